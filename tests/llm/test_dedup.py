"""SimHash, embedding and suffix-array deduplication against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from vigilframe.llm import suffix_dedup
from vigilframe.llm.components import connected_components
from vigilframe.llm.embeddings import least_count, link_vectors
from vigilframe.llm.simhash import BKTree, keep_one_of_each, near_links, simhash, simhash_components
from vigilframe.llm.suffix_dedup import LENGTH, removal_digests, remove_repeats, repeated_reach

WORDS = [f"{a}{b}" for a in ("th", "er", "on", "qu", "st", "é") for b in ("e", "an", "or", "ing", "x")]


def words(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def classes(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for p in links for x in p}
    assert got == classes(nodes, links)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def reference_simhash(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark):
    r = random.Random(1)
    base = words(r, 400)
    texts = [base, base, base.replace("the", "ERX", 1), base + " x", "", None, " \n\t", "A", "a", "A b", "a  b\n"] + [words(r, r.randrange(1, 60)) for _ in range(30)] + ["long " * 5000]
    rows = [(i + 5, t, "clash") for i, t in enumerate(texts)] + [(5, base, "again")]
    fps = {i: reference_simhash(t or "") for i, t, _ in rows}
    want = classes(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    got = simhash_components(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert len(got) == len(rows)
    assert {x.doc_id: x.fp % 2**64 for x in got} == fps
    assert {x.doc_id: x.component_id for x in got} == want
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bk_tree_and_shards_find_all_near(spark, monkeypatch):
    import vigilframe.llm.simhash as module

    monkeypatch.setattr(module, "TREE_NODES", 16)
    r = random.Random(2)
    seeds = [r.getrandbits(64) for _ in range(20)]
    values = {s ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))) for s in seeds for _ in range(30)}
    tree = BKTree()
    for v in values:
        tree.add(v)
    some = next(iter(values))
    assert set(tree.near(some, 2)) == {v for v in values if (v ^ some).bit_count() <= 2}
    rows = [(v - 2**64 if v >> 63 else v, i) for i, v in enumerate(sorted(values))]
    got = connected_components(near_links(spark.createDataFrame(rows, "fp long, id long"))).collect()
    ids = {i: v % 2**64 for v, i in rows}
    want = classes(ids, [(a, b) for a in ids for b in ids if a < b and (ids[a] ^ ids[b]).bit_count() <= 2])
    assert {i: {x.node: x.component for x in got}.get(i, i) for i in ids} == want


def test_embedding_links(spark, monkeypatch):
    import vigilframe.llm.embeddings as module

    monkeypatch.setattr(module, "BLOCK", 32)
    r = np.random.default_rng(3)
    rows, n = [], 0
    for label in (0, 1, 1, 1, None):
        centre = r.standard_normal(64)
        for spread in (0, 0, 0.02, 0.2, 0.3, 0.34, 0.38, 0.42, 0.5, 0.6) * 5:
            v = centre + spread * r.standard_normal(64)
            rows.append((n, label, [float(x) for x in v.astype("f4")]))
            n += 1
    rows += [(n, 0, None), (n + 1, 0, []), (n + 2, 0, [0.0] * 64), (n + 3, 0, [float("nan")] + [1.0] * 63), (n + 4, 1, [None] + [1.0] * 63), (n + 5, 0, [float("inf")] * 64)]
    unit = {i: (l, np.array(v) / np.sqrt((np.array(v) ** 2).sum())) for i, l, v in rows[:n] if l is not None}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a][0] == unit[b][0] and unit[a][1] @ unit[b][1] >= 0.93]
    want = classes([x[0] for x in rows], links)
    got = {x.vec_id: x for x in link_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("id", F.lit(1))).collect()}
    assert {i: x.component_id for i, x in got.items()} == want
    assert {i: x.n_links for i, x in got.items()} == {i: sum(i in p for p in links) for i in want}
    assert link_vectors(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_calibrated_count():
    assert least_count(64, 1.5, 0.9999) < least_count(64, 1.5, 0.9) <= 64 and least_count(64, 1.5, 0.9999) > 40


def brute_removed(texts):
    raws, starts = [(t or "").encode() for t in texts], {}
    for i, raw in enumerate(raws):
        for s in range(len(raw) - LENGTH + 1):
            starts.setdefault(raw[s : s + LENGTH], []).append((i, s))
    gone = [bytearray(len(x)) for x in raws]
    for places in starts.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + LENGTH] = b"\1" * LENGTH
    return raws, gone


def passages(r):
    shared = [words(r, 150) for _ in range(3)]
    texts = [words(r, 40) + s[r.randrange(30) :] + words(r, 40) for s in shared for _ in range(6)]
    near = words(r, 400)
    for _ in range(8):
        k = r.randrange(len(near))
        texts.append(near[:k] + "ß" + near[k + r.randrange(3) :])
    texts += [words(r, 120)] * 3 + ["x" * 900, "ab" * 260, "é" * 260, "", None, "short", words(r, 60) + shared[0] + words(r, 5) + shared[0]]
    return texts + [near[: 400 + k] for k in range(3)]


def check_removal(spark, texts):
    rows = [(i, t, 7) for i, t in enumerate(texts)]
    raws, gone = brute_removed(texts)
    got = {x.doc_id: x for x in removal_digests(spark.createDataFrame(rows, "doc_id long, text string, start int")).collect()}
    for i, (raw, g) in enumerate(zip(raws, gone, strict=True)):
        kept = bytes(b for b, x in zip(raw, g, strict=True) if not x)
        runs = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        x = got[i]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == (len(raw), sum(g), runs, hashlib.sha256(kept).hexdigest()), (i, texts[i][:50] if texts[i] else None, x, sum(g), runs)


def test_suffix_dedup_matches_brute_force(spark):
    check_removal(spark, passages(random.Random(4)))


def test_suffix_dedup_of_hot_groups_and_segments(spark, monkeypatch):
    import vigilframe.llm.suffix_dedup as module

    monkeypatch.setattr(module, "SORT_CLASSES", 2)
    monkeypatch.setattr(module, "SEGMENT", 500)
    monkeypatch.setattr(module, "SORT_ROWS", 10)
    check_removal(spark, passages(random.Random(5)))


def test_hot_groups_survive_hash_collisions(spark, monkeypatch):
    import vigilframe.llm.suffix_dedup as module

    monkeypatch.setattr(module, "SORT_CLASSES", 2)
    monkeypatch.setattr(module, "HASH_BITS", 2)
    check_removal(spark, passages(random.Random(15)))


def test_hot_contexts_with_little_in_common_make_few_rows(spark, monkeypatch):
    import vigilframe.llm.suffix_dedup as module

    made, join = [], module.join_heavy
    monkeypatch.setattr(module, "join_heavy", lambda rows, told, keys, *more: (made.append((keys, rows.count())), join(rows, told, keys, *more))[1])
    r = random.Random(23)
    gram = r.randbytes(32)
    sides = [(r.randbytes(368), gram + r.randbytes(368)) for _ in range(20)]
    sides.append((sides[0][0][:200] + r.randbytes(168), sides[0][1][:250] + r.randbytes(150)))  # strings that start 150 to 200 bytes before
    hot = spark.createDataFrame([(i, 7, b, a) for i, (b, a) in enumerate(sides)], "id long, anchor long, before binary, after binary")
    assert sorted(tuple(x) for x in module.crowd_reach(hot, 400).collect()) == [(0, 200, 250), (20, 200, 250)]
    counts = [n for keys, n in made if keys == ["h"]]
    assert counts[0] == 21 * 6 and sum(counts) < 21 * 12


def test_pipeline_removes_passages_of_over_50_words_only(spark):
    r = random.Random(16)
    shared = {n: words(r, n) for n in (30, 51, 55, 60)}
    rows = [(None, None), (0, ""), (1, words(r, 300))]
    rows += [(10 * n + k, words(r, 80) + " " + text + " " + words(r, 80)) for n, text in shared.items() for k in range(3)]
    rows += [(None, words(r, 40) + " " + shared[60]), (610, words(r, 500)), (610, words(r, 20))]
    docs = spark.createDataFrame([(i, t, 5, b"x") for i, t in rows], "doc_id long, text string, start int, spans binary")
    out = remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    got = [(x.doc_id, x.text) for x in out.collect()]
    assert sorted(x[0] or -1 for x in got) == sorted(x[0] or -1 for x in rows)
    for n, text in shared.items():
        held = sum(text in (x or "") for _, x in got)
        assert held == (3 if n == 30 else 0), n
    before, after = dict((x for x in rows if x[0] in (0, 1))), dict((x for x in got if x[0] in (0, 1)))
    assert before == after and (None, None) in got


def test_sorting_survives_hash_collisions(monkeypatch):
    import vigilframe.llm.suffix_dedup as module

    r = random.Random(6)
    rights = [("a" * r.randrange(40) + words(r, 90)).encode()[:LENGTH] for _ in range(40)]
    lefts = [words(r, 90).encode()[: module.REACH] for _ in range(20)] * 2
    group = np.repeat([1, 2, 3, 4], [1, 2, 7, 30])
    want = repeated_reach(lefts, rights, group)
    monkeypatch.setattr(module, "BASE", np.uint64(0))
    assert [x.tolist() for x in repeated_reach(lefts, rights, group)] == [x.tolist() for x in want]


def test_texts_after_removal(spark):
    r = random.Random(7)
    shared = words(r, 150)
    rows = [(1, f"é {shared}\té", 900, "en"), (2, f"ü\n{shared} x", 900, "en"), (3, None, 0, "en"), (4, "clean", 5, None)]  # units are whole words
    got = {x.doc_id: x for x in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, lang string")).collect()}
    assert got[1].text == "é \té" and got[1].n_chars == 4 and got[2].text == "ü\n x" and got[3].text is None and got[4].text == "clean"
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def unit_spans(texts, units):
    """Of each text the code points outside all windows of so many units that stand elsewhere too, by counting all windows."""
    found = [list(suffix_dedup.UNIT.finditer(t or "")) for t in texts]
    windows = Counter(tuple(m.group() for m in f[k : k + units]) for f in found for k in range(len(f) - units + 1))
    out = []
    for text, f in zip(texts, found, strict=True):
        gone = set()
        for k in range(len(f) - units + 1):
            if windows[tuple(m.group() for m in f[k : k + units])] > 1:
                gone |= set(range(k, k + units))
        at, rest, run = 0, [], None
        for k in [*sorted(gone), None]:
            if run is not None and (k is None or k != run[1] + 1):
                rest.append(text[at : f[run[0]].start()])
                at, run = f[run[1]].end(), None
            if k is not None:
                run = (run[0] if run else k, k)
        out.append(text if text is None else "".join(rest) + text[at:])
    return out


def test_passages_by_units(spark, monkeypatch):
    r = random.Random(21)
    short = " ".join(r.choice("abcdefgh") for _ in range(55))
    kanji = "".join(chr(0x4E00 + r.randrange(2000)) for _ in range(280))
    thai = "".join(chr(0x0E01 + r.randrange(40)) for _ in range(60))
    some = [None, "", words(r, 60)]
    for shared in (short, kanji, thai, words(r, 51), words(r, 50), "な" * 50, f"{words(r, 30)} {kanji[:20]}{words(r, 3)}"):
        some += [f"{words(r, r.randrange(30))} {shared} {words(r, r.randrange(30))}" for _ in range(2)]
    some += ["a b " * 60, kanji[100:200] + "。" + kanji[:60], some[-1], some[-1]]
    rows = [(i % 9 if i % 7 else None, t, i, "mine", [i]) for i, t in enumerate(some)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key int, th string, repeat_spans array<int>")
    want = unit_spans(some, 51)
    for classes in (256, 2):
        monkeypatch.setattr(suffix_dedup, "PASSAGE_CLASSES", classes)
        out = remove_repeats(docs)
        assert out.columns == docs.columns
        got = {x.row_key: (x.text, x.doc_id, x.th, x.repeat_spans) for x in out.collect()}
        assert got == {i: (want[i], key, th, spans) for key, _, i, th, spans in rows}
    assert sum(a != b for a, b in zip(some, want, strict=True)) >= 14


def test_one_of_each_keeps_columns_of_any_name(spark):
    r = random.Random(22)
    a = words(r, 80)
    rows = [(1, a, "mine", 2, [1]), (1, a, "other", 1, [2]), (2, words(r, 90), None, None, None), (3, a, "late", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key string, row int, first array<int>")
    found = [keep_one_of_each(docs.repartition(n)) for n in (1, 3)]
    assert all(f.columns == docs.columns for f in found)
    one, two = (sorted(tuple(x) for x in f.collect()) for f in found)
    assert one == two and {x[0] for x in one} == {1, 2} and len(one) == 2 and set(one) <= {tuple(x) for x in rows}
