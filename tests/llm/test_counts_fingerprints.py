"""Edit-aware counts and winnowing fingerprints against plain versions, and the whole pipeline."""

import hashlib
import random

import public_tokenizers
import regex
import xxhash
from pyspark.sql import functions as F

from vigilframe.llm.token_counts import CountTree, count_edited, counter
from vigilframe.llm.winnowing import GRAM, PARTED, PLACE, PLACE_BITS, UNIT, WINDOW, chosen, fingerprint_documents, hashes, likeness, op3_winnowing, places

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_counts_after_random_edits():
    counts, r = counter(RANKS), random.Random(1)
    bits = ["the", " ", "  ", "\n", "'s", "'", "re", "42", "é", "!?", "日本", "x" * 20, "\t ", "don't", "'l", "l"]
    for _ in range(300):
        text = "".join(r.choice(bits) for _ in range(r.randrange(0, 40)))
        tree = CountTree(text, counts)
        assert tree.total == len(counts.encoding.encode_ordinary(text))
        for _ in range(6):
            start, length, new = r.randrange(0, len(text) + 2), r.randrange(0, 6), "".join(r.choice(bits) for _ in range(r.randrange(0, 4)))
            text = text[:start] + new + text[start + length :]
            tree.edit(start, length, new)
            assert tree.text() == text and tree.total == len(counts.encoding.encode_ordinary(text)), (text, start, length, new)


def test_an_edit_touches_little(spark):
    text = "some words, and more. " * 2000
    tree = CountTree(text, counter(RANKS))
    tree.edit(20000, 4, "edit")
    assert tree.recut < 20
    rows = [(1, text, [(5, 2, "yz"), (0, 0, None)]), (2, None, [(3, 4, "new")]), (3, "abc", None), (3, "abc", [])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start int, length int, replacement string>>")
    got = sorted(map(tuple, count_edited(frame, RANKS).collect()))
    e = counter(RANKS).encoding.encode_ordinary
    assert [(x[0], x[1], x[2]) for x in got] == [(1, len(e(text)), len(e(text[:5] + "yz" + text[7:]))), (2, 0, len(e("new"))), (3, 1, 1), (3, 1, 1)]
    assert count_edited(frame.limit(0), RANKS).count() == 0


def signed(x):
    return x - 2**64 if x >> 63 else x


def plain_chosen(text):
    if not text:
        return []
    units = regex.findall(r"[^ \t\n\x0B\f\r]{1,%d}" % UNIT, text)
    word = lambda s, seed=42: xxhash.xxh64_intdigest(s.encode(), seed)
    if not units:
        return [signed(word(text) | PLACE)]

    def gram(hs):
        turned = lambda h, k: (h << k | h >> (64 - k)) & (2**64 - 1)
        out = 0
        for k, h in enumerate([*hs, *[0] * (GRAM - len(hs))]):
            out ^= turned(h, GRAM - 1 - k) if k < GRAM - 1 else h
        return out

    h = [word(u) for u in units]
    g = [(gram(h[i : i + GRAM]) & ~PLACE & (2**64 - 1)) + PLACE - i for i in range(max(1, len(h) - GRAM + 1))]
    g = [signed(x) for x in g]
    wins = [g[i : i + WINDOW] for i in range(max(1, len(g) - WINDOW + 1))]
    return list(dict.fromkeys(min(w) for w in wins))


def test_winnowing(spark):
    r = random.Random(2)
    words = ["the", "a", "thing", "x" * 40, "é", "日本"]
    texts = ["", None, " \n", "one", "one two", " ".join(["the"] * 50), "ab" * 500] + [" ".join(r.choice(words) for _ in range(r.randrange(1, 80))) for _ in range(40)]
    rows = [(7 * i + (i > 20) * 10**12, t, "c") for i, t in enumerate(texts)] + [(7, "again", "c"), (None, "null id", "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, chosen string")
    got = fingerprint_documents(frame).select("*", hashes(F.col("chosen")).alias("h"), places(F.col("chosen")).alias("p")).collect()
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((i, t, edited, plain_chosen(t), plain_chosen(edited), plain_chosen(after)))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((x.doc_id, x.text, x.edited, x.chosen, x.edited_chosen, x.next_chosen) for x in got), key=key) == sorted(want, key=key)
    for x in got:
        assert x.p == [PLACE - (c & PLACE) for c in x.chosen] and x.p == sorted(x.p)
    assert fingerprint_documents(frame.limit(0)).count() == 0
    one = fingerprint_documents(frame.where("doc_id = 14")).collect()
    assert len(one) == 1 and one[0].next_chosen == one[0].chosen


def test_the_next_document_among_hot_and_far_ids(spark, monkeypatch):
    import vigilframe.llm.winnowing as module

    monkeypatch.setattr(module, "STRETCHES", 16)
    monkeypatch.setattr(module, "BUCKET", 4)
    monkeypatch.setattr(module, "SHELF", 8)
    r = random.Random(5)
    say = lambda: "".join(r.choice("abcé日") for _ in range(r.randrange(12)))
    rows = [(i, say()) for i in range(200)] + [(None, say()) for _ in range(150)] + [(77, say()) for _ in range(150)] + [(2**63 - 1, "far"), (-(2**63), "low"), (10**15, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = module.with_next(frame.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), lambda t: F.length(t)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((x.doc_id, x.text, x.next_text, x.next_x) for x in got), key=key) == sorted(((*a, b[1], len(b[1])) for a, b in zip(order, order[1:] + order[:1])), key=key)


def test_likeness(spark):
    cases = [([], []), ([1], []), ([1, 2, 2, 3], [3, 2, 9]), ([5], [5, 5]), ([1], [2])]
    rows = spark.createDataFrame(cases, "a array<long>, b array<long>").select("a", "b", likeness(F.col("a"), F.col("b")).alias("x")).collect()
    for r in rows:
        a, b = set(r.a), set(r.b)
        assert r.x == (1.0 if not a | b else len(a & b) / len(a | b))


def test_the_registered_query(spark, tmp_path):
    r = random.Random(12)
    words = ["alpha", "beta", "gamma", "delta", "x" * 30 + "a7", "日本語"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(40)))) for i in range(30)] + [(40, None), (41, ""), (None, "some text here")]
    rows.append((50, rows[3][1]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in op3_winnowing(spark, str(tmp_path)).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    prints = {t: set(c >> PLACE_BITS for c in (x or [])) for t, x in spark.createDataFrame([(t,) for t in {t for _, t in order}], "t string").select("t", chosen(F.col("t"), PARTED)).collect()}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        both = prints[t] | prints[after]
        assert got[i].near_next == (len(prints[t] & prints[after]) / len(both) if both else 1.0) and 0 <= got[i].near_edited <= 1
        if edited == t:
            assert got[i].fingerprint == got[i].edited_fingerprint and got[i].near_edited == 1
    assert got[50].fingerprint == got[3].fingerprint and got[40].fingerprint == got[41].fingerprint != got[3].fingerprint


def test_rightmost_tie_and_guarantee(spark):
    shared = "alpha beta gamma delta epsilon zeta eta"
    a, b = spark.createDataFrame([("x y " + shared + " z", "q " + shared + " w v")], "a string, b string").select(hashes(chosen(F.col("a"))), hashes(chosen(F.col("b")))).first()
    assert set(a) & set(b) and len(shared.split()) == GRAM + WINDOW - 1
    same = spark.createDataFrame([("the " * 12,)], "a string").select(places(chosen(F.col("a")))).first()[0]
    assert same == list(range(WINDOW - 1, 12 - GRAM + 1)) and PLACE_BITS == 24


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(3)
    words = [a + b for a in ("th", "er", "on", "qu") for b in ("e", "an", "or", "ing", "x")]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = say(160)
    docs = [(i, say(60), "en", "s", 0) for i in range(300)]
    labels = []
    for i in range(0, 120):
        docs[i] = (i, docs[i][1] + " idiot scum idiot", "en", "s", 0)
        labels.append((i, 1, 1))
    labels += [(i, 1, 0) for i in range(120, 280)]
    docs += [(400 + k, say(20) + " " + passage + " " + say(20), "en", "s", 0) for k in range(4)] + [(500, docs[200][1], "en", "s", 0), (501, None, None, None, None), (502, "idiot moron scum idiot", "de", "s", 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == columns
        seen[name] = {x.doc_id: x.text for x in frame.collect()}
    ids = {d[0] for d in docs} - set(range(120)) - {502}
    assert set(seen["toxicity"]) == ids
    assert set(seen["simhash_near_dedup"]) == ids - {500}
    for k in range(4):
        assert passage[5:-5] not in seen["suffix_array_dedup"][400 + k] and len(seen["suffix_array_dedup"][400 + k].split()) >= 36
    assert seen["suffix_array_dedup"][200] == docs[200][1] and seen["suffix_array_dedup"][501] is None
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in out} == ids - {500}
    assert hashlib.sha256(b"").hexdigest() and corpus_pipeline.ORACLE_SQL is None
