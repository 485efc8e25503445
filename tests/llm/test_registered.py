"""The registered queries themselves, on small tables of their own."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

from vigilframe.llm.lattice_lm import SubwordLattice, piece_counts, vocabulary, word_counts
from vigilframe.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def put(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def say(r, n):
    return " ".join(r.choice(["the", "Ander", "ting", "über", "of,", "wher", "erer"]) for _ in range(n))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    rel = con.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted(tuple(map(str, (r[c] for c in columns))) for r in df.collect()) == sorted(tuple(str(r[k]) for k in at) for r in rel.fetchall())


def test_op1(spark, tmp_path):
    r = random.Random(1)
    rows = [(1, say(r, 40)), (2, None), (3, ""), (4, "ﬁne  \n\ttabs 日本 𝔘"), (4, "again"), (None, "x" * 3000)]
    got = QUERIES["op1_sentencepiece"](spark, put(spark, tmp_path, documents=(rows, "doc_id long, text string"))).collect()
    model = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = model.encode(t or "")
        want.append((i or -1, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    assert sorted((x.doc_id or -1, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in got) == sorted(want)


def test_op2(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(2)
    rows = [(i, say(r, r.randrange(0, 900))) for i in range(60)] + [(100, say(r, 9000)), (101, None), (7, "twice"), (7, "twice"), (None, "twice"), (None, "twice")]
    got = QUERIES["op2_best_fit_packing"](spark, put(spark, tmp_path, documents=(rows, "doc_id long, text string"))).collect()
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want[i, k // 4096, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    ends = {}
    for x in sorted(got, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == ends.get(x.sequence_id, 0)
        ends[x.sequence_id] = x.offset + x.length
    assert max(ends.values()) <= 4096 and len(ends) <= -(-sum(x.length for x in got) // 4096) + 1


def test_op4_scores_are_the_sum_of_words_chances(spark, tmp_path):
    """Whole words by absolute discounting over all spellings of the lattice, and the end; each by hand."""
    r = random.Random(3)
    rows = [(i, say(r, r.randrange(0, 25)) + (f" rare{i}" if i % 4 == 0 else "")) for i in range(50)] + [(60, None), (61, "odd wörd"), (None, "the")]
    docs = put(spark, tmp_path, documents=(rows, "doc_id long, text string"))
    got = {x.doc_id: x for x in QUERIES["op4_lattice_lm"](spark, docs).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    train = [t for i, t in rows if not held(i)]
    c = Counter(w for t in train for w in split(t))
    n, v, ones, twos = sum(c.values()) + len(train), len(c) + 1, sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    discount = (ones + 1) / (ones + 2 * twos + 2)
    counts = word_counts(spark.createDataFrame([(t,) for t in train], "text string"))
    model = public_tokenizers.path("piece_bpe_32k.model")
    lattice = SubwordLattice(model, piece_counts(counts, model))
    spelt = {w: lattice.log_chance(w) for t in [t for _, t in rows] for w in split(t)}
    chance = lambda w: math.log10(max(c[w] - discount, 0) / n + discount * v / n * math.exp(spelt[w]))
    end = math.log10(max(len(train) - discount, 0.25) / n)
    for i, t in rows:
        assert got[i].score == pytest.approx(sum(map(chance, split(t))) + end, rel=1e-6), i
        assert got[i].held_out == held(i)


def test_hot_words_are_bounded(spark, monkeypatch):
    import vigilframe.llm.lattice_lm as module

    counts = spark.createDataFrame([(str(k).encode(), 1 + 3000 // (k + 1)) for k in range(500)], "word binary, c long")
    for bound in (0, 1, 7, 100, 499, 500, 1000):
        monkeypatch.setattr(module, "HOT_WORDS", bound)
        kept = counts.where(counts.c >= module.hot_count(counts)).count()
        assert kept <= bound and (kept == 500 if bound >= 500 else True) and kept >= bound // 3


def test_op5_with_ids_on_several_vectors(spark, tmp_path):
    r = np.random.default_rng(4)
    base = {k: r.normal(size=16) for k in range(3)}
    rows = []
    for k in range(90):
        v = base[k % 3] + r.normal(size=16) * (0.05 if k % 2 else 0.25)
        rows.append((k % 40 if k % 7 else k % 5, v.astype("f4").tolist(), k % 2))
    rows += [(5, [1.0, 2.0], 0), (6, [1.0, 2.0], 0), (7, [1.0, 2.0, 0.0], 0), (None, rows[0][1], 0), (8, None, 0), (9, [0.0] * 16, 0), (10, [float("nan")] * 16, 0), (11, rows[0][1], None)]
    path = put(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    got = Counter((x.vec_id, x.n_links, x.component_id, x.kept) for x in QUERIES["op5_embedding_neardup"](spark, path).collect())
    unit = []
    for _, v, label in rows:
        a = np.array(v if v is not None else [], "f8")
        fit = label is not None and len(a) and np.isfinite(a).all() and a.any()
        unit.append(a / np.sqrt(a @ a) if fit else None)
    links = {(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93}
    group = list(range(len(rows)))
    for _ in rows:
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    want = Counter()
    for i, (vec, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        least = min(ids) if ids else None
        want[vec, sum(i == a for a, _ in links), least if unit[i] is not None else vec, None if vec is None or (least if unit[i] is not None else vec) is None else vec == (least if unit[i] is not None else vec)] += 1
    assert got == want


def test_op6_null_and_repeated_ids(spark, tmp_path):
    from vigilframe.llm.simhash import simhash

    r = random.Random(5)
    texts = [say(r, 60) for _ in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[2]), (9, texts[2]), (None, texts[3]), (4, texts[4]), (2, texts[4]), (3, None), (8, ""), (5, texts[5]), (5, texts[5])]
    got = Counter((x.doc_id, x.fingerprint, x.component_id) for x in QUERIES["op6_simhash_neardup"](spark, put(spark, tmp_path, documents=(rows, "doc_id long, text string"))).collect())
    prints = [simhash(t or "") for _, t in rows]
    near = lambda a, b: (a ^ b).bit_count() <= 2
    want = Counter()
    for i, (doc, _) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = {j for j in range(len(rows)) if near(prints[j], prints[k])} - reach
            reach |= new
            todo += new
        want[doc, f"{prints[i]:016x}", min((rows[j][0] for j in reach if rows[j][0] is not None), default=None)] += 1
    assert got == want


def test_op9(spark, tmp_path):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        toxic = int(i % 4 == 0)
        w = say(r, r.randrange(5, 60)).split()
        for _ in range(2 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["idiot", "Scum"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    rows += [(None, "idiot scum"), (500, None), (3, "again")]
    got = QUERIES["op9_toxicity_crf"](spark, put(spark, tmp_path, documents=(rows, "doc_id long, text string"), labels=(labels, "doc_id long, quality int, toxic int"))).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    assert all(x.held_out == held(x.doc_id) and x.predicted == int(x.score >= 0.5) and 0 <= x.score <= 1 for x in got)
    truth = dict((i, y) for i, _, y in labels)
    scored = [x for x in got if x.doc_id in truth and x.doc_id != 3 and x.held_out]
    assert sum(x.predicted == truth[x.doc_id] for x in scored) >= 0.98 * len(scored)


def test_op10_columns(spark, tmp_path):
    r = random.Random(7)
    shared = say(r, 120)
    rows = [(1, "é" + shared + "x"), (2, "ü" + shared + "y"), (3, None), (4, shared.encode()[:399].decode(errors="ignore")), (None, say(r, 100))]
    got = {x.doc_id: x for x in QUERIES["op10_suffix_dedup"](spark, put(spark, tmp_path, documents=(rows, "doc_id long, text string"))).collect()}
    for i, t in rows:
        raw, gone = (t or "").encode(), shared.encode() if i in (1, 2) else b""
        kept = raw.replace(gone, b"") if gone else raw
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256, got[i].kept_text) == (len(raw), len(gone), int(bool(gone)), hashlib.sha256(kept).hexdigest(), kept.decode())


@pytest.mark.parametrize("rows", [[], [(None, None), (None, None)]])
def test_pipeline_on_empty_tables(spark, tmp_path, rows):
    import corpus_pipeline

    rows = [(*x, None, None, None) for x in rows]
    path = put(spark, tmp_path, documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"), labels=([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, path).count() == min(1, len(rows))
