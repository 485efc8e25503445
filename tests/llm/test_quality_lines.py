"""Quality rules: counts against plain ones, Viterbi against all labellings, verdicts on held-out rows."""

import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from vigilframe.llm import quality_lines as ql
from vigilframe.llm.queries import QUERIES
from vigilframe.llm.toxicity import Chain

DATA = "/root/testdata/sf0.01"
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def plain(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often, marked = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            marked |= set(range(k, k + 8))
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\\x20\\x09-\\x0D]", line):
            again += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(marked), n < 20 or 100 * len(marked) > 30 * n


def texts():
    r = random.Random(2)
    some = ["".join(r.choice(["the ", "Straße ", "  ", "\n", "a b ", "\t", "#", "x.\n", "日本 ", "\x1c", "\x85", "\r\n", "|"]) for _ in range(r.randint(1, 300))) for _ in range(60)]
    twice = " ".join(f"w{k}" for k in range(12))
    return [None, "", " \n\t", "one", f"{twice} mid {twice}", f"{twice}\n{twice}\n{twice}", "w " * 9, "w " * 5000, "long" * 100_000, *some]


@pytest.mark.parametrize("text", texts())
def test_measures(text):
    assert tuple(ql.measures(text or "")[n] for n in NAMES) == plain(text)


def test_viterbi_by_all_labellings():
    r = np.random.default_rng(1)
    for _ in range(60):
        chain = Chain({}, r.normal(size=6) * 2, float(r.normal()), r.normal(size=(2, 2)))
        lines = [tuple(r.choice(6, size=int(r.integers(0, 4)), replace=False).tolist()) for _ in range(int(r.integers(1, 8)))]

        def score(states, chain=chain, lines=lines):
            total, before = 0.0, 0
            for y, active in zip(states, lines, strict=True):
                total += chain.moves[before, y] + (chain.bias + chain.weights[list(active)].sum() if y else 0)
                before = y
            return total

        assert score(ql.viterbi(chain, lines)) == pytest.approx(max(map(score, itertools.product((0, 1), repeat=len(lines)))))


def test_op13(spark, tmp_path):
    r = random.Random(4)
    good = lambda: "\n".join(" ".join(r.choice(["the", "wind", "blew", "over", "hills", "Straße", "and", f"k{r.randint(0, 999)}"]) for _ in range(r.randint(12, 30))) + "." for _ in range(3))
    bad = lambda: "\n".join(" ".join(f"k{r.randint(0, 999)}" + r.choice(["$$$", "###", "&&&"]) for _ in range(r.randint(12, 30))) for _ in range(3))
    rows = [(k, bad() if k % 3 == 0 else good()) for k in range(300)] + [(1000 + k, t) for k, t in enumerate(texts())] + [(None, good()), (0, good())]
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bad int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(300)] + [(None, 1), (5, None), (7, 9)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["op13_quality_lines"](spark, str(tmp_path)).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((x.doc_id, *(x[n] for n in NAMES)) for x in got), key=key) == sorted(((i, *plain(t)) for i, t in rows), key=key)
    assert not any(x.kept and x.base_failed for x in got)
    assert sum(x.kept for x in got if x.doc_id is not None and x.doc_id < 300 and x.doc_id % 3 == 0) == 1  # the other row of id 0
    assert all(x.kept for x in got if x.doc_id is None or x.doc_id < 300 and x.doc_id % 3)
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    lines = {x.doc_id: x.lines for x in ql.content_lines(docs, labels).where("doc_id IN (1, 3, 1000)").collect()}
    assert [y.content for y in lines[1]] == [True] * 3 and [y.content for y in lines[3]] == [False] * 3 and lines[1000] == []


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c " * 3), (2, " ".join(map(str, range(30))))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {x.doc_id: x.kept for x in ql.quality_verdicts(docs, none).collect()} == {1: False, 2: True}
    assert ql.quality_verdicts(docs.limit(0), none).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_held_out(spark):
    got = QUERIES["op13_quality_lines"](spark, DATA).where("crc32(cast(doc_id AS string)) % 5 = 0 AND NOT base_failed")
    rows = got.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").select("kept", "quality").collect()
    assert sum(x.kept == bool(x.quality) for x in rows) >= 0.97 * len(rows) > 40
