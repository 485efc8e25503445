"""Language-model and toxicity scores against brute force and held-out labels."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from vigilframe.llm.lattice_lm import SubwordLattice, lattice_scores
from vigilframe.llm.toxicity import Chain, drop_toxic, toxicity_scores

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute_chance(lattice, word):
    total = 0.0
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        parts, at = [], 0
        for k, c in enumerate(cuts, 1):
            if c:
                parts.append(word[at:k])
                at = k
        parts.append(word[at:])

        def chance(p):
            if p in lattice.inner:
                return math.exp(lattice.inner[p])
            return math.prod(math.exp(lattice.inner[f"<0x{b:02X}>"]) for b in p.encode()) if len(p) == 1 else 0.0

        rest = math.prod(map(chance, parts[1:]))
        total += math.exp(lattice.start) * chance(parts[0]) * rest
        if parts[0] in lattice.opening:
            total += math.exp(lattice.opening[parts[0]]) * rest
    return math.log(total * math.exp(lattice.end))


def test_lattice_sums_all_segmentations():
    r = random.Random(1)
    pieces = ["▁the", "▁", "t", "h", "e", "th", "he", "▁a", "a", "aa", "aaa", "é", ""]
    lattice = SubwordLattice(MODEL, {p: r.randrange(1, 500) for p in pieces})
    words = ["the", "a", "thwhes", "é", "日本𝔘x", "don't", "aaaaaaa"]
    assert lattice.log_chances(words) == pytest.approx([brute_chance(lattice, w) for w in words], abs=1e-9)
    assert math.exp(lattice.start) + sum(map(math.exp, lattice.opening.values())) == pytest.approx(1)
    assert math.exp(lattice.end) + sum(map(math.exp, lattice.inner.values())) == pytest.approx(1)


def test_lattice_scores(spark):
    r = random.Random(3)
    vocab = ["the", "and", "Thing", "ünder", "ther,", "x"]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(0, 30))) + (f" odd{i}" if i % 3 else ""), 1) for i in range(60)] + [(60, None, 1), (61, "", 1), (3, "THE the\x0bthe", 1), (3, "THE the\x0bthe", 1), (None, "the", 1), (62, "w" * 9000, 1)]
    got = lattice_scores(spark.createDataFrame(rows, "doc_id long, text string, word int"), MODEL).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t, _ in rows if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, held(i), len(split(t)), sum(c[w] > 0 for w in split(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for i, t, _ in rows)
    assert sorted((x.doc_id if x.doc_id is not None else -1, x.held_out, x.n_tokens, x.n_known, round(x.base_score, 6)) for x in got) == want
    assert {x.train_tokens for x in got} == {n} and all(-1e6 < x.score < 0 for x in got)
    assert lattice_scores(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_forward_backward_against_all_paths():
    r = np.random.default_rng(2)
    chain = Chain({}, bias=-0.3, moves=r.normal(size=(2, 2)))
    scores, size = r.normal(size=(3, 5)), np.array([5, 2, 4])
    toxic, pairs, total = chain.marginals(scores, size)
    for k, n in enumerate(size):
        weight = {p: math.exp(sum(scores[k, t] * y for t, y in enumerate(p)) + sum(chain.moves[a, b] for a, b in zip((0, *p), p))) for p in itertools.product((0, 1), repeat=int(n))}
        z = sum(weight.values())
        assert total[k] == pytest.approx(math.log(z))
        assert toxic[k, :n] == pytest.approx([sum(w for p, w in weight.items() if p[t]) / z for t in range(n)])
        assert pairs[k, 0] == pytest.approx(np.array([[sum(w for p, w in weight.items() if p[:2] == (a, b)) / z for b in (0, 1)] for a in (0, 1)]))


@pytest.mark.parametrize("seed", range(6))
def test_chances_over_whole_texts_against_all_steps(seed):
    r = np.random.default_rng(seed)
    chain = Chain({}, bias=float(r.normal(-1, 2)), moves=r.normal(size=(2, 2)) * 2)
    for n, at in ((1, [0]), (7, [0, 6]), (9, [4]), (400, [3, 4, 90, 350]), (60, list(range(60)))):
        score = r.normal(size=len(at)) * 3
        every = np.full((1, n), chain.bias)
        every[0, at] = score
        assert chain.chances(n, at, score.tolist()) == pytest.approx(chain.marginals(every, np.array([n]))[0][0], abs=1e-9)


def toxic_corpus(seed):
    r = random.Random(seed)
    words = ["the", "thing", "over", "Under", "été", "near"]
    docs, labels = [], []
    for i in range(500):
        w = [r.choice(words) for _ in range(r.randrange(5, 60))]
        toxic = int(r.random() < 0.25)
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["Idiot", "scum", "vequ" + r.choice(["re", "la", "tion", "xi"])]))
        docs.append((i, " ".join(w), "en"))
        labels.append((i, toxic))
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_corpus(4)
    odd = [(900, None, "en"), (901, "", None), (902, "x " * 40000 + "idiot Scum idiot", "en"), (5, docs[5][1], "en")]
    frame = spark.createDataFrame(docs + odd, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels + [(7, None), (None, 1), (902, None)], "doc_id long, toxic int")
    got = toxicity_scores(frame, known).collect()
    assert len(got) == len(docs) + len(odd)
    score = {x.doc_id: x.score for x in got}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((score[i] >= 0.5) == bool(y) for i, y in held) >= 0.98 * len(held)
    assert score[900] == score[901] < 0.5 <= score[902]
    spans = next(x.spans for x in got if x.doc_id == 902)
    assert ("x " * 40000 + "idiot Scum idiot")[spans[0].start : spans[0].stop] == "idiot" and len(spans) == 3
    left = {x.doc_id for x in drop_toxic(frame, known).collect()}
    assert left == {i for i, s in score.items() if s < 0.5}
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(x.score < 0.5 for x in toxicity_scores(frame, none).collect())
    assert toxicity_scores(frame.limit(0), known).count() == 0
