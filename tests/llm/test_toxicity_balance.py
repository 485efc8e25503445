"""The bound of the training sample doesn't shift the balance of labels."""

import random

import pytest

import vigilframe.llm.toxicity as toxicity


def corpus():
    """One document in ten is toxic; "perhaps" stands in half of the toxic and in one of six clean ones."""
    r, docs, labels = random.Random(8), [], []
    for i in range(3000):
        toxic = int(i % 10 == 0)
        w = [r.choice(["the", "over", "near"]) for _ in range(12)]
        if r.random() < (0.5 if toxic else 1 / 6):
            w[r.randrange(12)] = "perhaps"
        if toxic and r.random() < 0.9:
            w[r.randrange(12)] = "scum"
        docs.append((i, " ".join(w)))
        labels.append((i, toxic))
    return docs, labels


def test_a_bounded_sample_scores_like_the_whole(spark, monkeypatch):
    docs, labels = (spark.createDataFrame(x, s) for x, s in zip(corpus(), ("doc_id long, text string", "doc_id long, toxic int"), strict=True))
    fitted, curves = {}, {}
    for bound in (4000, 200):
        monkeypatch.setattr(toxicity, "SAMPLE_PER_LABEL", bound)
        fitted[bound] = chain = toxicity.fit_chain(docs, labels)
        curves[bound] = chain.score(chain.tag(["the over near", "the perhaps near", "the scum near"]))
    assert "perhaps$" not in fitted[4000].index and set(fitted[200].index) == set(fitted[4000].index)
    assert curves[200][0] == pytest.approx(curves[4000][0], rel=0.5) and curves[200][0] < 0.03
    assert [x >= 0.5 for x in curves[200]] == [x >= 0.5 for x in curves[4000]] == [False, False, True]
