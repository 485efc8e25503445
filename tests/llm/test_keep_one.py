"""Near-duplicate removal drops near duplicates only."""

import random

from vigilframe.llm.simhash import keep_one_of_each


def test_null_and_shared_ids_keep_different_texts(spark):
    r = random.Random(9)
    say = lambda: " ".join(r.choice("abcdefgh") + r.choice("klmnop") for _ in range(80))
    a, b, c, d, e = (say() for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (9, e), (3, e), (None, e), (None, None), (8, ""), (-2, "")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = keep_one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=str) == sorted([(None, a), (None, b), (7, c), (7, d), (3, e), (-2, "")], key=str)
    assert keep_one_of_each(docs.limit(0)).count() == 0
