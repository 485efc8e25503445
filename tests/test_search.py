"""The token index against a plain search of every row."""

import random
import re
import unicodedata

from vigilframe.operators.commits import new_folder
from vigilframe.operators.search import SearchIndex


def plain_words(text):
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return re.findall(r"[^\W_]+", bare.lower())


def plain(rows, asked):
    out = set()
    for query, text in asked:
        terms = plain_words(text)[:8]
        if 2 <= len(text.strip(" ")) <= 100 and terms:
            out |= {(query, i) for i, *said in rows if i is not None and all(any(w.startswith(t) for w in plain_words(" ".join(s for s in said if s is not None))) for t in terms)}
    return out


WORDS = ["Über", "uber", "Straße", "naïve", "Flood", "flooding", "flo", "ÉCOLE", "日本", "日", "Київ", "2024", "2", "a_b", "it's", "x-ray", "", "!?"]
ASKED = [(k, q) for k, q in enumerate(["flo", "ÜBER flo", "strasse", "straße", "日", "київ 2", "a b", "ecole NAIVE", "x", " ", "x" * 101, "?!", "flood flood", "it s x ray", "a b c d e f g h zzz", "2024 uber"])]


def rows(r, ids):
    return [(i, *(None if r.random() < 0.1 else " ".join(r.choice(WORDS) for _ in range(r.randint(0, 6))) for _ in range(2))) for i in ids]


def test_search_replace_compact(spark):
    r = random.Random(1)
    known = rows(r, [*range(200), None])
    table = lambda some: spark.createDataFrame(some, "event long, headline string, summary string")
    asked = spark.createDataFrame(ASKED, "query int, asked string")
    index = SearchIndex(spark, new_folder(spark)).put(table(known), "event", ["headline", "summary"])
    found = lambda: {(x.query, x.id) for x in index.search(asked).collect()}
    assert found() == plain(known, ASKED) and len({q for q, _ in found()}) >= 9
    changed = rows(r, range(150, 230))
    index.put(table(changed), "event", ["headline", "summary"])
    known = known[:150] + known[200:] + changed
    assert found() == plain(known, ASKED)
    index.remove(spark.createDataFrame([(k,) for k in range(0, 230, 3)], "id long"))
    known = [x for x in known if x[0] is None or x[0] % 3]
    assert found() == plain(known, ASKED)
    index.compact()
    assert index._generations() == [3] and found() == plain(known, ASKED)
    # A writer that died before its commit leaves files that don't count.
    table(rows(r, range(5))).selectExpr("event AS id", "headline AS token", "'f' AS head").write.partitionBy("head").parquet(f"{index.path}/tokens/gen=4")
    assert found() == plain(known, ASKED)


def test_many_terms_and_nothing(spark):
    r = random.Random(2)
    known = [(str(i), *t) for i, *t in rows(r, range(40))]
    index = SearchIndex(spark, new_folder(spark)).put(spark.createDataFrame(known, "id string, a string, b string"), "id", ["a", "b"])
    import vigilframe.operators.search as s

    many = [(k, w) for k, (_, w) in enumerate(ASKED)]
    table = spark.createDataFrame(many, "query int, asked string")
    before = s.BROADCAST_TERMS
    try:
        s.BROADCAST_TERMS = 3
        assert {(x.query, x.id) for x in index.search(table).collect()} == plain(known, many)
    finally:
        s.BROADCAST_TERMS = before
    assert index.search(table.limit(0)).collect() == []
    empty = SearchIndex(spark, new_folder(spark)).put(spark.createDataFrame([], "id string, a string"), "id", ["a"])
    assert empty.search(table).collect() == []


def test_ranges_reach_the_scan(spark):
    index = SearchIndex(spark, new_folder(spark)).put(spark.createDataFrame([(1, "flood fire storm")], "id long, a string"), "id", ["a"])
    plan = index.search(spark.createDataFrame([(1, "flo")], "query int, asked string"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*head", plan) and re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(token,flo\)", plan)


def test_frequent_terms_make_no_pairs(spark):
    rows = [(i, f"common often n{i:02}x") for i in range(40)] + [(100, "common often")]
    index = SearchIndex(spark, new_folder(spark)).put(spark.createDataFrame(rows, "id long, a string"), "id", ["a"])
    found = index.search(spark.createDataFrame([(f"q{i}", f"comm; oft n{i:02}") for i in range(40)] + [("all", "often COMMON"), ("none", "common else")], "query string, asked string"))
    assert sorted(tuple(x) for x in found.collect()) == sorted([(f"q{i}", i) for i in range(40)] + [("all", i) for i, _ in rows])
    keys = re.findall(r"keys=\[([^\]]*)\]", found._jdf.queryExecution().executedPlan().toString())
    assert keys and not any("query#" in k and re.search(r"\bid#", k) for k in keys)  # rows are gathered by id, not for each query that has one of their words
