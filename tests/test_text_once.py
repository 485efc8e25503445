"""Texts are looked through once a row, not once for each entity."""

import html

from pyspark.sql import functions as F

from vigilframe.functions.text import unescaped


def test_entities_of_a_long_page(spark):
    bits = ["a &copy; b", "&middot;&eacute;&amp;lt;", "x&#233;y&#x41;", "&nosuchname;", "", "&NotEqualTilde;"]
    pages = ["", "plain", "&copy;", "&copy;&copy;", *(" ".join(bits[(i * k) % len(bits)] for i in range(60)) for k in range(1, 6))]
    d = spark.createDataFrame([(p,) for p in pages], "p string").select("p", unescaped(F.col("p")).alias("got"))
    plan = d._jdf.queryExecution().analyzed().toString()
    assert "from_json" not in plan and "sequence(" not in plan
    assert all(x.got == html.unescape(x.p.replace("&nosuchname;", "&amp;nosuchname;")) for x in d.collect())
