"""Passages without spaces are found wherever they stand."""

import random

import pytest

from vigilframe.llm.winnowing import op3_winnowing


@pytest.mark.parametrize("letters", ["".join(map(chr, range(0x4E00, 0x4F00))), "".join(map(chr, range(0x0E01, 0x0E2F))), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"])
def test_a_shifted_passage_without_spaces(spark, tmp_path, letters):
    r = random.Random(10)
    passage = "".join(r.choice(letters) for _ in range(400))
    spark.createDataFrame([(2, passage), (1, "x" + passage), (0, "plain words stay as they are")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in op3_winnowing(spark, str(tmp_path)).collect()}
    assert got[2].near_next > 0.8 and got[1].near_next == 0
