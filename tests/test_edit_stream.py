"""The edit stream: bounded batches, broken and overlong lines, a restart; the same as its batch twin."""

import json
import random

from vigilframe.plans.ingest import MOST_BYTES, edit_stream, edits
from vigilframe.streaming.streams import run_available


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(6)
    made = lambda k: json.dumps({"event_id": k, "title": "t" * r.randrange(300), "comment": None if k % 5 == 0 else "ü" * r.randrange(900), "type": r.choice(["edit", "new", "log", None]), "size": r.choice([5, -10**10, None])})
    odd = ["", "{", "null", "[]", "{}", '{"event_id": "x", "type": "edit"}', made(1)[:-4], json.dumps({"event_id": 9, "type": "edit", "title": "x" * MOST_BYTES}), "\x00"]
    name = f"edits-{r.random()}"
    for part in range(3):
        for n in range(5):
            spark.createDataFrame([(x,) for x in [*(made(1000 * part + 10 * n + k) for k in range(8)), *odd]], "line string").coalesce(1).write.mode("append").text(f"{tmp_path}/in")
        out = run_available(edit_stream(spark, f"{tmp_path}/in", 2), name=name)
    want = edits(spark.read.schema("line string").text(f"{tmp_path}/in"))
    got, twin = (sorted(tuple(map(str, x)) for x in df.collect()) for df in (out, want))
    assert got == twin and 40 < len(got) < 120
    assert all(len(x.title) <= 140 and (x.comment is None or len(x.comment) <= 500) and (x.size is None or abs(x.size) <= 10**9) and x.type in ("edit", "new") for x in out.collect())
