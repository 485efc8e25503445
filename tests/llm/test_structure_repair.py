"""Structure repair against a plain table of cheapest edits, and the registered query on small and long conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

import vigilframe.llm.structure_repair as sr
from vigilframe.llm.queries import QUERIES

NAMES = {2: "user", 3: "assistant"}


def plain(rows):
    """Least (cost, audit) of rows (role, text, fault) by a table filled from the end."""
    n, best = len(rows), {}
    for i in range(n, -1, -1):
        now = {}
        for q in range(4):
            ways = [(0, "")] if i == n and q in (0, 3) else []
            if i < n:
                role, _, fault = rows[i]
                ways.append((best[i + 1, q][0] + 2, "D" + best[i + 1, q][1]))
                if fault not in ("blank", "duplicate"):
                    more = 5 * (fault == "truncated")
                    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, role[:1]))
                    if keep:
                        ways.append((best[i + 1, keep][0] + more, "K" + best[i + 1, keep][1]))
                    to = 3 if q == 2 else 2
                    ways.append((best[i + 1, to][0] + 1 + more, "R" + best[i + 1, to][1]))
            now[q] = min(ways, default=(10**9, ""))
        for _ in range(4):
            for q in range(4):
                to = 3 if q == 2 else 2
                now[q] = min(now[q], (now[to][0] + 5, "I" + now[to][1]))
        best |= {(i, q): w for q, w in now.items()}
    return best[0, 0]


def expected(rows):
    """The query's result for rows (conv_id, turn, role, text)."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        talks[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        talks[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = set()
    for conv, said in talks.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:32].encode(), hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, marked = set(), []
        for _, role, text in said:
            core = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "ok" if core[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit = plain(marked)
        state, lines, i = 0, [], 0
        for letter in audit:
            if letter == "I":
                state = 3 if state == 2 else 2
                lines.append(f"{NAMES[state]}:")
                continue
            role, text, _ = marked[i]
            i += 1
            if letter != "D":
                state = (3 if state == 2 else 2) if letter == "R" or role[0] != "s" else 1
                lines.append(f"{NAMES[state] if letter == 'R' else role}:{text}")
        turns = [t for t, *_ in said if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        count = lambda f: sum(m[2] == f for m in marked)  # noqa: E731, B023
        out.add((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
TEXTS = ["Well.", "no end", "", "  \n", "Well.", "Tell me. ", "so?\t", "Ünd!", "a" * 40 + ".", "a" * 40 + "b."]
ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", None]


def made(r, conv, n):
    return [(conv, r.choice([None, *range(n)]) if r.random() < 0.3 else t, r.choice(ROLES), r.choice([*TEXTS, None, f"{t}.", f"{t}!"])) for t in range(n)]


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return {tuple(x[c] for c in COLUMNS) for x in QUERIES["op11_structure_repair"](spark, str(tmp_path)).collect()}


def test_least_edits_by_plain_table():
    r = random.Random(5)
    for _ in range(400):
        rows = [(r.choice("suas-"), "", r.choice(["ok", "ok", "blank", "truncated", "duplicate"])) for _ in range(r.randint(1, 9))]
        kinds = [(i, {"ok": sr.OK, "truncated": sr.CUT_OFF}.get(f, sr.DROP)) for i, _, f in rows]
        assert sr.edit_way(kinds, 0, (0, 3), True) == plain(rows)
        cut = sorted(r.sample(range(1, len(rows)), min(2, len(rows) - 1)))
        blocks = [[sr.edit_way(kinds[a:b], p, [q], False) for p in range(4) for q in range(4)] for a, b in zip([0, *cut], [*cut, len(rows)], strict=True)]
        cost, audits = sr.join_blocks(blocks)
        assert (cost, "".join(audits)) == plain(rows)


@pytest.mark.parametrize("bits", [2, 12])
def test_op11(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(sr, "BLOCK_BITS", bits)
    r = random.Random(bits)
    rows = [x for conv in [None, *range(60)] for x in made(r, conv, r.randint(1, 12))]
    rows += made(r, 1 << 60, 300) + [(77, None, None, None)] * 3 + [(78, 5, "user", "Same.")] * 20 + rows[:5]
    rows += [(99, t, "user", "x.") for t in range(200) if zlib.crc32(f"99:{t}".encode()) % 20 == 0]
    got = run(spark, tmp_path, rows)
    want = expected(rows)
    assert got == want and next(x for x in got if x[0] == 99)[1:8] == (0, 0, 0, 0, 0, 0, "")


def test_repaired_turns_and_cases(spark):
    rows = [(1, 0, "system", "Be kind.", 7), (1, 1, "assistant", "Hi.", 7), (1, 2, "user", "  ", 7), (1, 3, "assistant", "So.", 7), (2, 0, "user", "x" * 200_000 + ".", 7), (2, 1, "ape", "y.", 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, digest int")
    got = [tuple(x) for x in sr.repaired_turns(df).orderBy("conv_id", "place").collect()]
    assert got[:4] == [(1, 0, "K", "system", "Be kind."), (1, 1, "R", "user", "Hi."), (1, 2, "D", "user", "  "), (1, 3, "K", "assistant", "So.")]
    assert got[4:] == [(2, 0, "K", "user", rows[4][3]), (2, 1, "K", "ape", "y.")]
    assert sr.repaired_turns(df.limit(0)).collect() == [] == sr.repair_digests(df.limit(0), df.limit(0)).collect()
