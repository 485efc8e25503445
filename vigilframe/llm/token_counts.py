"""Token counts that follow edits without encoding whole documents again.

A document is kept as a segment tree over its pre-tokens, each with its characters and tokens. An edit re-cuts only the
text from just before it until the cut falls on an old boundary again, and updates the sums above the leaves it touched.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, table, text_or_empty

#: Characters before an edit whose pre-tokens are cut anew: the pattern looks at most so far past a pre-token's end.
CONTEXT = 3
TABLE_WORDS, TABLE_CHARS = 500_000, 48


class PreTokenCounter:
    """Pre-token -> number of its tokens; each distinct one is encoded once."""

    def __init__(self, ranks_file: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(ranks_file).read_bytes().splitlines())}
        self.encoding = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def count(self, parts: list[str]) -> list[int]:
        known = self.known
        if len(known) > TABLE_WORDS:
            known.clear()
        new = set(parts).difference(known)
        some = {p: len(self.encoding.encode_ordinary(p)) for p in new}
        long = {p: n for p, n in some.items() if len(p) > TABLE_CHARS}
        known.update({p: n for p, n in some.items() if p not in long})
        return [known[p] if p in known else long[p] for p in parts]


@lru_cache(maxsize=2)
def counter(ranks_file: str) -> PreTokenCounter:
    return PreTokenCounter(ranks_file)


class CountTree:
    """Segment tree over slots of pre-tokens; a slot holds one at first, and what an edit left there later."""

    def __init__(self, text: str, counts: PreTokenCounter):
        parts = counts.cut(text)
        self.counts, self.slots, self.recut = counts, [[p] for p in parts], 0
        self.size = 1 << max(1, len(parts) - 1).bit_length()
        leaves = np.zeros((2, self.size), "i8")
        leaves[0, : len(parts)] = [len(p) for p in parts]
        leaves[1, : len(parts)] = counts.count(parts)
        levels = [leaves]
        while levels[-1].shape[1] > 1:
            levels.append(levels[-1][:, 0::2] + levels[-1][:, 1::2])
        self.chars, self.tokens = (np.concatenate([np.zeros(1, "i8"), *(x[k] for x in reversed(levels))]) for k in (0, 1))

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join(p for s in self.slots for p in s)

    def _slot(self, place: int) -> tuple[int, int]:
        """(slot, characters before it) of the slot that holds the character at place, or the last one."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if before + self.chars[node] <= place and self.chars[node + 1]:
                before += int(self.chars[node])
                node += 1
        return node - self.size, before

    def _put(self, slot: int, parts: list[str], tokens: list[int]) -> None:
        self.slots[slot] = parts
        node = slot + self.size
        chars, count = sum(map(len, parts)) - int(self.chars[node]), sum(tokens) - int(self.tokens[node])
        while node:
            self.chars[node] += chars
            self.tokens[node] += count
            node >>= 1

    def edit(self, start: int, length: int, replacement: str) -> None:
        """Replaces length characters from start on; both are cut at the text's ends."""
        start = min(max(start, 0), int(self.chars[1]))
        stop = min(start + max(length, 0), int(self.chars[1]))
        if not self.slots:
            self.slots = [[]]
        first, before = self._slot(max(0, start - CONTEXT))
        last = first
        old = "".join(self.slots[first])
        bounds = {before + sum(map(len, self.slots[first][:k])) for k in range(len(self.slots[first]) + 1)}
        while True:
            at = before + len(old)
            ended = last + 1 >= len(self.slots)
            new = old[: start - before] + replacement + old[stop - before :] if at >= stop else ""
            if at >= stop and (ended or at > stop):
                parts, place, cut = self.counts.cut(new), before, None
                shift = len(replacement) - (stop - start)
                if ended:
                    break
                for k, p in enumerate(parts):  # the last piece may go on beyond what is here, so its end is no boundary yet
                    place += len(p)
                    if place - shift in bounds and place - shift > stop and len(new) + before - place >= CONTEXT:
                        cut = k + 1
                        break
                if cut is not None:
                    parts = parts[:cut] + self._rest(first, last, before, place - shift)
                    break
            last += 1
            for p in self.slots[last]:
                bounds.add(before + len(old))
                old += p
            bounds.add(before + len(old))
        tokens = self.counts.count(parts)
        self.recut += len(parts)
        for slot in range(first + 1, last + 1):
            if self.slots[slot]:
                self._put(slot, [], [])
        self._put(first, parts, tokens)

    def _rest(self, first: int, last: int, before: int, place: int) -> list[str]:
        """Old pre-tokens of the slots from place on."""
        out, at = [], before
        for slot in range(first, last + 1):
            for p in self.slots[slot]:
                if at >= place:
                    out.append(p)
                at += len(p)
        return out


def count_edited(docs: DataFrame, ranks_file: str) -> DataFrame:
    """(doc_id, n_tokens, n_edited, n_pretokens, n_recut) of each row of docs(doc_id, text, edits).

    edits is an array of (start, length, replacement) in code points, applied in turn; null edits are none, a null
    replacement is empty, places are cut at the text's ends. Null texts are empty. Repeated rows give repeated rows; an
    empty table gives an empty one; further columns don't matter.
    """

    def run(counts: PreTokenCounter, keys: list, texts: list[str], edits: list) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_tokens", "n_edited", "n_pretokens", "n_recut")}
        for key, text, some in zip(keys, texts, edits, strict=True):
            tree = CountTree(text, counts)
            told = [key, tree.total, len(tree.slots)]
            for e in some or ():
                tree.edit(e["start"] or 0, e["length"] or 0, e["replacement"] or "")
            for name, v in zip(out, (*told[:2], tree.total, told[2], tree.recut), strict=True):
                out[name].append(v)
        return out

    return map_columns(docs.select("doc_id", text_or_empty(), "edits"), run, "doc_id bigint, n_tokens bigint, n_edited bigint, n_pretokens bigint, n_recut bigint", lambda: counter(ranks_file))


def op7_edit_aware_counts(spark, sf_dir: str) -> DataFrame:
    """Three edits of each document: five characters at the middle give way to the text's first twelve, its source's name goes in at a quarter, its last three characters go."""
    docs = table(spark, sf_dir, "documents").withColumn("n", F.length(text_or_empty()))
    edit = lambda start, length, new: F.struct(start.cast("int").alias("start"), F.lit(length).alias("length"), new.alias("replacement"))
    edits = F.array(edit(F.col("n") / 2, 5, F.substring(text_or_empty(), 1, 12)), edit(F.col("n") / 4, 0, F.coalesce("source", F.lit(""))), edit(F.col("n") - 3, 1 << 20, F.lit("")))
    return count_edited(docs.select("doc_id", "text", edits.alias("edits")), public_tokenizers.path("byte_bpe_50k.tiktoken"))
