"""Best-fit packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, materialize, table, text_or_empty

SEQUENCE_TOKENS, END_ID = 4096, 1
#: Pieces that are packed together. Each such bucket leaves about one sequence partly filled.
BUCKET_PIECES = 16_384
TABLE_WORDS, TABLE_CHARS = 500_000, 48


class WordTable:
    """Word -> its ids as little-endian 32-bit numbers. The tokenizer drops white space and joins nothing across it.

    A text of plain letters and signs is put in lower case and cut as the tokenizer's own pattern cuts it, so "Word,"
    and "word" share an entry; any other text goes to the tokenizer word by word. Each distinct word is encoded once.
    """

    #: No controls, combining marks or rare blanks: composing changes nothing here, and lower case maps one to one.
    PLAIN = re.compile("[\t\n\r -~\u00a1-\u00ac\u00ae-\u012f\u0131-\u017f]*")

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_file(file)
        parts = Tokenizer(whole.model)
        parts.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.tables: list[tuple[Tokenizer, dict[str, bytes]]] = [(parts, {}), (whole, {})]
        self.cut = regex.compile(json.loads(Path(file).read_text())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall

    @staticmethod
    def _ids(tokenizer, words: list[str]) -> dict[str, bytes]:
        found = tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return {w: array("I", x.ids).tobytes() for w, x in zip(words, found, strict=True)}

    def _words(self, text: str) -> tuple[int, list[str]]:
        """0 and parts in lower case, or 1 and words as they stand."""
        if self.PLAIN.fullmatch(text) and "<|" not in text:
            return 0, self.cut(text.lower())
        return 1, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._words(t) for t in texts]
        known = []
        for k, (tokenizer, words) in enumerate(self.tables):
            if len(words) > TABLE_WORDS:
                words.clear()
            new = set().union(*(w for at, w in cut if at == k)).difference(words)
            long = {w for w in new if len(w) > TABLE_CHARS}
            words.update(self._ids(tokenizer, list(new - long)))
            known.append((words | self._ids(tokenizer, list(long)) if long else words).__getitem__)
        return [b"".join(map(known[at], words)) for at, words in cut]


@lru_cache(maxsize=2)
def word_table(file: str) -> WordTable:
    return WordTable(file)


class TightestBin:
    """Segment tree over remaining capacities: node -> number of open bins whose room lies in its range."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.bins: dict[int, list[int]] = defaultdict(list)

    def _add(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.tree[node] += by
            node >>= 1

    def push(self, room: int, which: int) -> None:
        self.bins[room].append(which)
        self._add(room, 1)

    def pop(self, length: int) -> tuple[int, int] | None:
        """(room, bin) of an open bin with the least room >= length, taken out; None if there is none."""
        node, tree = length + self.size, self.tree
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):  # up until a right sibling holds bins
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item, longest first into the tightest open bin; the number of bins is max(bin) + 1."""
    where, offset, n = [0] * len(lengths), [0] * len(lengths), 0
    open_bins = TightestBin(capacity)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = open_bins.pop(lengths[i])
        if found is None:
            found, n = (capacity, n), n + 1
        room, where[i] = found
        offset[i] = capacity - room
        if room > lengths[i]:
            open_bins.push(room - lengths[i], where[i])
    return where, offset


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most capacity tokens: (doc_id, piece, start, length, ids_crc32). A null text is empty: its end id alone."""

    def run(known: WordTable, keys: list, texts: list[str]) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        end, step = end_id.to_bytes(4, "little"), 4 * capacity
        for key, ids in zip(keys, known.encode(texts), strict=True):
            ids += end
            for k in range(0, len(ids), step):
                part = ids[k : k + step]
                for name, v in zip(out, (key, k // step, k // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    out[name].append(v)
        return out

    return map_columns(docs.select("doc_id", text_or_empty()), run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint", lambda: word_table(tokenizer_file))


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Adds sequence_id and offset. Pieces are numbered and go to buckets by a hash of the number, so no source, long document or repeated row fills one bucket."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece", "number"], ascending=[False, True, True, True], kind="stable")
        where, offset = best_fit_decreasing(part.length.tolist(), capacity)
        return part.assign(sequence_id=part.bucket * (1 << 32) + np.array(where, "int64"), offset=np.array(offset, "int64")).drop(columns=["bucket", "number"])

    numbered = materialize(pieces.withColumn("number", F.monotonically_increasing_id()))
    buckets = max(1, -(-numbered.count() // BUCKET_PIECES))
    dealt = numbered.withColumn("bucket", F.pmod(F.xxhash64("number"), F.lit(buckets)).cast("long"))
    return dealt.groupBy("bucket").applyInPandas(pack, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """Whole packing: one row for each piece of each document row.

    Null texts are empty and pack as one end id. Documents longer than a sequence, and only those, are cut. Repeated
    rows are packed each; ties go by doc_id and piece; an empty table gives an empty one; further columns don't matter.
    """
    file = tokenizer_file or public_tokenizers.path("word_bpe_49k.json")
    return pack_pieces(token_pieces(docs, file))


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
