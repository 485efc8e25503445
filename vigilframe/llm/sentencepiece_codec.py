"""SentencePiece encoding and decoding through a distinct-chunk table.

No piece of the vocabulary holds a whitespace marker after another character, so no merge crosses the place where a
marker follows a non-marker. A text is cut there into marked words; each distinct marked word of a task is segmented
once by the library, and the ids are joined back by position. The table is bounded: it starts anew when full.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame

from .common import map_columns, table, text_or_empty

MARK = "▁"
#: Entries of a worker's table, and the longest word kept in it.
TABLE_WORDS, TABLE_CHARS = 500_000, 48


class ChunkTable:
    """Marked word -> its ids, as 32-bit numbers and as text. Raises ValueError for a model whose pieces cross markers or that changes its input."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) or self.model.encode("  ﬁ ") != self.model.encode(f"{MARK}{MARK}ﬁ{MARK}"):
            raise ValueError("pieces cross whitespace markers, or the model changes its input; encode whole texts instead")
        self.ids: dict[str, bytes] = {}  # bytes and strings only, which the garbage collector needn't walk
        self.shown: dict[str, str] = {}
        self.chunk = re.compile(f"{MARK}+[^{MARK}]*")

    def _cut(self, text: str) -> list[str]:
        """Marked words, each without its first marker."""
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text:
            return [w[1:] for w in self.chunk.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def _segment(self, words: list[str]) -> tuple[dict, dict]:
        found = self.model.encode(words, num_threads=1)  # the library puts the first marker back
        ids = {w: array("i", i).tobytes() for w, i in zip(words, found, strict=True)}
        shown = {w: ",".join(map(str, i)) for w, i in zip(words, found, strict=True)}
        if "" in ids:  # a marker with nothing after it
            lone = self.model.piece_to_id(MARK)
            ids[""], shown[""] = array("i", [lone]).tobytes(), str(lone)
        return ids, shown

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """For each text its ids, and the ids joined by commas."""
        if len(self.ids) > TABLE_WORDS:
            self.ids, self.shown = {}, {}
        cut = [self._cut(t) for t in texts]
        new = set().union(*cut).difference(self.ids)
        long = {w for w in new if len(w) > TABLE_CHARS}
        ids, shown = self._segment(list(new - long))
        self.ids.update(ids)
        self.shown.update(shown)
        ids, shown = self.ids, self.shown
        if long:
            ids, shown = (a | b for a, b in zip((ids, shown), self._segment(list(long)), strict=True))
        return [(np.frombuffer(b"".join(map(ids.__getitem__, w)), "<i4").tolist(), ",".join(map(shown.__getitem__, w))) for w in cut]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


@lru_cache(maxsize=2)
def chunk_table(model_file: str) -> ChunkTable:
    """One table for a worker process, kept from task to task."""
    return ChunkTable(model_file)


def encode_documents(docs: DataFrame, model_file: str, id_column: str = "doc_id") -> DataFrame:
    """Ids and decoded text of each row: (id, ids array, decoded).

    Null texts count as empty: no ids, decoded to the empty text. Repeated rows give repeated rows; further columns
    don't matter; an empty table gives an empty one. Texts of any length are encoded whole.
    """

    def run(known: ChunkTable, keys: list, texts: list[str]) -> dict:
        ids = [x[0] for x in known.encode(texts)]
        return {id_column: keys, "ids": ids, "decoded": [known.decode(x) for x in ids]}

    return map_columns(docs.select(id_column, text_or_empty()), run, f"{id_column} bigint, ids array<int>, decoded string", lambda: chunk_table(model_file))


def encode_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; the ids stay within the task. Cases as in encode_documents."""

    def run(known: ChunkTable, keys: list, texts: list[str]) -> dict:
        found = known.encode(texts)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return {"doc_id": keys, "n_tokens": [len(i) for i, _ in found], "ids_sha256": [sha(s) for _, s in found], "decoded_sha256": [sha(known.decode(i)) for i, _ in found]}

    return map_columns(docs.select("doc_id", text_or_empty()), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", lambda: chunk_table(model_file))


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
