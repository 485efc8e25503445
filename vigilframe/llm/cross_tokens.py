"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Both tokenizers' tokens are byte ranges of one text. A text is cut at a byte where tokens of both end, found near the
middle by bisection, and both halves are cut again, down to a few tokens whose ends are all looked up; intervals without
such a byte are groups. All intervals of one depth, of many texts at once, are worked on together. Token pairs that end a
group are linked and counted over the corpus.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, materialize, table, text_or_empty
from .sentencepiece_codec import MARK, chunk_table

#: Ends tried around the middle of an interval before all its ends are looked up, and tokens of an interval too short to halve.
NEAR = (0, 1, -1, 2, -2, 3, -3, 4, -4)
SHORT = 12
#: Code points of texts aligned together, and pairs of a task gathered before they are counted.
TOGETHER, GATHERED = 1 << 19, 1 << 21


def _byte_signs() -> dict[str, int]:
    """Byte-level vocabularies write a byte as itself where it is a printable sign of Latin-1, others as signs from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class TokenizerPair:
    """Encoders of a byte-level BPE file (A) and of a SentencePiece model (B), and the bytes of their tokens.

    A's ids are ranks of its merges, so the rank encoder gives what the file's own library gives, in a fifth of the time.
    """

    def __init__(self, byte_file: str, piece_file: str):
        import tiktoken

        with open(byte_file, encoding="utf-8") as f:
            told = json.load(f)
        signs, special = _byte_signs(), {t["content"] for t in told["added_tokens"]}
        merged = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"]]
        ranks = {bytes(signs[c] for c in t): i for t, i in told["model"]["vocab"].items() if t not in special}
        byte = lambda t: bytes(signs[c] for c in t)
        if told["model"].get("type", "BPE") != "BPE" or told.get("normalizer") or [ranks[byte(a + b)] for a, b in merged] != list(range(256, 256 + len(merged))):
            raise ValueError("not a byte-level BPE whose ids are the ranks of its merges")
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = chunk_table(piece_file)
        pieces = [self.b.model.id_to_piece(i) for i in range(self.b.model.get_piece_size())]
        hexed = re.compile("<0x([0-9A-F]{2})>")
        of_piece = lambda p: bytes([int(m.group(1), 16)]) if (m := hexed.fullmatch(p)) else p.replace(MARK, " ").encode()
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes_a[i] = t
        self.bytes_b = [of_piece(p) for p in pieces]
        self.length_a, self.length_b = (np.array([len(t) for t in known], "i8") for known in (self.bytes_a, self.bytes_b))
        # Ids as text, followed by what may stand behind them: of A another id or the bar, of B another id or the next group.
        self.shown_a, self.shown_b = ([np.array([f"{i}{sign}" for i in range(len(known))], object) for sign in (",", last)] for known, last in ((self.bytes_a, "|"), (self.bytes_b, ";")))

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both; none of a text that is empty or whose tokens don't spell a space and the text."""
        out = []
        for text, (ids_b, _) in zip(texts, self.b.encode(texts), strict=True):
            raw, ids_a = f" {text}".encode(), self.a.encode_ordinary(" " + text) if text else []
            right = text and b"".join(map(self.bytes_a.__getitem__, ids_a)) == raw == b"".join(map(self.bytes_b.__getitem__, ids_b))
            out.append((ids_a, ids_b) if right else ([], []))
        return out


@lru_cache(maxsize=2)
def tokenizer_pair(byte_file: str, piece_file: str) -> TokenizerPair:
    return TokenizerPair(byte_file, piece_file)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of A and of B that end at shared cuts, in order.

    ends_*: byte ends, rising over all texts; lasts: number of each text's last token of A, which ends at a shared cut.
    """
    cuts, low, high = [lasts], np.concatenate([[0], lasts[:-1] + 1]), lasts  # tokens low .. high - 1 end inside an interval
    short: list[tuple[np.ndarray, np.ndarray]] = []
    while len(low):
        long = high - low > SHORT
        short.append((low[~long], high[~long]))
        low, high = low[long], high[long]
        middle, found, todo = (low + high) // 2, np.full(len(low), -1), np.arange(len(low))
        for step in NEAR:
            at = middle[todo] + step
            todo, at = todo[ok := (at >= low[todo]) & (at < high[todo])], at[ok]
            hit = ends_b[np.searchsorted(ends_b, ends_a[at])] == ends_a[at]
            found[todo[hit]] = at[hit]
            todo = np.flatnonzero(found < 0)
        for k in todo:  # few: all ends of the interval are looked up, the nearest shared one is taken
            ends = ends_a[low[k] : high[k]]
            at = np.flatnonzero(ends_b[np.searchsorted(ends_b, ends)] == ends) + low[k]
            if len(at):
                found[k] = at[np.argmin(np.abs(at - middle[k]))]
        cut = found >= 0  # the others are leaves
        cuts.append(found[cut])
        low, high = np.concatenate([low[cut], found[cut] + 1]), np.concatenate([found[cut], high[cut]])
    low, high = (np.concatenate(x) for x in zip(*short, strict=True))
    order = np.argsort(low)
    low, size = low[order], (high - low)[order]
    at = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)  # all ends of the short intervals, in order
    cuts.append(at[ends_b[np.searchsorted(ends_b, ends_a[at])] == ends_a[at]])
    of_a = np.sort(np.concatenate(cuts))
    return of_a, np.searchsorted(ends_b, ends_a[of_a])


def align(pair: TokenizerPair, texts: list[str]) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Of each text its ids of A and B, and the numbers of the tokens of A and of B that end its groups."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= TOGETHER):
            size += len(texts[stop])
            stop += 1
        encoded = pair.encode(texts[start:stop])
        start, some = stop, [e for e in encoded if e[0]]
        if some:
            first_a, first_b = (np.cumsum([0, *(len(e[k]) for e in some)]) for k in (0, 1))
            ends_a = np.cumsum(pair.length_a[np.concatenate([e[0] for e in some])])
            ends_b = np.cumsum(pair.length_b[np.concatenate([e[1] for e in some])])
            of_a, of_b = shared_cuts(ends_a, ends_b, first_a[1:] - 1)
            groups = np.searchsorted(of_a, first_a)
        k = 0
        for ids_a, ids_b in encoded:
            if not ids_a:
                yield [], [], np.zeros(0, int), np.zeros(0, int)
                continue
            own = slice(groups[k], groups[k + 1])
            yield ids_a, ids_b, of_a[own] - first_a[k], of_b[own] - first_b[k]
            k += 1


def groups_text(pair: TokenizerPair, ids_a: list[int], ids_b: list[int], of_a: np.ndarray, of_b: np.ndarray) -> str:
    """The groups as `a1,a2|b1;a3|b2,b3`."""
    out = np.empty(len(ids_a) + len(ids_b), object)
    for ids, shown, own, other in ((ids_a, pair.shown_a, of_a, of_b), (ids_b, pair.shown_b, of_b, of_a)):
        ids, at = np.array(ids), np.arange(len(ids))
        signs = shown[0][ids]
        signs[own] = shown[1][ids[own]]
        group = np.searchsorted(own, at)
        before = np.concatenate([[0], other + 1])  # tokens of the other tokenizer up to each group's begin
        out[at + before[group + (own is of_b)]] = signs
    return "".join(out.tolist())[:-1]


def aligned_groups(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """(doc_id, groups) of each row: groups are (a, b), the ids of both tokenizers up to the next byte where tokens of both end.

    Null and empty texts, and texts whose tokens don't spell a space and the text (one holds U+2581, say), have no
    groups. Repeated rows give repeated rows; an empty table gives an empty one; further columns don't matter.
    """

    def run(pair: TokenizerPair, keys: list, texts: list[str]) -> dict:
        groups = []
        for ids_a, ids_b, of_a, of_b in align(pair, texts):
            a, b = np.concatenate([[0], of_a + 1]), np.concatenate([[0], of_b + 1])
            groups.append([{"a": ids_a[a[k] : a[k + 1]], "b": ids_b[b[k] : b[k + 1]]} for k in range(len(of_a))])
        return {"doc_id": keys, "groups": groups}

    return map_columns(docs.select("doc_id", text_or_empty()), run, "doc_id bigint, groups array<struct<a: array<int>, b: array<int>>>", lambda: tokenizer_pair(byte_file, piece_file))


def document_links(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links) of each row. Cases as in aligned_groups().

    Tokens have bytes, so a shared cut ends one token of each: one link. links are little-endian unsigned 64-bit
    numbers, id of A times 2^32 plus id of B, in rising order.
    """

    def run(pair: TokenizerPair, keys: list, texts: list[str]) -> dict:
        out: dict[str, list] = {"doc_id": keys, "n_a": [], "n_b": [], "n_groups": [], "groups_sha256": [], "links": []}
        for ids_a, ids_b, of_a, of_b in align(pair, texts):
            pairs = (np.array(ids_a, "u8")[of_a] << 32) | np.array(ids_b, "u8")[of_b] if ids_a else np.zeros(0, "u8")
            sha = hashlib.sha256(groups_text(pair, ids_a, ids_b, of_a, of_b).encode()).hexdigest() if ids_a else ""
            for name, v in zip(list(out)[1:], (len(ids_a), len(ids_b), len(of_a), sha, np.sort(pairs).astype("<u8").tobytes()), strict=True):
                out[name].append(v)
        return out

    return map_columns(docs.select("doc_id", text_or_empty()), run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary", lambda: tokenizer_pair(byte_file, piece_file))


def link_counts(links: DataFrame) -> DataFrame:
    """(link, n): how many links of all rows hold a pair of ids. Tasks count their own first.

    Of two tokens that end together one's bytes end the other's, so a token has fewer partners than it has bytes, but
    for its longer ones: all pairs are at most the bytes of both vocabularies, some 500,000 here, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, held, size = np.zeros(0, "u8"), np.zeros(0, "i8"), [], 0

        def folded() -> tuple[np.ndarray, np.ndarray]:
            every, each = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, "u8"), np.zeros(0, "i8"))
            both, where = np.unique(np.concatenate([pairs, every]), return_inverse=True)
            return both, np.bincount(where, np.concatenate([counts, each]), len(both)).astype("i8")

        for batch in batches:
            for x in batch.column(0).to_pylist():
                held.append(np.frombuffer(x, "<u8"))
                size += len(held[-1])
            if size > GATHERED:
                pairs, counts = folded()
                held, size = [], 0
        pairs, counts = folded()
        for k in range(0, len(pairs), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[k : k + (1 << 14)].astype("i8")), pa.array(counts[k : k + (1 << 14)])], names=["link", "n"])

    return links.select("links").mapInArrow(run, "link bigint, n bigint").groupBy("link").agg(F.sum("n").alias("n"))


def alignment_digests(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """Per row its tokens, groups and links, and how its links' counts over all rows stand. Cases as in aligned_groups().

    The counts of all pairs, bounded by the vocabularies (see link_counts), go to every task as two arrays.
    """
    links = materialize(document_links(docs, byte_file, piece_file))
    told = link_counts(links).toArrow()
    pairs, counts = told["link"].to_numpy(), told["n"].to_numpy()
    order = np.argsort(pairs)
    pairs, counts = pairs[order], counts[order]
    _, of_b = np.unique(pairs & 0xFFFFFFFF, return_inverse=True)
    most = np.zeros(of_b.max(initial=-1) + 1, "i8")
    np.maximum.at(most, of_b, counts)
    shared = docs.sparkSession.sparkContext.broadcast((pairs, counts, counts == most[of_b]))

    def run(*columns: list) -> dict:
        pairs, counts, best = shared.value
        sums, bests = [], []
        for x in columns[-1]:
            at = np.searchsorted(pairs, np.frombuffer(x, "<i8"))
            sums.append(int(counts[at].sum()))
            bests.append(int(best[at].sum()))
        return dict(zip(("doc_id", "n_a", "n_b", "n_groups", "groups_sha256"), columns[:-1], strict=True)) | {"n_links": columns[3], "n_best": bests, "count_sum": sums}

    shape = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return map_columns(links, run, shape)


def op12_cross_tokenizer(spark, sf_dir: str) -> DataFrame:
    return alignment_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
