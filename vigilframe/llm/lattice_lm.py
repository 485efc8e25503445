"""Language-model scores from a lattice of subwords under whole words.

A word's chance is the sum over all ways to spell it. Whole words of the training texts are one way, with absolute
discounting; the discounted mass goes to spellings in pieces of an existing vocabulary, whose chances come from the
training words' own segmentations. All segmentations count: a forward recursion in log space gives their sum.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty

#: Words, the most frequent of the training texts, whose scores every task holds; all others are joined by word.
HOT_WORDS = 100_000
#: Count that every piece has besides its own.
SMOOTHING = 0.05
MARK = "▁"


def words(text: str) -> list[bytes]:
    """Lower-case A-Z, parted at \\x20 and \\x09-\\x0D, as bytes."""
    return text.encode().lower().split()


def is_training(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 7 != 2, F.lit(True))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows; counted within the tasks before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            yield from pa.table({"word": pa.array(seen.keys(), pa.binary()), "c": pa.array(seen.values(), pa.int64())}).to_batches(max_chunksize=100_000)
            seen.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words(text))
                if len(seen) > 400_000:
                    yield from told()
        if seen:
            yield from told()

    return docs.select(text_or_empty()).mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@lru_cache(maxsize=2)
def vocabulary(model_file: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file)


class SubwordLattice:
    """All segmentations of words into an existing vocabulary's pieces, weighted by chances of pieces.

    A piece that opens a word, one that goes on with it, and the end of a word are told apart, so the chances of all
    words sum to one. A character that is no piece is spelt in the vocabulary's bytes.
    """

    def __init__(self, model_file: str, counts: dict[str, int] | None = None):
        model, counts = vocabulary(model_file), counts or {}
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)]
        self.opening = self._chances({p[1:]: counts.get(p, 0) for p in pieces if p[0] == MARK and MARK not in p[1:]})
        self.inner = self._chances({p: counts.get(p, 0) for p in ["", *pieces] if MARK not in p})
        self.start, self.end = self.opening.pop(""), self.inner.pop("")
        self.longest = max(map(len, pieces))

    @staticmethod
    def _chances(counts: dict[str, int]) -> dict[str, float]:
        total = sum(counts.values()) + SMOOTHING * len(counts)
        return {p: math.log((n + SMOOTHING) / total) for p, n in counts.items()}

    def log_chance(self, word: str) -> float:
        """Log of the sum over all segmentations: a forward recursion in log space, from each place along the pieces that begin there."""
        n, inner, longest = len(word), self.inner.get, self.longest
        exp, log1p, low = math.exp, math.log1p, -math.inf
        forward = [low] * (n + 1)
        for j in range(1, min(n, longest - 1) + 1):
            if (p := self.opening.get(word[:j])) is not None:
                forward[j] = p
        for i in range(n):
            before = forward[i] if i else self.start
            for j in range(i + 1, min(n, i + longest) + 1):
                p = inner(word[i:j])
                if p is None:
                    if j > i + 1:
                        continue
                    p = sum(self.inner[f"<0x{b:02X}>"] for b in word[i].encode())
                new, old = before + p, forward[j]
                forward[j] = new if old == low else old + log1p(exp(new - old)) if old > new else new + log1p(exp(old - new))
        return forward[n] + self.end

    def log_chances(self, words: list[str]) -> np.ndarray:
        return np.array([self.log_chance(w) for w in words])


def piece_counts(counts: DataFrame, model_file: str) -> dict[str, int]:
    """How often each piece occurs in the library's segmentations of the distinct words, and how many words end (""); as many entries as the vocabulary has pieces at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = vocabulary(model_file), np.zeros(vocabulary(model_file).get_piece_size() + 1, "i8")
        for batch in batches:
            found = model.encode([w.decode(errors="replace") for w in batch.column(0).to_pylist()], num_threads=1)
            seen[-1] += len(found)
            seen[:-1] += np.bincount(np.fromiter((i for ids in found for i in ids), int), minlength=len(seen) - 1)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(some, pa.int32()), "n": pa.array(seen[some], pa.int64())})

    rows = counts.select("word").mapInArrow(count, "piece int, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    model = vocabulary(model_file)
    return {model.id_to_piece(r.piece) if r.piece < model.get_piece_size() else "": r.n for r in rows}


@dataclass
class Model:
    lattice: SubwordLattice
    tokens: int
    distinct: int
    texts: int
    #: Taken off each count, for spellings in pieces.
    discount: float

    def base(self, c: int) -> float:
        return math.log10((c + 1) / (self.tokens + 1 * (self.distinct + 1)))

    def words(self, words: list[str], c: np.ndarray) -> np.ndarray:
        """log10 of words' chances: the whole word, if known, and all its spellings. With nothing to learn from, spellings alone."""
        spelt = self.lattice.log_chances(words)
        if not self.tokens:
            return spelt / math.log(10) - 1
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(c - self.discount, 0) / self.tokens)
        return np.logaddexp(whole, math.log(self.discount * self.distinct / self.tokens) + spelt) / math.log(10)

    def end(self) -> float:
        return math.log10(max(self.texts - self.discount, 0.25) / self.tokens) if self.tokens else -1.0


def hot_count(counts: DataFrame) -> int:
    """The least count at which no more than HOT_WORDS words are as frequent. Counts are looked at in classes of a sixteenth of a doubling, so a thousand rows at most come to the driver."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    found, least = 0, 1
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("c").alias("most")).collect(), key=lambda r: -r.step):
        found += r.n
        if found > HOT_WORDS:
            return r.most + 1
        least = r.least
    return least


def lattice_scores(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; logarithms to base 10.

    Learns from rows whose crc32 of the id as text leaves another remainder than 2 by 7 (a null id: learns). Null texts
    are empty: an end alone. Repeated rows are scored and learnt from each. An empty table gives an empty one; without
    training rows counts are 0 and spellings alone score. Frequent words are scored within the tasks, and all others
    are joined by word: a join that no single word can skew.
    """
    docs = docs.select(F.col("doc_id"), text_or_empty(), is_training().alias("training"))
    counts = materialize(word_counts(docs.where("training")))
    texts = docs.where("training").count()
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), *(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2))).first()
    model = Model(SubwordLattice(model_file, piece_counts(counts, model_file)), (total.n or 0) + texts, total.v + (texts > 0), texts, (total.n1 + 1) / (total.n1 + 2 * total.n2 + 2))
    top = counts.where(F.col("c") >= hot_count(counts)).collect()  # HOT_WORDS at most
    scored = model.words([bytes(r.word).decode(errors="replace") for r in top], np.array([r.c for r in top], "f8")) if top else []
    hot = {bytes(r.word): (model.base(r.c), float(x)) for r, x in zip(top, scored, strict=True)}
    end_base, end_known, end_score = model.base(texts), int(texts > 0), model.end()
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # at most HOT_WORDS entries

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row of sums for each text (word null), and one for each text and rarer word."""
        known = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                out: list[list] = [[] for _ in range(7)]
                for key, text, row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    n, base, score, rare = 0, 0.0, 0.0, []
                    for w, c in Counter(words(text)).items():
                        if found := known.get(w):
                            n, base, score = n + c, base + c * found[0], score + c * found[1]
                        else:
                            rare.append((w, c))
                    whole = sum(c for _, c in rare) + n + 1
                    for column, values in zip(out, ([key] * (1 + len(rare)), [row] * (1 + len(rare)), [None, *(w for w, _ in rare)], [whole, *(c for _, c in rare)], [n + end_known] + [0] * len(rare), [base + end_base] + [0.0] * len(rare), [score + end_score] + [0.0] * len(rare)), strict=True):
                        column += values
                yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "row", "word", "n", "known", "base", "score"), out, strict=True)), schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("word", pa.binary()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
    ddl = "doc_id bigint, row bigint, word binary, n bigint, known bigint, base double, score double"
    # A row is known by its id and a hash of its text; of repeated rows only one is cut, and `times` brings the others back.
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    sums = materialize(rows.mapInArrow(cut, ddl))
    rare = sums.where("word is not null").select("doc_id", "row", "word", "n").join(counts, "word", "left")

    told = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of word; each distinct word of a batch is scored once."""
        for batch in batches:
            word = batch.column("word").dictionary_encode()
            at, n = word.indices.to_numpy(), batch.column("n").to_numpy()
            c = np.zeros(len(word.dictionary), "f8")
            c[at] = batch.column("c").fill_null(0).to_numpy()
            base = np.log10((c + 1) / (model.tokens + 1 * (model.distinct + 1)))
            score = model.words([w.decode(errors="replace") for w in word.dictionary.to_pylist()], c)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(n * (c > 0)[at]), pa.array(n * base[at]), pa.array(n * score[at])], schema=told)

    joined = rare.select("doc_id", "row", "word", "n", "c").mapInArrow(spell, "doc_id bigint, row bigint, known bigint, base double, score double")
    alone = sums.where("word is null")
    both = alone.select("doc_id", "row", "n", "known", "base", "score", F.lit(1).alias("times")).unionByName(joined.withColumns({"n": F.lit(0).cast("long"), "times": F.lit(0)}))
    out = both.groupBy("doc_id", "row").agg(*(F.sum(c).alias(c) for c in ("n", "known", "base", "score", "times")))
    # Repeated rows were cut each, so every sum holds them `times` over; one row is given for each.
    each = out.select("doc_id", *((F.col(c) / F.col("times")).alias(c) for c in ("n", "known", "base", "score")), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("k"))
    return each.select(
        "doc_id", (~is_training()).alias("held_out"), F.round("n").cast("long").alias("n_tokens"), F.round("known").cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )


def op4_lattice_lm(spark, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
