"""Quality rules with a line labeller: a linear-chain conditional random field marks lines as content or boilerplate.

Labels are of documents; every line of a bad one that the plain rules let through counts as boilerplate. Features of a
line are bins of a few counts. Viterbi decoding labels a document's lines together; the share of words in content lines
decides whether it stays.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, materialize, table, text_or_empty
from .toxicity import Chain

#: The plain rules: least words, most percent of words in windows of so many words that come twice, and symbols.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
#: Least share of words in content lines.
LEAST_CONTENT = 0.5
#: Bound of the training sample: documents of each label, those with the least hash of their id; lines of one stretch, and about so many stretches in all, chosen by hash.
SAMPLE_PER_LABEL, STRETCH, STRETCHES = 3000, 40, 20_000
#: Upper ends of the bins of a line's counts. Shares are of its bytes (symbols, digits) or words (the same word as before, distinct words, mean bytes).
BINS = {
    "words": (1, 3, 9, 30),
    "symbols": (0.0, 0.01, 0.03, 0.1),
    "digits": (0.0, 0.05, 0.3),
    "same": (0.0, 0.1, 0.3, 0.6),
    "distinct": (0.3, 0.5, 0.7, 0.9),
    "mean": (2.5, 8.0, 14.0),
    "seen": (0.0,),
    "closed": (0.0,),
}
INDEX = {f"{name}{k}": i for i, (name, k) in enumerate((n, k) for n, ends in BINS.items() for k in range(len(ends) + 1))}
FIRST = dict(zip(BINS, np.cumsum([0, *(len(ends) + 1 for ends in BINS.values())]).tolist(), strict=False))
#: The fewest words for which shares of words say something.
FEW = 10


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that the text holds twice or more. Windows are told apart exactly, by ranks of doubled lengths."""
    if len(words) <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    rank = np.fromiter((number.setdefault(w, len(number)) for w in words), "i8", len(words))
    span = 1
    while span < WINDOW:
        _, rank = np.unique(rank[:-span] * (len(words) + 1) + rank[span:], return_inverse=True)
        span *= 2
    often = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, "i8")
    edge[: len(often)] += often
    edge[WINDOW : WINDOW + len(often)] -= often
    return int((np.cumsum(edge)[:-1] > 0).sum())


def line_features(line: bytes, words: list[bytes], seen: bool) -> tuple[int, ...]:
    n, size = len(words), len(line)
    said = {
        "words": n,
        "symbols": (size - len(line.translate(None, SYMBOLS))) / size,
        "digits": (size - len(line.translate(None, b"0123456789"))) / size,
        "mean": sum(map(len, words)) / n,
        "seen": float(seen),
        "closed": float(words[-1][-1:] in (b".", b"!", b"?")),
    }
    if n >= FEW:
        said |= {"same": sum(map(eq, words, words[1:])) / (n - 1), "distinct": len(set(words)) / n}
    return tuple(FIRST[name] + bisect_right(BINS[name], x) - (x in BINS[name]) for name, x in said.items())


def measures(text: str) -> dict:
    """The plain counts of a text."""
    raw = text.encode()
    words = raw.split()  # bytes are split at space and 0x09-0x0D, as the contract has it
    repeated = repeated_words(words)
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")),
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": (lines := [x for x in raw.split(b"\n") if x.strip()]) and len(lines) - len(set(lines)) or 0,
        "n_repeat_words": repeated,
        "base_failed": len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words),
    }


def text_lines(text: str) -> list[tuple[int, int, tuple[int, ...]]]:
    """(number from 0, words, features) of each line that has a word; `seen` tells of lines equal to an earlier one."""
    out, seen = [], set()
    for k, line in enumerate(text.encode().split(b"\n")):
        if words := line.split():
            out.append((k, len(words), line_features(line, words, line in seen)))
            seen.add(line)
    return out


def viterbi(chain: Chain, lines: list[tuple[int, ...]]) -> list[int]:
    """Likeliest states of a whole text's lines: 0 content, 1 boilerplate; content where both are as likely."""
    (m00, m01), (m10, m11) = chain.moves.tolist()
    x, y, back = 0.0, float("-inf"), []  # before the first line the state is content
    for active in lines:
        if (score := chain.known.get(active)) is None:
            score = chain.known[active] = chain.bias + float(chain.weights[list(active)].sum())
        back.append((y + m10 > x + m00, y + m11 > x + m01))
        x, y = max(x + m00, y + m10), max(x + m01, y + m11) + score
    state, out = int(y > x), []
    for came in reversed(back):
        out.append(state)
        state = int(came[state])
    return out[::-1]


def training_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, bad) to learn from: quality 0 or 1, crc32 of the id as text not divisible by 5; of several labels the better."""
    fit = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return fit.groupBy("doc_id").agg((1 - F.max("quality")).cast("int").alias("bad"))


def fit_lines(docs: DataFrame, labels: DataFrame) -> Chain:
    """Learns from a bounded sample of labelled rows that pass the plain rules. Without such rows of both labels every line is content."""
    rows = training_rows(labels)
    ids = [rows.where(F.col("bad") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_LABEL) for k in (0, 1)]
    chosen = F.broadcast(ids[0].union(ids[1]))  # at most twice SAMPLE_PER_LABEL rows of two numbers

    def cut(keys: list, texts: list[str], bad: list[int]) -> dict:
        out: dict[str, list] = {"doc_id": [], "k": [], "bad": [], "stretch": []}
        for key, text, y in zip(keys, texts, bad, strict=True):
            if not measures(text)["base_failed"]:
                lines = [list(f) for *_, f in text_lines(text)]
                for k in range(0, len(lines), STRETCH):
                    for name, v in zip(out, (key, k, y, lines[k : k + STRETCH]), strict=True):
                        out[name].append(v)
        return out

    found = materialize(map_columns(docs.select("doc_id", text_or_empty()).join(chosen, "doc_id").select("doc_id", "text", "bad"), cut, "doc_id bigint, k int, bad int, stretch array<array<int>>"))
    share = min(1.0, STRETCHES / max(1, found.count()))
    some = found.where(F.pmod(F.xxhash64("doc_id", "k"), F.lit(1 << 20)) < int(share * (1 << 20))).select("bad", "stretch").collect()  # about STRETCHES rows at most
    chain = Chain(INDEX, np.zeros(len(INDEX)))  # as it is, every line is content
    if {r.bad for r in some} == {0, 1}:
        lines = {k: sum(len(r.stretch) for r in some if r.bad == k) for k in (0, 1)}
        weight = np.array([1.0 / lines[r.bad] for r in some])  # both labels weigh alike, as a bad text kept is as wrong as a good one lost
        stretches = [[tuple(f) for f in r.stretch] for r in some]
        chain.fit(stretches, [[r.bad] * len(r.stretch) for r in some], weight / weight.mean())
    return chain


def content_share(chain: Chain, text: str) -> float:
    """Share of words in content lines; 1 for a text without words."""
    if not (lines := text_lines(text)):
        return 1.0
    bad = viterbi(chain, [f for *_, f in lines])
    return sum(n for (_, n, _), y in zip(lines, bad, strict=True) if not y) / sum(n for _, n, _ in lines)


def content_lines(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lines) of each row: (line, content) for each line with a word, numbers from 0. Null texts have none; cases as in quality_verdicts()."""
    chain = fit_lines(docs, labels)

    def run(keys: list, texts: list[str]) -> dict:
        told = [text_lines(t) for t in texts]
        return {"doc_id": keys, "lines": [[{"line": k, "content": not y} for (k, *_), y in zip(lines, viterbi(chain, [f for *_, f in lines]), strict=True)] for lines in told]}

    return map_columns(docs.select("doc_id", text_or_empty()), run, "doc_id bigint, lines array<struct<line: int, content: boolean>>")


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Plain counts of each row of docs, whether the plain rules reject it, and whether it is kept.

    Null and empty texts have no words and are rejected. Only the text is an input of a verdict. Repeated rows give
    repeated rows; an empty table gives an empty one; further columns don't matter. Without labels of both kinds that
    can be learned from, the plain rules alone decide.
    """
    chain = fit_lines(docs, labels)
    return map_columns(docs.select("doc_id", text_or_empty()), _verdicts(chain), "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double")


def _verdicts(chain: Chain) -> Callable[..., dict]:
    def run(keys: list, texts: list[str]) -> dict:
        told = [measures(t) for t in texts]
        shares = [content_share(chain, t) for t in texts]
        out = {name: [m[name] for m in told] for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")}
        return {"doc_id": keys, **out, "kept": [not m["base_failed"] and s >= LEAST_CONTENT for m, s in zip(told, shares, strict=True)], "content_share": shares}

    return run


def op13_quality_lines(spark, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
