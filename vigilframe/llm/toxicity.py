"""Toxicity by a linear-chain conditional random field over tokens.

Labels are given for documents only. Words and word beginnings that occur nearly always in toxic documents mark the
tokens of toxic training documents; a two-state chain learns from these token labels. Forward-backward over the whole
text gives each token's marginal chance; runs of tokens without features are crossed by powers of one matrix. A logistic
curve over the sum and the maximum of the chances of tokens with features gives the document's score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, materialize, table, text_or_empty

#: Bound of the training sample: so many documents of each label, those with the least hash of their id. Each stands for count/sampled rows of its label.
SAMPLE_PER_LABEL = 4000
#: A feature marks toxic tokens if its smoothed share of toxic documents, among all training rows, is at least this.
PRECISION, SMOOTHING = 0.7, 2.0
PREFIXES = (4, 5, 6, 7, 8)
#: The weights are fitted on stretches of the sample's texts: tokens with features, so many tokens on each side of them,
#: at most so many tokens in one, and about so many of them in all, chosen by hash. Scoring runs over whole texts.
CONTEXT, STRETCH, STRETCHES = 3, 40, 100_000
ITERATIONS, RATE, DECAY = 150, 0.1, 1e-3
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word itself and its beginnings, told apart by a trailing sign."""
    return [word + "$", *(word[:k] for k in PREFIXES if len(word) > k)]


def training_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) to learn from: labelled 0 or 1, crc32 of the id as text not divisible by 5; of several labels the highest."""
    fit = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return fit.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = training_rows(labels)
    ids = [rows.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_LABEL) for k in (0, 1)]
    chosen = F.broadcast(ids[0].union(ids[1]))  # at most twice SAMPLE_PER_LABEL rows of two numbers
    return materialize(docs.select("doc_id", text_or_empty()).join(chosen, "doc_id"))


def label_weights(labels: DataFrame) -> dict[int, float]:
    """How many training rows a sampled row of each label stands for; 1 where all are sampled."""
    counts = {r.toxic: r["count"] for r in training_rows(labels).groupBy("toxic").count().collect()}
    return {k: max(1.0, counts.get(k, 0) / SAMPLE_PER_LABEL) for k in (0, 1)}


def toxic_features(sample: DataFrame, weights: dict[int, float]) -> list[str]:
    """Features whose documents are nearly all toxic. Their number is bounded by the sample's distinct features over the least support.

    Clean documents are weighed against a toxic one, so that support and smoothing stay in sampled toxic documents.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
                for text, toxic in zip(*(c.to_pylist() for c in batch.slice(k, 64).columns), strict=True):
                    seen[toxic].update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
                every = list(seen[0] | seen[1])
                told = {"feature": every, "clean": [seen[0][f] for f in every], "toxic": [seen[1][f] for f in every]}
                yield pa.RecordBatch.from_pydict(told, schema=pa.schema([("feature", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]))

    counts = sample.select("text", "toxic").mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    clean = F.col("clean") * (weights[0] / weights[1])
    rows = counts.where(F.col("toxic") >= PRECISION * (F.col("toxic") + clean + SMOOTHING)).select("feature").collect()
    return sorted(r.feature for r in rows)


@dataclass
class Chain:
    """Two states, clean and toxic. Scores: of the toxic state a bias and weights of features; of transitions, three numbers (clean to clean is 0)."""

    index: dict[str, int]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -2.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.array([-2.0, 0.0, 0.0]))
    known: dict[str, tuple] = field(default_factory=dict)

    def active(self, word: str) -> tuple[int, ...]:
        if (found := self.known.get(word)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[word] = tuple(self.index[f] for f in features(word) if f in self.index)
        return found

    def tokens(self, text: str) -> list[tuple[int, int, tuple[int, ...]]]:
        """(start, end, features) of all tokens of a text that has any with features, else none."""
        low = text.lower()
        if not any(self.active(w) for w in set(WORD.findall(low))):
            return []
        return [(m.start(), m.end(), self.active(m.group())) for m in WORD.finditer(low)]

    def stretches(self, text: str) -> list[list[tuple[int, ...]]]:
        """Features of the tokens in stretches around tokens with features, to learn from."""
        tokens = [t[2] for t in self.tokens(text)]
        out: list[list[int]] = []
        for i in (i for i, t in enumerate(tokens) if t):
            if out and i - CONTEXT <= out[-1][1]:
                if i + CONTEXT + 1 - out[-1][0] <= STRETCH:
                    out[-1][1] = i + CONTEXT + 1
                elif i >= out[-1][1]:
                    out.append([out[-1][1], i + CONTEXT + 1])
            else:
                out.append([max(0, i - CONTEXT), i + CONTEXT + 1])
        return [tokens[a:b] for a, b in out]

    def marginals(self, scores: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over padded chains: chance of the toxic state, of each pair of neighbouring states, log of the sum over paths."""
        n, most = scores.shape
        emit = np.stack([np.zeros_like(scores), scores], axis=2)
        forward, backward = np.empty((n, most, 2)), np.zeros((n, most, 2))
        forward[:, 0] = emit[:, 0] + self.moves[0]
        for t in range(1, most):
            forward[:, t] = np.logaddexp(forward[:, t - 1, :1] + self.moves[0], forward[:, t - 1, 1:] + self.moves[1]) + emit[:, t]
        for t in range(most - 2, -1, -1):
            ahead = backward[:, t + 1] + emit[:, t + 1]
            step = np.stack([np.logaddexp(ahead[:, 0] + self.moves[k, 0], ahead[:, 1] + self.moves[k, 1]) for k in (0, 1)], axis=1)
            backward[:, t] = np.where((t + 1 < size)[:, None], step, 0.0)
        total = np.logaddexp(*forward[np.arange(n), size - 1].T)
        toxic = np.exp(forward[..., 1] + backward[..., 1] - total[:, None])
        pairs = np.exp(forward[:, :-1, :, None] + self.moves + (emit + backward)[:, 1:, None, :] - total[:, None, None, None])
        inside = np.arange(most) < size[:, None]
        return np.where(inside, toxic, 0.0), np.where(inside[:, 1:, None, None], pairs, 0.0), total

    def fit(self, chains: list[list[tuple[int, ...]]], truth: list[list[int]], weight: np.ndarray) -> None:
        """Gradient ascent (Adam) on the weighted conditional likelihood of the token labels, chains of like length together."""
        order = sorted(range(len(chains)), key=lambda k: len(chains[k]))
        groups = [self._padded([chains[k] for k in some], [truth[k] for k in some], weight[some]) for some in (order[k : k + 2048] for k in range(0, len(order), 2048))]
        value = np.concatenate([np.zeros(len(self.index)), [self.bias], np.zeros(4)])
        first, second = np.zeros_like(value), np.zeros_like(value)
        for step in range(1, ITERATIONS + 1):
            self.weights, self.bias, self.moves = value[:-5], value[-5], value[-4:].reshape(2, 2)
            grad = sum(self._gradient(*g) for g in groups) / weight.sum() - DECAY * value
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
            value = value + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        self.weights, self.bias, self.moves = value[:-5], float(value[-5]), value[-4:].reshape(2, 2)

    @staticmethod
    def _padded(chains: list[list[tuple[int, ...]]], truth: list[list[int]], weight: np.ndarray) -> tuple:
        """Sizes, labels, weights, moves seen, and where which feature stands."""
        size = np.array([len(c) for c in chains])
        label = np.zeros((len(chains), size.max()))
        at, which = [], []
        for i, (c, y) in enumerate(zip(chains, truth, strict=True)):
            label[i, : len(y)] = y
            for t, active in enumerate(c):
                at += [i * label.shape[1] + t] * len(active)
                which += active
        inside = np.arange(label.shape[1]) < size[:, None]
        states, seen = label.astype(int), np.zeros((2, 2))
        np.add.at(seen, (states[:, :-1][inside[:, 1:]], states[:, 1:][inside[:, 1:]]), np.broadcast_to(weight[:, None], label.shape)[:, 1:][inside[:, 1:]])
        seen[0] += np.bincount(states[:, 0], weight, minlength=2)
        return size, label, inside, weight, seen, np.array(at, int), np.array(which, int)

    def _gradient(self, size, label, inside, weight, seen, at, which) -> np.ndarray:
        scores = (np.bincount(at, self.weights[which], label.size) + self.bias).reshape(label.shape)
        toxic, pairs, _ = self.marginals(scores, size)
        off = np.where(inside, label - toxic, 0.0) * weight[:, None]
        expected = (pairs * weight[:, None, None, None]).sum((0, 1))
        expected[0] += [weight @ (1 - toxic[:, 0]), weight @ toxic[:, 0]]
        moves = seen - expected
        moves[0, 0] = 0
        return np.concatenate([np.bincount(which, off.ravel()[at], len(self.index)), [off.sum()], moves.ravel()])

    def plain(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Parts of the move over g tokens without features, up to a factor: first + rate**g * second. The two projectors of a matrix of positive numbers."""
        step = np.exp(self.moves + np.array([0.0, self.bias]))
        mean, apart = np.trace(step) / 2, np.sqrt(((step[0, 0] - step[1, 1]) / 2) ** 2 + step[0, 1] * step[1, 0])
        high, low = mean + apart, mean - apart
        first = (step - low * np.eye(2)) / (high - low)
        return first, np.eye(2) - first, float(low / high)

    def chances(self, n: int, at: list[int], score: list[float]) -> np.ndarray:
        """Chance of the toxic state of each of n tokens; those at `at`, one or more, have scores of their own, all others the bias.

        Before the text the state is clean. Messages pass from one scored token to the next in one step each; between
        them chances come from both sides' messages in closed form, so nothing is cut however long the text is.
        """
        (((a, b), (c, d)), ((e, f), (g, h)), rate) = self.plain()
        (m00, m01), (m10, m11) = np.exp(self.moves).tolist()
        gaps = [y - x - 1 for x, y in zip([-1, *at], [*at, n], strict=True)]
        lift = [float(np.exp(np.clip(s, -60, 60))) for s in score]

        def norm(x: float, y: float) -> tuple[float, float]:
            return x / (x + y), y / (x + y)

        before, x, y = [(1.0, 0.0)], 1.0, 0.0
        for k, gap in enumerate(gaps[:-1]):
            q = rate**gap
            x, y = x * (a + q * e) + y * (c + q * g), x * (b + q * f) + y * (d + q * h)
            x, y = norm(x * m00 + y * m10, (x * m01 + y * m11) * lift[k])
            before.append((x, y))
        q = rate ** gaps[-1]
        x, y = norm(a + q * e + b + q * f, c + q * g + d + q * h)
        after = [(x, y)]  # at the scored token itself, of what follows
        ahead = [(1.0, 1.0)]  # at the last token of each gap, of what follows it
        for k in range(len(at) - 1, -1, -1):
            x, y = norm(m00 * x + m01 * lift[k] * y, m10 * x + m11 * lift[k] * y)
            ahead.append((x, y))
            q = rate ** gaps[k]
            x, y = norm((a + q * e) * x + (b + q * f) * y, (c + q * g) * x + (d + q * h) * y)
            after.append((x, y))
        after, ahead = after[::-1], ahead[::-1]  # after[k + 1] belongs to at[k]; ahead[k] to gap k
        out = np.empty(n)
        for k, t in enumerate(at):
            clean, toxic = before[k + 1][0] * after[k + 1][0], before[k + 1][1] * after[k + 1][1]
            out[t] = toxic / (clean + toxic)
        start = 0
        for k, gap in enumerate(gaps):
            if gap:
                (x, y), (u, v) = before[k], ahead[k]
                up = rate ** np.arange(1, gap + 1, dtype="f8")
                down = rate ** np.arange(gap - 1, -1, -1, dtype="f8")
                clean = (x * (a + up * e) + y * (c + up * g)) * ((a + down * e) * u + (b + down * f) * v)
                toxic = (x * (b + up * f) + y * (d + up * h)) * ((c + down * g) * u + (d + down * h) * v)
                out[start : start + gap] = toxic / (clean + toxic)
            start += gap + 1
        return out

    def tag(self, texts: list[str]) -> list[tuple[list[float], list[tuple[int, int]]]]:
        """For each text the chances of its tokens with features, and (start, end) of all tokens more likely toxic than not, by code points of the text in lower case.

        A text that has no token with features is taken as clean.
        """
        out: list[tuple[list[float], list[tuple[int, int]]]] = []
        for text in texts:
            if not (tokens := self.tokens(text)):
                out.append(([], []))
                continue
            at = [i for i, t in enumerate(tokens) if t[2]]
            p = self.chances(len(tokens), at, [self.bias + float(self.weights[list(tokens[i][2])].sum()) for i in at])
            out.append((p[at].tolist(), [tokens[i][:2] for i in np.flatnonzero(p >= 0.5)]))
        return out

    def score(self, tagged: list[tuple[list[float], list]]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.inputs(tagged) @ self.curve)))

    @staticmethod
    def inputs(tagged: list[tuple[list[float], list]]) -> np.ndarray:
        return np.array([[1.0, np.log1p(sum(p)), max(p, default=0.0)] for p, _ in tagged]).reshape(-1, 3)

    def fit_curve(self, x: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> None:
        """Weighted logistic regression by Newton's method, lightly damped."""
        w = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            damp = np.diag([1e-6, 0.05, 0.05])
            w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + damp + 1e-9 * np.eye(3), x.T @ (weight * (truth - p)) - damp @ w)
        self.curve = w


def fit_chain(docs: DataFrame, labels: DataFrame) -> Chain:
    """Learns from a bounded sample of the training rows, weighed so that the balance of labels is that of all training rows.

    Without training rows of both labels every document scores under one half.
    """
    sample, stands_for = training_sample(docs, labels), label_weights(labels)
    found = toxic_features(sample, stands_for)
    chain = Chain({f: i for i, f in enumerate(found)}, np.zeros(len(found)))
    if not found:
        return chain

    def cut(keys: list, texts: list[str], toxic: list[int]) -> dict:
        each = [(key, k, y, [list(t) for t in c]) for key, text, y in zip(keys, texts, toxic, strict=True) for k, c in enumerate(chain.stretches(text))]
        return dict(zip(("doc_id", "k", "toxic", "stretch"), map(list, zip(*each, strict=True)) if each else ([], [], [], []), strict=True))

    def inputs(texts: list[str], toxic: list[int]) -> dict:
        x = chain.inputs(chain.tag(texts))
        return {"toxic": toxic, "amount": x[:, 1].tolist(), "most": x[:, 2].tolist()}

    found = materialize(map_columns(sample.select("doc_id", "text", "toxic"), cut, "doc_id bigint, k int, toxic int, stretch array<array<int>>"))
    share = min(1.0, STRETCHES / max(1, found.count()))
    rows = found.where(F.pmod(F.xxhash64("doc_id", "k"), F.lit(1 << 20)) < int(share * (1 << 20))).collect()  # about STRETCHES rows at most
    weight = np.array([stands_for[r.toxic] for r in rows])
    stretches = [[tuple(t) for t in r.stretch] for r in rows]
    chain.fit(stretches, [[int(bool(t) and r.toxic) for t in c] for c, r in zip(stretches, rows, strict=True)], weight / weight.mean())
    chain.known.clear()
    rows = map_columns(sample.select("text", "toxic"), inputs, "toxic int, amount double, most double").collect()  # a row for each sampled document
    weight = np.array([stands_for[r.toxic] for r in rows])
    chain.known.clear()
    # Weights average one, so damping and decay stay as they are to the sample.
    chain.fit_curve(np.array([[1.0, r.amount, r.most] for r in rows]), np.array([r.toxic for r in rows], float), weight / weight.mean())
    return chain


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, spans) of each row: spans are (start, stop) code points, in the text's lower case, of tokens more likely toxic than not.

    Null texts are empty; texts without evidence get the curve's foot. Only the text is an input of the score. Repeated
    rows give repeated rows; an empty table gives an empty one; further columns don't matter.
    """
    chain = fit_chain(docs, labels)

    def run(keys: list, texts: list[str]) -> dict:
        tagged = chain.tag(texts)
        return {"doc_id": keys, "score": chain.score(tagged).tolist(), "spans": [[{"start": a, "stop": b} for a, b in spans] for _, spans in tagged]}

    return map_columns(docs.select("doc_id", text_or_empty()), run, "doc_id bigint, score double, spans array<struct<start: int, stop: int>>")


def op9_toxicity_crf(spark, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_toxic_tokens"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score under one half, as they are, null and empty texts and repeated rows among them; an empty table gives an empty one."""
    from pyspark.sql.functions import pandas_udf

    chain = fit_chain(docs, labels)

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(chain.score(chain.tag(texts.fillna("").tolist())))

    return docs.where(score("text") < 0.5)
