"""Quality by positive-unlabelled learning.

Trusted positives and unlabelled texts give the non-negative unbiased risk: with class prior p, the loss of positives as
positives weighs p, and the loss of negatives is that of unlabelled texts as negatives less p times that of positives as
negatives, held from falling below zero. Where that part turns negative, a step goes against it, as the published method
has it. The scorer is logistic over shares of characters, words and repeats and their products, so its score estimates the
probability of label 1.

The prior is estimated from the labelled rows where both labels occur, else from how the scores of unlabelled texts and of
positives compare: the least ratio of their tails.

Features are counted in one narrow pass over whole texts. Fitting takes a bounded sample: at most about ``POSITIVES``
positives and ``UNLABELLED`` other rows, drawn by hash over the whole table; only their features reach the driver.

Edge cases: null counts as the empty text, whose features are all zero; a document with labels of both kinds has none;
without positives every score is 0.5; repeated rows each get their own result; empty tables give no rows; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folderloom.llm.text import LOWER, NOT_SPACE, run_hashes, slabs, word_hashes, word_spans

POSITIVES, UNLABELLED = 8_000, 16_000
STEPS, RATE, DECAY = 500, 0.05, 1e-4

_byte = np.arange(256)
#: Kinds of bytes whose shares are features.
KINDS = [
    (_byte >= 65) & (_byte <= 90), (_byte >= 97) & (_byte <= 122), (_byte >= 48) & (_byte <= 57), _byte >= 128, _byte == 10,
    np.isin(_byte, list(b" \t\x0b\x0c\r")), np.isin(_byte, list(b".,;:'\"")), np.isin(_byte, list(b"!?")),
    np.isin(_byte, list(b"#$%&*@^~|\\+=")), np.isin(_byte, list(b"()[]{}<>/-_`")),
]
_KIND = np.zeros(256, np.int64)
for _k, _mask in enumerate(KINDS):
    _KIND[_mask] = _k + 1
WIDTH = len(KINDS) + 11


def _distinct(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each row."""
    own = keys ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.bincount(rows[np.unique(own, return_index=True)[1]], minlength=n)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``WIDTH`` numbers for each text of a slab."""
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH))
    if not len(data):
        return out
    size = np.diff(offsets)
    row_of = np.repeat(np.arange(n), size)
    shares = np.bincount(row_of * (len(KINDS) + 1) + _KIND[data], minlength=n * (len(KINDS) + 1)).reshape(n, -1)
    some = np.maximum(size, 1)
    out[:, :len(KINDS)] = shares[:, 1:] / some[:, None]
    starts, ends, rows = word_spans(data, offsets, NOT_SPACE)
    lines, line_ends, line_rows = word_spans(data, offsets, _byte != 10)
    k = len(KINDS)
    words = np.bincount(rows, minlength=n)
    many = np.maximum(words, 1)
    out[:, k] = np.log1p(words) / 10
    if len(starts):
        lower = LOWER[data]
        length = ends - starts
        hashes = word_hashes(lower, starts, ends)
        out[:, k + 1] = np.bincount(rows, length, minlength=n) / many / 10
        out[:, k + 2] = np.bincount(rows, length <= 2, minlength=n) / many
        out[:, k + 3] = np.bincount(rows, length >= 12, minlength=n) / many
        last = data[ends - 1]
        out[:, k + 4] = np.bincount(rows, KINDS[8][last], minlength=n) / many
        out[:, k + 5] = np.bincount(rows, KINDS[7][last], minlength=n) / many
        out[:, k + 6] = np.bincount(rows, KINDS[0][data[starts]], minlength=n) / many
        out[:, k + 7] = (words > 0) - _distinct(hashes, rows, n) / many
        runs = run_hashes(hashes, 4)
        if len(runs):
            whole = rows[:len(runs)] == rows[3:]
            out[:, k + 8] = 1 - (_distinct(runs[whole], rows[:len(runs)][whole], n) + (words < 4)) / np.maximum(words - 3, 1)
            out[:, k + 8] = np.clip(out[:, k + 8], 0, 1)
    if len(lines):
        n_lines = np.bincount(line_rows, minlength=n)
        out[:, k + 9] = (n_lines > 0) - _distinct(word_hashes(data, lines, line_ends), line_rows, n) / np.maximum(n_lines, 1)
        out[:, k + 10] = np.log1p(n_lines) / 10
    out[size == 0] = 0
    return out


class Model:
    """A logistic scorer over standardised features and their products."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None):
        self.weights = None
        if not len(positive) or not len(unlabelled):
            return
        both = np.concatenate([positive, unlabelled])
        self.mean, self.spread = both.mean(axis=0), both.std(axis=0) + 1e-6
        p, u = self._expanded(positive), self._expanded(unlabelled)
        if prior is None:
            self._descend(p, u, 0.5)
            prior = self._tails(p @ self.weights, u @ self.weights)
        self.prior = min(max(prior, 0.01), 0.99)
        self._descend(p, u, self.prior)

    def _expanded(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -5, 5)
        i, j = np.triu_indices(z.shape[1])
        return np.concatenate([np.ones((len(z), 1)), z, z[:, i] * z[:, j] / 5], axis=1)

    @staticmethod
    def _tails(p: np.ndarray, u: np.ndarray) -> float:
        cuts = np.quantile(p, np.linspace(0.05, 0.8, 40))
        return float(min((u >= c).mean() / max((p >= c).mean(), 1e-9) for c in cuts))

    def _descend(self, p: np.ndarray, u: np.ndarray, prior: float) -> None:
        """Adam on the non-negative risk with the logistic loss, all rows in each step."""
        w = np.zeros(p.shape[1])
        first, second = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, STEPS + 1):
            gp, gu = p @ w, u @ w
            sp, su = 1 / (1 + np.exp(-np.clip(gp, -30, 30))), 1 / (1 + np.exp(-np.clip(gu, -30, 30)))
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            part = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
            if negative >= 0:
                grad = prior * (p.T @ (sp - 1)) / len(p) + part
            else:
                grad = -part
            grad = grad + DECAY * w
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad * grad
            w -= RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        self.weights = w

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self._expanded(x) @ self.weights, -30, 30)))


def _featured(keep: list[str], text: str, model=None):
    """Batches of ``keep`` with the features, or with the score of ``model``."""

    def run(batches):
        for batch in batches:
            found = [np.zeros((0, WIDTH) if model is None else 0)]
            for _, _, data, offsets in slabs(batch.column(text)):
                x = features(data, offsets)
                found.append(x if model is None else model.value.score(x))
            out = np.concatenate(found)
            if model is None:
                out = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * WIDTH, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out)],
                                             names=[*keep, "features" if model is None else "score"])

    return run


def _draw(column: str, share: float):
    return F.shiftrightunsigned(F.xxhash64(F.lit("draw"), column), 1).cast("double") / float(1 << 63) < share


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model of positives among ``labels`` and of all of ``docs`` as unlabelled texts."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        F.min(label).alias("_low"), F.max(label).alias("_high")).where(F.col("_low") == F.col("_high"))
    # A label counts if it has its document.
    known = known.join(docs.select(F.col(doc_id).alias("_id")).distinct(), "_id", "left_semi")
    n = {r[0]: r[1] for r in known.groupBy("_low").count().collect()}
    total = docs.count()
    if not n.get(1) or not total:
        return Model(np.zeros((0, WIDTH)), np.zeros((0, WIDTH)), None)
    prior = n[1] / (n[0] + n[1]) if n.get(0) else None
    drawn = known.where((F.col("_low") == 1) & _draw("_id", POSITIVES / n[1])).select("_id").collect()
    ids = spark.createDataFrame(drawn, known.select("_id").schema)
    marked = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(
        F.broadcast(ids.withColumn("_positive", F.lit(True))), "_id", "left")
    # Two uses of one table: a row may be a positive and one of the unlabelled.
    spread = F.shiftrightunsigned(F.xxhash64(F.lit("row"), "_id", "_text"), 1).cast("double") / float(1 << 63)
    sampled = marked.withColumn("_free", spread < UNLABELLED / total).where(F.col("_free") | F.col("_positive").isNotNull())
    rows = sampled.mapInArrow(_featured(["_positive", "_free"], "_text"),
                              "_positive boolean, _free boolean, features array<double>").dropDuplicates().toPandas()
    x = np.array(rows["features"].tolist()).reshape(len(rows), WIDTH)
    return Model(x[rows["_positive"].notna().to_numpy()], x[rows["_free"].to_numpy(bool)], prior)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of ``keep`` with the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    head = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(_featured(keep, text, shared), f"{head}, score double")
