"""Language identification by string kernels.

The kernel of two texts is the number of character 1- to 3-grams present in both (a blended spectrum of presences), divided
by the root of the product of their own numbers. Letters are folded to lower case, all else is a space. Landmark texts
(Nystroem) turn a text into one row of kernel values, and kernel ridge regression, one language versus the rest, turns the
row into a score for each language. Scoring is two matrix products for each block of texts.

N-grams are exact: three code points fit one 64-bit key. Fitting uses a bounded sample of labelled texts (``SAMPLE`` in all,
of at most ``LONGEST`` characters, spread evenly over the languages, distinct texts only); scoring reads whole texts and
runs in one narrow pass. The model that is broadcast is bounded by ``LANDMARKS`` texts.

Whether a text is close to the learned languages at all is told by its own 3-grams: the share that some landmark holds, against
a floor calibrated on labelled texts that are no landmarks, whole and in windows of one to eight words (``CALIBRATION`` of them).

Edge cases: a text that is null or has no letter is ``und`` with score 0 and not close; a language all of whose labelled texts
are longer than ``LONGEST`` is not learned; without any labelled text all are ``und``; ties go
to the language first in code point order; repeated rows each get their own result; empty tables give no rows; other columns
are not read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 3000
LONGEST = 8000
LANDMARKS = 128
CALIBRATION = 400
RIDGE = 1e-3
PART = 1 << 20
#: Texts nearer than ``CLOSE`` times the ``LOWEST`` quantile of held-out ones are close; ``BLIND`` stands in where none is held out.
CLOSE, LOWEST, BLIND = 0.6, 0.005, 0.25
_THREE = np.uint64(1 << 42)  # keys of three characters begin here


@cache
def _folded() -> np.ndarray:
    """The folded code point of every code point: its lower case if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def ngrams(text: str) -> np.ndarray:
    """Sorted distinct 1-, 2- and 3-grams of the folded text as 64-bit keys; by parts for very long texts."""
    found, carried = [], np.full(1, 32, np.uint64)
    for at in range(0, len(text) + 1, PART):
        end = " " if at + PART > len(text) else ""
        part = _folded()[np.frombuffer((text[at:at + PART] + end).encode("utf-32-le"), np.uint32)]
        c = np.concatenate([carried, part])
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        two = (c[:-1] << np.uint64(21)) | c[1:]
        three = (two[:-1] << np.uint64(21)) | c[2:]
        found.append(np.unique(np.concatenate([c[c != 32], two, three])))
        carried = c[-2:]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


class Model:
    """Landmarks as a presence matrix over their n-grams, and the ridge weights of each language."""

    def __init__(self, texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.languages = sorted(set(languages))
        if not self.languages:
            return
        share = max(1, landmarks // len(self.languages))
        grams, seen = [ngrams(t) for t in texts], dict.fromkeys(self.languages, 0)
        chosen = []
        for i, language in enumerate(languages):
            if seen[language] < share:
                seen[language] += 1
                chosen.append(i)
        self.vocabulary = np.unique(np.concatenate([grams[i] for i in chosen]))
        self.presence = np.zeros((len(self.vocabulary), len(chosen)), np.float32)
        for k, i in enumerate(chosen):
            self.presence[np.searchsorted(self.vocabulary, grams[i]), k] = 1
        self.norms = np.sqrt(np.array([len(grams[i]) for i in chosen], np.float64))
        kernel = self._kernel(grams)
        truth = np.array([[1.0 if x == y else -1.0 for y in self.languages] for x in languages])
        weight = np.array([1.0 / languages.count(x) for x in self.languages])[np.argmax(truth, axis=1)][:, None]
        left = kernel.T @ (kernel * weight) + ridge * kernel[chosen] + 1e-9 * np.eye(len(chosen))
        self.weights = np.linalg.solve(left, kernel.T @ (truth * weight))

        self.floor = self._calibrated([t for i, t in enumerate(texts) if i not in set(chosen)][:CALIBRATION])

    def _calibrated(self, texts: list[str]) -> float:
        """The least nearness of a close text, by texts that are no landmarks, whole and in windows of one to eight words."""
        rng, tried = np.random.default_rng(4), []
        for text in texts:
            words = text.split()
            for size in (1, 2, 4, 8):
                at = int(rng.integers(max(1, len(words) - size + 1)))
                tried.append(" ".join(words[at:at + size]))
            tried.append(text)
        tried = [t for t in tried if any(map(str.isalpha, t))]
        return CLOSE * float(np.quantile(self.near([ngrams(t) for t in tried]), LOWEST)) if tried else BLIND

    def near(self, grams: list[np.ndarray]) -> np.ndarray:
        """The share of each text's 3-grams that some landmark holds: near 0 for other scripts, low for other languages."""
        out = np.zeros(len(grams))
        for i, g in enumerate(grams):
            g = g[g >= _THREE]
            k = np.minimum(np.searchsorted(self.vocabulary, g), len(self.vocabulary) - 1)
            out[i] = np.mean(self.vocabulary[k] == g) if len(g) else 0.0
        return out

    def _kernel(self, grams: list[np.ndarray]) -> np.ndarray:
        block, out = max(8, (1 << 22) // len(self.vocabulary)), []
        for at in range(0, len(grams), block):
            part = grams[at:at + block]
            rows = np.zeros((len(part), len(self.vocabulary)), np.float32)
            for r, g in enumerate(part):
                k = np.minimum(np.searchsorted(self.vocabulary, g), len(self.vocabulary) - 1)
                rows[r, k[self.vocabulary[k] == g]] = 1
            own = np.sqrt(np.array([max(1, len(g)) for g in part], np.float64))
            out.append((rows @ self.presence).astype(np.float64) / (own[:, None] * self.norms))
        return np.concatenate(out)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        return self.scored([ngrams(t) for t in texts])

    def scored(self, grams: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        scores = self._kernel(grams) @ self.weights
        best = np.argmax(scores, axis=1)
        return [self.languages[b] for b in best], np.clip((scores[np.arange(len(best)), best] + 1) / 2, 0, 1)


def fit(labelled: DataFrame, text: str = "text", language: str = "lang", sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """A model of a bounded sample of the rows that have a language and a letter."""
    usable = labelled.select(F.col(text).alias("text"), F.col(language).alias("lang")).where(
        F.col("lang").isNotNull() & (F.length("text") <= longest) & F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return Model([], [])
    each = max(1, sample // len(counts))
    rate = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(2.0 * each / n))])
    place = F.shiftrightunsigned(F.xxhash64("text"), 1).cast("double") / float(1 << 63)
    drawn = usable.withColumn("place", place).where(F.col("place") < rate[F.col("lang")]).dropDuplicates(["lang", "place"])
    rows, taken = sorted((r["lang"], r["place"], r["text"]) for r in drawn.collect()), dict.fromkeys(counts, 0)
    texts, languages = [], []
    for lang, _, value in rows:
        if taken[lang] < each:
            taken[lang] += 1
            texts.append(value)
            languages.append(lang)
    return Model(texts, languages)


def _predict(model, keep: list[str], text: str):
    def run(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            with_letter = [i for i, t in enumerate(texts) if t and model.value.languages and any(map(str.isalpha, t))]
            languages, scores, close = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            for at in range(0, len(with_letter), 256):
                rows = with_letter[at:at + 256]
                grams = [ngrams(texts[i]) for i in rows]
                found, values = model.value.scored(grams)
                scores[rows], close[rows] = values, model.value.near(grams) >= model.value.floor
                for i, x in zip(rows, found, strict=True):
                    languages[i] = x
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(languages, pa.string()), pa.array(scores), pa.array(close)],
                names=[*keep, "lang_pred", "score", "close"])

    return run


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of ``keep`` with lang_pred, score and close: is the text like any that was learned from?"""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    head = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(
        _predict(shared, keep, text), f"{head}, lang_pred string, score double, close boolean")
