"""Language-model scores by subword lattices.

A word may be cut into pieces of an existing vocabulary in many ways. The vocabulary's scores weigh the pieces, the
training words reweigh them (expectation and maximisation over all segmentations of each distinct word), and the forward
recursion in log space sums all segmentations of a word. Its probability in a text is then

    P(word) = max(c - D, 0) / (N + 1) + (D * types + 1/2) / (N + 1) * lattice(word)
    P(end)  = (c_end + 1/2) / (N + 1)

for c occurrences in training and N training tokens, ends included: one more path in the lattice for a word that training
has seen, and the subword paths for what the discount D leaves. White space ends words and no piece reaches across it, so
the marginal probability of a text is the product over its words and its end, and each distinct word is worked out once.

Counts, expectations and word scores cover the whole corpus; their tables grow with its distinct words and are staged. A
word with at least one in ``FREQUENT`` of all occurrences is looked up in a broadcast table, which therefore has at most
``FREQUENT`` entries of some 30 bytes; the others are joined by the word itself, and as none of them is frequent, no join
key is hot. The pieces' weights, as many as the vocabulary has, are all that is summed up on the driver.

Edge cases: null counts as the empty text, which is its end alone; repeated rows are scored each, and counted each; rows of
an unknown split (null) are scored but not learned from; an empty table gives no rows; other columns are not read. Without
training texts the vocabulary's own weights score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folderloom.llm.text import LOWER, NOT_SPACE, flat, slabs, string_hashes, word_hashes, word_spans
from folderloom.plans.staging import Stage

FREQUENT = 1_000_000
DISCOUNT = 0.75
ROUNDS = 2
#: Weight of the vocabulary's own scores beside the training words, in pieces.
PRIOR = 50.0
#: Words of up to so many characters are worked out side by side, those of one length together.
SIDE_BY_SIDE = 48
SLAB = 1 << 22
START = "▁"


class Lattice:
    """Pieces with natural-log weights; ``bytes_at`` is where the 256 byte pieces begin, for characters without a piece."""

    def __init__(self, pieces: dict[str, int], logs: np.ndarray, bytes_at: int):
        self.pieces, self.logs, self.bytes_at = pieces, logs, bytes_at
        self.longest = max(map(len, pieces), default=1)

    @classmethod
    def from_file(cls, path: str) -> Lattice:
        """The vocabulary of a SentencePiece file. A merge vocabulary scores by rank: rank r weighs 1 / (r + 10)."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [i for i in range(model.get_piece_size())
                if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): k for k, i in enumerate(kept)}
        scores = np.array([model.get_score(i) for i in kept])
        ranks = bool(np.all(scores == np.round(scores)))
        logs = -np.log(10 - scores) if ranks else scores
        logs = np.concatenate([logs, np.full(256, logs.min() if len(logs) else 0.0)])
        return cls(pieces, logs - np.logaddexp.reduce(logs), len(kept))

    def _arcs(self, s: str, i: int):
        """(end, pieces, log weight) of what can stand at ``i``."""
        get, logs = self.pieces.get, self.logs_list
        one = get(s[i])
        if one is None:
            ids = [self.bytes_at + b for b in s[i].encode()]
            yield i + 1, ids, sum(logs[k] for k in ids)
        else:
            yield i + 1, [one], logs[one]
        for j in range(i + 2, min(len(s), i + self.longest) + 1):
            k = get(s[i:j])
            if k is not None:
                yield j, [k], logs[k]

    @property
    def logs_list(self) -> list[float]:
        found = self.__dict__.get("_logs_list")
        if found is None:
            found = self.__dict__["_logs_list"] = self.logs.tolist()
        return found

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_logs_list"}

    def forward(self, word: str) -> float:
        """Natural log of the summed weight of all segmentations."""
        s = START + word
        n, get, logs, longest = len(s), self.pieces.get, self.logs_list, self.longest
        into: list = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        for i in range(n):
            terms = into[i]
            into[i] = None
            top = max(terms)
            a = top if len(terms) == 1 else top + math.log(sum([math.exp(x - top) for x in terms]))
            one = get(s[i])
            into[i + 1].append(a + (logs[one] if one is not None else sum(logs[self.bytes_at + b] for b in s[i].encode())))
            for j in range(i + 2, min(n, i + longest) + 1):
                k = get(s[i:j])
                if k is not None:
                    into[j].append(a + logs[k])
        top = max(into[n])
        return top + math.log(sum(math.exp(x - top) for x in into[n]))

    def expect(self, word: str, counts: np.ndarray) -> None:
        """Add to ``counts`` how often each piece is expected in ``word``, over all segmentations."""
        s = START + word
        n = len(s)
        into: list[list] = [[] for _ in range(n + 1)]
        alpha = [0.0] * (n + 1)
        for i in range(n + 1):
            if i:
                terms = [alpha[a] + w for a, _, w in into[i]]
                top = max(terms)
                alpha[i] = top + math.log(sum([math.exp(x - top) for x in terms]))
            if i < n:
                for j, ids, w in self._arcs(s, i):
                    into[j].append((i, ids, w))
        back = [0.0] * (n + 1)  # the share of all segmentations that passes a position
        back[n] = 1.0
        for j in range(n, 0, -1):
            for i, ids, w in into[j]:
                share = back[j] * math.exp(alpha[i] + w - alpha[j])
                back[i] += share
                for k in ids:
                    counts[k] += share
            into[j] = []


class Table:
    """The same recursions for many words of one length at a time; pieces are found by the hash of their characters."""

    def __init__(self, lattice: Lattice):
        self.lattice, names = lattice, list(lattice.pieces)
        self.logs = lattice.logs
        hashes = np.array([string_hashes(self._codes([p]))(0, len(p))[0] for p in names], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array([lattice.pieces[p] for p in names])[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._slot(hashes)] = True

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)

    def _arcs(self, codes: np.ndarray):
        """(begin, end, rows, pieces, log weights, characters) of all arcs; pieces of -1 are characters without a piece."""
        hashes, (m, n), longest = string_hashes(codes), codes.shape, self.lattice.longest
        for i in range(n):
            for j in range(i + 1, min(n, i + longest) + 1):
                h = hashes(i, j)
                rows = np.flatnonzero(self.seen[self._slot(h)])
                at = np.minimum(np.searchsorted(self.hashes, h[rows]), len(self.hashes) - 1)
                hit = self.hashes[at] == h[rows]
                rows, ids = rows[hit], self.ids[at[hit]]
                if len(rows):
                    yield i, j, rows, ids, self.logs[ids], None
                if j == i + 1 and len(rows) < m:
                    bare = np.ones(m, bool)
                    bare[rows] = False
                    rows = np.flatnonzero(bare)
                    kinds, which = np.unique(codes[rows, i], return_inverse=True)
                    cost = np.array([sum(self.logs[self.lattice.bytes_at + b] for b in chr(c).encode()) for c in kinds])
                    yield i, j, rows, np.full(len(rows), -1), cost[which], codes[rows, i]

    def _alpha(self, codes: np.ndarray, keep: list | None) -> np.ndarray:
        alpha = np.full((codes.shape[1] + 1, len(codes)), -np.inf)
        alpha[0] = 0
        for arc in self._arcs(codes):
            i, j, rows, _, w, _ = arc
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + w)
            if keep is not None:
                keep.append(arc)
        return alpha

    def _groups(self, words: list[str]):
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w) if len(w) <= SIDE_BY_SIDE else -1, []).append(k)
        return by_length.items()

    def forward(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for length, at in self._groups(words):
            if length < 0:
                out[at] = [self.lattice.forward(words[k]) for k in at]
            else:
                out[at] = self._alpha(self._codes([START + words[k] for k in at]), None)[-1]
        return out

    def expect(self, words: list[str], counts: np.ndarray) -> None:
        for length, at in self._groups(words):
            if length < 0:
                for k in at:
                    self.lattice.expect(words[k], counts)
                continue
            arcs: list = []
            alpha = self._alpha(self._codes([START + words[k] for k in at]), arcs)
            back = np.zeros_like(alpha)
            back[-1] = 1
            arcs.sort(key=lambda arc: -arc[1])  # an arc's share is known when all that leave its end are done
            for i, j, rows, ids, w, chars in arcs:
                share = back[j, rows] * np.exp(alpha[i, rows] + w - alpha[j, rows])
                back[i, rows] += share
                if chars is None:
                    counts += np.bincount(ids, share, minlength=len(counts))
                else:
                    for c in np.unique(chars):
                        for b in chr(c).encode():
                            counts[self.lattice.bytes_at + b] += share[chars == c].sum()


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at])).cast(pa.string())


def _count(text: str, train: str):
    def run(batches):
        for batch in batches:
            flags = np.array([bool(x) for x in batch.column(train).to_pylist()])
            for i, _, data, offsets in slabs(batch.column(text), SLAB):
                data = LOWER[data]
                starts, ends, rows = word_spans(data, offsets, NOT_SPACE)
                if not len(starts):
                    continue
                _, first, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [_strings(data, starts[first], ends[first]),
                     pa.array(np.bincount(which, flags[i + rows], minlength=len(first)).astype(np.int64)),
                     pa.array(np.bincount(which, minlength=len(first)))], names=["token", "c", "uses"])

    return run


def _expect(lattice):
    def run(batches):
        table, counts = Table(lattice.value), np.zeros(len(lattice.value.logs))
        for batch in batches:
            table.expect(batch.column("token").to_pylist(), counts)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["piece", "n"])

    return run


def _words(lattice, total: int, distinct: int, types: int, discount: float):
    """Each distinct word with its hash and its part of the scores."""

    def run(batches):
        rest, table = math.log10((discount * types + 0.5) / (total + 1)), Table(lattice.value)
        for batch in batches:
            c = batch.column("c").to_numpy().astype(float)
            data, offsets = flat(batch.column("token"))
            spell = table.forward(batch.column("token").to_pylist()) / math.log(10) + rest
            with np.errstate(divide="ignore"):
                seen = np.log10(np.maximum(c - discount, 0) / (total + 1))
            high = np.maximum(seen, spell)
            score = high + np.log10(10 ** (seen - high) + 10 ** (spell - high))
            base = np.log10((c + 1) / (total + distinct + 1))
            hashes = word_hashes(data, offsets[:-1], offsets[1:]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("token"), batch.column("uses"), pa.array(hashes), pa.array(c > 0), pa.array(base), pa.array(score)],
                names=["token", "uses", "hash", "known", "base", "score"])

    return run


class Lookup:
    """The frequent words' parts by hash, sorted."""

    def __init__(self, hashes: np.ndarray, known: np.ndarray, base: np.ndarray, score: np.ndarray, end: tuple):
        order = np.argsort(hashes)
        self.hashes, self.known, self.base, self.score = hashes[order], known[order], base[order], score[order]
        self.end = end


def _score(lookup, keep: list[str], text: str):
    """A row for each text with the parts of its frequent words, and a row for each distinct other word of a text."""

    def run(batches):
        t: Lookup = lookup.value
        known_end, base_end, score_end = t.end
        for batch in batches:
            for i, j, data, offsets in slabs(batch.column(text), SLAB):
                n = j - i
                data = LOWER[data]
                starts, ends, rows = word_spans(data, offsets, NOT_SPACE)
                h = word_hashes(data, starts, ends)
                at = np.minimum(np.searchsorted(t.hashes, h), max(0, len(t.hashes) - 1))
                hit = t.hashes[at] == h if len(t.hashes) else np.zeros(len(h), bool)
                f, r = at[hit], rows[hit]
                own = [batch.column(c).slice(i, n) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(np.bincount(rows, minlength=n) + 1),
                     pa.array((np.bincount(r, t.known[f], minlength=n) + known_end).astype(np.int64)),
                     pa.array(np.bincount(r, t.base[f], minlength=n) + base_end),
                     pa.array(np.bincount(r, t.score[f], minlength=n) + score_end), pa.nulls(n, pa.string())],
                    names=[*keep, "n_tokens", "n_known", "base_score", "score", "token"])
                rest = np.flatnonzero(~hit)
                if not len(rest):
                    continue
                key = h[rest] ^ (rows[rest].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                _, first, times = np.unique(key, return_index=True, return_counts=True)
                first = rest[first]
                m, row = len(first), batch.column("_row").slice(i, n).take(pa.array(rows[first]))
                rare = {"_row": row, "n_tokens": pa.array(times), "token": _strings(data, starts[first], ends[first])}
                empty = {c: pa.nulls(m, batch.column(c).type) for c in keep} | {
                    "n_known": pa.nulls(m, pa.int64()), "base_score": pa.nulls(m, pa.float64()), "score": pa.nulls(m, pa.float64())}
                names = [*keep, "n_tokens", "n_known", "base_score", "score", "token"]
                yield pa.RecordBatch.from_arrays([(empty | rare)[c] for c in names], names=names)

    return run


def scores(docs: DataFrame, train: Column, path: str, keep: list[str], text: str = "text", rounds: int = ROUNDS,
           discount: float = DISCOUNT, frequent: int = FREQUENT) -> DataFrame:
    """The columns of ``keep`` with n_tokens, n_known, train_tokens, base_score and score; learned from rows of ``train``."""
    spark = docs.sparkSession
    stage, context = Stage(spark), spark.sparkContext
    flagged = docs.select(F.coalesce(train, F.lit(False)).alias("_train"), F.col(text).alias("_text"))
    counts = flagged.mapInArrow(_count("_text", "_train"), "token string, c long, uses long")
    counts = stage.keep(counts.groupBy("token").agg(F.sum("c").alias("c"), F.sum("uses").alias("uses")), "counts")
    texts = flagged.agg(F.count_if("_train")).first()[0]
    words, types, uses = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum("uses"), F.lit(0))).first()
    total, distinct = words + texts, types + (1 if texts else 0)

    lattice = Lattice.from_file(path)
    own = np.exp(lattice.logs)
    for _ in range(rounds if types else 0):
        found = counts.where(F.col("c") > 0).select("token").mapInArrow(_expect(context.broadcast(lattice)), "piece long, n double")
        expected = np.zeros(len(own))
        for piece, n in found.groupBy("piece").agg(F.sum("n")).collect():
            expected[piece] = n
        lattice = Lattice(lattice.pieces, np.log((expected + PRIOR * own) / (expected.sum() + PRIOR)), lattice.bytes_at)

    table = counts.mapInArrow(_words(context.broadcast(lattice), total, distinct, types, discount),
                              "token string, uses long, hash long, known boolean, base double, score double")
    table = stage.keep(table, "words")
    # Less than one in ``frequent`` of all uses: at most ``frequent`` words reach the bound.
    least = max(1, -(-uses // frequent))
    often = table.where(F.col("uses") >= least).select("hash", "known", "base", "score").toPandas()
    end = (int(texts > 0), math.log10((texts + 1) / (total + distinct + 1)), math.log10((texts + 0.5) / (total + 1)))
    lookup = context.broadcast(Lookup(often["hash"].to_numpy(np.int64).view(np.uint64), often["known"].to_numpy(float),
                                      often["base"].to_numpy(float), often["score"].to_numpy(float), end))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    head = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    numbered = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    parts = stage.keep(numbered.mapInArrow(
        _score(lookup, [*keep, "_row"], "_text"),
        f"{head}, _row long, n_tokens long, n_known long, base_score double, score double, token string"), "parts")
    rare = parts.where(F.col("token").isNotNull()).select("_row", "token", F.col("n_tokens").alias("times"))
    rare = rare.join(table.where(F.col("uses") < least).hint("merge"), "token").groupBy("_row").agg(
        F.sum(F.when(F.col("known"), F.col("times")).otherwise(0)).alias("_known"),
        F.sum(F.col("times") * F.col("base")).alias("_base"), F.sum(F.col("times") * F.col("score")).alias("_score"))
    return parts.where(F.col("token").isNull()).join(rare.hint("merge"), "_row", "left").select(
        *keep, "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"))
