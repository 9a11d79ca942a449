"""Toxicity scores by a factorization machine over hashed terms.

Terms are a text's distinct lower-cased words and the words' four- to six-letter beginnings, hashed. The score is the
logistic function of  bias + sum of w_i x_i + (1 / sqrt(m)) * sum over pairs of <v_i, v_j>.  The first sum runs over the linear
terms, the second over the pairs of the m paired terms in the text, so that two words together, such as an insult
next to a mention of a group, carry weight that neither has alone.

Which terms are linear and which are paired is decided apart:

* a linear term's share of positive rows must be unlikely by chance; x is how far it is from chance;
* paired terms are the ends of pairs of words that explain what the linear model leaves over: a score test of each pair's product against
  the linear model's residuals. A word need not tell anything by itself, nor be frequent: every pair of words with at
  least `pair_rows` rows each is tested, but for those that cannot pass whatever they go with. The least z grows with the number of
  tested pairs, so that rare words that meet by chance do not pass.

The model is fitted on a sample of labelled rows bounded by `max_rows` (of the labelled ids, those with the smallest
hashes; default 20,000). Term counts are added up by Spark (one row per hashed term reaches the driver); then the sample's rows come
with the numbers of the `max_terms` selected terms at most, 4 bytes each, and are fitted by mini-batch AdaGrad on the driver. Pairs are
counted on Spark: the sample's words are broadcast (4 bytes for each distinct word of a row), a task counts the pairs of a block of words with
all others, and only the numbers of the words that pass come back.
Scoring runs over all rows and whole texts.

Defined results: a null or empty text scores by the bias alone, and a text of any length is read whole. Labels that are null or have no text are passed over; of
repeated labels for one id the largest counts. Without both classes among the labels every score is the smoothed
share of positive labels. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import Steps, text_of

WORD = re.compile(r"\w+")
DIMS = 1 << 18
PREFIXES = (4, 5, 6)
Row = np.ndarray  # sorted distinct term numbers


def terms_of_word(w: str, dims: int = DIMS) -> list[int]:
    parts = [w, *(f"{w[:n]}*{n}" for n in PREFIXES if len(w) > n)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % dims for p in parts]


class Terms:
    """Sorted distinct term numbers of a text, or those of them that `known` keeps; whole: of words only, not of beginnings.

    Words do not reach over white space, so the numbers of each distinct piece between blanks are found once and kept
    in a bounded cache.
    """

    def __init__(self, known: np.ndarray | None = None, dims: int = DIMS, limit: int = 300_000, whole: bool = False):
        self.known, self.dims, self.limit, self.cache, self.whole = known, dims, limit, {}, whole

    def piece(self, piece: str) -> tuple[int, ...]:
        words = WORD.findall(piece.lower())
        found = {terms_of_word(w, self.dims)[0] for w in words} if self.whole else {t for w in words for t in terms_of_word(w, self.dims)}
        return tuple(found if self.known is None else (t for t in found if self.known[t]))

    def __call__(self, text: str | None) -> Row:
        pieces = set((text or "").split())
        if len(self.cache) > self.limit:
            self.cache.clear()
        for p in pieces.difference(self.cache):
            self.cache[p] = self.piece(p)
        out: set[int] = set()
        for own in map(self.cache.__getitem__, pieces):
            if own:
                out.update(own)
        return np.array(sorted(out), dtype=np.int64)


def flat(rows: list[Row]) -> tuple[np.ndarray, np.ndarray]:
    """All terms of some rows, and the row each is of."""
    sizes = [len(r) for r in rows]
    return (np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)), np.repeat(np.arange(len(rows)), sizes)


class FactorizationMachine:
    """Logistic FM; rows are arrays of term numbers."""

    def __init__(
        self, dims: int = DIMS, factors: int = 8, rate: float = 0.2, l2: float = 1e-4, pair_l2: float = 1e-3, epochs: int = 12, min_rows: int = 3,
        least_z: float = 3.0, pair_rows: int = 8, pair_z: float = 4.5, max_terms: int = 16_384, seed: int = 7,
    ):
        self.dims, self.k, self.rate, self.l2, self.pair_l2, self.epochs, self.min_rows = dims, factors, rate, l2, pair_l2, epochs, min_rows
        self.least_z, self.pair_rows, self.pair_z, self.max_terms = least_z, pair_rows, pair_z, max_terms
        self.rng, self.bias, self.share = np.random.default_rng(seed), 0.0, 0.5
        #: number of a linear and of a paired term, -1 for others
        self.linear, self.paired = np.full(dims, -1, dtype=np.int32), np.full(dims, -1, dtype=np.int32)
        self.x, self.w, self.v = np.zeros(0), np.zeros(0), np.zeros((0, factors))

    def screen(self, n: np.ndarray, positive: np.ndarray, total: int, positives: float) -> None:
        """Linear terms, from each term's rows and positive rows."""
        self.share = (positives + 0.5) / (total + 1)
        self.bias = float(np.log(self.share / (1 - self.share)))
        if not 0 < positives < total:
            return
        z = np.abs(positive - n * self.share) / np.sqrt(n * self.share * (1 - self.share) + 1)
        kept = np.flatnonzero((n >= self.min_rows) & (z > self.least_z))
        kept = np.sort(kept[np.argsort(-z[kept], kind="stable")[: self.max_terms]])
        self.linear[kept] = np.arange(len(kept))
        self.x, self.w = np.minimum(z[kept] - self.least_z, 5.0) / 5.0, np.zeros(len(kept))

    def known(self) -> np.ndarray:
        """Terms that matter, by number."""
        return (self.linear >= 0) | (self.paired >= 0)

    def pair(self, ends: np.ndarray) -> None:
        """Makes terms paired ones; they get a linear weight too, so that a word's own share is not left to its pairs."""
        self.paired[ends] = np.arange(len(ends))
        new = ends[self.linear[ends] < 0]
        self.linear[new] = len(self.w) + np.arange(len(new))
        self.x, self.w = np.append(self.x, np.ones(len(new))), np.append(self.w, np.zeros(len(new)))
        self.v = self.rng.normal(0, 0.2, (len(ends), self.k))

    def train(self, rows: list[Row], y: np.ndarray) -> None:
        """rows need hold the known() terms only; begins from the present weights."""
        if len(self.x) or len(self.v):
            self._train(rows, y)

    def _train(self, rows: list[Row], y: np.ndarray) -> None:
        lin, par = ([at[r][at[r] >= 0] for r in rows] for at in (self.linear, self.paired))
        gw, gv, gb = np.full(self.w.shape, 1e-3), np.full(self.v.shape, 1e-3), 1.0
        for _ in range(self.epochs):
            order = self.rng.permutation(len(rows))
            for start in range(0, len(order), 128):
                part = order[start : start + 128]
                (i, of), (j, pof) = flat([lin[r] for r in part]), flat([par[r] for r in part])
                p, sums, scale = self._forward(i, of, j, pof, len(part))
                g = (p - y[part]) / len(part)
                gb += g.sum() ** 2
                self.bias -= self.rate * g.sum() / np.sqrt(gb)
                if len(i):
                    used, where = np.unique(i, return_inverse=True)
                    dw = np.bincount(where, weights=g[of] * self.x[i], minlength=len(used)) + self.l2 * self.w[used]
                    gw[used] += dw**2
                    self.w[used] -= self.rate * dw / np.sqrt(gw[used])
                if len(j):
                    used, where = np.unique(j, return_inverse=True)
                    each = (g * scale)[pof][:, None] * (sums[pof] - self.v[j])
                    dv = np.stack([np.bincount(where, weights=each[:, c], minlength=len(used)) for c in range(self.k)], axis=1) + self.pair_l2 * self.v[used]
                    gv[used] += dv**2
                    self.v[used] -= self.rate * dv / np.sqrt(gv[used])

    def _forward(self, i: np.ndarray, of: np.ndarray, j: np.ndarray, pof: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of n rows, the paired terms' vector sums, and the factor of the pair sum."""
        v = self.v[j]
        sums = np.stack([np.bincount(pof, weights=v[:, c], minlength=n) for c in range(self.k)], axis=1)
        squares = np.bincount(pof, weights=(v**2).sum(1), minlength=n)
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(pof, minlength=n)))
        z = self.bias + np.bincount(of, weights=self.w[i] * self.x[i], minlength=n) + scale * ((sums**2).sum(1) - squares) / 2
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), sums, scale

    def scores(self, rows: list[Row], at_once: int = 1 << 18) -> np.ndarray:
        """Rows are taken together up to about `at_once` terms."""
        out, start = [], 0
        ends = np.cumsum([len(r) for r in rows])
        while start < len(rows):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + at_once, side="right")))
            term, of = flat(rows[start:stop])
            lin, par = self.linear[term], self.paired[term]
            out.append(self._forward(lin[lin >= 0], of[lin >= 0], par[par >= 0], of[par >= 0], stop - start)[0])
            start = stop
        return np.concatenate(out) if out else np.zeros(0)

    def without_pairs(self) -> FactorizationMachine:
        """The same model with all factors at zero."""
        other = copy.copy(self)
        other.v = np.zeros_like(self.v)
        return other


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels no model may see: crc32 of the id as text, mod 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(found: DataFrame, column: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and positive rows of each number in a column of numbers (4 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, positive = np.zeros(dims, dtype=np.int64), np.zeros(dims)
        for batch in batches:
            for terms, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = np.frombuffer(terms, dtype="<u4")
                n[at] += 1
                positive[at] += y
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(positive[at])], names=["term", "n", "positive"])

    counts = found.select(column, "y").mapInArrow(run, "term bigint, n bigint, positive double").groupBy("term").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).toPandas()
    n, positive = np.zeros(dims, dtype=np.int64), np.zeros(dims)
    n[counts["term"]], positive[counts["term"]] = counts["n"], counts["positive"]
    return n, positive


def _collected(found: DataFrame, terms: np.ndarray, words: np.ndarray) -> tuple[list[Row], list[Row], np.ndarray]:
    """The sample's terms, words (each as far as its mask has them) and labels, in an order of their own, so that the same rows give the same model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [[(at := np.frombuffer(b, dtype="<u4"))[mask[at]].tobytes() for b in batch.column(c).to_pylist()] for c, mask in enumerate((terms, words))]
            yield pa.RecordBatch.from_arrays([*(pa.array(k, type=pa.binary()) for k in kept), batch.column(2)], names=["terms", "words", "y"])

    got = found.mapInArrow(run, "terms binary, words binary, y double").toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("terms", "words", "y")), strict=True))
    unpacked = ([np.frombuffer(r[c], dtype="<u4") for r in rows] for c in (0, 1))
    return *unpacked, np.array([r[2] for r in rows])


def pair_ends(spark: SparkSession, rows: list[Row], left: np.ndarray, spread: np.ndarray, dims: int, least_z: float, ridge: float = 1.0) -> np.ndarray:
    """Numbers of the words that are in a pair which passes the score test.

    rows: the words of each row; left and spread: what the linear model leaves of each row, and its variance. A pair's z is |sum of left| /
    sqrt(ridge + sum of spread) over the rows that hold both; the least is `least_z`, or sqrt(2 ln(pairs tested)) - 1 if that is more, which
    lets in some hundred pairs by chance at most.
    """
    flat_words, of = flat(rows)
    # no pair's sum is larger than the larger one of what its words' rows leave above and below zero: a word below the least z passes with none
    above, below = (np.bincount(flat_words, weights=np.maximum(sign * left, 0)[of], minlength=dims) for sign in (1, -1))
    able = np.flatnonzero(np.maximum(above, below) > least_z)
    if len(able) < 2:
        return able[:0]
    least = max(least_z, float(np.sqrt(2 * np.log(len(able) * (len(able) - 1) / 2 + 1))) - 1)
    at = np.full(dims, -1, dtype=np.int32)
    at[able] = np.arange(len(able))
    inside = at[flat_words] >= 0
    words, of = at[flat_words][inside], of[inside].astype(np.int32)
    sent = spark.sparkContext.broadcast((words, of, np.cumsum(np.bincount(of, minlength=len(rows))), left, spread, len(able), least, ridge))
    block = 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, of, ends, left, spread, n, least, ridge = sent.value
        for batch in batches:
            for lo in batch.column(0).to_pylist():
                here = np.flatnonzero((words >= lo) & (words < lo + block))
                here = here[np.argsort(words[here], kind="stable")]
                cuts = np.searchsorted(words[here], np.arange(lo, min(n, lo + block) + 1))
                passed = []
                for k in range(len(cuts) - 1):
                    holders = of[here[cuts[k] : cuts[k + 1]]]
                    starts = np.where(holders > 0, ends[holders - 1], 0)
                    sizes = ends[holders] - starts
                    others = words[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
                    s = np.bincount(others, weights=np.repeat(left[holders], sizes), minlength=n)
                    v = np.bincount(others, weights=np.repeat(spread[holders], sizes), minlength=n)
                    s[lo + k] = 0
                    if (s * s > least * least * (ridge + v)).any():
                        passed.append(lo + k)
                yield pa.RecordBatch.from_arrays([pa.array(passed, type=pa.int64())], names=["word"])

    starts = spark.range(0, len(able), block, numPartitions=max(1, -(-len(able) // (4 * block))))
    return able[np.sort(starts.mapInArrow(run, "word bigint").toArrow().column("word").to_numpy())]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, pairs: bool = True, **how) -> FactorizationMachine:
    """The model of a bounded sample of the labelled rows that are not held out."""
    spark, model = docs.sparkSession, FactorizationMachine(**how)
    steps, dims = Steps(spark), model.dims
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("double").alias("y"))
    sample_ids = F.broadcast(known.orderBy(F.xxhash64("__id"), "__id").limit(max_rows))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(sample_ids, F.col("id") == F.col("__id")).select("text", "y")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [Terms(dims=dims), Terms(dims=dims, whole=True)]
        for batch in batches:
            texts = batch.column(0).to_pylist()
            terms = [pa.array([of(t).astype("<u4").tobytes() for t in texts], type=pa.binary()) for of in kinds]
            yield pa.RecordBatch.from_arrays([*terms, batch.column(1)], names=["terms", "words", "y"])

    found = steps.stored(rows.mapInArrow(find, "terms binary, words binary, y double"), "toxic-terms")
    total = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("positives")).first()
    model.screen(*_counted(found, "terms", dims), total["n"], total["positives"])
    often = np.zeros(dims, dtype=bool)
    if pairs and 0 < total["positives"] < total["n"]:
        holders, _ = _counted(found, "words", dims)
        often = (holders >= model.pair_rows) & (total["n"] - holders >= model.pair_rows)
    rows, words, y = _collected(found, model.known(), often)
    model.train(rows, y)
    if often.any():
        p = model.scores(rows)
        ends = pair_ends(spark, words, y - p, p * (1 - p), dims, model.pair_z)
        if len(ends):
            model.pair(ends)
            rows, _, y = _collected(found, model.known(), np.zeros(dims, dtype=bool))
            model.train(rows, y)
    steps.drop(found)
    return model


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) per row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = sent.value
        of = Terms(fm.known(), fm.dims)
        for batch in batches:
            scores = fm.scores([of(t.as_py()) for t in batch.column(2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, type=pa.float64())], names=[id_col, "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
