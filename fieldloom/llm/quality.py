"""Quality classifier by importance resampling: keep what a model of good text explains, by Gumbel top-k.

Two generative bag-of-n-grams models over hashed word unigrams and bigrams are counted: the target model from
texts labelled as good, the raw model from all texts. A document's log weight is the log ratio of its probabilities under the two
per n-gram, times the n-grams it is taken to be evidence of: its own number, at most `evidence`. (N-grams of one text
are far from independent; with the sum over a long text weights differ by thousands of nats and nothing is left to draw.)
Gumbel noise drawn from a hash of the row is added and the k largest keys are taken, which samples k documents without
replacement in proportion to their weights.

k is the share of documents that are to stay times their number. Unless given, it is read off labelled good rows that the
target model has not seen (one in four): the cut at which a key of theirs is expected to be taken with probability `keep_good`
gives k as the number of keys that all documents together are expected to have above it. The k-th key is found by counting
keys by their leading bits in a fixed number of passes; nothing is sorted whole and no key is collected.

Defined results: a null or empty text has no n-grams and log weight 0. Labels without a document, null labels and
null ids are passed over; of repeated labels for one id the largest counts. Without labelled good texts all weights
are 0 and, unless a share is given, all rows stay. Rows that repeat share a key and so a decision; if keys are equal at the k-th, all of them
are taken. Empty table: empty result. Other columns, of whatever name, are kept by `select`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.columns import TwoGenerations, freed, groups, numbers
from fieldloom.llm.common import Steps, sha256, text_of, tidy, without

BUCKETS = 1 << 18
TOKEN = re.compile(r"\w+|[^\w\s]+")
ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Buckets:
    """Hashed buckets of texts' unigrams and bigrams.

    Tokens do not reach over white space, so the hashes of each distinct piece between blanks are found once and kept in
    a bounded cache.
    """

    def __init__(self, n: int = BUCKETS, limit: int = 150_000):
        self.n, self.cache = n, TwoGenerations(limit)

    def learn(self, pieces: list[str]) -> None:
        for p in pieces:
            self.cache.young[p] = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in TOKEN.findall(p)], dtype=np.uint32).tobytes()

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of all texts' n-grams, and the number of the text that each is of."""
        h, ends = numbers(texts, self.cache, self.learn, "<u4")
        h, of = h.astype(np.uint64), np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        inside = of[:-1] == of[1:]
        mixed = (h[:-1] * ONE + h[1:] * TWO)[inside]
        return (np.concatenate([h * ONE, mixed]) >> np.uint64(32)).astype(np.int64) % self.n, np.concatenate([of, of[:-1][inside]])


def _counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, target, raw): n-gram counts in the good texts of the sample and in all texts. Input: text, good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed()
        of, sums = Buckets(buckets), np.zeros((2, buckets), dtype=np.int64)
        for batch in batches:
            good, row = pc.equal(batch.column(1), 1).fill_null(False).to_numpy(zero_copy_only=False), 0
            for group in groups(batch.column(0).fill_null("")):
                grams, text = of(group)
                sums[1] += np.bincount(grams, minlength=buckets)
                sums[0] += np.bincount(grams[good[row + text]], minlength=buckets)
                row += len(group)
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["bucket", "target", "raw"])

    return texts.mapInArrow(run, "bucket bigint, target bigint, raw bigint").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def log_ratios(counted: DataFrame, buckets: int = BUCKETS, prior: float = 4.0) -> np.ndarray:
    """log p_target - log p_raw per bucket. One row per bucket reaches the driver.

    The target model's prior is the raw model, with a weight of `prior` n-grams a bucket, so that the ratio of
    what good texts tell nothing about stays near 1.
    """
    rows = counted.toPandas()
    target, raw = np.zeros(buckets), np.zeros(buckets)
    target[rows["bucket"]], raw[rows["bucket"]] = rows["target"], rows["raw"]
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + prior) / (raw * target.sum() / raw.sum() + prior))


def weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS, max_labels: int = 50_000, evidence: float = 16.0) -> DataFrame:
    """(id, digest, good, seen, log_weight, draw) per row of docs, written to the shared folder.

    good: the label, null where the row is not in the labelled sample; seen: the target model may know the row. The sample of labelled ids
    is bounded by `max_labels` (those with the smallest hashes); the raw model and the weights cover all rows.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("good"))
    sample_ids = known.orderBy(F.xxhash64("__id"), "__id").limit(max_labels)
    rows = docs.select(text_of(text_col).alias("text"), F.col(id_col).alias("id"), F.xxhash64(F.lit("gumbel"), id_col, text_col).alias("draw"))
    rows = rows.join(F.broadcast(sample_ids), F.col("id") == F.col("__id"), "left").drop("__id")
    rows = rows.withColumn("seen", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(4)) != 3)
    ratios = spark.sparkContext.broadcast(log_ratios(_counts(rows.select("text", F.when(F.col("seen"), F.col("good")).alias("good")), buckets), buckets))
    rows = rows.select("text", "id", sha256(F.col("text")).alias("digest"), "good", "seen", "draw")
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("log_weight", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed()
        of, ratio = Buckets(buckets), ratios.value
        for batch in batches:
            w = [np.zeros(0)]
            for group in groups(batch.column(0).fill_null("")):
                grams, text = of(group)
                sums, n = np.bincount(text, weights=ratio[grams], minlength=len(group)), np.bincount(text, minlength=len(group))
                w.append(sums * np.minimum(1.0, evidence / np.maximum(1, n)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(w))], names=schema.names)

    return Steps(spark).stored(rows.mapInArrow(run, schema), "weights")


def _kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest of the long column `key`, by counting 16 leading bits more in each of four passes."""
    low, high = -(1 << 63), (1 << 63) - 1
    for shift in (48, 32, 16, 0):
        bins = keys.filter(F.col("key").between(low, high)).groupBy(F.shiftright("key", shift).alias("bin")).count().toPandas().sort_values("bin", ascending=False)
        passed = bins["count"].cumsum()
        at = int((passed >= k).to_numpy().argmax())
        k -= int(passed.iloc[at] - bins["count"].iloc[at])
        low = int(bins["bin"].iloc[at]) << shift
        high = low + (1 << shift) - 1
    return low


def gumbel_key(log_weight: Column, draw: Column) -> Column:
    u = (F.shiftrightunsigned(draw, 11).cast("double") + 0.5) / float(1 << 53)
    return log_weight - F.log(-F.log(u))


def _expected(cut: float) -> Column:
    """Probability that a row's key is above the cut."""
    return 1 - F.exp(-F.exp(F.col("log_weight") - F.lit(cut)))


def size_of_sample(weighted: DataFrame, keep_good: float) -> int:
    """k by the labelled good rows that the model has not seen; the cut is found to 1/16 nat in two passes over them."""
    rows, cut = weighted.filter("good = 1 and not seen").select("log_weight"), -50.0
    for step, n in ((1.0, 61), (1 / 16, 16)):
        means = rows.agg(*[F.avg(_expected(cut + i * step)).alias(str(i)) for i in range(n)]).first()
        if means[0] is None:
            return weighted.count()
        cut += step * max((i for i, m in enumerate(means) if m >= keep_good), default=0)
    return round(weighted.agg(F.sum(_expected(cut))).first()[0] or 0.0)


def sample(weighted: DataFrame, share: float | None = None, keep_good: float = 0.998) -> DataFrame:
    """`weights` with gumbel_key and whether the row is taken, by Gumbel top-k."""
    rows = weighted.withColumn("gumbel_key", gumbel_key(F.col("log_weight"), F.col("draw")))
    # keys as longs in the same order, to 2^-20
    key = F.floor(F.col("gumbel_key") * float(1 << 20))
    k = size_of_sample(weighted, keep_good) if share is None else round(share * weighted.count())
    if k <= 0:
        return rows.withColumn("taken", F.lit(False))
    return rows.withColumn("taken", key >= F.lit(_kth_largest(rows.select(key.alias("key")), k)))


@tidy
def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", share: float | None = None, keep_good: float = 0.998, **how) -> DataFrame:
    """docs without the rows that are not sampled; the columns are kept as they are. Only texts of rows that may go are shuffled."""
    taken = sample(weights(docs, labels, id_col, text_col, label_col, **how), share, keep_good)
    return without(docs, Steps(docs.sparkSession).stored(taken.filter("not taken").select("id", "digest"), "rejected"), id_col, text_col)
