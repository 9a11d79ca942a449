"""Exact dedup with a log-structured merge index of digests, DataFrame operations only.

* A memtable is one input split. `flush` hashes it, sorts its (digest, id) entries and writes them as
  a run: a Parquet file sorted by digest, with row-group statistics and a Bloom filter on the digest.
  No shuffle, no text is copied.
* `compact` merges the new runs into the level below, in which a digest has one entry: the identifier that stays
  (smallest or largest, as asked) and the number of copies. Copies meet in the map-side combine first, so a text that makes
  up a third of all rows sends one entry per task. A filter of the new runs' digests is asked for each entry of the level: entries
  that are surely not met go on to the next level as they are, only the others are shuffled and merged. The level merged from is deleted.
* Digests with several copies are hits. A filter of the hits is asked for each row: rows that are surely no hit stay
  as they are and are joined with nothing.
* `verify` compares the bytes of the rest: among the texts of a digest the smallest and the largest must be the
  same string. Only such texts are shuffled, and equal ones of one task as one. Digests for which they differ are grouped by digest and text instead.
* Digests that hold a large share of the rows (`join_groups`) are looked up by broadcast, so that their rows are
  reduced where they are read and no task gets them all.

The filters are `KeyFilter`s, tables of bounded size that Spark makes and broadcasts; what they let through by chance the joins
and comparisons sort out. The plan is the same at every size.

Defined results: a null text is the empty text. Rows that repeat an id and a text are one document, so they
get one decision together. Null ids lose against any id; if a group has null ids only, they stay. An empty
table gives an empty result. Other columns, of whatever name, are ignored by `groups` and kept by `dedup`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import KeyFilter, Steps, delete, join_groups, scratch, sha256, text_of, tidy, without

BLOOM = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true", "compression": "zstd"}


class DigestIndex:
    """The index: sorted runs in level 0, merged entries (digest, keep_id, copies) in the level below."""

    def __init__(self, spark, path: str | None = None, keep: str = "max", digest: Callable[[Column], Column] = sha256):
        if keep not in ("min", "max"):
            raise ValueError("keep is 'min' or 'max'")
        self.spark, self.path, self.digest = spark, path or scratch(spark, "digests"), digest
        self.best = F.max if keep == "max" else F.min
        self.flushed = self.compacted = 0
        self.merged: DataFrame | None = None

    def entries(self, docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
        return docs.select(F.col(id_col).alias("id"), self.digest(text_of(text_col)).alias("digest"), *more)

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Writes the rows of docs as sorted runs."""
        run = self.entries(docs, id_col, text_col).sortWithinPartitions("digest", "id")
        run.write.options(**BLOOM).parquet(f"{self.path}/level0/flush={self.flushed}")
        self.flushed += 1

    def runs(self, first: int = 0) -> DataFrame:
        """Entries of the flushes from `first` on."""
        parts = [self.spark.read.parquet(f"{self.path}/level0/flush={k}") for k in range(first, self.flushed)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def compact(self) -> DataFrame:
        """Merges the runs flushed since the last compaction; one entry per digest: (digest, keep_id, copies)."""
        if self.compacted == self.flushed:
            return self.merged
        new = self.runs(self.compacted).groupBy("digest").agg(self.best("id").alias("keep_id"), F.count("*").alias("copies"))
        old, level = self.merged, f"{self.path}/level1/{self.flushed}"
        if old is not None:
            digests = self.runs(self.compacted).select(F.xxhash64("digest").alias("h"))
            asked = KeyFilter(digests, "h", digests.count()).split(old.withColumn("h", F.xxhash64("digest")), "h", "met")
            both = asked.filter("met").select(*old.columns).unionByName(new)
            new = both.groupBy("digest").agg(self.best("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))
            new = new.unionByName(asked.filter("not met").select(*old.columns))
        new.sortWithinPartitions("digest").write.options(**BLOOM).parquet(level)
        if old is not None:
            delete(self.spark, f"{self.path}/level1/{self.compacted}")
        self.compacted, self.merged = self.flushed, self.spark.read.parquet(level)
        return self.merged

    def hit_filter(self) -> KeyFilter:
        """Filter of the digests with several copies."""
        hits = self.compact().filter("copies > 1").select(F.xxhash64("digest").alias("h"))
        return KeyFilter(hits, "h", hits.count())

    def verify(self, hits: KeyFilter, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Digests under which different texts meet (none, unless the digest has collided)."""
        texts = self.entries(docs, id_col, text_col, text_of(text_col).alias("t")).withColumn("h", F.xxhash64("digest"))
        seen = hits.split(texts, "h", "maybe").filter("maybe").groupBy("digest").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        return seen.filter("lo != hi").select("digest")


def _resolved(docs: DataFrame, id_col: str, text_col: str, keep: str, digest) -> DataFrame:
    """(id, digest, keep_id, copies) per row of docs."""
    index, steps = DigestIndex(docs.sparkSession, keep=keep, digest=digest), Steps(docs.sparkSession)
    index.flush(docs, id_col, text_col)
    merged, hits = index.compact(), index.hit_filter()
    collided = steps.stored(index.verify(hits, docs, id_col, text_col), "collided")
    rows, known = (hits.split(t.withColumn("h", F.xxhash64("digest")), "h", "maybe") for t in (index.runs(), merged))
    cols = ["id", "digest", "keep_id", "copies"]
    alone = rows.filter("not maybe").select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("copies"))
    groups = known.filter("maybe").select("digest", "keep_id", "copies", F.col("copies").alias("size"))
    if collided.isEmpty():
        steps.drop(collided)
        return alone.unionByName(join_groups(rows.filter("maybe").select("id", "digest"), groups, ["digest"], "size").select(cols))
    clear = join_groups(rows.filter("maybe").select("id", "digest"), groups.join(collided, "digest", "left_anti"), ["digest"], "size")
    texts = index.entries(docs, id_col, text_col, text_of(text_col).alias("t")).join(collided, "digest", "left_semi")
    by_text = texts.groupBy("digest", "t").agg(index.best("id").alias("keep_id"), F.count("*").alias("copies"), F.count("*").alias("size"))
    apart = join_groups(texts, by_text, ["digest", "t"], "size")
    return alone.unionByName(clear.select(cols)).unionByName(apart.select(cols))


@tidy
def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", digest=sha256) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, digest."""
    found = _resolved(docs, id_col, text_col, keep, digest)
    return found.select(F.col("id").alias(id_col), "keep_id", F.col("copies").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


@tidy
def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", digest=sha256) -> DataFrame:
    """docs without the rows that do not stay; all columns are kept as they are.

    Only texts of rows that may be lost are shuffled, by id and digest, so a large group is no hot key. Rows of one id whose
    different texts have one digest (never with SHA-256) are taken for repeats here.
    """
    found = _resolved(docs, id_col, text_col, keep, digest)
    lost = found.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "digest")
    return without(docs, Steps(docs.sparkSession).stored(lost, "lost"), id_col, text_col, digest)
