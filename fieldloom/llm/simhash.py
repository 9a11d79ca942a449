"""SimHash near-dedup by covering locality-sensitive hashing.

Each row gets a 64-bit fingerprint of its word shingles. Rows of one fingerprint are one class; only classes
are compared. For radius r there are 2^(r+1) - 1 tables. Bit i has a code c(i) in 1 .. 2^(r+1) - 1, and table v
keeps the bits for which the inner product of c(i) and v over GF(2) is odd. The codes of at most r differing
bits span less than the whole space, so some v is orthogonal to all of them: every pair within the radius has
the same key in that table, with certainty and not with some probability.

Inside a bucket no pairs are made. Two fingerprints differ in at most 2 bits if and only if some word is within
1 bit of both. Each fingerprint that shares a bucket emits itself and its one-bit neighbours over the bits
which its buckets leave open; those that meet on a word are linked to the smallest of them. At most 65
fingerprints can meet on one word, so this is linear in the number of classes, whatever the bucket sizes.

Defined results: a text without words (null, empty, white space) has fingerprint zero and is linked like any
other. Rows that repeat are in one class. A component's id is its smallest id; null ids are passed over, and a
component of null ids only has a null id. Other columns are ignored by `near_groups` and kept by `dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import ASCII_LOWER, Steps, join_groups, sha256, text_of, tidy, without
from fieldloom.llm.components import components

BITS = 64


def simhash(text: str | None, k: int = 3, seed: int = 42) -> int:
    """The fingerprint as an unsigned number: bit b is 1 if it is in over half of the shingles' hashes."""
    words = (text or "").encode().translate(ASCII_LOWER).split()  # bytes.split: \x20 and \x09-\x0D
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(k)), strict=False) if len(words) >= k else [words]
    return of_hashes(b"".join([xxhash.xxh64_digest(b" ".join(s), seed) for s in shingles]))


def of_hashes(digest: bytes) -> int:
    """The fingerprint of shingles' hashes, eight bytes each, the highest first."""
    rows = np.frombuffer(digest, dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(rows), 65536):
        ones += np.unpackbits(rows[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42, *more: Column) -> DataFrame:
    """(id, fp, more...): the signed 64-bit fingerprint per row of docs."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"), *more)
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t.as_py(), k, seed) for t in batch.column(0)), dtype=np.uint64, count=len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps.view(np.int64))], names=schema.names)

    return rows.mapInArrow(run, schema)


def covering_masks(radius: int) -> list[int]:
    """The tables' bit masks, as signed 64-bit numbers."""
    n = 2 ** (radius + 1) - 1
    masks = (sum(1 << bit for bit in range(BITS) if ((1 + bit % n) & v).bit_count() % 2) for v in range(1, n + 1))
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def meetings(classes: DataFrame) -> DataFrame:
    """(fp, word) of the distinct fingerprints that share a bucket: two differ in at most 2 bits if and only if they have a word in common."""
    masks = covering_masks(2)
    # inputs of joins are forced to be shuffled, so that nothing that grows with the data is broadcast at any size
    tables = classes.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])).alias("x")).select("fp", "x.*")
    shared = tables.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo != hi").select("t", "key")
    open_bits = F.element_at(F.array(*[F.lit(~m) for m in masks]), F.col("t") + 1)
    near = tables.join(shared.hint("merge"), ["t", "key"], "left_semi").groupBy("fp").agg(F.bit_or(open_bits).alias("open"))
    flips = F.expr("transform(filter(sequence(0, 63), b -> (shiftright(open, b) & 1L) = 1L), b -> fp ^ shiftleft(1L, b))")
    return near.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("word"))


def links(classes: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints at 2 or fewer differing bits that join whatever is linked."""
    words = meetings(classes)
    hubs = words.groupBy("word").agg(F.min("fp").alias("hub"), F.max("fp").alias("hi")).filter("hub != hi").select("word", "hub")
    return words.join(hubs.hint("merge"), "word").filter("fp != hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def grouped(rows: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(rows' columns, component_id): classes are (fp, rep, copies), roots (node, root) of the linked ones.

    Classes and roots may be deleted afterwards.
    """
    steps = Steps(rows.sparkSession)
    joined = steps.stored(classes.join(roots.hint("merge"), classes["fp"] == roots["node"], "left").select("fp", "rep", "copies", F.coalesce("root", "fp").alias("root")), "roots")
    ids = joined.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("size"))
    named = steps.stored(join_groups(joined, ids, ["root"], "size").select("fp", "component_id", "copies"), "named")
    steps.drop(joined)
    return join_groups(rows, named, ["fp"], "copies")


@tidy
def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of docs: id, fp, component_id."""
    rows = Steps(docs.sparkSession).stored(fingerprints(docs, id_col, text_col, k, seed), "fingerprints")
    return _components_of(rows).select(F.col("id").alias(id_col), "fp", "component_id")


def _components_of(rows: DataFrame) -> DataFrame:
    """rows (id, fp, ...) with component_id."""
    steps = Steps(rows.sparkSession)
    classes = steps.stored(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    out = grouped(rows, classes, components(links(classes)))
    steps.drop(classes)
    return out


@tidy
def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """docs with one document of each group: that with the smallest id. All columns are kept."""
    steps = Steps(docs.sparkSession)
    rows = steps.stored(fingerprints(docs, id_col, text_col, k, seed, sha256(text_of(text_col)).alias("digest")), "fingerprints")
    lost = _components_of(rows).filter(~F.col("id").eqNullSafe(F.col("component_id"))).select("id", "digest")
    lost = steps.stored(lost, "lost")
    steps.drop(rows)
    return without(docs, lost, id_col, text_col)
