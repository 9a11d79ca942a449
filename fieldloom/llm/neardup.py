"""Near-dedup of texts by the Jaccard similarity of their word shingles: the corpus pipeline's form of the SimHash operator.

Two texts are near copies if their sets of five-word shingles have similarity 0.8 or more; of each component one stays.
Candidates come from SimHash fingerprints of these sets first: all pairs at 2 or fewer of 64 differing bits, found through covering masks as in `simhash`,
with certainty. A radius cannot reach all near copies: at similarity 0.8 fingerprints differ in about 10 bits, and covering masks
for radius 10 are 2,047 tables. So MinHash bands add the candidates that fingerprints leave out; classes, components and removal are those of `simhash`.

The bands' candidates are the texts that share a band of a MinHash signature: 120 bands of 12 values, so that two texts of
similarity 0.8 meet with probability 1 - (1 - 0.8^12)^120 = 0.9998, of 0.85 with 0.99999999, but of 0.5 with 0.03 only: texts that are alike
without being near copies would otherwise meet in one bucket in great numbers. Every link is then confirmed on
the whole shingle sets (of 64-bit hashes); fingerprints and signatures decide nothing. A word that is within one bit of two fingerprints is a bucket like a band.

Rows of one shingle set are one class; only classes are compared. The smallest class of a bucket is its hub. First every class is compared with
the smallest of its hubs, then with those of its other hubs that are still in another component. What is linked by then needs no pair. A class that is in another
component than the hub is compared with the others of its bucket that are in another component than itself, unless the sizes, the triangle inequality of the Jaccard distance, or a sketch of 1,472 one-bit
MinHash values rule the pair out: the sketch lets through all that differ in at most five standard deviations more bits than pairs at the bound do on
average, so that of pairs at exactly 0.8 about one in a million is passed over, and fewer of more similar ones. A pair that shares several buckets is compared once.

Only texts that stand for a class which shares a bucket are shuffled, once; the others stay where they are.

Defined results: null and empty texts and those of white space have no words and are one class, like any other; a text of fewer than five
words is one shingle. Repeated rows are of one class, and each counts. The smallest id of a group stays, with all its
rows of that id and text; null ids are passed over unless a group has no other. Texts of any length are taken whole. Other columns are kept, whatever
their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.columns import freed
from fieldloom.llm.common import ASCII_LOWER, KeyFilter, Steps, join_groups, sha256, text_of, tidy, without
from fieldloom.llm.components import components
from fieldloom.llm.simhash import grouped, meetings, of_hashes

BANDS, ROWS = 120, 12
#: an odd number by which the words' hashes of a shingle are told apart by place, and one that mixes the sums
STEP, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


class Shingles:
    """Sets of k-word shingles as sorted 64-bit hashes, at least one; hashes of words are kept in a bounded cache."""

    def __init__(self, k: int = 5, limit: int = 150_000):
        self.k, self.limit, self.cache = k, limit, {}
        self.times = [np.uint64(pow(STEP, k - 1 - i, 1 << 64)) for i in range(k)]

    def __call__(self, text: str | None) -> np.ndarray:
        words, cache, k = (text or "").encode().translate(ASCII_LOWER).split(), self.cache, self.k
        if len(cache) > self.limit:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh64_digest(w)
        h = np.frombuffer(b"".join(map(cache.__getitem__, words)), dtype=np.uint64)
        if len(h) < k:
            return np.frombuffer(xxhash.xxh64_digest(h.tobytes(), len(h) + 1), dtype=np.uint64)
        n = len(h) - k + 1
        sums = h[:n] * self.times[0]
        for i in range(1, k):
            sums += h[i : i + n] * self.times[i]
        sums ^= sums >> np.uint64(32)
        sums *= MIX
        sums ^= sums >> np.uint64(29)
        sums.sort()
        return sums[np.concatenate([[True], sums[1:] != sums[:-1]])]


class Signature:
    """A signed 64-bit key per band of a set's MinHash signature."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 42):
        draws, self.bands, self.rows = np.random.default_rng(seed), bands, rows
        self.times = (draws.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1))[:, None]
        self.plus = draws.integers(0, 1 << 32, bands * rows, dtype=np.uint32)[:, None]

    def least(self, s: np.ndarray) -> np.ndarray:
        """The MinHash values."""
        short = (s >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.times), 0xFFFFFFFF, dtype=np.uint32)
        step = max(1, (1 << 18) // len(least))
        for at in range(0, len(short), step):
            np.minimum(least, (short[at : at + step] * self.times + self.plus).min(axis=1), out=least)
        return least

    def __call__(self, s: np.ndarray) -> np.ndarray:
        raw, rows = self.least(s).tobytes(), self.rows
        return np.array([xxhash.xxh64_intdigest(raw[4 * rows * i : 4 * rows * (i + 1)], i) for i in range(self.bands)], dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """(id, digest, fp, sim, bands) per row of docs: fp is a 64-bit hash of the shingle set, sim its SimHash fingerprint."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"), sha256(text_of(text_col)).alias("digest"))
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("fp", T.LongType()), T.StructField("sim", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed()
        of, bands = Shingles(k), Signature()
        for batch in batches:
            (fps, sims), keys = np.zeros((2, len(batch)), dtype=np.uint64), np.zeros((len(batch), BANDS), dtype=np.int64)
            for i, t in enumerate(batch.column(0)):
                s = of(t.as_py())
                fps[i], sims[i], keys[i] = xxhash.xxh3_64_intdigest(s.tobytes()), of_hashes(s.byteswap().tobytes()), bands(s)
            at = pa.array(np.arange(len(batch) + 1) * BANDS, type=pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps.view(np.int64)), pa.array(sims.view(np.int64)), pa.ListArray.from_arrays(at, pa.array(keys.ravel()))], names=schema.names)

    return rows.mapInArrow(run, schema)


#: Bytes of shingle sets that a task hands on together.
TOGETHER = 1 << 22


def _shingled(texts: DataFrame, k: int) -> DataFrame:
    """(fp, n, s) of (fp, text): size and hashes of the set; one row per fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed()
        of = Shingles(k)
        for batch in batches:
            sets, start, size = [], 0, 0
            for row, t in enumerate(batch.column(1), 1):
                sets.append(of(t.as_py()).tobytes())
                size += len(sets[-1])
                if size > TOGETHER or row == len(batch):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, row - start), pa.array([len(s) // 8 for s in sets], pa.int64()), pa.array(sets, pa.binary())], names=["fp", "n", "s"])
                    sets, start, size = [], row, 0

    return texts.select("fp", "text").mapInArrow(run, "fp bigint, n bigint, s binary")


def _measured(pairs: DataFrame, sets: DataFrame, steps: Steps) -> DataFrame:
    """(a, b, common, total) of distinct pairs (a, b): sizes of the intersection and the union; a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed()
        for batch in batches:
            common, total = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            for i, sides in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                p, q = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in sides)
                common[i] = len(np.intersect1d(p, q, assume_unique=True))
                total[i] = len(p) + len(q) - common[i]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common), pa.array(total)], names=["a", "b", "common", "total"])

    def of(side: str, name: str) -> DataFrame:
        sizes = pairs.groupBy(side).agg(F.count("*").alias("__size"))
        return sizes.join(sets.select(F.col("fp").alias(side), F.col("s").alias(name)).hint("merge"), side)

    n = pairs.count()
    # pairs are dealt by hot b before any set is joined to them, so that each is joined once
    y, least = of("b", "y"), n / int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot, few = y.filter(F.col("__size") > least).drop("__size"), y.filter(F.col("__size") <= least).drop("__size")
    x = lambda how: join_groups(pairs.join(F.broadcast(hot.select("b")), "b", how), of("a", "x"), ["a"], "__size", total=n)
    met = x("left_semi").join(F.broadcast(hot), "b").unionByName(x("left_anti").join(few.hint("merge"), "b"))
    return steps.stored(met.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, common bigint, total bigint"), "measured")


#: Words of a one-bit MinHash sketch.
SKETCH = 23


def _sketched(sets: DataFrame) -> DataFrame:
    """(fp, k0, k1, ...): one bit of each of 64 * SKETCH MinHash values of (fp, s)."""
    names = [f"k{w}" for w in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed()
        of = Signature(64 * SKETCH, 1, 43)
        for batch in batches:
            bits = np.stack([of.least(np.frombuffer(s.as_buffer(), dtype=np.uint64)) & np.uint32(1) for s in batch.column(1)]) if len(batch) else np.zeros((0, 64 * SKETCH))
            words = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(words[:, w])) for w in range(SKETCH))], names=["fp", *names])

    return sets.select("fp", "s").mapInArrow(run, f"fp bigint, {', '.join(f'{n} bigint' for n in names)}")


def most_apart(least: float) -> int:
    """Differing sketch bits up to which a pair is compared: five standard deviations above what pairs of similarity `least` have."""
    p, n = (1 - least) / 2, 64 * SKETCH
    return int(n * p + 5 * (n * p * (1 - p)) ** 0.5)


def _keys(classes: DataFrame, steps: Steps) -> DataFrame:
    """(fp, key): the buckets of each class of classes (fp, sim, bands): the words near its fingerprint, in a written table, and its bands."""
    words = meetings(classes.select(F.col("sim").alias("fp")).distinct()).filter("word != fp").groupBy("fp").agg(F.collect_list("word").alias("words"))
    sizes = classes.groupBy("sim").agg(F.count("*").alias("__size"))
    near = steps.stored(sizes.join(words.withColumnRenamed("fp", "sim").hint("merge"), "sim"), "near-words")
    others = join_groups(classes.select("fp", "sim"), near, ["sim"], "__size").select("fp", F.explode("words").alias("word"))
    # classes of one fingerprint meet on it, whether or not others are near
    met = classes.select("fp", F.col("sim").alias("word")).unionByName(others)
    met = steps.stored(met.select("fp", F.xxhash64(F.lit("simhash"), "word").alias("key")), "words")
    steps.drop(near)
    return met.unionByName(classes.select("fp", F.explode("bands").alias("key")))


def _shared(keys: DataFrame, steps: Steps) -> DataFrame:
    """(key, fp, hub): the rows of keys (fp, key) that share their key, with the smallest fp of that key; a written table."""
    hubs = steps.stored(keys.groupBy("key").agg(F.min("fp").alias("hub"), F.max("fp").alias("hi"), F.count("*").alias("__size")).filter("hub != hi").drop("hi"), "hubs")
    shared = KeyFilter(hubs.select("key"), "key", hubs.count())
    inside = steps.stored(join_groups(shared.split(keys, "key", "maybe").filter("maybe").drop("maybe"), hubs, ["key"], "__size"), "buckets")
    steps.drop(hubs)
    return inside


def _starred(inside: DataFrame, sets: DataFrame, alike: Column, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """The links between classes and their hubs, and what stays open; written tables.

    inside: (key, fp, hub). Open: (key, fp, hub, d, near, n, root) of the buckets that hold more than one component, but for their hubs; d is null
    where nothing had to be measured, which only near classes have.
    """
    nearest = inside.filter("fp != hub").groupBy(F.col("fp").alias("a")).agg(F.min("hub").alias("b"))
    least = _measured(steps.stored(nearest, "pairs"), sets, steps)
    found = steps.stored(least.filter(alike).select("a", "b"), "linked")
    # other hubs only where they are still in another component: the rest could add nothing to what is joined
    open_ = _open(inside, components(found), steps).filter("not near").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    more = _measured(steps.stored(open_.join(least.hint("merge"), ["a", "b"], "left_anti"), "pairs"), sets, steps)
    linked = steps.stored(found.unionByName(more.filter(alike).select("a", "b")), "linked")
    # how far each class of a bucket is from the hub, where that was measured, and its size
    d = least.unionByName(more).select(F.col("a").alias("fp"), F.col("b").alias("hub"), (1 - F.col("common") / F.col("total")).alias("d"))
    apart = _open(inside, components(linked), steps).join(d.hint("merge"), ["fp", "hub"], "left")
    mixed = steps.stored(apart.join(sets.select("fp", "n").hint("merge"), "fp"), "mixed")
    steps.drop(found, least, more)
    return linked, mixed


def _open(inside: DataFrame, roots: DataFrame, steps: Steps) -> DataFrame:
    """(key, fp, hub, root, near) of all but the hubs in the buckets that hold more than one component; near: in the hub's component. A written table.

    roots: (node, root); a class without links is a component of its own.
    """
    rows = inside.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rows = steps.stored(rows, "rooted")
    many = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by("root", "fp").alias("hub_root"), F.count("*").alias("__size")).filter("lo != hi")
    out = join_groups(rows, many.drop("lo", "hi"), ["key"], "__size").filter("fp != hub").withColumn("near", F.expr("root = hub_root")).drop("hub_root")
    out = steps.stored(out, "apart")
    steps.drop(rows)
    return out


@tidy
def links(classes: DataFrame, texts_of, k: int = 5, least: float = 0.8) -> DataFrame:
    """(a, b): links at similarity `least` or more that join whatever is linked; a written table.

    classes: (fp, sim, bands). texts_of: gives (fp, text), one row per fp, for a written table of fps.
    """
    steps = Steps(classes.sparkSession)
    alike, far = F.expr(f"common >= {least}D * total"), 1 - least + 1e-9
    inside = _shared(_keys(classes, steps), steps)
    met = steps.stored(inside.select("fp").distinct(), "met")
    sets = steps.stored(_shingled(texts_of(met), k), "shingles")
    first, mixed = _starred(inside, sets, alike, steps)
    steps.drop(inside, met)
    # what is left is compared by sketches first, and each pair in the smallest band only that it shares, or in its words if it shares none
    some = mixed.select("fp").distinct()
    sketches = steps.stored(_sketched(sets.join(some.hint("merge"), "fp", "left_semi")).join(classes.select("fp", "bands").hint("merge"), "fp"), "sketches")
    known = mixed.join(sketches.hint("merge"), "fp")
    x, y = (known.select("key", *[F.col(c).alias(f"{c}_{side}") for c in known.columns if c != "key"]) for side in "xy")
    apart = " + ".join(f"bit_count(k{w}_x ^ k{w}_y)" for w in range(SKETCH))
    possible = f"root_x != root_y and not near_x and (near_y or fp_x < fp_y) and coalesce(abs(d_x - d_y) <= {far}D, true) and least(n_x, n_y) >= {least}D * greatest(n_x, n_y)"
    possible += f" and {apart} <= {most_apart(least)} and coalesce(array_min(array_intersect(bands_x, bands_y)) = key, true)"
    more = steps.stored(x.join(y.hint("merge"), "key").filter(possible).select(F.least("fp_x", "fp_y").alias("a"), F.greatest("fp_x", "fp_y").alias("b")).distinct(), "more")
    rest = _measured(more, sets, steps)
    out = steps.stored(first.unionByName(rest.filter(alike).select("a", "b")), "near-links")
    steps.drop(mixed, more, rest, first, sets, sketches)
    return out


@tidy
def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one document of each group: that with the smallest id. All columns are kept."""
    steps = Steps(docs.sparkSession)
    rows = steps.stored(signatures(docs, id_col, text_col, k), "signed")
    # a class is represented by one of its texts: any of them has the same shingles
    classes = steps.stored(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("sim").alias("sim"), F.first("bands").alias("bands"), F.min("digest").alias("digest")), "classes")

    def texts_of(met: DataFrame) -> DataFrame:
        wanted = classes.select("fp", "digest").join(met.hint("merge"), "fp", "left_semi").withColumn("h", F.xxhash64("digest"))
        texts = docs.select(text_of(text_col).alias("text"), sha256(text_of(text_col)).alias("digest")).withColumn("h", F.xxhash64("digest"))
        some = KeyFilter(wanted, "h", met.count()).split(texts, "h", "maybe").filter("maybe").groupBy("digest").agg(F.first("text").alias("text"))
        return some.join(wanted.hint("merge"), "digest").select("fp", "text")

    near = links(classes.select("fp", "sim", "bands"), texts_of, k, least)
    found = grouped(rows.select("id", "digest", "fp"), classes.select("fp", "rep", "copies"), components(near))
    lost = steps.stored(found.filter(~F.col("id").eqNullSafe(F.col("component_id"))).select("id", "digest"), "lost")
    steps.drop(rows, classes)
    return without(docs, lost, id_col, text_col)
