"""What the training-data operators share: places that every executor sees, filters, joins and text helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table: A-Z to a-z, everything else as it is (UTF-8 bytes from 0x80 on included).
ASCII_LOWER = bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests) is a temporary folder set; on a cluster
    executors would write to disks of their own, so there a session without the setting is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        root = "file://" + tempfile.mkdtemp(prefix="fieldloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def is_local(master: str) -> bool:
    """Driver and executors are one process; local-cluster is not."""
    return master == "local" or master.startswith("local[")


#: Paths handed out while operators marked `tidy` run, by depth.
_MADE: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = f"{shared_root(spark)}/fieldloom/{name}-{uuid.uuid4().hex}"
    for made in _MADE[-1:]:
        made.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it is on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    for made in _MADE:
        if path in made:
            made.remove(path)


def read_by(*tables: DataFrame) -> set[str]:
    """Names of the scratch folders that the tables' plans read."""
    return {name for t in tables for file in t.inputFiles() for name in file.split("/fieldloom/")[1:] for name in [name.split("/")[0]]}


def tidy(operator: Callable) -> Callable:
    """An operator that deletes the steps it has written, but for those that its result still reads; if it fails, all of them."""

    @wraps(operator)
    def run(*args, **how):
        _MADE.append([])
        out, done = None, False
        try:
            out = operator(*args, **how)
            done = True
        finally:
            made = _MADE.pop()
            left = read_by(out) if done and isinstance(out, DataFrame) else set()
            for path in made:
                if path.rsplit("/", 1)[1] not in left:
                    delete(SparkSession.active(), path)
                elif _MADE:
                    _MADE[-1].append(path)
        return out

    return run


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes the steps that the tables read, once all that depends on them has been written."""
    for name in read_by(*tables):
        delete(spark, f"{shared_root(spark)}/fieldloom/{name}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back.

    Cuts the lineage durably: a lost executor costs tasks, not finished steps, and row ids or
    random draws made before the cut keep their values.
    """
    return Steps(df.sparkSession).stored(df, name)


class Steps:
    """Written tables of one operator: those that its result does not read are deleted once a later one is committed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    @property
    def tables(self) -> list[DataFrame]:
        """What is stored and not deleted, in order."""
        return [t for t, _ in self.paths.values()]

    def drop(self, *tables: DataFrame) -> None:
        """Deletes stored tables whose last reader has been written."""
        for t in tables:
            delete(self.spark, self.paths.pop(id(t))[1])


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes to clash with no column (whatever its case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def text_of(name: str = "text") -> Column:
    """The text column, null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z only; other letters keep their case."""
    return F.translate(c, UPPER, LOWER)


#: 64-bit words of a filter at most: 2^22 hold about 67 million keys well; beyond, more rows pass that need not.
MOST_WORDS = 1 << 22


class KeyFilter:
    """A Bloom filter of 64-bit hashes, blocked by 64-bit words: a table (word, bits) that is broadcast.

    A key sets four bits of one word. The number of words follows the number of keys up to `MOST_WORDS`, so what is
    broadcast is bounded whatever the data; with more keys more rows pass by chance. No key of the filter is ever kept back, and whoever
    asks must do without the filter's help on the rows that pass.
    """

    def __init__(self, keys: DataFrame, hashed: str, count: int):
        self.words = 1 << max(6, min(MOST_WORDS.bit_length() - 1, (count // 4).bit_length()))
        own = keys.select(self._word(F.col(hashed)).alias("__word"), self._mask(F.col(hashed)).alias("__mask"))
        self.table = own.groupBy("__word").agg(F.bit_or("__mask").alias("__bits"))

    def _word(self, h: Column) -> Column:
        return F.shiftrightunsigned(h, 24).bitwiseAND(F.lit(self.words - 1))

    @staticmethod
    def _mask(h: Column) -> Column:
        bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(h, at).bitwiseAND(F.lit(63)).cast("int"))
        return bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12)).bitwiseOR(bit(18))

    def split(self, rows: DataFrame, hashed: str, maybe: str) -> DataFrame:
        """rows with a last column `maybe`: false only if the key is surely not in the filter."""
        word, bits = fresh([*rows.columns, maybe], "__word", "__bits")
        out = rows.withColumn(word, self._word(F.col(hashed))).join(F.broadcast(self.table.toDF(word, bits)), word, "left")
        mask = self._mask(F.col(hashed))
        return out.withColumn(maybe, F.coalesce(F.col(bits).bitwiseAND(mask) == mask, F.lit(False))).drop(word, bits)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def without(docs: DataFrame, lost: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """docs less the rows whose id and text digest are in lost (id, digest), a stored table with a row for each such row.

    Texts are shuffled only of rows that pass a filter of the lost keys; the others stay where they are. Keys that many
    rows share are looked up by broadcast (see `join_groups`).
    """
    d, h, maybe, i = fresh(docs.columns, "__digest", "__key", "__maybe", "__lost")
    keys = lost.groupBy(F.col("id").alias(i), F.col("digest").alias(d)).agg(F.count("*").alias("__rows")).withColumn(h, F.xxhash64(i, d))
    n = lost.count()
    rows = docs.withColumn(d, digest(text_of(text_col))).withColumn(h, F.xxhash64(id_col, d))
    rows = KeyFilter(lost.select(F.xxhash64("id", "digest").alias("h")), "h", n).split(rows, h, maybe)
    least = n / int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot, few = (keys.filter(cond).withColumnsRenamed({d: f"{d}_lost", h: f"{h}_lost"}) for cond in (F.col("__rows") > least, F.col("__rows") <= least))
    same = (F.col(h) == F.col(f"{h}_lost")) & (F.col(d) == F.col(f"{d}_lost")) & F.col(id_col).eqNullSafe(F.col(i))
    left = rows.filter(maybe).join(F.broadcast(hot), same, "left_anti").join(few.hint("merge"), same, "left_anti")
    return rows.filter(~F.col(maybe)).unionByName(left).select(*docs.columns)


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, parts: int | None = None, total: int | None = None) -> DataFrame:
    """rows joined with groups, which has one row per key and, in `size`, how many rows have that key; size is dropped.

    Keys that hold more than one in `parts` of all rows (more than an even shuffle partition, unless given) are fewer than
    `parts`, whatever the data, so they are broadcast and their rows stay where they are. Rows of the other keys are
    shuffled, at any size of groups; none of these keys is hot. Keys are not null. total: the sum of sizes, or more, if known.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = (total if total is not None else groups.agg(F.sum(size)).first()[0] or 0) / parts
    hot, few = groups.filter(F.col(size) > least).drop(size), groups.filter(F.col(size) <= least).drop(size)
    others = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(others.join(few.hint("merge"), on))
