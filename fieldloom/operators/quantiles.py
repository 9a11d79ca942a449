"""Exact quantiles without a task that holds all values.

A double becomes a 64-bit number of the same order. Each pass counts, in every task, the values' next sixteen leading bits within
what the passes before have left of each asked rank; Spark adds the counts, and the bits of each rank's value follow from
them. After four passes the values at the asked ranks are known, whatever the distribution and however many are equal. A pass sends
at most 65,536 counts per rank to the driver, commonly some hundred.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, PASSES = 16, 4
_SIGN = np.uint64(1 << 63)


def ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; zeros are equal, NaN is the greatest."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def back(n: int) -> float:
    bits = np.array([n], dtype=np.uint64)
    return float(np.where(bits & _SIGN, bits & ~_SIGN, ~bits).view(np.float64)[0])


def _counted(values: DataFrame, prefixes: dict, done: int) -> dict:
    """{(group, prefix): {next bits: count}} of the values that begin with one of the group's prefixes of `done` bits."""
    sent = values.sparkSession.sparkContext.broadcast(prefixes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("g").to_pylist()
            code = {g: c for c, g in enumerate(dict.fromkeys(groups))}
            of, keys = np.array([code[g] for g in groups]), ordered(batch.column("v").to_numpy(zero_copy_only=False))
            for g, c in code.items():
                own = keys[of == c]
                if done:
                    own = own[np.isin(own >> np.uint64(64 - done), np.array(sorted(sent.value.get(g, ())), dtype=np.uint64))]
                found, n = np.unique(own >> np.uint64(64 - done - BITS), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)], names=["g", "p", "n"])

    got = values.mapInArrow(run, "g string, p bigint, n bigint").groupBy("g", "p").agg(F.sum("n").alias("n")).collect()
    out: dict = {}
    for r in got:
        p = int(r.p) % (1 << 64)
        out.setdefault((r.g, p >> BITS), {})[p] = r.n
    return out


def ranked_values(values: DataFrame, wanted: dict, first: dict | None = None) -> dict:
    """{(group, rank): value}: the values at ranks from 0 of (g, v); wanted: {group: ranks}; first: the counts of pass one, if known."""
    # per group and rank: the bits so far, and how many values of the same bits stand before it
    state = {(g, r): (0, r) for g, ranks in wanted.items() for r in ranks}
    for step in range(PASSES):
        prefixes: dict = {}
        for (g, _), (prefix, _) in state.items():
            prefixes.setdefault(g, set()).add(prefix)
        counts = first if step == 0 and first is not None else _counted(values, prefixes, step * BITS)
        for key, (prefix, before) in state.items():
            for p, n in sorted(counts[key[0], prefix].items()):
                if before < n:
                    state[key] = (p, before)
                    break
                before -= n
    return {key: back(prefix) for key, (prefix, _) in state.items()}


def quantiles(df: DataFrame, c: str, shares: Sequence[float], by: str | None = None) -> dict:
    """{group: [value per share]}: linear interpolation between neighbouring ranks, as numpy's; nulls are left out.

    by: a column of few groups, as strings in the result; None is the key without it. A group without values has no entry.
    """
    group = F.lit("") if by is None else F.coalesce(F.col(by).cast("string"), F.lit("null"))
    values = df.filter(F.col(c).isNotNull()).select(group.alias("g"), F.col(c).cast("double").alias("v"))
    first = _counted(values, {}, 0)
    places, wanted = {}, {}
    for (g, _), counts in first.items():
        n = sum(counts.values())
        # numpy's place of a share among n values
        places[g] = [s * (n - 1) for s in shares]
        wanted[g] = sorted({r for p in places[g] for r in (int(np.floor(p)), int(np.ceil(p)))})
    got = ranked_values(values, wanted, first) if wanted else {}
    out = {}
    for g, at in places.items():
        lo, hi = ([got[g, int(f(p))] for p in at] for f in (np.floor, np.ceil))
        out[g if by is not None else None] = [float(a if a == b else a + (b - a) * (p - np.floor(p))) for a, b, p in zip(lo, hi, at, strict=True)]
    return out


def median(df: DataFrame, c: str) -> float | None:
    got = quantiles(df, c, [0.5])
    return got[None][0] if got else None
