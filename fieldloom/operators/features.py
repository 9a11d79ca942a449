"""Feature layer: one row per observation in, one row out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import catalogue as cat
from fieldloom.functions import scalars as fn


def derive(obs: DataFrame, kind: str) -> DataFrame:
    """Adds the features of players (per 90 minutes, ratios, one difference) or teams (counts, rates, ratios, one difference)."""
    if kind == "player":
        counts = {f: fn.per90(F.col(f), F.col("minutes_played")) for f in cat.PLAYER_COUNTS}
        ratios = {n: fn.safe_ratio(F.col(a), F.expr(b)) for n, a, b in cat.PLAYER_RATIOS}
        more = {"np_goals_minus_npxg": counts["np_goals"] - counts["npxg"]}
    elif kind == "team":
        counts = {f: F.col(f).cast("double") for f in [*cat.TEAM_COUNTS, *cat.TEAM_RATES]}
        ratios = {n: fn.safe_ratio(F.col(a), F.expr(b)) for n, a, b in cat.TEAM_RATIOS}
        more = {"goals_minus_xg": F.col("goals") - F.col("xg")}
    else:
        raise ValueError(f"unknown kind {kind}")
    return obs.withColumns(counts | ratios | more)


def norm_stats(df: DataFrame, group: str | None, features: list[str]) -> DataFrame:
    """(grp, feature, mu, sd): population deviation; sd 0 or null is 1, mu null is 0. One pass for all features."""
    key = F.col(group) if group else F.lit("all")
    wide = df.groupBy(key.alias("grp")).agg(*[F.struct(F.avg(f).alias("mu"), F.stddev_pop(f).alias("sd")).alias(f) for f in features])
    long = wide.select("grp", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}.mu").alias("mu"), F.col(f"{f}.sd").alias("sd")) for f in features])).alias("x"))
    return long.select("grp", "x.feature", F.coalesce("x.mu", F.lit(0.0)).alias("mu"), F.when(F.coalesce(F.col("x.sd"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("x.sd")).alias("sd"))


def merge_stats(new: DataFrame, frozen: DataFrame) -> DataFrame:
    """Frozen statistics win; what they lack comes from the new ones."""
    old = frozen.select("grp", "feature", F.col("mu").alias("m0"), F.col("sd").alias("s0"))
    return new.join(old, ["grp", "feature"], "left").select("grp", "feature", F.coalesce("m0", "mu").alias("mu"), F.coalesce("s0", "sd").alias("sd"))


def zscore(df: DataFrame, stats: DataFrame, group: str | None, features: list[str], clip: float = 6.0) -> DataFrame:
    """Features as z-scores of their group, null to 0, held within the clip. The statistics, one row per group, are joined."""
    wide = stats.groupBy("grp").pivot("feature", features).agg(F.first(F.struct("mu", "sd")))
    wide = wide.select(F.col("grp").alias("__g"), *[F.col(f"`{f}`").alias(f"__{f}") for f in features])
    key = F.col(group) if group else F.lit("all")
    z = lambda f: F.least(F.greatest(F.coalesce(F.nanvl((F.col(f) - F.col(f"__{f}.mu")) / F.col(f"__{f}.sd"), F.lit(0.0)), F.lit(0.0)), F.lit(-clip)), F.lit(clip))
    joined = df.join(wide, key == F.col("__g"), "left")
    return joined.select(*[z(f).alias(f) if f in features else F.col(f) for f in df.columns])


def feature_matrix(df: DataFrame, entity: str, match: str, mass: str, features: list[str]) -> DataFrame:
    return df.select(F.col(entity).alias("entity_id"), F.col(match).alias("match_id"), F.col(mass).alias("mass"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))


def weighted_mean(df: DataFrame, entity: str, weight: str, features: list[str], skip_null: bool = False) -> DataFrame:
    """Means by weight; a mass of zero divides by 1, or gives null where nulls are skipped."""
    w = F.col(weight)

    def mean(f: str):
        if skip_null:
            return F.sum(w * F.col(f)) / F.nullif(F.sum(F.when(F.col(f).isNotNull(), w)), F.lit(0.0))
        return F.sum(w * F.coalesce(F.col(f), F.lit(0.0))) / F.coalesce(F.nullif(F.sum(w), F.lit(0.0)), F.lit(1.0))

    return df.groupBy(entity).agg(*[mean(f).alias(f) for f in features])


def melt(df: DataFrame, keys: list[str], features: list[str], name: str = "feature", value: str = "z") -> DataFrame:
    return df.unpivot(keys, features, name, value)


def phase_profile(long: DataFrame, phases: DataFrame, entity: str, lower_better: list[str]) -> DataFrame:
    """(entity, phase, score): mean of the phase's oriented values, added in order of features; phases: (phase, feature)."""
    z = fn.oriented(F.col("feature"), F.col("z"), lower_better)
    each = F.sort_array(F.collect_list(F.when(z.isNotNull(), F.struct("feature", z.alias("z")))))
    score = F.aggregate(each, F.lit(0.0), lambda s, v: s + v["z"]) / F.nullif(F.size(each), F.lit(0))
    return long.join(F.broadcast(phases), "feature").groupBy(entity, "phase").agg(score.alias("score"))
