"""URL filters: curated host and path rules, and association rules mined from labels, DataFrame operations only.

Curated rules fit a host and its subdomains, and paths that start with theirs; the longest wins. Where none fits, mined
rules decide. Each labelled url is a basket of tokens (host parts, path parts, query keys and values, fragment, scheme;
numbers become #) and its label. Spark's FP-growth finds the frequent baskets, whatever the number of a url's tokens; rules `tokens -> label` are pruned by
support, by confidence, by size, and if a rule with fewer tokens says the same with no less confidence. An inverted index holds each
rule under its rarest token; a url looks up its tokens and checks the rules found there for the rest. The rule of
the largest confidence, then support, then most tokens decides; without one the default verdict holds.

The mined rules are limited in number by support (at most 1 / min_support tokens are frequent), not by the data's size, so they
are broadcast where their count is below `max_broadcast_rules`, and shuffled by token beyond.

Defined results: a null url or one without `://` has empty host and path, no curated rule, and no tokens: the default verdict.
Rows that repeat count and are judged each. No labels, or an empty table: no mined rules. Other columns are ignored by
`judge`, which returns a row per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import Steps, ascii_lower, join_groups, stored, tidy

Rule = tuple[str, str, str]  # verdict, host, path


def rest_of(url: Column) -> Column:
    """What follows the first ://, empty without it."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def curated(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits as struct(size, rule, verdict), or null."""
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, h, p in rules
    ]
    none = F.lit(None).cast("struct<size: int, rule: string, verdict: string>")
    return F.array_max(F.array(*fits, none))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url."""
    tagged = lambda tag, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), F.regexp_replace(x, "[0-9]+", "#")))
    query, fragment = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(url, "#(.*)", 1)
    scheme = F.array(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    parts = F.concat(tagged("host=", F.split(host, r"\.")), tagged("path=", F.split(path, "/")), tagged("query=", F.split(query, "&")), tagged("fragment=", F.array(fragment)), tagged("scheme=", scheme))
    return F.coalesce(F.when(host != "", F.array_distinct(parts)), F.array().cast("array<string>"))


def _items(sets: DataFrame, least: float) -> DataFrame:
    """(token, item, often): the frequent tokens. Tokens that are in the same urls have the same count and sum of hashes; the smallest of them, the item, stands for all."""
    each = sets.select("tokens", "verdict", "n", F.explode("tokens").alias("token"))
    known = each.groupBy("token").agg(F.sum("n").alias("often"), F.sum(F.xxhash64("tokens", "verdict").cast("decimal(38,0)")).alias("same")).filter(F.col("often") >= least)
    # frequent tokens are few: at most the tokens of a url / min_support
    return known.select("token", F.min("token").over(Window.partitionBy("often", "same")).alias("item"), "often")


def _baskets(labelled: DataFrame, sets: DataFrame, items: DataFrame, max_items: int, max_tokens: int) -> DataFrame:
    """Rows (items): the frequent items of each labelled row and its label; of more than max_items items, baskets that hold every `max_tokens` of them together.

    The items of a long row are cut into blocks of max_items / max_tokens, rarest first, and each choice of max_tokens blocks is a basket.
    """
    each = sets.select("tokens", "verdict", "n", F.explode("tokens").alias("token"))
    own = F.array_sort(F.collect_list(F.struct("often", "token")))
    chosen = each.join(F.broadcast(items.filter("token = item").select("token", "often")), "token").groupBy("tokens", "verdict", "n").agg(own.alias("own"))
    chosen = chosen.select("tokens", "verdict", "n", F.transform("own", lambda x: x["token"]).alias("own"))
    rows = join_groups(labelled.filter(F.size("tokens") > 0), chosen, ["tokens", "verdict"], "n").select("own", F.concat(F.lit("verdict="), "verdict").alias("told"))
    short = rows.filter(F.size("own") <= max_items).select(F.array_append("own", F.col("told")).alias("items"))
    size = max(1, max_items // max_tokens)
    long = rows.filter(F.size("own") > max_items).withColumn("blocks", F.ceil(F.size("own") / size).cast("int"))
    long = long.withColumn("last", F.lit(-1)).withColumn("part", F.array().cast("array<string>"))
    for left in range(max_tokens - 1, -1, -1):
        # the next block of the choice; as many as are still to be chosen stay behind it
        long = long.filter(F.col("last") + 1 <= F.col("blocks") - 1 - left).withColumn("last", F.explode(F.sequence(F.col("last") + 1, F.col("blocks") - 1 - left)))
        long = long.withColumn("part", F.concat("part", F.slice("own", F.col("last") * size + 1, F.lit(size))))
    return short.unionByName(long.select(F.array_append("part", F.col("told")).alias("items")))


def mine(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.9, max_tokens: int = 3, max_items: int = 12) -> DataFrame:
    """Rules of up to max_tokens tokens from (tokens, verdict) rows: tokens, size, verdict, confidence, support; stored in the shared folder.

    FP-growth finds sets of every size, so that a basket of n items may add 2^n. Tokens that are in the same urls are therefore one item, and
    a url of more than `max_items` items is given in several baskets, so that each set of max_tokens of its items is in one of them. Such a
    url counts several times, so no frequent set is missed and some others are proposed; the counts of all that is proposed are then taken over
    all tokens of all labelled urls, and a rule holds for each token that its items stand for.
    """
    steps = Steps(labelled.sparkSession)
    sets = steps.stored(labelled.filter(F.size("tokens") > 0).groupBy("tokens", "verdict").agg(F.count("*").alias("n")), "token-sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    items = steps.stored(_items(sets, min_support * total), "items")
    baskets = steps.stored(_baskets(labelled, sets, items, max(max_items, max_tokens), max_tokens), "baskets")
    # as many baskets as it takes urls, however many baskets there are; counts that rounding may lose are let in
    least = min(1.0, min_support * total * (1 - 1e-9) / max(1, baskets.count()))
    found = FPGrowth(minSupport=least, minConfidence=min_confidence).fit(baskets).freqItemsets.filter(F.size("items") <= max_tokens + 1)
    of = F.filter("items", lambda x: x.startswith("verdict="))
    proposed = found.filter((F.size(of) == 1) & (F.size("items") > 1)).select(F.array_sort(F.array_except("items", of)).alias("rule")).distinct()
    proposed = steps.stored(proposed.withColumn("key", F.col("rule")[0]), "proposed")
    met = sets.select("tokens", "verdict", "n", F.explode("tokens").alias("key")).join(proposed, "key").filter(F.size(F.array_except("rule", "tokens")) == 0)
    counted = met.groupBy(F.col("rule").alias("tokens"), "verdict").agg(F.sum("n").alias("together"))
    counted = counted.withColumn("freq", F.sum("together").over(Window.partitionBy("tokens")))
    rules = counted.select("tokens", F.size("tokens").alias("size"), "verdict", (F.col("together") / F.col("freq")).alias("confidence"), (F.col("together") / F.lit(max(1, total))).alias("support"))
    rules = steps.stored(rules.filter((F.col("confidence") >= min_confidence) & (F.col("support") >= min_support)), "rules")
    steps.drop(baskets, sets, proposed)
    # a rule goes if one with fewer of its tokens has the same verdict and no less confidence: looked up by its subsets
    keyed = rules.select(F.col("tokens").alias("sub"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    subsets = rules.select("tokens", "verdict", "confidence", F.explode(F.concat(F.transform("tokens", lambda x: F.array_remove("tokens", x)), F.transform("tokens", lambda x: F.array(x)))).alias("sub")).filter(F.size("sub") < F.size("tokens"))
    worse = subsets.join(keyed, "sub").filter((F.col("verdict") == F.col("v")) & (F.col("c") >= F.col("confidence"))).select("tokens", "verdict").distinct()
    out = rules.join(worse, ["tokens", "verdict"], "left_anti").withColumns({"left": F.col("tokens"), "tokens": F.array().cast("array<string>")})
    # each item becomes each of its tokens; two tokens of one item say no more than one
    alike = items.select("item", F.col("token").alias("own"))
    for k in range(max_tokens):
        done, more = out.filter(F.size("left") == 0), out.filter(F.size("left") > 0).withColumn("item", F.col("left")[0])
        more = more.join(F.broadcast(alike), "item").withColumns({"tokens": F.array_append("tokens", F.col("own")), "left": F.slice("left", 2, max_tokens)})
        out = more.drop("item", "own") if k == 0 else done.unionByName(more.drop("item", "own"))
    out = steps.stored(out.select(F.array_sort("tokens").alias("tokens"), "size", "verdict", "confidence", "support"), "mined")
    steps.drop(items, rules)
    return out


def index_of(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """Rules under their rarest token: key, tokens, verdict, confidence, support, size."""
    counts = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    each = rules.select("*", F.explode("tokens").alias("token")).join(counts, "token")
    rarest = each.groupBy("tokens", "verdict", "confidence", "support", "size").agg(F.min(F.struct("n", "token")).alias("least"))
    return rarest.select(F.col("least.token").alias("key"), "tokens", "verdict", "confidence", "support", "size")


@tidy
def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_broadcast_rules: int = 100_000, **how) -> DataFrame:
    """One row per row: id, host, path, rule, verdict, mined (the tokens of the mined rule that decided, else null).

    The curated rules' own verdicts are the labels that the mined rules are learnt from.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("fit", curated(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    rows = stored(rows.select("id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("told"), "tokens", F.monotonically_increasing_id().alias("row")), "urls")
    labelled = rows.filter("told is not null").select("tokens", F.col("told").alias("verdict"))
    index = stored(index_of(mine(labelled, **how), labelled), "rule-index").withColumnRenamed("tokens", "needs")
    if index.count() <= max_broadcast_rules:
        index = F.broadcast(index)
    # a url's verdict depends on its tokens only, so that equal token sets are looked up once
    open_rows = rows.filter("told is null")
    asked = open_rows.groupBy("tokens").agg(F.count("*").alias("n"))
    hits = asked.select("tokens", F.explode("tokens").alias("key")).join(index, "key").filter(F.size(F.array_except("needs", "tokens")) == 0)
    best = hits.groupBy("tokens").agg(F.max(F.struct("confidence", "support", "size", "needs", "verdict")).alias("best"))
    judged = stored(asked.join(best, "tokens", "left"), "verdicts")
    both = join_groups(open_rows, judged, ["tokens"], "n").unionByName(rows.filter("told is not null"), allowMissingColumns=True)
    return both.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("told", "best.verdict", F.lit(default)).alias("verdict"), F.col("best.needs").alias("mined"))
