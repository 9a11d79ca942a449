"""Secret scans with multipart credential linking, DataFrame operations only.

Three base patterns are always reported. Access identifiers of other services, bare secrets and endpoints are weak
candidates: alone they are mostly ordinary text, so they are reported only where complementary parts stand within a
scope, a distance of `scope` characters in one document:

* a weak identifier with a secret (an assigned one or a bare one),
* a bare secret with an identifier (a base one or a weak one),
* an endpoint with both an identifier and a secret.

Only documents that hold a weak candidate leave their row. Their parts are joined as intervals: positions are cut
into blocks as long as the scope, a part meets the parts of the blocks that it covers and of their neighbours (semi-joins on
document and block, then the distance), and blocks hold few parts as parts do not overlap within a kind and each
takes several characters. Parts of any length are linked alike. No pairs are made.

Positions come from the pieces between matches and the matches themselves, whose lengths add up. All offsets
count code points; ends are exclusive.

Defined results: a null or empty text has no spans, and texts of any length are scanned whole. Repeated rows are documents of their own, also with equal or null
ids. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import stored, text_of, tidy

# The patterns of the base kinds, in their order, with the group whose length counts and its least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
# For these two a match that is long enough is the whole run, so that shorter runs need not be looked at.
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}+"
HEX_LONG = r"(?<![0-9a-f])[0-9a-f]{24,}+"
# The weak candidates.
WEAK = {
    "id": r"(?<![A-Z0-9])(?:ASIA|AROA|AIDA|AGPA|LTAI|AKID|GOOG)[A-Z0-9]{12,}+",
    "secret": r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}+={0,2}",
    "endpoint": r"(?i:https?://|(?<![A-Za-z0-9.-])(?:s3|sts|sqs|api|oss|storage)[a-z0-9-]*\.)[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]+)?",
}
SPANS = "array<struct<start: int, kind: int, end: int>>"


def _placed(sizes: Column, at: Column) -> Column:
    """Starts, from `at` on, of pieces that follow one another: struct (at: where the next one starts, starts)."""
    empty = F.struct(at.cast("int").alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(sizes, empty, lambda state, n: F.struct((state["at"] + n).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts")))


def _spans(text: Column, pattern: str, kind: str, block: int = 512) -> Column:
    """Spans of all matches: the gaps' and the matches' lengths, summed up.

    Sums run within blocks, and over the blocks' totals, so that a text of very many matches costs little more per match.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # the last gap has no match
    pairs = F.filter(F.zip_with(F.split(text, pattern, -1), matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"))), lambda x: x["size"].isNotNull())

    def blocked(pairs: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / block).cast("int")), lambda k: F.slice(pairs, k * block + 1, F.lit(block)))
        totals = F.transform(cuts, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["gap"] + x["size"]))
        return F.flatten(F.zip_with(cuts, _placed(totals, F.lit(0))["starts"], spans))

    def spans(cut: Column, base: Column) -> Column:
        starts = _placed(F.transform(cut, lambda x: x["gap"] + x["size"]), base)["starts"]
        return F.zip_with(cut, starts, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (at + x["gap"] + x["size"]).alias("end")))

    # bound to a name, so that the matches are found once
    found = F.transform(F.array(pairs), lambda p: F.when(F.size(p) > 0, blocked(p)).otherwise(_none()))
    return F.element_at(found, 1)


def _none() -> Column:
    return F.array().cast(SPANS)


def _assign(text: Column) -> Column:
    """Assignments, less those whose value is too short."""
    values = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v))
    both = F.arrays_zip(_spans(text, ASSIGN, "assign").alias("span"), values.alias("size"))
    return F.transform(F.filter(both, lambda x: x["size"] >= LEAST["assign"]), lambda x: x["span"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, assign, access, hex, weak): the parts in each document, in the shared folder. No text is copied."""
    t = F.col("t")
    has = {"assign": t.rlike(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"), "access": t.contains("AKIA"), "hex": t.rlike(HEX_LONG)}
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    rows = rows.select(
        "id", "t", F.when(has["assign"], _assign(t)).otherwise(_none()).alias("assign"), F.when(has["access"], _spans(t, ACCESS_LONG, "access")).otherwise(_none()).alias("access"),
        F.when(has["hex"], _spans(t, HEX_LONG, "hex")).otherwise(_none()).alias("hex"),
    )
    rows = rows.withColumn("weak_id", F.when(t.rlike("ASIA|AROA|AIDA|AGPA|LTAI|AKID|GOOG"), _spans(t, WEAK["id"], "id")).otherwise(_none()))
    # without an identifier or an assigned secret, neither bare secrets nor endpoints have a complement
    some = (F.size("access") + F.size("weak_id") > 0)
    rows = rows.withColumn("weak", F.when(some, F.concat("weak_id", _spans(t, WEAK["secret"], "secret"), _spans(t, WEAK["endpoint"], "endpoint"))).otherwise(_none()))
    return stored(rows.select("id", F.monotonically_increasing_id().alias("row"), "assign", "access", "hex", "weak"), "secret-parts")


def _near(left: DataFrame, right: DataFrame, scope: int) -> DataFrame:
    """The rows of left within the scope of a row of right in the same document: an interval join by blocks.

    A row of left is looked up by every block that it covers, so that its length does not matter, and counts once.
    """
    covered = F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("at")
    blocks = right.select(F.col("row").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))).alias("b"))
    apart = F.greatest(F.col("s") - F.col("end"), F.col("start") - F.col("e"))
    met = left.select("*", covered).join(blocks, (F.col("row") == F.col("r")) & (F.col("at") == F.col("b")) & (apart <= scope), "left_semi")
    return met.drop("at").distinct()


def link(parts: DataFrame, scope: int = 400) -> DataFrame:
    """(row, linked): the weak candidates that have their complement, per document."""
    every = parts.filter(F.size("weak") > 0).select("row", F.explode(F.concat("assign", "access", "weak")).alias("x")).select("row", "x.*")
    of = lambda *kinds: every.filter(F.col("kind").isin([KINDS.index(k) for k in kinds]))
    ids, secrets = of("access", "id"), of("assign", "secret")
    found = _near(of("id"), secrets, scope).unionByName(_near(of("secret"), ids, scope)).unionByName(_near(_near(of("endpoint"), ids, scope), secrets, scope))
    return found.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


@tidy
def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 400) -> DataFrame:
    """One row per document: id, assign, access, hex (spans of the base kinds), linked (spans of weak kinds)."""
    parts = scan(docs, id_col, text_col)
    linked = link(parts, scope).withColumnRenamed("row", "r")
    both = parts.join(linked, parts["row"] == linked["r"], "left")
    return both.select(F.col("id").alias(id_col), "assign", "access", "hex", F.coalesce("linked", _none()).alias("linked"))


def spelled(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
