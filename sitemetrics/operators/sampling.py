"""Numbering, repeatable random samples, quota cohorts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemetrics.session import cut
from sitemetrics.sources.tables import Tables


def shuffle_key(seed: int, ident: str) -> Column:
    """Repeatable stand-in for random(): a hash of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")))


def random_sample(df: DataFrame, ident: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in hash order (top-k per task, then merged)."""
    return df.orderBy(shuffle_key(seed, ident), ident).limit(n)


def stratified_sample(df: DataFrame, ident: str, n: int, seed: int = 42, by: str = "site_id") -> DataFrame:
    """Up to n rows of each stratum in hash order; cut per task before the shuffle."""
    order = Window.partitionBy(by).orderBy(shuffle_key(seed, ident), ident)
    return df.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n)


def tiered_sample(t: Tables, tiers: list[tuple[int, int]], otherwise: int, seed: int = 42) -> DataFrame:
    """Active members per site up to a quota by capacity; `tiers` = [(capacity at least, quota)], largest first."""
    top = max([quota for _, quota in tiers] + [otherwise])
    sampled = stratified_sample(t.members.filter(F.col("status") == "active").select("member_id", "site_id"),
                                "member_id", top, seed)
    quota = F.lit(otherwise)
    for bound, n in reversed(tiers):
        quota = F.when(F.col("capacity") >= bound, n).otherwise(quota)
    return (sampled.join(t.site_bounded(t.sites.select("site_id", "capacity")), "site_id")
            .filter(F.col("rn") <= quota).select("member_id", "site_id", "rn"))


def row_numbers(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "rn", total: str | None = None) -> DataFrame:
    """row_number() over (partition by `by` order by `order`) without one task holding a partition; nulls come first and are kept.

    Rows are dealt to ranges of (by, order) whose splitters come from a sample of the keys themselves, so neither gaps nor dense stretches
    of ids matter. A row's number is its place in its range plus the rows of its partition in earlier ranges, a running sum over
    one row a partition and range. The order should be total. `total` names a column for the partition's size.
    """
    by = by or []
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("at", F.monotonically_increasing_id())
    rows = cut(ranged).withColumn("part", F.shiftright("at", 33))   # kept, so that the ranges are told once
    sizes = rows.groupBy(*by, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    everything = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    starts = sizes.withColumn("start", F.coalesce(F.sum("size").over(everything.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if total:
        starts = starts.withColumn(total, F.sum("size").over(everything))
    starts = starts.select(*[F.col(c).alias(f"at_{c}") for c in by], F.col("part").alias("of"), "first", "start", *([total] if total else []))
    same = F.col("part") == F.col("of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"at_{c}"))
    return (rows.join(starts, same).withColumn(name, F.col("at") - F.col("first") + F.col("start") + 1)
            .drop("at", "part", "of", "first", "start", *[f"at_{c}" for c in by]))


def quota_cohorts(members: DataFrame, quotas: list[tuple[float, str]], otherwise: str) -> DataFrame:
    """Label members by position in their site: the first whose cumulative share bound is not exceeded."""
    numbered = row_numbers(members.select("member_id", "site_id"), ["member_id"], ["site_id"], "seq", "site_members")
    share = F.col("seq").cast("double") / F.col("site_members").cast("double")
    label = F.lit(otherwise)
    for bound, text in reversed(quotas):
        label = F.when(share <= bound, text).otherwise(label)
    return numbered.select("member_id", "site_id", "seq", label.alias("cohort"))


def numbered_members(members: DataFrame) -> DataFrame:
    """Global number in (site, member) order and the contact key built from it."""
    numbered = row_numbers(members.select("site_id", "member_id", "name"), ["site_id", "member_id"])
    return numbered.select("member_id", F.col("rn").alias("number"),
                           F.concat(F.lower("name"), F.lit("."), F.lpad(F.col("rn").cast("string"), 9, "0")).alias("contact_key"))


def churn_cohorts(members: DataFrame, high: int, critical: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two disjoint samples of active members: the second never holds a member of the first."""
    active = members.filter(F.col("status") == "active").select("member_id", "site_id")
    first = random_sample(active, "member_id", high, seed)
    rest = active.join(first.select("member_id"), "member_id", "left_anti")
    return first, random_sample(rest, "member_id", critical, seed + 1)


def cohort_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("member_id").union(b.select("member_id")).distinct()
