"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Each source has a target in words. Every document of a source first gets the same number of certain whole copies,
floor(target / size of the source); the rest of the target is a Pareto sample: each document draws u in (0, 1) from its id, its text and, where rows are equal in both, its number among them; its rank
is the random odds u/(1-u) divided by the inclusion odds p/(1-p), and the documents of lowest rank are taken until the size
is reached. The size is counted in words, so the prefix that still fits is taken; the words left are filled by further rounds over the
documents behind the cut that fit into what is left, and by one document that goes beyond it where that comes nearer. Draws come from a digest, hence reruns agree.

Defined cases: null and empty texts have size 0 and take no part beyond their whole copies (taken 0); a null source is a source of its own, last
in order; rows with equal id, text and source are numbered and drawn one by one, so a mass of them comes
as near to its target as others; null ids are told apart by their texts; an empty table gives an empty result; further
columns pass through, but for those whose names start with `mix_`, which are left out.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitemetrics.llm.common import cut, stored
from sitemetrics.llm.manifest import numbered
from sitemetrics.session import MAX_BROADCAST_ROWS

#: Weights of the sources in code point order, repeating; share of all words; copies at most; rounds that fill the size.
WEIGHTS, SHARE, MOST, ROUNDS, BUCKETS = (3, 1, 2), 1.5, 2, 3, 4096
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text):
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(ident, seed: str):
    """52 bits of a digest of the id, moved into the open unit interval."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(ident.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(mix_source, mix_words, mix_target) from (mix_source, mix_words): a common level times the weight, cut at `most` times the words.

    One row per source; the level solves sum(min(most * words, weight * level)) = share * sum(words), which is what
    resharing the excess by weight ends in.
    """
    place = Window.orderBy(F.col("mix_source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = (sizes.withColumn("mix_weight", F.element_at(cycle, F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1))
               .withColumn("mix_cap", F.col("mix_words") * float(most))
               .withColumn("mix_full", F.col("mix_cap") / F.col("mix_weight")))
    order = [F.col("mix_full"), F.col("mix_source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("mix_words").over(everything) * share - F.coalesce(F.sum("mix_cap").over(before), F.lit(0.0))) / F.sum("mix_weight").over(onward)
    found = weighed.withColumn("mix_level", level)
    found = found.withColumn("mix_level", F.max(F.when(F.col("mix_level") <= F.col("mix_full"), F.col("mix_level"))).over(everything))
    return found.select("mix_source", "mix_words", F.least(F.col("mix_cap"), F.col("mix_weight") * F.coalesce("mix_level", F.lit(float("inf")))).alias("mix_target"))


def by_source(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    """Join one row per source to the rows; broadcast only where the sources were counted and are few."""
    right = per_source.withColumnRenamed("mix_source", "mix_at")
    return rows.join(F.broadcast(right) if few else right, F.col("mix_source").eqNullSafe(F.col("mix_at")), "left").drop("mix_at")


def plan(rows: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, rounds=ROUNDS):
    """One row per source with its target, whole copies and the cuts of each round, from rows (mix_source, mix_size, mix_u, mix_tie).

    Sums run over a histogram of the rank (at most BUCKETS rows a source); only the bucket that holds the cut is summed row by row.
    """
    sizes = rows.groupBy("mix_source").agg(F.sum("mix_size").alias("mix_words"))
    state = cut(targets(sizes, weights, share, most)
                .withColumn("mix_ratio", F.when(F.col("mix_words") > 0, F.col("mix_target") / F.col("mix_words")).otherwise(F.lit(0.0)))
                .withColumn("mix_whole", F.floor("mix_ratio").cast("long"))
                .withColumn("mix_p", F.col("mix_ratio") - F.col("mix_whole"))
                .withColumn("mix_left", F.col("mix_p") * F.col("mix_words")))
    few = state.count() <= MAX_BROADCAST_ROWS
    for k in range(rounds):
        open_rows = by_source(rows.filter("mix_size > 0"), state, few).withColumn("mix_rank", rank())
        for j in range(k):
            open_rows = open_rows.filter(~taken_in(j))
        open_rows = (open_rows.filter(F.col("mix_size") <= F.col("mix_left"))
                     .select("mix_source", "mix_size", "mix_rank", "mix_tie", "mix_left", F.floor(F.col("mix_rank") * BUCKETS).alias("mix_bucket")))
        along = Window.partitionBy("mix_source").orderBy("mix_bucket")
        tower = (open_rows.groupBy("mix_source", "mix_bucket").agg(F.sum("mix_size").alias("mix_sum"), F.first("mix_left").alias("mix_left"))
                 .withColumn("mix_upto", F.sum("mix_sum").over(along)))
        edge = (tower.filter(F.col("mix_upto") > F.col("mix_left")).groupBy("mix_source")
                .agg(F.min_by(F.struct("mix_bucket", (F.col("mix_upto") - F.col("mix_sum")).alias("mix_before")), "mix_bucket").alias("e"))
                .select("mix_source", "e.mix_bucket", "e.mix_before"))
        total = tower.groupBy("mix_source").agg(F.sum("mix_sum").alias("mix_all"))
        edge = edge.withColumnRenamed("mix_bucket", "mix_edge")
        inside = by_source(open_rows, edge, few).filter(F.col("mix_bucket") == F.col("mix_edge"))
        row = Window.partitionBy("mix_source").orderBy("mix_rank", "mix_size", "mix_tie").rowsBetween(Window.unboundedPreceding, 0)
        last = (inside.withColumn("mix_upto", F.col("mix_before") + F.sum("mix_size").over(row))
                .filter(F.col("mix_upto") > F.col("mix_left"))
                .groupBy("mix_source").agg(F.min(F.struct("mix_rank", "mix_size", "mix_tie")).alias(f"mix_cut{k}"),
                                           F.min(F.col("mix_upto") - F.col("mix_size")).alias("mix_took")))
        after = by_source(by_source(state, total, few), last, few)
        # A source without a cut is taken whole in this round.
        state = cut(after.withColumn(f"mix_limit{k}", F.col("mix_left"))
                    .withColumn("mix_left", F.col("mix_left") - F.coalesce("mix_took", "mix_all", F.lit(0)))
                    .drop("mix_took", "mix_all"))
    # Where no document fits any more, one that goes beyond is taken if that comes nearer.
    open_rows = by_source(rows.filter("mix_size > 0"), state, few).withColumn("mix_rank", rank())
    for j in range(rounds):
        open_rows = open_rows.filter(~taken_in(j))
    least = (open_rows.filter((F.col("mix_p") > 0) & (F.col("mix_size") < 2 * F.col("mix_left"))).groupBy("mix_source")
             .agg(F.min(F.struct("mix_size", "mix_rank", "mix_tie")).alias("mix_extra")))
    return cut(by_source(state, least, few)), few


def rank():
    """Pareto rank q = (u/(1-u)) / (p/(1-p)), kept as q/(1+q) so that it lies in the unit interval."""
    up, down = F.col("mix_u") * (1 - F.col("mix_p")), (1 - F.col("mix_u")) * F.col("mix_p")
    return F.when(F.col("mix_p") > 0, up / (up + down)).otherwise(F.lit(1.0 - 2.0 ** -40))


def taken_in(k: int):
    """Whether round k took the row: it fits and its rank lies before the round's cut."""
    key = F.struct(F.col("mix_rank").alias("mix_rank"), F.col("mix_size").alias("mix_size"), F.col("mix_tie").alias("mix_tie"))
    cut_at = F.col(f"mix_cut{k}")
    return (F.col("mix_size") <= F.col(f"mix_limit{k}")) & (cut_at.isNull() | (key < cut_at))


def mix(docs: DataFrame, text="text", ident="doc_id", source="source", seed="mix", weights=WEIGHTS, share=SHARE, most=MOST,
        rounds=ROUNDS) -> DataFrame:
    """The documents with mix_size, mix_words (of the source), mix_target (of the source) and mix_copies (0 to `most`)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith("mix_")])
    own = F.md5(F.to_json(F.struct(F.col(ident).cast("string").alias("i"), F.md5(F.col(text).cast("binary")).alias("t"), F.col(source).cast("string").alias("s"))))
    keyed = docs.withColumn("mix_own", own)
    again = stored(keyed.groupBy("mix_own").agg(F.count("*").alias("mix_n")).filter("mix_n > 1").select("mix_own"))
    numbered_rows = keyed.withColumn("mix_no", F.lit(0).cast("long"))
    if not again.isEmpty():
        rest = numbered(keyed.join(again, "mix_own", "left_semi"), "mix_own", [], "mix_no", "mix_n").drop("mix_n")
        numbered_rows = numbered_rows.join(again, "mix_own", "left_anti").unionByName(rest)
    drawn = F.concat_ws(":", "mix_own", "mix_no")
    ready = numbered_rows.select(*docs.columns, F.col(source).alias("mix_source"), n_words(F.col(text)).alias("mix_size"),
                                 uniform(drawn, seed).alias("mix_u"), F.xxhash64("mix_own", "mix_no").alias("mix_tie"))
    slim = cut(ready.select("mix_source", "mix_size", "mix_u", "mix_tie"))
    state, few = plan(slim, weights, share, most, rounds)
    out = by_source(ready, state, few).withColumn("mix_rank", rank())
    chosen = F.lit(False)
    passed = F.lit(True)
    for k in range(rounds):
        chosen = chosen | (passed & taken_in(k))
        passed = passed & ~taken_in(k)
    extra = F.struct(F.col("mix_size").alias("mix_size"), F.col("mix_rank").alias("mix_rank"), F.col("mix_tie").alias("mix_tie"))
    chosen = chosen | (passed & F.coalesce(extra == F.col("mix_extra"), F.lit(False)))
    copies = F.col("mix_whole") + F.when(chosen & (F.col("mix_p") > 0) & (F.col("mix_size") > 0), 1).otherwise(0)
    return out.select(*docs.columns, "mix_size", "mix_words", "mix_target", F.least(copies, F.lit(most)).cast("long").alias("mix_copies"))


def op3(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source")).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_words").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.col("mix_copies").alias("copies"))
