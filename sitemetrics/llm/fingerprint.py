"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with DataFrame functions only.

A text's items are the 63-bit digests of its distinct paragraphs (pieces between line breaks, trimmed, empty ones left out). Long
paragraphs are cut at sentence ends into pieces of LONG code points or more, of half as many in texts of at most SHORT code points, and where no
sentence ends within LONG more, behind a word of certain ending, or there; texts of at most TINY
have words for items. A sketch of 3*m cells has three parts; an item falls into one cell of each part, by
three stretches of its bits. A cell holds the number of its items and the exclusive-or of their digests and of their check values. Two
sketches are subtracted cell by cell; a cell that holds one item (count 1 or -1 and a fitting check) gives that item away, which is then
taken out of its other cells, round by round (peeling). If cells are left over, the sketches are built again larger (SIZES, then twice with
other bits), so differences of any size are recovered. Long texts are compared in groups of about GROUP items, dealt by digest, each with sketches
of its own: work stays in proportion. The recovered items are the paragraphs that only one of the two versions has; the likeness is
1 - (their number) / (items of both).

Defined cases: a null text is empty; empty texts have no items, a fingerprint of their own and likeness 1 to each other, 0 to any
other text; paragraphs that repeat within a text count once, but a text's digest is part of its fingerprint, so only equal texts
share one; an empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONG, SHORT, TINY = 200, 1500, 200
#: Last letters of words behind which a passage without sentence marks may be cut: the same words are cut alike wherever they stand.
ENDING = "aoAO"
BASE, SIZES, GROUP, ROUNDS = 4, (8, 24), 12, 24
_CELLS = "array<struct<n:int,k:bigint,c:bigint>>"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def items(text: Column) -> Column:
    """Sorted distinct 63-bit digests of the paragraphs, of their pieces where they are long, of the words of a very short text."""
    def parts(t):
        lines = F.filter(F.transform(F.split(t, "[\r\n]+"), F.trim), lambda x: x != "")

        def pieces(least):
            # At least so many code points, up to the end of the sentence; where none comes, up to a word of certain ending, or so many more.
            piece = f".{{1,{least}}}(?:[^.!?]{{0,{LONG}}}[.!?]++\\x20*|[^.!?]{{0,{LONG}}}?[{ENDING}]\\x20|[^.!?]{{0,{LONG}}})"
            return F.flatten(F.transform(lines, lambda x: F.when(F.length(x) > 2 * least, F.regexp_extract_all(x, F.lit(piece), F.lit(0))).otherwise(F.array(x))))
        words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: x != "")
        return F.when(F.length(t) > SHORT, pieces(LONG)).when(F.length(t) > TINY, pieces(LONG // 2)).otherwise(words)
    return F.array_sort(F.array_distinct(F.transform(parts(text), lambda x: F.abs(F.xxhash64(x) % F.lit((1 << 63) - 25)))))


def _coded(k: Column, m: Column, turn: int, **more) -> Column:
    """An item with its check value and its cell in each of the three parts, worked out once."""
    bits = k if turn == 0 else F.xxhash64(k, F.lit(turn))
    cell = [F.pmod(F.shiftrightunsigned(bits, 20 * part).bitwiseAND(F.lit((1 << 23) - 1)), m).cast("int").alias(f"p{part}") for part in range(3)]
    return F.struct(k.alias("k"), F.xxhash64(k).alias("c"), *cell, *[v.alias(name) for name, v in more.items()])


def _cells(coded: Column, m: Column) -> Column:
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))

    def part(j):
        return F.transform(F.sequence(F.lit(0), (m - 1).cast("int")), lambda i: F.aggregate(
            F.filter(coded, lambda x: x[f"p{j}"] == i), zero,
            lambda a, x: F.struct((a["n"] + 1).alias("n"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["c"].bitwiseXOR(x["c"]).alias("c"))))
    return F.concat(part(0), part(1), part(2))


def sketch(found: Column, m: Column, turn: int = 0) -> Column:
    """Cells of a set of items: three parts of m."""
    return let(F.transform(found, lambda k: _coded(k, m, turn)), lambda coded: _cells(coded, m))


def subtract(a: Column, b: Column) -> Column:
    """Cells of the difference of two sketches of one size."""
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peel(cells: Column, m: Column, turn: int = 0) -> Column:
    """struct(left array<bigint>, right array<bigint>, ok boolean): items only in the first and only in the second version."""
    def pure_of(state):
        alone = F.filter(state["cells"], lambda c: F.when(F.abs(c["n"]) == 1, F.xxhash64(c["k"]) == c["c"]).otherwise(F.lit(False)))
        return F.array_distinct(F.transform(alone, lambda c: _coded(c["k"], m, turn, s=c["n"])))

    def less(state, pure):
        def part(j):
            return F.transform(F.slice(state["cells"], (m * j + 1).cast("int"), m.cast("int")), lambda cell, i: F.aggregate(
                F.filter(pure, lambda x: x[f"p{j}"] == i), cell,
                lambda a, x: F.struct((a["n"] - x["s"]).alias("n"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["c"].bitwiseXOR(x["c"]).alias("c"))))
        return F.concat(part(0), part(1), part(2))

    def round_(state):
        return let(pure_of(state), lambda pure: F.when(F.size(pure) == 0, F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(False).alias("on")))
                   .otherwise(F.struct(less(state, pure).alias("cells"), F.concat(state["found"], F.transform(pure, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s")))).alias("found"), F.lit(True).alias("on"))))
    start = F.struct(cells.cast(_CELLS).alias("cells"), F.array().cast("array<struct<k:bigint,s:int>>").alias("found"), F.lit(True).alias("on"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda state, _: F.when(state["on"], round_(state)).otherwise(state),
                       lambda s: F.struct(F.transform(F.filter(s["found"], lambda p: p["s"] == 1), lambda p: p["k"]).alias("left"),
                                          F.transform(F.filter(s["found"], lambda p: p["s"] == -1), lambda p: p["k"]).alias("right"),
                                          F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0)).alias("ok")))


def _or(other: Column):
    return lambda r: F.when(r["ok"], r).otherwise(other)


def _attempts(a: Column, b: Column) -> Column:
    """Difference of two item arrays by sketches that grow until it peels."""
    grown = F.greatest(F.lit(4 * SIZES[-1]), F.size(a) + F.size(b))
    tries = [(F.lit(m), 0) for m in SIZES] + [(grown, 1), (grown * 2, 2)]

    def attempt(m, turn):
        return peel(subtract(sketch(a, m, turn), sketch(b, m, turn)), m, turn)
    out = attempt(*tries[-1])
    for m, turn in reversed(tries[:-1]):
        out = let(attempt(m, turn), _or(out))
    return out


def difference(a: Column, b: Column) -> Column:
    """struct(left, right, ok): items only in the first, only in the second, whether every sketch peeled."""
    # Groups of groups, so that dealing n items takes n * sqrt(n) steps.
    groups = F.ceil(F.sqrt((F.size(a) + F.size(b)) / GROUP)).cast("int")

    def part(found, g, bits):
        return F.filter(found, lambda k: F.pmod(F.shiftrightunsigned(k, bits), groups) == g)

    def split(pair, bits, use):
        return F.transform(F.sequence(F.lit(0), groups - 1), lambda g: let(F.struct(part(pair["a"], g, bits).alias("a"), part(pair["b"], g, bits).alias("b")), use))
    few = F.array(_attempts(a, b))
    many = let(F.struct(a.alias("a"), b.alias("b")), lambda whole: F.flatten(split(whole, 30, lambda p: split(p, 42, lambda q: _attempts(q["a"], q["b"])))))
    return let(F.when(groups <= 1, few).otherwise(many), lambda rs: F.struct(
        F.flatten(F.transform(rs, lambda r: r["left"])).alias("left"), F.flatten(F.transform(rs, lambda r: r["right"])).alias("right"),
        F.forall(rs, lambda r: r["ok"]).alias("ok")))


def likeness(a: Column, b: Column) -> Column:
    """1 - share of the items of both that only one has; 1 if neither has any."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(let(difference(a, b), lambda d: F.lit(1.0) - (F.size(d["left"]) + F.size(d["right"])) / both))


def fingerprint(text: Column, found: Column) -> Column:
    """Text digest and the smallest sketch, as text."""
    cells = sketch(found, F.lit(BASE))
    shown = F.transform(cells, lambda c: F.concat_ws(".", c["n"].cast("string"), F.lower(F.hex(c["k"]))))
    return F.concat(F.substring(F.sha2(text, 256), 1, 32), F.lit("/"), F.array_join(shown, ","))


def _tree(column: Column, bounds: list[int]) -> Column:
    """Number of bounds that are not above the value, by bisection."""
    def node(lo, hi):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column < bounds[mid], node(lo, mid)).otherwise(node(mid + 1, hi))
    return node(0, len(bounds))


def with_next(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(fp_id, fp_text, fp_next): every row with the text of the next one in descending order of id, nulls last; the last is followed by the first.

    Ids are cut into ranges at quantiles and each range is one window; the first row of a range is copied behind the range before it,
    so that no window spans the table. Rows of equal id are ordered by their text. Each text is shuffled once.
    """
    spark = docs.sparkSession
    ready = docs.select(F.col(ident).cast("long").alias("fp_id"), F.coalesce(F.col(text), F.lit("")).alias("fp_text"))
    parts = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)
    main = min(256, parts)
    found = ready.select(F.percentile_approx("fp_id", [i / main for i in range(1, main)], 20_000).alias("q"), F.min("fp_id").alias("low"), F.max("fp_id").alias("high")).first()
    bounds = sorted(set(found.q or []))
    bucket = _tree(F.col("fp_id"), bounds).cast("long")
    finer = -(-parts // main)
    if finer > 1 and bounds:
        # More ranges than quantiles: each stretch is cut evenly.
        edges = [found.low, *bounds, found.high + 1]
        low = F.element_at(F.array(*[F.lit(e) for e in edges]), (bucket + 1).cast("int"))
        high = F.element_at(F.array(*[F.lit(e) for e in edges]), (bucket + 2).cast("int"))
        bucket = bucket * finer + F.floor((F.col("fp_id") - low) * finer / F.greatest(high - low, F.lit(1)))
    bucket = F.when(F.col("fp_id").isNull(), F.lit(-1)).otherwise(bucket)
    firsts = ready.groupBy(bucket.alias("b")).agg(F.max("fp_id").alias("first")).orderBy(F.desc("b")).collect()
    ghosts = spark.createDataFrame([(firsts[i].b, firsts[(i + 1) % len(firsts)].first) for i in range(len(firsts))], "fp_bucket long, fp_first long")
    placed = ready.withColumn("fp_bucket", bucket).withColumn("fp_ghost", F.lit(0))
    copies = (ready.join(F.broadcast(ghosts), F.col("fp_id").eqNullSafe(F.col("fp_first")))
              .select("fp_id", "fp_text", "fp_bucket", F.lit(1).alias("fp_ghost")))
    order = Window.partitionBy("fp_bucket").orderBy("fp_ghost", F.col("fp_id").desc_nulls_last(), F.xxhash64("fp_text"), "fp_text")
    return (placed.unionByName(copies).withColumn("fp_next", F.lead("fp_text").over(order)).filter("fp_ghost = 0")
            .select("fp_id", "fp_text", "fp_next"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as many code points from the start of the following one."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - third), F.substr(following, F.lit(1), third))


def op8(docs: DataFrame) -> DataFrame:
    texts = with_next(docs, "doc_id", "text").withColumn("fp_edited", edited(F.col("fp_text"), F.col("fp_next")))
    digests = texts.select(F.col("fp_id").alias("doc_id"), F.length("fp_text").cast("long").alias("n_chars"), F.sha2("fp_edited", 256).alias("edited_sha256"),
                           "fp_text", "fp_edited", items(F.col("fp_text")).alias("fp_a"), items(F.col("fp_edited")).alias("fp_e"), items(F.col("fp_next")).alias("fp_n"))
    return digests.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("fp_text"), F.col("fp_a")).alias("fingerprint"),
                          fingerprint(F.col("fp_edited"), F.col("fp_e")).alias("edited_fingerprint"),
                          likeness(F.col("fp_a"), F.col("fp_e")).alias("near_edited"), likeness(F.col("fp_a"), F.col("fp_n")).alias("near_next"))
