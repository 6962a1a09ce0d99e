"""Exact top-k by inner product: a Voronoi kNN join.

Vectors are quantised to integers, floor(SCALE * x). Pivots, vectors drawn by a digest of their components, divide queries and data
into cells; their number grows with the square root of the rows, from LEAST_PIVOTS to PIVOTS. From one summary row per cell (rows, radius around the pivot,
least and greatest norm) each group of queries gets a lower bound of its k-th score and each data cell an upper bound of its scores for the group; a cell is
replicated to a group only if its upper bound reaches the group's lower bound. With q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 the bounds follow from the triangle
inequality, |q - x| lying between d(pivots) - radii and d(pivots) + radii. Groups and cells travel as blocks of bounded size, and the blocks of a
cell are dealt to parts of PART blocks; block pairs are solved with one matrix product each, a task keeps the best k of each of its queries, and the last step
merges them per query. Products are exact: in doubles where all sums stay below 2^53, else in 64-bit integers.

Only the summaries (at most PIVOTS rows each) reach the driver, and only tables of that size, or of pairs of them, are broadcast.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do those with a component of 2^52 or more, whose products no long holds;
scores beyond a long are its greatest or least value; vectors of different lengths have no product, so queries meet the vectors of their own length, length by length;
ties in score go to the smaller id; rows that repeat an id are candidates of their own, except that a query never meets rows of its own id
and equal rows are one query; null ids take no part; fewer candidates than k give fewer rows; an empty table gives an empty result; further columns are ignored.
"""

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitemetrics.llm.common import cut

SCALE, LEAST_PIVOTS, PIVOTS, BLOCK_ROWS, PART, K = 1024, 64, 1024, 2048, 16, 10


def usable(vectors: DataFrame, ident="vec_id", vector="embedding") -> DataFrame:
    """(id, v array<double>) with integer components, of the vectors that take part."""
    v = F.col(vector)
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(1 << 52))), F.lit(False))
    return (vectors.filter(fine & F.col(ident).isNotNull())
            .select(F.col(ident).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v")))


def _matrix(column):
    import pyarrow as pa
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _nearest(m, pivots):
    """(cell, squared distance) of each row; ties go to the first pivot. Some rows at a time: the distances to all pivots are formed."""
    cells, found = [], []
    own = (pivots * pivots).sum(axis=1)[None, :]
    for a in range(0, len(m), 4096):
        part = m[a:a + 4096]
        d = (part * part).sum(axis=1)[:, None] + own - 2.0 * (part @ pivots.T)
        cells.append(d.argmin(axis=1))
        # Formed again from the difference: the sum above may cancel, and the radius must not be too small.
        found.append(((part - pivots[cells[-1]]) ** 2).sum(axis=1))
    return np.concatenate(cells), np.concatenate(found)


def _blocked(rows: DataFrame, pivots) -> DataFrame:
    """(cell, n, radius2, low2, high2, ids, values): blocks of at most BLOCK_ROWS rows of a cell, with their summary."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        import pyarrow as pa
        held: dict[int, list] = {}

        def block(cell):
            ids = np.concatenate([x[0] for x in held[cell]])
            m = np.concatenate([x[1] for x in held[cell]])
            d2 = np.concatenate([x[2] for x in held[cell]])
            norm = (m * m).sum(axis=1)
            held[cell] = []
            return (cell, len(ids), float(d2.max()), float(norm.min()), float(norm.max()), ids.tobytes(), m.astype(np.float32 if np.abs(m).max() < 1 << 24 else np.float64).tobytes())

        def out(found):
            kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
            names = ["cell", "n", "radius2", "low2", "high2", "ids", "vals"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)], names)
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            cell, d2 = _nearest(m, shared.value)
            for c in np.unique(cell).tolist():
                mine = cell == c
                held.setdefault(c, []).append((ids[mine], m[mine], np.maximum(d2[mine], 0)))
                if sum(len(x[0]) for x in held[c]) >= BLOCK_ROWS:
                    yield out([block(c)])
        rest = [block(c) for c in sorted(held) if held[c]]
        if rest:
            yield out(rest)
    return rows.mapInArrow(run, "cell int, n bigint, radius2 double, low2 double, high2 double, ids binary, vals binary")


def _summary(blocks: DataFrame):
    """Arrays (cell, n, radius, low2, high2, blocks) over the cells that have rows."""
    found = (blocks.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius2").alias("radius2"), F.min("low2").alias("low2"),
                                        F.max("high2").alias("high2"), F.count("*").alias("blocks")).orderBy("cell").collect())
    column = {c: np.array([r[c] for r in found], float) for c in ("n", "radius2", "low2", "high2")}
    return np.array([r["cell"] for r in found], int), column["n"], np.sqrt(column["radius2"]) * (1 + 1e-12), column["low2"], column["high2"], [r["blocks"] for r in found]


def needed(pivots, groups, cells, k):
    """{group: data cells that may hold one of its k best}, from the summaries alone; k counts the rows that the query must not meet, too."""
    out = {}
    c_cell, n, rc, c_low, c_high, _ = cells
    for g, rg, g_low, g_high in zip(groups[0], *groups[2:5]):
        d = np.sqrt(((pivots[c_cell] - pivots[g]) ** 2).sum(axis=1))
        most = np.sqrt(g_high * c_high)
        low = np.maximum((g_low + c_low - (d + rg + rc) ** 2) / 2, -most)
        high = np.minimum((g_high + c_high - np.maximum(0.0, d - rg - rc) ** 2) / 2, most)
        order = np.argsort(-low, kind="stable")
        enough = np.flatnonzero(np.cumsum(n[order]) >= k)
        floor = low[order[enough[0]]] if len(enough) else -np.inf
        # The bounds are sums of squares in doubles; the slack is far above their rounding.
        slack = 1e-9 * (g_high + c_high + (d + rg + rc) ** 2) + 1e-6
        out[int(g)] = c_cell[high + slack >= floor - slack].tolist() if np.isfinite(floor) else c_cell.tolist()
    return out


def _solve(k):
    def run(batches):
        import pyarrow as pa
        best: dict[int, list] = {}   # query -> [(score, id)], at most k

        def flush():
            rows = [(q, s, i) for q, found in best.items() for s, i in found]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                               pa.array([r[2] for r in rows], pa.int64())], ["query_id", "score", "vec_id"])

        def values(raw, n, width):
            return np.frombuffer(raw, np.float32 if len(raw) == n * width * 4 else np.float64).reshape(n, width).astype(np.float64)

        def products(q, x):
            """Scores as int64; the least value marks nothing yet."""
            about = q @ x.T
            if np.sqrt((q * q).sum(axis=1).max() * (x * x).sum(axis=1).max()) < float(1 << 53):
                return about.astype(np.int64)
            # Sums wrap around, which leaves them right wherever the result fits a long; beyond it the doubles tell the sign.
            exact = q.astype(np.int64) @ x.astype(np.int64).T
            exact[about >= 2.0 ** 63] = (1 << 63) - 1
            exact[about <= -2.0 ** 63] = -(1 << 63) + 1
            return exact
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                scores = products(values(row["q_vals"], len(q_ids), row["width"]), values(row["vals"], len(ids), row["width"]))
                own_row = q_ids[:, None] == ids[None, :]
                scores[own_row] = np.iinfo(np.int64).min
                for i, own in enumerate(q_ids.tolist()):
                    line = scores[i]
                    take = np.arange(len(ids))
                    if len(ids) > k:
                        edge = np.partition(line, len(ids) - k)[len(ids) - k]
                        take = np.flatnonzero(line >= edge)
                    take = take[np.lexsort((ids[take], ~line[take]))[:k]]
                    found = [(int(line[j]), int(ids[j])) for j in take.tolist() if not own_row[i, j]]
                    merged = sorted(best.get(own, []) + found, key=lambda x: (-x[0], x[1]))
                    best[own] = merged[:k]
                if len(best) > 20_000:
                    yield flush()
        yield flush()
    return run


SCHEMA = "query_id bigint, rank int, vec_id bigint, score bigint"


def top_k(vectors: DataFrame, is_query, k: int = K, pivots: int | None = None, ident="vec_id", vector="embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows of every row for which the condition over `id` holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, ident, vector)
    shapes = rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()   # one row a length
    parts = [_of_length(rows.filter(F.size("v") == s["d"]), is_query, k, s["d"], s["count"], pivots) for s in shapes]
    parts = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)


def _of_length(rows: DataFrame, is_query, k: int, width: int, count: int, pivots: int | None) -> DataFrame | None:
    spark = rows.sparkSession
    pivots = pivots or int(min(PIVOTS, max(LEAST_PIVOTS, count ** 0.5 / 8)))
    # Pivots are the vectors of lowest digest; a hot vector can fill one pivot only. The edge leaves a multiple of them to sort.
    share = min(1.0, 16.0 * pivots / count)
    edge = int((share - 0.5) * float(1 << 64)) if share < 1 else (1 << 63) - 1
    low = rows.withColumn("place", F.xxhash64(F.lit("pivot"), "v")).filter(F.col("place") <= edge)
    drawn = low.groupBy("place").agg(F.first("v").alias("v")).orderBy("place").limit(pivots).collect()
    if not drawn:   # few distinct vectors, none below the edge
        drawn = rows.select("v").limit(1).collect()
    centres = np.unique(np.array([r.v for r in drawn], float), axis=0)
    asked = rows.filter(is_query)
    repeats = asked.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if repeats is None:
        return None
    data = cut(_blocked(rows, centres))
    queries = cut(_blocked(asked.dropDuplicates(["id", "v"]), centres))
    cells, groups = _summary(data), _summary(queries)
    # A query meets none of its own rows, of which there may be as many as any query id has.
    found = needed(centres, groups, cells, k + repeats)
    pairs = spark.createDataFrame([(g, c) for g, near in found.items() for c in near], "g int, c int")
    # Blocks of a large cell are dealt to several parts, each met by the queries of its own.
    n_parts = -(-max(cells[5]) // PART)
    met = (queries.select(F.col("cell").alias("g"), F.col("ids").alias("q_ids"), F.col("vals").alias("q_vals"))
           .join(F.broadcast(pairs), "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
           .join(data.select(F.col("cell").alias("c"), F.pmod(F.xxhash64("ids"), F.lit(n_parts)).cast("int").alias("part"), "ids", "vals"), ["c", "part"])
           .select("q_ids", "q_vals", "ids", "vals", F.lit(width).alias("width")))
    best = met.mapInArrow(_solve(k), "query_id bigint, score bigint, vec_id bigint")
    # Equal queries of one id give their rows once; different vectors of one id are one query, whose best rows count.
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op7(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, F.col("id") % 100 == 0)


OP7_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
           where embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
      from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""
