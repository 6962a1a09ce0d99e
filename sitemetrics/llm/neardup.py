"""Near-duplicate documents by MinHash with sequential Bayesian verification.

A document is the set of its distinct 5-word shingles. Documents with equal sets are one class from the start. Signatures of BANDS * ROWS
minimum hashes are cut into bands; classes that agree in a band are candidates. A candidate pair is compared on batches of BATCH
hashes: after each batch the posterior of its similarity (uniform prior) tells the probability of reaching the threshold; the pair is pruned
when that falls below MISS. Survivors are verified exactly on the full sets, and links are joined to components.

No bucket is expanded into pairs. (1) Each band's bucket has one centre, drawn by a digest of band and class; every member is a candidate with it, so
a group of n copies gives n candidates a band. (2) Of its survivors each class verifies the best first, then the best between each two components.
(3) Buckets that still hold several components are settled in cells. A class outside a bucket's largest component meets every class of its buckets, in
bounded blocks: on signatures first, which leaves the classes with a survivor, then these on their full sets, where a cell gives out only links
that join components. A pair is compared where its rows lie, so rows grow with the classes, not with the pairs, and every candidate
between two components is settled in one round. Within a component no further link can change the result.

Defined cases: null texts and texts without words have no set and are linked with nothing; fewer than five words make one shingle of
the whole sequence; every row with a null id is one more document, with an output row of its own, linked like others; it is kept only where no document
of its component has an id, and of several such rows one is; rows that repeat an id are one document with the union of the rows' links, of which the row
with the largest set stands (of equal ones that of the smallest text digest); an empty table gives an empty result; further columns are not looked at.
"""

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.llm.common import blocks, discard, mix64, shingles_of, small_batches, stored, text_bytes, words_of

WORDS, PERCENT = 5, 75
#: A pair at the threshold shares none of 50 bands of 6 with a probability of 5.5e-5.
BANDS, ROWS = 50, 6
BATCH, COMPARED, MISS = 16, 128, 1e-6
#: Bytes of sets and classes of a block that meets others, and of those that it meets.
MEETING, MET, MOST = 2 << 20, 8 << 20, 512
#: Bytes of text turned into arrays at a time.
STEP = 1 << 19

_rng = np.random.default_rng(75)
_MUL = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def signature(shingles) -> np.ndarray:
    """Minimum hashes (uint32) of a set of 64-bit shingle hashes."""
    low = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 512):
        out = np.minimum(out, (low[a:a + 512, None] * _MUL[None, :] + _ADD[None, :]).min(axis=0))
    return out


def least_matches(threshold: float = PERCENT / 100, miss: float = MISS) -> np.ndarray:
    """For each number of compared hashes (a multiple of BATCH) the fewest matches whose posterior P(similarity >= threshold) reaches `miss`.

    With a uniform prior the posterior is Beta(matches + 1, misses + 1); its upper tail is a binomial sum.
    """
    out = []
    for n in range(BATCH, COMPARED + 1, BATCH):
        need = 0
        for m in range(n + 1):
            # P(Beta(m+1, n-m+1) > t) = P(Binomial(n+1, t) <= m)
            tail = sum(math.comb(n + 1, j) * threshold ** j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))
            if tail >= miss:
                need = m
                break
        out.append(need)
    return np.array(out)


def _surviving(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows that are never pruned, their matches) of two signature matrices, batch by batch."""
    need = least_matches_once()
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, k in enumerate(range(0, COMPARED, BATCH)):
        matches = matches + (a[alive, k:k + BATCH] == b[alive, k:k + BATCH]).sum(axis=1)
        on = matches >= need[i]
        alive, matches = alive[on], matches[on]
    return alive, matches


_need = None


def least_matches_once():
    global _need
    if _need is None:
        _need = least_matches()
    return _need


def _sketch_rows(batches):
    """(place, row_id, mark, n, set1, set2, bands, sig) of each row (place, text, row_id, mark)."""
    import pyarrow as pa
    for batch in batches:
        raw, offsets = text_bytes(batch.column(1))
        n, one, two, bands, sigs = [], [], [], [], []
        for a, b in blocks(offsets, STEP):
            words, first = words_of(raw[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
            for i in range(b - a):
                s = shingles_of(words[first[i]: first[i + 1]], WORDS)
                n.append(len(s))
                if not len(s):
                    one.append(0), two.append(0), bands.append(b""), sigs.append(b"")
                    continue
                one.append(int(np.bitwise_xor.reduce(s).view(np.int64)))
                two.append(int(mix64(s).sum(dtype=np.uint64).view(np.int64)))
                sig = signature(s)
                keys = np.zeros(BANDS, np.uint64)
                for r in range(ROWS):
                    keys = mix64(keys * np.uint64(31) + sig[r::ROWS].astype(np.uint64) + np.uint64(1))
                bands.append((keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).tobytes())
                sigs.append(sig[:COMPARED].astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()), pa.array(one, pa.int64()),
                                          pa.array(two, pa.int64()), pa.array(bands, pa.binary()), pa.array(sigs, pa.binary())],
                                         ["place", "row_id", "mark", "n", "set1", "set2", "bands", "sig"])


def _set_rows(batches):
    import pyarrow as pa
    for batch in batches:
        raw, offsets = text_bytes(batch.column(1))
        out = []
        for a, b in blocks(offsets, STEP):
            words, first = words_of(raw[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
            out += [shingles_of(words[first[i]: first[i + 1]], WORDS).tobytes() for i in range(b - a)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["rep", "members"])


def _explode_bands(batches):
    import pyarrow as pa
    for batch in batches:
        reps = batch.column(0).to_numpy(zero_copy_only=False)
        keys = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        size = np.array([len(k) for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(np.repeat(reps, size))], ["band", "rep"])


def _pruned(batches):
    """Pairs (x, y, sx, sy) that survive, with their matches."""
    import pyarrow as pa
    for batch in batches:
        if not batch.num_rows:
            continue
        sx, sy = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, COMPARED) for i in (2, 3))
        alive, matches = _surviving(sx, sy)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive)), pa.array(matches)], ["x", "y", "matches"])


def _verified(batches):
    """Pairs (x, y, mx, my) with 100 * intersection >= PERCENT * union."""
    import pyarrow as pa
    for batch in batches:
        keep = []
        for i, (mx, my) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            a, b = np.frombuffer(mx, np.uint64), np.frombuffer(my, np.uint64)
            small, large = (a, b) if len(a) < len(b) else (b, a)
            if 100 * len(small) < PERCENT * len(large):
                continue
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            common = int((large[at] == small).sum())
            if 100 * common >= PERCENT * (len(a) + len(b) - common):
                keep.append(i)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["x", "y"])


def verify(pairs: DataFrame, texts) -> DataFrame:
    """The pairs (x, y) whose full sets reach the threshold; `texts` gives (rep, text), one row each, of the wanted (rep)."""
    wanted = pairs.select(F.col("x").alias("rep")).union(pairs.select(F.col("y").alias("rep"))).distinct()
    sets = stored(texts(wanted).mapInArrow(_set_rows, "rep bigint, members binary"))
    links = stored(pairs.select("x", "y").join(sets.select(F.col("rep").alias("x"), F.col("members").alias("mx")), "x")
                   .join(sets.select(F.col("rep").alias("y"), F.col("members").alias("my")), "y")
                   .select("x", "y", "mx", "my").mapInArrow(_verified, "x bigint, y bigint"))
    discard(sets)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the edges. Rounds of large-star and small-star, each stored."""
    def both(e):
        return e.select(F.col("u"), F.col("v")).union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    e = stored(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct())
    while True:
        around = both(e)
        low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        after = stored(small)
        # Settled when every edge leads to a root: no node above is below as well, or has two roots.
        ends = after.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(after.select("v", F.lit(0), F.lit(1)))
        sides = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if sides.filter("up > 1 or up > 0 and down > 0").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).union(after.select("v", "v").distinct())
        discard(e)
        e = after


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links (x, y): only the roots that the links connect go through the rounds, then the nodes below them follow."""
    def root_of(end):
        return comps.select(F.col("node").alias(end), F.col("root").alias("r" + end))
    between = (links.select("x", "y").join(root_of("x"), "x", "left").join(root_of("y"), "y", "left")
               .select(F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y")))
    now = components(between)
    below = (comps.join(now.select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left")
             .select("node", F.coalesce("now", "root").alias("root")))
    return stored(below.union(now.join(comps.select("node"), "node", "left_anti").select("node", "root")))


class _Block:
    """Classes of a cell that meet others, and the components they lie in."""

    def __init__(self, rows, exact):
        self.reps = np.array([r[0] for r in rows], np.int64)
        self.label = np.array([r[1] for r in rows], np.int64)
        self.sig = np.frombuffer(b"".join(r[2] for r in rows), np.uint16).reshape(-1, COMPARED)
        self.flagged = np.zeros(len(rows), bool)
        self.now = {}
        if exact:
            sets = [np.frombuffer(r[3], np.uint64) for r in rows]
            self.size = np.array([len(x) for x in sets])
            every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
            order = np.argsort(every, kind="stable")
            self.every, self.owner = every[order], owner[order]

    def component(self, c):
        while c in self.now:
            c = self.now[c]
        return c

    def survivors(self, rep, component, sig):
        """Classes of other components that are not pruned."""
        need = least_matches_once()
        other = np.flatnonzero((self.label != component) & (self.reps != rep))
        matches = np.zeros(len(other), np.int64)
        for b, k in enumerate(range(0, COMPARED, BATCH)):
            if not len(other):
                break
            matches = matches + (self.sig[other, k:k + BATCH] == sig[k:k + BATCH]).sum(axis=1)
            on = matches >= need[b]
            other, matches = other[on], matches[on]
        return other

    def links(self, rep, component, sig, members):
        """Links of a class that join components; they are one component from then on."""
        component = self.component(component)
        other = self.survivors(rep, component, sig)
        if not len(other):
            return []
        # Common shingles with all classes of the block at once.
        first, last = np.searchsorted(self.every, members), np.searchsorted(self.every, members, "right")
        size = last - first
        at = np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        common = np.bincount(self.owner[at], minlength=len(self.reps))[other]
        out = []
        for j in other[100 * common >= PERCENT * (len(members) + self.size[other] - common)]:
            if self.label[j] != component:
                old, component = component, int(self.label[j])
                self.now[old] = component
                self.label[self.label == old] = component
                out.append((int(min(rep, self.reps[j])), int(max(rep, self.reps[j]))))
        return out


def _meet(exact: bool):
    """Over rows (grp, part, piece, side, rep, comp, sig[, members]) sorted by cell and side: a cell's side 0 is held, its side 1 passes by.

    Inexact: the rows (grp, part, piece, rep) of both sides that have a survivor. Exact: links (x, y)."""
    def run(batches):
        import pyarrow as pa
        key, waiting, block, out = None, [], None, []

        def close():
            if block is not None and not exact:
                out.extend((*key, int(r)) for r in block.reps[block.flagged])

        def batch_of():
            names = ["x", "y"] if exact else ["grp", "part", "piece", "rep"]
            made = pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(len(names))], names)
            out.clear()
            return made
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for row in zip(*cols):
                if row[:3] != key:
                    close()
                    key, waiting, block = row[:3], [], None
                if row[3] == 0:
                    waiting.append(row[4:])
                    continue
                if block is None:
                    if not waiting:
                        continue
                    block, waiting = _Block(waiting, exact), []
                sig = np.frombuffer(row[6], np.uint16)
                if exact:
                    out.extend(block.links(row[4], row[5], sig, np.frombuffer(row[7], np.uint64)))
                else:
                    found = block.survivors(row[4], row[5], sig)
                    if len(found):
                        block.flagged[found] = True
                        out.append((*key, row[4]))
            yield batch_of()
        close()
        yield batch_of()
    return run


def _cells(shared: DataFrame, comps: DataFrame, sizes: DataFrame) -> DataFrame:
    """(grp, part, piece, side, rep, comp) of the buckets that hold several components; `sizes`: rep, n.

    Side 0 are the classes outside their bucket's largest component, in blocks (grp, part); side 1 is all that shares a bucket with
    a class of the block, each once, in pieces."""
    marked = shared.join(comps.select(F.col("node").alias("rep"), "root"), "rep", "left").select("band", "rep", F.coalesce("root", "rep").alias("comp"))
    held = marked.groupBy("band", "comp").agg(F.count("*").alias("k"))
    mixed = (held.groupBy("band").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1").select("band", "main"))
    marked = stored(marked.join(mixed, "band"))
    outside = marked.filter("comp <> main")
    home = outside.groupBy("rep").agg(F.min("main").alias("grp"), F.first("comp").alias("comp")).join(sizes, "rep")
    bytes_ = F.sum(F.col("n") * 8)
    parts = home.groupBy("grp").agg(F.ceil(F.greatest(F.count("*") / MOST, bytes_ / MEETING)).alias("parts"))
    home = stored(home.join(parts, "grp").select("grp", F.pmod(F.xxhash64("rep"), "parts").alias("part"), "rep", "comp"))
    reached = outside.select("band", "rep").join(home.select("rep", "grp", "part"), "rep").select("band", "grp", "part").distinct()
    met = stored(reached.join(marked.select("band", "rep", "comp"), "band").select("grp", "part", "rep", "comp").distinct().join(sizes, "rep"))
    pieces = met.groupBy("grp", "part").agg(F.ceil(bytes_ / MET).alias("pieces"))
    passing = met.join(pieces, ["grp", "part"]).select("grp", "part", F.pmod(F.xxhash64("rep"), "pieces").alias("piece"), F.lit(1).alias("side"), "rep", "comp")
    holding = home.join(pieces, ["grp", "part"]).select("grp", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"),
                                                         F.lit(0).alias("side"), "rep", "comp")
    rows = stored(holding.unionByName(passing))
    discard(marked, home, met)
    return rows


def _settled(shared: DataFrame, comps: DataFrame, sigs: DataFrame, sizes: DataFrame, texts) -> DataFrame:
    """Links (x, y) that join all components between which a bucket holds a link."""
    cell = ["grp", "part", "piece"]

    def dealt(rows):
        return rows.repartition(*cell).sortWithinPartitions(*cell, "side", "rep")
    rows = _cells(shared, comps, sizes)
    near = dealt(rows.join(sigs.select("rep", "sig"), "rep").select(*cell, "side", "rep", "comp", "sig"))
    flagged = stored(near.mapInArrow(_meet(False), "grp bigint, part bigint, piece bigint, rep bigint").distinct())
    if flagged.isEmpty():
        links = flagged.select(F.col("rep").alias("x"), F.col("rep").alias("y"))
    else:
        sets = texts(flagged.select("rep").distinct()).mapInArrow(_set_rows, "rep bigint, members binary")
        full = rows.join(flagged, [*cell, "rep"], "left_semi").join(sigs.select("rep", "sig"), "rep").join(sets, "rep")
        links = dealt(full.select(*cell, "side", "rep", "comp", "sig", "members")).mapInArrow(_meet(True), "x bigint, y bigint")
    links = stored(links.distinct())
    discard(rows, flagged)
    return links


def _mark(text: str):
    """Digest that tells the texts of an id apart."""
    return F.coalesce(F.md5(F.col(text).cast("binary")), F.lit(""))


def _linked(docs: DataFrame, ident: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(row_id, mark, n, copies, place, root, component), one row per id and text, and the places of the rows without an id (place, mark, n).

    The component is its smallest id, null where no member has one; a text without a set has no root."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(ident).cast("long").alias("row_id"), F.col(text).alias("text"), _mark(text).alias("mark"))
    # The place is a row's own key: it is told once and stored, so that repeated and null ids stay apart.
    sketched = stored(rows.select(F.monotonically_increasing_id().alias("place"), "text", "row_id", "mark").mapInArrow(
        _sketch_rows, "place bigint, row_id bigint, mark string, n bigint, set1 bigint, set2 bigint, bands binary, sig binary"))
    kinds = stored(sketched.groupBy("row_id", "mark", "n", "set1", "set2").agg(F.count("*").alias("copies"), F.min("place").alias("place")))
    filled = sketched.filter("n > 0")
    # Equal sets: one class, its representative the row of the smallest place.
    reps = stored(filled.groupBy("set1", "set2", "n").agg(F.min("place").alias("rep"), F.min("row_id").alias("least")))
    member = stored(kinds.filter("n > 0").join(reps.select("set1", "set2", "n", "rep"), ["set1", "set2", "n"]).select("row_id", "mark", "n", "copies", "place", "rep"))
    one = filled.withColumnRenamed("place", "rep").join(reps.select("rep"), "rep", "left_semi")
    sigs = stored(one.select("rep", "sig", "row_id", "mark"))
    bands = one.select("rep", "bands").mapInArrow(_explode_bands, "band bigint, rep bigint")
    several = member.filter("copies > 1").limit(1).count() > 0

    def texts(wanted):
        from_row = sigs.join(wanted, "rep").select("rep", F.col("row_id").alias("own_id"), F.col("mark").alias("own_mark"))
        found = rows.join(from_row, F.col("row_id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark"))).select("rep", "text")
        return found.groupBy("rep").agg(F.first("text").alias("text")) if several else found
    draw = F.xxhash64("band", "rep")
    centres = bands.groupBy("band").agg(F.min_by("rep", draw).alias("centre"), F.count("*").alias("size")).filter("size > 1")
    shared = stored(bands.join(centres, "band").select("band", "rep", "centre", "size").distinct())
    # The texts that anything is compared with are fetched once.
    held = stored(texts(shared.select("rep").distinct()))

    def held_texts(wanted):
        return held.join(wanted, "rep")

    def prune(pairs):
        met = (pairs.join(sigs.select(F.col("rep").alias("x"), F.col("sig").alias("sx")), "x").join(sigs.select(F.col("rep").alias("y"), F.col("sig").alias("sy")), "y")
               .select("x", "y", "sx", "sy"))
        return met.mapInArrow(_pruned, "x bigint, y bigint, matches bigint")
    arms = shared.filter("rep <> centre").select(F.least("rep", "centre").alias("x"), F.greatest("rep", "centre").alias("y"), "size")
    stars = stored(prune(arms.select("x", "y").distinct()))
    best = F.max_by(F.struct("x", "y"), F.struct("matches", (-F.col("x")).alias("a"), (-F.col("y")).alias("b"))).alias("p")
    # Each class its strongest survivor, in both directions.
    ends = stars.select(F.col("x").alias("own"), "x", "y", "matches").union(stars.select(F.col("y").alias("own"), "x", "y", "matches"))
    first = stored(ends.groupBy("own").agg(best).select("p.x", "p.y").distinct())
    comps = components(verify(first, held_texts))

    def apart(pairs):
        """Pairs whose ends are in different components, with these."""
        left, right = comps.select(F.col("node").alias("x"), F.col("root").alias("rx")), comps.select(F.col("node").alias("y"), F.col("root").alias("ry"))
        found = pairs.join(left, "x", "left").join(right, "y", "left").withColumn("rx", F.coalesce("rx", "x")).withColumn("ry", F.coalesce("ry", "y"))
        return found.filter("rx <> ry").select("x", "y", "matches", F.least("rx", "ry").alias("a"), F.greatest("rx", "ry").alias("b"))
    # Then the strongest pair between two components, and the arms of buckets of two, which have no other pair.
    left = apart(stars.join(first, ["x", "y"], "left_anti"))
    twos = arms.filter("size = 2").select("x", "y").distinct()
    rest = left.groupBy("a", "b").agg(best).select("p.x", "p.y").union(left.join(twos, ["x", "y"], "left_semi").select("x", "y")).distinct()
    comps = _more(comps, rest, held_texts)
    found = _settled(shared.filter("size > 2").select("band", "rep"), comps, sigs, reps.select("rep", "n"), held_texts)
    if not found.isEmpty():
        comps = joined(comps, found)
    known = member.filter("row_id is not null")
    discard(shared, held, stars, first)
    repeated = known.groupBy("row_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b")
    if repeated.limit(1).count():
        # Ids whose rows have different sets join the classes of these.
        comps = joined(comps, known.join(repeated, "row_id").filter("rep <> a").select(F.col("a").alias("x"), F.col("rep").alias("y")))
    roots = reps.select("rep", "least").join(comps.select(F.col("node").alias("rep"), "root"), "rep", "left").select("rep", "least", F.coalesce("root", "rep").alias("root"))
    named = roots.groupBy("root").agg(F.min("least").alias("component"))
    linked = member.join(roots.select("rep", "root").join(named, "root"), "rep").select("row_id", "mark", "n", "copies", "place", "root", "component")
    bare = kinds.filter("n = 0").select("row_id", "mark", "n", "copies", "place", F.lit(None).cast("long").alias("root"), F.lit(None).cast("long").alias("component"))
    return stored(linked.union(bare)), sketched.filter("row_id is null").select("place", "mark", "n")


def _nameless(linked: DataFrame) -> DataFrame:
    """Of each component without an id the text that is kept: (root, mark)."""
    return (linked.filter("row_id is null and n > 0 and component is null").groupBy("root")
            .agg(F.min(F.struct((-F.col("n")).alias("n"), "mark")).alias("first")).select("root", "first.mark"))


def classes(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_id, n, component, kept): one row per id, and one per row without an id, with the size of its set and the smallest id of its component."""
    linked, nameless = _linked(docs, ident, text)
    ids = (linked.filter("row_id is not null").groupBy("row_id").agg(F.max("n").alias("n"), F.min("component").alias("component"))
           .select("row_id", "n", F.coalesce("component", "row_id").alias("component")).withColumn("kept", F.col("row_id") == F.col("component")))
    chosen = _nameless(linked).withColumn("first", F.lit(True))
    told = (linked.filter("row_id is null and n > 0").join(chosen, ["root", "mark"], "left")
            .select("mark", "component", F.when(F.col("first"), F.col("place")).alias("stays")))
    none = F.lit(None).cast("long")
    rest = nameless.filter("n > 0").join(told, "mark").select(none.alias("row_id"), "n", "component", F.coalesce(F.col("place") == F.col("stays"), F.lit(False)).alias("kept"))
    bare = nameless.filter("n = 0").select(none.alias("row_id"), "n", none.alias("component"), F.lit(True).alias("kept"))
    return ids.union(rest).union(bare)


def _more(comps: DataFrame, pairs: DataFrame, texts) -> DataFrame:
    """Components after the pairs were verified; the same ones where there is no pair."""
    pairs = stored(pairs)
    if not pairs.limit(1).count():
        return comps
    return joined(comps, verify(pairs, texts))


def keep_first(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that of its smallest id, or one without an id where none has one; rows without an id and a set all stay."""
    linked, _ = _linked(docs, ident, text)
    ids = (linked.filter("row_id is not null").groupBy("row_id").agg(F.min("component").alias("component"),
                                                                     F.min(F.struct((-F.col("n")).alias("n"), "mark", "copies")).alias("first"))
           .filter("component is null or component = row_id").select("row_id", "first.mark", "first.copies"))
    rest = linked.filter("row_id is null and n > 0").join(_nameless(linked), ["root", "mark"], "left_semi").select("row_id", "mark", "copies")
    # Rows without an id and a set are told by copies 0: each of them stays.
    bare = linked.filter("row_id is null and n = 0").select("row_id", "mark", F.lit(0).cast("long").alias("copies"))
    kept = stored(ids.union(rest).union(bare).select(F.col("row_id").alias("__id"), F.col("mark").alias("__mark"), F.col("copies").alias("__copies")))
    found = docs.join(kept, F.col(ident).cast("long").eqNullSafe(F.col("__id")) & (_mark(text) == F.col("__mark")))
    own = ["__id", "__mark", "__copies"]
    if not kept.filter("__copies > 1").limit(1).count():
        return found.drop(*own)
    # Rows equal in id and text: one of them, by a digest of the row.
    order = F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in docs.columns])
    single = (found.filter("__copies > 1").groupBy("__id", "__mark").agg(F.min_by(F.struct(*docs.columns), order).alias("__row"))
              .select(*[F.col("__row")[c].alias(c) for c in docs.columns]))
    return found.filter("__copies < 2").drop(*own).unionByName(single)


def op1(docs: DataFrame) -> DataFrame:
    return classes(docs.select("doc_id", "text")).select(F.col("row_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")
