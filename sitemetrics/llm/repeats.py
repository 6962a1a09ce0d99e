"""Passages that repeat: longest-previous-factor arrays over suffix arrays of bounded blocks.

Every string of LENGTH bytes has an anchor: the k-mer of lowest hash in it. Equal strings have equal anchors at equal places, so only
occurrences with the same anchor need to meet. An occurrence of an anchor stands for the strings that chose it, a stretch of the text
around it. Anchors that occur once are done: they are counted on their hash alone, and only rows of repeated ones are formed. Stretches that are equal as a
whole form a class: all its members repeat, and its first occurrence represents it. Classes of one anchor meet in blocks: their stretches are put one behind
the other, and a suffix array over them is built by prefix doubling (ranks of 8, 16, ... bytes). Previous and next smaller positions in suffix order, with the least
common prefix on the way there, give each position's longest previous factor (up to LENGTH); it is a later copy if that reaches LENGTH. Positions are
ordered by document id and offset, so "earlier copies" are the same in every block.

An anchor with more than CLASSES classes would not fit a block. Its stretches are cut into SLICES slices of neighbouring strings; the strings of a
slice share all but a few outer bytes, and equal strings lie in slices with equal shared bytes, so slices meet by these as smaller anchors do, and
most meet none. Slices of one such key that are still too many are met string by string, by the digest of each.

`spans` gives the spans of later copies (keeping the first) or of all copies. Texts are compared as UTF-8 bytes; matches do not cross documents.

Defined cases: null and empty texts have no bytes; texts shorter than LENGTH have no match; rows that repeat an id are documents of their
own, ordered by their text's digest; rows equal in id and text repeat each other as a whole, one of them being the first; an empty table gives an empty result.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.llm.common import byte_values, discard, mix64, powers, small_batches, stored, text_bytes

LENGTH, K, CLASSES, SLICES = 200, 32, 16_000, 8
WIDTH = LENGTH - K + 1
#: Bits of the number of strings of a stretch (at most WIDTH), kept beside the first one.
SPAN = 9
#: Bytes of stretches that one suffix array covers.
BLOCK_BYTES = 1 << 20
#: Texts are read in pieces of this many bytes, which overlap.
PIECE = 1 << 22
_LOW = np.uint64((1 << 23) - 1)


def _window_min(values):
    """Minimum over each window of WIDTH values, by blocks of that width."""
    n = len(values)
    padded = np.full(-(-n // WIDTH) * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, WIDTH)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - WIDTH + 1], ahead[WIDTH - 1: n])


def anchors(raw):
    """(hash, first string, last string, digest of the stretch) of the anchors of a text of at least LENGTH bytes."""
    parts = []
    for begin in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
        piece = raw[begin: begin + PIECE + LENGTH - 1]
        n = len(piece)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(byte_values(piece) * powers("up", n))])
        down = powers("down", n)
        grams = mix64((sums[K:] - sums[:-K]) * down[: n - K + 1])
        places = np.arange(len(grams), dtype=np.uint64)
        chosen = _window_min((grams & ~_LOW) | places) & _LOW
        edge = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        last = np.concatenate([edge[1:], [len(chosen)]]) - 1
        at = chosen[edge].astype(np.int64)
        size = last - edge + LENGTH
        digest = mix64((sums[edge + size] - sums[edge]) * down[edge] + mix64((size * 1024 + at - edge).astype(np.uint64)))
        parts.append((grams[at], edge + begin, last + begin, digest))
    return [np.concatenate(x) for x in zip(*parts)]


def _anchor_hashes(batches):
    """(h, n) of the anchors of a batch."""
    import pyarrow as pa
    for batch in batches:
        raw, offsets = text_bytes(batch.column(0))
        found = [anchors(raw[a:b])[0] for a, b in zip(offsets[:-1], offsets[1:]) if b - a >= LENGTH]
        h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])


def _anchor_rows(batches):
    import pyarrow as pa
    names = ["h", "digest", "row_id", "tie", "span"]
    for batch in batches:
        raw, offsets = text_bytes(batch.column(1))
        ids, ties = batch.column(0), batch.column(2)
        found, which = [], []
        for i in range(len(offsets) - 1):
            if offsets[i + 1] - offsets[i] >= LENGTH:
                rows = anchors(raw[offsets[i]: offsets[i + 1]])
                found.append(rows)
                which.append(np.full(len(rows[0]), i))
        if found:
            h, lo, hi, digest = [np.concatenate(x) for x in zip(*found)]
            take = pa.array(np.concatenate(which))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(digest.view(np.int64)), ids.take(take), ties.take(take), pa.array(lo << SPAN | (hi - lo))], names)


def suffix_order(data: np.ndarray, starts: np.ndarray):
    """Order of the starts by their LENGTH bytes in `data`, and the common prefix (up to LENGTH) of each with the one before it in that order.

    Prefix doubling: ranks of all places by 8 bytes, then by 16 to 128, then of the starts by LENGTH = 128 + 72 bytes. The ranks of all
    sizes then give the common prefixes, largest size first.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(2 * LENGTH, np.uint8)])
    key = np.zeros(n + LENGTH, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j: j + n + LENGTH].astype(np.uint64)
    rank = np.unique(key, return_inverse=True)[1].astype(np.int32)
    ranks, size = {8: rank}, 8
    while size < 128:
        pair = (rank[:-size].astype(np.int64) << 32) | rank[size:]
        head = np.unique(pair, return_inverse=True)[1].astype(np.int32)
        rank = np.concatenate([head, np.full(size, -1, np.int32)])
        size *= 2
        ranks[size] = rank
    last = (rank[starts].astype(np.int64) << 32) | rank[starts + LENGTH - 128]
    order = np.argsort(last, kind="stable")
    there = starts[order]
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        a, b, same = there[1:], there[:-1], common[1:]
        whole = last[order][1:] == last[order][:-1]
        for size in (128, 64, 32, 16, 8):
            fits = same + size <= LENGTH
            same += np.where(fits & (ranks[size][np.minimum(a + same, n + LENGTH - 1)] == ranks[size][np.minimum(b + same, n + LENGTH - 1)]), size, 0)
        on = np.ones(len(same), bool)
        for _ in range(7):
            on &= (same < LENGTH) & (padded[np.minimum(a + same, n + LENGTH)] == padded[np.minimum(b + same, n + LENGTH)])
            same += on
        same[whole] = LENGTH
        same[~whole] = np.minimum(same[~whole], LENGTH - 1)
    return order, common


def smaller(position: np.ndarray, common: np.ndarray):
    """For each place in suffix order the common prefix with the nearest place before it whose position is smaller (0 where there is none).

    All places follow their pointers at once: everything between a place and its pointer has larger positions than the place, so a pointer to a larger
    position is replaced by that position's pointer, and the least common prefix on the way is kept."""
    n = len(position)
    to, least = np.arange(n) - 1, common.copy()
    active = np.arange(1, n)
    while len(active):
        active = active[(to[active] >= 0) & (position[to[active]] > position[active])]
        at = to[active]
        hop, low = to[at], np.minimum(least[active], least[at])   # all from the state before this step
        to[active], least[active] = hop, low
    least[to < 0] = 0
    return least


def previous_factors(position: np.ndarray, common: np.ndarray):
    """Longest previous factor (up to LENGTH) of each place in suffix order: the longest prefix shared with a smaller position."""
    if not len(position):
        return common
    behind = smaller(position[::-1], np.append(common[1:], 0)[::-1])[::-1]
    return np.maximum(smaller(position, common), behind)


def _block_rows(batches):
    """Stretches (h, row_id, tie, lo, bytes, n), sorted by h -> (row_id, tie, lo, hi, earlier) of strings with an equal one elsewhere."""
    import pyarrow as pa
    held, size, last = [], 0, None

    def solve():
        data = np.frombuffer(b"".join(h[3] for h in held), np.uint8)
        lengths = np.array([len(h[3]) for h in held])
        begin = np.cumsum(lengths) - lengths
        strings = lengths - LENGTH + 1
        of = np.repeat(np.arange(len(held)), strings)
        within = np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings, strings)
        # Stretches in the order of their documents, so that comparing numbers compares positions.
        places = np.array(sorted(range(len(held)), key=lambda i: held[i][:3]))
        number = np.empty(len(held), np.int64)
        number[places] = np.arange(len(held))
        order, common = suffix_order(data, begin[of] + within)
        position = (number[of] << SPAN) + within
        factor = previous_factors(position[order], common)
        again = (common >= LENGTH) | np.append(common[1:] >= LENGTH, False)
        hit, earlier = np.zeros(len(of), bool), np.zeros(len(of), bool)
        hit[order], earlier[order] = again, factor >= LENGTH
        rows = []
        for flag, value in ((hit & ~earlier, False), (earlier, True)):
            at = np.flatnonzero(flag)
            if len(at):
                new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]])])
                head = np.flatnonzero(new)
                tail = np.concatenate([head[1:], [len(at)]]) - 1
                for a, b in zip(at[head], at[tail]):
                    i, ident, tie, lo = of[a], *held[of[a]][:3]
                    rows.append((held[i][4], held[i][5], int(lo + within[a]), int(lo + within[b]), value))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                                           pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.bool_())], ["row_id", "tie", "lo", "hi", "earlier"])
    for batch in batches:
        for row in batch.to_pylist():
            if row["h"] != last and size >= BLOCK_BYTES:
                yield solve()
                held, size = [], 0
            last = row["h"]
            order = (row["row_id"] is None, row["row_id"] or 0)
            held.append((order, row["tie"], row["lo"], row["body"], row["row_id"], row["tie"]))
            size += len(row["body"])
    if held:
        yield solve()


def _bodies(batches):
    """(row_id, tie, text, list of (h, lo, hi)) -> the stretches."""
    import pyarrow as pa
    for batch in batches:
        raw, offsets = text_bytes(batch.column("text"))
        rows = []
        for i, (ident, tie, wanted) in enumerate(zip(batch.column("row_id").to_pylist(), batch.column("tie").to_pylist(), batch.column("wanted").to_pylist())):
            data = raw[offsets[i]: offsets[i + 1]]
            rows += [(w["h"], ident, tie, w["lo"], data[w["lo"]: w["hi"] + LENGTH].tobytes()) for w in wanted or []]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])],
                                         ["h", "row_id", "tie", "lo", "body"])


BODIES = "h bigint, row_id bigint, tie bigint, lo bigint, body binary"
STEP = -(-WIDTH // SLICES)


def _sliced(batches):
    """(h, row_id, tie, lo, body, at) -> slices of the stretch, as stretches of smaller anchors: their h is a digest of h, the slice and the bytes
    that all its strings share. `at` is the anchor's place in the text: equal strings hold it at equal places."""
    import pyarrow as pa
    for batch in batches:
        rows = []
        for h, ident, tie, lo, body, at in zip(*(c.to_pylist() for c in batch.columns)):
            last = lo + len(body) - LENGTH
            for k in range(SLICES):
                # Strings whose start lies STEP * k to STEP * (k + 1) - 1 bytes before the anchor.
                a, b = max(lo, at - STEP * (k + 1) + 1), min(last, at - STEP * k)
                if a > b:
                    continue
                # All strings of the slice, also in stretches that hold only a part of it, share these bytes.
                shared = body[at - STEP * k - lo: at - STEP * (k + 1) + 1 + LENGTH - lo]
                key = int.from_bytes(hashlib.blake2b(shared + h.to_bytes(8, "little", signed=True) + bytes([k]), digest_size=8).digest(), "little", signed=True)
                rows.append((key, ident, tie, a, body[a - lo: b - lo + LENGTH]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])],
                                         ["h", "row_id", "tie", "lo", "body"])


def _strings(batches):
    """(h, row_id, tie, lo, body) -> one row for each string, with its digest."""
    import pyarrow as pa
    for batch in batches:
        rows = [(ident, tie, lo + j, hashlib.blake2b(body[j: j + LENGTH], digest_size=16).digest())
                for _, ident, tie, lo, body in zip(*(c.to_pylist() for c in batch.columns)) for j in range(len(body) - LENGTH + 1)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.binary()])],
                                         ["row_id", "tie", "lo", "digest"])


MARKS = "row_id bigint, tie bigint, lo bigint, hi bigint, earlier boolean"


def _in_blocks(stretches: DataFrame) -> DataFrame:
    return stretches.select("h", "row_id", "tie", "lo", "body").repartition("h").sortWithinPartitions("h").mapInArrow(_block_rows, MARKS)


def _place(last: str):
    return F.struct(F.col("row_id").isNull().alias("a"), F.col("row_id").alias("b"), F.col("tie").alias("c"), F.col(last).alias("d"))


def repeated(docs: DataFrame) -> DataFrame:
    """(row_id, tie, lo, hi, earlier): stretches of string starts with an equal string elsewhere; `earlier` where one is at an earlier position.

    docs: (row_id, text, tie), no two rows equal in both; tie tells apart rows of equal id and orders them.
    """
    often = stored(docs.select("text").mapInArrow(_anchor_hashes, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"))
    rows = stored(docs.select("row_id", "text", "tie").mapInArrow(_anchor_rows, "h bigint, digest bigint, row_id bigint, tie bigint, span bigint")
                  .join(often, "h", "left_semi"))
    sorts = stored(rows.groupBy("h", "digest").agg(F.count("*").alias("times"), F.min(_place("span")).alias("p")))
    lo, hi = F.shiftright("span", SPAN).alias("lo"), (F.shiftright("span", SPAN) + F.col("span").bitwiseAND(F.lit((1 << SPAN) - 1))).alias("hi")
    per_anchor = stored(sorts.groupBy("h").agg(F.count("*").alias("sorts")).filter("sorts > 1"))
    members = stored(rows.join(sorts.filter("times > 1").select("h", "digest", "p"), ["h", "digest"])
                 .select("row_id", "tie", lo, hi, (_place("span") != F.col("p")).alias("earlier")))
    discard(often, rows)
    firsts = sorts.join(per_anchor.select("h"), "h").select(F.col("p.b").alias("row_id"), F.col("p.c").alias("tie"), F.col("p.d").alias("span"), "h")
    wanted = firsts.groupBy("row_id", "tie").agg(F.collect_list(F.struct("h", lo, hi)).alias("wanted"))
    held = docs.select(F.col("row_id").alias("r"), F.col("tie").alias("t"), "text").join(wanted, F.col("r").eqNullSafe(F.col("row_id")) & (F.col("t") == F.col("tie")))
    stretches = stored(held.select("row_id", "tie", "text", "wanted").mapInArrow(_bodies, BODIES))
    discard(sorts)
    wide = per_anchor.filter(F.col("sorts") > CLASSES).select("h")
    if wide.isEmpty():
        out = stored(members.union(_in_blocks(stretches)))
        discard(per_anchor, members, stretches)
        return out
    blocks = _in_blocks(stretches.join(wide, "h", "left_anti"))
    # Slices that meet no other are done after their keys were counted.
    slices = stored(stretches.join(wide, "h", "left_semi").mapInArrow(_with_anchor, f"{BODIES}, at bigint").mapInArrow(_sliced, BODIES))
    keys = stored(slices.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    few, many = keys.filter(F.col("n") <= CLASSES).select("h"), keys.filter(F.col("n") > CLASSES).select("h")
    strings = stored(slices.join(many, "h", "left_semi").mapInArrow(_strings, "row_id bigint, tie bigint, lo bigint, digest binary"))
    best = strings.groupBy("digest").agg(F.min(_place("lo")).alias("p"), F.max(_place("lo")).alias("q")).filter("p <> q")
    single = strings.join(best, "digest").select("row_id", "tie", "lo", F.col("lo").alias("hi"), (_place("lo") != F.col("p")).alias("earlier"))
    out = stored(members.union(blocks).union(_in_blocks(slices.join(few, "h", "left_semi"))).union(single))
    discard(per_anchor, members, stretches, slices, keys, strings)
    return out


def _with_anchor(batches):
    """The place of the anchor of each stretch: its first k-mer with the anchor's hash that all its strings hold."""
    import pyarrow as pa
    for batch in batches:
        at = []
        for h, lo, body in zip(batch.column("h").to_pylist(), batch.column("lo").to_pylist(), batch.column("body").to_pylist()):
            raw = np.frombuffer(body, np.uint8)
            n = len(raw)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(byte_values(raw) * powers("up", n))])
            grams = mix64((sums[K:] - sums[:-K]) * powers("down", n)[: n - K + 1])
            strings = n - LENGTH + 1
            # All strings of a stretch hold the anchor: it starts between the last string's start and the first one's end.
            inside = np.flatnonzero(grams[strings - 1: LENGTH - K + 1].view(np.int64) == h)
            at.append(lo + strings - 1 + int(inside[0]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "at"])


def _cutter(later: bool):
    """(row_id, text, found, copies) -> sizes, removed spans and what is left; a row that is there several times repeats itself as a whole."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            rows = []
            for i, (ident, found, copies) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row_id", "found", "copies")))):
                data = raw[offsets[i]: offsets[i + 1]]

                def result(gone):
                    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                    spans = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
                    return ident, len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()
                step = np.zeros(len(data) + 1, np.int32)
                for w in found or []:
                    if w["earlier"] or not later:
                        step[w["lo"]] += 1
                        step[w["hi"] + LENGTH] -= 1
                alone = np.cumsum(step[:-1]) > 0
                whole = np.full(len(data), len(data) >= LENGTH)
                rows.append((*result(alone if later or copies == 1 else whole), 1))
                if copies > 1:
                    rows.append((*result(whole), copies - 1))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                             ["row_id", "n_bytes", "n_removed", "spans", "kept_sha256", "times"])
    return run


def spans(docs: DataFrame, later: bool = True, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_id, n_bytes, n_removed, spans, kept_sha256) of every row; `later` keeps each string's first occurrence, else all copies go."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(ident).cast("long").alias("row_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    several = stored(rows.groupBy("row_id", "tie").agg(F.count("*").alias("copies")).filter("copies > 1")
                     .select(F.col("row_id").alias("r"), F.col("tie").alias("t"), "copies"))
    single = rows.withColumn("copies", F.lit(1).cast("long"))
    if not several.isEmpty():
        same = F.col("row_id").eqNullSafe(F.col("r")) & (F.col("tie") == F.col("t"))
        folded = rows.join(several, same).groupBy("row_id", "tie").agg(F.first("text").alias("text"), F.first("copies").alias("copies"))
        single = rows.join(several, same, "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(folded)
    marks = repeated(single)
    found = (marks.groupBy("row_id", "tie").agg(F.collect_set(F.struct("lo", "hi", "earlier")).alias("found"))
             .select(F.col("row_id").alias("r"), F.col("tie").alias("t"), "found"))
    met = single.join(found, F.col("row_id").eqNullSafe(F.col("r")) & (F.col("tie") == F.col("t")), "left").select("row_id", "text", "found", "copies")
    cut = met.mapInArrow(_cutter(later), "row_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string, times bigint")
    if several.isEmpty():
        return cut.drop("times")
    return cut.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times", "copy")


def op5(docs: DataFrame) -> DataFrame:
    return spans(docs, later=False).select(F.col("row_id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
