"""Language-model scores by context-tree weighting over bytes, and a smoothed word unigram beside it.

The model: a byte is eight binary decisions (its bits from the top, 255 nodes); each decision has a tree of contexts, the up to DEPTH bytes
before it, most recent first. A context holds a Krichevsky-Trofimov estimate of its counts, and its weighted probability is half its
own estimate and half the product of those of its longer contexts, so that all depths are mixed by how well they coded the training
texts. Counts come from all training texts; a text's score is the log-probability of its bytes and of an end mark under the trained tree. Texts
are lower-cased (A-Z) and stand between end marks (byte 0xFF, which UTF-8 lacks).

As jobs: documents are dealt into blocks of about BLOCK bytes; each block gives its distinct grams (context and byte, at most 8 bytes
in one integer) and words with their training counts, in shards by the two most recent context bytes, as packed arrays. A shard sums its arrays one
after the other; its subtrees are independent of other shards, and the 257 contexts above them are of fixed size. Every distinct gram gets its
log-probability once; the shard answers each block's array, and the block scores its texts. Nothing is broadcast but the 257 upper contexts; a shard
holds its distinct grams, a block its own.

Words are known by a 63-bit digest. Defined cases: null and empty texts are an end mark alone, n_tokens 1; a null id is learned from; without
training texts every bit has probability 1/2 and the base score is 0; ties do not occur; equal rows are scored alike; an empty
table gives an empty result; further columns are ignored.
"""

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.llm.common import blocks, crc_of_id, discard, mix64, stored, text_bytes, words_of

#: Context bytes; text bytes of a block; bytes turned into arrays at a time; grams of a chunk of subtrees; shards at most.
DEPTH, BLOCK, STEP, CHUNK, SHARDS = 6, 16 << 20, 1 << 19, 100_000, 4096
GRAMS, WORDS = 0, 1
END = -1   # key of the end as a token
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def grams(raw, offsets, depth: int):
    """(key of each coded byte, first of each text and the end): context bytes, most recent first, then the byte."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    text = np.repeat(np.arange(n), size)
    stream = np.full(len(raw) + n * (depth + 1), 0xFF, np.uint64)
    at = np.arange(len(raw)) + text * (depth + 1) + depth
    stream[at] = _LOWER[raw]
    ends = offsets[1:] + np.arange(n) * (depth + 1) + depth
    coded = np.zeros(len(stream), bool)
    coded[at] = coded[ends] = True
    place = np.flatnonzero(coded)
    key = stream[place].copy()
    for d in range(1, depth + 1):
        key |= stream[place - d] << np.uint64(8 * (depth + 1 - d))
    return key, np.append(offsets[:-1] + np.arange(n), len(key))


def tokens(raw, offsets):
    """(key of each word, first of each text and the end); keys are negative as signed integers, and never END."""
    words, first = words_of(raw, offsets)
    return np.minimum(words | np.uint64(1 << 63), np.uint64((1 << 64) - 2)), first


def merged(keys, counts):
    """Sorted distinct keys with the sum of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def pack(values) -> bytes:
    """Numbers as compressed planes of their bytes."""
    import pyarrow as pa
    width = values.dtype.itemsize
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, dtype):
    import pyarrow as pa
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, n * width, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pack_keys(keys) -> bytes:
    """Sorted keys as packed differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes, n: int):
    return np.cumsum(unpack(data, n, np.uint64), dtype=np.uint64)


def shard_of(keys, kind: int, depth: int, shards: int):
    """Grams that share their two most recent context bytes share a shard."""
    lead = keys >> np.uint64(8 * (depth - 1)) if kind == GRAMS else keys
    return (mix64(lead + np.uint64(kind)) % np.uint64(shards)).astype(np.int64)


ASKED = "block bigint, shard bigint, kind int, n bigint, keys binary, counts binary"


def _requests(depth, shards):
    """The distinct grams and words of each block with their training counts, one packed row a shard and kind."""
    def run(batches):
        import pyarrow as pa
        held = {}   # (block, kind) -> pending (keys, counts)

        def squeeze(of):
            keys, counts = zip(*held[of])
            held[of] = [merged(np.concatenate(keys), np.concatenate(counts))]

        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False)
            learn = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for b in np.unique(block).tolist():
                for teach in (True, False):
                    rows = np.flatnonzero((block == b) & (learn == teach))
                    if not len(rows):
                        continue
                    raw, offsets = text_bytes(batch.column(2).take(pa.array(rows)))
                    for i, j in blocks(offsets, STEP):
                        part, at = raw[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
                        ends = np.full(j - i, END, np.int64).view(np.uint64)
                        for kind, keys in ((GRAMS, grams(part, at, depth)[0]), (WORDS, np.concatenate([tokens(part, at)[0], ends]))):
                            found, times = np.unique(keys, return_counts=True)
                            pending = held.setdefault((b, kind), [])
                            pending.append((found, times.astype(np.int64) if teach else np.zeros(len(found), np.int64)))
                            if sum(len(k) for k, _ in pending[1:]) > max(1 << 19, len(pending[0][0])):
                                squeeze((b, kind))
        for of in list(held):
            squeeze(of)
            keys, counts = held.pop(of)[0]
            shard = shard_of(keys, of[1], depth, shards)
            order = np.argsort(shard, kind="stable")
            edge = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = [(of[0], s, of[1], int(b - a), pack_keys(keys[order[a:b]]), pack(counts[order[a:b]]))
                    for s, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if b > a]
            yield _rows(rows, ASKED)
    return run


def _rows(rows, schema: str):
    import pyarrow as pa
    types = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


SUMS = "shard bigint, kind int, n bigint, keys binary, counts binary, total bigint, known bigint"


def _sums(batches):
    """Keys of each shard and kind with their counts over all blocks, from rows (shard, kind, n, keys, counts) sorted by shard and kind."""
    at, held = None, []

    def close():
        keys, counts = merged(*(np.concatenate(x) for x in zip(*held)))
        return _rows([(*at, len(keys), pack_keys(keys), pack(counts), int(counts.sum()), int((counts > 0).sum()))], SUMS)
    for batch in batches:
        for shard, kind, n, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if (shard, kind) != at:
                if held:
                    yield close()
                at, held = (shard, kind), []
            held.append((unpack_keys(keys, n), unpack(counts, n, np.int64)))
            if sum(len(k) for k, _ in held[1:]) > max(1 << 19, len(held[0][0])):
                held = [merged(*(np.concatenate(x) for x in zip(*held)))]
    if held:
        yield close()


def lgamma(x):
    """log Gamma for x > 0: Stirling's series, eight steps up."""
    y = x + 8.0
    head = np.ones_like(y)
    for i in range(8):
        head *= x + i
    z = 1.0 / (y * y)
    series = (1 / 12.0 - z * (1 / 360.0 - z * (1 / 1260.0 - z * (1 / 1680.0)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(head)


def log_kt(zeros, ones):
    """Log of the Krichevsky-Trofimov block probability."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - math.log(math.pi)


def weigh(own, longer):
    """(log weighted probability, weight of the own estimate) from the log of the own estimate and of the product of the longer contexts'."""
    top = np.maximum(own, longer)
    both = top + np.log(np.exp(own - top) + np.exp(longer - top))
    return both - math.log(2), np.exp(own - both)


class Subtrees:
    """Contexts of depth `low` and more over sorted distinct grams and their counts; `low` context bytes lead each key."""

    def __init__(self, keys, counts, depth: int, low: int):
        self.keys, self.depth, self.low = keys, depth, low
        tables = {depth: (keys, counts.astype(float))}
        rows = {depth: np.arange(len(keys))}   # row of each gram in the table of each depth
        for d in range(depth - 1, low - 1, -1):
            longer, n = tables[d + 1]
            cut = ((longer >> np.uint64(16)) << np.uint64(8)) | (longer & np.uint64(0xFF))   # without the oldest byte
            have, back = np.unique(cut, return_inverse=True)
            tables[d] = have, np.bincount(back, n, len(have))
            rows[d] = back[rows[d + 1]]
        self.tables, bits, weights = tables, {}, {}
        self.weighted = {}   # of depth `low`, per bit: (node, log weighted probability)
        for j in range(8):
            longer = None   # (nodes, log weighted probabilities) one level down
            for d in range(depth, low - 1, -1):
                key, n = tables[d]
                node = key >> np.uint64(8 - j)
                first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
                total = np.add.reduceat(n, first)
                ones = np.add.reduceat(n * ((key >> np.uint64(7 - j)) & np.uint64(1)), first)
                own = log_kt(total - ones, ones)
                nodes = node[first]
                if longer is None:
                    log_w, weight = own, None
                else:
                    j_ = np.uint64(j)
                    up = ((longer[0] >> np.uint64(8 + j)) << j_) | (longer[0] & np.uint64((1 << j) - 1))
                    log_w, weight = weigh(own, np.bincount(np.searchsorted(nodes, up), longer[1], len(nodes)))
                longer = nodes, log_w
                at = (np.cumsum(np.append(True, node[1:] != node[:-1])) - 1)[rows[d]]   # node of each gram
                guess = ((ones + 0.5) / (total + 1.0))[at]
                bits[j] = guess if weight is None else weight[at] * guess + (1 - weight[at]) * bits[j]
            self.weighted[j] = longer
        self.ones = bits   # per bit: probability of a one at each gram, of the contexts here

    def log_probability(self, upper):
        """Natural log-probability of each gram, mixed with the upper contexts: [(estimates, weights) by 255 nodes], the longest first."""
        total = np.zeros(len(self.keys))
        byte = (self.keys & np.uint64(0xFF)).astype(np.int64)
        recent = (self.keys >> np.uint64(8 * self.depth)).astype(np.int64)
        for j in range(8):
            node = (1 << j) - 1 + (byte >> (8 - j))
            p = self.ones[j]
            for guess, weight in upper:
                at = (recent, node) if guess.ndim == 2 else (node,)
                p = weight[at] * guess[at] + (1 - weight[at]) * p
            total += np.log(np.where((byte >> (7 - j)) & 1, p, 1 - p))
        return total


def subtrees(keys, counts, depth):
    """Subtrees of whole contexts of two bytes, about CHUNK grams at a time."""
    lead = keys >> np.uint64(8 * (depth - 1))
    a = 0
    while a < len(keys):
        b = int(np.searchsorted(lead, lead[min(a + CHUNK, len(keys)) - 1], "right"))
        yield Subtrees(keys[a:b], counts[a:b], depth, 2)
        a = b


def _heads(depth):
    """Per context of two bytes: its counts of 256 bytes and the log weighted probabilities of its 255 nodes."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for size, packed, times in zip(*(c.to_pylist() for c in batch.columns)):
                for tree in subtrees(unpack_keys(packed, size), unpack(times, size, np.int64), depth):
                    key, n = tree.tables[2]
                    context = np.unique(key >> np.uint64(8))
                    count, weighted = np.zeros((len(context), 256)), np.zeros((len(context), 255))
                    count[np.searchsorted(context, key >> np.uint64(8)), (key & np.uint64(0xFF)).astype(int)] = n
                    for j, (node, value) in tree.weighted.items():
                        prefix = (node & np.uint64((1 << j) - 1)).astype(int)
                        weighted[np.searchsorted(context, node >> np.uint64(j)), (1 << j) - 1 + prefix] = value
                    yield pa.RecordBatch.from_arrays([pa.array((context >> np.uint64(8)).astype(np.int64)), pa.array([r.tobytes() for r in count], pa.binary()),
                                                      pa.array([r.tobytes() for r in weighted], pa.binary())], ["recent", "counts", "weighted"])
    return run


def _sum_heads(table):
    """One row per most recent byte: at most 256 rows of 4 KB came in."""
    import pyarrow as pa
    add = lambda name: np.sum([np.frombuffer(v, float) for v in table.column(name).to_pylist()], axis=0).tobytes()
    return pa.table({"recent": [table.column("recent")[0].as_py()], "counts": [add("counts")], "weighted": [add("weighted")]})


def upper_contexts(heads):
    """[(estimates, weights)] of the contexts of one byte and of the empty one, from rows (recent, counts, weighted)."""
    count, longer = np.zeros((256, 256)), np.zeros((256, 255))
    for r in heads:
        count[r["recent"]], longer[r["recent"]] = np.frombuffer(bytes(r["counts"]), float), np.frombuffer(bytes(r["weighted"]), float)
    out = []
    for n in (count, count.sum(axis=0, keepdims=True)):
        zeros, ones = np.zeros((len(n), 255)), np.zeros((len(n), 255))
        for j in range(8):
            pairs = n.reshape(len(n), 1 << j, 2, -1).sum(axis=3)
            zeros[:, (1 << j) - 1: (2 << j) - 1], ones[:, (1 << j) - 1: (2 << j) - 1] = pairs[:, :, 0], pairs[:, :, 1]
        log_w, weight = weigh(log_kt(zeros, ones), longer)
        guess = (ones + 0.5) / (zeros + ones + 1.0)
        out.append((guess, weight) if len(n) > 1 else (guess[0], weight[0]))
        longer = log_w.sum(axis=0, keepdims=True)
    return out


ANSWERS = "block bigint, kind int, n bigint, keys binary, answer binary"


def _answers(depth, shared):
    """What each block asked for: log-probabilities of its grams, training counts of its words. Rows (shard, kind, side, block, n, keys,
    counts) come sorted; a shard's sums (side 0) precede the blocks' rows."""
    def run(batches):
        keys = value = None
        for batch in batches:
            out = []
            for _, kind, side, block, n, packed, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if side == 0:
                    keys, value = unpack_keys(packed, n), unpack(counts, n, np.int64)
                    if kind == GRAMS:
                        value = np.concatenate([t.log_probability(shared.value) for t in subtrees(keys, value, depth)]).astype(np.float32)
                    continue
                out.append((block, kind, n, packed, pack(value[np.searchsorted(keys, unpack_keys(packed, n))])))
            yield _rows(out, ANSWERS)
    return run


def _looked_up(asked, keys, value):
    """Values of the asked keys: equal ones are looked up once, in order."""
    found, back = np.unique(asked, return_inverse=True)
    return value[np.searchsorted(keys, found)][back]


def _scored(depth, total, distinct):
    """Scores of one block's texts from its answers."""
    def run(texts, answers):
        import pyarrow as pa
        tables = {}
        for kind, dtype in ((GRAMS, np.float32), (WORDS, np.int64)):
            rows = [r for r in zip(*(answers.column(c).to_pylist() for c in ("kind", "n", "keys", "answer"))) if r[0] == kind]
            key = np.concatenate([unpack_keys(k, n) for _, n, k, _ in rows])
            order = np.argsort(key)
            tables[kind] = key[order], np.concatenate([unpack(v, n, dtype) for _, n, _, v in rows])[order].astype(float)
        low = math.log10(total + 0.5 * (distinct + 1))
        end_count = tables[WORDS][1][-1]   # END is the largest key
        raw, offsets = text_bytes(texts.column("text"))
        out = {name: [] for name in ("n_tokens", "n_known", "base_score", "score", "n_bytes")}
        for i, j in blocks(offsets, STEP):
            part, at = raw[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
            coded, first = grams(part, at, depth)
            out["score"].append(np.add.reduceat(_looked_up(coded, *tables[GRAMS]), first[:-1]) / math.log(10))
            words, first = tokens(part, at)
            count = _looked_up(words, *tables[WORDS])
            upto = np.concatenate([[0], np.cumsum(count > 0)])
            out["n_known"].append(upto[first[1:]] - upto[first[:-1]] + int(end_count > 0))
            out["n_tokens"].append(np.diff(first) + 1)
            logs = np.append(np.log10(count + 0.5), 0.0)
            sums = np.where(np.diff(first) > 0, np.add.reduceat(logs, first[:-1]), 0.0)
            out["base_score"].append(sums + math.log10(end_count + 0.5) - (np.diff(first) + 1) * low)
            out["n_bytes"].append(np.diff(at))
        cols = {k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items()}
        bits = -cols["score"] * math.log2(10) / np.maximum(1, cols["n_bytes"])
        n = texts.num_rows
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": pa.array(cols["n_tokens"].astype(np.int64)),
                         "n_known": pa.array(cols["n_known"].astype(np.int64)), "train_tokens": pa.array(np.full(n, total, np.int64)),
                         "base_score": pa.array(cols["base_score"].astype(float)), "score": pa.array(cols["score"].astype(float)),
                         "bits_per_byte": pa.array(bits.astype(float))})
    return run


def score(docs: DataFrame, held_out, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row; rows with held_out teach nothing."""
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6 bytes")
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block))
    texts = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)))
    shards = max(8, min(n_blocks, SHARDS))
    asked = stored(texts.select("block", ~F.col("held_out"), "text").repartition(n_blocks, "block").mapInArrow(_requests(depth, shards), ASKED))
    sums = stored(asked.select("shard", "kind", "n", "keys", "counts").repartition(shards, "shard").sortWithinPartitions("shard", "kind")
                  .mapInArrow(_sums, SUMS))
    known = sums.filter(F.col("kind") == WORDS).agg(F.sum("total").alias("total"), F.sum("known").alias("known")).first()
    heads = (sums.filter(F.col("kind") == GRAMS).select("n", "keys", "counts").mapInArrow(_heads(depth), "recent bigint, counts binary, weighted binary")
             .groupBy("recent").applyInArrow(_sum_heads, "recent bigint, counts binary, weighted binary"))
    shared = spark.sparkContext.broadcast(upper_contexts(heads.collect()))   # 256 rows at most, 4 KB each
    first = sums.select("shard", "kind", F.lit(0).alias("side"), F.lit(None).cast("long").alias("block"), "n", "keys", "counts")
    then = asked.select("shard", "kind", F.lit(1).alias("side"), "block", "n", "keys", F.lit(None).cast("binary").alias("counts"))
    answers = stored(first.unionByName(then).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "side")
                     .mapInArrow(_answers(depth, shared), ANSWERS))
    discard(asked, sums)
    ident = docs.schema["doc_id"].dataType.simpleString()
    return (texts.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(_scored(depth, known["total"] or 0, known["known"] or 0),
                          f"doc_id {ident}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, "
                          "bits_per_byte double"))


def op13(docs: DataFrame) -> DataFrame:
    return score(docs, crc_of_id() % 5 == 1)
