"""Merkle manifest of a dataset: one tree per partition key, with a membership proof of every row, built by incremental witnesses.

Leaves are SHA-256 digests of the rows. Of each key they are numbered in order and cut into aligned blocks of 2^DEPTH. A block is a
streaming append: open subtrees lie on a stack, a new leaf closes those of equal height, and whenever two subtrees close into one, the
witnesses attached to the members of each are extended by the root of the other. Block roots are appended in the same way, in blocks of
their own, until one node of a key is left (its subroot); subroots are the leaves of the last tree. A row's whole witness is its own
block's part followed by those of the blocks above, which are joined to it, one row per block. No task holds more than a block.

Every 2 consecutive nodes of a level become their digest, a single last one too, while a level has more than one node. `verify` folds a
leaf (possibly changed) with its siblings.

Defined cases: null values count as `-`, so nulls and empty texts differ; rows of a null key form a tree of their own, first in order; null
ids come first in theirs; rows of equal id are ordered by their digest, and equal rows are leaves of their own each, with equal leaf but
their own witness; a key of one row has its leaf as subroot, and an empty table gives an empty result; further columns are ignored;
n_chars + 1 is formed as a decimal and cannot overflow.
"""

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemetrics.llm.common import crc_of_id, stored
from sitemetrics.session import MAX_BROADCAST_ROWS

#: A block is at most 2^DEPTH nodes: DEPTH digests of 32 bytes a row.
DEPTH = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """UTF-8 byte count, colon, value; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(fields) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def _parent(*nodes: bytes) -> bytes:
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def append(nodes, levels: int):
    """Root at height `levels` of nodes appended one by one, and the witness of each: its siblings from below, joined."""
    n = len(nodes)
    siblings = np.zeros((n, levels, 32), np.uint8)
    there = np.zeros((n, levels), bool)
    open_trees = []   # (height, root, first node, end)

    def close(right):
        # Two subtrees of one height: the members of each get the root of the other.
        height, root, first, end = open_trees.pop()
        siblings[first:end, height] = np.frombuffer(right[1], np.uint8)
        siblings[right[2]:right[3], height] = np.frombuffer(root, np.uint8)
        there[first:right[3], height] = True
        return height + 1, _parent(root, right[1]), first, right[3]

    for i, node in enumerate(nodes):
        tree = (0, node, i, i + 1)
        while open_trees and open_trees[-1][0] == tree[0]:
            tree = close(tree)
        open_trees.append(tree)
    tree = open_trees.pop()
    while tree[0] < levels:
        if open_trees and open_trees[-1][0] == tree[0]:
            tree = close(tree)
        else:   # the last of its level, alone
            tree = (tree[0] + 1, _parent(tree[1]), tree[2], tree[3])
    return tree[1], [siblings[i][there[i]].tobytes() for i in range(n)]


def heights(n: int) -> int:
    """Levels above n leaves."""
    return max(0, n - 1).bit_length()


def climb(node: bytes, place: int, n: int, witness: bytes, at: int = 0):
    """(node over the leaf `place` of n, bytes of the witness used): fold with the siblings that exist at each level."""
    while n > 1:
        if place ^ 1 < n:
            other = witness[at: at + 32]
            at += 32
            node = _parent(other, node) if place & 1 else _parent(node, other)
        else:
            node = _parent(node)
        place, n = place >> 1, (n + 1) >> 1
    return node, at


def _append_block(depth):
    """The nodes of one block with their witness and the block's root."""
    def run(rows):
        import pyarrow as pa
        rows = rows.take(pa.array(np.argsort(rows.column("place").to_numpy(), kind="stable")))
        n = rows.column("n")[0].as_py()
        root, witness = append(rows.column("node").to_pylist(), min(depth, heights(n)))
        return rows.append_column("witness", pa.array(witness, pa.binary())).append_column("root", pa.array([root] * rows.num_rows, pa.binary()))
    return run


def numbered(df: DataFrame, key: str, order, place: str, size: str) -> DataFrame:
    """df with each row's number inside its key (from 0) and the key's number of rows.

    Rows are range-partitioned by (key, order), so a frequent key spans several partitions; a row's number is its place in the partition plus the rows of
    the key in earlier partitions, which are one row per key and partition.
    """
    tie = F.monotonically_increasing_id()   # equal rows need not share a partition
    ranged = df.withColumn("__tie", tie).repartitionByRange(key, *order, "__tie").sortWithinPartitions(key, *order, "__tie").drop("__tie")
    rows = stored(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    parts = rows.groupBy(F.col(key).alias("__key"), part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    earlier = Window.partitionBy("__key").orderBy("__part")
    parts = (parts.withColumn("__before", F.sum("__rows").over(earlier) - F.col("__rows"))
             .withColumn(size, F.sum("__rows").over(Window.partitionBy("__key"))))
    parts = stored(parts)
    if parts.count() <= MAX_BROADCAST_ROWS:
        parts = F.broadcast(parts)
    joined = rows.withColumn("__in", part).join(parts, (F.col(key) == F.col("__key")) & (F.col("__in") == F.col("__part")))
    return (joined.withColumn(place, F.col("__at") - F.col("__first") + F.col("__before"))
            .drop("__at", "__in", "__key", "__part", "__first", "__rows", "__before"))


def witnessed(nodes: DataFrame, extra: str = "", depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(nodes with their whole witness up to their key's root, roots) from (key, place, n, node, further columns given by `extra`)."""
    more = f", {extra}" if extra else ""
    names = [c.split()[0] for c in extra.split(",")] if extra else []
    blocks = nodes.select("key", F.shiftright("place", depth).alias("block"), "place", "n", "node", *names)
    schema = f"key string, block bigint, place bigint, n bigint, node binary{more}, witness binary, root binary"
    rows = stored(blocks.groupBy("key", "block").applyInArrow(_append_block(depth), schema))
    heads = rows.filter(F.col("place") == F.shiftleft("block", depth))
    if rows.filter(F.col("n") > 1 << depth).isEmpty():
        return rows.drop("block"), heads.select("key", "root")
    # Block roots are appended to the next tree; keys of a single block have theirs already.
    count = F.shiftright(F.col("n") + F.lit((1 << depth) - 1), depth)
    above, roots = witnessed(heads.select("key", F.col("block").alias("place"), count.alias("n"), F.col("root").alias("node")), depth=depth)
    # One row per block: never more than a 2^DEPTH-th of the rows, and of each key as many as it has blocks.
    above = above.select(F.col("key").alias("__key"), F.col("place").alias("__block"), F.col("witness").alias("__above"))
    joined = rows.join(above, (F.col("key") == F.col("__key")) & (F.col("block") == F.col("__block")))
    joined = joined.withColumn("witness", F.concat("witness", "__above")).drop("__key", "__block", "__above", "block")
    return joined, roots


def manifest(df: DataFrame, key: Column, leaf: Column, order: Column, extra: dict[str, Column], depth: int = DEPTH) -> DataFrame:
    """Rows of `extra` columns with leaf, place, n, witness; subroot, key_place, keys, key_witness; root (all digests binary)."""
    names = list(extra)
    group = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))   # null first, then by bytes
    base = df.select(group.alias("key"), order.alias("__order"), F.unhex(leaf).alias("node"), *[c.alias(n) for n, c in extra.items()])
    place = numbered(base, "key", ["__order", "node"], "place", "n")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in place.select(*names).schema)
    leaves, roots = witnessed(place.select("key", "place", "n", "node", *names), types, depth)
    top = numbered(roots.select(F.lit("").alias("all"), F.col("key").alias("branch"), F.col("root").alias("node")), "all", ["branch"], "place", "n")
    branches, last = witnessed(top.select(F.col("all").alias("key"), "place", "n", "node", "branch"), "branch string", depth)
    last = last.first()   # one digest
    branches = branches.select("branch", F.col("node").alias("subroot"), F.col("place").alias("key_place"), F.col("n").alias("keys"),
                               F.col("witness").alias("key_witness"))
    branches = stored(branches.withColumn("root", F.unhex(F.lit(bytes(last["root"]).hex() if last else None))))
    if branches.count() <= MAX_BROADCAST_ROWS:
        branches = F.broadcast(branches)
    joined = leaves.drop("root").join(branches, F.col("key") == F.col("branch"))
    return joined.select(*names, F.col("node").alias("leaf"), "place", "n", "witness", "subroot", "key_place", "keys", "key_witness", "root")


def _fold(batches):
    """Proof digest and folded root of each row: (leaf to fold, place, n, witness, key_place, keys, key_witness) come last."""
    import pyarrow as pa
    for batch in batches:
        proof, folded = [], []
        values = [batch.column(c).to_pylist() for c in ("candidate", "place", "n", "witness", "key_place", "keys", "key_witness")]
        for leaf, place, n, witness, key_place, keys, key_witness in zip(*values):
            proof.append(hashlib.sha256((witness + key_witness).hex().encode()).hexdigest())
            subroot, used = climb(leaf, place, n, witness)
            root, top_used = climb(subroot, key_place, keys, key_witness)
            if used != len(witness) or top_used != len(key_witness):
                raise ValueError("the witness does not fit the leaf's place")
            folded.append(root.hex())
        kept = [batch.column(c) for c in ("doc_id", "leaf", "subroot", "root")]
        yield pa.RecordBatch.from_arrays(kept + [pa.array(proof, pa.string()), pa.array(folded, pa.string())],
                                         ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])


def verify(rows: DataFrame, candidate: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) from a manifest's rows; `candidate` is the leaf to fold."""
    shown = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")]
    given = rows.select("doc_id", *shown, candidate.alias("candidate"), "place", "n", "witness", "key_place", "keys", "key_witness")
    ident = rows.schema["doc_id"].dataType.simpleString()
    out = given.mapInArrow(_fold, f"doc_id {ident}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    docs = docs.select(*FIELDS)
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    changed = digest_of([more if c == "n_chars" else F.col(c) for c in FIELDS])
    tampered = F.when((crc_of_id() % 7 == 0) & F.col("n_chars").isNotNull(), F.unhex(changed))
    rows = manifest(docs, F.col("lang"), digest_of([F.col(c) for c in FIELDS]), F.col("doc_id"), {"doc_id": F.col("doc_id"), "tampered": tampered}, depth)
    return verify(rows, F.coalesce("tampered", "leaf"))


#: crc32 by shifts, as the SQL engine of the comparison has no such function.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(id_text, ''), lambda c: ascii(c)::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""


def _field_sql(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


_LEAF_SQL = " || ".join(_field_sql(c) for c in FIELDS)
_CHANGED_SQL = " || ".join(_field_sql("(n_chars::HUGEINT + 1)" if c == "n_chars" else c) for c in FIELDS)

OP12_SQL = f"""
WITH RECURSIVE hashed AS (
    SELECT doc_id, lang, sha256({_LEAF_SQL}) AS leaf,
        CASE WHEN n_chars IS NOT NULL AND {_CRC} % 7 = 0 THEN sha256({_CHANGED_SQL}) ELSE sha256({_LEAF_SQL}) END AS candidate
    FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS id_text FROM documents)),
placed AS (
    SELECT *, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
nodes(tree, height, place, node, width) AS (
    SELECT tree, 0, place, leaf, count(*) OVER (PARTITION BY tree) FROM placed
    UNION ALL
    SELECT tree, height + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), any_value((width + 1) // 2)
    FROM nodes WHERE width > 1 GROUP BY tree, height, place // 2),
subroots AS (SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS width FROM nodes WHERE width = 1),
tops(height, place, node, width) AS (
    SELECT 0, place, node, width FROM subroots
    UNION ALL
    SELECT height + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), any_value((width + 1) // 2)
    FROM tops WHERE width > 1 GROUP BY height, place // 2),
everything AS (SELECT tree, height, place, node, width FROM nodes UNION ALL SELECT NULL, height, place, node, width FROM tops),
steps AS (   -- one row per row and level, through the subroot
    SELECT p.tree, p.place AS leaf_place, n.height, n.place, n.width FROM placed p JOIN nodes n ON n.tree = p.tree AND n.place = p.place >> n.height AND n.width > 1
    UNION ALL
    SELECT p.tree, p.place, 1000 + t.height, t.place, t.width FROM placed p JOIN subroots s ON s.tree = p.tree
    JOIN tops t ON t.place = s.place >> t.height AND t.width > 1),
siblings AS (
    SELECT s.tree, s.leaf_place, s.height, s.place % 2 AS side, e.node FROM steps s LEFT JOIN everything e
    ON e.tree IS NOT DISTINCT FROM CASE WHEN s.height < 1000 THEN s.tree END AND e.height = s.height % 1000 AND e.place = xor(s.place, 1)),
proofs AS (
    SELECT tree, leaf_place, coalesce(string_agg(node, '' ORDER BY height) FILTER (node IS NOT NULL), '') AS siblings,
        list(struct_pack(side := side, node := node) ORDER BY height) AS path
    FROM siblings GROUP BY tree, leaf_place),
folds(tree, leaf_place, node, step, path) AS (
    SELECT p.tree, p.place, p.candidate, 1, coalesce(q.path, []) FROM placed p LEFT JOIN proofs q ON q.tree = p.tree AND q.leaf_place = p.place
    UNION ALL
    SELECT tree, leaf_place, CASE WHEN path[step].node IS NULL THEN sha256(node) WHEN path[step].side = 1 THEN sha256(path[step].node || node)
        ELSE sha256(node || path[step].node) END, step + 1, path
    FROM folds WHERE step <= len(path))
SELECT p.doc_id, p.leaf, s.node AS subroot, r.node AS root, sha256(coalesce(q.siblings, '')) AS proof_sha256, f.node AS folded_root,
    f.node = r.node AS verified
FROM placed p JOIN subroots s ON s.tree = p.tree JOIN folds f ON f.tree = p.tree AND f.leaf_place = p.place AND f.step = len(f.path) + 1
LEFT JOIN proofs q ON q.tree = p.tree AND q.leaf_place = p.place LEFT JOIN tops r ON r.width = 1
"""
