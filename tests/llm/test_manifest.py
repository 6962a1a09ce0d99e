"""Merkle manifest against its SQL and a plain recursion."""

import hashlib
import zlib

import pytest

from sitemetrics.llm import manifest
from tests.oracle import connect, differences


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def root_of(level):
    while len(level) > 1:
        level = [h(*level[i:i + 2]) for i in range(0, len(level), 2)]
    return level[0]


@pytest.mark.parametrize("depth", [2, 3, 10])
def test_tables(spark, depth):
    folder = "/root/testdata/sf0.001"
    problems, rows = differences(manifest.op12(spark.read.parquet(f"{folder}/documents.parquet"), depth), connect(folder), manifest.OP12_SQL)
    assert not problems and rows == 200


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 33])
def test_append_gives_root_and_witnesses(n):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    root, witness = manifest.append(leaves, manifest.heights(n))
    assert root.hex() == root_of([v.hex() for v in leaves])
    for i, leaf in enumerate(leaves):
        assert manifest.climb(leaf, i, n, witness[i]) == (root, len(witness[i]))
        assert manifest.climb(leaves[i - 1] if n > 1 else bytes(32), i, n, witness[i])[0] != root


def test_append_to_a_height_above_the_last_run():
    leaves = [bytes([i]) * 32 for i in range(3)]
    root, _ = manifest.append(leaves, 4)
    assert root.hex() == h(h(root_of([v.hex() for v in leaves])))


def test_odd_rows(spark, odd):
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    rows = odd.collect()
    got = manifest.op12(odd, 2).collect()
    assert len(got) == len(rows)
    trees = {}
    for r in rows:
        trees.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, h(*[enc(r[c]) for c in manifest.FIELDS])))
    roots = {k: root_of([x[2] for x in sorted(v)]) for k, v in trees.items()}
    root = root_of([roots[k] for k in sorted(roots, key=lambda k: (k is not None, (k or "").encode()))])
    assert {r.root for r in got} == {root}
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.leaf, r.subroot) for r in got) == sorted((x[1] if x[0] else -1, x[2], roots[k]) for k, v in trees.items() for x in v)
    counted = {h(*[enc(r[c]) for c in manifest.FIELDS]): r.n_chars is not None for r in rows}
    for r in got:
        changed = counted[r.leaf] and zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 == 0
        assert r.verified == (not changed) and (r.folded_root == root) == r.verified
    assert manifest.op12(odd.limit(0)).count() == 0
