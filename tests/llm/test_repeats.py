"""Repeated passages against brute force, for both choices of what stays, and the arrays they come from."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from sitemetrics.llm import repeats
from sitemetrics.llm.repeats import LENGTH


def brute(rows, later):
    """(id, bytes, removed, spans, digest of the rest) of rows (id, text); rows are ordered by id, then text digest, then as copies."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = defaultdict(list)
    for n, (_, raw) in enumerate(data):
        for p in range(len(raw) - LENGTH + 1):
            seen[raw[p:p + LENGTH]].append((n, p))
    out = []
    for n, (ident, raw) in enumerate(data):
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - LENGTH + 1):
            where = seen[raw[p:p + LENGTH]]
            if (min(where) < (n, p)) if later else len(where) > 1:
                gone[p:p + LENGTH] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((ident, len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    return out


def result(df, spans):
    return sorted((r.row_id if spans else r.doc_id, r.n_bytes, r.n_removed, len(r.spans) if spans else r.n_spans, r.kept_sha256) for r in df.collect())


def corpus(seed):
    rng = random.Random(seed)

    def words(n):
        return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))
    passage, short = words(70), words(36)[:190]
    rows = [(i, f"{words(rng.randint(5, 60))} {passage[rng.randint(0, 60):]} {words(10)}") for i in range(20)]
    rows += [(100 + i, f"{words(20)}{short}{words(20)}") for i in range(12)]              # shared, but shorter than a string
    rows += [(200 + i, f"{words(20)} {short}{'xyzw'[i % 2] * 15} {words(20)}") for i in range(12)]   # some agree on a little more
    same = words(90)
    rows += [(300, same), (300, same), (301, same), (302, "x " + same), (302, None), (303, ""), (304, "ab" * 500), (305, words(400))]
    return rows


@pytest.mark.parametrize("classes", [16_000, 3])
@pytest.mark.parametrize("later", [False, True])
def test_spans(spark, monkeypatch, classes, later):
    monkeypatch.setattr(repeats, "CLASSES", classes)
    rows = corpus(classes)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(repeats.spans(docs, later), True) == sorted(brute(rows, later))
    if not later:
        assert result(repeats.op5(docs), False) == sorted(brute(rows, False))


def test_repeated_rows_keep_one(spark):
    """Rows of equal id and text: the passage stays in exactly one place."""
    t = " ".join(f"w{i}" for i in range(110))
    rows = [(1, t), (1, t), (2, "x " + t)]
    got = repeats.spans(spark.createDataFrame(rows, "doc_id long, text string"), later=True).collect()
    assert sorted((r.row_id, r.n_removed) for r in got) == [(1, 0), (1, len(t)), (2, len(t))]


def test_previous_factors_by_definition():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 900).astype(np.uint8)
    data[500:800] = data[100:400]
    starts = np.arange(0, len(data) - LENGTH + 1)
    order, common = repeats.suffix_order(data, starts)
    raw = data.tobytes()
    assert [raw[s:s + LENGTH] for s in starts[order]] == sorted(raw[s:s + LENGTH] for s in starts)

    def prefix(a, b):
        n = 0
        while n < LENGTH and raw[a + n] == raw[b + n]:
            n += 1
        return n
    assert common.tolist() == [0] + [prefix(a, b) for a, b in zip(starts[order][1:], starts[order])]
    factor = np.empty(len(starts), int)
    factor[order] = repeats.previous_factors(starts[order], common)
    assert factor.tolist() == [max([prefix(a, b) for b in range(a)], default=0) for a in starts]
    assert max(factor) == LENGTH
