"""Context-tree weighting against the recursive definition, and the word unigram against counts."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sitemetrics.llm import treelm
from tests.llm.conftest import TEXTS
from tests.llm.test_operators import words

LN10 = math.log(10)


def lower(text):
    return (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


def decisions(text, depth):
    """(context, node, bit) of every decision: contexts end with the most recent byte."""
    stream = b"\xff" * depth + lower(text) + b"\xff"
    for i in range(depth, len(stream)):
        for j in range(8):
            yield stream[i - depth: i], (j, stream[i] >> (8 - j)), (stream[i] >> (7 - j)) & 1


class Tree:
    def __init__(self, texts, depth):
        self.depth, self.count, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for t in texts:
            for context, node, bit in decisions(t, depth):
                for d in range(depth + 1):
                    self.count[context[depth - d:], node][bit] += 1
                    if d < depth:
                        self.children[context[depth - d:], node].add(context[depth - d - 1:])
        self.known = {}

    def kt(self, context, node):
        a, b = self.count.get((context, node), (0, 0))
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, context, node):
        if (context, node) not in self.count:
            return 0.0
        if (context, node) not in self.known:
            own = self.kt(context, node)
            if len(context) < self.depth:
                longer = sum(self.weighted(c, node) for c in self.children[context, node])
                own = np.logaddexp(own, longer) - math.log(2)
            self.known[context, node] = own
        return self.known[context, node]

    def ones(self, context, node, d=0):
        here = context[len(context) - d:]
        a, b = self.count.get((here, node), (0, 0))
        own = (b + .5) / (a + b + 1)
        if d == self.depth:
            return own
        longer = sum(self.weighted(c, node) for c in self.children.get((here, node), ()))
        ratio = math.exp(min(600, self.kt(here, node) - longer))
        return (ratio * own + self.ones(context, node, d + 1)) / (ratio + 1)

    def score(self, text):
        total = 0.0
        for context, node, bit in decisions(text, self.depth):
            p = self.ones(context, node)
            total += math.log(p if bit else 1 - p)
        return total / LN10


@pytest.mark.parametrize("depth,block", [(2, 1 << 20), (3, 300)])
def test_scores(spark, odd, depth, block):
    rows = odd.filter("length(text) < 2000 or text is null")
    given = rows.collect()
    held = {r.doc_id: zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 1 for r in given}
    assert len(set(held.values())) == 2
    tree = Tree([r.text for r in given if not held[r.doc_id]], depth)
    count = Counter()
    for r in given:
        if not held[r.doc_id]:
            count.update([*words(r.text), None])
    total, distinct = sum(count.values()), len(count)
    expected = []
    for r in given:
        seen = [*words(r.text), None]
        base = sum(math.log10((count[w] + .5) / (total + .5 * (distinct + 1))) for w in seen)
        expected.append((-1 if r.doc_id is None else r.doc_id, held[r.doc_id], len(seen), sum(count[w] > 0 for w in seen), total, base, tree.score(r.text)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
           for r in treelm.score(rows, treelm.crc_of_id() % 5 == 1, depth, block).collect()]
    assert len(got) == len(expected)
    for a, b in zip(sorted(got), sorted(expected)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6)


def test_probabilities_of_all_bytes_sum_to_one():
    texts = ["abracadabra", "abba", ""]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    key, n = np.unique(treelm.grams(raw, offsets, 3)[0], return_counts=True)
    every = np.sort(np.concatenate([(key[:1] & ~np.uint64(0xFF)) + np.arange(256, dtype=np.uint64), key]))
    every = np.unique(every)
    count = np.zeros(len(every), np.int64)
    count[np.searchsorted(every, key)] = n
    tree = treelm.Subtrees(every, count, 3, 0)
    p = np.exp(tree.log_probability([]))
    assert p[(every >> np.uint64(8)) == (key[0] >> np.uint64(8))].sum() == pytest.approx(1.0)


def test_log_gamma():
    x = np.array([.5, 1, 1.5, 7, 100.5, 1e6, 1e12])
    assert treelm.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-11, abs=1e-11)


def test_edges_and_better_than_words(spark, odd):
    assert treelm.op13(odd.limit(0)).count() == 0
    for r in treelm.score(odd, treelm.crc_of_id() >= 0, 2).collect():   # nothing learned: one bit a decision
        if r.doc_id is not None and r.doc_id != 5:
            assert r.base_score == r.n_known == r.train_tokens == 0
            assert r.score == pytest.approx(-8 * (len(lower(TEXTS[r.doc_id])) + 1) * math.log10(2), rel=1e-6)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    unseen = [r for r in treelm.op13(table).collect() if r.held_out]
    assert sum(r.score > r.base_score for r in unseen) > 0.5 * len(unseen) and sum(r.bits_per_byte for r in unseen) < 2.4 * len(unseen)

