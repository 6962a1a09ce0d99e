"""Phrase mining against SQL and a plain count."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitemetrics.llm import phrases
from tests.oracle import connect, differences


def brute(rows, least, most, first, hide=80, scale=2_000_000):
    count, total = Counter(), Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for group, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[group] += len(w)
            for k in range(1, most + 1):
                count.update((group, *w[i:i + k]) for i in range(len(w) - k + 1))
    count = {p: a for p, a in count.items() if a >= least}
    out = {}
    for (group, *w), a in count.items():
        if len(w) < 2:
            continue
        if any(g == group and len(v) > len(w) and any(v[i:i + len(w)] == w for i in range(len(v))) and 100 * b >= hide * a for (g, *v), b in count.items()):
            continue
        score, k = min((scale * a // (count[(group, *w[:k])] + count[(group, *w[k:])]), k) for k in range(1, len(w)))
        out.setdefault(group, []).append((-score, -a, " ".join(w).encode(), count[(group, *w[:k])], count[(group, *w[k:])]))
    return sorted((g, i + 1, p.decode(), -a, l, r, total[g], -s) for g, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:first]))


def test_tables(spark):
    folder = "/root/testdata/sf0.01"
    problems, rows = differences(phrases.op11(spark.read.parquet(f"{folder}/documents.parquet")), connect(folder), phrases.OP11_SQL)
    assert not problems and rows > 100


@pytest.mark.parametrize("sample,least,most,first", [(2, 2, 4, 2000), (10 ** 9, 2, 3, 5), (1, 3, 4, 1)])
def test_small(spark, odd, sample, least, most, first):
    """With a sample of no rows everything is left to the closing pass."""
    more = spark.createDataFrame([(90 + i, f"one two three four five. Two three {'x' * i} four", "en") for i in range(7)], "doc_id long, text string, lang string")
    docs = odd.select("doc_id", "text", "lang").filter("length(text) < 1000 or text is null").unionByName(more)
    rows = [(r.lang or "und", r.text) for r in docs.collect()]
    got = phrases.mine(docs, F.col("lang"), least=least, most=most, first=first, sample=sample).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, least, most, first)


def test_edges(spark, odd):
    assert phrases.op11(odd.limit(0)).count() == 0
    assert phrases.op11(odd.filter("text is null or text = ''")).count() == 0
    assert phrases.op11(odd).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_filter_misses_nothing(spark):
    keys = [hash((i, "x")) for i in range(5000)]
    got = phrases.filter_of(spark.createDataFrame([(k,) for k in keys], "key long"))
    import numpy as np
    assert got.has(np.array(keys).view(np.uint64)).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 20000).astype(np.uint64)
    assert got.has(others).mean() < 0.05


def test_a_rare_collision_starts_again(spark, odd, monkeypatch):
    rows = [("und", "a b a b")] * 3
    docs = spark.createDataFrame([(i, t, None) for i, (_, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = phrases.mine(docs, F.col("lang"), least=3).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 3, 4, 2000)
