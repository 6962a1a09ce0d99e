"""Large groups of near copies that fall into many components, against brute force."""

import random

import pytest

from sitemetrics.llm import neardup
from tests.llm.test_operators import words


def brute(rows):
    sets = {}
    for k, t in rows:
        w = words(t)
        sets[k] = frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: (len(sets[k]), top(k)) for k in sets}


def group(rng, n, length, least, most):
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.sample(range(length), rng.randint(least, most)):
            w[at] = f"v{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("met,most", [(8 << 20, 512), (3000, 4)])
def test_components_of_near_copies(spark, monkeypatch, met, most):
    """Copies changed so far that most pairs fall short of the threshold: links are few and no centre finds them all."""
    monkeypatch.setattr(neardup, "MET", met)
    monkeypatch.setattr(neardup, "MOST", most)
    rng = random.Random(5)
    texts = group(rng, 90, 150, 2, 5) + group(rng, 60, 120, 4, 7) + group(rng, 10, 80, 0, 1)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    expected = brute(rows)
    assert len({c for _, c in expected.values()}) > 20
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.op1(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


def test_cells_find_what_the_arms_cannot(spark):
    """Cells alone, without any earlier link, give the components of all candidates."""
    rng = random.Random(6)
    rows = list(enumerate(group(rng, 60, 150, 2, 4)))
    expected = brute(rows)
    docs = spark.createDataFrame(rows, "rep long, text string").coalesce(1)
    sketched = docs.selectExpr("rep as place", "text", "rep as row_id", "'' as mark").mapInArrow(
        neardup._sketch_rows, "place bigint, row_id bigint, mark string, n bigint, set1 bigint, set2 bigint, bands binary, sig binary")
    sketched = neardup.stored(sketched).withColumnRenamed("place", "rep")
    shared = sketched.select("rep", "bands").mapInArrow(neardup._explode_bands, "band bigint, rep bigint")
    none = spark.createDataFrame([], "node long, root long")
    links = neardup._settled(shared, none, sketched.select("rep", "sig"), sketched.select("rep", "n"), lambda wanted: docs.join(wanted, "rep"))
    found = {r.node: r.root for r in neardup.components(links).collect()}
    assert {k: found.get(k, k) for k, _ in rows} == {k: c for k, (_, c) in expected.items()}
    assert links.count() <= 50 * len(rows)
