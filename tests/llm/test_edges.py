"""Edge cases of single operators that once went wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitemetrics.llm import knn, mixing, pii


def brute_top(rows, k, every):
    """rows: (id, vector) with ids as they are; score in Python integers."""
    import math
    ready = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows]
    out = set()
    for q in {i for i, _ in ready if i % every == 0}:
        best = {}
        scored = []
        for v in {tuple(v) for i, v in ready if i == q}:
            scored += [(-sum(a * b for a, b in zip(v, w)), i) for i, w in ready if i != q and len(w) == len(v)]
        for rank, (score, i) in enumerate(sorted(scored)[:k]):
            best[rank + 1] = (i, -score)
        out |= {(q, r, i, s) for r, (i, s) in best.items()}
    return out


@pytest.mark.parametrize("scale", [1.0, 2e5, 5e5])
def test_top_k_is_exact_for_large_components(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(scale, 1, 16)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in knn.op7(df).collect()} == brute_top(rows, 10, 100)


def test_top_k_of_repeated_ids_ties_and_lengths(spark):
    rng = np.random.default_rng(5)
    one = [0.5, 0.25, -1.0]
    rows = [(0, one)] * 12 + [(i, [float(x) for x in rng.normal(0, 1, 3)]) for i in range(1, 21)] + [(300 + i, one) for i in range(4)]
    rows += [(100, [1.0, 2.0]), (101, [3.0, 1.0]), (102, [3.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cell string, n int")
    got = [tuple(r) for r in knn.op7(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_top(rows, 10, 100)
    assert sum(q == 0 for q, *_ in got) == 10


def test_top_k_parts_of_a_cell(spark, monkeypatch):
    monkeypatch.setattr(knn, "PART", 1)
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, 4)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert {tuple(r) for r in knn.top_k(df, F.col("id") % 100 == 0, 10, 3).collect()} == brute_top(rows, 10, 100)


def test_mix_of_equal_rows_meets_its_target(spark):
    rows = [(7, "a b c d", "s1")] * 1000 + [(None, f"x{i} y z", "s2") for i in range(300)] + [(i, "one two", "s3") for i in range(200)] + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.op3(df).collect()
    assert len(got) == len(rows)
    for source_size in {4000, 900, 400}:
        mine = [r for r in got if r.source_size == source_size]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 4 and all(r.taken <= 2 * r.size for r in mine)
    assert sorted(map(str, mixing.op3(df).collect())) == sorted(map(str, got))


def test_context_reaches_over_an_earlier_match(spark):
    df = spark.createDataFrame([(1, "ssn: 123-45-6789, 987-65-4321"), (2, "123-45-6789 and 987-65-4321"), (3, "e-mail a@b.org")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.op4(df).collect()}
    assert got[1].spans == "ssn:5:16,ssn:18:29" and got[2].spans == "" and got[3].top_score == 0.75


@pytest.mark.parametrize("spoiled", ["<svg>", "<select>", "<iframe src='x'>", "<noscript>", "<object>", "<svg><svg><b>drawn</b></svg><i>drawn</i></svg>",
                                     "<select><option>drawn<option>drawn</select>", "<option>drawn</option>", "<video><video>drawn</video></video>"])
def test_pages_with_hidden_elements_keep_the_text(spoiled):
    from sitemetrics.llm import extract
    page = f"<html><body><article><p>First paragraph.</p>{spoiled}<p>Second one.</p><p>So <math><mi>x</mi></math> is.</p></article></body></html>"
    text = " ".join(raw for node in extract.parse(page) for _, raw in node.parts)
    assert "First paragraph." in text and "Second one." in text and "x" in text and "drawn" not in text


def test_unclosed_options_take_linear_time():
    import time

    from sitemetrics.llm import extract
    begin = time.perf_counter()
    nodes = extract.parse("<p>" + "<svg><option>a " * 20_000 + "</p>end")
    assert time.perf_counter() - begin < 3 and any("end" in raw for n in nodes for _, raw in n.parts)


def test_fingerprints_of_text_without_sentences(spark):
    from sitemetrics.llm import fingerprint
    rng = np.random.default_rng(8)
    words = " ".join("".join(rng.choice(list("abcdefgho"), rng.integers(2, 8))) for _ in range(3000))
    rows = [(3, words), (2, "語" * 9000 + "".join(chr(0x4E00 + int(i)) for i in rng.integers(0, 5000, 9000))), (1, "word " * 2000)]
    got = {r.doc_id: r for r in fingerprint.op8(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for key in (2, 3):
        assert got[key].near_edited > 0.5 > got[key].near_next
