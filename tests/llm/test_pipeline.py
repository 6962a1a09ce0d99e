"""Each stage of the pipeline against a plain version, and on odd rows."""

import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitemetrics.llm import langid, mixing, pii, quality
from tests.llm.test_neardup_groups import brute

COLUMNS = list(corpus_pipeline.COLUMNS)
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def test_language_stage(spark, docs):
    found = {r.doc_id: r.lang_pred for r in langid.op2(docs).collect()}
    expected = sorted([(r.doc_id, r.text, found[r.doc_id], r.source, r.n_chars) for r in docs.collect() if found[r.doc_id] != "und"], key=str)
    assert rows(STAGES["language_id"](spark, docs, "")) == expected


def test_near_duplicate_stage(spark, docs):
    kept = {k for k, (_, c) in brute([(r.doc_id, r.text) for r in docs.collect()]).items() if k == c}
    assert rows(STAGES["near_duplicates"](spark, docs, "")) == sorted([tuple(r[c] for c in COLUMNS) for r in docs.collect() if r.doc_id in kept], key=str)
    assert len(kept) < docs.count()


def test_personal_data_stage(spark, docs):
    spans = {r.doc_id: r.spans for r in pii.op4(docs).collect()}
    expected = []
    for r in docs.collect():
        found = sorted((int(a), -int(b), kind) for kind, a, b in (s.split(":") for s in spans[r.doc_id].split(",") if s))
        text, at = "", 0
        for a, b, kind in found:
            if a >= at:
                text += r.text[at:a] + f"[{kind.upper()}]"
            at = max(at, -b)
        text += r.text[at:]
        expected.append((r.doc_id, text, r.lang, r.source, len(text)))
    assert rows(STAGES["personal_data"](spark, docs, "")) == sorted(expected, key=str)


def test_mixing_stage(spark, docs):
    copies = {r.doc_id: max(r.copies, int(r.size == 0)) for r in mixing.op3(docs).collect()}
    got = Counter(r.doc_id for r in STAGES["mixing"](spark, docs, "").collect())
    assert got == Counter({k: n for k, n in copies.items() if n})


def test_packing_stage(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    pieces, windows = {}, {}
    for r in STAGES["packing"](spark, docs, "").collect():
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    for d in docs.collect():
        ids = [*model.encode(d.text, add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(pieces[d.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            at += p.length
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[p.start: at]))
        assert at == len(ids)
    for inside in windows.values():
        at = 0
        for p in sorted(inside, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_odd_rows(spark, odd, name):
    given = odd.withColumns({"lang_pred": F.lit("x"), "rep": F.lit(1), "mix_size": F.lit(2), "pii_spans": F.lit(3), "score": F.lit(4)})
    out = STAGES[name](spark, given, "")
    got = out.collect()
    assert (out.columns == COLUMNS) == (name != "packing")
    ids = {r.doc_id for r in given.collect()}
    assert {r.doc_id for r in got} <= ids and got
    assert STAGES[name](spark, given.limit(0), "").count() == 0


def test_regularised_leader_by_definition():
    """The vectorised training against one coordinate at a time."""
    import math

    import numpy as np
    rng = np.random.default_rng(2)
    examples = [(rng.integers(0, 16, rng.integers(0, 12)).astype(np.int32), int(rng.integers(0, 2))) for _ in range(40)]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 1e-4
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(2):
        for found, label in examples:
            x = Counter(found.tolist())
            x = {i: c / math.sqrt(max(1, len(found))) for i, c in x.items()} | {16: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    weights, bias = quality.train(examples, bits=4, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    assert weights == pytest.approx([weight(i) for i in range(16)], rel=1e-5, abs=1e-7) and bias == pytest.approx(weight(16), rel=1e-9)


def test_text_score_is_the_sum_over_segmentations(docs):
    """Posterior of a text from all segmentations of its words, counted one by one in plain Python."""
    import math
    langs, pieces, table = langid.fit(docs)
    index = langid.Pieces(pieces)
    number = {p: i for i, p in enumerate(pieces)}
    text = "The old house, by the Sea"

    def word_sum(word, g):
        sums = [1.0] + [0.0] * len(word)
        for t in range(1, len(word) + 1):
            for size in range(1, min(t, langid.LONGEST) + 1):
                piece = word[t - size:t]
                p = table[number[piece], g] if piece in number else (table[index.n + 1, g] if size == 1 else 0.0)
                sums[t] += sums[t - size] * p
        return sums[-1]
    logs = [sum(math.log(word_sum(w, g)) for w in text.lower().replace(",", "").split()) for g in range(len(langs))]
    best = max(range(len(langs)), key=lambda g: logs[g])
    (pred,), (score,) = langid.score_texts([text], langs, index, table)
    assert pred == langs[best] and score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs), rel=1e-4)
