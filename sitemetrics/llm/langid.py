"""Language identification by unigram pieces whose segmentations are summed out.

The pieces are the letter-only entries of a fixed public vocabulary (lower-cased, at most LONGEST letters). Each language has piece
probabilities, fitted by expectation maximisation on the words of a bounded sample of labelled texts. A word's probability is the sum over
all its segmentations into pieces (forward algorithm); a text's score is the product over its words (maximal runs of letters, lower-cased).
Texts are scored whole, by Arrow batches, without a shuffle; each distinct word of a block is scored once.

Defined cases: a null text and a text without a letter are `und` with score 0; letters that no piece covers have a small fixed
probability in every language; runs of letters are cut every CHUNK letters; with no labelled row to learn from everything is `und`; equal
scores go to the language that comes first by code point; repeated rows are scored alike; an empty table gives an empty result.
"""

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sitemetrics.llm.common import crc_of_id, mix64, small_batches

#: Bound on the texts learned from, a language; letters of a piece; letters after which a run is cut; passes of the fit.
ROWS_PER_LANG, LONGEST, CHUNK, PASSES = 400, 8, 48, 4
VOCABULARY = "piece_bpe_32k.model"
FLOOR, SMOOTH = 1e-8, 1e-3
#: Binary digits by which sums that became small are lifted.
STEP = 300
#: Letters scored at a time, and distinct words in one lattice: arrays stay at a few MB, which workers give back.
BLOCK, WORDS_AT_ONCE = 1 << 20, 4000

_alpha = None


def _letters():
    global _alpha
    if _alpha is None:
        _alpha = np.array([chr(c).isalpha() for c in range(0x110000)], bool)
    return _alpha


def pieces_of(vocabulary: str | None = None) -> list[str]:
    """Letter-only pieces of a public vocabulary file, sorted."""
    import sentencepiece
    if vocabulary is None:
        import public_tokenizers
        vocabulary = public_tokenizers.path(VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    found = {model.id_to_piece(i).replace("▁", "").lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if p.isalpha() and len(p) <= LONGEST)


_STEP = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(CHUNK + 1)], np.uint64)


def _hash(letters, starts, length):
    """Hash of `length` letters from each start."""
    total = np.full(len(starts), length, np.uint64)
    for k in range(length):
        total += (letters[starts + k].astype(np.uint64) + np.uint64(0x51ED27)) * _STEP[k]
    return mix64(total)


class Pieces:
    """Finds the number of a run of letters among the pieces: a sorted table of hashes behind a first-bits filter."""

    def __init__(self, pieces):
        self.n = len(pieces)
        letters = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(p) for p in pieces])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if self.n else np.zeros(0, np.int64)
        keys = np.zeros(self.n, np.uint64)
        for n in np.unique(lengths):
            keys[lengths == n] = _hash(letters, starts[lengths == n], int(n))
        order = np.argsort(keys)
        self.keys, self.number = keys[order], order.astype(np.int32)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[keys >> np.uint64(42)] = True

    def find(self, hashes):
        """Number of each hash's piece, or n."""
        out = np.full(len(hashes), self.n, np.int32)
        some = np.flatnonzero(self.maybe[hashes >> np.uint64(42)])
        if len(some):
            at = np.minimum(np.searchsorted(self.keys, hashes[some]), self.n - 1)
            hit = self.keys[at] == hashes[some]
            out[some[hit]] = self.number[at[hit]]
        return out


def words_in(texts):
    """Lower-cased letter runs of the texts: (letters, starts, ends, first word of each text and the end)."""
    low = [t.lower() if t else "" for t in texts]
    letters = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass") or b"", np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    inside = np.zeros(len(letters) + 2, bool)
    inside[1:-1] = _letters()[letters]
    step = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = np.flatnonzero(ends - starts > CHUNK)
    if len(long):
        extra = [np.arange(starts[i] + CHUNK, ends[i], CHUNK) for i in long]
        more = np.concatenate(extra)
        starts = np.sort(np.concatenate([starts, more]))
        ends = np.sort(np.concatenate([ends, more]))
    return letters, starts, ends, np.searchsorted(starts, offsets)


def distinct(letters, starts, ends):
    """(place of one word of each kind, kind of every word)."""
    keys = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    for n in np.unique(lengths):
        keys[lengths == n] = _hash(letters, starts[lengths == n], int(n))
    _, at, kind = np.unique(keys, return_index=True, return_inverse=True)
    return at, kind


def lattice(pieces: Pieces, letters, starts, ends):
    """For each word length: (words, numbers of the pieces [word, end, letters of the piece - 1]); one letter without a piece gets n + 1."""
    lengths = ends - starts
    for n in np.unique(lengths):
        n = int(n)
        which = np.flatnonzero(lengths == n)
        numbers = np.full((len(which), n + 1, min(n, LONGEST)), pieces.n, np.int32)
        for size in range(1, min(n, LONGEST) + 1):
            at = (starts[which][:, None] + np.arange(n - size + 1)[None, :]).ravel()
            found = pieces.find(_hash(letters, at, size)).reshape(len(which), -1)
            if size == 1:
                found = np.where(found == pieces.n, pieces.n + 1, found)
            numbers[:, size:, size - 1] = found
        yield n, which, numbers


def _lift(sums, scale, t, window):
    """Where sums[:, t] has become small, the sums still in use are multiplied by 2^STEP, exactly, and their scale counts one more."""
    small = sums[:, t] < 2.0 ** -STEP
    if small.any():
        factor = np.where(small, 2.0 ** STEP, 1.0)[:, None]
        sums[:, window] *= factor
        scale[:, window] += small[:, None]


def scaled_forward(n, numbers, table):
    """Sums over segmentations up to each letter and their scales, both [word, n + 1, languages]: a sum stands for itself times 2^(-STEP * scale).

    table has rows for `no piece` (0) and unknown letters. A letter alone has at least FLOOR, so no sum underflows between two lifts.
    """
    alpha = np.zeros((len(numbers), n + 1, table.shape[1]))
    scale = np.zeros(alpha.shape, np.int16)
    alpha[:, 0] = 1.0
    for t in range(1, n + 1):
        for size in range(1, min(t, LONGEST) + 1):
            alpha[:, t] += alpha[:, t - size] * table[numbers[:, t, size - 1]]
        scale[:, t] = scale[:, t - 1]
        _lift(alpha, scale, t, slice(max(0, t - LONGEST + 1), t + 1))
    return alpha, scale


def scaled_backward(n, numbers, p):
    """Sums over segmentations from each letter on, of one language: (sums, scales), [word, n + 1, 1]."""
    beta = np.zeros((len(numbers), n + 1, 1))
    scale = np.zeros(beta.shape, np.int16)
    beta[:, n] = 1.0
    for t in range(n - 1, -1, -1):
        for size in range(1, min(n - t, LONGEST) + 1):
            beta[:, t, 0] += p[numbers[:, t + size, size - 1]] * beta[:, t + size, 0]
        scale[:, t] = scale[:, t + 1]
        _lift(beta, scale, t, slice(t, t + LONGEST))
    return beta, scale


def forward(n, numbers, table):
    """Sums over segmentations up to each letter, [word, n + 1, languages], as plain numbers: 0 where they are below the least double."""
    alpha, scale = scaled_forward(n, numbers, table)
    return np.ldexp(alpha, -STEP * scale)


def log_probability(n, numbers, table):
    """Log of the sum over all segmentations of each word: [word, languages], always finite."""
    alpha, scale = scaled_forward(n, numbers, table)
    return np.log(alpha[:, n]) - scale[:, n] * (STEP * math.log(2.0))


def learn(counts: dict[str, dict[str, int]], pieces: list[str], passes: int = PASSES):
    """(languages, table of probabilities) from word counts of each language."""
    index = Pieces(pieces)
    langs = sorted(counts)
    table = np.zeros((index.n + 2, len(langs)))
    for g, lang in enumerate(langs):
        words = sorted(counts[lang])
        weight = np.array([counts[lang][w] for w in words], float)
        letters, starts, ends, _ = words_in(words)
        at, kind = distinct(letters, starts, ends)
        weight = np.bincount(kind, np.repeat(weight, 1), len(at)) if len(kind) == len(weight) else np.ones(len(at))
        shapes = list(lattice(index, letters, starts[at], ends[at]))
        p = np.full(index.n + 2, 1.0 / max(1, index.n))
        p[index.n], p[index.n + 1] = 0.0, FLOOR
        for _ in range(passes):
            expected = np.zeros(index.n + 2)
            for n, which, numbers in shapes:
                (alpha, up), (beta, down) = scaled_forward(n, numbers, p[:, None]), scaled_backward(n, numbers, p)
                alpha, up, beta, down = alpha[:, :, 0], up[:, :, 0], beta[:, :, 0], down[:, :, 0]
                share = weight[which] / alpha[:, n]
                for t in range(1, n + 1):
                    for size in range(1, min(t, LONGEST) + 1):
                        ids = numbers[:, t, size - 1]
                        part = alpha[:, t - size] * p[ids] * beta[:, t] * share
                        expected += np.bincount(ids, np.ldexp(part, STEP * (up[:, n] - up[:, t - size] - down[:, t])), index.n + 2)
            expected[index.n:] = 0.0
            p = (1 - SMOOTH) * expected / max(expected.sum(), 1e-300) + SMOOTH / max(1, index.n)
            p[index.n], p[index.n + 1] = 0.0, FLOOR
        table[:, g] = p
    return langs, table


def _count_words(batches):
    import pyarrow as pa
    for batch in batches:
        counts: dict[tuple[str, str], int] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            letters, starts, ends, _ = words_in([text])
            for a, b in zip(starts, ends):
                word = letters[a:b].tobytes().decode("utf-32-le", "surrogatepass")
                counts[lang, word] = counts.get((lang, word), 0) + 1
        rows = [(lang, word, n) for (lang, word), n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                          pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])


def fit(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, vocabulary: str | None = None, text="text", lang="lang", ident="doc_id"):
    """Model from rows with a language whose id does not hash to the held-out quarter, about `rows_per_lang` of each language at most."""
    small_batches(docs.sparkSession)
    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.lit("lang"), F.col(ident)).alias("place"),
                        crc_of_id(ident).alias("crc")).filter("lang is not null and text is not null and crc % 4 != 2")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    edge = F.lit((1 << 63) - 1)
    for name, n in sorted(sizes.items()):
        if n > rows_per_lang:
            edge = F.when(F.col("lang") == name, F.lit(int((rows_per_lang / n - 0.5) * float(1 << 64)))).otherwise(edge)
    counted = (known.filter(F.col("place") <= edge).select("text", "lang").mapInArrow(_count_words, "lang string, word string, n bigint")
               .groupBy("lang", "word").agg(F.sum("n").alias("n")).collect())
    counts: dict[str, dict[str, int]] = {}
    for r in counted:
        counts.setdefault(r.lang, {})[r.word] = r.n
    if not counts:
        return None
    pieces = pieces_of(vocabulary)
    langs, table = learn(counts, pieces)
    return langs, pieces, table


def score_texts(texts, langs, index: Pieces, table):
    """(language or `und`, posterior) of each text."""
    preds, scores = [], []
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or "") <= BLOCK):
            size += len(texts[last] or "")
            last += 1
        letters, starts, ends, bounds = words_in(texts[first:last])
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        total = np.zeros((last - first, len(langs)))
        if len(starts):
            at, kind = distinct(letters, starts, ends)
            value = np.zeros((len(at), len(langs)))
            for n, which, numbers in lattice(index, letters, starts[at], ends[at]):
                for a in range(0, len(which), WORDS_AT_ONCE):
                    value[which[a:a + WORDS_AT_ONCE]] = log_probability(n, numbers[a:a + WORDS_AT_ONCE], table)
            # Each text is summed by itself: what stands beside it in the block cannot change it.
            total[full] = np.add.reduceat(value[kind], bounds[full], axis=0)
        for i in range(last - first):
            if bounds[i] == bounds[i + 1]:
                preds.append("und")
                scores.append(0.0)
                continue
            own = np.round(total[i] - total[i].max(), 6)
            best = int(np.argmax(own))
            preds.append(langs[best])
            scores.append(round(1.0 / math.fsum(np.exp(own - own[best])), 9))
        first = last
    return preds, scores


def predict(docs: DataFrame, model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with lang_pred and score.

    Whole rows go through the Arrow step batch by batch, so that none wait on the heap for their result."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("lang_pred", "score")
    keep = [c for c in docs.columns if keep is None or c in keep]
    if model is None:
        return docs.select(*keep).withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = spark.sparkContext.broadcast(model)
    passed = docs.select(F.col(text).alias("__text"), *keep)

    def run(batches):
        import pyarrow as pa
        langs, pieces, table = shared.value
        index = Pieces(pieces)
        for batch in batches:
            preds, scores = score_texts(batch.column(0).to_pylist(), langs, index, table)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(preds, pa.string()), pa.array(scores, pa.float64())],
                                             [*batch.schema.names[1:], "lang_pred", "score"])
    schema = StructType([docs.schema[c] for c in keep] + [StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return passed.mapInArrow(run, schema)


def op2(docs: DataFrame) -> DataFrame:
    found = predict(docs.select("doc_id", "text"), fit(docs), keep=["doc_id"])
    return found.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "lang_pred", "score")
