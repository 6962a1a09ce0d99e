"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's features are its words (runs of letters, of digits and of other characters) and word pairs (a pair of equal words is one feature for all words), hashed into 2^BITS slots; each occurrence weighs 1/sqrt(number of occurrences). The
score is the logistic of a sparse dot product and a bias. Training runs over at most about ROWS labelled rows (drawn by a digest of the id, so that every run
draws the same), in the order of that digest, for EPOCHS passes; the weights, of fixed size, are broadcast. Texts are scored whole,
by Arrow batches, without a shuffle.

Defined cases: null and empty texts have no features and get the score of the bias; labels that are null or neither 0 nor 1, and
rows without a label, teach nothing; without any labelled row every score is 0.5; repeated rows are scored alike; an empty table
gives an empty result.
"""

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.llm.common import blocks, crc_of_id, mix64, small_batches, text_bytes, words_of

#: Bound on the labelled rows learned from; slots of the weight table as a power of two.
ROWS, BITS, EPOCHS = 6000, 18, 5
#: Follow-the-regularised-leader: learning rate, smoothing, L1, L2.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 1e-4
KEEP = 0.3


def slots(words, first, bits=BITS):
    """(slots of all words and word pairs, first feature of each text and the end)."""
    shift = np.uint64(64 - bits)
    n = len(words)
    pair_ok = np.ones(n, bool)
    pair_ok[first[1:][first[1:] > 0] - 1] = False   # the last word of a text starts no pair
    pairs = mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    pairs[words[:-1] == words[1:]] = 1   # a word repeated at once is one feature, whichever word it is
    pairs = pairs[pair_ok[:-1]] if n else words
    upto = np.zeros(n + 1, np.int64)
    np.cumsum(pair_ok, out=upto[1:])
    return (words >> shift).astype(np.int32), first, (pairs >> shift).astype(np.int32), upto[first]


def train(examples, bits=BITS, epochs=EPOCHS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
    """Weights and bias from [(slots, label)]: per-coordinate FTRL, weights materialised only for the slots of an example."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for found, label in examples:
            index, times = np.unique(found, return_counts=True)
            index = np.append(index, size - 1)
            value = np.append(times / math.sqrt(max(1, len(found))), 1.0)
            zi, ni = z[index], n[index]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            margin = float(w @ value)
            p = 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, margin))))
            g = (p - label) * value
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[index] += g - sigma * w
            n[index] += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w[:-1].astype(np.float32), float(w[-1])


def _featurize(batches):
    import pyarrow as pa
    for batch in batches:
        raw, offsets = text_bytes(batch.column(0))
        found = []
        for a, b in blocks(offsets):
            words, first = words_of(raw[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], runs=True)
            one, f1, two, f2 = slots(words, first)
            found += [np.concatenate([one[f1[i]: f1[i + 1]], two[f2[i]: f2[i + 1]]]).tobytes() for i in range(b - a)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1), batch.column(2)], ["slots", "label", "place"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS):
    """Model from the labelled rows whose id does not hash to the held-out fifth; at most about `rows` of them."""
    spark = docs.sparkSession
    known = labels.filter(F.col("quality").isin(0, 1) & (crc_of_id() % 5 != 0) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").alias("label"))
    known = known.withColumn("place", F.xxhash64(F.lit("order"), "doc_id"))
    total = known.count()
    if not total:
        return np.zeros(1 << BITS, np.float32), 0.0
    share = min(1.0, rows / total)
    edge = int((share - 0.5) * float(1 << 64)) if share < 1 else (1 << 63) - 1
    some = known.filter(F.col("place") <= F.lit(max(-(1 << 63), min(edge, (1 << 63) - 1))))
    small_batches(spark)
    taught = (docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "label", "place")
              .mapInArrow(_featurize, "slots binary, label int, place bigint").collect())
    taught.sort(key=lambda r: (r.place, r.label, bytes(r.slots)))
    return train([(np.frombuffer(bytes(r.slots), np.int32), r.label) for r in taught])


def score(docs: DataFrame, model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score between 0 and 1."""
    from pyspark.sql.pandas.functions import arrow_udf
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def scored(column):
        import pyarrow as pa
        weights, bias = shared.value
        raw, offsets = text_bytes(column)
        result = np.empty(len(offsets) - 1)
        for a, b in blocks(offsets):
            words, first = words_of(raw[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], runs=True)
            one, f1, two, f2 = slots(words, first)
            s1 = np.concatenate([[0.0], np.cumsum(weights[one], dtype=np.float64)])
            s2 = np.concatenate([[0.0], np.cumsum(weights[two], dtype=np.float64)])
            n = np.maximum(1, np.diff(f1) + np.diff(f2))
            result[a:b] = (np.diff(s1[f1]) + np.diff(s2[f2])) / np.sqrt(n) + bias
        # Prefix sums differ in the last bits with the place in the batch: round before anything depends on it.
        return pa.array(np.round(1.0 / (1.0 + np.exp(-np.clip(result, -35, 35))), 9))
    return docs.withColumn(out, scored(F.col(text)))


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score",
                         F.when(F.col("score") >= KEEP, 1).otherwise(0).cast("int").alias("predicted"))
