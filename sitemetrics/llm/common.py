"""Helpers shared by the training-data operators: tables, shared storage and vectorised word hashing."""

import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemetrics.session import cut, shared_dir  # noqa: F401  (cut: for the operators)

# Bytes of text that are turned into arrays at a time; a single longer text is one block.
BLOCK_BYTES = 2 << 20


#: Shuffle files go when the job that wrote them ends, not when the driver collects its garbage; Arrow batches hold few rows, as texts may be long.
WHILE_STORED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings of the jobs inside; the caller's come back afterwards."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder: smaller than a checkpoint for many narrow rows."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    with settings(df.sparkSession, WHILE_STORED):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by `stored` that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/llm-" in path:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_of_id(column="doc_id"):
    """crc32 of the id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_bytes(column):
    """(bytes, offsets) of an Arrow string column; nulls are empty. No copy where the column has no nulls."""
    import pyarrow as pa
    import pyarrow.compute as pc
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def blocks(offsets, limit: int = BLOCK_BYTES):
    """Ranges (first, last) of texts with about `limit` bytes together, at least one text each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def mix64(x):
    """Finaliser that spreads every input bit over the 64-bit word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = np.random.default_rng(20240315).integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def powers(kind: str, n: int):
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        step = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        have = np.full(size, step, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * BLOCK_BYTES:
            _powers[kind] = have
    return have[:n]


_CLASS = np.full(256, 3, np.uint8)
_CLASS[[*range(48, 58)]] = 2
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[_SPACE] = 0


def byte_values(raw):
    """Random value of each byte, for polynomial hashes."""
    return _BYTE[raw]


def words_of(raw, offsets, lower: bool = True, runs: bool = False):
    """Words `[^\\x20\\x09-\\x0D]+` of the texts: (64-bit hash of each word, first word of each text and the end).

    The hash is a polynomial over random byte values, taken from prefix sums, then mixed; with `lower`, A-Z count as a-z.
    With `runs`, words are cut further into runs of letters, of digits and of other characters.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if runs:
        kind = _CLASS[raw]
        edge[1:-1] |= kind[1:] != kind[:-1]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER if lower else _BYTE)[raw] * powers("up", n), out=sums[1:])
    value = (sums[ends] - sums[starts]) * powers("down", n)[starts]
    return mix64(value + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


_ODD = np.random.default_rng(7).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(words, k: int = 5):
    """Sorted distinct hashes of the k-word shingles; fewer words give one shingle, none give none."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    total = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        total += words[j: n - k + 1 + j] * _ODD[j]
    return np.unique(mix64(total))
