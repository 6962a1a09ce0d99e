"""Phrase collocations by Toivonen's sampling method: a sample proposes frequent phrases, one pass counts them and their negative border.

Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words `[^\\x20\\x09]+`; all counts are per group (language).

1. The sample (every SAMPLE-th document by a digest of its id) proposes: phrases of 1 to MOST words found at least PROPOSE times in it.
2. One pass over all documents counts every phrase whose two parts without the last and without the first word were proposed: the proposed
   phrases and their negative border (every word is in the border). A phrase found frequent that was not proposed is a border failure.
3. While the border fails, a further pass counts what no counted phrase rules out: uncounted phrases all of whose counted parts are
   frequent. As a phrase is never more frequent than its parts, what is then uncounted is infrequent.

All counts are exact and cover all documents; the sample decides only what is counted when. Proposed and frequent phrases reach the tasks as bit
filters, of 16 bits a phrase and at most FILTER_BITS; a wrongly passing phrase is counted and found infrequent. Tasks combine equal phrases before the shuffle.
A phrase is known by the digest of its words but the last and that of its last word, 64 bits each; its parts are found by joins. The words of the
reported phrases are read back as text; two spellings of one digest make the run start again with another seed.

Defined cases: null and empty texts have no words; a null group is `und`, together with a group of that name; rows are counted as often as they occur; ties end
with the phrase by bytes; a group without frequent phrases has no row, and an empty table gives an empty result; further columns are ignored.
"""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitemetrics.llm.common import _LOWER, blocks, discard, mix64, powers, stored, text_bytes

#: Least count, words of a phrase, rows of a group, share a longer phrase needs to hide a part (percent), factor of the score.
LEAST, MOST, FIRST, HIDE, SCALE = 30, 4, 2000, 80, 2_000_000
#: One document in SAMPLE, proposals from PROPOSE occurrences, bits of a filter at most, buffered phrases of a task, text bytes at a time.
SAMPLE, PROPOSE, FILTER_BITS, BUFFER, PART = 8, 2, 1 << 28, 500_000, 1 << 19

_KIND = np.zeros(256, np.uint8)   # 0 in a word, 1 blank, 2 break
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_STEP = (0, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def words_and_pieces(raw, offsets, seed: int = 0):
    """(digest, piece, start, end) of each word; pieces never cross texts."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    kind = _KIND[raw]
    word = kind == 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.append(False, word[:-1])
    after = np.append(word[1:], False)
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    piece = np.cumsum((kind == 2) | edge[:-1])[starts]
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_LOWER[raw] * powers("up", n), out=sums[1:])
    value = (sums[ends] - sums[starts]) * powers("down", n)[starts]
    return mix64(value + (ends - starts).astype(np.uint64) + np.uint64(seed)), piece, starts, ends


def extend(prefix, word, length: int):
    """Digest of the phrase of `length` words from that of all but the last and the last word's."""
    return mix64(prefix * np.uint64(_STEP[1]) + word * np.uint64(_STEP[2]) + np.uint64(length))


class Filter:
    """Bit set of digests, two places each: no member is missed, about one other in sixty passes."""

    def __init__(self, words):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    def has(self, keys):
        found = np.ones(len(keys), bool)
        for place in places(keys):
            place = place & self.mask
            found &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return found


def places(keys):
    return keys, mix64(keys ^ np.uint64(_STEP[3]))


def _bits(mask):
    """(word of the filter, its bits) for a batch of keys."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            place = np.concatenate([p & np.uint64(mask) for p in places(keys)])
            word, first = np.unique(place >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, first, np.uint64(1) << (place & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])
    return run


def filter_of(keys: DataFrame) -> Filter:
    """Filter over a column `key`; it is put together by a shuffle, and at most FILTER_BITS come to the driver."""
    size = 1 << 16
    while size < min(FILTER_BITS, 16 * keys.count()):
        size *= 2
    rows = keys.select("key").mapInArrow(_bits(size - 1), "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size >> 6, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Filter(words)


def phrases(word, piece, most: int):
    """Per length: (prefix digest, last word, digest) of the phrase that starts at each word, and whether the words are of one piece."""
    n = len(word)
    out = [None, (np.zeros(n, np.uint64), word, word, np.ones(n, bool))]
    for k in range(2, most + 1):
        m = max(0, n - k + 1)
        prefix, last = out[-1][2][:m], word[k - 1:]
        out.append((prefix, last, extend(prefix, last, k), piece[:m] == piece[k - 1:]))
    return out


def words_sampled(found, given):
    yield 1, found[1][3]


def phrases_sampled(found, given):
    """All phrases of proposed words."""
    inside = given["proposed"].has(found[1][2])
    for k in range(2, len(found)):
        inside = inside[:-1] & inside[1:] if len(inside) else inside
        yield k, inside & found[k][3]


def proposed_and_border(found, given):
    """Phrases both of whose parts were proposed."""
    counted = found[1][3]
    for k in range(1, len(found)):
        yield k, counted
        inside = counted & given["proposed"].has(found[k][2])
        if k + 1 < len(found):
            counted = (inside[:-1] & inside[1:] if len(inside) else inside) & found[k + 1][3]


def left_open(found, given):
    """Phrases not counted so far that no counted part rules out."""
    counted = open_ = found[1][3]
    for k in range(1, len(found)):
        inside = counted & given["proposed"].has(found[k][2])
        if k > 1:
            yield k, open_ & ~counted
        open_ = np.where(counted, given["frequent"].has(found[k][2]), open_)
        if k + 1 < len(found):
            ok = found[k + 1][3]
            counted, open_ = ((v[:-1] & v[1:] if len(v) else v) & ok for v in (inside, open_))


def _count(rule, most, seed, shared):
    """(grp, words, prefix, last, n) of the phrases that the rule chooses; words = 0 counts all words of the group."""
    def run(batches):
        import pyarrow as pa
        given = {k: Filter(v) for k, v in shared.value.items()} if shared is not None else {}
        held, size = {}, 0

        def flush():
            nonlocal held, size
            for (group, k), arrays in held.items():
                prefix, last, key, times = (np.concatenate(a) for a in zip(*arrays))
                _, first, back = np.unique(key, return_index=True, return_inverse=True)
                total = np.bincount(back, times, len(first)).astype(np.int64)
                for a in range(0, len(first), 1 << 16):
                    at = first[a: a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([group] * len(at), pa.string()), pa.array(np.full(len(at), k, np.int8)), pa.array(prefix[at].view(np.int64)),
                         pa.array(last[at].view(np.int64)), pa.array(total[a: a + (1 << 16)])], ["grp", "words", "prefix", "last", "n"])
            held, size = {}, 0

        for batch in batches:
            group = batch.column(0).dictionary_encode()
            code = group.indices.to_numpy()
            for c, name in enumerate(group.dictionary.to_pylist()):
                raw, offsets = text_bytes(batch.column(1).take(pa.array(np.flatnonzero(code == c))))
                for a, b in blocks(offsets, PART):
                    word, piece, _, _ = words_and_pieces(raw[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], seed)
                    if not len(word):
                        continue
                    zero = np.zeros(1, np.uint64)
                    held.setdefault((name, 0), []).append((zero, zero, zero, np.array([len(word)])))
                    found = phrases(word, piece, most)
                    for k, chosen in rule(found, given):
                        prefix, last, key, _ = found[k]
                        key, first, times = np.unique(key[chosen], return_index=True, return_counts=True)
                        held.setdefault((name, k), []).append((prefix[chosen][first], last[chosen][first], key, times))
                        size += len(key)
                    if size > BUFFER:
                        yield from flush()
        yield from flush()
    return run


def counts(texts: DataFrame, rule, least: int, most: int, seed: int, **given) -> DataFrame:
    """Stored (grp, words, prefix, last, n, key) of the phrases chosen by the rule that occur `least` times, and the words = 0 row of each group."""
    shared = texts.sparkSession.sparkContext.broadcast({k: v.words for k, v in given.items()}) if given else None   # 2 * FILTER_BITS at most
    rows = (texts.mapInArrow(_count(rule, most, seed, shared), "grp string, words tinyint, prefix bigint, last bigint, n bigint")
            .groupBy("grp", "words", "prefix", "last").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("words") == 0)))
    out = stored(rows.mapInArrow(_with_key, "grp string, words tinyint, prefix bigint, last bigint, n bigint, key bigint"))
    if shared is not None:
        shared.unpersist()
    return out


def _with_key(batches):
    import pyarrow as pa
    for batch in batches:
        k, prefix, last = (batch.column(i).to_numpy() for i in (1, 2, 3))
        key = last.view(np.uint64).copy()
        for length in range(2, MOST + 1):
            at = k == length
            key[at] = extend(prefix[at].view(np.uint64), last[at].view(np.uint64), length)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], [*batch.schema.names, "key"])


def frequent(texts: DataFrame, sampled, least: int, most: int, seed: int) -> DataFrame:
    """All phrases of 1 to `most` words with at least `least` occurrences in their group: rows as of `counts`."""
    some, texts = texts.filter(sampled).select("grp", "text"), texts.select("grp", "text")
    words = counts(some, words_sampled, PROPOSE, 1, seed)
    word_filter = filter_of(words.filter("words > 0"))
    longer = counts(some, phrases_sampled, PROPOSE, most, seed, proposed=word_filter)
    proposed = words.unionByName(longer).filter("words > 0")
    given = filter_of(proposed)
    found = counts(texts, proposed_and_border, least, most, seed, proposed=given)
    failures = found.filter(F.col("words").between(1, most - 1)).join(proposed.select("key"), "key", "left_anti")
    if not failures.isEmpty():
        # Everything not ruled out is counted at once, so one pass closes the border.
        more = counts(texts, left_open, least, most, seed, proposed=given, frequent=filter_of(found.filter("words > 0")))
        found = found.unionByName(more.filter("words > 0"))
    discard(words, longer)
    return found


def spelled(found: DataFrame, most: int) -> DataFrame:
    """(grp, ws, a): the phrases as arrays of word digests, by joining each to its prefix."""
    known = found.filter("words = 1").select("grp", F.array("last").alias("ws"), F.col("n").alias("a"), "key")
    out = known
    for k in range(2, most + 1):
        longer = found.filter(F.col("words") == k).select("grp", F.col("prefix").alias("before"), "last", "n", F.col("key").alias("own"))
        known = (longer.join(known.select(F.col("grp").alias("g"), F.col("key").alias("k"), "ws"), (F.col("grp") == F.col("g")) & (F.col("before") == F.col("k")))
                 .select("grp", F.concat("ws", F.array("last")).alias("ws"), F.col("n").alias("a"), F.col("own").alias("key")))
        out = out.unionByName(known)
    return out.drop("key")


def scored(known: DataFrame, most: int, hide: int, scale: int) -> DataFrame:
    """(grp, ws, a, l, r, score) of the candidates that no longer candidate hides, from (grp, ws, a)."""
    candidates = known.filter(F.size("ws") > 1)
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)))
    cuts = cuts.withColumn("first", F.expr("slice(ws, 1, k)")).withColumn("rest", F.expr("slice(ws, k + 1, size(ws) - k)"))
    count = known.select(F.col("grp").alias("g"), F.col("ws").alias("part"), F.col("a").alias("times"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(count, (F.col("grp") == F.col("g")) & (F.col(part) == F.col("part"))).withColumnRenamed("times", name).drop("g", "part", part)
    wide = "cast({} as decimal(38,0))".format
    cuts = cuts.withColumn("score", F.expr(f"{wide(scale)} * {wide('a')} div ({wide('l')} + {wide('r')})"))
    best = cuts.groupBy("grp", "ws").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Parts of at least two words inside a longer candidate, as slices (first word, words).
    slices = [(s, n) for n in range(2, most) for s in range(1, most - n + 2)]
    parts = F.array(*[F.when(F.size("ws") >= max(s + n - 1, n + 1), F.slice("ws", s, n)) for s, n in slices])
    inside = candidates.filter(F.size("ws") > 2).withColumn("part", F.explode(parts))
    most_of = inside.filter("part is not null").groupBy(F.col("grp").alias("g"), "part").agg(F.max("a").alias("longer"))
    rows = best.join(most_of, (F.col("grp") == F.col("g")) & (F.col("ws") == F.col("part")), "left")
    kept = rows.filter(F.expr(f"longer is null or {wide(100)} * longer < {wide(hide)} * a"))
    return kept.select("grp", "ws", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def _spell(seed, shared):
    """Distinct (word digest, text) of the wanted words in each task."""
    def run(batches):
        import pyarrow as pa
        wanted, seen = Filter(shared.value), {}
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            for a, b in blocks(offsets, PART):
                part = raw[offsets[a]: offsets[b]]
                word, _, starts, ends = words_and_pieces(part, offsets[a: b + 1] - offsets[a], seed)
                word, first = np.unique(word, return_index=True)
                for i in np.flatnonzero(wanted.has(word)):
                    at = first[i]
                    seen.setdefault((int(word[i]), part[starts[at]: ends[at]].tobytes().lower()), None)
        keys = np.array([k for k, _ in seen], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([t.decode() for _, t in seen], pa.string())], ["w", "spelling"])
    return run


def mine(docs: DataFrame, group, ident: str = "doc_id", least: int = LEAST, most: int = MOST, first: int = FIRST, hide: int = HIDE,
         scale: int = SCALE, sample: int = SAMPLE) -> DataFrame:
    """grp, rank, phrase, a, l, r, n, score of each group's first `first` phrases."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(group.cast("string"), F.lit("und")).alias("grp"), "text", F.col(ident).alias("__id"))
    for seed in range(8):
        found = frequent(texts, F.pmod(F.xxhash64("__id"), F.lit(sample)) == 0, least, most, seed)
        rows = scored(stored(spelled(found, most)), most, hide, scale)
        # Ties at the last place are kept until the spelling decides.
        place = Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("a"))
        top = stored(rows.withColumn("at", F.rank().over(place)).filter(F.col("at") <= first).drop("at"))
        wanted = top.select(F.explode("ws").alias("key")).distinct()
        shared = spark.sparkContext.broadcast(filter_of(wanted).words)
        spelling = stored(texts.select("text").mapInArrow(_spell(seed, shared), "w bigint, spelling string").distinct()
                          .join(wanted.withColumnRenamed("key", "w"), "w", "left_semi"))
        if spelling.count() == spelling.select("w").distinct().count():
            break
        discard(found, top, spelling)
    words = (top.select("grp", "ws", F.posexplode("ws").alias("i", "w")).join(spelling, "w")
             .groupBy("grp", "ws").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "spelling"))), lambda x: x["spelling"]), " ").alias("phrase")))
    total = found.filter("words = 0").select("grp", F.col("n"))
    ranked = Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (top.join(words, ["grp", "ws"]).join(total, "grp").withColumn("rank", F.row_number().over(ranked).cast("long")).filter(F.col("rank") <= first)
            .select("grp", "rank", "phrase", "a", "l", "r", "n", "score"))


def op11(docs: DataFrame) -> DataFrame:
    return mine(docs, F.col("lang")).withColumnRenamed("grp", "lang")


_BREAK, _UPPER, _SMALL = r"[.,;:!?\x0A-\x0D]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11_SQL = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '{_BREAK}')) AS piece
    FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM split GROUP BY lang),
found AS (
    SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS a
    FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT lang, ws, unnest([1, 2, 3, 4]) AS k FROM split) WHERE len(ws) >= k)
    GROUP BY ALL HAVING count(*) >= {LEAST}),
candidates AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS ws FROM found WHERE k > 1),
cuts AS (
    SELECT c.lang, c.phrase, c.a, c.cut, f.a AS l, t.a AS r, {SCALE}::HUGEINT * c.a // (f.a::HUGEINT + t.a) AS score
    FROM (SELECT *, unnest(range(1, len(ws))) AS cut FROM candidates) c
    JOIN found f ON f.lang = c.lang AND f.phrase = array_to_string(c.ws[1 : c.cut], ' ')
    JOIN found t ON t.lang = c.lang AND t.phrase = array_to_string(c.ws[c.cut + 1 :], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
hidden AS (
    SELECT p.lang, p.phrase FROM candidates p JOIN (
        SELECT lang, array_to_string(ws[s : s + k - 1], ' ') AS part, a FROM (
            SELECT lang, ws, a, k, unnest(range(1, len(ws) - k + 2)) AS s FROM (SELECT *, unnest(range(2, len(ws))) AS k FROM candidates))) q
    ON q.lang = p.lang AND q.part = p.phrase AND 100::HUGEINT * q.a >= {HIDE}::HUGEINT * p.a)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best b JOIN totals USING (lang) ANTI JOIN hidden h ON h.lang = b.lang AND h.phrase = b.phrase
QUALIFY rank <= {FIRST}
"""
