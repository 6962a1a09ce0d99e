"""Packing documents into sequences of a fixed length by order-preserving dynamic programming.

The documents of a partition form one token stream, in their order. It is cut into windows of at most WIDTH tokens. A cut may lie behind a
document (free), behind a sentence (SENTENCE) or, where neither is near, at every HARD tokens (FORCED). The programme minimises
the padding of all windows plus the penalties of their cuts. Padding is WIDTH - length, so the best start of a window that ends at j is the
minimum of cost(i) + i over the last WIDTH tokens: a monotone queue gives it in constant time. Windows whose length is a power of two from
SHORTEST on need no padding and are tried besides. The stream is solved in stretches of about STRETCH tokens; the last window of a stretch goes
on into the next one, so memory is bounded and stretches leave no padding. No shuffle; one open sequence a partition.

Tokens come from a public tokenizer file. Words of Latin-1 letters go through the file's merges many at a time, everything else through the
tokenizer itself; the ids are the same.

Defined cases: a null or empty text is the end token alone; ids (null too) and repeated rows are packed row by row; a text
longer than a sequence runs over several; an empty table gives an empty result.
"""

import zlib
from collections import deque

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sitemetrics.llm.common import blocks, byte_values, mix64, powers, small_batches, text_bytes

WIDTH, END = 4096, 2
SENTENCE, FORCED, HARD, SHORTEST = 24, 192, 512, 256
STRETCH, KEPT = 1 << 19, 1_000_000
TOKENIZER = "word_bpe_49k.json"
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Merges:
    """The tokenizer's merges, applied to many words side by side: each step merges the first pair of lowest rank in every word."""

    def __init__(self, tokenizer):
        import json
        model = json.loads(tokenizer.to_str())["model"]
        vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.merged = keys[self.order], np.array([vocab[a + b] for a, b in pairs], np.int32)
        # Bytes stand for themselves where they print, and for code points from 256 on, in order, where they don't.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        name = {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}
        self.inner = np.array([vocab[name[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[name[b] + "</w>"] for b in range(256)], np.int32)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(keys)] = True

    @staticmethod
    def _slot(keys):
        return (keys * 0x9E3779B1 >> 11) & 0xFFFFF

    NONE = 1 << 30

    def _rank(self, left, right):
        keys = left.astype(np.int64) << 16 | right
        out = np.full(len(keys), self.NONE, np.int32)
        some = np.flatnonzero(self.maybe[self._slot(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        hit = self.keys[at] == keys[some]
        out[some[hit]] = self.order[at[hit]]
        return out

    def encode(self, data):
        """(symbols, number of them) of words of equal length, runs of lower-case letters: a matrix of bytes, a row each."""
        total, n = data.shape
        symbols = np.concatenate([self.inner[data[:, :-1]], self.last[data[:, -1:]]], axis=1)
        done, size = symbols.copy(), np.full(total, n, np.int32)
        # Ranks of the pair that starts at each place; only words that can still merge stay in the working arrays.
        ranks = np.full((total, n), self.NONE, np.int32)
        for j in range(n - 1):
            ranks[:, j] = self._rank(symbols[:, j], symbols[:, j + 1])
        rows, left_over = np.arange(total), size.copy()
        while len(rows):
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(rows)), at]
            on = low < self.NONE
            if not on.all():
                done[rows[~on]], size[rows[~on]] = symbols[~on], left_over[~on]
                rows, at, low, symbols, ranks, left_over = rows[on], at[on], low[on], symbols[on], ranks[on], left_over[on]
                if not len(rows):
                    break
            ahead = np.arange(n - 1)[None, :] > at[:, None]
            np.copyto(symbols[:, :-1], symbols[:, 1:].copy(), where=ahead)
            np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=ahead)
            ranks[:, -1] = self.NONE
            each = np.arange(len(rows))
            symbols[each, at] = self.merged[low]
            left_over -= 1
            ranks[each, at] = self.NONE
            r = np.flatnonzero(at + 1 < left_over)
            ranks[r, at[r]] = self._rank(symbols[r, at[r]], symbols[r, at[r] + 1])
            r = np.flatnonzero(at > 0)
            ranks[r, at[r] - 1] = self._rank(symbols[r, at[r] - 1], symbols[r, at[r]])
        return done, size


_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[97:123] = 1
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "'<"]] = 2
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32


def _lower(raw):
    """Bytes with the letters of Latin-1 in lower case, and the kind of each: space, letter of Latin-1, mark, other."""
    low = _PLAIN[raw]
    kind = _KIND[low]
    lead = np.flatnonzero(raw[:-1] == 0xC3)   # the first of two bytes for U+00C0 to U+00FF
    second = raw[lead + 1]
    letter = (second != 0x97) & (second != 0xB7)
    lead, second = lead[letter], second[letter]
    low[lead + 1] = np.where(second < 0x9F, second + 0x20, second)
    kind[lead] = kind[lead + 1] = 1
    return low, kind


class Encoder:
    """Token ids of whole texts, equal to the tokenizer's own.

    No token spans white space. Parts that are letters of Latin-1 with marks behind are a word and a run of marks: words go through `Merges`,
    each distinct one once while it is kept; runs of marks and all other parts go through the tokenizer, with a bounded store.
    """

    def __init__(self, path: str | None = None):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(self.tokenizer)
        self.parts: dict[bytes, list[int]] = {}
        self._forget()
        self.ends = np.unique([self._ids(m)[-1] for m in (".", "!", "?", "...", ".\"", "!!")])

    def _forget(self):
        """Empty store of words: their hashes in order, and where their ids lie."""
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _ids(self, text):
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _others(self, parts):
        """(ids, where each part's begin, how many) by the tokenizer."""
        if len(self.parts) > KEPT:
            self.parts.clear()
        new = sorted(set(parts) - self.parts.keys())
        found = self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)
        self.parts.update(zip(new, (f.ids for f in found)))
        count = np.array([len(self.parts[p]) for p in parts], np.int64)
        return np.array([i for p in parts for i in self.parts[p]], np.int32), np.cumsum(count) - count, count

    def _words(self, low, begin, length, key):
        """Number in the store of each word, given by its place and the hash of its letters."""
        keys, first, word = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) > KEPT:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = first[self.keys[at] != keys] if len(self.keys) else first
        if len(new):
            ids, places, counts, filled, order = [self.ids], [self.at], [self.n], len(self.ids), []
            for size in np.unique(length[new]):
                mine = new[length[new] == size]
                symbols, count = self.merges.encode(low[begin[mine][:, None] + np.arange(size)[None, :]])
                ids.append(symbols[np.arange(size)[None, :] < count[:, None]])
                places.append(filled + np.cumsum(count) - count)
                counts.append(count)
                order.append(mine)
                filled += int(count.sum())
            self.ids = np.concatenate(ids)
            every = np.concatenate([self.keys, key[np.concatenate(order)]])
            sort = np.argsort(every)
            self.keys, self.at, self.n = every[sort], np.concatenate(places)[sort], np.concatenate(counts)[sort]
            at = np.searchsorted(self.keys, keys)
        return at[word]

    def encode(self, raw, offsets):
        """(ids of all texts, first id of each text and the end) of texts given as bytes."""
        n = len(raw)
        nothing = np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if not n:
            return nothing
        low, kind = _lower(raw)
        inside = kind > 0
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]))
        ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
        if not len(starts):
            return nothing
        # A part is plain if it is letters up to `stops` and marks from there on.
        letters = np.concatenate([[0], np.cumsum(kind == 1, dtype=np.int32)])
        marks = np.concatenate([[0], np.cumsum(kind == 2, dtype=np.int32)])
        stops = starts + letters[ends] - letters[starts]
        plain = (letters[stops] - letters[starts] == stops - starts) & (marks[ends] - marks[stops] == ends - stops)
        worded, marked = plain & (stops > starts), plain & (ends > stops)
        # The ids of a part: up to two stretches, from the store of words and from the tokenizer's.
        at, count = np.zeros((len(starts), 2), np.int64), np.zeros((len(starts), 2), np.int64)
        which = np.flatnonzero(worded)
        if len(which):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(byte_values(low) * powers("up", n))])
            size = (stops - starts)[which]
            key = mix64((sums[stops[which]] - sums[starts[which]]) * powers("down", n)[starts[which]] + size.astype(np.uint64))
            found = self._words(low, starts[which], size, key)
            at[which, 0], count[which, 0] = self.at[found], self.n[found]
        rest = np.flatnonzero(~plain | marked)
        table = self.ids
        if len(rest):
            body = raw.tobytes()
            begin = np.where(plain, stops, starts)[rest]
            ids, places, counts = self._others([body[a:b] for a, b in zip(begin.tolist(), ends[rest].tolist())])
            at[rest, 1], count[rest, 1] = len(table) + places, counts
            table = np.concatenate([table, ids])
        place = np.concatenate([[0], np.cumsum(count.sum(axis=1))])
        at, count = at.ravel(), count.ravel()
        shift = at - (np.cumsum(count) - count)
        ids = table[np.arange(place[-1]) + np.repeat(shift, count)]
        return ids.astype(np.uint32), place[np.searchsorted(starts, offsets)]


_encoders: dict[str | None, Encoder] = {}


def encoder_for(path: str | None) -> Encoder:
    """The worker's encoder of a tokenizer file; its stores serve all tasks of the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, doc_ends, sentence_ends):
    """Places where the stream may be cut with their penalties, both sorted by place; place 0 comes first, n is one of them."""
    penalty = {}
    places = np.unique(np.concatenate([[0], doc_ends, sentence_ends, [n]])).astype(np.int64)
    gaps = np.flatnonzero(np.diff(places) > HARD)
    hard = [np.arange(places[g] + HARD, places[g + 1], HARD) for g in gaps]
    places = np.unique(np.concatenate([places, *hard])) if hard else places
    penalty = np.full(len(places), FORCED, np.int64)
    penalty[np.searchsorted(places, sentence_ends)] = SENTENCE
    penalty[np.searchsorted(places, doc_ends)] = 0
    penalty[0] = 0
    return places, penalty


def best_windows(places, penalty):
    """Window ends of the cheapest way to cut the stream, from the first place to the last."""
    n = len(places)
    exact = []
    size = SHORTEST
    while size < WIDTH:
        at = np.searchsorted(places, places - size)
        exact.append(np.where(places[at] == places - size, at, -1).tolist())
        size *= 2
    place, extra = places.tolist(), penalty.tolist()
    cost, back = [0] * n, [0] * n
    queue = deque([(0, 0)])   # (cost + place, index), increasing
    for j in range(1, n):
        here = place[j]
        while place[queue[0][1]] < here - WIDTH:
            queue.popleft()
        value, i = queue[0]
        value += WIDTH - here
        for way in exact:
            k = way[j]
            if k >= 0 and cost[k] < value:
                value, i = cost[k], k
        cost[j], back[j] = value + extra[j], i
        value = cost[j] + here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    ends = []
    j = n - 1
    while j:
        ends.append(place[j])
        j = back[j]
    return ends[::-1]


class Packer:
    """Packs a stream of (id, ids) and gives out finished pieces as rows of SCHEMA."""

    def __init__(self, first_sequence: int, sentence_tokens):
        self.sequence, self.sentence_tokens = first_sequence, sentence_tokens
        self.docs = []   # [id, ids, tokens of it already given out]
        self.tokens = 0

    def add(self, ident, ids):
        self.docs.append([ident, ids, 0])
        self.tokens += len(ids)

    def solve(self, last: bool):
        """Rows of all windows of the stretch; without the last window unless the stream ends."""
        if not self.docs:
            return []
        stream = np.concatenate([ids[done:] for _, ids, done in self.docs])
        doc_ends = np.cumsum([len(ids) - done for _, ids, done in self.docs])
        sentence_ends = np.flatnonzero(np.isin(stream, self.sentence_tokens)) + 1
        ends = best_windows(*cuts(len(stream), doc_ends, sentence_ends))
        if not last:
            ends.pop()
        rows, at, d, starts = [], 0, 0, np.concatenate([[0], doc_ends[:-1]])
        for end in ends:
            begin = at
            while at < end:
                ident, ids, done = self.docs[d]
                upto = min(end, int(doc_ends[d]))
                rows.append((ident, done + at - int(starts[d]), upto - at, zlib.crc32(stream[at:upto].astype("<u4").tobytes()), len(ids), self.sequence, at - begin))
                at = upto
                if at == doc_ends[d]:
                    d += 1
            self.sequence += 1
        rest = self.docs[d:]
        if rest:
            rest[0] = [rest[0][0], rest[0][1], rest[0][2] + at - int(starts[d])]
        self.docs, self.tokens = rest, sum(len(ids) - done for _, ids, done in rest)
        return rows


def _batch(rows):
    import pyarrow as pa
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of the documents (doc_id, text) with the sequence and the offset they go to."""
    small_batches(docs.sparkSession)

    def run(batches):
        encoder = encoder_for(tokenizer)
        # Sequences are numbered by partition, hence the same after a retry.
        packer = Packer(TaskContext.get().partitionId() << 40, encoder.ends)
        end = np.array([END], np.uint32)
        for batch in batches:
            idents = batch.column(0).to_pylist()
            raw, offsets = text_bytes(batch.column(1))
            for a, b in blocks(offsets):
                ids, first = encoder.encode(raw[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                for i in range(b - a):
                    packer.add(idents[a + i], np.concatenate([ids[first[i]: first[i + 1]], end]))
                    if packer.tokens >= STRETCH:
                        yield _batch(packer.solve(False))
        yield _batch(packer.solve(True))
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, SCHEMA)


def op10(docs: DataFrame) -> DataFrame:
    return pack(docs)
