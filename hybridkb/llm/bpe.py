"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

No regular expression runs over the text. Code points are mapped to classes, each class (with the
one or two code points after it) acts as a transition function on eight states, and the functions
are composed by a blocked associative scan: within blocks for all states at once, then across
blocks, then once more along each block from its known first state. The emitted boundaries equal
those of the common pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Slices of the UTF-8 buffer then feed a cache; slices not seen before are merged together, one
merge in every slice at a time. Byte offsets of the tokens are kept, so that a token can be traced to its
text; decoding is a gather of the tokens' bytes.

Scale: a map over rows. The vocabulary's arrays (a few MB, fixed) are broadcast. Each Arrow batch
is worked off in runs of about ``RUN_BYTES`` bytes, so memory doesn't depend on the batch.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hybridkb.llm.memory import held, lean, small_batches
from hybridkb.session import pick

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RUN_BYTES = 500_000
#: Entries after which a worker forgets its slices; it affects speed and memory alone.
CACHE_ENTRIES = 200_000
SHORT = 64
NONE = np.int32(2**31 - 1)

LETTER, NUMBER, OTHER, SHORT_TAIL, LONG_TAIL, JOINED, LAST, INNER = range(8)
IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_SPACES, ONE_MORE, TWO_MORE, FRESH = range(8)
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def code_point_classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space, for every code point."""
    out = np.full(0x110000, 2, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = 0
        elif k == "N":
            out[c] = 1
    out[_WHITE] = 3
    return out


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and 'a token starts here' by (symbol + 8 at a text's first code point) * 8 + state."""
    go, cut = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    into = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SHORT_TAIL: ONE_MORE, LONG_TAIL: TWO_MORE, JOINED: AFTER_SPACE, LAST: FRESH, INNER: IN_SPACES}
    goes_on = {
        (LETTER, IN_LETTERS): IN_LETTERS, (LETTER, AFTER_SPACE): IN_LETTERS, (LETTER, ONE_MORE): FRESH, (LETTER, TWO_MORE): ONE_MORE,
        (NUMBER, IN_NUMBERS): IN_NUMBERS, (NUMBER, AFTER_SPACE): IN_NUMBERS, (INNER, IN_SPACES): IN_SPACES,
    } | {(s, q): IN_OTHER for s in (OTHER, SHORT_TAIL, LONG_TAIL) for q in (IN_OTHER, AFTER_SPACE)}
    for s in range(8):
        for q in range(8):
            go[s, q], cut[s, q] = goes_on.get((s, q), into[s]), (s, q) not in goes_on
            go[s + 8, q], cut[s + 8, q] = into[s], True
    return go.reshape(-1), cut.reshape(-1)


GO, CUT = _machine()


def scan_states(symbols: np.ndarray, block: int = 128) -> np.ndarray:
    """State before each symbol, by composing transition functions block by block."""
    n = len(symbols)
    blocks = max(1, -(-n // block))
    padded = np.zeros(blocks * block, np.uint8)
    padded[:n] = symbols
    steps = np.ascontiguousarray(padded.reshape(blocks, block).T).astype(np.uint8)
    whole = np.broadcast_to(np.arange(8, dtype=np.uint8), (blocks, 8)).copy()
    for row in steps:  # each block's function: what becomes of every state
        whole = GO[(row[:, None] << np.uint8(3)) | whole]
    width = 1
    while width < blocks:  # prefix composition across blocks
        whole[width:] = np.take_along_axis(whole[width:], whole[:-width].copy(), axis=1)
        width *= 2
    state = np.empty(blocks, np.uint8)
    state[0] = FRESH
    state[1:] = whole[:-1, FRESH]
    out = np.empty((block, blocks), np.uint8)
    for t, row in enumerate(steps):
        out[t] = state
        state = GO[(row << np.uint8(3)) | state]
    return out.T.reshape(-1)[:n]


def token_starts(points: np.ndarray, firsts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Mask of the code points at which a pre-token starts; ``firsts`` marks each text's first."""
    n = len(points)
    kind = classes[points]
    end = np.empty(n, bool)  # the text ends after this code point
    end[:-1], end[-1:] = firsts[1:], True
    white = kind == 3
    then_white = np.ones(n, bool)
    then_white[:-1] = white[1:]
    then_white |= end
    symbols = kind.copy()
    symbols[white] = np.where(then_white[white], INNER, np.where(points[white] == 32, JOINED, LAST))
    for i in np.flatnonzero(points == 39) if n else ():
        if end[i]:
            continue
        a = points[i + 1]
        if a in (115, 116, 109, 100):  # s t m d
            symbols[i] = SHORT_TAIL
        elif not end[i + 1] and (a, points[i + 2]) in ((114, 101), (118, 101), (108, 108)):  # re ve ll
            symbols[i] = LONG_TAIL
    symbols = symbols | (firsts.astype(np.uint8) << np.uint8(3))
    return CUT[(symbols << np.uint8(3)) | scan_states(symbols)]


class Vocabulary:
    """Arrays of a byte-level vocabulary in rank form; picklable, of fixed size."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError(f"{path} lacks some bytes")
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.merged = np.full(1 << self.bits, NONE, np.int32)
        held, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        at = self._slot(held)
        while len(held):  # open addressing, all keys at once: the first to a free slot has it
            free = self.keys[at] == -1
            self.keys[at[free]], self.merged[at[free]] = held[free], values[free]
            left = self.keys[at] != held
            held, values, at = held[left], values[left], (at[left] + 1) & (len(self.keys) - 1)
        self.classes = code_point_classes()
        self.ranks = None

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that left and right make, NONE where they make none; -1 pairs with nothing."""
        shape = left.shape
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).reshape(-1)
        out = np.full(len(keys), NONE, np.int32)
        open_ = np.flatnonzero(((left >= 0) & (right >= 0)).reshape(-1))
        at = self._slot(keys[open_])
        while len(open_):
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.merged[at[hit]]
            on = ~hit & (there != -1)
            open_, at = open_[on], (at[on] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)

    def __getstate__(self):
        return self.__dict__ | {"ranks": None}

    def _whole(self) -> dict[bytes, int]:
        if self.ranks is None:
            self.ranks = {t: i for i, t in enumerate(self.tokens) if t}
        return self.ranks

    def merge_many(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word."""
        whole = self._whole()
        out: list[np.ndarray | None] = [None] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if (r := whole.get(w)) is not None:
                out[i] = np.array([r], np.int32)
            elif len(w) > SHORT:
                out[i] = self._merge_long(w)
            else:
                by.setdefault(len(w), []).append(i)
        for n, where in by.items():
            ids = self.single[np.frombuffer(b"".join(words[i] for i in where), np.uint8)].reshape(-1, n)
            for i, row in zip(where, self._merge_block(ids)):
                out[i] = row
        return out

    def _merge_block(self, ids: np.ndarray) -> list[np.ndarray]:
        """Words of one length, the lowest pair of each merged at a time, the leftmost of equals."""
        n, width = ids.shape
        ids = ids.copy()
        count = np.full(n, width)
        live = np.arange(n)
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        cols = np.arange(width)
        while len(live):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(live)), at]
            on = best != NONE
            live, at, best, ranks = live[on], at[on], best[on], ranks[on]
            if not len(live):
                break
            rows = ids[live]
            src = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), width - 1)
            rows = np.take_along_axis(rows, src, axis=1)
            rows[np.arange(len(live)), at] = best
            count[live] -= 1
            rows[cols[None, :] >= count[live][:, None]] = -1
            ids[live] = rows
            r = np.arange(len(live))
            src = np.minimum(cols[None, :-1] + (cols[None, :-1] > at[:, None]), width - 2)
            ranks = np.take_along_axis(ranks, src, axis=1)
            for side in (0, 1):  # only the pairs on either side of the merge are new
                p = at - 1 + side
                ok = (p >= 0) & (p < width - 1)
                ranks[r[ok], p[ok]] = self.pair_ranks(rows[r[ok], p[ok]], rows[r[ok], p[ok] + 1])
            ranks[cols[None, :-1] >= (count[live] - 1)[:, None]] = NONE
        return [row[:k] for row, k in zip(ids, count)]

    def _merge_long(self, word: bytes) -> np.ndarray:
        """Any length in n log n: a heap of pairs over a linked list."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair_ranks(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        table: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in table:
                table[a, b] = int(self.pair_ranks(np.array([a]), np.array([b]))[0])
            return table[a, b]

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for k in (prev[i], i):
                if k >= 0 and nxt[k] < n:
                    q = rank(ids[k], ids[nxt[k]])
                    if q != NONE:
                        heapq.heappush(heap, (q, k, ids[k], ids[nxt[k]]))
        return np.array([t for t in ids if t >= 0], np.int32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The tokens' bytes, one after another."""
        return gather(self.bytes, self.start[ids], self.size[ids])


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each entry, one after another."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    step = np.ones(ends[-1], np.int64)
    some = size > 0
    s, e, z = start[some], ends[some], size[some]
    step[0] = s[0]
    step[e[:-1]] = s[1:] - s[:-1] - z[:-1] + 1
    return flat[np.cumsum(step)]


class _Slices(dict):
    """Number of each distinct slice; a slice not yet there is noted as new."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes runs of texts; keeps the slices it has merged."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.slices = _Slices()
        self.flat = np.empty(1 << 16, np.int32)
        self.used = 0
        self.begin, self.count = np.empty(1 << 15, np.int64), np.empty(1 << 15, np.int64)

    def _learn(self) -> None:
        new, self.slices.new = self.slices.new, []
        if not new:
            return
        got = self.v.merge_many(new)
        sizes = np.array([len(g) for g in got], np.int64)
        n = len(self.slices)
        if n > len(self.begin):
            self.begin, self.count = np.resize(self.begin, 2 * n), np.resize(self.count, 2 * n)
        total = int(sizes.sum())
        if self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + total))
        self.flat[self.used : self.used + total] = np.concatenate(got)
        self.count[n - len(new) : n] = sizes
        self.begin[n - len(new) : n] = self.used + np.cumsum(sizes) - sizes
        self.used += total

    def encode(self, data: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts data[edges[i]:edges[i+1]] -> ids, byte offset of each token in ``data``, and the
        tokens before each text and in all."""
        if not data:
            return np.empty(0, np.int32), np.empty(0, np.int64), np.zeros(len(edges), np.int64)
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        size = np.ones(len(points), np.int8)
        for edge in (0x80, 0x800, 0x10000):
            size += points >= edge
        at = np.cumsum(size, dtype=np.int64) - size
        firsts = np.zeros(len(points), bool)
        firsts[np.searchsorted(at, edges[:-1][edges[:-1] < edges[1:]])] = True
        starts = at[token_starts(points, firsts, self.v.classes)]
        ends = np.append(starts[1:], len(data))
        if len(self.slices) > CACHE_ENTRIES:
            self._forget()
        words = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        number = np.fromiter(map(self.slices.__getitem__, words), np.int64, len(words))
        self._learn()
        counts = self.count[number]
        ids = gather(self.flat, self.begin[number], counts)
        length = self.v.size[ids]
        offsets = np.cumsum(length) - length
        before = np.concatenate([[0], np.cumsum(counts)])
        return ids, offsets, before[np.searchsorted(starts, edges)]


def text_runs(column: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, row after the last, bytes, edges) of successive rows of a string column; null is
    empty. A row larger than a run is a run by itself."""
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    width = 8 if pa.types.is_large_string(column.type) else 4
    edges = np.frombuffer(column.buffers()[1], f"<i{width}", n + 1, width * column.offset).astype(np.int64)
    raw = memoryview(column.buffers()[2]) if column.buffers()[2] is not None else memoryview(b"")
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + run_bytes, "right")) - 1)
        yield a, b, bytes(raw[edges[a] : edges[b]]), edges[a : b + 1] - edges[a]
        a = b


def worker_encoder(shared) -> Encoder:
    """One encoder for each Python worker and broadcast vocabulary."""
    key = ("bpe", shared.value.name)
    return held(key, lambda: Encoder(shared.value))


def share(spark, path: str):
    small_batches(spark)
    v = Vocabulary(path)
    v.name = f"{path}-{uuid.uuid4().hex}"  # a worker keeps an encoder by this name, and a path may be written anew
    return spark.sparkContext.broadcast(v)


ENCODED = "doc_id long, n_tokens int, ids array<int>, offsets array<int>, round_trip boolean"


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids, offsets, round_trip), one row for each row of ``docs``.

    ``offsets`` are the byte positions of the tokens in the UTF-8 text; ``round_trip`` says that
    decoding ``ids`` gives back the text's very bytes. Null text has null ids and offsets, no
    tokens and a null round_trip; empty text has empty lists. Texts of any length are encoded
    whole. Repeated rows and null ids are kept. An empty table gives no rows; further columns are
    ignored.
    """
    shared = share(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            valid = np.asarray(batch.column(1).is_valid())
            for a, b, data, edges in text_runs(batch.column(1)):
                ids, offsets, before = encoder.encode(data, edges)
                back = encoder.v.decode(ids).tobytes()
                counts = np.diff(before)
                own = offsets - np.repeat(edges[:-1], counts)
                same = np.ones(b - a, bool) if back == data else np.array([back[x:y] == data[x:y] for x, y in zip(edges[:-1], edges[1:])])
                gone = pa.array(~valid[a:b])
                lists = [pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(x.astype(np.int32)), mask=gone) for x in (ids, own)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b].cast(pa.int64()), pa.array(counts.astype(np.int32)), *lists, pa.array(same, mask=~valid[a:b])],
                    names=["doc_id", "n_tokens", "ids", "offsets", "round_trip"],
                )

    return pick(docs, "doc_id", "text").selectExpr("doc_id", "cast(text as string) text").mapInArrow(lean(run), ENCODED)


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give null, ids outside the vocabulary raise.
    Bytes that aren't UTF-8 (a token cut from its text) become replacement characters."""
    shared = share(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                if not ids.is_valid:
                    texts.append(None)
                    continue
                got = np.asarray(ids.values.to_numpy(zero_copy_only=False), np.int64)
                if len(got) and (got.min() < 0 or got.max() >= len(v.size)):
                    raise ValueError("an id outside the vocabulary")
                texts.append(v.decode(got).tobytes().decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return pick(encoded, "doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")
