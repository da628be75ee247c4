"""N-gram Jaccard join by PartEnum signatures, told as classes and links.

Sets whose sizes fall in one band have their n-grams hashed into the band's ``n1`` partitions of the
feature domain. Two sets of Jaccard similarity at least g differ in at most K = (1 - g) / g * (smaller size)
n-grams, so at most K partitions differ. The signatures of a set are its first K + 1 non-empty
partitions, each with its content: the first partition in which two similar sets agree has at most
K differing ones before it, hence both enumerate it. Subsets of one partition each (n2 = 1, k2 = 0) are
enumerated: a set of 100 n-grams then has 34 signatures of 3 n-grams on average, where n2 = 3, k2 = 1 would
have 51 of 4 n-grams, half as much again to move, and lose the guarantee where subsets are empty. Empty
partitions, in which unlike sets would meet, need no signature. A set near the top of its band takes
part in the next band as well.

Sets that share a signature are compared by size and by a 192-bit sketch. Two limits hold for the bits
in which sketches differ: one for each n-gram not shared, which loses nothing and decides for small
sets; and for large ones 8 deviations beyond what a pair at the threshold has, which such a pair
passes but for a chance of 4e-11 (a Chernoff bound), pairs well above it surely. The pairs that stay are linked into
components, and within each component the true intersections of all different sets are computed.
N-grams are compared as 64-bit hashes.

Scale: copies of one set are told apart from different sets first, within each task, so that a text
repeated a million times costs one comparison a task. Signatures travel in binary blocks by ``part``, cut
to 32 bits there (a chance meeting costs one comparison); a part beyond ``CHUNK_BYTES``, as by a passage that
very many documents share, is cut into chunks, and each two chunks meet in a task of their own. Links are shuffled, pairs never: at most one
link for each document and task, one count for each set and tile. Different sets of a component are
hashed into blocks; each block is compared within itself where it is packed, and blocks of one
component meet pairwise, read from files that are written once.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hybridkb.llm.bpe import text_runs
from hybridkb.llm.components import Unions, connected_components
from hybridkb.llm.memory import lean, small_batches
from hybridkb.session import discard, materialise, pick, scratch

NGRAM, THRESHOLD = 3, 0.75
#: Different sets of a component in one block, and bytes of a block.
BLOCK, BLOCK_BYTES = 1024, 16_000_000
#: Rows of a (doc_id, ...) table that may be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 2_000_000
#: Groups of signatures: at least so many, and one for so many bytes of text.
LEAST_PARTS, PART_TEXT = 256, 64_000_000
RUN_BYTES = 8_000_000
PIECE_BYTES = 500_000
#: Sets that a task remembers to know copies by.
KNOWN_SETS = 200_000
#: Bytes of signatures and entries that a task compares at once. A group of signatures with more is cut into chunks.
CHUNK_BYTES = 256_000_000
SKETCH_BITS, DEVIATIONS = 192, 8.0

_U = np.uint64
_STEP, _BACK = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.empty(0, _U), np.empty(0, _U)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_STEP, _BACK)):
            p = np.full(n + n // 4 + 1, base, _U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def gram_sets(data: bytes, edges: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct n-gram hashes of text i are hashes[bounds[i]:bounds[i + 1]].
    Words are runs without ASCII white space; a text of fewer than n words is one n-gram.
    Texts are taken up to ``PIECE_BYTES`` at a time (a longer one by itself), as the work needs 50 times their size."""
    out, sizes, a, texts = [], [], 0, len(edges) - 1
    while a < texts:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + PIECE_BYTES, "right")) - 1)
        hashes, bounds = _gram_piece(data[edges[a] : edges[b]], edges[a : b + 1] - edges[a], n)
        out.append(hashes)
        sizes.append(np.diff(bounds))
        a = b
    if not out:
        return np.empty(0, _U), np.zeros(1, np.int64)
    return np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _gram_piece(data: bytes, edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    texts = len(edges) - 1
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, _U), np.zeros(texts + 1, np.int64)
    dark = ~_WHITE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[edges] = True
    begin, end = dark.copy(), dark.copy()
    begin[1:] &= ~dark[:-1] | first[1:-1]
    end[:-1] &= ~dark[1:] | first[1:-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = _power(len(raw) + 1)
    total = np.empty(len(raw) + 1, _U)
    total[0] = 0
    np.cumsum(_BYTE[raw] * up[:-1], out=total[1:])
    words = _mix((total[e] - total[s]) * down[s] + (e - s).astype(_U))
    at = np.searchsorted(s, edges)
    grams = np.zeros(len(words), _U)
    for k in range(n):
        grams[: len(words) - k] += _mix(words[k:] + _U((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1)))
    out, bounds = [], np.zeros(texts + 1, np.int64)
    for i in range(texts):
        a, b = at[i], at[i + 1]
        if a < b:
            if b - a >= n:
                own = np.sort(_mix(grams[a : b - n + 1]))
                own = own[np.append(True, own[1:] != own[:-1])]
            else:
                short = sum((_mix(words[a + k : a + k + 1] + _U((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))) for k in range(b - a)), np.zeros(1, _U))
                own = _mix(short)
            out.append(own)
            bounds[i + 1] = len(own)
    return (np.concatenate(out) if out else np.empty(0, _U)), np.cumsum(bounds)


class Bands:
    """Size bands [2^k, 2^(k+1)) and their partition counts."""

    def __init__(self, threshold: float):
        self.g = threshold
        self.n1 = np.array([self._partitions(k) for k in range(40)], np.int64)

    def differing(self, size):
        """Most n-grams in which a similar set at least as large can differ from one of this size."""
        return np.floor((1 - self.g) / self.g * np.asarray(size) + 1e-9).astype(np.int64)

    def _partitions(self, k: int) -> int:
        """Fewest partitions that leave every set of the band K + 1 non-empty ones, by 8 deviations;
        0 for a partition to each feature."""
        top = (2 << k) - 1
        low = max(1, int(np.ceil(self.g * (1 << k))))
        for share in np.arange(4.0, 0.4, -0.25):
            n = int(top / share)
            ok = n > 0
            for size in (low, top):
                full = n * -np.expm1(-size / n) if n else 0
                none = np.exp(-size / n) if n else 0
                spread = np.sqrt(max(0.0, n * (none - (1 + size / n) * none * none))) if n else 0
                ok &= full - 8 * spread >= self.differing(size) + 1
            if ok:
                return n
        return 0

    def instances(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, band) of the bands in which each set takes part."""
        band = np.frexp(sizes.astype(float))[1] - 1
        over = np.flatnonzero(sizes >= self.g * np.exp2(band + 1) - 1e-9)
        return np.concatenate([np.arange(len(sizes)), over]), np.concatenate([band, band[over] + 1]).astype(np.int64)


def set_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits that name each non-empty set: two rows of int64."""
    out = [np.add.reduceat(_mix(hashes ^ _U(c)), bounds[:-1]) for c in (0x8A5CD789635D2DFF, 0x121FD2155C472F96)]
    return np.stack(out).view(np.int64) if len(bounds) > 1 else np.empty((2, 0), np.int64)


def sketches(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``SKETCH_BITS`` a set: one bit of the least hash in each of so many ranges; 0 where a range is empty."""
    sets = len(bounds) - 1
    of = np.repeat(np.arange(sets), np.diff(bounds))
    turned = _mix(hashes + _U(0x632BE59BD9B4E019))
    cell = of * SKETCH_BITS + (turned % _U(SKETCH_BITS)).astype(np.int64)
    least = np.full(sets * SKETCH_BITS, np.iinfo(np.uint64).max, _U)
    np.minimum.at(least, cell, turned // _U(SKETCH_BITS))
    bits = (_mix(least) & _U(1)).astype(np.uint8)
    bits[least == np.iinfo(np.uint64).max] = 0
    return np.packbits(bits.reshape(sets, SKETCH_BITS), axis=1).view(np.uint64).reshape(sets, SKETCH_BITS // 64)


ENTRY = np.dtype([("id", "<i8"), ("size", "<i4"), ("sketch", "<u8", (SKETCH_BITS // 64,))])


def signatures(hashes: np.ndarray, bounds: np.ndarray, ids: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, entry of it, entries): an entry is a set in one of its bands."""
    sizes = np.diff(bounds)
    sets, band = bands.instances(sizes)
    bits = sketches(hashes, bounds)
    entries = np.zeros(len(sets), ENTRY)
    entries["id"], entries["size"], entries["sketch"] = ids[sets], sizes[sets], bits[sets]
    out, owner = [], []
    spread = _mix(hashes + _U(0xA24BAED4963EE407))
    quota = bands.differing(sizes) + 1
    for i, (k, b) in enumerate(zip(sets.tolist(), band.tolist())):
        own = slice(bounds[k], bounds[k + 1])
        n = int(bands.n1[b])
        place = spread[own] % _U(n) if n else spread[own]
        order = np.argsort(place, kind="stable") if n else np.argsort(place)
        place = place[order]
        start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))[: quota[k] + 1]
        content = np.add.reduceat(spread[own][order] | _U(1), start)[: quota[k]]
        got = _mix(content * _U(0x9E3779B97F4A7C15) + place[start[: quota[k]]] + _U((b * 0xC2B2AE3D27D4EB4F) & (2**64 - 1)))
        out.append(got)
        owner.append(np.full(len(got), i, np.int64))
    if not out:
        return np.empty(0, _U), np.empty(0, np.int64), entries
    return np.concatenate(out), np.concatenate(owner), entries


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of entries may be similar, by size and sketch."""
    small, large = np.minimum(a["size"], b["size"]), np.maximum(a["size"], b["size"])
    unlike = np.bitwise_count(a["sketch"] ^ b["sketch"]).sum(axis=1)
    p = (1 - threshold) / 2
    differing = (1 - threshold) / (1 + threshold) * (small + large.astype(float)) + 1e-9  # each turns one bit at most
    return (small >= threshold * large - 1e-9) & (unlike <= np.minimum(differing, SKETCH_BITS * p + DEVIATIONS * np.sqrt(SKETCH_BITS * p * (1 - p))))


def links(
    signature: np.ndarray, owner: np.ndarray, entries: np.ndarray, threshold: float, second: int | None = None, joined: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id linked with it), from entries that meet in a signature and are alike.

    What counts is who is connected: in each signature's group the first entry is compared with all
    others, and only pairs that are not yet connected are compared after that. A group of
    copies takes as many comparisons as it has members, once for all its signatures. Entries from ``second``
    on are another chunk: the two are compared with each other alone, ``joined`` being what each has linked within itself.
    """
    if not len(signature):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ids, number = np.unique(entries["id"], return_inverse=True)
    unions = Unions(len(ids))
    if joined is not None:
        unions.join(*(np.searchsorted(ids, x) for x in joined))

    def consider(x: np.ndarray, y: np.ndarray) -> None:
        apart = unions.roots(number[x]) != unions.roots(number[y])
        if second is not None:
            apart &= (x < second) != (y < second)
        x, y = x[apart], y[apart]
        ok = alike(entries[x], entries[y], threshold)
        unions.join(number[x[ok]], number[y[ok]])

    def open_groups(at: np.ndarray, m: int) -> np.ndarray:
        root = unions.roots(number[owner[at[:, None] + np.arange(m)]].reshape(-1)).reshape(-1, m)
        return at[(root != root[:, :1]).any(1)]

    order = np.argsort(signature, kind="stable")
    signature, owner = signature[order], owner[order]
    start = np.flatnonzero(np.append(True, signature[1:] != signature[:-1]))
    count = np.diff(np.append(start, len(signature)))
    for m in np.unique(count[count > 1])[::-1].tolist():
        groups = start[count == m]
        for k in range(0, len(groups), max(1, 500_000 // m)):
            at = open_groups(groups[k : k + max(1, 500_000 // m)], m)
            if not len(at):
                continue
            consider(np.repeat(owner[at], m - 1), owner[at[:, None] + np.arange(1, m)].reshape(-1))
            if m == 2:
                continue
            at = open_groups(at, m)
            if m <= 512:
                i, j = np.triu_indices(m - 1, 1)
                for r in range(0, len(at), max(1, 500_000 // len(i))):
                    rows = at[r : r + max(1, 500_000 // len(i)), None] + 1
                    consider(owner[rows + i].reshape(-1), owner[rows + j].reshape(-1))
                continue
            for s in at.tolist():  # a large group, by rows, until it is connected
                members = owner[s : s + m]
                members = members[np.argsort(entries["size"][members], kind="stable")]
                size = entries["size"][members]
                last = np.searchsorted(size, size / threshold * (1 + 1e-9), "right")  # larger ones can't be alike
                for r in range(m - 1):
                    consider(np.full(last[r] - r - 1, members[r]), members[r + 1 : last[r]])
                    if r % 16 == 0 and not len(open_groups(np.array([s]), m)):
                        break
    root = ids[unions.roots(np.arange(len(ids)))]
    moved = root != ids
    return ids[moved], root[moved]


def _rows(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").where("doc_id IS NOT NULL AND text IS NOT NULL")


def _sized(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def candidate_links(docs: DataFrame, n: int, threshold: float, chunk: int = CHUNK_BYTES) -> DataFrame:
    """(a, b) links of which the components hold every pair at or over the threshold. Groups of signatures of more
    than ``chunk`` bytes are compared by chunks: each within itself, then each two of them in a task of their own."""
    spark, rows = docs.sparkSession, _rows(docs)
    small_batches(spark)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, math.ceil(size / PART_TEXT))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(parts / 8))
    bands = Bands(threshold)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], int] = {}
        for batch in batches:
            for a, b, data, edges in text_runs(batch.column(1), RUN_BYTES):
                hashes, bounds = gram_sets(data, edges, n)
                ids = batch.column(0)[a:b].to_numpy(zero_copy_only=False)
                some = np.diff(bounds) > 0
                ids, bounds = ids[some], np.append(bounds[:-1][some], bounds[-1])
                if len(known) > KNOWN_SETS:
                    known.clear()
                new, same = np.ones(len(ids), bool), []
                for i, key in enumerate(zip(*set_keys(hashes, bounds).tolist())):
                    first = known.setdefault(key, int(ids[i]))
                    if first != ids[i]:
                        new[i] = False
                        same.append((int(ids[i]), first))
                sizes = np.diff(bounds)
                hashes, bounds = hashes[np.repeat(new, sizes)], np.concatenate([[0], np.cumsum(sizes[new])])
                sig, owner, entries = signatures(hashes, bounds, ids[new], bands)
                part = (sig % _U(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                sig, owner, part = sig[order], owner[order], part[order]
                edge = np.searchsorted(part, np.arange(parts + 1))
                out = []
                for p in range(parts):
                    x, y = edge[p], edge[p + 1]
                    if x < y:
                        used, local = np.unique(owner[x:y], return_inverse=True)
                        out.append((p, (sig[x:y] >> _U(32)).astype("<u4").tobytes(), local.astype("<u4" if len(used) > 65535 else "<u2").tobytes(), entries[used].tobytes(), b""))
                if same:
                    out.append((int(same[0][1] % parts), b"", b"", b"", np.array(same, "<i8").tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[k] for r in out], pa.binary()) for k in (1, 2, 3, 4))], names=["part", "sig", "owner", "entries", "same"])

    root = scratch(spark, "near-chunks")
    system, path = fs.FileSystem.from_uri(root)
    system.create_dir(path, recursive=True)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, cut = None, [], 0, False

        def close() -> Iterator[pa.RecordBatch]:
            base = np.cumsum([0] + [len(h[2]) for h in held[:-1]])
            sig, entries = (np.concatenate([h[k] for h in held]) for k in (0, 2))
            owner = np.concatenate([h[1].astype(np.int64) + k for h, k in zip(held, base)])
            got = links(sig, owner, entries, threshold)
            copies = np.concatenate([h[3] for h in held])
            ends = [np.concatenate([got[k], copies[:, k]]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(ends[0]), pa.int32()), pa.nulls(len(ends[0]), pa.string()), *map(pa.array, ends)], names=["part", "path", "a", "b"])
            if cut:
                name = f"{root}/{uuid.uuid4().hex}.npz"
                _save(name, sig=sig, owner=owner, entries=entries, a=got[0], b=got[1])
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([name]), *(pa.nulls(1, pa.int64()) for _ in (0, 1))], names=["part", "path", "a", "b"])

        for batch in batches:
            for p, sig, owner, entries, same in zip(*(c.to_pylist() for c in batch.columns)):
                more = len(sig) + len(owner) + len(entries)
                if p != now:
                    if held:
                        yield from close()
                    held, size, cut = [], 0, False
                elif size + more > chunk:
                    cut = True
                    yield from close()
                    held, size = [], 0
                now, e = p, np.frombuffer(entries, ENTRY)
                held.append((np.frombuffer(sig, "<u4"), np.frombuffer(owner, "<u4" if len(e) > 65535 else "<u2"), e, np.frombuffer(same, "<i8").reshape(-1, 2)))
                size += more
        if held:
            yield from close()

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, x = None, None
        for batch in batches:
            for near, far in zip(*(c.to_pylist() for c in batch.columns)):
                if near != name:
                    name, x = near, _load(near)
                y = _load(far)
                common = np.intersect1d(x["sig"], y["sig"])
                in_x, in_y = np.isin(x["sig"], common), np.isin(y["sig"], common)
                got = links(
                    np.concatenate([x["sig"][in_x], y["sig"][in_y]]), np.concatenate([x["owner"][in_x], y["owner"][in_y] + len(x["entries"])]),
                    np.concatenate([x["entries"], y["entries"]]), threshold, len(x["entries"]), tuple(np.concatenate([x[k], y[k]]) for k in ("a", "b")),
                )
                yield pa.RecordBatch.from_arrays([pa.array(g) for g in got], names=["a", "b"])

    blocks = rows.mapInArrow(lean(emit), "part int, sig binary, owner binary, entries binary, same binary")
    first = materialise(blocks.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(lean(meet), "part int, path string, a long, b long"), "near-links")
    found, files = first.where("path IS NULL").select("a", "b"), first.where("path IS NOT NULL").select("part", "path")
    if files.isEmpty():
        discard(root)
        found._scratch_path = first._scratch_path
        return found
    tiles = materialise(files.join(files.withColumnRenamed("path", "other"), "part").where("path < other").select("path", "other"), "near-chunk-list")
    tasks = max(tasks, math.ceil(tiles.count() / 16))
    second = materialise(tiles.repartition(tasks, "path", "other").sortWithinPartitions("path").mapInArrow(lean(cross), "a long, b long"), "near-chunk-links")
    discard(root, tiles)
    return found.unionByName(second)


def intersections(hashes: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of sorted sets, pairwise or with ``others``."""
    g, every = len(hashes), [*hashes, *(others or [])]
    size = np.array([len(h) for h in every])
    flat, of = np.concatenate(every), np.repeat(np.arange(len(every)), size)
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    new = np.append(True, flat[1:] != flat[:-1])
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    column = np.cumsum(new & shared) - 1
    of, column = of[shared], column[shared]
    total = int(column[-1]) + 1 if len(column) else 0
    out = np.zeros((g, len(others) if others is not None else g), np.float32)
    width = max(256, 4_000_000 // max(1, len(every)))
    for c in range(0, total, width):
        a, b = np.searchsorted(column, [c, c + width])
        dense = np.zeros((len(every), min(width, total - c)), np.float32)
        dense[of[a:b], column[a:b] - c] = 1
        out += dense[:g] @ (dense[g:] if others is not None else dense).T
    if others is None:
        np.fill_diagonal(out, size)
    return out.astype(np.int32)


class Verdicts:
    """What comparisons found: pairs, or links enough to connect the same sets and the number of each set's pairs."""

    def __init__(self, threshold: float, pairs: bool):
        self.threshold, self.pairs, self.out, self.rows = threshold, pairs, [], 0

    def compare(self, keys: np.ndarray, sets: list[np.ndarray], other_keys: np.ndarray | None = None, others: list[np.ndarray] | None = None) -> None:
        inter = intersections(sets, others)
        size = np.array([len(x) for x in sets], np.int64)
        far_keys, far = (keys, size) if others is None else (other_keys, np.array([len(x) for x in others], np.int64))
        found = []
        for r in range(0, len(keys), 256):  # by rows, so that no further table of pairs is held
            rows = slice(r, r + 256)
            good = inter[rows] >= self.threshold * (size[rows, None] + far[None, :] - inter[rows]) - 1e-9
            if others is None:
                good &= np.arange(len(keys))[None, :] > np.arange(len(keys))[rows, None]
            x, y = np.nonzero(good)
            found.append((x + r, y))
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        if not len(a):
            return
        x, y = keys[a], far_keys[b]
        if self.pairs:
            j = inter[a, b] / (size[a] + far[b] - inter[a, b])
            self._add(x, y, j)
            return
        names, number = np.unique(np.concatenate([x, y]), return_inverse=True)
        u = Unions(len(names))
        u.join(number[: len(x)], number[len(x) :])
        root = u.roots(np.arange(len(names)))
        on = root != np.arange(len(names))
        self._add(names[on], names[root[on]], np.full(on.sum(), np.nan))
        self._add(names, None, np.bincount(number).astype(float))

    def _add(self, x, y, value) -> None:
        self.out.append((x, y, value))
        self.rows += len(x)

    def give(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.rows >= least:
            far = pa.concat_arrays([pa.nulls(len(x), pa.int64()) if y is None else pa.array(y) for x, y, _ in self.out])
            values = pa.array(np.concatenate([v for *_, v in self.out]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in self.out])), far, values], names=["a", "b", "value"])
            self.out, self.rows = [], 0


def _save(path: str, **arrays: np.ndarray) -> None:
    blob = io.BytesIO()
    np.savez(blob, **arrays)
    system, at = fs.FileSystem.from_uri(path)
    with system.open_output_stream(at) as f:
        f.write(blob.getvalue())


def _load(path: str) -> dict[str, np.ndarray]:
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_file(at) as f:
        return dict(np.load(io.BytesIO(f.read())))


def _put(path: str, keys: np.ndarray, sets: list[np.ndarray]) -> None:
    _save(path, keys=keys, bounds=np.cumsum([0] + [len(x) for x in sets]), grams=np.concatenate(sets))


def _get(path: str) -> tuple[np.ndarray, list[np.ndarray]]:
    held = _load(path)
    bounds, grams = held["bounds"], held["grams"]
    return held["keys"], [grams[x:y] for x, y in zip(bounds, bounds[1:])]


def verified(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, pairs: bool = False, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members, found). ``members`` (doc_id, key): the set of each document that may be alike to
    another, or a copy of it. ``found`` (a, b, value) between keys: with ``pairs`` every pair at or over the threshold and its
    similarity; else links (value NaN) that connect the same sets, and (a, null, number of a's pairs) by tile."""
    if not 0.5 <= threshold <= 1:
        raise ValueError("the threshold must lie in [0.5, 1]: under it, alike sets can lie two size bands apart")
    spark = docs.sparkSession
    links_ = candidate_links(docs, n, threshold)
    placed = materialise(connected_components(links_), "near-groups")
    discard(links_)
    members = _rows(docs).join(_sized(placed), F.col("doc_id") == F.col("node")).select("component", "doc_id", "text")
    schema = "component long, doc_id long, key long, more long, grams binary"

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[int, int]] = set()
        for batch in batches:
            for a, b, data, edges in text_runs(batch.column(2), 2_000_000):
                hashes, bounds = gram_sets(data, edges, n)
                some = np.flatnonzero(np.diff(bounds))
                begin, end = bounds[:-1][some], bounds[1:][some]
                keys = set_keys(hashes, np.append(begin, len(hashes)))
                if len(known) > KNOWN_SETS:
                    known.clear()
                got = []
                for x, y, key in zip(begin.tolist(), end.tolist(), zip(*keys.tolist())):
                    got.append(None if key in known else hashes[x:y].tobytes())
                    known.add(key)
                own = batch.slice(a, b - a).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(keys[0]), pa.array(keys[1]), pa.array(got, pa.binary())], names=["component", "doc_id", "key", "more", "grams"])

    sets = materialise(members.mapInArrow(lean(grams), schema), "near-sets")
    root = scratch(spark, "near-blocks")
    system, path = fs.FileSystem.from_uri(root)
    system.create_dir(path, recursive=True)
    results = "component long, path string, a long, b long, value double"

    def widen(batches: Iterator[pa.RecordBatch], component=None, path=None) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([pa.nulls(x.num_rows, pa.int64()), pa.nulls(x.num_rows, pa.string()), *x.columns], names=["component", "path", "a", "b", "value"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdicts, files = Verdicts(threshold, pairs), []
        at, held, size, cut, last = None, [], 0, False, None

        def close(more: bool) -> None:
            """Compare the block within itself; other blocks of the component, if there are any, read it from its file."""
            if not held:
                return
            keys, own = np.array([h[0] for h in held]), [np.frombuffer(h[1], _U) for h in held]
            if len(held) > 1:
                verdicts.compare(keys, own)
            if more:
                name = f"{root}/{uuid.uuid4().hex}.npz"
                _put(name, keys, own)
                files.append((at[0], name))

        for batch in batches:
            for component, blk, blocks, key, more, g in zip(*(c.to_pylist() for c in batch.columns)):
                if (component, blk) != at:
                    close(cut)
                    at, held, size, cut, last = (component, blk), [], 0, blocks > 1, None
                if last == (key, more):
                    continue
                if held and (size + len(g) > BLOCK_BYTES or len(held) >= 2 * block):
                    cut = True
                    close(cut)
                    held, size = [], 0
                last = (key, more)
                held.append((key, g))
                size += len(g)
            yield from widen(verdicts.give(100_000))
            if files:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files]), pa.array([f[1] for f in files]), *(pa.nulls(len(files), pa.int64()) for _ in (0, 1)), pa.nulls(len(files), pa.float64())], names=["component", "path", "a", "b", "value"])
                files.clear()
        close(cut)
        yield from widen(verdicts.give())
        if files:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files]), pa.array([f[1] for f in files]), *(pa.nulls(len(files), pa.int64()) for _ in (0, 1)), pa.nulls(len(files), pa.float64())], names=["component", "path", "a", "b", "value"])

    told = sets.where("grams IS NOT NULL")
    large = told.groupBy("component").agg(F.ceil(F.count_distinct("key") / block).cast("int").alias("blocks")).where("blocks > 1")
    told = told.join(_sized(materialise(large, "near-large")), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    told = told.withColumn("block", F.pmod(F.shiftrightunsigned("key", 7), F.col("blocks")).cast("int"))
    packed = told.select("component", "block", "blocks", "key", "more", "grams").repartition("component", "block").sortWithinPartitions("component", "block", "key", "more")
    first = materialise(packed.mapInArrow(lean(pack), results), "near-found")
    files = first.where("path IS NOT NULL").select("component", "path")
    tiles = files.alias("x").join(files.withColumnRenamed("path", "other").alias("y"), "component").where("path < other").select("path", "other")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdicts, name, held = Verdicts(threshold, pairs), None, None
        for batch in batches:
            for x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if x != name:
                    name, held = x, _get(x)
                verdicts.compare(*held, *_get(y))
                yield from verdicts.give(100_000)
        yield from verdicts.give()

    found = first.where("path IS NULL").select("a", "b", "value")
    if not files.isEmpty():
        tiles = materialise(tiles, "near-tile-list")
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(tiles.count() / 16))
        second = materialise(tiles.repartition(tasks, "path", "other").sortWithinPartitions("path").mapInArrow(lean(meet), "a long, b long, value double"), "near-tiles")
        found = found.unionByName(second)
    return sets.select("doc_id", "key"), found


def representative_pairs(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_a, doc_b, jaccard) for all pairs of different sets of word n-grams with a Jaccard similarity of
    ``threshold`` or more, each set shown by the least document that has it; doc_a < doc_b. Where one
    document (rows that repeat an id) has both sets there is no pair.

    The rules on odd rows are those of ``near_duplicate_classes``.
    """
    members, found = verified(docs, n, threshold, True, block)
    least = members.groupBy("key").agg(F.min("doc_id").alias("doc"))
    named = found.join(least.select(F.col("key").alias("a"), F.col("doc").alias("x")), "a").join(least.select(F.col("key").alias("b"), F.col("doc").alias("y")), "b")
    return named.where("x <> y").groupBy(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).agg(F.round(F.max("value"), 6).alias("jaccard"))


def _member_classes(docs: DataFrame, n: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links) of documents that may be alike to others."""
    members, found = verified(docs, n, threshold, False, block)
    members = members.distinct()
    several = members.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    several = several.select("doc_id", "a").join(members, "doc_id").select("a", F.col("key").alias("b"))
    groups = connected_components(found.where("b IS NOT NULL").select("a", "b").unionByName(several))
    links_ = found.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("value").cast("long").alias("n"))
    placed = members.join(groups.withColumnRenamed("node", "key"), "key", "left").join(links_, "key", "left")
    placed = materialise(placed.select("doc_id", F.coalesce("component", "key").alias("component"), F.coalesce("n", F.lit(0)).alias("n")), "near-members")
    least = placed.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return placed.join(least, "component").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n").cast("long").alias("n_links"))


def near_duplicate_classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links), one row for each document.

    Documents are linked if their sets of word n-grams are equal or have a Jaccard similarity of
    ``threshold`` or more; ``class_id`` is the least doc_id connected by links, ``n_links`` the number of different other
    sets that are so similar to the document's own (copies of one text are one set).

    Documents with null texts, and texts without words, are classes by themselves without links; rows with a null id
    give nothing and join nothing. Rows that repeat an id are one document: what any of them is linked with is in its
    class, and n_links is that of the row with the most. Texts of any length count whole. An
    empty table gives no rows; further columns are ignored.
    """
    ids = pick(docs, "doc_id").selectExpr("cast(doc_id as long) doc_id").where("doc_id IS NOT NULL").distinct()
    classes = _member_classes(docs, n, threshold, block)
    return ids.join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one_of_each(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without near duplicates: of each group connected by similar pairs the least doc_id stays,
    and of rows that repeat an id one of each distinct row. Rows with a null id and texts
    without words all stay."""
    gone = materialise(_member_classes(docs, n, threshold).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone")), "near-duplicates")
    ids = pick(docs, "doc_id")
    repeated = materialise(ids.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")), "repeated-ids")
    at = docs.columns.index("doc_id") if "doc_id" in docs.columns else [c.lower() for c in docs.columns].index("doc_id")
    wide = docs.toDF(*[f"_o{i}" for i in range(len(docs.columns))])
    left = wide.join(_sized(gone), F.col(f"_o{at}") == F.col("_gone"), "left_anti")
    if repeated.isEmpty():
        return left.toDF(*docs.columns)
    marks = _sized(repeated)
    once = left.join(marks, F.col(f"_o{at}") == F.col("_again"), "left_semi").distinct()
    return left.join(marks, F.col(f"_o{at}") == F.col("_again"), "left_anti").union(once).toDF(*docs.columns)


def oracle(n: int = NGRAM, threshold: float = THRESHOLD) -> str:
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(text, '[\\t\\n\\x0B\\f\\r ]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
sets AS (SELECT DISTINCT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {n - 1}, 1) + 1), lambda i: list_aggregate(w[i:i + {n - 1}], 'string_agg', ' ')))) AS s FROM words WHERE len(w) > 0),
nodes AS (SELECT s, min(doc_id) AS rep, row_number() OVER (ORDER BY min(doc_id), s) AS k FROM sets GROUP BY s),
members AS (SELECT doc_id, k FROM sets JOIN nodes USING (s)),
grams AS (SELECT k, len(s) AS size, unnest(s) AS gram FROM nodes),
meets AS (SELECT a.k AS x, b.k AS y, a.size AS sa, b.size AS sb, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.k < b.k GROUP BY ALL),
alike AS (SELECT x, y FROM meets WHERE n >= {threshold} * (sa + sb - n) - 1e-9),
edges AS (SELECT x, y FROM alike UNION SELECT y, x FROM alike UNION SELECT a.k, b.k FROM members a JOIN members b ON a.doc_id = b.doc_id AND a.k <> b.k),
reach AS (SELECT k, k AS far FROM nodes UNION SELECT r.k, e.y FROM reach r JOIN edges e ON e.x = r.far),
class AS (SELECT r.k, min(m.doc_id) AS class_id FROM reach r JOIN members m ON m.k = r.far GROUP BY r.k),
links AS (SELECT k, count(*) AS n FROM (SELECT x AS k FROM alike UNION ALL SELECT y FROM alike) GROUP BY k),
found AS (SELECT doc_id, min(class_id) AS class_id, max(coalesce(n, 0)) AS n_links FROM members JOIN class USING (k) LEFT JOIN links USING (k) GROUP BY doc_id)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN found USING (doc_id)"""
