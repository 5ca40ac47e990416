"""Removal of repeated byte strings by bucketed, deep-shallow sorted suffixes.

A byte goes if a string of MIN bytes that covers it also starts earlier: in a document
with a smaller id, or earlier in the same document.

Each window of MIN bytes has an anchor, the place of the smallest hash among its grams of
GRAM bytes (the leftmost of equal ones). Equal windows have their anchors at the same
place, so only windows whose anchors have the same gram need comparing. Neighbouring
windows with one anchor form a run; all of its bytes are its region.

Pass 1 deals runs by gram and finds grams with several runs. They are marked in bitmaps of
a fixed size. Pass 2 deals the runs of marked grams into buckets. Runs with equal regions
fall to the first of them, already in the map task: those with the same 64-bit hashes of
gram and region, whose bytes are then compared. Only where all regions of a gram have one
hash are no bytes sent, so that runs of different tasks are equal by these 128 bits.
Where the regions of a gram differ, the suffixes from the anchors on are sorted: multikey quicksort over 8-byte
characters, in which every open group is parted into smaller, equal and larger ones at
once, to a shallow depth, and blind tries for the groups that still agree; the reversed
prefixes before the anchors likewise. Common prefixes of sorted neighbours cut both orders
into intervals of rows that agree to a depth. Windows with b bytes before the anchor are
equal exactly if they share an interval of depth MIN - b to the right and one of depth b
to the left, so one look at each b tells the first row of every window, however many
regions a gram has; no pairs are made. A gram of more than SPLIT regions would be too much
for a bucket, so its windows are dealt one by one, by a hash of their own, and sorted in
their buckets the same way: equal ones are neighbours that agree in MIN bytes.

A full bitmap costs speed, not results: with more repeated grams than bits, pass 2 deals
all runs, with their regions, rather than those that may be repeats.

Defined results: null text counts as empty; a null doc_id comes after all others; of
rows with the same doc_id, the smaller 64-bit text hash comes first, and rows that repeat both
are one document; texts of under MIN bytes lose nothing; very long texts are cut into
overlapping segments, so nothing is missed between them; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bitmap, saved, text_of, with_maybe

MIN, GRAM = 100, 24
#: Windows handled at once, of a longer document in overlapping segments; and about so many bytes dealt together.
SEGMENT, TOGETHER = 1 << 20, 1 << 24
#: Least and most bits of the largest bitmap, as powers of 2 (32 MB), and buckets for each shuffle partition.
BITS, BUCKETS = (20, 28), 8
#: Grams with several regions are fewer, and those with very many are few: their bitmaps have fewer bits by these powers.
FEWER = (0, 2, 5)
#: Bytes compared by quicksort before tries take over.
SHALLOW = 32
#: Regions of a gram beyond which its windows are dealt one by one; windows that are sorted at once.
SPLIT, SLICE = 32768, 1 << 20
#: Bytes of input for which there is a bucket at least.
BUCKET_BYTES = 1 << 26
#: Bytes of a bitmap that a row brings to the driver.
PIECE = 1 << 17
WIDE = 104  # regions reach at most MIN bytes from the anchor, padded to whole words
_PLACE = np.uint64((1 << 24) - 1)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
LAST = (1 << 63) - 1


# --- anchors ---------------------------------------------------------------------------


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    n = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    h = words[:n] * _MIX[0]
    h += (words[8 : 8 + n] * _MIX[1]) ^ (h >> np.uint64(31))
    h += (words[16 : 16 + n] * _MIX[2]) ^ (h >> np.uint64(29))
    h ^= h >> np.uint64(32)
    h *= _MIX[0]
    h ^= h >> np.uint64(29)
    return h


def spread(hashes: np.ndarray) -> np.ndarray:
    """One to one. Anchors have small hashes; after this their leading bits are even again."""
    h = (hashes ^ (hashes >> np.uint64(31))) * _MIX[2]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


def anchor_runs(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows, anchor) of each run; and the gram hash of each run's anchor."""
    span = MIN - GRAM + 1
    hashes = gram_hashes(data)
    low = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    have = 1
    while have < span:  # smallest of `have` neighbours, doubled until it spans a window
        more = min(have, span - have)
        low = np.minimum(low[:-more], low[more:])
        have += more
    anchor = (low & _PLACE).astype(np.int64)
    edge = np.zeros(len(data) + 1, np.int8)
    long_ = ends - starts >= MIN
    edge[starts[long_]] += 1
    edge[ends[long_] - MIN + 1] -= 1  # documents do not overlap, so no place occurs twice with one sign
    whole = np.cumsum(edge[: len(anchor)], dtype=np.int8) > 0
    cut = np.ones(len(anchor), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
    cut[starts[long_]] = True
    first = np.flatnonzero(cut)
    count = np.diff(np.append(first, len(anchor)))
    on = whole[first]
    first, count = first[on], count[on]
    at = anchor[first]
    doc = np.searchsorted(starts, first, "right") - 1
    return doc, first, count, at, spread(hashes[at])


class Chunk:
    """Runs of some documents, with the text they lie in."""

    def __init__(self, texts: list[bytes], bases: list[int], keys: list[int], marks: list[int]):
        self.data = b"".join(texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size)
        starts = ends - size
        doc, self.first, self.count, self.anchor, self.gram = anchor_runs(self.data, starts, ends)
        view, reach = self.data, self.first + self.count + MIN - 1
        self.region = np.array([xxhash.xxh64_intdigest(view[a:b]) for a, b in zip(self.first.tolist(), reach.tolist(), strict=True)], dtype=np.uint64)
        self.key, self.mark, self.offset = np.array(keys, np.int64)[doc], np.array(marks, np.int64)[doc], self.anchor - self.first
        self.place = self.first + (np.array(bases, np.int64) - starts)[doc]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Chunk]]:
    """Chunks, some together; documents too short for a window are left out, long ones segmented."""
    out, texts, bases, keys, marks, size = [], [], [], [], [], 0

    def close() -> None:
        nonlocal texts, bases, keys, marks, size
        out.append(Chunk(texts, bases, keys, marks))
        texts, bases, keys, marks, size = [], [], [], [], 0

    for batch in batches:
        for key, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = text.as_buffer().to_pybytes()
            for base in range(0, max(len(data) - MIN + 1, 0), SEGMENT):
                part = data[base : base + SEGMENT + MIN - 1]
                if texts and size + len(part) > SEGMENT + MIN:
                    close()
                    if len(out) * SEGMENT >= TOGETHER:
                        yield out
                        out = []
                texts.append(part)
                bases.append(base)
                keys.append(key)
                marks.append(mark)
                size += len(part)
    if texts:
        close()
    if out:
        yield out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _blobs(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """Rows sorted by bucket, as one blob a bucket: the columns one after the other."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(bucket)).tolist(), strict=True):
        if a < b:
            yield int(bucket[a]), b"".join(c[a:b].tobytes() for c in columns)


# --- pass 1: grams with several runs ----------------------------------------------------


def _pairs(buckets: int):
    def run(batches):
        for own in chunks(batches):
            gram, region = (np.concatenate([getattr(c, k) for c in own]) for k in ("gram", "region"))
            order = np.lexsort((region, gram))
            gram, region = gram[order], region[order]
            same = np.zeros(len(gram), bool)
            same[1:] = (gram[1:] == gram[:-1]) & (region[1:] == region[:-1])
            third = same.copy()
            third[1:] &= same[:-1]
            gram, region = gram[~third], region[~third]  # twice is as good as more
            rows = list(_blobs(bucket_of(gram, buckets), [gram, region]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])

    return run


def _columns(blobs: list[bytes], kinds: str) -> list[np.ndarray]:
    """Columns of 8-byte numbers out of blobs, kinds such as 'uuii'."""
    parts = [np.frombuffer(b, "<u8").reshape(len(kinds), -1) for b in blobs]
    whole = np.concatenate(parts, axis=1) if parts else np.zeros((len(kinds), 0), np.uint64)
    return [whole[i] if k == "u" else whole[i].view(np.int64) for i, k in enumerate(kinds)]


def _rows_of_bits(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    """Which bitmap, from which byte on, and the bytes."""
    return pa.table({"which": pa.array([r[0] for r in rows], pa.int32()), "base": pa.array([r[1] for r in rows], pa.int64()), "bits": pa.array([r[2] for r in rows], pa.binary())})


def _marker(bits: int, split: int):
    def run(table: pa.Table) -> pa.Table:
        gram, region = _columns(table["blob"].to_pylist(), "uu")
        order = np.lexsort((region, gram))
        gram, region = gram[order], region[order]
        new = np.append(True, gram[1:] != gram[:-1])
        other = np.append(True, (region[1:] != region[:-1]) | new[1:])
        at = np.flatnonzero(new)
        runs, kinds = np.diff(np.append(at, len(gram))), np.add.reduceat(other.astype(np.int64), at)
        out = []
        for which, (less, on) in enumerate(zip(FEWER, (runs > 1, kinds > 1, kinds > split), strict=True)):
            slot = (gram[at] >> np.uint64(64 - bits + less)).astype(np.int64)
            base = int(slot[0]) & ~7
            flags = np.zeros((int(slot[-1]) - base) // 8 * 8 + 8, bool)
            flags[slot[on] - base] = True
            own, byte = np.packbits(flags, bitorder="little").tobytes(), base // 8
            while own:  # rows end where pieces do
                n = PIECE - byte % PIECE
                out.append((which, byte, own[:n]))
                own, byte = own[n:], byte + n
        return _rows_of_bits(out)

    return run


def _whole_piece(table: pa.Table) -> pa.Table:
    """The bits of all buckets in one piece of a bitmap."""
    base = table["base"].to_numpy()
    first = int(base.min())
    out = np.zeros(PIECE - first % PIECE, np.uint8)
    for a, bits in zip((base - first).tolist(), table["bits"], strict=True):
        own = np.frombuffer(bits.as_buffer(), np.uint8)
        out[a : a + len(own)] |= own
    used = np.flatnonzero(out)
    return _rows_of_bits([(table["which"][0].as_py(), first, out[: used[-1] + 1].tobytes())] if len(used) else [])


def marked_grams(rows: DataFrame, buckets: int, bits: int, split: int) -> list[np.ndarray]:
    """Three bitmaps over the grams' leading bits: several runs, several regions, more than `split` regions.

    Their size is fixed by `bits`. Each bucket gives its own stretch of them; the executors
    join these to pieces, so the driver gets a row a piece, however many buckets there are.
    """
    layout = "which int, base long, bits binary"
    found = rows.mapInArrow(_pairs(buckets), "bucket long, blob binary").groupBy("bucket").applyInArrow(_marker(bits, split), layout)
    whole = found.groupBy("which", F.floor(F.col("base") / PIECE)).applyInArrow(_whole_piece, layout)
    out = [np.zeros((1 << bits - less) // 8, np.uint8) for less in FEWER]
    for r in whole.collect():
        piece = np.frombuffer(r["bits"], np.uint8)
        out[r["which"]][r["base"] : r["base"] + len(piece)] |= piece
    return out


def _has(bits: np.ndarray, gram: np.ndarray) -> np.ndarray:
    slot = (gram >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


# --- pass 2: runs of those grams into buckets --------------------------------------------


def merged(key: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of the intervals of each document."""
    order = np.lexsort((start, mark, key))
    key, mark, start, end = key[order], mark[order], start[order], end[order]
    if not len(key):
        return key, mark, start, end
    fresh = np.append(True, (key[1:] != key[:-1]) | (mark[1:] != mark[:-1]))
    number = np.cumsum(fresh)
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * far) - number * far  # furthest end so far in the document
    new = fresh.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return key[at], mark[at], start[at], np.maximum.reduceat(reach, at)


def _spans(key: np.ndarray, mark: np.ndarray, place: np.ndarray, size) -> tuple[np.ndarray, ...]:
    return key, mark, place, place + size


def _firsts(gram: np.ndarray, region: np.ndarray, *where: np.ndarray, text: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the hashes and then where: key, mark, place; which rows are first of their bytes; which repeat an earlier place.

    Rows of the same hashes as the first, but with another text, count as first ones too.
    """
    order = np.lexsort((*reversed(where), region, gram))
    lead = np.zeros(len(order), bool)
    lead[:1] = True
    for x in (gram, region):
        lead[1:] |= x[order][1:] != x[order][:-1]
    at = np.flatnonzero(lead)
    head = np.repeat(order[at], np.diff(np.append(at, len(order))))
    later = np.flatnonzero(~lead)
    lead[later] = [text(i) != text(j) for i, j in zip(order[later].tolist(), head[later].tolist(), strict=True)]
    again = np.zeros(len(order), bool)
    for x in where:
        again |= x[order] != x[head]
    return order, lead, again & ~lead


def _windows(c: Chunk, part: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each window of some runs by itself: gram, hash, key, mark, place, where it starts in the chunk."""
    count = c.count[part]
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    part = np.repeat(part, count)
    start = c.first[part] + step
    hashes = np.fromiter((xxhash.xxh64_intdigest(c.data[a : a + MIN]) for a in start.tolist()), np.uint64, len(start))
    return c.gram[part], hashes, c.key[part], c.mark[part], c.place[part] + step, start


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["bucket", "kind", "blob", "bytes"])


def _dealer(buckets: int, shared):
    """Rows (bucket, kind, blob, bytes): kind 0 repeats for certain, 1 runs, 2 single windows.

    Of runs with equal regions in a batch, only the first goes on, and of equal windows.
    """

    def run(batches):
        dup, multi, hot = shared.value
        for turn, own in enumerate(chunks(batches)):
            runs, windows, rows, gone = [], [], [], []
            for k, c in enumerate(own):
                on = np.flatnonzero(_has(dup, c.gram))
                split = _has(hot, c.gram[on])
                p = on[~split]
                runs.append((c.gram[p], c.region[p], c.key[p], c.mark[p], c.place[p], c.count[p], c.offset[p], c.first[p], np.full(len(p), k)))
                if split.any():
                    windows.append((k, _windows(c, on[split])))
            if windows:
                chunk = np.repeat([k for k, _ in windows], [len(w[0]) for _, w in windows])
                gram, hashes, key, mark, place, start = (np.concatenate(x) for x in zip(*(w for _, w in windows), strict=True))
                text = lambda i: own[chunk[i]].data[start[i] : start[i] + MIN]
                order, lead, repeat = _firsts(gram, hashes, key, mark, place, text=text)
                o = order[repeat]
                gone.append(_spans(key[o], mark[o], place[o], MIN))
                keep = order[lead]
                keep = keep[np.argsort(hashes[keep], kind="stable")]
                held = a = 0
                for b, blob in _blobs(bucket_of(hashes[keep], buckets), [x[keep] for x in (hashes, key, mark, place)]):
                    stop = a + len(blob) // 32
                    rows.append((b, 2, packed(blob), packed(b"".join(map(text, keep[a:stop].tolist())))))
                    a, held = stop, held + len(rows[-1][2]) + len(rows[-1][3])
                    if held > TOGETHER:
                        yield _dealt(rows)
                        rows, held = [], 0
            gram, region, key, mark, place, count, offset, first, chunk = (np.concatenate(x) for x in zip(*runs, strict=True))
            reach = first + count + MIN - 1
            order, lead, repeat = _firsts(gram, region, key, mark, place, text=lambda i: own[chunk[i]].data[first[i] : reach[i]])
            o = order[repeat]
            gone.append(_spans(key[o], mark[o], place[o], count[o] + MIN - 1))
            keep = order[lead]
            bucket = bucket_of(gram[keep], buckets)
            needs = _has(multi, gram[keep])
            about = count[keep] << 32 | offset[keep] << 16 | needs
            size = np.where(needs, count[keep] + MIN - 1, 0)
            chunk, first, a = chunk[keep], first[keep], 0
            for b, blob in _blobs(bucket, [*(x[keep] for x in (gram, region, key, mark, place)), about]):
                stop = a + len(blob) // 48
                text = b"".join(own[k].data[i : i + n] for k, i, n in zip(chunk[a:stop].tolist(), first[a:stop].tolist(), size[a:stop].tolist(), strict=True))
                rows.append((b, 1, packed(blob), packed(text)))
                a = stop
            spans = merged(*(np.concatenate(x) for x in zip(*gone, strict=True)))
            if len(spans[0]):
                rows.append(((int(spans[0][0]) * 31 + turn) % buckets, 0, packed(b"".join(x.tobytes() for x in spans)), None))
            yield _dealt(rows)

    return run


# --- deep-shallow sorting ----------------------------------------------------------------


class BlindTrie:
    """Strings of one length by the bits at which they part; the bits between are not looked at on the way down."""

    __slots__ = ("bits", "root")

    def __init__(self, size: int):
        self.bits, self.root = 8 * size, None

    def add(self, value: int, item: int) -> None:
        if self.root is None:
            self.root = [value, [item]]
            return
        node = self.root
        while len(node) == 3:
            node = node[1 + (value >> node[0] & 1)]
        apart = value ^ node[0]
        if not apart:
            node[1].append(item)
            return
        bit = apart.bit_length() - 1  # the highest bit at which they differ
        above, side, node = None, 0, self.root
        while len(node) == 3 and node[0] > bit:
            above, side = node, 1 + (value >> node[0] & 1)
            node = node[side]
        leaf = [value, [item]]
        new = [bit, node, leaf] if value >> bit & 1 else [bit, leaf, node]
        if above is None:
            self.root = new
        else:
            above[side] = new

    def items(self) -> list[int]:
        out, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if len(node) == 3:
                todo += [node[2], node[1]]
            else:
                out += node[1]
        return out


def _in_groups(cut: np.ndarray) -> np.ndarray:
    """Which rows are in a group of several, by the marks of the groups' first rows."""
    size = np.diff(np.append(np.flatnonzero(cut), len(cut)))
    return np.repeat(size > 1, size)


def deep_shallow(rows: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Order of byte strings (rows of a matrix, padded) inside groups."""
    n, wide = rows.shape
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64).reshape(n, wide // 8)
    order = np.argsort(group, kind="stable")
    label = group[order]  # rows with one label are not told apart yet
    cut = np.append(True, label[1:] != label[:-1])
    depth = np.zeros(n, np.int64)  # characters in which the rows of a group are known to agree
    last = min(shallow, wide) // 8
    open_ = np.flatnonzero(_in_groups(cut))
    while len(open_):  # multikey quicksort: a pivot parts each open group into smaller, equal and larger rows
        own = np.cumsum(cut[open_]) - 1
        at = np.flatnonzero(cut[open_])
        char = words[order[open_], depth[open_]]
        pivot = char[at + np.diff(np.append(at, len(open_))) // 2]
        side = (char > pivot[own]).astype(np.int8) - (char < pivot[own])
        by = np.lexsort((side, own))
        order[open_], own, side = order[open_][by], own[by], side[by]
        new = np.append(True, (own[1:] != own[:-1]) | (side[1:] != side[:-1]))
        cut[open_] = new
        depth[open_] = depth[open_][by] + (side == 0)  # the equal ones go on with the next character
        on = _in_groups(new) & (depth[open_] < last)
        open_ = open_[on]
    label = np.cumsum(cut)
    at = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
    size = np.diff(np.append(at, n))
    for a, m in zip(at[size > 1].tolist(), size[size > 1].tolist(), strict=True):  # blind tries order what still agrees
        trie = BlindTrie(wide)
        for i in order[a : a + m].tolist():
            trie.add(int.from_bytes(rows[i].tobytes(), "big"), i)
        order[a : a + m] = trie.items()
    return order


def neighbour_lcp(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it in order; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 1 << 14):
        b = min(len(order), a + (1 << 14))
        same = rows[order[a:b]] == rows[order[a - 1 : b - 1]]
        out[a:b] = np.where(same.all(axis=1), rows.shape[1], np.argmin(same, axis=1))
    return out


def _padded(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(WIDE, b"\0") for p in parts), np.uint8).reshape(len(parts), WIDE)


def _intervals(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    """For each row the number of its interval in the order: those that agree in `depth` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcp < depth)
    return out


def repeated_windows(group: np.ndarray, regions: list[bytes], offset: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window) that an earlier row of the group also has; rows sorted by group and then place."""
    n = len(group)
    right = _padded([r[o:] for r, o in zip(regions, offset.tolist(), strict=True)])
    left = _padded([r[:o][::-1] for r, o in zip(regions, offset.tolist(), strict=True)])
    ahead, back = deep_shallow(right, group), deep_shallow(left, group)
    far, near = neighbour_lcp(right, ahead), neighbour_lcp(left, back)
    for order, lcp in ((ahead, far), (back, near)):  # an interval never goes on into another group
        lcp[1:][group[order[1:]] != group[order[:-1]]] = -1
        lcp[:1] = -1
    longest = np.array([len(r) for r in regions], np.int64) - offset
    at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(at, n))
    out: list[tuple[np.ndarray, ...]] = [(at[:0], at[:0], at[:0])]

    # two rows: their common prefixes tell all equal windows at once
    later, earlier = at[size == 2] + 1, at[size == 2]
    place = np.empty(n, np.int64)
    for both, (order, lcp) in enumerate(((ahead, far), (back, near))):
        place[order] = np.arange(n)
        agree = lcp[np.maximum(place[later], place[earlier])]
        if not both:
            r = np.minimum(agree, np.minimum(longest[later], longest[earlier]))
        else:
            lf = np.minimum(agree, np.minimum(offset[later], offset[earlier]))
    low = np.maximum(MIN - r, offset[later] - count[later] + 1)  # bytes of the window before the anchor
    on = low <= lf
    out.append((later[on], (offset[later] - lf)[on], (offset[later] - low)[on]))

    many = np.flatnonzero(np.repeat(size > 2, size))
    if len(many):
        for b in range(int(offset[many].max()) + 1):
            own = many[(offset[many] >= b) & (offset[many] - count[many] < b)]  # rows with such a window
            if len(own) < 2:
                continue
            a, z = _intervals(ahead, far, MIN - b)[own], _intervals(back, near, b)[own]
            by = np.lexsort((own, z, a))
            same = np.append(False, (a[by][1:] == a[by][:-1]) & (z[by][1:] == z[by][:-1]))
            row = own[by[same]]  # the first row of a window stays
            out.append((row, offset[row] - b, offset[row] - b))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def equal_windows(hashes: np.ndarray, text: bytes, slice_: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """(row, first row) of windows that an earlier row also has; row i has MIN bytes of the text. Rows of one hash are sorted together."""
    whole = np.frombuffer(text, np.uint8).reshape(-1, MIN)
    by = np.argsort(hashes, kind="stable")
    fresh = np.flatnonzero(np.append(True, hashes[by][1:] != hashes[by][:-1]))
    out, a = [(by[:0], by[:0])], 0
    while a < len(by):
        b = np.searchsorted(fresh, a + slice_)
        stop = int(fresh[b]) if b < len(fresh) else len(by)
        own = by[a:stop]
        rows = np.zeros((len(own), WIDE), np.uint8)
        rows[:, :MIN] = whole[own]
        order = deep_shallow(rows, np.cumsum(np.append(True, hashes[own][1:] != hashes[own][:-1])))
        new = neighbour_lcp(rows, order) < MIN
        at = np.flatnonzero(new)
        first = np.repeat(order[at], np.diff(np.append(at, len(order))))
        out.append((own[order[~new]], own[first[~new]]))
        a = stop
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _judge(table: pa.Table) -> pa.Table:
    """Repeats in a bucket: key, mark and the interval as start << 32 | end."""
    kind = table["kind"].to_numpy()
    blobs, extra = table["blob"], table["bytes"]

    def columns(which: int, kinds: str) -> list[np.ndarray]:
        return _columns([unpacked(blobs[int(i)].as_py()) for i in np.flatnonzero(kind == which)], kinds)

    def texts(which: int) -> bytes:
        return b"".join(unpacked(extra[int(i)].as_py()) for i in np.flatnonzero(kind == which))

    gone = [tuple(columns(0, "iiii"))]
    hashes, *where = columns(2, "uiii")
    if len(hashes):
        order = np.lexsort(where[::-1])  # by place: the first of equal ones stays
        placed = np.frombuffer(texts(2), np.uint8).reshape(-1, MIN)[order].tobytes()
        row, head = equal_windows(hashes[order], placed)
        row, head = order[row], order[head]
        on = np.zeros(len(row), bool)
        for x in where:
            on |= x[row] != x[head]
        gone.append(_spans(*(x[row[on]] for x in where), MIN))
    gram, region, key, mark, place, about = columns(1, "uuiiii")
    if len(gram):
        count, offset, needs = about >> 32, about >> 16 & 0xFFFF, about & 1
        size = np.where(needs == 1, count + MIN - 1, 0)
        end, data = np.cumsum(size), texts(1)
        begin = end - size
        order, lead, repeat = _firsts(gram, region, key, mark, place, text=lambda i: data[begin[i] : end[i]])
        o = order[repeat]
        gone.append(_spans(key[o], mark[o], place[o], count[o] + MIN - 1))
        first = order[lead]
        first = first[needs[first] == 1]
        first = first[np.lexsort((place[first], mark[first], key[first], gram[first]))]
        g = gram[first]
        same = np.zeros(len(g) + 1, bool)
        same[1:-1] = g[1:] == g[:-1]
        first = first[same[:-1] | same[1:]]
        if len(first):
            group = np.cumsum(np.append(True, gram[first][1:] != gram[first][:-1]))
            regions = [data[a:e] for a, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
            row, a, b = repeated_windows(group, regions, offset[first], count[first])
            o = first[row]
            gone.append(_spans(key[o], mark[o], place[o] + a, b - a + MIN))
    key, mark, a, b = merged(*(np.concatenate(x) for x in zip(*gone, strict=True)))
    return pa.table({"key": key, "mark": mark, "span": a << 32 | b})


# --- the operator ------------------------------------------------------------------------


def _cut_out(batches):
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes()
            packed = np.sort(np.array(spans or [], np.int64))
            zero = np.zeros(len(packed), np.int64)
            _, _, start, end = merged(zero, zero, packed >> 32, packed & 0xFFFFFFFF)
            kept, at = hashlib.sha256(), 0
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            rows.append((doc_id, len(data), int((end - start).sum()), len(start), kept.hexdigest()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def input_bytes(docs: DataFrame) -> int:
    """The engine's own estimate of a frame's bytes, from its files; 0 where it has none."""
    told = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return told if told < 1 << 60 else 0


def repeats(docs: DataFrame, bits: int | None = None, split: int = SPLIT) -> DataFrame:
    """key, mark, spans (array of start << 32 | end in bytes) of each document that has repeats."""
    spark = docs.sparkSession
    buckets = max(64, BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // BUCKET_BYTES)
    bits = min(max((buckets << 15).bit_length(), BITS[0]), BITS[1]) if bits is None else bits
    rows = docs.select("key", "mark", "text")
    shared = spark.sparkContext.broadcast(marked_grams(rows, buckets, bits, split))
    dealt = rows.mapInArrow(_dealer(buckets, shared), "bucket long, kind int, blob binary, bytes binary")
    found = dealt.groupBy("bucket").applyInArrow(_judge, "key long, mark long, span long")
    return found.groupBy("key", "mark").agg(F.collect_list("span").alias("spans"))


def remove_repeats(docs: DataFrame, bits: int | None = None, split: int = SPLIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs(doc_id, text)."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    whole = whole.withColumn("key", F.coalesce("doc_id", F.lit(LAST))).withColumn("mark", F.xxhash64("text"))
    found = saved(repeats(whole, bits, split))
    marked = with_maybe(whole, bitmap(found, "mark"), "mark", "maybe")
    size = F.octet_length("text").cast("long")
    zero = F.lit(0).cast("long")
    clean = marked.where("NOT maybe").select("doc_id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    touched = marked.where("maybe").drop("maybe").join(found, ["key", "mark"], "left").select("doc_id", "text", "spans")
    return clean.unionByName(touched.mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
