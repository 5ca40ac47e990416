"""Media columns: texts stored as samples in ISO media containers, and such containers indexed.

The container has a file type box, a movie box with one track, and the media data. The
walker descends nested boxes, decodes the sample tables (durations, sizes, compact sizes,
chunk map, chunk offsets, sync samples) and the runs of movie fragments with their defaults,
and gives codec, duration and the byte ranges of keyframes without decoding a payload.

Counts and offsets are held to the boxes and the file they are in. A track that breaks this
gets a status that tells how, and no samples; the others of the file are indexed. Boxes are
descended DEPTH deep, far deeper than the format nests them.

Defined results: null text counts as empty and gives one frame of blanks; texts of any
length are stored whole; an empty table gives no rows; further columns are ignored; rows are
independent, so repeats repeat; what is no container, or has no track, gives no index row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import text_of

FRAME = 192
#: A sync sample every so many frames, and so many frames in a chunk.
GROUP, CHUNK = 16, 64
TIMESCALE = 48_000
# Boxes of the format that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
CODEC = b"raw "
DEPTH = 32


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < (1 << 32) - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def table(kind: bytes, rows: np.ndarray, width: str = ">u4") -> bytes:
    return full(kind, struct.pack(">I", len(rows)), np.ascontiguousarray(rows, dtype=width).tobytes())


def store(payload: bytes, frame: int = FRAME) -> bytes:
    """A container whose samples are the payload's frames, one after the other."""
    n = len(payload) // frame
    if not n or len(payload) % frame:
        raise ValueError("payload is not a positive number of frames")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    chunks = np.arange(0, n, CHUNK, dtype=np.int64) * frame
    rest = n % CHUNK
    runs = [[1, CHUNK, 1]] if n >= CHUNK else []
    if rest:
        runs.append([len(chunks), rest, 1])
    entry = box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, 0))
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def movie(base: int) -> bytes:
        at = chunks + base
        wide = bool(at[-1] >= 1 << 32)
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            table(b"stts", np.array([[n, frame]])),
            table(b"stss", np.arange(0, n, GROUP) + 1),
            table(b"stsc", np.array(runs)),
            full(b"stsz", struct.pack(">II", frame, n)),
            table(b"co64" if wide else b"stco", at, ">u8" if wide else ">u4"),
        )
        long_ = n * frame
        return box(
            b"moov",
            full(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, long_), struct.pack(">IHH8x", 0x10000, 0x100, 0), matrix, bytes(24), struct.pack(">I", 2), version=1),
            box(
                b"trak",
                full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, long_, 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=7),
                box(
                    b"mdia",
                    full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, long_, 0x55C4, 0), version=1),
                    full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"samples\0"),
                    box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl),
                ),
            ),
        )

    head = 16 if len(payload) >= (1 << 32) - 8 else 8
    base = len(ftyp) + len(movie(0)) + head
    return ftyp + movie(base) + box(b"mdat", payload)


NO_SAMPLES = np.zeros(0, np.int64)


@dataclass
class Track:
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    offsets: np.ndarray = field(default_factory=lambda: NO_SAMPLES)
    sizes: np.ndarray = field(default_factory=lambda: NO_SAMPLES)
    sync: np.ndarray = field(default_factory=lambda: NO_SAMPLES)
    status: str = "ok"

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def keyframes(self) -> list[tuple[int, int]]:
        """Byte range (start, end) of each sync sample."""
        i = self.sync
        return list(zip(self.offsets[i].tolist(), (self.offsets[i] + self.sizes[i]).tolist(), strict=True))


class Damaged(ValueError):
    """A box that does not hold what it says."""


class Box(NamedTuple):
    """Where a box and its body start, where it ends, and the kinds of the boxes around it and its own."""

    path: tuple[bytes, ...]
    start: int
    body: int
    stop: int

    @property
    def kind(self) -> bytes:
        return self.path[-1]


def walk(data: bytes) -> Iterator[Box]:
    """Every box, outer ones first. A truncated box ends the walk of its parent."""
    todo: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while todo:
        start, end, path = todo.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        stop = start + size
        if size < body - start or stop > end:
            continue
        yield Box((*path, kind), start, body, stop)
        todo.append((stop, end, path))
        if kind in CONTAINERS and len(path) < DEPTH:
            todo.append((body, stop, (*path, kind)))


class Reader:
    """Numbers of a box's body, one after the other; what is beyond its end is damage."""

    def __init__(self, data: bytes, box: Box):
        self.data, self.at, self.stop, self.name = data, box.body, box.stop, box.kind.decode("latin-1")

    def take(self, form: str) -> tuple:
        at, self.at = self.at, self.at + struct.calcsize(form)
        if self.at > self.stop:
            raise Damaged(f"{self.name} is too short")
        return struct.unpack_from(form, self.data, at)

    def head(self) -> tuple[int, int]:
        """Version and flags."""
        word = self.take(">I")[0]
        return word >> 24, word & 0xFFFFFF

    def rows(self, n: int, width: str, columns: int = 1) -> np.ndarray:
        size = n * columns * np.dtype(width).itemsize
        if self.at + size > self.stop:
            raise Damaged(f"{self.name} has fewer entries than it says")
        flat = np.frombuffer(self.data, width, n * columns, self.at).astype(np.int64)
        self.at += size
        return flat.reshape(n, columns) if columns > 1 else flat


def _table(data: bytes, box: Box, width: str, columns: int = 1) -> np.ndarray:
    r = Reader(data, box)
    r.head()
    return r.rows(r.take(">I")[0], width, columns)


def _held(n: int, size: int, data: bytes, name: str) -> None:
    """Samples of a size that is told once need no table, so only the file holds their number down."""
    if n > len(data) or n * size > len(data):
        raise Damaged(f"{name} has more samples than the file has room for")


def _sizes(data: bytes, parts: dict[bytes, Box]) -> np.ndarray:
    if b"stsz" in parts:
        r = Reader(data, parts[b"stsz"])
        r.head()
        fixed, n = r.take(">II")
        if not fixed:
            return r.rows(n, ">u4")
        _held(n, fixed, data, r.name)
        return np.full(n, fixed, np.int64)
    r = Reader(data, parts[b"stz2"])
    r.head()
    width, n = r.take(">II")
    if (width := width & 0xFF) == 4:
        pairs = r.rows((n + 1) // 2, ">u1")
        return np.stack([pairs >> 4, pairs & 15], axis=1).reshape(-1)[:n]
    if width not in (8, 16):
        raise Damaged("stz2 has no known width")
    return r.rows(n, ">u1" if width == 8 else ">u2")


def _sampled(data: bytes, parts: dict[bytes, Box], track: Track) -> None:
    """Samples of the movie's own tables."""
    sizes = _sizes(data, parts)
    n = len(sizes)
    chunk_at = _table(data, parts[b"co64"], ">u8") if b"co64" in parts else _table(data, parts[b"stco"], ">u4")
    runs = _table(data, parts[b"stsc"], ">u4", 3).reshape(-1, 3)
    spent = _table(data, parts[b"stts"], ">u4", 2).reshape(-1, 2)
    sync = _table(data, parts[b"stss"], ">u4") - 1 if b"stss" in parts else np.arange(n)
    if len(sync) and (sync.min() < 0 or sync.max() >= n):
        raise Damaged("stss names samples that there are not")
    track.duration = track.duration or sum(a * b for a, b in spent.tolist())
    if not n:
        return
    if not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any():
        raise Damaged("stsc is not in order")
    reach = np.minimum(np.append(runs[1:, 0], len(chunk_at) + 1), len(chunk_at) + 1)
    per_chunk = np.repeat(runs[:, 1], np.maximum(reach - np.minimum(runs[:, 0], len(chunk_at) + 1), 0))
    last = np.cumsum(per_chunk)
    if not len(last) or last[-1] < n:
        raise Damaged("chunks hold fewer samples than there are")
    chunk_of = np.searchsorted(last, np.arange(n), "right")
    before = np.cumsum(sizes) - sizes
    first = np.minimum(last - per_chunk, n - 1)
    track.offsets, track.sizes, track.sync = chunk_at[chunk_of] + before - before[first[chunk_of]], sizes, sync


def _defaults(data: bytes, box: Box) -> tuple[int, tuple[int, int, int]]:
    """The track of a trex box, and its samples' duration, size and flags."""
    r = Reader(data, box)
    r.head()
    track, _, duration, size, flags = r.take(">5I")
    return track, (duration, size, flags)


def _fragment(data: bytes, moof: Box, parts: list[Box], defaults: dict[int, tuple[int, int, int]], after: int) -> tuple[int, int, list[tuple], int]:
    """Of a traf box: its track, time, runs as (offsets, sizes, sync flags), and where its data ends."""
    r = Reader(data, parts[0])
    _, flags = r.head()
    track = r.take(">I")[0]
    base = r.take(">Q")[0] if flags & 1 else moof.start if flags & 0x20000 or after < 0 else after
    if flags & 2:
        r.take(">I")
    own = list(defaults.get(track, (0, 0, 0)))
    for k, bit in enumerate((8, 16, 32)):
        if flags & bit:
            own[k] = r.take(">I")[0]
    at, time, out = base, 0, []
    for box in parts[1:]:
        r = Reader(data, box)
        _, flags = r.head()
        n = r.take(">I")[0]
        if flags & 1:
            at = base + r.take(">i")[0]
        if not 0 <= at <= len(data):
            raise Damaged("a fragment's data is beyond the file")
        first = r.take(">I")[0] if flags & 4 else None
        given = [k for k, bit in enumerate((0x100, 0x200, 0x400, 0x800)) if flags & bit]
        if not given:
            _held(n, own[1], data, r.name)
        rows = r.rows(n, ">u4", len(given)).reshape(n, len(given)) if given else NO_SAMPLES
        column = lambda k: rows[:, given.index(k)] if k in given else np.full(n, own[k], np.int64)
        sizes, marks = column(1), column(2).copy()
        if first is not None and n:
            marks[0] = first
        out.append((at + np.cumsum(sizes) - sizes, sizes, marks & 0x10000 == 0))
        time, at = time + int(column(0).sum()), at + int(sizes.sum())
    return track, time, out, at


def tracks(data: bytes) -> list[Track]:
    """The index of every track: of its sample tables, and of the fragments that go on with it."""
    found: list[dict[bytes, Box]] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    fragments: list[tuple[Box, list[Box]]] = []
    moof, broken = None, ""
    for own in walk(data):
        if own.kind == b"trak":
            found.append({})
        elif b"trak" in own.path:
            found[-1].setdefault(own.kind, own)
        elif own.kind == b"trex":
            try:
                track, values = _defaults(data, own)
                defaults[track] = values
            except Damaged as e:
                broken = broken or str(e)
        elif own.kind == b"moof":
            moof = own
        elif own.kind == b"traf" and moof:
            fragments.append((moof, []))
        elif own.kind in (b"tfhd", b"trun") and b"traf" in own.path and fragments:
            fragments[-1][1].append(own)
    out, ids = [], []
    for parts in found:
        track, number = Track(), None
        try:
            if b"tkhd" in parts:
                r = Reader(data, parts[b"tkhd"])
                r.take(">QQ" if r.head()[0] else ">II")
                number = r.take(">I")[0]
            if not {b"mdhd", b"stsd", b"stts", b"stsc"} <= parts.keys() or not parts.keys() & {b"stsz", b"stz2"} or not parts.keys() & {b"stco", b"co64"}:
                raise Damaged("no whole sample table")
            r = Reader(data, parts[b"mdhd"])
            long_ = r.head()[0]
            r.take(">QQ" if long_ else ">II")
            track.timescale, track.duration = r.take(">IQ" if long_ else ">II")
            r = Reader(data, parts[b"stsd"])
            track.codec = r.take(">12x4s")[0].decode("latin-1")
            _sampled(data, parts, track)
        except Damaged as e:
            track = Track(track.codec, track.timescale, track.duration, status=str(e))
        out.append(track)
        ids.append(number)
    _continue(data, fragments, defaults, {n: t for n, t in zip(ids, out, strict=True) if n is not None}, broken)
    for t in out:
        if t.status == "ok" and len(t.sizes) and (t.offsets.min() < 0 or (t.offsets + t.sizes).max() > len(data)):
            t.status = "samples beyond the file"
    return out


def _continue(data: bytes, fragments, defaults, by_id: dict[int, Track], broken: str) -> None:
    """Add the fragments' runs to their tracks."""
    more: dict[int, list[tuple]] = {}
    told = {n for n, t in by_id.items() if t.duration}
    last, after = None, -1
    for moof, parts in fragments:
        if last is not moof:
            last, after = moof, -1
        try:
            if not parts or parts[0].kind != b"tfhd" or any(p.kind != b"trun" for p in parts[1:]):
                raise Damaged("a fragment does not start with its header")
            track, time, runs, after = _fragment(data, moof, parts, defaults, after)
        except Damaged as e:
            broken = broken or str(e)
            continue
        if (own := by_id.get(track)) and own.status == "ok":
            more.setdefault(track, []).extend(runs)
            if track not in told:
                own.duration += time
    for number, runs in more.items():
        if not runs:
            continue
        own, had = by_id[number], len(by_id[number].sizes)
        flags = np.concatenate([r[2] for r in runs])
        own.offsets = np.concatenate([own.offsets, *(r[0] for r in runs)])
        own.sizes = np.concatenate([own.sizes, *(r[1] for r in runs)])
        own.sync = np.concatenate([own.sync, had + np.flatnonzero(flags)])
    if broken and fragments:
        for own in by_id.values():
            own.status = broken if own.status == "ok" else own.status


def read_back(data: bytes, track: Track) -> bytes:
    """The samples' bytes in order; neighbouring samples are read as one range."""
    if not len(track.offsets):
        return b""
    cuts = np.flatnonzero(track.offsets[1:] != track.offsets[:-1] + track.sizes[:-1]) + 1
    firsts, lasts = np.append(0, cuts), np.append(cuts, len(track.offsets)) - 1
    return b"".join(data[track.offsets[a] : track.offsets[b] + track.sizes[b]] for a, b in zip(firsts, lasts, strict=True))


def feature(track: Track) -> str:
    keys = ",".join(f"{a}-{b}" for a, b in track.keyframes())
    return f"codec={track.codec.strip()};seconds={track.seconds:.6f};samples={len(track.sizes)};keyframes={keys}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes()
            data = store(raw + b" " * ((-len(raw)) % FRAME or (0 if raw else FRAME)))
            track = tracks(data)[0]
            back = read_back(data, track)
            rows.append((doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(track)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=names)


def stored_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text), each text stored and read back: digests and the feature of its index."""
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(_stored, SCHEMA)


INDEX_SCHEMA = "name string, track int, codec string, seconds double, samples long, keyframes array<struct<start: long, end: long>>, status string"


def _indexed(batches):
    import pandas as pd

    for pdf in batches:
        rows = []
        for name, data in zip(pdf["name"], pdf["content"], strict=True):
            for i, t in enumerate(tracks(bytes(data)) if data is not None else []):
                rows.append((name, i, t.codec, t.seconds, len(t.sizes), [{"start": a, "end": b} for a, b in t.keyframes()], t.status))
        yield pd.DataFrame(rows, columns=["name", "track", "codec", "seconds", "samples", "keyframes", "status"])


def index_media(files: DataFrame) -> DataFrame:
    """files(name, content binary): one row a track. status is 'ok', or tells what is wrong with the track."""
    return files.select("name", "content").mapInPandas(_indexed, INDEX_SCHEMA)
