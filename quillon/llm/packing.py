"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents are tokenized where they are; only pieces (ids and lengths) move. Pieces that
fill a sequence are done. The others are dealt evenly into blocks, packed best-fit in
order of length, and improved by local search: while a block has more bins than its
tokens need, documents move between underfull bins, or are exchanged one for one or two
for one, each step raising the sum of squared fills, until the emptiest bins are empty.
What lies in bins with more than `loose` free tokens is dealt again into fewer blocks, round
after round, until one block holds all of it or a round no longer leaves less.

The search ends by itself, since the sum cannot rise for ever; `patience` ends it sooner, after
so many steps without a bin less. No piece is lost by that; some bins may be left underfull.

Defined results: null and empty texts give one piece of one token; texts of any length are
tokenized whole; ties are broken by
the row's place; rows that repeat are packed again; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import saved, text_of

SEQUENCE = 2048
#: Pieces in a block; a bin with more free tokens than LOOSE is packed again with those of other blocks.
BLOCK, LOOSE = 16384, 16
#: Steps of the local search without a bin less, after which a block is left as it is.
PATIENCE = 400

_LOADED: dict[str, object] = {}


class Ids:
    """Ids of texts by a tokenizer file; a faster reader of the same vocabulary where there is one."""

    def __init__(self, name: str):
        import public_tokenizers as P

        self.path, self.fast = P.path(name), None
        with open(self.path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f).get("added_tokens") or []]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        try:
            import tiktoken

            with open(P.path(name.replace(".json", ".tiktoken")), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (ImportError, OSError, KeyError):
            pass

    @cached_property
    def slow(self):
        """The tokenizer itself, loaded when it is needed."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> list[int]:
        if self.fast and not self.special.search(text):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # extreme texts pass the pattern's limits, which some versions tell by a panic
                if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                    raise
        return self.slow.encode(text, add_special_tokens=False).ids


def ids_of(name: str) -> Ids:
    if name not in _LOADED:
        _LOADED[name] = Ids(name)
    return _LOADED[name]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def cut(ids: np.ndarray, limit: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(piece, start, ids): whole if it fits, else pieces of the limit with the shorter one first."""
    first = len(ids) % limit or limit
    yield 0, 0, ids[:first]
    for k, at in enumerate(range(first, len(ids), limit), 1):
        yield k, at, ids[at : at + limit]


def pieces(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    def run(batches):
        encode = ids_of(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py()), 0], dtype="<u4")
                rows += [(doc_id, k, at, len(x), zlib.crc32(x.tobytes())) for k, at, x in cut(ids, limit)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Bins of indices: each item, longest first, goes where it leaves the least room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: a bin with r free
    for i in np.argsort(-lengths, kind="stable").tolist():
        x = int(lengths[i])
        fits = rooms >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            own = by_room[room]
            b = own.pop()
            if not own:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = limit, len(bins)
            bins.append([i])
        room -= x
        if room:
            by_room.setdefault(room, []).append(b)
            rooms |= 1 << room
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, limit: int, patience: int = PATIENCE) -> list[list[int]]:
    """Local search between underfull bins: moves and exchanges that raise the sum of squared fills."""
    fills = np.array([int(lengths[b].sum()) for b in bins], dtype=np.int64)
    least = -(-int(fills.sum()) // limit)
    alive, idle, stuck = len(bins), 0, set()
    while alive > least and idle < patience:
        idle += 1
        open_ = np.flatnonzero((fills > 0) & (fills < limit))
        todo = [b for b in open_.tolist() if b not in stuck]
        if len(open_) < 2 or not todo:
            break
        b = min(todo, key=lambda k: (fills[k], k))
        others = open_[open_ != b]
        moved = False
        for i in sorted(bins[b], key=lambda k: -lengths[k]):
            if step := _step(i, b, bins, fills, lengths, limit, others):
                to, back = step
                for k in back:
                    bins[to].remove(k)
                bins[b].remove(i)
                bins[to].append(i)
                bins[b].extend(back)
                gain = int(lengths[i]) - int(lengths[back].sum() if back else 0)
                fills[to] += gain
                fills[b] -= gain
                stuck.discard(to)
                moved = True
                break
        if not moved:
            stuck.add(b)
        elif not bins[b]:
            alive, idle, stuck = alive - 1, 0, set()
    return [b for b in bins if b]


def _step(i, b, bins, fills, lengths, limit, others):
    """The step for item i of bin b that raises the squares most: (bin, items given back), or None."""
    x, room = int(lengths[i]), limit - fills[others]
    k = np.flatnonzero(room >= x)
    if len(k):  # move
        to = int(others[k[np.argmax(fills[others[k]])]])
        return to, []
    owner = np.repeat(others, [len(bins[o]) for o in others])
    item = np.array([j for o in others for j in bins[o]], dtype=np.int64)
    if not len(item):
        return None
    order = np.lexsort((lengths[item], owner))
    item, owner = item[order], owner[order]
    y, room = lengths[item], limit - fills[owner]

    def gain(d, ok):
        return np.where(ok & (d > 0) & (d <= room) & (fills[owner] + d > fills[b]), d * (fills[owner] - fills[b] + d), 0)

    one = gain(x - y, True)  # one for one
    # two for one: to each item the smallest other one of its bin with which it leaves no more than the room
    key = owner * (limit + 1) + y
    other = np.searchsorted(key, owner * (limit + 1) + np.maximum(x - room - y, 0))
    other += other == np.arange(len(item))
    at = np.minimum(other, len(item) - 1)
    two = gain(x - y - y[at], (other < len(item)) & (owner[at] == owner))
    first, second = int(np.argmax(one)), int(np.argmax(two))
    if two[second] > one[first]:
        return int(owner[second]), [int(item[second]), int(item[at[second]])]
    return (int(owner[first]), [int(item[first])]) if one[first] else None


PACKED = PIECES + ", sequence_id long, offset long"


def _packer(limit: int, tag: int, patience: int):
    def run(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy().astype(np.int64)
        bins = improve(best_fit(lengths, limit), lengths, limit, patience)
        n = len(lengths)
        seq, off, fill = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
        block = int(table["block"][0].as_py())
        for k, b in enumerate(bins):
            own = lengths[b]
            seq[b] = (((block << 20) + k) << TAG_BITS) + tag
            off[b] = np.cumsum(own) - own
            fill[b] = own.sum()
        out = table.drop_columns(["block"])
        for name, column in (("sequence_id", seq), ("offset", off), ("fill", fill)):
            out = out.append_column(name, pa.array(column))
        return out

    return run


#: Bits of a sequence's number that tell its round, 0 for pieces that fill a sequence.
TAG_BITS = 6


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = SEQUENCE, block: int = BLOCK, loose: int = LOOSE, patience: int = PATIENCE) -> DataFrame:
    """docs(doc_id, text) as pieces with the sequence and offset where each lies."""
    rows = saved(pieces(docs, tokenizer, limit))
    place = F.monotonically_increasing_id()
    whole = rows.where(F.col("length") == limit).select("*", F.shiftleft(place, TAG_BITS).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo, out = rows.where(F.col("length") < limit), whole
    n = todo.count()
    for tag in range(1, 1 << TAG_BITS):
        if not n:
            break
        blocks = -(-n // block)
        dealt = todo.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "start", place), F.lit(blocks)))
        packed = saved(dealt.groupBy("block").applyInArrow(_packer(limit, tag, patience), PACKED + ", fill long"))
        tight = F.col("fill") >= limit - loose
        before, n = n, packed.where(~tight).count() if blocks > 1 else 0
        if n >= before or not n:  # no use in going on, or nothing left
            out = out.unionByName(packed.drop("fill"))
            break
        out = out.unionByName(packed.where(tight).drop("fill"))
        todo = packed.where(~tight).drop("fill", "sequence_id", "offset")
    else:
        out = out.unionByName(packed.where(~tight).drop("fill"))
    return out
