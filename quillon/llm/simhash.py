"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are made where the documents are. Distinct fingerprints meet in buckets:
with the 64 bits cut into radius + m blocks, two fingerprints within the radius agree on
m whole blocks, so every choice of m blocks gives a bucket key and no link is lost. m
grows with the number of fingerprints, so that buckets stay small.

Inside buckets, fingerprints lie in words of 64 lanes, stored as 64 vertical bit planes.
A fingerprint is compared with a word of lanes at once: difference bits are added into
bitwise counters through carry-save adders, and a word is abandoned when all its lanes
have passed the radius. Links leave a task as a spanning forest, never as pairs. A bucket
that is too large is cut into tiles, and every pair of tiles is a task's unit of work.

Components of the links are found by alternating large-star and small-star rounds. Where
a join meets a node of many links, that node is broadcast.

similar_groups links texts whose sets of five-word shingles have a Jaccard similarity of
0.8 or more. Such sets share a bucket by one of BANDS keys of ROWS least hashes each (a pair
at exactly 0.8 misses all of them once in 4600 times, one at 0.9 once in 10^7), where the same
bit-sliced comparison leaves those within a wide radius. Of these only the forest is kept,
and the texts of each of its components are compared exactly: smaller components at once,
larger ones by the same buckets and tiles.

Defined results: null and empty texts have fingerprint zero and are linked like others, by
similar_groups with each other only; texts of under four (five) words are one shingle; very long
texts are read whole; equal fingerprints are always linked; a null
doc_id never names a component that has another id; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bitmap, has_repeats, matched, saved, text_of, with_maybe, without

WIDTH, RADIUS, SEED = 4, 4, 42
#: Words of a shingle and the least Jaccard similarity of similar texts; bits that their fingerprints may
#: differ by: 10 are expected at a similarity of 0.8, with a deviation of 3; bands, and least hashes in each.
SIMILAR_WIDTH, SIMILARITY, WIDE_RADIUS, BANDS, ROWS = 5, 0.8, 24, 16, 4
#: Rows of a bucket compared in one piece; a larger one has tiles of half as many. And the same for whole texts.
BUCKET, TEXTS = 8192, 512
#: Mean rows a bucket may have before keys take in one block more.
MEAN = 256
#: Hot buckets up to which their list is broadcast.
HOT_BUCKETS = 50_000
#: Comparisons of a fingerprint with a word that are held at once.
CHUNK = 1 << 17

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """A hash of each run of `width` words, repeats included; of the whole sequence if it is shorter."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hash_of(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[: -width] + 1)
    return np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 if there are none."""
    n, value = len(hashes), 0
    if n < 64:
        counts = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        octets = hashes.view(np.uint8).reshape(n, 8)
        counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    for bit in np.flatnonzero(2 * counts > n).tolist():
        value |= 1 << bit
    return value


def fingerprint(text: str, width: int = WIDTH) -> int:
    """Bits set in over half the hashes of a text's word shingles."""
    return majority(shingle_hashes(text, width))


def _fingerprints(width):
    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints, pa.int64())], names=["doc_id", "mark", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, mark (a hash of the text), fp (the 64 bits as a signed long) of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("mark", F.xxhash64("text"))
    return rows.mapInArrow(_fingerprints(width), "doc_id long, mark long, fp long")


# --- comparison -----------------------------------------------------------------------


def planes_of(prints: np.ndarray, lane: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """planes[b, w]: bit b of all lanes of word w; and the lanes of each word that are in use."""
    planes, used = np.zeros((64, words), np.uint64), np.zeros(words, np.uint64)
    at = np.uint64(1) << lane.astype(np.uint64)
    np.bitwise_or.at(used, word, at)
    for b in range(64):
        on = (prints >> np.uint64(b)) & np.uint64(1) == 1
        np.bitwise_or.at(planes[b], word[on], at[on])
    return planes, used


def near(planes: np.ndarray, used: np.ndarray, prints: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compare fingerprint query[k] with all lanes of word[k]; returns query, word and lanes within the radius."""
    size = max(1, (radius + 1).bit_length())  # counters hold radius + 1 and more
    count = [np.zeros(len(query), np.uint64) for _ in range(size)]
    over = ~used[word]
    order = np.arange(64)

    def difference(b):
        mask = np.where((prints[query] >> np.uint64(b)) & np.uint64(1) == 1, ONES, np.uint64(0))
        return planes[b][word] ^ mask

    def add(x, level):
        for k in range(level, size):
            count[k], x = count[k] ^ x, count[k] & x
        return x

    def passed():
        """Lanes whose count is over the radius."""
        more, same = np.zeros_like(over), np.full_like(over, ONES)
        for k in reversed(range(size)):
            if radius >> k & 1:
                same = same & count[k]
            else:
                more, same = more | (same & count[k]), same & ~count[k]
        return more

    for at in range(0, 64, 8):
        twos = []
        for j in range(0, 8, 2):  # carry-save: two planes and the ones counter give a sum and a carry
            a, b = difference(order[at + j]), difference(order[at + j + 1])
            half = count[0] ^ a
            twos.append((count[0] & a) | (half & b))
            count[0] = half ^ b
        for x in twos:
            over |= add(x, 1)
        over |= passed()
        alive = over != ONES
        if not alive.all():  # abandon words all of whose lanes have passed the radius
            query, word, over = query[alive], word[alive], over[alive]
            count = [c[alive] for c in count]
        if not len(query):
            break
    return query, word, ~over


def forest(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest index of each of n nodes' components, links (u, v) added to those of label."""
    label = np.arange(n) if label is None else label
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def hits(group: np.ndarray, prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows within the radius, of rows sorted by group; some at a time, never all of them."""
    n = len(prints)
    if not n:
        return
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(start, n))
    inside = np.arange(n) - np.repeat(start, sizes)
    blocks = -(-sizes // 64)
    first_word = np.cumsum(blocks) - blocks
    word, lane = np.repeat(first_word, sizes) + inside // 64, inside % 64
    total = int(blocks.sum())
    planes, used = planes_of(prints, lane, word, total)
    row_at = np.zeros(total * 64, np.int64)
    row_at[word * 64 + lane] = np.arange(n)
    reach = np.repeat(first_word + blocks, sizes) - word  # words from a row's own to its group's last
    reach[np.repeat(sizes, sizes) < 2] = 0
    done = np.cumsum(reach)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + CHUNK, "right")))
        some = reach[at:stop]
        query = np.repeat(np.arange(at, stop), some)
        against = word[query] + np.arange(len(query)) - np.repeat(np.cumsum(some) - some, some)
        q, w, lanes = near(planes, used, prints, query, against, radius)
        for k in range(0, len(q), 1 << 15):
            hit = np.unpackbits(lanes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, j = np.nonzero(hit)
            yield q[k + i], row_at[w[k + i] * 64 + j]
        at = stop


def link_groups(group: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For rows sorted by group: the first row of each row's component of links inside its group."""
    label = np.arange(len(prints))
    for i, j in hits(group, prints, radius):
        label = forest(len(label), i, j, label)
    return label


# --- buckets --------------------------------------------------------------------------


def block_masks(radius: int, agree: int) -> list[int]:
    """Masks of every choice of `agree` blocks out of radius + agree, as signed longs."""
    m = radius + agree
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(m)]
    masks = [sum(c) for c in combinations(blocks, agree)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def agreeing(n: int, radius: int, mean: int = MEAN) -> int:
    """Blocks that a key takes in, so that n random fingerprints give buckets of a mean size."""
    agree = 1
    while agree < 6 and n / 2.0 ** (64 * agree // (radius + agree)) > mean:
        agree += 1
    return agree


GROUP_KEYS = ("mask", "key", "tile")


def _by_group(batches: Iterator[pa.RecordBatch], least: int, most_bytes: int = 1 << 26) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows sorted by GROUP_KEYS, at least so many rows or bytes at once, with their numbers."""
    kept, rows, size = [], 0, 0

    def numbers(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for name in GROUP_KEYS:
            x = table[name].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.cumsum(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows < least and size < most_bytes:
            continue
        table = pa.Table.from_batches(kept)
        number = numbers(table)
        cut = int(np.searchsorted(number, number[-1]))  # the last group may go on in the next batch
        if cut:
            yield table.slice(0, cut), number[:cut]
            table = pa.Table.from_batches(table.slice(cut).combine_chunks().to_batches())
        kept, rows, size = table.to_batches(), table.num_rows, table.nbytes
    if rows:
        table = pa.Table.from_batches(kept)
        yield table, numbers(table)


def _linker(radius: int, node: str):
    """Rows (mask, key, tile, fp, node) as edges from a node to the first of its component in the group."""

    def run(batches):
        for table, number in _by_group(batches, 1 << 16):
            root = link_groups(number, table["fp"].to_numpy().astype(np.int64).view(np.uint64), radius)
            on = np.flatnonzero(root != np.arange(len(root)))
            names = table[node].combine_chunks()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(on)), names.take(pa.array(root[on]))], names=["u", "v"])

    return run


def dealt(keyed: DataFrame, bucket: int, rows: int) -> DataFrame:
    """About so many rows (mask, key, ...) with a tile. A bucket of more rows than `bucket` is cut: each pair of tiles is a group."""
    hot = saved(keyed.groupBy("mask", "key").count().where(F.col("count") > bucket), rows)
    if hot.isEmpty():
        return keyed.withColumn("tile", F.lit(0))
    if hot.count() <= HOT_BUCKETS:
        known = keyed.join(F.broadcast(hot), ["mask", "key"], "left")
    else:
        known = matched(keyed, hot.withColumn("n", F.col("count")), ["mask", "key"], rows, "left")
    tiles = F.ceil(F.col("count") / F.lit(bucket // 2)).cast("int")
    own = F.pmod(F.xxhash64(F.lit("tile"), *[c for c in keyed.columns if c not in GROUP_KEYS]), tiles).cast("int")
    pair = F.transform(F.sequence(F.lit(0), tiles - 1), lambda o: F.least(o, own) * tiles + F.greatest(o, own))
    return known.withColumn("tile", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(0))).otherwise(pair))).drop("count")


def _grouped_rows(tiled: DataFrame, node: str) -> DataFrame:
    """Groups as neighbours, each by node, so that the first row of a component has its smallest."""
    parts = int(tiled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiled.repartition(parts, *GROUP_KEYS).sortWithinPartitions(*GROUP_KEYS, node)


def near_links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, n: int | None = None) -> DataFrame:
    """Links u - v that join exactly the components of distinct prints(fp) within the radius."""
    n = prints.count() if n is None else n
    masks = block_masks(radius, agreeing(n, radius))
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "key"))
    return _grouped_rows(dealt(keyed, bucket, n * len(masks)), "fp").mapInArrow(_linker(radius, "fp"), "u long, v long")


# --- similar sets -----------------------------------------------------------------------


_FAMILY = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys of each set that is not empty, each of the least of ROWS hashes of its members."""
    whole = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for i, (flip, factor) in enumerate(_FAMILY.T):
        least = np.minimum.reduceat((whole ^ flip) * (factor | np.uint64(1)), starts)
        own = (keys[:, i // ROWS] ^ least) * _FOLD
        keys[:, i // ROWS] = own ^ (own >> np.uint64(32))
    return keys.view(np.int64)


#: Shingles whose least hashes are taken at once; bytes of texts whose groups are compared at once.
TOGETHER, BYTES = 1 << 18, 1 << 22


def _sketches(width: int):
    """Rows (doc_id, text, mark) as (doc_id, mark, sig, fp, keys); sig is a digest of the shingles' set."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        full = [r[2] for r in rows if len(r[2])]
        found = iter(band_keys(full).tolist() if full else [])
        keys = [next(found) if len(r[2]) else [] for r in rows]
        prints = np.array([majority(r[2]) for r in rows], dtype=np.uint64).view(np.int64)
        sigs = [xxhash.xxh3_128_digest(r[2].tobytes(), SEED) for r in rows]
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(sigs, pa.binary()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "sig", "fp", "keys"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for doc_id, text, mark in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                rows.append((doc_id, mark, np.unique(shingle_hashes(text.as_py(), width))))
                size += len(rows[-1][2])
                if size >= TOGETHER or len(rows) >= 1 << 12:
                    yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)

    return run


def verified(number: np.ndarray, sets: list[np.ndarray], nodes: list[int], similarity: float, radius: int = WIDE_RADIUS) -> list[tuple[int, int]]:
    """Links from nodes to the first of their component of similar sets in a group; pairs that are joined already are not compared."""
    prints = np.array([majority(s) for s in sets], dtype=np.uint64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    label = list(range(len(sets)))

    def top(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i, j in hits(number, prints, radius):
        small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        on = (i != j) & (small >= similarity * large) & (small > 0)
        for a, b in zip(i[on].tolist(), j[on].tolist(), strict=True):
            x, y = top(a), top(b)
            if x == y:
                continue
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if both >= similarity * (sizes[a] + sizes[b] - both):
                label[max(x, y)] = min(x, y)
    return [(nodes[i], nodes[top(i)]) for i in range(len(sets)) if top(i) != i]


def _verifier(width: int, similarity: float):
    def run(batches):
        for table, number in _by_group(batches, 1 << 10, BYTES):
            edges = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(number))
            filled = np.append(0, np.cumsum(pc.binary_length(table["text"].combine_chunks()).to_numpy()))
            a = 0
            while a < len(edges) - 1:  # some whole groups at once
                b = max(a + 1, int(np.searchsorted(filled[edges], filled[edges[a]] + BYTES, "right")) - 1)
                own = table.slice(edges[a], edges[b] - edges[a])
                sets = [np.unique(shingle_hashes(t.as_py(), width)) for t in own["text"]]
                links = verified(number[edges[a] : edges[b]], sets, own["node"].to_pylist(), similarity)
                columns = zip(*links, strict=True) if links else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u", "v"])
                a = b

    return run


def similar_links(docs: DataFrame, nodes: DataFrame, n: int, width: int, similarity: float, bucket: int = BUCKET, texts: int = TEXTS) -> DataFrame:
    """Links u - v that join the components of similar sets; the n nodes(node, first, least, fp, keys) are distinct sets of docs."""
    keyed = lambda rows, *more: rows.select(*more, F.posexplode("keys").alias("mask", "key"))
    near_ = _grouped_rows(dealt(keyed(nodes, "node", "fp"), bucket, n * BANDS), "node").mapInArrow(_linker(WIDE_RADIUS, "node"), "u long, v long")
    stars = components(near_, n)
    members = stars.select("node", "root").unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    grouped = saved(members.join(nodes, "node").select("node", "root", "first", "least", "keys"), n)
    some = grouped.count()
    large = saved(stars.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("n")).where(F.col("n") > texts), some)
    alone = grouped.select("node", F.lit(-1).alias("mask"), F.col("root").alias("key"), F.lit(0).alias("tile"))
    if large.isEmpty():
        groups = alone
    else:  # larger components by bands and tiles
        marked = saved(matched(grouped, large.select("root", "n", F.lit(True).alias("large")), "root", some, "left"), some)
        split = dealt(keyed(marked.where("large"), "node"), texts, some * BANDS).select("node", "mask", "key", "tile")
        groups = alone.join(marked.where("large").select("node"), "node", "left_anti").unionByName(split)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("mark", F.xxhash64("text"))
    maybe = with_maybe(rows, bitmap(grouped, "least"), "mark", "maybe").where("maybe").alias("r")
    same = (F.col("r.mark") == F.col("g.least")) & F.col("r.doc_id").eqNullSafe(F.col("g.first"))
    own = saved(maybe.join(grouped.alias("g"), same).select("node", "r.text").groupBy("node").agg(F.any_value("text").alias("text")))
    return _grouped_rows(groups.join(own, "node"), "node").mapInArrow(_verifier(width, similarity), "u long, v long")


# --- components -----------------------------------------------------------------------


def _lowest(pairs: DataFrame, total: int) -> DataFrame:
    return saved(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both, 2 * total)
    return matched(both.where("v > u"), low, "u", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down, total)
    moved = matched(down, low, "u", total)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _done(edges: DataFrame) -> bool:
    """Whether every edge goes down to a node that has none down itself, and every node has one at most."""
    ends = edges.select(F.col("u").alias("x"), F.when(F.col("v") < F.col("u"), 1).otherwise(2).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    sums = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return sums.where("down > 1 OR (down > 0 AND up > 0)").isEmpty()


def components(edges: DataFrame, n: int | None = None) -> DataFrame:
    """node, root: the smallest node reachable over edges(u, v), for every node with a link; a saved table.

    n: about how many edges there are.
    """
    edges = saved(edges.where("u <> v").distinct(), n)
    while not _done(edges):
        total = edges.count()
        edges = saved(_small_star(saved(_large_star(edges, total), total), total), total)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


# --- the operator ---------------------------------------------------------------------


def _named(rows: DataFrame, nodes: DataFrame, stars: DataFrame, key: str) -> DataFrame:
    """rows(key, ...) with `low`, their component's lowest member: an id before none, then by text hash and key."""
    total = rows.count()
    own = F.col(key).alias("own")
    rooted = saved(nodes.join(stars, "node", "left").select(own, "first", "least", "rows", F.coalesce("root", "node").alias("root")), total)
    lowest = saved(rooted.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "least", "own")).alias("low"), F.count(F.lit(1)).alias("n")), total)
    named = matched(rooted.select("own", "root", "rows"), lowest, "root", total).select("own", "low", F.col("rows").alias("n"))
    return matched(rows.withColumnRenamed(key, "own"), saved(named, total), "own", total)


def _near(docs: DataFrame, radius: int, width: int, bucket: int) -> DataFrame:
    """doc_id, mark, own (the fingerprint), low of rows linked by fingerprints."""
    rows = saved(fingerprints(docs, width).withColumnRenamed("fp", "node"))
    nodes = saved(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("mark").alias("least"), F.count(F.lit(1)).alias("rows")), rows.count())
    n = nodes.count()
    stars = components(near_links(nodes.select(F.col("node").alias("fp")), radius, bucket, n), n)
    return _named(rows, nodes, stars, "node")


def _similar(docs: DataFrame, width: int, similarity: float, bucket: int, texts: int) -> DataFrame:
    """doc_id, mark, own (a digest of the shingles), low of rows linked by similarity."""
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("mark", F.xxhash64("text"))
    made = saved(first.mapInArrow(_sketches(width), "doc_id long, mark long, sig binary, fp long, keys array<long>"))
    rows = made.select("doc_id", "mark", "sig")
    shown = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("shown")
    nodes = made.groupBy("sig").agg(shown, F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys"), F.count(F.lit(1)).alias("rows"))
    number = F.monotonically_increasing_id().alias("node")  # kept with the rows
    nodes = saved(nodes.select(number, "sig", F.col("shown.doc_id").alias("first"), F.col("shown.mark").alias("least"), "fp", "keys", "rows"), rows.count())
    n = nodes.count()
    stars = components(similar_links(docs, nodes, n, width, similarity, bucket, texts), n)
    return _named(rows, nodes, stars, "sig")


def near_groups(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs(doc_id, text)."""
    rows = _near(docs, radius, width, bucket)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("own")), 16, "0").alias("fingerprint"), F.col("low.first").alias("component_id"))


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, width: int = SIMILAR_WIDTH, bucket: int = BUCKET, texts: int = TEXTS) -> DataFrame:
    """doc_id, component_id for each row of docs(doc_id, text)."""
    return _similar(docs, width, similarity, bucket, texts).select("doc_id", F.col("low.first").alias("component_id"))


def _firsts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    stays = F.when(F.col("low.none"), (F.col("own") == F.col("low.own")) & (F.col("mark") == F.col("low.least"))).otherwise(F.col("doc_id").eqNullSafe(F.col("low.first")))
    left = without(docs, rows.where(~stays), F.xxhash64(text_of()))
    if has_repeats(docs):
        left = left.withColumn("_same_text", F.md5(text_of())).dropDuplicates(["doc_id", "_same_text"]).drop("_same_text")
    return left


def near_deduplicated(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH, bucket: int = BUCKET) -> DataFrame:
    """One document of each component of near_groups, the one with the smallest id, with all its columns."""
    return _firsts_of(docs, _near(docs, radius, width, bucket))


def similar_deduplicated(docs: DataFrame, similarity: float = SIMILARITY, width: int = SIMILAR_WIDTH, bucket: int = BUCKET, texts: int = TEXTS) -> DataFrame:
    """One document of each component of similar_groups, the one with the smallest id, with all its columns."""
    return _firsts_of(docs, _similar(docs, width, similarity, bucket, texts))
