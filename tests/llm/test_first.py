"""Packing, exact dedup, media columns and mixing."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import exact_dedup, media, mixing, packing, queries
from tests.oracle import assert_same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "Same Text", "en", "a", 9), (2, "same text", "en", "a", 9), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \t\n", "en", None, 3),
    (6, "word " * 30000, "en", "a", 150000), (7, "ÄÖ é", "de", "a", 4), (7, "ÄÖ é", "de", "a", 4), (None, "lost", "en", "b", 4), (8, "äö é", "de", "c", 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("h", F.lit("clash")).withColumn("_chunk", F.lit(1)).withColumn("size", F.lit(7))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), sf, queries.ORACLES[name])


@pytest.mark.parametrize("bits,weak", [(24, False), (16, True)])
def test_exact_groups(odd, bits, weak):
    hash_of = (lambda t: F.unhex(F.substring(F.md5(t), 1, 2)) if not weak else F.lit(b"x")) if weak else exact_dedup.content_hash
    got = sorted(map(tuple, exact_dedup.exact_groups(odd, bits=bits if weak else None, hash_of=hash_of).collect()), key=repr)
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for i, t, *_ in ODD:
        groups[low(t)].append(i)
    want = []
    for i, t, *_ in ODD:
        ids = [x for x in groups[low(t)] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[low(t)]), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert exact_dedup.deduplicated(odd).count() == len(groups)


def test_exact_dedup_without_ids(spark):
    rows = [(None, "A b"), (None, "a B"), (None, "c"), (4, "c"), (4, "c"), (4, "d"), (None, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _id int, _own int")
    out = exact_dedup.deduplicated(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, (r.text or "").lower()) for r in out.collect()), key=repr) == sorted([(None, "a b"), (4, "c"), (4, "d"), (None, "")], key=repr)


def test_empty_tables(none):
    assert exact_dedup.exact_groups(none).count() == exact_dedup.deduplicated(none).count() == 0
    assert media.stored_texts(none).count() == packing.pack(none).count() == 0
    assert mixing.mix(none).count() == mixing.mixed(none).count() == 0


def test_media_round_trip(odd):
    texts = {i: t or "" for i, t, *_ in ODD}
    for r in media.stored_texts(odd).collect():
        raw = texts[r.doc_id].encode()
        pad = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
        assert r.media_bytes > len(pad) and r.feature.startswith("codec=raw;")


def boxes(data):
    """Kind and body of boxes that fill the bytes to the last one, by the layout of the format alone."""
    out, at = [], 0
    while at < len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8].decode()
        head = 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        assert head <= size <= len(data) - at, (kind, size)
        out.append((kind, data[at + head : at + size]))
        at += size
    return out


def inside(data, *path):
    """The body of the one box of each kind on the way down."""
    for kind in path:
        (data,) = [body for k, body in boxes(data) if k == kind]
    return data


def numbers(body, width=4):
    return [int.from_bytes(body[k : k + width], "big") for k in range(0, len(body), width)]


def read_independently(data):
    """Payload and feature of a stored text, read without the operator's reader."""
    assert [k for k, _ in boxes(data)] == ["ftyp", "moov", "mdat"]
    media_ = ("moov", "trak", "mdia")
    table = lambda kind: inside(data, *media_, "minf", "stbl", kind)
    head = inside(data, *media_, "mdhd")
    scale, duration = numbers(head[20:24])[0], numbers(head[24:32], 8)[0]  # version 1
    assert head[0] == 1 and table("stsd")[4:8] == bytes([0, 0, 0, 1])
    codec = boxes(table("stsd")[8:])[0][0]
    size, n = numbers(table("stsz")[4:12])
    runs = numbers(table("stts")[8:])
    assert sum(runs[::2]) == n and sum(a * b for a, b in zip(runs[::2], runs[1::2])) == duration
    places = numbers(table("stco")[8:])
    chunk_runs = numbers(table("stsc")[8:])
    per_chunk = {}
    for first, count, entry in zip(*(chunk_runs[k::3] for k in range(3))):
        assert entry == 1
        per_chunk |= {c: count for c in range(first, len(places) + 1)}
    at = [place + k * size for c, place in enumerate(places, 1) for k in range(per_chunk[c])]
    assert len(at) == n
    keys = [at[k - 1] for k in numbers(table("stss")[8:])]
    feature = f"codec={codec.strip()};seconds={duration / scale:.6f};samples={n};keyframes={','.join(f'{k}-{k + size}' for k in keys)}"
    return b"".join(data[a : a + size] for a in at), feature


def test_media_by_an_independent_reader(spark):
    texts = ["", "a", "x" * 192, "é" * 97, "word " * 2500, "long " * 100_000]
    for r in media.stored_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        raw = texts[r.doc_id].encode()
        pad = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        data = media.store(pad)
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        assert read_independently(data) == (pad, r.feature)


def test_media_index(spark):
    pay = random.Random(1).randbytes(192 * 133)
    data = media.store(pay)
    (t,) = media.tracks(data)
    assert media.read_back(data, t) == pay and t.seconds == 192 * 133 / 48000
    assert [data[a:b] for a, b in t.keyframes()] == [pay[i * 192 : i * 192 + 192] for i in range(0, 133, 16)]
    assert {p[-1] for p, *_ in media.walk(data)} >= {b"ftyp", b"moov", b"stbl", b"stsz", b"mdat"}
    assert media.tracks(data[:300]) == [] and media.tracks(b"") == []
    files = spark.createDataFrame([("a", data), ("b", b"junk"), ("c", None)], "name string, content binary")
    (r,) = media.index_media(files).collect()
    assert (r.name, r.codec, r.samples, len(r.keyframes)) == ("a", "raw ", 133, 9)


def fragmented(sizes, keys, given=True):
    """A movie without samples of its own, and a fragment for each list of sizes."""
    word = lambda *x: struct.pack(f">{len(x)}I", *x)
    entry = media.box(b"avc1", bytes(78))
    empty = [media.full(k, word(0)) for k in (b"stts", b"stsc", b"stco")] + [media.full(b"stsz", word(0, 0))]
    stbl = media.box(b"stbl", media.full(b"stsd", word(1), entry), *empty)
    trak = media.box(b"trak", media.full(b"tkhd", word(0, 0, 7), bytes(72)), media.box(b"mdia", media.full(b"mdhd", word(0, 0, 1000, 0), bytes(4)), media.box(b"minf", stbl)))
    out = media.box(b"ftyp", b"isom", word(512)) + media.box(b"moov", trak, media.box(b"mvex", media.full(b"trex", word(7, 1, 40, sizes[0][0], 0x10000))))
    payloads = []
    for own in sizes:
        rows = b"".join(word(50, n, 0 if k in keys else 0x10000) for k, n in enumerate(own))
        flags, body = (0x701, rows) if given else (0x5, b"")

        def moof(at):
            head = word(len(own)) + struct.pack(">i", at) + (b"" if given else word(0))
            return media.box(b"moof", media.full(b"mfhd", word(1)), media.box(b"traf", media.full(b"tfhd", word(7), flags=0x20000), media.full(b"trun", head, body, flags=flags)))

        data = random.Random(len(out)).randbytes(sum(own))
        out += moof(len(moof(0)) + 8) + media.box(b"mdat", data)
        payloads.append(data)
    return out, b"".join(payloads)


def test_fragments():
    data, payload = fragmented([[5, 9, 30], [4, 4]], {0})
    (t,) = media.tracks(data)
    assert (t.codec, t.status, t.seconds, t.sizes.tolist(), t.sync.tolist()) == ("avc1", "ok", 0.25, [5, 9, 30, 4, 4], [0, 3])
    assert media.read_back(data, t) == payload and [data[a:b] for a, b in t.keyframes()] == [payload[:5], payload[44:48]]
    data, payload = fragmented([[6] * 4, [6] * 2], set(), given=False)  # all from the defaults, the first a keyframe
    (t,) = media.tracks(data)
    assert t.sizes.tolist() == [6] * 6 and t.sync.tolist() == [0, 4] and t.duration == 240 and media.read_back(data, t) == payload


@pytest.mark.parametrize("width,sizes,values", [(4, [3, 15, 1, 7, 2], b"\x3f\x17\x20"), (8, [3, 200, 1], b"\x03\xc8\x01"), (16, [3, 60000], b"\x00\x03\xea\x60")])
def test_compact_sizes(width, sizes, values):
    data = media.full(b"stz2", struct.pack(">II", width, len(sizes)), values)
    (own,) = media.walk(data)
    assert media._sizes(data, {b"stz2": own}).tolist() == sizes


def patched(data, kind, at, value):
    """The container with a word of a box's body replaced."""
    own = next(b for b in media.walk(data) if b.kind == kind)
    return data[: own.body + at] + struct.pack(">I", value) + data[own.body + at + 4 :]


@pytest.mark.parametrize("kind,at,value,told", [
    (b"stsz", 8, 0xFFFFFFF0, "room"), (b"stts", 4, 9999, "fewer entries"), (b"stss", 8, 0, "stss names"), (b"stss", 4, 1 << 31, "fewer entries"),
    (b"stsc", 8, 5, "not in order"), (b"stsc", 12, 1, "chunks hold"), (b"stco", 8, 1 << 31, "beyond"), (b"stco", 4, 7, "fewer entries"),
])
def test_damaged_containers(kind, at, value, told):
    (t,) = media.tracks(patched(media.store(random.Random(1).randbytes(192 * 133)), kind, at, value))
    assert told in t.status and (told == "beyond" or not len(t.sizes))


def test_deep_and_fuzzed_containers(spark):
    deep = b""
    for _ in range(1500):
        deep = media.box(b"moov", deep)
    assert media.tracks(deep) == [] and len(list(media.walk(deep))) == media.DEPTH + 1
    assert len(list(media.walk(struct.pack(">I4s", 8, b"moov") * 50000))) == 50000
    rng, files = random.Random(3), [("deep", deep)]
    for good in (media.store(rng.randbytes(192 * 70)), fragmented([[5, 9, 30], [4, 4]], {0})[0], fragmented([[6] * 4], set(), False)[0]):
        heads = [b for b in media.walk(good) if b.kind != b"mdat"]
        for k in range(2000):
            data = bytearray(good)
            for _ in range(rng.randrange(1, 4)):
                own = rng.choice(heads)
                i = rng.randrange(own.start, own.stop)
                data[i] = rng.choice([0, 1, 255, rng.randrange(256)])
            data = bytes(data[: rng.randrange(len(data))] if rng.random() < 0.2 else data)
            for t in media.tracks(data):
                assert t.status and len(t.sizes) <= len(data) and len(t.keyframes()) == len(t.sync)
            if k % 100 == 0:
                files.append((str(k), data))
    assert media.index_media(spark.createDataFrame([(*f, "x") for f in files], "name string, content binary, status string")).where("status IS NULL").isEmpty()


def check_packing(rows, docs, limit=2048):
    enc = packing.ids_of("byte_bpe_50k.json").slow
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for own in by_seq.values():
        end = 0
        for off, n in sorted(own):
            assert off == end
            end += n
        assert end <= limit
    for i, t in docs:
        ids = np.array(enc.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i])
        want, at = [], 0
        for k, n in enumerate([len(ids) % limit or limit] + [limit] * ((len(ids) - 1) // limit)):
            want.append((k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
        assert got == want
    return len(by_seq), -(-sum(r.length for r in rows) // limit)


def test_packing(spark, sf, odd):
    docs = [(r.doc_id, r.text) for r in odd.dropDuplicates(["doc_id"]).collect()]
    check_packing(packing.pack(odd.dropDuplicates(["doc_id"])).collect(), docs)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used, least = check_packing(queries.op1_best_fit_packing(spark, sf).collect(), docs)
    assert used <= least * 1.01 + 1
    blocks = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), block=100).collect()
    used, least = check_packing(blocks, docs)
    assert used <= least * 1.02 + 2


def test_repeated_rows_are_packed_again(spark, odd):
    """Each row by itself: as many pieces as rows ask for, and sequences without gaps, over several rounds."""
    df = odd.unionByName(odd).unionByName(odd.where("doc_id <> 6")).withColumn("piece", F.lit("clash"))
    rows = packing.pack(df, limit=64, block=20).collect()
    enc = packing.ids_of("byte_bpe_50k.json").slow
    want, got, by_seq = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in df.collect():
        n = len(enc.encode(r.text or "", add_special_tokens=False).ids) + 1
        for k in range(-(-n // 64)):
            want[r.doc_id, k] += 1
    for r in rows:
        got[r.doc_id, r.piece] += 1
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for own in by_seq.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 64


def test_two_for_one_in_any_bin():
    """The only exchange that helps is in the least full bin of many."""
    lengths = np.array([81] * 5 + [29, 29, 20] + [60])
    bins = [[0], [1], [2], [3], [4], [5, 6, 7], [8]]
    out = packing.improve([list(b) for b in bins], lengths, 100)
    assert sorted(i for b in out for i in b) == list(range(9)) and max(lengths[b].sum() for b in out) <= 100
    fills = lambda own: sum(int(lengths[b].sum()) ** 2 for b in own)
    assert fills(out) > fills(bins)


def test_steps_by_brute_force():
    """The step taken is the best of all moves, and else of all exchanges one for one and two for one."""
    rng = random.Random(3)
    for _ in range(400):
        limit = 60
        lengths, bins = [], []
        for _ in range(rng.randrange(2, 7)):
            own = []
            while (n := rng.randrange(1, 25)) + sum(lengths[k] for k in own) < limit and len(own) < 5:
                own.append(len(lengths))
                lengths.append(n)
            bins.append(own)
        lengths = np.array(lengths + [0])
        fills = np.array([int(lengths[b].sum()) for b in bins])
        b = int(np.argmin(np.where(fills > 0, fills, 99)))
        others = np.array([k for k in range(len(bins)) if k != b and fills[k] > 0], dtype=np.int64)
        for i in bins[b]:
            x, gains = int(lengths[i]), {}
            for o in others.tolist():
                for back in [()] + [(j,) for j in bins[o]] + [(j, k) for j in bins[o] for k in bins[o] if j < k]:
                    d = x - int(lengths[list(back)].sum()) if back else x
                    if d > 0 and fills[o] + d <= limit and fills[o] + d > fills[b]:
                        gains[o, back] = d * (int(fills[o]) - int(fills[b]) + d)
            got = packing._step(i, b, bins, fills, lengths, limit, others)
            moves = [o for o in others.tolist() if fills[o] + x <= limit]
            if moves:
                assert got[1] == [] and fills[got[0]] == max(fills[moves])
            elif not gains:
                assert got is None
            else:
                assert gains[got[0], tuple(sorted(got[1]))] == max(gains.values())


def test_special_strings_and_extreme_texts():
    enc = packing.ids_of("byte_bpe_50k.json")
    for t in ("a<|endoftext|>b", " " * 200000, "x" * 50000, "é \x00 '", "don't  do\n\n it"):
        assert list(enc(t)) == enc.slow.encode(t, add_special_tokens=False).ids


def test_local_search_empties_bins():
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = rng.integers(200, 900, 120)
        bins = [[i] for i in range(len(lengths))]  # a bad start, which the search has to mend
        out = packing.improve(bins, lengths, 2048)
        assert sorted(i for b in out for i in b) == list(range(len(lengths)))
        assert max(lengths[b].sum() for b in out) <= 2048
        assert len(out) <= -(-lengths.sum() // 2048) + 2


def test_exchanges():
    lengths = np.array([6, 3, 5, 4, 2, 3])
    out = packing.improve([[0, 1], [2, 3], [4, 5]], lengths, 10)
    assert sorted(int(lengths[b].sum()) for b in out)[-1] <= 10 and sum(len(b) for b in out) == 6


def test_mixing(odd, spark, sf):
    rows = mixing.mix(odd).collect()
    sizes = {i: len((t or "").split()) for i, t, *_ in ODD if i != 7}
    assert all(r["size"] == sizes[r.doc_id] for r in rows if r.doc_id != 7)
    assert all(r.taken <= 3 * r["size"] for r in rows)
    big = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"), block=7).collect()
    taken, target = defaultdict(int), {}
    for r in big:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken)
    pos = [r.position for r in big if r.position is not None]
    assert pos == sorted(pos) and 0 <= pos[0] and pos[-1] <= 1
    early = [r for r in big if r.position is not None and r.position < 0.5]
    weight5 = lambda rs: sum(r.taken for r in rs if r.source in ("src0",)) / sum(r.taken for r in rs)
    assert weight5(early) > weight5([r for r in big if r.position is not None and r.position >= 0.5])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in big if r["size"])


def test_rows_with_shared_ids_are_mixed_one_by_one(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, None, 7]), rng.choice(["a b c", "a b c", "d e", "f " * 40, "", None]), rng.choice(["a", "b", "c", None])) for _ in range(120)]
    df = spark.createDataFrame([(*r, k, 1) for k, r in enumerate(rows)], "doc_id long, text string, source string, row int, own int")
    plan = mixing.mix(df).collect()
    out = mixing.mixed(df).collect()
    want, got = defaultdict(int), defaultdict(int)
    for r in plan:
        want[r.doc_id, r.source, r["size"]] += r.copies if r["size"] else 0
    for r in out:
        got[r.doc_id, r.source, len((r.text or "").split())] += 1
    assert dict(got) == {k: v for k, v in want.items() if v}
    assert max(sum(1 for r in out if r.row == k) for k in range(120)) <= 3


def test_shared_ids_in_two_sources(spark):
    """A source of much text, of which one copy each is taken, and one whose rows are taken three times."""
    rows = [(i, "w " * 50, "a") for i in range(3)] + [(i, "x y", "b") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {(r.doc_id, r.source): r.copies for r in mixing.mix(df).collect()}
    got = defaultdict(int)
    for r in mixing.mixed(df).collect():
        got[r.doc_id, r.source] += 1
    assert dict(got) == {k: v for k, v in plan.items() if v} and len(set(plan.values())) > 1


def test_many_sources(spark, monkeypatch):
    """Running sums over ranges of sources agree with those over all of them."""
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 40), f"s{rng.randrange(60):02}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 7)
    assert sorted(map(str, mixing.mix(df).collect())) == one


def test_demand_inverse(spark):
    knots = ((0.0, 0.0), (0.25, 2.0), (0.5, 0.0), (0.75, 0.0), (1.0, 1.0))
    got = [r[0] for r in spark.range(101).select(mixing.demand_inverse(knots, F.col("id") / 100)).collect()]
    t = np.linspace(0, 1, 200001)
    area = np.concatenate([[0], np.cumsum(np.interp((t[1:] + t[:-1]) / 2, *zip(*knots)))])
    area /= area[-1]
    for i, x in enumerate(got):
        assert abs(np.interp(x, t, area) - i / 100) < 1e-4
    with pytest.raises(ValueError):
        mixing.demand_inverse(((0.0, 0.0), (1.0, 0.0)), F.lit(0.5))
