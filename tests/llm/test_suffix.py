"""Removal of repeated byte strings against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quillon.llm import queries, suffix_dedup as sd
from tests.llm.test_first import ODD, SCHEMA


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(docs):
    """doc_id and text rows to (doc_id, n_bytes, n_removed, n_spans, sha) by looking up every string of 100 bytes."""
    def place(row):
        data = (row[1] or "").encode()
        return (row[0] is None, row[0] or 0, signed(xxhash.xxh64_intdigest(data, 42))), data

    seen, out, done = set(), {}, {}
    for k, data in sorted((place(r) for r in docs), key=lambda x: x[0]):
        if (k, data) in done:
            continue
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            s = hashlib.md5(data[i : i + 100]).digest()
            if s in seen:
                gone[i : i + 100] = True
            seen.add(s)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])) == 1))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        done[k, data] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((r[0], *done[place(r)]) for r in docs), key=repr)


def local(docs, bits=16, split=256, buckets=8, batch=50):
    """The operator's tasks without Spark."""
    rows = []
    for i, t in docs:
        data = (t or "").encode()
        rows.append((sd.LAST if i is None else i, signed(xxhash.xxh64_intdigest(data, 42)), t or ""))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + batch]), (pa.int64(), pa.int64(), pa.string()))], names=["key", "mark", "text"]) for k in range(0, len(rows), batch)]
    marks = [np.zeros((1 << bits - less) // 8, np.uint8) for less in sd.FEWER]
    tables = defaultdict(list)
    for b in batches:
        for r in sd._pairs(buckets)(iter([b])):
            for x in r.to_pylist():
                tables[x["bucket"]].append(x)
    pieces = defaultdict(list)
    for own in tables.values():
        for r in sd._marker(bits, split)(pa.Table.from_pylist(own)).to_pylist():
            pieces[r["which"], r["base"] // sd.PIECE].append(r)
    for own in pieces.values():
        for r in sd._whole_piece(pa.Table.from_pylist(own)).to_pylist():
            piece = np.frombuffer(r["bits"], np.uint8)
            marks[r["which"]][r["base"] : r["base"] + len(piece)] |= piece

    class Shared:
        value = marks

    tables = defaultdict(list)
    for b in batches:
        for r in sd._dealer(buckets, Shared)(iter([b])):
            for x in r.to_pylist():
                tables[x["bucket"]].append(x)
    spans = defaultdict(list)
    schema = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary()), ("bytes", pa.binary())])
    for own in tables.values():
        for x in sd._judge(pa.Table.from_pylist(own, schema)).to_pylist():
            spans[x["key"], x["mark"]].append(x["span"])
    out = []
    for (i, _), (key, mark, text) in zip(docs, rows):
        b = pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([text]), pa.array([spans.get((key, mark))], pa.list_(pa.int64()))], names=["a", "b", "c"])
        out += [tuple(r.values()) for x in sd._cut_out(iter([b])) for r in x.to_pylist()]
    return sorted(out, key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(15, 60))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            kind = rng.random()
            if kind < 0.5:
                p = rng.choice(passages)
                a = rng.randrange(len(p))
                parts.append(p[a:] if kind < 0.25 else p)
            elif kind < 0.6:
                parts.append(rng.choice(["ab", "x", "abc "]) * rng.randrange(20, 200))
            else:
                parts.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))))
        text = " ".join(parts)
        if docs and rng.random() < 0.3:  # a near copy
            text = rng.choice(docs)[1] or ""
            if text and rng.random() < 0.7:
                k = rng.randrange(len(text))
                text = text[:k] + rng.choice(["", "Q", "zz"]) + text[k + rng.randrange(3) :]
        docs.append((i * 7 % 1009, text))
    return docs


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("split", [256, 3])
def test_tasks_match_brute_force(seed, split):
    docs = corpus(seed)
    assert local(docs, split=split) == brute(docs)


def test_long_documents(monkeypatch):
    monkeypatch.setattr(sd, "SEGMENT", 700)
    monkeypatch.setattr(sd, "TOGETHER", 3000)
    docs = corpus(9, 40) + [(2000 + i, " ".join(t for _, t in corpus(i, 25))) for i in range(3)]
    assert local(docs) == brute(docs)


@pytest.mark.parametrize("piece", [1, 48, 4096])
def test_bitmaps_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(sd, "PIECE", piece)
    docs = corpus(21)
    assert local(docs, split=5) == brute(docs)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """With eight hashes for all windows of crowded grams the result is the same, since their bytes decide."""
    docs, plain = corpus(3), sd._windows

    def weak(c, part):
        gram, hashes, *rest = plain(c, part)
        return gram, hashes & np.uint64(7), *rest

    monkeypatch.setattr(sd, "_windows", weak)
    assert local(docs, split=2) == brute(docs)


@pytest.mark.parametrize("slice_", [1, 7, 1 << 20])
def test_equal_windows(slice_):
    rng = np.random.default_rng(8)
    kinds = [bytes([65 + k // 3]) * (10 * (k % 3) + 40) + bytes([97 + k]) * 1 + b"z" * (59 - 10 * (k % 3)) for k in range(12)]
    pick = rng.integers(0, len(kinds), 300)
    hashes = (pick % 4).astype(np.uint64)
    row, head = sd.equal_windows(hashes, b"".join(kinds[k] for k in pick), slice_)
    firsts = {}
    want = {(i, firsts[k]) for i, k in enumerate(pick.tolist()) if firsts.setdefault(k, i) != i}
    assert set(zip(row.tolist(), head.tolist(), strict=True)) == want
    assert not len(sd.equal_windows(hashes[:0], b"", slice_)[0])


def test_regions_of_one_hash_are_told_apart():
    texts = [b"a", b"b", b"a", b"b", b"a"]
    one = np.zeros(5, np.uint64)
    order, lead, again = sd._firsts(one, one, np.arange(5), text=texts.__getitem__)
    assert order.tolist() == [0, 1, 2, 3, 4] and lead.tolist() == [True, True, False, True, False] and again.tolist() == [False, False, True, False, True]


def test_many_regions_of_a_gram():
    """More regions of one gram than were ever compared in pairs, which agree to all depths on both sides."""
    rng = random.Random(4)
    gram = "The passage that many share: "
    near_ = ["".join(rng.choice("ab") for _ in range(90)) for _ in range(12)]
    docs = []
    for i in range(2500):
        a, b = rng.choice(near_), rng.choice(near_)
        x, y = rng.randrange(91), rng.randrange(91)
        docs.append((i, "".join(rng.choice("abc") for _ in range(x)) + a[x:] + gram + b[:y] + "".join(rng.choice("abc") for _ in range(90 - y))))
    assert local(docs, split=1 << 20, batch=500) == brute(docs)


def test_repeated_windows_by_pairs():
    """Intervals of both orders against a look at every window of every row."""
    rng = random.Random(9)
    for _ in range(60):
        anchors = "".join(rng.choice("xy") for _ in range(sd.GRAM))
        sides = ["".join(rng.choice("ab") for _ in range(80)) for _ in range(3)]
        group, regions, offset, count = [], [], [], []
        for g in range(rng.randrange(1, 5)):
            for _ in range(rng.randrange(1, 12)):
                before = rng.randrange(0, 77)  # bytes before the anchor in the first window
                n = rng.randrange(1, before + 2)
                whole = rng.choice(sides)[80 - before :] + anchors + rng.choice(sides)
                regions.append(whole[: sd.MIN + n - 1].encode())
                group.append(g), offset.append(before), count.append(n)
        got = {(r, k) for r, a, b in zip(*(x.tolist() for x in sd.repeated_windows(np.array(group), regions, np.array(offset), np.array(count)))) for k in range(a, b + 1)}
        seen, want = set(), set()
        for r, (g, own, o, n) in enumerate(zip(group, regions, offset, count)):
            new = set()
            for k in range(n):
                w = (g, o - k, own[k : k + sd.MIN])
                if w in seen:
                    want.add((r, k))
                new.add(w)
            seen |= new
        assert got == want


def test_buckets_are_even():
    data = " ".join(t for _, t in corpus(3, 400)).encode()
    gram = sd.anchor_runs(data, np.array([0]), np.array([len(data)]))[4]
    counts = np.bincount(sd.bucket_of(np.unique(gram), 8), minlength=8)
    assert counts.max() < 1.5 * counts.mean()


def test_deep_shallow_order():
    rng = random.Random(1)
    rows = [bytes(rng.choice(b"ab") for _ in range(rng.choice([3, 20, 60]))) for _ in range(60)]
    rows = [rng.choice(rows)[:40] + rng.choice(rows) for _ in range(500)]
    m, group = sd._padded(rows), np.sort(np.array([rng.randrange(6) for _ in rows]))
    order = sd.deep_shallow(m, group)
    got = [(group[i], m[i].tobytes()) for i in order]
    assert got == sorted(got) and sorted(order.tolist()) == list(range(500))
    lcp = sd.neighbour_lcp(m, order)
    for k in range(1, 500):
        a, b = m[order[k - 1]].tobytes(), m[order[k]].tobytes()
        assert lcp[k] == next((i for i in range(len(a)) if a[i] != b[i]), len(a))


def run(df, **options):
    return sorted((tuple(r) for r in sd.remove_repeats(df, **options).collect()), key=repr)


def test_odd_rows(spark):
    docs = [(r[0], r[1]) for r in ODD] + [(None, "lost" * 60), (20, "lost" * 60), (None, "lost" * 60), (6, "other text " * 20)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, key string, span int")
    assert run(df) == brute(docs)
    assert run(spark.createDataFrame([], SCHEMA)) == []


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op6_suffix_array_dedup"](spark, sf).collect()), key=repr) == brute(docs)


def test_split_grams(spark):
    docs = corpus(11, 300)
    assert run(spark.createDataFrame(docs, "doc_id long, text string"), split=5, bits=18) == brute(docs)
