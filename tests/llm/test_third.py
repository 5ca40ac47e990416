"""URL filters, vector codes and fill-in-middle."""

import bisect
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon import plans
from quillon.llm import fill_in_middle, queries, url_filter, vector_codes
from quillon.llm.url_filter import Leaf, Rule
from tests.oracle import assert_same

# --- fill-in-middle

TEXTS = ["", None, "one", "a\nb\nc\n", "\n", "\n\n\n", "no end\nof line", "é\n😀 x\n" * 50, "has <S> in it\n", "<<P", "x <\ny <S\nz", "a\r\nb\r\n", "long line " * 20000, "w\n" * 50000]


def brute_fim(doc_id, text, seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    ids = [*range(len(TEXTS) * 6), None, 3]
    rows = [(i, TEXTS[(i or 0) % len(TEXTS)], "x", 1) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    out = fill_in_middle.fill_in_middle(docs).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form")))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted(((i, *brute_fim(i, t), t or "") for i, t, _, _ in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_options(spark):
    docs = spark.createDataFrame([(i, f"some words {i} \t and\nmore  {'x' * i}") for i in range(400)], "doc_id int, text string")
    marks = ("[pre]", "{suf}", "~mid|")
    for unit, find in (("word", r"\s+(?=\S|$)|\S+\s*"), ("character", r"(?s).")):
        out = fill_in_middle.fill_in_middle(docs, seed=1, unit=unit, rate=70, spm=20, marks=marks)
        got = out.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"), marks)).collect()
        texts = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.back == texts[r.doc_id] and r.n == len(re.findall(find, r.back)) for r in got)
        share = Counter(r.form for r in got)
        assert 80 < share["plain"] < 160 and 30 < share["spm"] < 90 < share["psm"]
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle.fill_in_middle(docs, unit="page")
    with pytest.raises(ValueError):
        fill_in_middle.fill_in_middle(docs, marks=("<P>", "<P>", "<M>"))


def test_units_end_between_classes():
    at = lambda text, unit: fill_in_middle.bounds(np.frombuffer(text.encode("utf-32-le"), "<u4"), unit).tolist()
    assert at("", "line") == [0] and at("a", "line") == [0, 1] and at("a\n", "line") == [0, 2] and at("\n\nb", "line") == [0, 1, 2, 3]
    assert at("ab  c\td", "word") == [0, 4, 6, 7] and at("😀é", "character") == [0, 1, 2]


def test_large_batches_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "BATCH", 100)
    docs = spark.createDataFrame([(i, "ab\n" * i) for i in range(60)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n for r in fill_in_middle.fill_in_middle(docs).collect()}
    assert got == {i: i for i in range(60)}


# --- vector codes


def brute_codes(rows, rounds=4, entries=256):
    """rows (vec_id, vector, label) in order of id; codes, errors and codebooks by comparing everything."""
    whole = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(whole[0][1]) // 4
    part = lambda v, p: v[p * w : p * w + w]
    books = [[part(v, p) for _, v, _ in whole[:entries]] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            own = [part(v, p) for _, v, _ in whole]
            at = [near(x, books[p])[1] for x in own]
            for e in range(len(books[p])):
                mine = [x for x, k in zip(own, at, strict=True) if k == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = {i: [near(part(v, p), books[p]) for p in range(4)] for i, v, _ in whole}
    errors, sums = {i: sum(d for d, _ in f) for i, f in found.items()}, Counter()
    for i, _, lab in whole:
        sums[lab] += errors[i]
    digest = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    return {(i, "".join(f"{e:02x}" for _, e in found[i]), errors[i], sums[lab], digest) for i, _, lab in whole}


VECTORS = "vec_id long, embedding array<float>, label int, code string, n int"


def coded(spark, rows, **options):
    df = spark.createDataFrame([(i, v, lab, "q", 1) for i, v, lab in rows], VECTORS)
    codes, books = vector_codes.compress(df, **options)
    return vector_codes.with_label_errors(codes), books


@pytest.mark.parametrize("width,count,spread", [(8, 400, 0.02), (16, 300, 1.0), (4, 40, 0.003), (20, 320, 100.0)])
def test_vector_codes_by_brute_force(spark, width, count, spread):
    rng = np.random.default_rng(width)
    middles = rng.normal(0, spread, (9, width))
    rows = [(7 * i - 50, (middles[i % 9] + rng.normal(0, spread / 3, width)).astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i in range(count)]
    rows += [(5000 + i, rows[i % count][1], 1) for i in range(60)]  # repeated vectors
    rows += [(-900, None, 1), (-901, [float("nan")] + [0.0] * (width - 1), 1), (9001, [None] + [0.0] * (width - 1), None), (9002, [float("-inf")] * width, 2)]
    got, books = coded(spark, rows)
    want = brute_codes(sorted(rows, key=lambda r: r[0]))
    assert {(*r, vector_codes.digest(books)) for r in got.select("vec_id", "code", "error", "label_error").collect()} == want


def test_vector_codes_query(spark, sf):
    assert_same(queries.op12_vector_codes(spark, sf), sf, queries.ORACLES["op12_vector_codes"])


def test_odd_vectors(spark):
    fine = [(i, [i / 8.0, 1.0, 2.0, -1.0], 1) for i in range(3)]
    odd = [(10, [1.0, 2.0, 3.0], 1), (11, [], 2), (12, [0.0] * 8, 2), (13, [1e30, 0.0, 0.0, 0.0], 1), (None, [0.5, 1.0, 2.0, -1.0], None), (None, [0.5, 1.0, 2.0, -1.0], None)]
    got, books = coded(spark, odd + fine)
    out = {r.vec_id: (r.code, r.error, r.label_error) for r in got.collect()}
    assert out[0] == ("00000000", 0, 0) and out[1][0] == "01000000" and [out[i] for i in (10, 13)] == [(None, None, 0)] * 2 and out[11] == out[12] == (None, None, None)
    assert got.count() == 9 and out[None][1] == 0 and books[0].shape == (5, 1)
    assert [r.decoded for r in vector_codes.decoded(got, books).where("vec_id = 2").collect()] == [[256, 1024, 2048, -1024]]
    for rows in ([], [(1, None, 1)]):
        assert coded(spark, rows)[0].count() == 0
    none, books = coded(spark, [(1, [1.0], 4)])
    assert [tuple(r) for r in none.select("vec_id", "code", "error").collect()] == [(1, None, None)] and books == []


def test_bounds_leave_few_exact_distances():
    """Bounds never lose the nearest entry, and spare most distances where entries differ."""
    rng = np.random.default_rng(5)
    for scale, least_spared in ((3, 0.0), (900, 0.5)):
        middles = rng.integers(-scale, scale + 1, (256, 16)) + rng.integers(-9 * scale, 9 * scale, (256, 1))
        x = middles[rng.integers(0, 256, 2000)] + rng.integers(-2, 3, (2000, 16))
        entry, error, exact = vector_codes.Codebook(middles).nearest(x)
        every = ((x[:, None] - middles[None]) ** 2).sum(axis=2)
        assert (error == every.min(axis=1)).all() and (entry == every.argmin(axis=1)).all()
        assert exact <= (1 - least_spared) * every.size + 3 * len(x)


def test_large_components_stay_exact():
    most = vector_codes.limit(64) - 1
    rng = np.random.default_rng(6)
    entries = rng.integers(-most, most, (256, 16))
    x = np.concatenate([entries[::-1] + rng.integers(-1, 2, (256, 16)).clip(-1, 1), np.full((1, 16), most), np.full((1, 16), -most)])
    x = x.clip(-most, most)
    entry, error, _ = vector_codes.Codebook(entries).nearest(x)
    for i in range(len(x)):
        every = [sum((int(a) - int(b)) ** 2 for a, b in zip(x[i], y, strict=True)) for y in entries]
        assert error[i] == min(every) and entry[i] == every.index(min(every))


# --- URL filters

URLS = [
    "http://a.example.net/en/1?x=1&y=2#top", "https://x.net/", "https://x.net", "https://net/abc", "HTTP://Shop.EXAMPLE.com/de/1", "https://example.com/de", "http://w.org/fr/9.html", "http://xorg/fr/", "http://w.org?next=/fr/",
    "http://w.org#/fr/", "no scheme.net/en/", "", None, "://", "http://", "http://a.net:80/x", "http://ÄB.net/é/ü?q=%20", "https://b.example.net/en/", "a://b://c.net/", "http://w.org//fr/", "http://notexample.com/de/7", "http://x.net/" + "a" * 100_000,
]


def plain_parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(host, path, rules=url_filter.RULES):
    best = None
    for r in rules:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(str(r)) > len(str(best))):
            best = r
    return best


def plain_lexical(url):
    url = url or ""
    host, path = plain_parts(url)
    query = url.split("#", 1)[0].partition("?")[2]
    counts = Counter(url).values()
    entropy = round(math.log2(len(url)) - sum(c * math.log2(c) for c in counts) / len(url), 6) if url else 0.0
    digits = sum(c in "0123456789" for c in url)
    pieces = lambda text, marks: len([p for p in re.split(marks, text) if p])
    return [len(url), len(host), len(path), pieces(host, "[.]"), pieces(path, "/"), digits / max(1, len(url)), entropy, pieces(query, "[&;]"), len(query), host.count("-")]


def plain_trees(urls, learnt):
    """Chances of block of `urls` from trees fitted on learnt (url, y), all of it; the operator's definition in plain code."""
    suffix = lambda u: plain_parts(u)[0].rpartition(".")[2]
    fold = lambda u: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest((u or "").encode(), seed=xxhash.xxh64_intdigest(b"fold", seed=42))) % url_filter.FOLDS
    rows, n, b = Counter(suffix(u) for u in urls), Counter(), Counter()
    for u, y in learnt:
        n[suffix(u), fold(u)] += 1
        b[suffix(u), fold(u)] += y
    folds = range(url_filter.FOLDS)
    prior = sum(b.values()) / sum(n.values())

    def features(u, without=None):
        s = suffix(u)
        share = lambda c: sum(c[s, k] for k in folds if k != without)
        return [*map(float, plain_lexical(u)), round(math.log2(rows[s] + 1), 6), (share(b) + 10 * prior) / (share(n) + 10)]

    weights = Counter(learnt)
    sample = [(features(u, fold(u)), y, w) for (u, y), w in weights.items()]
    limits = []
    for f in range(len(url_filter.FEATURES)):
        values = sorted(x[f] for x, _, _ in sample)
        at = [(len(values) - 1) * k / 32 for k in range(1, 32)]
        limits.append(sorted({values[math.floor(p)] if p == math.floor(p) else (math.ceil(p) - p) * values[math.floor(p)] + (p - math.floor(p)) * values[math.ceil(p)] for p in at}))
    bins = [[bisect.bisect_left(limits[f], v) for f, v in enumerate(x)] for x, _, _ in sample]
    base = math.log((sum(b.values()) + 0.5) / (sum(n.values()) - sum(b.values()) + 0.5))
    score, trees = [base] * len(sample), []
    for _ in range(url_filter.TREES):
        chance = [1 / (1 + math.exp(-s)) for s in score]
        half_up = lambda v: math.copysign(math.floor(abs(v) + 0.5), v)
        g = [half_up((y - p) * w * url_filter.UNIT) for p, (_, y, w) in zip(chance, sample, strict=True)]
        h = [half_up(p * (1 - p) * w * url_filter.UNIT) for p, (_, y, w) in zip(chance, sample, strict=True)]
        worth = lambda rows: (sum(g[i] for i in rows) / url_filter.UNIT) ** 2 / (sum(h[i] for i in rows) / url_filter.UNIT + 1)

        def node(rows, depth):
            best, found = worth(rows) + 1e-6, None
            for f in range(len(limits)) if depth else ():
                for t in sorted({bins[i][f] for i in rows})[:-1]:
                    left, right = [i for i in rows if bins[i][f] <= t], [i for i in rows if bins[i][f] > t]
                    if worth(left) + worth(right) > best:
                        best, found = worth(left) + worth(right), (f, t, left, right)
            if found:
                return *found[:2], node(found[2], depth - 1), node(found[3], depth - 1)
            for i in rows:
                score[i] += leaf(rows)
            return leaf(rows)

        leaf = lambda rows: url_filter.RATE * (sum(g[i] for i in rows) / url_filter.UNIT) / (sum(h[i] for i in rows) / url_filter.UNIT + 1)
        trees.append(node(list(range(len(sample))), url_filter.DEPTH))

    def told(x):
        out = base
        for t in trees:
            while isinstance(t, tuple):
                t = t[2] if x[t[0]] <= limits[t[0]][t[1]] else t[3]
            out += t
        return 1 / (1 + math.exp(-out))

    return {u: told(features(u)) for u in urls}


def made_urls(rng, n):
    hosts = ["a-b.example.net", "x.example.com", "blog.example.org", "m.shop.example.com", "q.net", "deep.a.b.org", "casino-win.example.com"]
    tails = ["", "/", "?page=2&ref=x", "#top", ".html", "?utm_source=feed", "?a=1;b=2;;c=3"]
    return [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(9999)}{rng.choice(tails)}" for _ in range(n)]


def test_trees_by_brute_force(spark):
    rng = random.Random(3)
    urls = URLS + made_urls(rng, 260)
    urls += rng.choices(urls, k=40)  # repeated rows
    pages = spark.createDataFrame([(i, u, "h", "allow", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string, n int")
    got = url_filter.judge(pages).collect()
    assert sorted(r.page_id for r in got) == list(range(len(urls)))
    ruled = {u: plain_rule(*plain_parts(u)) for u in urls}
    want = plain_trees(urls, [(u or "", int(ruled[u].verdict == "block")) for u in urls if ruled[u]])
    for r in got:
        host, path = plain_parts(r.url)
        rule = ruled[r.url]
        assert (r.host, r.path, r.rule) == (host, path, str(rule) if rule else None), r.url
        assert abs(r.score - want[r.url]) < 1e-9
        assert r.verdict == (rule.verdict if rule else "block" if r.score > 0.5 else "allow")


def test_trees_learn_what_urls_look_like(spark):
    """Blocked are long hosts with hyphens and many digits; held-out ones are told from the others."""
    rng = random.Random(8)
    good = [f"https://{rng.choice(['news', 'shop', 'wiki'])}.site{rng.randrange(50)}.{rng.choice(['com', 'org', 'top'])}/{rng.choice(['a', 'about', 'post'])}/{rng.randrange(99)}" for _ in range(1500)]
    bad = [f"http://win-{rng.randrange(10**6)}-big-{rng.randrange(10**6)}.{rng.choice(['com', 'top', 'top'])}/x{rng.randrange(10**9)}?id={rng.randrange(10**9)}&r=1" for _ in range(1500)]
    cut = 1000
    labelled = spark.createDataFrame([(u, False) for u in good[:cut]] + [(u, True) for u in bad[:cut]] + [(None, None)], "url string, block boolean")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(good[cut:] + bad[cut:])], "page_id long, url string")
    got = url_filter.judge(pages, rules=(), labelled=labelled, train_rows=600).collect()
    right = sum((r.verdict == "block") == (r.page_id >= 500) for r in got)
    assert right >= 0.99 * len(got) and all(r.rule is None for r in got)


def test_few_labels(spark):
    pages = lambda urls: spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    assert url_filter.judge(pages([])).count() == 0
    assert [r.verdict for r in url_filter.judge(pages(["http://x.com/", None])).collect()] == ["allow", "allow"]
    assert {r.verdict for r in url_filter.judge(pages(["http://x.net/", "http://y.net/", "http://q.com/"])).collect()} == {"block"}


def test_hot_suffixes_join_alike(spark, monkeypatch):
    urls = made_urls(random.Random(1), 300) + ["http://only.here/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    want = sorted(url_filter.judge(pages).collect())
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 1)
    monkeypatch.setattr("quillon.llm.common.BROADCAST_ROWS", 1)
    monkeypatch.setattr("quillon.llm.common.HOT_ROWS", 50)
    assert sorted(url_filter.judge(pages).collect()) == want


def test_longest_rule_wins(spark):
    rules = (Rule("block", "b.c", "/"), Rule("allow", "a.b.c", "/"), Rule("block", "a.b.c", "/x/y"), Rule("allow", "c", "/x/y/zz"))
    df = spark.createDataFrame([("http://a.b.c/x/y/zz",), ("http://q.a.b.c/x/y",), ("http://b.c/x",), ("http://a.b.c/",), ("http://xb.c/q",)], "url string")
    host, path = url_filter.host_and_path(F.col("url"))
    got = [tuple(r) for r in df.select(*[c for c in url_filter.matching(host, path, rules)]).collect()]
    assert got == [("a.b.c/x/y", "block"), ("a.b.c/x/y", "block"), ("b.c/", "block"), ("a.b.c/", "allow"), (None, None)]


def test_splits_as_text(spark):
    tree = url_filter.Split(0, 1, Leaf(-1e-7), url_filter.Split(1, 0, Leaf(2.0), Leaf(3.5)))
    model = url_filter.Model(0.5, 0.5, ((1.0, 2.5), (0.125,)), (tree,))
    df = spark.createDataFrame([(2.5, 9.0), (3.0, 0.125), (3.0, 1.0)], "_length double, _host_length double")
    assert [r[0] for r in df.select(model.score("_")).collect()] == [0.5 - 1e-7, 2.5, 4.0]


def test_native_plan(spark, sf):
    plans.require_native(queries.op11_url_filters(spark, sf))
