"""Language identification by words first, with backoff to character n-grams.

A known word counts with its log frequency in each language. An unseen word falls back
to its character n-grams (with word ends marked), the longest length first; the first
length of which some n-gram is known decides, with the mean log frequency of those.

The model is fitted on about TRAIN_DOCS labelled documents, taken by a hash of the id,
and whole texts of those. The sample is bounded for each language: the rarest give all
their documents, the others equally many, LEAST_DOCS at least, so every label is learned.
The sample alone bounds the model: each word and n-gram in it is kept, with the languages it
was seen in. If these entries are more than ENTRIES (about 20 bytes each), which is
counted before any of them leaves the executors, the sample is halved until they are not.
What a language was not seen to have gets the same share in all of them, however small
their samples are, so it needs no entry. Prediction reads every whole text.

Tables are sorted 64-bit hashes of the items, with sparse rows. Words that come up are kept
at hand as full rows, as far as there is room.

Defined results: null texts and texts without a letter are 'und' with score 0; very long
texts are read whole; of languages with equal scores the first by name is taken; texts of
which nothing is known get the first language by name with score 1 / languages; without
training rows everything is 'und'; an empty table gives no rows; repeated rows repeat;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import saved, small

#: Bounds of the sample, see above.
TRAIN_DOCS, LEAST_DOCS, ENTRIES = 20_000, 100, 3_000_000
LENGTHS = (5, 4, 3, 2, 1)
#: Words after which the score takes a text to be long.
LONG = 20
#: Words that a worker keeps at hand, cells of their table, and cells of rows made at once.
MEMO, MEMO_CELLS, CELLS = 200_000, 4_000_000, 1_000_000
#: Words counted by a task before their counts are handed on.
COUNTED = 1 << 19
LETTERS = re.compile(r"[^\W\d_]+")
HELD_OUT, FOLDS = 2, 4
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def item(text: str, kind: int) -> int:
    """A word (kind 0) or n-gram (kind n) as 64 bits."""
    return xxhash.xxh64_intdigest(text, kind)


def _counted(batches):
    """Partial counts; kind 0 is words, kind n is n-grams of n."""
    counts: dict[str, Counter] = defaultdict(Counter)
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            for kind in (0, *LENGTHS):
                own = words
                if kind:
                    own = Counter()
                    for w, n in words.items():
                        for g in grams(w, kind):
                            own[g] += n
                items = np.fromiter((item(x, kind) for x in own), np.uint64, len(own)).view(np.int64)
                times = np.fromiter(own.values(), np.int64, len(own))
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(own)), pa.repeat(pa.scalar(kind, pa.int32()), len(own)), pa.array(items), pa.array(times)], names=["lang", "kind", "item", "n"])

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = words_of(text.as_py())
            counts[lang].update(words)
            size += len(words)
            if size > COUNTED:
                yield from rows()
                counts, size = defaultdict(Counter), 0
    yield from rows()


class Table:
    """Sorted items, and for each the languages that have it, with by how much its log share is above the least."""

    def __init__(self, items: np.ndarray, column: np.ndarray, n: np.ndarray, whole: np.ndarray, kinds: int):
        """Rows (item, language, count) sorted by item; tokens of each language; most different items of one."""
        first = np.flatnonzero(np.append(True, items[1:] != items[:-1])) if len(items) else np.zeros(0, np.int64)
        self.items, self.starts, self.column = items[first], np.append(first, len(items)), column.astype(np.int32)
        least = 0.5 / max([1.0, *whole.tolist()])  # a share, so that small samples do not favour what they lack
        self.base = float(np.log(least / (1 + least * kinds)))
        self.above = np.log1p(n / np.maximum(whole[column], 1) / least).astype(np.float32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each item, or -1."""
        if not len(self.items):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.items, hashes), len(self.items) - 1)
        return np.where(self.items[at] == hashes, at, -1)

    def rows(self, at: np.ndarray, languages: int) -> np.ndarray:
        """Log shares in all languages."""
        out = np.full((len(at), languages), self.base)
        some = self.starts[at + 1] - self.starts[at]
        entry = np.arange(some.sum()) + np.repeat(self.starts[at] - (np.cumsum(some) - some), some)
        out[np.repeat(np.arange(len(at)), some), self.column[entry]] += self.above[entry]
        return out


class Model:
    """Log frequencies of items in each language, and the texts' languages by them."""

    def __init__(self, langs: list[str], tables: dict[int, Table]):
        """tables: of words (0) and of n-grams of each length."""
        self.langs, self.tables, self.at = langs, tables, None

    def __getstate__(self):
        return {"langs": self.langs, "tables": self.tables, "at": None}

    def prepare(self) -> None:
        wide = max(1, len(self.langs))
        self.memo = np.zeros((min(MEMO, max(1000, MEMO_CELLS // wide)), wide))
        self.batch = max(100, CELLS // wide // 8)
        self.at, self.used = {}, 0

    def made(self, words: list[str]) -> np.ndarray:
        """A row for each word: its own, or the mean of its known n-grams of the longest length that has any, or NaN."""
        wide = len(self.langs)
        out = np.full((len(words), wide), np.nan)
        at = self.tables[0].find(np.array([item(w, 0) for w in words], np.uint64))
        known = np.flatnonzero(at >= 0)
        out[known] = self.tables[0].rows(at[known], wide)
        left = np.flatnonzero(at < 0)
        for n in LENGTHS:
            if not len(left):
                break
            parts = [[item(g, n) for g in grams(words[i], n)] for i in left.tolist()]
            owner = np.repeat(np.arange(len(left)), [len(p) for p in parts])
            at = self.tables[n].find(np.array([g for p in parts for g in p], np.uint64))
            owner, at = owner[at >= 0], at[at >= 0]
            if len(at):
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                sums = np.zeros((len(first), wide))
                edges = np.append(first, len(at)).tolist()
                for a in range(0, len(first), self.batch):  # some words at once, so that their n-grams' rows stay few
                    b = min(a + self.batch, len(first))
                    rows = self.tables[n].rows(at[edges[a] : edges[b]], wide)
                    sums[a:b] = np.add.reduceat(rows, first[a:b] - first[a], axis=0)
                out[left[owner[first]]] = sums / np.diff(np.append(first, len(at)))[:, None]
                left = np.delete(left, owner[first])
        return out

    def kept(self, words: list[str]) -> np.ndarray:
        """Rows of words that are not at hand; they are then, those of before being forgotten if there is no room."""
        out = self.made(words)
        if self.used + len(words) > len(self.memo):
            self.at, self.used = {}, 0
        keep = words[: len(self.memo) - self.used]
        self.memo[self.used : self.used + len(keep)] = out[: len(keep)]
        self.at.update(zip(keep, range(self.used, self.used + len(keep)), strict=True))
        self.used += len(keep)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        if self.at is None:
            self.prepare()
        counts = Counter(words_of(text or ""))
        if not self.langs or not any(c.isalpha() for w in counts for c in w):
            return UNKNOWN, 0.0
        n = len(counts)
        rows = np.fromiter(map(self.at.get, counts, repeat(-1)), np.int64, n)
        times = np.fromiter(counts.values(), np.float64, n)
        weight, total = 0.0, np.zeros(len(self.langs))

        def add(vectors: np.ndarray, times: np.ndarray) -> None:
            nonlocal weight, total
            on = ~np.isnan(vectors[:, 0])
            weight += times[on].sum()
            total = total + times[on] @ vectors[on]

        new = np.flatnonzero(rows < 0)
        if len(new) < n:
            old = rows >= 0
            add(self.memo[rows[old]], times[old])
        if len(new):
            words = list(counts)
            for k in range(0, len(new), self.batch):
                some = new[k : k + self.batch]
                add(self.kept([words[i] for i in some.tolist()]), times[some])
        if not weight:
            return self.langs[0], 1 / len(self.langs)
        mean = total / weight * min(weight, LONG)
        p = np.exp(mean - mean.max())
        best = int(np.argmax(p))
        return self.langs[best], float(p[best] / p.sum())


def quota(sizes: list[int], most: int, least: int = LEAST_DOCS) -> int:
    """The most documents of a language, so that about `most` are taken of all, or `least` of each."""
    left, own = most, 0
    for k, n in enumerate(sorted(sizes)):
        own = left // (len(sizes) - k)
        if n > own:
            return max(own, least)
        left -= n
    return max([own, least, *sizes])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", most_docs: int = TRAIN_DOCS, most_entries: int = ENTRIES) -> Model:
    """Fit on the labelled rows of docs. What reaches the driver is bounded by most_entries, and a few numbers for each label."""
    labelled = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    place = F.pmod(F.xxhash64("i"), F.lit(1 << 40))
    sizes = saved(labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")))
    most, least = quota([r["n"] for r in sizes.select("n").collect()], most_docs), 1
    while True:
        share = sizes.select("l", F.when(F.col("n") > most, F.greatest(F.col("first") + 1, F.floor(F.lit(float(1 << 40)) * most / F.col("n")))).alias("end"))
        sample = labelled.join(small(share), "l").where(F.col("end").isNull() | (place < F.col("end")))
        counts = sample.select("t", "l").mapInArrow(_counted, "lang string, kind int, item long, n long")
        counts = saved(counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")))
        entries = counts.count()
        if entries <= most_entries or most <= least:
            break
        most //= 2
    sums = counts.groupBy("lang", "kind").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("different"))
    totals = {(r["lang"], r["kind"]): (r["all"], r["different"]) for r in sums.collect()}
    langs = sorted({r["l"] for r in sizes.select("l").collect()})
    numbers = docs.sparkSession.createDataFrame(list(enumerate(langs)), "number int, lang string")
    rows = counts.join(small(saved(numbers)), "lang").select("kind", "item", "number", "n").toArrow()
    kind, items, column, n = (rows[c].to_numpy() for c in rows.column_names)
    items = items.astype(np.int64).view(np.uint64)
    order = np.lexsort((column, items, kind))
    kind, items, column, n = kind[order], items[order], column[order], n[order]
    tables = {}
    for k in (0, *LENGTHS):
        own = slice(*np.searchsorted(kind, [k, k + 1]))
        of = [totals.get((name, k), (0, 0)) for name in langs]
        tables[k] = Table(items[own], column[own], n[own], np.array([x[0] for x in of], dtype=float), max([1, *(x[1] for x in of)]))
    return Model(langs, tables)


def predicted(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """text and the columns `keep` of docs, with lang_pred and score. Only the text is an input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    first = docs.select("text", *keep)

    def run(batches):
        own = shared.value
        for batch in batches:
            out = [own.predict(t.as_py()) for t in batch.column(0)]
            names, scores = zip(*out, strict=True) if out else ((), ())
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["text", *keep, "lang_pred", "score"])

    return first.mapInArrow(run, first.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema)


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs(doc_id, text, lang)."""
    model = train(docs.where(~held_out(F.col("doc_id"))), **bounds)
    out = predicted(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, **bounds) -> DataFrame:
    """The documents that have a language, with their columns as they are: null texts and texts without letters go."""
    model = train(docs.where(~held_out(F.col("doc_id"))), **bounds)
    others = {c: f"c{i}" for i, c in enumerate(c for c in docs.columns if c != "text")}
    renamed = docs.select("text", *[F.col(f"`{c}`").alias(k) for c, k in others.items()])
    kept = predicted(renamed, model, list(others.values())).where(F.col("lang_pred") != UNKNOWN)
    return kept.select(*[F.col(others.get(c, "text")).alias(c) for c in docs.columns])
