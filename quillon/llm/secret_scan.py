"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its content. The ledger, a table that only grows,
holds which pairs of a blob and a rule version have been scanned, and what was found. A
scan first joins the ledger with the blobs' addresses. Rules that all blobs have had are
passed over, and no text is read if none is left; rules that no blob has had run on texts
where they are. Only texts whose content occurs twice, or which have had some of the other
rules, move, and of these not the ones that are certain to have had all. Each blob is
scanned once however many paths carry it, and findings are joined back to all paths.

A rule's matches are leftmost and do not overlap. Spans are in code points, end exclusive.

Defined results: null text is the empty blob, without findings; very long texts are scanned
whole, in time that grows with their length and number of matches; ties cannot occur, since
spans of a rule do not overlap; repeated rows repeat their findings; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bitmap, let, matched, saved, text_of, with_maybe


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose given group has fewer characters than `least` are dropped after matching.

    hints: strings of which a text with a match has one, or none.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hints: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules. Matches of access and hex that are too short are left out
# by the pattern, which cannot change the others, since such a match ends with its run.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("=", ":")),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", hints=("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", hints=("-----BEGIN",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyJ",)),
    Rule("url", 1, r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@[A-Za-z0-9.-]{1,255}", hints=("://",)),
)
RULES = BASE + MORE
SPAN = "struct<start:int,rule:int,end:int>"
SPAN_BYTES = 32


LEDGER = f"blob binary, rule string, spans array<{SPAN}>"
#: Numbers that a running sum adds up one by one; then sums of so many, and of those.
RUN = 64


def _sum(values: Column, start: Column, count: Column) -> Column:
    return F.aggregate(F.slice(values, start + 1, count), F.lit(0), lambda a, b: a + b)


def running(sizes: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """body(before), where before(i) is the sum of the first i sizes, in a time that does not grow with i.

    sizes are not empty. Sums of RUN sizes, and of RUN of these, are taken first.
    """

    def folded(values: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda c: _sum(values, c * RUN, F.lit(RUN)))

    def with_tops(own: Column) -> Column:
        some, more = own["some"], own["more"]
        tops = F.transform(F.sequence(F.lit(0), F.size(more) - 1), lambda c: _sum(more, F.lit(0), c))
        return let(tops, lambda top: body(lambda i: before(i, some, top)))

    def before(i: Column, some: Column, top: Column) -> Column:
        of_run, of_top = F.floor(i / RUN).cast("int"), F.floor(i / (RUN * RUN)).cast("int")
        return F.get(top, of_top) + _sum(some, of_top * RUN, of_run % RUN) + _sum(sizes, of_run * RUN, i % RUN)

    return let(folded(sizes), lambda some: let(F.struct(some.alias("some"), folded(some).alias("more")), with_tops))


def spans_of(text: Column, rule: Rule, index: int) -> Column:
    """Array of (start, rule, end): gaps between matches and matches, lengths summed up from the left."""
    pattern = F.lit(rule.pattern)
    hits, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, F.lit(-1))
    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(F.length(g).alias("gap"), F.length(h).alias("len"), F.length(F.regexp_extract(h, rule.pattern, rule.group)).alias("own")))
    empty = F.array().cast(f"array<{SPAN}>")

    def placed(own: Column) -> Column:
        pairs, sizes = own["pairs"], own["sizes"]

        def spans(before: Callable[[Column], Column]) -> Column:
            starts = F.transform(pairs, lambda p, i: F.struct((before(i) + p["gap"]).alias("start"), p["len"].alias("len"), p["own"].alias("own")))
            return F.transform(F.filter(starts, lambda p: p["own"] >= rule.least), lambda p: F.struct(p["start"].alias("start"), F.lit(index).alias("rule"), (p["start"] + p["len"]).alias("end")))

        return running(sizes, spans)

    found = let(pairs, lambda p: let(F.struct(p.alias("pairs"), F.transform(p, lambda x: x["gap"] + x["len"]).alias("sizes")), placed))
    maybe = F.lit(True)
    if rule.hints:
        maybe = F.lit(False)
        for h in rule.hints:
            maybe = maybe | F.contains(text, F.lit(h))
    return F.when(maybe & F.rlike(text, pattern), found).otherwise(empty)


def blobs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_of().alias("t")).withColumn("blob", F.unhex(F.sha2("t", 256)))


def addressed(docs: DataFrame) -> DataFrame:
    """doc_id, blob of every row, saved."""
    return saved(blobs(docs).select("doc_id", "blob"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, bits: int | None = None, paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(paths, entries): doc_id, blob, spans for every row; and the ledger's new rows (blob, rule, spans).

    ledger: earlier entries. Pairs of blob and rule version in it are not scanned again.
    paths: what addressed(docs) gave, if it is there already.
    """
    spark = docs.sparkSession
    paths = addressed(docs) if paths is None else paths
    total = paths.count()
    each = saved(paths.groupBy("blob").agg(F.count(F.lit(1)).alias("n")), total)
    own, places = each.count(), {r.key: i for i, r in enumerate(rules)}
    old = spark.createDataFrame([], LEDGER) if ledger is None else ledger.where(F.col("rule").isin(list(places))).dropDuplicates(["blob", "rule"])
    old = saved(old.join(each, "blob", "left_semi"), total)
    counts = {r["rule"]: r["count"] for r in old.groupBy("rule").count().collect()}
    open_ = [r for r in rules if counts.get(r.key, 0) < own]  # the others have run on every blob
    mixed = [r.key for r in open_ if counts.get(r.key)]

    none = F.array().cast(f"array<{SPAN}>")
    entries = spark.createDataFrame([], LEDGER)
    if open_:
        no_rule = F.array().cast("array<string>")
        known = old.where(F.col("rule").isin(mixed)).groupBy("blob").agg(F.collect_set("rule").alias("known"))
        apart = saved(each.join(known, "blob", "left").where("n > 1 OR known IS NOT NULL").select("blob", F.coalesce("known", no_rule).alias("known")), total)
        marked = with_maybe(blobs(docs).select("blob", "t"), bitmap(apart, "blob", bits), "blob", "maybe")
        once = marked.where("NOT maybe").select("blob", "t", no_rule.alias("known"))
        again = marked.where("maybe").select("blob", "t")
        ready = apart.where(F.size("known") == len(open_)).select("blob")
        if not ready.isEmpty():  # texts that have had all rules stay where they are
            todo = saved(each.select("blob").join(ready, "blob", "left_anti"), total)
            again = with_maybe(again, bitmap(todo, "blob", bits), "blob", "todo").where("todo").select("blob", "t")
        again = again.groupBy("blob").agg(F.max("t").alias("t")).join(apart, "blob", "left").withColumn("known", F.coalesce("known", no_rule))
        unseen = once.unionByName(again.where(F.size("known") < len(open_)))
        entry = [
            F.struct(F.lit(r.key).alias("rule"), (~F.array_contains("known", r.key)).alias("new"), F.when(F.array_contains("known", r.key), none).otherwise(spans_of(F.col("t"), r, places[r.key])).alias("spans"))
            for r in open_
        ]
        done = saved(unseen.select("blob", F.array(*entry).alias("e")))
        entries = done.select("blob", F.inline("e")).where("new").select("blob", "rule", "spans")

    # what was found before is put under the places that the rules have now
    place = F.create_map(*[x for k, i in places.items() for x in (F.lit(k), F.lit(i))])
    hits = old.unionByName(entries).where(F.size("spans") > 0)
    hits = hits.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), place[F.col("rule")].alias("rule"), s["end"].alias("end"))).alias("spans"))
    found = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    found = saved(found.join(each, "blob"), total)
    out = matched(paths, found, "blob", total, "left", F.size("spans") * SPAN_BYTES)
    return out.select("doc_id", "blob", F.coalesce("spans", none).alias("spans")), entries


# --- the stored ledger ------------------------------------------------------------------


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored entries, or None where there are none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def scan_into(path: str, docs: DataFrame, *increments: tuple[Rule, ...]) -> DataFrame:
    """Paths after scans of each increment of rules, with the ledger stored at path read and added to.

    Entries that are written twice, by scans at the same time, count once. An increment's
    rows are added before the next one starts, so one that fails loses only its own work.
    """
    spark, keys, out = docs.sparkSession, addressed(docs), None
    for rules in increments:
        out, entries = scan(docs, read_ledger(spark, path), rules, paths=keys)
        if not entries.isEmpty():
            entries.write.mode("append").parquet(path)
    return out


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, by start and then rule, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))))


def report(paths: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """Counts and digests for each path."""
    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == i)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(rules[:base])]
    own = F.filter("spans", lambda s: s["rule"] < base)
    return paths.select("doc_id", *counts, F.sha2(joined(own, rules), 256).alias("base_sha256"), joined(F.col("spans"), rules).alias("spans"))
