"""URLs allowed or blocked: by rules where one fits, else by boosted trees on lexical features.

A rule is a host and the start of a path. It fits its host and all hosts below it; the longest
rule that fits decides. What the rules judge is also what the trees learn from, unless other
labelled URLs are given.

Features (FEATURES) are read off the URL alone: lengths, labels of the host, depth of the
path, share of digits, entropy of the characters, parameters, hyphens; and statistics of the
host's suffix, its last label: in how many URLs it stands, and which share of its labelled
URLs are blocked, smoothed towards that of all. Counts are over all rows. For a URL that the
trees are fitted on, the share leaves out the fold that the URL is in, so that it does not
tell the URL's own label.

Trees are grown level by level in Spark: a job sums gradients and second derivatives by node,
feature and bin, and only these sums (at most 2^DEPTH x features x BINS rows) come to the
driver, which picks the splits. The sums are of whole numbers, so reruns agree to the bit. The
trees are fitted on at most about TRAIN_ROWS labelled URLs, half of each class, chosen by hash,
equal ones merged and weighted by how many rows each stands for; everything else reads all rows.

Prediction is one expression in place. Suffix statistics are keyed by hash; a table of up to
BROADCAST_ROWS suffixes is broadcast, beyond it only the most frequent are, so rows of a
frequent suffix stay where they are.

Defined results: a null URL, or one without '://', has an empty host and path and is judged by
the trees; very long URLs are read whole; equal URLs are judged alike; an empty table gives no
rows; without any labelled URL all others are allowed; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_ROWS, ascii_lower, matched, saved, text_of

ALLOW, BLOCK = "allow", "block"

#: Most labelled URLs that the trees are fitted on, about.
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS = 10, 3, 0.4, 32
#: Folds of the labelled URLs; rows of the overall share added to each suffix's; what steadies a leaf.
FOLDS, SMOOTHING, RIDGE = 5, 10.0, 1.0
#: Gradients are summed as whole multiples of 1 / UNIT.
UNIT = 1 << 20
#: Trees after which the fitted scores are written down.
SAVE_EVERY = 5


@dataclass(frozen=True)
class Rule:
    """What to do with hosts `host` and below, where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


# The rules of the query.
RULES = (Rule(BLOCK, "net", "/"), Rule(ALLOW, "example.net", "/en/"), Rule(BLOCK, "example.com", "/de/"), Rule(ALLOW, "org", "/fr/"))


def _after(text: Column, mark: str) -> Column:
    """What follows the first mark; empty without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text))).otherwise("")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path."""
    rest = _after(F.coalesce(url, F.lit("")), "://")
    host = F.substring_index(F.translate(rest, "?#", "//"), "/", 1)
    path = F.substring_index(F.substring_index(F.substring(rest, F.length(host) + 1, F.length(rest)), "?", 1), "#", 1)
    return ascii_lower(host), path


def matching(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; of equally long ones the first. Meant for up to some hundred rules."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(str(r))):  # the last one set is looked at first
        fits = r.fits(host, path)
        name, verdict = F.when(fits, str(r)).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Bits a character, by runs of the sorted characters; rounded, so that equal counts are equal."""
    chars = F.array_sort(F.split(text, "", -1))
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))
    weight = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(0.0)

    def step(a: Column, c: Column) -> Column:
        same = a["c"] == c
        return F.struct(c.alias("c"), F.when(same, a["n"] + 1).otherwise(1.0).alias("n"), F.when(same, a["sum"]).otherwise(a["sum"] + weight(a["n"])).alias("sum"))

    n = F.length(text).cast("double")
    return F.when(n > 0, F.round(F.log2(n) - F.aggregate(chars, start, step, lambda a: a["sum"] + weight(a["n"])) / n, 6)).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the URL alone, as doubles."""
    url = F.coalesce(url, F.lit(""))
    without = lambda text, chars: F.length(F.translate(text, chars, ""))
    pieces = lambda text, mark: F.size(F.filter(F.split(text, mark, -1), lambda p: p != ""))
    query = F.substring_index(_after(F.substring_index(url, "#", 1), "?"), "#", 1)
    features = {
        "length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "labels": pieces(host, "[.]"),
        "depth": pieces(path, "/"),
        "digit_ratio": (F.length(url) - without(url, "0123456789")) / F.greatest(F.length(url), F.lit(1)),
        "entropy": _entropy(url),
        "parameters": pieces(query, "[&;]"),
        "query_length": F.length(query),
        "hyphens": F.length(host) - without(host, "-"),
    }
    return {k: v.cast("double") for k, v in features.items()}


FEATURES = ("length", "host_length", "path_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "query_length", "hyphens", "suffix_rows", "suffix_blocked")


def _suffix(host: Column) -> Column:
    """A number for the host's last label."""
    return F.xxhash64(F.substring_index(host, ".", -1))


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), F.coalesce(url, F.lit(""))), F.lit(FOLDS)).cast("int")


def suffix_statistics(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """suffix, n (its rows), and of its labelled rows how many there are, and are blocked, in each fold; saved."""
    none = [F.lit(0).alias(c) for k in range(FOLDS) for c in (f"n{k}", f"b{k}")]
    own = [F.count_if(F.col("fold") == k).alias(f"n{k}") for k in range(FOLDS)] + [F.count_if((F.col("fold") == k) & (F.col("y") == 1)).alias(f"b{k}") for k in range(FOLDS)]
    counted = rows.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))
    judged = labelled.groupBy("suffix").agg(*own)
    both = counted.select("suffix", "n", *none).unionByName(judged.withColumn("n", F.lit(0)))
    return saved(both.groupBy("suffix").agg(*[F.sum(c).alias(c) for c in both.columns[1:]]))


def with_suffix(rows: DataFrame, table: DataFrame, total: int) -> DataFrame:
    """rows with the statistics of their suffix; total: how many rows there are in all."""
    known = table.withColumnRenamed("n", "suffix_n").withColumn("n", F.col("suffix_n"))
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(known.drop("n")), "suffix", "left")
    return matched(rows, known, "suffix", total, "left")


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def suffix_features(prior: float, fold: Column | None = None) -> dict[str, Column]:
    """From the columns of with_suffix; with a fold, without the labels in it."""
    kept = lambda letter: _sum([F.when(fold == k, 0).otherwise(F.col(f"{letter}{k}")) if fold is not None else F.col(f"{letter}{k}") for k in range(FOLDS)])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return {"suffix_rows": F.round(F.log2(zero(F.col("suffix_n")) + 1), 6), "suffix_blocked": (zero(kept("b")) + SMOOTHING * prior) / (zero(kept("n")) + SMOOTHING)}


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    """Rows whose feature is at most the threshold, which is the bin's upper end, go left."""

    feature: int
    bin: int
    left: Split | Leaf
    right: Split | Leaf

    def sql(self, goes_left: Callable[[int, int], str], leaf: Callable[[Leaf], str] = lambda leaf: f"{leaf.value!r}D") -> str:
        """As one expression, whose text is far cheaper to build than columns."""
        left, right = (side.sql(goes_left, leaf) if isinstance(side, Split) else leaf(side) for side in (self.left, self.right))
        return f"CASE WHEN {goes_left(self.feature, self.bin)} THEN {left} ELSE {right} END"


@dataclass(frozen=True)
class Model:
    base: float
    prior: float
    thresholds: tuple[tuple[float, ...], ...]
    trees: tuple[Split, ...]

    def score(self, prefix: str = "") -> Column:
        """Log-odds of being blocked, from columns named by the features."""
        goes_left = lambda f, b: f"{prefix}{FEATURES[f]} <= {self.thresholds[f][b]!r}D"
        return F.expr(" + ".join([f"{self.base!r}D", *(t.sql(goes_left) for t in self.trees)]))


def best_split(sums: dict[tuple[int, int], tuple[int, int]], features: int, total: tuple[int, int]) -> tuple[int, int, tuple[int, int]] | None:
    """Of a node's sums (gradient, second derivative) by feature and bin, the split that gains most, and the sums on its left.

    The first of equals; None without a gain.
    """
    worth = lambda g, h: (g / UNIT) ** 2 / (h / UNIT + RIDGE)
    best, found = worth(*total) + 1e-6, None
    for f in range(features):
        g = h = 0
        bins = sorted(b for x, b in sums if x == f)
        for b in bins[:-1]:
            g, h = g + sums[f, b][0], h + sums[f, b][1]
            gain = worth(g, h) + worth(total[0] - g, total[1] - h)
            if gain > best:
                best, found = gain, (f, b, (g, h))
    return found


def _in_bins(feature: int, last: int) -> str:
    return f"bins[{feature}] <= {last}"


def grow(rows: DataFrame, depth: int = DEPTH) -> Split | None:
    """A tree for rows(bins, y, w, score); None if no split gains. One job a level."""
    chance = 1 / (1 + F.exp(-F.col("score")))
    rows = rows.select("bins", F.round((F.col("y") - chance) * F.col("w") * UNIT).cast("long").alias("g"), F.round(chance * (1 - chance) * F.col("w") * UNIT).cast("long").alias("h"))
    made: dict[int, tuple[int, int]] = {}  # of node k the children are 2k and 2k + 1
    totals: dict[int, tuple[int, int]] = {}

    def build(k: int) -> Split | Leaf:
        return Split(*made[k], build(2 * k), build(2 * k + 1)) if k in made else Leaf(RATE * (totals[k][0] / UNIT) / (totals[k][1] / UNIT + RIDGE))

    def node(k: int) -> str:
        return f"CASE WHEN {_in_bins(*made[k])} THEN {node(2 * k)} ELSE {node(2 * k + 1)} END" if k in made else str(k)

    for level in range(depth):
        if level and not any(k // 2 in made for k in range(1 << level, 2 << level)):
            break
        each = rows.withColumn("node", F.expr(node(1))).where(F.col("node") >= (1 << level)).select("node", "g", "h", F.posexplode("bins").alias("f", "bin"))
        sums: dict[int, dict[tuple[int, int], tuple[int, int]]] = {}
        for r in each.groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            sums.setdefault(r["node"], {})[r["f"], r["bin"]] = (r["g"], r["h"])
        for k, of in sums.items():
            total = tuple(sum(v[i] for (f, _), v in of.items() if f == 0) for i in (0, 1))
            if found := best_split(of, len(FEATURES), total):
                made[k] = found[:2]
                totals[2 * k] = found[2]
                totals[2 * k + 1] = total[0] - found[2][0], total[1] - found[2][1]
    return build(1) if made else None


def fit(labelled: DataFrame, table: DataFrame, total: int, train_rows: int = TRAIN_ROWS, trees: int = TREES) -> Model:
    """Trees for labelled(url, y, suffix, fold) rows, of `total`, with the suffix statistics."""
    n = table.select(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for k in range(FOLDS) for c in (f"n{k}", f"b{k}")]).first()
    every, blocked = sum(n[f"n{k}"] for k in range(FOLDS)), sum(n[f"b{k}"] for k in range(FOLDS))
    if not every:
        return Model(0.0, 0.0, (), ())
    prior = blocked / every
    base = math.log((blocked + 0.5) / (every - blocked + 0.5))
    shares = [min(1.0, train_rows / 2 / max(1, of)) for of in (every - blocked, blocked)]
    share = F.when(F.col("y") == 1, F.lit(shares[1])).otherwise(F.lit(shares[0]))
    place = F.pmod(F.xxhash64(F.lit("sample"), "url"), F.lit(1 << 40))
    chosen = labelled.where(place < share * F.lit(float(1 << 40))).groupBy("url", "y", "suffix", "fold").agg((F.count(F.lit(1)) / F.max(share)).alias("w"))
    host, path = host_and_path(F.col("url"))
    features = lexical(F.col("url"), host, path) | suffix_features(prior, F.col("fold"))
    sample = saved(with_suffix(chosen, table, total).select("y", "w", *[features[f].alias(f) for f in FEATURES]), train_rows)
    cuts = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    found = sample.select(*[F.percentile(f, cuts).alias(f) for f in FEATURES]).first()
    thresholds = tuple(tuple(sorted(set(found[f] or ()))) for f in FEATURES)
    above = [" + ".join(["0", *(f"CAST({f} > {t!r}D AS INT)" for t in own)]) for f, own in zip(FEATURES, thresholds, strict=True)]
    rows = saved(sample.select(F.expr(f"array({', '.join(above)})").alias("bins"), "y", "w", F.lit(base).alias("score")), train_rows)
    made: list[Split] = []
    for k in range(trees):
        tree = grow(rows)
        if tree is None:
            break
        made.append(tree)
        rows = rows.withColumn("score", F.col("score") + F.expr(tree.sql(_in_bins)))
        if k % SAVE_EVERY == SAVE_EVERY - 1:
            rows = saved(rows, train_rows)
    return Model(base, prior, thresholds, tuple(made))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, labelled: DataFrame | None = None, train_rows: int = TRAIN_ROWS, trees: int = TREES) -> DataFrame:
    """page_id, url, host, path, rule, verdict, score (chance of block by the trees) of pages(page_id, url).

    labelled(url, block boolean): what the trees learn from; without it, the URLs that a rule fits.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rule, verdict = matching(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("suffix", _suffix(F.col("host")))
    if labelled is None:
        known = rows.where(F.col("ruled").isNotNull()).select(text_of("url").alias("url"), (F.col("ruled") == BLOCK).cast("int").alias("y"), "suffix")
    else:
        known = labelled.where(F.col("block").isNotNull()).select(text_of("url").alias("url"), F.col("block").cast("int").alias("y"), _suffix(host).alias("suffix"))
    known = known.withColumn("fold", _fold(F.col("url")))
    table = suffix_statistics(rows, known)
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    model = fit(known, table, total, train_rows, trees)
    features = lexical(F.col("url"), F.col("host"), F.col("path")) | suffix_features(model.prior)
    ready = with_suffix(rows, table, total).withColumns({f"_{k}": v for k, v in features.items()})
    odds = ready.withColumn("odds", model.score("_"))
    told = F.coalesce("ruled", F.when(F.col("odds") > 0, BLOCK).otherwise(ALLOW))
    return odds.select("page_id", "url", "host", "path", "rule", told.alias("verdict"), (1 / (1 + F.exp(-F.col("odds")))).alias("score"))
