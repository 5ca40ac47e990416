"""What the operators share: lineage cuts, membership bitmaps, checked broadcasts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many narrow rows may be broadcast.
BROADCAST_ROWS = 50_000
#: A table of longer rows may be broadcast up to so many bytes of them.
BROADCAST_BYTES = 64 << 20
#: A key of more rows than this, or than one in HOT_KEYS of all, is hot; so there are at most HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 1000, 10_000
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Narrow rows in a file of a saved table, and the least number of files, where the rows are known.
SAVED_ROWS, SAVED_FILES = 50_000, 4


def saved(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows, computed once, in the folder of spark.checkpoint.dir; it survives lost executors.

    rows: about how many there are, at most; with few of them there are few files.
    """
    if rows is not None:
        df = df.coalesce(max(SAVED_FILES, -(-rows // SAVED_ROWS)))
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master, as in tests, may go without: it gets a temporary one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir is not set; the driver and executors need a shared folder")
    return tempfile.mkdtemp(prefix="quillon-")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever the session's file systems have it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def has_repeats(docs: DataFrame) -> bool:
    """Whether an id occurs twice; reads ids only."""
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) inside an expression, with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A saved table, marked for broadcast if counting shows that it is small; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def matched(rows: DataFrame, table: DataFrame, key: str | list[str], total: int, how: str = "inner", size: Column | None = None) -> DataFrame:
    """rows joined with the saved table(key, n, ...) on the key, how: inner or left; n goes.

    n is how many of the `total` rows have the key. Hot keys are few by that, so they are
    broadcast and their rows stay where they are; only rows of other keys are shuffled.
    rows are read twice, so they should be saved.

    size: bytes of a row of the table, where they have no bound. What would be broadcast then
    has its bytes summed, and beyond BROADCAST_BYTES is shuffled: a hot key's row is repeated
    for each HOT_ROWS of its rows, which are dealt out evenly over those.
    """
    light = lambda t: size is None or (t.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES
    if total <= BROADCAST_ROWS and light(table):
        return rows.join(F.broadcast(table), key, how).drop("n")
    keys = [key] if isinstance(key, str) else key
    is_hot = F.col("n") > max(HOT_ROWS, total // HOT_KEYS)
    hot = table.where(is_hot)
    others = rows.join(F.broadcast(hot).select(key), key, "left_anti").join(table.where(~is_hot), key, how)
    if light(hot):
        own = rows.join(F.broadcast(hot), key)
    else:
        parts = F.ceil(F.col("n") / HOT_ROWS).cast("int")
        names = F.broadcast(hot.select(*keys, parts.alias("_parts")))
        each = hot.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        dealt = rows.join(names, key).withColumn("_part", F.pmod(F.monotonically_increasing_id(), "_parts").cast("int")).drop("_parts")
        own = dealt.join(each, [*keys, "_part"]).drop("_part")
    return own.unionByName(others).drop("n")


#: Least and most bits of a bitmap, as powers of 2: the largest has 16 MB.
BITS = (17, 27)


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def bitmap(keys: DataFrame, column: str, bits: int | None = None) -> tuple[DataFrame, int]:
    """Membership bits of a saved table's keys, at most 2^(bits-15) rows of 4 KB, and `bits`.

    Unless given, there are about 32 bits a key, within BITS, however many keys there are.
    """
    if bits is None:
        bits = min(max((32 * keys.count()).bit_length(), BITS[0]), BITS[1])
    slot = _slot(F.col(column), bits)
    marks = keys.select(F.shiftright(slot, 15).alias("_chunk"), slot.bitwiseAND(F.lit(32767)).alias("_bit"))
    chunks = marks.groupBy("_chunk").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    return saved(chunks, SAVED_ROWS << max(0, bits - 21)), bits  # 64 chunks a file


def with_maybe(df: DataFrame, marked: tuple[DataFrame, int], column: str, out: str) -> DataFrame:
    """Adds a flag: false where the key is certainly not among those of the bitmap. Nothing is shuffled."""
    marks, bits = marked
    slot = _slot(F.col(column), bits)
    at = df.withColumn("_slot", slot).withColumn("_own", F.shiftright("_slot", 15))
    joined = at.join(F.broadcast(marks), F.col("_own") == F.col("_chunk"), "left")
    bit = F.col("_slot").bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = F.expr("shiftright({b}, cast(_slot & 7 AS INT)) & 1".format(b="_byte"))
    return joined.withColumn("_byte", byte).withColumn(out, F.coalesce(on == 1, F.lit(False))).drop("_slot", "_own", "_chunk", "_bits", "_byte")


def without(docs: DataFrame, gone: DataFrame, mark: Column) -> DataFrame:
    """The rows of docs that are not in gone(doc_id, mark). An id and a mark of the text decide together.

    Rows whose id, or if it is null whose mark, a bitmap clears stay where they are; only the others are shuffled.
    """
    key = lambda m: F.xxhash64("id", F.when(F.col("id").isNull(), m))
    names = [F.col(f"`{c}`") for c in docs.columns]
    left_out = saved(gone.select(F.col("doc_id").alias("id"), "mark").withColumn("key", key(F.col("mark"))))
    keyed = docs.select(F.struct(*names).alias("row"), F.col("doc_id").alias("id"), F.when(F.col("doc_id").isNull(), mark).alias("none"), F.col("text")).withColumn("key", key(F.col("none")))
    own = with_maybe(keyed, bitmap(left_out, "key"), "key", "maybe")
    a, b = own.where("maybe").select("row", "id", mark.alias("mark")).alias("a"), left_out.alias("b")
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & F.col("a.mark").eqNullSafe(F.col("b.mark"))
    return own.where("NOT maybe").select("row.*").unionByName(a.join(b, same, "left_anti").select("row.*"))
