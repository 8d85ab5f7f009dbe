"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session that names none, as in tests, gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: On a shared local folder a file comes without a second one of checksums (Parquet has its own): each file that Hadoop
#: makes there costs a process or two for its mode. Other file systems ignore this.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: it cuts the lineage and survives lost executors."""
    path = f"{shared_folder(spark)}/helixframe-{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **_PLAIN_FILES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that ``stored`` wrote, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(conf).delete(path, True)


def id_remainder(column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % mod


#: Bytes of a side up to which a join broadcasts it. A larger one is shuffled, and a bitmap of its keys goes ahead of it.
BROADCAST_BYTES = 32 << 20
#: Bits of that bitmap, at most: 64 MB for any number of keys. Beyond a sixth of that many keys it lets more rows through.
BITMAP_BITS = 1 << 29
_PAGE = 1 << 15  # bits of a row of the bitmap


def small_or_shuffled(df: DataFrame, n: int, width: int = 32) -> DataFrame:
    """``df`` of ``n`` rows of ``width`` bytes each, marked for broadcast if they are within the bound."""
    return F.broadcast(df) if n * width <= BROADCAST_BYTES else df


def _place(on: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(41), *on), F.lit(bits))


def _marked(rows: DataFrame, keys: DataFrame, on: list[str], n: int) -> DataFrame:
    """``rows`` with ``__hit``: false where a row's key is surely none of ``keys``."""
    bits = _PAGE
    while bits < min(16 * n, BITMAP_BITS):
        bits *= 2
    at = keys.select(_place(on, bits).alias("p"))
    pages = at.groupBy(F.expr(f"p div {_PAGE}").alias("__page")).agg(F.expr(f"bitmap_construct_agg(p % {_PAGE})").alias("__bits"))
    rows = rows.withColumn("__p", _place(on, bits)).withColumn("__page", F.expr(f"__p div {_PAGE}")).join(F.broadcast(pages), "__page", "left")
    byte = "cast(conv(hex(substring(__bits, cast((__p % 32768) div 8 as int) + 1, 1)), 16, 10) as int)"
    return rows.withColumn("__hit", F.expr(f"__bits is not null and (shiftright({byte}, cast(__p % 8 as int)) & 1) = 1")).drop("__p", "__page", "__bits")


def with_keys(rows: DataFrame, side: DataFrame, on: list[str], n: int, width: int | None = 32) -> DataFrame:
    """Inner join of wide rows with ``n`` narrow rows of ``width`` bytes, on columns of equal names.

    Rows whose key the side lacks stay where they are, whatever the side's size: a large side is shuffled behind a bitmap.
    A width of None stands for a side that grows as the rows do: it is never broadcast.
    """
    if width is not None and n * width <= BROADCAST_BYTES:
        return rows.join(F.broadcast(side), on)
    return _marked(rows, side, on, n).filter("__hit").drop("__hit").join(side, on)


def without_keys(rows: DataFrame, side: DataFrame, on: list[str], n: int, width: int = 32) -> DataFrame:
    """The rows whose key the side lacks; keys with a null are lacking. Only rows that the bitmap can't decide are shuffled."""
    if n * width <= BROADCAST_BYTES:
        return rows.join(F.broadcast(side.select(*on)), on, "left_anti")
    marked = _marked(rows, side, on, n)
    return marked.filter("not __hit").drop("__hit").unionByName(marked.filter("__hit").drop("__hit").join(side.select(*on), on, "left_anti"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once for each row, wherever the optimizer moves the expression.

    A column of an earlier select is no substitute: filters pushed below it take its expression into themselves, and
    inside a lambda that is then worked out for each element.
    """
    return F.transform(F.array(value), use)[0]
