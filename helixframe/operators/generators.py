"""Seeded generators of genomes and reads. Every draw is a hash of the seed and of what is drawn, so any run, in any number of tasks, gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _text(seed: int, name: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), *(p.cast("string") for p in parts)))


def _digit(text: Column) -> Column:
    return F.ascii(F.substring(text, 1, 1))


def _chance(text: Column, share: float) -> Column:
    return F.substring(text, 1, 8) < f"{int(share * 2**32):08x}"


def _base(n: Column) -> Column:
    return F.substring(F.lit("ACGT"), (n % 4 + 1).cast("int"), F.lit(1))


def _joined(rows: DataFrame, keys: list[str], order: Column, base: str = "base") -> DataFrame:
    """A sequence is one value: its letters are put together in order."""
    parts = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col(base).alias("b"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["b"]), "").alias("seq"))


def looped_genome(spark: SparkSession, blocks: int, size: int, seed: int, rate: float) -> DataFrame:
    """(name, seq): ``linear``, blocks A B C D of random bases, and ``looped``, A D C with substitutions at ``rate``."""
    g = spark.range(blocks * size).withColumnRenamed("id", "i")
    code = _digit(_text(seed, "genome", F.col("i")))
    other = code + 1 + _digit(_text(seed, "other", F.col("i"))) % 3
    block = F.call_function("div", F.col("i"), F.lit(size))
    turn = F.when(block == 0, 0).when(block == blocks - 1, 1).otherwise(2)
    linear = g.select(F.lit("linear").alias("name"), F.lit(0).alias("turn"), "i", _base(code).alias("base"))
    looped = g.filter(block != 1).select(F.lit("looped").alias("name"), turn.alias("turn"), "i", F.when(_chance(_text(seed, "loop", F.col("i")), rate), _base(other)).otherwise(_base(code)).alias("base"))
    return _joined(linear.unionByName(looped), ["name"], F.struct("turn", "i"))


def mutated(reads: DataFrame, seed: int, substitutions: float, deletions: float, insertions: float) -> DataFrame:
    """(read_id, seq): each base replaced by another one, left out, or preceded by a random one, at these rates."""
    c = reads.select("read_id", F.posexplode(F.filter(F.split("seq", ""), lambda x: x != "")).alias("i", "b"))
    u, o = _text(seed, "kind", F.col("read_id"), F.col("i")), _digit(_text(seed, "base", F.col("read_id"), F.col("i")))
    changed = _base(F.instr(F.lit("ACGT"), F.col("b")) + o % 3)
    base = F.when(_chance(u, substitutions), changed).when(_chance(u, substitutions + deletions), "").when(_chance(u, substitutions + deletions + insertions), F.concat(_base(o), F.col("b"))).otherwise(F.col("b"))
    done = _joined(c.withColumn("base", base), ["read_id"], F.col("i"))
    return reads.select("read_id").join(done, "read_id", "left").select("read_id", F.coalesce("seq", F.lit("")).alias("seq"))


def labelled_reads(spark: SparkSession, n: int, clusters: int, length: int, seed: int, rate: float) -> DataFrame:
    """(read_id, label, seq): ``n`` reads dealt over clusters; a cluster's template differs from the first one's at ``rate`` of its sites."""
    sites = spark.range(length).withColumnRenamed("id", "i").withColumn("label", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(clusters - 1).cast("long"))))
    code = _digit(_text(seed, "template", F.col("i"))) % 4
    differs = (F.col("label") > 0) & _chance(_text(seed, "site", F.col("label"), F.col("i")), rate)
    other = code + 1 + _digit(_text(seed, "alt", F.col("label"), F.col("i"))) % 3
    templates = _joined(sites.withColumn("base", F.when(differs, _base(other)).otherwise(_base(code))), ["label"], F.col("i"))
    reads = spark.range(n).select(F.col("id").alias("read_id"), (F.col("id") % clusters).alias("label"))
    return reads.join(F.broadcast(templates), "label").select("read_id", "label", "seq")  # a row for each cluster
