"""Benchmark decontamination by size-partitioned MinHash containment search, verified by exact shingle containment.

Documents are partitioned by the size of their shingle set, to powers of two. A document of the partition of size 2**j
keeps the least hash of each of ``2**(j + extra)`` ranges of hash values: a one-permutation MinHash whose length grows
with the document, so a short test item inside a long document is sampled as densely as in a short one. An item is
probed with its shingles; the two meet when one of them is a least hash of the document. With m shared shingles the
chance of missing all is about (1 - p)**m, where p is the share of shingles that are least ones; ``extra`` is chosen so
that it stays under MISS for the shortest item. If no length can give that, documents keep all their hashes. A longer
item shares more shingles than are needed for that, so it is not probed with those that most other items have too: a
phrase common to the items makes no pairs. Documents and items that met are then compared by their shingles themselves.

All of it is DataFrame expressions. Text of a document leaves its partition only if it met an item.

Defined results: null and empty texts, and texts and items of fewer than n words, have no shingles and meet nothing;
items of one id and different texts are items of their own; a null item id is kept; repeated documents each give a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.llm.common import BROADCAST_BYTES, bound, stored, with_keys, without_keys

#: Greatest chance that the MinHash search misses an item that is contained as asked.
MISS = 1e-6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _places(w: Column, n: int) -> Column:
    return F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))


def shingle_texts(text: Column, n: int) -> Column:
    """Distinct n-word shingles of a text, as texts."""
    return bound(words(text), lambda w: F.array_distinct(F.transform(_places(w, n), lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(n))))))


def shingle_hashes(text: Column, n: int) -> Column:
    """Their hashes, ascending."""
    return bound(words(text), lambda w: F.sort_array(F.array_distinct(F.transform(_places(w, n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n)))))))


def hits_needed(extra: int | None) -> int:
    """Least number of shared shingles that are all missed with a chance under MISS; one if documents keep all hashes."""
    if extra is None:
        return 1
    load = 2.0**-extra  # shingles for each range, at most
    p = (1 - math.exp(-load)) / load
    return math.ceil(math.log(MISS) / math.log(1 - p))


def extra_bits(fewest: int) -> int | None:
    """Least ``extra`` for which ``fewest`` shared shingles are missed with a chance under MISS; None if there is none."""
    return next((extra for extra in range(4) if hits_needed(extra) <= fewest), None)


def least_hashes(hashes: Column, extra: int) -> Column:
    """The least hash of each range of ascending hashes; the number of ranges goes by the size of the set."""
    shift = lambda h: F.lit(64 - extra) - F.ceil(F.log2(F.greatest(F.size(h), F.lit(2)))).cast("int")
    place = lambda x, by: F.call_function("shiftrightunsigned", x.bitwiseXOR(F.lit(-(2**63))), by)

    def firsts(s: Column) -> Column:
        return F.filter(s["h"], lambda x, i: (i == 0) | (place(x, s["by"]) != place(F.get(s["h"], i - 1), s["by"])))

    return bound(hashes, lambda h: bound(F.struct(h.alias("h"), shift(h).alias("by")), firsts))


def leaks(docs: DataFrame, items: DataFrame, *, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, t1, t2 (hashes of its text), item_id, n_hits, n_item: where hits / item shingles >= num / den."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("item_text")).distinct()
    asked = asked.select("item_id", F.xxhash64("item_id", "item_text").alias("item_key"), shingle_texts(F.col("item_text"), n).alias("item_shingles"), shingle_hashes(F.col("item_text"), n).alias("item_hashes")).filter(F.size("item_hashes") > 0)
    asked = stored(spark, asked.withColumn("n_item", F.size("item_shingles").cast("long")), "items")
    shortest, n_items, shingle_bytes = asked.agg(F.min("n_item"), F.count(F.lit(1)), F.coalesce(F.sum(F.aggregate("item_shingles", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x) + 16)), F.lit(0))).first()
    extra = extra_bits(-(-num * shortest // den)) if shortest else None
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(29), F.col("text"))})
    hashes = shingle_hashes(F.col("text"), n)
    # outer: a plain explode would make Spark work out the hashes a second time, to filter on their number
    kept = own.select("t1", "t2", F.explode_outer(hashes if extra is None else least_hashes(hashes, extra)).alias("h")).filter("h is not null")
    each = asked.select("item_key", "n_item", F.explode("item_hashes").alias("h"))
    rare = Window.partitionBy("item_key").orderBy("items", "h")
    spare = F.ceil(F.col("n_item") * num / den) - hits_needed(extra)
    probe = each.join(each.groupBy("h").agg(F.count(F.lit(1)).alias("items")), "h").withColumn("k", F.row_number().over(rare)).filter(F.col("k") <= F.col("n_item") - F.greatest(spare, F.lit(0)))
    probe = stored(spark, probe.select("h", "item_key"), "probes")
    met = stored(spark, with_keys(kept, probe, ["h"], probe.count()).select("t1", "t2", "item_key").distinct(), "met")
    asked = asked.drop("item_hashes")
    found = with_keys(own, met, ["t1", "t2"], met.count(), 48).join(F.broadcast(asked) if shingle_bytes + 64 * n_items <= BROADCAST_BYTES else asked, "item_key")
    found = found.withColumn("n_hits", F.size(F.array_intersect(shingle_texts(F.col("text"), n), "item_shingles")).cast("long"))
    return found.filter(F.col("n_hits") * den >= F.col("n_item") * num).select("doc_id", "t1", "t2", "item_id", "n_hits", "n_item")


def without_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    bad = stored(docs.sparkSession, leaks(docs, items, id_col=id_col, text_col=text_col, **options).select("t1", "t2").distinct(), "leaks")
    names = docs.columns
    keyed = docs.withColumns({"__t1": F.xxhash64(text_col), "__t2": F.xxhash64(F.lit(29), F.col(text_col))})
    return without_keys(keyed, bad.toDF("__t1", "__t2"), ["__t1", "__t2"], bad.count()).select(*names)
