"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character 1- to 3-grams (``_`` stands at word ends). A document's
own most frequent n-grams are compared with each profile by the out-of-place distance: the sum of rank differences,
where an n-gram that a profile lacks counts as its whole length. The nearest profile names the language.

Defined results: null texts, and texts without a letter, get ``und`` and score 0; equal distances go to the smaller
language name; equal counts within a profile go by n-gram code; with no profile at all every row is ``und``; rows that
repeat a text are judged alike (a repeated id may give a profile some more documents); a very long text is read whole, in
one task; an empty table gives no rows and no profiles; other columns pass, but for those that are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from helixframe.llm.textblocks import slices

#: Documents of each language that the profiles are learned from: those of least hash.
TRAIN_DOCS = 1024
PROFILE, DOC_GRAMS = 400, 300
#: Parts of a language's rows, each of which puts forward its least hashes.
PARTS = 64
UND = "und"


def letter_table() -> np.ndarray:
    """Code point to itself if it is a letter, else 0."""
    n = 0x110000
    return np.fromiter((i if chr(i).isalpha() else 0 for i in range(n)), np.uint32, n)


def text_grams(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 1- to 3-grams of a lower-cased text as codes, with their counts. Word ends are code 95, ``_``."""
    code = letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    inner = code > 0
    if not inner.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # one end mark between words and at both ends of the text
    line = np.concatenate(([np.uint32(0)], code, [np.uint32(0)]))
    keep = np.ones(len(line), bool)
    keep[1:] = (line[1:] > 0) | (line[:-1] > 0)
    line = np.where(line[keep] == 0, 95, line[keep]).astype(np.uint64)
    one = line[line != 95]
    two = (line[:-1] << np.uint64(21)) | line[1:]
    three = (two[:-1] << np.uint64(21)) | line[2:]
    three = three[line[1:-1] != 95]
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def ranked(code: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    return code[np.lexsort((code, -count))[:most]]


def learn_profiles(docs: DataFrame, may_learn: Column, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS, profile: int = PROFILE) -> dict[str, list[int]]:
    """Profiles by language, from at most ``train_docs`` documents of each; ``may_learn`` holds for rows that may be used."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.lit(3)).alias("h"), may_learn.alias("ok")).filter("ok and lang is not null and text is not null")
    # first within parts of a language, so that no task sorts all of its rows
    ids = own.select("lang", "h", "id", F.pmod("h", F.lit(PARTS)).alias("part"))
    for keys in (["lang", "part"], ["lang"]):
        ids = ids.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "id"))).filter(F.col("k") <= train_docs)
    edge = ids.groupBy("lang").agg(F.max("h").alias("last"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), pc.utf8_lower(batch.column("text")).to_pylist(), strict=True):
                code, n = text_grams(text, letters)
                if len(code):
                    yield pa.record_batch([pa.array([lang] * len(code)), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = own.join(F.broadcast(edge), "lang").filter("h <= last").select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("k") <= profile)
    out: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["k"])):  # profile rows for each language
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Ranker:
    def __init__(self, profiles: dict[str, list[int]], doc_grams: int = DOC_GRAMS):
        self.langs, self.most = sorted(profiles), doc_grams
        self.length = max([1, *map(len, profiles.values())])
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
        self.rank = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.grams, np.array(profiles[lang], np.uint64)), j] = np.arange(len(profiles[lang]))
        self.letters = letter_table()

    def guess(self, text: str | None) -> tuple[str, float]:
        code, n = text_grams(text, self.letters) if text else ((), ())
        if not len(code) or not self.langs:
            return UND, 0.0
        own = ranked(code, n, self.most)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        rank = np.where((self.grams[at] == own)[:, None], self.rank[at], -1)
        far = np.where(rank < 0, self.length, np.abs(rank - np.arange(len(own))[:, None])).sum(0)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (max(self.length, len(own)) * len(own)))


def identify(docs: DataFrame, profiles: dict[str, list[int]], *, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` with the language and its score added; columns of those names are replaced."""
    docs = docs.drop(lang_col, score_col)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # profile entries for each language
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(shared.value)
        for batch in batches:
            for b in slices(batch, text_col):
                found = [ranker.guess(t) for t in pc.utf8_lower(b.column(text_col)).to_pylist()]
                yield pa.record_batch([*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)
