"""The operators' queries over their whole tables, and the SQL that replays those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontam, langid, ngramjoin, packing, pii, quotes, repeats, sharding, topk, toxicity
from helixframe.llm.common import id_remainder, read


#: A key for runs of the queries; a real run gives its own, from where it keeps its secrets.
PII_KEY = "example key"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY, count_col="n_replaced")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, read(spark, sf_dir, "labels"), id_remainder("doc_id", 5) != 0)
    scored = toxicity.score(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


OP3_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    profiles = langid.learn_profiles(docs, id_remainder("doc_id", 4) != 2)
    found = langid.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.groups(read(spark, sf_dir, "documents"), num=90, den=100, n=3)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(read(spark, sf_dir, "conversations"))


#: Holds where no line is quoted, as in the given tables: every message replies to the turn before it. Quotes have no
#: SQL form; the tests compare them with brute force.
OP7_SQL = r"""WITH t AS (SELECT conv_id, turn, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS depth,
  min(turn) OVER (PARTITION BY conv_id) AS thread, max(turn) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  role, regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS own FROM conversations)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(thread AS BIGINT) AS thread, depth, CAST(turn AS BIGINT) AS turn, CAST(before AS BIGINT) AS parent_turn,
  false AS quoted, role, own AS text, CAST(0 AS BIGINT) AS n_quotes FROM t"""


def vocabulary(path: str | None = None) -> str:
    """Text of the tokenizer file, read on the driver; the installed public one unless a path is given."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary(), special=True)


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_hits", "n_item")


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
OP9_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_hits, any_value(n_item) AS n_item FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) * 10 >= any_value(n_item) * 8"""


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_pii, op2_toxicity, op3_topk, op4_langid, op5_ngramjoin, op6_sharding, op7_quotes, op8_packing, op9_decontam, op10_repeats)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": OP3_SQL, "op7_quotes": OP7_SQL, "op9_decontam": OP9_SQL}
