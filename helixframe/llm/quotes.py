"""Chat formatting by quotation linking, in DataFrame expressions only.

A message is cut into its own lines and quoted lines (``>`` marks, nested as ``> >`` or ``>>``). Runs of quoted lines of
one level are passages. A passage, its paragraphs (between blank quoted lines) and its lines are normalised (lower case, one
space between words) and hashed; so are every message's own text, its paragraphs and its lines. A message replies to the
latest earlier message of its conversation whose own text has the passage; shallow quotes come before deep ones, whole
passages before their paragraphs and these before lines, longer matches before shorter ones. A quote of part of a line
matches nothing. A message that quotes nothing, or nothing that was said, replies to the turn before it. Following replies
upwards gives each message its thread (the message that the thread began with) and its depth. In the order (conv_id,
thread, turn) every reply follows what it answers. Messages are parsed once, into a table in the shared folder.

The latest earlier message that has a hash is found by an as-of search in two steps (within stretches of turns, then over
stretches), so a line that is quoted and said very often makes no pairs.

Defined results: a null text has no lines and gets an empty text; lines of a message that are only marks are dropped;
rows that repeat (conv_id, turn) are each resolved by themselves (their thread and depth are those of the one that replies
to the latest turn), and what answers that turn answers them all; rows whose conv_id or turn is null answer nothing, are
answered by nothing, and are their own thread; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.llm.common import bound, discard, stored

#: Turns of a stretch in the as-of search.
STRETCH = 256
_MARKS = r"^[ \t]*(?:>[ \t]*)+"


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def _lines(text: Column) -> Column:
    """(level, content) of each line."""
    raw = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")

    def parse(line: Column) -> Column:
        marks = F.regexp_extract(line, _MARKS, 0)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.substring(line, F.length(marks) + 1, F.length(line)).alias("content"))

    return F.transform(raw, parse)


def _split(lines: Column) -> Column:
    """(own, quotes) of a message's lines: its text without quotes, and runs of (level, lines)."""
    n = F.size(lines)
    level = lambda i: F.get(lines, i)["level"]
    own = F.regexp_replace(F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["content"]), "\n"), r"^\s+|\s+$", "")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))

    def runs(s: Column) -> Column:
        def run(start: Column, k: Column) -> Column:
            inside = F.transform(F.slice(lines, start + 1, F.coalesce(F.get(s, k + 1), n) - start), lambda x: normalised(x["content"]))
            said = lambda xs: F.filter(xs, lambda x: x != "")
            cut = F.split(F.array_join(F.transform(inside, lambda x: F.when(x == "", "\x01").otherwise(x)), " "), "\x01")
            return F.struct(level(start).alias("level"), said(inside).alias("lines"), said(F.transform(cut, F.trim)).alias("paragraphs"))

        return F.filter(F.transform(s, run), lambda q: (q["level"] > 0) & (F.size(q["lines"]) > 0))

    return F.struct(own.alias("own"), bound(starts, runs).alias("quotes"))


def parsed(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """``messages`` with ``own`` and ``quotes``."""
    return messages.withColumn("parts", bound(_lines(F.col(text_col)), _split)).withColumns({"own": F.col("parts.own"), "quotes": F.col("parts.quotes")}).drop("parts")


def said(own: Column) -> Column:
    """Normalised texts that a quote of a message can be: all of it, its paragraphs, its lines."""
    paragraphs = F.transform(F.split(own, r"\n[ \t]*\n"), normalised)
    lines = F.transform(F.split(own, "\n"), normalised)
    return F.filter(F.array_distinct(F.concat(F.array(normalised(own)), paragraphs, lines)), lambda x: x != "")


def latest_before(asks: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """``asks`` (keys, turn, ...) with ``found``: the greatest turn of ``answers`` with the same keys that is less."""
    stretch = F.floor(F.col("turn") / STRETCH).alias("stretch")
    there = answers.select(*keys, "turn", stretch).distinct()
    tops = there.groupBy(*keys, "stretch").agg(F.max("turn").alias("top"))
    both = asks.select(*keys, "turn", stretch).distinct().select(*keys, "stretch", "turn", F.lit(None).cast("long").alias("said")).unionByName(there.select(*keys, "stretch", "turn", F.col("turn").alias("said")))
    near = both.withColumn("near", F.max("said").over(Window.partitionBy(*keys, "stretch").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))).filter("said is null").drop("said")
    marks = tops.unionByName(near.select(*keys, "stretch").distinct().withColumn("top", F.lit(None).cast("long"))).groupBy(*keys, "stretch").agg(F.max("top").alias("top"))
    far = marks.withColumn("far", F.max("top").over(Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    found = near.join(far, [*keys, "stretch"], "left").select(*keys, "turn", F.coalesce("near", "far").alias("found"))
    return asks.join(found, [*keys, "turn"]).filter("found is not null")


def replies(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, row_key, parent): what each message with a matched quote answers. messages: parsed, with row_key."""
    quoted = messages.filter(F.size("quotes") > 0).select("conv_id", "turn", "row_key", F.explode("quotes").alias("q"))
    ask = lambda whole, xs: F.transform(xs, lambda x: F.struct(F.lit(whole).alias("whole"), x.alias("text")))
    each = F.concat(ask(2, F.array(F.array_join("q.lines", " "))), ask(1, F.col("q.paragraphs")), ask(0, F.col("q.lines")))
    texts = quoted.select("conv_id", "turn", "row_key", F.col("q.level").alias("level"), F.explode(each).alias("t"))
    asks = texts.select("conv_id", "turn", "row_key", "level", F.col("t.whole").alias("whole"), F.length("t.text").alias("size"), F.xxhash64("t.text").alias("h1"), F.xxhash64(F.lit(31), "t.text").alias("h2"))
    asked = asks.select("conv_id", "h1", "h2").distinct()
    answers = messages.select("conv_id", "turn", F.explode(said(F.col("own"))).alias("text")).select("conv_id", "turn", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(31), "text").alias("h2")).join(asked, ["conv_id", "h1", "h2"], "left_semi")
    found = latest_before(asks, answers, ["conv_id", "h1", "h2"])
    best = F.max(F.struct((-F.col("level")).alias("a"), F.col("whole").alias("b"), F.col("size").alias("c"), F.col("found").alias("d")))
    return found.groupBy("conv_id", "turn", "row_key").agg(best.alias("best")).select("conv_id", "turn", "row_key", F.col("best.d").alias("parent"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) from (conv_id, turn, parent), one row for each turn; by pointer jumping.

    A turn whose parent has none is done; only the others look further up in the next round.
    """
    spark, names = links.sparkSession, ["conv_id", "turn", "up", "depth", "open"]
    at = stored(spark, links.select("conv_id", "turn", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("open")), "threads")
    while not at.filter("open").isEmpty():
        above = at.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        moved = at.filter("open").drop("open").join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("open"))
        new = stored(spark, at.filter("not open").unionByName(moved).select(*names), "threads")
        discard(at)
        at = new
    return at.select("conv_id", "turn", F.col("up").alias("thread"), "depth")


def turn_before(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, before): the greatest earlier turn of the conversation, for each turn that has one."""
    turns = messages.select("conv_id", "turn").distinct()
    return latest_before(turns, turns, ["conv_id"]).withColumnRenamed("found", "before")


def conversations(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, thread, depth, turn, parent_turn, quoted (is the parent found by a quote), role, text (without quotes), n_quotes."""
    own = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).cast("string").alias("text"))
    own = parsed(own).withColumn("row_key", F.xxhash64("conv_id", "turn", "role", "text")).drop("text")
    own = stored(messages.sparkSession, own, "parsed")
    usable = own.filter("conv_id is not null and turn is not null")
    keys = ["conv_id", "turn"]
    parent = usable.select(*keys, "row_key").distinct().join(replies(usable), [*keys, "row_key"], "left").join(turn_before(usable), keys, "left")
    parent = stored(messages.sparkSession, parent.select(*keys, "row_key", F.coalesce("parent", "before").alias("parent_turn"), F.col("parent").isNotNull().alias("quoted")).filter("parent_turn is not null"), "replies")
    thread = threads(parent.groupBy(*keys).agg(F.max("parent_turn").alias("parent")))
    out = own.join(parent, [*keys, "row_key"], "left").join(thread, keys, "left")
    return out.select("conv_id", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), "turn", "parent_turn", F.coalesce("quoted", F.lit(False)).alias("quoted"), "role", F.col("own").alias("text"), F.size("quotes").cast("long").alias("n_quotes"))
