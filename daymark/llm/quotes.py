"""Quotation linking for conversations, in DataFrame expressions only.

A line's quote level is the number of `>` in the run of blanks and `>` that it begins with.  Passages are lines and whole
paragraphs (neighbouring lines of one level without a blank line between), lower-cased with white space collapsed, and
known by their hash.  A quoted passage belongs to the earliest turn of its conversation that wrote it unquoted, so each
hash has one origin and a common line links nothing twice.  A message replies to the turn from which its shallowest
linked quotes take most characters (ties: the later turn).  Roots and depths follow from the reply links by doubling, and
messages are ordered by the turn of their root and then their own; positions come from counts over ranges, so a
conversation may hold any share of the rows.

The text without quotes leaves out quoted lines and the line `On ... wrote:` that introduces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.llm.text import key
from daymark.operators.ordering import running
from daymark.session import settle

MARK = r"^[ \t>]*>"  # one character class: no recursion in the matcher, however long the run
INTRODUCES = r"(?i)^\s*on\b.*\bwrote:\s*$"
MESSAGE = ["conv_key", "turn", "text_hash"]


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARK, 0), "[^>]", ""))


def _body(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARK, "")), r"\s+", " "))


def _unquoted(lines: Column) -> Column:
    def stays(line: Column, i: Column) -> Column:
        after = F.coalesce(level(F.get(lines, i + 1)), F.lit(0))
        return (level(line) == 0) & ~(line.rlike(INTRODUCES) & (after > 0))

    return F.array_join(F.filter(lines, stays), "\n")


def passages(messages: DataFrame) -> DataFrame:
    """(conv_key, turn, text_hash, level, hash, weight): the lines and paragraphs of every message of the table.

    Messages must not repeat.
    """
    lines = messages.select(*MESSAGE, F.posexplode("lines").alias("pos", "line")).select(
        *MESSAGE, "pos", level(F.col("line")).alias("level"), _body(F.col("line")).alias("body")
    )
    inside = Window.partitionBy(*MESSAGE).orderBy("pos")
    last = F.lag(F.when(F.col("body") != "", F.col("level"))).over(inside)
    starts = F.when(F.coalesce(last == F.col("level"), F.lit(False)), 0).otherwise(1)
    numbered = lines.withColumn("starts", starts).withColumn("part", F.sum("starts").over(inside)).where("body <> ''")
    blocks = (
        numbered.groupBy(*MESSAGE, "level", "part")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "body"))).alias("rows"))
        .where(F.size("rows") > 1)
        .select(*MESSAGE, "level", F.array_join(F.col("rows.body"), " ").alias("body"))
    )
    either = numbered.select(*MESSAGE, "level", "body").unionByName(blocks)
    return either.select(*MESSAGE, "level", F.md5(F.col("body").cast("binary")).alias("hash"), F.length("body").alias("weight"))


def _replies(messages: DataFrame) -> DataFrame:
    """(conv_key, turn, text_hash, reply_to, n_linked) of messages with a linked quote."""
    quoting = settle(messages.where("n_quoted_lines > 0").select("conv_key").distinct())
    # a message counts once, however often its row is repeated
    once = messages.join(quoting, "conv_key", "left_semi").where("turn IS NOT NULL").select(*MESSAGE, "lines").distinct()
    found = settle(passages(once))
    origins = settle(found.where("level = 0").groupBy("conv_key", "hash").agg(F.min("turn").alias("origin")))
    linked = found.where("level > 0").join(origins, ["conv_key", "hash"]).where("origin < turn")
    by_origin = linked.groupBy(*MESSAGE, "level", "origin").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    return by_origin.groupBy(*MESSAGE).agg(
        F.max(F.struct(-F.col("level"), "weight", "origin")).getField("origin").alias("reply_to"), F.sum("n").alias("n_linked")
    )


def _roots(replies: DataFrame) -> DataFrame:
    """(conv_key, turn, root_turn, depth) of turns that reply to another; replies always point to an earlier turn."""
    links = settle(
        replies.groupBy("conv_key", "turn").agg(F.min("reply_to").alias("root_turn")).withColumn("depth", F.lit(1).cast("long"))
    )
    while True:
        up = links.select("conv_key", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        longer = links.join(up, ["conv_key", "root_turn"], "left")
        doubled = settle(
            longer.select(
                "conv_key", "turn", F.coalesce("next", "root_turn").alias("root_turn"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"),
            )
        )
        links = doubled.drop("moved")
        if doubled.where("moved").isEmpty():
            return links


def thread(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Per row: conversation, turn, role, text without quotes, n_quoted_lines, n_linked, reply_to, root_turn, depth, position.

    `n_linked` counts linked quoted passages; `reply_to` is NULL without one.  `position` starts at 0 in each
    conversation; rows that repeat a turn share it.  A NULL text stays NULL and quotes nothing.  Rows with a NULL turn
    neither reply nor are replied to and come first.  NULL conversations form one conversation.  Other columns are not
    read; an empty table gives an empty result.
    """
    text = F.col(text_col)
    lines = F.split(text, "\n")
    read = messages.select(
        F.col(conv_col).alias("conv"),
        key(F.col(conv_col)).alias("conv_key"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("role"),
        F.xxhash64(text).alias("text_hash"),
        lines.alias("lines"),
        F.coalesce(F.size(F.filter(lines, lambda s: level(s) > 0)), F.lit(0)).cast("long").alias("n_quoted_lines"),
        text.alias("whole"),
    )
    own = F.when(F.col("n_quoted_lines") == 0, F.col("whole")).otherwise(F.trim(_unquoted(F.col("lines"))))
    held = settle(read.withColumn("own", own).drop("whole"))
    replies = settle(_replies(held))
    roots = settle(_roots(replies).withColumnRenamed("turn", "reply_turn"))
    rooted = (
        held.drop("lines")
        .join(replies.withColumnRenamed("text_hash", "hash_").withColumnRenamed("turn", "turn_").withColumnRenamed("conv_key", "conv_"),
              (F.col("conv_key") == F.col("conv_")) & (F.col("turn") == F.col("turn_")) & (F.col("text_hash") == F.col("hash_")), "left")
        .drop("conv_", "turn_", "hash_")
        .join(roots.withColumnRenamed("conv_key", "conv_"),
              (F.col("conv_key") == F.col("conv_")) & (F.col("turn") == F.col("reply_turn")) & F.col("reply_to").isNotNull(), "left")
        .withColumn("root_turn", F.coalesce("root_turn", "turn"))
    )
    placed = settle(rooted.drop("conv_", "reply_turn"))
    # before a message stand the smaller roots of its conversation and the earlier turns under its own root
    slots = placed.select(
        "conv_key",
        F.coalesce("root_turn", F.lit(-(2**53))).alias("root"),
        F.coalesce("turn", F.lit(-(2**53))).alias("at"),
    )
    turns = settle(slots.distinct().withColumn("n", F.lit(1).cast("long")))
    of_root = settle(turns.groupBy("conv_key", "root").agg(F.sum("n").alias("n")))
    smaller = settle(running(of_root, "root", ["n"], by=["conv_key"]).select("conv_key", "root", F.col("n_before").alias("base")))
    earlier = settle(running(turns, "at", ["n"], by=["conv_key", "root"]).select("conv_key", "root", "at", F.col("n_before").alias("more")))
    position = settle(
        earlier.join(smaller, ["conv_key", "root"]).select("conv_key", "root", "at", (F.col("base") + F.col("more")).alias("position"))
    )
    return (
        placed.withColumns({"root": F.coalesce("root_turn", F.lit(-(2**53))), "at": F.coalesce("turn", F.lit(-(2**53)))})
        .join(position, ["conv_key", "root", "at"])
        .select(
            F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("own").alias(text_col),
            "n_quoted_lines", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to", "root_turn",
            F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "position",
        )
    )
