"""Quotation linking: replies find the messages they quote, with DataFrame functions only.

A line's quote level is the number of ``>`` marks it begins with.  In each message, runs
of lines of one level, cut at blank lines, are passages; a passage is normalised (lower
case, white space to one space) and hashed.  Own passages (level 0), and each message's
whole own text, are originals.  A quoted passage links to the first earlier original of
the same hash in its conversation, else to the first earlier one anywhere; *earlier*
is by (conv_id, turn), so links have no cycles.  A message's parent is the original that
most of its shallowest linked passages name (ties: the least).

Originals are reduced to the first per hash, and per hash and conversation, before
any join, so a phrase that a third of all messages quote or say joins one row.

Result, a row per message: its text without quotes (and without an attribution line
``On ... wrote:`` before one), the parent, the depth and the reply path.  Sorted by
(thread_id, reply_path) the rows are the conversations in reply order: every reply after
its original, siblings by (conv_id, turn).  A thread is a conversation, or several that
quotations connect (the least conv_id names it).

Defined results: null texts have no lines and stay null; empty ones stay empty.  Messages
without conv_id or turn link to nothing, are no originals and have no reply path.  Repeated rows stay repeated; rows
that repeat (conv_id, turn) with another text count as originals of their own.  An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.components import component_labels
from .scratch import written

_MARK = r"^(?:[ \t]*>)+[ \t]?"
_HAS = r"(?:^|\n)[ \t]*>"
_BLANK = r"^[\s>]*$"
_SAID = r"^\s*On .*wrote:\s*$"


def normalised(text: Column) -> Column:
    """Lower case, white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def quote_lines(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, sum, i, level, body): the lines of messages that quote anything."""
    lines = messages.where(F.col("text").rlike(_HAS)).select("conv_id", "turn", "sum", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    mark = F.regexp_extract("line", _MARK, 0)
    return lines.select("conv_id", "turn", "sum", "i", F.length(F.regexp_replace(mark, "[^>]", "")).alias("level"), F.expr(f"substring(line, length(regexp_extract(line, r'{_MARK}', 0)) + 1)").alias("body"), "line")


def _hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def link_quotes(conversations: DataFrame) -> DataFrame:
    """A row per message; see the module's text for the columns."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("sum", F.xxhash64("text"))
    key = ["conv_id", "turn", "sum"]
    messages = rows.where("conv_id is not null and turn is not null").select(*key, "text")
    lines = quote_lines(messages).distinct()

    message = W.partitionBy(*key).orderBy("i")
    marked = lines.withColumn("said", (F.col("level") == 0) & F.col("line").rlike(_SAID) & (F.lead("level", 1, 0).over(message) > 0))
    own = marked.groupBy(*key).agg(F.sort_array(F.collect_list(F.when((F.col("level") == 0) & ~F.col("said"), F.struct("i", "line")))).alias("l"), F.sum((F.col("level") > 0).cast("long")).alias("n_lines"))
    own = own.select(*key, F.trim(F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), r"\n[ \t]*(?:\n[ \t]*)+", "\n\n")).alias("own"))
    own = own.withColumn("own", F.regexp_replace("own", r"^\s+|\s+$", ""))
    # a passage begins where the level changes or after a blank line
    blank = F.col("body").rlike(_BLANK)
    cut = marked.withColumn("new", (F.col("level") != F.lag("level", 1, -1).over(message)) | F.lag(blank, 1, True).over(message))
    cut = cut.withColumn("part", F.sum(F.col("new").cast("int")).over(message)).where((F.col("level") > 0) & ~blank)
    quoted = cut.groupBy(*key, "part", "level").agg(F.sort_array(F.collect_list(F.struct("i", "body"))).alias("l"))
    quoted = quoted.select(*key, "part", "level", _hash(normalised(F.array_join(F.transform("l", lambda x: x["body"]), " "))).alias("h"))
    quoted = written(quoted, "quoted")
    own = written(own, "own-text")

    # originals: only those whose hash is quoted at all
    said = messages.join(own, key, "left").select("conv_id", "turn", F.coalesce("own", "text").alias("own"))
    pieces = said.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(F.concat(F.split("own", r"\n[ \t]*\n"), F.array("own")), normalised))).alias("p")).where("p != ''")
    wanted = quoted.select("h").distinct()
    originals = pieces.select("conv_id", "turn", _hash(F.col("p")).alias("h")).join(wanted, "h", "left_semi")
    inside = written(originals.groupBy("h", "conv_id").agg(F.min("turn").alias("first_turn")), "originals")
    first = inside.groupBy("h").agg(F.min(F.struct(F.col("conv_id").alias("c"), F.col("first_turn").alias("t"))).alias("first"))
    first = written(first, "first-originals")  # so that the join can split a hot passage

    at = F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    linked = quoted.join(inside, ["h", "conv_id"], "left").join(first, "h", "left")
    found = F.when(F.col("first_turn") < F.col("turn"), F.struct(F.col("conv_id").alias("c"), F.col("first_turn").alias("t"))).when(F.col("first") < at, F.col("first"))
    linked = written(linked.select(*key, "part", "level", found.alias("to")), "linked")
    counts = linked.groupBy(*key).agg(F.count("*").alias("n_quotes"), F.count("to").alias("n_linked"), F.min(F.when(F.col("to").isNotNull(), F.col("level"))).alias("shallow"))
    votes = linked.where("to is not null").join(counts.select(*key, "shallow"), key).where("level = shallow").groupBy(*key, "to").agg(F.count("*").alias("votes"))
    parents = votes.groupBy(*key).agg(F.min(F.struct((-F.col("votes")).alias("v"), "to")).alias("best")).select(*key, F.col("best.to.c").alias("parent_conv"), F.col("best.to.t").alias("parent_turn"))

    links = written(parents, "parents")
    edges = links.where("parent_conv != conv_id").select(F.col("conv_id").alias("a"), F.col("parent_conv").alias("b"))
    paths = _paths(links)
    out = rows.join(own, key, "left").join(counts.drop("shallow"), key, "left").join(links, key, "left").join(paths, ["conv_id", "turn"], "left")
    if edges.limit(1).count():
        threads = component_labels(edges, lambda df: written(df, "threads"))
        out = out.join(threads.select(F.col("id").alias("conv_id"), F.col("label").alias("thread_id")), "conv_id", "left").withColumn("thread_id", F.coalesce("thread_id", "conv_id"))
    else:
        out = out.withColumn("thread_id", F.col("conv_id"))
    zero = F.lit(0).cast("long")
    self_ = F.array(F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t")))
    path = F.coalesce("path", self_)
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce("own", "text").alias("text"),
        F.coalesce("n_quotes", zero).alias("n_quotes"),
        F.coalesce("n_linked", zero).alias("n_linked"),
        "parent_conv",
        "parent_turn",
        "thread_id",
        (F.size(path) - 1).cast("long").alias("depth"),
        F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.array_join(F.transform(path, lambda s: F.format_string("%020d.%020d", s["c"], s["t"])), "/")).alias("reply_path"),
    )


def _paths(links: DataFrame) -> DataFrame:
    """(conv_id, turn, path): the chain of (c, t) from the first original, for messages with a parent.

    Each round joins the chain known so far to the chain of its first element, so depth d takes log2(d) rounds.
    """
    step = F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    up = F.struct(F.col("parent_conv").alias("c"), F.col("parent_turn").alias("t"))
    paths = links.groupBy("conv_id", "turn").agg(F.min(F.array(up, step)).alias("path"))
    while True:
        paths = written(paths, "paths")
        head = paths.select(F.col("conv_id").alias("hc"), F.col("turn").alias("ht"), F.col("path").alias("before"))
        first = F.element_at("path", 1)
        longer = paths.withColumn("c0", first["c"]).withColumn("t0", first["t"]).join(head, (F.col("c0") == F.col("hc")) & (F.col("t0") == F.col("ht")), "left")
        if not longer.where("before is not null").limit(1).count():
            return paths
        paths = longer.select("conv_id", "turn", F.when(F.col("before").isNotNull(), F.concat("before", F.slice("path", 2, F.size("path")))).otherwise(F.col("path")).alias("path"))


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """:func:`link_quotes`, sorted across partitions into reply order."""
    return link_quotes(conversations).orderBy("thread_id", "reply_path")
