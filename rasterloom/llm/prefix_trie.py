"""The trie of all conversation prefixes, by preorder intervals.

1. Turns are numbered within their conversations by distributed prefix sums: a range sort deals the rows to
   tasks, each task sums what it streams, and what earlier tasks hold of the same key is added from a table
   of one row a task.  So a conversation may hold any share of all rows.
2. A prefix is named by its depth and the XOR of 128-bit hashes of its turns, each hashed with its place;
   running XORs come from the same distributed sums.
3. Conversations are ranked lexicographically by their turns' hashes: blocks of ``BLOCK`` turns are ranked,
   then blocks of ``BLOCK`` ranks, until one is left, so no key grows with a conversation.
4. A node's members hold an interval of ranks.  Nodes in the order of (first rank, depth) are in preorder;
   a subtree ends at the last node whose first rank is the node's last one.  Leaves and savings of a
   subtree are differences of prefix sums in that order.

Defined results: rows without a conv_id take no part.  Turns of equal number lie by role, then text.  A
missing role or text is empty.  Negative ids use the remainder that is never negative.  An empty table gives
no nodes.  Extra columns are ignored.  A node's ``ends_sha256`` is one hash over a list, which is sequential
by definition: it streams through one task in strings of the ids of a span of ``SPAN`` numbers, and is never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import discard, written

#: turns, or ranks, that one key of the lexicographic ranking takes
BLOCK = 64
#: numbers that the ids of one string of ends are from
SPAN = 4_096


# ---- distributed prefix sums -------------------------------------------------------------


def running(rows: DataFrame, key: str | None, order: list[Column | str], sums: dict[str, str], xors: dict[str, str], keep: list[str]) -> DataFrame:
    """``keep`` of ``rows`` with running sums and XORs within each ``key``, or over all rows, in ``order``.

    ``sums`` and ``xors`` give a new column's source; sources are longs and never null.
    """
    of = F.col(key) if key else F.lit(0).cast("long")
    names = [*sums, *xors]
    sources = [*sums.values(), *xors.values()]
    sorted_ = rows.withColumn("__key", of).repartitionByRange("__key", *order).sortWithinPartitions("__key", *order)
    fed = sorted_.select(*keep, "__key", *[F.col(s).alias(f"__{n}") for n, s in zip(names, sources, strict=True)], F.spark_partition_id().alias("__part"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema), "__key long, __part int, __at long", *(f"`{n}` long" for n in names)])
    n_sums = len(sums)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried, at = None, np.zeros(len(names), np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("__key").to_numpy(zero_copy_only=False)
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            new[0] = last is None or keys[0] != last
            start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
            out = []
            for i, name in enumerate(names):
                v = batch.column(f"__{name}").to_numpy(zero_copy_only=False)
                if i < n_sums:
                    total = np.concatenate([[0], np.cumsum(v)])
                    got = total[1:] - total[np.maximum(start, 0)] + np.where(start < 0, carried[i], 0)
                else:
                    total = np.concatenate([np.zeros(1, np.int64), np.bitwise_xor.accumulate(v)])
                    got = total[1:] ^ total[np.maximum(start, 0)] ^ np.where(start < 0, carried[i], 0)
                carried[i] = got[-1]
                out.append(pa.array(got, pa.int64()))
            last = keys[-1]
            columns = [batch.column(k) for k in keep] + [batch.column("__key"), batch.column("__part"), pa.array(np.arange(at, at + len(keys)), pa.int64()), *out]
            at += len(keys)
            yield pa.RecordBatch.from_arrays(columns, [*keep, "__key", "__part", "__at", *names])

    local = written(fed.mapInArrow(summed, schema), "running")
    # one row a task; of the keys before a task's first one only the last of each task can go on into it
    tasks = local.groupBy("__part").agg(F.min("__key").alias("from"), F.max("__key").alias("to"), F.max_by(F.struct(*names), "__at").alias("tail"))
    before = W.partitionBy("to").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    joined = {n: (F.sum if i < n_sums else F.bit_xor) for i, n in enumerate(names)}
    within = tasks.select("__part", "from", "to", *[f(F.col(f"tail.{n}")).over(before).alias(f"in_{n}") for n, f in joined.items()])
    whole = tasks.groupBy(F.col("to").alias("of")).agg(*[f(F.col(f"tail.{n}")).alias(f"all_{n}") for n, f in joined.items()])
    carry = within.join(whole, within["from"] == whole["of"], "left")
    carry = carry.select("__part", F.col("from").alias("__key"), *[F.coalesce(F.when(F.col("from") == F.col("to"), F.col(f"in_{n}")).otherwise(F.col(f"all_{n}")), F.lit(0)).alias(f"c_{n}") for n in names])
    met = local.join(carry, ["__part", "__key"], "left")
    added = [(F.col(n) + F.coalesce(f"c_{n}", F.lit(0)) if i < n_sums else F.col(n).bitwiseXOR(F.coalesce(f"c_{n}", F.lit(0)))).alias(n) for i, n in enumerate(names)]
    return met.select(*keep, *added)


def lexicographic_ranks(keys: DataFrame) -> DataFrame:
    """(key, rank): the place of each distinct ``key`` from 1, in the order of ``key``."""
    return running(keys.select("key").distinct().withColumn("one", F.lit(1).cast("long")), None, ["key"], {"rank": "one"}, {}, ["key"])


# ---- conversations -----------------------------------------------------------------------


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, s1, s2, bytes): turns numbered from 1, named by two hashes."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", F.lit(1).cast("long").alias("one"), F.xxhash64("role", "text").alias("s1"), F.xxhash64(F.lit("second"), "role", "text").alias("s2"), F.octet_length("text").cast("long").alias("bytes"))
    return running(rows, "conv", [F.asc_nulls_first("turn"), "role", "text"], {"pos": "one"}, {}, ["conv", "s1", "s2", "bytes"])


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) where conversation c begins with the first turns of conversation c - c % ``every``.

    It takes crc32(c) % ``most`` turns of that one (all if fewer) in place of as many of its own.
    """
    sizes = written(turns.groupBy("conv").agg(F.max("pos").alias("n")), "sizes")
    c = F.col("conv")
    plans = sizes.select("conv", "n", (F.crc32(c.cast("string").cast("binary")) % most).alias("h"), (c - F.pmod(c, F.lit(every))).alias("base"))
    lent = F.least("h", F.coalesce("m", F.lit(0)))
    plans = plans.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("m")), "base", "left").select("conv", "base", "h", lent.alias("lent"), (lent + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    plans = written(plans, "plans")
    named = ["s1", "s2", "bytes"]
    own = turns.join(plans.select("conv", "h", "lent"), "conv").where("pos > h").select("conv", (F.col("lent") + F.col("pos") - F.col("h")).alias("pos"), *named)
    heads = turns.where(F.col("pos") < most).withColumnRenamed("conv", "base")  # a few turns of each conversation
    taken = heads.join(plans.select("conv", "base", "h").where("h > 0"), "base").where("pos <= h").select("conv", "pos", *named)
    return own.unionByName(taken), plans.select("conv", "length")


def conversation_ranks(turns: DataFrame) -> DataFrame:
    """(conv, rank): the lexicographic place, by turns' hashes, of each conversation that has turns; equal ones share it."""
    symbol = F.unhex(F.concat(*[F.lpad(F.hex(s), 16, "0") for s in ("s1", "s2")]))
    rows = turns.select("conv", (F.col("pos") - 1).alias("at"), symbol.alias("symbol"))
    while True:
        blocks = rows.groupBy("conv", F.floor(F.col("at") / BLOCK).alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "symbol"))).alias("s"))  # BLOCK at most
        keyed = written(blocks.select("conv", "at", F.array_join(F.transform("s", lambda x: F.hex(x["symbol"])), "").alias("key")), "blocks")
        ranked = written(keyed.join(lexicographic_ranks(keyed), "key").select("conv", "at", "rank"), "ranks")
        discard(keyed)
        if not ranked.where("at > 0").limit(1).count():
            return ranked.select("conv", "rank")
        rows = ranked.select("conv", "at", F.unhex(F.lpad(F.hex("rank"), 16, "0")).alias("symbol"))


def hashed_ends(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the hash of the comma-joined ids, ascending, of ``ends(node, conv)``."""
    strings = ends.groupBy("node", F.floor(F.col("conv") / SPAN).alias("span")).agg(F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("ids"))  # SPAN ids at most

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for at, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if at != node:
                    if sha is not None:
                        done.append((node, sha.hexdigest()))
                    node, sha = at, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.int64()), pa.array([s for _, s in done], pa.string())], ["node", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([sha.hexdigest()], pa.string())], ["node", "ends_sha256"])

    return strings.repartition("node").sortWithinPartitions("node", "span").select("node", "ids").mapInArrow(hashed, "node long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of ``turns(conv, pos, s1, s2, bytes)`` of ``conversations(conv, length)``; see the module's docstring.

    Returns node (its place in preorder, from 1), end (the last place of its subtree), conv_id (least
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    named = turns.select("*", F.xxhash64("pos", "s1", "s2").alias("m1"), F.xxhash64("s2", "pos", "s1").alias("m2"))
    paths = running(named, "conv", ["pos"], {}, {"x1": "m1", "x2": "m2"}, ["conv", "pos", "m1", "m2", "bytes"])
    paths = written(paths.join(conversation_ranks(turns), "conv"), "paths")
    grouped = paths.groupBy(F.col("pos").alias("depth"), "x1", "x2").agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.min("rank").alias("low"), F.max("rank").alias("high"),
        F.first(F.col("x1").bitwiseXOR(F.col("m1"))).alias("p1"), F.first(F.col("x2").bitwiseXOR(F.col("m2"))).alias("p2"),
    )
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    whole = conversations.select("conv", none.alias("rank")).unionByName(paths.select(none.alias("conv"), "rank")).agg(F.min("conv").alias("conv_id"), F.count("conv").alias("n_convs"), F.max("rank").alias("high"))
    top = whole.where("n_convs > 0").select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id", "n_convs", zero.alias("bytes"), zero.alias("low"), F.coalesce("high", zero).alias("high"), none.alias("p1"), none.alias("p2"))
    nodes = written(grouped.unionByName(top), "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(above, ["depth", "p1", "p2"], "left").join(children, ["depth", "x1", "x2"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    nodes = nodes.select("*", F.lit(1).cast("long").alias("one"), (F.col("n_children") == 0).cast("long").alias("leaf"), saved.alias("saved"))
    columns = ["conv_id", "depth", "x1", "x2", "parent_conv_id", "n_convs", "n_children", "low", "high", "leaf", "saved"]
    placed = written(running(nodes, None, ["low", "depth"], {"node": "one", "leaves": "leaf", "savings": "saved"}, {}, columns), "placed")
    ends = placed.groupBy(F.col("low").alias("high")).agg(F.max("node").alias("end"), F.max("leaves").alias("end_leaves"), F.max("savings").alias("end_savings"))
    counted = placed.join(ends, "high").select(
        "node", "end", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("end_leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"), (F.col("end_savings") - F.col("savings") + F.col("saved")).alias("saved_tokens"),
    )
    stops = conversations.where("length = 0").select("conv", F.lit(1).cast("long").alias("node"))  # the root is the first
    last = paths.join(conversations.select("conv", F.col("length").alias("pos")), ["conv", "pos"]).select("conv", F.col("pos").alias("depth"), "x1", "x2")
    stops = stops.unionByName(last.join(placed.select("depth", "x1", "x2", "node"), ["depth", "x1", "x2"]).select("conv", "node"))
    return counted.join(hashed_ends(stops), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``conversations(conv_id, turn, role, text)``."""
    turns, plans = rebuilt(written(numbered_turns(conversations), "turns"))
    return prefix_trie(written(turns, "rebuilt"), plans)
