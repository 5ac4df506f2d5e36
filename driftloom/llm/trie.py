"""The prefix trie of conversations, level by level.

A turn is known by the SHA-256 of its role and text.  At every depth the live conversations, those
that share their node with others and have a turn left, are grouped by (node, next turn); a group is a
child node and is named by its smallest conversation.  A conversation that is alone in a node stops being live: what
follows is a chain of its own, which is read off its turns without any grouping.  Rounds carry ids and digests but no texts.

Spark runs a round for each level of the large nodes.  As soon as a node has no more than ``MEMBERS`` members, with no more than ``SUBTREE`` turns left, all
that is below it is built in one task, level by level likewise; so the rounds are as many as large nodes are deep.

Then the shared nodes are rolled up from the deepest level to the root: each level joins the sums of the one below.

A level is written to the shared folder, so a lost executor repeats a level and not the trie.  Groups are aggregated with map-side
combine and joined back, so that a first turn that very many conversations share isn't one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.plans.lineage import cut

#: Members of a node, and their turns below it, that one task builds the subtree of.
MEMBERS, SUBTREE = 32, 10_000
#: Bits of an id that conversations of one segment may differ in: a segment is hashed as one string.
SEGMENT = 12
#: Levels after which the turns of live conversations are written anew, so that later levels read no others.
SWEEP = 8
#: Characters of a text that ranges are cut by.
PREFIX = 32

_PART = 33  # the bits below a partition's number in monotonically_increasing_id


def ordered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth, key, n_bytes): the turns of each conversation numbered from 1, with the digest of role and text and the text's bytes.

    Turns are ordered by ``turn``, null first, then by role and text.  Null roles and texts are ''; rows with a null id
    are left out; equal rows are turns of their own.  Rows are dealt by ranges of that order, so that one
    conversation may have any part of them.
    """
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), plain(role_col).alias("role"), plain(text_col).alias("text")).where("conv_id IS NOT NULL")
    ranged = rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, PREFIX), F.substring("text", 1, PREFIX)).sortWithinPartitions("conv_id", "turn", "role", "text")
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("role").cast("binary"), F.col("text").cast("binary")), 256))
    numbered = cut(ranged.select("conv_id", key.alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("at")))
    numbered = numbered.withColumn("part", F.shiftright("at", _PART))
    sizes = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("conv_id", "part", (F.coalesce(earlier, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return numbered.join(sizes, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("depth"), "key", "n_bytes")


def lengths(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of numbered turns."""
    return turns.groupBy("conv_id").agg(F.max("depth").alias("n_turns"))


def with_openings(turns: DataFrame, base: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): each conversation with its first ``taken`` turns, ``most`` at most, replaced by the first ``taken`` of the conversation ``base``.

    Both are columns over ``conv_id``.  Where the other has fewer turns all of them are taken, where it
    doesn't exist none.  A conversation may end up without turns; (conv_id) has all of them.
    """
    own = cut(lengths(turns))
    plan = own.select("conv_id", base.alias("base"), taken.alias("taken"))
    opening = turns.where(F.col("depth") <= most).withColumnRenamed("conv_id", "base").join(plan, "base").where("depth <= taken").select("conv_id", "depth", "key", "n_bytes")
    shift = F.least("taken", F.coalesce("n_turns", F.lit(0))) - F.col("taken")
    plan = plan.join(own.withColumnRenamed("conv_id", "base"), "base", "left").select("conv_id", "taken", shift.alias("shift"))
    rest = turns.join(plan, "conv_id").where("depth > taken").select("conv_id", (F.col("depth") + F.col("shift")).alias("depth"), "key", "n_bytes")
    return own.select("conv_id"), cut(opening.unionByName(rest))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the comma-joined strings of each (depth, conv_id), whose rows follow each other in order."""
    last, digest = None, None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        depth, conv, text = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(conv, pa.int64()), pa.array(text, pa.string())], names=["depth", "conv_id", "ends_sha256"])

    for batch in batches:
        done = []
        for depth, node, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if (depth, node) != last:
                if digest:
                    done.append((*last, digest.hexdigest()))
                last, digest = (depth, node), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield out(done)
    if digest:
        yield out([(*last, digest.hexdigest())])


def _ends(ended: DataFrame) -> DataFrame:
    """(depth, conv_id, ends_sha256) of the nodes in ``ended(conv_id, depth, node)``.

    The ids of a segment are joined to one string where they lie; the digest of a node reads the strings one after the other.
    """
    segments = ended.groupBy("depth", "node", F.shiftright("conv_id", SEGMENT).alias("segment")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    joined = segments.select("depth", "node", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "segment")
    ordered = joined.repartition("depth", "node").sortWithinPartitions("depth", "node", "segment").drop("segment")
    return ordered.mapInArrow(_hashed, "depth long, conv_id long, ends_sha256 string")


_BELOW = "kind string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, longest long"


def _subtree(key: tuple, table: pa.Table) -> pa.Table:
    """All below one node, of rows (node, conv_id, n_turns, at, depth, key, n_bytes), ``at`` the node's depth.

    Rows of kind ``node`` are the nodes that more than one conversation reaches or that one is first alone in; ``end`` is a conversation that
    ends in company, in the node ``parent_conv_id``; ``alone`` has in ``depth`` from where on a conversation is, and its turns in ``longest``.
    """
    top, at = key[0].as_py(), table.column("at")[0].as_py()
    turns: dict[int, dict[int, tuple[bytes, int]]] = {}
    last: dict[int, int] = {}
    for conv, n, depth, digest, size in zip(*(table.column(c).to_pylist() for c in ("conv_id", "n_turns", "depth", "key", "n_bytes")), strict=True):
        turns.setdefault(conv, {})[depth] = digest, size
        last[conv] = n
    levels: list[list[list]] = []
    rows: list[tuple] = []
    live, depth = dict.fromkeys(turns, top), at
    while live:
        depth += 1
        groups: dict[tuple[int, bytes], list[int]] = {}
        for conv, node in live.items():
            groups.setdefault((node, turns[conv][depth][0]), []).append(conv)
        live, level = {}, []
        for (node, _), members in groups.items():
            child = min(members)
            # name, parent, members, bytes, longest, children, leaves, saved
            level.append([child, node, len(members), turns[child][depth][1], max(last[m] for m in members), 0, 0, 0])
            if len(members) == 1:
                rows.append(("alone", child, depth, None, None, None, None, None, last[child]))
                continue
            for m in members:
                if last[m] == depth:
                    rows.append(("end", m, depth, child, None, None, None, None, None))
                else:
                    live[m] = child
        levels.append(level)
    for k in range(len(levels) - 1, -1, -1):
        named = {node[0]: node for node in levels[k - 1]} if k else {}
        for node in levels[k]:
            child, parent, n, size, longest, children, leaves, saved = node
            if n == 1:
                children = int(longest > at + 1 + k)
            leaves, saved = max(leaves, 1), saved + (n - 1) * size
            rows.append(("node", child, at + 1 + k, parent, n, children, leaves, saved, longest))
            if k:
                above = named[parent]
                above[5:] = above[5] + 1, above[6] + leaves, above[7] + saved
    columns = zip(*rows, strict=True)
    names = [c.split()[0] for c in _BELOW.split(", ")]
    return pa.table([pa.array(c, pa.string() if name == "kind" else pa.int64()) for c, name in zip(columns, names, strict=True)], names=names)


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node.

    ``convs(conv_id)`` has distinct ids, ``turns(conv_id, depth, key, n_bytes)`` their turns, depths from 1 without gaps.
    A node is a distinct sequence of first turns and is named by its depth and smallest member; the root, of depth 0, has every
    conversation, also those without turns.  ``saved_tokens`` sums (members - 1) times the bytes of the
    last text over a node's subtree; ``ends_sha256`` is the digest of the members that end there.

    Equal conversations share all their nodes, whatever their number.  No conversation gives no node.
    """
    spark = convs.sparkSession
    every = cut(convs.join(lengths(turns), "conv_id", "left").select("conv_id", F.coalesce("n_turns", F.lit(0)).cast("long").alias("n_turns")))
    count, root, longest, total = every.agg(F.count("*"), F.min("conv_id"), F.max("n_turns"), F.sum("n_turns")).first()
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not count:
        return spark.createDataFrame([], schema)
    levels = [spark.createDataFrame([(root, None, count, 0, longest)], "conv_id long, parent_conv_id long, n_convs long, n_bytes long, longest long")]
    depth = F.lit(0).cast("long")
    # (conv_id, node, depth): where a conversation ends in company, and (conv_id, n_turns, from): from where on it is alone
    shared = every.withColumns({"node": F.lit(root), "n_convs": F.lit(count), "rest": F.lit(total).cast("long")})
    ended = [shared.where("n_turns = 0" if count > 1 else "false").select("conv_id", "node", depth.alias("depth"))]
    alone = [every.where("false" if count > 1 else "true").select("conv_id", "n_turns", depth.alias("from"))]
    going = shared.where("n_turns > 0" if count > 1 else "false").select("conv_id", "n_turns", "node", "n_convs", "rest")
    subtrees: dict[int, DataFrame] = {}  # by the depth of their highest nodes
    left, d = turns, 0
    while True:
        few = (F.col("n_convs") <= MEMBERS) & (F.col("rest") <= SUBTREE)
        small, live = going.where(few).drop("n_convs", "rest"), going.where(~few).drop("n_convs", "rest")
        if not small.isEmpty():
            rows = small.withColumn("at", F.lit(d).cast("long")).join(left.where(F.col("depth") > d), "conv_id")
            below = cut(rows.groupBy("node").applyInArrow(_subtree, _BELOW))
            subtrees[d + 1] = below.where("kind = 'node'").drop("kind")
            ended.append(below.where("kind = 'end'").select("conv_id", F.col("parent_conv_id").alias("node"), "depth"))
            alone.append(below.where("kind = 'alone'").select("conv_id", F.col("longest").alias("n_turns"), F.col("depth").alias("from")))
        if live.isEmpty():
            break
        d += 1
        depth = F.lit(d).cast("long")
        step = cut(live.join(left.where(F.col("depth") == d), "conv_id").select("conv_id", "n_turns", "node", "key", "n_bytes"), count)
        groups = step.groupBy(F.col("node").alias("parent_conv_id"), "key").agg(
            F.min("conv_id").alias("child"), F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes"), F.max("n_turns").alias("longest"), F.sum(F.col("n_turns") - d).alias("rest")
        )
        groups = cut(groups, count)
        levels.append(groups.select(F.col("child").alias("conv_id"), "parent_conv_id", "n_convs", "n_bytes", "longest"))
        placed = step.join(groups.select(F.col("parent_conv_id").alias("node"), "key", "child", "n_convs", "rest"), ["node", "key"])
        placed = cut(placed.select("conv_id", "n_turns", F.col("child").alias("node"), "n_convs", "rest"), count)
        shared = placed.where("n_convs > 1")
        ended.append(shared.where(F.col("n_turns") == d).select("conv_id", "node", depth.alias("depth")))
        alone.append(placed.where("n_convs = 1").select("conv_id", "n_turns", depth.alias("from")))
        going = shared.where(F.col("n_turns") > d).select("conv_id", "n_turns", "node", "n_convs", "rest")
        if d % SWEEP == 0:
            left = cut(left.where(F.col("depth") > d).join(going.select("conv_id"), "conv_id", "left_semi"))

    # from the deepest level up; the nodes below one were built by rounds or in a task
    nodes, below = list(subtrees.values()), subtrees.get(len(levels))
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k].withColumn("depth", F.lit(k).cast("long"))
        if below is None:
            level = level.withColumns({c: F.lit(None).cast("long") for c in ("children", "leaves", "saved")})
        else:
            sums = below.where(F.col("depth") == k + 1).groupBy(F.col("parent_conv_id").alias("conv_id"))
            sums = sums.agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            level = level.join(sums, "conv_id", "left")
        # a node of one conversation has its chain below it
        chain = F.when((F.col("n_convs") == 1) & (F.col("longest") > k), 1).otherwise(0)
        rolled = level.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("children", chain).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("n_bytes") + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"), "longest",
        )
        below = cut(rolled, count)
        nodes.append(below)
        if k in subtrees:
            below = below.unionByName(subtrees[k])

    def union(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)

    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    chains = turns.join(union(alone), "conv_id").where(F.col("depth") > F.col("from")).withColumnRenamed("n_turns", "longest")
    chains = chains.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (F.col("depth") < F.col("longest")).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), "longest")
    made = union(nodes).join(_ends(union(ended)), ["depth", "conv_id"], "left").unionByName(chains, allowMissingColumns=True)
    # a node of one conversation is where that one ends, or nobody does
    own = F.when((F.col("n_convs") == 1) & (F.col("depth") == F.col("longest")), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256))
    ends = F.coalesce("ends_sha256", own, F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    return made.select(*[c.split()[0] for c in schema.split(", ")[:-1]], ends)
