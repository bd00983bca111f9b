"""Conversation prefix trie by whole-sequence collapse.

Conversations are rebuilt from their own turns and the first turns of their opening conversation. Every rebuilt turn
carries running sums of hashes of (depth, role, text) in four lanes of 32 bits, so equal prefixes of equal length meet as
one 128-bit key and no sequence is ever held whole. Then:

* identical rebuilt conversations collapse into weighted sequences: the least conv_id stands for all, with their number;
  their ids go sorted, in blocks, through one hasher (the list of ends);
* sequences that are proper prefixes of others drop out by an anti-join; the rest are the leaves;
* the turns of the representatives, weighted, are summed by prefix. A subtree's sums need no walk: what the sequences
  through a node hold from its depth on, by weight, less the bytes of the nodes of the subtree, each counted once in the
  sequence of its least conv_id, which owns a suffix of its own path.

Defined results: a null conv_id is no conversation; null role and text are empty; turns of equal number are ordered by
role, then by the first 64 characters, then by hash, so that equal rows are interchangeable and each counts; remainders
are truncated, as in SQL, so that a negative conv_id opens from the next multiple towards 0; a rebuilt conversation without
turns ends at the root; an empty table gives no node; other columns are not read, whatever their names.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.operators.careers import Run, with_running
from duelframe.session import materialize

from .common import parts, settle

GROUP, MOST, HOT = 5, 9, 200_000
LANES = ("s0", "s1", "s2", "s3")
# Characters of ids that are handed on as one block of a list of ends.
BLOCK = 1 << 16


def _lanes(depth, high, low):
    """Four 32-bit hashes of a turn at its depth; sums of them stay exact over any sequence."""
    out = []
    for k, x in enumerate((F.xxhash64(depth, high, low), F.xxhash64(low, F.lit(7), depth, high))):
        out += [x.bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"t{2 * k}"), F.shiftrightunsigned(x, 32).alias(f"t{2 * k + 1}")]
    return out


def _node(depth, *sums):
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums])))


def ordered_turns(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", hot_rows=HOT) -> DataFrame:
    """(c, pos, high, low, bytes): every turn's position, a 128-bit digest of role and text, and the text's UTF-8 bytes."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), role.alias("role"), F.substring(text, 1, 64).alias("head"),
        F.xxhash64(digest).alias("high"), F.conv(F.substring(digest, 1, 16), 16, -10).cast("long").alias("low"), F.octet_length(text).cast("long").alias("bytes"))
    found = with_running(rows.filter("c is not null"), "c", ["turn", "role", "head", "high", "low"], {"pos": Run("count", inclusive=False)}, hot_rows)
    return found.select("c", "pos", "high", "low", "bytes")


def rebuild(placed: DataFrame, group=GROUP, most=MOST) -> tuple:
    """(conversations, rebuilt turns): c and its number of turns; c, depth (from 1), digest and bytes of every rebuilt turn.

    A conversation c takes the first h turns of c - c % group, h = crc32(c) % most, then its own after its first h."""
    counts = placed.groupBy("c").agg(F.count("*").alias("n"))
    opened = counts.select("c", (F.col("c") - F.col("c") % group).alias("b"), F.pmod(F.crc32(F.col("c").cast("string")), F.lit(most)).alias("h"))
    opened = opened.join(counts.select(F.col("c").alias("b"), "n"), "b", "left")
    opened = materialize(opened.select("c", "b", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("taken")), "trie-convs")
    # At most `group` conversations share an opening and take at most `most` turns of it.
    first = placed.filter((F.col("pos") < most) & (F.col("c") % group == 0)).withColumnRenamed("c", "b")
    lent = first.join(opened.select("b", "c", "taken"), "b").filter("pos < taken").select("c", (F.col("pos") + 1).alias("depth"), "high", "low", "bytes")
    own = placed.join(opened.select("c", "h", "taken"), "c").filter("pos >= h")
    own = own.select("c", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "high", "low", "bytes")
    return opened.select("c"), lent.unionByName(own)


def _ends(batches):
    """Rows sorted by (node, c): blocks of comma-joined ids, with the first id of each."""
    node, first, ids, size = None, None, [], 0

    def block():
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], names=["node", "first", "ids"])

    for batch in batches:
        for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (n != node or size >= BLOCK):
                yield block()
                ids, size = [], 0
            if not ids:
                node, first = n, c
            ids.append(str(c))
            size += len(ids[-1]) + 1
    if ids:
        yield block()


def _hashed(batches):
    """Blocks sorted by (node, first): the SHA-256 of each node's whole list; only the hasher's state is held."""
    node, state = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    for batch in batches:
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if state is None or n != node:
                if state is not None:
                    yield row()
                node, state = n, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state is not None:
        yield row()


def end_lists(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, c): ranges of the sorted ids become blocks in their own tasks, so that the one task
    that must hash a hot node's list reads a few long strings."""
    n = parts(ends.sparkSession)
    blocks = ends.repartitionByRange(n, "node", "c").sortWithinPartitions("node", "c").mapInArrow(_ends, "node binary, first long, ids string")
    return blocks.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, hot_rows=HOT) -> DataFrame:
    """A row for each node of the trie of `convs` (c) with the rebuilt `turns` (c, depth, high, low, bytes)."""
    depth, lanes = F.col("depth"), [f"t{k}" for k in range(4)]
    turns = turns.select("c", "depth", "bytes", *_lanes(depth, F.col("high"), F.col("low")))
    running = {s: Run("sum", F.col(t)) for s, t in zip(LANES, lanes)} | {"upto": Run("sum", F.col("bytes"))}
    paths = with_running(turns, "c", ["depth"], running, hot_rows)
    parent = _node(depth - 1, *[F.col(s) - F.col(t) for s, t in zip(LANES, lanes)])
    paths = materialize(paths.select("c", depth.cast("long").alias("depth"), "bytes", "upto", _node(depth, *map(F.col, LANES)).alias("node"), parent.alias("parent")), "trie-paths")
    root = _node(F.lit(0), *[F.lit(0)] * 4)

    # Whole sequences: the last row of a conversation stands for all of it.
    last = paths.groupBy("c").agg(F.max("depth").alias("length"), F.max_by("node", "depth").alias("node"), F.max("upto").alias("total"))
    zero = F.lit(0).cast("long")
    whole = convs.join(last, "c", "left").select("c", F.coalesce("length", zero).alias("length"), F.coalesce("node", root).alias("node"), F.coalesce("total", zero).alias("total"))
    whole = materialize(whole, "trie-wholes")
    sequences = whole.groupBy("length", "node").agg(F.min("c").alias("rep"), F.count("*").alias("weight"), F.max("total").alias("total"))
    sequences = materialize(sequences, "trie-sequences")
    ends = materialize(end_lists(whole.select("node", "c")), "trie-ends")

    # Leaves: sequences that no other goes on from.
    chosen = sequences.select("rep", "length", "weight", "total")
    steps = paths.join(chosen, F.col("c") == F.col("rep")).select("rep", "length", "weight", "total", "depth", "bytes", "upto", "node", "parent")
    top = chosen.select("*", zero.alias("depth"), zero.alias("bytes"), zero.alias("upto"), root.alias("node"), F.lit(None).cast("binary").alias("parent"))
    steps = materialize(steps.unionByName(top), "trie-steps")
    proper = steps.filter("depth < length").select("node").distinct()
    leaves = sequences.join(proper, "node", "left_anti").select("rep", F.lit(1).cast("long").alias("leaf"))

    steps = steps.join(leaves, "rep", "left").withColumn("rest", F.col("total") - F.col("upto") + F.col("bytes"))
    nodes = steps.groupBy("node").agg(
        F.min("rep").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("bytes").alias("bytes"),
        F.sum("weight").alias("n_convs"), F.sum(F.coalesce("leaf", zero)).alias("n_leaves"), F.sum(F.col("weight") * F.col("rest")).alias("held"))
    nodes = materialize(nodes, "trie-nodes")
    # A representative owns the nodes of its path from some depth on; above it, all it owns lies in the subtree.
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("since"), F.sum("bytes").alias("owns")).withColumnRenamed("conv_id", "rep")
    once = steps.join(owned, "rep", "left")
    once = once.groupBy("node").agg(F.sum(F.when(F.col("depth") >= F.col("since"), F.col("rest")).otherwise(F.coalesce("owns", zero))).alias("single"))
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(once, "node").join(children, "node", "left").join(ends, "node", "left")
    # Last, as many nodes may share a parent and its row is one: what Spark can split.
    found = materialize(found, "trie-found").join(above, "parent", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        (F.col("held") - F.col("single")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))



def conversation_trie(conversations: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", group=GROUP, most=MOST, hot_rows=HOT) -> DataFrame:
    """The trie of a table of turns after rebuilding: a row for each distinct prefix."""
    settle(conversations.sparkSession)
    placed = materialize(ordered_turns(conversations, conv_col, turn_col, role_col, text_col, hot_rows), "trie-turns")
    convs, turns = rebuild(placed, group, most)
    return prefix_trie(convs, turns, hot_rows)
