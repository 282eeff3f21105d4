"""Conversation prefix trie by leaf-peeling message passing.

Every distinct sequence of first turns is a node. A node's name is the XOR of 64-bit hashes, in two lanes, of each turn
with its place: a running aggregate along each conversation, so that prefixes are named where they stand, equal prefixes
are named alike everywhere, and a node's parent's name is the name without its last turn. Texts are not shuffled beyond
the sort of each conversation.

Peeling: each node holds a counter of children still to come and its totals so far. Nodes whose counter is zero are
complete: they are written out and send their totals to their parents, added up by parent before the shuffle; those
parents count down, until only the root is left and finishes. Each round reads the nodes left from files in the shared
folder. Nodes with one child only pass things on, so runs of them are contracted first, by pointer doubling up to the
next node with several children: rounds follow the branchings on a path and not the turns of the longest conversation.

Skew: members and messages are counted and added up in each task before the shuffle; children of a node with very many
learn of it through a broadcast of the hot ones (`components.lookup`). Members that end at a node are hashed in order of
their numbers: sorted ranges, which split large nodes, join their part of the numbers into pieces, and a node's pieces
are hashed as a stream. No list of a node's members is ever held.

Cases: null roles and texts count as empty; turns are ordered by number, null first, then by role and text. Rows without
a conversation's number belong to none and are left out. Repeated rows are turns of their own. Members without any turn
are members of the root. An empty table gives an empty result; other columns are ignored, whatever their names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import col, written
from .components import lookup

#: Conversations are rebuilt upon the first of each so many, of whose turns they take fewer than so many.
EVERY, TURNS = 5, 9
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _ordered(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(c, i, role, text): turns numbered from 1 in each conversation."""
    text = lambda name: F.coalesce(col(name).cast("string"), F.lit(""))
    rows = turns.where(col(id_col).isNotNull()).select(col(id_col).alias("c"), col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    w = Window.partitionBy("c").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return rows.select("c", F.row_number().over(w).alias("i"), "role", "text")


def rebuilt(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, members): conversation c is the first h turns of conversation c - c % EVERY, if there is one, and then c's own
    after its first h; h: the CRC-32 of c in decimals, modulo TURNS (% keeps
    the sign, as in SQL). Turns as (conv_id, turn, role, text), and all c, also those
    left without a turn, as conv_id."""
    own = _ordered(turns, id_col, turn_col, role_col, text_col)
    taken = F.crc32(F.col("c").cast("string")) % TURNS
    members = written(own.select("c").distinct().select("c", taken.alias("h"), (F.col("c") - F.col("c") % EVERY).alias("base")), "members")
    heads = own.where(F.col("i") < TURNS).withColumnRenamed("c", "base").join(members, "base").where("i <= h").select("c", "i", "role", "text")
    tails = own.where(F.col("i") > taken)
    return heads.unionByName(tails).toDF("conv_id", "turn", "role", "text"), members.select(F.col("c").alias("conv_id"))


def _names(turns: DataFrame) -> DataFrame:
    """turns: (c, i, role, text). -> (c, depth, node, parent, bytes, last): the prefix that ends with each turn."""
    w = Window.partitionBy("c").orderBy("i")
    lanes = [F.xxhash64(F.lit(lane), "i", "role", "text") for lane in (1, 2)]
    rows = turns.select("c", "i", F.octet_length("text").cast("long").alias("bytes"), *(x.alias(f"x{k}") for k, x in enumerate(lanes)))
    rows = rows.select("c", F.col("i").cast("long").alias("depth"), "bytes", "x0", "x1", F.lead("i").over(w).isNull().alias("last"), *(F.bit_xor(f"x{k}").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"y{k}") for k in (0, 1)))
    return rows.select("c", "depth", _node(F.col("y0"), F.col("y1")).alias("node"), _node(F.col("y0").bitwiseXOR(F.col("x0")), F.col("y1").bitwiseXOR(F.col("x1"))).alias("parent"), "bytes", "last")


def _node(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def _root() -> Column:
    return _node(F.lit(0).cast("long"), F.lit(0).cast("long"))


def _ends(ends: DataFrame) -> DataFrame:
    """ends: (node, c). -> (node, ends_sha256): of the numbers in ascending order, joined by commas."""
    kind = ends.schema["node"].dataType.simpleString()

    def runs(nodes: pa.Array) -> Iterator[tuple[int, int]]:
        """From where to where a sorted batch has one node."""
        a, b = (nodes.field(k).to_pylist() for k in range(2))
        start = 0
        for i in range(1, len(a) + 1):
            if i == len(a) or a[i] != a[start] or b[i] != b[start]:
                yield start, i
                start = i

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_pylist()
            at = list(runs(batch.column(0)))
            first = pa.array([s for s, _ in at], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(first), batch.column(1).take(first), pa.array([",".join(map(str, ids[s:e])) for s, e in at], pa.string())], ["node", "first", "piece"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for s, e in runs(batch.column(0)):
                now = batch.column(0)[s].as_py()
                if now != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest, mark = now, hashlib.sha256(), b""
                for i in range(s, e):
                    digest.update(mark + batch.column(2)[i].as_py().encode())
                    mark = b","
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], batch.schema.field(0).type), pa.array([d for _, d in done])], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], batch.schema.field(0).type), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

    c = ends.schema["c"].dataType.simpleString()
    parts = ends.repartitionByRange("node", "c").sortWithinPartitions("node", "c").select("node", "c").mapInArrow(pieces, f"node {kind}, first {c}, piece string")
    return parts.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, f"node {kind}, ends_sha256 string")


def _contracted(tree: DataFrame) -> DataFrame:
    """The nodes with one child, but for the root: (node, up, top, above): the next node above with several children (or the
    root), the highest node below that, and what nodes from there down to this one save together."""
    at = written(tree.where("n_children = 1 AND depth > 0").select("node", F.col("parent").alias("up"), F.col("node").alias("top"), F.col("own").alias("above")), "chains")
    while True:
        seen = Observation()
        step = at.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("top").alias("higher"), F.col("above").alias("more"))
        jumped = at.join(step, "up", "left").select("node", F.coalesce("next", "up").alias("up"), F.coalesce("higher", "top").alias("top"), (F.col("above") + F.coalesce("more", F.lit(0).cast("long"))).alias("above"), F.col("next").isNotNull().alias("moved"))
        at = written(jumped.observe(seen, F.count_if("moved").alias("moved")).drop("moved"), "chains")
        if not seen.get["moved"]:
            return at


def _peeled(nodes: DataFrame) -> DataFrame:
    """nodes: (node, parent, children, leaves, saved, via), leaves and saved of the node alone; via: what a message to parent
    adds to saved. -> (node, leaves, saved), of whole subtrees."""
    left, done = nodes, []
    while True:
        seen = Observation()
        ready = written(left.where("children = 0").observe(seen, F.count(F.lit(1)).alias("n")), "complete")
        if not seen.get["n"]:
            break
        done.append(ready)
        sent = ready.groupBy("parent").agg(F.count("*").alias("k"), F.sum("leaves").alias("l"), F.sum(F.col("saved") + F.col("via")).alias("s")).withColumnRenamed("parent", "node")
        add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0).cast("long"))).alias(a)
        left = left.where("children > 0").join(sent, "node", "left").select("node", "parent", (F.col("children") - F.coalesce("k", F.lit(0).cast("long"))).alias("children"), add("leaves", "l"), add("saved", "s"), "via")
        left = written(left, "waiting")
    out = nodes.limit(0)
    for d in done:
        out = out.unionByName(d)
    return out.select("node", "leaves", "saved")


def trie(turns: DataFrame, members: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the
    subtree, the bytes of a node's last text once for each member but one), ends_sha256 (of the members that end there).
    members: the ids of conversations that may have no turns, as id_col."""
    named = written(_names(_ordered(turns, id_col, turn_col, role_col, text_col)), "prefixes")
    all_ = named.select("c") if members is None else members.where(col(id_col).isNotNull()).select(col(id_col).alias("c")).unionByName(named.select("c"))
    all_ = written(all_.distinct(), "all-members")
    nodes = named.groupBy("node").agg(F.min("depth").alias("depth"), F.min("parent.a").alias("a"), F.min("parent.b").alias("b"), F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"))
    nodes = nodes.select("node", "depth", _node(F.col("a"), F.col("b")).alias("parent"), "conv_id", "n_convs", "bytes")
    top = all_.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    none = F.lit(0).cast("long")
    top = top.select(_root().alias("node"), none.alias("depth"), F.lit(None).cast(nodes.schema["parent"].dataType).alias("parent"), "conv_id", "n_convs", none.alias("bytes"))
    nodes = written(nodes.unionByName(top), "nodes")
    below = nodes.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    tree = nodes.join(below, "node", "left").select("node", "parent", "depth", "conv_id", "n_convs", F.coalesce("n_children", none).alias("n_children"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"))
    tree = written(tree, "tree")
    n = tree.count()

    single = _contracted(tree)
    kernel = tree.where("n_children <> 1 OR depth = 0").select("node", "parent", F.col("n_children").alias("children"), (F.col("n_children") == 0).cast("long").alias("leaves"), F.col("own").alias("saved"))
    passed = single.select(F.col("node").alias("parent"), "up", "top", "above")
    kernel = kernel.join(passed, "parent", "left").select("node", F.coalesce("up", "parent").alias("parent"), "children", "leaves", "saved", F.coalesce("above", none).alias("via"), "top")
    kernel = written(kernel, "kernel")
    totals = written(_peeled(kernel.drop("top")), "totals")
    # A node with one child has the totals of the node below its run, and what the run's nodes save from it on.
    ends_of = kernel.where("top IS NOT NULL").select("node", "top", "via").join(totals, "node").select("top", "via", "leaves", "saved")
    runs = ends_of.join(single.groupBy("top").agg(F.count("*").alias("weight")), "top")
    inner = lookup(single, runs, "top", n).join(tree.select("node", "own"), "node").select("node", "leaves", (F.col("saved") + F.col("via") - F.col("above") + F.col("own")).alias("saved"))
    totals = totals.unionByName(inner)

    turnless = all_.join(named.select("c").distinct(), "c", "left_anti").select(_root().alias("node"), "c")
    ends = _ends(named.where("last").select("node", "c").unionByName(turnless))
    parents = tree.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    full = lookup(tree, parents, "parent", n).join(totals, "node").join(ends, "node", "left")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
