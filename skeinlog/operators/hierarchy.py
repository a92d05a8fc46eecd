"""Parent-child links to full hierarchies (problem 1).

Links are shuffled by a salted locality key, so that most parents lie in the same task and no hot key fills
one. Every task runs a weighted disjoint-set forest over its own links: each node gets its local top, its
offset from it and the outward parent of that top. The contracted links between tops are merged level by level:
while they are more than one task may hold, leaves are set aside and half of the others are placed with their
parents, so that every level leaves a fraction of the one before; the last level is one task. Solutions are
then carried down the levels by joins. Rings are found wherever they close; on which nodes of lower levels they
run is told by walking up from where they enter a task. Paths are materialised by walking parent indexes, tree by tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.runtime import cut

#: Contracted links that one task may merge (about 200 bytes each); while there are more, another level is put in between.
ONE_TASK = 1_000_000
#: Rows of one locality key or tree that one task may hold; larger ones are split.
SLOT_ROWS = 100_000

TREE, OUT, RING, TAIL = 0, 1, 2, 3
LOCAL = "node string, parent string, top string, off bigint, low string, ext string, far bigint, state int"
SOLVED = "node string, root string, dist bigint, state int"
PATHS = "node string, root string, depth int, path array<string>"


def find_all(parent: np.ndarray, weight: np.ndarray, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted find with full path compression for all nodes of a forest in which each has one link.

    ``parent`` holds indexes, -1 where a node has no link. Gives the top of each node, its offset from it,
    and masks of the nodes on a ring and of those leading into one (whose top is then a node of the ring). ``low``
    (a number for each link) is lowered in place to the least on the way from the node to its top.
    """
    n = len(parent)
    top = np.where(parent < 0, np.arange(n), parent)
    off = np.where(parent < 0, 0, weight).astype(np.int64)
    fixed = parent < 0
    live = np.flatnonzero(~fixed[top])
    for _ in range(max(1, n).bit_length() + 1):
        if not len(live):
            break
        step = top[live]
        new_off, new_top = off[live] + off[step], top[step]
        if low is not None:
            low[live] = np.minimum(low[live], low[step])
        off[live], top[live] = new_off, new_top
        live = live[~fixed[new_top]]
    on = np.zeros(n, bool)
    on[top[live]] = True
    into = np.zeros(n, bool)
    into[live] = True
    return top, off, on, into & ~on


def _indexed(nodes: pa.Array, parents: pa.Array) -> np.ndarray:
    """Index of each parent among the nodes, -1 where it is null or not among them."""
    return pc.fill_null(pc.index_in(parents, value_set=nodes), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _column(batches: list[pa.RecordBatch], name: str, kind: pa.DataType) -> pa.Array:
    return pa.chunked_array([b.column(name) for b in batches], type=kind).combine_chunks()


def _forest(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's links ``node, parent, weight, low``, contracted.

    A link covers the nodes above its node up to its parent; ``low`` is the least id among them. Each node gets
    its top, the offset from it and the least id between (of the top itself: that of its own link), and the parent
    and weight of the top's link where that leads out of the task. The top of a ring is its least id.
    """
    batches = [b for b in stream if b.num_rows]
    if not batches:
        return
    nodes, parents, lows = (_column(batches, name, pa.string()) for name in ("node", "parent", "low"))
    weight = _column(batches, "weight", pa.int64()).to_numpy(zero_copy_only=False)
    link = _indexed(nodes, parents)
    top, off, on, into, least, names = _least(nodes, lows, link, weight)
    ringed = on | into
    ext = pc.if_else(pa.array(ringed), pa.scalar(None, pa.string()), pc.take(parents, pa.array(top)))
    state = np.where(on, RING, np.where(into, TAIL, np.where(ext.is_null().to_numpy(zero_copy_only=False), TREE, OUT))).astype(np.int32)
    tops = pc.if_else(pa.array(ringed), pc.take(names, pa.array(np.where(on, least, least[top]))), pc.take(nodes, pa.array(top)))
    between = pc.if_else(pa.array(top == np.arange(len(top))), lows, pc.take(names, pa.array(least)))
    yield from pa.table({"node": nodes, "parent": parents, "top": tops, "off": off, "low": between, "ext": ext, "far": weight[top], "state": state}).to_batches(max_chunksize=65_536)


def _least(nodes: pa.Array, lows: pa.Array, link: np.ndarray, weight: np.ndarray) -> tuple:
    """``find_all`` and for each node the number, in the sorted ``names``, of the least id on the way to its top."""
    names = pc.unique(lows.drop_null())
    names = pa.concat_arrays([pc.take(names, pc.array_sort_indices(names)), pa.array([None], pa.string())])
    least = pc.fill_null(pc.index_in(lows, value_set=names.drop_null()), len(names) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
    least = np.where(link < 0, len(names) - 1, least)
    top, off, on, into = find_all(link, weight, least)
    return top, off, on, into, least, names


def _merge(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solves ``node, parent, weight, low, root, dist, state``; a row with a root is solved already."""
    batches = [b for b in stream if b.num_rows]
    if not batches:
        return
    nodes, parents, roots, lows = (_column(batches, name, pa.string()) for name in ("node", "parent", "root", "low"))
    weight = _column(batches, "weight", pa.int64()).to_numpy(zero_copy_only=False)
    base = pc.fill_null(_column(batches, "dist", pa.int64()), 0).to_numpy(zero_copy_only=False)
    given = _column(batches, "state", pa.int32()).to_numpy(zero_copy_only=False)
    link = np.where(roots.is_valid().to_numpy(zero_copy_only=False), -1, _indexed(nodes, parents))
    top, off, on, into, least, names = _least(nodes, lows, link, weight)
    ring = pc.take(names, pa.array(np.where(on, least, least[top])))
    root = pc.if_else(pa.array(on | into), ring, pc.take(pc.coalesce(roots, nodes), pa.array(top)))
    state = np.where(on, RING, np.where(into, TAIL, given[top])).astype(np.int32)
    yield from pa.table({"node": nodes, "root": root, "dist": off + base[top], "state": state}).to_batches(max_chunksize=65_536)


def _mark(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of ``node, parent, entered`` from those where a ring enters up to their tops."""
    batches = [b for b in stream if b.num_rows]
    if not batches:
        return
    nodes, parents = (_column(batches, name, pa.string()) for name in ("node", "parent"))
    link = _indexed(nodes, parents)
    on = np.zeros(len(link), bool)
    at = np.flatnonzero(_column(batches, "entered", pa.bool_()).to_numpy(zero_copy_only=False))
    while len(at):
        on[at] = True
        at = np.unique(link[at])
        at = at[at >= 0]
        at = at[~on[at]]
    yield from pa.table({"on_ring": nodes.filter(pa.array(on))}).to_batches(max_chunksize=65_536)


def salted(df: DataFrame, key: str, rows: int = SLOT_ROWS) -> DataFrame:
    """``df`` with ``__slot``: the hash of ``key``, split further where a key has more than ``rows`` rows.

    Counts are combined map-side before their shuffle; only keys over the bound are joined back.
    """
    hot = df.groupBy(F.col(key).alias("__k")).count().where(F.col("count") > rows).select("__k", F.ceil(F.col("count") / rows).cast("int").alias("__n"))
    return df.join(hot, df[key] == hot["__k"], "left").withColumn(
        "__slot", F.hash(F.col(key), F.when(F.col("__n").isNotNull(), F.pmod(F.xxhash64("node"), F.col("__n"))).otherwise(0))
    ).drop("__k", "__n")


def _one_per_node(links: DataFrame) -> DataFrame:
    """One link per node: repeated rows count once; of several parents the smallest id is kept."""
    return links.where("node is not null").groupBy("node").agg(F.min("parent").alias("parent"), F.min("locality").alias("locality"))


def _coin(node: Column, level: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(level)), F.lit(2)) == 1


def _next_level(contracted: DataFrame, one_task: int, slot_rows: int, level: int) -> DataFrame:
    """``node, root, dist, state`` of contracted links too many for one task.

    Leaves wait for their parents. Of the others those that draw tails are placed with a parent that draws
    heads, so a fraction is contracted whatever the shape; parents with more than ``slot_rows`` children don't
    gather theirs.
    """
    live, known = contracted.where("root is null"), contracted.where("root is not null")
    asked = cut(live.groupBy(F.col("parent").alias("p")).agg(F.count("*").alias("children")))
    inner = live.join(asked, F.col("node") == F.col("p"), "left_semi")
    leaf = live.join(asked, F.col("node") == F.col("p"), "left_anti")
    own, mate = F.col("node"), F.col("parent")
    solved_here = known.select(F.col("node").alias("t")).withColumn("solved", F.lit(True))
    sized = inner.join(asked, mate == F.col("p"), "left").join(solved_here, mate == F.col("t"), "left")
    heads = (_coin(mate, level) | F.coalesce("solved", F.lit(False))) & (F.coalesce("children", F.lit(0)) <= slot_rows)
    placed = sized.select("node", "parent", "weight", "low", F.when(_coin(own, level), own).when(heads, mate).otherwise(own).alias("place"))
    ends = known.join(asked, F.col("node") == F.col("p"), "left_semi").select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("weight"), F.lit(None).cast("string").alias("low"), F.col("node").alias("place"))
    forest = cut(placed.unionByName(ends).repartition("place").select("node", "parent", "weight", "low").mapInArrow(_forest, LOCAL))
    sub = _solve(forest, one_task, slot_rows, level + 1)
    said = known.select(F.col("node").alias("kn"), F.col("root").alias("k_root"), F.col("dist").alias("k_dist"), F.col("state").alias("k_state"))
    done = cut(sub.join(said, F.col("root") == F.col("kn"), "left").select(
        "node", F.coalesce("k_root", "root").alias("root"), (F.col("dist") + F.coalesce("k_dist", F.lit(0))).alias("dist"), F.when(F.col("k_state") == TAIL, TAIL).otherwise(F.col("state")).alias("state")))
    above = done.select(F.col("node").alias("up"), F.col("root").alias("u_root"), F.col("dist").alias("u_dist"), F.col("state").alias("u_state"))
    below = leaf.join(above, F.col("parent") == F.col("up")).select(
        "node", F.col("u_root").alias("root"), (F.col("weight") + F.col("u_dist")).alias("dist"), F.when(F.col("u_state") == TREE, TREE).otherwise(TAIL).alias("state"))
    apart = known.join(asked, F.col("node") == F.col("p"), "left_anti").select("node", "root", "dist", "state")
    return done.unionByName(below).unionByName(apart)


def _solve(forest: DataFrame, one_task: int, slot_rows: int, level: int = 0) -> DataFrame:
    """``node, root, dist, state`` of all nodes of a level, from its tasks' forests."""
    tops = forest.where((F.col("state") == OUT) & (F.col("node") == F.col("top"))).select("node", F.col("ext").alias("to"), "far", F.col("low").alias("own_low"))
    aim = forest.select(F.col("node").alias("at"), F.col("top").alias("to_top"), F.col("off").alias("to_off"), F.col("state").alias("to_state"), F.col("low").alias("to_low"))
    target = F.col("to_state")
    contracted = cut(
        tops.join(aim, F.col("to") == F.col("at"), "left").select(
            "node", F.col("at").alias("entry"),
            F.when(target == OUT, F.col("to_top")).alias("parent"),
            (F.col("far") + F.coalesce("to_off", F.lit(0))).alias("weight"),
            F.when(F.col("at") == F.col("to_top"), F.col("own_low")).otherwise(F.least("own_low", "to_low")).alias("low"),
            F.when(target.isNull(), F.col("node")).when(target != OUT, F.col("to_top")).alias("root"),
            F.when(target == TREE, F.col("far") + F.col("to_off")).otherwise(F.lit(0)).cast("bigint").alias("dist"),
            F.when(target.isNull(), TREE).when(target == OUT, OUT).when(target == TREE, TREE).otherwise(TAIL).alias("state"),
        )
    )
    if contracted.count() <= one_task:
        solved = cut(contracted.coalesce(1).select("node", "parent", "weight", "low", "root", "dist", "state").mapInArrow(_merge, SOLVED))
    else:
        solved = cut(_next_level(contracted, one_task, slot_rows, level))
    said = solved.select(F.col("node").alias("t"), F.col("root").alias("t_root"), F.col("dist").alias("t_dist"), F.col("state").alias("t_state"))
    joined = forest.join(said, (F.col("top") == F.col("t")) & (F.col("state") == OUT), "left")
    ringed = solved.where(F.col("state") == RING).select(F.col("node").alias("ring_top"))
    on = F.lit(False)
    if not ringed.isEmpty():
        # A ring through several tasks runs from where it enters a task's tree up to the top of that tree.
        entries = contracted.join(ringed, F.col("node") == F.col("ring_top"), "left_semi").select(F.col("entry").alias("e")).distinct()
        trees = forest.where(F.col("state") == OUT).join(ringed, F.col("top") == F.col("ring_top"), "left_semi")
        walked = trees.join(entries, F.col("node") == F.col("e"), "left").repartition("top").select("node", "parent", F.col("e").isNotNull().alias("entered"))
        marked = cut(walked.mapInArrow(_mark, "on_ring string"))
        joined = joined.join(marked, F.col("node") == F.col("on_ring"), "left")
        on = F.col("on_ring").isNotNull()
    state = F.when(F.col("state") != OUT, F.col("state")).when(F.col("t_state") == TREE, TREE).when((F.col("t_state") == RING) & on, RING).otherwise(TAIL)
    return joined.select("node", F.coalesce("t_root", "top").alias("root"), (F.col("off") + F.coalesce("t_dist", F.lit(0))).alias("dist"), state.alias("state"))


def resolve(links: DataFrame, one_task: int = ONE_TASK, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """``node, root, depth`` of the links ``node, parent[, locality]`` (strings).

    A parent that is null or no node makes its child a root (itself, depth 0). On a ring the root is the
    smallest id of the ring and depth -1; a node leading into a ring has the same root and depth -2. Null
    nodes are ignored, repeated links count once, of several parents of one node the smallest id is taken,
    no links give no rows. Other columns are ignored. ``locality`` only places rows: nodes that share it are
    likely linked.
    """
    if "locality" not in links.columns:
        placed = _one_per_node(links.withColumn("locality", F.col("node"))).withColumn("__slot", F.hash("node"))
    else:
        placed = salted(_one_per_node(links), "locality", slot_rows)
    rows = placed.repartition("__slot").select("node", "parent", F.lit(1).cast("bigint").alias("weight"), F.col("parent").alias("low"))
    solved = _solve(cut(rows.mapInArrow(_forest, LOCAL)), one_task, slot_rows)
    return solved.select("node", "root", F.when(F.col("state") == RING, -1).when(F.col("state") == TAIL, -2).otherwise(F.col("dist")).cast("int").alias("depth"))


def _walk(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of whole trees: all nodes of a batch step up together, each writing its place in the arrays of all."""
    batches = [b for b in stream if b.num_rows]
    if not batches:
        return
    nodes, parents, roots = (_column(batches, name, pa.string()) for name in ("node", "parent", "root"))
    depth = _column(batches, "depth", pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64)
    link = _indexed(nodes, parents)
    ends = np.cumsum(depth + 1)
    at = 0
    while at < len(depth):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000, side="right")))
        part = np.arange(at, upto)
        size = depth[part] + 1
        offsets = np.concatenate([[0], np.cumsum(size)])
        flat = np.empty(offsets[-1], np.int64)
        place, first, cur = offsets[1:] - 1, offsets[:-1], part
        while len(place):
            flat[place] = cur
            more = place > first
            place, first, cur = place[more] - 1, first[more], link[cur[more]]
        pick = pa.array(part)
        yield pa.record_batch({
            "node": pc.take(nodes, pick), "root": pc.take(roots, pick), "depth": pa.array(depth[part], pa.int32()),
            "path": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pc.take(nodes, pa.array(flat))),
        })
        at = upto


def gather_above(rows: DataFrame, piece: str) -> DataFrame:
    """``rows`` without ``above`` and with the arrays in ``piece`` of all nodes above put in front of the own one.

    ``rows`` has ``node, above, depth`` and other columns; ``above`` is null at roots. Every round joins the
    piece that ends where the known one begins, so a depth of d takes log2(d) rounds.
    """
    cur = cut(rows)
    deepest = cur.agg(F.max("depth")).first()[0] or 0
    kept = [c for c in cur.columns if c not in ("above", piece)]
    for _ in range(max(1, math.ceil(math.log2(deepest + 1)) + 1)):
        up = cur.select(F.col("node").alias("__at"), F.col("above").alias("__next"), F.col(piece).alias("__piece"))
        cur = cut(cur.join(up, F.col("above") == F.col("__at"), "left").select(
            *kept, F.col("__next").alias("above"), F.when(F.col("__at").isNull(), F.col(piece)).otherwise(F.concat("__piece", piece)).alias(piece)))
    return cur.drop("above")


def paths(links: DataFrame, resolved: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """``node, root, depth, path``: the ids from the root down to the node; on or into a ring only the node itself.

    Trees of up to ``slot_rows`` nodes are walked whole in one task. The path of a node of a larger tree is
    put together by doubling: each round joins the piece above the piece that is known.
    """
    rows = cut(_one_per_node(links.withColumn("locality", F.lit(None).cast("string"))).drop("locality").join(resolved, "node"))
    ringed = rows.where("depth < 0").select("node", "root", "depth", F.array("node").alias("path"))
    trees = rows.where("depth >= 0")
    hot = cut(trees.groupBy(F.col("root").alias("hot_root")).count().where(F.col("count") > slot_rows))
    small = trees.join(hot, F.col("root") == F.col("hot_root"), "left_anti")
    walked = small.repartition("root").select("node", "parent", "root", "depth").mapInArrow(_walk, PATHS)
    out = ringed.unionByName(walked)
    if hot.isEmpty():
        return out
    parts = trees.join(hot, F.col("root") == F.col("hot_root"), "left_semi").select(
        "node", "root", "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("above"), F.array("node").alias("path"))
    return out.unionByName(gather_above(parts, "path"))


def ring_walks(links: DataFrame, resolved: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """``node, root, depth, path, walk`` of the nodes on a ring or leading into one.

    ``walk`` has every node above, each once, the farthest first, and the node itself at its end: all of the
    ring is above its nodes and above those leading into it. ``path`` is the same for a node of the ring; that
    of a node leading into it begins at the first node of the ring.
    """
    rows = cut(_one_per_node(links.withColumn("locality", F.lit(None).cast("string"))).drop("locality").join(resolved.where("depth < 0"), "node"))
    # Without the link of its smallest node, a ring with all that leads into it is a tree below that node.
    opened = rows.select("node", F.when(F.col("node") != F.col("root"), F.col("parent")).alias("parent"))
    down = paths(opened, resolve(opened, slot_rows=slot_rows), slot_rows).select("node", F.col("path").alias("down"))
    known = cut(rows.select("node", "root", "depth").join(down, "node"))
    rings = known.where("depth = -1").groupBy("root").agg(F.max_by("down", F.size("down")).alias("ring"))
    placed = known.join(rings, "root").withColumn("on", F.size(F.array_intersect("down", "ring")))
    walked = placed.withColumn("walk", F.concat(F.slice("ring", F.col("on") + 1, F.size("ring") - F.col("on")), F.col("down")))
    path = F.when(F.col("depth") == -1, F.col("walk")).otherwise(F.slice("down", F.col("on"), F.size("down")))
    return walked.select("node", "root", "depth", path.alias("path"), "walk")


def whole_paths(links: DataFrame, resolved: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """``node, root, depth, path, walk`` of every node: ``paths`` of the trees and ``ring_walks`` of the rest."""
    trees = paths(links, resolved, slot_rows).where("depth >= 0").withColumn("walk", F.col("path"))
    return trees.unionByName(ring_walks(links, resolved, slot_rows))


def descendants(path_rows: DataFrame) -> DataFrame:
    """``ancestor, node, distance``: one row for each node and each of its ancestors, itself included.

    Nodes on a ring or leading into one have rows if ``path_rows`` has their ``walk`` (``whole_paths``); with
    ``path`` only they have none.
    """
    if "walk" not in path_rows.columns:
        path_rows = path_rows.where("depth >= 0").withColumn("walk", F.col("path"))
    return path_rows.select("node", F.size("walk").alias("n"), F.posexplode("walk").alias("at", "ancestor")).select(
        "ancestor", "node", (F.col("n") - 1 - F.col("at")).cast("int").alias("distance")
    )
