"""Groups from pairwise matches: connected components on a two-dimensional grid of edge partitions.

Vertices are hashed into B blocks; an edge lies in the cell of its pair of blocks, so a vertex touches the
B cells of its row and column only, and the edges of the busiest vertex are spread over B cells.  A cell that still
holds more than its share, because a vertex has a fixed share of all edges, is split by a hash of its edges.  A round:

1. every cell runs a local union-find over its edges and reports, for each vertex it holds, the
   representative of its part of the cell;
2. rows and columns exchange representatives: a vertex keeps the first of those that its cells report as its
   parent (at most B values a vertex, combined before the shuffle);
3. what the cells disagree on are the edges of the next round, between representatives only.

Representatives are chosen in an order that changes every round, so long chains shrink by a constant factor.
The rounds end when all cells agree.  Labels then travel back down the rounds, and a group is named by its
smallest member.  B grows with the square root of the edges and larger cells are split, so a task holds about
CELL_EDGES of them whatever the size and however uneven the degrees.

Each round is written to the shared folder; nothing but counts reaches the driver.  Joins on a
representative that a third of all vertices may share go through :func:`tressage.runtime.skew_join`.

Defined results: null ends, links from a vertex to itself and repeated links do not matter; direction does not
matter; a vertex without links is in no group; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, hot_keys, skew_join

CELL_EDGES = 1_000_000
_OUT = "v long, rep long"


def local_union_find(a, b, seed: int):
    """Vertices of the edges (a, b) and the representative of each one's component; numpy arrays of longs."""
    import numpy as np

    if not len(a):
        return a, a
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    with np.errstate(over="ignore"):
        x = ids.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        for k, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(k))) * np.uint64(m)
    order = np.lexsort((ids, x ^ (x >> np.uint64(31))))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    left, right = rank[at[: len(a)]], rank[at[len(a) :]]
    parent = np.arange(len(ids))
    while True:
        pl, pr = parent[left], parent[right]
        if (pl == pr).all():
            break
        low = np.minimum(pl, pr)
        np.minimum.at(parent, pl, low)
        np.minimum.at(parent, pr, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return ids, ids[order[parent[rank]]]


def _stars(edges: DataFrame, blocks: int, seed: int, cell_edges: int) -> DataFrame:
    block = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(seed)), F.lit(blocks))
    lo, hi = F.least(block("a"), block("b")), F.greatest(block("a"), block("b"))
    cells = blocks * (blocks + 1) // 2

    def run(batches):
        import numpy as np
        import pyarrow as pa

        a, b = [], []
        for batch in batches:
            a.append(batch.column(0).to_numpy(zero_copy_only=False))
            b.append(batch.column(1).to_numpy(zero_copy_only=False))
        if not a:
            return
        v, rep = local_union_find(np.concatenate(a), np.concatenate(b), seed)
        for i in range(0, len(v), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(v[i : i + 100_000]), pa.array(rep[i : i + 100_000])], names=["v", "rep"])

    placed = edges.select("a", "b", (hi * (hi + 1) / 2 + lo).cast("int").alias("cell"))
    if blocks > 2:
        # cells over their share: at most one in cell_edges edges, so the list is a millionth of the table
        large = placed.groupBy("cell").count().where(F.col("count") > 2 * cell_edges).collect()
        split, extra = [], cells
        for r in large:
            parts = math.ceil(r["count"] / cell_edges)
            split.append((r["cell"], parts, extra))
            extra += parts
        if split:
            sizes = edges.sparkSession.createDataFrame(split, "cell int, parts int, first int")
            part = F.pmod(F.xxhash64("a", "b", F.lit(~seed)), F.col("parts")).cast("int")
            placed = placed.join(F.broadcast(sizes), "cell", "left").select("a", "b", F.coalesce(F.col("first") + part, "cell").alias("cell"))
            cells = extra
    return placed.repartitionById(cells, F.col("cell")).select("a", "b").mapInArrow(run, _OUT)


def connected_components(links: DataFrame, left: str, right: str, scratch: Scratch | None = None, cell_edges: int = CELL_EDGES) -> DataFrame:
    """(vertex, group) for every end of a link: ``group`` is the smallest vertex it is tied to, however indirectly."""
    scratch = scratch or Scratch(links.sparkSession, "components")
    ends = links.select(F.col(f"`{left}`").cast("long").alias("x"), F.col(f"`{right}`").cast("long").alias("y")).where("x is not null and y is not null and x <> y")
    edges = scratch.write(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while n := edges.count():
        blocks = max(2, math.ceil(math.sqrt(2 * n / cell_edges)))
        stars = _stars(edges, blocks, len(rounds), cell_edges)
        kept = scratch.write(stars.groupBy("v").agg(F.min("rep").alias("parent"), F.collect_set("rep").alias("reps")), "parents")
        rounds.append(kept)
        rest = kept.where("size(reps) > 1").select("parent", F.explode("reps").alias("rep")).where("rep <> parent")
        old, edges = edges, scratch.write(rest.select(F.least("parent", "rep").alias("a"), F.greatest("parent", "rep").alias("b")).distinct(), "edges")
        scratch.drop(old)
    if not rounds:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("group"))

    def attach(rows: DataFrame, key: str, names: DataFrame) -> DataFrame:
        sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        hot = scratch.write(hot_keys(sizes, [key], "n", rows.count()), "hot")
        return skew_join(rows, names, [key], hot if hot.head(1) else None, "left")

    labels = rounds[-1].select("v", F.col("parent").alias("root"))
    for kept in reversed(rounds[:-1]):
        names = scratch.write(labels.select(F.col("v").alias("parent"), "root"), "labels")
        labels = attach(kept.select("v", "parent"), "parent", names).select("v", F.coalesce("root", "parent").alias("root"))
    labels = scratch.write(labels, "labels")
    first = labels.groupBy("root").agg(F.min("v").alias("group"))
    return attach(labels, "root", first).select(F.col("v").alias("vertex"), "group")


#: White space of any kind around a reference, with the invisible characters that act as such.
_EDGE_SPACE = "(?U)^[\\s\\p{Z}\\x1c-\\x1f\\u200b\\u2060\\ufeff]+|[\\s\\p{Z}\\x1c-\\x1f\\u200b\\u2060\\ufeff]+$"


def notice_groups(notices: DataFrame, links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(group_idx, idx) of each notice in a group of two or more; links whose ends are no notices do not count.

    A reference is compared without the white space around it.  Where an ``idweb`` stands for several ``idx``, the
    smallest is meant.
    """
    scratch = scratch or Scratch(notices.sparkSession, "groups")
    nodes = notices.select(F.col("idx").cast("long").alias("idx"), "idweb").where("idx is not null")
    by_name = nodes.where("idweb is not null").groupBy(F.col("idweb").alias("t")).agg(F.min("idx").alias("there"))
    named = scratch.write(links.select(F.col("right_idx").cast("long").alias("idx"), F.regexp_replace("target_idweb", _EDGE_SPACE, "").alias("t")).where("idx is not null and t is not null").distinct(), "links")
    total = named.count()

    def meet(rows, key, table):
        hot = scratch.write(hot_keys(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), [key], "n", total), "hot")
        return skew_join(rows, table, [key], hot if hot.head(1) else None)

    found = scratch.write(meet(named, "t", by_name).select("idx", "there").where("idx <> there"), "found")
    ends = meet(found, "idx", nodes.select("idx").distinct())
    groups = connected_components(ends, "idx", "there", scratch)
    return groups.select(F.col("group").alias("group_idx"), F.col("vertex").alias("idx"))
