"""Episodes: records tied by shared folders, explicit references and chains, under a veto on conflicting identifiers.

Edges are proposed in a fixed order.  Components of all proposed edges are found first; only those that hold two
or more trusted identifiers can refuse a merge, and only their edges are replayed in order, one component a task.
A component is a procurement and its notices; those in conflict are few, and their size is what bounds a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import HOT_FLOOR, Scratch, hot_keys, skew_join

METHODS = ("contractfolderid", "explicit_linked_notice", "exact_reference_same_buyer")
REFERENCE_SPAN_DAYS = 730


def star_edges(rows: DataFrame, key: str, vertex: str = "idx") -> DataFrame:
    """(left_id, right_id, evidence): each record tied to the first of its group; the centre comes from an aggregate."""
    keyed = rows.where(F.trim(F.coalesce(key, F.lit(""))) != "").select(F.trim(key).alias("evidence"), F.col(vertex).alias("right_id")).distinct()
    centre = keyed.groupBy("evidence").agg(F.min("right_id").alias("left_id"))
    return keyed.join(centre, "evidence").where("left_id <> right_id").select("left_id", "right_id", "evidence")


def chain_edges(rows: DataFrame, keys: list[str], day: str, vertex: str = "idx", span: int = REFERENCE_SPAN_DAYS) -> DataFrame:
    """(left_id, right_id, evidence, accepted): consecutive records of a group by day; too far apart is proposed but not accepted."""
    keyed = rows
    for k in keys:
        keyed = keyed.where(F.trim(F.coalesce(k, F.lit(""))) != "")
    c = keyed.select(*keys, F.col(day).alias("_d"), F.col(vertex).alias("right_id")).distinct()
    w = Window.partitionBy(*keys).orderBy("_d", "right_id")
    c = c.withColumns({"left_id": F.lag("right_id").over(w), "_p": F.lag("_d").over(w)}).where("left_id is not null")
    return c.select("left_id", "right_id", F.concat_ws("|", *keys).alias("evidence"), F.coalesce(F.datediff("_d", "_p") <= span, F.lit(False)).alias("accepted"))


def components(edges: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """(vertex, root): the smallest vertex of each connected component, by label propagation with shortcuts.

    Each round a vertex takes the smallest label around it and then the label of its label, so the rounds grow with
    the logarithm of the longest chain; each is written to the shared folder.  A vertex with a share of all edges, or a
    label with a share of all vertices, is met where its rows are (:func:`tressage.runtime.skew_join`).
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = scratch.write(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    total = e.count()

    def busy(rows: DataFrame, key: str) -> DataFrame | None:
        if total <= HOT_FLOOR:
            return None
        hot = scratch.write(hot_keys(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), [key], "n", total), "hot")
        return hot if hot.head(1) else None

    hubs = busy(e, "v")
    labels = scratch.write(e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")), "labels")
    many = labels.count() > HOT_FLOOR  # no label of fewer vertices is hot
    while True:
        near = skew_join(e, labels.select(F.col("u").alias("v"), F.col("l").alias("n")), ["v"], hubs).groupBy("u").agg(F.min("n").alias("n"))
        new = labels.join(near, "u").select("u", F.least("l", "n").alias("l"))
        # the label of the label, and that vertex pulled along
        pulled = new.select(F.col("u"), "l").unionByName(labels.join(new.withColumnRenamed("l", "m"), "u").select(F.col("l").alias("u"), F.col("m").alias("l")))
        new = pulled.groupBy("u").agg(F.min("l").alias("l"))
        if many:
            new = scratch.write(new, "pulled")
        jump = new.select(F.col("u").alias("l"), F.col("l").alias("ll"))
        after = scratch.write(skew_join(new, jump, ["l"], busy(new, "l") if many else None, "left").select("u", F.coalesce("ll", "l").alias("l")), "labels")
        moved = after.join(labels.withColumnRenamed("l", "before"), "u").where("l <> before").limit(1).count()
        scratch.drop(labels, new)
        labels = after
        if not moved:
            return labels.select(F.col("u").alias("vertex"), F.col("l").alias("root"))


#: What becomes of an edge.
KNOWN, REFUSED, ACCEPTED = "already_connected", "trusted_buyer_conflict", "accepted"


def replay(vertices: list, trusted: dict, edges: list[tuple]) -> tuple[dict, list[tuple]]:
    """Ordered edges with the veto: (vertex -> root, [(edge, decision)])."""
    parent = {v: v for v in vertices}
    ids = {v: ({trusted[v]} if trusted.get(v) else set()) for v in vertices}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    log = []
    for edge in edges:
        x, y = find(edge[0]), find(edge[1])
        if x == y:
            log.append((edge, KNOWN))
        elif ids[x] and ids[y] and ids[x] != ids[y]:
            log.append((edge, REFUSED))
        else:
            lo, hi = min(x, y), max(x, y)
            parent[hi] = lo
            ids[lo] |= ids[hi]
            log.append((edge, ACCEPTED))
    return {v: find(v) for v in vertices}, log


def constrained_components(edges: DataFrame, trusted: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((vertex, root), (left_id, right_id, priority, decision)) under the veto on conflicting identifiers.

    ``edges`` has left_id, right_id, priority and evidence (their order); ``trusted`` has vertex and trusted_id.
    """
    edges = scratch.write(edges.where("left_id <> right_id"), "proposed")
    free = scratch.write(components(edges, "left_id", "right_id", scratch), "free")
    known = free.join(trusted.where("trusted_id <> ''"), "vertex").groupBy("root").agg(F.count_distinct("trusted_id").alias("ids"))
    contested = scratch.write(known.where("ids > 1").select("root"), "contested")
    where = edges.join(free.select(F.col("vertex").alias("left_id"), "root"), "left_id")
    hard = where.join(contested, "root", "left_semi").join(trusted.select(F.col("vertex").alias("left_id"), F.col("trusted_id").alias("lt")).distinct(), "left_id", "left").join(trusted.select(F.col("vertex").alias("right_id"), F.col("trusted_id").alias("rt")).distinct(), "right_id", "left")

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["priority", "evidence", "left_id", "right_id"])
        ids = {**dict(zip(pdf["left_id"], pdf["lt"])), **dict(zip(pdf["right_id"], pdf["rt"]))}
        roots, log = replay(sorted(ids), {k: v for k, v in ids.items() if isinstance(v, str)}, list(zip(pdf["left_id"], pdf["right_id"], pdf["priority"])))
        a = pd.DataFrame({"vertex": list(roots), "root": list(roots.values())}).assign(left_id=None, right_id=None, priority=None, decision=None)
        b = pd.DataFrame([(*e, d) for e, d in log], columns=["left_id", "right_id", "priority", "decision"]).assign(vertex=None, root=None)
        return pd.concat([a, b])[["vertex", "root", "left_id", "right_id", "priority", "decision"]]

    played = scratch.write(hard.groupBy("root").applyInPandas(run, "vertex long, root long, left_id long, right_id long, priority int, decision string"), "replayed")
    easy = free.join(contested, "root", "left_anti").select("vertex", "root")
    out = easy.unionByName(played.where("vertex is not null").select("vertex", "root"))
    plain = where.join(contested, "root", "left_anti").select("left_id", "right_id", "priority", F.lit(ACCEPTED).alias("decision"))
    return out, plain.unionByName(played.where("left_id is not null").select("left_id", "right_id", "priority", "decision"))


def episode_ids(members: DataFrame, root: str, name: str) -> DataFrame:
    """(root, episode_id, n): an identifier that depends on the members only."""
    g = members.groupBy(root).agg(F.array_sort(F.collect_set(name)).alias("ids"), F.count(F.lit(1)).alias("n"))
    return g.select(root, F.concat(F.lit("EP-"), F.substring(F.sha2(F.concat_ws("\n", "ids"), 256), 1, 16)).alias("episode_id"), "n")
