"""Episode reconstruction over notices, quarterly trends, and readers and writers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text
from ..functions.special import t_sf2
from ..operators import episodes as ops
from ..operators import trend
from ..runtime import Scratch, table
from .registry import Registry

Q = Registry()


def _notices(spark, d):
    return table(spark, d, "notices").withColumn("day", F.to_date(F.when(F.col("publication_date") != "", F.col("publication_date")))).distinct()


_STAR = "SELECT left_id, idx AS right_id, k AS evidence FROM (SELECT DISTINCT trim({k}) AS k, idx, min(idx) OVER (PARTITION BY trim({k})) AS left_id FROM notices WHERE trim(coalesce({k}, '')) <> '') WHERE left_id <> idx"


@Q.query(_STAR.format(k="procedure_reference"))
def edges_star(spark, d):
    return ops.star_edges(_notices(spark, d), "procedure_reference")


_EXPLICIT = r"SELECT DISTINCT n.idx AS left_id, e.right_idx AS right_id, n.idweb AS evidence FROM explicit_links e JOIN notices n ON n.idweb = regexp_replace(e.target_idweb, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') WHERE n.idx <> e.right_idx AND e.right_idx IN (SELECT idx FROM notices)"


@Q.query(_EXPLICIT)
def edges_explicit(spark, d):
    n = _notices(spark, d).select("idx", "idweb").distinct()
    e = table(spark, d, "explicit_links").select(F.col("right_idx").alias("right_id"), text.trimmed(F.col("target_idweb")).alias("evidence")).distinct()
    e = e.join(n.select(F.col("idweb").alias("evidence"), F.col("idx").alias("left_id")), "evidence").join(n.select(F.col("idx").alias("right_id")), "right_id", "left_semi")
    return e.where("left_id <> right_id").select("left_id", "right_id", "evidence")


_CHAIN = """SELECT left_id, right_id, evidence, coalesce(span <= 730, false) AS accepted FROM (
    SELECT lag(idx) OVER w AS left_id, idx AS right_id, buyer_key || '|' || buyer_name_normalized || '|' || ref AS evidence, date_diff('day', lag(day) OVER w, day) AS span
    FROM (SELECT DISTINCT idx, buyer_key, buyer_name_normalized, {r} AS ref, TRY_CAST(nullif(publication_date, '') AS DATE) AS day FROM notices WHERE trim(coalesce(buyer_key, '')) <> '' AND trim(coalesce(buyer_name_normalized, '')) <> '' AND trim(coalesce({r}, '')) <> '' AND procedure_reference_source <> 'eforms:cbc:ContractFolderID')
    WINDOW w AS (PARTITION BY buyer_key, buyer_name_normalized, ref ORDER BY day NULLS FIRST, idx)) WHERE left_id IS NOT NULL"""


def _chains(spark, d, reference):
    n = _notices(spark, d).where("procedure_reference_source <> 'eforms:cbc:ContractFolderID'").withColumn("ref", reference)
    return ops.chain_edges(n, ["buyer_key", "buyer_name_normalized", "ref"], "day")


@Q.query(_CHAIN.format(r="substr(procedure_reference, 1, 3)"))
def edges_chain(spark, d):
    """Chains of a buyer's notices in the same series of references (its letter and year)."""
    return _chains(spark, d, F.substring("procedure_reference", 1, 3))


def _edges(spark, d):
    parts = [ops.star_edges(_notices(spark, d), "contractfolderid"), edges_explicit(spark, d), _chains(spark, d, F.col("procedure_reference")).where("accepted").drop("accepted")]
    out = None
    for i, p in enumerate(parts, 1):
        p = p.withColumn("priority", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out


@Q.query(f"""
    WITH RECURSIVE e AS MATERIALIZED (SELECT left_id AS a, right_id AS b FROM ({_STAR.format(k="contractfolderid")}) UNION SELECT left_id, right_id FROM ({_EXPLICIT}) UNION SELECT left_id, right_id FROM ({_CHAIN.format(r="procedure_reference")}) WHERE accepted), x AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT a AS v, a AS s FROM x UNION SELECT x.b, r.s FROM r JOIN x ON x.a = r.v WHERE r.s <= x.b)
    SELECT v AS vertex, min(s) AS root FROM r GROUP BY 1""")
def components(spark, d):
    return ops.components(_edges(spark, d), "left_id", "right_id", Scratch(spark, "episodes"))


def _trusted(spark, d):
    return _notices(spark, d).where("buyer_siren <> ''").groupBy(F.col("idx").alias("vertex")).agg(F.min("buyer_siren").alias("trusted_id"))


@Q.query()
def components_constrained(spark, d):
    return ops.constrained_components(_edges(spark, d), _trusted(spark, d), Scratch(spark, "episodes"))[0]


@Q.query()
def edge_decisions(spark, d):
    log = ops.constrained_components(_edges(spark, d), _trusted(spark, d), Scratch(spark, "episodes"))[1]
    return log.groupBy("priority", "decision").agg(F.count(F.lit(1)).alias("n"))


@Q.query()
def episode_table(spark, d):
    """Every notice's episode with its identifier, size, first and last day, methods and conflicts."""
    scratch = Scratch(spark, "episodes")
    roots, log = ops.constrained_components(_edges(spark, d), _trusted(spark, d), scratch)
    n = _notices(spark, d)
    m = n.join(roots.select(F.col("vertex").alias("idx"), "root"), "idx", "left").withColumn("root", F.coalesce("root", "idx"))
    mask = log.where("decision <> 'trusted_buyer_conflict'").select(F.explode(F.array("left_id", "right_id")).alias("idx"), F.shiftleft(F.lit(1), 0).alias("one"), "priority")
    mask = mask.groupBy("idx").agg(F.bit_or(F.when(F.col("priority") == 1, 1).when(F.col("priority") == 2, 2).otherwise(4)).alias("mask"))
    m = scratch.write(m.join(mask, "idx", "left"), "members")
    g = m.groupBy("root").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.bit_or("mask").alias("mask"), F.array_sort(F.collect_set(F.when(F.col("buyer_siren") != "", F.col("buyer_siren")))).alias("sirens"), F.array_sort(F.collect_set("procedure_reference")).alias("references"))
    primary = F.when(F.col("mask").bitwiseAND(1) > 0, ops.METHODS[0]).when(F.col("mask").bitwiseAND(2) > 0, ops.METHODS[1]).when(F.col("mask").bitwiseAND(4) > 0, ops.METHODS[2]).otherwise("singleton")
    return ops.episode_ids(m, "root", "idweb").join(g, "root").select("episode_id", F.col("n").alias("notices"), "first_day", "last_day", F.datediff("last_day", "first_day").alias("span_days"), primary.alias("method"), F.when(F.size("sirens") == 1, F.col("sirens")[0]).otherwise("").alias("siren"), (F.size("sirens") > 1).alias("buyer_conflict"), (F.size("references") > 1).alias("reference_conflict"))


# --- trends ----------------------------------------------------------------------------------------------------

_START, _END = "1995-01-01", "2001-04-01"
_PANEL = f"""(SELECT s.segment, CAST(q AS DATE) AS quarter, coalesce(n, 0) AS n FROM (SELECT DISTINCT c_mktsegment AS segment FROM customer UNION SELECT 'Overall') s CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '{_START}', TIMESTAMP '{_END}', INTERVAL 3 MONTH)) AS q)
    LEFT JOIN (SELECT c_mktsegment AS segment, date_trunc('quarter', o_orderdate) AS qq, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2 UNION ALL SELECT 'Overall', date_trunc('quarter', o_orderdate), count(*) FROM orders GROUP BY 2) c ON c.segment = s.segment AND c.qq = q)"""


def _panel(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return trend.quarterly_panel(j, "o_orderdate", "c_mktsegment", _START, _END)


@Q.query(f"SELECT segment, quarter, n FROM {_PANEL}")
def quarterly_panel(spark, d):
    return _panel(spark, d)


@Q.query(f"""SELECT segment, round(slope, 6) AS slope, round(4 * slope, 6) AS annualised, round(mean, 6) AS mean, round(r2, 6) AS r2 FROM (SELECT segment, regr_slope(n, x) AS slope, regr_r2(n, x) AS r2, avg(n) AS mean FROM (SELECT segment, n, 12 - row_number() OVER (PARTITION BY segment ORDER BY quarter DESC) AS x FROM {_PANEL} p) WHERE x >= 0 GROUP BY 1)""")
def recent_trend(spark, d):
    return trend.recent_slope(_panel(spark, d)).select("segment", *[F.round(c, 6).alias(c) for c in ("slope", "annualised", "mean", "r2")])


def _t_tail(t):
    return t.map(lambda v: t_sf2(v, 10) if v == v else 1.0).astype(float)


_t_tail.__annotations__ = {"t": pd.Series, "return": pd.Series}


@Q.query(f"""WITH r AS (SELECT segment, regr_slope(n, x) AS slope, regr_r2(n, x) AS r2 FROM (SELECT segment, n, 12 - row_number() OVER (PARTITION BY segment ORDER BY quarter DESC) AS x FROM {_PANEL} p) WHERE x >= 0 GROUP BY 1)
    SELECT segment, round(slope, 6) AS slope, round(t, 6) AS t_stat, CASE WHEN abs(t) > {trend.T_TEN} AND slope > 0 THEN 'increasing' WHEN abs(t) > {trend.T_TEN} AND slope < 0 THEN 'decreasing' ELSE 'stable_or_uncertain' END AS state FROM (SELECT *, sign(slope) * sqrt(r2 * 10 / (1 - r2)) AS t FROM r)""")
def trend_state(spark, d):
    s = trend.direction(trend.recent_slope(_panel(spark, d)))
    return s.select("segment", F.round("slope", 6).alias("slope"), F.round("t_stat", 6).alias("t_stat"), "state")


@Q.query()
def trend_signal(spark, d):
    """The direction of each series with the probability of its slope under none."""
    p = F.pandas_udf(_t_tail, "double")("t_stat")
    return trend.direction(trend.recent_slope(_panel(spark, d))).select("segment", "slope", p.alias("p_value"), "state")


@Q.query()
def pelt_breaks(spark, d):
    return trend.by_series(_panel(spark, d), lambda v: [(m, trend.break_points(v, m)) for m in (0.5, 1.0, 2.0)], "multiplier double, breaks array<int>")


@Q.query()
def stable_breaks(spark, d):
    return trend.by_series(_panel(spark, d), lambda v: [(trend.stable_breaks(v),)], "stable array<int>")


@Q.query()
def adf_kpss(spark, d):
    def kernel(v):
        u = trend.unit_root(v)
        return [(u["adf"], u["adf_lags"], u["adf_rejects"], u["kpss"], u["kpss_lags"], u["kpss_rejects"])] if u else []

    return trend.by_series(_panel(spark, d), kernel, "adf double, adf_lags int, adf_rejects boolean, kpss double, kpss_lags int, kpss_rejects boolean")


@Q.query()
def hmm_regimes(spark, d):
    def kernel(v):
        r = trend.regimes(v)
        return [(r["regime"], r["probability"], r["means"])] if r else []

    return trend.by_series(_panel(spark, d), kernel, "regime string, probability double, means array<double>")
