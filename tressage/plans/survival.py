"""Time to the next order of a customer, right-censored at the end of the data, and its analysis."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import survival as ops
from ..runtime import table
from .registry import Registry

Q = Registry()

HORIZONS = (12.0, 24.0, 36.0, 48.0, 60.0)
#: An award is a filled order; its successor the customer's first order at least 90 days later.
_BASE = """
    WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS st, o_totalprice AS price, o_orderpriority AS pr FROM orders), cut AS (SELECT max(day) AS last FROM o),
    l AS (SELECT a.k, min(date_diff('day', a.day, b.day)) AS gap FROM o a JOIN o b ON a.c = b.c WHERE a.st = 'F' AND date_diff('day', a.day, b.day) BETWEEN 90 AND 2920 GROUP BY 1),
    s AS (SELECT o.k AS id, c_mktsegment AS segment, r_name AS region, price, pr, year(o.day) AS award_year, CAST(l.gap IS NOT NULL AS INT) AS event, CAST(coalesce(l.gap, date_diff('day', o.day, last)) AS INT) AS days, CAST(date_diff('day', o.day, last) AS INT) AS to_cutoff
          FROM o CROSS JOIN cut LEFT JOIN l ON l.k = o.k JOIN customer ON c_custkey = o.c JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o.st = 'F'),
    x AS (SELECT *, round(greatest(days, 1) / 30.4375, 6) AS t FROM s)"""


def dataset(spark, d):
    """(id, segment, region, price, pr, award_year, event, days, to_cutoff, t) of every award.

    The next order is found by a window over each customer's orders, not by joining them with each other.
    """
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("st"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("pr"))
    days = F.unix_date("day")
    ahead = Window.partitionBy("c").orderBy(F.col("_d")).rangeBetween(90, 2920)
    o = o.withColumn("_d", days).withColumn("next", F.min("_d").over(ahead)).where("st = 'F'")
    last = table(spark, d, "orders").agg(F.unix_date(F.to_date(F.max("o_orderdate"))).alias("last"))
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    j = o.crossJoin(F.broadcast(last)).join(c, F.col("c_custkey") == F.col("c")).join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(r), F.col("r_regionkey") == F.col("n_regionkey"))
    gap = F.coalesce(F.col("next") - F.col("_d"), F.col("last") - F.col("_d"))
    return j.select(
        "id", F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"), "price", "pr", F.year("day").alias("award_year"), F.col("next").isNotNull().cast("int").alias("event"), gap.alias("days"),
        (F.col("last") - F.col("_d")).alias("to_cutoff"), F.round(F.greatest(gap, F.lit(1)) / 30.4375, 6).alias("t"))


@Q.query(_BASE + " SELECT id, segment, event, days, to_cutoff, t FROM x")
def survival_dataset(spark, d):
    return dataset(spark, d).select("id", "segment", "event", "days", "to_cutoff", "t")


_KM = """, g AS (SELECT segment, t, count(*) AS n, sum(event) AS d FROM x GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY segment ORDER BY t DESC) AS y FROM g),
    km AS (SELECT segment, t, n, d, y, CASE WHEN max(CAST(d = y AS INT)) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN d < y THEN ln(1 - d / y::DOUBLE) ELSE 0.0 END) OVER w) END AS s FROM r WINDOW w AS (PARTITION BY segment ORDER BY t))"""


@Q.query(_BASE + _KM + f" SELECT segment, CAST(m AS DOUBLE) AS months, round(coalesce(min(s) FILTER (t <= m), 1.0), 8) AS survival FROM km, (SELECT unnest({list(HORIZONS)}) AS m) GROUP BY 1, 2")
def km_by_segment(spark, d):
    t = ops.life_table(dataset(spark, d), ["segment"])
    return ops.survival_at(t, list(HORIZONS), ["segment"]).withColumn("survival", F.round("survival", 8))


_ALL = _BASE.replace("c_mktsegment AS segment", "'all' AS segment")


@Q.query(_ALL + _KM + " SELECT t, CAST(n AS BIGINT) AS n, CAST(d AS BIGINT) AS d, CAST(y AS BIGINT) AS at_risk, round(s, 8) AS survival FROM km")
def km_overall(spark, d):
    return ops.life_table(dataset(spark, d)).withColumn("survival", F.round("survival", 8))


@Q.query(_BASE + _KM + " SELECT segment, coalesce(min(t) FILTER (s <= 0.5), 'inf'::DOUBLE) AS median FROM km GROUP BY 1")
def km_median(spark, d):
    return ops.median_survival(ops.life_table(dataset(spark, d), ["segment"]), ["segment"])


@Q.query(_BASE + _KM + """, v AS (SELECT segment, m, coalesce(min(s) FILTER (t <= m), 1.0) AS s FROM km, (SELECT unnest([6.0, 12.0, 18.0, 24.0, 30.0, 36.0]) AS m) GROUP BY 1, 2)
    SELECT a.segment, CAST(a.m AS DOUBLE) AS age, CASE WHEN a.s > 0 THEN round(1 - b.s / a.s, 8) END AS probability FROM v a JOIN v b ON a.segment = b.segment AND b.m = a.m + 12 WHERE a.m IN (6, 12, 24)""")
def conditional_probability(spark, d):
    t = ops.life_table(dataset(spark, d), ["segment"])
    return ops.conditional_probability(t, [6.0, 12.0, 24.0], 12.0, ["segment"]).withColumn("probability", F.round("probability", 8))


@Q.query(_BASE + """, tt AS (SELECT t, sum(event) AS dd, count(*) AS nn FROM x GROUP BY 1), ev AS (SELECT t, dd, sum(nn) OVER (ORDER BY t DESC) AS yy FROM tt), e AS (SELECT * FROM ev WHERE dd > 0),
    gt AS (SELECT segment, t, count(*) AS n, sum(event) AS d FROM x GROUP BY 1, 2), grid AS (SELECT coalesce(z.segment, gt.segment) AS segment, coalesce(z.t, gt.t) AS t, dd, yy, coalesce(n, 0) AS n, coalesce(d, 0) AS d FROM (SELECT * FROM e CROSS JOIN (SELECT DISTINCT segment FROM x)) z FULL JOIN gt ON gt.segment = z.segment AND gt.t = z.t),
    q AS (SELECT *, sum(n) OVER (PARTITION BY segment ORDER BY t DESC) AS y FROM grid)
    SELECT segment, CAST(sum(d) AS BIGINT) AS observed, round(sum(dd * y / yy::DOUBLE), 6) AS expected FROM q WHERE dd IS NOT NULL GROUP BY 1""")
def logrank_counts(spark, d):
    return ops.logrank_counts(dataset(spark, d), "segment").withColumn("expected", F.round("expected", 6))


@Q.query(_BASE + " SELECT segment, count(*) AS n, CAST(sum(event) AS BIGINT) AS events, round(sum(event) / count(*)::DOUBLE, 4) AS rate, round(quantile_cont(days, 0.5) FILTER (event = 1), 4) AS median_gap, bool_and(days >= 0) AS valid FROM x GROUP BY 1")
def survival_description(spark, d):
    s = dataset(spark, d)
    return s.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event").cast("bigint")).alias("events"), F.round(F.sum("event") / F.count(F.lit(1)), 4).alias("rate"), F.round(F.percentile(F.when(F.col("event") == 1, F.col("days")), F.lit(0.5)), 4).alias("median_gap"), F.bool_and(F.col("days") >= 0).alias("valid"))


@Q.query(_BASE + """ SELECT name, round(CASE WHEN na < 2 OR nb < 2 THEN NULL WHEN va + vb = 0 THEN 0.0 ELSE (ma - mb) / sqrt((va + vb) / 2) END, 6) AS difference FROM (
      SELECT 'price' AS name, avg(price) FILTER (event = 1) AS ma, avg(price) FILTER (event = 0) AS mb, var_samp(price) FILTER (event = 1) AS va, var_samp(price) FILTER (event = 0) AS vb, count(price) FILTER (event = 1) AS na, count(price) FILTER (event = 0) AS nb FROM x
      UNION ALL SELECT 'to_cutoff', avg(to_cutoff) FILTER (event = 1), avg(to_cutoff) FILTER (event = 0), var_samp(to_cutoff) FILTER (event = 1), var_samp(to_cutoff) FILTER (event = 0), count(*) FILTER (event = 1), count(*) FILTER (event = 0) FROM x)""")
def smd_table(spark, d):
    s = dataset(spark, d)
    one = lambda c: ops.standardised_difference(s, c, "event").select(F.lit(c).alias("name"), F.round("difference", 6).alias("difference"))
    return one("price").unionByName(one("to_cutoff"))


@Q.query(_BASE + " SELECT 'segment' AS category, segment AS level, count(*) AS n, CAST(sum(event) AS BIGINT) AS events FROM x GROUP BY 2 UNION ALL SELECT 'region', region, count(*), CAST(sum(event) AS BIGINT) FROM x GROUP BY 2 UNION ALL SELECT 'year', CAST(award_year AS VARCHAR), count(*), CAST(sum(event) AS BIGINT) FROM x GROUP BY 2")
def selection_by_category(spark, d):
    s = dataset(spark, d)
    long_ = s.select("event", F.explode(F.array(*[F.struct(F.lit(a).alias("category"), c.cast("string").alias("level")) for a, c in (("segment", F.col("segment")), ("region", F.col("region")), ("year", F.col("award_year")))])).alias("x"))
    return long_.groupBy("x.category", "x.level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event").cast("bigint")).alias("events"))


@Q.query(_BASE + """, z AS (SELECT t, event, award_year AS risk FROM x), c AS (SELECT t, event, risk, count(*) AS n FROM z GROUP BY ALL)
    SELECT CAST(sum(CASE WHEN a.risk > b.risk THEN a.n * b.n ELSE 0 END) AS BIGINT) AS concordant, CAST(sum(CASE WHEN a.risk < b.risk THEN a.n * b.n ELSE 0 END) AS BIGINT) AS discordant, CAST(sum(CASE WHEN a.risk = b.risk THEN a.n * b.n ELSE 0 END) AS BIGINT) AS tied,
      round((sum(CASE WHEN a.risk > b.risk THEN a.n * b.n ELSE 0 END) + 0.5 * sum(CASE WHEN a.risk = b.risk THEN a.n * b.n ELSE 0 END)) / sum(a.n * b.n), 6) AS c_index
    FROM c a JOIN c b ON (b.t > a.t OR (b.t = a.t AND b.event = 0)) WHERE a.event = 1""")
def concordance(spark, d):
    return ops.concordance(dataset(spark, d).select("t", "event", F.col("award_year").alias("risk")))


_LINKS = """
    WITH p AS (SELECT anchor_episode_id AS a, candidate_episode_id AS c, max(CASE WHEN text_component IS NULL OR isnan(text_component) THEN 0.0 ELSE text_component END) AS s, max(CASE WHEN word_tfidf_similarity IS NULL OR isnan(word_tfidf_similarity) THEN 0.0 ELSE word_tfidf_similarity END) AS w, min(gap_days) AS gap FROM candidate_pairs GROUP BY 1, 2),
    anchors AS (SELECT anchor_episode_id AS a, CAST(date_diff('day', max(CAST(anchor_award_date AS DATE)), (SELECT max(CAST(candidate_origin_date AS DATE)) FROM candidate_pairs)) AS INT) AS to_cutoff FROM candidate_pairs GROUP BY 1),
    top AS (SELECT a, max_by(struct_pack(c := c, w := w, gap := gap), (s, c)) AS t FROM p WHERE s >= 0.5 GROUP BY 1),
    l AS (SELECT anchors.a, to_cutoff, t.c AS c, t.gap AS gap, t.w AS w, count(*) OVER (PARTITION BY t.c) AS uses FROM anchors LEFT JOIN top USING (a))"""


@Q.query(_LINKS + " SELECT a AS anchor_episode_id, CAST(c IS NOT NULL AND NOT (w < 0.5 OR uses > 1) AS INT) AS event, CASE WHEN c IS NOT NULL AND NOT (w < 0.5 OR uses > 1) THEN gap ELSE to_cutoff END AS days, coalesce(c IS NOT NULL AND (w < 0.5 OR uses > 1), false) AS flagged FROM l")
def recensor_flagged(spark, d):
    """Accepted links that a template may explain, by few shared words or a successor that others have too, censored again."""
    from ..operators.linkage import ANCHOR, CANDIDATE, _zero

    p = table(spark, d, "candidate_pairs")
    last = p.agg(F.max(F.to_date("candidate_origin_date")).alias("last"))
    one = p.groupBy(ANCHOR, CANDIDATE).agg(F.max(_zero("text_component")).alias("s"), F.max(_zero("word_tfidf_similarity")).alias("w"), F.min("gap_days").alias("gap"), F.max(F.to_date("anchor_award_date")).alias("award"))
    top = one.groupBy(ANCHOR).agg(F.max("award").alias("award"), F.max_by(F.struct(F.col(CANDIDATE).alias("c"), "w", "gap"), F.when(F.col("s") >= 0.5, F.struct("s", CANDIDATE))).alias("t"))
    uses = top.where("t is not null").groupBy(F.col("t.c").alias("c")).agg(F.count(F.lit(1)).alias("uses"))
    j = top.select(ANCHOR, "award", "t.c", "t.w", "t.gap").join(uses, "c", "left").crossJoin(F.broadcast(last))  # one row
    linked = F.col("c").isNotNull()
    flagged = F.coalesce(linked & ((F.col("w") < 0.5) | (F.col("uses") > 1)), F.lit(False))
    return j.select(ANCHOR, (linked & ~flagged).cast("int").alias("event"), F.when(linked & ~flagged, F.col("gap")).otherwise(F.datediff("last", "award")).alias("days"), flagged.alias("flagged"))


@Q.query(_BASE + " SELECT segment, count(*) AS kept, CAST(sum(event) AS BIGINT) AS events FROM x WHERE NOT coalesce(price BETWEEN 200000 AND 300000, false) GROUP BY 1")
def borderline_excluded(spark, d):
    s = dataset(spark, d).where(~F.coalesce(F.col("price").between(200000, 300000), F.lit(False)))
    return s.groupBy("segment").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.col("event").cast("bigint")).alias("events"))


@Q.query(_BASE + " SELECT CAST(arm AS INT) AS arm, segment, CAST(count(*) FILTER (event = 1 AND days >= arm) AS BIGINT) AS events, round(avg(CAST(event = 1 AND days >= arm AS INT)), 6) AS rate FROM x, (SELECT unnest([90, 180, 365, 730]) AS arm) GROUP BY 1, 2")
def arm_sensitivity(spark, d):
    s = dataset(spark, d).withColumn("arm", F.explode(F.array(*map(F.lit, (90, 180, 365, 730)))))
    hit = (F.col("event") == 1) & (F.col("days") >= F.col("arm"))
    return s.groupBy("arm", "segment").agg(F.count_if(hit).alias("events"), F.round(F.avg(hit.cast("int")), 6).alias("rate"))


@Q.query(_BASE + _KM + """, c AS (SELECT id, segment, to_cutoff / 30.4375 AS age FROM x WHERE event = 0 AND award_year >= 2000),
    p AS (SELECT c.id, c.segment, coalesce(min(s) FILTER (km.t <= age), 1.0) AS now, coalesce(min(s) FILTER (km.t <= age + 12), 1.0) AS then_ FROM c JOIN km USING (segment) GROUP BY 1, 2)
    SELECT id, segment, round(1 - then_ / now, 6) AS probability, rank_no FROM (SELECT *, CAST(row_number() OVER (PARTITION BY segment ORDER BY round(1 - then_ / now, 6) DESC, id) AS INT) AS rank_no FROM p WHERE now > 0) WHERE rank_no <= 5""")
def watchlist(spark, d):
    """Censored awards by the chance of an event within a year, given the segment's curve at their age."""
    s = dataset(spark, d)
    c = s.where("event = 0 and award_year >= 2000").select("id", "segment", (F.col("to_cutoff") / 30.4375).alias("age"))
    p = ops.asof_steps(c, ops.life_table(s, ["segment"]), ["segment"], "age", [0.0, 12.0])
    p = p.where("s0 > 0").withColumn("probability", F.round(1 - F.col("s1") / F.col("s0"), 6))
    w = Window.partitionBy("segment").orderBy(F.desc("probability"), "id")
    return p.withColumn("rank_no", F.row_number().over(w)).where("rank_no <= 5").select("id", "segment", "probability", "rank_no")


@Q.query("""
    WITH g AS (SELECT DISTINCT sample_id, anchor_theme, TRY_CAST(publication_gap_days AS INT) / 30.4375 AS declared, date_diff('day', TRY_CAST(anchor_award_notice_date AS DATE), TRY_CAST(candidate_start_date AS DATE)) / 30.4375 AS observed FROM confirmed_links)
    SELECT anchor_theme AS segment, count(*) AS n, round(avg(CAST(abs(observed - declared) <= 6 AS INT)), 6) AS within6, round(quantile_cont(abs(observed - declared), 0.5), 6) AS median_abs FROM g WHERE declared IS NOT NULL AND observed IS NOT NULL GROUP BY 1""")
def declared_vs_observed(spark, d):
    """The gap a reviewer wrote down against the one between the dates, in months."""
    c = table(spark, d, "confirmed_links")
    day = lambda x: F.col(x).try_cast("date")
    g = c.select("sample_id", "anchor_theme", (F.col("publication_gap_days").try_cast("int") / 30.4375).alias("declared"), (F.datediff(day("candidate_start_date"), day("anchor_award_notice_date")) / 30.4375).alias("observed")).distinct()
    g = g.where("declared is not null and observed is not null").withColumn("gap", F.abs(F.col("observed") - F.col("declared")))
    return g.groupBy(F.col("anchor_theme").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("gap") <= 6).cast("int")), 6).alias("within6"), F.round(F.percentile("gap", F.lit(0.5)), 6).alias("median_abs"))


@Q.query(_ALL + _KM + " SELECT round(regr_slope(ln(-ln(s)), ln(t)), 6) AS weibull_slope, round(regr_r2(ln(-ln(s)), ln(t)), 6) AS weibull_r2, round(regr_slope(ln((1 - s) / s), ln(t)), 6) AS loglogistic_slope FROM km WHERE s > 0 AND s < 1")
def linearised_fit(spark, d):
    t = ops.life_table(dataset(spark, d)).where("survival > 0 and survival < 1").select(F.log("t").alias("x"), F.log(-F.log("survival")).alias("w"), F.log((1 - F.col("survival")) / F.col("survival")).alias("l"))
    return t.agg(F.round(F.regr_slope("w", "x"), 6).alias("weibull_slope"), F.round(F.regr_r2("w", "x"), 6).alias("weibull_r2"), F.round(F.regr_slope("l", "x"), 6).alias("loglogistic_slope"))


def _design(spark, d):
    s = dataset(spark, d)
    return s.select("t", "event", *[(F.col("segment") == v).cast("int").alias(f"segment_{v.lower()}") for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")], (F.col("price") > 250000).cast("int").alias("large"), (F.col("award_year") - 1997).alias("award_year"))


_COVARIATES = ["segment_building", "segment_furniture", "segment_household", "segment_machinery", "large", "award_year"]


#: Minimum gaps in months under which an event counts.
ARMS = {"3m": 3.0, "6m": 6.0, "12m": 12.0, "24m": 24.0}


def arms(spark, d):
    """Each arm with its counted patterns; rows are counted once for all of them."""
    p = ops.bounded(ops.patterns(_design(spark, d), _COVARIATES), ops.MOST_PATTERNS, "patterns").toPandas()
    return [(arm, p.assign(event=((p.event == 1) & (p.t >= months)).astype(int))) for arm, months in ARMS.items()]


@Q.query()
def concordance_out_of_time(spark, d):
    """The concordance of one model, fitted to awards up to 1997, within them and on the years after."""
    base = _design(spark, d)
    fitted = [c for c in _COVARIATES if c != "award_year"]
    fit = ops.cox(base.where("award_year <= 0"), fitted)
    risk = sum((F.lit(fit["beta"][c]) * F.col(c) for c in fitted), F.lit(0.0))
    scored = base.select("t", "event", "award_year", F.round(risk, 9).alias("risk"))
    out = None
    for name, rows in (("train", "award_year <= 0"), ("1998-1999", "award_year between 1 and 2"), ("1998-2001", "award_year between 1 and 4")):
        one = ops.concordance(scored.where(rows)).select(F.lit(name).alias("period"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@Q.query()
def logrank(spark, d):
    r = ops.logrank(dataset(spark, d), "segment")
    return spark.createDataFrame([(r["chi2"], r["df"], r["p"])], "chi2 double, df int, p double")


@Q.query()
def cox(spark, d):
    fit = ops.cox(_design(spark, d), _COVARIATES)
    names = ("covariate", "coef", "hazard_ratio", "se", "low", "high", "p")
    return spark.createDataFrame([tuple(r[n] for n in names) for r in fit["rows"]], "covariate string, coef double, hazard_ratio double, se double, low double, high double, p double")


@Q.query()
def ph_test(spark, d):
    p = ops.patterns(_design(spark, d), _COVARIATES)
    rows = ops.ph_test(p, _COVARIATES, ops.cox_fit(p, _COVARIATES)["beta"])
    return spark.createDataFrame([(r["covariate"], r["rho"], r["chi2"], r["p"]) for r in rows], "covariate string, rho double, chi2 double, p double")


@Q.query()
def parametric(spark, d):
    fits = ops.parametric_fits(dataset(spark, d))
    return spark.createDataFrame([(f["family"], f["params"], f["loglik"], f["aic"], f["bic"]) for f in fits], "family string, params array<double>, loglik double, aic double, bic double")


@Q.query()
def km_bootstrap(spark, d):
    b = ops.bootstrap_conditionals(dataset(spark, d), [0.0, 12.0, 24.0, 36.0, 48.0], [12.0, 24.0])
    return b.groupBy("age", "horizon").agg(F.count(F.lit(1)).alias("draws"), F.percentile("probability", F.lit(0.025)).alias("low"), F.percentile("probability", F.lit(0.5)).alias("median"), F.percentile("probability", F.lit(0.975)).alias("high"))
