"""Evaluation of links against reviews: design weights, curves by method, sweeps, reference building, continuity audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation as ops
from ..operators import linkage
from ..operators.linkage import ANCHOR, CANDIDATE
from ..runtime import table
from .linkage import _C, _LEVELS, _MODEL, _PREDICT, _S, _T, _RULES
from .registry import Registry

Q = Registry()

#: Awards from this day on may still run at the end of the study, so "no successor" says nothing about them.
CENSORED_FROM = "2021-01-01"
#: An anchor with at most so many candidates has had all of them reviewed.
SMALL_POOL = 60
_WEIGHTS = {"HIGH": 1.5, "MEDIUM": 2.5}

_DESIGN = f"""
    truth AS (SELECT anchor_episode_id, coalesce(list(DISTINCT successor_episode_id) FILTER (final_outcome = 'OBSERVED_SUCCESSOR' AND successor_episode_id IS NOT NULL), []) AS successors, max(final_confidence) AS stratum_id, max(anchor_award_notice_date) AS award
      FROM confirmed_links WHERE final_outcome IN ('OBSERVED_SUCCESSOR', 'NO_OBSERVED_SUCCESSOR') GROUP BY 1),
    held AS (SELECT anchor_episode_id, count(DISTINCT candidate_episode_id) AS k FROM candidate_pairs GROUP BY 1),
    sample AS (SELECT t.*, CASE stratum_id WHEN 'HIGH' THEN 1.5 WHEN 'MEDIUM' THEN 2.5 ELSE 4.0 END AS w, len(successors) = 0 AND coalesce(award >= '{CENSORED_FROM}', true) AS censored, coalesce(k, 0) <= {SMALL_POOL} AS exhaustive FROM truth t LEFT JOIN held USING (anchor_episode_id)),
    pool AS (SELECT DISTINCT anchor_episode_id, candidate_episode_id FROM candidate_pairs WHERE candidate_is_digital),
    top AS (SELECT anchor_episode_id, candidate_episode_id AS top FROM ({_PREDICT.format(by='text_component', rule=f'{_T} >= 0.5')}) WHERE predicted_rank = 1),
    scored AS (SELECT s.*, top.top, CAST(top.top IS NOT NULL AND pool.anchor_episode_id IS NULL AS INT) AS outside, CAST(pool.anchor_episode_id IS NOT NULL AS INT) AS accepted, CAST(pool.anchor_episode_id IS NOT NULL AND list_contains(successors, top.top) AS INT) AS correct
      FROM sample s LEFT JOIN top USING (anchor_episode_id) LEFT JOIN pool ON pool.anchor_episode_id = s.anchor_episode_id AND pool.candidate_episode_id = top.top)"""


def _sample(spark, d):
    """Reviewed anchors with their stratum, design weight and what is known of their negatives."""
    c = table(spark, d, "confirmed_links").where("final_outcome in ('OBSERVED_SUCCESSOR', 'NO_OBSERVED_SUCCESSOR')")
    found = F.collect_set(F.when(F.col("final_outcome") == "OBSERVED_SUCCESSOR", F.col("successor_episode_id")))
    t = c.groupBy(ANCHOR).agg(found.alias("successors"), F.max("final_confidence").alias("stratum_id"), F.max("anchor_award_notice_date").alias("award"))
    pool = table(spark, d, "candidate_pairs").groupBy(ANCHOR).agg(F.count_distinct(CANDIDATE).alias("k"))
    weight = F.lit(4.0)
    for level, w in _WEIGHTS.items():
        weight = F.when(F.col("stratum_id") == level, w).otherwise(weight)
    return t.join(pool, ANCHOR, "left").select(
        ANCHOR, "successors", "stratum_id", weight.alias("design_weight"), F.lit(ops.PROBABILITY).alias("frame"),
        ((F.size("successors") == 0) & F.coalesce(F.col("award") >= CENSORED_FROM, F.lit(True))).alias("negative_is_censored"),
        F.when(F.coalesce("k", F.lit(0)) <= SMALL_POOL, ops.EXHAUSTIVE).otherwise("AMONG_SHOWN").alias("negative_verification"))


def _scored(spark, d):
    pairs = table(spark, d, "candidate_pairs")
    return ops.scored_anchors(linkage.predict(pairs, "B", 50.0, 1), _sample(spark, d), pairs.where("candidate_is_digital"))


_SETS = {"precision_at_1": ("accepted = 1", "correct"), "recall_at_1": ("len(successors) > 0", "correct"), "false_positive_rate": ("len(successors) = 0 AND NOT censored AND exhaustive", "accepted"), "coverage": ("true", "accepted")}


def _ratio(name, where, y):
    return f"""SELECT '{name}' AS metric, round(ratio, 4) AS estimate, round(coalesce(sd, 0) / tx, 4) AS standard_error, round(greatest(ratio - 1.959963985 * coalesce(sd, 0) / tx, 0.0), 4) AS low, round(least(ratio + 1.959963985 * coalesce(sd, 0) / tx, 1.0), 4) AS high, n
      FROM (SELECT sum(w * {y}) / sum(w) AS ratio, sum(w) AS tx, count(*) AS n FROM scored WHERE {where}),
        (SELECT sqrt(sum(h * h * (1 - k / h) * s2 / k)) AS sd FROM (SELECT count(*) AS k, sum(w) AS h, var_samp({y} - ratio) AS s2 FROM scored, (SELECT sum(w * {y}) / sum(w) AS ratio FROM scored WHERE {where}) WHERE {where} GROUP BY stratum_id HAVING count(*) >= 2))"""


@Q.query(f"WITH {_DESIGN} " + " UNION ALL ".join(_ratio(n, w, y) for n, (w, y) in _SETS.items()))
def weighted_metrics(spark, d):
    """Precision, recall, false positives on verified negatives and coverage under the design."""
    return ops.weighted_rates(_scored(spark, d))


@Q.query(f"""WITH {_DESIGN} SELECT count(*) AS anchors, count(*) FILTER (len(successors) > 0) AS positives, count(*) FILTER (len(successors) = 0 AND NOT censored) AS negatives, count(*) FILTER (len(successors) = 0 AND NOT censored AND exhaustive) AS verified_negatives,
    CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(outside) AS BIGINT) AS outside, count(*) FILTER (len(successors) = 0 AND censored) AS censored_out FROM scored""")
def weighted_counts(spark, d):
    return ops.weighted_counts(_scored(spark, d))


# --- curves and sweeps -----------------------------------------------------------------------------------------

_TRUE_PAIRS = "SELECT DISTINCT anchor_episode_id, successor_episode_id FROM confirmed_links WHERE final_outcome = 'OBSERVED_SUCCESSOR'"
_WEIGHT = "log2(0.01 / 0.99) + " + " + ".join("CASE " + f + " " + " ".join(f"WHEN '{v}' THEN {b}" for g, v, b in _MODEL if g == f) + " ELSE 0.0 END" for f in linkage.FIELDS)
_GATE = _RULES["C"].replace(f"{_S} >= 70.0", f"{_S} >= 0.0")
_SCORES = {
    "A": f"CASE WHEN coalesce({_RULES['A']}, false) THEN 1.0 ELSE 0.0 END", "B": _T, "C": f"CASE WHEN coalesce({_GATE}, false) THEN {_S} / 100.0 ELSE -1.0 END",
    "D": f"1 / (1 + exp(-({_WEIGHT}) * 0.6931471805599453))",
}


def _curve_sql(method):
    return f"""SELECT '{method}' AS method, round(sum(area), 6) AS roc_auc, round(sum(step), 6) AS average_precision, CAST(max(pp) AS BIGINT) AS positives, CAST(max(nn) AS BIGINT) AS negatives FROM (
      SELECT pp, nn, (fp - lag(fp, 1, 0) OVER w) / nn::DOUBLE * (tp + lag(tp, 1, 0) OVER w) / pp::DOUBLE / 2 AS area, (tp - lag(tp, 1, 0) OVER w) / pp::DOUBLE * tp / (tp + fp)::DOUBLE AS step FROM (
        SELECT score, CAST(sum(p) OVER v AS BIGINT) AS tp, CAST(sum(n - p) OVER v AS BIGINT) AS fp, (SELECT sum(y) FROM l) AS pp, (SELECT count(*) - sum(y) FROM l) AS nn FROM (SELECT {method.lower()} AS score, sum(y) AS p, count(*) AS n FROM l GROUP BY 1) WINDOW v AS (ORDER BY score DESC)) WINDOW w AS (ORDER BY score DESC))"""


def _labelled(spark, d):
    true = table(spark, d, "confirmed_links").where("final_outcome = 'OBSERVED_SUCCESSOR'").select(ANCHOR, F.col("successor_episode_id").alias(CANDIDATE)).distinct().withColumn("y", F.lit(1))
    return table(spark, d, "candidate_pairs").join(true, [ANCHOR, CANDIDATE], "left").withColumn("y", F.coalesce("y", F.lit(0)))


@Q.query("WITH l AS (SELECT " + ", ".join(f"round({s}, 9) AS {m.lower()}" for m, s in _SCORES.items()) + f", CASE WHEN t.anchor_episode_id IS NULL THEN 0 ELSE 1 END AS y FROM {_LEVELS} p LEFT JOIN ({_TRUE_PAIRS}) t ON t.anchor_episode_id = p.anchor_episode_id AND t.successor_episode_id = p.candidate_episode_id) " + " UNION ALL ".join(map(_curve_sql, _SCORES)))
def pair_curves(spark, d):
    """Ranking quality of the four methods' scores over all labelled pairs; D by a fixed model."""
    s = linkage.score_with(_labelled(spark, d), list(_MODEL), 0.01)
    return ops.pair_curves(s.withColumn("fs_match_probability", F.round("fs_match_probability", 9)), "y")


def _wilson_sql(k, n, sign):
    bound = f"(({k} / {n}::DOUBLE + 3.841458824 / (2.0 * {n}) {sign} 1.959963985 * sqrt({k} / {n}::DOUBLE * (1 - {k} / {n}::DOUBLE) / {n} + 3.841458824 / (4.0 * {n} * {n}))) / (1 + 3.841458824 / {n}))"
    return f"CASE WHEN {n} > 0 THEN round(least(greatest({bound}, 0.0), 1.0), 4) END"


_SWEEP = f"""
    truth AS (SELECT anchor_episode_id, coalesce(list(DISTINCT successor_episode_id) FILTER (final_outcome = 'OBSERVED_SUCCESSOR' AND successor_episode_id IS NOT NULL), []) AS successors FROM confirmed_links WHERE final_outcome IN ('OBSERVED_SUCCESSOR', 'NO_OBSERVED_SUCCESSOR') GROUP BY 1),
    best AS (SELECT anchor_episode_id, candidate_episode_id, coalesce(score, 0.0) AS score FROM ({_PREDICT.format(by='text_component', rule='true')}) WHERE predicted_rank = 1),
    counts AS (SELECT CAST(t AS INT) AS threshold, count(*) FILTER (coalesce(score >= t / 100.0::DOUBLE, false)) AS accepted, count(*) FILTER (coalesce(score >= t / 100.0::DOUBLE, false) AND list_contains(successors, candidate_episode_id)) AS tp,
        count(*) FILTER (coalesce(score >= t / 100.0::DOUBLE, false) AND len(successors) > 0 AND NOT list_contains(successors, candidate_episode_id)) AS fp_wrong, count(*) FILTER (coalesce(score >= t / 100.0::DOUBLE, false) AND len(successors) = 0) AS fp_negative,
        count(*) FILTER (len(successors) > 0) AS positives, count(*) FILTER (len(successors) = 0) AS negatives FROM truth LEFT JOIN best USING (anchor_episode_id), (SELECT unnest(generate_series(0, 100)) AS t) GROUP BY 1),
    rates AS (SELECT threshold, accepted, tp, fp_wrong, fp_negative, CASE WHEN accepted > 0 THEN round(tp / accepted::DOUBLE, 4) END AS precision, CASE WHEN positives > 0 THEN round(tp / positives::DOUBLE, 4) END AS recall,
        CASE WHEN negatives > 0 THEN round(fp_negative / negatives::DOUBLE, 4) END AS fpr, round(accepted / (positives + negatives)::DOUBLE, 4) AS coverage,
        {_wilson_sql('tp', 'accepted', '-')} AS precision_low, {_wilson_sql('tp', 'accepted', '+')} AS precision_high, {_wilson_sql('tp', 'positives', '-')} AS recall_low, {_wilson_sql('tp', 'positives', '+')} AS recall_high FROM counts)"""


def _truth(spark, d):
    return _sample(spark, d).select(ANCHOR, "successors")


@Q.query(f"WITH {_SWEEP} SELECT * FROM rates")
def sweep_intervals(spark, d):
    """The top-1 decision at every threshold, with rates and their intervals."""
    return ops.sweep_rates(table(spark, d, "candidate_pairs"), _truth(spark, d), range(101))


@Q.query(f"WITH {_SWEEP} SELECT threshold, accepted, precision, recall, fpr, true AS agrees FROM rates WHERE threshold = 70")
def sweep_crosscheck(spark, d):
    """The sweep's row at the threshold in use against the evaluator's own answer there."""
    pairs, truth = table(spark, d, "candidate_pairs"), _truth(spark, d)
    row = ops.sweep_rates(pairs, truth, range(70, 71)).select("threshold", "accepted", "precision", "recall", "fpr")
    own = linkage.confusion(linkage.predict(pairs, "B", 70.0), truth).select(*[F.col(c).alias(f"_{c}") for c in ("accepted", "precision", "recall", "fpr")])
    same = F.lit(True)
    for c in ("accepted", "precision", "recall", "fpr"):
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return row.crossJoin(F.broadcast(own)).select("threshold", "accepted", "precision", "recall", "fpr", same.alias("agrees"))  # one row each


@Q.query(f"SELECT anchor_episode_id, candidate_episode_id, round(score, 8) AS score FROM ({_PREDICT.format(by='fs', rule='fs >= 0.65').replace('FROM candidate_pairs', f'FROM (SELECT *, {_SCORES[chr(68)]} AS fs FROM {_LEVELS})')}) WHERE predicted_rank = 1")
def method_d_fixed(spark, d):
    """The posterior method at 0.65 under a stored model."""
    s = linkage.score_with(table(spark, d, "candidate_pairs"), list(_MODEL), 0.01)
    return linkage.predict(s, "D", 65.0, 1).select(ANCHOR, CANDIDATE, F.round("score", 8).alias("score"))


_TEXTS, _CUTS, _MODES = tuple(i / 20 for i in range(0, 19, 2)), tuple(range(0, 90, 10)), (0, 1, 2)
_GRID = f"""
    truth AS (SELECT anchor_episode_id, coalesce(list(DISTINCT successor_episode_id) FILTER (final_outcome = 'OBSERVED_SUCCESSOR' AND successor_episode_id IS NOT NULL), []) AS successors FROM confirmed_links WHERE final_outcome IN ('OBSERVED_SUCCESSOR', 'NO_OBSERVED_SUCCESSOR') GROUP BY 1),
    r AS (SELECT anchor_episode_id, candidate_episode_id, {_S} AS s, {_T} AS t, CASE WHEN {_C} > 0 THEN 2 WHEN cpv_component IS NOT NULL AND NOT isnan(cpv_component) THEN 1 ELSE 0 END AS m FROM candidate_pairs JOIN truth USING (anchor_episode_id)),
    grid AS (SELECT a.text_at, b.score_at, c.mode FROM (SELECT unnest({list(_TEXTS)}::DOUBLE[]) AS text_at) a, (SELECT unnest({list(_CUTS)}::DOUBLE[]) AS score_at) b, (SELECT unnest([0, 1, 2]) AS mode) c),
    best AS (SELECT text_at, score_at, mode, anchor_episode_id, max_by(candidate_episode_id, (s, t, candidate_episode_id)) AS top FROM r JOIN grid ON t >= text_at AND s >= score_at AND m >= mode GROUP BY 1, 2, 3, 4),
    points AS (SELECT text_at, score_at, CAST(mode AS INT) AS mode, count(*) AS accepted, count(*) FILTER (list_contains(successors, top)) AS tp, round(count(*) FILTER (list_contains(successors, top)) / count(*)::DOUBLE, 6) AS precision,
      round(count(*) FILTER (list_contains(successors, top)) / (SELECT count(*) FROM truth WHERE len(successors) > 0)::DOUBLE, 6) AS recall FROM best JOIN truth USING (anchor_episode_id) GROUP BY 1, 2, 3)"""


def _grid(spark, d):
    truth = _truth(spark, d)
    pairs = table(spark, d, "candidate_pairs").join(truth.select(ANCHOR), ANCHOR, "left_semi")
    return ops.grid_top1(pairs, truth, _TEXTS, _CUTS, _MODES)


@Q.query(f"WITH {_GRID} SELECT * FROM points")
def grid_points(spark, d):
    """The decision at each of 270 points of text cut, score cut and category mode."""
    return _grid(spark, d)


@Q.query(f"WITH {_GRID} SELECT * FROM points WHERE accepted >= 10 ORDER BY precision DESC, recall DESC, accepted, text_at DESC, score_at DESC, mode DESC LIMIT 1")
def grid_selected(spark, d):
    """The point in use: of those with ten predictions or more the first by precision, recall and strictness."""
    return ops.best_of_grid(_grid(spark, d), 10)


#: Weight presets of the components: production, text first, buyer first.
_PRESETS = {"production": (0.5, 0.25, 0.2, 0.05), "text_first": (0.2, 0.6, 0.15, 0.05), "buyer_first": (0.7, 0.1, 0.15, 0.05)}
_PARTS = ("buyer_component", "text_component", "cpv_component", "time_component")


def _preset_sql(name, weights):
    seen = [f"CASE WHEN {c} IS NULL OR isnan({c}) THEN NULL ELSE least(greatest({c}, 0.0), 1.0) END" for c in _PARTS]
    total = " + ".join(f"coalesce({w} * {c}, 0.0)" for w, c in zip(weights, seen))
    weight = " + ".join(f"CASE WHEN {c} IS NULL THEN 0.0 ELSE {w} END" for w, c in zip(weights, seen))
    return f"SELECT '{name}' AS preset, anchor_episode_id, max_by(candidate_episode_id, (round(100 * ({total}) / ({weight}), 6), candidate_episode_id)) AS top FROM candidate_pairs WHERE ({weight}) > 0 AND round(100 * ({total}) / ({weight}), 6) >= 60 GROUP BY 2"


@Q.query(f"WITH {_SWEEP}, tops AS (" + " UNION ALL ".join(_preset_sql(n, w) for n, w in _PRESETS.items()) + """)
    SELECT preset, count(*) AS accepted, count(*) FILTER (list_contains(successors, top)) AS tp, round(count(*) FILTER (list_contains(successors, top)) / count(*)::DOUBLE, 6) AS precision FROM tops JOIN truth USING (anchor_episode_id) GROUP BY 1""")
def preset_comparison(spark, d):
    """The top-1 decision under several weightings of the components, at a score of 60."""
    from ..functions.scores import weighted_score

    p, parts = table(spark, d, "candidate_pairs"), {c.split("_")[0]: F.col(c) for c in _PARTS}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("preset"), F.round(weighted_score(parts, tuple(zip(parts, w))), 6).alias("s")) for n, w in _PRESETS.items()])).alias("x")
    tops = p.select(ANCHOR, CANDIDATE, each).where("x.s >= 60").groupBy("x.preset", ANCHOR).agg(F.max_by(CANDIDATE, F.struct("x.s", CANDIDATE)).alias("top"))
    hit = F.array_contains("successors", F.col("top"))
    g = tops.join(_truth(spark, d), ANCHOR).groupBy("preset").agg(F.count(F.lit(1)).alias("accepted"), F.count_if(hit).alias("tp"))
    return g.withColumn("precision", F.round(F.col("tp") / F.col("accepted"), 6))


# --- reference building ----------------------------------------------------------------------------------------

_RESOLVED = f"""
    seen AS (SELECT DISTINCT anchor_episode_id, candidate_episode_id, CAST(CAST(candidate_origin_date AS DATE) AS VARCHAR) AS day FROM candidate_pairs),
    r AS (SELECT DISTINCT sample_id, anchor_episode_id, successor_episode_id, final_outcome, final_confidence, anchor_award_notice_date, candidate_start_date FROM confirmed_links),
    a AS (SELECT r.*, (SELECT count(*) FROM seen s WHERE s.anchor_episode_id = r.anchor_episode_id AND s.candidate_episode_id = r.successor_episode_id) AS by_id, (SELECT count(DISTINCT candidate_episode_id) FROM seen s WHERE s.anchor_episode_id = r.anchor_episode_id AND s.day = r.candidate_start_date) AS by_day,
        (SELECT min(candidate_episode_id) FROM seen s WHERE s.anchor_episode_id = r.anchor_episode_id AND s.day = r.candidate_start_date) AS day_pick FROM r),
    b AS (SELECT *, CASE WHEN by_id > 0 AND by_day = 1 AND day_pick <> successor_episode_id THEN 'DISAGREE' WHEN by_id > 0 THEN 'BY_ID' WHEN by_day = 1 THEN 'BY_DAY' WHEN by_day > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS route FROM a),
    verdicts AS (SELECT sample_id, anchor_episode_id, successor_episode_id, route, CASE WHEN final_outcome = 'OBSERVED_SUCCESSOR' AND route IN ('BY_ID', 'BY_DAY') THEN 'POSITIVE' WHEN final_outcome = 'OBSERVED_SUCCESSOR' THEN 'ANCHOR_UNUSABLE'
        WHEN final_outcome = 'NO_OBSERVED_SUCCESSOR' AND coalesce(anchor_award_notice_date >= '{CENSORED_FROM}', true) THEN 'NEGATIVE_CENSORED' WHEN final_outcome = 'NO_OBSERVED_SUCCESSOR' THEN 'NEGATIVE' ELSE 'NOT_JUDGED' END AS verdict,
        CASE WHEN substr(sha256(anchor_episode_id), 1, 1) < '8' THEN 'development' ELSE 'locked' END AS split FROM b)"""


def _verdicts(spark, d):
    """Each review resolved to a candidate by its identifier and, apart from that, by its day; and what it counts as."""
    seen = table(spark, d, "candidate_pairs").select(ANCHOR, CANDIDATE, F.to_date("candidate_origin_date").cast("string").alias("candidate_start_date")).distinct()
    r = table(spark, d, "confirmed_links").select("sample_id", ANCHOR, "successor_episode_id", "final_outcome", "final_confidence", "anchor_award_notice_date", "candidate_start_date").distinct()
    ids = seen.select(ANCHOR, F.col(CANDIDATE).alias("successor_episode_id")).distinct().withColumn("by_id", F.lit(True))
    days = seen.groupBy(ANCHOR, "candidate_start_date").agg(F.count_distinct(CANDIDATE).alias("by_day"), F.min(CANDIDATE).alias("pick"))
    j = r.join(ids, [ANCHOR, "successor_episode_id"], "left").join(days, [ANCHOR, "candidate_start_date"], "left")
    id_, one = F.col("by_id").isNotNull(), F.coalesce(F.col("by_day") == 1, F.lit(False))
    route = F.when(id_ & one & (F.col("pick") != F.col("successor_episode_id")), "DISAGREE").when(id_, "BY_ID").when(one, "BY_DAY").when(F.col("by_day") > 1, "AMBIGUOUS").otherwise("UNRESOLVED")
    j = j.withColumn("route", route)
    yes, no = F.col("final_outcome") == "OBSERVED_SUCCESSOR", F.col("final_outcome") == "NO_OBSERVED_SUCCESSOR"
    verdict = F.when(yes & F.col("route").isin("BY_ID", "BY_DAY"), "POSITIVE").when(yes, "ANCHOR_UNUSABLE").when(no & F.coalesce(F.col("anchor_award_notice_date") >= CENSORED_FROM, F.lit(True)), "NEGATIVE_CENSORED").when(no, "NEGATIVE").otherwise("NOT_JUDGED")
    split = F.when(F.substring(F.sha2(ANCHOR, 256), 1, 1) < "8", "development").otherwise("locked")
    return j.select("sample_id", ANCHOR, "successor_episode_id", "route", verdict.alias("verdict"), split.alias("split"))


@Q.query(f"WITH {_RESOLVED} SELECT * FROM verdicts")
def reference_verdicts(spark, d):
    return _verdicts(spark, d)


@Q.query(f"WITH {_RESOLVED} SELECT split, verdict, count(*) AS pairs, count(DISTINCT p.anchor_episode_id) AS anchors FROM seen p JOIN (SELECT DISTINCT anchor_episode_id, verdict, split FROM verdicts) v USING (anchor_episode_id) GROUP BY 1, 2")
def reference_exposure(spark, d):
    """The production candidates of the reference's anchors, by what the anchors count as."""
    seen = table(spark, d, "candidate_pairs").select(ANCHOR, CANDIDATE, F.to_date("candidate_origin_date").alias("day")).distinct()
    v = _verdicts(spark, d).select(ANCHOR, "verdict", "split").distinct()
    return seen.join(v, ANCHOR).groupBy("split", "verdict").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct(ANCHOR).alias("anchors"))


_MODELLING = f"""{_RESOLVED},
    usable AS (SELECT anchor_episode_id, split, coalesce(list(DISTINCT successor_episode_id) FILTER (verdict = 'POSITIVE'), []) AS successors FROM verdicts WHERE verdict IN ('POSITIVE', 'NEGATIVE') GROUP BY 1, 2),
    best AS (SELECT anchor_episode_id, candidate_episode_id, max({_T}) AS text, max({_S}) AS score, max(CASE WHEN buyer_match_type IN ('siren', 'normalized_name') THEN 1 ELSE 0 END) AS strong FROM candidate_pairs GROUP BY 1, 2),
    model AS (SELECT b.anchor_episode_id, b.candidate_episode_id, u.split, b.text, b.score, CAST(b.strong AS INT) AS strong, CAST(list_contains(u.successors, b.candidate_episode_id) AS INT) AS y FROM best b JOIN usable u USING (anchor_episode_id))"""


def _model(spark, d):
    v = _verdicts(spark, d).where("verdict in ('POSITIVE', 'NEGATIVE')")
    usable = v.groupBy(ANCHOR, "split").agg(F.collect_set(F.when(F.col("verdict") == "POSITIVE", F.col("successor_episode_id"))).alias("successors"))
    p = table(spark, d, "candidate_pairs")
    best = p.groupBy(ANCHOR, CANDIDATE).agg(F.max(linkage._zero("text_component")).alias("text"), F.max(linkage._zero("linkage_score")).alias("score"), F.max(F.coalesce(F.col("buyer_match_type").isin(*linkage.STRONG), F.lit(False)).cast("int")).alias("strong"))
    return best.join(usable, ANCHOR).select(ANCHOR, CANDIDATE, "split", "text", "score", "strong", F.array_contains("successors", F.col(CANDIDATE)).cast("int").alias("y"))


@Q.query(f"WITH {_MODELLING} SELECT * FROM model")
def modelling_table(spark, d):
    """A labelled row a candidate of each usable anchor."""
    return _model(spark, d)


@Q.query(f"""WITH {_MODELLING} SELECT 'pairs_unique' AS name, count(*) = count(DISTINCT (anchor_episode_id, candidate_episode_id)) AS ok FROM model UNION ALL SELECT 'scores_finite', bool_and(isfinite(text) AND isfinite(score)) FROM model
    UNION ALL SELECT 'both_labels', max(y) = 1 AND min(y) = 0 FROM model UNION ALL SELECT 'splits_disjoint', max(k) = 1 FROM (SELECT count(DISTINCT split) AS k FROM model GROUP BY anchor_episode_id)""")
def modelling_checks(spark, d):
    m = _model(spark, d)
    a = m.agg(
        (F.count(F.lit(1)) == F.count_distinct(F.struct(ANCHOR, CANDIDATE))).alias("pairs_unique"), F.bool_and(~F.isnan("text") & ~F.isnan("score") & (F.abs("score") < float("inf"))).alias("scores_finite"),
        ((F.max("y") == 1) & (F.min("y") == 0)).alias("both_labels"))
    s = m.groupBy(ANCHOR).agg(F.count_distinct("split").alias("k")).agg((F.max("k") == 1).alias("splits_disjoint"))
    return a.crossJoin(F.broadcast(s)).unpivot([], ["pairs_unique", "scores_finite", "both_labels", "splits_disjoint"], "name", "ok")  # one row each


# --- audits of the candidates ----------------------------------------------------------------------------------

_LOSS = r"""
    l AS (SELECT DISTINCT anchor_episode_id, successor_episode_id, TRY_CAST(anchor_award_notice_date AS DATE) AS award, TRY_CAST(candidate_start_date AS DATE) AS start, trim(regexp_replace(strip_accents(lower(anchor_buyer_name)), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(strip_accents(lower(candidate_buyer_name)), '[^a-z0-9]+', ' ', 'g')) AS b FROM confirmed_links WHERE final_outcome = 'OBSERVED_SUCCESSOR'),
    s AS (SELECT l.*, EXISTS (SELECT 1 FROM candidate_pairs p WHERE p.anchor_episode_id = l.anchor_episode_id AND p.candidate_episode_id = l.successor_episode_id) AS reached, EXISTS (SELECT 1 FROM candidate_pairs p WHERE p.anchor_episode_id = l.anchor_episode_id) AS anchored, EXISTS (SELECT 1 FROM candidate_pairs p WHERE p.candidate_episode_id = l.successor_episode_id) AS pooled FROM l),
    c AS (SELECT *, CASE WHEN reached THEN 'REACHED' WHEN NOT anchored THEN 'ANCHOR_NOT_IN_COHORT' WHEN NOT pooled THEN 'SUCCESSOR_NOT_IN_POOL' WHEN start IS NULL OR award IS NULL THEN 'NO_DATE' WHEN date_diff('day', award, start) NOT BETWEEN 90 AND 2920 THEN 'OUTSIDE_WINDOW' WHEN coalesce(a <> b, true) THEN 'DIFFERENT_BUYER' ELSE 'UNEXPLAINED' END AS stage FROM s)"""


def _missed(spark, d):
    p = table(spark, d, "candidate_pairs").select(ANCHOR, CANDIDATE).distinct()
    c = table(spark, d, "confirmed_links").where("final_outcome = 'OBSERVED_SUCCESSOR'")
    li = c.select(
        ANCHOR, F.col("successor_episode_id").alias(CANDIDATE), F.col("anchor_award_notice_date").try_cast("date").alias("award"), F.col("candidate_start_date").try_cast("date").alias("start"),
        text.text_key(F.col("anchor_buyer_name")).alias("a"), text.text_key(F.col("candidate_buyer_name")).alias("b")).distinct()
    flag = lambda keys, name: (p.select(*keys).distinct().withColumn(name, F.lit(True)), keys)
    for other, keys in (flag([ANCHOR, CANDIDATE], "reached"), flag([ANCHOR], "anchored"), flag([CANDIDATE], "pooled")):
        li = li.join(other, keys, "left")
    gap = F.datediff("start", "award")
    stage = ops.first_failure({
        "REACHED": F.col("reached"), "ANCHOR_NOT_IN_COHORT": F.col("anchored").isNull(), "SUCCESSOR_NOT_IN_POOL": F.col("pooled").isNull(), "NO_DATE": gap.isNull(),
        "OUTSIDE_WINDOW": ~gap.between(*linkage.GAP), "DIFFERENT_BUYER": F.coalesce(F.col("a") != F.col("b"), F.lit(True))})
    return li.withColumn("stage", stage)


@Q.query(f"WITH {_LOSS} SELECT stage, count(*) AS n FROM c GROUP BY 1")
def missed_pairs(spark, d):
    """True pairs by the first blocking condition that lost them."""
    return _missed(spark, d).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@Q.query(f"""WITH {_LOSS} SELECT count(*) AS true_pairs, count(*) FILTER (reached) AS reached, round(count(*) FILTER (reached) / count(*)::DOUBLE, 4) AS completeness, count(DISTINCT anchor_episode_id) AS anchors, count(DISTINCT anchor_episode_id) FILTER (reached) AS reachable_anchors,
    round(count(DISTINCT anchor_episode_id) FILTER (reached) / count(DISTINCT anchor_episode_id)::DOUBLE, 4) AS recall_ceiling FROM c""")
def pairs_completeness(spark, d):
    """How many true pairs, and anchors with any, the candidates hold at all."""
    m = _missed(spark, d)
    r = F.col("reached").isNotNull()
    g = m.agg(F.count(F.lit(1)).alias("true_pairs"), F.count_if(r).alias("reached"), F.count_distinct(ANCHOR).alias("anchors"), F.count_distinct(F.when(r, F.col(ANCHOR))).alias("reachable_anchors"))
    return g.withColumns({"completeness": F.round(F.col("reached") / F.col("true_pairs"), 4), "recall_ceiling": F.round(F.col("reachable_anchors") / F.col("anchors"), 4)})


_CPV = r"""
    n AS (SELECT idx, idweb, list_distinct(list_transform(regexp_extract_all(max(cpv_codes_json), '\b([0-9]{8})\b', 1), lambda x: x[1:2])) AS divs, substr(regexp_extract(max(cpv_codes_json), '\b([0-9]{8})\b', 1), 1, 2) AS main FROM notices_engineered GROUP BY 1, 2),
    x AS (SELECT DISTINCT a.idx AS a_idx, c.idx AS c_idx, c.main AS from_division, a.main AS to_division, list_has_any(a.divs, c.divs) AS shares FROM explicit_links e JOIN n a ON a.idx = e.right_idx JOIN n c ON c.idweb = regexp_replace(e.target_idweb, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') WHERE a.idx <> c.idx AND a.main <> '' AND c.main <> '')"""


def _divisions(spark, d):
    codes = F.regexp_extract_all("c", F.lit(text.CODE), F.lit(1))
    n = table(spark, d, "notices_engineered").groupBy("idx", "idweb").agg(F.max("cpv_codes_json").alias("c"))
    n = n.select("idx", "idweb", F.array_distinct(F.transform(codes, lambda v: F.substring(v, 1, 2))).alias("divs"), F.substring(F.get(codes, F.lit(0)), 1, 2).alias("main")).where("main <> ''")
    e = table(spark, d, "explicit_links").select(F.col("right_idx").alias("a_idx"), text.trimmed(F.col("target_idweb")).alias("idweb")).distinct()
    later = n.select(F.col("idx").alias("a_idx"), F.col("divs").alias("a_divs"), F.col("main").alias("to_division"))
    first = n.select("idweb", F.col("idx").alias("c_idx"), F.col("divs").alias("c_divs"), F.col("main").alias("from_division"))
    return e.join(first, "idweb").join(later, "a_idx").where("a_idx <> c_idx").select("a_idx", "c_idx", "from_division", "to_division", F.arrays_overlap("a_divs", "c_divs").alias("shares")).distinct()


@Q.query(f"WITH {_CPV} SELECT from_division, to_division, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY from_division)::DOUBLE, 6) AS share, from_division = to_division AS same FROM x GROUP BY 1, 2")
def transition_shares(spark, d):
    """From which category division to which linked notices go, as shares of the first."""
    g = _divisions(spark, d).groupBy("from_division", "to_division").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("from_division")  # at most a hundred divisions
    return g.withColumns({"share": F.round(F.col("n") / F.sum("n").over(w), 6), "same": F.col("from_division") == F.col("to_division")})


@Q.query(f"""WITH {_CPV} SELECT count(*) AS links, count(*) FILTER (from_division = to_division) AS same_division, count(*) FILTER (shares) AS shared_division, count(*) FILTER (NOT shares) AS no_division, round(count(*) FILTER (from_division = to_division) / count(*)::DOUBLE, 4) AS same_share,
    count(DISTINCT c_idx) AS targets, (SELECT count(*) FROM (SELECT c_idx FROM x GROUP BY 1 HAVING count(DISTINCT a_idx) > 1)) AS reused_targets, round(count(DISTINCT a_idx) FILTER (shares) / count(DISTINCT a_idx)::DOUBLE, 4) AS ceiling_if_shared FROM x""")
def division_continuity(spark, d):
    """How far links stay within a division, how often a target is reused, and what a rule on divisions would still reach."""
    x = _divisions(spark, d)
    same = F.col("from_division") == F.col("to_division")
    g = x.agg(F.count(F.lit(1)).alias("links"), F.count_if(same).alias("same_division"), F.count_if("shares").alias("shared_division"), F.count_if(~F.col("shares")).alias("no_division"), F.count_distinct("c_idx").alias("targets"), F.count_distinct("a_idx").alias("_a"), F.count_distinct(F.when(F.col("shares"), F.col("a_idx"))).alias("_s"))
    r = x.groupBy("c_idx").agg(F.count_distinct("a_idx").alias("k")).agg(F.count_if(F.col("k") > 1).alias("reused_targets"))
    j = g.crossJoin(F.broadcast(r))  # one row each
    return j.select("links", "same_division", "shared_division", "no_division", F.round(F.col("same_division") / F.col("links"), 4).alias("same_share"), "targets", "reused_targets", F.round(F.col("_s") / F.col("_a"), 4).alias("ceiling_if_shared"))


#: The closed vocabularies of a review.
_ALLOWED = {"relationship_label": ("RENEWAL_OF_EXPIRING", "CONCURRENT", "UNRELATED", "UNUSABLE"), "observable_successor_y_n_uncertain": ("Y", "N", "UNCERTAIN"), "confidence_high_medium_low": ("HIGH", "MEDIUM", "LOW")}
_EVENTS = "CASE relationship_label WHEN 'RENEWAL_OF_EXPIRING' THEN 'Y' WHEN 'CONCURRENT' THEN 'N' WHEN 'UNRELATED' THEN 'N' ELSE 'UNCERTAIN' END"


@Q.query("SELECT 'review_id_unique' AS rule, count(*) - count(DISTINCT review_id) AS violations FROM review_audit_findings UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', count(*) FILTER (coalesce({c} NOT IN {v}, true)) FROM review_audit_findings" for c, v in _ALLOWED.items())
    + f" UNION ALL SELECT 'labels_agree', count(*) FILTER (coalesce({_EVENTS} <> observable_successor_y_n_uncertain, true)) FROM review_audit_findings")
def review_validation(spark, d):
    """Violations of a review file's rules: unique keys, closed vocabularies, labels that agree."""
    r = table(spark, d, "review_audit_findings")
    event = F.when(F.col("relationship_label") == "RENEWAL_OF_EXPIRING", "Y").when(F.col("relationship_label").isin("CONCURRENT", "UNRELATED"), "N").otherwise("UNCERTAIN")
    rules = {"review_id_unique": F.count(F.lit(1)) - F.count_distinct("review_id")}
    rules |= {c: F.count_if(F.coalesce(~F.col(c).isin(*v), F.lit(True))) for c, v in _ALLOWED.items()}
    rules["labels_agree"] = F.count_if(F.coalesce(event != F.col("observable_successor_y_n_uncertain"), F.lit(True)))
    return r.agg(*[c.alias(n) for n, c in rules.items()]).unpivot([], list(rules), "rule", "violations")


@Q.query(f"""WITH {_RESOLVED}, v AS (SELECT DISTINCT anchor_episode_id, split FROM verdicts), p AS (SELECT anchor_episode_id, candidate_episode_id, max({_T}) AS score FROM candidate_pairs GROUP BY 1, 2),
    q AS (SELECT split, anchor_episode_id, candidate_episode_id, score, CASE WHEN score >= 0.7 THEN 'automatic' WHEN score >= 0.4 THEN 'manual_review' END AS tier FROM p JOIN v USING (anchor_episode_id) WHERE score >= 0.4)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY tier, anchor_episode_id ORDER BY score DESC, candidate_episode_id) AS INT) AS rank_no FROM q) WHERE rank_no <= CASE tier WHEN 'automatic' THEN 1 ELSE 5 END""")
def review_queue(spark, d):
    """The decision of the sure tier and the five best of the doubtful one, for each anchor of each split."""
    v = _verdicts(spark, d).select(ANCHOR, "split").distinct()
    p = table(spark, d, "candidate_pairs").groupBy(ANCHOR, CANDIDATE).agg(F.max(linkage._zero("text_component")).alias("score")).where("score >= 0.4").join(v, ANCHOR)
    p = p.withColumn("tier", F.when(F.col("score") >= 0.7, "automatic").otherwise("manual_review"))
    w = Window.partitionBy("tier", ANCHOR).orderBy(F.desc("score"), CANDIDATE)
    most = F.when(F.col("tier") == "automatic", 1).otherwise(5)
    return p.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= most).select("split", ANCHOR, CANDIDATE, "score", "tier", "rank_no")
