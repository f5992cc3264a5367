"""Audits: relabelling, asserted joins, grids, taxonomies, invariants and queues over linked records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import episodes, joins, survival
from ..operators import linkage as ops
from ..runtime import Scratch, table
from . import survival as lives
from .linkage import _LABELLED, _PREDICT, _T, _TRUTH, _labelled, _truth
from .registry import Registry

Q = Registry()

_EVENT = {"RENEWAL_OF_EXPIRING": "Y", "CONCURRENT": "N", "UNRELATED": "N"}


@Q.query("""
    SELECT review_id, CASE relationship_label WHEN 'RENEWAL_OF_EXPIRING' THEN 'Y' WHEN 'CONCURRENT' THEN 'N' WHEN 'UNRELATED' THEN 'N' END AS event, TRY_CAST(gap_days AS INT) AS gap_days,
      coalesce(CASE relationship_label WHEN 'RENEWAL_OF_EXPIRING' THEN 'Y' WHEN 'CONCURRENT' THEN 'N' WHEN 'UNRELATED' THEN 'N' END = observable_successor_y_n_uncertain, false) AS consistent FROM review_audit_findings""")
def relabelled_reviews(spark, d):
    e = F.col("relationship_label")
    event = F.when(F.lit(False), F.lit(""))
    for k, v in _EVENT.items():
        event = event.when(e == k, v)
    r = table(spark, d, "review_audit_findings").withColumn("event", event)
    return r.select("review_id", "event", F.col("gap_days").try_cast("int").alias("gap_days"), F.coalesce(F.col("event") == F.col("observable_successor_y_n_uncertain"), F.lit(False)).alias("consistent"))


@Q.query("SELECT l_orderkey, l_linenumber, o_custkey, c_mktsegment FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey")
def asserted_join(spark, d):
    return _asserted(spark, d, table(spark, d, "lineitem"))


def _asserted(spark, d, li):
    li = li.withColumnRenamed("l_orderkey", "o_orderkey")
    j = joins.asserted_join(li, table(spark, d, "orders"), ["o_orderkey"])
    j = joins.asserted_join(j.withColumnRenamed("o_custkey", "c_custkey"), table(spark, d, "customer"), ["c_custkey"])
    return j.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", F.col("c_custkey").alias("o_custkey"), "c_mktsegment")


@Q.query("""
    WITH a AS (SELECT anchor_episode_id, max(anchor_digital_segment) AS segment, max(CASE WHEN isnan(text_component) THEN NULL ELSE text_component END) >= 0.7 AS linked FROM candidate_pairs GROUP BY 1),
    s AS (SELECT segment, count(*) FILTER (coalesce(linked, false)) AS k, count(*) FILTER (NOT coalesce(linked, false)) AS n FROM a GROUP BY 1)
    SELECT segment, k AS linked, n AS unlinked, round(k / (sum(k) OVER ())::DOUBLE - n / (sum(n) OVER ())::DOUBLE, 6) AS difference FROM s""")
def linked_share_difference(spark, d):
    p = table(spark, d, "candidate_pairs").groupBy("anchor_episode_id").agg(F.max("anchor_digital_segment").alias("segment"), F.max(F.when(~F.isnan("text_component"), F.col("text_component"))).alias("s"))
    linked = F.coalesce(F.col("s") >= 0.7, F.lit(False))
    g = p.groupBy("segment").agg(F.count_if(linked).alias("linked"), F.count_if(~linked).alias("unlinked"))
    all_ = Window.partitionBy(F.lit(1))  # a row a segment
    return g.withColumn("difference", F.round(F.col("linked") / F.sum("linked").over(all_) - F.col("unlinked") / F.sum("unlinked").over(all_), 6))


_KEYWORDS = {"logiciel": "software", "serveurs": "it", "reseau": "telecom", "telephonie": "telecom", "video": "security", "acces": "security"}


_WORDS_IN_ORDER = sorted(_KEYWORDS)


@Q.query(r"""
    WITH n AS (SELECT idx, max(cpv_codes_json) AS c, ' ' || trim(regexp_replace(strip_accents(lower(max(objet))), '[^a-z0-9]+', ' ', 'g')) || ' ' AS k FROM notices_engineered GROUP BY 1),
    s AS (SELECT idx, list_filter(list_transform(regexp_extract_all(c, '\b([0-9]{8})\b', 1), lambda x: x[1:2]), lambda x: x IN ('32', '35', '48', '72')) AS divisions, k FROM n),
    h AS (SELECT idx, segment, count(*) AS n, min(pos) AS first FROM s, (VALUES """ + ", ".join(f"({i}, '{w}', '{_KEYWORDS[w]}')" for i, w in enumerate(_WORDS_IN_ORDER)) + """) v(pos, word, segment) WHERE contains(k, ' ' || word || ' ') GROUP BY 1, 2),
    m AS (SELECT idx, max_by(segment, (n, -first)) AS modal FROM h GROUP BY 1)
    SELECT s.idx, CASE WHEN len(divisions) > 0 THEN 'CPV-' || divisions[1] ELSE coalesce(modal, 'none') END AS segment FROM s LEFT JOIN m USING (idx)""")
def segment_choice(spark, d):
    """The division of the first code in scope, else the segment that most of the keywords found stand for, of equals the
    one whose keyword comes first by name."""
    n = table(spark, d, "notices_engineered").groupBy("idx").agg(F.max("cpv_codes_json").alias("c"), F.max("objet").alias("o"))
    divisions = F.filter(F.transform(F.regexp_extract_all("c", F.lit(text.CODE), F.lit(1)), lambda v: F.substring(v, 1, 2)), lambda v: v.isin("32", "35", "48", "72"))
    padded = F.concat(F.lit(" "), text.text_key(F.col("o")), F.lit(" "))
    hits = F.array_compact(F.array(*[F.when(F.contains(padded, F.lit(f" {w} ")), F.lit(_KEYWORDS[w])) for w in _WORDS_IN_ORDER]))
    n = n.select("idx", divisions.alias("divisions"), hits.alias("hits"))
    often = lambda v: F.size(F.filter("hits", lambda h: h == v))
    modal = F.array_max(F.transform("hits", lambda v: F.struct(often(v).alias("n"), (-F.array_position("hits", v)).alias("first"), v.alias("segment"))))["segment"]
    return n.select("idx", F.coalesce(F.concat(F.lit("CPV-"), F.get("divisions", F.lit(0))), modal, F.lit("none")).alias("segment"))


@Q.query(r"""
    SELECT doc_id, list_slice(list_distinct_ordered(regexp_extract_all(text, '\b([0-9]{2}/[0-9]{2}/[0-9]{4})\b', 1)), 1, 30) AS dates FROM documents WHERE text IS NOT NULL""".replace("list_distinct_ordered(", "list_sort(list_distinct(").replace(", 1)), 1, 30)", ", 1))), 1, 30)"))
def date_candidates(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    found = F.regexp_extract_all("text", F.lit(r"(?<![0-9A-Za-z_])([0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z_])"), F.lit(1))
    return t.select("doc_id", F.slice(F.array_sort(F.array_distinct(found)), 1, 30).alias("dates"))


@Q.query("SELECT l_orderkey, l_linenumber, round((l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag)) / stddev_pop(l_extendedprice) OVER (PARTITION BY l_returnflag), 6) AS z FROM lineitem")
def z_scores(spark, d):
    li = table(spark, d, "lineitem")
    g = li.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("m"), F.stddev_pop("l_extendedprice").alias("s"))
    return li.join(g, "l_returnflag").select("l_orderkey", "l_linenumber", F.round((F.col("l_extendedprice") - F.col("m")) / F.col("s"), 6).alias("z"))


@Q.query(r"""
    WITH RECURSIVE n AS (SELECT idx, idweb, min(buyer_siren) FILTER (buyer_siren <> '') AS siren FROM notices GROUP BY 1, 2),
    e AS MATERIALIZED (SELECT DISTINCT a.idx AS a, b.idx AS b FROM explicit_links l JOIN n a ON a.idx = l.right_idx JOIN n b ON b.idweb = regexp_replace(l.target_idweb, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') WHERE a.idx <> b.idx AND (a.siren IS NULL OR b.siren IS NULL OR a.siren = b.siren)),
    x AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS v, a AS s FROM x UNION SELECT x.b, r.s FROM r JOIN x ON x.a = r.v WHERE r.s <= x.b)
    SELECT v AS vertex, min(s) AS root FROM r GROUP BY 1""")
def components_pairwise(spark, d):
    """Components over the edges whose two ends do not conflict; the pairwise variant of the veto."""
    n = table(spark, d, "notices").groupBy("idx", "idweb").agg(F.min(F.when(F.col("buyer_siren") != "", F.col("buyer_siren"))).alias("siren"))
    e = table(spark, d, "explicit_links").select(F.col("right_idx").alias("a"), text.trimmed(F.col("target_idweb")).alias("idweb")).distinct()
    j = e.join(n.select(F.col("idx").alias("a"), F.col("siren").alias("sa")), "a").join(n.select(F.col("idx").alias("b"), "idweb", F.col("siren").alias("sb")), "idweb")
    return episodes.components(j.where("a <> b and (sa is null or sb is null or sa = sb)"), "a", "b", Scratch(spark, "pairwise"))


@Q.query(f"""
    WITH p AS ({_PREDICT.format(by='text_component', rule=f'{_T} >= 0.5')}), l AS (SELECT DISTINCT anchor_episode_id, sample_id, final_outcome, final_confidence, successor_episode_id FROM confirmed_links),
    t AS (SELECT l.*, p.candidate_episode_id AS top, CASE final_confidence WHEN 'HIGH' THEN 1.5 WHEN 'MEDIUM' THEN 2.5 ELSE 4.0 END AS w FROM l LEFT JOIN p ON p.anchor_episode_id = l.anchor_episode_id AND predicted_rank = 1 WHERE final_outcome <> 'UNCERTAIN'),
    r AS (SELECT final_confidence AS h, w, CAST(coalesce(final_outcome = 'OBSERVED_SUCCESSOR' AND top = successor_episode_id, false) AS DOUBLE) AS y, CAST(top IS NOT NULL AS DOUBLE) AS x FROM t),
    q AS (SELECT sum(w * y) / sum(w * x) AS ratio, sum(w * x) AS tx, count(*) AS n FROM r), s AS (SELECT h, count(*) AS k, sum(w) AS bigh, var_samp(y - ratio * x) AS s2 FROM r, q GROUP BY 1 HAVING count(*) >= 2), v AS (SELECT sqrt(sum(bigh * bigh * (1 - k / bigh) * s2 / k)) AS sd FROM s)
    SELECT round(ratio, 4) AS estimate, round(sd / tx, 4) AS standard_error, round(greatest(ratio - 1.959963985 * sd / tx, 0.0), 4) AS low, round(least(ratio + 1.959963985 * sd / tx, 1.0), 4) AS high, n FROM q, v""")
def weighted_evaluation(spark, d):
    """Weighted precision of the top-1 decision over reviewed anchors; uncertain verdicts are left out."""
    top = ops.predict(table(spark, d, "candidate_pairs"), "B", 50.0, 1).select(ops.ANCHOR, F.col(ops.CANDIDATE).alias("top"))
    li = table(spark, d, "confirmed_links").select(ops.ANCHOR, "sample_id", "final_outcome", "final_confidence", "successor_episode_id").distinct().where("final_outcome <> 'UNCERTAIN'")
    w = F.when(F.col("final_confidence") == "HIGH", 1.5).when(F.col("final_confidence") == "MEDIUM", 2.5).otherwise(4.0)
    hit = F.coalesce((F.col("final_outcome") == "OBSERVED_SUCCESSOR") & (F.col("top") == F.col("successor_episode_id")), F.lit(False))
    r = li.join(top, ops.ANCHOR, "left").select("final_confidence", w.alias("w"), hit.cast("double").alias("y"), F.col("top").isNotNull().cast("double").alias("x"))
    return ops.stratified_ratio(r, "y", "x", "final_confidence", "w")


@Q.query(f"""
    WITH p AS ({_PREDICT.format(by='text_component', rule=f'{_T} >= 0.5')}), n AS (SELECT DISTINCT anchor_episode_id, successor_episode_id AS c, final_confidence FROM confirmed_links WHERE final_outcome = 'NO_OBSERVED_SUCCESSOR'), pairs AS (SELECT DISTINCT anchor_episode_id, candidate_episode_id FROM candidate_pairs)
    SELECT final_confidence AS source, count(*) AS negatives, count(pairs.candidate_episode_id) AS at_risk, count(p.candidate_episode_id) AS accepted, CASE WHEN count(pairs.candidate_episode_id) > 0 THEN round(count(p.candidate_episode_id) / count(pairs.candidate_episode_id)::DOUBLE, 4) END AS rate
    FROM n LEFT JOIN pairs ON pairs.anchor_episode_id = n.anchor_episode_id AND pairs.candidate_episode_id = c LEFT JOIN p ON p.anchor_episode_id = n.anchor_episode_id AND p.candidate_episode_id = c AND predicted_rank = 1 GROUP BY 1""")
def hard_negatives(spark, d):
    """Reviewed non-successors that were candidates, and how many were accepted; null where none was at risk."""
    pairs = table(spark, d, "candidate_pairs")
    top = ops.predict(pairs, "B", 50.0, 1).select(ops.ANCHOR, ops.CANDIDATE, F.lit(1).alias("accepted"))
    n = table(spark, d, "confirmed_links").where("final_outcome = 'NO_OBSERVED_SUCCESSOR'").select(ops.ANCHOR, F.col("successor_episode_id").alias(ops.CANDIDATE), F.col("final_confidence").alias("source")).distinct()
    j = n.join(pairs.select(ops.ANCHOR, ops.CANDIDATE, F.lit(1).alias("at_risk")).distinct(), [ops.ANCHOR, ops.CANDIDATE], "left").join(top, [ops.ANCHOR, ops.CANDIDATE], "left")
    g = j.groupBy("source").agg(F.count(F.lit(1)).alias("negatives"), F.count("at_risk").alias("at_risk"), F.count("accepted").alias("accepted"))
    return g.withColumn("rate", F.when(F.col("at_risk") > 0, F.round(F.col("accepted") / F.col("at_risk"), 4)))


_UNION = rf"[^\p{{{{L}}}}]({text.UNION_WORDS})[^\p{{{{L}}}}]"
_FAMILY = f"CASE WHEN regexp_matches({{c}}, '{text.TOWN_WORDS}', 'i') AND regexp_matches(' ' || {{c}} || ' ', '{_UNION}', 'i') THEN 'mixed_label' WHEN regexp_matches({{c}}, '{text.TOWN_WORDS}', 'i') THEN 'municipal' WHEN regexp_matches(' ' || {{c}} || ' ', '{_UNION}', 'i') THEN 'intercommunal' ELSE 'other' END"
_LINKED = r"""
    n AS (SELECT idx, idweb, max(buyer_key) AS buyer, max(code_departement) AS department, max(nomacheteur) AS name FROM notices_engineered GROUP BY 1, 2),
    l AS (SELECT DISTINCT a.idx AS a_idx, c.idx AS c_idx, coalesce(a.buyer, '') AS ak, coalesce(c.buyer, '') AS ck, coalesce(a.department, '') AS ad, coalesce(c.department, '') AS cd, coalesce(a.name, '') AS an, coalesce(c.name, '') AS cn
      FROM explicit_links e JOIN n a ON a.idx = e.right_idx JOIN n c ON c.idweb = regexp_replace(e.target_idweb, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') WHERE a.idx <> c.idx)"""


def _linked(spark, d):
    """Linked notices with the buyer's key, department and name of both."""
    g = table(spark, d, "notices_engineered").groupBy("idx", "idweb").agg(*[F.coalesce(F.max(c), F.lit("")).alias(c) for c in ("buyer_key", "code_departement", "nomacheteur")])
    e = table(spark, d, "explicit_links").select(F.col("right_idx").alias("a_idx"), text.trimmed(F.col("target_idweb")).alias("idweb")).distinct()
    side = lambda p: [F.col("buyer_key").alias(f"{p}k"), F.col("code_departement").alias(f"{p}d"), F.col("nomacheteur").alias(f"{p}n")]
    return e.join(g.select("idweb", F.col("idx").alias("c_idx"), *side("c")), "idweb").join(g.select(F.col("idx").alias("a_idx"), *side("a")), "a_idx").where("a_idx <> c_idx").drop("idweb").distinct()


@Q.query(f"""WITH {_LINKED}, f AS (SELECT *, {_FAMILY.format(c='an')} AS a, {_FAMILY.format(c='cn')} AS b FROM l)
    SELECT reason, count(*) AS n, bool_or(contains(reason, 'conflicting_validated_siren')) AS hard_fail FROM (SELECT concat_ws(';', CASE WHEN starts_with(ak, 'siren:') AND starts_with(ck, 'siren:') AND ak <> ck THEN 'conflicting_validated_siren' END,
      CASE WHEN (a = 'municipal' AND b = 'intercommunal') OR (a = 'intercommunal' AND b = 'municipal') THEN 'municipal_intercommunal_mix' END, CASE WHEN starts_with(ak, 'name:') AND starts_with(ck, 'name:') AND ad <> '' AND cd <> '' AND ad <> cd THEN 'name_only_cross_department' END,
      CASE WHEN a <> b THEN 'legal_family_diff_review' END) AS reason FROM f) GROUP BY 1""")
def legal_form_audit(spark, d):
    """Why a pair of linked buyers needs a look, of four reasons; a conflict of validated identifiers fails it."""
    f = _linked(spark, d).withColumns({"a": text.legal_family(F.col("an")), "b": text.legal_family(F.col("cn"))})
    both = lambda p: F.col("ak").startswith(p) & F.col("ck").startswith(p)
    reason = F.concat_ws(
        ";", F.when(both("siren:") & (F.col("ak") != F.col("ck")), "conflicting_validated_siren"),
        F.when(F.array_sort(F.array("a", "b")) == F.array(F.lit("intercommunal"), F.lit("municipal")), "municipal_intercommunal_mix"),
        F.when(both("name:") & (F.col("ad") != "") & (F.col("cd") != "") & (F.col("ad") != F.col("cd")), "name_only_cross_department"), F.when(F.col("a") != F.col("b"), "legal_family_diff_review"))
    return f.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n")).withColumn("hard_fail", F.contains("reason", F.lit("conflicting_validated_siren")))


@Q.query("""
    SELECT 'orders_unique' AS name, count(*) = count(DISTINCT o_orderkey) AS ok FROM orders UNION ALL SELECT 'items_in_orders', count(*) = 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'customers_in_nations', count(*) = 0 FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'notice_ids_one_to_one', count(DISTINCT idx) = count(DISTINCT idweb) FROM notices UNION ALL SELECT 'discounts_are_shares', bool_and(l_discount BETWEEN 0 AND 1) FROM lineitem""")
def invariants(spark, d):
    o, li, c, n, t = (table(spark, d, x) for x in ("orders", "lineitem", "customer", "nation", "notices"))
    row = lambda df, name, ok: df.agg(F.lit(name).alias("name"), ok.alias("ok"))
    parts = [
        row(o, "orders_unique", F.count(F.lit(1)) == F.count_distinct("o_orderkey")), row(li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"), "items_in_orders", F.count(F.lit(1)) == 0),
        row(c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left_anti"), "customers_in_nations", F.count(F.lit(1)) == 0), row(t, "notice_ids_one_to_one", F.count_distinct("idx") == F.count_distinct("idweb")),
        row(li, "discounts_are_shares", F.bool_and(F.col("l_discount").between(0, 1)))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@Q.query("""
    SELECT o_custkey, n, span_days, n >= 18 AS many, span_days > 2100 AS wide, conflict FROM (SELECT o_custkey, count(*) AS n, CAST(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS INT) AS span_days, count(DISTINCT o_orderpriority) = 1 AS conflict FROM orders GROUP BY 1)
    WHERE n >= 18 OR span_days > 2100 OR conflict""")
def suspicious_queue(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.datediff(F.max("o_orderdate").cast("date"), F.min("o_orderdate").cast("date")).alias("span_days"), (F.count_distinct("o_orderpriority") == 1).alias("conflict"))
    return g.select("o_custkey", "n", "span_days", (F.col("n") >= 18).alias("many"), (F.col("span_days") > 2100).alias("wide"), "conflict").where("many or wide or conflict").orderBy(F.desc("n"), F.desc("span_days"), "o_custkey")


@Q.query(f"""
    WITH l AS ({_LABELLED}), g AS (SELECT CAST(t AS INT) AS threshold, m AS margin, anchor_episode_id, max_by(y, (score, candidate_episode_id)) AS y, max(score) AS best FROM l, (SELECT unnest([40, 50, 60, 70, 80]) AS t), (SELECT unnest([0.0, 0.1, 0.2]) AS m) WHERE score >= t / 100.0::DOUBLE + m GROUP BY 1, 2, 3)
    SELECT threshold, CAST(margin AS DOUBLE) AS margin, count(*) AS accepted, CAST(sum(y) AS BIGINT) AS tp, round(sum(y) / count(*)::DOUBLE, 6) AS precision FROM g GROUP BY 1, 2""")
def grid_sweep(spark, d):
    """Accepted anchors and true ones for every point of a grid of thresholds and margins (a fixed grid, exploded)."""
    li = _labelled(spark, d)
    grid = li.withColumns({"threshold": F.explode(F.array(*map(F.lit, (40, 50, 60, 70, 80))))}).withColumn("margin", F.explode(F.array(*map(F.lit, (0.0, 0.1, 0.2)))))
    kept = grid.where(F.col("score") >= F.col("threshold") / 100.0 + F.col("margin"))
    best = kept.groupBy("threshold", "margin", ops.ANCHOR).agg(F.max_by("y", F.struct("score", ops.CANDIDATE)).alias("y"))
    return best.groupBy("threshold", "margin").agg(F.count(F.lit(1)).alias("accepted"), F.sum(F.col("y").cast("bigint")).alias("tp"), F.round(F.sum("y") / F.count(F.lit(1)), 6).alias("precision"))


@Q.query(f"""
    WITH t AS ({_TRUTH}), p AS (SELECT anchor_episode_id, candidate_episode_id FROM ({_PREDICT.format(by='text_component', rule=f'{_T} >= 0.5')}) WHERE predicted_rank = 1), c AS (SELECT DISTINCT anchor_episode_id, candidate_episode_id FROM candidate_pairs),
    r AS (SELECT t.anchor_episode_id, bool_or(c.candidate_episode_id IS NOT NULL AND list_contains(successors, c.candidate_episode_id)) AS reachable FROM t LEFT JOIN c USING (anchor_episode_id) GROUP BY 1)
    SELECT class, count(*) AS n FROM (SELECT CASE WHEN coalesce(len(successors), 0) = 0 AND candidate_episode_id IS NULL THEN 'true_negative' WHEN coalesce(len(successors), 0) = 0 THEN 'false_link' WHEN list_contains(successors, candidate_episode_id) THEN 'correct' WHEN NOT reachable THEN 'blocked' WHEN candidate_episode_id IS NULL THEN 'abstained' ELSE 'wrong_successor' END AS class FROM t LEFT JOIN p USING (anchor_episode_id) JOIN r USING (anchor_episode_id)) GROUP BY 1""")
def error_taxonomy(spark, d):
    t, pairs = _truth(spark, d), table(spark, d, "candidate_pairs")
    top = ops.predict(pairs, "B", 50.0, 1).select(ops.ANCHOR, F.col(ops.CANDIDATE).alias("top"))
    seen = t.select(ops.ANCHOR, F.explode("successors").alias(ops.CANDIDATE)).join(pairs.select(ops.ANCHOR, ops.CANDIDATE), [ops.ANCHOR, ops.CANDIDATE], "left_semi").select(ops.ANCHOR, F.lit(True).alias("reachable")).distinct()
    j = t.join(top, ops.ANCHOR, "left").join(seen, ops.ANCHOR, "left")
    none = F.size("successors") == 0
    kind = F.when(none & F.col("top").isNull(), "true_negative").when(none, "false_link").when(F.array_contains("successors", F.col("top")), "correct").when(F.col("reachable").isNull(), "blocked").when(F.col("top").isNull(), "abstained").otherwise("wrong_successor")
    return j.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@Q.query(f"""
    WITH l AS ({_LABELLED}) SELECT tier, count(*) AS pairs, count(DISTINCT anchor_episode_id) AS anchors, CAST(sum(y) AS BIGINT) AS tp FROM (SELECT *, CASE WHEN score >= 0.7 THEN 'automatic' WHEN score >= 0.4 THEN 'manual_review' ELSE 'no_link' END AS tier FROM l) GROUP BY 1""")
def three_state_gate(spark, d):
    tier = F.when(F.col("score") >= 0.7, "automatic").when(F.col("score") >= 0.4, "manual_review").otherwise("no_link")
    return _labelled(spark, d).groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct(ops.ANCHOR).alias("anchors"), F.sum(F.col("y").cast("bigint")).alias("tp"))


@Q.query("""
    SELECT anchor_episode_id, CASE WHEN count(DISTINCT final_outcome) > 1 THEN 'AMBIGUOUS' ELSE max(final_outcome) END AS verdict, list_sort(list(DISTINCT successor_episode_id) FILTER (final_outcome = 'OBSERVED_SUCCESSOR' AND successor_episode_id <> anchor_episode_id)) AS successors, count(DISTINCT sample_id) AS reviews FROM confirmed_links GROUP BY 1
    HAVING count(*) FILTER (final_outcome = 'OBSERVED_SUCCESSOR') > 0""")
def reference_build(spark, d):
    c = table(spark, d, "confirmed_links")
    yes = F.col("final_outcome") == "OBSERVED_SUCCESSOR"
    g = c.groupBy(ops.ANCHOR).agg(F.count_distinct("final_outcome").alias("k"), F.max("final_outcome").alias("v"), F.array_sort(F.collect_set(F.when(yes & (F.col("successor_episode_id") != F.col(ops.ANCHOR)), F.col("successor_episode_id")))).alias("successors"), F.count_distinct("sample_id").alias("reviews"), F.count_if(yes).alias("y")).where("y > 0")
    return g.select(ops.ANCHOR, F.when(F.col("k") > 1, "AMBIGUOUS").otherwise(F.col("v")).alias("verdict"), "successors", "reviews")


@Q.query()
def buyer_match_types(spark, d):
    """The strongest evidence that the buyers of two linked notices are one; two identifiers that differ refuse the rest."""
    p = _linked(spark, d).withColumns({"a": text.text_key(F.col("an")), "b": text.text_key(F.col("cn"))})
    siren = lambda c: F.regexp_extract(c, "^siren:([0-9]+)$", 1)
    return ops.buyer_match(p.withColumns({"a_siren": siren("ak"), "b_siren": siren("ck")}), "a", "b", "a_siren", "b_siren").groupBy("buyer_match_type").agg(F.count(F.lit(1)).alias("n"))


@Q.query(f"""WITH {_LINKED}, k AS (SELECT *, regexp_extract(ak, '^siren:([0-9]+)$', 1) AS sa, regexp_extract(ck, '^siren:([0-9]+)$', 1) AS sc, trim(regexp_replace(strip_accents(lower(an)), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(strip_accents(lower(cn)), '[^a-z0-9]+', ' ', 'g')) AS b FROM l)
    SELECT kind, count(*) AS n FROM (SELECT CASE WHEN sa <> '' AND sa = sc THEN 'siren' WHEN sa <> '' AND sc <> '' THEN 'conflict' WHEN a <> '' AND a = b THEN 'normalized_name' ELSE 'other' END AS kind FROM k) GROUP BY 1""")
def buyer_exact_matches(spark, d):
    """The levels of buyer evidence that need no similarity."""
    p = _linked(spark, d).withColumns({"a": text.text_key(F.col("an")), "b": text.text_key(F.col("cn"))})
    sa, sc = (F.regexp_extract(c, "^siren:([0-9]+)$", 1) for c in ("ak", "ck"))
    kind = F.when((sa != "") & (sa == sc), "siren").when((sa != "") & (sc != ""), "conflict").when((F.col("a") != "") & (F.col("a") == F.col("b")), "normalized_name").otherwise("other")
    return p.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@Q.query()
def univariate_screen(spark, d):
    """Each covariate alone and with the others, and whether its sign flips."""
    p = survival.bounded(survival.patterns(lives._design(spark, d), lives._COVARIATES), survival.MOST_PATTERNS, "patterns").toPandas()
    joint = {r["covariate"]: r for r in survival.cox_fit(p, lives._COVARIATES)["rows"]}
    rows = []
    for c in lives._COVARIATES:
        alone = survival.cox_fit(p, [c])["rows"][0]
        rows.append((c, alone["coef"], alone["p"], joint[c]["coef"], joint[c]["p"], alone["coef"] * joint[c]["coef"] < 0))
    return spark.createDataFrame(rows, "covariate string, alone double, p_alone double, joint double, p_joint double, flips boolean")


@Q.query()
def arm_retest(spark, d):
    """Every covariate under several minimum gaps: its hazard ratios, in how many of the four it is significant, whether it
    always points one way; robust from three on, fragile up to one."""
    rows = []
    for arm, p in lives.arms(spark, d):
        rows += [(arm, r["covariate"], r["hazard_ratio"], r["p"]) for r in survival.cox_fit(p, lives._COVARIATES)["rows"]]
    g = spark.createDataFrame(rows, "arm string, covariate string, hr double, p double").groupBy("covariate")
    ratio = [F.max(F.when(F.col("arm") == a, F.col("hr"))).alias(f"hr_{a}") for a in lives.ARMS]
    out = g.agg(*ratio, F.count_if(F.col("p") < 0.05).alias("significant"), (F.count_distinct(F.col("hr") > 1) == 1).alias("same_direction"))
    verdict = F.when(F.col("same_direction") & (F.col("significant") >= 3), "robust").when(F.col("significant") <= 1, "fragile").otherwise("mixed")
    return out.withColumn("verdict", verdict)


@Q.query()
def arm_logrank(spark, d):
    """The log-rank test of the segments under several minimum gaps, its verdict, and their order by observed over expected."""
    rows = []
    base = lives.dataset(spark, d)
    for arm, months in lives.ARMS.items():
        x = base.withColumn("event", F.when((F.col("event") == 1) & (F.col("t") >= months), 1).otherwise(0))
        test = survival.logrank(x, "segment")
        order = " > ".join(v for v, _, _ in sorted(test["levels"], key=lambda x: (-(x[1] / x[2] if x[2] else 0.0), x[0])))
        rows.append((arm, test["chi2"], test["df"], test["p"], "differ" if test["p"] < 0.05 else "no difference shown", order))
    return spark.createDataFrame(rows, "arm string, chi2 double, df int, p double, verdict string, ordering string")


@Q.query()
def signal_matrix(spark, d):
    """A row a segment: recent direction, last stable break, stationarity, regime, and what to do with them."""
    from ..operators import trend
    from .episodes import _panel

    return trend.signals(_panel(spark, d))
