"""Candidate pairs, similarities, decisions and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import linkage as ops
from ..operators import similarity
from ..runtime import table
from .registry import Registry

Q = Registry()

_V = "CASE WHEN {c} IS NULL OR isnan({c}) THEN 0.0 ELSE {c} END"
_T, _C, _S, _N = (_V.format(c=c) for c in ("text_component", "cpv_component", "linkage_score", "buyer_name_similarity"))


def _orders(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("key"),
        F.concat(F.lit("n"), F.floor(F.col("o_custkey") / 2).cast("string")).alias("name"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey").cast("string")).otherwise("").alias("siren"), "o_orderstatus")


_PAIRS = """
    WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_custkey AS k, o_custkey // 2 AS n, CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS siren, o_orderstatus AS st FROM orders),
    p AS (SELECT a.id AS a_id, c.id AS c_id, CAST(date_diff('day', a.day, c.day) AS INT) AS gap_days FROM o a JOIN o c ON a.n = c.n WHERE a.st = 'F' AND a.id <> c.id AND date_diff('day', a.day, c.day) BETWEEN 90 AND 2920 AND (a.siren = '' OR c.siren = '' OR a.siren = c.siren)
          UNION SELECT a.id, c.id, CAST(date_diff('day', a.day, c.day) AS INT) FROM o a JOIN o c ON a.k = c.k WHERE a.st = 'F' AND a.id <> c.id AND date_diff('day', a.day, c.day) BETWEEN 90 AND 2920)"""


@Q.query(_PAIRS + " SELECT a_id, c_id, gap_days FROM p")
def candidate_pairs_blocked(spark, d):
    o = _orders(spark, d)
    return ops.block_pairs(o.where("o_orderstatus = 'F'"), o, ["key", "name"], identifier="siren")


@Q.query(_PAIRS + " SELECT a_id, c_id, gap_days, rank_no FROM (SELECT *, CAST(row_number() OVER (PARTITION BY a_id ORDER BY abs(gap_days - 1461), c_id) AS INT) AS rank_no FROM p) WHERE rank_no <= 5")
def candidate_rank_by_gap(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("a_id").orderBy(F.abs(F.col("gap_days") - 1461), "c_id")
    return candidate_pairs_blocked(spark, d).withColumn("rank_no", F.row_number().over(w)).where("rank_no <= 5")


@Q.query(_PAIRS + " SELECT a_id, c_id, gap_days, CAST(row_number() OVER (PARTITION BY a_id ORDER BY abs(gap_days - 1461), c_id) AS INT) AS rank_no FROM p")
def candidate_rank_by_gap_all(spark, d):
    """The rank of every pair of an anchor; ``candidate_rank_by_gap`` has the first five."""
    return ops.ranked(candidate_pairs_blocked(spark, d), "a_id", [F.abs(F.col("gap_days") - 1461), F.col("c_id")])


def _names(spark, d):
    p = table(spark, d, "candidate_pairs").where("anchor_buyer_name is not null")
    return p.select(text.text_key(F.col("anchor_buyer_name")).alias("name"), F.col("anchor_episode_id").alias("episode_id"))


@Q.query(r"""
    WITH n AS (SELECT DISTINCT trim(regexp_replace(strip_accents(lower(anchor_buyer_name)), '[^a-z0-9]+', ' ', 'g')) AS name FROM candidate_pairs WHERE anchor_buyer_name IS NOT NULL),
    s AS (SELECT name, list_distinct(list_filter(string_split(name, ' '), lambda x: length(x) >= 4 AND NOT regexp_matches(x, '^[0-9]+$'))) AS tokens FROM n),
    t AS (SELECT name, unnest(tokens) AS w FROM s),
    p AS (SELECT a.name AS a_name, b.name AS b_name, count(*) AS shared FROM t a JOIN t b ON a.w = b.w WHERE a.name < b.name GROUP BY 1, 2)
    SELECT a_name, b_name, round(shared / (len(x.tokens) + len(y.tokens) - shared)::DOUBLE, 6) AS overlap FROM p JOIN s x ON x.name = a_name JOIN s y ON y.name = b_name
    WHERE shared / (len(x.tokens) + len(y.tokens) - shared)::DOUBLE >= 0.34""")
def token_blocking_pairs(spark, d):
    """Buyer names whose tokens overlap by a Jaccard similarity of 0.34 or more, however frequent the tokens are.

    The episodes of a name are in ``token_candidate_members``; copies are not expanded into pairs.
    """
    return ops.token_overlaps(_names(spark, d), "name").select("a_name", "b_name", F.round("overlap", 6).alias("overlap"))


@Q.query()
def token_candidates(spark, d):
    """Buyer names that share any token, however frequent, and pass the buyer test.

    The candidate episodes are the rows of ``token_candidate_members`` of both names; copies are not expanded into pairs.
    """
    return ops.token_pairs(_names(spark, d), "name")


@Q.query(r"""
    SELECT DISTINCT name, episode_id FROM (SELECT trim(regexp_replace(strip_accents(lower(anchor_buyer_name)), '[^a-z0-9]+', ' ', 'g')) AS name, anchor_episode_id AS episode_id FROM candidate_pairs WHERE anchor_buyer_name IS NOT NULL)
    WHERE len(list_filter(string_split(name, ' '), lambda x: length(x) >= 4 AND NOT regexp_matches(x, '^[0-9]+$'))) > 0""")
def token_candidate_members(spark, d):
    """The episodes of each name of ``token_candidates``."""
    return _names(spark, d).where(F.size(text.name_tokens(F.col("name"))) > 0).distinct()


def _texts(spark, d):
    """Whole texts of a buyer as anchors and candidates, normalised as names are."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("buyer_key").alias("block"), F.to_date("published_on").alias("day"), text.text_key(F.col("text")).alias("text"))
    return t


_TFIDF = r"""
    n{k} AS (SELECT doc_id AS id, buyer_key AS block, CAST(published_on AS DATE) AS day, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) AS text FROM documents WHERE buyer_key <> '' AND published_on IS NOT NULL),
    pairs{k} AS (SELECT a.id AS a_id, c.id AS c_id FROM n{k} a JOIN n{k} c ON c.block = a.block WHERE a.id <> c.id AND date_diff('day', a.day, c.day) BETWEEN 90 AND 2920),
    grams{k} AS ({grams}),
    terms{k} AS (SELECT id, term, count(*) AS tf FROM grams{k} GROUP BY 1, 2),
    corpus{k} AS (SELECT a_id, c_id AS id FROM pairs{k} UNION SELECT a_id, a_id FROM pairs{k}),
    size{k} AS (SELECT a_id, count(*) AS n FROM corpus{k} GROUP BY 1),
    bag{k} AS MATERIALIZED (SELECT a_id, id, term, tf FROM corpus{k} JOIN terms{k} USING (id)),
    df{k} AS (SELECT a_id, term, count(*) AS df, max(tf) FILTER (id = a_id) AS own FROM bag{k} GROUP BY 1, 2),
    w{k} AS (SELECT a_id, id, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w, coalesce(own, 0) * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS o FROM bag{k} JOIN df{k} USING (a_id, term) JOIN size{k} USING (a_id)),
    sums{k} AS (SELECT a_id, id, sqrt(sum(w * w)) AS norm, sum(w * o) AS dot FROM w{k} GROUP BY 1, 2),
    sim{k} AS (SELECT p.a_id, p.c_id, coalesce(round(c.dot / (c.norm * a.norm), 6), 0.0) AS similarity FROM pairs{k} p LEFT JOIN sums{k} c ON c.a_id = p.a_id AND c.id = p.c_id LEFT JOIN sums{k} a ON a.a_id = p.a_id AND a.id = p.a_id)"""
_WORDS = r"SELECT id, unnest(list_concat(t, CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE []::VARCHAR[] END)) AS term FROM (SELECT id, list_filter(string_split(text, ' '), lambda x: length(x) >= 2) AS t FROM n_w)"
_CHARS = r"SELECT id, substr(w, CAST(i AS INT), CAST(k AS INT)) AS term FROM (SELECT id, w, k, unnest(generate_series(1, length(w) - k + 1)) AS i FROM (SELECT id, ' ' || unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) || ' ' AS w FROM n_c), (SELECT unnest([3, 4, 5]) AS k) WHERE length(w) >= k)"
_BY_WORD, _BY_CHAR = _TFIDF.format(k="_w", grams=_WORDS), _TFIDF.format(k="_c", grams=_CHARS)


@Q.query(f"WITH {_BY_WORD} SELECT a_id, c_id, similarity FROM sim_w")
def tfidf_word(spark, d):
    return similarity.blocked_similarities(_texts(spark, d), kinds=["word"], digits=6).select("a_id", "c_id", F.col("word").alias("similarity"))


@Q.query(f"WITH {_BY_CHAR} SELECT a_id, c_id, similarity FROM sim_c")
def tfidf_char_wb(spark, d):
    return similarity.blocked_similarities(_texts(spark, d), kinds=["char"]).select("a_id", "c_id", F.round("char", 6).alias("similarity"))


@Q.query(f"WITH {_BY_WORD}, {_BY_CHAR} SELECT w.a_id, w.c_id, w.similarity AS word, c.similarity AS char, greatest(w.similarity, c.similarity) AS text_component FROM sim_w w JOIN sim_c c ON c.a_id = w.a_id AND c.c_id = w.c_id")
def text_component(spark, d):
    s = similarity.blocked_similarities(_texts(spark, d)).select("a_id", "c_id", F.round("word", 6).alias("word"), F.round("char", 6).alias("char"))
    return s.withColumn("text_component", F.greatest("word", "char"))


@Q.query()
def sequence_ratio(spark, d):
    p = table(spark, d, "candidate_pairs").select("anchor_buyer_name", "candidate_buyer_name").distinct()
    keyed = p.select("*", text.text_key(F.col("anchor_buyer_name")).alias("a"), text.text_key(F.col("candidate_buyer_name")).alias("b"))
    return ops.sequence_ratio(keyed, "a", "b").select("anchor_buyer_name", "candidate_buyer_name", "ratio")


def _method(name, condition):
    sql = f"SELECT anchor_episode_id, candidate_episode_id, count(*) AS n FROM candidate_pairs WHERE {condition} GROUP BY 1, 2"

    @Q.query(sql, name=f"method_{name.lower()}")
    def run(spark, d):
        return table(spark, d, "candidate_pairs").where(ops.rule(name, 70.0)).groupBy(ops.ANCHOR, ops.CANDIDATE).agg(F.count(F.lit(1)).alias("n"))


_RULES = {
    "A": f"buyer_match_type = 'siren' AND {_C} > 0 AND {_T} >= 0.25",
    "B": f"{_T} >= 0.7",
    "C": f"(buyer_match_type IN ('siren', 'normalized_name') OR {_N} >= 0.82) AND ({_C} > 0 OR {_T} >= 0.55) AND {_T} >= 0.25 AND (buyer_match_type IN ('siren', 'normalized_name') OR ({_T} >= 0.4 AND {_C} > 0)) AND {_S} >= 70.0",
}
for _name, _condition in _RULES.items():
    _method(_name, _condition)

_PREDICT = """SELECT anchor_episode_id, candidate_episode_id, score, CAST(row_number() OVER (PARTITION BY anchor_episode_id ORDER BY score DESC NULLS LAST, first, candidate_episode_id) AS INT) AS predicted_rank
    FROM (SELECT anchor_episode_id, candidate_episode_id, max(CASE WHEN isnan({by}) THEN NULL ELSE {by} END) AS score, min(candidate_origin_date) AS first FROM candidate_pairs WHERE {rule} GROUP BY 1, 2)"""


@Q.query(f"SELECT anchor_episode_id, candidate_episode_id, score FROM ({_PREDICT.format(by='text_component', rule=_RULES['B'])}) WHERE predicted_rank = 1")
def predict_top1(spark, d):
    return ops.predict(table(spark, d, "candidate_pairs"), "B", 70.0, 1).select(ops.ANCHOR, ops.CANDIDATE, "score")


_ARMS = (("B", 80.0, "text_component"), ("B", 70.0, "text_component"), ("B", 60.0, "text_component"), ("C", 70.0, "linkage_score"))


@Q.query(" UNION ALL ".join(f"SELECT '{m}@{int(t)}' AS arm, count(*) AS links, count(DISTINCT candidate_episode_id) AS successors FROM ({_PREDICT.format(by=by, rule=_RULES[m] if m == 'C' else f'{_T} >= {t / 100}')}) WHERE predicted_rank = 1" for m, t, by in _ARMS))
def policy_arms(spark, d):
    out = None
    for m, t, _ in _ARMS:
        one = ops.predict(table(spark, d, "candidate_pairs"), m, t, 1).agg(F.lit(f"{m}@{int(t)}").alias("arm"), F.count(F.lit(1)).alias("links"), F.count_distinct(ops.CANDIDATE).alias("successors"))
        out = one if out is None else out.unionByName(one)
    return out


def _truth(spark, d):
    c = table(spark, d, "confirmed_links").where("final_outcome in ('OBSERVED_SUCCESSOR', 'NO_OBSERVED_SUCCESSOR')")
    return c.groupBy(ops.ANCHOR).agg(F.collect_set(F.when(F.col("final_outcome") == "OBSERVED_SUCCESSOR", F.col("successor_episode_id"))).alias("successors"))


_TRUTH = "SELECT anchor_episode_id, list(DISTINCT successor_episode_id) FILTER (final_outcome = 'OBSERVED_SUCCESSOR') AS successors FROM confirmed_links WHERE final_outcome IN ('OBSERVED_SUCCESSOR', 'NO_OBSERVED_SUCCESSOR') GROUP BY 1"


@Q.query(f"""
    WITH t AS ({_TRUTH}), p AS ({_PREDICT.format(by='text_component', rule=f'{_T} >= 0.5')}), q AS (SELECT anchor_episode_id, max(candidate_episode_id) FILTER (predicted_rank = 1) AS top, list(candidate_episode_id) AS five FROM p WHERE predicted_rank <= 5 GROUP BY 1),
    c AS (SELECT count(*) FILTER (len(successors) > 0) AS positives, count(*) FILTER (coalesce(len(successors), 0) = 0) AS negatives, count(top) AS accepted, count(*) FILTER (len(successors) > 0 AND top IS NOT NULL AND list_contains(successors, top)) AS tp,
      count(*) FILTER (len(successors) > 0 AND top IS NOT NULL AND NOT list_contains(successors, top)) AS fp_wrong, count(*) FILTER (coalesce(len(successors), 0) = 0 AND top IS NOT NULL) AS fp_negative, count(*) FILTER (len(successors) > 0 AND top IS NULL) AS fn_abstained,
      count(*) FILTER (coalesce(len(successors), 0) = 0 AND top IS NULL) AS tn, count(*) FILTER (len(successors) > 0 AND list_has_any(successors, five)) AS hits5 FROM t LEFT JOIN q USING (anchor_episode_id))
    SELECT *, CASE WHEN accepted > 0 THEN round(tp / accepted::DOUBLE, 4) END AS precision, CASE WHEN positives > 0 THEN round(tp / positives::DOUBLE, 4) END AS recall, CASE WHEN positives > 0 THEN round(hits5 / positives::DOUBLE, 4) END AS recall5,
      CASE WHEN negatives > 0 THEN round(fp_negative / negatives::DOUBLE, 4) END AS fpr, CASE WHEN negatives > 0 THEN round(tn / negatives::DOUBLE, 4) END AS no_link_accuracy, round(accepted / (positives + negatives)::DOUBLE, 4) AS coverage,
      round(greatest((tp / accepted::DOUBLE + 3.841458824 / (2.0 * accepted) - 1.959963985 * sqrt(tp / accepted::DOUBLE * (1 - tp / accepted::DOUBLE) / accepted + 3.841458824 / (4.0 * accepted * accepted))) / (1 + 3.841458824 / accepted), 0.0), 4) AS precision_low,
      round(least((tp / accepted::DOUBLE + 3.841458824 / (2.0 * accepted) + 1.959963985 * sqrt(tp / accepted::DOUBLE * (1 - tp / accepted::DOUBLE) / accepted + 3.841458824 / (4.0 * accepted * accepted))) / (1 + 3.841458824 / accepted), 1.0), 4) AS precision_high
    FROM c""")
def confusion_metrics(spark, d):
    return ops.confusion(ops.predict(table(spark, d, "candidate_pairs"), "B", 50.0), _truth(spark, d))


@Q.query(f"""
    WITH t AS ({_TRUTH}), b AS (SELECT anchor_episode_id, candidate_episode_id, coalesce(score, 0.0) AS score FROM ({_PREDICT.format(by='text_component', rule='true')}) WHERE predicted_rank = 1)
    SELECT CAST(threshold AS INT) AS threshold, count(*) FILTER (coalesce(score >= threshold / 100.0::DOUBLE, false)) AS accepted, count(*) FILTER (coalesce(score >= threshold / 100.0::DOUBLE, false) AND len(successors) > 0 AND list_contains(successors, candidate_episode_id)) AS tp,
      count(*) FILTER (coalesce(score >= threshold / 100.0::DOUBLE, false) AND len(successors) > 0 AND NOT list_contains(successors, candidate_episode_id)) AS fp_wrong, count(*) FILTER (coalesce(score >= threshold / 100.0::DOUBLE, false) AND coalesce(len(successors), 0) = 0) AS fp_negative
    FROM t LEFT JOIN b USING (anchor_episode_id), (SELECT unnest(generate_series(0, 100)) AS threshold) GROUP BY 1""")
def threshold_sweep(spark, d):
    return ops.sweep(table(spark, d, "candidate_pairs"), _truth(spark, d), range(101))


def _labelled(spark, d):
    true = table(spark, d, "confirmed_links").where("final_outcome = 'OBSERVED_SUCCESSOR'").select(ops.ANCHOR, F.col("successor_episode_id").alias(ops.CANDIDATE), F.lit(1).alias("y")).distinct()
    p = table(spark, d, "candidate_pairs").groupBy(ops.ANCHOR, ops.CANDIDATE).agg(F.max(ops._zero("text_component")).alias("score"))
    return p.join(true, [ops.ANCHOR, ops.CANDIDATE], "left").select(ops.ANCHOR, ops.CANDIDATE, "score", F.coalesce("y", F.lit(0)).alias("y"))


_LABELLED = f"""SELECT p.*, CASE WHEN t.anchor_episode_id IS NULL THEN 0 ELSE 1 END AS y FROM (SELECT anchor_episode_id, candidate_episode_id, max({_T}) AS score FROM candidate_pairs GROUP BY 1, 2) p
    LEFT JOIN (SELECT DISTINCT anchor_episode_id, successor_episode_id FROM confirmed_links WHERE final_outcome = 'OBSERVED_SUCCESSOR') t ON t.anchor_episode_id = p.anchor_episode_id AND t.successor_episode_id = p.candidate_episode_id"""
_CURVE = f"""WITH l AS ({_LABELLED}), g AS (SELECT score, sum(y) AS p, count(*) AS n FROM l GROUP BY 1),
    r AS (SELECT score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n - p) OVER w AS BIGINT) AS fp, (SELECT sum(y) FROM l)::DOUBLE AS pp, (SELECT count(*) - sum(y) FROM l)::DOUBLE AS nn FROM g WINDOW w AS (ORDER BY score DESC)),
    c AS (SELECT score, tp, fp, tp / pp AS recall, tp / (tp + fp)::DOUBLE AS precision, fp / nn AS fpr FROM r)"""


@Q.query(_CURVE + " SELECT score, tp, fp, round(recall, 8) AS recall, round(precision, 8) AS precision, round(fpr, 8) AS fpr FROM c")
def roc_curve(spark, d):
    c = ops.curve(_labelled(spark, d), "y", "score")
    return c.select("score", "tp", "fp", *[F.round(x, 8).alias(x) for x in ("recall", "precision", "fpr")])


@Q.query(_CURVE + " SELECT round(sum(area), 6) AS roc_auc, round(sum(step), 6) AS average_precision FROM (SELECT (fpr - lag(fpr, 1, 0.0) OVER w) * (recall + lag(recall, 1, 0.0) OVER w) / 2 AS area, (recall - lag(recall, 1, 0.0) OVER w) * precision AS step FROM c WINDOW w AS (ORDER BY score DESC))")
def roc_auc_ap(spark, d):
    return ops.auc_ap(ops.curve(_labelled(spark, d), "y", "score"))


@Q.query(f"""
    WITH l AS ({_LABELLED}), r AS (SELECT substr(anchor_episode_id, 4, 1) AS h, CAST(y AS DOUBLE) AS y, CAST(score >= 0.3 AS DOUBLE) AS x, 1.5 + (ascii(substr(anchor_episode_id, 5, 1)) % 3) AS w FROM l),
    t AS (SELECT sum(w * y) AS ty, sum(w * x) AS tx, sum(w * y) / sum(w * x) AS ratio, count(*) AS n FROM r),
    s AS (SELECT h, count(*) AS nh, sum(w) AS bigh, var_samp(y - ratio * x) AS s2 FROM r, t GROUP BY 1 HAVING count(*) >= 2),
    v AS (SELECT sqrt(sum(bigh * bigh * (1 - nh / bigh) * s2 / nh)) AS sd FROM s)
    SELECT round(ratio, 4) AS estimate, round(sd / tx, 4) AS standard_error, round(greatest(ratio - 1.959963985 * sd / tx, 0.0), 4) AS low, round(least(ratio + 1.959963985 * sd / tx, 1.0), 4) AS high, n FROM t, v""")
def stratified_ratio(spark, d):
    r = _labelled(spark, d).select(F.substring(ops.ANCHOR, 4, 1).alias("h"), "y", (F.col("score") >= 0.3).cast("double").alias("x"), (1.5 + (F.ascii(F.substring(ops.ANCHOR, 5, 1)) % 3)).alias("w"))
    return ops.stratified_ratio(r, "y", "x", "h", "w")


@Q.query(f"""SELECT t.anchor_episode_id, len(successors) AS truths, min(rank_no) AS best_rank, CASE WHEN min(rank_no) IS NULL THEN 0.0 ELSE round(1.0 / min(rank_no), 6) END AS reciprocal, coalesce(min(rank_no) <= 5, false) AS hit5, coalesce(min(rank_no) <= 20, false) AS hit20
    FROM ({_TRUTH}) t LEFT JOIN (SELECT anchor_episode_id, candidate_episode_id, CAST(row_number() OVER (PARTITION BY anchor_episode_id ORDER BY score DESC, candidate_episode_id) AS INT) AS rank_no FROM (SELECT anchor_episode_id, candidate_episode_id, max({_T}) AS score FROM candidate_pairs GROUP BY 1, 2)) r
    ON r.anchor_episode_id = t.anchor_episode_id AND list_contains(successors, r.candidate_episode_id) WHERE len(successors) > 0 GROUP BY 1, 2""")
def recall_at_k(spark, d):
    from pyspark.sql import Window

    t = _truth(spark, d).where("size(successors) > 0")
    p = table(spark, d, "candidate_pairs").join(t.select(ops.ANCHOR), ops.ANCHOR, "left_semi").groupBy(ops.ANCHOR, ops.CANDIDATE).agg(F.max(ops._zero("text_component")).alias("score"))
    r = p.withColumn("rank_no", F.row_number().over(Window.partitionBy(ops.ANCHOR).orderBy(F.desc("score"), ops.CANDIDATE)))
    best = t.select(ops.ANCHOR, F.explode("successors").alias(ops.CANDIDATE)).join(r, [ops.ANCHOR, ops.CANDIDATE], "left").groupBy(ops.ANCHOR).agg(F.min("rank_no").alias("best_rank"))
    j = t.join(best, ops.ANCHOR)
    return j.select(ops.ANCHOR, F.size("successors").cast("bigint").alias("truths"), "best_rank", F.coalesce(F.round(1.0 / F.col("best_rank"), 6), F.lit(0.0)).alias("reciprocal"), *[F.coalesce(F.col("best_rank") <= k, F.lit(False)).alias(f"hit{k}") for k in (5, 20)])


@Q.query("""
    WITH p AS (SELECT DISTINCT anchor_episode_id, candidate_episode_id FROM candidate_pairs), x AS (SELECT DISTINCT right_idx, target_idweb FROM explicit_links)
    SELECT reason, count(*) AS n FROM (SELECT CASE WHEN right_idx NOT IN (SELECT idx FROM notices) THEN 'source_missing' WHEN target_idweb IS NULL OR target_idweb = '' THEN 'target_blank' WHEN a.idweb IS NULL THEN 'target_missing' WHEN a.idx = right_idx THEN 'self' ELSE 'reachable' END AS reason FROM x LEFT JOIN (SELECT DISTINCT idx, idweb FROM notices) a ON a.idweb = target_idweb) GROUP BY 1""")
def blocking_loss(spark, d):
    x = table(spark, d, "explicit_links").select("right_idx", "target_idweb").distinct()
    n = table(spark, d, "notices").select("idx", "idweb").distinct()
    j = x.join(n.select(F.col("idx").alias("right_idx"), F.lit(True).alias("known")), "right_idx", "left").join(n.select(F.col("idweb").alias("target_idweb"), F.col("idx").alias("t")), "target_idweb", "left")
    why = F.when(F.col("known").isNull(), "source_missing").when(F.coalesce("target_idweb", F.lit("")) == "", "target_blank").when(F.col("t").isNull(), "target_missing").when(F.col("t") == F.col("right_idx"), "self").otherwise("reachable")
    return j.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@Q.query("""
    SELECT source_stratum, relationship_label, count(*) AS n, count(*) FILTER (observable_successor_y_n_uncertain = 'Y') AS yes, CASE WHEN count(*) FILTER (observable_successor_y_n_uncertain IN ('Y', 'N')) > 0 THEN round(count(*) FILTER (observable_successor_y_n_uncertain = 'Y') / (count(*) FILTER (observable_successor_y_n_uncertain IN ('Y', 'N')))::DOUBLE, 4) END AS precision
    FROM review_audit_findings GROUP BY 1, 2""")
def review_precision(spark, d):
    y, known = F.col("observable_successor_y_n_uncertain") == "Y", F.col("observable_successor_y_n_uncertain").isin("Y", "N")
    g = table(spark, d, "review_audit_findings").groupBy("source_stratum", "relationship_label").agg(F.count(F.lit(1)).alias("n"), F.count_if(y).alias("yes"), F.count_if(known).alias("known"))
    return g.select("source_stratum", "relationship_label", "n", "yes", F.when(F.col("known") > 0, F.round(F.col("yes") / F.col("known"), 4)).alias("precision"))


_LEVELS = """(SELECT 'buyer_' || buyer_match_type AS buyer, CASE WHEN text_component IS NULL OR isnan(text_component) THEN 'missing' WHEN text_component < 0.05 THEN 'text<0.05' WHEN text_component < 0.15 THEN 'text0.05-0.15' WHEN text_component < 0.3 THEN 'text0.15-0.30' WHEN text_component < 0.5 THEN 'text0.30-0.50' ELSE 'text>=0.50' END AS text,
    CASE WHEN cpv_component IS NULL OR isnan(cpv_component) THEN 'missing' WHEN cpv_component < 0.001 THEN 'cpv_none' WHEN cpv_component < 0.5 THEN 'cpv_partial' ELSE 'cpv_strong' END AS cpv, CASE WHEN time_component IS NULL OR isnan(time_component) THEN 'missing' WHEN time_component < 0.001 THEN 'time_low' WHEN time_component < 0.5 THEN 'time_medium' ELSE 'time_high' END AS time, * EXCLUDE (candidate_version) FROM candidate_pairs)"""


@Q.query("SELECT field, level, n, round((n + 0.5) / sum(n + 0.5) OVER (PARTITION BY field), 9) AS u FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS level, count(*) AS n FROM {_LEVELS} GROUP BY 2" for f in ops.FIELDS) + ")")
def fs_levels(spark, d):
    return ops.levels(ops.patterns(table(spark, d, "candidate_pairs"))).withColumn("u", F.round("u", 9))


_MODEL = (("buyer", "buyer_siren", 0.8), ("buyer", "buyer_normalized_name", -0.4), ("text", "text>=0.50", 4.1), ("text", "text0.30-0.50", 1.2), ("text", "text<0.05", -3.0), ("cpv", "cpv_strong", 2.2), ("cpv", "cpv_none", -1.6), ("time", "time_high", 1.1), ("time", "time_low", -0.9))


@Q.query("SELECT anchor_episode_id, candidate_episode_id, round(w, 8) AS match_weight, round(1 / (1 + exp(-w * 0.6931471805599453)), 8) AS probability FROM (SELECT anchor_episode_id, candidate_episode_id, log2(0.01 / 0.99) + " + " + ".join("CASE " + f + " " + " ".join(f"WHEN '{v}' THEN {b}" for g, v, b in _MODEL if g == f) + " ELSE 0.0 END" for f in ops.FIELDS) + f" AS w FROM {_LEVELS})")
def fs_match_weight(spark, d):
    s = ops.score_with(table(spark, d, "candidate_pairs"), list(_MODEL), 0.01)
    return s.select(ops.ANCHOR, ops.CANDIDATE, F.round("match_weight", 8).alias("match_weight"), F.round("fs_match_probability", 8).alias("probability"))


def _cramer_sql(a, b):
    return f"""SELECT '{a}' AS left_field, '{b}' AS right_field, round(sqrt(sum((coalesce(n, 0) - e) * (coalesce(n, 0) - e) / e) / max(t) / (least(max(ka), max(kb)) - 1)), 6) AS v FROM (
      SELECT na * nb / t::DOUBLE AS e, n, t, ka, kb FROM (SELECT {a} AS a, count(*) AS na FROM {_LEVELS} GROUP BY 1) CROSS JOIN (SELECT {b} AS b, count(*) AS nb FROM {_LEVELS} GROUP BY 1) CROSS JOIN (SELECT count(*) AS t, count(DISTINCT {a}) AS ka, count(DISTINCT {b}) AS kb FROM {_LEVELS})
      LEFT JOIN (SELECT {a} AS a2, {b} AS b2, count(*) AS n FROM {_LEVELS} GROUP BY 1, 2) ON a2 = a AND b2 = b)"""


@Q.query(" UNION ALL ".join(_cramer_sql(a, b) for i, a in enumerate(ops.FIELDS) for b in ops.FIELDS[i + 1 :]))
def cramers_v(spark, d):
    return ops.cramers_v(ops.patterns(table(spark, d, "candidate_pairs")))


@Q.query()
def fs_em(spark, d):
    fit = ops.fit_mixture(ops.patterns(table(spark, d, "candidate_pairs")))
    return spark.createDataFrame([(f, v, m, u, b, fit["prior"], len(fit["trace"])) for f, v, m, u, b in fit["levels"]], "field string, level string, m double, u double, bits double, prior double, iterations int")


@Q.query()
def method_d(spark, d):
    """The posterior method at 0.65 under the model fitted to the pairs; ``method_d_fixed`` has a stored one."""
    p = table(spark, d, "candidate_pairs")
    fit = ops.fit_mixture(ops.patterns(p))
    s = ops.score_with(p, [(f, v, b) for f, v, _, _, b in fit["levels"]], fit["prior"])
    return ops.predict(s, "D", 65.0, 1).select(ops.ANCHOR, ops.CANDIDATE, "score")


@Q.query()
def fs_robustness(spark, d):
    """How far the evidence of each level moves when the non-match rates are fitted too."""
    rows = ops.fit_divergence(ops.patterns(table(spark, d, "candidate_pairs")))
    return spark.createDataFrame(rows, "field string, level string, fixed double, free double, difference double")
