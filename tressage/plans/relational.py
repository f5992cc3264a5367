"""Joins, aggregates, windows and set operations over orders and notices, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import linkage
from ..runtime import table
from .registry import Registry

Q = Registry()


def _day(c):
    return F.to_date(c)


@Q.query("""
    WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders)
    SELECT CAST(step AS INT) AS step, n FROM (
      SELECT 1 AS step, count(*) AS n FROM o UNION ALL SELECT 2, count(*) FROM o WHERE o_orderstatus = 'F'
      UNION ALL SELECT 3, count(*) FROM o WHERE o_orderstatus = 'F' AND day >= DATE '1996-01-01' AND day < DATE '2000-01-01'
      UNION ALL SELECT 4, count(*) FROM o WHERE o_orderstatus = 'F' AND day >= DATE '1996-01-01' AND day < DATE '2000-01-01' AND o_totalprice > 100000)""")
def cohort_funnel(spark, d):
    o = table(spark, d, "orders").withColumn("day", _day("o_orderdate"))
    award = F.col("o_orderstatus") == "F"
    window = award & (F.col("day") >= F.lit("1996-01-01").cast("date")) & (F.col("day") < F.lit("2000-01-01").cast("date"))
    steps = [F.lit(True), award, window, window & (F.col("o_totalprice") > 100000)]
    one = o.agg(*[F.count_if(s).alias(str(i)) for i, s in enumerate(steps, 1)])
    return one.unpivot([], [str(i) for i in range(1, 5)], "step", "n").select(F.col("step").cast("int"), "n")


@Q.query("SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS award, CAST(max(o_orderdate) AS DATE) AS last_day, round(min(CASE WHEN l_shipdate > o_orderdate THEN l_extendedprice END), 2) AS least FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def award_dates(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    j = o.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_custkey").agg(_day(F.min("o_orderdate")).alias("award"), _day(F.max("o_orderdate")).alias("last_day"), F.round(F.min(F.when(F.col("l_shipdate") > F.col("o_orderdate"), F.col("l_extendedprice"))), 2).alias("least"))


@Q.query("SELECT famille, nature, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY famille)::DOUBLE, 6) AS share FROM notices_engineered GROUP BY 1, 2")
def shares_within(spark, d):
    g = table(spark, d, "notices_engineered").groupBy("famille", "nature").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("famille")), 6))


@Q.query(r"SELECT code, count(*) AS n FROM (SELECT unnest(regexp_extract_all(cpv_codes_json, '\b([0-9]{8})\b', 1)) AS code FROM notices_engineered) GROUP BY 1")
def value_counts_multi(spark, d):
    n = table(spark, d, "notices_engineered").select(F.explode(F.regexp_extract_all("cpv_codes_json", F.lit(r"\b([0-9]{8})\b"), F.lit(1))).alias("code"))
    return n.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@Q.query("""
    WITH c AS (SELECT p_brand AS brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY n DESC, brand) AS k FROM c)
    SELECT CASE WHEN k <= 6 THEN brand ELSE 'Other' END AS brand, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / (SELECT sum(n) FROM c)::DOUBLE, 6) AS share FROM r GROUP BY 1""")
def top_n_other_share(spark, d):
    # a fixed number of names is kept, so the broadcast side never grows
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    c = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))
    top = c.orderBy(F.desc("n"), "brand").limit(6).select("brand", F.lit(True).alias("top"))
    g = c.join(F.broadcast(top), "brand", "left").groupBy(F.when(F.col("top"), F.col("brand")).otherwise("Other").alias("brand")).agg(F.sum("n").alias("n"))
    return g.crossJoin(F.broadcast(c.agg(F.sum("n").alias("all")))).select("brand", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@Q.query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def monthly_pivot(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@Q.query("""
    SELECT l_returnflag, metric, round(value, 2) AS value FROM (UNPIVOT (SELECT l_returnflag, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price, sum(l_extendedprice * l_discount) AS discount FROM lineitem GROUP BY 1) ON quantity, price, discount INTO NAME metric VALUE value)""")
def unpivot_metrics(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("discount"))
    return g.unpivot("l_returnflag", ["quantity", "price", "discount"], "metric", "value").select("l_returnflag", "metric", F.round("value", 2).alias("value"))


@Q.query("""
    SELECT c_mktsegment, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS least,
      round(quantile_cont(o_totalprice, 0.05), 4) AS p05, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, max(o_totalprice) AS most
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def describe_quantiles(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    p = F.percentile("o_totalprice", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    g = j.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 4).alias("sd"), F.min("o_totalprice").alias("least"), p.alias("p"), F.max("o_totalprice").alias("most"))
    return g.select("c_mktsegment", "n", "mean", "sd", "least", *[F.round(F.col("p")[i], 4).alias(a) for i, a in enumerate(("p05", "p50", "p95"))], "most")


@Q.query("SELECT idweb, count(*) AS n, count(DISTINCT raw_source_file) AS files FROM notices_engineered GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return table(spark, d, "notices_engineered").groupBy("idweb").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("raw_source_file").alias("files")).where("n > 1")


@Q.query("""
    SELECT o_custkey, 'EP-' || substr(sha256(string_agg(DISTINCT CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY CAST(o_orderkey AS VARCHAR))), 1, 16) AS episode_id, count(*) AS n,
      CAST(coalesce(min(o_orderdate) FILTER (o_orderstatus <> 'F'), min(o_orderdate)) AS DATE) AS origin, CASE WHEN count(*) FILTER (o_orderstatus <> 'F') > 0 THEN 'competition' ELSE 'any' END AS origin_source,
      CAST(max(o_orderdate) AS DATE) AS last_day, CAST(date_diff('day', CAST(coalesce(min(o_orderdate) FILTER (o_orderstatus <> 'F'), min(o_orderdate)) AS DATE), CAST(max(o_orderdate) AS DATE)) AS INT) AS span_days,
      list_sort(list(DISTINCT o_orderstatus)) AS statuses, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) ELSE '' END AS priority, count(DISTINCT o_orderpriority) > 1 AS priority_conflict, bool_or(o_totalprice > 400000) AS large
    FROM orders GROUP BY 1""")
def episode_aggregate(spark, d):
    o = table(spark, d, "orders").withColumns({"day": _day("o_orderdate"), "open": F.col("o_orderstatus") != "F"})
    g = o.groupBy("o_custkey").agg(
        F.array_sort(F.collect_set(F.col("o_orderkey").cast("string"))).alias("ids"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("open"), F.col("day"))).alias("first_open"), F.min("day").alias("first"), F.max("day").alias("last_day"),
        F.array_sort(F.collect_set("o_orderstatus")).alias("statuses"), F.collect_set("o_orderpriority").alias("p"), F.bool_or(F.col("o_totalprice") > 400000).alias("large"))
    origin = F.coalesce("first_open", "first")
    return g.select(
        "o_custkey", F.concat(F.lit("EP-"), F.substring(F.sha2(F.concat_ws("\n", "ids"), 256), 1, 16)).alias("episode_id"), "n", origin.alias("origin"), F.when(F.col("first_open").isNotNull(), "competition").otherwise("any").alias("origin_source"),
        "last_day", F.datediff("last_day", origin).alias("span_days"), "statuses", F.when(F.size("p") == 1, F.col("p")[0]).otherwise("").alias("priority"), (F.size("p") > 1).alias("priority_conflict"), "large")


@Q.query("""
    SELECT raw_source_file, buyer_key, string_agg(objet, chr(10) ORDER BY pos, objet) AS text FROM (SELECT raw_source_file, buyer_key, min_by(objet, (idx, objet)) AS objet, min(idx) AS pos FROM notices_engineered WHERE objet <> '' GROUP BY raw_source_file, buyer_key, lower(objet)) GROUP BY 1, 2""")
def ordered_dedup_text(spark, d):
    """The distinct subjects of a buyer within a delivery, in order; a delivery is what bounds a group."""
    n, by = table(spark, d, "notices_engineered").where("objet <> ''"), ["raw_source_file", "buyer_key"]
    one = n.groupBy(*by, F.lower("objet").alias("k")).agg(F.min_by("objet", F.struct("idx", "objet")).alias("objet"), F.min("idx").alias("at"))
    g = one.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", "objet"))).alias("t"))
    return g.select(*by, F.concat_ws("\n", F.transform("t", lambda x: x["objet"])).alias("text"))


@Q.query("""
    SELECT o_custkey, o_orderpriority AS mode FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, min(o_orderkey)) AS k FROM orders GROUP BY 1, 2) WHERE k = 1""")
def mode_first_seen(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))
    return g.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("n", -F.col("first"))).alias("mode"))


_SEGMENTS = ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@Q.query("""
    SELECT c_custkey, """ + ", ".join(f"CAST(c_mktsegment = '{s}' AS INT) AS segment_{s.lower()}" for s in _SEGMENTS) + """, round(c_acctbal - (SELECT quantile_cont(c_acctbal, 0.5) FROM customer), 6) AS balance_centred FROM customer""")
def dummy_coding(spark, d):
    c = table(spark, d, "customer")
    middle = c.agg(F.percentile("c_acctbal", F.lit(0.5)).alias("m"))
    return c.crossJoin(F.broadcast(middle)).select("c_custkey", *[(F.col("c_mktsegment") == s).cast("int").alias(f"segment_{s.lower()}") for s in _SEGMENTS], F.round(F.col("c_acctbal") - F.col("m"), 6).alias("balance_centred"))


@Q.query("""
    SELECT o_orderkey, n.n_name AS nation, r.r_name AS region, c2.c_name AS same_nation_first FROM orders JOIN customer c ON c.c_custkey = o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
    JOIN (SELECT c_nationkey, min_by(c_name, c_custkey) AS c_name FROM customer GROUP BY 1) c2 ON c2.c_nationkey = c.c_nationkey""")
def dimension_two_roles(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    first = c.groupBy("c_nationkey").agg(F.min_by("c_name", "c_custkey").alias("same_nation_first"))
    j = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(first, "c_nationkey")
    j = j.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows by definition
    return j.select("o_orderkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "same_nation_first")


@Q.query("SELECT idx, count(*) AS n FROM notices n WHERE EXISTS (SELECT 1 FROM explicit_links e WHERE e.right_idx = n.idx) GROUP BY 1")
def semi_filter(spark, d):
    return table(spark, d, "notices").join(table(spark, d, "explicit_links").select(F.col("right_idx").alias("idx")), "idx", "left_semi").groupBy("idx").agg(F.count(F.lit(1)).alias("n"))


@Q.query("SELECT DISTINCT idx, idweb FROM notices n WHERE NOT EXISTS (SELECT 1 FROM explicit_links e WHERE e.right_idx = n.idx OR regexp_replace(e.target_idweb, '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g') = n.idweb)")
def anti_filter(spark, d):
    e = table(spark, d, "explicit_links")
    return table(spark, d, "notices").select("idx", "idweb").distinct().join(e.select(F.col("right_idx").alias("idx")), "idx", "left_anti").join(e.select(text.trimmed(F.col("target_idweb")).alias("idweb")), "idweb", "left_anti").select("idx", "idweb")


@Q.query("SELECT a.o_orderkey, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN 'RESOLVED' WHEN count(l_suppkey) = 0 THEN 'UNRESOLVED' ELSE 'AMBIGUOUS' END AS outcome, count(DISTINCT l_suppkey) AS n FROM orders a LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def cardinality_classes(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    g = table(spark, d, "orders").select("o_orderkey").join(li, "o_orderkey", "left").groupBy("o_orderkey").agg(F.count_distinct("l_suppkey").alias("n"))
    return g.select("o_orderkey", F.when(F.col("n") == 1, "RESOLVED").when(F.col("n") == 0, "UNRESOLVED").otherwise("AMBIGUOUS").alias("outcome"), "n")


@Q.query("""
    SELECT CAST(y AS INT) AS year, s.c_mktsegment AS segment, coalesce(n, 0) AS n, CASE WHEN t > 0 THEN round(coalesce(n, 0) / t::DOUBLE, 6) END AS share FROM (SELECT unnest(generate_series(1992, 2003)) AS y) CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s
    LEFT JOIN (SELECT year(o_orderdate) AS yy, c_mktsegment, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) x ON yy = y AND x.c_mktsegment = s.c_mktsegment
    LEFT JOIN (SELECT year(o_orderdate) AS ty, count(*) AS t FROM orders GROUP BY 1) z ON ty = y""")
def spine_zero_fill(spark, d):
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    c = table(spark, d, "customer")
    years = spark.range(1).select(F.explode(F.sequence(F.lit(1992), F.lit(2003))).alias("year"))
    spine = years.crossJoin(c.select(F.col("c_mktsegment").alias("segment")).distinct())  # twelve years
    n = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("year", F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    t = o.groupBy("year").agg(F.count(F.lit(1)).alias("t"))
    return spine.join(n, ["year", "segment"], "left").join(t, "year", "left").select("year", "segment", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.when(F.col("t") > 0, F.round(F.coalesce("n", F.lit(0)) / F.col("t"), 6)).alias("share"))


@Q.query("""
    SELECT o_custkey, o_orderkey, prev_key, gap_days FROM (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS prev_key, CAST(date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)) AS INT) AS gap_days FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE prev_key IS NOT NULL AND gap_days <= 730""")
def chain_pairs(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").withColumns({"prev_key": F.lag("o_orderkey").over(w), "prev_day": _day(F.lag("o_orderdate").over(w))})
    return o.withColumn("gap_days", F.datediff(_day("o_orderdate"), "prev_day")).where("prev_key is not null and gap_days <= 730").select("o_custkey", "o_orderkey", "prev_key", "gap_days")


@Q.query("SELECT contractfolderid, idx, first_value(idx) OVER (PARTITION BY contractfolderid ORDER BY idx) AS centre, count(*) OVER (PARTITION BY contractfolderid) > 1 AS shared FROM (SELECT DISTINCT contractfolderid, idx FROM notices WHERE contractfolderid <> '')")
def star_centres(spark, d):
    n = table(spark, d, "notices").where("contractfolderid <> ''").select("contractfolderid", "idx").distinct()
    w = Window.partitionBy("contractfolderid")
    return n.select("contractfolderid", "idx", F.min("idx").over(w).alias("centre"), (F.count(F.lit(1)).over(w) > 1).alias("shared"))


@Q.query("SELECT anchor_episode_id, candidate_episode_id, linkage_score, rank_no FROM (SELECT DISTINCT anchor_episode_id, candidate_episode_id, linkage_score, CAST(row_number() OVER (PARTITION BY anchor_episode_id ORDER BY linkage_score DESC NULLS LAST, candidate_origin_date, candidate_episode_id, candidate_version, gap_days) AS INT) AS rank_no FROM candidate_pairs) WHERE rank_no <= 3")
def candidate_rank(spark, d):
    w = Window.partitionBy("anchor_episode_id").orderBy(F.desc_nulls_last("linkage_score"), "candidate_origin_date", "candidate_episode_id", "candidate_version", "gap_days")
    return table(spark, d, "candidate_pairs").withColumn("rank_no", F.row_number().over(w)).where("rank_no <= 3").select("anchor_episode_id", "candidate_episode_id", "linkage_score", "rank_no")


@Q.query("SELECT anchor_episode_id, candidate_episode_id, linkage_score, CAST(row_number() OVER (PARTITION BY anchor_episode_id ORDER BY linkage_score DESC NULLS LAST, candidate_origin_date, candidate_episode_id, candidate_version, gap_days) AS INT) AS rank_no FROM candidate_pairs")
def candidate_rank_all(spark, d):
    """The rank of every candidate of an anchor; ``candidate_rank`` has the first three."""
    p = table(spark, d, "candidate_pairs").select("anchor_episode_id", "candidate_episode_id", "linkage_score", "candidate_origin_date", "candidate_version", "gap_days")
    order = [F.desc_nulls_last("linkage_score"), *[F.asc_nulls_last(c) for c in ("candidate_origin_date", "candidate_episode_id", "candidate_version", "gap_days")]]
    return linkage.ranked(p, "anchor_episode_id", order).select("anchor_episode_id", "candidate_episode_id", "linkage_score", "rank_no")


@Q.query("""
    WITH c AS (SELECT anchor_episode_id AS a, candidate_episode_id AS c, max(coalesce(text_component, 0)) AS s, bool_or(coalesce(text_component, 0) >= 0.3) AS keep FROM candidate_pairs WHERE text_component IS NULL OR NOT isnan(text_component) GROUP BY 1, 2),
    r AS (SELECT *, bool_or(keep) OVER (PARTITION BY a) AS any_kept, row_number() OVER (PARTITION BY a, keep ORDER BY s DESC, c) AS in_class, row_number() OVER (PARTITION BY a ORDER BY s DESC, c) AS in_all FROM c)
    SELECT a AS anchor_episode_id, c AS candidate_episode_id, s AS score FROM r WHERE (any_kept AND keep AND in_class <= 75) OR (NOT any_kept AND in_all <= 10)""")
def capped_candidates(spark, d):
    p = table(spark, d, "candidate_pairs").where("text_component is null or not isnan(text_component)").withColumn("score", F.coalesce("text_component", F.lit(0.0)))
    c = p.groupBy("anchor_episode_id", "candidate_episode_id").agg(F.max("score").alias("score")).withColumn("keep", F.col("score") >= 0.3)
    order = [F.desc("score"), "candidate_episode_id"]
    kept = c.where("keep").withColumn("k", F.row_number().over(Window.partitionBy("anchor_episode_id").orderBy(*order))).where("k <= 75")
    poor = c.join(kept.select("anchor_episode_id").distinct(), "anchor_episode_id", "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("anchor_episode_id").orderBy(*order))).where("k <= 10")
    return kept.unionByName(poor).select("anchor_episode_id", "candidate_episode_id", "score")


@Q.query("SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def set_operations(spark, d):
    o = table(spark, d, "orders")
    key = lambda x: x.select(F.col("o_custkey").alias("k"))
    return key(o.where("o_orderstatus = 'F'")).intersect(key(o.where("o_orderstatus = 'P'"))).subtract(key(o.where("o_totalprice > 450000")))


@Q.query("SELECT a.k AS o_custkey, a.s = b.s AS agree, a.s AS by_order, b.s AS by_item FROM (SELECT o_custkey AS k, list_sort(list(DISTINCT o_orderkey)) AS s FROM orders GROUP BY 1) a JOIN (SELECT o_custkey AS k, list_sort(list(DISTINCT l_orderkey)) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1) b ON a.k = b.k")
def set_equality(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_returnflag = 'R'")
    a = o.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderkey")).alias("by_order"))
    b = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.array_sort(F.collect_set("l_orderkey")).alias("by_item"))
    return a.join(b, "o_custkey").select("o_custkey", (F.col("by_order") == F.col("by_item")).alias("agree"), "by_order", "by_item")


@Q.query("SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance, CAST(grouping(c_mktsegment, c_nationkey) AS INT) AS level FROM customer GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment), ())")
def rollup_levels(spark, d):
    c = table(spark, d, "customer")
    return c.rollup("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.grouping_id().cast("int").alias("level"))


@Q.query("SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance, CAST(grouping(c_mktsegment, c_nationkey) AS INT) AS level FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def cube_levels(spark, d):
    c = table(spark, d, "customer")
    return c.cube("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.grouping_id().cast("int").alias("level"))


@Q.query("SELECT n_regionkey, c_mktsegment, count(*) AS n, CAST(grouping(n_regionkey, c_mktsegment) AS INT) AS level FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY GROUPING SETS ((n_regionkey), (c_mktsegment))")
def grouping_sets(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    j = c.join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 rows by definition
    return j.groupingSets([["n_regionkey"], ["c_mktsegment"]], "n_regionkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


@Q.query()
def approximate_distinct(spark, d):
    """Whether the approximate count of customers (2 % standard error) is within a tenth of the exact one."""
    a = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.approx_count_distinct("o_custkey", 0.02).alias("a"), F.count_distinct("o_custkey").alias("e"))
    return a.select("o_orderpriority", (F.abs(F.col("a") / F.col("e") - 1) < 0.1).alias("close"))


@Q.query("SELECT CAST(m AS INT) AS mask, count(*) AS n, (m & 1) > 0 AS has_f, (m & 2) > 0 AS has_o, (m & 4) > 0 AS has_p FROM (SELECT o_custkey, bit_or(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END) AS m FROM orders GROUP BY 1) GROUP BY m")
def method_mask(spark, d):
    o = table(spark, d, "orders")
    g = o.groupBy("o_custkey").agg(F.bit_or(F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(4)).alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    return g.select("mask", "n", *[(F.col("mask").bitwiseAND(b) > 0).alias(a) for b, a in ((1, "has_f"), (2, "has_o"), (4, "has_p"))])


@Q.query("SELECT CASE WHEN n >= 15 THEN '15_plus' ELSE CAST(n AS VARCHAR) END AS size, count(*) AS n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def size_histogram(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    return g.groupBy(F.when(F.col("k") >= 15, "15_plus").otherwise(F.col("k").cast("string")).alias("size")).agg(F.count(F.lit(1)).alias("n"))


@Q.query("SELECT CAST(b AS INT) AS bin, count(*) AS n, round(avg(x), 4) AS mean FROM (SELECT x, least(cast(floor((x - 0) / (m / 60)) AS INT) + 1, 60) AS b FROM (SELECT least(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)) AS x, (SELECT quantile_cont(o_totalprice, 0.99) FROM orders) AS m FROM orders)) GROUP BY 1")
def winsorised_histogram(spark, d):
    o = table(spark, d, "orders")
    j = o.crossJoin(F.broadcast(o.agg(F.percentile("o_totalprice", F.lit(0.99)).alias("m")))).withColumn("x", F.least("o_totalprice", "m"))
    b = F.least(F.floor(F.col("x") / (F.col("m") / 60)).cast("int") + 1, F.lit(60))
    return j.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 4).alias("mean"))


@Q.query("""
    SELECT year, """ + ", ".join(f"round(100 * avg(CAST({c} IS NOT NULL AND {c} <> '' AS INT)), 4) AS {c}" for c in ("contractfolderid", "nomacheteur", "code_departement", "descripteur_code", "type_marche", "source_schema", "cpv_codes_json")) + r"""
    FROM (SELECT *, CAST(regexp_extract(dateparution, '(20[0-9]{2})', 1) AS INT) AS year FROM notices_engineered WHERE regexp_matches(dateparution, '20[0-9]{2}')) GROUP BY 1""")
def coverage_by_year(spark, d):
    names = ("contractfolderid", "nomacheteur", "code_departement", "descripteur_code", "type_marche", "source_schema", "cpv_codes_json")
    n = table(spark, d, "notices_engineered").withColumn("year", F.regexp_extract("dateparution", "(20[0-9]{2})", 1)).where("year <> ''")
    return n.groupBy(F.col("year").cast("int").alias("year")).agg(*[F.round(100 * F.avg((F.col(c).isNotNull() & (F.col(c) != "")).cast("int")), 4).alias(c) for c in names])


@Q.query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(quantile_cont(l_extendedprice, 0.5) FILTER (l_returnflag = 'R'), 4) AS median_r, round(quantile_cont(l_extendedprice, 0.5) FILTER (l_returnflag = 'N'), 4) AS median_n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope FROM lineitem")
def label_score_assoc(spark, d):
    li = table(spark, d, "lineitem")
    by = lambda v: F.round(F.percentile(F.when(F.col("l_returnflag") == v, F.col("l_extendedprice")), F.lit(0.5)), 4)
    return li.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), by("R").alias("median_r"), by("N").alias("median_n"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"))


@Q.query("""
    SELECT r.o_orderkey AS o_orderkey, 'i' || string_agg(reason, ';' ORDER BY k) AS reasons FROM (
      SELECT o_orderkey, 1 AS k, 'large' AS reason FROM orders WHERE o_totalprice > 450000 UNION ALL SELECT o_orderkey, 2, 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 3, 'open' FROM orders WHERE o_orderstatus = 'O') r GROUP BY 1""")
def reason_codes(spark, d):
    o = table(spark, d, "orders")
    why = F.concat_ws(";", F.when(F.col("o_totalprice") > 450000, "large"), F.when(F.col("o_orderpriority") == "1-URGENT", "urgent"), F.when(F.col("o_orderstatus") == "O", "open"))
    return o.select("o_orderkey", why.alias("w")).where("w <> ''").select("o_orderkey", F.concat(F.lit("i"), "w").alias("reasons"))


@Q.query("SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR) || '|7') AS h FROM orders ORDER BY h, o_orderkey LIMIT 100")
def seeded_sample(spark, d):
    h = F.sha2(F.concat(F.col("o_orderkey").cast("string"), F.lit("|7")), 256)
    return table(spark, d, "orders").select("o_orderkey", h.alias("h")).orderBy("h", "o_orderkey").limit(100)


@Q.query("SELECT count(*) AS n, count(DISTINCT candidate_episode_id) AS distinct_candidates, count(*) FILTER (n2 >= 2) AS reused, max(n2) AS most, (SELECT candidate_episode_id FROM candidate_pairs GROUP BY 1 ORDER BY count(DISTINCT anchor_episode_id) DESC, candidate_episode_id LIMIT 1) AS most_reused FROM (SELECT candidate_episode_id, count(DISTINCT anchor_episode_id) AS n2 FROM candidate_pairs GROUP BY 1)")
def reuse_stats(spark, d):
    g = table(spark, d, "candidate_pairs").groupBy("candidate_episode_id").agg(F.count_distinct("anchor_episode_id").alias("k"))
    top = g.groupBy().agg(F.max("k").alias("most"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") >= 2).alias("reused"), F.min(F.struct(-F.col("k"), "candidate_episode_id"))["candidate_episode_id"].alias("most_reused"))
    return top.select("n", F.col("n").alias("distinct_candidates"), "reused", "most", "most_reused")


@Q.query("""
    SELECT n_name, count(*) AS n, count(DISTINCT s_suppkey) AS suppliers, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
    WHERE c_nationkey = s_nationkey AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1""")
def star_join(spark, d):
    li, o, c, s, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    o = o.where((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey")).join(c, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(F.broadcast(n), F.col("n_nationkey") == F.col("s_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s_suppkey").alias("suppliers"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
