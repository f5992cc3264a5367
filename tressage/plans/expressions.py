"""Scalar expressions over whole columns, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, text
from ..runtime import table
from .registry import Registry

Q = Registry()

_BUYERS = "(SELECT DISTINCT nomacheteur AS name FROM notices_engineered WHERE nomacheteur IS NOT NULL)"
_TEXT_KEY = "trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"
_GENERIC = r"\b(commune de|ville de|mairie de|departement de|departement|region|conseil regional|conseil departemental)\b"


def _buyers(spark, d):
    return table(spark, d, "notices_engineered").select(F.col("nomacheteur").alias("name")).where("name is not null").distinct()


@Q.query(rf"SELECT name, trim(regexp_replace(lower(name), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS key FROM {_BUYERS}")
def name_keys(spark, d):
    return _buyers(spark, d).select("name", text.name_key(F.col("name")).alias("key"))


@Q.query(f"SELECT name, {_TEXT_KEY.format(x='name')} AS key FROM {_BUYERS}")
def normalize_text(spark, d):
    return _buyers(spark, d).select("name", text.text_key(F.col("name")).alias("key"))


@Q.query(rf"SELECT name, trim(regexp_replace(regexp_replace({_TEXT_KEY.format(x='name')}, '{_GENERIC}', ' ', 'g'), ' +', ' ', 'g')) AS key FROM {_BUYERS}")
def blocking_name(spark, d):
    return _buyers(spark, d).select("name", text.blocking_key(F.col("name")).alias("key"))


@Q.query(r"""
    SELECT idweb, CASE WHEN length(k) < 3 OR regexp_matches(k, '^(sans objet|neant|n/?a|non renseigne|aucun|fra|dce|voir( dce)?|cf\.?|org\s*[0-9]+|tpo\s*[0-9]+|default[_ ]value[_ ]change[_ ]me|documents?( de| du)? march[eé]|https?\b.*|www\b.*)$', 'i') THEN '' ELSE k END AS reference_key
    FROM (SELECT DISTINCT idweb, trim(regexp_replace(lower(procedure_reference), '[^\p{L}\p{N}_]+', ' ', 'g')) AS k FROM notices)""")
def reference_keys(spark, d):
    n = table(spark, d, "notices").select("idweb", "procedure_reference").distinct()
    return n.select("idweb", text.reference_key(F.col("procedure_reference")).alias("reference_key")).distinct()


@Q.query(f"""
    SELECT anchor_episode_id, candidate_episode_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) END AS jaccard FROM (
      SELECT DISTINCT anchor_episode_id, candidate_episode_id,
        list_distinct(list_filter(string_split({_TEXT_KEY.format(x='anchor_buyer_name')}, ' '), lambda t: length(t) >= 4 AND NOT regexp_matches(t, '^[0-9]+$'))) AS a,
        list_distinct(list_filter(string_split({_TEXT_KEY.format(x='candidate_buyer_name')}, ' '), lambda t: length(t) >= 4 AND NOT regexp_matches(t, '^[0-9]+$'))) AS b
      FROM candidate_pairs WHERE anchor_buyer_name IS NOT NULL AND candidate_buyer_name IS NOT NULL)""")
def token_jaccard(spark, d):
    p = table(spark, d, "candidate_pairs").where("anchor_buyer_name is not null and candidate_buyer_name is not null")
    tokens = lambda c: text.name_tokens(text.text_key(F.col(c)))
    p = p.select("anchor_episode_id", "candidate_episode_id", tokens("anchor_buyer_name").alias("a"), tokens("candidate_buyer_name").alias("b")).distinct()
    return p.select("anchor_episode_id", "candidate_episode_id", F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@Q.query(r"""
    SELECT DISTINCT idweb, list_sort(list_distinct(regexp_extract_all(cpv_codes_json, '\b([0-9]{8})\b', 1))) AS codes
    FROM notices_engineered WHERE cpv_codes_json IS NOT NULL""")
def extract_codes(spark, d):
    n = table(spark, d, "notices_engineered").where("cpv_codes_json is not null")
    return n.select("idweb", F.sort_array(text.codes(F.col("cpv_codes_json"))).alias("codes")).distinct()


@Q.query(r"""
    WITH c AS (SELECT DISTINCT idweb, list_distinct(regexp_extract_all(cpv_codes_json, '\b([0-9]{8})\b', 1)) AS codes FROM notices_engineered WHERE cpv_codes_json IS NOT NULL)
    SELECT DISTINCT idweb, list_sort(list_distinct(list_transform(codes, lambda x: x[1:2]))) AS divisions, list_sort(list_distinct(list_transform(codes, lambda x: x[1:3]))) AS groups,
      list_sort(list_distinct(list_transform(codes, lambda x: x[1:4]))) AS classes, list_sort(list_distinct(list_transform(codes, lambda x: x[1:5]))) AS categories,
      list_has_any(list_transform(codes, lambda x: x[1:2]), ['32','35','48','72']) AS in_scope FROM c""")
def cpv_prefix_sets(spark, d):
    n = table(spark, d, "notices_engineered").where("cpv_codes_json is not null").select("idweb", text.codes(F.col("cpv_codes_json")).alias("c"))
    cut = [text.prefixes(F.col("c"), k).alias(a) for k, a in ((2, "divisions"), (3, "groups"), (4, "classes"), (5, "categories"))]
    scope = F.arrays_overlap(F.transform("c", lambda v: F.substring(v, 1, 2)), F.array(*map(F.lit, ("32", "35", "48", "72"))))
    return n.select("idweb", *cut, scope.alias("in_scope")).distinct()


@Q.query(r"SELECT right_idx, list_distinct(regexp_extract_all(target_idweb, '\b([0-9]{2}-[0-9]+)\b', 1)) AS ids FROM (SELECT DISTINCT right_idx, target_idweb FROM explicit_links WHERE target_idweb IS NOT NULL)")
def linked_notice_ids(spark, d):
    n = table(spark, d, "explicit_links").where("target_idweb is not null").select("right_idx", "target_idweb").distinct()
    return n.select("right_idx", text.notice_ids(F.col("target_idweb")).alias("ids"))


@Q.query("""
    WITH x AS (SELECT DISTINCT idweb, regexp_replace(buyer_key, '[^0-9]', '', 'g') AS d FROM notices WHERE buyer_key <> ''),
    s AS (SELECT idweb, d, length(d) IN (9, 14) AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (CASE WHEN CAST(substr(reverse(d), CAST(i AS INT), 1) AS INT) * 2 > 9 THEN CAST(substr(reverse(d), CAST(i AS INT), 1) AS INT) * 2 - 9 ELSE CAST(substr(reverse(d), CAST(i AS INT), 1) AS INT) * 2 END) ELSE CAST(substr(reverse(d), CAST(i AS INT), 1) AS INT) END)) % 10 = 0 AS ok FROM x WHERE d <> '')
    SELECT idweb, CASE WHEN ok AND length(d) = 14 THEN d ELSE '' END AS siret, CASE WHEN ok THEN d[1:9] ELSE '' END AS siren, CASE WHEN ok AND length(d) = 14 THEN 'siret' WHEN ok THEN 'siren' ELSE '' END AS kind FROM s""")
def luhn_ids(spark, d):
    n = table(spark, d, "notices").where("buyer_key <> ''").select("idweb", "buyer_key").distinct()
    n = n.withColumn("d", text.digits(F.col("buyer_key"))).where("d <> ''")
    return n.select("idweb", text.buyer_identifier(F.col("d")).alias("i")).select("idweb", "i.siret", "i.siren", "i.kind").distinct()


@Q.query("""
    SELECT postcode, CASE WHEN NOT regexp_matches(postcode, '^[0-9]{5}$') THEN '' WHEN postcode[1:3] IN ('971','972','973','974','976') THEN postcode[1:3] WHEN postcode[1:2] = '20' THEN '2A/2B' ELSE postcode[1:2] END AS department
    FROM (SELECT DISTINCT regexp_extract(donnees, '"(cp|CP|codePostal|cbc:PostalZone)": ?"?([0-9]+)', 2) AS postcode FROM notices_engineered WHERE donnees IS NOT NULL)""")
def postcode_departments(spark, d):
    p = table(spark, d, "notices_engineered").where("donnees is not null").select(F.regexp_extract("donnees", '"(cp|CP|codePostal|cbc:PostalZone)": ?"?([0-9]+)', 2).alias("postcode")).distinct()
    return p.select("postcode", text.postcode_department(F.col("postcode")).alias("department"))


@Q.query("""
    SELECT cell, CASE WHEN t IN ('2A', '2B') THEN t WHEN run = '' THEN '' WHEN CAST(run AS INT) < 100 THEN lpad(CAST(CAST(run AS INT) AS VARCHAR), 2, '0') ELSE CAST(CAST(run AS INT) AS VARCHAR) END AS department
    FROM (SELECT cell, upper(regexp_replace(trim(cell), '["'']', '', 'g')) AS t, regexp_extract(upper(regexp_replace(trim(cell), '["'']', '', 'g')), '([0-9]+)', 1) AS run FROM (SELECT DISTINCT code_departement AS cell FROM notices_engineered WHERE code_departement IS NOT NULL))""")
def department_codes(spark, d):
    p = table(spark, d, "notices_engineered").where("code_departement is not null").select(F.col("code_departement").alias("cell")).distinct()
    return p.select("cell", text.department_code(F.col("cell")).alias("department"))


@Q.query(r"""
    SELECT doc_id, TRY_CAST(nullif(replace(regexp_replace(m, '[ \x{A0}\s]', '', 'g'), ',', '.'), '') AS DOUBLE) AS amount
    FROM (SELECT doc_id, regexp_extract(text, '-?[0-9]+(?:[ \x{A0}\t\n\r][0-9]{3})*(?:[.,][0-9]+)?') AS m FROM documents WHERE text IS NOT NULL)""")
def numerals(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", text.numeral(F.col("text")).alias("amount"))


@Q.query(r"""
    SELECT name, CASE WHEN a AND b THEN 'mixed_label' WHEN a THEN 'municipal' WHEN b THEN 'intercommunal' ELSE 'other' END AS family
    FROM (SELECT name, regexp_matches(name, '\b(commune|ville|mairie)\b', 'i') AS a, regexp_matches(' ' || name || ' ', '[^\p{L}](metropole|métropole|communaute|communauté|agglomeration|agglomération|epci)[^\p{L}]', 'i') AS b
          FROM (SELECT DISTINCT anchor_buyer_name AS name FROM candidate_pairs WHERE anchor_buyer_name IS NOT NULL))""")
def legal_family(spark, d):
    n = table(spark, d, "candidate_pairs").where("anchor_buyer_name is not null").select(F.col("anchor_buyer_name").alias("name")).distinct()
    return n.select("name", text.legal_family(F.col("name")).alias("family"))


_WORDS = ["logiciel", "serveurs", "reseau", "fibre optique", "video", "telephonie", "messagerie", "billettique", "plateforme de dematerialisation", "tablettes"]


@Q.query(f"""
    SELECT idx, list_sort(list_filter([{', '.join(f"CASE WHEN contains(k, ' {w} ') THEN '{w}' END" for w in _WORDS)}], lambda x: x IS NOT NULL)) AS hits
    FROM (SELECT DISTINCT idx, ' ' || {_TEXT_KEY.format(x='objet')} || ' ' AS k FROM notices_engineered WHERE objet IS NOT NULL)""")
def keyword_hits(spark, d):
    n = table(spark, d, "notices_engineered").where("objet is not null").select("idx", text.text_key(F.col("objet")).alias("k")).distinct()
    return n.select("idx", text.keyword_hits(F.col("k"), _WORDS).alias("hits"))


@Q.query(r"""
    SELECT doc_id, CAST(length(text) AS INT) AS chars, CASE WHEN flat = '' THEN 0 ELSE CAST(len(string_split(flat, ' ')) AS INT) END AS words, sha256(text) AS digest
    FROM (SELECT *, regexp_replace(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'), '^ | $', '', 'g') AS flat FROM documents WHERE text IS NOT NULL)""")
def text_lengths(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    flat = F.regexp_replace(F.regexp_replace("text", "[ \\t\\n\\r]+", " "), "^ | $", "")
    return t.select("doc_id", F.length("text").alias("chars"), F.when(flat == "", 0).otherwise(F.size(F.split(flat, " "))).alias("words"), F.sha2("text", 256).alias("digest"))


@Q.query(r"""
    SELECT DISTINCT idweb, dateparution, TRY_CAST(replace(nullif(regexp_extract(dateparution, '(20[0-9]{2}[-/][0-9]{2}[-/][0-9]{2})', 1), ''), '/', '-') AS DATE) AS published FROM notices_engineered""")
def parse_dates(spark, d):
    n = table(spark, d, "notices_engineered")
    return n.select("idweb", "dateparution", scores.parsed_date(F.col("dateparution")).alias("published")).distinct()


@Q.query("""
    SELECT DISTINCT idx, CAST(published >= DATE '2019-01-01' AND published < DATE '2023-01-01' AS BOOLEAN) IS NOT TRUE AS outside_study,
      coalesce(CAST(datelimitereponse AS DATE) < published, false) AS deadline_before_publication, CAST(date_diff('day', published, CAST(datelimitereponse AS DATE)) AS INT) AS days_open,
      year(published)::INT AS year, quarter(published)::INT AS quarter, strftime(published, '%Y-%m') AS month
    FROM (SELECT *, TRY_CAST(replace(nullif(regexp_extract(dateparution, '(20[0-9]{2}[-/][0-9]{2}[-/][0-9]{2})', 1), ''), '/', '-') AS DATE) AS published FROM notices_engineered)""")
def chronology_flags(spark, d):
    n = table(spark, d, "notices_engineered").withColumn("p", scores.parsed_date(F.col("dateparution"))).withColumn("e", F.to_date("datelimitereponse"))
    return n.select(
        "idx", F.coalesce(~((F.col("p") >= F.lit("2019-01-01").cast("date")) & (F.col("p") < F.lit("2023-01-01").cast("date"))), F.lit(True)).alias("outside_study"),
        F.coalesce(F.col("e") < F.col("p"), F.lit(False)).alias("deadline_before_publication"), F.datediff("e", "p").alias("days_open"),
        F.year("p").alias("year"), F.quarter("p").alias("quarter"), F.date_format("p", "yyyy-MM").alias("month")).distinct()


@Q.query("""
    SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'lt1k' WHEN o_totalprice < 100000 THEN 'lt100k' WHEN o_totalprice < 250000 THEN 'lt250k' ELSE 'ge250k' END AS bracket, round(ln(1 + o_totalprice), 6) AS log_amount, o_totalprice > 400000 AS aberrant FROM orders""")
def amount_brackets(spark, d):
    a = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.when(a < 1000, "lt1k").when(a < 100000, "lt100k").when(a < 250000, "lt250k").otherwise("ge250k").alias("bracket"), F.round(F.log1p(a), 6).alias("log_amount"), (a > 400000).alias("aberrant"))


_LEVEL = "CASE WHEN {c} IS NULL OR isnan({c}) THEN 'missing' {w} ELSE '{l}' END"


def _level_sql(col, levels):
    edges, names = levels
    return _LEVEL.format(c=col, w=" ".join(f"WHEN {col} < {e} THEN '{n}'" for e, n in zip(edges, names)), l=names[-1])


@Q.query(f"""
    SELECT 'buyer_' || buyer_match_type AS buyer, {_level_sql('text_component', scores.TEXT_LEVELS)} AS text, {_level_sql('cpv_component', scores.CPV_LEVELS)} AS cpv, {_level_sql('time_component', scores.TIME_LEVELS)} AS time, count(*) AS n
    FROM candidate_pairs GROUP BY ALL""")
def bin_levels(spark, d):
    p = table(spark, d, "candidate_pairs")
    return p.groupBy(
        F.concat(F.lit("buyer_"), "buyer_match_type").alias("buyer"), scores.level(F.col("text_component"), *scores.TEXT_LEVELS).alias("text"),
        scores.level(F.col("cpv_component"), *scores.CPV_LEVELS).alias("cpv"), scores.level(F.col("time_component"), *scores.TIME_LEVELS).alias("time")).count().withColumnRenamed("count", "n")


_PARTS = {"buyer": "buyer_component", "text": "text_component", "cpv": "cpv_component", "time": "time_component"}


@Q.query("""
    WITH v AS (SELECT *, CASE WHEN isnan(buyer_component) THEN NULL ELSE buyer_component END AS b, CASE WHEN isnan(text_component) THEN NULL ELSE text_component END AS t, CASE WHEN isnan(cpv_component) THEN NULL ELSE cpv_component END AS c, CASE WHEN isnan(time_component) THEN NULL ELSE time_component END AS m FROM candidate_pairs)
    SELECT anchor_episode_id, candidate_episode_id, linkage_score AS given,
      round(100.0 * (coalesce(0.5 * least(greatest(b, 0.0), 1.0), 0.0) + coalesce(0.25 * least(greatest(t, 0.0), 1.0), 0.0) + coalesce(0.2 * least(greatest(c, 0.0), 1.0), 0.0) + coalesce(0.05 * least(greatest(m, 0.0), 1.0), 0.0))
        / nullif(CASE WHEN b IS NULL THEN 0.0 ELSE 0.5 END + CASE WHEN t IS NULL THEN 0.0 ELSE 0.25 END + CASE WHEN c IS NULL THEN 0.0 ELSE 0.2 END + CASE WHEN m IS NULL THEN 0.0 ELSE 0.05 END, 0.0), 6) AS score,
      CAST((b IS NOT NULL)::INT + (t IS NOT NULL)::INT + (c IS NOT NULL)::INT + (m IS NOT NULL)::INT AS INT) AS parts
    FROM v""")
def weighted_score(spark, d):
    p = table(spark, d, "candidate_pairs")
    parts = {k: F.col(v) for k, v in _PARTS.items()}
    return p.select("anchor_episode_id", "candidate_episode_id", F.col("linkage_score").alias("given"), F.round(scores.weighted_score(parts), 6).alias("score"), scores.completeness(*parts.values()).alias("parts"))


@Q.query("""
    SELECT o_orderkey, CASE WHEN q > 0 THEN round(greatest(0.0, 1.0 - abs(g - q * 30.4375) / 365.0), 6) END AS plausibility
    FROM (SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(max(l_shipdate) AS DATE)) AS INT) AS g, CASE WHEN sum(l_quantity) > 200 THEN NULL ELSE sum(l_quantity) / 40 END AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate)""")
def time_plausibility(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"))
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.to_date("l_shipdate")).alias("b"), F.sum("l_quantity").alias("q"))
    j = o.join(li, "o_orderkey").withColumn("months", F.when(F.col("q") <= 200, F.col("q") / 40))
    return j.select("o_orderkey", F.round(scores.time_plausibility(F.datediff("b", "a"), F.col("months")), 6).alias("plausibility"))


@Q.query(r"""
    WITH c AS (SELECT idx, idweb, list_distinct(regexp_extract_all(max(cpv_codes_json), '\b([0-9]{8})\b', 1)) AS codes FROM notices_engineered WHERE cpv_codes_json IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT DISTINCT a.idx AS a_idx, b.idx AS b_idx, list_distinct(list_transform(a.codes, lambda x: x[1:3])) AS a3, list_distinct(list_transform(b.codes, lambda x: x[1:3])) AS b3, list_distinct(list_transform(a.codes, lambda x: x[1:2])) AS a2, list_distinct(list_transform(b.codes, lambda x: x[1:2])) AS b2
          FROM explicit_links JOIN c a ON a.idx = right_idx JOIN c b ON b.idweb = regexp_replace(target_idweb, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g'))
    SELECT DISTINCT a_idx, b_idx, CASE WHEN len(a3) > 0 AND len(b3) > 0 THEN round(greatest(len(list_intersect(a3, b3)) / len(list_distinct(list_concat(a3, b3)))::DOUBLE, 0.5 * len(list_intersect(a2, b2)) / len(list_distinct(list_concat(a2, b2)))::DOUBLE), 6) END AS continuity FROM p""")
def category_continuity(spark, d):
    c = table(spark, d, "notices_engineered").where("cpv_codes_json is not null").groupBy("idx", "idweb").agg(text.codes(F.max("cpv_codes_json")).alias("c"))
    links = table(spark, d, "explicit_links").select(F.col("right_idx").alias("a_idx"), text.trimmed(F.col("target_idweb")).alias("idweb")).distinct()
    a, b = c.select(F.col("idx").alias("a_idx"), F.col("c").alias("a")), c.select(F.col("idx").alias("b_idx"), "idweb", F.col("c").alias("b"))
    return links.join(a, "a_idx").join(b, "idweb").select("a_idx", "b_idx", F.round(scores.category_continuity(F.col("a"), F.col("b")), 6).alias("continuity")).distinct()


@Q.query("""
    SELECT buyer_match_type, n, k, CASE WHEN n > 0 THEN round(least(greatest((p + z * z / (2.0 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 0.0), 1.0), 4) END AS low, CASE WHEN n > 0 THEN round(least(greatest((p + z * z / (2.0 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 0.0), 1.0), 4) END AS high
    FROM (SELECT buyer_match_type, count(*) AS n, count(*) FILTER (candidate_is_digital) AS k, (count(*) FILTER (candidate_is_digital))::DOUBLE / count(*) AS p, 1.959963985::DOUBLE AS z FROM candidate_pairs GROUP BY 1)""")
def wilson_ci(spark, d):
    g = table(spark, d, "candidate_pairs").groupBy("buyer_match_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("candidate_is_digital").alias("k"))
    return g.select("buyer_match_type", "n", "k", scores.wilson(F.col("k"), F.col("n"), False).alias("low"), scores.wilson(F.col("k"), F.col("n"), True).alias("high"))


@Q.query("""
    SELECT o_orderkey, CAST(o_orderdate + to_microseconds(CAST(round((o_orderkey % 37 + 1) / 2.0 * 30.4375 * 86400000000) AS BIGINT)) AS TIMESTAMP) AS expected_end FROM orders""")
def expected_end(spark, d):
    o = table(spark, d, "orders")
    moved = scores.plus_months(F.col("o_orderdate").cast("timestamp"), (F.col("o_orderkey") % 37 + 1) / 2.0)
    return o.select("o_orderkey", moved.cast("timestamp_ntz").alias("expected_end"))


@Q.query("""
    SELECT anchor_episode_id, candidate_episode_id, round(CASE WHEN w >= 0 THEN 1 / (1 + exp(-w * 0.6931471805599453)) ELSE exp(w * 0.6931471805599453) / (1 + exp(w * 0.6931471805599453)) END, 9) AS probability
    FROM (SELECT anchor_episode_id, candidate_episode_id, (linkage_score - 50) * 3 AS w FROM candidate_pairs WHERE linkage_score IS NOT NULL AND NOT isnan(linkage_score))""")
def match_probability(spark, d):
    p = table(spark, d, "candidate_pairs").where("linkage_score is not null and not isnan(linkage_score)")
    return p.select("anchor_episode_id", "candidate_episode_id", F.round(scores.logistic_bits((F.col("linkage_score") - 50) * 3), 9).alias("probability"))


@Q.query("""
    SELECT n_region, count(*) AS n FROM (SELECT CASE m[1] WHEN '14' THEN 'Normandie' WHEN '22' THEN 'Bretagne' WHEN '27' THEN 'Normandie' WHEN '29' THEN 'Bretagne' WHEN '35' THEN 'Bretagne' WHEN '44' THEN 'Pays de la Loire' WHEN '49' THEN 'Pays de la Loire' WHEN '50' THEN 'Normandie' WHEN '53' THEN 'Pays de la Loire' WHEN '56' THEN 'Bretagne' WHEN '61' THEN 'Normandie' WHEN '72' THEN 'Pays de la Loire' WHEN '76' THEN 'Normandie' WHEN '85' THEN 'Pays de la Loire' END AS n_region
      FROM (SELECT list_filter(regexp_extract_all(code_departement, '[0-9][0-9AB]+'), lambda x: x IN ('14','22','27','29','35','44','49','50','53','56','61','72','76','85')) AS m FROM notices_engineered)) WHERE n_region IS NOT NULL GROUP BY 1""")
def region_filter(spark, d):
    regions = {"14": "Normandie", "22": "Bretagne", "27": "Normandie", "29": "Bretagne", "35": "Bretagne", "44": "Pays de la Loire", "49": "Pays de la Loire", "50": "Normandie", "53": "Pays de la Loire", "56": "Bretagne", "61": "Normandie", "72": "Pays de la Loire", "76": "Normandie", "85": "Pays de la Loire"}
    lookup = F.create_map(*[F.lit(x) for kv in regions.items() for x in kv])
    found = F.filter(F.regexp_extract_all("code_departement", F.lit("([0-9][0-9AB]+)"), F.lit(1)), lambda x: x.isin(*regions))
    return table(spark, d, "notices_engineered").select(lookup[F.get(found, F.lit(0))].alias("n_region")).where("n_region is not null").groupBy("n_region").agg(F.count(F.lit(1)).alias("n"))


@Q.query("""
    SELECT column_name, blank, round(blank / total::DOUBLE, 6) AS rate FROM (
      UNPIVOT (SELECT count(*) AS total, """ + ", ".join(f"count(*) FILTER ({c} IS NULL OR lower(trim({c})) IN ('','none','null','nan','<na>','[]','{{}}')) AS {c}" for c in ("idweb", "contractfolderid", "objet", "famille", "nature", "nomacheteur", "code_departement", "descripteur_code", "type_marche", "source_schema", "donnees")) + """ FROM notices_engineered)
      ON COLUMNS(* EXCLUDE total) INTO NAME column_name VALUE blank)""")
def missingness_profile(spark, d):
    names = ("idweb", "contractfolderid", "objet", "famille", "nature", "nomacheteur", "code_departement", "descripteur_code", "type_marche", "source_schema", "donnees")
    one = table(spark, d, "notices_engineered").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(text.is_blank(F.col(c))).alias(c) for c in names])
    return one.unpivot("total", list(names), "column_name", "blank").select("column_name", "blank", F.round(F.col("blank") / F.col("total"), 6).alias("rate"))
