"""Queries of the training-data operators over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from ..plans.registry import Registry
from ..runtime import table
from . import bpe, components, leakage, names, spans, topn

Q = Registry()


def queries() -> dict:
    return {name: f for name, (f, _) in Q.registered.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in Q.registered.items() if sql}


@Q.query("""
    SELECT anchor_episode_id, CAST(rank_no AS INT) AS rank_no, candidate_episode_id FROM (
      SELECT *, row_number() OVER (PARTITION BY anchor_episode_id ORDER BY best DESC, candidate_episode_id) AS rank_no FROM (
        SELECT anchor_episode_id, candidate_episode_id, max(text_component) AS best FROM candidate_pairs
        WHERE text_component IS NOT NULL AND NOT isnan(text_component)
          AND anchor_episode_id IS NOT NULL AND candidate_episode_id IS NOT NULL
        GROUP BY 1, 2))
    WHERE rank_no <= 5""")
def p5_found(spark, d):
    pairs = table(spark, d, "candidate_pairs")
    return topn.top_n(pairs, "anchor_episode_id", "candidate_episode_id", "text_component", 5).drop("text_component")


@Q.query(r"""
    WITH RECURSIVE n AS (SELECT idweb, min(idx) AS idx FROM notices WHERE idweb IS NOT NULL AND idx IS NOT NULL GROUP BY 1),
    e AS MATERIALIZED (SELECT DISTINCT l.right_idx AS a, n.idx AS b FROM explicit_links l JOIN n ON n.idweb = regexp_replace(l.target_idweb, '^[\s\p{Z}\x0b\x1c-\x1f\x{85}\x{200b}\x{2060}\x{feff}]+|[\s\p{Z}\x0b\x1c-\x1f\x{85}\x{200b}\x{2060}\x{feff}]+$', '', 'g')
      WHERE l.right_idx <> n.idx AND l.right_idx IN (SELECT idx FROM notices)),
    x AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS v, a AS s FROM x UNION SELECT x.b, r.s FROM r JOIN x ON x.a = r.v WHERE r.s <= x.b)
    SELECT min(s) AS group_idx, v AS idx FROM r GROUP BY v""")
def p1_found(spark, d):
    return components.notice_groups(table(spark, d, "notices"), table(spark, d, "explicit_links"))


@Q.query()
def p7_ids(spark, d):
    return bpe.encode(table(spark, d, "documents"), "doc_id", "text")


@Q.query()
def p8_found(spark, d):
    return leakage.leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage")


@Q.query()
def p8_reparameterised(spark, d):
    return leakage.reparameterised(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage")


_WINDOWS = """
    w AS MATERIALIZED (SELECT doc_id, i, substr(text, CAST(i AS INT), 120) AS s FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 119)) AS i FROM documents WHERE length(text) >= 120)),
    shared AS (SELECT s FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
    found AS (SELECT doc_id, i - 1 AS i FROM w SEMI JOIN shared USING (s))"""


@Q.query(f"WITH {_WINDOWS} SELECT doc_id, CAST(sum(coalesce(least(120, later - i), 120)) AS BIGINT) AS shared_chars FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS later FROM found) GROUP BY 1")
def p9_found(spark, d):
    return spans.shared_chars(table(spark, d, "documents"), "doc_id", "text")


@Q.query(f"""WITH {_WINDOWS}, parts AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 120 THEN 1 ELSE 0 END AS new FROM found))
    SELECT doc_id, CAST(min(i) AS INT) AS "begin", CAST(max(i) + 120 AS INT) AS "end" FROM parts GROUP BY doc_id, part""")
def p9_intervals(spark, d):
    return spans.shared_intervals(table(spark, d, "documents"), "doc_id", "text")


def _typed_names(spark, d):
    confirmed = table(spark, d, "confirmed_links")
    audit = table(spark, d, "review_audit_findings")
    columns = [confirmed.select("anchor_buyer_name"), confirmed.select("candidate_buyer_name"), audit.select("anchor_buyer_name_raw")]
    return columns[0].union(columns[1]).union(columns[2]).toDF("name")


@Q.query()
def p3_found(spark, d):
    return names.same_name_pairs(names.entities(_typed_names(spark, d), "name"))


@Q.query()
def p3_entities(spark, d):
    return names.entities(_typed_names(spark, d), "name")
