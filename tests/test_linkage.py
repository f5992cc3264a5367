"""Candidates and ranks against brute force, with frequent tokens and hot anchors."""

import random
from difflib import SequenceMatcher

import duckdb
from pyspark.sql import functions as F

from tressage import plans
from tressage.operators import linkage


def brute_names(names):
    tokens = {n: {t for t in n.split(" ") if len(t) >= 4 and not t.isdigit()} for n in names if n is not None}
    out = {}
    for a in tokens:
        for b in tokens:
            if a <= b and tokens[a] & tokens[b]:
                overlap = len(tokens[a] & tokens[b]) / len(tokens[a] | tokens[b])
                similar = any(SequenceMatcher(None, x, y).ratio() >= 0.72 for x, y in ((a, b), (b, a)))
                if overlap >= 0.34 or similar:
                    out[a, b] = "same_name" if a == b else "token_overlap" if overlap >= 0.34 else "similarity"
    return out


def test_names_that_share_any_token_against_brute_force(spark):
    r = random.Random(2)
    words = "commune ville lycee syndicat eaux habitat nord ormaie sarvette tresque bru de 2024 x".split()
    names = [" ".join(["commune" if k < 60 else "", *r.choices(words, k=r.randrange(1, 6)), "".join(r.choices("abel", k=7))]).strip() for k in range(120)]
    names += ["commune de bravribechin", "commune de bravribechan", "commune de bravribechin", None, "", "de la 20245"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    want = brute_names(set(names))
    for block in (7, 500):
        got = linkage.token_pairs(df, "name", block=block).collect()
        assert len(got) == len(want) and {(x.a_name, x.b_name): x.kept_by for x in got} == want
    assert set(want.values()) == {"same_name", "token_overlap", "similarity"}


def test_token_candidates_keep_frequent_tokens(spark):
    data = "/root/testdata/sf0.01"
    pairs, members = plans.queries()["token_candidates"](spark, data).collect(), {}
    for x in plans.queries()["token_candidate_members"](spark, data).collect():
        members.setdefault(x.name, []).append(x.episode_id)
    got = {(x.a_name, x.b_name) for x in pairs}
    assert got == set(brute_names(members)) and sum(map(len, members.values())) == 626
    found = {e for x in pairs for n in (x.a_name, x.b_name) for e in members[n] if len(members[n]) > 1 or x.a_name != x.b_name}
    assert len(found) == 625  # one episode's name has no partner
    overlaps = {(x.a_name, x.b_name) for x in plans.queries()["token_blocking_pairs"](spark, data).collect()}
    assert overlaps == {(x.a_name, x.b_name) for x in pairs if x.overlap >= linkage.TOKEN_OVERLAP and x.a_name != x.b_name}


def test_every_row_is_ranked_and_a_hot_group_is_split(spark):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.7 else r.choice(["a", "b", None]), r.choice([None, 0.5, r.random()]), k) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, s double, i int")
    got = {(x.g, x.i): x.rank_no for x in linkage.ranked(df, "g", [F.desc_nulls_last("s"), F.col("i")]).collect()}
    want, seen = {}, {}
    for g, s, i in sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[2])):
        want[g, i] = seen[g] = seen.get(g, 0) + 1
    assert got == want and len(got) == len(rows)


def test_ranks_of_every_candidate_equal_sql(spark, data):
    duck = duckdb.connect()
    for t in ("candidate_pairs", "orders"):
        duck.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    for name in ("candidate_rank_all", "candidate_rank_by_gap_all"):
        got, rel = plans.queries()[name](spark, data), duck.sql(plans.oracle_sql()[name])
        assert sorted(map(str, map(tuple, got.select(*rel.columns).collect()))) == sorted(map(str, rel.fetchall()))
