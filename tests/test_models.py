import math
import random

import numpy as np
import pytest

from tressage.functions import special
from tressage.operators import episodes, linkage, survival, trend
from tressage.runtime import Scratch


def test_tails():
    assert abs(special.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(special.chi2_sf(9.487729036781154, 4) - 0.05) < 1e-9
    assert abs(special.t_sf2(2.2281388519649385, 10) - 0.05) < 1e-9
    assert abs(special.normal_sf2(1.959963984540054) - 0.05) < 1e-12
    low, high = special.clopper_pearson(14, 20)
    assert abs(low - 0.4572) < 1e-4 and abs(high - 0.8811) < 1e-4
    assert special.clopper_pearson(0, 0) is None and special.clopper_pearson(0, 5)[0] == 0.0


@pytest.fixture(scope="module")
def lives(spark):
    r = random.Random(5)
    rows = []
    for i in range(400):
        x = i % 2
        t = max(0.1, round(r.expovariate(0.1 * math.exp(0.7 * x)), 1))
        c = round(r.uniform(1, 20), 1)
        rows.append((i, "b" if x else "a", float(min(t, c)), int(t <= c), x))
    return rows, spark.createDataFrame(rows, "id long, g string, t double, event int, x int")


def test_kaplan_meier_matches_the_definition(lives):
    rows, df = lives
    s, want = 1.0, {}
    for t in sorted({r[2] for r in rows}):
        y, d = sum(r[2] >= t for r in rows), sum(r[2] == t and r[3] for r in rows)
        s *= 1 - d / y
        want[t] = s
    got = {r.t: r.survival for r in survival.life_table(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)


def test_curve_reaches_zero_when_all_fail(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (None, 1), (3.0, None)], "t double, event int")
    got = {r.t: r.survival for r in survival.life_table(df).collect()}
    assert abs(got[1.0] - 0.5) < 1e-12 and got[2.0] == 0.0
    at = {r.months: r.survival for r in survival.survival_at(survival.life_table(df), [0.5, 1.5, 9]).collect()}
    assert at[0.5] == 1.0 and abs(at[1.5] - 0.5) < 1e-12 and at[9.0] == 0.0
    assert survival.life_table(df.limit(0)).count() == 0


def test_cox_recovers_a_planted_effect_and_its_score_is_zero(lives):
    rows, df = lives
    fit = survival.cox(df, ["x"])
    b = fit["beta"]["x"]
    assert 0.4 < b < 1.0
    eps = 1e-4

    def ll(beta):  # Efron by the definition
        out = 0.0
        for t in sorted({r[2] for r in rows if r[3]}):
            dead = [r for r in rows if r[2] == t and r[3]]
            risk = sum(math.exp(beta * r[4]) for r in rows if r[2] >= t)
            own = sum(math.exp(beta * r[4]) for r in dead)
            out += sum(beta * r[4] for r in dead) - sum(math.log(risk - k / len(dead) * own) for k in range(len(dead)))
        return out

    assert abs(ll(b + eps) - ll(b - eps)) / (2 * eps) < 1e-3
    assert survival.logrank(df, "g")["p"] < 0.01


def test_cox_by_sums_in_spark_equals_the_one_on_the_driver(spark, monkeypatch):
    r = random.Random(4)
    rows = [(float(r.randrange(1, 30)), int(r.random() < 0.6), r.randrange(3), r.random() < 0.5) for _ in range(500)] + [(None, 1, 1, True), (2.0, None, 1, True)]
    df = spark.createDataFrame([(t, e, a, int(b)) for t, e, a, b in rows], "t double, event int, a int, b int")
    here = survival.cox(df, ["a", "b"])
    monkeypatch.setattr(survival, "MOST_PATTERNS", 3)
    there = survival.cox(df, ["a", "b"])
    assert there["beta"] == pytest.approx(here["beta"], abs=1e-8) and there["loglik"] == pytest.approx(here["loglik"])
    assert [x["se"] for x in there["rows"]] == pytest.approx([x["se"] for x in here["rows"]])
    with pytest.raises(ValueError):
        survival.ph_test(survival.patterns(df, ["a", "b"]), ["a", "b"], here["beta"])


def test_ph_test_against_its_definition(lives):
    rows, df = lives
    b = survival.cox(df, ["x"])["beta"]["x"]
    res = []
    for t in sorted({r[2] for r in rows if r[3]}):
        risk = [r for r in rows if r[2] >= t]
        mean = sum(r[4] * math.exp(b * r[4]) for r in risk) / sum(math.exp(b * r[4]) for r in risk)
        res += [(t, r[4] - mean) for r in rows if r[2] == t and r[3]]
    rank = np.arange(1, len(res) + 1) - (len(res) + 1) / 2
    times = np.array([t for t, _ in res])
    rank = np.array([rank[times == t].mean() for t in times])
    got = survival.ph_test(survival.patterns(df, ["x"]), ["x"], {"x": b})[0]
    rho = np.corrcoef(rank, [v for _, v in res])[0, 1]
    assert got["rho"] == pytest.approx(rho, abs=0.02) and got["p"] == pytest.approx(special.chi2_sf(got["rho"] ** 2 * len(res), 1))


def test_running_sums_and_curves_go_by_ranges(spark):
    from tressage.runtime import ranged, running
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(float(i % 37), i) for i in range(200)], "k double, i int").groupBy("k").agg(F.sum("i").alias("v"))
    r = ranged(df, [F.asc("k")], Scratch(spark, "t"))
    assert r.select("_range").distinct().count() > 1
    v = {x.k: x.v for x in df.collect()}
    got = {x.k: (x.up, x.down) for x in running(running(r, [F.asc("k")], {"up": F.col("v")}), [F.desc("k")], {"down": F.col("v")}, reverse=True).collect()}
    assert got == {k: (sum(b for a, b in v.items() if a <= k), sum(b for a, b in v.items() if a >= k)) for k in v}
    scored = spark.createDataFrame([(round(i / 7 % 1, 3), int(i % 3 == 0)) for i in range(90)], "s double, y int")
    c = linkage.auc_ap(linkage.curve(scored, "y", "s")).first()
    rows = [(x.s, x.y) for x in scored.collect()]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert c.roc_auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg), abs=1e-6)
    with pytest.raises(ValueError):
        linkage.curve(scored.where("y = 1"), "y", "s")


def test_last_step_before_an_age(spark):
    curve = spark.createDataFrame([("a", 1.0, 0.9), ("a", 3.0, 0.5), ("b", 2.0, 0.1)], "g string, t double, survival double")
    rows = spark.createDataFrame([(1, "a", 0.5), (2, "a", 1.0), (3, "a", 2.5), (4, "b", 9.0), (5, "c", 1.0), (6, "a", 2.5), (7, "a", None)], "id int, g string, age double")
    got = {r.id: (r.s0, r.s1) for r in survival.asof_steps(rows, curve, ["g"], "age", [0.0, 0.5]).collect()}
    assert got == {1: (1.0, 0.9), 2: (0.9, 0.9), 3: (0.9, 0.5), 4: (0.1, 0.1), 5: (1.0, 1.0), 6: (0.9, 0.5)}


def test_parametric_families_nest(lives):
    fits = {f["family"]: f["loglik"] for f in survival.parametric_fits(lives[1])}
    assert fits["weibull"] >= fits["exponential"] - 1e-6
    assert fits["generalized_gamma"] >= max(fits["weibull"], fits["lognormal"]) - 0.05


def test_concordance_by_brute_force(lives):
    rows, df = lives
    c = d = tie = 0
    for a in rows:
        for b in rows:
            if a[3] and (b[2] > a[2] or (b[2] == a[2] and not b[3])):
                c += a[4] > b[4]
                d += a[4] < b[4]
                tie += a[4] == b[4]
    r = survival.concordance(df.selectExpr("t", "event", "x as risk")).first()
    assert (r.concordant, r.discordant, r.tied) == (c, d, tie)
    many = [(t, e, round(math.sin(i * 7.3), 2)) for i, _, t, e, _ in rows] + [(None, 1, 0.5)]
    got = survival.concordance(df.sparkSession.createDataFrame(many, "t double, event int, risk double")).first()
    c = d = tie = 0
    for t, e, x in many[:-1]:
        for u, f, y in many[:-1]:
            if e and (u > t or (u == t and not f)):
                c, d, tie = c + (x > y), d + (x < y), tie + (x == y)
    assert (got.concordant, got.discordant, got.tied) == (c, d, tie)
    assert survival.concordance(df.limit(0).selectExpr("t", "event", "x as risk")).first().c_index is None


def test_breaks_and_regimes():
    values = [10.0] * 12 + [30.0] * 12
    assert trend.break_points(values) == [12] and trend.stable_breaks(values) == [12]
    assert trend.break_points([5.0] * 20) == [] and trend.break_points([1, 2, 3]) == []
    r = random.Random(1)
    noise = [r.gauss(0, 1) for _ in range(60)]
    assert trend.unit_root(noise)["adf_rejects"] and not trend.unit_root(list(np.cumsum([1 + x for x in noise])))["adf_rejects"]
    assert trend.unit_root([1.0] * 20) is None and trend.regimes([1.0] * 20) is None
    steps = [m + r.gauss(0, 1) for m in [8] * 10 + [0] * 10 + [-8] * 10 + [8] * 10]
    g = trend.regimes([float(x) for x in np.cumsum(steps)])
    assert g["regime"] == "growth" and g["means"] == sorted(g["means"])


def test_break_points_are_optimal():
    r = random.Random(3)
    for _ in range(20):
        x = [r.gauss(0, 1) + (3 if i > 11 else 0) for i in range(24)]
        z = (np.array(x) - np.mean(x)) / np.std(x)
        pen = math.log(24)
        best = {0: (0.0, [])}
        for j in range(4, 25):
            options = [(best[i][0] + float(((z[i:j] - z[i:j].mean()) ** 2).sum()) + pen, best[i][1] + ([i] if i else [])) for i in best if j - i >= 4]
            best[j] = min(options)
        assert trend.break_points(x) == best[24][1]


def test_replay_and_constrained_components(spark):
    r = random.Random(9)
    n = 60
    ids = {v: r.choice(["", "", "A", "B"]) for v in range(n)}
    edges = [(r.randrange(n), r.randrange(n), r.randrange(1, 4)) for _ in range(70)]
    edges = sorted({e for e in edges if e[0] != e[1]}, key=lambda e: (e[2], "", e[0], e[1]))
    want, log = episodes.replay(list(range(n)), ids, edges)
    df = spark.createDataFrame([(*e, "") for e in edges], "left_id long, right_id long, priority int, evidence string")
    trusted = spark.createDataFrame(list(ids.items()), "vertex long, trusted_id string")
    got, decisions = episodes.constrained_components(df, trusted, Scratch(spark, "test"))
    groups = {}
    for x in got.collect():
        groups.setdefault(x.root, set()).add(x.vertex)
    touched = {v for e in edges for v in e[:2]}
    expect = {}
    for v in touched:
        expect.setdefault(want[v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))
    assert decisions.where("decision = 'trusted_buyer_conflict'").count() == sum(x == "trusted_buyer_conflict" for _, x in log)


def test_components_with_hubs_kept_in_place(spark, monkeypatch):
    from tressage import runtime

    r = random.Random(3)
    pairs = [(1, i) for i in range(2, 200)] + [(i, i + 1) for i in range(300, 340)] + [(r.randrange(400, 600), r.randrange(400, 600)) for _ in range(90)] + [(199, 300)]
    df = spark.createDataFrame(pairs, "a long, b long")
    want = {x.vertex: x.root for x in episodes.components(df, "a", "b", Scratch(spark, "t")).collect()}
    monkeypatch.setattr(episodes, "HOT_FLOOR", 5)
    monkeypatch.setattr(runtime, "HOT_FLOOR", 5)
    assert {x.vertex: x.root for x in episodes.components(df, "a", "b", Scratch(spark, "t")).collect()} == want
    assert want[340] == 1 and all(root <= v for v, root in want.items())


def test_components_of_a_long_chain(spark):
    df = spark.range(300).selectExpr("id as a", "id + 1 as b")
    got = episodes.components(df, "a", "b", Scratch(spark, "test"))
    assert got.where("root = 0").count() == 301


def test_mixture_is_monotone_and_sums_to_one(spark, data):
    counted = linkage.patterns(spark.read.parquet(f"{data}/candidate_pairs.parquet"))
    for free in (False, True):
        fit = linkage.fit_mixture(counted, free)
        assert all(b >= a - 1e-3 * abs(a) for a, b in zip(fit["trace"], fit["trace"][1:]))
        for k in (2, 3):
            totals = {}
            for row in fit["levels"]:
                totals[row[0]] = totals.get(row[0], 0) + row[k]
            assert all(abs(v - 1) < 1e-9 for v in totals.values())


def test_top1_and_abstention(spark):
    rows = [("a", "x", 0.9, "siren"), ("a", "y", 0.9, "siren"), ("a", "z", float("nan"), "siren"), ("b", "x", 0.1, "siren"), ("c", "x", None, "none")]
    df = spark.createDataFrame(rows, "anchor_episode_id string, candidate_episode_id string, text_component double, buyer_match_type string").selectExpr("*", "date'2020-01-01' as candidate_origin_date")
    p = linkage.predict(df, "B", 70.0)
    assert [(r.anchor_episode_id, r.candidate_episode_id, r.predicted_rank) for r in p.orderBy("predicted_rank").collect()] == [("a", "x", 1), ("a", "y", 2)]
    truth = spark.createDataFrame([("a", ["x"]), ("b", ["x"]), ("c", [])], "anchor_episode_id string, successors array<string>")
    m = linkage.confusion(p, truth).first()
    assert (m.tp, m.fn_abstained, m.tn, m.precision, m.recall, m.fpr) == (1, 1, 1, 1.0, 0.5, 0.0)
    assert linkage.confusion(p, truth.limit(0)).first().precision is None


def test_bootstrap_of_all_ages_equals_each_alone(spark, lives):
    _, df = lives
    got = {(r.draw, r.age, r.horizon): r.probability for r in survival.bootstrap_conditionals(df, [0.0, 4.0], [2.0, 5.0], draws=6).collect()}
    assert len(got) == 6 * 4
    for age, horizon in ((0.0, 5.0), (4.0, 2.0)):
        for r in survival.bootstrap_conditional(df, age, horizon, draws=6).collect():
            assert r.probability == got[r.draw, age, horizon] and 0 < r.probability < 1


def test_bootstrap_query_takes_all_draws_ages_and_horizons(spark, data):
    from tressage import plans

    rows = plans.queries()["km_bootstrap"](spark, data).collect()
    assert {(r.age, r.horizon) for r in rows} == {(a, h) for a in (0.0, 12.0, 24.0, 36.0, 48.0) for h in (12.0, 24.0)}
    assert len(rows) == 10 and all(r.draws == 500 and r.low <= r.median <= r.high for r in rows)
