"""Guards and rules of the evaluation, and queries without SQL, against what their definitions give."""

import json
import random
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tressage import plans
from tressage.functions.special import t_sf2
from tressage.operators import evaluation, linkage, standardize, trend
from tressage.plans import audit, episodes, survival


def design(spark, rows):
    return spark.createDataFrame(rows, "anchor_episode_id string, successors array<string>, stratum_id string, design_weight double, frame string, negative_is_censored boolean, negative_verification string")


SAMPLE = [
    ("a", ["x"], "s1", 2.0, "PROBABILITY", False, "AMONG_SHOWN"), ("b", ["y"], "s1", 2.0, "PROBABILITY", False, "AMONG_SHOWN"), ("c", [], "s2", 5.0, "PROBABILITY", False, "EXHAUSTIVE_POOL"),
    ("d", [], "s2", 5.0, "PROBABILITY", True, "EXHAUSTIVE_POOL"), ("e", [], "s2", 5.0, "PROBABILITY", False, "AMONG_SHOWN"), ("f", ["z"], "s1", 2.0, "PROBABILITY", False, "AMONG_SHOWN")]


def test_frames_and_weights_are_guarded(spark):
    assert evaluation.guard_design(design(spark, SAMPLE)).count() == 6
    for bad in (SAMPLE + [("g", [], "s", 1.0, "ENRICHMENT_A", False, "")], SAMPLE + [("g", [], "s", None, "PROBABILITY", False, "")]):
        with pytest.raises(ValueError):
            evaluation.guard_design(design(spark, bad))
    with pytest.raises(ValueError):
        evaluation.guard_design(design(spark, SAMPLE).drop("frame"))
    with pytest.raises(ValueError):
        linkage.stratified_ratio(design(spark, SAMPLE + [("g", [], "s", None, "PROBABILITY", False, "")]).withColumn("one", F.lit(1)), "one", "one", "stratum_id", "design_weight")


def test_predictions_outside_the_pool_and_censored_negatives(spark):
    predicted = spark.createDataFrame([("a", "x", 1), ("b", "q", 1), ("c", "w", 1), ("f", "z", 1), ("e", "w", 2)], "anchor_episode_id string, candidate_episode_id string, predicted_rank int")
    pool = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "w"), ("f", "z")], "anchor_episode_id string, candidate_episode_id string")
    scored = evaluation.scored_anchors(predicted, design(spark, SAMPLE), pool)
    c = evaluation.weighted_counts(scored).first()
    assert (c.anchors, c.positives, c.negatives, c.verified_negatives, c.accepted, c.outside, c.censored_out) == (6, 3, 2, 1, 3, 1, 1)
    rates = {r.metric: r for r in evaluation.weighted_rates(scored).collect()}
    assert rates["precision_at_1"].estimate == pytest.approx(4 / 9, abs=1e-4) and rates["recall_at_1"].estimate == pytest.approx(2 / 3, abs=1e-4)
    assert rates["false_positive_rate"].estimate == 1.0 and rates["coverage"].estimate == pytest.approx(9 / 21, abs=1e-4)
    assert all(r.low <= r.estimate <= r.high for r in rates.values())


def test_the_grid_against_brute_force(spark):
    r = random.Random(1)
    rows = [(f"a{r.randrange(9)}", f"c{k}", r.choice([None, float("nan"), r.random()]), r.choice([None, 100 * r.random()]), r.choice([None, 0.0, 0.7])) for k in range(120)]
    pairs = spark.createDataFrame(rows, "anchor_episode_id string, candidate_episode_id string, text_component double, linkage_score double, cpv_component double")
    truth = {f"a{k}": [f"c{j}" for j in range(k, 120, 11)] for k in range(7)} | {"a7": [], "a8": []}
    t = spark.createDataFrame(list(truth.items()), "anchor_episode_id string, successors array<string>")
    got = {(x.text_at, x.score_at, x.mode): (x.accepted, x.tp) for x in evaluation.grid_top1(pairs, t, (0.0, 0.5), (0, 40), (0, 1, 2)).collect()}
    zero = lambda v: v if v is not None and v == v else 0.0
    for ta in (0.0, 0.5):
        for sa in (0, 40):
            for m in (0, 1, 2):
                best = {}
                for a, c, x, s, v in rows:
                    if zero(x) >= ta and zero(s) >= sa and (m == 0 or (v is not None and (m == 1 or v > 0))):
                        best[a] = max(best.get(a, (-1, -1, "")), (zero(s), zero(x), c))
                want = (len(best), sum(b[2] in truth[a] for a, b in best.items()))
                assert got.get((ta, float(sa), m), (0, 0)) == want
    one = evaluation.best_of_grid(evaluation.grid_top1(pairs, t, (0.0, 0.5), (0, 40), (0, 1, 2)), 5).collect()
    assert len(one) == 1 and one[0].precision == max(round(tp / n, 6) for n, tp in got.values() if n >= 5)


def test_buyer_evidence_refuses_conflicts(spark):
    rows = [("nantes", "nantes", "1", "1"), ("nantes", "nantes", "1", "2"), ("nantes", "nantes", "", "2"), ("", "", "", None), ("ville nantes", "ville nante", None, None), ("syndicat eaux bru", "eaux grandes lacs syndicat", "", ""), ("abc", "xyz", "", "")]
    got = [r.buyer_match_type for r in linkage.buyer_match(spark.createDataFrame(rows, "a string, b string, i string, j string"), "a", "b", "i", "j").collect()]
    assert got == ["siren", "none", "normalized_name", "none", "fuzzy_name", "token_overlap", "none"]


def key(s):
    import unicodedata

    t = "".join(c for c in unicodedata.normalize("NFD", (s or "").lower()) if not unicodedata.combining(c))
    return " ".join(re.findall("[a-z0-9]+", t))


def test_buyer_match_types_of_the_table(spark, data):
    want = Counter()
    for r in audit._linked(spark, data).collect():
        a, b = key(r.an), key(r.cn)
        i, j = (v[6:] if re.fullmatch("siren:[0-9]+", v) else "" for v in (r.ak, r.ck))
        x, y = ({t for t in k.split() if len(t) >= 4 and not t.isdigit()} for k in (a, b))
        ratio = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
        kind = "siren" if i and i == j else "none" if i and j else "normalized_name" if a and a == b else "fuzzy_name" if ratio >= 0.82 else "token_overlap" if x and y and len(x & y) / len(x | y) >= 0.34 else "none"
        want[kind] += 1
    assert {r.buyer_match_type: r.n for r in plans.queries()["buyer_match_types"](spark, data).collect()} == want


def test_sequence_ratios_of_the_table(spark, data):
    rows = plans.queries()["sequence_ratio"](spark, data).collect()
    assert len(rows) > 20
    for r in rows:
        a, b = key(r.anchor_buyer_name), key(r.candidate_buyer_name)
        assert r.ratio == pytest.approx(SequenceMatcher(None, a, b).ratio() if a and b else 0.0)


def test_the_posterior_method_keeps_what_its_model_says(spark, data):
    p = spark.read.parquet(f"{data}/candidate_pairs.parquet")
    fit = linkage.fit_mixture(linkage.patterns(p))
    s = linkage.score_with(p, [(f, v, b) for f, v, _, _, b in fit["levels"]], fit["prior"])
    best = {}
    for r in s.collect():
        if r.fs_match_probability is not None and r.fs_match_probability >= 0.65:
            best.setdefault(r.anchor_episode_id, []).append((-r.fs_match_probability, r.candidate_origin_date, r.candidate_episode_id))
    got = {r.anchor_episode_id: r.candidate_episode_id for r in plans.queries()["method_d"](spark, data).collect()}
    assert got.keys() == best.keys()
    assert linkage.score_with(s, [], 0.5) is s
    with pytest.raises(ValueError):
        linkage.score_with(p.drop("cpv_component"), [], 0.5)
    shift = plans.queries()["fs_robustness"](spark, data).collect()
    assert {r.field for r in shift} == set(linkage.FIELDS) and all(r.difference == pytest.approx(r.free - r.fixed) for r in shift)


def replayed(spark, data):
    """Episodes by a plain union-find over the ordered edges of the table."""
    from tressage.operators.episodes import replay

    edges = sorted({(e.priority, e.evidence, e.left_id, e.right_id) for e in episodes._edges(spark, data).collect() if e.left_id != e.right_id})
    trusted = {r.vertex: r.trusted_id for r in episodes._trusted(spark, data).collect()}
    vertices = sorted({v for e in edges for v in e[2:]})
    return vertices, replay(vertices, trusted, [(a, b, p) for p, _, a, b in edges])


def test_constrained_components_and_decisions_of_the_table(spark, data):
    vertices, (roots, log) = replayed(spark, data)
    groups, got = defaultdict(set), defaultdict(set)
    for v, r in roots.items():
        groups[r].add(v)
    for r in plans.queries()["components_constrained"](spark, data).collect():
        got[r.root].add(r.vertex)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values())) and len(vertices) > 50
    refused = sum(d == "trusted_buyer_conflict" for _, d in log)
    assert refused == sum(r.n for r in plans.queries()["edge_decisions"](spark, data).collect() if r.decision == "trusted_buyer_conflict")


def test_episodes_of_the_table(spark, data):
    import hashlib

    _, (roots, _) = replayed(spark, data)
    members = defaultdict(set)
    for n in episodes._notices(spark, data).collect():
        members[roots.get(n.idx, n.idx)].add((n.idweb, n.day, n.buyer_siren or "", n.idx))
    got = {r.episode_id: r for r in plans.queries()["episode_table"](spark, data).collect()}
    want = {"EP-" + hashlib.sha256("\n".join(sorted({m[0] for m in ms})).encode()).hexdigest()[:16]: ms for ms in members.values()}
    assert got.keys() == want.keys()
    for e, ms in want.items():
        days = [m[1] for m in ms if m[1]]
        assert got[e].first_day == (min(days) if days else None) and got[e].last_day == (max(days) if days else None)
        sirens = {m[2] for m in ms if m[2]}
        assert got[e].siren == (sirens.pop() if len(sirens) == 1 else "") and got[e].buyer_conflict == (len(sirens) > 1)


def test_signals_of_the_panel(spark, data):
    panel = defaultdict(list)
    for r in episodes._panel(spark, data).orderBy("quarter").collect():
        panel[r.segment].append(r.n)
    slopes = {r.segment: r for r in plans.queries()["trend_signal"](spark, data).collect()}
    matrix = {r.segment: r for r in plans.queries()["signal_matrix"](spark, data).collect()}
    assert slopes.keys() == matrix.keys() == panel.keys()
    for s, v in panel.items():
        y, n = v[-12:], 12
        mx, my = 5.5, sum(y) / n
        sxx, sxy, syy = sum((x - mx) ** 2 for x in range(n)), sum((x - mx) * (w - my) for x, w in enumerate(y)), sum((w - my) ** 2 for w in y)
        slope, r2 = sxy / sxx, sxy * sxy / sxx / syy
        t = slope / (((1 - r2) * syy / 10) ** 0.5 / sxx**0.5)
        p = t_sf2(t, 10)
        assert slopes[s].slope == pytest.approx(slope) and slopes[s].p_value == pytest.approx(p, rel=1e-6)
        state = "stable_or_uncertain" if p >= 0.1 else "increasing" if slope > 0 else "decreasing"
        assert slopes[s].state == matrix[s].state == state
        breaks = trend.stable_breaks(v)
        assert matrix[s].quarters_since_break == (len(v) - breaks[-1] if breaks else None) and matrix[s].advice


def test_screens_and_arms(spark, data):
    fit = {c: survival.ops.cox(survival._design(spark, data), [c])["rows"][0] for c in ("large", "award_year")}
    screen = {r.covariate: r for r in plans.queries()["univariate_screen"](spark, data).collect()}
    assert set(screen) == set(survival._COVARIATES)
    for c, r in fit.items():
        assert screen[c].alone == pytest.approx(r["coef"]) and screen[c].p_alone == pytest.approx(r["p"])
        assert screen[c].flips == (screen[c].alone * screen[c].joint < 0)
    arms = {r.covariate: r for r in plans.queries()["arm_retest"](spark, data).collect()}
    x = survival._design(spark, data)
    late = survival.ops.cox(x.withColumn("event", ((F.col("event") == 1) & (F.col("t") >= 12.0)).cast("int")), survival._COVARIATES)
    for r in late["rows"]:
        assert arms[r["covariate"]].hr_12m == pytest.approx(r["hazard_ratio"], rel=1e-6)
    assert all(0 <= a.significant <= 4 and a.verdict in ("robust", "fragile", "mixed") for a in arms.values())
    tests = plans.queries()["arm_logrank"](spark, data).collect()
    assert len(tests) == 4 and all(sorted(t.ordering.split(" > ")) == sorted(tests[0].ordering.split(" > ")) for t in tests)
    periods = {r.period: r for r in plans.queries()["concordance_out_of_time"](spark, data).collect()}
    assert set(periods) == {"train", "1998-1999", "1998-2001"} and all(0 <= r.c_index <= 1 for r in periods.values())


def test_a_standardised_notice(spark):
    eforms = {"EFORMS": {"ContractNotice": {
        "ext:UBLExtensions": {"x": {"efac:Organizations": {"efac:Organization": [
            {"efac:Company": {"cac:PartyIdentification": {"cbc:ID": "ORG-1"}, "cac:PartyName": {"cbc:Name": "Acheteur test"}, "cac:PartyLegalEntity": [{"cbc:CompanyID": "26440013600471"}], "cac:PostalAddress": [{"cbc:PostalZone": "44000"}]}},
            {"efac:Company": {"cac:PartyIdentification": {"cbc:ID": "ORG-2"}, "cac:PartyName": {"cbc:Name": "Autre"}, "cac:PostalAddress": [{"cbc:PostalZone": "75001"}]}}]}}},
        "cac:ContractingParty": {"cac:Party": {"cac:PartyIdentification": {"cbc:ID": "ORG-1"}}}, "cbc:ContractFolderID": "ABC-2024-001"}}}
    months = {"MAPA": {"initial": {"duree": {"dureeMois": "12"}, "x": {"duree": "24"}}}}
    rows = [(1, json.dumps(eforms)), (2, json.dumps(months)), (3, None), (4, "{"), (5, json.dumps({"MAPA": {"dureeMois": 36, "valeur": "12 345,50 €"}}))]
    got = {r.idx: r for r in standardize.standardise(spark.createDataFrame(rows, "idx long, donnees string")).collect()}
    assert (got[1].layout, got[1].buyer_name, got[1].buyer_siren, got[1].buyer_department, got[1].reference) == ("EFORMS", "Acheteur test", "264400136", "44", "abc 2024 001")
    assert got[1].buyer_key == "siren:264400136" and not got[1].identifier_conflict
    assert got[2].duration_months is None and got[2].duration_quality == "conflict"
    for k in (3, 4):
        assert got[k].buyer_name == "" and got[k].layout is None and got[k].duration_quality == "unresolved" and got[k].amounts == []
    assert got[5].duration_months == 36.0 and got[5].amounts == [12345.5]
