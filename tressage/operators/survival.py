"""Right-censored survival analysis over (t, event) rows, t > 0 in months and event 0 or 1.

Every estimator first counts by distinct time (and group or covariate pattern) in Spark; windows and driver loops
see those counts only, never rows, and counts reach the driver only behind a count of them.  Rows with a null time or
event are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi2_sf, normal_sf2
from ..runtime import Scratch, python_rows, ranged, running

#: The most counts by time and pattern that one fit holds on the driver (some tens of bytes each), and the most distinct
#: times and levels of a category.  With more patterns the sums by time are taken in Spark at every step.
MOST_PATTERNS, MOST_TIMES, MOST_LEVELS = 1_000_000, 200_000, 1_000


def bounded(counts: DataFrame, most: int, what: str) -> DataFrame:
    """``counts``, refused where there are more rows than a driver should hold."""
    if counts.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return counts


def _counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.where("t is not null and event is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event").cast("bigint")).alias("d"))


def life_table(rows: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, t, n, d, at_risk, survival): the Kaplan-Meier curve at each distinct time.

    Without groups the distinct times are summed by ranges (:func:`tressage.runtime.running`), in no single task.
    """
    g = _counts(rows, *by, "t")
    log = F.when(F.col("d") < F.col("at_risk"), F.log(1 - F.col("d") / F.col("at_risk"))).otherwise(0.0)
    dead = (F.col("d") == F.col("at_risk")).cast("int")
    if not by:
        scratch = Scratch(rows.sparkSession, "life")
        r = running(ranged(g, [F.asc("t")], scratch), [F.desc("t")], {"at_risk": F.col("n")}, reverse=True)
        r = running(r, [F.asc("t")], {"_logs": log, "_dead": dead})
        return r.select("t", "n", "d", "at_risk", F.when(F.col("_dead") > 0, F.lit(0.0)).otherwise(F.exp("_logs")).alias("survival"))
    part = Window.partitionBy(*[F.col(b) for b in by])
    down, up = part.orderBy(F.desc("t")), part.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = g.withColumn("at_risk", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return r.withColumn("survival", F.when(F.max(dead).over(up) == 1, F.lit(0.0)).otherwise(F.exp(F.sum(log).over(up))))


def survival_at(table: DataFrame, times: list[float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, months, survival): the last step at or before each time; 1 before the first."""
    at = F.explode(F.array(*[F.lit(float(t)) for t in times])).alias("months")
    return table.select(*by, "t", "survival", at).groupBy(*by, "months").agg(F.coalesce(F.min(F.when(F.col("t") <= F.col("months"), F.col("survival"))), F.lit(1.0)).alias("survival"))


def median_survival(table: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, median): the first time at which survival is at most one half; infinite if there is none."""
    return table.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))), F.lit(float("inf"))).alias("median"))


def conditional_probability(table: DataFrame, ages: list[float], horizon: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, age, probability): 1 - S(age + horizon) / S(age); null where nobody survives to that age."""
    s = survival_at(table, sorted({*ages, *[a + horizon for a in ages]}), by)
    now, then = s.select(*by, F.col("months").alias("age"), F.col("survival").alias("now")), s.select(*by, (F.col("months") - horizon).alias("age"), F.col("survival").alias("then"))
    j = now.join(then, [*by, "age"]).where(F.col("age").isin(*map(float, ages)))
    return j.select(*by, "age", F.when(F.col("now") > 0, 1 - F.col("then") / F.col("now")).alias("probability"))


def _risk_sets(rows: DataFrame, group: str) -> tuple[list, DataFrame]:
    """The levels of a category, and (t, D, Y, y0.., d0..) at each time with an event: deaths and at risk, in all and by level."""
    g = rows.where("t is not null and event is not null").groupBy(F.col(group).alias("g"), "t").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event").cast("bigint")).alias("d"))
    names = sorted(r.g for r in bounded(g.select("g").distinct(), MOST_LEVELS, "levels").collect())
    k = range(len(names))
    wide = g.groupBy("t").agg(*[F.sum(F.when(F.col("g") == names[i], F.col("n")).otherwise(0)).alias(f"n{i}") for i in k], *[F.sum(F.when(F.col("g") == names[i], F.col("d")).otherwise(0)).alias(f"d{i}") for i in k])
    r = running(ranged(wide, [F.desc("t")], Scratch(rows.sparkSession, "risk")), [F.desc("t")], {f"y{i}": F.col(f"n{i}") for i in k})
    every = lambda p: sum((F.col(f"{p}{i}") for i in k), F.lit(0))
    return names, r.withColumns({"D": every("d"), "Y": every("y")}).where("D > 0")


def logrank_counts(rows: DataFrame, group: str) -> DataFrame:
    """(group, observed, expected) of the k-sample log-rank test."""
    names, r = _risk_sets(rows, group)
    kind = dict(rows.dtypes)[group]
    each = F.explode(F.array(*[F.struct(F.lit(v).cast(kind).alias(group), F.col(f"d{i}").alias("d"), (F.col("D") * F.col(f"y{i}") / F.col("Y")).alias("e")) for i, v in enumerate(names)])).alias("x")
    return r.select(each).groupBy(f"x.{group}").agg(F.sum("x.d").alias("observed"), F.sum("x.e").alias("expected"))


def logrank(rows: DataFrame, group: str) -> dict:
    """Chi-square, degrees of freedom and p of the k-sample log-rank test, and (level, observed, expected) of each level.

    The covariance is summed in Spark: what comes back is one row.
    """
    import numpy as np

    names, r = _risk_sets(rows, group)
    k = range(len(names))
    factor = F.when(F.col("Y") > 1, F.col("D") * (F.col("Y") - F.col("D")) / (F.col("Y") - 1)).otherwise(0.0)
    expected = lambda i: F.col("D") * F.col(f"y{i}") / F.col("Y")
    sums = [x for i in k for x in (F.sum(f"d{i}").alias(f"o{i}"), F.sum(expected(i)).alias(f"e{i}"))]
    s = r.agg(F.count(F.lit(1)).alias("times"), *sums, *[F.sum(factor * F.col(f"y{i}") / F.col("Y") * ((1.0 if i == j else 0.0) - F.col(f"y{j}") / F.col("Y"))).alias(f"v{i}_{j}") for i in k for j in k]).first()
    if len(names) < 2 or not s.times:
        return {"chi2": 0.0, "df": max(len(names) - 1, 0), "p": 1.0, "levels": [(v, 0, 0.0) for v in names]}
    z = np.array([s[f"o{i}"] - s[f"e{i}"] for i in k[:-1]])
    v = np.array([[s[f"v{i}_{j}"] for j in k[:-1]] for i in k[:-1]])
    chi2 = float(z @ np.linalg.pinv(v) @ z)
    return {"chi2": chi2, "df": len(names) - 1, "p": chi2_sf(chi2, len(names) - 1), "levels": [(names[i], s[f"o{i}"], s[f"e{i}"]) for i in k]}


def patterns(rows: DataFrame, covariates: list[str], scratch: Scratch | None = None) -> DataFrame:
    """(t, event, covariates, n): the distinct times and covariate patterns with counts, written once for any number of fits."""
    scratch = scratch or Scratch(rows.sparkSession, "patterns")
    return scratch.write(rows.where("t is not null and event is not null").groupBy("t", "event", *covariates).agg(F.count(F.lit(1)).alias("n")), "patterns")


def cox(rows: DataFrame, covariates: list[str], iterations: int = 30) -> dict:
    """:func:`cox_fit` of rows."""
    return cox_fit(patterns(rows, covariates), covariates, iterations)


def cox_fit(counted, covariates: list[str], iterations: int = 30) -> dict:
    """Proportional hazards by Newton steps on counted patterns, ties after Efron.

    ``counted`` has t, event, the covariates and n, as a table or, held once for several fits, as pandas.  A step needs the
    risk's moments at each time; they come from the patterns on the driver, or beyond MOST_PATTERNS of them from an
    aggregate in Spark, a row a time.  Returns coefficients with standard errors and p, the log partial likelihood and AIC.
    """
    import numpy as np

    k = len(covariates)
    if isinstance(counted, DataFrame) and counted.limit(MOST_PATTERNS + 1).count() > MOST_PATTERNS:
        mean, moments = _spark_moments(counted, covariates)
    else:
        p = counted.toPandas() if isinstance(counted, DataFrame) else counted
        mean, moments = _local_moments(p, covariates)

    def parts(b):
        """Log likelihood, gradient and Hessian from the moments at each time, latest first."""
        at = moments(b)
        s0, s1, s2 = (np.cumsum(at[c], axis=0) for c in ("s0", "s1", "s2"))
        ll, grad, hess = float(at["dx"].sum(axis=0) @ b), at["dx"].sum(axis=0), np.zeros((k, k))
        for i in np.flatnonzero(at["d"] > 0):
            f = np.arange(at["d"][i]) / at["d"][i]
            a0 = s0[i] - f * at["d0"][i]
            a1 = s1[i][None, :] - f[:, None] * at["d1"][i][None, :]
            ll -= float(np.log(a0).sum())
            grad = grad - (a1 / a0[:, None]).sum(axis=0)
            hess -= s2[i] * (1 / a0).sum() - at["d2"][i] * (f / a0).sum() - (a1 / a0[:, None]).T @ (a1 / a0[:, None])
        return ll, grad, hess

    beta = np.zeros(k)
    ll, grad, hess = parts(beta)
    for _ in range(iterations):
        step = np.linalg.solve(-hess + 1e-12 * np.eye(k), grad)
        scale = 1.0
        while True:
            new = parts(beta + scale * step)
            if new[0] >= ll - 1e-12 or scale < 1e-4:
                break
            scale /= 2
        done = abs(new[0] - ll) < 1e-10 * (abs(ll) + 1)
        beta, (ll, grad, hess) = beta + scale * step, new
        if done:
            break
    se = np.sqrt(np.diag(np.linalg.inv(-hess)))
    rows_ = [{"covariate": c, "coef": float(b), "hazard_ratio": math.exp(b), "se": float(s), "low": math.exp(b - 1.959963985 * s), "high": math.exp(b + 1.959963985 * s), "p": normal_sf2(b / s)} for c, b, s in zip(covariates, beta, se)]
    return {"rows": rows_, "beta": dict(zip(covariates, map(float, beta))), "mean": dict(zip(covariates, map(float, mean))), "loglik": ll, "aic": 2 * k - 2 * ll}


def _local_moments(p, covariates: list[str]):
    import numpy as np

    p = p.sort_values("t", ascending=False, kind="stable")
    x, n = p[covariates].to_numpy(float), p.n.to_numpy(float)
    mean = np.average(x, axis=0, weights=n)
    x = x - mean
    t, dn = p.t.to_numpy(float), n * (p.event.to_numpy(int) == 1)
    starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    add = lambda v: np.add.reduceat(v, starts, axis=0)
    square = x[:, :, None] * x[:, None, :]

    def moments(b):
        risk = np.exp(x @ b)
        r, d = risk * n, risk * dn
        return {
            "s0": add(r), "s1": add(r[:, None] * x), "s2": add(r[:, None, None] * square), "d0": add(d), "d1": add(d[:, None] * x), "d2": add(d[:, None, None] * square),
            "d": add(dn).astype(int), "dx": add(dn[:, None] * x)}

    return mean, moments


def _spark_moments(counted: DataFrame, covariates: list[str]):
    import numpy as np

    k = range(len(covariates))
    m = counted.agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"m{i}") for i, c in enumerate(covariates)]).first()
    bounded(counted.select("t").distinct(), MOST_TIMES, "distinct times")
    x = counted.select("t", "event", "n", *[(F.col(c) - F.lit(float(m[f"m{i}"]))).alias(f"x{i}") for i, c in enumerate(covariates)])

    def moments(b):
        r = x.withColumn("r", F.exp(sum((F.lit(float(b[i])) * F.col(f"x{i}") for i in k), F.lit(0.0))))
        sums = []
        for side, weight in (("s", F.col("r") * F.col("n")), ("d", F.when(F.col("event") == 1, F.col("r") * F.col("n")).otherwise(0.0))):
            sums += [F.sum(weight).alias(f"{side}0"), *[F.sum(weight * F.col(f"x{i}")).alias(f"{side}1_{i}") for i in k], *[F.sum(weight * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"{side}2_{i}_{j}") for i in k for j in k if i <= j]]
        dead = F.when(F.col("event") == 1, F.col("n")).otherwise(0)
        p = r.groupBy("t").agg(*sums, F.sum(dead).alias("d"), *[F.sum(dead * F.col(f"x{i}")).alias(f"dx_{i}") for i in k]).toPandas().sort_values("t", ascending=False)
        two = lambda s: np.stack([np.stack([p[f"{s}2_{min(i, j)}_{max(i, j)}"].to_numpy(float) for j in k], axis=1) for i in k], axis=1)
        one = lambda s: np.stack([p[f"{s}_{i}"].to_numpy(float) for i in k], axis=1)
        return {"s0": p.s0.to_numpy(float), "s1": one("s1"), "s2": two("s"), "d0": p.d0.to_numpy(float), "d1": one("d1"), "d2": two("d"), "d": p.d.to_numpy(int), "dx": one("dx")}

    return np.array([m[f"m{i}"] for i in k], float), moments


def ph_test(counted: DataFrame, covariates: list[str], beta: dict[str, float]) -> list[dict]:
    """Correlation of scaled Schoenfeld residuals with the rank of event times, by covariate; over :func:`patterns`."""
    import numpy as np

    p = bounded(counted, MOST_PATTERNS, "patterns").toPandas().sort_values("t", ascending=False)
    x, b = p[covariates].to_numpy(float), np.array([beta[c] for c in covariates])
    t, e, n = p.t.to_numpy(float), p.event.to_numpy(int), p.n.to_numpy(float)
    r = np.exp((x - x.mean(axis=0)) @ b) * n
    s0, s1 = np.cumsum(r), np.cumsum(r[:, None] * x, axis=0)
    last = np.searchsorted(-t, -t, side="right") - 1
    mean = s1[last] / s0[last][:, None]
    m = e == 1
    res, w, times = (x - mean)[m], n[m], t[m]
    order = np.argsort(times, kind="stable")
    res, w, times = res[order], w[order], times[order]
    rank = np.cumsum(w) - (w - 1) / 2
    rc = rank - np.average(rank, weights=w)
    out = []
    for i, c in enumerate(covariates):
        y = res[:, i] - np.average(res[:, i], weights=w)
        denominator = math.sqrt(float((w * rc * rc).sum() * (w * y * y).sum()))
        rho = float((w * rc * y).sum()) / denominator if denominator else 0.0
        chi2 = rho * rho * float(w.sum())
        out.append({"covariate": c, "rho": rho, "chi2": chi2, "p": chi2_sf(chi2, 1)})
    return out


def concordance(scored: DataFrame, levels: int = 1 << 20, scratch: Scratch | None = None) -> DataFrame:
    """(concordant, discordant, tied, c_index) of (t, event, risk): higher risk should fail earlier.

    Rows are counted by (t, event, risk); risks are numbered in order.  Two risks differ first at one binary digit of
    their numbers: for each digit an event whose digit is 1 meets the later rows whose digit is 0 under the same higher
    digits, counted by running sums over time, so that no pair is ever made.  More than ``levels`` distinct risks are refused.
    """
    scratch = scratch or Scratch(scored.sparkSession, "concordance")
    g = scored.where("t is not null and event is not null and risk is not null").groupBy("t", "event", "risk").agg(F.count(F.lit(1)).alias("n"))
    g = scratch.write(g, "counts")
    risks = ranged(g.select("risk").distinct().withColumn("_one", F.lit(1)), [F.asc("risk")], scratch)
    numbered = scratch.write(running(risks, [F.asc("risk")], {"k": F.col("_one")}).select("risk", (F.col("k") - 1).cast("int").alias("k")), "risks")
    most = numbered.agg(F.max("k")).first()[0] or 0
    if most >= levels:
        raise ValueError(f"more than {levels} distinct risks")
    g = scratch.write(g.join(numbered, "risk").groupBy("t", "k").agg(F.sum(F.when(F.col("event") == 1, F.col("n")).otherwise(0)).alias("d"), F.sum(F.when(F.col("event") == 1, 0).otherwise(F.col("n"))).alias("c")), "numbered")
    # a censored row outlives the events of its time, another event of that time does not
    digits = range(most.bit_length())
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.shiftright("k", b + 1).alias("up"), F.shiftright("k", b).bitwiseAND(1).alias("digit")) for b in digits], F.struct(F.lit(-1).alias("b"), F.col("k").alias("up"), F.lit(2).alias("digit")))).alias("x")
    r = g.select("t", "d", "c", each).select("t", "x.*", "d", "c").groupBy("b", "up", "t").agg(*[F.sum(F.when(F.col("digit") == v, F.col(w)).otherwise(0)).alias(f"{w}{v}") for v in (0, 1, 2) for w in ("d", "c")])
    order = [F.asc("b"), F.asc("up"), F.desc("t")]
    r = running(ranged(r, order, scratch), order, {f"s{v}": F.col(f"d{v}") + F.col(f"c{v}") for v in (0, 1, 2)})
    r = scratch.write(r, "sums")
    base = r.groupBy("b", "up").agg(*[F.min(F.col(f"s{v}") - F.col(f"d{v}") - F.col(f"c{v}")).alias(f"o{v}") for v in (0, 1, 2)])
    j = r.join(base, ["b", "up"])
    later = lambda v: F.col(f"s{v}") - F.col(f"d{v}") - F.col(f"o{v}")
    s = j.agg(F.sum(F.col("d1") * later(0)).alias("concordant"), F.sum(F.col("d0") * later(1)).alias("discordant"), F.sum(F.col("d2") * later(2)).alias("tied"))
    total = F.col("concordant") + F.col("discordant") + F.col("tied")
    return s.select("*", F.when(total > 0, F.round((F.col("concordant") + 0.5 * F.col("tied")) / total, 6)).alias("c_index"))


def asof_steps(rows: DataFrame, curve: DataFrame, by: list[str], at: str, offsets: list[float]) -> DataFrame:
    """Adds s0, s1, ...: the curve's value (by, t, survival) at ``at`` plus each offset, the last step not after it; 1 before.

    Distinct ages are put among the curve's steps and take the last one before them in order; rows meet their age by an
    equal join, so nothing scans a curve.
    """
    ages = rows.where(F.col(at).isNotNull()).select(*by, at).distinct()
    asked = ages.select(*by, F.col(at).alias("_age"), F.posexplode(F.array(*[F.col(at) + float(o) for o in offsets])).alias("_i", "_x"))
    both = curve.select(*by, F.col("t").alias("_x"), "survival", F.lit(0).alias("_ask"), F.lit(None).cast("double").alias("_age"), F.lit(None).cast("int").alias("_i"))
    both = both.unionByName(asked.select(*by, "_x", F.lit(None).cast("double").alias("survival"), F.lit(1).alias("_ask"), F.col("_age").cast("double").alias("_age"), "_i"))
    w = Window.partitionBy(*by).orderBy("_x", "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = both.withColumn("_s", F.coalesce(F.last("survival", ignorenulls=True).over(w), F.lit(1.0))).where("_ask = 1")
    wide = got.groupBy(*by, "_age").agg(*[F.max(F.when(F.col("_i") == i, F.col("_s"))).alias(f"s{i}") for i in range(len(offsets))])
    return rows.join(wide.withColumnRenamed("_age", at), [*by, at])


def parametric_fits(rows: DataFrame) -> list[dict]:
    """Exponential, Weibull, log-normal, log-logistic and generalised gamma by maximum likelihood, with AIC and BIC.

    Works on counts by (t, event), of which there are at most MOST_PATTERNS; a simplex search on the driver.
    """
    import numpy as np

    p = bounded(patterns(rows, []), MOST_PATTERNS, "distinct times").toPandas()
    t, e, n = p.t.to_numpy(float), p.event.to_numpy(float), p.n.to_numpy(float)
    lt, total = np.log(t), float(n.sum())
    erfc = np.vectorize(math.erfc)

    def log_sf_normal(z):
        return np.log(np.maximum(0.5 * erfc(z / math.sqrt(2)), 1e-300))

    def exponential(q):
        return e * (-q[0]) - np.exp(lt - q[0])

    def weibull(q):
        k = math.exp(q[1])
        z = k * (lt - q[0])
        return e * (q[1] + z - lt) - np.exp(np.minimum(z, 700))

    def lognormal(q):
        s = math.exp(q[1])
        z = (lt - q[0]) / s
        return np.where(e == 1, -0.5 * z * z - lt - q[1] - 0.5 * math.log(2 * math.pi), log_sf_normal(z))

    def loglogistic(q):
        k = math.exp(q[1])
        z = k * (lt - q[0])
        soft = np.logaddexp(0, z)
        return np.where(e == 1, q[1] + z - lt - 2 * soft, -soft)

    from ..functions.special import gamma_q

    def gengamma(q):
        s, lam = math.exp(q[1]), q[2]
        if abs(lam) < 0.02:
            return lognormal(q)
        a = lam**-2
        w = lam * (lt - q[0]) / s
        u = a * np.exp(np.minimum(w, 50))
        pdf = math.log(abs(lam)) - q[1] - lt + a * math.log(a) - math.lgamma(a) + a * w - u
        up = np.array([gamma_q(a, v) for v in u])
        return np.where(e == 1, pdf, np.log(np.maximum(up if lam > 0 else 1 - up, 1e-300)))

    def simplex(f, x0, steps=400):
        k = len(x0)
        pts = [np.array(x0, float)] + [np.array(x0, float) + np.eye(k)[i] * 0.5 for i in range(k)]
        val = [f(v) for v in pts]
        for _ in range(steps * k):
            o = np.argsort(val)
            pts, val = [pts[i] for i in o], [val[i] for i in o]
            if abs(val[-1] - val[0]) < 1e-9 * (abs(val[0]) + 1):
                break
            c = np.mean(pts[:-1], axis=0)
            r = c + (c - pts[-1])
            fr = f(r)
            if fr < val[0]:
                x = c + 2 * (c - pts[-1])
                fx = f(x)
                pts[-1], val[-1] = (x, fx) if fx < fr else (r, fr)
            elif fr < val[-2]:
                pts[-1], val[-1] = r, fr
            else:
                x = c + 0.5 * (pts[-1] - c)
                fx = f(x)
                if fx < val[-1]:
                    pts[-1], val[-1] = x, fx
                else:
                    pts = [pts[0]] + [pts[0] + 0.5 * (v - pts[0]) for v in pts[1:]]
                    val = [val[0]] + [f(v) for v in pts[1:]]
        return pts[0], val[0]

    start = float(np.average(lt, weights=n))
    out = []
    for name, f, x0 in (("exponential", exponential, [start]), ("weibull", weibull, [start, 0.0]), ("lognormal", lognormal, [start, 0.0]), ("loglogistic", loglogistic, [start, 0.0]), ("generalized_gamma", gengamma, [start, 0.0, 0.5])):
        def loss(q, f=f):
            v = float(-(n * f(q)).sum())
            return v if math.isfinite(v) else 1e300

        q, v = simplex(loss, x0)
        out.append({"family": name, "params": [float(a) for a in q], "loglik": -v, "aic": 2 * len(q) + 2 * v, "bic": len(q) * math.log(total) + 2 * v})
    return out


def bootstrap_conditional(rows: DataFrame, age: float, horizon: float, draws: int = 500, seed: int = 0) -> DataFrame:
    """(draw, probability) of :func:`bootstrap_conditionals` at one age and horizon."""
    return bootstrap_conditionals(rows, [age], [horizon], draws, seed).select("draw", "probability")


def bootstrap_conditionals(rows: DataFrame, ages: list[float], horizons: list[float], draws: int = 500, seed: int = 0) -> DataFrame:
    """(draw, age, horizon, probability): conditional probability under Poisson bootstrap weights.

    Rows are counted by time and event first; the weights of n rows add up to a Poisson number of mean n, so a draw
    costs a number a count and not a row.  Numbers depend on the time, the event and the seed only, so a lost task draws the
    same again.  All ages and horizons come from one set of weighted counts.
    """

    def kernel(cols):
        import struct

        import numpy as np

        out: dict[str, list] = {"t": [], "draw": [], "n": [], "d": []}
        for t, event, n in zip(cols["t"], cols["event"], cols["n"]):
            drawn = np.random.default_rng([seed, int(event), int.from_bytes(struct.pack(">d", t), "big")]).poisson(n, draws)
            at = np.flatnonzero(drawn)
            out["t"] += [t] * len(at)
            out["draw"] += at.tolist()
            out["n"] += drawn[at].tolist()
            out["d"] += (drawn[at] * int(event)).tolist()
        return out

    counts = rows.where("t is not null and event is not null").groupBy(F.col("t").cast("double").alias("t"), F.col("event").cast("int").alias("event")).agg(F.count(F.lit(1)).alias("n"))
    g = python_rows(counts, kernel, "t double, draw int, n long, d long").groupBy("draw", "t").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    part = Window.partitionBy("draw")
    up = part.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = g.withColumn("at_risk", F.sum("n").over(part.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    dead = F.max((F.col("d") == F.col("at_risk")).cast("int")).over(up)
    logs = F.sum(F.when(F.col("d") < F.col("at_risk"), F.log(1 - F.col("d") / F.col("at_risk"))).otherwise(0.0)).over(up)
    t = g.withColumn("survival", F.when(dead == 1, F.lit(0.0)).otherwise(F.exp(logs)))
    s = survival_at(t, sorted({*ages, *[a + h for a in ages for h in horizons]}), ["draw"])
    grid = F.array(*[F.struct(F.lit(float(a)).alias("age"), F.lit(float(h)).alias("horizon")) for a in ages for h in horizons])
    curve = s.groupBy("draw").agg(F.map_from_entries(F.collect_list(F.struct("months", "survival"))).alias("at")).withColumn("x", F.explode(grid)).select("draw", "x.age", "x.horizon", "at")
    now, then = F.element_at("at", F.col("age")), F.element_at("at", F.col("age") + F.col("horizon"))
    return curve.select("draw", "age", "horizon", F.when(now > 0, 1 - then / now).alias("probability"))


def standardised_difference(rows: DataFrame, value: str, flag: str) -> DataFrame:
    """(difference): means of flagged less others over the equally pooled deviation; null under two rows, 0 if flat."""
    x = F.col(value).cast("double")
    a, b = F.when(F.col(flag) == 1, x), F.when(F.col(flag) == 0, x)
    s = rows.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"))
    pooled = F.sqrt((F.col("va") + F.col("vb")) / 2)
    return s.select(F.when((F.col("na") < 2) | (F.col("nb") < 2), F.lit(None)).when(pooled == 0, 0.0).otherwise((F.col("ma") - F.col("mb")) / pooled).alias("difference"))
