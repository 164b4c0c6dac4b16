"""Benchmark models and walk-forward evaluation. A fit sees one series and one fold; both are group keys."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.functions.fitting import NORMAL, fit_garch, fit_hawkes, fit_nu, garch_horizon, student_logpdf, student_ppf
from tidemark.functions.fits import logistic_fits
from tidemark.functions.recurrences import along_series, ewma_variance, expanding_tail, garch_variance, hawkes_probability, rolling_tail, with_ewma

from .analogue import neighbours
from .volatility import FLOOR, VolConfig, engine_of

#: Fixed values.
HALFLIVES = (5.0, 10.0, 20.0, 50.0, 100.0, 200.0)


def with_har(data: DataFrame, c: VolConfig) -> DataFrame:
    """har: logs of mean realised variance over the three spans; NULL until all are complete."""
    parts = [F.log(W.floored(W.sma(F.col("rv"), n), F.col("floor"))) for n in c.har]
    out = F.array(*parts)
    return data.withColumn("har", F.when(F.forall(out, lambda v: v.isNotNull()), out))


def with_folds(data: DataFrame, bounds: DataFrame) -> DataFrame:
    """Every series' rows up to a fold's end, once for each fold: the fold fits before a and forecasts [a, b)."""
    return data.join(bounds, "series_id").filter("t < b")


def fit_rows(t: np.ndarray, a: int, c: VolConfig) -> np.ndarray:
    """Bars past the warm-up whose targets are known when the fold starts at a."""
    return (t >= c.warmup) & (t < a - c.h - 1)


def har_coefficients(data: DataFrame, bounds: DataFrame, c: VolConfig) -> DataFrame:
    """b0 to b3 per series and fold from sums of products: rows are added up where they lie, and only a
    4 x 4 system a fold is solved."""
    names = ["x0", "x1", "x2", "x3"]
    rows = with_folds(with_har(data, c), bounds).filter(F.col("har").isNotNull() & F.col("target").isNotNull() & (F.col("t") >= c.warmup) & (F.col("t") < F.col("a") - c.h - 1))
    rows = rows.withColumns({"x0": F.lit(1.0), "x1": F.col("har")[0], "x2": F.col("har")[1], "x3": F.col("har")[2]})
    sums = [F.sum(F.col(p) * F.col(q)).alias(f"{p}{q}") for i, p in enumerate(names) for q in names[i:]] + [F.sum(F.col(p) * F.col("target")).alias(f"{p}y") for p in names]
    added = rows.groupBy("series_id", "fold").agg(*sums)

    def solve(pdfs):
        for pdf in pdfs:
            m = np.zeros((len(pdf), 4, 4))
            for i, p in enumerate(names):
                for j, q in enumerate(names[i:], i):
                    m[:, i, j] = m[:, j, i] = pdf[f"{p}{q}"]
            b = np.linalg.solve(m, pdf[[f"{p}y" for p in names]].to_numpy()[..., None])[..., 0] if len(pdf) else np.zeros((0, 4))
            yield pd.DataFrame({"series_id": pdf["series_id"], "fold": pdf["fold"], **{f"b{i}": b[:, i] for i in range(4)}})

    return added.mapInPandas(solve, "series_id string, fold int, b0 double, b1 double, b2 double, b3 double")


def har_forecast(data: DataFrame, bounds: DataFrame, c: VolConfig) -> DataFrame:
    """series_id, fold, t, log_variance over the folds, before any correction."""
    b = har_coefficients(data, bounds, c)
    value = F.col("b0") + F.col("b1") * F.col("har")[0] + F.col("b2") * F.col("har")[1] + F.col("b3") * F.col("har")[2]
    return with_folds(with_har(data, c), bounds).join(b, ["series_id", "fold"]).filter("har IS NOT NULL").withColumn("log_variance", value).select("series_id", "fold", "t", "a", "log_variance", "target")


def rolling_har(data: DataFrame, c: VolConfig, window: int, ridge: float = 1e-10) -> DataFrame:
    """series_id, t, log_variance: least squares on the ``window`` rows whose targets are known at each bar."""
    d = with_har(data, c).withColumns({"x0": F.lit(1.0), **{f"x{i + 1}": F.col("har")[i] for i in range(3)}})
    known = F.col("har").isNotNull() & F.col("target").isNotNull()
    w = W.ordered().rowsBetween(-c.h - window, -c.h - 1)
    names = ["x0", "x1", "x2", "x3"]
    for i, p in enumerate(names):
        for q in [*names[i:], "target"]:
            d = d.withColumn(f"s_{p}_{q}", F.sum(F.when(known, F.col(p) * F.col(q))).over(w))
    d = d.withColumn("n", F.sum(known.cast("long")).over(w)).filter(F.col("har").isNotNull() & (F.col("n") >= max(50, 40)))

    def solve(pdfs):
        for pdf in pdfs:
            m, y = np.zeros((len(pdf), 4, 4)), np.zeros((len(pdf), 4, 1))
            for i, p in enumerate(names):
                y[:, i, 0] = pdf[f"s_{p}_target"]
                for j, q in enumerate(names[i:], i):
                    m[:, i, j] = m[:, j, i] = pdf[f"s_{p}_{q}"]
            b = np.linalg.solve(m + ridge * np.eye(4), y)[..., 0] if len(pdf) else np.zeros((0, 4))
            yield pd.DataFrame({"series_id": pdf["series_id"], "t": pdf["t"], "log_variance": (b * pdf[names].to_numpy(float)).sum(axis=1)})

    return d.select("series_id", "t", *names, *(f"s_{p}_{q}" for i, p in enumerate(names) for q in [*names[i:], "target"])).mapInPandas(solve, "series_id string, t long, log_variance double")


def bias_correct(forecasts: DataFrame, c: VolConfig) -> DataFrame:
    """log_variance plus log mean exp(target - forecast) over each fold's fit rows; only [a, b) is returned."""
    fit = forecasts.filter(F.col("target").isNotNull() & (F.col("t") >= c.warmup) & (F.col("t") < F.col("a") - c.h - 1))
    keys = [k for k in ("series_id", "fold", "model") if k in forecasts.columns]
    shift = fit.groupBy(*keys).agg(F.log(F.avg(F.exp(F.col("target") - F.col("log_variance")))).alias("shift"))
    return forecasts.filter("t >= a").join(shift, keys, "left").withColumn("log_variance", F.col("log_variance") + F.coalesce("shift", F.lit(0.0))).drop("shift")


def ewma_by_fold(data: DataFrame, bounds: DataFrame, c: VolConfig, halflives: tuple[float, ...] = HALFLIVES) -> DataFrame:
    """series_id, fold, t, log_variance by the half-life with the least mean QLIKE on each fold's fit rows (the first of
    equal ones, and where there are none).

    A half-life's variances do not depend on folds: they are made once a series, and folds add up losses."""
    names = [f"v{i}" for i in range(len(halflives))]
    made = along_series(
        data.select("series_id", "t", "r", "floor", "target", "realised"), dict.fromkeys(names, "double"),
        lambda p: {n: np.log(np.maximum(ewma_variance(p["r"].to_numpy(float), hl), p["floor"].to_numpy(float))) for n, hl in zip(names, halflives, strict=True)},
    )
    fit = with_folds(made, bounds).filter((F.col("t") >= c.warmup) & (F.col("t") < F.col("a") - c.h - 1) & F.col("target").isNotNull() & (F.col("realised") > 0))
    loss = lambda n: F.avg(F.col("realised") / F.exp(n) - F.log(F.col("realised") / F.exp(n)) - 1)
    tried = fit.groupBy("series_id", "fold").agg(F.array(*(F.struct(loss(n).alias("loss"), F.lit(i).alias("i")) for i, n in enumerate(names))).alias("tried"))
    chosen = tried.select("series_id", "fold", F.array_min("tried")["i"].alias("i"))
    out = with_folds(made, bounds).filter("t >= a").join(chosen, ["series_id", "fold"], "left")
    return out.select("series_id", "fold", "t", F.array(*names)[F.coalesce("i", F.lit(0))].alias("log_variance"))


def _garch(c: VolConfig):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        r, floor, t, a = pdf["r"].to_numpy(float), pdf["floor"].to_numpy(float), pdf["t"].to_numpy(), int(pdf["a"].iloc[0])
        g = fit_garch(r[fit_rows(t, a, c)])
        nxt, _ = garch_variance(r, g[0], g[1], g[2], g[3])
        out = t >= a
        return pd.DataFrame({"series_id": pdf["series_id"].to_numpy()[out], "fold": pdf["fold"].to_numpy()[out], "t": t[out], "model": "GARCH", "log_variance": np.log(np.maximum(garch_horizon(nxt, g, c.h), floor))[out]})

    return run


FORECASTS = "series_id string, fold int, t long, model string, log_variance double"


def walk_forward(data: DataFrame, analogue: DataFrame, bounds: DataFrame, c: VolConfig, halflives: tuple[float, ...] = HALFLIVES) -> DataFrame:
    """series_id, fold, t, model, log_variance of EWMA, GARCH, HAR, Analogue and Analogue+HAR out of sample.

    ``analogue`` (series_id, t, log_variance) does not depend on folds and is made once. The last three are
    corrected for bias on each fold's fit rows, the average after averaging.
    """
    garch = with_folds(data.select("series_id", "t", "r", "floor"), bounds).groupBy("series_id", "fold").applyInPandas(_garch(c), FORECASTS)
    simple = ewma_by_fold(data, bounds, c, halflives).select("series_id", "fold", "t", F.lit("EWMA").alias("model"), "log_variance").unionByName(garch)
    har = har_forecast(data, bounds, c)
    ana = with_folds(data.select("series_id", "t", "target").join(analogue.select("series_id", "t", "log_variance"), ["series_id", "t"]), bounds).select("series_id", "fold", "t", "a", "log_variance", "target")
    both = har.join(ana.select("series_id", "fold", "t", F.col("log_variance").alias("other")), ["series_id", "fold", "t"]).withColumn("log_variance", (F.col("log_variance") + F.col("other")) / 2).drop("other")
    named = har.withColumn("model", F.lit("HAR")).unionByName(ana.withColumn("model", F.lit("Analogue"))).unionByName(both.withColumn("model", F.lit("Analogue+HAR")))
    corrected = bias_correct(named, c).select("series_id", "fold", "t", "model", "log_variance")
    return simple.unionByName(corrected)


def gbm_forecast(data: DataFrame, fit_end: int, c: VolConfig, trees: int = 20, depth: int = 4, seed: int = 0) -> DataFrame:
    """Gradient boosted trees over all series at once, trained before ``fit_end``; a benchmark only, its
    trees are MLlib's."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    d = with_har(data, c).filter(F.col("har").isNotNull() & F.col("emb").isNotNull())
    names = [f"f{i}" for i in range(3 + c.m + 2)]
    values = [*(F.col("har")[i] for i in range(3)), *(F.col("emb")[i] for i in range(c.m)), F.col("state").cast("double"), F.log("long")]
    wide = VectorAssembler(inputCols=names, outputCol="features").transform(d.select("series_id", "t", "target", *(v.alias(n) for v, n in zip(values, names, strict=True))))
    fit = wide.filter(F.col("target").isNotNull() & (F.col("t") >= c.warmup) & (F.col("t") < fit_end - c.h - 1))
    model = GBTRegressor(labelCol="target", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed).fit(fit)
    return model.transform(wide.filter(F.col("t") >= fit_end)).select("series_id", "t", F.col("prediction").alias("log_variance"))


TAILS = "series_id string, fold int, t long, model string, p double"


def tail_forecasts(data: DataFrame, analogue: DataFrame, bounds: DataFrame, c: VolConfig, halflife: float = 20.0, window: int = 100) -> DataFrame:
    """Chances of a jump within h bars by five models, clipped to [.01, .99]."""

    def hawkes(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, a, event = pdf["t"].to_numpy(), int(pdf["a"].iloc[0]), pdf["jump"].to_numpy(bool)
        p = hawkes_probability(event, *fit_hawkes(event[(t >= c.warmup) & (t < a)]), c.h)
        return pdf[["series_id", "fold", "t"]].assign(model="Hawkes", p=p)[t >= a]

    x = with_ewma(data.select("series_id", "t", "r", "long", "jump", "tail"), halflife, "_s")
    x = x.withColumn("x", F.log(F.greatest(F.col("_s") * F.col("_s"), F.lit(1e-300))) - F.log("long")).withColumn("Poisson", W.poisson_probability(F.col("jump"), c.h, window))
    x = x.join(analogue.select("series_id", "t", F.col("tail_probability").alias("Analogue")), ["series_id", "t"], "left")
    rows = with_folds(x, bounds)
    fit = rows.filter((F.col("t") >= c.warmup) & (F.col("t") < F.col("a") - c.h - 1) & F.col("tail").isNotNull())
    fitted = fit.groupBy("series_id", "fold").agg(F.avg("tail").alias("Constant")).join(logistic_fits(fit, ["series_id", "fold"], "x", "tail"), ["series_id", "fold"], "left")
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.coalesce("w0", F.lit(0.0)) + F.coalesce("w1", F.lit(0.0)) * F.col("x")))
    out = rows.filter("t >= a").join(fitted, ["series_id", "fold"], "left").withColumn("Logistic-EWMA", 1 / (1 + F.exp(-z)))
    long = out.unpivot(["series_id", "fold", "t"], ["Constant", "Poisson", "Logistic-EWMA", "Analogue"], "model", "p")
    exciting = with_folds(data.select("series_id", "t", "jump"), bounds).groupBy("series_id", "fold").applyInPandas(hawkes, TAILS)
    clipped = F.when(F.col("p").isNotNull() & ~F.isnan("p"), F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("p"))))
    return long.unionByName(exciting).withColumn("p", clipped)


VAR = "series_id string, fold int, t long, model string, var double, es double"


def var_forecasts(data: DataFrame, bounds: DataFrame, c: VolConfig, alpha: float, hs_window: int = 250) -> DataFrame:
    """One-bar value at risk and expected shortfall by HS, GARCH-N, GARCH-t, FHS, Analogue and their Blend.

    The analogue's sample is what followed its neighbours (found once for all folds), standardised and scaled
    to the next bar's variance; row t forecasts bar t + 1.
    """
    y = F.array(F.lead("r").over(W.ordered()))
    near = neighbours(data.select("series_id", "t", "emb", y.alias("y"), "state"), replace(engine_of(c), delay=1, horizon=1, bandwidth=0.0), c.m, 1)
    lists = near.filter("weight > 0").groupBy("series_id", "t").agg(F.collect_list("anchor_t").alias("anchors"), F.collect_list("weight").alias("weights"))
    rows = data.select("series_id", "t", "r").join(lists, ["series_id", "t"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t").reset_index(drop=True)
        t, a, r = pdf["t"].to_numpy(), int(pdf["a"].iloc[0]), pdf["r"].to_numpy(float)
        fit = fit_rows(t, a, c)
        g = fit_garch(r[fit])
        nxt, _ = garch_variance(r, g[0], g[1], g[2], g[3])
        sd = np.sqrt(nxt)  # of the bar after
        z = r / np.r_[np.sqrt(g[3]), sd[:-1]]
        out = np.flatnonzero(t >= a)
        hs_q, hs_e = rolling_tail(r, hs_window, alpha) if len(r) >= hs_window else (np.full(len(r), np.nan),) * 2
        fhs_q, fhs_e = expanding_tail(z, max(1, c.warmup // 2), alpha)
        zn = NORMAL.inv_cdf(alpha)
        es_n = -np.exp(-zn * zn / 2) / np.sqrt(2 * np.pi) / alpha
        nu = fit_nu(z[fit])
        scale = np.sqrt((nu - 2) / nu)
        qt = student_ppf(alpha, nu)
        es_t = -float(np.exp(student_logpdf(qt, nu))) / alpha * (nu + qt * qt) / (nu - 1) * scale
        made: dict[str, list] = {m: [] for m in ("HS", "GARCH-N", "GARCH-t", "FHS", "Analogue", "Blend")}
        for i in out:
            fq, fe = fhs_q[i], fhs_e[i]
            aq = ae = np.nan
            if isinstance(pdf["anchors"].iloc[i], (list, np.ndarray)):
                j = np.asarray(pdf["anchors"].iloc[i], int)
                w = np.asarray(pdf["weights"].iloc[i], float)
                v = z[j + 1]
                o = np.argsort(v, kind="stable")
                cut = int(np.argmax(np.cumsum(w[o]) >= alpha * w.sum()))
                aq, ae = v[o][cut], float(np.average(v[o][: cut + 1], weights=w[o][: cut + 1]))
            s = sd[i]
            for m, q, e in (("HS", hs_q[i], hs_e[i]), ("GARCH-N", zn * s, es_n * s), ("GARCH-t", qt * scale * s, es_t * s), ("FHS", fq * s, fe * s), ("Analogue", aq * s, ae * s), ("Blend", (aq + fq) / 2 * s, (ae + fe) / 2 * s)):
                made[m].append((q, e))
        base = {"series_id": pdf["series_id"].to_numpy()[out], "fold": pdf["fold"].to_numpy()[out], "t": t[out]}
        return pd.concat([pd.DataFrame({**base, "model": m, "var": [x[0] for x in v], "es": [x[1] for x in v]}) for m, v in made.items()])

    return with_folds(rows, bounds).groupBy("series_id", "fold").applyInPandas(run, VAR)


def common_sample(forecasts: DataFrame, value: str, models: int) -> DataFrame:
    """Only bars for which every model has a value."""
    all_there = forecasts.filter(F.col(value).isNotNull()).groupBy("series_id", "t").agg(F.count_distinct("model").alias("n")).filter(F.col("n") == models).select("series_id", "t")
    return forecasts.join(all_there, ["series_id", "t"], "left_semi")


__all__ = ["FLOOR", "bias_correct", "common_sample", "gbm_forecast", "har_forecast", "rolling_har", "tail_forecasts", "var_forecasts", "walk_forward"]
