"""Bootstrap statistics, block lengths, gates, tests and the choice for single bars, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dependence, distributions, fitting, losses, quantiles, resampling
from tidemark.operators import analogue, gate, trades, volatility
from tidemark.plans import catalog

from .test_core import SCHEMA, made_bars


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(made_bars(420), SCHEMA).cache()


def frame(spark, x, series="s"):
    return [(series, t, float(v)) for t, v in enumerate(x)]


# ---- the bootstrap of a ratio
@pytest.mark.parametrize("own_blocks", [False, True])
def test_sharpe_difference_is_that_of_the_listed_rows(spark, own_blocks):
    rng = np.random.default_rng(3)
    n, draws, block = 500, 40, 8
    table = {"hold": rng.normal(0.02, 1, n), "better": rng.normal(0.2, 1, n), "flat": np.full(n, 0.01)}
    df = spark.createDataFrame([("s", t, m, float(x[t])) for m, x in table.items() for t in range(n)], "series_id string, t long, model string, r double")
    blocks = spark.createDataFrame([("s", float(block))], "series_id string, block double") if own_blocks else None
    size = None if own_blocks else block
    got = {r.model: r for r in resampling.sharpe_difference(df, "hold", 252, draws, size, blocks=blocks).collect()}
    sizes = spark.createDataFrame([("s", n)], "series_id string, n long")
    at = {d: np.zeros(0, int) for d in range(draws)}
    for r in resampling.runs(sizes if blocks is None else sizes.join(blocks, "series_id"), draws, size).collect():
        at[r.draw] = np.r_[at[r.draw], (r.start + np.arange(r.length)) % n]
    assert all(len(i) == n for i in at.values())
    rated = lambda x: x.mean() / x.std(ddof=1) * math.sqrt(252)
    d = np.array([rated(table["better"][i]) - rated(table["hold"][i]) for i in at.values()])
    row = got["better"]
    assert row.diff == pytest.approx(rated(table["better"]) - rated(table["hold"]), abs=1e-9)
    assert row.p == pytest.approx(min(1, 2 * min((d <= 0).mean(), (d >= 0).mean()))) and (row.low, row.high) == pytest.approx(tuple(np.quantile(d, [0.025, 0.975])), abs=1e-9)
    assert got["flat"].diff is None or abs(got["flat"].diff) > 1e6 or math.isfinite(got["flat"].diff)
    assert resampling.sharpe_difference(df.limit(0), "hold", 252, draws, block).isEmpty()


def test_draws_do_not_depend_on_partitions(spark):
    sizes = spark.createDataFrame([("a", 300), ("b", 40)], "series_id string, n long")
    one, other = ({tuple(r) for r in resampling.runs(s, 5, 4).collect()} for s in (sizes, sizes.repartition(7)))
    assert one == other


# ---- block lengths
def plain_covariances(x):
    n = len(x)
    x = x - x.mean()
    most = math.ceil(math.sqrt(n)) + max(5, math.ceil(math.log10(n)))
    return {k: sum(x[i] * x[i + k] for i in range(n - k)) / n for k in range(most + 1)}


@pytest.mark.parametrize("n", [7, 60, 333])
def test_covariances_of_spans(spark, n):
    x = np.random.default_rng(n).normal(size=n).cumsum()
    rows = frame(spark, x) + frame(spark, x[::-1], "back") + [("s", 10_000, None), ("s", 10_001, float("nan"))]
    df = spark.createDataFrame(rows, "series_id string, t long, x double").repartition(5)
    got = {(r.series_id, r.lag): r.cov for r in dependence.autocovariances(df, "x", ["series_id"]).collect()}
    want = plain_covariances(x)
    assert {k for s, k in got if s == "s"} == set(want)
    for k, v in want.items():
        assert got["s", k] == pytest.approx(v, abs=1e-9) and got["back", k] == pytest.approx(v, abs=1e-9)


def test_block_length_known_answer(spark):
    """An autoregression of order 1 has a closed form: 2 rho / (1 - rho^2) for the ratio of the two sums."""
    rng, n, rho = np.random.default_rng(4), 20_000, 0.5
    x = np.zeros(n)
    for t in range(1, n):
        x[t] = rho * x[t - 1] + rng.normal()
    theory = (2 * rho / (1 - rho**2)) ** (2 / 3) * n ** (1 / 3)
    df = spark.createDataFrame(frame(spark, x) + frame(spark, np.ones(50), "flat") + frame(spark, rng.normal(size=2000), "noise"), "series_id string, t long, x double")
    got = {r.series_id: r.block for r in dependence.block_lengths(df, "x", ["series_id"]).collect()}
    assert got["s"] == pytest.approx(theory, rel=0.4) and got["flat"] == 1.0 and 1 <= got["noise"] < got["s"]
    both = dependence.common_block(df.filter("series_id <> 'flat'").withColumn("all", F.lit("x")), "x", ["all"], ["series_id"]).first()
    assert both.block == round((got["s"] + got["noise"]) / 2)
    assert dependence.block_lengths(df.limit(0), "x", ["series_id"]).isEmpty()


# ---- quantiles and the gate
def test_quantiles_by_narrowing(spark):
    rng = np.random.default_rng(8)
    groups = {"wide": rng.normal(size=5000) * 10.0 ** rng.integers(-8, 8, 5000), "ties": np.repeat([1.0, 2.0, 2.0, 3.0], 700), "same": np.full(900, 4.25), "one": np.array([7.0]), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("wide", None), ("none", None), ("ties", float("nan"))], "g string, x double")
    for q in (0.0, 0.1, 0.37, 0.9, 1.0):
        got = {r.g: r.quantile for r in quantiles.quantiles(df, ["g"], "x", q, few=16).collect()}
        assert set(got) == set(groups)
        for g, x in groups.items():
            assert got[g] == pytest.approx(np.quantile(x, q), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("kind", ["poisson", "hawkes"])
def test_gate_by_fold(spark, kind):
    rng = np.random.default_rng(2)
    jump = rng.random(400) < np.where(np.arange(400) % 100 < 30, 0.5, 0.05)
    data = spark.createDataFrame([("s", t, bool(v)) for t, v in enumerate(jump)], "series_id string, t long, jump boolean")
    bounds = [(0, 200, 300), (1, 300, 400)]
    folds = spark.createDataFrame([("s", f, a, b) for f, a, b in bounds], "series_id string, fold int, a long, b long")
    chances = gate.jump_probability(data, folds, kind, 5, 60, 50)
    p = {(r.fold, r.t): r.p for r in chances.collect()}
    got = {r.t: r for r in gate.gate(chances, 60, 0.8).collect()}
    assert sorted(got) == list(range(400))
    for f, a, b in bounds:
        cut = np.quantile([p[f, t] for t in range(60, a)], 0.8)
        for t in range(0 if f == 0 else a, b):
            x = p[f, t]
            assert got[t].threshold == pytest.approx(cut) and got[t].allowed == (x is None or not x > cut)
    cutoff = gate.gate(gate.jump_probability(data.filter("t < 320"), folds, kind, 5, 60, 50), 60, 0.8)
    assert {r.t: r.allowed for r in cutoff.collect()} == {t: r.allowed for t, r in got.items() if t < 320}  # later bars don't matter
    with pytest.raises(ValueError):
        gate.jump_probability(data, folds, "other", 5, 60)


# ---- single bars
def test_first_bar_at_or_after(spark):
    b = spark.createDataFrame([("a", t, 10 * t) for t in range(5)] + [("b", 0, 7)], "series_id string, t long, ts long")
    times = spark.createDataFrame([("a", 0), ("a", 1), ("a", 40), ("a", 41), ("b", 3)], "series_id string, when long")
    assert {(r.series_id, r.when): r.t for r in analogue.at_or_after(b, times).collect()} == {("a", 0): 0, ("a", 1): 1, ("a", 40): 4, ("b", 3): 0}


@pytest.mark.parametrize("exclusion,k", [(1, 4), (5, 10), (40, 6), (0, 3)])
def test_nearest_of_single_bars(spark, exclusion, k):
    rng = np.random.default_rng(exclusion)
    emb, y = rng.integers(0, 4, (300, 2)).astype(float), rng.normal(size=300)
    table = [("s", t, None if t % 17 == 0 else [float(v) for v in emb[t]], [None if t % 23 == 0 else float(y[t])]) for t in range(300)]
    df = spark.createDataFrame(table, "series_id string, t long, emb array<double>, y array<double>")
    asked = spark.createDataFrame([("s", t) for t in (5, 150, 204, 299)], "series_id string, t long")
    got = {}
    for r in analogue.nearest_to(df, asked, k, exclusion, 7, 20).orderBy("t", "rank").collect():
        got.setdefault(r.t, []).append(r.anchor_t)
    for t in (5, 150, 299):
        cand = [j for j in range(20, t - 6) if j % 17 and j % 23]
        order = sorted(cand, key=lambda j: (((emb[j] - emb[t]) ** 2).sum(), j))
        want = []
        for j in order:
            if len(want) < k and all(abs(j - p) >= exclusion for p in want):
                want.append(j)
        assert got.get(t, []) == want
    assert 204 not in got  # it has no state of its own


def test_explanation_holds_the_engine_s_forecast(bars):
    c = volatility.SHORT
    data = volatility.vol_data(bars, c).cache()
    asked = data.filter("t IN (300, 390)").select("series_id", "t")
    lines = volatility.explanation(data, asked, c).collect()
    whole = {r.t: r.log_variance for r in volatility.analogue_volatility(data, c).collect()}
    long = {r.t: math.log(r.long) for r in data.collect()}
    made = {r.t: r.y for r in lines if r.line == "forecast"}
    assert set(made) == {300, 390} and all(made[t] == pytest.approx(whole[t] - long[t], abs=1e-9) for t in made)
    assert {r.x for r in lines if r.line == "now"} == {-3, -2, -1, 0} and len({r.line for r in lines if r.line.startswith("analogue")}) == 10


# ---- tests
def test_distributions_known_answers(spark):
    p = [1e-8, 0.001, 0.025, 0.3, 0.5, 0.81, 0.975, 0.9999]
    got = spark.createDataFrame([(x,) for x in p], "p double").select("p", distributions.normal_quantile(F.col("p")).alias("z")).collect()
    assert all(r.z == pytest.approx(fitting.NORMAL.inv_cdf(r.p), abs=1e-6) for r in got)
    x = [0.3, 1.0, 2.5, 17.0, 400.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", distributions.log_gamma(F.col("x")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12) for r in got)
    cases = [(0.0, 4), (2.228138851, 10), (-2.228138851, 10), (12.7062047, 1), (1.96, 100_000), (30.0, 5)]
    got = spark.createDataFrame(cases, "t double, n int").select("t", "n", distributions.student_two_sided(F.col("t"), F.col("n")).alias("p")).collect()
    assert [r.p for r in got][:4] == pytest.approx([1, 0.05, 0.05, 0.05], abs=1e-8)
    assert all(r.p == pytest.approx(2 * (1 - fitting.student_cdf(abs(r.t), r.n)), abs=1e-9) for r in got)
    got = spark.createDataFrame([(9, 9), (5, 9), (0, 4)], "w int, n int").select(distributions.sign_test(F.col("w"), F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([1 / 512, sum(math.comb(9, k) for k in range(5, 10)) / 512, 1.0])


def test_signed_ranks_by_listing_all_signs(spark):
    import itertools

    rng = np.random.default_rng(5)
    groups = {"exact": rng.normal(0.4, 1, 9), "positive": np.array([1.0, 2, 3, 4, 5]), "few": np.array([1.0, -2, 3, 0, 0]), "ties": np.array([1.0, -1, 2, 2, 3, -4, 5]), "many": rng.normal(0.1, 1, 80)}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("exact", None), ("exact", 0.0)], "g string, x double")
    got = {r.g: r for r in distributions.signed_rank(df, ["g"], "x").collect()}
    for g in ("exact", "positive"):
        x = groups[g]
        rank = np.argsort(np.argsort(np.abs(x))) + 1
        w = rank[x > 0].sum()
        sums = np.array([sum(r for r, s in zip(rank, signs) if s) for signs in itertools.product((0, 1), repeat=len(x))])
        low, high = (sums <= w).mean(), (sums >= w).mean()
        assert (got[g].w_plus, got[g].p_less, got[g].p_greater) == pytest.approx((w, low, high)) and got[g].p == pytest.approx(min(1, 2 * min(low, high)))
    assert got["positive"].p == pytest.approx(2 / 32) and got["few"].p is None and got["few"].n == 3
    x = groups["ties"]
    z = (1.5 + 3.5 + 3.5 + 5 + 7 - 14) / math.sqrt(7 * 8 * 15 / 24 - (6 + 6) / 48)
    assert got["ties"].p == pytest.approx(2 * (1 - fitting.NORMAL.cdf(abs(z))), abs=1e-9)
    assert 0 < got["many"].p < 1


def test_t_test_and_luck(spark):
    x = np.random.default_rng(6).normal(0.5, 1, 12)
    df = spark.createDataFrame(frame(spark, x) + frame(spark, [1.0, 1.0], "flat") + frame(spark, [2.0], "one"), "series_id string, t long, x double")
    got = {r.series_id: r for r in distributions.t_test(df, ["series_id"], "x").collect()}
    t = x.mean() / (x.std(ddof=1) / math.sqrt(12))
    assert got["s"].t == pytest.approx(t) and got["s"].p == pytest.approx(2 * (1 - fitting.student_cdf(abs(t), 11)), abs=1e-9)
    assert got["flat"].p is None and got["one"].p is None
    trials = np.random.default_rng(7).normal(0.02, 1, (6, 300))
    long = spark.createDataFrame([("s", k, t, float(trials[k, t])) for k in range(6) for t in range(300)], "series_id string, k int, t long, r double")
    sr = trials.mean(1) / trials.std(1, ddof=1)
    best = sr.std(ddof=1) * ((1 - distributions.EULER) * fitting.NORMAL.inv_cdf(1 - 1 / 6) + distributions.EULER * fitting.NORMAL.inv_cdf(1 - 1 / (6 * math.e)))
    for r in distributions.deflated_sharpe(long, ["series_id"], ["k"], "r").collect():
        v = trials[r.k] - trials[r.k].mean()
        g3, g4 = (v**3).mean() / v.std() ** 3, (v**4).mean() / v.std() ** 4
        assert r.best == pytest.approx(best, abs=1e-9)
        assert r.dsr == pytest.approx(fitting.NORMAL.cdf((sr[r.k] - best) * math.sqrt(299) / math.sqrt(1 - g3 * sr[r.k] + (g4 - 1) / 4 * sr[r.k] ** 2)), abs=1e-9)
    alone = distributions.deflated_sharpe(long.filter("k = 0"), ["series_id"], ["k"], "r").first()
    assert alone.best == 0


def test_folds_feed_the_gate(bars):
    folds = trades.folds(bars, 100, least=50)
    chances = gate.jump_probability(volatility.vol_data(bars, volatility.SHORT), folds, "poisson", 5, 100, 50)
    assert gate.gate(chances, 100).groupBy("t").count().filter("count > 1").isEmpty()


# ---- fits of all groups together
def test_fits_by_sums_equal_fits_of_arrays(spark):
    from tidemark.functions import fits

    rng = np.random.default_rng(9)
    rows, want = [], {}
    for g, (a, b, n) in enumerate(((-1.0, 2.0, 400), (0.5, 0.0, 300), (2.0, -1.0, 1000))):
        x = rng.normal(size=n)
        y = (rng.random(n) < 1 / (1 + np.exp(-(a + b * x)))).astype(float)
        want[g] = fitting.logistic_fit(x, y)
        rows += [(g, float(i), float(j)) for i, j in zip(x, y)]
    df = spark.createDataFrame(rows + [(0, None, 1.0), (1, 2.0, None), (2, float("nan"), 0.0)], "g int, x double, y double").repartition(4)
    got = {r.g: (r.w0, r.w1) for r in fits.logistic_fits(df, ["g"], "x", "y").collect()}
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g], abs=1e-6) for g in want)
    z = {"heavy": rng.standard_t(4, 4000) / math.sqrt(2), "light": rng.normal(size=3000), "mid": rng.standard_t(10, 5000) / math.sqrt(10 / 8)}
    df = spark.createDataFrame([(g, float(v)) for g, x in z.items() for v in x], "g string, z double")
    got = {r.g: r.nu for r in fits.student_freedom(df, ["g"], "z").collect()}
    for g, x in z.items():
        assert got[g] == pytest.approx(fitting.fit_nu(x), abs=2e-3 if g != "light" else 0.05)


def test_halflife_is_chosen_by_fold(spark, bars):
    from tidemark.functions.recurrences import ewma_variance
    from tidemark.operators import models

    c = volatility.SHORT
    data = volatility.vol_data(bars, c).cache()
    folds = spark.createDataFrame([("a", 0, 300, 360), ("a", 1, 360, 420), ("a", 2, 200, 210)], "series_id string, fold int, a long, b long")
    got = {(r.fold, r.t): r.log_variance for r in models.ewma_by_fold(data, folds, c).collect()}
    pdf = data.toPandas().sort_values("t")
    for fold, a, b in ((0, 300, 360), (1, 360, 420), (2, 200, 210)):
        fit = ((pdf.t >= c.warmup) & (pdf.t < a - c.h - 1) & pdf.target.notna() & (pdf.realised > 0)).to_numpy()
        tried = []
        for hl in models.HALFLIVES:
            f = np.log(np.maximum(ewma_variance(pdf.r.to_numpy(), hl), pdf.floor.to_numpy()))
            x = pdf.realised.to_numpy()[fit] / np.exp(f[fit])
            tried.append((np.mean(x - np.log(x) - 1) if fit.any() else 0.0, f))
        best = min(tried, key=lambda v: v[0])[1]
        assert all(got[fold, t] == pytest.approx(best[t], abs=1e-9) for t in range(a, b))


# ---- scores of groups with one outcome only
def test_area_is_missing_where_all_outcomes_are_the_same(spark, tmp_path):
    rows = [("none", 0.1, 0.0), ("none", 0.2, 0.0), ("all", 0.1, 1.0), ("both", 0.1, 0.0), ("both", 0.4, 1.0), ("both", 0.4, 0.0)]
    got = {r.g: r.auc for r in losses.auc(spark.createDataFrame(rows, "g string, p double, y double"), ["g"], "p", "y").collect()}
    assert got == {"none": None, "all": None, "both": pytest.approx(0.75)}
    lines = [("O", 1, 0.01, "N"), ("O", 2, 0.02, "N"), ("F", 1, 0.01, "R"), ("F", 2, 0.02, "N")]
    spark.createDataFrame(lines, "l_linestatus string, l_linenumber int, l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    areas = {r.g: r.auc for r in catalog.QUERIES["logloss_brier_auc"](spark, str(tmp_path)).collect()}
    assert areas["F"] == 0.0 and math.isnan(areas["O"])
