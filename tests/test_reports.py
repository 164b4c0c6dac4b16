"""Reports over small tables of results, by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import reports as Q
from tidemark.plans import studies

SCORES = "set string, series_id string, model string, qlike double, ratio double, mcs_p double"


@pytest.fixture(scope="module")
def scores(spark):
    rows = [("a", f"s{i}", m, q, q / 2.0, p) for i in range(6) for m, q, p in (("base", 2.0, 1.0), ("x", 1.0 + i / 5, 0.05 * i), ("y", 3.0 + i, 0.01))]
    return spark.createDataFrame(rows + [("b", "s0", "base", 1.0, 1.0, 1.0)], SCORES)


def test_closing_rows(scores):
    got = {(r.set, r.line): r for r in Q.with_closing_rows(scores, ["base", "x", "y"]).collect()}
    assert len(got) == 6 + 2 + 1 + 2
    assert got["a", "s3"].x == pytest.approx(0.8) and got["a", "mean"].x == pytest.approx(np.mean([(1 + i / 5) / 2 for i in range(6)]))
    assert (got["a", "members"].base, got["a", "members"].x, got["a", "members"].y) == (6, 4, 0) and got["b", "mean"].x is None


def test_ratio_tests_and_significance(spark, scores):
    got = {(r.set, r.model): r for r in Q.ratio_tests(scores, "base").collect()}
    assert set(got) == {("a", "x"), ("a", "y")} and got["a", "y"].p == pytest.approx(2 / 64) and got["a", "y"].median_ratio == pytest.approx(math.sqrt(2.5 * 3))
    tests = spark.createDataFrame([("a", f"s{i}", "x", (-1.0) ** i * 3, 0.01 * i) for i in range(6)], "set string, series_id string, model string, dm double, p double")
    row = {r.model: r for r in Q.significance(scores, tests, "base").collect()}
    assert (row["x"].better, row["x"].worse, row["x"].members) == (3, 2, 4) and row["y"].better is None


def test_two_runs_side_by_side(spark):
    keyed = lambda rows: spark.createDataFrame(rows, "set string, series_id string, model string, p double")
    before = keyed([("a", "s0", "m", 0.2), ("a", "s1", "m", 0.01), ("a", "s2", "m", None), ("a", "s3", "m", 0.5), ("b", "s0", "m", 0.5)])
    after = keyed([("a", "s0", "m", 0.05), ("a", "s1", "m", 0.02), ("a", "s2", "m", 0.3), ("c", "s9", "m", 0.5)])
    out = {r.set: tuple(r)[1:] for r in Q.changed_verdicts(before, after, ["set", "series_id", "model"], ["set"], "p", F.col("p") >= 0.1).collect()}
    assert out == {"a": (2, 1, 0, 1, 1, 1), "b": (0, 0, 0, 0, 1, 0), "c": (0, 0, 0, 0, 0, 1)}
    changes = {(r.set, r.series_id): (r.side, r.change) for r in Q.changed_values(before, after, ["set", "series_id", "model"], "p").collect()}
    assert changes["a", "s0"] == ("both", pytest.approx(-0.15)) and changes["b", "s0"] == ("before", None) and changes["c", "s9"] == ("after", None)
    tests = spark.createDataFrame([("d", "H1", 1.0, 0.5), ("d", "H2", 2.0, 0.4), ("c", "H1", 3.0, 0.01), ("c", "H2", 4.0, None)], "set string, id string, statistic double, p double")
    joined = {r.id: r for r in Q.side_by_side(tests, "d", "c").collect()}
    assert joined["H1"].second_holm == pytest.approx(0.02) and joined["H2"].second_p is None and joined["H2"].second_holm == 1.0


def test_tails_and_coverage(spark):
    t = spark.createDataFrame([("a", s, m, v, 0.6) for s, x in (("s0", (1.0, 0.5, 2.0)), ("s1", (1.0, 1.0, 0.9))) for m, v in zip(("Constant", "P", "H"), x)], "set string, series_id string, model string, log_loss double, auc double")
    got = {r.model: r for r in Q.against_constant(t).collect()}
    assert got["P"].mean_ratio == pytest.approx(0.75) and (got["P"].best, got["H"].best, got["H"].worse, got["Constant"].best) == (1, 1, 1, 0)
    v = spark.createDataFrame([("a", "s", 0.05, m, h, 0.2, 0.01, f, p) for m, h, f, p in (("A", 1.5, 1.0, 1.0), ("B", 0.5, 1.0, 0.2), ("C", 1.0, 2.0, 0.05))], "set string, series_id string, alpha double, model string, hit_rate double, p_uc double, p_cc double, fz0 double, mcs_p double")
    got = {r.model: r for r in Q.coverage(v).collect()}
    assert got["A"].mean_rank == got["B"].mean_rank == 1.5 and got["C"].mean_rank == 3 and got["B"].mean_error == pytest.approx(0.5)
    assert (got["A"].kupiec_pass, got["A"].cc_pass, got["C"].member_share) == (1, 0, 0)


def test_eight_hypotheses(spark):
    rng = np.random.default_rng(0)
    rows = [(f"H{h}", f"s{i}", float(rng.normal(-1, 0.2))) for h in range(1, 9) for i in range(7)] + [("H2", "s9", None)]
    got = {r.id: r for r in Q.hypothesis_table(spark.createDataFrame(rows, "id string, series_id string, x double")).collect()}
    assert sorted(got) == [f"H{h}" for h in range(1, 9)] and all(r.series == 7 for r in got.values())
    assert got["H4"].p == pytest.approx(1 / 128) and got["H2"].p == pytest.approx(2 / 128) and got["H8"].p == pytest.approx(1.0) and got["H8"].statistic == 0
    p = sorted(r.p for r in got.values())
    adjusted, top = [], 0.0
    for i, v in enumerate(p):
        top = max(top, min(1.0, (8 - i) * v))
        adjusted.append(top)
    assert sorted(r.holm for r in got.values()) == pytest.approx(adjusted)
    few = Q.hypothesis_table(spark.createDataFrame(rows[7:10], "id string, series_id string, x double")).first()
    assert few.p is None and few.holm == 1.0


def test_overlay_table(spark):
    rng = np.random.default_rng(3)
    data = spark.createDataFrame([("s", t, 100 + 5 * math.sin(t / 9), float(rng.normal(0, 0.02))) for t in range(500)], "series_id string, t long, close double, r double")
    made = spark.createDataFrame([("s", t, m, math.log(0.0004) + k / 10) for t in range(355, 500) for k, m in enumerate(studies.TARGETS)], "series_id string, t long, model string, log_variance double")
    gated = spark.createDataFrame([("s", t, t % 2 == 0) for t in range(500)], "series_id string, t long, gate boolean")
    returns = studies.overlay_returns(data, made, 355, gated)
    assert returns.groupBy("model").count().collect() and {r["count"] for r in returns.groupBy("model").count().collect()} == {145}
    table = {r.strategy: r for r in studies.overlay_table(returns, 252, 50, 10).collect()}
    assert len(table) == 8 and table["Buy & hold"].diff is None and all(0 <= r.p <= 1 for s, r in table.items() if s != "Buy & hold")
    assert table["Vol target: Analogue+HAR + gate"].exposure < table["Vol target: Analogue+HAR"].exposure
