"""Reports over tables of results: pivots with a closing row, memberships, ranks, and comparisons of two runs.

A table of results is long: set, series_id, model and measures. All reports are aggregates over it; where a report
closes with a mean or a count over the series, grouping sets make those rows in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions.distributions import sign_test, signed_rank, t_test
from tidemark.functions.losses import holm

#: A model is in the set of the best where its p is at least this; a test decides below the other.
MEMBER, DECIDED = 0.1, 0.05


def wide(df: DataFrame, rows: Sequence[str], column: str, names: Sequence[str], value: str) -> DataFrame:
    """A column for each of ``names``, NULL where a row has none."""
    return df.groupBy(*rows).pivot(column, list(names)).agg(F.first(value))


def with_closing_rows(df: DataFrame, models: Sequence[str], ratio: str = "ratio", p: str = "mcs_p") -> DataFrame:
    """set, line and a column a model: every series' ratio, then ``mean`` (of the ratios) and ``members`` (how many
    series have the model among the best)."""
    each = df.groupingSets([["set", "series_id", "model"], ["set", "model"]], "set", "series_id", "model").agg(
        F.grouping("series_id").alias("_all"), F.avg(ratio).alias("_mean"), F.sum((F.col(p) >= MEMBER).cast("double")).alias("_members")
    )
    series = F.struct(F.col("series_id").alias("line"), F.col("_mean").alias("value"))
    closing = F.array(F.struct(F.lit("mean").alias("line"), F.col("_mean").alias("value")), F.struct(F.lit("members").alias("line"), F.col("_members").alias("value")))
    lines = each.select("set", "model", F.explode(F.when(F.col("_all") == 1, closing).otherwise(F.array(series))).alias("x")).select("set", "model", "x.*")
    return wide(lines, ["set", "line"], "model", models, "value")


def against_constant(df: DataFrame, constant: str = "Constant") -> DataFrame:
    """set, model: mean_ratio of the log loss to the constant's, mean_auc, in how many series a model is best, and in
    how many worse than the constant. df(set, series_id, model, log_loss, auc)."""
    base = df.filter(F.col("model") == constant).select("set", "series_id", F.col("log_loss").alias("_base"))
    best = df.groupBy("set", "series_id").agg(F.min_by("model", F.struct("log_loss", "model")).alias("_best"))
    x = df.join(base, ["set", "series_id"]).join(best, ["set", "series_id"])
    return x.groupBy("set", "model").agg(
        F.avg(F.col("log_loss") / F.col("_base")).alias("mean_ratio"), F.avg("auc").alias("mean_auc"),
        F.sum((F.col("_best") == F.col("model")).cast("long")).alias("best"), F.sum((F.col("log_loss") > F.col("_base")).cast("long")).alias("worse"),
    )


def coverage(df: DataFrame) -> DataFrame:
    """set, model: mean distance of the hit rate from its level, shares of passed tests and memberships, and the mean rank
    of the joint loss. df(set, series_id, alpha, model, hit_rate, p_uc, p_cc, fz0, mcs_p)."""
    rank = F.rank().over(Window.partitionBy("set", "series_id", "alpha").orderBy("fz0")) + (F.count(F.lit(1)).over(Window.partitionBy("set", "series_id", "alpha", "fz0")) - 1) / 2
    share = lambda c: F.avg(c.cast("double"))
    return df.withColumn("_rank", rank).groupBy("set", "model").agg(
        F.avg(F.abs(F.col("hit_rate") - 1)).alias("mean_error"), share(F.col("p_uc") > DECIDED).alias("kupiec_pass"), share(F.col("p_cc") > DECIDED).alias("cc_pass"),
        F.avg("_rank").alias("mean_rank"), share(F.col("mcs_p") >= MEMBER).alias("member_share"),
    )


def ratio_tests(df: DataFrame, base: str) -> DataFrame:
    """set, model, series, median_ratio, w_plus and p: do the log ratios of a model's loss to the base's differ from 0?
    df(set, series_id, model, qlike)."""
    own = df.filter(F.col("model") == base).select("set", "series_id", F.col("qlike").alias("_base"))
    x = df.filter(F.col("model") != base).join(own, ["set", "series_id"]).withColumn("_x", F.log(F.col("qlike") / F.col("_base")))
    middle = x.groupBy("set", "model").agg(F.count("_x").alias("series"), F.exp(F.percentile("_x", F.lit(0.5))).alias("median_ratio"))
    return middle.join(signed_rank(x, ["set", "model"], "_x"), ["set", "model"], "left").select("set", "model", "series", "median_ratio", "w_plus", "p")


def side_by_side(tests: DataFrame, first: str, second: str) -> DataFrame:
    """id, statistic and p of two sets of series, joined by id, with the second set's p adjusted for all its tests."""
    own = lambda name: tests.filter(F.col("set") == name)
    a = own(first).select("id", F.col("statistic").alias("first_statistic"), F.col("p").alias("first_p"))
    b = holm(own(second).withColumn("_p", F.coalesce("p", F.lit(1.0))), "_p").select("id", F.col("statistic").alias("second_statistic"), F.col("p").alias("second_p"), F.col("holm").alias("second_holm"))
    return b.join(a, "id").select("id", "first_statistic", "first_p", "second_statistic", "second_p", "second_holm")


def changed_values(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, side (both, before, after), both values and their change; what only one run has is kept, without a change."""
    a, b = before.select(*keys, F.col(value).alias("before"), F.lit(1).alias("_a")), after.select(*keys, F.col(value).alias("after"), F.lit(1).alias("_b"))
    side = F.when(F.col("_b").isNull(), "before").when(F.col("_a").isNull(), "after").otherwise("both")
    return a.join(b, list(keys), "full_outer").select(*keys, side.alias("side"), "before", "after", (F.col("after") - F.col("before")).alias("change"))


def changed_verdicts(before: DataFrame, after: DataFrame, keys: Sequence[str], by: Sequence[str], value: str, verdict: Column) -> DataFrame:
    """Per group: cases that both runs have, how many each finds, how many verdicts changed, and how many rows only one
    run has. ``verdict`` is a condition on ``value``; rows without a value are no cases."""
    own = lambda df: df.filter(F.col(value).isNotNull()).select(*keys, verdict.alias("v"))
    a, b = own(before), own(after)
    met = a.withColumnRenamed("v", "va").join(b.withColumnRenamed("v", "vb"), list(keys))
    many = lambda c: F.sum(c.cast("long"))
    counted = met.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), many(F.col("va")).alias("found_before"), many(F.col("vb")).alias("found_after"), many(F.col("va") != F.col("vb")).alias("changed"))
    lone = lambda x, y, name: x.join(y, list(keys), "left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    out = counted.join(lone(a, b, "only_before"), list(by), "full_outer").join(lone(b, a, "only_after"), list(by), "full_outer")
    return out.select(*by, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("cases", "found_before", "found_after", "changed", "only_before", "only_after")))


def significance(df: DataFrame, tests: DataFrame, base: str) -> DataFrame:
    """set, model: median ratio, memberships, tests won and lost against the base, and the signed-rank p of the ratios.
    df(set, series_id, model, qlike, ratio, mcs_p), tests(set, series_id, model, dm, p)."""
    counts = df.filter(F.col("model") != base).groupBy("set", "model").agg(F.percentile("ratio", F.lit(0.5)).alias("median_ratio"), F.sum((F.col("mcs_p") >= MEMBER).cast("long")).alias("members"))
    sure = F.col("p") < DECIDED
    won = tests.groupBy("set", "model").agg(F.sum((sure & (F.col("dm") > 0)).cast("long")).alias("better"), F.sum((sure & (F.col("dm") < 0)).cast("long")).alias("worse"))
    ranked = ratio_tests(df, base).select("set", "model", "p")
    return counts.join(won, ["set", "model"], "left").join(ranked, ["set", "model"], "left")


#: Which test each hypothesis takes, and what its statistic is.
TESTS = {"H1": "mean", "H2": "two-sided", "H3": "two-sided", "H4": "less", "H5": "two-sided", "H6": "less", "H7": "difference", "H8": "sign"}


def hypothesis_table(samples: DataFrame) -> DataFrame:
    """id, test, series, statistic, p and holm of the eight hypotheses; samples(id, series_id, x), a value a series.

    mean: is the mean 0 (t test; the statistic is the mean). two-sided and less: signed ranks of log ratios (the median
    ratio). difference: signed ranks of differences (the median). sign: how many are above 0 (their number). A test
    that too few series leave open has p NULL and counts as 1 for the others."""
    kind = F.create_map(*(F.lit(v) for pair in TESTS.items() for v in pair))
    x = samples.filter(F.col("x").isNotNull() & ~F.isnan("x")).withColumn("test", kind[F.col("id")])
    t = t_test(x.filter("test = 'mean'"), ["id", "test"], "x").select("id", "test", F.col("n").alias("series"), F.col("mean").alias("statistic"), "p")
    s = x.filter("test = 'sign'").groupBy("id", "test").agg(F.count(F.lit(1)).alias("series"), F.sum((F.col("x") > 0).cast("long")).alias("wins"))
    s = s.select("id", "test", "series", F.col("wins").cast("double").alias("statistic"), sign_test(F.col("wins"), F.col("series")).alias("p"))
    rest = x.filter("test NOT IN ('mean', 'sign')")
    middle = rest.groupBy("id", "test").agg(F.count(F.lit(1)).alias("series"), F.percentile("x", F.lit(0.5)).alias("_m"))
    ranked = signed_rank(rest, ["id"], "x").select("id", F.col("p").alias("_two"), "p_less")
    w = middle.join(ranked, "id", "left").select("id", "test", "series", F.when(F.col("test") == "difference", F.col("_m")).otherwise(F.exp("_m")).alias("statistic"), F.when(F.col("test") == "less", F.col("p_less")).otherwise(F.col("_two")).alias("p"))
    every = t.unionByName(s).unionByName(w).withColumn("_p", F.coalesce("p", F.lit(1.0)))
    return holm(every, "_p").select("id", "test", "series", "statistic", "p", "holm")
