"""The studies as pipelines over any set of series, and the reports made of their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import losses as L
from tidemark.functions import resampling as S
from tidemark.functions import windows as W
from tidemark.operators import gate as G
from tidemark.operators import models as M
from tidemark.operators import reports as Q
from tidemark.operators import trades as B
from tidemark.operators import volatility as V

from . import tables as T
from .bars_queries import C, _data, six
from .registry import Registry
from .trade_queries import _analogue, _direction, _folds, _losses, _walked, against_har

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles



@query()
def e1_direction_skill(spark, d):
    """Rank correlation of forecast and realised outcomes, and Brier skill of the up forecast."""
    bars, lab, made = _direction(spark, d)
    start = B.folds(bars, 250, least=100).groupBy("series_id").agg(F.min("a").alias("cal"))
    all_ = lab.join(start, "series_id").join(made, ["series_id", "t"], "left")
    x = all_.filter("t >= cal AND r_long IS NOT NULL AND mean_0 IS NOT NULL")
    ic = L.spearman(x, ["series_id"], "mean_0", "r_long").withColumnRenamed("ic", "ic_long").join(L.spearman(x, ["series_id"], "mean_1", "r_short").withColumnRenamed("ic", "ic_short"), "series_id")
    scored = (F.col("t") >= F.col("cal")) & F.col("r_long").isNotNull() & F.col("mean_0").isNotNull()
    skill = L.brier_skill(all_, ["series_id"], "mean_2", "up", (F.col("t") >= 250) & (F.col("t") < F.col("cal")), scored)
    return ic.join(skill.withColumnRenamed("skill", "brier_skill"), "series_id", "left")


def volatility_table(losses: DataFrame, models: int, draws: int) -> DataFrame:
    """QLIKE, its ratio to HAR's, the mean squared error of logs, p of the confidence set and of the test against HAR, per
    series and model. losses(series_id, t, model, loss, realised, long, log_variance)."""
    target = F.log(F.greatest(F.col("realised"), V.FLOOR * F.col("long")))
    logs = losses.groupBy("series_id", "model").agg(F.avg((target - F.col("log_variance")) ** 2).alias("log_mse"))
    chosen = S.confidence_set(losses, models, draws, 20)
    har = losses.filter("model = 'HAR'").groupBy("series_id").agg(F.avg("loss").alias("_har"))
    tested = against_har(losses).select("series_id", "model", "dm", F.col("p").alias("dm_p"))
    return chosen.join(har, "series_id").join(logs, ["series_id", "model"]).join(tested, ["series_id", "model"], "left").select(
        "series_id", "model", F.col("mean").alias("qlike"), (F.col("mean") / F.col("_har")).alias("ratio"), "log_mse", F.col("p").alias("mcs_p"), F.coalesce("dm", F.lit(0.0)).alias("dm"), F.coalesce("dm_p", F.lit(1.0)).alias("dm_p")
    )


@query()
def e2_volatility(spark, d):
    return volatility_table(_losses(spark, d), 5, 200)


def _ablation(spark, d, only: tuple[str, ...] | None = None):
    data = T.kept(_data(spark, d))
    variants = {"base": C, "m=1": C.but(m=1), "m=2": C.but(m=2), "m=8": C.but(m=8), "no regime": C.but(regime=False), "no exclusion": C.but(exclusion=0), "kernel": C.but(bandwidth=0.6), "recent": C.but(lookback=300)}
    parts = []
    for name, c in variants.items():
        if only and name not in only:
            continue
        own = data if c.m == C.m else V.vol_data(T.hourly(spark, d), c)
        made = V.analogue_volatility(own, c).filter("realised > 0")
        parts.append(made.select("series_id", "t", F.lit(name).alias("variant"), L.qlike(F.col("realised"), F.col("log_variance")).alias("loss")))
    losses = parts[0]
    for p in parts[1:]:
        losses = losses.unionByName(p)
    mean = losses.groupBy("series_id", "variant").agg(F.avg("loss").alias("qlike"))
    base = mean.filter("variant = 'base'").select("series_id", F.col("qlike").alias("base"))
    ratio = mean.join(base, "series_id").select("series_id", "variant", (F.col("qlike") / F.col("base")).alias("ratio"))
    return ratio.unionByName(ratio.groupBy("variant").agg(F.avg("ratio").alias("ratio")).withColumn("series_id", F.lit("mean")))


@query()
def e3_ablation(spark, d):
    """Mean QLIKE of variants of the analogue forecast over that of the plain one; ``mean`` closes the table."""
    return _ablation(spark, d)


def _tails(spark, d, base=None):
    data, ana = base or _analogue(spark, d)
    made = M.tail_forecasts(data, ana, _folds(spark, d), C).join(data.select("series_id", "t", "tail"), ["series_id", "t"]).filter("tail IS NOT NULL")
    x = M.common_sample(made, "p", 5)
    s = x.groupBy("series_id", "model").agg(F.avg("tail").alias("base_rate"), F.avg(L.log_loss(F.col("p"), F.col("tail"))).alias("log_loss"), F.avg(L.brier(F.col("p"), F.col("tail"))).alias("brier"))
    return s.join(L.auc(x, ["series_id", "model"], "p", "tail"), ["series_id", "model"], "left")


@query()
def e4_tail(spark, d):
    """Base rate, log loss, Brier score and area under the curve of five jump models on common bars."""
    return _tails(spark, d)


TARGETS = ("EWMA", "GARCH", "HAR", "Analogue", "Analogue+HAR")


def overlay_returns(data: DataFrame, forecasts: DataFrame, start: int, gated: DataFrame) -> DataFrame:
    """series_id, t, model (the strategy), r and w from bar ``start`` on: holding, a variance target by each model, one
    by the inverse variance, and one that the jump gate closes. forecasts(series_id, t, model, log_variance),
    gated(series_id, t, gate)."""
    bars = data.select("series_id", "t", "close", "r")
    known = forecasts.select("series_id", "t", "model", F.exp("log_variance").alias("variance"))

    def sized(names: list[str], label: str, kind: str = "vol", gate: DataFrame | None = None) -> DataFrame:
        wide = bars.withColumn("model", F.explode(F.array(*(F.lit(m) for m in names)))).join(known, ["series_id", "t", "model"], "left")
        if gate is not None:
            wide = wide.join(gate, ["series_id", "t"], "left")
        wide = wide.withColumn("series_id", F.concat("series_id", F.lit("|"), "model")).drop("model")
        out = B.overlay(wide, start, C.warmup, 1.0, 0.1, 0.0005, kind, "gate" if gate is not None else None)
        name = F.concat(F.lit(label), F.split_part("series_id", F.lit("|"), F.lit(2)), F.lit(" + gate" if gate is not None else ""))
        return out.select(F.split_part("series_id", F.lit("|"), F.lit(1)).alias("series_id"), "t", name.alias("model"), F.col("ret").alias("r"), "w")

    hold = bars.select("series_id", "t", F.lit("Buy & hold").alias("model"), F.coalesce(F.col("close") / F.lag("close").over(W.ordered()) - 1, F.lit(0.0)).alias("r"), F.lit(1.0).alias("w"))
    own = [TARGETS[-1]]
    parts = [hold, sized(list(TARGETS), "Vol target: "), sized(own, "Kelly: ", "kelly"), sized(own, "Vol target: ", gate=gated)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("t") >= start)


def overlay_table(returns: DataFrame, per_year: float, draws: int, block: float) -> DataFrame:
    """A row a series and strategy: summary, and the difference of Sharpe ratios to holding with its p."""
    keyed = returns.withColumn("series_id", F.concat("series_id", F.lit("|"), "model"))
    summed = L.summary(keyed, "r", per_year, "w").withColumns({"strategy": F.split_part("series_id", F.lit("|"), F.lit(2)), "series_id": F.split_part("series_id", F.lit("|"), F.lit(1))})
    tested = S.sharpe_difference(returns.select("series_id", "t", "model", "r"), "Buy & hold", per_year, draws, block).select("series_id", F.col("model").alias("strategy"), "diff", "p")
    return summed.join(tested, ["series_id", "strategy"], "left").select("series_id", "strategy", "sharpe", "diff", "p", "ann_ret", "ann_vol", "max_dd", "cvar", "calmar", "exposure", "turnover")


def _overlay(spark, d, walked=None):
    data, _, made = walked or _walked(spark, d)
    start = C.warmup + 100
    forecasts = made.select("series_id", "t", "model", "log_variance")
    span = data.groupBy("series_id").agg(F.lit(0).alias("fold"), F.lit(start).cast("long").alias("a"), (F.max("t") + 1).alias("b"))
    gated = G.gate(G.jump_probability(data, span, "hawkes", C.h, C.warmup), C.warmup, C.gate_q).select("series_id", "t", (~F.col("allowed")).alias("gate"))
    return overlay_table(T.kept(overlay_returns(data, forecasts, start, gated)), 252, 200, 2 * C.h)


@query()
def e5_overlay(spark, d):
    """Eight strategies, from the end of the first fold's fit on: holding, and positions sized by forecast variance."""
    return _overlay(spark, d)


LEVELS = (0.01, 0.025, 0.05)


@query()
def e8_var(spark, d):
    """Coverage and losses of six value-at-risk models at three levels, with the confidence set per series and level."""
    out, keyed = None, None
    for alpha in LEVELS:
        x = T.kept(_risk(spark, d, alpha).withColumn("hit", F.col("y") <= F.col("var")))
        cover = L.christoffersen(x, "hit", alpha, ["series_id", "model"])
        loss = x.groupBy("series_id", "model").agg(F.avg(L.tick_loss(F.col("y"), F.col("var"), alpha)).alias("tick"), F.avg("loss").alias("fz0"))
        one = cover.join(loss, ["series_id", "model"]).select("series_id", F.lit(alpha).alias("alpha"), "model", F.col("n").cast("long").alias("n"), (F.col("x") / F.col("n") / alpha).alias("hit_rate"), "p_uc", "p_cc", "tick", "fz0")
        own = x.select(F.concat("series_id", F.lit(f"|{alpha}")).alias("series_id"), "t", "model", "loss")
        out, keyed = (one, own) if out is None else (out.unionByName(one), keyed.unionByName(own))
    chosen = S.confidence_set(keyed, 6, 200, 10).select(F.split_part("series_id", F.lit("|"), F.lit(1)).alias("series_id"), F.split_part("series_id", F.lit("|"), F.lit(2)).cast("double").alias("alpha"), "model", F.col("p").alias("mcs_p"))
    return out.join(chosen, ["series_id", "alpha", "model"])


@query()
def e9_rolling_har(spark, d):
    """Rolling least squares, alone and averaged with the analogue forecast, against the same bars' outcomes."""
    data, ana = _analogue(spark, d)
    parts = []
    for window in (100, 200):
        har = M.rolling_har(data, C, window)
        parts += [har.withColumn("model", F.lit(f"HAR({window})")), har.join(ana.select("series_id", "t", F.col("log_variance").alias("o")), ["series_id", "t"]).select("series_id", "t", ((F.col("log_variance") + F.col("o")) / 2).alias("log_variance")).withColumn("model", F.lit(f"Analogue+HAR({window})"))]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    x = all_.join(data.select("series_id", "t", "realised"), ["series_id", "t"]).filter("realised > 0")
    x = M.common_sample(x.withColumn("loss", L.qlike(F.col("realised"), F.col("log_variance"))), "loss", 4)
    return x.groupBy("series_id", "model").agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("qlike"))


@query()
def e10_intraday_rv(spark, d):
    """The volatility forecast with realised variance from finer bars in place of squared returns."""
    from tidemark.sources.bars import intraday_variance, resample

    fine = T.quarter_hours(spark, d)
    data = V.vol_data(intraday_variance(resample(fine, "hour"), fine, "hour").withColumnRenamed("rv", "fine_rv"), C, rv="fine_rv")
    made = V.analogue_volatility(data, C)
    return made.select("series_id", "t", *six("log_variance", "realised"))


def _risk(spark, d, alpha: float) -> DataFrame:
    """Losses of six value-at-risk models on their common bars."""
    nxt = _data(spark, d).select("series_id", "t", F.lead("r").over(W.ordered()).alias("y"))
    made = M.var_forecasts(_data(spark, d), _folds(spark, d), C, alpha, 100).join(nxt, ["series_id", "t"]).filter("y IS NOT NULL AND es < 0")
    return M.common_sample(made, "var", 6).withColumn("loss", L.fz0_loss(F.col("y"), F.col("var"), F.col("es"), alpha))


def _gbm_ratio(data: DataFrame, losses: DataFrame, fit_end: int = 400) -> DataFrame:
    """series_id, x: log of the boosted trees' mean loss over that of HAR, on the bars that both forecast."""
    trees = M.gbm_forecast(data, fit_end, C, trees=3, depth=3).withColumnRenamed("log_variance", "tree")
    har = losses.filter("model = 'HAR'").select("series_id", "t", "realised", F.col("loss").alias("har"))
    both = har.join(trees, ["series_id", "t"]).withColumn("gbm", L.qlike(F.col("realised"), F.col("tree")))
    return both.groupBy("series_id").agg(F.log(F.avg("gbm") / F.avg("har")).alias("x"))


@query()
def hypotheses(spark, d):
    """The eight hypotheses, each with its statistic, number of series, p and p after Holm."""
    apart = lambda df, key, value, a, b: df.groupBy("series_id").pivot(key, [a, b]).agg(F.first(value)).select("series_id", F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b"))
    ratio, gap = F.log(F.col("a") / F.col("b")).alias("x"), (F.col("a") - F.col("b")).alias("x")
    walked = _walked(spark, d)
    losses = T.kept(_losses(spark, d, walked))
    q = T.kept(losses.groupBy("series_id", "model").agg(F.avg("loss").alias("qlike")))
    kernel = _ablation(spark, d, ("base", "kernel")).filter("series_id <> 'mean' AND variant = 'kernel'").select("series_id", F.log("ratio").alias("x"))
    tails = apart(_tails(spark, d, walked[:2]), "model", "log_loss", "Hawkes", "Poisson")
    risk = apart(_risk(spark, d, 0.025).groupBy("series_id", "model").agg(F.avg("loss").alias("fz0")), "model", "fz0", "Blend", "FHS")
    drawdown = apart(_overlay(spark, d, walked), "strategy", "max_dd", "Vol target: Analogue+HAR", "Buy & hold")
    samples = {
        "H1": e1_direction_skill(spark, d).select("series_id", F.col("ic_long").alias("x")), "H2": apart(q, "model", "qlike", "Analogue+HAR", "HAR").select("series_id", ratio),
        "H3": apart(q, "model", "qlike", "Analogue", "HAR").select("series_id", ratio), "H4": kernel, "H5": _gbm_ratio(walked[0], losses),
        "H6": tails.select("series_id", ratio), "H7": risk.select("series_id", gap), "H8": drawdown.select("series_id", gap),
    }
    long = None
    for name, x in samples.items():
        x = x.withColumn("id", F.lit(name))
        long = x if long is None else long.unionByName(x)
    return Q.hypothesis_table(T.kept(long))


@query()
def vol_summary(spark, d):
    """Mean and median ratio to HAR, and how often a model has the least loss."""
    q = _losses(spark, d).groupBy("series_id", "model").agg(F.avg("loss").alias("qlike"))
    har = q.filter("model = 'HAR'").select("series_id", F.col("qlike").alias("har"))
    best = q.groupBy("series_id").agg(F.min_by("model", "qlike").alias("best"))
    x = q.join(har, "series_id").join(best, "series_id")
    return x.groupBy("model").agg(F.avg(F.col("qlike") / F.col("har")).alias("mean_ratio"), F.percentile(F.col("qlike") / F.col("har"), F.lit(0.5)).alias("median_ratio"), F.sum((F.col("best") == F.col("model")).cast("long")).alias("times_best"))


@query(f"""WITH {T.HOURLY} SELECT series_id, strftime(min(ts), '%Y-%m-%d %H') AS first_bar, strftime(max(ts), '%Y-%m-%d %H') AS last_bar, CAST(count(*) AS BIGINT) AS bars, CAST(greatest(0, count(*) - {C.warmup}) AS BIGINT) AS out_of_sample FROM bars GROUP BY 1""")
def data_table(spark, d):
    b = T.hourly(spark, d).groupBy("series_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH").alias("first_bar"), F.date_format(F.max("ts"), "yyyy-MM-dd HH").alias("last_bar"), F.count(F.lit(1)).alias("bars"))
    return b.withColumn("out_of_sample", F.greatest(F.lit(0), F.col("bars") - C.warmup))


@query(f"WITH RECURSIVE {T.HOURLY}, {T.RETURNS}, {T.ewma_sql('a', 20)}, {T.ewma_sql('b', 80)}, x AS (SELECT series_id, t, a.v AS va, b.v AS vb, r * r AS y FROM a JOIN b USING (series_id, t) JOIN rets USING (series_id, t) WHERE r <> 0 AND t > 50), g AS (SELECT series_id, t, (y / vb - ln(y / vb)) - (y / va - ln(y / va)) AS gain FROM x) SELECT series_id, t, round(sum(gain) OVER (PARTITION BY series_id ORDER BY t), 4) AS gain FROM g")
def cumulative_gain(spark, d):
    """Running sum of one model's gain in loss over another's."""
    from tidemark.functions.recurrences import with_ewma

    from .bars_queries import _returns

    x = with_ewma(with_ewma(_returns(spark, d), 20, "a"), 80, "b").filter("r <> 0 AND t > 50")
    loss = lambda c: L.qlike(F.col("r") * F.col("r"), F.log(F.col(c) * F.col(c)))
    return x.withColumn("g", loss("b") - loss("a")).select("series_id", "t", F.round(F.sum("g").over(W.upto()), 4).alias("gain"))
