"""Queries over trades, models, losses and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import losses as L
from tidemark.functions import recurrences as R
from tidemark.functions import resampling as S
from tidemark.functions import windows as W
from tidemark.operators import analogue as A
from tidemark.operators import models as M
from tidemark.operators import trades as B
from tidemark.operators import volatility as V

from . import tables as T
from .bars_queries import COUNTS, DATA, STATE, C, _data, _returns, six
from .registry import Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _atr(spark, d):
    return R.with_atr(_returns(spark, d), 14)


def _one_side(d: int, hold: int, rr: float, mult: float) -> str:
    """first(series_id, t, price): the earliest bar of the holding period that ends a trade."""
    against, beyond = ("b.low <= stop", "b.high >= goal") if d > 0 else ("b.high >= stop", "b.low <= goal")
    n = "l" if d > 0 else "s"
    return f"""
e{n} AS (SELECT x.series_id, x.t, o.open AS entry, x.sd, o.open - {d} * x.sd AS stop, o.open + {d} * {rr}::DOUBLE * x.sd AS goal, q.open AS last FROM sdv x JOIN bars o ON o.series_id = x.series_id AND o.t = x.t + 1
  JOIN bars q ON q.series_id = x.series_id AND q.t = x.t + 1 + {hold} WHERE x.sd > 0),
h{n} AS (SELECT e.series_id, e.t, b.t - e.t AS i, CASE WHEN b.t > e.t + 1 AND {d} * (b.open - stop) <= 0 THEN b.open WHEN b.t > e.t + 1 AND {d} * (b.open - goal) >= 0 THEN b.open
  WHEN {against} THEN stop WHEN {beyond} THEN goal END AS price FROM e{n} e JOIN bars b ON b.series_id = e.series_id AND b.t BETWEEN e.t + 1 AND e.t + {hold}),
f{n} AS (SELECT series_id, t, arg_min(price, i) AS price FROM h{n} WHERE price IS NOT NULL GROUP BY 1, 2),
r{n} AS (SELECT e.series_id, e.t, ({d} * (coalesce(f.price, e.last) - e.entry) - 0.0005::DOUBLE * (e.entry + coalesce(f.price, e.last))) / e.sd AS r FROM e{n} e LEFT JOIN f{n} f USING (series_id, t))"""


LABELS = f"{T.HOURLY}, {T.RETURNS}, {T.atr_sql('a', 14)}, sdv AS (SELECT series_id, t, 2.5::DOUBLE * atr AS sd FROM a), {_one_side(1, 20, 1.5, 2.5)}, {_one_side(-1, 20, 1.5, 2.5)}"


@query(f"""WITH RECURSIVE {LABELS} SELECT b.series_id, b.t, round(rl.r, 6) AS r_long, round(rs.r, 6) AS r_short,
  CASE WHEN rl.r IS NOT NULL THEN CAST(lead(b.close, 20) OVER (PARTITION BY b.series_id ORDER BY b.t) > b.close AS DOUBLE) END AS up
  FROM bars b LEFT JOIN rl ON rl.series_id = b.series_id AND rl.t = b.t LEFT JOIN rs ON rs.series_id = b.series_id AND rs.t = b.t""")
def trade_labels(spark, d):
    bars = _atr(spark, d).withColumn("sd", 2.5 * F.col("atr"))
    return B.labels(bars, "sd", 1.5, 20, 0.0005).select("series_id", "t", *six("r_long", "r_short"), "up")


LG = B.Legacy(lookback=200, scan=100)


@query(f"""WITH RECURSIVE {T.HOURLY}, {T.RETURNS}, {T.atr_sql('a', 14)},
  s AS (SELECT x.*, a.atr, CAST(coalesce(a.atr > CASE WHEN count(a.atr) OVER w = 200 THEN avg(a.atr) OVER w END, false) AS INTEGER) AS state,
    CASE WHEN coalesce(abs(r) > 2.5::DOUBLE * CASE WHEN count(r) OVER w = 200 THEN sqrt(greatest(avg(r * r) OVER w - avg(r) OVER w * avg(r) OVER w, 0)) END, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS jumped
    FROM rets x LEFT JOIN a USING (series_id, t) WINDOW w AS ({T.W} {T.rows(200)})),
  p AS (SELECT *, lag(state) OVER ({T.W}) AS was, close / lag(close, 20) OVER ({T.W}) - 1 AS move, CASE WHEN lead(close, 20) OVER ({T.W}) > close THEN 1 ELSE 0 END AS won FROM s),
  q AS (SELECT *, sum(CASE WHEN was = 0 AND state = 0 THEN 1 ELSE 0 END) OVER v AS n00, sum(CASE WHEN was = 0 AND state = 1 THEN 1 ELSE 0 END) OVER v AS n01, sum(CASE WHEN was = 1 AND state = 0 THEN 1 ELSE 0 END) OVER v AS n10,
    sum(CASE WHEN was = 1 AND state = 1 THEN 1 ELSE 0 END) OVER v AS n11, sum(jumped) OVER ({T.W} {T.rows(200)}) / 200 AS rate FROM p WINDOW v AS ({T.W} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)),
  k AS (SELECT q.series_id, q.t, o.won, row_number() OVER (PARTITION BY q.series_id, q.t ORDER BY abs(o.move - q.move), o.t DESC) AS n FROM q JOIN q o ON o.series_id = q.series_id AND o.t BETWEEN q.t - 100 AND q.t - 21 AND o.move IS NOT NULL WHERE q.t >= 231),
  m AS (SELECT series_id, t, sum(won) AS wins FROM k WHERE n <= 10 GROUP BY 1, 2),
  z AS (SELECT q.series_id, q.t, atr, wins, wins * 10.0::DOUBLE AS prior, wins / 10.0::DOUBLE AS share, CASE WHEN state = 1 THEN n11 / greatest(n10 + n11, 1) ELSE n00 / greatest(n00 + n01, 1) END AS stay, 100 * (1 - exp(-rate * 20)) AS pj FROM q JOIN m USING (series_id, t)),
  b AS (SELECT *, prior * stay + 50 * (1 - stay) AS score, share + 3.8416::DOUBLE / 20 AS mid, 1.96::DOUBLE * sqrt(share * (1 - share) / 10 + 3.8416::DOUBLE / 400) AS half, 2.5::DOUBLE * atr * CASE WHEN pj >= 10 AND pj < 50 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS stop FROM z),
  e AS (SELECT *, greatest(score, 100 - score) / 100 AS best, 100 * greatest(0, (mid - half) / 1.38416::DOUBLE) AS low, 100 * least(1, (mid + half) / 1.38416::DOUBLE) AS high FROM b),
  f AS (SELECT *, least(10, greatest(0, 50 * (best - (1 - best) / (stop * 1.5::DOUBLE / greatest(stop, 0.0001::DOUBLE))))) AS kelly FROM e)
  SELECT series_id, t, CAST(wins AS BIGINT) AS wins, round(score, 6) AS score, round(pj, 6) AS jump_chance, round(stop, 6) AS stop, round(greatest(kelly, 0.01::DOUBLE) / 100, 6) AS size,
    CAST(CASE WHEN pj >= 50 OR kelly <= 0 THEN 0 WHEN low >= 65 AND score >= 65 THEN 1 WHEN 100 - high >= 65 AND 100 - score >= 65 THEN -1 ELSE 0 END AS TINYINT) AS dir FROM f""")
def legacy_signals(spark, d):
    return B.legacy_signals(_atr(spark, d), LG).select("series_id", "t", F.col("wins").cast("long").alias("wins"), *six("score", "jump_chance", "stop", "size"), "dir")


@query()
def legacy_backtest(spark, d):
    bars = _atr(spark, d)
    signals = B.legacy_signals(bars, LG).select("series_id", "t", "dir", "stop", "size")
    return B.backtest(bars.join(signals, ["series_id", "t"], "left"), B.LEGACY_EXECUTION)[0]


@query(f"WITH {T.HOURLY} SELECT series_id, t, CAST(CASE WHEN t >= 50 THEN sign(close - lag(close, 20) OVER ({T.W})) ELSE 0 END AS TINYINT) AS dir FROM bars")
def momentum_signal(spark, d):
    return B.momentum(T.hourly(spark, d), 20, 50).select("series_id", "t", "dir")


def _momentum_backtest(spark, d):
    bars = B.momentum(_atr(spark, d), 20, 50).withColumns({"stop": 2.5 * F.col("atr"), "size": F.lit(0.01)})
    return B.backtest(bars, B.Backtest())


@query()
def backtest(spark, d):
    return _momentum_backtest(spark, d)[0]


@query()
def backtest_equity(spark, d):
    return _momentum_backtest(spark, d)[1]


def _direction(spark, d):
    """Forecasts of trade outcomes by analogues of recent returns."""
    bars = R.with_features(_returns(spark, d), 20, 14).withColumn("state", W.regime(F.col("atr"), 100)).withColumn("sd", 2.5 * F.col("atr"))
    lab = B.labels(bars, "sd", 1.5, 10, 0.0005)
    y = F.array("r_long", "r_short", "up", F.col("r_long") ** 2, F.col("r_short") ** 2)
    framed = bars.join(lab, ["series_id", "t"]).withColumn("y", y).withColumn("emb", W.return_embedding(F.col("r"), F.col("sigma"), 20, 4, digits=9))
    e = A.Engine(k=5, k_min=3, exclusion=5, delay=11, warmup=250, first=20, horizon=10)
    return bars, lab, A.forecast(framed.select("series_id", "t", "emb", "y", "state"), e, 4, 5)


@query()
def direction_forecast(spark, d):
    return _direction(spark, d)[2].select("series_id", "t", *six("mean_0", "mean_1", "mean_2", "se_0", "se_1"), "n_used")


@query()
def direction_backtest(spark, d):
    bars, _, made = _direction(spark, d)
    decided = B.decide(made.join(bars.select("series_id", "t", "atr"), ["series_id", "t"]), z=0.5)
    return B.backtest(bars.join(decided.select("series_id", "t", "dir", "stop", "size"), ["series_id", "t"], "left"), B.Backtest(max_hold=10))[0]


@query(f"""WITH f AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_discount * 10 - 0.5::DOUBLE AS m0, l_tax * 10 - 0.4::DOUBLE AS m1, l_discount AS s0, l_tax AS s1, l_quantity / 10 AS q0, l_quantity / 20 AS q1 FROM lineitem),
  g AS (SELECT *, CASE WHEN m0 - s0 > 0 AND m0 - s0 >= m1 - s1 THEN 1 WHEN m1 - s1 > 0 AND m1 - s1 > m0 - s0 THEN -1 ELSE 0 END AS dir FROM f)
  SELECT CAST(dir AS TINYINT) AS dir, count(*) AS n, round(sum(greatest(0, least(0.02::DOUBLE, coalesce(0.5::DOUBLE * CASE WHEN dir = 1 THEN m0 / q0 WHEN dir = -1 THEN m1 / q1 END, 0)))), 4) AS size FROM g GROUP BY 1""")
def decide(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    f = li.select((F.col("l_discount") * 10 - 0.5).alias("mean_0"), (F.col("l_tax") * 10 - 0.4).alias("mean_1"), F.col("l_discount").alias("se_0"), F.col("l_tax").alias("se_1"), (F.col("l_quantity") / 10).alias("mean_3"), (F.col("l_quantity") / 20).alias("mean_4"), F.lit(1.0).alias("atr"))
    return B.decide(f).groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("size"), 4).alias("size"))


FOLDS = f"""fn AS (SELECT series_id, count(*) AS n FROM bars GROUP BY 1), fc_ AS (SELECT *, greatest(CAST(floor(0.3::DOUBLE * n) AS BIGINT), {C.warmup + 100}) AS cal FROM fn),
fd AS (SELECT series_id, CAST(k AS INTEGER) AS fold, CAST(floor(cal + (n - cal) * k / 5) AS BIGINT) AS a, CAST(floor(cal + (n - cal) * (k + 1) / 5) AS BIGINT) AS b FROM fc_, range(0, 5) r(k) WHERE cal < n)"""


def _folds(spark, d):
    return B.folds(T.hourly(spark, d), C.warmup, least=100)


@query(f"WITH {T.HOURLY}, {FOLDS} SELECT * FROM fd")
def folds(spark, d):
    return _folds(spark, d)


@query(f"""WITH RECURSIVE {T.HOURLY}, {T.RETURNS}, {T.ewma_sql('e', 20)}, g AS (SELECT series_id, avg(r * r) AS goal FROM rets WHERE t >= 50 AND t < 200 GROUP BY 1),
  raw AS (SELECT x.series_id, x.t, x.close, greatest(0, least(2.0::DOUBLE, coalesce(sqrt(goal / v), 0))) AS raw FROM rets x JOIN e USING (series_id, t) JOIN g USING (series_id)),
  v AS (SELECT series_id, t, CASE WHEN raw > 0.25 THEN raw ELSE 0.0::DOUBLE END AS w FROM raw WHERE t = 200 UNION ALL SELECT r.series_id, r.t, CASE WHEN abs(r.raw - v.w) > 0.25 THEN r.raw ELSE v.w END FROM v JOIN raw r ON r.series_id = v.series_id AND r.t = v.t + 1),
  w AS (SELECT series_id, t, coalesce(v.w, 0.0::DOUBLE) AS w FROM bars LEFT JOIN v USING (series_id, t)),
  z AS (SELECT w.*, coalesce(lag(w) OVER ({T.W}), 0) AS held, coalesce(lag(w, 2) OVER ({T.W}), 0) AS was FROM w),
  c AS (SELECT series_id, t, coalesce(close / lag(close) OVER ({T.W}) - 1, 0) AS s FROM bars)
  SELECT series_id, t, round(w, 6) AS w, round(held * s - abs(held - was) * 0.0005::DOUBLE, 6) AS ret FROM z JOIN c USING (series_id, t)""")
def overlay_weights(spark, d):
    data = R.with_ewma(_returns(spark, d), 20).withColumn("variance", F.col("sigma") * F.col("sigma"))
    return B.overlay(data, 200, 50, 2.0, 0.25, 0.0005).select("series_id", "t", *six("w", "ret"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice AS p, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS dir FROM orders),
  a AS (SELECT o_orderkey AS k, dir, p FROM o WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k, dir, p * (CASE WHEN o_custkey % 5 = 0 THEN 1.01::DOUBLE ELSE 1.0001::DOUBLE END) AS p FROM o WHERE o_orderkey % 4 <> 0)
  SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'ours' WHEN b.k IS NULL THEN 'theirs' ELSE 'both' END AS side, abs(a.p / b.p - 1) <= 0.001::DOUBLE AS entry_agrees FROM a FULL JOIN b ON a.k = b.k AND a.dir = b.dir""")
def trade_match_outer(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), "o_custkey", F.col("o_totalprice").alias("p"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).alias("dir"))
    a = o.filter("k % 3 <> 0").select(F.col("k").alias("entry_time"), "dir", F.col("p").alias("entry_price"), F.col("p").alias("exit_price"))
    moved = F.col("p") * F.when(F.col("o_custkey") % 5 == 0, 1.01).otherwise(1.0001)
    b = o.filter("k % 4 <> 0").select(F.col("k").alias("entry_time"), "dir", moved.alias("entry_price"), moved.alias("exit_price"))
    return B.match_trades(a, b, 0.001).select(F.col("entry_time").alias("k"), "side", "entry_agrees")


# ---- models
def _har_part(n: int) -> str:
    mean = T.whole("avg(r * r)", "r", T.rows(n), n)
    return f"ln(greatest({mean}, 0.001 * lv) + 0 * {mean})"


HAR = f"""{T.HOURLY}, {DATA}, {FOLDS},
hv AS (SELECT *, {_har_part(1)} AS h1, {_har_part(5)} AS h2, {_har_part(22)} AS h3 FROM data)"""


@query(f"""WITH RECURSIVE {HAR}, k AS (SELECT h.*, f.fold FROM hv h JOIN fd f USING (series_id) WHERE h.t < f.a - {C.h} - 1 AND h.t >= {C.warmup} AND h.target IS NOT NULL AND h1 + h2 + h3 IS NOT NULL)
  SELECT series_id, fold, CAST(count(*) AS BIGINT) AS n, round(sum(h1 * target), 4) AS x1y, round(sum(h1 * h2), 4) AS x1x2, round(sum(target), 4) AS y FROM k GROUP BY 1, 2""")
def har_ols_sums(spark, d):
    rows = M.with_folds(M.with_har(_data(spark, d), C), _folds(spark, d)).filter(F.col("har").isNotNull() & F.col("target").isNotNull() & (F.col("t") >= C.warmup) & (F.col("t") < F.col("a") - C.h - 1))
    h = F.col("har")
    return rows.groupBy("series_id", "fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(h[0] * F.col("target")), 4).alias("x1y"), F.round(F.sum(h[0] * h[1]), 4).alias("x1x2"), F.round(F.sum("target"), 4).alias("y"))


def solve_sql(p: str, source: str, keep: str, n: int = 4) -> str:
    """{p}b(keep, b0, ...): the solution of source(keep, a00 ... a33 of the upper triangle, y0 ...) by elimination."""
    at = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    out, last = "", source
    for k in range(n - 1):
        cells = [f"{at(i, j)} - {at(k, i)} * {at(k, j)} / {at(k, k)} AS {at(i, j)}" for i in range(k + 1, n) for j in range(i, n)] + [f"y{i} - {at(k, i)} * y{k} / {at(k, k)} AS y{i}" for i in range(k + 1, n)]
        done = [f"{at(i, j)}" for i in range(k + 1) for j in range(i, n)] + [f"y{i}" for i in range(k + 1)]
        out += f"{p}e{k} AS (SELECT {keep}, {', '.join(done + cells)} FROM {last}), "
        last = f"{p}e{k}"
    for i in reversed(range(n)):
        rest = "".join(f" - {at(i, j)} * b{j}" for j in range(i + 1, n))
        out += f"{p}s{i} AS (SELECT *, (y{i}{rest}) / {at(i, i)} AS b{i} FROM {last}), "
        last = f"{p}s{i}"
    return out + f"{p}b AS (SELECT * FROM {last})"


XS = ("1.0::DOUBLE", "h1", "h2", "h3")
CELLS = [(f"a{i}{j}", f"{XS[i]} * {XS[j]}") for i in range(4) for j in range(i, 4)] + [(f"y{i}", f"{XS[i]} * target") for i in range(4)]


@query(f"""WITH RECURSIVE {HAR}, k AS (SELECT h.*, f.fold FROM hv h JOIN fd f USING (series_id) WHERE h.t < f.a - {C.h} - 1 AND h.t >= {C.warmup} AND h.target IS NOT NULL AND h1 + h2 + h3 IS NOT NULL),
  m AS (SELECT series_id, fold, {", ".join(f"sum({x}) AS {name}" for name, x in CELLS)} FROM k GROUP BY 1, 2), {solve_sql('q', 'm', 'series_id, fold')}
  SELECT series_id, fold, {", ".join(f"round(b{i}, 5) AS b{i}" for i in range(4))} FROM qb""")
def har_ols(spark, d):
    return M.har_coefficients(_data(spark, d), _folds(spark, d), C).select("series_id", "fold", *(F.round(f"b{i}", 5).alias(f"b{i}") for i in range(4)))


SPAN = 200


@query(f"""WITH RECURSIVE {HAR}, w AS (SELECT *, h1 + h2 + h3 + target IS NOT NULL AS known FROM hv),
  r AS (SELECT series_id, t, h1, h2, h3, count(*) FILTER (known) OVER v AS n, {", ".join(f"sum({x}) FILTER (known) OVER v AS {name}" for name, x in CELLS)} FROM w WINDOW v AS ({T.W} ROWS BETWEEN {C.h + SPAN} PRECEDING AND {C.h + 1} PRECEDING)),
  m AS (SELECT series_id, t, h1, h2, h3, {", ".join(f"{name} + 1e-10::DOUBLE AS {name}" if name in ("a00", "a11", "a22", "a33") else name for name, _ in CELLS)} FROM r WHERE n >= 50 AND h1 + h2 + h3 IS NOT NULL), {solve_sql('q', 'm', 'series_id, t, h1, h2, h3')}
  SELECT series_id, t, round(b0 + b1 * h1 + b2 * h2 + b3 * h3, 5) AS log_variance FROM qb""")
def har_rolling(spark, d):
    return M.rolling_har(_data(spark, d), C, SPAN).select("series_id", "t", F.round("log_variance", 5).alias("log_variance"))


@query(f"""WITH RECURSIVE {T.HOURLY}, {DATA}, {FOLDS}, f AS (SELECT d.series_id, fold, t, a, ln(lv) AS f, target FROM data d JOIN fd USING (series_id) WHERE t < b),
  s AS (SELECT series_id, fold, ln(avg(exp(target - f))) AS shift FROM f WHERE target IS NOT NULL AND t >= {C.warmup} AND t < a - {C.h} - 1 GROUP BY 1, 2)
  SELECT series_id, fold, t, round(f + coalesce(shift, 0), 6) AS log_variance FROM f LEFT JOIN s USING (series_id, fold) WHERE t >= a""")
def bias_correct(spark, d):
    f = M.with_folds(_data(spark, d), _folds(spark, d)).select("series_id", "fold", "t", "a", F.log("long").alias("log_variance"), "target")
    return M.bias_correct(f, C).select("series_id", "fold", "t", *six("log_variance"))


def _analogue(spark, d):
    data = T.kept(_data(spark, d))
    return data, T.kept(V.analogue_volatility(data, C))


@query()
def walk_forward(spark, d):
    data, ana = _analogue(spark, d)
    return M.walk_forward(data, ana, _folds(spark, d), C)


def _walked(spark, d):
    """Inputs, analogue forecasts and all models' walk-forward forecasts, each worked out once."""
    data, ana = _analogue(spark, d)
    return data, ana, T.kept(M.walk_forward(data, ana, _folds(spark, d), C))


def _losses(spark, d, walked=None):
    data, _, made = walked or _walked(spark, d)
    scored = made.join(data.select("series_id", "t", "realised", "long"), ["series_id", "t"]).filter("realised > 0")
    return M.common_sample(T.kept(scored.withColumn("loss", L.qlike(F.col("realised"), F.col("log_variance")))), "loss", 5)


def against_har(losses):
    """Every other model's loss against HAR's on the same bars: above 0 if it is better."""
    har = losses.filter("model = 'HAR'").select("series_id", "t", F.col("loss").alias("_har"))
    apart = losses.filter("model <> 'HAR'").join(har, ["series_id", "t"]).select("series_id", "model", "t", (F.col("_har") - F.col("loss")).alias("gain"))
    return L.newey_west(apart, "gain", C.h, ("series_id", "model"))


@query()
def mcs(spark, d):
    return S.confidence_set(_losses(spark, d), 5, 200, 20).select("series_id", "model", F.col("mean").alias("qlike"), F.col("p").alias("mcs_p"))


@query()
def dm_tests(spark, d):
    return against_har(_losses(spark, d)).select("series_id", "model", F.lit("HAR").alias("vs"), F.col("dm").alias("stat"), "p")


@query()
def tail_forecasts(spark, d):
    data, ana = _analogue(spark, d)
    return M.tail_forecasts(data, ana, _folds(spark, d), C)


@query()
def var_forecasts(spark, d):
    return M.var_forecasts(_data(spark, d), _folds(spark, d), C, 0.05, 100)


@query()
def gbm_forecast(spark, d):
    return M.gbm_forecast(_data(spark, d), 400, C, trees=3, depth=3)


# ---- losses and tests
def erf_sql(x: str) -> str:
    """The error function by logarithms of its series' terms."""
    return f"least(1.0::DOUBLE, CASE WHEN ({x}) <= 0 THEN 0.0::DOUBLE WHEN ({x}) >= 6 THEN 1.0::DOUBLE ELSE 2 / sqrt(pi()) * exp(-({x}) * ({x})) * list_sum(list_transform(range(0, 141), lambda k: exp(2 * k * ln(2.0::DOUBLE) + (2 * k + 1) * ln(greatest({x}, 1e-300::DOUBLE)) + lgamma(k + 1.0::DOUBLE) - lgamma(2 * k + 2.0::DOUBLE)))) END)"


@query(f"WITH RECURSIVE {T.HOURLY}, {DATA}, q AS (SELECT series_id, realised / exp(ln(lv)) AS x FROM data WHERE realised > 0) SELECT series_id, count(*) AS n, round(avg(x - ln(x) - 1), 6) AS qlike FROM q GROUP BY 1")
def qlike(spark, d):
    return _data(spark, d).filter("realised > 0").groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(L.qlike(F.col("realised"), F.log("long"))), 6).alias("qlike"))


PY = "py AS (SELECT l_linestatus AS g, l_linenumber AS n, l_discount * 10 AS p, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM lineitem)"


def _py(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linestatus").alias("g"), F.col("l_linenumber").alias("n"), (F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "R").cast("double").alias("y"))


@query(f"""WITH {PY}, k AS (SELECT *, greatest(0.000001::DOUBLE, least(0.999999::DOUBLE, p)) AS q, rank() OVER (PARTITION BY g ORDER BY p) + (count(*) OVER (PARTITION BY g, p) - 1) / 2.0::DOUBLE AS r FROM py)
  SELECT g, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc FROM k GROUP BY 1""")
def logloss_brier_auc(spark, d):
    df = _py(spark, d)
    means = df.groupBy("g").agg(F.round(F.avg(L.log_loss(F.col("p"), F.col("y"))), 6).alias("log_loss"), F.round(F.avg(L.brier(F.col("p"), F.col("y"))), 6).alias("brier"))
    areas = L.auc(df, ["g"], "p", "y").select("g", F.coalesce("auc", F.lit(float("nan"))).alias("auc"))  # NaN in SQL
    return means.join(areas, "g").select("g", "log_loss", "brier", *six("auc"))


@query(f"""WITH {T.DAILY}, x AS (SELECT series_id, t, coalesce(close / lag(close) OVER ({T.W}) - 1, 0) AS r FROM bars),
  e AS (SELECT *, product(1 + r) OVER ({T.W}) AS eq FROM x), m AS (SELECT *, eq / max(eq) OVER ({T.W}) - 1 AS dd FROM e), c AS (SELECT series_id, quantile_cont(r, 0.05) AS cut FROM x GROUP BY 1)
  SELECT series_id, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe, round(pow(product(1 + r), 252 / count(*)) - 1, 6) AS ann_ret, round(stddev_pop(r) * sqrt(252), 6) AS ann_vol, round(min(dd), 6) AS max_dd,
  round(avg(CASE WHEN r <= cut THEN r END), 6) AS cvar FROM m JOIN c USING (series_id) GROUP BY 1""")
def sharpe_drawdown_cvar(spark, d):
    x = T.daily(spark, d).withColumn("r", F.coalesce(F.col("close") / F.lag("close").over(W.ordered()) - 1, F.lit(0.0)))
    return L.summary(x, "r", 252).select("series_id", *six("sharpe", "ann_ret", "ann_vol", "max_dd", "cvar"))


@query(f"""WITH {T.HOURLY}, {T.RETURNS}, x AS (SELECT series_id, t, r * r - abs(r) AS d FROM rets), y AS (SELECT *, d - avg(d) OVER (PARTITION BY series_id) AS x FROM x),
  z AS (SELECT *, lag(x, 1) OVER ({T.W}) AS l1, lag(x, 2) OVER ({T.W}) AS l2, lag(x, 3) OVER ({T.W}) AS l3 FROM y),
  s AS (SELECT series_id, avg(d) AS mean, count(*) AS n, (sum(x * x) + 1.5::DOUBLE * sum(x * l1) + 1.0::DOUBLE * sum(x * l2) + 0.5::DOUBLE * sum(x * l3)) / count(*) / count(*) AS variance FROM z GROUP BY 1)
  SELECT series_id, round(mean, 6) AS mean, round(variance, 6) AS variance, round(mean / sqrt(variance), 6) AS dm, round(1 - {erf_sql('abs(mean) / sqrt(2 * variance)')}, 6) AS p FROM s""")
def newey_west_dm(spark, d):
    x = _returns(spark, d).withColumn("d", F.col("r") * F.col("r") - F.abs("r"))
    return L.newey_west(x, "d", 3).select("series_id", *six("mean", "variance", "dm", "p"))


@query(f"""WITH {T.HOURLY}, {T.RETURNS}, m AS (SELECT series_id, avg(r) AS m, stddev_samp(r) AS sd, count(*) AS n FROM rets GROUP BY 1),
  c AS (SELECT series_id, any_value(m) / any_value(sd) AS sr, any_value(n) AS n, avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 1.5::DOUBLE) AS g3, avg(pow(r - m, 4)) / pow(avg(pow(r - m, 2)), 2) AS g4 FROM rets JOIN m USING (series_id) GROUP BY 1),
  z AS (SELECT series_id, sr, sr * sqrt(n - 1) / sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr * sr) / sqrt(2) AS z FROM c)
  SELECT series_id, round(sr, 6) AS sr, round((1 + sign(z) * {erf_sql('abs(z)')}) / 2, 6) AS psr FROM z""")
def probabilistic_sharpe(spark, d):
    return L.probabilistic_sharpe(_returns(spark, d), ["series_id"], "r").select("series_id", *six("sr", "psr"))


@query(f"""WITH {T.HOURLY}, {T.RETURNS}, x AS (SELECT series_id, r, volume, rank() OVER (PARTITION BY series_id ORDER BY r) + (count(*) OVER (PARTITION BY series_id, r) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY series_id ORDER BY volume) + (count(*) OVER (PARTITION BY series_id, volume) - 1) / 2.0::DOUBLE AS b FROM rets)
  SELECT series_id, round(corr(a, b), 6) AS ic FROM x GROUP BY 1""")
def spearman_ic(spark, d):
    return L.spearman(_returns(spark, d), ["series_id"], "r", "volume").select("series_id", *six("ic"))


@query(f"""WITH {PY}, b AS (SELECT g, avg(y) AS base FROM py WHERE n <= 2 GROUP BY 1) SELECT py.g, round(1 - avg((p - y) * (p - y)) / avg((base - y) * (base - y)), 6) AS skill FROM py JOIN b USING (g) WHERE n > 2 GROUP BY 1""")
def brier_skill(spark, d):
    return L.brier_skill(_py(spark, d), ["g"], "p", "y", F.col("n") <= 2, F.col("n") > 2).select("g", *six("skill"))


@query(f"""WITH v AS (SELECT l_suppkey AS k, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY v) AS c, sum(w) OVER (PARTITION BY k) AS tot FROM v),
  f AS (SELECT k, min(v) AS var FROM c WHERE c >= 0.05::DOUBLE * tot - 1e-12::DOUBLE GROUP BY 1) SELECT k, var, round(sum(v.v * w) / sum(w), 9) AS es FROM v JOIN f USING (k) WHERE v.v <= var GROUP BY 1, 2""")
def weighted_tail(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("w"))
    return L.weighted_tail(li, ["k"], "v", "w", 0.05).select("k", "var", F.round("es", 9).alias("es"))


HIT = "hit AS (SELECT series_id, t, CASE WHEN r < -1.0 THEN 1 ELSE 0 END AS h FROM rets)"


@query(f"""WITH {T.HOURLY}, {T.RETURNS}, {HIT}, b AS (SELECT *, lag(h) OVER ({T.W}) AS l FROM hit),
  c AS (SELECT series_id, count(*) AS n, sum(h) AS x, sum(CASE WHEN l = 0 AND h = 0 THEN 1 ELSE 0 END) AS n00, sum(CASE WHEN l = 0 AND h = 1 THEN 1 ELSE 0 END) AS n01, sum(CASE WHEN l = 1 AND h = 0 THEN 1 ELSE 0 END) AS n10, sum(CASE WHEN l = 1 AND h = 1 THEN 1 ELSE 0 END) AS n11 FROM b GROUP BY 1),
  p AS (SELECT *, n01 / (n00 + n01) AS p01, n11 / (n10 + n11) AS p11, (n01 + n11) / (n00 + n01 + n10 + n11) AS pp FROM c),
  q AS (SELECT *, -2 * (x * ln(0.2::DOUBLE) + (n - x) * ln(0.8::DOUBLE) - CASE WHEN x > 0 AND x < n THEN x * ln(x / n) + (n - x) * ln(1 - x / n) ELSE 0 END) AS lr_uc,
    greatest(0, -2 * ((CASE WHEN n00 + n10 > 0 THEN (n00 + n10) * ln(1 - pp) ELSE 0 END + CASE WHEN n01 + n11 > 0 THEN (n01 + n11) * ln(pp) ELSE 0 END)
    - (CASE WHEN n00 > 0 THEN n00 * ln(1 - p01) ELSE 0 END + CASE WHEN n01 > 0 THEN n01 * ln(p01) ELSE 0 END + CASE WHEN n10 > 0 THEN n10 * ln(1 - p11) ELSE 0 END + CASE WHEN n11 > 0 THEN n11 * ln(p11) ELSE 0 END))) AS lr_ind FROM p)
  SELECT series_id, round(lr_uc, 6) AS lr_uc, round(lr_ind, 6) AS lr_ind, round(lr_uc + lr_ind, 6) AS lr_cc, round(exp(-(lr_uc + lr_ind) / 2), 6) AS p_cc, round(1 - {erf_sql('sqrt(greatest(lr_uc, 0) / 2)')}, 6) AS p_uc FROM q""")
def kupiec_christoffersen(spark, d):
    x = _returns(spark, d).withColumn("hit", F.col("r") < -1.0)
    return L.christoffersen(x, "hit", 0.2, ["series_id"]).select("series_id", *six("lr_uc", "lr_ind", "lr_cc", "p_cc", "p_uc"))


@query(f"""WITH {T.HOURLY}, {T.RETURNS} SELECT series_id, round(avg((0.025::DOUBLE - CASE WHEN r <= -1.5 THEN 1 ELSE 0 END) * (r + 1.5)), 6) AS tick,
  round(avg(-(CASE WHEN r <= -1.5 THEN 1 ELSE 0 END) * (-1.5::DOUBLE - r) / (0.025::DOUBLE * -2.0::DOUBLE) + (-1.5::DOUBLE) / (-2.0::DOUBLE) + ln(2.0::DOUBLE) - 1), 6) AS fz0 FROM rets GROUP BY 1""")
def tick_fz0(spark, d):
    v, e = F.lit(-1.5), F.lit(-2.0)
    return _returns(spark, d).groupBy("series_id").agg(F.round(F.avg(L.tick_loss(F.col("r"), v, 0.025)), 6).alias("tick"), F.round(F.avg(L.fz0_loss(F.col("r"), v, e, 0.025)), 6).alias("fz0"))


@query("""WITH x AS (SELECT o_totalprice / 600000.0::DOUBLE AS p, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM orders),
  c AS (SELECT [quantile_cont(p, 0.1), quantile_cont(p, 0.2), quantile_cont(p, 0.3), quantile_cont(p, 0.4), quantile_cont(p, 0.5), quantile_cont(p, 0.6), quantile_cont(p, 0.7), quantile_cont(p, 0.8), quantile_cont(p, 0.9)] AS cuts FROM x)
  SELECT CAST(len(list_filter(cuts, lambda z: z < p)) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM x, c GROUP BY 1""")
def reliability_bins(spark, d):
    x = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_totalprice") / 600000.0).alias("p"), (F.col("o_orderstatus") == "F").cast("double").alias("y"))
    return L.reliability(x, "p", "y").select("bin", "n", *six("mean_p", "mean_y"))


@query("""WITH p AS (SELECT n_name AS id, s_ AS p FROM (SELECT n_name, avg(s_acctbal) / 100000.0::DOUBLE + 0.01::DOUBLE AS s_ FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)),
  s AS (SELECT *, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p, id) + 1) * p) AS s FROM p) SELECT id, round(p, 12) AS p, round(max(s) OVER (ORDER BY p, id), 12) AS holm FROM s""")
def holm(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    p = s.groupBy(F.col("n_name").alias("id")).agg((F.avg("s_acctbal") / 100000.0 + 0.01).alias("p"))
    return L.holm(p, "p").select("id", F.round("p", 12).alias("p"), F.round("holm", 12).alias("holm"))


@query(f"""WITH {T.HOURLY}, {T.RETURNS}, x AS (SELECT series_id, r FROM rets WHERE r <> 0), k AS (SELECT *, rank() OVER (PARTITION BY series_id ORDER BY abs(r)) + (count(*) OVER (PARTITION BY series_id, abs(r)) - 1) / 2.0::DOUBLE AS k FROM x)
  SELECT series_id, sum(CASE WHEN r > 0 THEN k ELSE 0 END) AS w_plus FROM k GROUP BY 1""")
def wilcoxon_wplus(spark, d):
    x = _returns(spark, d).filter("r <> 0").withColumn("size", F.abs("r"))
    return L.average_ranks(x, ["series_id"], "size", "k").groupBy("series_id").agg(F.sum(F.when(F.col("r") > 0, F.col("k")).otherwise(0.0)).alias("w_plus"))


@query(f"WITH {T.HOURLY}, {T.RETURNS} SELECT series_id, t, round(close / first_value(close) OVER ({T.W}), 6) AS growth, round(coalesce(close / lag(close) OVER ({T.W}) - 1, 0), 6) AS ret FROM bars")
def buy_hold(spark, d):
    w = W.ordered()
    x = T.hourly(spark, d)
    return x.select("series_id", "t", F.round(F.col("close") / F.first("close").over(w), 6).alias("growth"), F.round(F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)), 6).alias("ret"))


__all__ = ["COUNTS", "STATE", "QUERIES", "ORACLES"]
