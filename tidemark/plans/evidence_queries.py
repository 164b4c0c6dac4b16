"""Queries over the bootstrap, block lengths, gates, single analogues and tests."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions import dependence as D
from tidemark.functions import distributions as P
from tidemark.functions import fits as N
from tidemark.functions import resampling as S
from tidemark.functions import windows as W
from tidemark.operators import analogue as A
from tidemark.operators import gate as G
from tidemark.operators import trades as B
from tidemark.operators import volatility as V

from . import tables as T
from .bars_queries import COUNTS, DATA, FORECAST, JUMPY, C, _pairs_sql, _returns, six
from .registry import Registry
from .trade_queries import FOLDS, erf_sql

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

# ---- the bootstrap
DRAWS, BLOCK, START = 200, 20, 61
MOVES = (20, 60)


def _even_sql(*of: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('-', {', '.join(of)})), 1, 13) AS BIGINT) + 1) / {float(1 << 52)}::DOUBLE"


def runs_sql(source: str, draws: int, block: str, seed: int = 0) -> str:
    """rn(series_id, n, draw, start, len) and place(series_id, draw, k): every drawn row (from 1) of ``source``(series_id, n)."""
    return f"""
rq AS (SELECT s.*, CAST(ceil(n / {block} + 6 * sqrt(n / {block}) + 10) AS BIGINT) AS most FROM {source} s),
re AS (SELECT q.*, d AS draw, unnest(range(1, most + 1)) AS run FROM rq q, range(0, {draws}) z(d)),
rl AS (SELECT *, least(floor({_even_sql('series_id', 'draw', 'run', str(2 * seed + 1))} * n), n - 1) AS start,
  CASE WHEN {block} > 1 THEN CAST(floor(ln({_even_sql('series_id', 'draw', 'run', str(2 * seed))}) / ln(1 - 1 / {block})) AS BIGINT) + 1 ELSE 1 END AS long FROM re),
rb AS (SELECT *, coalesce(sum(long) OVER (PARTITION BY series_id, draw ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rl),
rn AS (SELECT series_id, n, draw, CAST(start AS BIGINT) AS start, CAST(CASE WHEN run = most THEN n - before ELSE least(long, n - before) END AS BIGINT) AS len FROM rb WHERE n > before),
place AS (SELECT series_id, draw, (start + unnest(range(0, len))) % n + 1 AS k FROM rn)"""


SIMPLE = f"""{T.DAILY}, sm AS (SELECT *, coalesce(close / lag(close) OVER ({T.W}) - 1, 0) AS ret, {", ".join(f"sign(close - lag(close, {n}) OVER ({T.W})) AS p{n}" for n in MOVES)} FROM bars),
st AS (SELECT series_id, t, ret AS hold, {", ".join(f"lag(p{n}) OVER ({T.W}) * ret AS m{n}" for n in MOVES)} FROM sm),
sr AS (SELECT series_id, t, model, r FROM (SELECT * FROM st WHERE t >= {START}) UNPIVOT (r FOR model IN (hold, {", ".join(f"m{n}" for n in MOVES)})))"""


def _strategies(spark, d):
    """Daily returns of holding, and of going with the last moves."""
    w = W.ordered()
    x = T.daily(spark, d).withColumns({"hold": F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)), **{f"p{n}": F.signum(F.col("close") - F.lag("close", n).over(w)) for n in MOVES}})
    x = x.withColumns({f"m{n}": F.lag(f"p{n}").over(w) * F.col("hold") for n in MOVES}).filter(F.col("t") >= START)
    return x.unpivot(["series_id", "t"], ["hold", *(f"m{n}" for n in MOVES)], "model", "r")


#: by plain expansion: every draw's rows are listed and its statistics taken over them
DRAWN = f"""{SIMPLE}, ss AS (SELECT series_id, count(DISTINCT t) AS n FROM sr GROUP BY 1), {runs_sql('ss', DRAWS, f'{BLOCK}.0::DOUBLE')},
kk AS (SELECT *, row_number() OVER (PARTITION BY series_id, model ORDER BY t) AS k FROM sr)"""


@query(f"""WITH {DRAWN}, g AS (SELECT p.series_id, model, draw, avg(r) AS again FROM place p JOIN kk USING (series_id, k) GROUP BY ALL), m AS (SELECT series_id, model, avg(r) AS mean FROM sr GROUP BY ALL)
  SELECT series_id, model, CAST(draw AS INTEGER) AS draw, round(again, 9) AS again, round(mean, 9) AS mean FROM g JOIN m USING (series_id, model)""")
def bootstrap_means(spark, d):
    made = S.bootstrap_means(_strategies(spark, d).withColumnRenamed("r", "loss"), DRAWS, BLOCK)
    return made.select("series_id", "model", "draw", F.round("again", 9).alias("again"), F.round("mean", 9).alias("mean"))


@query(f"""WITH {DRAWN}, g AS (SELECT p.series_id, model, draw, avg(r) / stddev_samp(r) * sqrt(252) AS s FROM place p JOIN kk USING (series_id, k) GROUP BY ALL),
  o AS (SELECT series_id, model, avg(r) / stddev_samp(r) * sqrt(252) AS s FROM sr GROUP BY ALL),
  z AS (SELECT a.series_id, a.model, a.s - b.s AS d FROM g a JOIN g b ON a.series_id = b.series_id AND a.draw = b.draw AND b.model = 'hold' WHERE a.model <> 'hold'),
  x AS (SELECT series_id, model, least(1.0::DOUBLE, 2 * least(avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN d >= 0 THEN 1.0 ELSE 0.0 END))) AS p, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM z GROUP BY ALL)
  SELECT x.series_id, x.model, round(o.s - h.s, 6) AS diff, round(p, 6) AS p, round(low, 6) AS low, round(high, 6) AS high FROM x JOIN o USING (series_id, model) JOIN o h ON h.series_id = x.series_id AND h.model = 'hold'""")
def sharpe_difference(spark, d):
    return S.sharpe_difference(_strategies(spark, d), "hold", 252, DRAWS, BLOCK).select("series_id", "model", *six("diff", "p", "low", "high"))


COVS = f"""{T.DAILY}, ra AS (SELECT series_id, t, abs(coalesce(ln(close / lag(close) OVER ({T.W})), 0)) AS x FROM bars),
cs AS (SELECT series_id, count(*) AS n, avg(x) AS m FROM ra GROUP BY 1), cq AS (SELECT *, CAST(greatest(5, ceil(log10(n))) AS BIGINT) AS quiet FROM cs),
cl AS (SELECT *, unnest(range(0, CAST(ceil(sqrt(n)) AS BIGINT) + quiet + 1)) AS lag FROM cq),
cv AS (SELECT l.series_id, l.n, l.quiet, l.lag, sum((a.x - l.m) * (b.x - l.m)) / l.n AS cov FROM cl l JOIN ra a ON a.series_id = l.series_id JOIN ra b ON b.series_id = l.series_id AND b.t = a.t + l.lag GROUP BY l.series_id, l.n, l.quiet, l.lag)"""


def _sizes(spark, d):
    """Sizes of daily moves: they depend on each other over many days."""
    return T.daily(spark, d).select("series_id", "t", F.abs(W.log_return(F.col("close"))).alias("x"))


@query(f"WITH {COVS} SELECT series_id, CAST(lag AS INTEGER) AS lag, round(cov, 9) AS cov FROM cv")
def autocovariances(spark, d):
    return D.autocovariances(_sizes(spark, d), "x", ["series_id"]).select("series_id", "lag", F.round("cov", 9).alias("cov"))


@query(f"""WITH {COVS}, rho AS (SELECT c.*, b.cov AS base, c.lag > 0 AND abs(c.cov / b.cov) < 2 * sqrt(log10(c.n) / c.n) AS small FROM cv c JOIN cv b ON b.series_id = c.series_id AND b.lag = 0),
  still AS (SELECT a.series_id, min(a.lag) AS m FROM rho a WHERE (SELECT count(*) FROM rho b WHERE b.series_id = a.series_id AND b.lag > a.lag AND b.lag <= a.lag + a.quiet AND b.small) = a.quiet GROUP BY 1),
  top AS (SELECT series_id, max(lag) AS most FROM rho GROUP BY 1),
  mm AS (SELECT t.series_id, CAST(coalesce(least(2 * greatest(s.m, 1), most), most) AS DOUBLE) AS m FROM top t LEFT JOIN still s USING (series_id)),
  gd AS (SELECT r.series_id, any_value(n) AS n, sum(CASE WHEN lag = 0 THEN 1 ELSE 2 END * greatest(0, least(1, 2 * (1 - lag / m))) * lag * cov) AS g, sum(CASE WHEN lag = 0 THEN 1 ELSE 2 END * greatest(0, least(1, 2 * (1 - lag / m))) * cov) AS s FROM rho r JOIN mm USING (series_id) WHERE lag <= m GROUP BY 1)
  SELECT series_id, round(least(greatest(cbrt(2 * g * g / (2 * s * s)) * cbrt(n), 1), ceil(least(3 * sqrt(n), n / 3))), 6) AS block FROM gd""")
def block_lengths(spark, d):
    return D.block_lengths(_sizes(spark, d), "x", ["series_id"]).select("series_id", *six("block"))


# ---- the gate
WINDOW, GATE = 100, 0.9


@query(f"""WITH RECURSIVE {T.HOURLY}, {T.RETURNS}, {JUMPY}, {FOLDS},
  pp AS (SELECT series_id, t, 1 - exp(-5 * {T.whole('sum(CAST(jump AS DOUBLE))', 'jump', T.rows(WINDOW), WINDOW)} / {WINDOW}) AS p FROM jy),
  th AS (SELECT f.series_id, f.fold, quantile_cont(p, {GATE}) AS threshold FROM pp JOIN fd f USING (series_id) WHERE t >= {C.warmup} AND t < a GROUP BY ALL)
  SELECT f.series_id, f.fold, t, round(p, 6) AS p, round(threshold, 6) AS threshold, NOT coalesce(p > threshold, false) AS allowed
  FROM pp JOIN fd f ON f.series_id = pp.series_id AND t < b AND (t >= a OR f.fold = 0) LEFT JOIN th ON th.series_id = f.series_id AND th.fold = f.fold""")
def gate(spark, d):
    """The jump gate by the Poisson rate."""
    jumps = _returns(spark, d).select("series_id", "t", (F.abs("r") > 1.0).alias("jump"))
    folds = B.folds(T.hourly(spark, d), C.warmup, least=100)
    return G.gate(G.jump_probability(jumps, folds, "poisson", 5, C.warmup, WINDOW), C.warmup, GATE).select("series_id", "fold", "t", *six("p", "threshold"), "allowed")


# ---- the nearest past of a few bars
TIMES = ("1995-06-17", "1996-12-31", "1998-05-05")
NEAR = f"""wh AS (SELECT w, min(t) AS t FROM (VALUES {", ".join(f"(TIMESTAMP '{x}')" for x in TIMES)}) v(w) JOIN bars ON ts >= w GROUP BY 1),
nq AS (SELECT DISTINCT d.* FROM data d WHERE t IN (SELECT t FROM wh) AND e0 + e1 + e2 + e3 IS NOT NULL),
nl AS (SELECT q.t, list(struct_pack(j := o.t, d := (o.e0 - q.e0) * (o.e0 - q.e0) + (o.e1 - q.e1) * (o.e1 - q.e1) + (o.e2 - q.e2) * (o.e2 - q.e2) + (o.e3 - q.e3) * (o.e3 - q.e3)) ORDER BY (o.e0 - q.e0) * (o.e0 - q.e0) + (o.e1 - q.e1) * (o.e1 - q.e1) + (o.e2 - q.e2) * (o.e2 - q.e2) + (o.e3 - q.e3) * (o.e3 - q.e3), o.t) AS l
  FROM nq q JOIN data o ON o.t <= q.t - {C.h} AND o.t >= {C.warmup // 2} AND o.target IS NOT NULL AND o.e0 + o.e1 + o.e2 + o.e3 IS NOT NULL GROUP BY q.t),
nc AS (SELECT t, list_reduce(list_transform(l, lambda x: [x]), lambda a, y: CASE WHEN len(a) < 10 AND len(list_filter(a, lambda z: abs(z.j - y[1].j) < {C.h})) = 0 THEN list_concat(a, y) ELSE a END) AS got FROM nl),
np AS (SELECT t, unnest(range(1, len(got) + 1)) AS rank, got[unnest(range(1, len(got) + 1))].j AS j, got[unnest(range(1, len(got) + 1))].d AS d FROM nc)"""


def _asked(spark, d):
    bars = T.order_days(spark, d)
    times = spark.range(1).select(F.lit("orders").alias("series_id"), F.explode(F.array(*(F.to_timestamp(F.lit(x)) for x in TIMES))).alias("when"))
    return T.kept(V.vol_data(bars, C)), T.kept(A.at_or_after(bars, times).select("series_id", "t").distinct())


@query(f"WITH RECURSIVE {T.ORDER_DAYS}, {DATA}, {NEAR} SELECT 'orders' AS series_id, t, CAST(rank AS INTEGER) AS rank, j AS anchor_t, round(d, 6) AS distance FROM np")
def nearest_analogues(spark, d):
    """The ten nearest days of the first days at or after three dates."""
    data, asked = _asked(spark, d)
    near = A.nearest_to(data.select("series_id", "t", "emb", F.array("target").alias("y")), asked, 10, C.h, C.h, C.warmup // 2)
    return near.select("series_id", "t", "rank", "anchor_t", *six("distance"))


ASKED = _pairs_sql(True).replace(f"WHERE t >= {C.warmup} AND", f"WHERE t >= {C.warmup} AND t IN (SELECT t FROM wh) AND")


@query(f"""WITH RECURSIVE {T.ORDER_DAYS}, {DATA}, {COUNTS}, {NEAR}, {ASKED}, {FORECAST},
  ln_ AS (SELECT t, 'now' AS line, t AS j FROM nq UNION ALL SELECT t, 'analogue ' || rank, j FROM np),
  pts AS (SELECT l.t, line, x, CASE x WHEN -3 THEN e0 WHEN -2 THEN e1 WHEN -1 THEN e2 ELSE e3 END AS y FROM ln_ l JOIN data o ON o.t = l.j, range(-3, 1) r(x)
    UNION ALL SELECT l.t, CASE line WHEN 'now' THEN 'realised' ELSE line END, 1, target - ln(lv) FROM ln_ l JOIN data o ON o.t = l.j WHERE target IS NOT NULL UNION ALL SELECT t, 'forecast', 1, mean_0 FROM fc)
  SELECT 'orders' AS series_id, t, line, CAST(x AS INTEGER) AS x, round(y, 6) AS y FROM pts""")
def analogue_explanation(spark, d):
    """Lines of past shapes and outcomes: the days asked for, their analogues, the forecast and what came."""
    data, asked = _asked(spark, d)
    return V.explanation(data, asked, C).select("series_id", "t", "line", "x", *six("y"))


# ---- tests
GRID = {"w": (5, 10, 20), "z": (0.0, 0.5, 1.0)}
#: What the best of so many trials reaches by luck, in deviations.
LUCK = " ".join(f"WHEN {n} THEN {(1 - P.EULER) * NormalDist().inv_cdf(1 - 1 / n) + P.EULER * NormalDist().inv_cdf(1 - 1 / (n * math.e))!r}" for n in range(2, 1 + len(GRID["w"]) * len(GRID["z"])))


@query(f"""WITH {T.DAILY}, x AS (SELECT *, coalesce(ln(close / lag(close) OVER ({T.W})), 0) AS r, coalesce(close / lag(close) OVER ({T.W}) - 1, 0) AS ret, {", ".join(f"ln(close / lag(close, {w}) OVER ({T.W})) AS m{w}" for w in GRID['w'])} FROM bars),
  y AS (SELECT *, sqrt(greatest(avg(r * r) OVER v - avg(r) OVER v * avg(r) OVER v, 0)) AS sd FROM x WINDOW v AS ({T.W} {T.rows(20)})),
  g AS (SELECT series_id, t, ret, sd, w, CASE w {" ".join(f"WHEN {w} THEN m{w}" for w in GRID['w'])} END AS m, z FROM y, (VALUES {", ".join(f"({w})" for w in GRID['w'])}) a(w), (VALUES {", ".join(f"({z}::DOUBLE)" for z in GRID['z'])}) b(z)),
  p AS (SELECT *, lag(CASE WHEN abs(m) > z * sd * sqrt(w) THEN sign(m) ELSE 0 END) OVER (PARTITION BY series_id, w, z ORDER BY t) * ret AS tr FROM g),
  q AS (SELECT * FROM p WHERE t >= {START}), s AS (SELECT series_id, w, z, avg(tr) AS m, stddev_samp(tr) AS sd, count(*) AS n FROM q GROUP BY ALL HAVING stddev_samp(tr) > 0),
  c AS (SELECT q.series_id, q.w, q.z, any_value(s.m) / any_value(s.sd) AS sr, any_value(n) AS n, avg(pow(tr - s.m, 3)) / pow(avg(pow(tr - s.m, 2)), 1.5::DOUBLE) AS g3, avg(pow(tr - s.m, 4)) / pow(avg(pow(tr - s.m, 2)), 2) AS g4 FROM q JOIN s USING (series_id, w, z) GROUP BY ALL),
  b AS (SELECT series_id, CASE count(*) {LUCK} ELSE 0.0 END::DOUBLE * coalesce(stddev_samp(m / sd), 0) AS best FROM s GROUP BY 1),
  k AS (SELECT c.*, best, (sr - best) * sqrt(n - 1) / sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr * sr) / sqrt(2) AS e FROM c JOIN b USING (series_id))
  SELECT series_id, CAST(w AS INTEGER) AS w, z, round(sr, 6) AS sr, round(best, 6) AS best, round((1 + sign(e) * {erf_sql('abs(e)')}) / 2, 6) AS dsr FROM k""")
def deflated_sharpe(spark, d):
    """Every setting of a grid of spans and thresholds, against the best that so many settings reach by luck."""
    x = T.daily(spark, d).withColumns({"r": W.log_return(F.col("close")), "ret": F.coalesce(F.col("close") / F.lag("close").over(W.ordered()) - 1, F.lit(0.0))})
    moves = F.array(*(F.struct(F.lit(w).alias("w"), F.log(F.col("close") / F.lag("close", w).over(W.ordered())).alias("m")) for w in GRID["w"]))
    x = x.withColumns({"sd": W.stdev(F.col("r"), 20), "moves": moves})
    grid = x.select("series_id", "t", "ret", "sd", F.explode("moves").alias("a")).select("series_id", "t", "ret", "sd", "a.w", "a.m", F.explode(F.array(*(F.lit(z) for z in GRID["z"]))).alias("z"))
    side = F.when(F.abs("m") > F.col("z") * F.col("sd") * F.sqrt("w"), F.signum("m")).otherwise(0.0)
    trades = grid.withColumn("side", side).withColumn("tr", F.lag("side").over(Window.partitionBy("series_id", "w", "z").orderBy("t")) * F.col("ret"))
    return P.deflated_sharpe(trades.filter(F.col("t") >= START), ["series_id"], ["w", "z"], "tr").select("series_id", "w", "z", *six("sr", "best", "dsr"))


def _balances(spark, d):
    """How far suppliers' balances are from the middle of their range, by region."""
    nation = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.col("n_regionkey").cast("long").alias("region"))
    return spark.read.parquet(f"{d}/supplier.parquet").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("region", (F.col("s_acctbal") - 4500).alias("x"))


BALANCES = "sx AS (SELECT CAST(n_regionkey AS BIGINT) AS region, s_acctbal - 4500 AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
DENSITY = "exp(lgamma((f + 1) / 2) - lgamma(f / 2) - 0.5::DOUBLE * ln(f * pi()) - (f + 1) / 2 * ln(1 + u * u / f))"


@query(f"""WITH {BALANCES}, s AS (SELECT region, count(*) AS n, avg(x) AS mean, avg(x) / (stddev_samp(x) / sqrt(count(*))) AS t FROM sx GROUP BY 1 HAVING count(*) > 1),
  k AS (SELECT *, CAST(n - 1 AS DOUBLE) AS f FROM s), i AS (SELECT region, abs(t) / 1000 * unnest(range(0, 1001)) AS u, f, CASE WHEN unnest(range(0, 1001)) IN (0, 1000) THEN 1 WHEN unnest(range(0, 1001)) % 2 = 1 THEN 4 ELSE 2 END AS c FROM k),
  a AS (SELECT region, sum(c * {DENSITY}) AS area FROM i GROUP BY 1)
  SELECT region, n, round(mean, 6) AS mean, round(t, 6) AS t, round(1 - 2 * area * abs(t) / 3000, 6) AS p FROM k JOIN a USING (region)""")
def t_tests(spark, d):
    return P.t_test(_balances(spark, d), ["region"], "x").filter("n > 1").select("region", "n", *six("mean", "t", "p"))


@query(f"""WITH RECURSIVE {BALANCES}, ways(n, c) AS (SELECT 0, list_transform(range(0, 1276), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
    UNION ALL SELECT n + 1, list_transform(range(1, 1277), lambda i: (c[i] + CASE WHEN i > n + 1 THEN c[i - n - 1] ELSE 0.0::DOUBLE END) / 2) FROM ways WHERE n < 50),
  v AS (SELECT region, x, rank() OVER (PARTITION BY region ORDER BY abs(x)) + (count(*) OVER (PARTITION BY region, abs(x)) - 1) / 2.0::DOUBLE AS k, count(*) OVER (PARTITION BY region, abs(x)) AS c FROM sx WHERE x <> 0),
  s AS (SELECT region, count(*) AS n, CAST(sum(CASE WHEN x > 0 THEN k ELSE 0 END) AS DOUBLE) AS w, CAST(sum(c * c - 1) AS DOUBLE) AS ties FROM v GROUP BY 1),
  e AS (SELECT s.*, ways.c AS c, (w - s.n * (s.n + 1) / 4.0::DOUBLE) / sqrt(s.n * (s.n + 1) * (2 * s.n + 1) / 24.0::DOUBLE - ties / 48) / sqrt(2.0::DOUBLE) AS z FROM s LEFT JOIN ways ON ways.n = s.n AND ties = 0),
  p AS (SELECT *, CASE WHEN c IS NOT NULL THEN list_sum(c[1 : CAST(w AS BIGINT) + 1]) ELSE (1 + sign(z) * {erf_sql('abs(z)')}) / 2 END AS lo, CASE WHEN c IS NOT NULL THEN list_sum(c[CAST(w AS BIGINT) + 1 :]) ELSE (1 - sign(z) * {erf_sql('abs(z)')}) / 2 END AS hi FROM e)
  SELECT region, n, round(w, 6) AS w_plus, CASE WHEN n >= 5 THEN round(least(1, 2 * least(lo, hi)), 6) END AS p, CASE WHEN n >= 5 THEN round(lo, 6) END AS p_less, CASE WHEN n >= 5 THEN round(hi, 6) END AS p_greater FROM p""")
def signed_rank_tests(spark, d):
    return P.signed_rank(_balances(spark, d), ["region"], "x").select("region", "n", *six("w_plus", "p", "p_less", "p_greater"))


@query(f"""WITH {BALANCES}, s AS (SELECT region, count(*) AS n, sum(CASE WHEN x > 0 THEN 1 ELSE 0 END) AS wins FROM sx GROUP BY 1)
  SELECT region, n, CAST(wins AS BIGINT) AS wins, round(least(1, list_sum(list_transform(range(CAST(wins AS BIGINT), n + 1), lambda k: exp(lgamma(n + 1.0::DOUBLE) - lgamma(k + 1.0::DOUBLE) - lgamma(n - k + 1.0::DOUBLE) - n * ln(2.0::DOUBLE))))), 6) AS p FROM s""")
def sign_tests(spark, d):
    s = _balances(spark, d).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("x") > 0).cast("long")).alias("wins"))
    return s.withColumn("p", P.sign_test(F.col("wins"), F.col("n"))).select("region", "n", "wins", *six("p"))



# ---- fits of all groups together
def newton_sql(source: str, rounds: int) -> str:
    """Logistic fits of source(g, x, y), a step a table."""
    out = f"w0_ AS (SELECT g, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM {source} GROUP BY 1)"
    for i in range(rounds):
        out += f""",
n{i} AS (SELECT s.g, any_value(w.a) AS a, any_value(w.b) AS b, sum(y - p) AS g0, sum((y - p) * x) AS g1, sum(p * (1 - p)) + 1e-9::DOUBLE AS h0, sum(p * (1 - p) * x) AS h1, sum(p * (1 - p) * x * x) + 1e-9::DOUBLE AS h2
  FROM (SELECT s.*, 1 / (1 + exp(-(w.a + w.b * s.x))) AS p FROM {source} s JOIN w{i}_ w ON s.g = w.g) s JOIN w{i}_ w ON s.g = w.g GROUP BY 1),
w{i + 1}_ AS (SELECT g, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM n{i})"""
    return out


@query(f"""WITH src AS (SELECT l_linenumber AS g, CAST(l_discount * 10 + l_quantity / 50 AS DOUBLE) AS x, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM lineitem), {newton_sql('src', 8)}
  SELECT g, round(a, 6) AS w0, round(b, 6) AS w1 FROM w8_""")
def logistic_fits(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linenumber").alias("g"), (F.col("l_discount") * 10 + F.col("l_quantity") / 50).alias("x"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    return N.logistic_fits(x, ["g"], "x", "y").select("g", *six("w0", "w1"))


def narrowing_sql(source: str, rounds: int, points: int) -> str:
    """Degrees of freedom of source(series_id, zz), a grid a table."""
    out = f"b0 AS (SELECT series_id, {N.LEAST}::DOUBLE AS lo, {N.MOST}::DOUBLE AS hi FROM {source} GROUP BY 1)"
    for i in range(rounds):
        out += f""",
c{i} AS (SELECT *, lo + (hi - lo) * i / {points - 1} AS nu FROM b{i}, range(0, {points}) r(i)),
e{i} AS (SELECT c.series_id, c.i, any_value(lo) AS lo, any_value(hi) AS hi, count(*) * (lgamma((any_value(nu) + 1) / 2) - lgamma(any_value(nu) / 2) - 0.5::DOUBLE * ln((any_value(nu) - 2) * pi())) - (any_value(nu) + 1) / 2 * sum(ln(1 + zz / (nu - 2))) AS ll FROM c{i} c JOIN {source} s ON s.series_id = c.series_id GROUP BY 1, 2),
b{i + 1} AS (SELECT series_id, any_value(lo) + (any_value(hi) - any_value(lo)) / {points - 1} * greatest(arg_max(i, ll) - 1, 0) AS lo, any_value(lo) + (any_value(hi) - any_value(lo)) / {points - 1} * least(arg_max(i, ll) + 1, {points - 1}) AS hi FROM e{i} GROUP BY 1)"""
    return out


@query(f"""WITH {T.DAILY}, {T.RETURNS}, m AS (SELECT series_id, avg(r) AS m, stddev_samp(r) AS sd FROM rets GROUP BY 1), src AS (SELECT series_id, pow((r - m) / sd, 2) AS zz FROM rets JOIN m USING (series_id)), {narrowing_sql('src', 12, 9)}
  SELECT series_id, round((lo + hi) / 2, 3) AS nu FROM b12""")
def student_fits(spark, d):
    """How heavy the tails of daily moves are."""
    x = T.daily(spark, d).withColumn("r", W.log_return(F.col("close")))
    m = x.groupBy("series_id").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"))
    z = x.join(m, "series_id").withColumn("z", (F.col("r") - F.col("m")) / F.col("sd"))
    return N.student_freedom(z, ["series_id"], "z").select("series_id", F.round("nu", 3).alias("nu"))
