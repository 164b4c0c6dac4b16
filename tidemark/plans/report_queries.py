"""Studies over two sets of series whose models SQL can express, and the reports made of their tables.

The development set is the hourly series of events, the confirmatory set the daily series of orders; a third set has
the daily series with adjusted prices.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions import dependence as D
from tidemark.functions import losses as L
from tidemark.functions import recurrences as R
from tidemark.functions import resampling as S
from tidemark.functions import windows as W
from tidemark.operators import reports as Q
from tidemark.operators import trades as TR
from tidemark.sources import bars as SB

from . import tables as T
from .bars_queries import six
from .evidence_queries import runs_sql
from .registry import Registry
from .trade_queries import erf_sql

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

FIRST, H, DRAWS, BLOCK = 100, 5, 100, 10
MODELS = ("EWMA", "Slow", "Mean")
SET = "split_part(series_id, '/', 1)"
FACTOR = "pow(0.995, floor((max(t) OVER (PARTITION BY series_id) - t) / 60))"

BOTH = f"""{T._bars_sql('ha', 'events', "'dev/' || event_type", "date_trunc('hour', ts)", 'ts, event_id', 'value')}, {T._bars_sql('hc', 'orders', "'conf/' || o_orderpriority", "date_trunc('day', o_orderdate)", 'o_orderdate, o_orderkey', 'o_totalprice')},
hj AS (SELECT 'adj/' || split_part(series_id, '/', 2) AS series_id, ts, open * f AS open, high * f AS high, low * f AS low, close * f AS close, volume, t FROM (SELECT *, {FACTOR} AS f FROM hc)),
bars AS (SELECT * FROM ha UNION ALL SELECT * FROM hc UNION ALL SELECT * FROM hj)"""


def _both(spark, d):
    """All three sets of series as one frame."""
    named = lambda df, name: df.withColumn("series_id", F.concat(F.lit(f"{name}/"), "series_id"))
    daily = T.daily(spark, d)
    back = F.floor((F.max("t").over(Window.partitionBy("series_id")) - F.col("t")) / 60)
    adjusted = SB.adjust(daily.withColumn("adj_close", F.col("close") * F.pow(F.lit(0.995), back))).drop("adj_close")
    out = named(T.hourly(spark, d), "dev").unionByName(named(daily, "conf")).unionByName(named(adjusted, "adj"))
    return out.withColumns({"r": W.log_return(F.col("close")), "tr": W.true_range()})


def _set(df):
    return df.withColumn("set", F.split_part("series_id", F.lit("/"), F.lit(1)))


# ---- volatility
LOSSES = f"""{BOTH}, {T.RETURNS}, {T.ewma_sql('ea', 20)}, {T.ewma_sql('eb', 80)},
rw AS (SELECT series_id, t, r, {T.whole('avg(r * r)', 'r', T.ahead(H), H)} AS realised, {T.whole('avg(r * r)', 'r', T.rows(50), 50)} AS mean_ FROM rets),
vv AS (SELECT rw.*, ea.v AS ewma, eb.v AS slow FROM rw JOIN ea USING (series_id, t) JOIN eb USING (series_id, t) WHERE t >= {FIRST} AND realised > 0 AND mean_ > 0 AND ea.v > 0 AND eb.v > 0),
vl AS (SELECT series_id, t, model, realised / v - ln(realised / v) - 1 AS loss FROM (SELECT series_id, t, realised, ewma AS "EWMA", slow AS "Slow", mean_ AS "Mean" FROM vv) UNPIVOT (v FOR model IN ("EWMA", "Slow", "Mean")))"""


def _losses(spark, d):
    x = R.with_ewma(R.with_ewma(_both(spark, d), 20, "sa"), 80, "sb")
    square = F.col("r") * F.col("r")
    x = x.withColumns({"realised": W.forward_mean(square, H), "Mean": W.sma(square, 50), "EWMA": F.col("sa") ** 2, "Slow": F.col("sb") ** 2})
    x = x.filter(f"t >= {FIRST} AND realised > 0 AND Mean > 0 AND EWMA > 0 AND Slow > 0").unpivot(["series_id", "t", "realised"], list(MODELS), "model", "v")
    return T.kept(x.select("series_id", "t", "model", L.qlike(F.col("realised"), F.log("v")).alias("loss")))


def mcs_sql(p: str, source: str, models: int, draws: int, block: str, sizes: str) -> str:
    """{p}s(series_id, model, mean, p): the confidence set of source(series_id, t, model, loss), draw by draw."""
    own, model = "PARTITION BY series_id, draw", "PARTITION BY series_id, model"
    out = f"""{_prefixed(p, runs_sql(sizes, draws, block))},
{p}k AS (SELECT *, row_number() OVER (PARTITION BY series_id, model ORDER BY t) AS k FROM {source}), {p}m AS (SELECT series_id, model, avg(loss) AS mean FROM {source} GROUP BY ALL),
{p}x0 AS (SELECT q.series_id, q.model, q.draw, again - mean AS noise, mean, 0.0::DOUBLE AS level, NULL::DOUBLE AS p FROM (SELECT a.series_id, model, draw, avg(loss) AS again FROM {p}place a JOIN {p}k USING (series_id, k) GROUP BY ALL) q JOIN {p}m USING (series_id, model))"""
    for i in range(models - 1):
        out += f""",
{p}a{i} AS (SELECT *, CASE WHEN p IS NULL THEN mean - avg(CASE WHEN p IS NULL THEN mean END) OVER ({own}) END AS d, CASE WHEN p IS NULL THEN noise - avg(CASE WHEN p IS NULL THEN noise END) OVER ({own}) END AS z FROM {p}x{i}),
{p}b{i} AS (SELECT *, sqrt(avg(z * z) OVER ({model})) AS se FROM {p}a{i}),
{p}e{i} AS (SELECT series_id, draw, max(CASE WHEN se > 0 THEN d / se WHEN p IS NULL THEN 0 END) AS most, max(CASE WHEN se > 0 THEN z / se WHEN p IS NULL THEN 0 END) AS chance, arg_max(model, CASE WHEN se > 0 THEN d / se WHEN p IS NULL THEN 0 END) AS worst FROM {p}b{i} GROUP BY ALL),
{p}l{i} AS (SELECT series_id, avg(CASE WHEN chance >= most THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS q, any_value(worst) AS worst FROM {p}e{i} GROUP BY 1),
{p}x{i + 1} AS (SELECT x.series_id, x.model, x.draw, noise, mean, greatest(level, q) AS level, CASE WHEN p IS NULL AND model = worst THEN greatest(level, q) ELSE p END AS p FROM {p}x{i} x JOIN {p}l{i} USING (series_id))"""
    return out + f",\n{p}s AS (SELECT series_id, model, mean, coalesce(p, 1.0::DOUBLE) AS p FROM {p}x{models - 1} WHERE draw = 0)"


def _prefixed(p: str, sql: str) -> str:
    """runs_sql under other names, so that it can be used twice."""
    for name in ("place", "rq", "re", "rl", "rb", "rn"):
        sql = sql.replace(f"\n{name} AS", f"\n{p}{name} AS").replace(f"FROM {name}", f"FROM {p}{name}")
    return sql


def block_sql(p: str, source: str, keys: str) -> str:
    """{p}b(keys, block): block lengths of source(keys, t, x)."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    under = lambda a: ", ".join(f"{a}.{k}" for k in keys.split(", "))
    return f"""
{p}i AS (SELECT {keys}, x, row_number() OVER (PARTITION BY {keys} ORDER BY t) AS i FROM {source}), {p}z AS (SELECT {keys}, count(*) AS n, avg(x) AS m, CAST(greatest(5, ceil(log10(count(*)))) AS BIGINT) AS quiet FROM {p}i GROUP BY {keys}),
{p}g AS (SELECT *, unnest(range(0, CAST(ceil(sqrt(n)) AS BIGINT) + quiet + 1)) AS lag FROM {p}z),
{p}c AS (SELECT {under('l')}, l.n, l.quiet, l.lag, sum((a.x - l.m) * (b.x - l.m)) / l.n AS cov FROM {p}g l JOIN {p}i a ON {on('a', 'l')} JOIN {p}i b ON {on('b', 'l')} AND b.i = a.i + l.lag GROUP BY {under('l')}, l.n, l.quiet, l.lag),
{p}r AS (SELECT c.*, b.cov AS base, c.lag > 0 AND abs(c.cov) < b.cov * 2 * sqrt(log10(c.n) / c.n) AS small FROM {p}c c JOIN {p}c b ON {on('b', 'c')} AND b.lag = 0),
{p}t AS (SELECT {under('a')}, a.lag, count(*) AS ok FROM {p}r a JOIN {p}r b ON {on('a', 'b')} AND b.lag > a.lag AND b.lag <= a.lag + a.quiet AND b.small GROUP BY {under('a')}, a.lag, a.quiet HAVING count(*) = a.quiet),
{p}u AS (SELECT {keys}, min(lag) AS m FROM {p}t GROUP BY {keys}),
{p}v AS (SELECT {under('r')}, max(r.lag) AS most, any_value(n) AS n FROM {p}r r GROUP BY {under('r')}),
{p}w AS (SELECT v.*, CAST(coalesce(least(2 * greatest(u.m, 1), most), most) AS DOUBLE) AS mm FROM {p}v v LEFT JOIN {p}u u ON {on('u', 'v')}),
{p}y AS (SELECT {under('w')}, any_value(w.n) AS n, sum(CASE WHEN lag = 0 THEN 1 ELSE 2 END * greatest(0, least(1, 2 * (1 - lag / mm))) * lag * cov) AS g, sum(CASE WHEN lag = 0 THEN 1 ELSE 2 END * greatest(0, least(1, 2 * (1 - lag / mm))) * cov) AS s FROM {p}w w JOIN {p}r r ON {on('r', 'w')} WHERE lag <= mm GROUP BY {under('w')}),
{p}b AS (SELECT {keys}, CASE WHEN s <> 0 THEN least(greatest(cbrt(g * g / (s * s)) * cbrt(n), 1), ceil(least(3 * sqrt(n), n / 3))) ELSE 1 END AS block FROM {p}y)"""


FIXED = f"{LOSSES}, vn AS (SELECT series_id, count(DISTINCT t) AS n FROM vl GROUP BY 1), {mcs_sql('f', 'vl', 3, DRAWS, f'{BLOCK}.0::DOUBLE', 'vn')}"
SCORES = f"""{FIXED}, sc AS (SELECT {SET} AS set, split_part(series_id, '/', 2) AS series, model, mean AS qlike, mean / max(CASE WHEN model = 'EWMA' THEN mean END) OVER (PARTITION BY series_id) AS ratio, p AS mcs_p FROM fs)"""


def _scored(chosen):
    base = F.max(F.when(F.col("model") == "EWMA", F.col("mean"))).over(Window.partitionBy("series_id"))
    return _set(chosen.withColumn("ratio", F.col("mean") / base)).select("set", F.split_part("series_id", F.lit("/"), F.lit(2)).alias("series_id"), "model", F.col("mean").alias("qlike"), "ratio", F.col("p").alias("mcs_p"))


def _scores(spark, d):
    return T.kept(_scored(S.confidence_set(_losses(spark, d), 3, DRAWS, BLOCK)))


@query(f"WITH RECURSIVE {SCORES} SELECT set, series AS series_id, model, round(qlike, 6) AS qlike, round(ratio, 6) AS ratio, round(mcs_p, 6) AS mcs_p FROM sc")
def volatility_sets(spark, d):
    """Losses of three models, over that of the first, and the confidence set, for all series of three sets."""
    return _scores(spark, d).select("set", "series_id", "model", *six("qlike", "ratio", "mcs_p"))


@query(f"""WITH RECURSIVE {SCORES}, li AS (SELECT set, series AS line, model, ratio AS v FROM sc UNION ALL SELECT set, 'mean', model, avg(ratio) FROM sc GROUP BY ALL UNION ALL SELECT set, 'members', model, sum(CASE WHEN mcs_p >= 0.1 THEN 1.0 ELSE 0.0 END) FROM sc GROUP BY ALL)
  SELECT set, line, {", ".join(f"round(max(CASE WHEN model = '{m}' THEN v END), 6) AS {m.lower()}_" for m in MODELS)} FROM li WHERE set <> 'adj' GROUP BY 1, 2""")
def report_volatility(spark, d):
    out = Q.with_closing_rows(_scores(spark, d).filter("set <> 'adj'"), MODELS)
    return out.select("set", "line", *(F.round(m, 6).alias(f"{m.lower()}_") for m in MODELS))


@query(f"""WITH RECURSIVE {SCORES} SELECT coalesce(a.series, b.series) AS series_id, coalesce(a.model, b.model) AS model, CASE WHEN b.series IS NULL THEN 'before' WHEN a.series IS NULL THEN 'after' ELSE 'both' END AS side,
  round(a.ratio, 6) AS before, round(b.ratio, 6) AS after, round(b.ratio - a.ratio, 6) AS change FROM (SELECT * FROM sc WHERE set = 'conf') a FULL JOIN (SELECT * FROM sc WHERE set = 'adj') b ON a.series = b.series AND a.model = b.model""")
def compare_adjusted(spark, d):
    """Ratios of losses with plain and with adjusted prices."""
    s = _scores(spark, d)
    out = Q.changed_values(s.filter("set = 'conf'"), s.filter("set = 'adj'"), ["series_id", "model"], "ratio")
    return out.select("series_id", "model", "side", *six("before", "after", "change"))


AUTO = f"""{FIXED}, vd AS (SELECT series_id, model, t, loss - avg(loss) OVER (PARTITION BY series_id, t) AS x FROM vl), {block_sql('bo', 'vd', 'series_id, model')},
bom AS (SELECT series_id, greatest(1, round_even(avg(block), 0))::DOUBLE AS block FROM bob GROUP BY 1), bon AS (SELECT vn.series_id, n, block FROM vn JOIN bom USING (series_id)), {mcs_sql('q', 'vl', 3, DRAWS, 'block', 'bon')}"""


@query(f"""WITH RECURSIVE {AUTO}, j AS (SELECT split_part(f.series_id, '/', 1) AS set, f.p >= 0.1 AS a, q.p >= 0.1 AS b FROM fs f JOIN qs q USING (series_id, model) WHERE f.series_id NOT LIKE 'adj/%')
  SELECT set, CAST(count(*) AS BIGINT) AS cases, CAST(sum(CASE WHEN a THEN 1 ELSE 0 END) AS BIGINT) AS found_before, CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) AS BIGINT) AS found_after, CAST(sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS BIGINT) AS changed, CAST(0 AS BIGINT) AS only_before, CAST(0 AS BIGINT) AS only_after FROM j GROUP BY 1""")
def compare_blocks(spark, d):
    """How many memberships change when block lengths come from the losses instead of being fixed."""
    losses = _losses(spark, d).filter("series_id NOT LIKE 'adj/%'")
    apart = losses.withColumn("x", F.col("loss") - F.avg("loss").over(Window.partitionBy("series_id", "t")))
    blocks = T.kept(D.common_block(apart, "x", ["series_id"], ["model"]))
    fixed, auto = _scored(S.confidence_set(losses, 3, DRAWS, BLOCK)), _scored(S.confidence_set(losses, 3, DRAWS, None, blocks=blocks))
    return Q.changed_verdicts(fixed, auto, ["set", "series_id", "model"], ["set"], "mcs_p", F.col("mcs_p") >= Q.MEMBER)


SIGNED = """ways(n, c) AS (SELECT 0, list_transform(range(0, 1276), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
    UNION ALL SELECT n + 1, list_transform(range(1, 1277), lambda i: (c[i] + CASE WHEN i > n + 1 THEN c[i - n - 1] ELSE 0.0::DOUBLE END) / 2) FROM ways WHERE n < 50)"""
#: five series without ties are few enough for the exact law
RANKED = f"""lr AS (SELECT set, model, ln(ratio) AS x FROM sc WHERE model <> 'EWMA'), lk AS (SELECT *, rank() OVER (PARTITION BY set, model ORDER BY abs(x)) AS k FROM lr WHERE x <> 0),
lw AS (SELECT set, model, count(*) AS n, sum(CASE WHEN x > 0 THEN k ELSE 0 END) AS w FROM lk GROUP BY ALL),
lp AS (SELECT set, model, w, least(1, 2 * least(list_sum(c[1 : CAST(w AS BIGINT) + 1]), list_sum(c[CAST(w AS BIGINT) + 1 :]))) AS p FROM lw JOIN ways USING (n)),
lt AS (SELECT lr.set, lr.model, CAST(count(*) AS BIGINT) AS series, exp(quantile_cont(x, 0.5)) AS median_ratio, any_value(w) AS w_plus, any_value(p) AS p FROM lr JOIN lp ON lr.set = lp.set AND lr.model = lp.model GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {SIGNED}, {SCORES}, {RANKED} SELECT set, model, series, round(median_ratio, 6) AS median_ratio, round(w_plus, 6) AS w_plus, round(p, 6) AS p FROM lt")
def ratio_tests(spark, d):
    return Q.ratio_tests(_scores(spark, d), "EWMA").select("set", "model", "series", *six("median_ratio", "w_plus", "p"))


@query(f"""WITH RECURSIVE {SIGNED}, {SCORES}, {RANKED}, c AS (SELECT *, greatest(0, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p, model) + 1) * p)) AS s FROM lt WHERE set = 'conf'),
  z AS (SELECT *, max(s) OVER (ORDER BY p, model) AS holm FROM c)
  SELECT z.model AS id, round(a.median_ratio, 6) AS first_statistic, round(a.p, 6) AS first_p, round(z.median_ratio, 6) AS second_statistic, round(z.p, 6) AS second_p, round(z.holm, 6) AS second_holm FROM z JOIN lt a ON a.model = z.model AND a.set = 'dev'""")
def report_hypotheses(spark, d):
    """Tests on the development set beside those on the confirmatory set, the latter adjusted."""
    tests = Q.ratio_tests(_scores(spark, d), "EWMA").select("set", F.col("model").alias("id"), F.col("median_ratio").alias("statistic"), "p")
    return Q.side_by_side(tests, "dev", "conf").select("id", *six("first_statistic", "first_p", "second_statistic", "second_p", "second_holm"))


@query(f"WITH RECURSIVE {SCORES}, x AS (SELECT set, series, model, ln(ratio) AS y FROM sc WHERE model <> 'EWMA' AND set <> 'adj') SELECT set, series AS series_id, model, round(y, 6) AS log_ratio, round(quantile_cont(y, 0.5) OVER (PARTITION BY set, model), 6) AS median FROM x")
def figure_hypotheses(spark, d):
    """Every series' log ratio and the median of its set."""
    x = _scores(spark, d).filter("set <> 'adj' AND model <> 'EWMA'").withColumn("y", F.log("ratio"))
    middle = x.groupBy("set", "model").agg(F.percentile("y", F.lit(0.5)).alias("median"))
    return x.join(middle, ["set", "model"]).select("set", "series_id", "model", F.round("y", 6).alias("log_ratio"), *six("median"))


LAGS = range(1, H + 1)
DM = f"""ga AS (SELECT a.series_id, a.model, a.t, b.loss - a.loss AS d FROM vl a JOIN vl b ON a.series_id = b.series_id AND a.t = b.t AND b.model = 'EWMA' WHERE a.model <> 'EWMA'), gb AS (SELECT *, d - avg(d) OVER (PARTITION BY series_id, model) AS x FROM ga),
gc AS (SELECT *, {", ".join(f"lag(x, {k}) OVER (PARTITION BY series_id, model ORDER BY t) AS l{k}" for k in LAGS)} FROM gb),
gv AS (SELECT series_id, model, avg(d) AS mean, (sum(x * x) + {" + ".join(f"{2 * (1 - k / (H + 1))!r}::DOUBLE * sum(x * l{k})" for k in LAGS)}) / count(*) / count(*) AS v FROM gc GROUP BY ALL),
dm AS (SELECT split_part(series_id, '/', 1) AS set, model, CASE WHEN v > 0 THEN mean / sqrt(v) ELSE 0 END AS dm, 1 - {erf_sql('CASE WHEN v > 0 THEN abs(mean) / sqrt(2 * v) ELSE 0 END')} AS p FROM gv)"""


@query(f"""WITH RECURSIVE {SIGNED}, {SCORES}, {RANKED}, {DM}, w AS (SELECT set, model, CAST(sum(CASE WHEN p < 0.05 AND dm > 0 THEN 1 ELSE 0 END) AS BIGINT) AS better, CAST(sum(CASE WHEN p < 0.05 AND dm < 0 THEN 1 ELSE 0 END) AS BIGINT) AS worse FROM dm GROUP BY ALL),
  c AS (SELECT set, model, quantile_cont(ratio, 0.5) AS median_ratio, CAST(sum(CASE WHEN mcs_p >= 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS members FROM sc WHERE model <> 'EWMA' GROUP BY ALL)
  SELECT c.set, c.model, round(c.median_ratio, 6) AS median_ratio, members, better, worse, round(p, 6) AS p FROM c JOIN w USING (set, model) JOIN lt USING (set, model)""")
def report_significance(spark, d):
    """Median ratios, memberships, tests won and lost, and the signed-rank test, per set and model."""
    losses = _losses(spark, d)
    base = losses.filter("model = 'EWMA'").select("series_id", "t", F.col("loss").alias("_base"))
    gain = losses.filter("model <> 'EWMA'").join(base, ["series_id", "t"]).withColumn("gain", F.col("_base") - F.col("loss"))
    tests = _set(L.newey_west(gain, "gain", H, ("series_id", "model")))
    scores = T.kept(_scored(S.confidence_set(losses, 3, DRAWS, BLOCK)))
    return Q.significance(scores, tests, "EWMA").select("set", "model", F.round("median_ratio", 6).alias("median_ratio"), "members", "better", "worse", F.round("p", 6).alias("p"))


# ---- jumps
TAILS = ("Constant", "Poisson", "Hawkes")
TAIL = f"""{BOTH}, {T.RETURNS}, {T.ewma_sql('ea', 20)}, tj AS (SELECT x.series_id, x.t, coalesce(abs(x.r) > 2 * sqrt(lag(ea.v) OVER (PARTITION BY x.series_id ORDER BY x.t)), false) AS jump FROM rets x JOIN ea ON ea.series_id = x.series_id AND ea.t = x.t),
tl AS (SELECT *, CASE WHEN count(*) OVER ({T.W} {T.ahead(H)}) = {H} THEN max(CAST(jump AS INTEGER)) OVER ({T.W} {T.ahead(H)}) END AS y, 1 - exp(-{H} * {T.whole('sum(CAST(jump AS DOUBLE))', 'jump', T.rows(FIRST), FIRST)} / {FIRST}) AS poisson FROM tj),
th(series_id, t, s) AS (SELECT series_id, t, CAST(jump AS INTEGER)::DOUBLE FROM tj WHERE t = 0 UNION ALL SELECT j.series_id, j.t, th.s * exp(CAST(-0.2 AS DOUBLE)) + CAST(j.jump AS INTEGER) FROM th JOIN tj j ON j.series_id = th.series_id AND j.t = th.t + 1),
tb AS (SELECT series_id, CAST(avg(y) AS DOUBLE) AS base FROM tl WHERE t >= {FIRST} AND t < {2 * FIRST} GROUP BY 1),
tp AS (SELECT series_id, t, y, base AS "Constant", poisson AS "Poisson", 1 - exp(-(0.02::DOUBLE * {H} + 0.4::DOUBLE * s * (1 - exp(CAST(-0.2 * {H} AS DOUBLE))))) AS "Hawkes" FROM tl JOIN th USING (series_id, t) JOIN tb USING (series_id) WHERE t >= {2 * FIRST} AND y IS NOT NULL AND poisson IS NOT NULL),
tu AS (SELECT series_id, CAST(y AS DOUBLE) AS y, model, greatest(0.01::DOUBLE, least(0.99::DOUBLE, p)) AS p FROM tp UNPIVOT (p FOR model IN ("Constant", "Poisson", "Hawkes"))),
tr AS (SELECT *, rank() OVER (PARTITION BY series_id, model ORDER BY p) + (count(*) OVER (PARTITION BY series_id, model, p) - 1) / 2.0::DOUBLE AS k FROM tu),
ts AS (SELECT {SET} AS set, series_id, model, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS ll, CASE WHEN sum(y) * sum(1 - y) > 0 THEN (sum(k * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) END AS auc FROM tr GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {TAIL}, b AS (SELECT *, max(CASE WHEN model = 'Constant' THEN ll END) OVER (PARTITION BY series_id) AS c, first_value(model) OVER (PARTITION BY series_id ORDER BY ll, model) AS w FROM ts WHERE set <> 'adj')
  SELECT set, model, round(avg(ll / c), 6) AS mean_ratio, round(avg(auc), 6) AS mean_auc, CAST(sum(CASE WHEN model = w THEN 1 ELSE 0 END) AS BIGINT) AS best, CAST(sum(CASE WHEN ll > c THEN 1 ELSE 0 END) AS BIGINT) AS worse FROM b GROUP BY ALL""")
def report_tails(spark, d):
    """Three models of jumps against the constant rate."""
    x = R.with_ewma(_both(spark, d).filter("series_id NOT LIKE 'adj/%'"), 20, "sa")
    x = x.withColumn("jump", W.jump(F.col("r"), F.col("sa"), 2.0))
    ahead = W.forward(H)
    x = x.withColumns({"y": F.when(F.count(F.lit(1)).over(ahead) == H, F.max(F.col("jump").cast("double")).over(ahead)), "Poisson": W.poisson_probability(F.col("jump"), H, FIRST)})
    x = R.along_series(x.select("series_id", "t", "jump", "y", "Poisson"), {"Hawkes": "double"}, lambda p: {"Hawkes": R.hawkes_probability(p["jump"].to_numpy(bool), 0.02, 0.4, 0.2, H)})
    base = x.filter(f"t >= {FIRST} AND t < {2 * FIRST}").groupBy("series_id").agg(F.avg("y").alias("Constant"))
    long = x.join(base, "series_id").filter(f"t >= {2 * FIRST} AND y IS NOT NULL AND Poisson IS NOT NULL").unpivot(["series_id", "t", "y"], list(TAILS), "model", "p")
    long = T.kept(long.filter("p IS NOT NULL").withColumn("p", F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("p")))))
    means = long.groupBy("series_id", "model").agg(F.avg(L.log_loss(F.col("p"), F.col("y"))).alias("log_loss"))
    both = long.groupBy("series_id", "model").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).filter("lo < hi").select("series_id", "model")
    areas = L.auc(long.join(both, ["series_id", "model"], "left_semi"), ["series_id", "model"], "p", "y")
    return Q.against_constant(_set(means.join(areas, ["series_id", "model"], "left"))).select("set", "model", *six("mean_ratio", "mean_auc"), "best", "worse")


# ---- value at risk
ALPHAS, SPAN = (0.05, 0.1), 60
Z = {a: NormalDist().inv_cdf(a) for a in ALPHAS}
ES = {a: -NormalDist().pdf(Z[a]) / a for a in ALPHAS}
_case = lambda x: "CASE alpha " + " ".join(f"WHEN {a} THEN {x[a]!r}::DOUBLE" for a in ALPHAS) + " END"
RISK = f"""{BOTH}, {T.RETURNS}, {T.ewma_sql('ea', 20)}, ra AS (SELECT x.series_id, x.t, x.r, sqrt(v) AS sd FROM rets x JOIN ea USING (series_id, t) WHERE x.series_id NOT LIKE 'adj/%'),
rc AS (SELECT series_id, t, r, sd, alpha, lead(r) OVER (PARTITION BY series_id, alpha ORDER BY t) AS y, CASE alpha {" ".join(f"WHEN {a} THEN quantile_cont(r, {a}) OVER w" for a in ALPHAS)} END AS q, list(r) OVER w AS xs FROM (SELECT ra.*, alpha FROM ra, (VALUES {", ".join(f"({a}::DOUBLE)" for a in ALPHAS)}) a(alpha)) WINDOW w AS (PARTITION BY series_id, alpha ORDER BY t {T.rows(SPAN)})),
rd AS (SELECT series_id, t, alpha, y, q AS hv, list_avg(list_filter(xs, lambda x: x <= q)) AS he, sd * {_case(Z)} AS nv, sd * {_case(ES)} AS ne FROM rc WHERE t >= {FIRST} AND y IS NOT NULL),
rf AS (SELECT series_id, t, alpha, y, unnest(['HS', 'Normal', 'Blend']) AS model, unnest([hv, nv, (hv + nv) / 2]) AS v, unnest([he, ne, (he + ne) / 2]) AS e FROM rd WHERE he < 0 AND ne < 0),
rk AS (SELECT split_part(series_id, '/', 1) AS set, series_id || '|' || alpha AS series_id, t, alpha, model, y, v, e, CASE WHEN y <= v THEN 1 ELSE 0 END AS h, -(CASE WHEN y <= v THEN 1 ELSE 0 END) * (v - y) / (alpha * e) + v / e + ln(-e) - 1 AS loss FROM rf),
rl2 AS (SELECT *, lag(h) OVER (PARTITION BY series_id, model ORDER BY t) AS l FROM rk),
rs AS (SELECT set, series_id, alpha, model, count(*) AS n, sum(h) AS x, avg(loss) AS fz0, {", ".join(f"sum(CASE WHEN l = {a} AND h = {b} THEN 1 ELSE 0 END) AS n{a}{b}" for a in (0, 1) for b in (0, 1))} FROM rl2 GROUP BY ALL),
rt AS (SELECT *, -2 * (x * ln(alpha) + (n - x) * ln(1 - alpha) - CASE WHEN x > 0 AND x < n THEN x * ln(x / n) + (n - x) * ln(1 - x / n) ELSE 0 END) AS uc, (n01 + n11) / (n00 + n01 + n10 + n11) AS pp FROM rs),
ru AS (SELECT *, greatest(0, -2 * ((CASE WHEN n00 + n10 > 0 THEN (n00 + n10) * ln(1 - pp) ELSE 0 END + CASE WHEN n01 + n11 > 0 THEN (n01 + n11) * ln(pp) ELSE 0 END) - (CASE WHEN n00 > 0 THEN n00 * ln(n00 / (n00 + n01)) ELSE 0 END + CASE WHEN n01 > 0 THEN n01 * ln(n01 / (n00 + n01)) ELSE 0 END + CASE WHEN n10 > 0 THEN n10 * ln(n10 / (n10 + n11)) ELSE 0 END + CASE WHEN n11 > 0 THEN n11 * ln(n11 / (n10 + n11)) ELSE 0 END))) AS ind FROM rt)"""


@query(f"""WITH RECURSIVE {RISK}, vn AS (SELECT series_id, count(DISTINCT t) AS n FROM rk GROUP BY 1), src AS (SELECT series_id, t, model, loss FROM rk), {mcs_sql('f', 'src', 3, DRAWS, f'{BLOCK}.0::DOUBLE', 'vn')},
  z AS (SELECT ru.*, fs.p AS mcs, rank() OVER (PARTITION BY ru.series_id ORDER BY fz0) + (count(*) OVER (PARTITION BY ru.series_id, fz0) - 1) / 2.0::DOUBLE AS k FROM ru JOIN fs USING (series_id, model))
  SELECT set, model, round(avg(abs(x / n / alpha - 1)), 6) AS mean_error, round(avg(CASE WHEN 1 - {erf_sql('sqrt(greatest(uc, 0) / 2)')} > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS kupiec_pass, round(avg(CASE WHEN exp(-(uc + ind) / 2) > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS cc_pass,
  round(avg(k), 6) AS mean_rank, round(avg(CASE WHEN mcs >= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS member_share FROM z GROUP BY ALL""")
def report_var(spark, d):
    """Coverage and joint loss of three value-at-risk models at two levels, with the confidence set per series and level."""
    x = R.with_ewma(_both(spark, d).filter("series_id NOT LIKE 'adj/%'"), 20, "sd")
    w = W.trailing(SPAN)
    x = x.withColumns({"y": F.lead("r").over(W.ordered()), "q": F.percentile("r", F.array(*(F.lit(a) for a in ALPHAS))).over(w), "xs": F.collect_list("r").over(w)}).filter(f"t >= {FIRST} AND y IS NOT NULL")
    levels = F.array(*(F.struct(F.lit(a).alias("alpha"), F.col("q")[i].alias("v"), F.lit(Z[a]).alias("z"), F.lit(ES[a]).alias("s")) for i, a in enumerate(ALPHAS)))
    x = x.select("series_id", "t", "y", "sd", "xs", F.explode(levels).alias("l")).select("series_id", "t", "y", "xs", "l.alpha", F.col("l.v").alias("hv"), (F.col("sd") * F.col("l.z")).alias("nv"), (F.col("sd") * F.col("l.s")).alias("ne"))
    low = F.filter("xs", lambda v: v <= F.col("hv"))
    x = x.withColumn("he", F.aggregate(low, F.lit(0.0), lambda a, v: a + v) / F.size(low)).filter("he < 0 AND ne < 0")
    made = F.array(*(F.struct(F.lit(m).alias("model"), v.alias("v"), e.alias("e")) for m, v, e in (("HS", F.col("hv"), F.col("he")), ("Normal", F.col("nv"), F.col("ne")), ("Blend", (F.col("hv") + F.col("nv")) / 2, (F.col("he") + F.col("ne")) / 2))))
    x = x.select("series_id", "t", "y", "alpha", F.explode(made).alias("m")).select("series_id", "t", "y", "alpha", "m.*").withColumn("hit", F.col("y") <= F.col("v"))
    hit = F.col("hit").cast("double")
    x = T.kept(x.withColumn("loss", -hit * (F.col("v") - F.col("y")) / (F.col("alpha") * F.col("e")) + F.col("v") / F.col("e") + F.log(-F.col("e")) - 1))
    tests = None
    for a in ALPHAS:
        one = L.christoffersen(x.filter(F.col("alpha") == a), "hit", a, ["series_id", "model"]).withColumn("alpha", F.lit(a)).withColumn("hit_rate", F.col("x") / F.col("n") / a)
        tests = one if tests is None else tests.unionByName(one)
    means = x.groupBy("series_id", "alpha", "model").agg(F.avg("loss").alias("fz0"))
    keyed = x.select(F.concat("series_id", F.lit("|"), F.col("alpha").cast("string")).alias("series_id"), "t", "model", "loss")
    chosen = S.confidence_set(keyed, 3, DRAWS, BLOCK).select(F.split_part("series_id", F.lit("|"), F.lit(1)).alias("series_id"), F.split_part("series_id", F.lit("|"), F.lit(2)).cast("double").alias("alpha"), "model", F.col("p").alias("mcs_p"))
    table = tests.join(means, ["series_id", "alpha", "model"]).join(chosen, ["series_id", "alpha", "model"])
    return Q.coverage(_set(table)).select("set", "model", *six("mean_error", "kupiec_pass", "cc_pass", "mean_rank", "member_share"))


# ---- strategies
GO = f"""{BOTH}, sm AS (SELECT *, coalesce(close / lag(close) OVER ({T.W}) - 1, 0) AS ret, sign(close - lag(close, 20) OVER ({T.W})) AS p FROM bars WHERE series_id NOT LIKE 'adj/%'),
st AS (SELECT series_id, t, ret AS hold, lag(p) OVER ({T.W}) * ret AS follow, lag(p) OVER ({T.W}) * -ret AS fade FROM sm),
sr AS (SELECT series_id, t, model, r FROM (SELECT * FROM st WHERE t >= {FIRST}) UNPIVOT (r FOR model IN (hold, follow, fade))),
sg AS (SELECT *, product(1 + r) OVER (PARTITION BY series_id, model ORDER BY t) AS growth FROM sr)"""


def _returns_of(spark, d):
    w = W.ordered()
    x = _both(spark, d).filter("series_id NOT LIKE 'adj/%'").withColumns({"hold": F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)), "side": F.signum(F.col("close") - F.lag("close", 20).over(w))})
    x = x.withColumns({"follow": F.lag("side").over(w) * F.col("hold"), "fade": F.lag("side").over(w) * -F.col("hold")}).filter(F.col("t") >= FIRST)
    return T.kept(x.unpivot(["series_id", "t"], ["hold", "follow", "fade"], "model", "r"))


@query(f"WITH {GO} SELECT series_id, t, model, round(growth, 6) + 0.0::DOUBLE AS growth FROM sg WHERE series_id LIKE 'conf/%'")
def figure_overlay(spark, d):
    """Growth of holding and of two ways to go with the last move."""
    x = _returns_of(spark, d).filter("series_id LIKE 'conf/%'")
    w = Window.partitionBy("series_id", "model").orderBy("t")
    return x.select("series_id", "t", "model", (F.round(F.product(1 + F.col("r")).over(w), 6) + 0.0).alias("growth"))


@query(f"""WITH {GO}, gn AS (SELECT series_id, count(DISTINCT t) AS n FROM sr GROUP BY 1), {runs_sql('gn', DRAWS, f'{2 * H}.0::DOUBLE')}, kk AS (SELECT *, row_number() OVER (PARTITION BY series_id, model ORDER BY t) AS k FROM sr),
  g AS (SELECT p.series_id, model, draw, avg(r) / stddev_samp(r) AS s FROM place p JOIN kk USING (series_id, k) GROUP BY ALL),
  z AS (SELECT a.series_id, a.model, a.s - b.s AS d FROM g a JOIN g b ON a.series_id = b.series_id AND a.draw = b.draw AND b.model = 'hold' WHERE a.model <> 'hold'),
  p AS (SELECT series_id, model, least(1.0::DOUBLE, 2 * least(avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN d >= 0 THEN 1.0 ELSE 0.0 END))) AS p FROM z GROUP BY ALL),
  dd AS (SELECT series_id, model, r, growth / max(growth) OVER (PARTITION BY series_id, model ORDER BY t) - 1 AS dd FROM sg), s AS (SELECT series_id, model, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, min(dd) AS dd FROM dd GROUP BY ALL)
  SELECT series_id, {", ".join(f"round(max(CASE WHEN s.model = '{m}' THEN sharpe END), 6) AS sharpe_{m}, round(max(CASE WHEN s.model = '{m}' THEN dd END), 6) AS max_dd_{m}" for m in ("hold", "follow", "fade"))}, {", ".join(f"round(max(CASE WHEN s.model = '{m}' THEN p END), 6) AS p_{m}" for m in ("follow", "fade"))}
  FROM s LEFT JOIN p USING (series_id, model) GROUP BY 1""")
def report_overlay(spark, d):
    """Sharpe ratios, drawdowns and tests against holding, a row a series."""
    x = _returns_of(spark, d)
    keyed = x.withColumn("series_id", F.concat("series_id", F.lit("|"), "model"))
    rated = L.summary(keyed, "r", 252).select(F.split_part("series_id", F.lit("|"), F.lit(1)).alias("series_id"), F.split_part("series_id", F.lit("|"), F.lit(2)).alias("model"), "sharpe", "max_dd")
    tested = S.sharpe_difference(x, "hold", 252, DRAWS, 2 * H).select("series_id", "model", "p")
    out = rated.join(tested, ["series_id", "model"], "left").groupBy("series_id").pivot("model", ["hold", "follow", "fade"]).agg(F.first("sharpe").alias("sharpe"), F.first("max_dd").alias("max_dd"), F.first("p").alias("p"))
    names = [(v, m) for m in ("hold", "follow", "fade") for v in ("sharpe", "max_dd", "p") if (v, m) != ("p", "hold")]
    return out.select("series_id", *(F.round(f"{m}_{v}", 6).alias(f"{v}_{m}") for v, m in names))


# ---- direction
SPANS = (5, 20)


def _ic_sql(source: str, keys: str) -> str:
    """ic({keys}, ic): the rank correlation of x and y."""
    part = f"PARTITION BY {keys}"
    return f"""rx AS (SELECT *, rank() OVER ({part} ORDER BY x) + (count(*) OVER ({part}, x) - 1) / 2.0::DOUBLE AS kx, rank() OVER ({part} ORDER BY y) + (count(*) OVER ({part}, y) - 1) / 2.0::DOUBLE AS ky FROM {source}),
ic AS (SELECT {keys}, corr(kx, ky) AS ic FROM rx GROUP BY ALL)"""


@query(f"""WITH {BOTH}, mv AS (SELECT series_id, t, lead(close, {H}) OVER ({T.W}) / close - 1 AS y, {", ".join(f"close / lag(close, {s}) OVER ({T.W}) - 1 AS m{s}" for s in SPANS)} FROM bars WHERE series_id NOT LIKE 'adj/%'),
  sx AS (SELECT {SET} AS set, split_part(series_id, '/', 2) AS series_id, m, x, y FROM mv UNPIVOT (x FOR m IN ({", ".join(f"m{s}" for s in SPANS)})) WHERE t >= {FIRST} AND y IS NOT NULL), {_ic_sql('sx', 'set, series_id, m')},
  li AS (SELECT * FROM ic UNION ALL SELECT set, 'mean', m, avg(ic) FROM ic GROUP BY ALL)
  SELECT set, series_id AS line, {", ".join(f"round(max(CASE WHEN m = 'm{s}' THEN ic END), 6) AS m{s}" for s in SPANS)} FROM li GROUP BY 1, 2""")
def report_direction(spark, d):
    """Rank correlations of past and coming moves by span, with the mean of each set."""
    w = W.ordered()
    x = _both(spark, d).filter("series_id NOT LIKE 'adj/%'").withColumns({"y": F.lead("close", H).over(w) / F.col("close") - 1, **{f"m{s}": F.col("close") / F.lag("close", s).over(w) - 1 for s in SPANS}})
    x = _set(x.filter(f"t >= {FIRST} AND y IS NOT NULL")).withColumn("series_id", F.split_part("series_id", F.lit("/"), F.lit(2))).unpivot(["set", "series_id", "y"], [f"m{s}" for s in SPANS], "m", "x")
    each = L.spearman(x, ["set", "series_id", "m"], "x", "y")
    lines = each.groupingSets([["set", "series_id", "m"], ["set", "m"]], "set", "series_id", "m").agg(F.grouping("series_id").alias("_all"), F.avg("ic").alias("ic"))
    lines = lines.withColumn("line", F.when(F.col("_all") == 1, "mean").otherwise(F.col("series_id")))
    return Q.wide(lines, ["set", "line"], "m", [f"m{s}" for s in SPANS], "ic").select("set", "line", *six(*(f"m{s}" for s in SPANS)))


FRAMES = {"15 minutes": None, "1 hour": 1, "4 hours": 4}


@query(f"""WITH {T.QUARTER}, tf AS (SELECT '15 minutes' AS frame, ts, close FROM fine UNION ALL SELECT '1 hour', date_trunc('hour', ts), last(close ORDER BY ts) FROM fine GROUP BY 2 UNION ALL SELECT '4 hours', time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '1970-01-01'), last(close ORDER BY ts) FROM fine GROUP BY 2),
  tm AS (SELECT frame, row_number() OVER w - 1 AS t, ln(close / lag(close) OVER w) AS x, ln(lead(close) OVER w / close) AS y FROM tf WINDOW w AS (PARTITION BY frame ORDER BY ts)),
  sx AS (SELECT frame, x, y FROM tm WHERE x IS NOT NULL AND y IS NOT NULL), {_ic_sql('sx', 'frame')}, n AS (SELECT frame, count(*) AS bars FROM tf GROUP BY 1) SELECT frame, bars, round(ic, 6) AS ic FROM ic JOIN n USING (frame)""")
def time_frames(spark, d):
    """Does a move tell the next one when bars are longer? Rank correlations at three lengths of bars."""
    fine = T.quarter_hours(spark, d)
    parts = []
    for name, hours in FRAMES.items():
        bars = fine if hours is None else SB.resample_to(fine, f"{hours} hours")
        parts.append(bars.withColumn("series_id", F.lit(name)))
    bars = parts[0].unionByName(parts[1]).unionByName(parts[2])
    w = W.ordered()
    x = bars.withColumns({"x": F.log(F.col("close") / F.lag("close").over(w)), "y": F.log(F.lead("close").over(w) / F.col("close"))})
    ic = L.spearman(x.filter("x IS NOT NULL AND y IS NOT NULL"), ["series_id"], "x", "y")
    return bars.groupBy("series_id").agg(F.count(F.lit(1)).alias("bars")).join(ic, "series_id").select(F.col("series_id").alias("frame"), "bars", *six("ic"))



# ---- lists of trades
TRADES = """raw AS (SELECT o_orderkey AS trade, CASE WHEN o_orderstatus = 'F' THEN 'long' ELSE 'short' END AS way, CAST(o_orderdate AS TIMESTAMP) - INTERVAL 2 HOUR AS utc, o_totalprice AS p, o_custkey FROM orders),
one AS (SELECT trade, CASE way WHEN 'long' THEN 1 ELSE -1 END AS dir, utc + INTERVAL 1 SECOND * trade AS entry_time, p AS entry_price, utc + INTERVAL 1 SECOND * trade + INTERVAL 5 HOUR AS exit_time, p * 1.01::DOUBLE AS exit_price FROM raw WHERE trade % 7 <> 0),
own AS (SELECT CASE WHEN way = 'long' THEN 1 ELSE -1 END AS dir, utc + INTERVAL 1 SECOND * trade AS entry_time, CASE WHEN o_custkey % 5 = 0 THEN 1.01::DOUBLE ELSE 1.00001::DOUBLE END * p AS entry_price, utc + INTERVAL 1 SECOND * trade + CASE WHEN o_custkey % 3 = 0 THEN INTERVAL 6 HOUR ELSE INTERVAL 5 HOUR END AS exit_time, p * 1.01::DOUBLE AS exit_price FROM raw WHERE trade % 4 <> 0)"""


def _trades(spark, d):
    """A list of entries and exits, two rows a trade and some without an exit, and the trades it is compared with."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("trade"), F.when(F.col("o_orderstatus") == "F", "long").otherwise("short").alias("way"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")).alias("s"), F.col("o_totalprice").alias("p"), "o_custkey")
    enter = o.select("trade", F.concat(F.lit("Entry "), "way").alias("type"), F.timestamp_seconds("s").alias("at"), F.col("p").alias("price"))
    leave = o.filter("trade % 7 <> 0").select("trade", F.concat(F.lit("Exit "), "way").alias("type"), F.timestamp_seconds(F.col("s") + 5 * 3600).alias("at"), (F.col("p") * 1.01).alias("price"))
    theirs = SB.trade_list(enter.unionByName(leave), "+02:00")
    moved = F.col("p") * F.when(F.col("o_custkey") % 5 == 0, 1.01).otherwise(1.00001)
    hours = F.when(F.col("o_custkey") % 3 == 0, 6).otherwise(5)
    at = F.col("s") - 2 * 3600
    ours = o.filter("trade % 4 <> 0").select(F.when(F.col("way") == "long", 1).otherwise(-1).cast("tinyint").alias("dir"), F.timestamp_seconds(at).alias("entry_time"), moved.alias("entry_price"), F.timestamp_seconds(at + hours * 3600).alias("exit_time"), (F.col("p") * 1.01).alias("exit_price"))
    return theirs, ours


@query(f"WITH {TRADES} SELECT trade, CAST(dir AS TINYINT) AS dir, strftime(entry_time, '%Y-%m-%d %H:%M:%S') AS entered, strftime(exit_time, '%Y-%m-%d %H:%M:%S') AS left_at, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price FROM one")
def trade_list(spark, d):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return _trades(spark, d)[0].select("trade", "dir", text("entry_time").alias("entered"), text("exit_time").alias("left_at"), *six("entry_price", "exit_price"))


@query(f"""WITH {TRADES}, w AS (SELECT min(entry_time) AS lo, max(entry_time) AS hi FROM one), ins AS (SELECT own.* FROM own, w WHERE entry_time BETWEEN lo AND hi),
  m AS (SELECT one.exit_time = ins.exit_time AS e, abs(one.entry_price / ins.entry_price - 1) <= 0.0001 AS a, abs(one.exit_price / ins.exit_price - 1) <= 0.0001 AS x FROM one JOIN ins ON one.entry_time = ins.entry_time AND one.dir = ins.dir)
  SELECT (SELECT count(*) FROM one) AS theirs, (SELECT count(*) FROM ins) AS ours, count(*) AS matched, round(avg(CASE WHEN e THEN 1.0 ELSE 0.0 END), 6) AS same_exit, round(avg(CASE WHEN a THEN 1.0 ELSE 0.0 END), 6) AS entry_agrees, round(avg(CASE WHEN x THEN 1.0 ELSE 0.0 END), 6) AS exit_agrees,
  (SELECT count(*) FROM one WHERE NOT EXISTS (SELECT 1 FROM ins WHERE ins.entry_time = one.entry_time AND ins.dir = one.dir)) AS only_theirs, (SELECT count(*) FROM ins WHERE NOT EXISTS (SELECT 1 FROM one WHERE ins.entry_time = one.entry_time AND ins.dir = one.dir)) AS only_ours,
  round(count(*) / (SELECT count(*) FROM one), 6) AS match_rate FROM m""")
def trade_match_report(spark, d):
    out = TR.match_report(*_trades(spark, d))
    return out.select("theirs", "ours", "matched", *six("same_exit", "entry_agrees", "exit_agrees"), "only_theirs", "only_ours", *six("match_rate"))
