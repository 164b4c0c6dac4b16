"""Queries over bars: sources, windows, recurrences, the engine and the flagship forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import recurrences as R
from tidemark.functions import windows as W
from tidemark.operators import analogue as A
from tidemark.operators import volatility as V
from tidemark.sources import bars as S

from . import tables as T
from .registry import Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
C = V.SHORT


def six(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def rnd(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


# ---- sources
@query(f"WITH {T.HOURLY} SELECT series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, t, open, high, low, close, volume FROM bars")
def bars_resample(spark: SparkSession, d: str) -> DataFrame:
    return T.hourly(spark, d).select("series_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "t", *S.PRICES, "volume")


@query(f"""WITH {T.QUARTER}, coarse AS (SELECT series_id, date_trunc('hour', ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
  last(close ORDER BY ts) AS close, sum(volume) AS volume FROM fine GROUP BY ALL)
  SELECT series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, row_number() OVER (ORDER BY ts) - 1 AS t, open, high, low, close, volume FROM coarse""")
def bars_coarser(spark, d):
    return S.resample(T.quarter_hours(spark, d), "hour").select("series_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "t", *S.PRICES, "volume")


@query("""WITH raw AS (SELECT event_type AS series_id, date_trunc('minute', ts) AS ts, event_id, value - 1 AS low, value AS close, value + 1 AS high, value AS open FROM events),
  once AS (SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY event_id) AS n FROM raw),
  ok AS (SELECT * FROM once WHERE n = 1 AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= low)
  SELECT series_id, event_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS t, open, high, low, close FROM ok""")
def clean_bars(spark, d):
    raw = T.events(spark, d).select(F.col("event_type").alias("series_id"), F.date_trunc("minute", "ts").alias("ts"), "event_id", F.col("value").alias("open"), (F.col("value") + 1).alias("high"), (F.col("value") - 1).alias("low"), F.col("value").alias("close"))
    return S.clean(raw, ["event_id"]).select("series_id", "event_id", "t", *S.PRICES)


@query(f"""WITH {T.HOURLY}, x AS (SELECT *, ln(close / lag(close) OVER ({T.W})) AS r FROM bars),
  y AS (SELECT *, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w END AS sd, lead(r) OVER ({T.W}) AS nxt FROM x WINDOW w AS ({T.W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
  SELECT series_id, t, close FROM y WHERE NOT coalesce(abs(r) > 1.5 * sd AND sign(nxt) = -sign(r) AND abs(nxt) > 0.7 * abs(r), false)""")
def bad_ticks(spark, d):
    return S.drop_bad_ticks(T.hourly(spark, d), k=1.5).select("series_id", "t", "close")


@query(f"""WITH {T.QUARTER}, coarse AS (SELECT series_id, date_trunc('hour', ts) AS ts, last(close ORDER BY ts) AS close FROM fine GROUP BY ALL),
  fr AS (SELECT *, ln(close / lag(close) OVER (ORDER BY ts)) AS r FROM fine), rv AS (SELECT date_trunc('hour', ts) AS ts, sum(r * r) AS rv FROM fr GROUP BY 1),
  cr AS (SELECT *, ln(close / lag(close) OVER (ORDER BY ts)) AS r, row_number() OVER (ORDER BY ts) - 1 AS t FROM coarse)
  SELECT t, round(coalesce(rv.rv, r * r, 0.0), 6) AS rv FROM cr LEFT JOIN rv USING (ts)""")
def intraday_rv(spark, d):
    fine = T.quarter_hours(spark, d)
    return S.intraday_variance(S.resample(fine, "hour"), fine, "hour").select("t", *six("rv"))


@query("""SELECT CAST(o_custkey % 7 AS VARCHAR) AS series_id, strftime(to_timestamp(CASE WHEN e < 100000000000000 THEN e ELSE e // 1000 END / 1000) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at, o_totalprice AS close
  FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 1551398400000 + o_orderkey * 1000 ELSE 1740787200000000 + o_orderkey * 1000000 END AS e FROM orders)""")
def klines(spark, d):
    epoch = F.when(F.col("o_orderkey") % 2 == 0, F.lit(1551398400000) + F.col("o_orderkey") * 1000).otherwise(F.lit(1740787200000000) + F.col("o_orderkey") * 1000000)
    text = F.col("o_totalprice").cast("string")
    raw = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 7).cast("string").alias("series_id"), epoch.alias("epoch"), *(text.alias(c) for c in (*S.PRICES, "volume")))
    return S.klines(raw).select("series_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "close")


@query(f"""WITH {T.DAILY}, x AS (SELECT *, max(ts) OVER (PARTITION BY series_id) AS last FROM bars)
  SELECT series_id, t, round(close * 0.5, 6) AS close, round(open * 0.5, 6) AS open FROM x WHERE CASE WHEN series_id = '1-URGENT' THEN ts <= TIMESTAMP '1996-01-01' ELSE ts < last END""")
def pinned_adjusted(spark, d):
    ends = spark.createDataFrame([("1-URGENT", "1996-01-01")], "series_id string, e string").select("series_id", F.col("e").cast("timestamp").alias("end"))
    bars = T.daily(spark, d).withColumn("adj_close", F.col("close") * 0.5)
    return S.adjust(S.pinned(bars, ends)).select("series_id", "t", *six("close", "open"))


@query(f"WITH {T.HOURLY}, n AS (SELECT series_id, count(*) AS n FROM bars GROUP BY 1) SELECT series_id, t, close FROM bars JOIN n USING (series_id) WHERE n >= 170")
def long_enough(spark, d):
    return S.long_enough(T.hourly(spark, d), 170).select("series_id", "t", "close")


def _ten_digits(x: str) -> str:
    return f"format('{{:.' || CASE WHEN {x} = 0 THEN 9 ELSE 9 - CAST(floor(log10(abs({x}))) AS INTEGER) END || 'f}}', CAST({x} AS DOUBLE))"


@query(f"""WITH {T.HOURLY}, l AS (SELECT series_id, CAST(ts AS DATE) AS day, concat_ws(',', strftime(ts, '%Y-%m-%d %H:%M:%S'), {", ".join(_ten_digits(c) for c in (*S.PRICES, "volume"))}) AS line FROM bars),
  n AS (SELECT series_id, day, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM l GROUP BY 1, 2) SELECT series_id, CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(d, '' ORDER BY day)) AS sha256 FROM n GROUP BY 1""")
def data_digest(spark, d):
    return S.digest(T.hourly(spark, d)).select("series_id", "n_rows", "sha256")


# ---- windows
@query(f"WITH {T.HOURLY}, {T.RETURNS} SELECT series_id, t, {rnd('r', 'tr')} FROM rets")
def log_returns(spark, d):
    return _returns(spark, d).select("series_id", "t", *six("r", "tr"))


def _returns(spark, d):
    return T.hourly(spark, d).withColumns({"r": W.log_return(F.col("close")), "tr": W.true_range()})


@query(f"""WITH {T.HOURLY}, x AS (SELECT *, {T.whole('avg(close)', 'close', T.rows(20), 20)} AS sma, {T.whole('avg(close * close)', 'close', T.rows(20), 20)} AS sq, {T.whole('sum(close)', 'close', T.rows(20), 20)} AS total FROM bars)
  SELECT series_id, t, round(sma, 6) AS sma, CASE WHEN sma IS NOT NULL THEN round(sqrt(greatest(sq - sma * sma, 0)), 6) END AS stdev, round(total, 6) AS total FROM x""")
def sma_stdev(spark, d):
    c = F.col("close")
    return T.hourly(spark, d).select("series_id", "t", F.round(W.sma(c, 20), 6).alias("sma"), F.round(W.stdev(c, 20), 6).alias("stdev"), F.round(W.rolling_sum(c, 20), 6).alias("total"))


@query(f"WITH RECURSIVE {T.HOURLY}, {T.RETURNS}, {T.ewma_sql('e', 50)} SELECT series_id, t, round(sqrt(v), 6) AS sigma FROM e")
def ewma_vol(spark, d):
    return R.with_ewma(_returns(spark, d), 50).select("series_id", "t", *six("sigma"))


@query(f"WITH RECURSIVE {T.HOURLY}, {T.RETURNS}, {T.atr_sql('a', 14)} SELECT series_id, t, round(atr, 6) AS atr FROM rets LEFT JOIN a USING (series_id, t)")
def atr(spark, d):
    return R.with_atr(_returns(spark, d), 14).select("series_id", "t", *six("atr"))


STATE = f"""{T.atr_sql('a', 14)},
st AS (SELECT series_id, t, r, tr, atr, CAST(coalesce(atr > {T.whole('avg(atr)', 'atr', T.rows(100), 100)}, false) AS TINYINT) AS state FROM rets LEFT JOIN a USING (series_id, t))"""


def _states(spark, d):
    return R.with_atr(_returns(spark, d), 14).withColumn("state", W.regime(F.col("atr"), 100))


@query(f"WITH RECURSIVE {T.HOURLY}, {T.RETURNS}, {STATE} SELECT series_id, t, state FROM st")
def regime(spark, d):
    return _states(spark, d).select("series_id", "t", "state")


@query(f"WITH RECURSIVE {T.HOURLY}, {T.RETURNS}, {T.ewma_sql('e', 50)}, {STATE} SELECT series_id, t, round(sqrt(v), 6) AS sigma, round(atr, 6) AS atr, state FROM st JOIN e USING (series_id, t)")
def features(spark, d):
    return R.with_features(_returns(spark, d), 50, 14).withColumn("state", W.regime(F.col("atr"), 100)).select("series_id", "t", *six("sigma", "atr"), "state")


def _embedding_sql(w: int, m: int) -> str:
    g = w // m
    return ", ".join(f"round(sum(r) OVER ({T.W} {T.rows(g, (m - 1 - q) * g)}) / (sqrt(v) * sqrt({float(g)})), 6) AS e{q}" for q in range(m))


@query(f"WITH RECURSIVE {T.HOURLY}, {T.RETURNS}, {T.ewma_sql('e', 50)}, x AS (SELECT series_id, t, {_embedding_sql(20, 4)} FROM rets JOIN e USING (series_id, t)) SELECT * FROM x WHERE t >= 20")
def embed_returns(spark, d):
    emb = W.return_embedding(F.col("r"), F.col("sigma"), 20, 4, digits=6)
    return R.with_ewma(_returns(spark, d), 50).withColumn("emb", emb).filter("emb IS NOT NULL").select("series_id", "t", *(F.col("emb")[i].alias(f"e{i}") for i in range(4)))


def _shape_sql(h: int, m: int, digits: int) -> str:
    span = lambda q: T.whole("avg(r * r)", "r", T.rows(h, q * h), h)
    return ", ".join(f"round(ln(greatest({span(q)}, 0.001 * lv) + 0 * {span(q)}) - ln(lv), {digits}) AS e{m - 1 - q}" for q in range(m - 1, -1, -1))


H = C.h
DATA = f"""{T.RETURNS}, {T.ewma_sql('el', C.long_halflife)}, {STATE},
d0 AS (SELECT s.*, el.v AS lv, {T.whole('avg(s.r * s.r)', 's.r', T.ahead(H), H).replace('PARTITION BY series_id ORDER BY t', 'PARTITION BY s.series_id ORDER BY s.t')} AS realised,
  coalesce(abs(s.r) > 3.0 * sqrt(lag(el.v) OVER (PARTITION BY s.series_id ORDER BY s.t)), false) AS jump FROM st s JOIN el ON el.series_id = s.series_id AND el.t = s.t),
data AS (SELECT *, ln(greatest(realised, 0.001 * lv) + 0 * realised) AS target, CASE WHEN realised IS NOT NULL THEN max(CAST(jump AS INTEGER)) OVER ({T.W} {T.ahead(H)}) END AS tail, {_shape_sql(H, C.m, 9)} FROM d0)"""


def _data(spark, d):
    return V.vol_data(T.hourly(spark, d), C)


@query(f"WITH RECURSIVE {T.HOURLY}, {DATA} SELECT series_id, t, {rnd('e0', 'e1', 'e2', 'e3')} FROM data WHERE e0 + e1 + e2 + e3 IS NOT NULL")
def embed_vol_shape(spark, d):
    return _data(spark, d).filter("emb IS NOT NULL").select("series_id", "t", *(F.round(F.col("emb")[i], 6).alias(f"e{i}") for i in range(4)))


@query(f"WITH RECURSIVE {T.HOURLY}, {DATA} SELECT series_id, t, {rnd('realised', 'target')} FROM data")
def vol_target(spark, d):
    return _data(spark, d).select("series_id", "t", *six("realised", "target"))


@query(f"WITH RECURSIVE {T.HOURLY}, {DATA} SELECT series_id, t, jump, CAST(tail AS DOUBLE) AS tail FROM data")
def jumps_tail(spark, d):
    return _data(spark, d).select("series_id", "t", "jump", "tail")


JUMPY = "jy AS (SELECT series_id, t, r, abs(r) > 1.0 AS jump FROM rets)"


@query(f"WITH {T.HOURLY}, {T.RETURNS}, {JUMPY}, x AS (SELECT *, {T.whole('sum(CAST(jump AS DOUBLE))', 'jump', T.rows(100), 100)} / 100 AS rate FROM jy) SELECT series_id, t, round(1 - exp(-rate * 5), 6) AS p FROM x")
def poisson_prob(spark, d):
    return _returns(spark, d).withColumn("jump", F.abs("r") > 1.0).select("series_id", "t", F.round(W.poisson_probability(F.col("jump"), 5, 100), 6).alias("p"))


# ---- recurrences
@query(f"""WITH RECURSIVE {T.HOURLY}, {T.RETURNS}, {JUMPY},
  s AS (SELECT series_id, t, CAST(jump AS INTEGER)::DOUBLE AS s FROM jy WHERE t = 0 UNION ALL SELECT j.series_id, j.t, s.s * exp(CAST(-0.2 AS DOUBLE)) + CAST(j.jump AS INTEGER) FROM s JOIN jy j ON j.series_id = s.series_id AND j.t = s.t + 1)
  SELECT series_id, t, round(1 - exp(-(0.02::DOUBLE * 5 + 0.4::DOUBLE * s * (1 - exp(CAST(-1.0 AS DOUBLE))))), 6) AS p FROM s""")
def hawkes_prob(spark, d):
    jumps = _returns(spark, d).withColumn("jump", F.abs("r") > 1.0)
    return R.along_series(jumps, {"p": "double"}, lambda x: {"p": R.hawkes_probability(x["jump"].to_numpy(bool), 0.02, 0.4, 0.2, 5)}).select("series_id", "t", *six("p"))


@query(f"""WITH RECURSIVE {T.HOURLY}, {T.RETURNS},
  g AS (SELECT series_id, t, CAST(0.01 AS DOUBLE) + CAST(0.08 AS DOUBLE) * r * r + CAST(0.9 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS v FROM rets WHERE t = 0
  UNION ALL SELECT x.series_id, x.t, CAST(0.01 AS DOUBLE) + CAST(0.08 AS DOUBLE) * x.r * x.r + CAST(0.9 AS DOUBLE) * g.v FROM g JOIN rets x ON x.series_id = g.series_id AND x.t = g.t + 1)
  SELECT series_id, t, round(v, 6) AS v FROM g""")
def garch_filter(spark, d):
    return R.along_series(_returns(spark, d), {"v": "double"}, lambda x: {"v": R.garch_variance(x["r"].to_numpy(float), 0.01, 0.08, 0.9, 0.5)[0]}).select("series_id", "t", *six("v"))


@query(f"""WITH {T.HOURLY}, {T.RETURNS}, {JUMPY}, n AS (SELECT series_id, CAST(count(*) AS DOUBLE) AS n FROM jy GROUP BY 1), j AS (SELECT series_id, CAST(t AS DOUBLE) AS x FROM jy WHERE jump),
  l AS (SELECT a.series_id, a.x, ln(0.02::DOUBLE + 0.4::DOUBLE * 0.15::DOUBLE * coalesce(sum(exp(-0.15::DOUBLE * (a.x - b.x))), 0)) AS ll FROM j a LEFT JOIN j b ON a.series_id = b.series_id AND b.x < a.x GROUP BY 1, 2)
  SELECT series_id, CAST(count(l.x) AS BIGINT) AS events, round(coalesce(sum(ll - 0.4::DOUBLE * (1 - exp(-0.15::DOUBLE * (n.n - l.x)))), 0) - 0.02::DOUBLE * any_value(n.n), 6) AS loglik FROM n LEFT JOIN l USING (series_id) GROUP BY 1""")
def hawkes_loglik(spark, d):
    def one(pdf):
        x = pdf.sort_values("t")
        times = x.loc[x["jump"], "t"].to_numpy(float)
        return x.iloc[:1][["series_id"]].assign(events=len(times), loglik=R.hawkes_loglik(times, float(len(x)), 0.02, 0.4, 0.15))

    jumps = _returns(spark, d).select("series_id", "t", (F.abs("r") > 1.0).alias("jump"))
    return jumps.groupBy("series_id").applyInPandas(one, "series_id string, events long, loglik double").select("series_id", "events", *six("loglik"))


@query(f"""WITH {T.HOURLY}, {T.RETURNS}, q AS (SELECT series_id, t, quantile_cont(r, 0.05) OVER w AS q, list(r) OVER w AS xs FROM rets WINDOW w AS ({T.W} ROWS UNBOUNDED PRECEDING))
  SELECT series_id, t, round(q, 6) AS q, round(list_avg(list_filter(xs, lambda x: x <= q)), 6) AS es FROM q WHERE t >= 100""")
def expanding_tail(spark, d):
    def tail(p):
        q, es = R.expanding_tail(p["r"].to_numpy(float), 0, 0.05)
        return {"q": q, "es": es}

    return R.along_series(_returns(spark, d), {"q": "double", "es": "double"}, tail).filter("t >= 100").select("series_id", "t", *six("q", "es"))


@query(f"""WITH {T.HOURLY}, {T.RETURNS}, q AS (SELECT series_id, t, quantile_cont(r, 0.05) OVER w AS q, list(r) OVER w AS xs FROM rets WINDOW w AS ({T.W} {T.rows(60)}))
  SELECT series_id, t, round(q, 6) AS q, round(list_avg(list_filter(xs, lambda x: x <= q)), 6) AS es FROM q WHERE t >= 59""")
def rolling_tail(spark, d):
    df = _returns(spark, d)
    q = df.withColumn("q", F.percentile("r", F.lit(0.05)).over(W.trailing(60))).withColumn("xs", F.collect_list("r").over(W.trailing(60)))
    low = F.filter("xs", lambda x: x <= F.col("q"))
    es = F.aggregate(low, F.lit(0.0), lambda a, x: a + x) / F.size(low)
    return q.withColumn("es", es).filter("t >= 59").select("series_id", "t", *six("q", "es"))


# ---- the engine
def counts_sql(h: int) -> str:
    """mk(series_id, t, state, counts, pi_high) of st(series_id, t, state)."""
    return f"""tr2 AS (SELECT *, lag(state) OVER ({T.W}) AS s_ FROM st),
tc AS (SELECT *, {', '.join(f"CAST(sum(CASE WHEN s_ = {a} AND state = {b} THEN 1 ELSE 0 END) OVER ({T.W}) AS BIGINT) AS c{a}{b}" for a in (0, 1) for b in (0, 1))} FROM tr2),
tp AS (SELECT *, CASE WHEN c00 + c01 > 0 THEN c01 / (c00 + c01) ELSE 0.0 END AS pa, CASE WHEN c10 + c11 > 0 THEN c10 / (c10 + c11) ELSE 0.0 END AS pb FROM tc),
mk AS (SELECT series_id, t, state, c00, c01, c10, c11, CASE WHEN pa + pb > 0 THEN pa / (pa + pb) + (state - pa / (pa + pb)) * list_sum(list_transform(range(1, {h + 1}), lambda k: pow(1 - pa - pb, k))) / {h} ELSE CAST(state AS DOUBLE) END AS pi_high FROM tp)"""


COUNTS = counts_sql(H)


@query(f"WITH RECURSIVE {T.HOURLY}, {T.RETURNS}, {STATE}, {COUNTS} SELECT series_id, t, c00, c01, c10, c11 FROM mk")
def transition_counts(spark, d):
    return W.transitions(_states(spark, d)).select("series_id", "t", "c00", "c01", "c10", "c11")


@query(f"WITH RECURSIVE {T.HOURLY}, {T.RETURNS}, {STATE}, {COUNTS} SELECT series_id, t, round(pi_high, 6) AS pi_high FROM mk")
def markov_pi(spark, d):
    return W.markov_high(_states(spark, d), H).select("series_id", "t", *six("pi_high"))


def _pairs_sql(regime: bool) -> str:
    """cand: every candidate with its distance; pick: the greedy choice as rows."""
    same = "len(list_filter(a, lambda z: z.s = x.s))" if regime else "len(a)"
    return f"""
ask AS (SELECT * FROM data WHERE t >= {C.warmup} AND e0 + e1 + e2 + e3 IS NOT NULL),
own AS (SELECT *, target - ln(lv) AS y0, CAST(tail AS DOUBLE) AS y1 FROM data WHERE e0 + e1 + e2 + e3 IS NOT NULL AND target IS NOT NULL AND tail IS NOT NULL AND t >= {C.embedded}),
cand AS (SELECT q.series_id, q.t, o.t AS j, o.state, o.y0, o.y1, (o.e0 - q.e0) * (o.e0 - q.e0) + (o.e1 - q.e1) * (o.e1 - q.e1) + (o.e2 - q.e2) * (o.e2 - q.e2) + (o.e3 - q.e3) * (o.e3 - q.e3) AS dist
  FROM ask q JOIN own o ON o.series_id = q.series_id AND o.t <= q.t - {H}),
lists AS (SELECT series_id, t, list(struct_pack(j := j, s := state, d := dist) ORDER BY dist, j) AS l FROM cand GROUP BY 1, 2),
chosen AS (SELECT series_id, t, list_reduce(list_transform(l, lambda x: [x]), lambda a, y: CASE WHEN {same.replace('x.s', 'y[1].s')} < {C.k} AND len(list_filter(a, lambda z: abs(z.j - y[1].j) < {C.excl})) = 0 THEN list_concat(a, y) ELSE a END) AS got FROM lists),
pick AS (SELECT series_id, t, unnest(got, recursive := true) FROM chosen)"""


GREEDY = f"{DATA}, {COUNTS}, {_pairs_sql(True)}"


def _framed(spark, d):
    data = _data(spark, d)
    return data.select("series_id", "t", "emb", F.array(F.col("target") - F.log("long"), F.col("tail")).alias("y"), "state")


#: Weights of the two regimes' groups; sizes below the least count as absent.
MIXED = f"""gs AS (SELECT series_id, t, s, count(*) AS n FROM pick GROUP BY ALL),
gw AS (SELECT g.*, CASE WHEN n >= {C.k_min} THEN CASE WHEN s = 1 THEN pi_high ELSE 1 - pi_high END ELSE 0.0 END AS w0 FROM gs g JOIN mk USING (series_id, t)),
gn AS (SELECT *, w0 / sum(w0) OVER (PARTITION BY series_id, t) AS w, sum(w0) OVER (PARTITION BY series_id, t) AS ws FROM gw)"""


@query(f"""WITH RECURSIVE {T.HOURLY}, {GREEDY}, {MIXED}
  SELECT series_id, t, CAST(p.s AS INTEGER) AS grp, CAST(row_number() OVER (PARTITION BY series_id, t, p.s ORDER BY p.d, p.j) AS INTEGER) AS rank, p.j AS anchor_t, round(p.d, 6) AS distance, round(w / n, 6) AS weight
  FROM pick p JOIN gn USING (series_id, t, s) WHERE ws > 0""")
def knn_neighbours(spark, d):
    found = A.neighbours(_framed(spark, d), V.engine_of(C), C.m, 2)
    return found.select("series_id", "t", "grp", "rank", "anchor_t", *six("distance", "weight"))


FORECAST = f"""{MIXED},
ya AS (SELECT p.series_id, p.t, p.s, avg(o.y0) AS m0, avg(o.y1) AS m1, coalesce(var_samp(o.y0), 0) AS v0, coalesce(var_samp(o.y1), 0) AS v1 FROM pick p JOIN own o ON o.series_id = p.series_id AND o.t = p.j GROUP BY ALL),
fc AS (SELECT g.series_id, g.t, sum(w * m0) AS mean_0, sum(w * m1) AS mean_1, sqrt(sum(w * w * v0 / n)) AS se_0, sqrt(sum(w * w * v1 / n)) AS se_1, CAST(sum(n) AS DOUBLE) AS n_used FROM gn g JOIN ya USING (series_id, t, s) WHERE ws > 0 GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {T.HOURLY}, {GREEDY}, {FORECAST} SELECT series_id, t, {rnd('mean_0', 'mean_1', 'se_0', 'se_1')}, n_used, round(pi_high, 6) AS pi_high FROM fc JOIN mk USING (series_id, t)")
def knn_forecast(spark, d):
    made = A.forecast(_framed(spark, d), V.engine_of(C), C.m, 2)
    return made.select("series_id", "t", *six("mean_0", "mean_1", "se_0", "se_1"), "n_used", *six("pi_high"))


@query(f"""WITH RECURSIVE {T.HOURLY}, {GREEDY}, {FORECAST}
  SELECT series_id, t, round(exp(mean_0 + ln(lv)), 6) AS variance, round(mean_0 + ln(lv), 6) AS log_variance, round(realised, 6) AS realised, n_used AS n_analogues, round(mean_1, 6) AS tail_probability FROM fc JOIN data USING (series_id, t)""")
def volatility_forecast(spark, d):
    made = V.volatility_forecast(T.hourly(spark, d), C)
    return made.select("series_id", "t", *six("variance", "log_variance", "realised"), "n_analogues", *six("tail_probability"))


def _kernel_sql(block: bool) -> str:
    squares_cte = f"kb AS (SELECT series_id, t, state, sum(b * b) AS sq FROM (SELECT series_id, t, state, j // {H} AS bl, sum(w) AS b FROM kw GROUP BY ALL) GROUP BY ALL)" if block else "kb AS (SELECT series_id, t, state, sum(w * w) AS sq FROM kw GROUP BY ALL)"
    return f"""{DATA}, {COUNTS}, {_pairs_sql(True).split('lists AS')[0].rstrip().rstrip(',')},
kz AS (SELECT *, (dist - min(dist) OVER (PARTITION BY series_id, t)) / (2 * 0.36::DOUBLE) AS z FROM cand),
kw AS (SELECT *, exp(-z) AS w FROM kz WHERE z <= 30), {squares_cte},
kg AS (SELECT series_id, t, state, sum(w) AS tot, sum(w * y0) / sum(w) AS m0, greatest(sum(w * y0 * y0) / sum(w) - pow(sum(w * y0) / sum(w), 2), 0) AS v0 FROM kw GROUP BY ALL),
kn AS (SELECT g.*, tot * tot / sq AS neff FROM kg g JOIN kb USING (series_id, t, state)),
k0 AS (SELECT n.*, CASE WHEN neff >= {C.k_min} THEN CASE WHEN n.state = 1 THEN pi_high ELSE 1 - pi_high END ELSE 0.0 END AS w0 FROM kn n JOIN mk USING (series_id, t)),
k1 AS (SELECT *, sum(w0) OVER (PARTITION BY series_id, t) AS ws FROM k0)
SELECT series_id, t, round(sum(w0 / ws * m0), 6) AS mean_0, round(sqrt(sum(w0 / ws * w0 / ws * v0 / neff)), 6) AS se_0, round(sum(neff), 6) AS n_used FROM k1 WHERE ws > 0 GROUP BY 1, 2"""


@query(f"WITH RECURSIVE {T.HOURLY}, {_kernel_sql(False)}")
def kernel_forecast(spark, d):
    return A.forecast(_framed(spark, d), V.engine_of(C.but(bandwidth=0.6)), C.m, 2).select("series_id", "t", *six("mean_0", "se_0", "n_used"))


@query(f"WITH RECURSIVE {T.HOURLY}, {_kernel_sql(True)}")
def kernel_block_ess(spark, d):
    return A.forecast(_framed(spark, d), V.engine_of(C.but(bandwidth=0.6, kernel_block=True)), C.m, 2).select("series_id", "t", *six("mean_0", "se_0", "n_used"))


@query("""WITH v AS (SELECT vec_id AS t, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, CAST(label AS DOUBLE) AS y FROM embeddings),
  c AS (SELECT q.t, o.t AS j, o.y, list_sum(list_transform(range(1, 65), lambda i: (o.e[i] - q.e[i]) * (o.e[i] - q.e[i]))) AS d FROM v q JOIN v o ON o.t <= q.t - 10 WHERE q.t >= 100),
  l AS (SELECT t, list(struct_pack(j := j, y := y, d := d) ORDER BY d, j) AS l FROM c GROUP BY 1),
  g AS (SELECT t, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN len(a) < 5 AND len(list_filter(a, lambda z: abs(z.j - x[1].j) < 3)) = 0 THEN list_concat(a, x) ELSE a END) AS got FROM l),
  p AS (SELECT t, unnest(got, recursive := true) FROM g)
  SELECT t, round(avg(y), 6) AS mean_0, round(sqrt(var_samp(y) / count(*)), 6) AS se_0, CAST(count(*) AS DOUBLE) AS n_used FROM p GROUP BY 1""")
def analogue_embeddings(spark, d):
    df = spark.read.parquet(f"{d}/embeddings.parquet").select(F.lit("v").alias("series_id"), F.col("vec_id").alias("t"), F.col("embedding").alias("emb"), F.array(F.col("label").cast("double")).alias("y"))
    made = A.Analogue(k=5, k_min=2, horizon=10, exclusion=3, warmup=100).forecast(df, 64, 1)
    return made.select("t", *six("mean_0", "se_0"), "n_used")



@query(f"""WITH st AS (SELECT 'v' AS series_id, vec_id AS t, label % 2 AS state FROM embeddings), {counts_sql(10)},
  v AS (SELECT vec_id AS t, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, CAST(label AS DOUBLE) AS y, label % 2 AS s FROM embeddings),
  c AS (SELECT q.t, o.t AS j, o.y, o.s, list_sum(list_transform(range(1, 65), lambda i: (o.e[i] - q.e[i]) * (o.e[i] - q.e[i]))) AS d FROM v q JOIN v o ON o.t <= q.t - 10 WHERE q.t >= 100),
  l AS (SELECT t, list(struct_pack(j := j, y := y, s := s, d := d) ORDER BY d, j) AS l FROM c GROUP BY 1),
  g AS (SELECT t, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda z: z.s = x[1].s)) < 5 AND len(list_filter(a, lambda z: abs(z.j - x[1].j) < 3)) = 0 THEN list_concat(a, x) ELSE a END) AS got FROM l),
  p AS (SELECT t, unnest(got, recursive := true) FROM g), gs AS (SELECT t, s, count(*) AS n, avg(y) AS m, coalesce(var_samp(y), 0) AS va FROM p GROUP BY ALL),
  gw AS (SELECT gs.*, CASE WHEN n >= 2 THEN CASE WHEN s = 1 THEN pi_high ELSE 1 - pi_high END ELSE 0.0 END AS w FROM gs JOIN mk USING (t)), gn AS (SELECT *, sum(w) OVER (PARTITION BY t) AS ws FROM gw)
  SELECT t, round(sum(w / ws * m), 6) AS mean_0, round(sqrt(sum(w / ws * w / ws * va / n)), 6) AS se_0, CAST(sum(n) AS DOUBLE) AS n_used FROM gn WHERE ws > 0 GROUP BY 1""")
def analogue_embeddings_all(spark, d):
    """All vectors, all 64 components and the regime label % 2."""
    df = spark.read.parquet(f"{d}/embeddings.parquet").select(
        F.lit("v").alias("series_id"), F.col("vec_id").alias("t"), F.col("embedding").alias("emb"), F.array(F.col("label").cast("double")).alias("y"), (F.col("label") % 2).alias("state")
    )
    made = A.Analogue(k=5, k_min=2, horizon=10, exclusion=3, warmup=100).forecast(df, 64, 1, state="state")
    return made.select("t", *six("mean_0", "se_0"), "n_used")
