"""The jump gate: no trades while the chance of a jump is above what it was on most bars before the fold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fitting import fit_hawkes
from tidemark.functions.quantiles import quantiles
from tidemark.functions.recurrences import hawkes_probability
from tidemark.functions.windows import poisson_probability


def jump_probability(data: DataFrame, bounds: DataFrame, kind: str, h: int, warmup: int, window: int = 1000) -> DataFrame:
    """series_id, fold, a, b, t, p for the bars of each fold and all before it; data(series_id, t, jump).

    poisson: the rate over the last ``window`` bars, the same for all folds. hawkes: self-exciting, fitted on
    [warmup, a) for each fold."""
    if kind not in ("poisson", "hawkes"):
        raise ValueError("kind is poisson or hawkes")
    if kind == "poisson":
        return data.select("series_id", "t", poisson_probability(F.col("jump"), h, window).alias("p")).join(bounds, "series_id").filter("t < b").select("series_id", "fold", "a", "b", "t", "p")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        event, t, a = pdf["jump"].to_numpy(bool), pdf["t"].to_numpy(), int(pdf["a"].iloc[0])
        p = hawkes_probability(event, *fit_hawkes(event[(t >= warmup) & (t < a)]), h)
        return pdf[["series_id", "fold", "a", "b", "t"]].assign(p=p)

    rows = data.select("series_id", "t", "jump").join(bounds, "series_id").filter("t < b")
    return rows.groupBy("series_id", "fold").applyInPandas(run, "series_id string, fold int, a long, b long, t long, p double")


def gate(chances: DataFrame, warmup: int, q: float = 0.9) -> DataFrame:
    """series_id, fold, t, p, threshold and allowed; chances as ``jump_probability`` gives them.

    A fold's threshold is the q-quantile of its chances on [warmup, a), found by narrowing, so no task holds a series.
    Bars before the first fold go by that fold. Where the chance or the threshold is not known, trades are allowed."""
    before = chances.filter((F.col("t") >= warmup) & (F.col("t") < F.col("a")))
    threshold = quantiles(before, ["series_id", "fold"], "p", q, "threshold")
    first = chances.groupBy("series_id").agg(F.min("fold").alias("_first"))
    own = chances.join(first, "series_id").filter((F.col("t") >= F.col("a")) | (F.col("fold") == F.col("_first")))
    out = own.join(threshold, ["series_id", "fold"], "left")
    return out.select("series_id", "fold", "t", "p", "threshold", (~F.coalesce(F.col("p") > F.col("threshold"), F.lit(False))).alias("allowed"))
