"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of the labelled rows (``max_examples``, drawn by a hash of the id). Terms are
words and the first 4, 5 and 6 letters of longer ones; those that tell the labels apart on the sample (chi
squared, and mostly seen in toxic rows) make up the index's vocabulary, bounded by ``max_terms``, so index
and vocabulary are bounded whatever the input and can be broadcast.

The index lists for each term, block by block, the examples that hold it and the block's largest weight. For
a text, a block's bound is the sum of its terms' largest products; blocks are scored from the highest bound
down until no bound beats the k-th best cosine, which gives the exact k nearest. Their votes are weighted by
similarity, and isotonic regression on the examples' own leave-one-out votes turns a vote into a calibrated
score. The nearest examples are returned as evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
REJECT = 0.7


@dataclass(frozen=True)
class Settings:
    max_examples: int = 8192
    max_terms: int = 4096
    min_chi2: float = 30.0
    min_rows: int = 5
    k: int = 15
    block: int = 64
    prior: float = 0.05  # similarity of a clean example that each of the k is held against


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


@dataclass
class Index:
    """terms: term -> (number, idf). postings[number]: blocks, largest weights, and per block rows and weights."""

    terms: dict[str, tuple[int, float]]
    ids: list = field(default_factory=list)
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    postings: list = field(default_factory=list)
    blocks: int = 0
    block: int = 64
    memo: dict = field(default_factory=dict)

    def vector(self, text: str | None) -> dict[int, float]:
        """Unit vector of the text over the vocabulary; empty if it holds none of it."""
        if not text or not self.terms:
            return {}
        if len(self.memo) > 50_000:
            self.memo = {}
        counts: Counter = Counter()
        memo = self.memo
        for word, n in Counter(WORD.findall(text.lower())).items():
            known = memo.get(word)
            if known is None:
                known = memo[word] = tuple(self.terms[t] for t in terms_of(word) if t in self.terms)
            for t in known:
                counts[t] += n
        v = {number: (1 + math.log(n)) * idf for (number, idf), n in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    def fill(self, rows: list[tuple[object, int, dict[int, float]]], block: int) -> None:
        """rows: id, label, vector. Rows with like vectors are put side by side, which tightens the bounds."""
        rows = sorted((r for r in rows if r[2]), key=lambda r: (max(r[2], key=r[2].get), str(r[0])))
        self.ids, self.toxic, self.block = [r[0] for r in rows], np.array([r[1] for r in rows], float), block
        self.blocks = -(-len(rows) // block)
        lists: list[dict[int, list]] = [{} for _ in self.terms]
        for i, (_, _, v) in enumerate(rows):
            for t, x in v.items():
                lists[t].setdefault(i // block, []).append((i, x))
        self.postings = [
            (np.array(list(by), int), np.array([max(x for _, x in p) for p in by.values()]), {b: (np.array([i for i, _ in p]) - b * block, np.array([x for _, x in p])) for b, p in by.items()})
            for by in lists
        ]

    def nearest(self, v: dict[int, float], k: int, without: object = None) -> list[tuple[float, int]]:
        """(cosine, row) of the k nearest, ties to the earlier row. ``without``: an id that is left out."""
        bound = np.zeros(self.blocks)
        for t, x in v.items():
            blocks, most, _ = self.postings[t]
            bound[blocks] += x * most
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best) == k and bound[b] < best[-1][0] - 1e-9:
                break
            score = np.zeros(self.block)
            for t, x in v.items():
                if b in self.postings[t][2]:
                    at, w = self.postings[t][2][b]
                    score[at] += x * w
            best += [(float(score[i]), int(b) * self.block + int(i)) for i in np.flatnonzero(score) if without is None or self.ids[int(b) * self.block + int(i)] != without]
            best = sorted(best, key=lambda s: (-s[0], s[1]))[:k]
        return best

    def vote(self, near: list[tuple[float, int]], k: int, prior: float) -> float:
        return sum(s * self.toxic[i] for s, i in near) / (sum(s for s, _ in near) + k * prior)


def isotonic(votes: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (smallest vote, probability) by pooling adjacent violators; half a row of each label is added."""
    blocks: list[list[float]] = []  # smallest vote, rows, toxic rows
    for x in np.unique(votes):
        at = votes == x
        blocks.append([float(x), float(at.sum()), float(toxic[at].sum())])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            _, n, y = blocks.pop()
            blocks[-1][1] += n
            blocks[-1][2] += y
    return np.array([b[0] for b in blocks]), np.array([(b[2] + 0.5) / (b[1] + 1) for b in blocks])


@dataclass
class Model:
    index: Index
    steps: np.ndarray
    chances: np.ndarray
    settings: Settings
    id_type: str = "bigint"

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        near = self.index.nearest(self.index.vector(text), self.settings.k)
        vote = self.index.vote(near, self.settings.k, self.settings.prior)
        return float(self.chances[max(0, int(np.searchsorted(self.steps, vote, side="right")) - 1)]), near


def _texts(column: pa.Array) -> Iterator[str | None]:
    """One text at a time: as Python's strings, a batch would be held twice over."""
    return (x.as_py() for x in column)


def _choose_terms(sample: DataFrame, s: Settings) -> dict[str, tuple[int, float]]:
    """The sample is bounded, so are its counts; they are added up in Spark all the same."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, y in zip(_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                seen[y].update({t for w in set(WORD.findall((text or "").lower())) for t in terms_of(w)})
            for y in (0, 1):
                yield pa.record_batch([pa.array(list(seen[y]), pa.string()), pa.array(np.full(len(seen[y]), y, np.int32)), pa.array(list(seen[y].values()), pa.int64())], ["term", "y", "n"])

    rows = sample.groupBy("y").count().collect()
    n1, n0 = (sum(r["count"] for r in rows if r["y"] == y) for y in (1, 0))
    counts = sample.select("text", "y").mapInArrow(lean(count), "term string, y int, n long").groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    n = float(n1 + n0)
    chi2 = n * F.pow(a * (n0 - b) - b * (n1 - a), 2) / ((a + b) * (n - a - b) * n1 * n0)
    picked = counts.filter((F.col("a") + F.col("b") >= s.min_rows) & (F.col("a") > F.col("b")) & (F.col("a") + F.col("b") < n)).withColumn("chi2", chi2).filter(F.col("chi2") >= s.min_chi2) if n1 and n0 else counts.filter("false").withColumn("chi2", F.lit(0.0))
    top = picked.orderBy(F.desc("chi2"), "term").limit(s.max_terms).collect()
    return {r["term"]: (i, math.log((1 + n) / (1 + r["a"] + r["b"])) + 1) for i, r in enumerate(top)}


def train_row(id_col: str = "doc_id") -> Column:
    return fold(id_col) != 1


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic): learns from the labels' rows outside the held-out fold.

    Ids are of any type, the same in both. An id that repeats in docs counts with one of its texts (by a hash), so that
    the sample never has more rows than ``max_examples``; one that repeats in labels with its largest label."""
    s = settings or Settings()
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & train_row()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_examples)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.max_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text")).persist()
    try:
        terms = _choose_terms(sample, s)
        index = Index(terms)

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = [index.vector(t) for t in _texts(batch.column(1))]
                yield pa.record_batch([batch.column(0), batch.column(2), pa.array([list(x) for x in v], pa.list_(pa.int32())), pa.array([list(x.values()) for x in v], pa.list_(pa.float64()))], ["doc_id", "y", "t", "x"])

        rows = sample.select("doc_id", "text", "y").mapInArrow(lean(vectors), f"doc_id {id_type}, y int, t array<int>, x array<double>").collect()
    finally:
        sample.unpersist()
    examples = sorted(((r["doc_id"], r["y"], dict(zip(r["t"], r["x"], strict=True))) for r in rows), key=lambda r: (r[0], r[1]))
    index.fill(examples, s.block)
    # most of the sample has an empty vector and costs nothing here
    votes = np.array([index.vote(index.nearest(v, s.k, without=i), s.k, s.prior) if v else 0.0 for i, _, v in examples])
    steps, chances = isotonic(votes, np.array([y for _, y, _ in examples], float)) if examples else (np.zeros(1), np.zeros(1))
    return Model(index, steps, chances, s, id_type)


def score_toxicity(docs: DataFrame, model: Model, evidence: int = 3) -> DataFrame:
    """All columns of docs in ``row``, with score and the evidence: ids and similarities of the nearest examples.

    Defined cases: null and empty texts, and texts without any of the vocabulary, get the chance of examples
    without neighbours; with no labelled rows every score is 0; repeated rows are scored each; no rows give
    no rows; extra columns stay inside ``row``. Whole texts are read.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    spark = docs.sparkSession
    ids_type = to_arrow_type(_parse_datatype_string(model.id_type))
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            row = batch.column(0)
            found = [m.score(t) for t in _texts(row.field(at))]
            near = [n[:evidence] for _, n in found]
            yield pa.record_batch(
                [row, pa.array([p for p, _ in found], pa.float64()), pa.array([[m.index.ids[i] for _, i in n] for n in near], pa.list_(ids_type)), pa.array([[s for s, _ in n] for n in near], pa.list_(pa.float64()))],
                ["row", "score", "evidence_ids", "evidence_similarity"],
            )

    # the text goes to the workers once, in its row
    at = [c.lower() for c in docs.columns].index("text")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.mapInArrow(lean(score), f"row {rows.schema['row'].dataType.simpleString()}, score double, evidence_ids array<{model.id_type}>, evidence_similarity array<double>")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select(F.col("row.doc_id").alias("doc_id"), "score", "evidence_ids").select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), "evidence_ids")
