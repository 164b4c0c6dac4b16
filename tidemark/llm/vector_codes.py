"""Vector code compression by member-resident Lloyd iterations.

A vector is cut into parts; each part position has a codebook, and a vector's code names the nearest entry for
every part. The members (a vector's part at a position) are dealt once by (position, entry, salt) and stay in
the files of their owner. In each round an owner's members add up to the entry's new value where they lie, only
sums travel; then members are assigned anew, those that keep their entry stay, and only those that change it
migrate in a shuffle to their new owner. The salt splits an entry that a large share of all vectors chooses.

All arithmetic is on whole numbers, so results do not depend on how rows are dealt. Codebooks have a size given
by parameters and are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch

SCALE = 256
#: Scaled components are held within this bound, so that all sums of squares fit in 64 bits.
LARGEST = 1 << 26
#: Members of an entry are dealt over so many owners.
SALTS = 32
#: Members whose distances are held at a time.
AT_ONCE = 4096
#: Labels that are broadcast at most.
FEW_LABELS = 100_000


def nearest(parts: np.ndarray, position: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part; books[position, entry, component]. Ties go to the lower entry."""
    entry, far = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    for lo in range(0, len(parts), AT_ONCE):
        at = slice(lo, lo + AT_ONCE)
        gap = parts[at, None, :] - books[position[at]]
        d = np.einsum("nec,nec->ne", gap, gap)
        entry[at] = d.argmin(axis=1)
        far[at] = d.min(axis=1)
    return entry, far


@dataclass(frozen=True)
class Codes:
    """rows: all columns of the kept vectors in ``row``, with code, error; codebooks[part][entry][component]; migrated: members that each round moved."""

    rows: DataFrame
    codebooks: np.ndarray
    migrated: list[int]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for x in self.codebooks.ravel().tolist()).encode()).hexdigest()


MEMBER = "rid long, position int, entry int, far long, part array<long>, moved boolean"


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", salts: int = SALTS) -> Codes:
    """Codes of all vectors whose components are all present and finite.

    Initial entries are the parts of the vectors with the smallest ids (rows without an id come last; fewer vectors
    give smaller codebooks). Vectors shorter than the longest, and a length that the parts don't divide, are filled up with 0;
    scaled components beyond ``LARGEST`` count as that. Rows with equal ids are vectors each. No vectors give no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for a part: 1 to 256 entries")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    row = F.struct(*(F.col(f"`{c}`") for c in vectors.columns)).alias("row")
    wide = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    scaled = F.transform("x", lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(v * SCALE))).cast("long"))
    kept = vectors.select(row, F.col(f"`{id_col}`").alias("id"), wide.alias("x")).filter(F.col("x").isNotNull() & finite)
    kept = scratch.table(kept.select(F.monotonically_increasing_id().alias("rid"), "row", "id", scaled.alias("x")), "kept")
    longest = kept.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(parts * width) - F.size("x"))).alias("x")
    rows = kept.select("rid", filled)
    # the first ``entries`` vectors: bounded by the parameter
    first = [r["x"] for r in kept.select("id", filled).orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()]
    books = np.array(first, np.int64).reshape(-1, parts, width).transpose(1, 0, 2)
    if not len(first):
        return Codes(kept.select("row", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books, [])

    def enter(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            position = np.tile(np.arange(parts), n)
            yield from members(np.repeat(batch.column(0).to_numpy(), parts), position, *nearest(x, position, books), x, np.ones(n * parts, bool))

    def members(rid, position, entry, far, x, moved) -> Iterator[pa.RecordBatch]:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x.ravel()))
        yield pa.record_batch([pa.array(rid), pa.array(position, pa.int32()), pa.array(entry, pa.int32()), pa.array(far), lists, pa.array(moved)], ["rid", "position", "entry", "far", "part", "moved"])

    def again(books: np.ndarray):
        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("part").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                position, old = batch.column("position").to_numpy(), batch.column("entry").to_numpy()
                entry, far = nearest(x, position, books)
                yield from members(batch.column("rid").to_numpy(), position, entry, far, x, entry != old)

        return assign

    salt = F.pmod(F.xxhash64("rid"), F.lit(salts))

    def migrate(df: DataFrame, name: str) -> DataFrame:
        """Members in the files of their owners."""
        return scratch.table(df.repartition("position", "entry", salt), name)

    resident = migrate(rows.mapInArrow(enter, MEMBER), "owned-0")
    migrated, names = [], ["owned-0"]
    for step in range(1, rounds + 1):
        sums = resident.groupBy("position", "entry").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("part")[i]).alias(f"s{i}") for i in range(width)))
        books = books.copy()
        for r in sums.collect():  # at most parts x entries rows
            books[r["position"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
        anew = scratch.table(resident.mapInArrow(again(books), MEMBER), f"assigned-{step}")
        movers = anew.filter("moved")
        migrated.append(movers.count())
        if step == rounds:
            resident = anew
        else:  # who stays is read where it lies
            resident = anew.filter("not moved").unionByName(migrate(movers, f"owned-{step}"))
        scratch.drop(*names)
        names = [f"assigned-{step}", f"owned-{step}"]
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda x: F.lpad(F.lower(F.hex(x["entry"])), 2, "0")), "")
    coded = resident.groupBy("rid").agg(code.alias("code"), F.sum("far").alias("error"))
    return Codes(kept.select("rid", "row").join(coded, "rid").select("row", "code", "error"), books, migrated)


def reconstruct(coded: DataFrame, codebooks: np.ndarray, code_col: str = "code") -> DataFrame:
    """coded with the vector that a code stands for in ``decoded`` (components divided by the scale)."""
    parts = len(codebooks)
    flat = F.lit([[[float(x) / SCALE for x in entry] for entry in book] for book in codebooks.tolist()])
    entry = lambda p: F.conv(F.substring(F.col(code_col), 2 * p + 1, 2), 16, 10).cast("int")
    return coded.withColumn("_books", flat).withColumn("decoded", F.concat(*(F.col("_books")[p][entry(p)] for p in range(parts)))).drop("_books")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    codes = compress(vectors)
    rows = Scratch(spark, "coded").table(codes.rows.select("row.vec_id", "row.label", "code", "error"), "rows")
    totals = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    if totals.count() <= FEW_LABELS:
        totals = F.broadcast(totals)
    out = rows.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def op12_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The same by plain joins of all parts with all entries."""
    steps = ""
    for r in range(rounds + 1):
        steps += f""",
dist{r} AS (SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN book{r} b ON p.part = b.part),
pick{r} AS (SELECT vec_id, part, min(d) AS d, arg_min(entry, d * 256 + entry) AS entry FROM dist{r} GROUP BY vec_id, part)"""
        if r < rounds:
            steps += f""",
mean{r} AS (SELECT part, entry, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM (SELECT p.part, k.entry, unnest(p.x) AS v, unnest(range(len(p.x))) AS i FROM p JOIN pick{r} k USING (vec_id, part)) GROUP BY part, entry, i),
new{r} AS (SELECT part, entry, list(v ORDER BY i) AS x FROM mean{r} GROUP BY part, entry),
book{r + 1} AS (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM book{r} b LEFT JOIN new{r} n ON b.part = n.part AND b.entry = n.entry)"""
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
p AS (SELECT vec_id, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS x FROM (SELECT vec_id, x, unnest(range({parts})) AS part FROM v)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < {entries}),
book0 AS (SELECT part, entry, x FROM p JOIN f USING (vec_id)){steps},
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM pick{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN v USING (vec_id), h
"""


OP12_SQL = op12_sql()
