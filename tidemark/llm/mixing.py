"""Mixing sources to target weights by hierarchical budgets over a domain, language and source tree.

A token budget goes down the tree. A node's children get their shares by weight, none more than its
subtree can supply (its tokens times the allowed epochs); what a child cannot take goes to its siblings in
proportion to their weights, and only when all of a node's subtree is used up does the node's own shortage
reach its siblings in turn. All shares are whole numbers, so engines agree on them exactly.

A leaf with its share draws from seeded epochs: whole epochs first, then the longest prefix of the next
epoch, in an order hashed from seed, epoch and document id, that stays within the share. The end of a prefix
is found by narrowing: sums over 256 key ranges, then over 256 ranges within the one that the share ends in,
and only what is left is put in order. No task holds a leaf.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import Scratch

SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"  # with the spaces after it
KEY_BITS, NARROW_BITS = 52, 8
LEVELS = ("domain", "lang", "source")


def source_domain(source: Column) -> Column:
    """Sources are named by number here: every second is the web, every fourth reference works."""
    number = F.coalesce(F.try_to_number(F.regexp_extract(source, r"(\d{1,6})$", 1), F.lit("999999")).cast("int"), F.lit(1))
    return F.when(number % 2 == 0, "web").when(number % 4 == 1, "books").otherwise("reference")


@dataclass(frozen=True)
class Mixture:
    """Weights are whole numbers; a name that a level does not list weighs ``default``."""

    weights: Sequence[Mapping[str, int]] = field(default_factory=lambda: ({"web": 60, "books": 15, "reference": 25}, {"en": 60, "de": 16, "fr": 14, "es": 10}, {"src0": 3}))
    default: int = 1
    budget_per_mille: int = 600  # of all tokens, each counted once
    max_epochs: int = 2
    seed: int = 7
    domain: Callable[[Column], Column] = source_domain


def _weight(level: int, mix: Mixture) -> Column:
    table = mix.weights[level]
    if not table:
        return F.lit(mix.default)
    return F.coalesce(F.create_map(*(F.lit(x) for x in chain(*table.items())))[F.col(LEVELS[level])], F.lit(mix.default))


def _big(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def allot(leaves: DataFrame, budget: int, mix: Mixture) -> DataFrame:
    """leaves(domain, lang, source, tokens) with ``share``."""
    capacity = leaves.withColumn("capacity", F.col("tokens") * mix.max_epochs)
    parents = None
    for depth in range(len(LEVELS)):
        path, above = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = capacity.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(depth, mix).cast("long")).filter("weight > 0")
        nodes = nodes.withColumn("given", F.lit(budget).cast("long")) if parents is None else nodes.join(parents, above)
        siblings = Window.partitionBy(*(above or [F.lit(0)]))
        # the least supply for its weight fills first, so those that are used up are a prefix
        rising = siblings.orderBy(F.col("capacity") / F.col("weight"), LEVELS[depth])
        before, onward = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
        nodes = nodes.withColumn("left", F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("heavy", F.sum("weight").over(onward))
        nodes = nodes.withColumn("used_up", _big(F.col("capacity")) * _big(F.col("heavy")) <= _big(F.col("left")) * _big(F.col("weight")))
        rest = F.col("given") - F.coalesce(F.sum(F.when(F.col("used_up"), F.col("capacity"))).over(siblings), F.lit(0))
        others = F.sum(F.when(~F.col("used_up"), F.col("weight"))).over(siblings)
        nodes = nodes.withColumns({"rest": rest, "others": others})
        share = F.when(F.col("used_up"), F.col("capacity")).otherwise(F.expr("CAST(rest AS DECIMAL(20,0)) * CAST(weight AS DECIMAL(18,0)) div others"))
        parents = nodes.select(*path, share.cast("long").alias("given"))
    return leaves.join(parents.withColumnRenamed("given", "share"), list(LEVELS))


def order_key(mix: Mixture, epoch: Column, doc_id: Column) -> Column:
    text = F.concat_ws("|", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The largest key of each leaf's prefix: rows(leaf, key, tokens), plan(leaf, rest) -> leaf, threshold."""
    leaf = list(LEVELS)
    bound = plan.filter("rest > 0").select(*leaf, "rest", F.lit(0).cast("long").alias("before"))
    inside, shift = rows.filter("rest > 0").select(*leaf, "key", "tokens"), KEY_BITS
    for _ in range(2):
        shift -= NARROW_BITS
        part = F.shiftright("key", shift).alias("part")
        sums = inside.groupBy(*leaf, part).agg(F.sum("tokens").alias("tokens")).join(bound.select(*leaf, "rest", "before"), leaf)
        sums = sums.withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("part")))
        first = sums.filter("upto > rest").groupBy(*leaf, "rest").agg(F.min(F.struct("part", (F.col("upto") - F.col("tokens")).alias("before"))).alias("end"))
        bound = first.select(*leaf, "rest", F.col("end.part").alias("part"), F.col("end.before").alias("before"))
        inside = inside.join(bound.select(*leaf, F.col("part").alias("_part")), leaf).filter(F.shiftright("key", shift) == F.col("_part")).drop("_part")
    # rows with one key (repeated ids) are in or out together
    last = inside.join(bound, leaf).withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy(*leaf, "part").orderBy("key")))
    return last.groupBy(*leaf).agg(F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("key"))), F.shiftleft(F.first("part"), shift) - 1).alias("threshold"))


def word_count(text: Column) -> Column:
    """Runs of other than spaces. Each becomes one letter, so no row has a list of its words: ``regexp_count`` makes one."""
    return F.length(F.regexp_replace(F.ltrim(text, F.lit(SPACES)), F.lit(WORD), F.lit("x")))


def _in_few(by_leaf: DataFrame) -> DataFrame:
    """Rows by leaf, for writing: a file for each core at most, not one for each shuffle partition that a leaf fell into."""
    return by_leaf.coalesce(by_leaf.sparkSession.sparkContext.defaultParallelism)


def _with_leaf(docs: DataFrame, mix: Mixture, source_col: str, lang_col: str) -> DataFrame:
    known = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    return docs.withColumns({"domain": mix.domain(known(source_col)), "lang": known(lang_col), "source": known(source_col)})


def plan_mixture(docs: DataFrame, mix: Mixture, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(slim rows, plan): the documents' leaf, id and tokens; each leaf's tokens, share, epochs and threshold."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col("lang"), F.col("source"))
    leafed = _with_leaf(named, mix, "source", "lang")
    slim = scratch.table(leafed.select("id", *LEVELS, F.coalesce(word_count(F.col("text")), F.lit(0)).cast("long").alias("tokens")), "slim")
    leaves = scratch.table(_in_few(slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))), "leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    shares = allot(leaves, total * mix.budget_per_mille // 1000, mix)
    whole = F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(F.lit(0))
    shares = scratch.table(_in_few(shares.withColumn("epochs", whole).withColumn("rest", F.col("share") - F.col("epochs") * F.col("tokens"))), "shares")
    keyed = scratch.table(slim.join(shares.select(*LEVELS, "epochs", "rest"), list(LEVELS)).withColumn("key", order_key(mix, F.col("epochs"), F.col("id"))), "keyed")
    plan = scratch.table(_in_few(shares.join(thresholds(keyed, shares), list(LEVELS), "left").withColumn("threshold", F.coalesce("threshold", F.lit(-1).cast("long")))), "plan")
    return slim, plan


def draw(rows: DataFrame, plan: DataFrame, mix: Mixture) -> DataFrame:
    """rows(id, domain, lang, source, ...) once for each epoch that selects them, with ``epoch``."""
    chosen = rows.join(plan.select(*LEVELS, "epochs", "threshold"), list(LEVELS))
    times = F.col("epochs") + (order_key(mix, F.col("epochs"), F.col("id")) <= F.col("threshold")).cast("long")
    return chosen.withColumn("times", times).filter("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))).drop("times", "epochs", "threshold")


def mix_documents(docs: DataFrame, mix: Mixture | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' own columns, a document once for each epoch that selects it.

    Defined cases: a null source or language is a leaf named "unknown"; a null or empty text has no tokens
    and goes with the prefix that its key falls into; rows that share an id are drawn together; a level's
    node with weight 0 gives nothing; no rows give no rows; other columns are carried in a struct.
    """
    mix = mix or Mixture()
    scratch = Scratch(docs.sparkSession, "mixing")
    _, plan = plan_mixture(docs, mix, scratch, id_col, text_col)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), "lang", "source")
    return draw(_with_leaf(whole, mix, "source", "lang"), plan, mix).select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = Mixture()
    slim, plan = plan_mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"), mix, Scratch(spark, "mixing"))
    return draw(slim, plan, mix).select(F.col("id").alias("doc_id"), *LEVELS, F.col("tokens").alias("n_tokens"), "epoch")


def _sql() -> str:
    mix = Mixture()
    case = lambda level: f"coalesce(map {{{', '.join(f'{k!r}: {v}' for k, v in mix.weights[level].items())}}}[{LEVELS[level]}], {mix.default})::BIGINT"
    ctes, above = [], ""
    for depth, name in enumerate(LEVELS):
        path = ", ".join(LEVELS[: depth + 1])
        part = f"PARTITION BY {above}" if above else ""
        given = f"(SELECT CAST(sum(tokens) AS BIGINT) * {mix.budget_per_mille} // 1000 FROM leaves)" if not above else "p.given"
        join = f"JOIN g{depth - 1} p USING ({above})" if above else ""
        ctes.append(f"""
n{depth} AS (SELECT {path}, CAST(sum(tokens) AS HUGEINT) * {mix.max_epochs} AS capacity, {case(depth)} AS weight FROM leaves GROUP BY {path}),
a{depth} AS (SELECT n.*, {given} AS given FROM n{depth} n {join} WHERE weight > 0),
b{depth} AS (SELECT *, given - coalesce(sum(capacity) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
  sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy FROM a{depth} WINDOW r AS ({part} ORDER BY capacity / weight, {name})),
c{depth} AS (SELECT *, capacity * heavy <= lft * weight AS used_up FROM b{depth}),
d{depth} AS (SELECT *, given - coalesce(sum(CASE WHEN used_up THEN capacity END) OVER ({part}), 0) AS rest,
  sum(CASE WHEN NOT used_up THEN weight END) OVER ({part}) AS others FROM c{depth}),
g{depth} AS (SELECT {path}, CAST(CASE WHEN used_up THEN capacity ELSE CAST(rest AS HUGEINT) * weight // CAST(others AS HUGEINT) END AS HUGEINT) AS given FROM d{depth})""")
        above = path
    return f"""
WITH named AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents),
numbered AS (SELECT *, coalesce(try_cast(regexp_extract(source, '(\\d{{1,6}})$', 1) AS INTEGER), 1) AS number FROM named),
slim AS (SELECT doc_id, CASE WHEN number % 2 = 0 THEN 'web' WHEN number % 4 = 1 THEN 'books' ELSE 'reference' END AS domain, lang, source, tokens FROM numbered),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM slim GROUP BY ALL),{",".join(ctes)},
plan AS (SELECT l.domain, l.lang, l.source, CASE WHEN l.tokens > 0 THEN CAST(g.given // l.tokens AS BIGINT) ELSE 0 END AS epochs, g.given, l.tokens AS total
  FROM leaves l JOIN g2 g USING (domain, lang, source)),
keyed AS (SELECT s.*, p.epochs, p.given - p.epochs * p.total AS rest,
  CAST('0x' || substr(md5('{mix.seed}|' || p.epochs || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS key FROM slim s JOIN plan p USING (domain, lang, source)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM keyed),
times AS (SELECT *, epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS n FROM summed)
SELECT doc_id, domain, lang, source, tokens AS n_tokens, CAST(unnest(range(n)) AS BIGINT) AS epoch FROM times WHERE n > 0
"""


OP1_SQL = _sql()
