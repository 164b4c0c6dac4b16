"""A small corpus with every awkward row: nulls, empty and long texts, ties, repeats and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

SYLLABLES = "ba de fi go lu me ni po ra su ta ve wo xi yo zu".split()


def sentence(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def corpus_rows():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        rows.append((i, sentence(rng, rng.randint(20, 120)), ["en", "de"][i % 2], f"src{i % 5}"))
    for i in range(12):  # near copies of one text, each with one word changed
        words = rows[3][1].split() + sentence(rng, 60).split()
        if i == 0:
            base = words
        w = list(base)
        w[rng.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w), "en", "src0"))
    rows += [(200 + i, rows[7][1].upper(), "en", "src0") for i in range(5)]
    rows += [(300, None, "en", "src1"), (301, "", None, "src1"), (302, " \n\t ", "en", None), (303, "one two", "en", "src2"), (304, "One  Two", "en", "src2"), (305, "é É ß 日本 語", "de", "src3")]
    rows += [(306, sentence(rng, 6000), "en", "src4"), (307, "x" * 30000, "en", "src4"), (308, "<|endoftext|> a<|endoftext|>", "en", "src4")]
    rows += [(0, rows[0][1], "en", "src0"), (0, rows[0][1], "en", "src0")]  # repeated rows
    rows += [(None, rows[9][1], "en", "src0"), (None, None, None, None)]
    return rows


#: Names that operators use inside; documents may have them as well.
CLASH = ["id", "row", "digest", "n", "key", "size", "score", "item", "rank", "part", "loc", "cls", "tokens", "domain", "epoch", "shard", "slot", "bytes", "kept", "task"]


@pytest.fixture(scope="session")
def corpus(spark):
    return corpus_rows()


@pytest.fixture(scope="session")
def docs(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(f"x-{c}") for c in CLASH}).repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture
def sf_dir(tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)
