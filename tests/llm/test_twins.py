"""Sharding and packing against plain versions of their methods."""

import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import packing, sharding, token_counts


def plain_differencing(weights, parts):
    """Sums of the parts: the two partial partitions of largest spread are added, oppositely ordered, until one is left."""
    left = [(w, i, sorted([w] + [0] * (parts - 1), reverse=True)) for i, w in enumerate(weights)]
    number = len(left)
    while len(left) > 1:
        left.sort(key=lambda x: (-x[0], x[1]))
        (_, _, a), (_, _, b) = left[:2]
        both = sorted((x + y for x, y in zip(a, reversed(b))), reverse=True)
        both = [x - both[-1] for x in both]
        left = [*left[2:], (both[0] - both[-1], number, both)]
        number += 1
    spread = left[0][2]
    rest = (sum(weights) - sum(spread)) // parts
    return sorted((x + rest for x in spread), reverse=True)


@pytest.mark.parametrize("seed,n,parts", [(0, 50, 4), (1, 200, 7), (2, 3, 5), (3, 90, 40), (4, 1, 2)])
def test_differencing_equals_the_plain_one(seed, n, parts):
    rng = random.Random(seed)
    w = [rng.choice([rng.randint(1, 50), rng.randint(1, 5000)]) for _ in range(n)]
    part = sharding.difference(np.array(w), parts)
    sums = sorted(np.bincount(part, weights=w, minlength=parts).astype(int).tolist(), reverse=True)
    assert sums == plain_differencing(w, parts)


def test_shards_of_the_query(spark, sf_dir, corpus):
    """The law, sizes and slots that the query returns; groups stay together and the heaviest shard is as light as can be."""
    out = sharding.op3_sharding(spark, sf_dir).collect()
    assert len(out) == len(corpus) and {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}
    size = lambda t: len((t or "").encode()) + 16
    groups = Counter()
    for _, t, *_ in corpus:
        groups[t] += size(t)
    sums = Counter()
    for r in out:
        sums[r.shard] += r.size
    assert sum(sums.values()) == sum(groups.values())
    # one group outweighs an even share: it is alone, and the others are level
    assert max(sums.values()) == max(plain_differencing(list(groups.values()), 40)) == max(max(groups.values()), max(sums.values()))


def plain_packs(lengths, size):
    """Lengths from the longest on, each to the pack with the most room, a new one where none has enough."""
    packs = []
    for x in sorted(lengths, reverse=True):
        best = max((p for p in packs if size - sum(p) >= x), key=lambda p: size - sum(p), default=None)
        if best is None:
            packs.append(best := [])
        best.append(x)
    return Counter(tuple(sorted(p)) for p in packs)


@pytest.mark.parametrize("seed,size", [(0, 20), (1, 64), (2, 2048), (3, 7)])
def test_packs_fill_as_well_as_plain_ones(seed, size):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, size), rng.randint(1, max(1, size // 8))]) for _ in range(400)]
    made = packing.patterns(Counter(lengths), size)
    assert Counter(x for p, n in made for x in p for _ in range(n)) == Counter(lengths) and all(sum(p) <= size for p, _ in made)
    assert sum(n for _, n in made) == sum(plain_packs(lengths, size).values())
    room = sorted(size - sum(p) for p, n in made for _ in range(n))
    assert room == sorted(size - sum(p) for p, n in plain_packs(lengths, size).items() for _ in range(n))


def test_packing_at_the_production_length(spark, docs, corpus):
    pytest.importorskip("tokenizers")
    out = packing.pack(docs, 2048, *token_counts.vocabulary()).collect()
    held = {}
    for r in out:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in out) == sum(r.doc_tokens for r in out if r.start == 0) and sum(r.start == 0 for r in out) == len(corpus)
    assert len(held) == sum(plain_packs([r.length for r in out], 2048).values())


def test_stages_of_nothing(spark, docs, nothing, tmp_path):
    """Every stage of the pipeline on an empty table, read from files and not."""
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plain = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    for empty in (plain, spark.read.schema(plain.schema).parquet(f"{tmp_path}/documents.parquet")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, empty, str(tmp_path))
            assert out.count() == 0, name
            assert name == "packing" or out.columns == plain.columns
