import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, dedup, jaccard, katz, licences, maxscore, mixing, packing, sharding, token_counts, toxicity, words
from tidemark.llm.shared import Scratch

from . import brute


def key(x):
    return tuple((v is not None, v if v is not None else 0) for v in x)


# ---- 8
def test_dedup_matches_groups(spark, docs, nothing, corpus, sf_dir, tmp_path):
    out = dedup.op8_exact_dedup(spark, sf_dir).collect()
    groups = defaultdict(list)
    for d, t, *_ in corpus:
        groups[brute.lower_ascii(t)].append(d)
    want = sorted(((d, max((x for x in groups[brute.lower_ascii(t)] if x is not None), default=None), len(groups[brute.lower_ascii(t)])) for d, t, *_ in corpus), key=key)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in out), key=key) == want
    assert sum(r.kept for r in out) == len(groups)
    kept = dedup.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    nothing.write.parquet(f"{tmp_path}/none.parquet")
    assert dedup.dedup_table(spark, f"{tmp_path}/none.parquet").count() == 0


def test_dedup_checks_bytes_when_digests_meet(spark, sf_dir, corpus):
    weak = lambda text: F.pmod(F.length(text), F.lit(3)).cast("string")
    out = dedup.dedup_table(spark, f"{sf_dir}/documents.parquet", digest=weak, files_per_batch=1)
    assert out.filter("kept").count() == len({brute.lower_ascii(t) for _, t, *_ in corpus})


# ---- 3
def test_shards(spark, docs, nothing, corpus):
    out = sharding.shard_table(docs, 4).collect()
    assert len(out) == len(corpus)
    where = defaultdict(set)
    size = Counter()
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        size[r.shard] += r.size
        where[(r.crc, r.size)].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(len(s) == 1 for k, s in where.items() if k[1] > 16)
    assert sharding.shard_table(nothing, 4).count() == 0


def test_differencing_is_tight_and_levels_agree(spark):
    rng = np.random.default_rng(1)
    w = rng.integers(1, 10_000, 3000)
    part = sharding.difference(w, 8)
    sums = np.bincount(part, weights=w, minlength=8)
    assert sums.max() - sums.min() <= 20
    w = rng.integers(1, 10_000, 20_000)
    items = spark.createDataFrame([(str(i), int(x)) for i, x in enumerate(w)], "item string, weight long")
    placed = sharding.balance(items, 8, Scratch(spark, "t"), batch=4000, fan_in=16, top=4000).join(items, "item")
    sums = [r["s"] for r in placed.groupBy("shard").agg(F.sum("weight").alias("s")).collect()]
    assert placed.count() == 20_000 and max(sums) - min(sums) < 0.001 * np.mean(sums)


# ---- 9, 7
def test_tokens_are_the_library_s(spark, docs, nothing, corpus):
    tokenizers = pytest.importorskip("tokenizers")
    path, pattern = token_counts.vocabulary()
    library = tokenizers.Tokenizer.from_file(path)
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t, *_ in corpus]
    out = token_counts.with_token_counts(docs, path, pattern).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in out) == sorted((len((t or "").encode()), len(i)) for (_, t, *_), i in zip(corpus, ids))
    rng = random.Random(2)
    odd = ["".join(rng.choice(["a", " ", "\n", "'s", "1", "é", "!", "\t", "b", " ", "日", "aa"]) for _ in range(rng.randint(0, 14))) for _ in range(500)]
    got = bpe.Merger(path, pattern).encode(odd)
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in odd]

    pieces = packing.pack(docs, 256, path, pattern).collect()
    assert sum(p.length for p in pieces) == sum(len(i) + 1 for i in ids)
    crcs = sorted(zlib.crc32(np.array([*i, 1][a : a + 256], "<u4").tobytes()) for i in ids for a in range(0, len(i) + 1, 256))
    assert sorted(p.ids_crc32 for p in pieces) == crcs
    ends = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends[p.sequence_id]
        ends[p.sequence_id] += p.length
    assert max(ends.values()) <= 256
    assert packing.pack(nothing, 256, path, pattern).count() == 0 and token_counts.with_token_counts(nothing, path, pattern).count() == 0


def test_patterns_place_everything():
    rng = random.Random(3)
    histogram = dict(Counter(rng.randint(1, 100) for _ in range(5000)))
    made = packing.patterns(histogram, 100)
    placed = Counter()
    for lengths, n in made:
        assert sum(lengths) <= 100
        for x in lengths:
            placed[x] += n
    assert placed == histogram
    assert sum(k * v for k, v in histogram.items()) / (100 * sum(n for _, n in made)) > 0.99


# ---- 10
def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.2, (300, 8))
    x[50:80] = x[50]  # ties
    rows = [(i, [float(v) for v in x[i]], "c") for i in range(300)]
    rows += [(1000, None, "c"), (1001, [], "c"), (1002, [float("nan")] * 8, "c"), (1003, [None] * 8, "c"), (1004, [float("inf")] * 8, "c"), (None, [0.1] * 8, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    q = np.floor(64 * x).astype(int)
    want = []
    for i in range(0, 300, 20):
        s = sorted(((int(-(q[i] @ q[j])), j) for j in range(300) if j != i))[:20]
        want += [(i, n, j, -v) for n, (v, j) in enumerate(s, 1)]
    for shard, block in ((8192, 256), (37, 4)):
        got = [tuple(r) for r in maxscore.top_k(df, shard=shard, block=block).orderBy("query_id", "rank").collect()]
        assert got == want
    assert maxscore.top_k(df.limit(0)).count() == 0


# ---- 1
def water(b, children):
    """children: name -> (capacity, weight); the plain fixed-point version."""
    given, open_ = dict.fromkeys(children, 0), {c for c, (_, w) in children.items() if w > 0}
    while open_:
        left = b - sum(given[c] for c in children if c not in open_)
        total = sum(children[c][1] for c in open_)
        full = {c for c in open_ if children[c][0] * total <= left * children[c][1]}
        if not full:
            for c in open_:
                given[c] = left * children[c][1] // total
            break
        for c in full:
            given[c] = children[c][0]
        open_ -= full
    return given


def test_mixing_equals_plain_budgets(spark, docs, nothing, corpus):
    mix = mixing.Mixture(weights=({"web": 50, "books": 30, "reference": 20}, {"en": 3, "de": 1, "unknown": 1}, {}), budget_per_mille=700, max_epochs=2)
    slim, plan = mixing.plan_mixture(docs, mix, Scratch(spark, "t"))
    leaves = {(r.domain, r.lang, r.source): r for r in plan.collect()}
    tokens = Counter({k: r.tokens for k, r in leaves.items()})
    assert sum(tokens.values()) == sum(len(brute.words(t)) if t else 0 for _, t, *_ in corpus)

    def share(path, budget):
        depth = len(path)
        if depth == 3:
            return {path: budget}
        names = sorted({k[depth] for k in tokens if k[:depth] == path})
        caps = {n: (2 * sum(v for k, v in tokens.items() if k[: depth + 1] == (*path, n)), mix.weights[depth].get(n, 1)) for n in names}
        out = {}
        for n, b in water(budget, caps).items():
            out |= share((*path, n), b)
        return out

    want = share((), sum(tokens.values()) * 700 // 1000)
    assert {k: r.share for k, r in leaves.items()} == want
    drawn = mixing.draw(slim, plan, mix).collect()
    got = Counter()
    for r in drawn:
        got[(r.domain, r.lang, r.source)] += r.tokens
    rows = defaultdict(list)
    for r in slim.withColumn("k0", mixing.order_key(mix, F.lit(0), F.col("id"))).withColumn("k1", mixing.order_key(mix, F.lit(1), F.col("id"))).collect():
        rows[(r.domain, r.lang, r.source)].append(r)
    for leaf, r in leaves.items():
        epochs = r.share // r.tokens if r.tokens else 0
        rest, upto = r.share - epochs * r.tokens, 0
        by = defaultdict(int)
        for x in rows[leaf]:
            by[x.k1 if epochs else x.k0] += x.tokens
        for k in sorted(by):
            if epochs == 2 or upto + by[k] > rest:
                break
            upto += by[k]
        assert got[leaf] == epochs * r.tokens + upto, leaf
    out = mixing.mix_documents(docs, mix)
    assert out.columns == docs.columns and out.count() == len(drawn)
    assert mixing.mix_documents(nothing, mix).count() == 0


def test_mixing_writes_leaves_in_few_files(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), F.col("id") % 80).alias("source"))
    many = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    scratch = Scratch(spark, "few")
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        _, plan = mixing.plan_mixture(docs, mixing.Mixture(), scratch)
        assert plan.count() == 80
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name in ("leaves", "shares", "plan"):  # not one for each partition that holds a leaf
        assert len(scratch.read(name).inputFiles()) <= spark.sparkContext.defaultParallelism, name


def test_mixing_counts_words(spark):
    texts = [None, "", " ", "\t\n\x0b\f\r ", "a", " a", "a ", "\n a\t\tb \r\n", "a\u00a0b \u2003 c", "\x1f\x85 \x00", "$1 \\ x", "日本 語 😀", "w " * 5000, "x" * 30000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", mixing.word_count(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: None if t is None else len(brute.words(t)) for i, t in enumerate(texts)}


# ---- 4
@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 60, 100)])
def test_near_duplicates_equal_brute_force(docs, corpus, k, num, den):
    out = jaccard.near_duplicates(docs, k, num, den).collect()
    want = [(d, *x) for (d, *_), x in zip(corpus, brute.jaccard_components([(d, t) for d, t, *_ in corpus], k, num, den))]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=key) == sorted(want, key=key)


def test_near_duplicates_of_nothing(nothing):
    assert jaccard.near_duplicates(nothing).count() == 0


def test_large_buckets_and_passed_over_segments(spark):
    """Small limits send every pair through hubs and both prefix joins; links stay the same."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(30)]
    rows = []
    for g in range(6):
        base = passage + [word() for _ in range(60)]
        for _ in range(7):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(30, len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((d, *x) for (d, _), x in zip(rows, brute.jaccard_components(rows, 3, 80, 100)))
    for small, withheld, local, common in ((16, 0, 2_000_000, 65_536), (2, 0, 2_000_000, 65_536), (2, 4, 2_000_000, 0), (2, 1000, 2_000_000, 65_536), (2, 1000, 500, 65_536), (3, 2, 1, 65_536)):
        limits = jaccard.Limits(small=small, withheld=withheld, local=local, common=common, per_hub=2)
        out = jaccard.near_duplicates(df, 3, 80, 100, limits=limits)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == want, limits


# ---- 6
def test_katz(spark, docs, nothing, corpus):
    for settings in (katz.Settings(), katz.Settings(local=25), katz.Settings(local=0)):
        out = katz.score_texts(docs, settings=settings).collect()
        train = [zlib.crc32(str(d).encode() if d is not None else b"") % 10 != 0 for d, *_ in corpus]
        want, n = brute.base_scores([(d, t) for d, t, *_ in corpus], train)
        assert {r.train_tokens for r in out} == {n}
        got = sorted((r.n_tokens, r.n_known, round(r.base_score, 4)) for r in out)
        assert got == sorted((a, b, round(c, 4)) for a, b, c in want)
        assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    assert katz.score_texts(nothing).count() == 0


def plain_discounts(counts):
    """Worth of counts 1 to 5: counts of counts on a line in logarithms, then taken down as larger counts keep theirs."""
    of = Counter(counts)
    x, y = zip(*((math.log(r), math.log(of[r])) for r in range(1, 7) if of[r]))
    mx, my = sum(x) / len(x), sum(y) / len(y)
    b = sum((i - mx) * (j - my) for i, j in zip(x, y)) / sum((i - mx) ** 2 for i in x) if len(x) > 1 else -2.0
    b = min(b, -1.05)
    floor = 6 ** (b + 1)
    return lambda c: c - 0.5 if c > 5 else c * ((1 + 1 / c) ** (b + 1) - floor) / (1 - floor)


@pytest.mark.parametrize("local", [65_536, 7, 0])
def test_katz_backs_off_and_adds_up(spark, local):
    """Scores equal a plain recursion; chances after every context add up to 1."""
    rng = random.Random(6)
    names = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(names, weights=[j * j for j in range(1, 61)], k=30))) for i in range(150)] + [(900, "w1 unseen w2"), (903, "never met before"), (906, "new york is new york")]
    # after "new" always comes "york", many times: other words must stay possible there
    rows += [(1000 + i, "new york") for i in range(30)] + [(i, "new w59") for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 10 == 0]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in katz.score_texts(df, settings=katz.Settings(local)).collect()}
    train = [t for d, t in rows if zlib.crc32(str(d).encode()) % 10 != 0]
    single = Counter(w for t in train for w in [*t.split(), "</s>"])
    total = sum(single.values())
    worth = plain_discounts(single.values())
    p1 = {w: worth(c) / total for w, c in single.items()}
    unseen = 1 - sum(p1.values())
    assert 0 < unseen < 0.2
    pairs, seen = Counter(), Counter()
    for t in train:
        h = "<s>"
        for w in [*t.split(), "</s>"]:
            pairs[h, w] += 1
            seen[h] += 1
            h = w
    worth = plain_discounts(pairs.values())
    assert all(worth(c) < worth(c + 1) < c + 1 for c in range(1, 9))
    chance, weight = {}, {}
    for h in seen:
        chance[h] = {w: worth(c) / seen[h] for (g, w), c in pairs.items() if g == h}
        weight[h] = (1 - sum(chance[h].values())) / (1 - sum(p1[w] for w in chance[h]))
        assert weight[h] > 0 and abs(sum(chance[h].get(w, weight[h] * p) for w, p in p1.items()) + weight[h] * unseen - 1) < 1e-9
    assert set(chance["new"]) == {"york"} and pairs["new", "york"] > 5
    for doc, t in rows:
        h, score = "<s>", 0.0
        for w in [*t.split(), "</s>"]:
            score += math.log10(chance.get(h, {}).get(w, weight.get(h, 1.0) * p1.get(w, unseen)))
            h = w
        assert abs(score - got[doc]) < 1e-6, doc


def test_katz_discounts_rise():
    for of in ({1: 100, 2: 40, 3: 5, 4: 60, 5: 1, 6: 9}, {1: 10}, {}, {2: 7, 6: 7}, {r: 10**r for r in range(1, 7)}):
        d = katz.discounts(of)
        worth = katz.discounted(np.arange(1, 12), d)
        assert (np.diff(worth) > 0).all() and (worth > 0).all() and (worth < np.arange(1, 12)).all()


# ---- 2
def labelled(spark, n=400):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = [rng.choice(["le", "la", "mo", "tu", "ra", "so"]) + rng.choice("abcdefg") for _ in range(40)]
        if toxic:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["foul", "vileness", "vilely", "rotten"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_learns_and_is_exact(spark, docs, nothing):
    rows, labels = labelled(spark)
    df = spark.createDataFrame([*rows, (None, "foul"), (5000, None), (5001, ""), (0, rows[0][1])], "doc_id long, text string").withColumn("score", F.lit("x"))
    lab = spark.createDataFrame([*labels, (None, 1), (7, None), (8, 1 if 8 % 4 == 0 else 0)], "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    out = toxicity.score_toxicity(df, model).select("row.doc_id", F.col("score"), "evidence_ids").collect()
    assert len(out) == len(rows) + 4
    truth = dict(labels)
    held = [r for r in out if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 50 and all((r.score >= 0.7) == bool(truth[r.doc_id]) for r in held)
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for r in out for i in r.evidence_ids)
    assert max(r.score for r in out if r.doc_id in (5000, 5001)) < 0.1
    vectors = [None] * len(model.index.ids)
    for number, (_, _, by) in enumerate(model.index.postings):
        for b, (at, x) in by.items():
            for i, v in zip(at, x):
                vectors[b * model.index.block + i] = (vectors[b * model.index.block + i] or {}) | {number: float(v)}
    for _, text in rows[:40]:
        v = model.index.vector(text)
        near, plain = model.index.nearest(v, 5), brute.cosine_neighbours(vectors, v, 5)
        assert [round(s, 9) for s, _ in near] == [round(s, 9) for s, _ in plain]
    assert toxicity.score_toxicity(nothing, model).count() == 0
    # ids may be texts, repeat, and texts may be very long or tie
    named = df.select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), "text").unionByName(spark.createDataFrame([("long", "foul rotten " + "la mo " * 200_000), *[("again", "vileness foul " * 3)] * 3], "doc_id string, text string"))
    marks = lab.select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), "toxic").unionByName(spark.createDataFrame([("again", 1), ("again", 0)], "doc_id string, toxic int"))
    own = toxicity.fit(named, marks)
    assert len(own.index.ids) <= own.settings.max_examples and sum(i == "again" for i in own.index.ids) <= 1
    scored = {r.doc_id: r for r in toxicity.score_toxicity(named, own).select("row.doc_id", "score", "evidence_ids").collect()}
    assert scored["long"].score >= 0.7 and all(isinstance(i, str) for i in scored["long"].evidence_ids) and scored["again"].score >= 0.7
    empty = toxicity.fit(df, lab.limit(0))
    assert {r["score"] for r in toxicity.score_toxicity(df, empty).select("score").collect()} == {0.0}


# ---- 5
def test_licences_equal_brute_force(spark, docs, nothing):
    body = " ".join(licences.TEMPLATES["ISC"])
    rows = [(1, "prose here\nReleased under the MIT License.\nmore"), (2, "Licensed under CC BY-NC 4.0"), (3, None), (4, ""), (5, "nothing of the kind under the License"), (6, f"intro\n\n{body.upper()}\n\nend"), (7, "licensed   under: the Apache license -- version 2.0!"), (None, "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licence", F.lit("x"))
    got = {r.doc_id: (r.licence, r.dice) for r in licences.scan(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "MIT", 2: "CC-BY-NC-4.0", 3: None, 4: None, 5: None, 6: "ISC", 7: "Apache-2.0", None: "MIT"}
    for d, t in rows:
        found = [(len(licences.bigrams(u) & licences.bigrams(x)), brute.dice(licences.bigrams(u), licences.bigrams(x))) for u in licences.units(t or "") for xs in licences.TEMPLATES.values() for x in xs if licences.telling(x) <= licences.bigrams(u)]
        assert got[d][1] == max((f for f in found if f[1] >= licences.THRESHOLD), default=(0, 0.0))[1]
    assert licences.scan(nothing).count() == 0 and licences.scan(docs).count() == docs.count()


def test_words_of_bytes():
    import pyarrow as pa

    texts = ["A b\tC", None, "", "é É", "x" * 200 + " " + "x" * 200, " lead"]
    seen = defaultdict(list)
    for lo, _, data, offsets in words.text_chunks(pa.array(texts), 8):
        h, r = words.word_hashes(data, offsets)
        for x, i in zip(h, r):
            seen[lo + i].append(int(x))
    assert [len(seen[i]) for i in range(6)] == [len(brute.words(t)) for t in texts]
    one = lambda t: int(words.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0][0])
    assert seen[0][0] == one("a") and seen[0][2] == one("c") and seen[3][0] != seen[3][1] and seen[4][0] == seen[4][1]


def test_katz_cells_come_back_whole():
    for x in (np.array([3, -1, 1 << 62, -(1 << 63)]), np.array([0.1, -2.5]), np.arange(7, dtype=np.int32), np.zeros(0, np.int64)):
        for starts in ([0], [0, len(x) // 2]):
            cells = katz._planes(np.array(starts), x)
            assert np.array_equal(np.concatenate([katz._numbers(c, x.dtype) for c in cells]), x)


def test_katz_over_all_words_and_pairs(spark):
    """By default nothing is merged or cut: every word is an entry, pairs seen once count; the cache changes nothing."""
    rng = random.Random(16)
    names = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(names, weights=[1 / (1 + j) for j in range(300)], k=30))) for i in range(120)] + [(900 + i, f"w1 unseen{i} w250 w2") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = [t for d, t in rows if zlib.crc32(str(d).encode()) % 10 != 0]
    single = Counter(w for t in train for w in [*t.split(), "</s>"])
    total, worth = sum(single.values()), plain_discounts(single.values())
    unseen = 1 - sum(worth(c) for c in single.values()) / total
    pairs, seen = Counter(), Counter()
    for t in train:
        for h, w in zip(["<s>", *t.split()], [*t.split(), "</s>"]):
            pairs[h, w] += 1
            seen[h] += 1
    alone = lambda w: worth(single[w]) / total if w in single else unseen
    of_pair = plain_discounts(pairs.values())
    weight = {}
    for h in seen:
        after = {w: c for (g, w), c in pairs.items() if g == h}
        weight[h] = (1 - sum(map(of_pair, after.values())) / seen[h]) / (1 - sum(alone(w) for w in after))
    want = {}
    for doc, t in rows:
        steps = zip(["<s>", *t.split()], [*t.split(), "</s>"])
        want[doc] = sum(math.log10(of_pair(pairs[h, w]) / seen[h] if (h, w) in pairs else weight.get(h, 1.0) * alone(w)) for h, w in steps)
    for settings in (None, katz.Settings(local=7)):
        got = {r.doc_id: r.score for r in katz.score_texts(df, settings=settings).collect()}
        assert {i: (got[i], want[i]) for i in want if abs(got[i] - want[i]) >= 1e-6} == {}, settings


def test_near_licences_are_told_apart(spark):
    """Families differ in few words; what the catalogue lacks is not another licence."""
    bsd2 = (licences.Path(licences.__file__).parent / "licence_texts" / "BSD-2-Clause.txt").read_text()
    affero = licences.known_templates()["GPL-3.0"][-1].replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE").replace("GNU General", "GNU Affero General").replace("29 June 2007", "19 November 2007", 1)
    texts = {
        "BSD-2-Clause": bsd2, "GPL-2.0": licences.TEMPLATES["GPL-2.0"][1], "LGPL-3.0": licences.TEMPLATES["LGPL-3.0"][0], "AGPL-3.0": licences.TEMPLATES["AGPL-3.0"][0], "LGPL-2.1": licences.TEMPLATES["LGPL-2.1"][0],
        "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "MPL-2.0": licences.TEMPLATES["MPL-2.0"][0], "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
        "CC0-1.0": licences.TEMPLATES["CC0-1.0"][1], "EPL-2.0": licences.TEMPLATES["EPL-2.0"][0], "BSD": licences.TEMPLATES["BSD"][0], "BSD-3-Clause": licences.known_templates()["BSD-3-Clause"][-1], "GPL-3.0": licences.known_templates()["GPL-3.0"][-1],
    }
    unknown = [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 4 of the License, or (at your option) any later version.",
        "This work is licensed under a Creative Commons Attribution 3.0 International License.", "Licensed under CC BY-SA 3.0.", "Licensed under the Apache License, Version 1.1.", "Released under the MPL License.",
    ]
    rows = [(n, t) for n, t in texts.items()] + [(f"{n}, inside", f"lorem ipsum dolor\n\n{t}\n\nsit amet " + "word " * 300) for n, t in texts.items()] + [(f"unknown {i}", t) for i, t in enumerate(unknown)] + [("affero", affero)]
    got = {r.doc_id: r.licence for r in licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for n in texts:
        assert (got[n], got[f"{n}, inside"]) == (n, n)
    assert got["affero"] == "AGPL-3.0"  # nine tenths of its words are those of the other text
    assert [got[f"unknown {i}"] for i in range(len(unknown))] == [None] * len(unknown)


def test_licences_anywhere_in_a_text(spark):
    """Whole texts, flattened or wrapped, and notices inside longer lines are found; every window is compared."""
    whole = {n: x[-1] for n, x in licences.known_templates().items() if n in ("MIT", "Apache-2.0", "GPL-3.0", "ISC", "BSD-3-Clause", "Unlicense")}
    prose = "ba de fi go lu me ni po ra su " * 20
    rows = [(i, f"{prose}{' '.join(t.split())} {prose}") for i, t in enumerate(whole.values())]
    wrapped = "x = 1\n# This program is free software: you can redistribute it\n# and/or modify it under the terms of the GNU General Public\n# License as published by the Free Software Foundation, either\n# version 3 of the License, or (at your option) any later version.\ny = 2\n"
    rows += [(50, prose + wrapped + prose), (51, f"{prose} Released under the MIT License. See the project page for details."), (52, prose), (53, licences.PARAGRAPHS["MIT"][1] + "\n\n" + prose)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(n in got[i].licences and got[i].dice > 0.999 for i, n in enumerate(whole))
    assert (got[50].licence, got[51].licence, got[52].licence, got[53].licence) == ("GPL-3.0", "MIT", None, "MIT")
    m = licences.Matcher({"a": ["one two three one two four"]}, 0.5)
    rng = random.Random(17)
    for _ in range(200):
        words = rng.choices(["one", "two", "three", "four"], k=rng.randint(0, 15))
        parts = [words[i : i + 6] for i in range(max(1, len(words) - 5))]
        both = [(len(licences.bigrams(" ".join(p)) & m.sets[0][1]), brute.dice(licences.bigrams(" ".join(p)), m.sets[0][1])) for p in [*parts, words]]
        best = max((x for x in both if x[1] >= 0.5), default=(0, 0.0))[1]
        assert m.text(" ".join(words)) == ([(best, "a")] if best >= 0.5 else [])


def test_katz_part_holds_its_pairs_once():
    """A part's pairs are counted in little more than the memory that they take themselves."""
    import tracemalloc

    from tidemark.llm import katz

    rng = np.random.default_rng(3)
    n, each = 400_000, 20_000
    blocks = lambda: [(t, t % 3 > 0, np.sort(rng.integers(2, 300, each)), rng.integers(2, 5000, each), np.ones(each, np.int32), rng.integers(0, 50, each).astype(np.int32)) for t in range(n // each)]
    tracemalloc.start()
    try:
        own = blocks()
        held = tracemalloc.get_traced_memory()[0]
        parts = katz._count_part(own, np.full(5000, 1e-4))
        del own
        kinds = [kind for kind, _, _ in parts]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert kinds[0] == katz.COUNTS and katz.SEEN in kinds and held >= 20 * n
    assert peak < 145 * n


def rows_of_joins(df):
    """(condition, rows) of every join that the frame ran."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Join" in name:
            out.append((node.simpleString(100), node.metrics().get("numOutputRows").get().value()))
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else []
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_sets_without_links_need_no_look_at_each_bucket(spark):
    from tidemark.llm import jaccard
    from tidemark.llm.shared import Scratch

    rng = random.Random(4)
    large = [(i, rng.randint(-1, 30), rng.sample(range(60), rng.randint(3, 25))) for i in range(300)]
    group = {i: i - i % 5 for i in range(100)}  # the others are alone
    buckets = {}
    for i, _, sigs in large:
        for s in sigs:
            buckets.setdefault(s, Counter())[group.get(i, i)] += 1
    main = {s: max((n, c) for c, n in b.items())[1] for s, b in buckets.items()}
    cost = {i: sum(1 + (s & 1) for s in sigs if main[s] != group.get(i, i)) for i, _, sigs in large}
    want = {i for i, slack, _ in large if slack >= 0 and 2 * cost[i] > slack}
    df = spark.createDataFrame(large, "cls long, slack long, sigs array<long>")
    joined = spark.createDataFrame(list(group.items()), "node long, component long")
    out = jaccard._asking(df, joined, Scratch(spark, "t"))
    assert {r.cls for r in out.collect()} == want and 0 < len(want) < 300
    of_linked = sum(len(sigs) for i, _, sigs in large if i in group)
    assert sum(n for how, n in rows_of_joins(out) if "sig" in how) <= of_linked
