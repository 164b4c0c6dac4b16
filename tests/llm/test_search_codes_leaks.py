"""Operators 11 to 13 against plain versions, with awkward rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import blockmax, decontamination, vector_codes, words

from .brute import lower_ascii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(lower_ascii(text or ""))


# ---- 11
def plain_leaks(text, items, n):
    own = plain_words(text)
    hit, found = [False] * len(own), set()
    for item, t in items:
        w = plain_words(t)
        if item is None or not w:
            continue
        k = min(n, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i in range(len(own) - k + 1):
            if tuple(own[i : i + k]) in windows:
                found.add(str(item))
                hit[i : i + k] = [True] * k
    return len(own), sum(hit), sorted(found)


def leak_items(corpus):
    long = corpus[5][1].split()
    return [
        (1, " ".join(long[3:25])), (10, " ".join(long[3:14]).upper().replace(" ", " -- ")), (2, "one two"), (3, ""), (4, None), (None, " ".join(long[:12])), (7, "é é"),
        (8, " ".join(corpus[70][1].split()[-4:])), (8, " ".join(corpus[8][1].split()[10:21])), (9, "never seen words that no document holds at all anywhere here"),
    ]


@pytest.fixture(scope="module")
def items(spark, corpus):
    return spark.createDataFrame(leak_items(corpus), "item_id long, text string").withColumn("n", F.lit(1))


@pytest.mark.parametrize("bound", [decontamination.BROADCAST_BYTES, 0])
def test_leaks_equal_brute_force(spark, docs, corpus, items, bound, tmp_path):
    source = docs
    if not bound:  # the way for sets that are too large to broadcast, over files and not
        docs.write.parquet(f"{tmp_path}/docs.parquet")
        source = spark.read.parquet(f"{tmp_path}/docs.parquet")
    out = decontamination.scan(source, items, broadcast_bytes=bound).select("row.doc_id", "row.text", "row.rank", "n_words", "n_hit", "items", "spans", "clean").collect()
    assert len(out) == len(corpus) and {r["rank"] for r in out} == {"x-rank"}
    want = Counter((d, *map(str, plain_leaks(t, leak_items(corpus), 10))) for d, t, *_ in corpus)
    assert Counter((r.doc_id, str(r.n_words), str(r.n_hit), str(r["items"])) for r in out) == want
    assert sum(r.n_hit > 0 for r in out) > 4
    for r in out:
        if r.n_hit:
            parts, done, raw = [], 0, r.text.encode()
            assert sum(len(plain_words(raw[s.start : s.end].decode())) for s in r.spans) == r.n_hit
            for s in r.spans:
                parts, done = [*parts, raw[done : s.start]], s.end
            assert r.clean == b"".join([*parts, raw[done:]]).decode()
        else:
            assert r.clean is None and not r.spans


def test_leaks_go_as_spans_or_documents(spark, docs, corpus, items, nothing):
    kept = decontamination.decontaminate(docs, items, "documents")
    assert kept.columns == docs.columns and kept.count() == sum(not plain_leaks(t, leak_items(corpus), 10)[1] for _, t, *_ in corpus)
    clean = decontamination.decontaminate(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(corpus)
    assert clean.filter("text IS NULL").count() == docs.filter("text IS NULL").count()
    assert decontamination.scan(nothing, items).count() == 0 and decontamination.scan(docs, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    with pytest.raises(ValueError):
        decontamination.decontaminate(docs, items, "lines")


def test_leaks_are_verified_word_for_word(spark, docs, corpus, items, monkeypatch):
    """With all hashes the same, only the words decide."""
    w = lambda t: words.split_words(np.frombuffer(t, np.uint8), np.array([0, len(t)]), words.NOT_ALNUM)
    own = w(b"ab c d")
    same = decontamination.WindowSet(np.zeros(3, np.int64), [b"abc", b"abc", b"abd"], [np.array(x, np.int32).tobytes() for x in ([2, 1], [1, 2], [2, 1])], [["1"], ["2"], ["3"]])
    same.bits[:] = True
    monkeypatch.setattr(decontamination, "window_hashes", lambda w, k: (np.arange(len(w.hashes) - k + 1), np.zeros(len(w.hashes) - k + 1, np.uint64)))
    at, window = same.find(own)
    assert (at.tolist(), [same.items[same.items_at[i]] for i in window]) == ([0], [0])


# ---- 12
def plain_codes(vectors, parts, entries, rounds):
    """vectors: (id, list), in the order of their ids."""
    width = max(1, -(-max(len(v) for _, v in vectors) // parts))
    x = [[math.floor(256 * c) for c in v] + [0] * (parts * width - len(v)) for _, v in vectors]
    x = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in x]
    books = [[list(v[p]) for v in x[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (gap(v[p], books[p][e]), e))
    for _ in range(rounds):
        own = [[near(v, p) for p in range(parts)] for v in x]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, o in zip(x, own) if o[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    own = [[near(v, p) for p in range(parts)] for v in x]
    return ["".join(f"{e:02x}" for e in o) for o in own], [sum(gap(v[p], books[p][o[p]]) for p in range(parts)) for v, o in zip(x, own)], books


@pytest.mark.parametrize("salts,n", [(1, 120), (5, 120), (3, 6)])
def test_codes_equal_plain_lloyd(spark, salts, n):
    rng = np.random.default_rng(12)
    x = rng.normal(0, 0.3, (n, 8)).astype(np.float32)
    x[n // 3 : n // 2] = x[0]  # a hot group of equal vectors
    rows = [(int(i), [float(c) for c in x[i]], int(i % 3)) for i in range(n)]
    odd = [(1000, None, 1), (1001, [0.1, None] * 4, 1), (1002, [float("nan")] * 8, None), (1003, [float("inf")] * 8, 2)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(0) for c in ("rid", "position", "entry", "part", "code", "x", "id")}).repartition(4)
    made = vector_codes.compress(df, 4, 16, 2, salts=salts)
    got = {r["row"].vec_id: (r.code, r.error) for r in made.rows.collect()}
    codes, errors, books = plain_codes([(i, v) for i, v, _ in rows], 4, 16, 2)
    assert got == {i: (c, e) for (i, *_), c, e in zip(rows, codes, errors)}
    assert made.codebooks.tolist() == books and made.digest() == hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    assert len(made.migrated) == 2 and made.migrated[0] < 4 * n  # who keeps an entry does not move
    back = vector_codes.reconstruct(made.rows, made.codebooks).select("row.vec_id", "error", "row.embedding", "decoded").collect()
    for r in back:
        assert sum((math.floor(256 * a) - 256 * b) ** 2 for a, b in zip(r.embedding, r.decoded)) == r.error


def test_codes_of_odd_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    uneven = [(1, [0.5, 0.25, 1.0]), (1, [0.5]), (None, [1.0]), (2, []), (3, [1e300, -1e300])]
    made = vector_codes.compress(spark.createDataFrame(uneven, schema), 2, 3, 1)
    assert made.rows.count() == 5 and made.codebooks.shape == (2, 3, 2) and np.abs(made.codebooks).max() <= vector_codes.LARGEST
    empty = vector_codes.compress(spark.createDataFrame([(1, None)], schema), 4)
    assert empty.rows.count() == 0 and empty.rows.columns == ["row", "code", "error"]
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame(uneven, schema), entries=300)


def test_labels_share_an_error(spark, tmp_path):
    rows = [(i, [i / 7.0, -i / 3.0] * 16, None if i % 4 == 0 else i % 3) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = vector_codes.op12_vector_codes(spark, str(tmp_path)).collect()
    label = {i: g for i, _, g in rows}
    total = Counter()
    for r in out:
        total[label[r.vec_id]] += r.error
    assert len(out) == 90 and all(r.label_error == total[label[r.vec_id]] for r in out)


# ---- 13
def plain_ranks(docs, items, k):
    texts = [(d, Counter(plain_words(t))) for d, t in docs]
    texts = [(d, c) for d, c in texts if c]
    n, total = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(w for _, c in texts for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(plain_words(t))
    out = {}
    for i, q in asked.items():
        scored = []
        for d, c in texts:
            m = 75 + (25 * sum(c.values()) * n) // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m)) for w, r in q.items() if w in c)
            if s > 0:
                scored.append((s, d))
        out[i] = sorted(scored, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
    return {i: v for i, v in out.items() if v}


@pytest.mark.parametrize("shard_rows,block_terms,k", [(8192, 16384, 20), (7, 30, 3), (1, 5, 1)])
def test_ranks_equal_brute_force(spark, docs, corpus, items, shard_rows, block_terms, k):
    extra = [(20, " ".join(corpus[i][1].split()[0] for i in range(40))), (21, "ba de fi go lu me ni po"), (22, "ba ba ba"), (None, "de fi"), (23, "?!")]
    asked = leak_items(corpus) + extra
    index = blockmax.build_index(docs, shard_rows=shard_rows)
    got = {}
    for r in blockmax.search(index, blockmax.query_terms(spark.createDataFrame(asked, "item_id long, text string")), k, block_terms).orderBy("item", "rank").collect():
        got.setdefault(r["item"], []).append((r.score, r.id))
        assert r["rank"] == len(got[r["item"]])
    want = plain_ranks([(d, t) for d, t, *_ in corpus], asked, k)
    assert set(got) == set(want)
    for i in want:
        assert got[i] == want[i]


def test_search_of_nothing(spark, docs, nothing, items):
    assert blockmax.search(blockmax.build_index(nothing), blockmax.query_terms(items)).count() == 0
    assert blockmax.search(blockmax.build_index(docs), blockmax.query_terms(items.limit(0))).count() == 0


def test_blocks_are_rejected_before_they_are_decompressed(monkeypatch):
    """A frequent term is only probed where a rare one has been found, in the blocks of those documents."""
    rng = np.random.default_rng(1)
    docs = 128 * 40
    rare = np.sort(rng.choice(docs, 25, replace=False))
    terms = np.r_[np.zeros(docs, np.int64), np.ones(25, np.int64)]
    at = np.r_[np.arange(docs), rare]
    n = np.bincount(at, minlength=docs)
    out = blockmax.shard_postings(terms, at, n)
    m = blockmax.length_norm(n, docs, int(n.sum()))
    norms = lambda x: blockmax.length_norm(x, docs, int(n.sum()))
    lists = [blockmax.Postings(*(out[c][i].as_py() for c in ("df", "last", "sizes", "bounds", "data")), m, norms) for i in range(2)]
    for one, held in zip(lists, (np.arange(docs), rare)):
        assert one.all()[0].tolist() == held.tolist()
        one.whole = None
        assert (one.most >= np.maximum.reduceat(one.all()[1], np.arange(0, len(held), 128))).all()
        one.whole = None
    read = []
    plain = blockmax.Postings.decode
    monkeypatch.setattr(blockmax.Postings, "decode", lambda self, blocks: read.append(len(blocks)) or plain(self, blocks))
    top, score = blockmax.best(lists, np.array([1, 5000]), np.array([one.most.max() for one in lists]), docs, 3)
    assert set(top) <= set(rare) and sum(read) < 1 + 25 + 1 and read[0] == 1
    assert (np.diff(score) <= 0).all()


def test_varints_round_trip():
    values = np.r_[0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**31 - 1, np.random.default_rng(0).integers(0, 2**31, 500)]
    data, size = blockmax.varints(values)
    assert blockmax.from_varints(data).tolist() == values.tolist() and len(data) == size.sum()
    assert blockmax.from_varints(np.zeros(0, np.uint8)).tolist() == []


# ---- 10
def test_inner_products_of_odd_vectors(spark):
    """Repeated ids, unequal lengths, ties and components whose products pass 2**53."""
    from tidemark.llm import maxscore

    rng = np.random.default_rng(3)
    for scale in (1.0, 3e6):
        rows = [(i, [float(x) for x in np.round(rng.normal(size=int(rng.integers(1, 6))) * scale, 3)]) for i in range(130)] + [(20, [1.0 * scale, 2.0]), (40, [0.0]), (None, [1.0])]
        rows += [(200 + i, [scale, scale]) for i in range(5)]  # ties
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None]
        got = {}
        for r in maxscore.top_k(df, 7, 20, shard=31, block=2).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        asked = {i for i, _ in whole if i % 20 == 0}
        assert set(got) == asked
        for q in asked - {20}:
            own = next(v for i, v in whole if i == q)
            want = sorted(((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q))[:7]
            assert [(i, s) for _, i, s in sorted(got[q])] == [(i, -s) for s, i in want]
