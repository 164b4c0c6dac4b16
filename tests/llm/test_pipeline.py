import re

import corpus_pipeline
import pyarrow as pa
import __spark_entry__ as entry
from tidemark.llm.shared import Scratch

from . import brute
from .test_corpus_operators import labelled


def test_stages_take_effect(spark, docs, tmp_path):
    rows, labels = labelled(spark, 300)
    extra = spark.createDataFrame([(i + 10_000, t, "en", "src1") for i, t in rows], "doc_id long, text string, lang string, source string")
    own = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(extra, allowMissingColumns=True)
    own.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i + 10_000, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, scratch = spark.read.parquet(f"{tmp_path}/documents.parquet"), Scratch(spark, "t")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = scratch.table(stage(spark, kept, str(tmp_path)), name)
        seen[name] = kept.collect()
        if name != "packing":
            assert kept.columns == before.columns
    foul = {i + 10_000 for i, y in labels if y}
    assert not foul & {r.doc_id for r in seen["toxicity"]}
    assert len(seen["toxicity"]) == own.count() - len(foul)
    texts = [brute.lower_ascii(r.text) for r in seen["exact_dedup"]]
    assert len(texts) == len(set(texts)) == len({brute.lower_ascii(r.text) for r in seen["toxicity"]})
    groups = {c for _, c in brute.jaccard_components([(r.doc_id, r.text) for r in seen["exact_dedup"]], 5, 80, 100)}
    assert {r.doc_id for r in seen["near_duplicates"]} == groups
    assert {r.doc_id for r in seen["mixing"]} <= groups
    tokens = lambda rs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rs)
    assert 0.6 * tokens(seen["near_duplicates"]) < tokens(seen["mixing"]) <= 0.9 * tokens(seen["near_duplicates"])
    assert {r.doc_id for r in seen["packing"]} == {r.doc_id for r in seen["mixing"]}
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()), key=str) == sorted(((r.doc_id, r.start, r.length, r.ids_crc32) for r in seen["packing"]), key=str)


def test_all_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_near_copies_are_dropped_by_row(spark, tmp_path):
    """Ids that repeat or are null neither take clean rows along nor keep copies."""
    words = [f"w{i}" for i in range(120)]
    base, other = " ".join(words), " ".join(f"v{i}" for i in range(60))
    near = lambda i: " ".join([*words[:i], "changed", *words[i + 1 :]])
    rows = [(3, base), (7, near(0)), (7, other), (3, near(119)), (None, near(1)), (None, "clean text without an id"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/d.parquet")
    for docs in (spark.read.parquet(f"{tmp_path}/d.parquet"), df):
        out = corpus_pipeline.drop_near_copies(spark, docs, "")
        kept = [tuple(r) for r in out.collect()]
        assert out.columns == ["doc_id", "text"] and len(kept) == 4
        assert sum(d == 3 for d, _ in kept) == 1 and {(7, other), (None, "clean text without an id"), (9, None)} < set(kept)


def test_rows_go_to_workers_in_small_batches(spark, tmp_path, monkeypatch):
    """Whole rows of an input partition are not one batch, and carry their text once."""
    from tidemark.llm import shared

    rows, labels = labelled(spark, 200)
    spark.createDataFrame([(i, f"{t} " + "z" * 2000) for i, t in rows], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/d.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], ["n"])

    counted = lambda df: df.coalesce(1).mapInArrow(sizes, "n long")
    before = spark.conf.get(shared.BATCH_BYTES)
    monkeypatch.setattr(shared, "SMALL_BATCH", 16_384)
    monkeypatch.setattr(corpus_pipeline, "SMALL_BATCH", 16_384)
    try:
        got = [r.n for r in shared.Scratch(spark, "t", small=True).table(counted(docs), "n").collect()]
        assert sum(got) == docs.count() and max(got) <= 10 and spark.conf.get(shared.BATCH_BYTES) == before
        out = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
        got = [r.n for r in counted(out).collect()]
        assert sum(got) == out.count() and max(got) <= 10
        plan = out._jdf.queryExecution().analyzed().toString()
        assert "score(row#" in plan and "score(row#" + plan.split("score(row#")[1].split(")")[0] + ")" in plan and "text" not in plan.split("score(row#")[1].split(")")[0]
    finally:
        spark.conf.set(shared.BATCH_BYTES, before)


def test_workers_give_back_what_they_freed(spark, monkeypatch):
    """After each batch and at the end, not only when a worker ends."""
    from tidemark.llm import shared

    pss = lambda: sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon:")) >> 10

    def work(batches):
        for batch in batches:
            held = [bytes(20_000) for _ in range(8000)]  # 160 MB in small pieces
            pin = bytes(20_000)
            del held
            yield pa.record_batch([pa.array([len(pin)])], ["n"])

    before = pss()
    batch = pa.record_batch([pa.array([1])], ["n"])
    assert sum(b.num_rows for b in shared.lean(work)(iter([batch] * 3))) == 3 and pss() < before + 80
    calls = []
    monkeypatch.setattr(shared, "give_back", lambda: calls.append(1))
    list(shared.lean(work)(iter([batch] * 3)))
    assert len(calls) == 4


def test_tables_of_the_driver_need_no_other_workers(spark, tmp_path, monkeypatch):
    """Workers of createDataFrame over rows would stay beside those of mapInArrow, in every executor."""
    from pyspark.sql import DataFrameWriter

    made, write = [], DataFrameWriter.parquet

    def seen(self, path, *args, **kw):
        made.append((path, self._df._jdf.queryExecution().toRdd().toDebugString()))
        return write(self, path, *args, **kw)

    texts = ["one two three", "one two three", "", None, "four"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/d.parquet")
    docs = spark.read.parquet(f"{tmp_path}/d.parquet")
    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    assert corpus_pipeline.drop_copies(spark, docs, "").count() == 3
    assert corpus_pipeline.pack_sequences(spark, docs, "").count() == 5
    tables = [p for p, _ in made if p.endswith(("batch=-1", "/places"))]
    assert len(tables) == 2 and not [p for p, lineage in made if "PythonRDD" in lineage and p in tables]
