import corpus_pipeline as cp
import pyarrow as pa

from textloom.llm import decontaminate as dc
from textloom.llm import simhash_forest as sf
from textloom.llm.common import materialize


def test_each_stage_against_its_own_input(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in cp.STAGES:
        before, docs = docs, materialize(stage(spark, docs, medium), "stage")
        steps[name] = (before.toPandas(), docs.toPandas())
        if name != "packing":
            assert docs.columns == columns
    before, after = steps["quality rules"]
    labels = spark.read.parquet(f"{medium}/labels.parquet").toPandas()
    clean = set(labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id)
    assert len(clean & set(after.doc_id)) > 0.97 * len(clean)
    bad = set(labels[labels.quality == 0].doc_id)
    assert len(bad & set(after.doc_id)) < 0.5 * len(bad)
    before, after = steps["line dedup"]
    assert set(after.doc_id) <= set(before.doc_id) and (after.n_chars == after.text.str.len()).all()
    before, after = steps["near duplicates"]
    sig, some = sf.signatures(pa.array(after.text.tolist(), pa.large_string()))
    assert some.all() and sum(bool(sf.near(sig[i], sig[j])) for i in range(len(sig)) for j in range(i)) <= 0.1 * (len(before) - len(after))
    before, after = steps["decontamination"]
    items = [(r["item_id"], dc.normal(r["text"])) for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()]
    holds = {d for d, t in zip(before.doc_id, before.text) if any(x in dc.normal(t) for _, x in items)}
    assert holds and not holds & set(after.doc_id) and len(after) >= len(before) - len(holds) - 2
    before, after = steps["packing"]
    assert set(after.doc_id) == set(before.doc_id)
    whole = cp.run(spark, medium).toPandas()
    assert sorted(map(tuple, whole.values.tolist())) == sorted(map(tuple, after.values.tolist()))


def test_empty_documents_table(spark, medium, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{medium}/{t}.parquet")
        (df.limit(0) if t == "documents" else df).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_edge_rows_of_every_stage(spark, medium, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{medium}/documents.parquet")
    item = spark.read.parquet(f"{medium}/benchmark.parquet").first()["text"]
    clean = [" ".join(f"{w}{k * k + 7}" for k in range(20)) for w in ("river", "bridge", "garden", "window", "market", "harbour")]
    rows = [(None, clean[0], "en", "s", 1), (None, clean[1], None, None, None), (1, None, "en", "s", 1), (2, "", "en", "s", 1), (3, " \n\t", "en", "s", 1), (4, clean[2], "en", "s", 1), (4, clean[2], "en", "s", 1), (5, clean[3] + "\n" + item, "en", "s", 1), (6, clean[4] + " word" * 300_000, "en", "s", 1), (7, clean[5], "en", "s", 1), (8, clean[5] + " again", "en", "s", 1)]
    rows = spark.createDataFrame(rows, docs.schema).select("*", *[F.lit(7).alias(c) for c in ("did", "th", "gone", "mask", "rest", "keep", "DOC")])
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{medium}/{t}.parquet").limit(0 if t == "labels" else 1000).write.parquet(f"{tmp_path}/{t}.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for _, stage in cp.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == columns
        seen.append(sorted(((r["doc_id"], r["text"][:20]) for r in docs.collect()), key=repr))
    ids = lambda k: [i for i, _ in seen[k]]
    # no labels: whatever has a word stays; then one of the rows alike and of the near copies; then not the one with the benchmark's item
    assert ids(0) == ids(1) == [4, 4, 5, 6, 7, 8, None, None] and ids(2) == [4, 5, 6, 7, None, None] and ids(3) == [4, 6, 7, None, None]
    packed = cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {4, 6, 7, None} and sum(r["n_tokens"] for r in packed if r["doc_id"] == 6) > 300_000
    # each stage on the raw rows, and on none
    raw = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES:
        assert stage(spark, raw, str(tmp_path)).count() > 0 and stage(spark, raw.limit(0), str(tmp_path)).count() == 0


def test_empty_benchmark(spark, medium, tmp_path):
    spark.read.parquet(f"{medium}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    assert cp.STAGES[3][1](spark, docs, str(tmp_path)).count() == docs.count()
