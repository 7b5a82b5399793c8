import corpus_pipeline as pipeline
from engram.llm import quality_rules
from tests.llm.test_decontam_packing import check_packing, contaminated
from tests.llm.test_minhash import brute
from tests.llm.test_quality_pii import base, counts


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    before = docs
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    good = pipeline.quality(spark, docs, sf_dir).cache()
    kept, all_ = texts(good), texts(before)
    rules = quality_rules.fit(spark, quality_rules.statistics(docs.select("doc_id", "text")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert all(kept[i] == all_[i] for i in kept)
    for i, t in all_.items():
        n, *_, repeated = counts(t)
        if n < 50 or 100 * repeated > 50 * n:
            assert i not in kept
    assert rules == [] or sum(i in kept for i, q in labels.items() if q == 0) < sum(q == 0 for q in labels.values())

    single = pipeline.near_dedup(spark, good, sf_dir).cache()
    assert set(texts(single)) == {i for i, (_, c, k) in brute(kept, 5, 80).items() if k}

    clean = pipeline.decontaminate(spark, single, sf_dir).cache()
    items = [r.text.lower().split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items = {k: x for k, x in enumerate(items)}
    dirty = {d for d, _ in contaminated(texts(single), items)}
    assert set(texts(clean)) == set(texts(single)) - dirty

    private = pipeline.redact(spark, clean, sf_dir).cache()
    assert private.columns == docs.columns
    for r in private.collect():
        assert not base(r.text) and r.n_chars == len(r.text)
        if not base(all_[r.doc_id]) and "token" not in all_[r.doc_id]:
            assert r.text == all_[r.doc_id]

    check_packing(texts(private), pipeline.pack(spark, private, sf_dir).collect())


def test_one_row_of_each_group_stays(spark, sf_dir):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(4, text, "a", "s", 1), (4, text, "a", "s", 1), (4, text + " end", "a", "s", 1), (7, text, "a", "s", 1), (None, text, "a", "s", 1), (9, "alone here", None, None, None), (9, "alone here", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.near_dedup(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(4, text), (9, "alone here"), (None, text)], key=str)


def test_run(spark, sf_dir):
    rows = pipeline.run(spark, sf_dir).collect()
    assert rows and sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns
