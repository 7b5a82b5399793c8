import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import langid
from engram.llm.queries import QUERIES
from engram.llm.workspace import bounded_sample, sample_threshold


def plain(pages, langs, models):
    """The same fusion, page by page."""
    rows = []
    for i, url, html in pages:
        host, domain, suffix, path = langid.address(url or "")
        m = langid._LANG.search(html or "")
        at = langid.trigrams(langid.visible(html or ""))
        ll = models[at].astype(float).sum(axis=0) * langid.EVIDENCE / (langid.EVIDENCE + len(at))
        ll -= ll.max()
        code = lambda c: None if c is None else c if c in langs else "other"
        rows.append((i, host, domain, suffix, code(path), code(m[1].lower() if m else None), ll, np.exp(ll) / np.exp(ll).sum()))
    sums = [defaultdict(lambda: np.zeros(len(langs))) for _ in range(6)]
    counts = [defaultdict(int) for _ in range(6)]
    for r in rows:
        for c in range(1, 6):
            sums[c][r[c]] += r[7]
            counts[c][r[c]] += 1
    mass = sum(r[7] for r in rows)
    out = {}
    for r in rows:
        prior = (mass + 1) / (len(rows) + len(langs))
        for c in (2, 1):
            if r[c] is not None:
                prior = (np.maximum(sums[c][r[c]] - r[7], 0) + langid.PRIOR_WEIGHT * prior) / (counts[c][r[c]] - 1 + langid.PRIOR_WEIGHT)
        z = r[6] + np.log(prior)
        if r[3] is not None:
            z += np.log((sums[3][r[3]] + langid.SMOOTH) / (mass + 2 * langid.SMOOTH))
        for c in (4, 5):
            if r[c] is not None:
                whole = sum(v for k, v in sums[c].items() if k is not None)
                z += np.log((sums[c][r[c]] + langid.SMOOTH + langid.HONEST * (np.array(langs) == r[c])) / (whole + langid.SMOOTH * (len(langs) + 1) + langid.HONEST))
        out[r[0]] = (langs[int(z.argmax())], 1 / np.exp(z - z.max()).sum())
    return out


def test_query_against_page_by_page_fusion(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    langs, models = langid.text_models(docs)
    pages = [tuple(r) for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html").collect()]
    expected = plain(pages, langs, models)
    got = {r.page_id: r for r in QUERIES["op3_language_id"](spark, d).collect()}
    assert set(got) == set(expected)
    for i, (lang, p) in expected.items():
        assert got[i].lang == lang and math.isclose(got[i].confidence, p, rel_tol=1e-6)
    assert sum(r.lang == r.declared for r in got.values()) >= 0.97 * len(got)


def test_models_tell_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars >= 100")
    langs, models = langid.text_models(docs.filter("doc_id % 3 <> 0"))
    rest = docs.filter("doc_id % 3 = 0").collect()
    right = sum(langs[int(models[langid.trigrams(r.text)].sum(axis=0).argmax())] == r.lang for r in rest)
    assert right >= 0.97 * len(rest)


def test_odd_pages(spark):
    docs = spark.createDataFrame([(1, "the and of with that", "en"), (2, "der die und nicht ist", "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string")
    pages = [(1, None, None), (2, "", ""), (3, "http://a.de/de/", "<html lang='de'><script>the the the"), (None, "x://", "<" * 5000), (5, "http://a.de/", "the and " * 50000), (5, "http://a.de/", "und nicht")]
    df = spark.createDataFrame(pages, "id long, url string, html string")
    rows = langid.fuse(spark, df, docs).collect()
    got = {r.id: r for r in rows if r.id != 5}
    assert len(rows) == 6 and got[3].lang == "de" and {r.lang for r in rows if r.id == 5} == {"en", "de"}
    assert all(0 < r.confidence <= 1 for r in rows)
    assert langid.fuse(spark, df.limit(0), docs).count() == 0
    clash = df.withColumn("lang", F.lit("xx")).withColumn("host", F.lit(1)).withColumn("p", F.lit(1))
    assert sorted(map(str, langid.fuse(spark, clash, docs.withColumn("place", F.lit(1))).collect())) == sorted(map(str, rows))
    nothing = langid.fuse(spark, df, docs.limit(0)).collect()
    assert len(nothing) == 6 and all(r.lang is None for r in nothing)


def test_samples_of_very_large_tables(spark):
    for n in (1, 4000, 10**6, 10**11, 10**15):
        share = sample_threshold(n, 4000) / 2**62
        assert share == min(1, 4000 / n) or abs(share * n / 4000 - 1) < 1e-2
    rows = spark.range(100_000).withColumnRenamed("id", "doc_id")
    assert 3400 < bounded_sample(rows, 4000, 9, "doc_id").count() < 4600 and bounded_sample(rows.limit(50), 50, 9, "doc_id").count() == 50
    with pytest.raises(ValueError):
        bounded_sample(rows, 0, 9, "doc_id")


def test_visible_text():
    assert langid.visible("<p>a<b>b</b> &amp; <STYLE>x</style>c<script>d</p>").split() == ["a", "b", "&", "c"]
    assert langid.address("https://User.Example.co:80/en/x?y") == ("user.example.co", "example.co", "co", "en")
    assert langid.address("nonsense") == (None, None, None, None)
