"""Language identification by Bayesian evidence fusion.

Four pieces of evidence meet in one posterior: the likelihood of the visible text under hashed byte-trigram models, the language
that the markup declares, the language-like parts of the address (path code and top-level suffix), and a prior of the host.
The models of markup and address, P(value | language), and the priors are grouped sums of the text model's soft verdicts over
all pages; host priors are smoothed towards their domain's, and those towards the whole, each page left out of its own prior.

The text models come from labelled documents, about ``max_rows`` of them, chosen by hash of the id.  Long texts count as
EVIDENCE trigrams at most, as neighbouring trigrams say much the same.

Null pages, markup and addresses are empty and say nothing; without labelled documents every page's language is null.
Repeated and null ids get a row each time; columns besides id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.workspace import Workspace, attach, bounded_sample

TABLE_BITS, EVIDENCE, SMOOTH, PRIOR_WEIGHT = 16, 100.0, 0.5, 8.0
SLICE = 1 << 14
#: What a code is believed to say of its own language before any page is seen, in pages.
HONEST = 5.0
_OPEN = re.compile(r"(?i)<(script|style)\b")
_CLOSE = {k: re.compile(rf"(?i)</{k}\s*>") for k in ("script", "style")}
_TAG = re.compile(r"<[^<>]*>")
_LANG = re.compile(r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b")
_HOST = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://([^/?#:@]+)")
_PATH = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+/([a-z]{2,3})(?:[/?#]|$)")


def visible(markup: str) -> str:
    """Text outside tags, scripts and styles; an unclosed script or style runs to the end."""
    out, at = [], 0
    while m := _OPEN.search(markup, at):
        out.append(markup[at : m.start()])
        end = _CLOSE[m[1].lower()].search(markup, m.end())
        at = end.end() if end else len(markup)
    out.append(markup[at:])
    return entities.unescape(_TAG.sub(" ", " ".join(out)))


def address(url: str) -> tuple[str | None, str | None, str | None, str | None]:
    """Host, domain (last two labels), top-level suffix and path code of an address."""
    m, p = _HOST.match(url), _PATH.match(url)
    host = m[1].lower().rstrip(".") if m else None
    labels = host.split(".") if host else []
    return host, ".".join(labels[-2:]) or None, labels[-1] if labels else None, p[1].lower() if p else None


def trigrams(text: str) -> np.ndarray:
    """Table places of the byte trigrams of the lower-cased text, runs of other than letters as one space."""
    b = np.frombuffer(re.sub(r"[\W\d_]+", " ", f" {text.lower()} ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    x = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (x >> np.uint32(32 - TABLE_BITS)).astype(np.int64)


def text_models(docs: DataFrame, max_rows: int = 4000) -> tuple[list[str], np.ndarray]:
    """Languages, and log P(trigram | language) [places, languages], from docs (doc_id, text, lang)."""
    known = docs.filter("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    known = bounded_sample(known, max_rows, 9, "doc_id")

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                c = counts.setdefault(lang, np.zeros(1 << TABLE_BITS, np.int64))
                c += np.bincount(trigrams(text), minlength=1 << TABLE_BITS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "place", "n"])

    sums = known.mapInArrow(run, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in sums})
    table = np.full((1 << TABLE_BITS, len(langs)), SMOOTH)
    for r in sums:
        table[r.place, langs.index(r.lang)] += r.n
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def evidence(pages: DataFrame, models: np.ndarray, langs: list[str]) -> DataFrame:
    """id, host, domain, suffix, path, declared, ll (tempered text log-likelihoods) and p (soft verdict of the text alone)."""
    known = set(langs)
    schema = pa.schema([("id", pa.int64()), *[(k, pa.string()) for k in ("host", "domain", "suffix", "path", "declared")], ("ll", pa.list_(pa.float64())), ("p", pa.list_(pa.float64()))])

    def value(code):
        return None if code is None else code if code in known else "other"

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part, out = batch.slice(low, 256), []
                for url, markup in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    markup = markup or ""
                    host, domain, suffix, path = address(url or "")
                    m = _LANG.search(markup)
                    at = trigrams(visible(markup))
                    # Slice by slice: a long page takes no more memory than a short one.
                    ll = sum(models[at[k : k + SLICE]].sum(axis=0, dtype=np.float64) for k in range(0, max(1, len(at)), SLICE)) * (EVIDENCE / (EVIDENCE + len(at)))
                    ll -= ll.max()
                    out.append((host, domain, suffix, value(path), value(m[1].lower() if m else None), ll, _soft(ll)))
                yield pa.record_batch([part.column(0), *[pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), list(schema)[1:], strict=True)]], schema=schema)

    return pages.mapInArrow(run, "id long, host string, domain string, suffix string, path string, declared string, ll array<double>, p array<double>")


def fuse(spark: SparkSession, pages: DataFrame, docs: DataFrame, max_rows: int = 4000) -> DataFrame:
    """id, lang, confidence, text_lang, declared, host of each row of pages (id, url, html)."""
    ws = Workspace(spark, "langid")
    langs, models = text_models(docs, max_rows)
    each = range(len(langs))
    pages = pages.select(F.col("id").cast("long").alias("id"), "url", "html")
    if not langs:
        nothing = {"lang": "string", "confidence": "double", "text_lang": "string", "declared": "string", "host": "string"}
        return pages.select("id", *[F.lit(None).cast(t).alias(k) for k, t in nothing.items()])
    pieces = ws.table(evidence(pages, models, langs).withColumn("uid", F.monotonically_increasing_id()), "evidence")
    total = pieces.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("p", F.lit(k))).alias(f"g{k}") for k in each]).first()
    n, mass = total.n, [total[f"g{k}"] or 0.0 for k in each]
    whole = [(m + 1) / (n + len(langs)) for m in mass]
    df = pieces
    for level in ("host", "domain", "suffix"):
        df = attach(df, level, "uid", {f"{level}{k}": F.get("p", F.lit(k)) for k in each}, F.sum).withColumnRenamed("group_rows", f"{level}_n")

    def channel(name: str) -> list[Column]:
        """log P(value | language) of a column with few values, from its grouped soft counts; nothing where it is null."""
        rows = pieces.filter(F.col(name).isNotNull()).groupBy(name).agg(*[F.sum(F.get("p", F.lit(k))).alias(f"s{k}") for k in each]).collect()
        values = len(langs) + 1
        sums = [sum(r[f"s{k}"] for r in rows) for k in each]
        out = []
        for k in each:
            c = F.lit(0.0)
            for r in rows:
                c = F.when(F.col(name) == r[name], F.lit(math.log((r[f"s{k}"] + SMOOTH + HONEST * (r[name] == langs[k])) / (sums[k] + SMOOTH * values + HONEST)))).otherwise(c)
            out.append(c)
        return out

    def suffix(k: int) -> Column:
        return F.when(F.col("suffix").isNull(), F.lit(0.0)).otherwise(F.log((F.col(f"suffix{k}") + SMOOTH) / (mass[k] + 2 * SMOOTH)))

    def prior(k: int) -> Column:
        own, out = F.get("p", F.lit(k)), F.lit(whole[k])
        for level in ("domain", "host"):
            rest = (F.greatest(F.col(f"{level}{k}") - own, F.lit(0.0)) + PRIOR_WEIGHT * out) / (F.col(f"{level}_n") - 1 + PRIOR_WEIGHT)
            out = F.when(F.col(level).isNull(), out).otherwise(rest)
        return F.log(out)

    declared, path = channel("declared"), channel("path")
    scored = df.select("id", "declared", "host", "p", *[(F.get("ll", F.lit(k)) + declared[k] + path[k] + suffix(k) + prior(k)).alias(f"z{k}") for k in each])
    names = F.array(*map(F.lit, langs))
    zs = F.array(*[F.col(f"z{k}") for k in each])
    top = F.array_max(zs)
    spread = reduce(lambda a, b: a + b, [F.exp(F.col(f"z{k}") - top) for k in each])
    first = lambda a, m: F.get(names, (F.array_position(a, m) - 1).cast("int"))
    return scored.select("id", first(zs, top).alias("lang"), (1 / spread).alias("confidence"), first(F.col("p"), F.array_max("p")).alias("text_lang"), "declared", "host")
