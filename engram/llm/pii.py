"""Personal data by weak supervision.

Base spans follow four fixed patterns.  Wider candidates (credentials with and without a keyword, phones without a code, and
numbers or addresses that the base rules turn down) get votes of +1, -1 or 0 from five labelers: format, checksum, gazetteer,
left context and shape.  Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability; for
each kind a logistic span classifier is then trained on the posteriors, from the votes and from the span and its neighbourhood
(characters on both sides, share of digits, length, an assignment before it).  Its verdict decides on every candidate that is no
base span.  Patterns and features are few (kinds x 3^5 x SHAPES), so their counts are all the driver sees of the corpus.

Null texts are empty and have no spans.  Base spans always stay; an added span never overlaps another span.  Repeated and null
ids get a row each time.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.llm.workspace import Workspace

KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = 5
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits does, so the look-behind changes nothing but the time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WIDE_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
_SECRET = re.compile(r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b)\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_=-]{12,}+)")
#: A long run of letters and digits that no keyword announces.
_BARE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+_-]*[0-9])(?=[0-9+_-]*[A-Za-z])[A-Za-z0-9+_-]{20,}+")
#: Ten digits whose area and exchange can exist.
_PLACED = re.compile(r"[2-9][0-9]{2}[2-9][0-9]{6}")
_DIGIT = re.compile(r"[0-9]")

#: Gazetteers and context cues of the labelers.
SUFFIXES = frozenset("com org net edu gov mil int info biz io de fr es it uk eu us ca au ch at nl be pl se jp cn br in".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 61 62 63 64 65 66 81 82 84 86 90 91".split())
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "xoxb-", "xoxp-", "AIza", "eyJ")
CARD_STARTS = ("2", "34", "37", "4", "5", "6")
CUES = {
    "email": frozenset("email e-mail mail contact write".split()),
    "ip": frozenset("ip address host server from".split()),
    "card": frozenset("card visa mastercard amex credit payment account".split()),
    "phone": frozenset("phone tel call fax mobile telephone cell".split()),
    "secret": frozenset("token secret password passwd api_key api-key apikey access_key key".split()),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i & 1:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and matches that failed their further condition; both (kind, start, end) in code points."""
    found, failed = [], []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            (found if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")) else failed).append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19:
                (found if luhn(digits) else failed).append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                n = sum(c.isdigit() for c in m[0])
                (found if 9 <= n <= 15 else failed).append(("phone", m.start(), m.end()))
        failed += [("phone", m.start(), m.end()) for m in _WIDE_PHONE.finditer(text)]
    if ":" in text or "=" in text:
        failed += [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text)]
    failed += [("secret", m.start(), m.end()) for m in _BARE.finditer(text)]
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return found, failed


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """Votes of the labelers format, checksum, gazetteer, context and shape on one candidate; format is -1 only for failed bounds or checksums."""
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    left = re.findall(r"[a-z_-]+", text[max(0, start - 40) : start].lower())[-3:]
    cue = 1 if CUES[kind].intersection(left) else 0
    if kind == "email":
        return 1, 0, 1 if s.rsplit(".", 1)[-1].lower() in SUFFIXES else -1, cue, 1 if len(s) <= 64 else -1
    if kind == "ip":
        parts = s.split(".")
        return 1 if strict else -1, 1 if strict else -1, -1 if parts[0].lstrip("0") in ("", "255") else 0, cue, 1 if all(len(p) <= 3 for p in parts) else -1
    if kind == "card":
        return 1 if strict else -1, 1 if luhn(digits) else -1, 1 if digits.startswith(CARD_STARTS) else -1, cue, 1 if len(digits) in (14, 15, 16) else -1
    if kind == "phone":
        code = any(digits[:k] in CALLING_CODES for k in (1, 2)) if s[0] == "+" else None
        placed = bool(_PLACED.fullmatch(digits))
        form = 1 if strict else -1 if s[0] == "+" else 1 if placed else 0
        return form, 0, (0 if placed else -1) if code is None else 1 if code else -1, cue, 1 if 9 <= len(digits) <= 15 and re.search(r"[ ().-]", s) else -1
    distinct = len(set(s))
    starts = s.startswith(KEY_STARTS)  # such a beginning announces itself, as a word before it would
    known, cue = starts or (left and left[-1] in CUES[kind]), 1 if starts else cue
    return 1 if re.fullmatch(r"[0-9a-f]{16,}|[A-Za-z0-9+/_=-]{20,}", s) else 0, 0, 1 if known else -1, cue, 1 if digits and distinct >= 8 else -1


def _side(c: str) -> int:
    """Class of a neighbouring character: none, white space, letter, digit, other."""
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


#: Numbers of classes of the span features, in order: before, after, share of digits, length, assignment.
WIDTHS = (5, 5, 4, 5, 2)
SHAPES = math.prod(WIDTHS)
PRIOR_ROWS = 20.0


def shape(text: str, start: int, end: int) -> tuple[int, ...]:
    """Classes of a span and its neighbourhood, as many as WIDTHS says."""
    n = end - start
    digits = sum("0" <= c <= "9" for c in text[start:end])
    share = 0 if not digits else 3 if digits == n else 1 if 2 * digits <= n else 2
    left = text[max(0, start - 8) : start].rstrip(" \t\"'(")
    return _side(text[start - 1 : start]), _side(text[end : end + 1]), share, (n >= 9) + (n >= 13) + (n >= 17) + (n >= 25), int(left[-1:] in (":", "="))


def code_of(kind: str, vote: tuple[int, ...], form: tuple[int, ...] = (0,) * len(WIDTHS)) -> int:
    out = KINDS.index(kind)
    for v in vote:
        out = out * 3 + v + 1
    for v, width in zip(form, WIDTHS, strict=True):
        out = out * width + v
    return out


def decoded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes and span classes of codes."""
    codes, forms, columns = np.array(codes), [], []
    for width in WIDTHS[::-1]:
        forms.append(codes % width)
        codes = codes // width
    for _ in range(LABELERS):
        columns.append(codes % 3 - 1)
        codes = codes // 3
    return codes, np.stack(columns[::-1], axis=-1), np.stack(forms[::-1], axis=-1)


def estimate(votes_: np.ndarray, weight: np.ndarray, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM for labelers that are independent given the truth: posterior of each vote pattern, and P(vote | truth) [2, labeler, 3].

    Starts from the majority of votes; a prior of one pseudo-count per cell, a little stronger for agreement, fixes which
    class is which.
    """
    post = 1 / (1 + np.exp(-1.5 * votes_.sum(axis=1)))
    prior = np.ones((2, votes_.shape[1], 3))
    prior[1, :, 2] += 2
    prior[0, :, 0] += 2
    for _ in range(steps):
        table = prior.copy()
        for v in (-1, 0, 1):
            hit = votes_ == v
            table[1, :, v + 1] += (weight * post) @ hit
            table[0, :, v + 1] += (weight * (1 - post)) @ hit
        table /= table.sum(axis=2, keepdims=True)
        share = (weight @ post + 1) / (weight.sum() + 2)
        logit = np.log(share / (1 - share)) + sum(np.log(table[1, j, votes_[:, j] + 1] / table[0, j, votes_[:, j] + 1]) for j in range(votes_.shape[1]))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, table


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def features(votes_: np.ndarray, forms: np.ndarray) -> np.ndarray:
    """A constant, for each labeler whether it voted for or against, and an indicator for each class of each span feature."""
    classes = [np.eye(width)[forms[:, i]] for i, width in enumerate(WIDTHS)]
    return np.hstack([np.ones((len(votes_), 1)), votes_ == 1, votes_ == -1, *classes]).astype(float)


def accepted(counts: dict[int, int]) -> list[int]:
    """Codes that the trained classifier takes for personal data, from the corpus counts of all codes."""
    if not counts:
        return []
    codes, weight = np.array(sorted(counts)), np.array([counts[k] for k in sorted(counts)], float)
    kinds, votes_, forms = decoded(codes)
    out = []
    for k in sorted(set(kinds.tolist())):
        own = kinds == k
        patterns, place = np.unique(votes_[own], axis=0, return_inverse=True)
        post, _ = estimate(patterns, np.bincount(place.ravel(), weight[own]))
        x, majority = features(votes_[own], forms[own]), 1 / (1 + np.exp(-1.5 * votes_[own].sum(axis=1)))
        # In a small corpus, from which no reliability can be told, the majority counts too.
        doubt = PRIOR_ROWS / (PRIOR_ROWS + weight[own].sum())
        w = train(x, (1 - doubt) * post[place.ravel()] + doubt * majority, weight[own])
        out += codes[own][x @ w >= 0].tolist()
    return out


_CANDIDATES = "array<struct<start:int,kind:int,end:int,code:int,base:boolean>>"
_NOTHING = {**{f"n_{k}": 0 for k in KINDS[:4]}, "base_sha256": hashlib.sha256(b"").hexdigest(), "cands": []}


def scan(text: str | None) -> dict:
    """Counts and digest of the base spans, and all candidates, of a text; no two added ones overlap each other or a base span."""
    found, failed = base_spans(text) if text else ((), ())
    if not found and not failed:
        return _NOTHING
    taken = sorted((s, e) for _, s, e in found)
    cands = [{"start": s, "kind": KINDS.index(k), "end": e, "code": code_of(k, votes(text, k, s, e, True), shape(text, s, e)), "base": True} for k, s, e in found]
    voted = [(s, e, k, votes(text, k, s, e, False)) for k, s, e in failed]
    # What the labelers speak against does not stand in the way of what they speak for.
    for s, e, k, vote in sorted(voted, key=lambda x: (x[3][0] < 0, x[0], -x[1], -sum(x[3]))):
        at = bisect.bisect_left(taken, (e,))
        if not (at and taken[at - 1][1] > s):
            cands.append({"start": s, "kind": KINDS.index(k), "end": e, "code": code_of(k, vote, shape(text, s, e)), "base": False})
            bisect.insort(taken, (s, e))
    digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()
    return {**{f"n_{x}": sum(k == x for k, _, _ in found) for x in KINDS[:4]}, "base_sha256": digest, "cands": cands}


def candidates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as doc_id and ``pii``: counts, digest, base spans and candidates of each row."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("code", pa.int32()), ("base", pa.bool_())])
    kind = pa.struct([*[(f"n_{k}", pa.int64()) for k in KINDS[:4]], ("base_sha256", pa.string()), ("cands", pa.list_(span))])

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([scan(t) for t in part.column(1).to_pylist()], kind)], names=["doc_id", "pii"])

    fields = ", ".join(f"n_{k}: long" for k in KINDS[:4])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, pii struct<{fields}, base_sha256: string, cands: {_CANDIDATES}>")


def code_counts(found: DataFrame) -> dict[int, int]:
    """Number of candidates of each code in all documents; at most kinds x 3^5 x SHAPES rows."""
    return {r.code: r.n for r in found.select(F.explode("pii.cands").alias("c")).groupBy("c.code").agg(F.count(F.lit(1)).alias("n")).collect()}


def spans(codes: list[int]) -> Column:
    """Base spans and accepted ones, by start and then kind."""
    kept = F.filter("pii.cands", lambda c: c.base | c.code.isin(codes) if codes else c.base)
    return F.array_sort(F.transform(kept, lambda c: F.struct(c.start.alias("start"), c.kind.alias("kind"), c.end.alias("end"))))


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans for (doc_id, text)."""
    ws = Workspace(spark, "pii")
    found = ws.table(candidates(docs), "candidates")
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(spans(accepted(code_counts(found))), lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")
    return found.select("doc_id", *[F.col(f"pii.n_{k}").alias(f"n_{k}") for k in KINDS[:4]], F.col("pii.base_sha256").alias("base_sha256"), text.alias("spans"))


def masked(text: str | None, codes: frozenset[int]) -> str | None:
    """The text with each base span and each candidate of these codes replaced by its kind in brackets; of overlapping ones the first."""
    kept = sorted((c["start"], c["kind"], c["end"]) for c in scan(text)["cands"] if c["base"] or c["code"] in codes)
    if not kept:
        return text
    out, at = [], 0
    for start, kind, end in kept:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in brackets, and n_chars to match if it is there."""
    ws = Workspace(spark, "redact")
    keyed = docs.select(F.lit(0).alias("doc_id"), "text")
    codes = frozenset(accepted(code_counts(ws.table(candidates(keyed).select("pii"), "patterns"))))
    ws.end()

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                yield pa.RecordBatch.from_arrays([pa.array([masked(t, codes) for t in part.column(0).to_pylist()], pa.string()), part.column(1)], names=["text", "row"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = docs.select("text", row).mapInArrow(run, T.StructType([T.StructField("text", T.StringType()), T.StructField("row", docs.schema)]))
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
