"""Document quality by a learned decision list, in DataFrame operations only.

Sequential covering: each rule is grown, one threshold condition at a time, by the gain on two thirds of the labelled rows,
pruned on the other third, and kept if it is precise there; the rows that it covers leave and the next rule is sought.  Every
step is one grouped count of (statistic, bin, label), so only counts, bounded by statistics times thresholds, reach the driver.
The list becomes one ordered conditional expression.

Null texts are empty.  No labelled rows of low quality: an empty list, which keeps whatever the base rules keep.
Null, repeated or foreign ids and extra columns (of any name) do not matter: verdicts are made row by row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.workspace import Workspace, bounded_sample

SPACES = " \t\n\x0b\x0c\r"
#: Labelled rows that rules are learned from, about.
MAX_ROWS = 20_000
WORD_BREAK = r"[\x20\x09-\x0D]+"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "bangs", "marks", "distinct", "line_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(f"f.{self.feature}")
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _counted(characters: str) -> Column:
    """How many of these characters, none of a-z, the text holds."""
    return F.length("_rest") - F.length(F.translate("_rest", characters, ""))


def statistics(rows: DataFrame) -> DataFrame:
    """rows has a column ``text``; adds a struct ``s`` of the counts in STATS and a struct ``f`` of FEATURES."""
    own = rows.columns
    t = F.coalesce("text", F.lit(""))
    df = rows.withColumn("_t", t).withColumn("_words", F.filter(F.split("_t", WORD_BREAK), lambda w: w != ""))
    # What is left without the commonest letters is short, and holds all characters that are counted below.
    df = df.withColumn("_rest", F.translate("_t", "abcdefghijklmnopqrstuvwxyz", ""))
    df = df.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    hashed = F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    df = df.withColumn("_grams", F.when(F.size("_words") >= 3, F.slice(hashed, 1, F.size("_words") - 2)).otherwise(F.array().cast("array<bigint>")))
    placed = F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), placed).otherwise(F.array().cast("array<struct<g:bigint,i:int>>")))
    twice = F.filter("_sorted", lambda x, k: (x.g == F.get("_sorted", k - 1).g) | (x.g == F.get("_sorted", k + 1).g))
    starts = F.array_sort(F.transform(twice, lambda x: x.i))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(starts, start, lambda a, i: F.struct(i.alias("last"), (a.n + F.least(F.lit(3), i - a["last"])).alias("n"))).n
    dup = F.size("_lines") - F.size(F.array_distinct("_lines"))
    s = F.struct(F.size("_words").cast("long").alias("n_words"), (F.length("_t") - _counted(SPACES)).cast("long").alias("word_chars"), _counted("#*$%&|<>").cast("long").alias("n_symbols"), dup.cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).alias("n_repeat_words"))
    lines = F.size("_lines")
    df = df.withColumn("s", s)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    f = {
        "words": F.col("s.n_words").cast("double"), "word_length": ratio(F.col("s.word_chars"), F.col("s.n_words")), "symbols": ratio(F.col("s.n_symbols"), F.col("s.word_chars")),
        "dup_lines": ratio(F.col("s.n_dup_lines"), lines), "repeats": ratio(F.col("s.n_repeat_words"), F.col("s.n_words")),
        "upper": ratio(_counted("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.col("s.word_chars")), "digits": ratio(_counted("0123456789"), F.col("s.word_chars")),
        "bangs": ratio(_counted("!"), F.col("s.n_words")), "marks": ratio(_counted(".,;:?"), F.col("s.n_words")),
        "distinct": ratio(F.size(F.array_distinct("_words")), F.col("s.n_words")), "line_words": ratio(F.col("s.n_words"), lines),
    }
    return df.withColumn("f", F.struct(*[f[k].alias(k) for k in FEATURES])).select(*own, "s", "f")


def base_failed() -> Column:
    return (F.col("s.n_words") < 50) | (100 * F.col("s.n_repeat_words") > 50 * F.col("s.n_words"))


def _all(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in rule], F.lit(True))


def _centred(rows: DataFrame, rule: Rule) -> Rule:
    """The rule with each threshold half-way between the labelled values on both sides: the same rows, with the widest margin."""
    aggs = []
    for i, c in enumerate(rule):
        x = F.col(f"f.{c.feature}")
        aggs += [F.max(F.when(x <= c.threshold, x)).alias(f"low{i}"), F.min(F.when(x > c.threshold, x)).alias(f"high{i}")]
    row = rows.agg(*aggs).first()
    ends = [(row[f"low{i}"], row[f"high{i}"]) for i in range(len(rule))]
    return tuple(c if None in e else Condition(c.feature, c.above, sum(e) / 2) for c, e in zip(rule, ends, strict=True))


def _bin(feature: str, points: list[float]) -> Column:
    """How many of the points lie below the feature."""
    return F.size(F.filter(F.array(*map(F.lit, points)), lambda t: t < F.col(f"f.{feature}")))


def learn(labelled: DataFrame, bins: int = 24, conditions: int = 3, rules: int = 8, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """labelled: ``f``, ``bad`` boolean, ``prune`` boolean (the third that pruning uses), few enough rows to be read often."""
    quantiles = [i / bins for i in range(1, bins)]
    cuts_row = labelled.agg(*[F.percentile_approx(f"f.{k}", quantiles, 1000).alias(k) for k in FEATURES]).first()
    cuts = {k: sorted(set(cuts_row[k] or [])) for k in FEATURES}
    binned = [F.struct(F.lit(k).alias("k"), _bin(k, v).alias("b")) for k, v in cuts.items() if v]
    found: list[Rule] = []
    if not binned:
        return found
    left = labelled
    for _ in range(rules):
        rule: Rule = ()
        for _ in range(conditions):
            counts = left.filter(~F.col("prune") & _all(rule)).select("bad", F.explode(F.array(*binned)).alias("x")).groupBy("x.k", "x.b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            total = [sum(r.p for r in counts if r.k == FEATURES[0]), sum(r.n for r in counts if r.k == FEATURES[0])]
            if total[0] < least or not total[1]:
                break
            best = (0.0, None)
            for k, points in cuts.items():
                rows = [r for r in counts if r.k == k]
                for i, point in enumerate(points):
                    high = [sum(r.p for r in rows if r.b > i), sum(r.n for r in rows if r.b > i)]
                    for above, (p, n) in ((True, high), (False, (total[0] - high[0], total[1] - high[1]))):
                        if p >= least:
                            gain = p * (math.log2((p + 1) / (p + n + 2)) - math.log2((total[0] + 1) / (sum(total) + 2)))
                            if gain > best[0] + 1e-9:
                                best = (gain, Condition(k, above, point))
            if not best[1]:
                break
            rule = (*[c for c in rule if (c.feature, c.above) != (best[1].feature, best[1].above)], best[1])
        if not rule:
            break
        shorter = [rule[:i] for i in range(1, len(rule) + 1)]
        row = left.filter("prune").agg(*[F.count_if(_all(r) & (F.col("bad") == bad)).alias(f"{'pn'[not bad]}{i}") for i, r in enumerate(shorter) for bad in (True, False)]).first()
        worth = [((row[f"p{i}"] + 1) / (row[f"p{i}"] + row[f"n{i}"] + 2), -i) for i in range(len(shorter))]
        score, i = max(worth)
        rule = shorter[-i]
        if score < precision:
            break
        rule = _centred(left, rule)
        found.append(rule)
        left = left.filter(~_all(rule))
    return found


def decision(rules: list[Rule]) -> Column:
    """'keep', or the number of the first rule that rejects: one ordered conditional expression."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        out = F.when(_all(rule), F.lit(i)).otherwise(out)
    return out


def sampled(labels: DataFrame, max_rows: int) -> DataFrame:
    """doc_id, bad of about max_rows labelled rows, chosen by hash of the id: few enough to broadcast."""
    labels = labels.filter("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") == 0).alias("bad")).distinct()
    return bounded_sample(labels, max_rows, 7, "doc_id")


def fit(spark: SparkSession, stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **kw) -> list[Rule]:
    """stats: doc_id, s, f.  labels: doc_id, quality.  About max_rows labelled rows are used.

    The list judges what the base rules let pass, so it learns from such rows only.
    """
    picked = F.broadcast(sampled(labels, max_rows))
    ws = Workspace(spark, "rules")
    chosen = stats.join(picked, "doc_id").select(base_failed().alias("base"), "f", "bad", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0).alias("prune"))
    # Written before it is filtered: a filter on statistics that are not written yet would work them out again for each use.
    rows = ws.table(chosen, "labelled").filter(~F.col("base")).drop("base")
    return learn(rows, **kw)


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for each row of docs (doc_id, text)."""
    ws = Workspace(spark, "quality")
    stats = ws.table(statistics(docs.select("doc_id", "text")).drop("text"), "stats")
    rules = fit(spark, stats, labels)
    return stats.select("doc_id", *[F.col(f"s.{k}").alias(k) for k in STATS], base_failed().alias("base_failed"), (~base_failed() & decision(rules).isNull()).alias("kept"), decision(rules).alias("rule"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs that neither the base rules nor the learned list reject, with their own columns."""
    known = docs.select("doc_id", "text").join(F.broadcast(sampled(labels, MAX_ROWS)), "doc_id", "left_semi")
    rules = fit(spark, statistics(known), labels)
    judged = statistics(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"))
    # The filter stays above a generator; pushed below it, each use of a statistic would compute its whole tree again.
    once = judged.select("row", F.explode(F.array(F.struct("s", "f"))).alias("x")).select("row", "x.s", "x.f")
    return once.filter(~base_failed() & decision(rules).isNull()).select("row.*")
