"""Toxicity: a lexicon trie met by Levenshtein automata, and context windows that tell quotation from abuse.

The lexicon is learned from labelled training rows alone: words, and stems (word beginnings of STEM letters), whose odds of
standing in a toxic text are high.  A word runs through the Levenshtein automata of all terms and stems of the trie at once, made
deterministic step by step as words ask for it; what a misspelled form counts is learned for each of them.  Each hit is scored with its context: quotation marks around it, verbs of
saying near it, and words that address someone.  A logistic model on these scores is fitted on training rows.

An entry's own length says how many changes a form of it may have, so short misspellings of longer terms are found too.

Training rows are those whose id's CRC-32 is not divisible by FOLDS, at most about ``max_rows`` of them, chosen by hash of the id.
No label, language, source or id is an input of a score.  Null and empty texts have no hits and get the model's floor; without
labelled rows nothing is known of any text, and all get the same score.  Repeated and null ids get a row each time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.workspace import Workspace, bounded_sample

FOLDS = 5
STEM = (3, 7)
WINDOW = 5
_WORD = re.compile(r"[^\W_]+(?:['’*@$!]+[^\W_]+)*|[\"“”«»„]")
_LEET = str.maketrans("013457@$!", "oieastasi", "*'’")
_QUOTES = frozenset('"“”«»„')
#: Context cues.
SAYING = frozenset("said says say wrote writes called calls quote quoted reported according dit dijo sagte schrieb".split())
ADDRESS = frozenset("you your you're youre u are tu vous ihr du sie usted eres".split())
FEATURES = ("exact", "stem", "near", "quoted", "said", "addressed", "share", "some")


MOST = 2


def allowed(length: int, stem: bool = False) -> int:
    """Changes that a form of a term, or a beginning like a stem, of so many letters may have."""
    return 0 if length < 4 + stem else 1 if length < 9 else MOST


@dataclass
class Trie:
    """Terms and stems by letters; a node is [children, term id or -1, stem id or -1, depth].

    trust: what a misspelled form of each entry (terms, then stems) counts, from 0 to 1 (None: 1 for all).
    """

    terms: list[str]
    stems: list[str]
    trust: list[float] | None = None
    root: list = field(init=False)
    forms: Automaton | None = field(init=False, default=None)

    def __post_init__(self):
        self.root = [{}, -1, -1, 0]
        for where, words in ((1, self.terms), (2, self.stems)):
            for i, w in enumerate(words):
                node = self.root
                for c in w:
                    node = node[0].setdefault(c, [{}, -1, -1, node[3] + 1])
                node[where] = i

    def match(self, word: str) -> tuple[int, int]:
        """(kind, entry): 1 a term, 2 a stem of the word, 3 a term or stem within the distance that its length allows; 0 none.

        The entry is its place among terms and then stems for the third kind, and -1 for others.
        """
        node, stem = self.root, False
        for c in word:
            node = node[0].get(c)
            if node is None:
                break
            stem = stem or node[2] >= 0
        else:
            if node[1] >= 0:
                return 1, -1
        if stem:
            return 2, -1
        if self.forms is None:
            self.forms = Automaton(self.root, MOST, allowed)
        found = self.forms.find(word)
        if found is None:
            return 0, -1
        _, where, i = found
        return 3, i + (where == 2) * len(self.terms)

    def near(self, word: str, most: int) -> int | None:
        """Least distance, at most ``most``, of a term to the word, or of a stem to its beginning; swapped neighbours count as one change."""
        found = Automaton(self.root, most, lambda length, stem=False: most).find(word)
        return None if found is None else found[0]


class Automaton:
    """The Levenshtein automata of all terms and stems of a trie at once, made deterministic as words ask for it.

    A state is a set of (trie node, changes so far, letter still owed by a swap).  Most words reach the empty state after a
    few letters, so a look-up costs a few dictionary reads.  An entry of n letters is met with ``limit(n, stem=)`` changes.
    """

    def __init__(self, root: list, most: int, limit: Callable[..., int], memory: int = 20_000):
        self.root, self.most, self.limit, self.memory = root, most, limit, memory
        self.reset()

    def reset(self) -> None:
        self.known: dict[frozenset, int] = {}
        self.next: list[dict[str, int]] = []
        self.states: list[list] = []
        self.accepts: list[tuple[int, int, int] | None] = []
        self.begins: list[tuple[int, int, int] | None] = []
        self.start = self.number({(id(self.root), None): (self.root, 0)})

    def number(self, items: dict) -> int:
        """The number of a state, closed under leaving out letters of terms."""
        stack = [(node, e, owed) for (_, owed), (node, e) in items.items()]
        while stack:
            node, e, owed = stack.pop()
            if owed is None and e < self.most:
                for child in node[0].values():
                    k = (id(child), None)
                    if k not in items or items[k][1] > e + 1:
                        items[k] = (child, e + 1)
                        stack.append((child, e + 1, None))
        key = frozenset((k, e) for k, (_, e) in items.items())
        n = self.known.get(key)
        if n is None:
            n = self.known[key] = len(self.states)
            self.states.append([(node, e, owed) for (_, owed), (node, e) in items.items()])
            self.next.append({})
            done = [(node, e) for node, e, owed in self.states[-1] if owed is None]
            self.accepts.append(min(((e, 1, node[1]) for node, e in done if node[1] >= 0 and e <= self.limit(node[3])), default=None))
            self.begins.append(min(((e, 2, node[2]) for node, e in done if node[2] >= 0 and e <= self.limit(node[3], stem=True)), default=None))
        return n

    def step(self, state: int, c: str) -> int:
        items: dict = {}

        def add(node, e, owed=None):
            k = (id(node), owed)
            if k not in items or items[k][1] > e:
                items[k] = (node, e)

        for node, e, owed in self.states[state]:
            if owed is not None:
                if c == owed:
                    add(node, e)
                continue
            if c in node[0]:
                add(node[0][c], e)
            if e < self.most:
                add(node, e + 1)
                for x, child in node[0].items():
                    if x != c:
                        add(child, e + 1)
                        if c in child[0]:
                            add(child[0][c], e + 1, x)
        n = self.next[state][c] = self.number(items)
        return n

    def find(self, word: str) -> tuple[int, int, int] | None:
        """(distance, 1 for a term or 2 for a stem, its id) of the nearest one: a term to the word, a stem to its beginning."""
        if len(self.states) > self.memory:
            self.reset()
        state, best = self.start, None
        for c in word:
            n = self.next[state].get(c)
            state = self.step(state, c) if n is None else n
            if not self.states[state]:
                return best
            begun = self.begins[state]
            if begun is not None and (best is None or begun < best):
                best = begun
        ended = self.accepts[state]
        return ended if best is None or ended is not None and ended < best else best


class Matcher:
    """Features of texts; remembers the words that it has seen, up to a bound."""

    def __init__(self, trie: Trie, memory: int = 200_000):
        self.trie, self.memory, self.seen = trie, memory, {}

    def kind(self, word: str) -> tuple[int, int]:
        """As Trie.match; a term with digits or signs for letters is a misspelled one."""
        k = self.seen.get(word)
        if k is None:
            if len(self.seen) >= self.memory:
                self.seen.clear()
            k = self.trie.match(word)
            if not k[0] and not word.isalpha() and not word.isdigit() and (plain := word.translate(_LEET)) != word:
                found = self.trie.match(plain)
                k = (3, found[1]) if found[0] in (1, 3) else k
            self.seen[word] = k
        return k

    def features(self, text: str | None) -> list[float]:
        words = _WORD.findall(text.lower()) if text else []
        trust, kinds = self.trie.trust, {}
        for w in set(words) - _QUOTES:
            k, entry = self.kind(w)
            weight = trust[entry] if trust and entry >= 0 else 1.0
            if k and weight > 0:
                kinds[w] = k, weight
        if not kinds:
            return [0.0] * len(FEATURES)
        counts, quoted, said, addressed, hits, inside = [0, 0, 0], 0, 0, 0, 0, False
        for i, w in enumerate(words):
            if w in _QUOTES:
                inside = not inside if w == '"' else w in "“«„"
                continue
            if w in kinds:
                k, weight = kinds[w]
                hits += weight
                counts[k - 1] += weight
                near = words[max(0, i - WINDOW) : i + WINDOW + 1]
                quoted += weight * inside
                said += weight * (not SAYING.isdisjoint(near))
                addressed += weight * (not ADDRESS.isdisjoint(near))
        exact, stem, near = counts
        # A misspelled term counts little less than a plain one; what it adds or lacks beyond that is learned.
        return [*np.log1p([exact + 0.8 * near, stem, near]).tolist(), quoted / hits, said / hits, addressed / hits, min(1.0, 20 * hits / len(words)), max(weight for _, weight in kinds.values())]


def is_held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0


def training(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """text and toxic (boolean) of the texts of about max_rows labelled training ids."""
    own = labels.filter("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") == 1).alias("toxic")).filter(~is_held_out())
    picked = bounded_sample(own.distinct(), max_rows, 5, "doc_id")
    return docs.select("doc_id", "text").join(picked.hint("merge"), "doc_id").select("text", "toxic").dropDuplicates()


def without_copies(rows: DataFrame) -> DataFrame:
    """One row of each group of copies; near ones too, as most share their least three-word shingle."""
    least_gram = F.array_min(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))))
    return rows.withColumn("words", F.split(F.lower("text"), r"\s+")).withColumn("gram", least_gram).dropDuplicates(["gram", "toxic"]).select("text", "toxic")


def lexicon(rows: DataFrame, least: int = 5, share: float = 0.01, odds: float = 12.0) -> Trie:
    """Words and stems that ``odds`` times as many toxic as other rows have; as many as the bounded training rows give.

    Counted by document, in each partition first; ``least`` toxic rows, and ``share`` of them, must have it.  Of stems that
    begin one another the shorter stays; a stem that is little more than one of the words goes.
    All terms and stems are met in misspelled form too; ``trust`` and the weight of ``near`` say what that is worth.
    """

    def run(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            if len(toxic) + len(clean) > 500_000:
                yield from flushed(toxic, clean)
            for text, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stems = set()
                for w in set(_WORD.findall((text or "").lower())):
                    stems.update(w[:k] for k in range(STEM[0], min(len(w), STEM[1]) + 1))
                    stems.add(w + "$")
                (toxic if bad else clean).update(stems)
        yield from flushed(toxic, clean)

    def flushed(toxic, clean):
        names = list(toxic.keys() | clean.keys())
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[k] for k in part], pa.int64()), pa.array([clean[k] for k in part], pa.int64())], names=["stem", "t", "n"])
        toxic.clear()
        clean.clear()

    rows = without_copies(rows)
    total = rows.groupBy("toxic").count().collect()
    t, n = (next((r["count"] for r in total if r.toxic == x), 0) for x in (True, False))
    found = rows.mapInArrow(run, "stem string, t long, n long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    ratio = (F.col("t") + 0.5) / (F.col("n") + 0.5) * ((n + 1) / (t + 1))
    best = found.filter(F.col("t") >= max(least, share * t)).withColumn("odds", ratio).filter(F.col("odds") >= odds).collect()
    rows_with = {r.stem: r.t for r in best}
    words = {s[:-1]: n for s, n in rows_with.items() if s.endswith("$")}
    stems: list[str] = []
    for s in sorted((s for s in rows_with if not s.endswith("$")), key=lambda s: (len(s), s)):
        if not any(s.startswith(x) for x in stems) and not any(w.startswith(s) and n >= 0.8 * rows_with[s] for w, n in words.items()):
            stems.append(s)
    terms = sorted(w for w in words if not any(w.startswith(s) for s in stems))
    return Trie(terms, stems)


def trust(rows: DataFrame, trie: Trie) -> list[float]:
    """For each entry the lead of toxic over clean ones among the training rows with a misspelled form of it; copies count once.

    Two rows in favour are added, so what the rows never show misspelled counts in full; 0 is the least.
    """

    def run(batches):
        matcher, toxic, clean = Matcher(trie), Counter(), Counter()
        for batch in batches:
            for text, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = map(matcher.kind, set(_WORD.findall((text or "").lower())) - _QUOTES)
                (toxic if bad else clean).update({entry for k, entry in found if k == 3 and entry >= 0})
        keys = sorted(toxic.keys() | clean.keys())
        columns = [keys, [toxic[k] for k in keys], [clean[k] for k in keys]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["entry", "t", "n"])

    seen = without_copies(rows).mapInArrow(run, "entry long, t long, n long").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect()
    lead = {r.entry: max(0.0, (r.t + 2 - r.n) / (r.t + 2 + r.n)) for r in seen}
    return [lead.get(i, 1.0) for i in range(len(trie.terms) + len(trie.stems))]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression with an intercept, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step * min(1.0, 3 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _measured(rows: DataFrame, trie: Trie, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and x, the features of text (the first column)."""

    def run(batches):
        matcher = Matcher(trie)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                x = [matcher.features(t) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    kinds = dict(rows.dtypes)
    return rows.select("text", *keep).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", x array<double>")


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text)."""
    ws = Workspace(spark, "toxicity")
    # An id that many rows share brings all their texts along; of those about max_rows are taken again.
    rows = ws.table(bounded_sample(ws.table(training(docs, labels, max_rows), "labelled"), 2 * max_rows, 6, "text"), "training")
    trie = lexicon(rows)
    trie = Trie(trie.terms, trie.stems, trust(rows, trie))
    sample = _measured(rows, trie, ["toxic"]).collect()  # about max_rows rows of a few numbers
    if {r.toxic for r in sample} == {True, False}:
        w = fit(np.array([r.x for r in sample]), np.array([r.toxic for r in sample], float))
    else:  # nothing to learn from
        w = np.array([0.0] * len(FEATURES) + [-3.0])
    found = _measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), trie, ["doc_id"])
    logit = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in w[:-1]]), lambda a, b: a * b), F.lit(float(w[-1])), lambda a, b: a + b)
    p = 1 / (1 + F.exp(-logit))
    return found.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), p.alias("score"), (p >= 0.5).cast("int").alias("predicted"))
