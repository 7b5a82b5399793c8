import math
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.llm import toxicity
from engram.llm.queries import QUERIES


def distance(a, b):
    """Optimal string alignment by the full table."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=6), st.text("abc", max_size=8), st.integers(0, 2))
def test_automaton_on_trie(terms, word, most):
    best = min(distance(t, word) for t in terms)
    assert toxicity.Trie(terms, []).near(word, most) == (best if best <= most else None)


def test_context_features():
    m = toxicity.Matcher(toxicity.Trie(["idiot"], ["vequ"]))
    names = dict(zip(toxicity.FEATURES, m.features('He said "what an idiot" then'), strict=True))
    assert names["quoted"] == 1 and names["said"] == 1 and names["exact"] > 0
    assert m.features("you are an idoit")[2] > 0 and m.features("you are an idoit")[5] == 1
    assert m.features("vequette")[1] > 0 and m.features("an 1d10t")[2] > 0 and m.features("room 101")[2] == 0
    assert m.features(None) == m.features("") == m.features("a fine day") == [0.0] * len(toxicity.FEATURES)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = QUERIES["op9_toxicity"](spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) >= 0.98
    # About one toxic label in fifteen stands on a text without any term.
    assert sum(a == b == 1 for a, b in held) / sum(a for a, _ in held) >= 0.9


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "you idiot " * 20000, 1), (None, "x", 1), (3, "you idiot", 1)], "doc_id long, text string, toxic int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(spark, docs, none).collect()
    assert len(got) == 5 and len({r.score for r in got}) == 1 and not any(r.predicted for r in got)
    assert toxicity.score(spark, docs.limit(0), none).count() == 0
    rng = random.Random(1)
    words = [f"{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}word" for _ in range(300)]
    train = [(i, " ".join(rng.choices(words, k=40) + (["zqtoxic", "zqawful"] if i % 3 == 0 else []))) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in train], "doc_id long, quality int, toxic int")
    got = toxicity.score(spark, spark.createDataFrame(train, "doc_id long, text string"), labels).collect()
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in got) >= 0.98 * len(got)
    twice = labels.unionByName(labels).withColumn("text", F.lit("x")).withColumn("x", F.lit(1)).unionByName(spark.createDataFrame([(None, 1, 1, "x", 1)], "doc_id long, quality int, toxic int, text string, x int"))
    again = toxicity.score(spark, spark.createDataFrame(train, "doc_id long, text string").withColumn("toxic", F.lit(1)).withColumn("x", F.lit(0)), twice).collect()
    assert sorted((r.doc_id, r.predicted) for r in again) == sorted((r.doc_id, r.predicted) for r in got)


def plain_features(trie, text):
    """Features of a text by full distance tables, term by term."""
    F, out = toxicity, []
    words = F._WORD.findall(text.lower()) if text else []

    def kind(word, leet=True):
        if word in trie.terms:
            return 1, 1.0
        if any(word.startswith(s) for s in trie.stems):
            return 2, 1.0
        near = [(distance(t, word), 1, i) for i, t in enumerate(trie.terms) if distance(t, word) <= F.allowed(len(t))]
        near += [(d, 2, i) for i, t in enumerate(trie.stems) for d in [min(distance(t, word[:k]) for k in range(len(word) + 1))] if d <= F.allowed(len(t), True)]
        if near:
            _, where, i = min(near)
            return 3, trie.trust[i + (where == 2) * len(trie.terms)] if trie.trust else 1.0
        if leet and not word.isalpha() and not word.isdigit():
            plain = word.translate(F._LEET)
            k, weight = kind(plain, False) if plain != word else (0, 0.0)
            return (3, weight) if k in (1, 3) else (0, 0.0)
        return 0, 0.0

    inside, hits = False, []
    for i, w in enumerate(words):
        if w in F._QUOTES:
            inside = not inside if w == '"' else w in "“«„"
            continue
        k, weight = kind(w)
        if k and weight > 0:
            near = words[max(0, i - F.WINDOW) : i + F.WINDOW + 1]
            hits.append((k, weight, inside, any(x in F.SAYING for x in near), any(x in F.ADDRESS for x in near)))
    if not hits:
        return [0.0] * len(F.FEATURES)
    total = sum(h[1] for h in hits)
    exact, stem, near = (sum(h[1] for h in hits if h[0] == k) for k in (1, 2, 3))
    out = [math.log1p(exact + 0.8 * near), math.log1p(stem), math.log1p(near)]
    out += [sum(h[1] for h in hits if h[j]) / total for j in (2, 3, 4)]
    return [*out, min(1.0, 20 * total / len(words)), max(h[1] for h in hits)]


def test_features_by_brute_force(spark):
    rng = random.Random(6)
    trie = toxicity.Trie(["idiot", "scum", "worthless", "clown"], ["vequo", "zzz"], [1.0, 0.5, 1.0, 0.0, 1.0, 1.0])
    forms = "idiot idot idoit scum scm scam worthless wrthles wortless clown clwn vequoia veqoia vequ zzztop zztop 1d10t a fine day said you “ ” \"".split()
    texts = [" ".join(rng.choices(forms, k=rng.randrange(12))) for _ in range(400)] + [None, ""]
    matcher = toxicity.Matcher(trie)
    for t in texts:
        assert all(abs(a - b) < 1e-9 for a, b in zip(matcher.features(t), plain_features(trie, t), strict=True)), t


def corpus(seed, n):
    """Texts with a label and a kind: plain, misspelled and quoted toxic terms, clean ones, and ones that quote a term to report it."""
    rng = random.Random(seed)
    common = ["".join(random.Random(i).choices("abcdefghilmnoprstu", k=random.Random(i).randrange(3, 9))) for i in range(800)]
    terms = ["".join(random.Random(10_000 + i).choices("jkqvwxyzmnoprst", k=8)) for i in range(20)]
    text = lambda *more: " ".join([*rng.choices(common, k=40), *more, *rng.choices(common, k=10)])

    def bent(t):
        k = rng.randrange(1, 3)
        return rng.choice([t[:k] + t[k + 1 :], t[:k] + rng.choice("abcdef") + t[k:], t[:k] + t[k + 1] + t[k] + t[k + 2 :]])

    out = []
    for _ in range(n):
        t, kind = rng.choice(terms), rng.choice(["plain", "bent", "report", "clean", "clean", "clean"])
        words = {"plain": ("you", t, "you", t), "bent": ("you", bent(t), "you", bent(t)), "report": ("he", "said", f'"you {t}"', "and", "wrote", f'"{t}"'), "clean": rng.choice([(), ("you",), ("he", "said"), ('"', "and", '"', "wrote")])}[kind]
        out.append((text(*words), kind in ("plain", "bent"), kind))
    return out


def test_automata_and_context_earn_their_place(spark):
    import numpy as np

    rows = spark.createDataFrame(corpus(1, 1500), "text string, toxic boolean, kind string")
    held = corpus(2, 600)
    trie = toxicity.lexicon(rows.select("text", "toxic"), odds=2.0)
    trie = toxicity.Trie(trie.terms, trie.stems, toxicity.trust(rows.select("text", "toxic"), trie))
    matcher = toxicity.Matcher(trie)
    x, y = np.array([matcher.features(t) for t, *_ in corpus(1, 1500)]), np.array([float(b) for _, b, _ in corpus(1, 1500)])
    z, truth, kinds = np.array([matcher.features(t) for t, *_ in held]), np.array([b for _, b, _ in held]), np.array([k for *_, k in held])

    def right(without):
        keep = [i for i, f in enumerate(toxicity.FEATURES) if f not in without]
        a, b = x[:, keep].copy(), z[:, keep].copy()
        if "near" in without:  # no misspelled form is seen at all
            a[x[:, 2] > 0], b[z[:, 2] > 0] = 0, 0
        w = toxicity.fit(a, y)
        said = b @ w[:-1] + w[-1] >= 0
        return {k: float((said == truth)[kinds == k].mean()) for k in ("plain", "bent", "report", "clean")}

    full, exact_only, no_context = right(()), right(("near",)), right(("quoted", "said", "addressed"))
    print(full, exact_only, no_context)
    assert min(full.values()) >= 0.95
    assert exact_only["bent"] <= full["bent"] - 0.4 and min(no_context["report"], no_context["plain"]) <= min(full["report"], full["plain"]) - 0.2


def test_misspelled_learned_terms(spark):
    m = toxicity.Matcher(toxicity.Trie(["idiot"], ["vequot"]))
    assert m.features("veqoutte")[2] > 0 and m.features("vexotte")[2] == 0
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    terms = ["zq" + "".join(rng.choices("mnoprstuv", k=6)) for _ in range(20)]  # each in one toxic row of twenty
    text = lambda *more: " ".join(rng.choices(words, k=30) + list(more))
    train = [(i, text(*[terms[i // 3 % 20]] * 2 if i % 3 == 0 else [])) for i in range(900)]
    swapped = [(1000 + k, text(*[t[:4] + t[5] + t[4] + t[6:]] * 2)) for k, t in enumerate(terms) if t[4] != t[5]]
    plain = [(2000 + k, text()) for k in range(20)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in train], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(spark, spark.createDataFrame(train + swapped + plain, "doc_id long, text string"), labels).collect()}
    assert sum(got[i] for i, _ in swapped) >= 0.9 * len(swapped) and sum(got[i] for i, _ in plain) == 0


def test_misspelled_forms_count_by_their_rows(spark):
    trie = toxicity.Trie(["idiot", "moron"], [])
    rows = [(f"a{i} b{i} c{i} idoit", True) for i in range(4)] + [(f"d{i} e{i} f{i} maron", False) for i in range(4)]
    assert toxicity.trust(spark.createDataFrame(rows, "text string, toxic boolean"), trie) == [1.0, 0.0]
