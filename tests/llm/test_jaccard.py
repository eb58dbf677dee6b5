import random
import re

import pytest

from tidewake.llm import jaccard, skew


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(s), find(k)) for k, s in sets}


def corpus(seed, n):
    """Copies, near copies of every degree, common passages, and texts of their own."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(400))
    passage, rows = [word() for _ in range(30)], []
    bases = [[word() for _ in range(rng.choice([3, 5, 20, 60, 150]))] for _ in range(8)]
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.3:
            words = [word() for _ in range(rng.choice([2, 12, 40]))] + passage * (rng.random() < 0.8)
        rows.append((i * 3 + 1, rng.choice([" ", "\n"]).join(words).replace("a", rng.choice("aA"))))
    return rows


@pytest.mark.parametrize("seed,frequent,pivots,hot", [(1, 16, 1, 256), (2, 3, 0.1, 4), (3, 2, 0.02, 16)])
def test_components_equal_brute_force(spark, monkeypatch, seed, frequent, pivots, hot):
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", frequent)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    rows = corpus(seed, 220)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute(rows)


def test_odd_tables(spark):
    schema = "doc_id long, text string, component_id string, n int"
    df = spark.createDataFrame([(1, "a b c d e", "x", 1), (1, "a b c d e", "x", 1), (2, "A  b\tc d e", "x", 1), (3, None, "x", 1), (4, " \n", "x", 1), (None, "a b c d e", "x", 1), (5, "a b", "x", 1)], schema)
    got = sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (None, 2, None), (5, 1, 5)], key=str)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "None"]
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def near_by_hand(rows, n=5, percent=80):
    """Keys that a pairwise comparison of all texts leaves: the least of each group of links."""
    sets = []
    for k, t in rows:
        w = (t or "").lower().split()
        sets.append((k, {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()))
    root = {k: k for k, _ in rows}
    for _ in rows:
        before = dict(root)
        for i, (a, s) in enumerate(sets):
            for b, t in sets[:i]:
                if s and t and 100 * len(s & t) >= percent * len(s | t):
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return sorted(k for k, r in root.items() if k == r)


def test_pipeline_stage_joins_at_five_words_and_eighty_percent(spark, monkeypatch):
    import corpus_pipeline

    base = [f"w{i}" for i in range(100)]
    near = [("x" + w if i in (30, 60) else w) for i, w in enumerate(base)]
    rows = [(9001, " ".join(base)), (9002, " ".join(near)), *corpus(7, 150)]
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert got == near_by_hand(rows) and 9001 in got and 9002 not in got


def test_template_pages(spark):
    """Pages of a common template and one of many passages: each posting of the template holds all of them."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    template = [word() for _ in range(100)]
    passages = [[word() for _ in range(100)] for _ in range(20)]
    rows = []
    for i in range(400):
        own = list(passages[i % 20])
        own[rng.randrange(100)] = word()
        rows.append((i, " ".join(template + own + [word()])))
    join = jaccard.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"))
    _, nodes, components = join.run()
    assert len(join.rounds) <= 10
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(join.docs.toDF("doc_id", "text")).collect()}
    assert got == {k: v[1] for k, v in brute(rows).items()}
