import hashlib
import random

import pytest

from tidewake.llm import mixing


def targets_by_rounds(sizes):
    """Shares by weight, the excess over three times a source's size dealt again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in full]
        rest = total - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[t] for t in left) for s in left}
        above = [s for s in left if share[s] > 3 * sizes[s]]
        if not above:
            return full | share
        full |= {s: 3.0 * sizes[s] for s in above}


@pytest.mark.parametrize("seed", range(6))
def test_targets_are_shared_until_none_is_above(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 3, 50, 1000, 9000]) for s in ["a", "b", "src10", "src2", None, "ü"][: 2 + seed % 5]}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = targets_by_rounds(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def mix_by_hand(rows):
    sizes = {}
    for _, source, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    target, tokens, due = targets_by_rounds(sizes), {}, []
    order = sorted(rows, key=lambda r: (hashlib.md5(f"mix/{r[0]}".encode()).hexdigest(), r[0], r[2]))
    for key, source, size in order:
        tokens[source] = tokens.get(source, 0) + size
        if size and target[source]:
            due += [((tokens[source] + k * sizes[source]) / target[source], source is None, source or "", hashlib.md5(f"mix/{key}".encode()).hexdigest(), key, size) for k in range(3)]
    taken, used = {}, 0
    for d in sorted(due):
        used += d[5]
        if used > sum(sizes.values()):
            break
        taken[d[4]] = taken.get(d[4], 0) + 1
    return taken, target


def test_mix_equals_the_queue_worked_by_hand(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "a", "b", "c", None]), rng.choice([0, 1, 5, 40, 300])) for i in range(400)]
    df = spark.createDataFrame([(i, s, "w " * n if n else None, "clash") for i, s, n in rows], "doc_id long, source string, text string, size string")
    got = mixing.mix(df).collect()
    taken, target = mix_by_hand(rows)
    assert {r["key"]: r["rounds"] for r in got if r["rounds"]} == taken
    for source in target:
        words = sum(r["size"] * r["rounds"] for r in got if r["source"] == source)
        assert abs(words - target[source]) <= 300
    assert max(r["rounds"] for r in got) <= 3
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(taken.values())


def test_odd_tables(spark):
    schema = "doc_id long, source string, text string, lang string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, None, "a b", "x"), (1, "s", "a b", "x"), (1, "s", "a b", "x"), (2, "s", None, None)], schema)
    got = mixing.mix(df).collect()
    assert len(got) == 4 and sum(r["size"] * r["rounds"] for r in got) <= 6
    assert mixing.mixed_documents(df).filter("text IS NULL").count() == 0


@pytest.mark.parametrize("sizes", [[("a", 50)], [("a", 1000), ("a", 1)], [("a", 1), ("a", 1000), ("b", 2)], [("a", 7), ("b", 7)]])
def test_tables_that_one_document_dominates(spark, sizes):
    rows = [(i, s, n) for i, (s, n) in enumerate(sizes)]
    df = spark.createDataFrame([(i, s, "w " * n) for i, s, n in rows], "doc_id long, source string, text string")
    got = {r["key"]: r["rounds"] for r in mixing.mix(df).collect() if r["rounds"]}
    assert got == mix_by_hand(rows)[0] and sum(n * got.get(i, 0) for i, _, n in rows) <= sum(n for *_, n in rows)


@pytest.mark.parametrize("seed", range(4))
def test_a_dominant_document_does_not_lift_the_budget(spark, monkeypatch, seed):
    """One document as large as its source's neighbours together; the cut may lie in any round."""
    monkeypatch.setattr(mixing, "EDGE_ROWS", 1)
    rng = random.Random(seed)
    rows = [(0, "a", 300)] + [(i, "b", 1) for i in range(1, 101)] if seed == 0 else [(i, rng.choice("abc"), rng.choice([1, 7, 2000])) for i in range(rng.choice([1, 2, 9, 40]))]
    if seed == 0:
        rows = [(i, {"a": "a", "b": "c"}[s], n) for i, s, n in rows] + [(500, "b", 0)]
    df = spark.createDataFrame([(i, s, "w " * n) for i, s, n in rows], "doc_id long, source string, text string")
    taken, _ = mix_by_hand(rows)
    got = {r["key"]: r["rounds"] for r in mixing.mix(df).collect()}
    assert {k: n for k, n in got.items() if n} == taken
    assert sum(got[k] * n for k, _, n in rows) <= sum(n for _, _, n in rows)


def test_the_mix_stands_in_the_order_of_finish_times(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("aab"), rng.choice([1, 5, 9])) for i in range(300)]
    df = spark.createDataFrame([(i, s, "w " * n, "x") for i, s, n in rows] + [(None, "a", "v w", "x"), (None, "a", "v u", "x")], "doc_id long, source string, text string, due string")
    due = {(r["key"], k): r["due"] + k * r["lap"] for r in mixing.mix(df).collect() if r["key"] is not None for k in range(3)}
    mixed, seen, times = mixing.mixed_documents(df), {}, []
    assert mixed.columns == df.columns
    for r in mixed.collect():
        if r["doc_id"] is not None:
            times.append(due[r["doc_id"], seen.get(r["doc_id"], 0)])
            seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert times == sorted(times) and len(times) > 100
