import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidewake.llm import decontaminate, licenses, quality, textcore, tokenfiles, toxicity, urlfilter


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n)]


def smith_waterman(a, b):
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0.0, h[i][j] + (1.0 if x == y else -0.4), h[i][j + 1] - 0.4, h[i + 1][j] - 0.4)
    return max(map(max, h))


def test_alignment_scores_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(40):
        a, b = rng.integers(0, 6, rng.integers(1, 14)).astype(np.uint64), rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64)
        score, begin, end = decontaminate.align(a, b)
        assert score == pytest.approx(smith_waterman(a.tolist(), b.tolist()))
        assert smith_waterman(a.tolist(), b[begin:end].tolist()) == pytest.approx(score)


def test_leaks_whole_edited_and_none(spark):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, 30))) for i in range(12)] + [(90, "only three words"), (91, None), (92, "")]
    edited = items[1][1].split()
    for k in (3, 11, 19, 26):
        edited[k] = "zzz"
    around = lambda t: " ".join(words(rng, 50)) + ". " + t + "! " + " ".join(words(rng, 50))
    docs = [(1, around(items[0][1].upper())), (2, around(" ".join(edited))), (3, around("")), (4, None), (5, ""), (1, around(items[2][1])), (6, around(" ".join(items[3][1].split()[:8]))), (7, "Only, three; words")]
    d = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items + [items[0]], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.leaks(d, b).collect()}
    assert set(got) == {(1, 0), (2, 1), (1, 2), (7, 90)} and got[1, 0] == 1.0 and 0.9 > got[2, 1] >= 0.5
    clean = decontaminate.clean_documents(d, b)
    assert clean.columns == d.columns and sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 5, 6]
    assert decontaminate.leaks(d.limit(0), b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0


def test_leaks_edited_often_equal_brute_force(spark):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, n) + ["the", "of", "the"])) for i, n in enumerate([6, 14, 27, 27, 40, 40, 55])]
    docs = []
    for i, t in items:
        for share in (0.2, 0.25, 0.3, 0.35):
            w = [rng.choice(["the", "zz", "of"]) if rng.random() < share else x for x in t.split()]
            docs.append(" ".join(words(rng, 60) + w + words(rng, 60)))
        w = t.split()
        docs += [" ".join(x if k % 4 else "zzz" for k, x in enumerate(w)), " ".join(x if k % 3 else "zzz" for k, x in enumerate(w)), " yy ".join(w), " ".join(rng.sample(w, len(w)))]
    docs.append(items[2][1] + " the of " + items[2][1])
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.leaks(d, b).collect()}
    want = {(k, i): smith_waterman(t.split(), x.split()) / len(t.split()) for k, x in enumerate(docs) for i, t in items}
    want = {k: v for k, v in want.items() if v >= 0.5 - 1e-12}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 30


def licence_windows(text):
    """Per licence the best (dice, first word, words) of all windows that begin at a template's bigram."""
    words = re.sub(r"[\W_]+", " ", text.lower()).strip().split(" ")
    best = {}
    for name, template in licenses.TEMPLATES:
        grams, long = set(licenses.template_bigrams(template)), len(licenses.template_words(template))
        for at in range(len(words) - 1):
            window = words[at : at + long]
            own = set(zip(window, window[1:]))
            dice = 2 * len({f"{a} {b}" for a, b in own} & grams) / (len(own) + len(grams))
            if dice >= 0.8 and " ".join(words[at : at + 2]) in grams:
                best[name] = max(best.get(name, (0, 0, 0)), (dice, -at, len(window)))
    return {(name, round(d, 6), -at, n) for name, (d, at, n) in best.items()}


def test_license_scan(spark):
    rng = random.Random(11)
    mit = licenses.TEMPLATES[-2][1].split()
    wrapped = "\n * ".join(" ".join(mit[i : i + 9]) for i in range(0, len(mit), 9))
    edited = " ".join("changed" if rng.random() < 0.08 else w for w in mit)
    gpl = dict((n, t) for n, t in licenses.TEMPLATES if n == "GPL-3.0")["GPL-3.0"]
    texts = [
        (1, "x y\nReleased under the MIT License.\nfoo"),
        (2, "This work is licensed under the GNU General Public License version 3"),
        (3, "nothing here at all"), (4, None), (5, ""), (None, "Licensed under CC BY-NC 4.0."), (1, "x y\nReleased under the MIT License.\nfoo"),
        (6, " ".join(["filler"] * 200) + ". Released under the MIT License. " + " ".join(["filler"] * 200)),
        (7, "Copyright 2020 X. " + " ".join(words(rng, 14)) + " Released under the MIT License. All rights reserved. " + " ".join(words(rng, 12))),
        (8, "/*\n * " + wrapped + "\n */ int main"), (9, " ".join(words(rng, 30)) + " " + edited), (10, "the of in under " * 60),
        (11, " ".join(words(rng, 9)) + " " + gpl.replace("; ", ";\n") + " " + gpl), (12, " ".join(words(rng, 60_000)) + " licensed under CC BY-NC 4.0"),
    ]
    df = spark.createDataFrame([(k, t, "c", 1) for k, t in texts], "doc_id long, text string, license string, dice int")
    got = sorted(((r["doc_id"], r["license"], round(r["dice"], 6), r["first_word"], r["n_words"]) for r in licenses.license_matches(df).collect()), key=str)
    assert got == sorted(((k, *found) for k, t in texts if t for found in licence_windows(t)), key=str)
    assert {(k, name) for k, name, *_ in got} == {(1, "MIT"), (2, "GPL-3.0"), (None, "CC-BY-NC-4.0"), (6, "MIT"), (7, "MIT"), (8, "MIT"), (9, "MIT"), (11, "GPL-3.0"), (11, "LGPL-2.1"), (12, "CC-BY-NC-4.0")}
    assert sum(k == 1 for k, *_ in got) == 2
    assert licenses.license_matches(df.limit(0)).count() == 0
    for _, text in licenses.TEMPLATES:
        grams = licenses.template_bigrams(text)
        anchors = set(licenses.anchor_words(grams))
        assert sum(not set(g.split(" ")) & anchors for g in grams) < licenses.needed(len(grams))


def test_url_rules_and_links(spark):
    link = '<a href="http://bad.example.com/en/1">x</a>'
    pages = [(1, "http://A.com/x?q"), (2, "https://b.example.com/en/1"), (3, "http://www.example.com/en/2"), (4, "http://x.net/es/1"), (5, "http://x.net/de/1"), (6, None), (7, "no scheme"), (8, "http://s.org"), (9, "http://bad.example.com/en/1")]
    df = spark.createDataFrame([(k, u, link if k == 8 else None, "c") for k, u in pages], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(df).collect()}
    assert got == {
        1: ("a.com", "/x", "com/", "allow"), 2: ("b.example.com", "/en/1", "example.com/en/", "block"), 3: ("www.example.com", "/en/2", "www.example.com/en/", "allow"), 4: ("x.net", "/es/1", "net/es/", "block"),
        5: ("x.net", "/de/1", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("s.org", "", None, "block"), 9: ("bad.example.com", "/en/1", "example.com/en/", "block"),
    }
    assert urlfilter.judge_urls(df.limit(0)).count() == 0


def test_pagerank_equals_power_iteration(spark):
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 2.0)]
    work = urlfilter.Workspace(spark, "test")
    got = {r["host"]: r["score"] for r in urlfilter.spread(spark.createDataFrame(edges, "src string, dst string, links double"), spark.createDataFrame([("a", 1.0)], "host string, seed double"), work, "t", rounds=12).collect()}
    rank = {"a": 1.0}
    for _ in range(12):
        new = {}
        for s, t, n in edges:
            new[t] = new.get(t, 0) + 0.85 * rank.get(s, 0) * n / sum(e[2] for e in edges if e[0] == s)
        new["a"] = new.get("a", 0) + 1 - sum(new.values())
        rank = new
    assert all(got.get(h, 0) == pytest.approx(v, abs=1e-8) for h, v in rank.items())


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    data = tokenfiles.dump_index(keys, np.arange(len(keys)), np.arange(len(keys)) * 2, np.ones(len(keys)))
    rows, known = tokenfiles.search_index(data, keys)
    assert known.all() and (rows["shard"] == np.arange(len(keys))).all()
    slots = tokenfiles.PerfectHash.load(data, 16)[0].slots(keys)
    assert sorted(slots) == list(range(len(keys)))
    assert tokenfiles.search_index(data, keys + np.uint64(1))[1].mean() < 0.01


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SHARD_BYTES", 300)
    monkeypatch.setattr(tokenfiles, "BUCKET_KEYS", 7)
    rng = random.Random(2)
    rows = [(rng.randrange(-50, 500), " ".join(words(rng, rng.randrange(0, 30)))) for _ in range(80)] + [(7, "same"), (7, "same"), (8, None), (9, ""), (None, "no key")]
    df = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id long, text string, shard string")
    path = P.path("word_bpe_49k.json")
    got = sorted(map(tuple, tokenfiles.token_files(df, path).collect()), key=lambda r: r[1])
    whole = Tokenizer.from_file(path)
    ids = [(k, whole.encode(t or "", add_special_tokens=False).ids + [1]) for k, t in rows]
    want = sorted((k is not None, k or 0, zlib.crc32(np.array(x, "<u4").tobytes()), len(x)) for k, x in ids)
    assert sorted((k is not None, k or 0, c, n) for k, _, n, c in got) == want
    at = 0
    for key, start, n, _ in got:
        assert start == at
        at += n
    keys = [(k is not None, k or 0) for k, *_ in got]
    assert keys == sorted(keys)
    assert tokenfiles.token_files(df.limit(0), path).count() == 0


def test_kernel_equals_brute_force():
    def weight(a, b):
        from itertools import combinations

        total = 0.0
        for i in combinations(range(len(a)), 3):
            for j in combinations(range(len(b)), 3):
                if all(a[x] == b[y] for x, y in zip(i, j)):
                    total += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
        return total

    names = ["idiot", "idxiot", "abc", "stupid", "aabbaab", "ti"]
    got = toxicity.kernel(toxicity.codes(names), toxicity.codes(names))
    assert np.allclose(got, [[weight(a, b) for b in names] for a in names], rtol=1e-4)
    assert np.allclose(toxicity.own_weight(toxicity.codes(names))[:5], [weight(a, a) for a in names[:5]], rtol=1e-4)


def labelled(rng, n):
    bad = ["idiot", "stupid", "worthless", "moron"]
    rows = []
    for i in range(n):
        text, toxic = words(rng, 60), i % 4 == 0
        for w in rng.sample(bad, 2) if toxic else []:
            text.insert(rng.randrange(len(text)), w)
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_toxicity_is_learnt_and_tolerates_gaps(spark):
    rng = random.Random(6)
    rows = labelled(rng, 240)
    docs = spark.createDataFrame([(k, t, "c") for k, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k % 3], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs, model).collect()}
    held = [(got[k] >= 0.7) == bool(y) for k, _, y in rows if k % 3 == 0]
    assert sum(held) >= 0.95 * len(held)
    plain = " ".join(words(rng, 40))
    odd = [(1, plain + " st.up-id idixot " + plain), (2, plain + " m o r o n i d i o t " + plain), (3, plain), (4, None), (5, ""), (None, plain), (1, plain)]
    scores = [(r["doc_id"], r["score"]) for r in toxicity.score_texts(spark.createDataFrame(odd, "doc_id long, text string").coalesce(1), model).collect()]
    assert scores[0][1] > 0.5 and scores[1][1] > 0.5 and all(s < 0.5 for _, s in scores[2:])
    assert toxicity.score_texts(docs.limit(0), model).count() == 0
    assert toxicity.score_texts(docs, toxicity.train(docs, labels.limit(0))).filter("score >= 0.7").count() == 0


def test_machine_with_all_landmarks_is_the_exact_kernel_machine():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcde", k=rng.randrange(4, 7))) for _ in range(25)]
    texts = [" ".join(rng.sample(vocabulary, 4) + ["stupid"] * (i % 3 == 0)) for i in range(24)]
    labels = [int(i % 3 == 0) for i in range(24)]
    sentences = toxicity.Sentences.of_texts([t.encode() for t in texts], labels)
    model = toxicity.train_machine(sentences, ridge=1e-2, count=10_000)
    got = [sum(model.of_words(sorted(set(t.split())))) + model.bias for t in texts]
    # The same machine in its own kernel matrix, made word pair by word pair: a from (K, bias) by Newton steps.
    names = sorted({w for t in texts for w in t.split()})
    between = toxicity.word_kernel(toxicity.codes(names), toxicity.codes(names)).astype(float)
    rows = [[names.index(w) for w in sorted(set(t.split()))] for t in texts]
    k = np.array([[between[np.ix_(a, b)].sum() for b in rows] for a in rows])
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    bad = y > 0
    weight = np.where(bad, 1 / bad.sum(), 1 / (~bad).sum())
    alpha, bias = np.zeros(24), 0.0
    for _ in range(200):
        active = weight * (1 - y * (k @ alpha + bias) > 0)
        left = np.block([[active[:, None] * k + 1e-2 * np.eye(24), active[:, None]], [(active @ k)[None], np.array([[active.sum()]])]])
        alpha_bias = np.linalg.lstsq(left, np.append(active * y, active @ y), rcond=None)[0]
        alpha, bias = alpha_bias[:-1], alpha_bias[-1]
    assert np.allclose(got, k @ alpha + bias, atol=2e-2)


def test_quality_is_learnt_from_positives_alone(spark):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        w = words(rng, 80)
        junk = i % 5 == 0
        rows.append((i, " ".join(x + "***" if junk and rng.random() < 0.6 else x for x in w), not junk))
    df = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(1000, None), (1001, ""), (None, "a b")], "doc_id long, text string")
    table = quality.feature_table(df, ("doc_id",)).cache()
    known = spark.createDataFrame([(k,) for k, _, good in rows if good and k % 2], "doc_id long")
    net, prior = quality.fit(table, known)
    assert 0.65 < prior < 0.95
    got = {r["doc_id"]: r["score"] for r in quality.score_table(table, net, ("doc_id",)).collect()}
    right = [(got[k] >= 0.7) == good for k, _, good in rows if not k % 2]
    assert sum(right) >= 0.95 * len(right) and len(got) == 603 and all(0 <= s <= 1 for s in got.values())
    assert quality.fit(table, known.limit(0))[0] is None


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    text = ("Ab é cd  " * 400 + "x" * 90 + "\tab").encode()
    whole = textcore.word_hashes(np.frombuffer(text, np.uint8))
    monkeypatch.setattr(textcore, "SEGMENT", 64)
    assert (textcore.word_hashes(np.frombuffer(text, np.uint8)) == whole).all() and whole[0] == whole[-1] != whole[2]


def test_the_toxicity_model_is_fitted_outside_the_driver(spark, monkeypatch):
    """The driver of the pipeline went over its memory with the sample and its kernels."""
    import os

    monkeypatch.setattr(toxicity, "fit", lambda rows: (os.getpid(), len(rows)))
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    pid, n = toxicity.train(docs, docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic"))
    assert n == 6 and pid != os.getpid()
