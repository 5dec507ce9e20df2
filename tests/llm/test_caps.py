"""Behaviour at places where a cap or a switch would show."""

import random

import numpy as np
import pytest
from helpers import documents, prose
from pyspark.sql import functions as F

from lociframe.llm import html, minhash, mixing, toxicity
from test_operators import brute_components, shingle_set


def template_pairs(seed, pairs=150, common=873, shared=24, own=100):
    """Documents with a common template, in pairs that share some words more: linked within pairs, not between them."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(10**9)}"
    template = [word() for _ in range(common)]
    rows = []
    for p in range(pairs):
        both = [word() for _ in range(shared)]
        for k in range(2):
            rows.append((2 * p + k, " ".join(template + both + [word() for _ in range(own)])))
    return rows


def similarity(a, b, k):
    x, y = shingle_set(a, k), shingle_set(b, k)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize(("seed", "k"), [(1, 4), (2, 4), (3, 5)])
def test_pairs_in_a_crowd_of_similar_documents(spark, seed, k):
    rows = template_pairs(seed)
    assert similarity(rows[0][1], rows[2][1], k) < 0.8 <= similarity(rows[0][1], rows[1][1], k)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, rows), words=k).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


@pytest.mark.parametrize("seed", [4, 5])
def test_random_groups_of_similar_documents(spark, seed):
    r = random.Random(seed)
    rows = []
    for g in range(6):
        base = prose(seed * 100 + g, r.randint(80, 200)).split()
        for i in range(25):
            own = list(base)
            for _ in range(r.randint(0, 9)):
                own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(own + [f"y{r.randrange(10**6)}" for _ in range(r.randint(0, 12))])))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(documents(spark, rows), words=4).collect()}
    assert got == brute_components(rows, 4)


def test_joined_disguises_of_any_length_are_read(spark):
    rows = [(i, prose(i, 60) + (" you are an idiot and moron" if i % 4 == 0 else " you are an alpha and omega")) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    model = toxicity.train(documents(spark, rows), labels)
    for n in (0, 27, 28):
        word = "y0uar3anidi0t" + "alphabetagammadeltaepsilonzeta"[:n]
        assert len(word) == 13 + n
        got = toxicity.with_evidence(documents(spark, [(1, word), (2, word.replace("idi0t", "kapp0"))]), model, ["doc_id"], "text").collect()
        assert {r["doc_id"]: r["e2"] >= 1 for r in got} == {1: True, 2: False}


def test_long_pages_train(spark):
    body = [f"{prose(10 + j, 60)}." for j in range(600)]
    page = "<html><body><x-1>" + "".join(f"<x-9>{prose(5000 + j, 3)}</x-9>" for j in range(400)) + "</x-1><x-1>" + "".join(f"<x-2>{t}</x-2>" for t in body) + "</x-1></body></html>"
    assert len(page) > 200_000
    texts = spark.createDataFrame([(t,) for t in body], "text string")
    df = spark.createDataFrame([(1, page), (2, "<p>short</p>")], "page_id long, html string")
    fitted, prior = html.train(df, texts), html.prior()
    assert any((a != b).any() for a, b in zip(fitted, prior))
    got = html.contents([page], fitted)[0]
    assert sum(t in got for t in body) > 0.95 * len(body)
    # Beyond the bound on characters a page is passed over, and the rest still serve.
    assert all((a == b).all() for a, b in zip(html.train(df, texts, chars=1000), prior))


def test_labels_beyond_twelve_thousand_are_learnt(spark):
    """Four toxic rows of the last ones by the hash of their id have a word of their own."""
    n = 12_100
    order = [r["doc_id"] for r in spark.range(n).toDF("doc_id").orderBy(F.xxhash64("doc_id").desc()).limit(4).collect()]
    bad = set(order) | set(range(0, n, 50))
    rows = [(i, f"alpha beta w{i % 97} " + ("zorgon" if i in order else "idiot" if i in bad else "omega")) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i in bad)) for i in range(n)], "doc_id long, toxic int")
    model = toxicity.train(documents(spark, rows), labels)
    got = {r["doc_id"]: r["e2"] for r in toxicity.with_evidence(documents(spark, [(1, "a zorgon"), (2, "an idiot"), (3, "an omega")]), model, ["doc_id"], "text").collect()}
    assert got[1] >= 1 and got[2] >= 1 and got[3] == 0


def test_calibration_in_passes_is_ridge_regression(spark):
    r = random.Random(5)
    rows = [(int(r.random() < 0.3 + 0.1 * k), float(k), float(k % 3)) for k in (r.randrange(6) for _ in range(400))]
    seen = spark.createDataFrame(rows, "toxic int, e0 double, e1 double").groupBy("toxic", "e0", "e1").count()
    w = toxicity.fit_logistic(seen, ["e0", "e1"], 400)
    x, y = np.array([(1, a, b) for _, a, b in rows]), np.array([t for t, *_ in rows])
    assert np.allclose(x.T @ (y - 1 / (1 + np.exp(-x @ w))), 1e-2 * 4 * w, atol=1e-5)
    low = spark.createDataFrame([(t, -a, b) for t, a, b in rows], "toxic int, e0 double, e1 double").groupBy("toxic", "e0", "e1").count()
    assert (toxicity.fit_increasing(low, ["e0", "e1"], 400)[1:] >= 0).all()


def test_calibration_of_apart_classes_stays_finite(spark):
    rows = [(0, 0.0, 0.0, 23_000), (0, 2.0, 1.0, 30), (1, 6.0, 20.0, 2_700), (1, 6.0, 11.0, 40), (1, 0.0, 0.0, 80)]
    seen = spark.createDataFrame(rows, "toxic int, e0 double, e1 double, count long")
    w = toxicity.fit_increasing(seen, ["e0", "e1"], sum(r[3] for r in rows))
    assert np.isfinite(w).all() and w[0] < 0 < w[0] + 6 * w[1] + 20 * w[2]


def test_domains_beyond_twelve_thousand_labels_are_learnt(spark):
    """A domain whose labels are the last ones by the hash of their id."""
    n = 12_200
    last = {r["doc_id"] for r in spark.range(n).toDF("doc_id").orderBy(F.xxhash64("doc_id").desc()).limit(200).collect()}
    rows = [(i, f"alpha w{i % 7} " + ("zorgon # # #" if i in last else "beta gamma" if i % 2 else "omega psi")) for i in range(n)]
    labels = spark.createDataFrame([(i, "rare" if i in last else "odd" if i % 2 else "even") for i in range(n)], "doc_id long, d string")
    model = mixing.train(documents(spark, rows), labels, F.col("d"))
    assert model.domains == ["even", "odd", "rare"]
    rates = mixing._featured(documents(spark, [(1, "alpha w1 beta gamma"), (2, "alpha w2 omega psi"), (3, "alpha w3 zorgon # # #")]), ["doc_id"], "text", model).collect()
    assert {r["doc_id"]: model.domains[int(np.argmax(r["x"]))] for r in rates} == {1: "odd", 2: "even", 3: "rare"}
