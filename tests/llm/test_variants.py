import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, documents

from lociframe.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, misspelt=199):
    out = Counter()
    for key, text in rows:
        for w in RUN.findall(text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if misspelt and h % misspelt == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= 5}


def one_error(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_variants(counts, times=5):
    out, form = {}, {}
    for w in counts:
        near = [v for v in counts if one_error(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= times * counts[w]:
            form[w] = best
        out[w] = [counts[w], len(near)]
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, *out[w], counts[form[w]] if w in form else None)
    return out


def made(seed, n, letters="abé", sizes=(6, 9)):
    r = random.Random(seed)
    stems = ["".join(r.choice(letters) for _ in range(r.randint(*sizes))) for _ in range(n)]
    stems += [s[:i] + c + s[i + j :] for s in stems[: n // 2] for i in (0, len(s) // 2, len(s)) for c, j in (("a", 0), ("b", 1), ("", 1))]
    return {s: r.choice((5, 6, 25, 30, 125, 130, 700)) for s in stems if len(s) >= 6}


def as_rows(got):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()}


@pytest.mark.parametrize("group", [2, 16, 4096])
def test_variants_equal_brute_force(spark, group):
    counts = made(1, 120) | made(2, 60, "aab", (6, 7)) | {"q" * 300: 50, "q" * 299: 5, "q" * 150 + "r" + "q" * 149: 5, "ÿ" * 6: 5, "ÿ" * 7: 25, "alone×÷": 9}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert as_rows(variants.spelling_variants(words, group=group)) == brute_variants(counts)


def test_groups_stay_small(spark):
    r = random.Random(4)
    words = list({"".join(r.choice("abc") for _ in range(8)) for _ in range(900)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    sizes = variants.grouped(df, 10).groupBy(*variants._GROUP).count().collect()
    assert all(r["count"] <= 10 or r["b"] - r["a"] == 1 for r in sizes)
    # A stretch of one letter: words of one or two letters there, of an alphabet of three.
    assert max(r["count"] for r in sizes) <= 3 + 9


def test_rows_that_come_in_small_batches_give_the_same(spark):
    counts = made(3, 150)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, rows = spark.conf.get(name), variants.ROWS
    try:
        variants.ROWS = 7
        spark.conf.set(name, "3")
        assert as_rows(variants.spelling_variants(words)) == brute_variants(counts)
    finally:
        variants.ROWS = rows
        spark.conf.set(name, before)


def test_words_and_their_hashes(spark):
    r = random.Random(5)
    pool = ["Banana", "banané", "caféteria", "À×÷ÿxyz", "Straßen", "short", "w" * 70, "Ānotletters", "mixed1digits", "\U0001f600smiley"]
    rows = [*AWKWARD, (None, "a null key banana " * 6)] + [(i, " ".join(r.choice(pool) for _ in range(60))) for i in range(80)] + [(7, "banana" * 3)] * 5
    df = documents(spark, rows, extra=True)
    for misspelt in (199, 3, 0):
        got = {r["word"]: r["n"] for r in variants.word_counts(df, misspelt=misspelt).collect()}
        assert got == brute_counts(rows, misspelt)
    counts = brute_counts(rows, 3)
    assert as_rows(variants.spelling_variants(variants.word_counts(df, misspelt=3))) == brute_variants(counts)


def test_hash_goes_on_from_its_state():
    words = [b"", b"a", b"abc", b"x" * 64, b"y" * 65, b"z" * 1000]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    state = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(words))], np.uint32)
    assert variants.run_hashes(data, starts, ends, state).tolist() == [zlib.crc32(f"{i}:".encode() + w) for i, w in enumerate(words)]


def test_roots_of_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("x", "w3"), ("y", "z")]
    got = {r["word"]: r["root"] for r in variants.rooted(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{i}": "w13" for i in range(13)} | {"x": "w13", "y": "z"}


def test_no_words(spark):
    for rows in ([], [(1, None), (2, ""), (3, "few")]):
        assert variants.spelling_variants(variants.word_counts(documents(spark, rows))).count() == 0
