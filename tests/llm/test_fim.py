import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, documents, prose
from hypothesis import given, settings, strategies as st

from lociframe.llm import fim
from lociframe.llm.text import raw_chunks

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(key, text):
    t = text or ""
    u = UNIT.findall(t)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(u)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (n, "plain", None, None, t)
    if h[3] % 100 < 20:
        return (n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB 1.é€\U0001f600\n<", max_size=40), max_size=6), st.integers(1, 9))
def test_every_cut_of_every_text(texts, block):
    before, fim.BLOCK = fim.BLOCK, block
    try:
        for c in raw_chunks(pa.array(texts, pa.string())):
            forest, own = fim.Forest(c), texts[c.lo : c.hi]
            units = [UNIT.findall(t) for t in own]
            assert forest.totals().tolist() == [[len(u), len(t)] for u, t in zip(units, own)]
            for k in range(max(map(len, units), default=0) + 1):
                asked = np.array([min(k, len(u)) for u in units])
                at, chars = forest.cuts(asked)
                heads = ["".join(u[:k]) for u in units]
                assert at.tolist() == [len(h.encode()) for h in heads] and chars.tolist() == [len(h) for h in heads]
    finally:
        fim.BLOCK = before


ROWS = [*AWKWARD, (None, "a null key"), (20, "x<P>y"), (21, "<S>"), (22, "a < P > b"), (23, "<<S"), (24, "é" * 5000), (25, "z" * 70_000), (26, ". " * 40_000), (27, prose(5, 30_000))]
ROWS += [(100 + i, prose(i, 3 + i % 50) + " <M"[: i % 4]) for i in range(150)]


def test_rows_equal_brute_force(spark):
    got = fim.fill_in_middle(documents(spark, ROWS, extra=True)).withColumn("back", fim.restored()).collect()
    assert sorted(map(repr, ((r[0], *r[1:6]) for r in got))) == sorted(repr((k, *brute(k, t))) for k, t in ROWS)
    texts = {}
    for k, t in ROWS:
        texts.setdefault(k, set()).add(t or "")
    assert all(r["back"] in texts[r["doc_id"]] for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_rates_and_seed(spark):
    df = documents(spark, [(i, f"word {i} and more") for i in range(60)])
    assert {r["form"] for r in fim.fill_in_middle(df, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in fim.fill_in_middle(df, rate=100, suffix_first=100).collect()} == {"spm"}
    one, two = ([r["output"] for r in fim.fill_in_middle(df, seed=s).orderBy("doc_id").collect()] for s in "12")
    assert one != two


def test_no_rows(spark):
    assert fim.fill_in_middle(documents(spark, [])).count() == 0


@pytest.mark.parametrize("key", ["k", "t"])
def test_other_names_and_types(spark, key):
    df = spark.createDataFrame([("a", "one two"), (None, None)], f"{key} string, body string")
    assert fim.fill_in_middle(df, key=key, text="body").count() == 2
