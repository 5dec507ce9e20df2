import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, documents, prose
from pyspark.sql import functions as F

from lociframe.llm import wordvec
from lociframe.llm.text import raw_chunks

np.seterr(over="ignore")
RUN = re.compile(r"[A-Za-z\u0080-\U0010ffff]+|[0-9]+|[^A-Za-z\u0080-\U0010ffff0-9\x20\x09-\x0d]+")


def junk(seed, n):
    return " ".join(w + "&%#!"[i % 4] * 3 for i, w in enumerate(prose(seed, n).split()))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_runs_of_one_kind():
    texts = ["", "ab12 c-d", "é\U0001f600x", None, "a", "b", "!! ?\n7"]
    for c in raw_chunks(pa.array(texts, pa.string())):
        wordvec.find_runs(c)
        for i, t in enumerate(texts[c.lo : c.hi]):
            own = range(c.words[i], c.words[i + 1])
            assert [bytes(c.data[c.starts[k] : c.ends[k]]).decode() for k in own] == RUN.findall(t or "")


def test_word_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(wordvec, "GATHER", 7)
    texts = [prose(i, 40) for i in range(12)] + [None, "", "one", "a b"]
    want = np.zeros((wordvec.CELLS, wordvec.DIM))
    for t in texts:
        for c in raw_chunks(pa.array([t], pa.string())):
            wordvec.find_runs(c)
            place, sign = wordvec.index_vectors(c.hashes)
            for i in range(len(c.hashes)):
                for j in range(max(0, i - 2), min(len(c.hashes), i + 3)):
                    np.add.at(want[wordvec._cell(c.hashes)[i]], place[j], sign[j])
    size = np.linalg.norm(want, axis=1, keepdims=True)
    used = size[:, 0] > 0
    want[used] /= size[used]
    want[used] -= want[used].mean(0)
    want[used] /= np.linalg.norm(want[used], axis=1, keepdims=True)
    df = documents(spark, list(enumerate(texts)))
    for parts in (1, 5):
        assert np.allclose(wordvec.word_vectors(df.repartition(parts)), want, atol=1e-6)


def test_pooled_features(monkeypatch):
    vectors = np.random.default_rng(1).normal(size=(wordvec.CELLS, wordvec.DIM)).astype(np.float32)
    texts = [prose(1, 50), "", "x x x", None, prose(2, 9)]
    for gather in (4, 1 << 16):
        monkeypatch.setattr(wordvec, "GATHER", gather)
        for c in raw_chunks(pa.array(texts, pa.string())):
            wordvec.find_runs(c)
            got = wordvec.pooled(c, vectors)
            for i in range(c.hi - c.lo):
                h = c.hashes[c.words[i] : c.words[i + 1]]
                own = vectors[wordvec._cell(h)].astype(float)
                want = np.concatenate((own.mean(0), own.std(0), [np.log1p(len(h)), len(set(h.tolist())) / len(h), 1])) if len(h) else np.zeros(wordvec.FEATURES)
                assert np.allclose(got[i], want, atol=1e-9)


def test_network_learns_what_no_line_separates():
    r = np.random.default_rng(2)
    x = r.uniform(-1, 1, (800, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    net = wordvec.fit_network(x, y, np.arange(800) % 5 == 0, decay=1e-5)
    fresh = r.uniform(-1, 1, (500, 2))
    assert ((net.scores(fresh) > 0.5) == (fresh[:, 0] * fresh[:, 1] > 0)).mean() > 0.93


def test_temperature_calibrates():
    r = np.random.default_rng(3)
    x = r.normal(size=(4000, 3))
    y = (r.uniform(size=4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    # A network fitted to few rows is too sure; those set apart say by how much.
    net = wordvec.fit_network(x, y, np.arange(4000) >= 60, decay=0.0)
    z = net.logits(x[60:])
    assert net.temperature > 1.2 and wordvec._loss(z / net.temperature, y[60:]) < wordvec._loss(z, y[60:]) - 0.02
    net = wordvec.fit_network(x, y, np.arange(4000) % 2 == 0)
    p = net.scores(x[::2])
    for lo in (0.0, 0.25, 0.5, 0.75):
        own = (p >= lo) & (p < lo + 0.25)
        assert abs(p[own].mean() - y[::2][own].mean()) < 0.07


def test_held_out_quality(spark, sf_dir):
    got = wordvec.query(spark, "/root/testdata/sf0.01")
    labelled = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    rows = got.join(labelled, "doc_id").filter("held_out").collect()
    low = [r for r in rows if r["quality"] == 0]
    assert len(low) >= 10 and sum(r["predicted"] == 0 for r in low) >= 0.9 * len(low)
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()


def test_other_labels_change_nothing(spark):
    rows = [(i, prose(i, 60) if i % 2 else junk(i, 60)) for i in range(80)]
    docs = documents(spark, rows)
    known = [(i, i % 2, 0) for i in range(80)]
    held = {r["doc_id"] for r in docs.filter(wordvec.fold("doc_id", 5) == 0).collect()}
    turned = [(i, 1 - y if i in held else y, 1) for i, y, _ in known]
    out = []
    for given in (known, turned):
        model = wordvec.train(docs, labels(spark, given).filter(wordvec.fold("doc_id", 5) != 0))
        out.append({r["doc_id"]: r["score"] for r in wordvec.quality_scores(docs, model).collect()})
    assert out[0] == out[1] and all((s > 0.5) == bool(i % 2) for i, s in out[0].items() if i in held)


@pytest.mark.parametrize("known", [[], [(4, 1, 0), (6, 1, 0)], [(4, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, 0), (8, 1, 0)]])
def test_awkward_tables(spark, known):
    df = documents(spark, [*AWKWARD, (None, "no key")], extra=True)
    model = wordvec.train(df, labels(spark, known))
    got = wordvec.quality_scores(df, model).collect()
    assert len(got) == len(AWKWARD) + 1 and all(0 <= r["score"] <= 1 for r in got)
    if not known:
        assert {r["score"] for r in got} == {0.5}
    nothing = documents(spark, [])
    assert wordvec.quality_scores(nothing, wordvec.train(nothing, labels(spark, known))).count() == 0


def test_scores_do_not_depend_on_partitions(spark):
    df = documents(spark, [(i, prose(i, 60) if i % 2 else junk(i, 60)) for i in range(60)])
    known = labels(spark, [(i, i % 2, 0) for i in range(60)])
    a, b = ({r["doc_id"]: r["score"] for r in wordvec.quality_scores(df, wordvec.train(df.repartition(n), known)).withColumn("x", F.lit(1)).collect()} for n in (1, 7))
    assert a == b
