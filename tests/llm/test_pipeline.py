import re

import corpus_pipeline
from helpers import AWKWARD, documents
from lociframe.llm import mixing, pii, toxicity
from lociframe.llm.tables import table, written
from test_operators import brute_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute_masked(text, field):
    """text with the pattern's matches, found by plain regular expressions, and the field's spans masked."""
    base = [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(pii.PATTERNS[k], text) if pii._valid(k, m.group())]
    return pii.masked(text, base + pii.added_spans([text], [base], field)[0])


def test_stages_equal_their_operators_and_brute_force(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        after = written(stage(spark, docs, sf_dir), f"test-{name}")
        assert after.columns == COLUMNS
        got = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "toxicity":
            score = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect()}
            assert set(got) == {i for i, _ in before if score[i] < toxicity.THRESHOLD}
        elif name == "near_duplicates":
            assert set(got) == {i for i, (_, c) in brute_components(before, 5).items() if c == i}
        elif name == "personal_data":
            assert got == {i: brute_masked(t, pii.train()) for i, t in before}
            assert after.filter("n_chars <> length(text)").count() == 0
        else:
            model = mixing.train(docs, labels, mixing.quality_domain())
            assert set(got) == {r["doc_id"] for r in mixing.mixed(docs, model, mixing.QUALITY_WEIGHTS, whole="good").collect() if r["kept"]}
        if name != "personal_data":
            assert got.items() <= dict(before).items()
        docs = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_empty_and_awkward_documents(spark, sf_dir):
    extra = [(None, "no id"), (None, "no id")]
    for rows in ([], AWKWARD + extra):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), "test-awkward")
            assert docs.columns == COLUMNS
        left = [r["doc_id"] for r in docs.collect()]
        # Copies (5 of 4, 8 of 3, the second row of 9) go; nothing else does but what mixing thins.
        assert set(left) <= {0, 1, 2, 3, 4, 6, 7, 9, None} and len(left) == len(set(left)) + (left.count(None) == 2)
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
        assert sorted(str(r["doc_id"]) for r in pieces if r["start"] == 0) == sorted(map(str, left))


def test_queries_equal_their_sql(spark, sf_dir):
    import duckdb

    from lociframe.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, sf_dir)
        cur = con.execute(sql)
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(tuple, df.select(*columns).collect())) == sorted(cur.fetchall())
