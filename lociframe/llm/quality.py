"""Document quality rules judged together with the record of the host a document comes from.

Only DataFrame functions: per-document counts inside each row, host failure rates by a partial-aggregated
groupBy, an empirical beta prior fitted to those rates by moments, and the host verdict joined back.

Defined edge cases: a null text has no words and fails the rules; a null host gets no verdict (its documents are
judged alone); repeated rows are judged and counted once each; an empty table gives an empty result. The query takes
`source` as the host of a document: the table has no address, and a source is what its documents come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import table, written

#: Base rule: fewer words than this, or more than this share of them inside repeated three-word windows, fails.
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
#: A host is rejected when its shrunken failure rate is above this.
MAX_HOST_RATE = 0.5
#: Fixed values of the rules: white space and symbol characters.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _repeated_words() -> Column:
    """Words covered by windows whose hash (in `_s`, null if all differ) occurs twice or more.

    Windows are sorted within the row, with their places, so that equal hashes become neighbours: n log n for any text.
    """
    s = F.col("_s")
    same = lambda v, w: F.coalesce(v["x"] == w["x"], F.lit(False))
    hit = F.filter(s, lambda v, i: same(v, F.get(s, i - 1)) | same(v, F.get(s, i + 1)))
    near = F.transform(hit, lambda v: F.array(v["i"], v["i"] + 1, v["i"] + 2))
    return F.when(s.isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten(near)))).cast("bigint")


def text_counts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of each row."""
    t = F.coalesce(F.col("_t"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.when(
        F.size("_w") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    placed = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    out = (
        df.select(*[F.col(c) for c in keep], F.col(text).alias("_t"))
        .withColumn("_w", F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), ""))
        .withColumn("_l", lines)
        .withColumn("_h", hashes)
        .withColumn("_s", placed)
        .select(
            *keep,
            F.size("_w").cast("bigint").alias("n_words"),
            F.char_length(F.translate(t, SPACE, "")).cast("bigint").alias("word_chars"),
            (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
            _repeated_words().alias("n_repeat_words"),
        )
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_verdicts(counts: DataFrame, host: str) -> DataFrame:
    """host, host_docs, host_rate (shrunken) and host_rejected; the prior is one row fitted to all hosts."""
    hosts = (
        counts.filter(F.col(host).isNotNull())
        .groupBy(host)
        .agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("host_failed"))
    )
    rate = F.col("host_failed") / F.col("host_docs")
    row = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v")).first()
    mean, var = row["m"] or 0.0, row["v"] or 0.0
    # Moments of a beta distribution; equal rates give the strongest prior, widely scattered ones the weakest.
    strength = min(max(mean * (1 - mean) / var - 1, 1.0), 1e6) if var > 0 else 1e6
    shrunken = (F.col("host_failed") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    return hosts.select(host, "host_docs", shrunken.alias("host_rate"), (shrunken > MAX_HOST_RATE).alias("host_rejected"))


def host_rules(df: DataFrame, key: str = "doc_id", text: str = "text", host: str | Column = "source") -> DataFrame:
    """One row per document: its counts, base verdict, host record and kept."""
    host = F.col(host) if isinstance(host, str) else host
    slim = df.select(F.col(key), F.col(text).alias("_text"), host.cast("string").alias("host"))
    counts = written(text_counts(slim, "_text", (key, "host")), "quality-counts")
    verdict = F.coalesce(F.col("host_rejected"), F.lit(False))
    return counts.join(host_verdicts(counts, "host"), "host", "left").withColumn("kept", ~F.col("base_failed") & ~verdict)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT rid, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid
), m AS (
  SELECT d.rid, d.doc_id, d.source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM b WHERE source IS NOT NULL GROUP BY source
), p AS (
  SELECT avg(f / n) AS mu, coalesce(var_pop(f / n), 0) AS v FROM h
), s AS (
  SELECT mu, CASE WHEN v > 0 THEN least(greatest(mu * (1 - mu) / v - 1, 1), 1e6) ELSE 1e6 END AS k FROM p
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce((h.f + s.mu * s.k) / (h.n + s.k) > 0.5, false) AS kept
FROM b LEFT JOIN h ON b.source = h.source CROSS JOIN s
"""
