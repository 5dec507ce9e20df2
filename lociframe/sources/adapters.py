"""Genotype, phenotype, metric and graph tables made of the general tables, with the same rules as SQL text.

Dense genotype: embeddings, a marker for each vector element. Tall genotype: order lines, a marker for each line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lociframe.functions.scalars import dosage_of, founder_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _samples(e: DataFrame) -> DataFrame:
    label = F.lpad(F.col("label").cast("string"), 2, "0")
    first = e.groupBy("label").agg(F.min("vec_id").alias("first_id"))
    founder = F.concat(F.lit("P"), label)
    return e.join(first, "label").select(
        F.concat(founder, F.lit("_NAM"), label).alias("family_id"),
        F.when(F.col("vec_id") == F.col("first_id"), founder).otherwise(F.concat(F.lit("S"), F.lpad(F.col("vec_id").cast("string"), 6, "0"))).alias("sample_id"),
        F.col("vec_id").alias("sample_pos"), "label", "embedding",
    )


def dense_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family_id, sample_id, sample_pos, marker_id, marker_pos, call."""
    e = _samples(table(spark, sf_dir, "embeddings")).select("*", F.posexplode("embedding").alias("j", "x")).withColumn("v", F.col("x").cast("double")).withColumn("i", F.col("sample_pos"))
    call = F.expr(
        """CASE WHEN (i * 31 + j * 17) % 23 = 0 OR (j % 16 = 8 AND (i + j) % 20 <> 0) THEN '-'
        WHEN j % 16 = 0 THEN CASE WHEN v > -0.25D THEN 'B' ELSE 'A' END
        WHEN v < -0.05D THEN CASE WHEN (i + j) % 3 = 0 THEN 'A/A' ELSE 'A' END
        WHEN v > 0.05D THEN CASE WHEN (i + j) % 3 = 0 THEN 'B/B' ELSE 'B' END
        ELSE CASE WHEN (i + j) % 2 = 0 THEN 'H' ELSE 'A/B' END END"""
    )
    return e.select("family_id", "sample_id", "sample_pos", F.concat(F.lit("m"), F.lpad(F.col("j").cast("string"), 3, "0")).alias("marker_id"), F.col("j").alias("marker_pos"), call.alias("call"))


def dense_phenotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family_id, sample_id, sample_pos, yield."""
    e = _samples(table(spark, sf_dir, "embeddings")).withColumn("i", F.col("sample_pos"))
    v = [F.get("embedding", F.lit(k)).cast("double") for k in (1, 2, 3)]
    value = F.round(3000 + 25 * F.col("label") + 400 * (v[0] + v[1] - v[2]) + ((F.col("i") * 7919) % 101 - 50) * F.lit(0.5), 2)
    return e.select("family_id", "sample_id", "sample_pos", F.when(F.col("i") % 41 != 0, value).alias("yield"))


def dense_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples that are modelled: no founders, trait known."""
    return dense_phenotype(spark, sf_dir).filter((F.col("sample_id") != founder_of(F.col("family_id"))) & F.col("yield").isNotNull())


def dense_dosage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dosage of each modelled sample and marker, and its trait."""
    kept = dense_samples(spark, sf_dir).select("family_id", "sample_id", "yield")
    return dense_calls(spark, sf_dir).join(kept, ["family_id", "sample_id"]).withColumn("dosage", dosage_of(F.col("call"))).drop("call")


def tall_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family_id (nation), sample_id (order), marker_pos (line), call, and the rest of the line to order repeats by."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linestatus"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    call = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "H").when(F.col("l_returnflag") == "R", "B")
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.withColumn("call", call).withColumnsRenamed({"l_orderkey": "sample_id", "l_linenumber": "marker_pos", "c_nationkey": "family_id"}).drop("o_orderkey", "o_custkey", "c_custkey")


def tall_phenotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family_id, sample_id, yield: every order, with or without lines."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("family_id"), F.col("o_orderkey").alias("sample_id"), F.col("o_totalprice").alias("yield"))


#: What orders the repeats of a (sample, marker) pair.
TALL_ORDER = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, fold, epoch, loss."""
    from pyspark.sql import Window

    at = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("fold"), F.row_number().over(at).alias("epoch"), F.col("value").cast("double").alias("loss"))


def gene_of(marker_pos: str = "marker_pos"):
    """The gene of a marker: 13 genes, of which gene 5 has no marker."""
    return F.when(F.col(marker_pos) % 13 == 5, 12).otherwise(F.col(marker_pos) % 13).cast("int")


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v: pairs of nodes (parts and suppliers by number) with self loops, both directions and repeats."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("int").alias("u"), F.col("l_suppkey").cast("int").alias("v"))


def graph_genes(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """marker_pos, gene_id: markers on nodes of raw_edges, two on each third one down from the largest number."""
    top = edges.agg(F.max(F.greatest("u", "v")).alias("m"))
    markers = calls.select("marker_pos").distinct().join(F.broadcast(top), F.lit(True))
    return markers.select("marker_pos", (F.col("m") - 3 * F.floor(F.col("marker_pos") / 2)).cast("int").alias("gene_id"))


def graph_nodes(edges: DataFrame) -> DataFrame:
    """gene_id: all numbers up to the largest part or supplier."""
    top = edges.agg(F.max(F.greatest("u", "v")).alias("m"))
    return top.select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("gene_id"))


#: The same tables as common table expressions: raw_calls, calls, phenotype, samples, dosage.
DENSE_SQL = """
raw_calls AS (
  SELECT vec_id AS i, label, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings
), first_of AS (SELECT label AS l, min(vec_id) AS first_id FROM embeddings GROUP BY label
), named AS (
  SELECT vec_id AS sample_pos, label, embedding, 'P' || lpad(CAST(label AS VARCHAR), 2, '0') AS founder,
         'P' || lpad(CAST(label AS VARCHAR), 2, '0') || '_NAM' || lpad(CAST(label AS VARCHAR), 2, '0') AS family_id,
         CASE WHEN vec_id = first_id THEN 'P' || lpad(CAST(label AS VARCHAR), 2, '0') ELSE 'S' || lpad(CAST(vec_id AS VARCHAR), 6, '0') END AS sample_id
  FROM embeddings JOIN first_of ON label = l
), calls AS (
  SELECT family_id, sample_id, sample_pos, 'm' || lpad(CAST(j AS VARCHAR), 3, '0') AS marker_id, CAST(j AS INTEGER) AS marker_pos,
    CASE WHEN (i * 31 + j * 17) % 23 = 0 OR (j % 16 = 8 AND (i + j) % 20 <> 0) THEN '-'
         WHEN j % 16 = 0 THEN CASE WHEN v > -0.25 THEN 'B' ELSE 'A' END
         WHEN v < -0.05 THEN CASE WHEN (i + j) % 3 = 0 THEN 'A/A' ELSE 'A' END
         WHEN v > 0.05 THEN CASE WHEN (i + j) % 3 = 0 THEN 'B/B' ELSE 'B' END
         ELSE CASE WHEN (i + j) % 2 = 0 THEN 'H' ELSE 'A/B' END END AS call
  FROM raw_calls JOIN named ON i = sample_pos
), phenotype AS (
  SELECT family_id, sample_id, sample_pos, founder, CASE WHEN sample_pos % 41 <> 0 THEN
    round(3000 + 25 * label + 400 * (CAST(embedding[2] AS DOUBLE) + CAST(embedding[3] AS DOUBLE) - CAST(embedding[4] AS DOUBLE)) + ((sample_pos * 7919) % 101 - 50) * CAST(0.5 AS DOUBLE), 2) END AS yield
  FROM named
), samples AS (SELECT family_id, sample_id, sample_pos, yield FROM phenotype WHERE sample_id <> founder AND yield IS NOT NULL
), dosage AS (
  SELECT calls.family_id, calls.sample_id, calls.sample_pos, marker_id, marker_pos, yield,
    CASE WHEN call IN ('A', 'A/A') THEN -1 WHEN call IN ('H', 'A/B') THEN 0 WHEN call IN ('B', 'B/B') THEN 1 END AS dosage
  FROM calls JOIN samples ON calls.family_id = samples.family_id AND calls.sample_id = samples.sample_id
)"""

TALL_SQL = """
tall AS (
  SELECT c_nationkey AS family_id, l_orderkey AS sample_id, l_linenumber AS marker_pos,
         CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'H' WHEN 'R' THEN 'B' END AS call, lineitem.*
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
), tall_phenotype AS (
  SELECT c_nationkey AS family_id, o_orderkey AS sample_id, o_totalprice AS yield FROM orders JOIN customer ON o_custkey = c_custkey
)"""

EVENTS_SQL = """
log AS (
  SELECT user_id AS run, event_type AS fold, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS epoch, CAST(value AS DOUBLE) AS loss FROM events
)"""

GRAPH_SQL = """
raw_edges AS (SELECT CAST(l_partkey AS INTEGER) AS u, CAST(l_suppkey AS INTEGER) AS v FROM lineitem
), edges AS (
  SELECT least(u, v) AS a, greatest(u, v) AS b FROM raw_edges WHERE u <> v GROUP BY 1, 2
), directed AS (SELECT a AS source, b AS target FROM edges UNION ALL SELECT b, a FROM edges
)"""
#: Nodes, normalised weights with self loops, and gene values of the samples over the whole graph.
GENE_GRAPH_SQL = GRAPH_SQL + """, nodes AS (SELECT unnest(range(CAST((SELECT max(greatest(u, v)) + 1 FROM raw_edges) AS BIGINT))) AS g
), w AS (SELECT source, target FROM directed UNION ALL SELECT g, g FROM nodes
), deg AS (SELECT source AS v, count(*) AS d FROM w GROUP BY 1
), ww AS (SELECT w.source, w.target, 1 / sqrt(a.d * b.d) AS w FROM w JOIN deg a ON a.v = w.source JOIN deg b ON b.v = w.target
), means AS (SELECT family_id, sample_id, (SELECT max(g) FROM nodes) - 3 * (marker_pos // 2) AS gene_id, avg(coalesce(dosage, 0)) AS x FROM dosage GROUP BY ALL
), hop AS (SELECT family_id, sample_id, source AS gene_id, sum(w * x) AS x FROM means JOIN ww ON gene_id = target GROUP BY ALL
)"""
