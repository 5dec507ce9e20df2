"""Gene graphs as edge tables: closure, marker-to-gene means, smoothing over neighbours, pooling, integrity.

Smoothing is linear, so any number of hops is one sparse matrix from markers to genes (`smoothing_operator`), a power of the
normalised adjacency times the map, found without samples; features are joined to it once, and pooling needs its column
sums alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def undirected(edges: DataFrame) -> DataFrame:
    """source, target in both directions, once each, without self loops; the same when applied again.

    edges: its first two columns are the ends.
    """
    u, v = edges.columns[:2]
    once = edges.filter(F.col(u) != F.col(v)).select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).distinct()
    return once.select(F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("target")), F.struct(F.col("b").alias("source"), F.col("a").alias("target")))).alias("e")).select("e.source", "e.target")


def gene_list(marker_genes: DataFrame) -> DataFrame:
    """gene_id from 0 to the largest one in the map."""
    top = marker_genes.agg(F.max("gene_id").alias("m"))
    return top.select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("gene_id"))


def gene_means(dosage: DataFrame, marker_genes: DataFrame) -> DataFrame:
    """family_id, sample_id, gene_id, x: mean dosage (missing as 0) of a gene's markers; 0 for a gene without any.

    marker_genes: marker_pos, gene_id.
    """
    x = F.coalesce(F.col("dosage").cast("double"), F.lit(0.0))
    means = dosage.join(marker_genes, "marker_pos").groupBy("family_id", "sample_id", "gene_id").agg(F.avg(x).alias("m"))
    every = dosage.select("family_id", "sample_id").distinct().join(F.broadcast(gene_list(marker_genes)), F.lit(True))
    return every.join(means, ["family_id", "sample_id", "gene_id"], "left").withColumn("x", F.coalesce("m", F.lit(0.0))).drop("m")


def smoothing_weights(edges: DataFrame, genes: DataFrame, parts: int | None = None) -> DataFrame:
    """source, target, w of the normalised adjacency with self loops: 1 / sqrt(degree(source) * degree(target)). With parts,
    edges are dealt over so many tasks by their ends."""
    loops = genes.select(F.col("gene_id").alias("source"), F.col("gene_id").alias("target"))
    full = edges.select("source", "target").unionByName(loops)
    full = full if parts is None else full.repartition(parts, "source")
    degree = full.groupBy("source").agg(F.count(F.lit(1)).alias("d"))
    out = full.join(degree, "source").withColumnRenamed("d", "ds")
    out = out if parts is None else out.repartition(parts, "target")
    out = out.join(degree.withColumnsRenamed({"source": "target", "d": "dt"}), "target")
    return out.select("source", "target", (1 / F.sqrt(F.col("ds") * F.col("dt"))).alias("w"))


def smoothed(features: DataFrame, weights: DataFrame, hops: int = 1) -> DataFrame:
    """features (family_id, sample_id, gene_id, x) after `hops` weighted sums over neighbours and themselves."""
    for _ in range(hops):
        moved = features.join(weights, features["gene_id"] == weights["target"])
        features = moved.groupBy("family_id", "sample_id", F.col("source").alias("gene_id")).agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return features


#: Edges of one part of a gene's neighbourhood: a gene with more is dealt over several.
PART = 4096


def smoothing_operator(marker_genes: DataFrame, weights: DataFrame, hops: int = 1, part: int = PART) -> DataFrame:
    """gene_id, marker_pos, w: what a marker's dosage adds to a gene after `hops` sums; pairs without a path have no row.

    marker_genes: marker_pos, gene_id; weights: smoothing_weights. A hop is a sparse product, joined on (gene, part): the
    neighbours of a hub are dealt over parts of about `part` edges, and the rows that meet them go to each.
    """
    share = marker_genes.groupBy("gene_id").agg(F.count(F.lit(1)).alias("_n"))
    out = marker_genes.join(share, "gene_id").select("gene_id", "marker_pos", (1 / F.col("_n")).alias("w"))
    parts = weights.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    dealt = weights.join(parts, "target").withColumn("part", F.pmod(F.xxhash64("source"), F.col("parts")).cast("int"))
    dealt = dealt.select(F.col("target").alias("gene_id"), "part", "source", F.col("w").alias("a"))
    for _ in range(hops):
        copies = out.join(parts.withColumnRenamed("target", "gene_id"), "gene_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        moved = copies.join(dealt, ["gene_id", "part"])
        out = moved.groupBy(F.col("source").alias("gene_id"), "marker_pos").agg(F.sum(F.col("a") * F.col("w")).alias("w"))
    return out


def applied(dosage: DataFrame, operator: DataFrame, parts: int | None = None) -> DataFrame:
    """family_id, sample_id, gene_id, x: smoothed gene values of each sample (missing dosages as 0), for the genes that a
    marker reaches; the others are 0.

    With parts, samples are dealt over so many tasks, to each of which the whole operator goes (for one of few rows): a
    sample's values are summed where its dosages are, and a task's table of sums is a share of all of them.
    """
    if parts is not None:
        dosage, operator = dosage.select("family_id", "sample_id", "marker_pos", "dosage").repartition(parts, "family_id", "sample_id"), F.broadcast(operator)
    x = F.coalesce(F.col("dosage").cast("double"), F.lit(0.0))
    return dosage.join(operator, "marker_pos").groupBy("family_id", "sample_id", "gene_id").agg(F.sum(x * F.col("w")).alias("x"))


def applied_pool(dosage: DataFrame, operator: DataFrame, genes: DataFrame) -> DataFrame:
    """family_id, sample_id, pooled: the mean of `applied` over all genes, by the sums of the operator over genes."""
    sums = operator.groupBy("marker_pos").agg(F.sum("w").alias("w")).join(F.broadcast(genes.agg(F.count(F.lit(1)).alias("n"))), F.lit(True))
    x = F.coalesce(F.col("dosage").cast("double"), F.lit(0.0))
    return dosage.join(sums, "marker_pos", "left").groupBy("family_id", "sample_id").agg(F.coalesce(F.sum(x * F.col("w") / F.col("n")), F.lit(0.0)).alias("pooled"))


def pooled(features: DataFrame) -> DataFrame:
    return features.groupBy("family_id", "sample_id").agg(F.avg("x").alias("pooled"))


def integrity(edges: DataFrame, marker_genes: DataFrame, n_markers: int) -> DataFrame:
    """Rows (problem, value): edge ends beyond the genes, and a map that does not have one row for each marker."""
    top = marker_genes.agg(F.max("gene_id").alias("m"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("v")).distinct().join(F.broadcast(top), F.col("v") > F.col("m"))
    size = marker_genes.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != n_markers)
    return ends.select(F.lit("edge end is no gene").alias("problem"), F.col("v").cast("bigint").alias("value")).unionByName(size.select(F.lit("map rows").alias("problem"), F.col("n").alias("value")))
