"""Family file discovery, phenotype and genotype readers, input manifests.

A family has one phenotype file (a row for each sample) and one genotype file (a row for each marker, a column for
each sample), gzipped tab-separated text. Wide genotype rows become a long table of calls with explicit positions. Files
stream through their tasks (streams.py), so their size does not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lociframe.operators import folds
from lociframe.functions.scalars import GENOTYPE_SUFFIX, PHENOTYPE_SUFFIX, base_name, family_of_file, na_to_null, stripped

from . import streams

#: The phenotype columns that must be there.
SAMPLE_COLUMN, TRAIT_COLUMN = "Corrected Strain", "Yld (kg/ha)"


class InputError(ValueError):
    """Files that do not form a valid data set."""


def list_family_files(spark: SparkSession, data_dir: str) -> DataFrame:
    """family_id, phenotype_path, genotype_path by family; raises if the files don't pair one to one."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tsv.gz").load(data_dir).select("path")
    named = found.withColumn("name", base_name(F.col("path"))).withColumn("family_id", family_of_file(F.col("name")))
    kind = F.when(F.col("name").endswith(PHENOTYPE_SUFFIX), "phenotype").when(F.col("name").endswith(GENOTYPE_SUFFIX), "genotype")
    named = named.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    pairs = named.groupBy("family_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "phenotype", F.col("path")))).alias("p"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "genotype", F.col("path")))).alias("g"),
    )
    rows = pairs.orderBy("family_id").collect()  # one row for each family of files
    if not any(r["p"] for r in rows):
        raise InputError(f"no phenotype files in {data_dir}")
    for kind, column in (("phenotype", "p"), ("genotype", "g")):
        if twice := [r["family_id"] for r in rows if len(r[column]) > 1]:
            raise InputError(f"several {kind} files for one family: {twice}")
    p_only, g_only = [r["family_id"] for r in rows if not r["g"]], [r["family_id"] for r in rows if not r["p"]]
    if p_only or g_only:
        raise InputError(f"families without genotypes: {p_only}; without phenotypes: {g_only}")
    return pairs.select("family_id", F.col("p")[0].alias("phenotype_path"), F.col("g")[0].alias("genotype_path")).orderBy("family_id")


def read_phenotypes(spark: SparkSession, files: DataFrame) -> DataFrame:
    """family_id, sample_pos, sample_id, yield_raw; values as written, missing tokens as null."""
    lines = streams.numbered_lines(spark, [r[0] for r in files.select("phenotype_path").collect()]).withColumn("cells", F.split("line", "\t", -1))
    header = lines.filter("line_pos = 0").select("family_id", F.array_position("cells", SAMPLE_COLUMN).alias("s"), F.array_position("cells", TRAIT_COLUMN).alias("y"))
    if bad := [r["family_id"] for r in header.filter("s = 0 or y = 0").orderBy("family_id").collect()]:
        raise InputError(f"phenotype files without the columns {SAMPLE_COLUMN!r} and {TRAIT_COLUMN!r}: {bad}")
    cell = lambda c: na_to_null(F.get("cells", (F.col(c) - 1).cast("int")))
    body = lines.filter("line_pos > 0").join(F.broadcast(header), "family_id")  # a row for each file
    return body.select("family_id", (F.col("line_pos") - 1).alias("sample_pos"), stripped(cell("s")).alias("sample_id"), cell("y").alias("yield_raw"))


def read_genotypes(spark: SparkSession, files: DataFrame) -> DataFrame:
    """streams.CELLS of the genotype files. What needs headers and calls both should store or persist it: files are then read
    once."""
    return streams.melted(streams.numbered_lines(spark, [r[0] for r in files.select("genotype_path").collect()]))


def genotype_headers(cells: DataFrame) -> DataFrame:
    """family_id, sample_pos, sample_id: the header as written, repeated names and all."""
    header = cells.filter("marker_pos = -1")
    if bad := [r["family_id"] for r in header.filter("sample_pos = -1").orderBy("family_id").collect()]:
        raise InputError(f"genotype files without sample columns: {bad}")
    return header.select("family_id", "sample_pos", stripped(F.col("sample")).alias("sample_id"))


def genotype_calls(cells: DataFrame) -> DataFrame:
    """family_id, marker_pos, marker_id, sample_pos, sample_id, call: one row for each cell of the genotype files."""
    return cells.filter("marker_pos >= 0").select(
        "family_id", "marker_pos", stripped(na_to_null(F.col("marker"))).alias("marker_id"), "sample_pos", stripped(F.col("sample")).alias("sample_id"), na_to_null(F.col("call")).alias("call")
    )


def read_genotype_headers(spark: SparkSession, files: DataFrame) -> DataFrame:
    return genotype_headers(read_genotypes(spark, files))


def read_calls(spark: SparkSession, files: DataFrame) -> DataFrame:
    return genotype_calls(read_genotypes(spark, files))


#: Fixed value: the marker map's column of genes.
GENE_COLUMN = "gene_id"


def read_processed_phenotypes(spark: SparkSession, path: str, k: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Samples (sample_id, yield, family_id, and fold_index) and folds of a CSV whose first column is the sample.

    With a family_id column a fold is a family; without one samples are dealt over k random folds, and their fold is
    their family.
    """
    raw = spark.read.option("header", True).csv(path)
    name = raw.columns[0]
    trait = next((c for c in (TRAIT_COLUMN, "yield") if c in raw.columns), None)
    if trait is None:
        raise InputError(f"no column {TRAIT_COLUMN!r} or 'yield' in {path}")
    samples = raw.select(F.col(f"`{name}`").alias("sample_id"), F.expr(f"try_cast(`{trait}` as double)").alias("yield"), *(["family_id"] if "family_id" in raw.columns else []))
    if "family_id" not in raw.columns:
        samples = folds.random_kfold(samples, k, seed).withColumn("family_id", F.concat(F.lit("fold"), F.lpad(F.col("fold_index").cast("string"), 3, "0"))).drop("fold_index")
    plan = folds.make_folds(samples)
    return samples.join(F.broadcast(plan.select(F.col("held_out_family").alias("family_id"), "fold_index")), "family_id"), plan


def read_processed(spark: SparkSession, phenotypes: str, matrix: str, marker_map: str | None = None, k: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Packed samples (family_id, sample_id, sample_pos, yield, dosages) and folds of a phenotype CSV and the int8 matrix that
    goes with it, row by row; sample_pos is the row in both. Raises if their numbers of rows differ, or if the marker map
    does not have a row for each column."""
    n, m, _ = streams.matrix_shape(matrix)
    samples, plan = read_processed_phenotypes(spark, phenotypes, k, seed)
    # Rows are numbered in the order of the file: its parts come in order, and there is one number of rows for each.
    names = spark.read.option("header", True).csv(phenotypes)
    key = names.columns[0]
    placed = names.select(F.col(f"`{key}`").alias("sample_id"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_in"))
    starts = {r["_part"]: (r["n"], r["low"]) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_in").alias("low")).collect()}
    rows = sum(c for c, _ in starts.values())
    if rows != n:
        raise InputError(f"{matrix} has {n} rows, {phenotypes} {rows}")
    if marker_map is not None and (found := read_marker_map(spark, marker_map).count()) != m:
        raise InputError(f"{marker_map} has {found} rows for {m} markers")
    shift, before = [], 0
    for part in sorted(starts):
        shift.append((part, before - starts[part][1]))
        before += starts[part][0]
    if twice := placed.groupBy("sample_id").count().filter("count > 1").limit(5).collect():
        raise InputError(f"samples that {phenotypes} has more than once: {[r['sample_id'] for r in twice]}")
    places = placed.join(F.broadcast(spark.createDataFrame(shift or [(0, 0)], "_part int, _shift long")), "_part").select("sample_id", (F.col("_in") + F.col("_shift")).alias("sample_pos"))
    return samples.drop("fold_index").join(places, "sample_id").join(streams.matrix_rows(spark, matrix), "sample_pos").select("family_id", "sample_id", "sample_pos", "yield", "dosages"), plan


def read_marker_map(spark: SparkSession, path: str) -> DataFrame:
    """marker_pos, gene_id of a CSV with a row for each marker in order: its position, its gene (gene_id, or the last column)."""
    raw = spark.read.option("header", True).csv(path)
    gene = GENE_COLUMN if GENE_COLUMN in raw.columns else raw.columns[-1]
    out = raw.select(F.expr(f"try_cast(`{raw.columns[0]}` as int)").alias("marker_pos"), F.expr(f"try_cast(`{gene}` as int)").alias("gene_id"))
    if bad := out.filter("marker_pos is null or gene_id is null").limit(5).collect():
        raise InputError(f"rows without a marker or gene number in {path}: {len(bad)} or more")
    return out


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """u, v of a CSV of gene pairs (its first two columns)."""
    raw = spark.read.option("header", True).csv(path)
    out = raw.select(*[F.expr(f"try_cast(`{c}` as int)").alias(n) for c, n in zip(raw.columns, ("u", "v"))])
    if bad := out.filter("u is null or v is null").limit(5).collect():
        raise InputError(f"rows without two gene numbers in {path}: {len(bad)} or more")
    return out


def read_modelling_table(spark: SparkSession, path: str) -> DataFrame:
    """A packed modelling table written by `write_modelling_table`."""
    return spark.read.parquet(path)


def describe_input_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """family_id, both file names (no paths) and their SHA-256, found piece by piece."""
    out = files.select("family_id")
    for kind in ("phenotype", "genotype"):
        found = streams.digests(spark, [r[0] for r in files.select(f"{kind}_path").collect()])
        sums = found.select(base_name(F.col("path")).alias(f"{kind}_file"), F.col("sha256").alias(f"{kind}_sha256"))
        out = out.join(sums.withColumn("family_id", family_of_file(F.col(f"{kind}_file"))), "family_id")
    return out.orderBy("family_id")


def changed_inputs(now: DataFrame, expected: DataFrame) -> DataFrame:
    """Manifest rows that differ, with the side they stand on; the file list is that of the expected manifest."""
    kept = now.join(expected.select("family_id"), "family_id", "left_semi").select(*expected.columns)
    return kept.exceptAll(expected).withColumn("side", F.lit("now")).unionByName(expected.exceptAll(kept).withColumn("side", F.lit("expected")))


def verify_inputs_unchanged(now: DataFrame, expected: DataFrame) -> None:
    if bad := sorted({r["family_id"] for r in changed_inputs(now, expected).select("family_id").collect()}):
        raise InputError(f"input files changed during the run: {bad}")
