"""Strict checks of phenotypes and calls. Each gives rows (check, family_id, kind, ids, detail); none means valid."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lociframe.functions.scalars import dosage_of, founder_of, is_missing_call, stripped, trait_of

VIOLATION = ["check", "family_id", "kind", "ids", "detail"]


class ValidationError(ValueError):
    """The first violations of a data set, by family."""


def _violation(df: DataFrame, check: str, kind: str, ids, detail="") -> DataFrame:
    family = F.col("family_id") if "family_id" in df.columns else F.lit(None).cast("string")
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(check).alias("check"), family.cast("string").alias("family_id"), F.lit(kind).alias("kind"), ids.cast("array<string>").alias("ids"), detail.cast("string").alias("detail"))


def without_founders(df: DataFrame) -> DataFrame:
    """Rows of samples other than the family's parent."""
    return df.filter(F.col("sample_id") != founder_of(F.col("family_id")))


def empty_ids(df: DataFrame, id_col: str, pos_col: str, kind: str) -> DataFrame:
    """Families with missing or blank ids, and the zero-based positions of those."""
    bad = df.filter(stripped(F.col(id_col)) == "").select("family_id", pos_col).distinct().groupBy("family_id").agg(F.array_sort(F.collect_list(pos_col)).alias("ids"))
    return _violation(bad, "empty id", kind, F.col("ids"))


def duplicates(df: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Key values that occur more than once, with their number. With parts, keys are dealt over so many tasks, whatever the
    session's number: a task's table of keys is a share of all of them."""
    df = df if parts is None else df.select(*keys).repartition(parts, *keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def duplicate_ids(df: DataFrame, id_col: str, kind: str) -> DataFrame:
    bad = duplicates(df, ["family_id", id_col]).groupBy("family_id").agg(F.array_sort(F.collect_list(id_col)).alias("ids"))
    return _violation(bad, "duplicate id", kind, F.col("ids"))


def two_sided_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys and side: 'left' or 'right' of what only one input has."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(True)), right.select(*keys).distinct().withColumn("_r", F.lit(True))
    return a.join(b, keys, "full_outer").filter("_l is null or _r is null").select(*keys, F.when(F.col("_r").isNull(), "left").otherwise("right").alias("side"))


def sample_sets(phenotype: DataFrame, genotype: DataFrame) -> DataFrame:
    """family_id, phenotype_only, genotype_only (sorted) of families whose samples, founders aside, differ."""
    diff = two_sided_difference(without_founders(phenotype), without_founders(genotype), ["family_id", "sample_id"])
    return diff.groupBy("family_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "left", F.col("sample_id")))).alias("phenotype_only"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "right", F.col("sample_id")))).alias("genotype_only"),
    )


def marker_consistency(markers: DataFrame) -> DataFrame:
    """family_id, missing, extra, moved of families whose markers differ from those of the first family.

    markers: family_id, marker_id, marker_pos. moved lists markers in another place, if the sets are equal.
    """
    families = markers.select("family_id").distinct()
    first = families.agg(F.min("family_id").alias("first_family"))
    ref = markers.join(first, F.col("family_id") == F.col("first_family")).select("marker_id", F.col("marker_pos").alias("ref_pos")).distinct()
    own = markers.select("family_id", "marker_id", "marker_pos").distinct()
    met = own.join(ref, "marker_id", "left")
    n_ref = ref.agg(F.count(F.lit(1)).alias("n_ref"))
    per = met.groupBy("family_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("ref_pos").isNull(), F.col("marker_id")))).alias("extra"),
        F.array_sort(F.collect_list(F.when(F.col("ref_pos") != F.col("marker_pos"), F.col("marker_id")))).alias("moved"),
        F.count("ref_pos").alias("n_met"),
    )
    lacking = families.join(n_ref, F.lit(True)).join(per, "family_id").filter("n_met < n_ref").select("family_id")
    # Every marker of the reference for the few families that lack some.
    missing = lacking.join(ref.select("marker_id"), F.lit(True)).join(own.select("family_id", "marker_id"), ["family_id", "marker_id"], "left_anti")
    missing = missing.groupBy("family_id").agg(F.array_sort(F.collect_list("marker_id")).alias("missing"))
    none = F.array().cast("array<string>")
    out = per.join(missing, "family_id", "left").withColumn("missing", F.coalesce("missing", none))
    same_set = (F.size("missing") == 0) & (F.size("extra") == 0)
    return out.select("family_id", "missing", "extra", F.when(same_set, F.col("moved")).otherwise(none).alias("moved")).filter("size(missing) + size(extra) + size(moved) > 0")


def bad_traits(samples: DataFrame) -> DataFrame:
    """Rows whose trait is neither blank nor a finite number; samples: yield_raw."""
    return samples.filter((stripped(F.col("yield_raw")) != "") & trait_of(F.col("yield_raw")).isNull())


def strict_traits(samples: DataFrame) -> DataFrame:
    """Samples with a trait, as a number; blank ones are left out."""
    return samples.filter(stripped(F.col("yield_raw")) != "").withColumn("yield", trait_of(F.col("yield_raw"))).drop("yield_raw")


def empty_families(samples: DataFrame, kept: DataFrame) -> DataFrame:
    return samples.select("family_id").distinct().join(kept.select("family_id").distinct(), "family_id", "left_anti")


def unknown_calls(calls: DataFrame) -> DataFrame:
    """family_id and the sorted symbols that are neither a call nor missing."""
    bad = calls.filter(~is_missing_call(F.col("call")) & dosage_of(F.col("call")).isNull())
    return bad.groupBy("family_id").agg(F.array_sort(F.collect_set(stripped(F.col("call")))).alias("symbols"))


def validate(phenotype: DataFrame, headers: DataFrame, calls: DataFrame) -> DataFrame:
    """All violations of a data set. phenotype: sample_pos, sample_id, yield_raw; headers: genotype sample names."""
    markers = calls.select("family_id", "marker_id", "marker_pos").distinct()
    pairs = sample_sets(phenotype, headers)
    consistent = marker_consistency(markers)
    retained = strict_traits(without_founders(phenotype))
    known = calls.join(retained.select("family_id", "sample_id"), ["family_id", "sample_id"], "left_semi")
    traits = bad_traits(without_founders(phenotype)).groupBy("family_id").agg(F.array_sort(F.collect_list(F.concat_ws("=", "sample_id", "yield_raw"))).alias("ids"))
    parts = [
        empty_ids(phenotype, "sample_id", "sample_pos", "phenotype sample"),
        empty_ids(headers, "sample_id", "sample_pos", "genotype sample"),
        empty_ids(markers, "marker_id", "marker_pos", "marker"),
        duplicate_ids(phenotype, "sample_id", "phenotype sample"),
        duplicate_ids(headers, "sample_id", "genotype sample"),
        duplicate_ids(markers, "marker_id", "marker"),
        _violation(pairs.filter("size(phenotype_only) > 0"), "sample sets differ", "phenotype_only", F.col("phenotype_only")),
        _violation(pairs.filter("size(genotype_only) > 0"), "sample sets differ", "genotype_only", F.col("genotype_only")),
        _violation(consistent.filter("size(missing) + size(extra) > 0"), "marker set differs", "marker", F.concat("missing", "extra")),
        _violation(consistent.filter("size(moved) > 0"), "marker order differs", "marker", F.col("moved")),
        _violation(traits, "trait is not a number", "phenotype sample", F.col("ids")),
        _violation(empty_families(phenotype, retained), "no sample left", "family", F.array()),
        _violation(unknown_calls(known), "unknown call", "symbol", F.col("symbols")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assert_valid(violations: DataFrame) -> None:
    rows = violations.orderBy("family_id", "check", "kind").limit(20).collect()
    if rows:
        raise ValidationError("; ".join(f"family {r['family_id']}: {r['check']} ({r['kind']}): {', '.join(r['ids'] or [])}" for r in rows))


def align(phenotype: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls of the samples that have a trait, with it; phenotype order is in sample_pos."""
    kept = strict_traits(without_founders(phenotype)).select("family_id", "sample_id", F.col("sample_pos").alias("_pos"), "yield")
    return calls.join(kept, ["family_id", "sample_id"]).withColumn("sample_pos", F.col("_pos")).drop("_pos")


#: Fixed value: a range of traits up to this counts as constant.
EPSILON = 2.220446049250313e-16


def fold_guards(samples: DataFrame, value: str = "yield", least: int = 3) -> DataFrame:
    """held_out_family, n, low, high, trainable: the training traits of every fold, from one row a family.

    A fold can be trained if all traits are finite, at least `least` are there and they are not constant.
    """
    y = F.col(value).cast("double")
    bad = y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))
    per = samples.groupBy("family_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.min(y).alias("low"), F.max(y).alias("high"))
    other = per.select(F.col("family_id").alias("held_out_family"))
    pairs = other.join(F.broadcast(per), F.col("family_id") != F.col("held_out_family"))  # families x families
    out = pairs.groupBy("held_out_family").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.min("low").alias("low"), F.max("high").alias("high"))
    return out.select("held_out_family", "n", "low", "high", ((F.col("bad") == 0) & (F.col("n") >= least) & (F.col("high") - F.col("low") > EPSILON)).alias("trainable"))


def marker_set_sizes(dosage: DataFrame) -> DataFrame:
    """family_id, n_markers, all_markers: a family lacks markers if the two differ."""
    pairs = dosage.select("family_id", "marker_pos").distinct()
    every = pairs.select("marker_pos").distinct().agg(F.count(F.lit(1)).alias("all_markers"))
    return pairs.groupBy("family_id").agg(F.count(F.lit(1)).alias("n_markers")).join(F.broadcast(every), F.lit(True))


def require_trainable(samples: DataFrame, dosage: DataFrame, value: str = "yield", least: int = 3) -> None:
    """Raises unless every fold can be trained, all families have the same markers and all dosages are -1, 0, 1 or missing."""
    if rows := fold_guards(samples, value, least).filter("not trainable").limit(5).collect():
        raise ValidationError(f"training traits not finite, too few or constant for the folds of {[r['held_out_family'] for r in rows]}")
    if rows := marker_set_sizes(dosage).filter("n_markers <> all_markers").limit(5).collect():
        raise ValidationError(f"marker sets differ: {[(r['family_id'], r['n_markers'], r['all_markers']) for r in rows]}")
    if rows := dosage.filter("dosage is not null and dosage not in (-1, 0, 1)").limit(5).collect():
        raise ValidationError(f"dosages that are none: {[r['dosage'] for r in rows]}")


def require_thresholds(rate: float, maf: float, variance: float) -> None:
    """Raises unless marker thresholds lie where they mean something."""
    if not (0 <= rate <= 1 and 0 <= maf <= 0.5 and 0 <= variance < float("inf")):
        raise ValidationError(f"thresholds out of range: observed rate {rate}, allele frequency {maf}, variance {variance}")
