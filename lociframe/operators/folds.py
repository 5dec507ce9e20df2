"""Cross-validation folds as tables of family lists; a fold's members are found by a predicate, never by an index list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def sorted_families(samples: DataFrame) -> DataFrame:
    return samples.select("family_id").distinct().orderBy("family_id")


def make_folds(samples: DataFrame) -> DataFrame:
    """fold_index, held_out_family, train_family_ids, test_family_ids: one fold for each family, in sorted order.

    The window has no partition: it is over the distinct families only.
    """
    families = samples.select("family_id").distinct()
    every = families.agg(F.array_sort(F.collect_list("family_id")).alias("all_ids"))
    return families.join(F.broadcast(every), F.lit(True)).select(
        (F.array_position("all_ids", F.col("family_id")).cast("int") - 1).alias("fold_index"),
        F.col("family_id").alias("held_out_family"),
        F.array_except("all_ids", F.array("family_id")).alias("train_family_ids"),
        F.array("family_id").alias("test_family_ids"),
    )


def require_folds(folds: DataFrame) -> None:
    if folds.count() < 2:
        raise ValueError("at least two families are needed")


def validation_families(folds: DataFrame, seed: int) -> DataFrame:
    """folds with validation_family (element (seed + fold) mod n of the training families), fit_family_ids, fold_seed."""
    at = ((F.lit(seed) + F.col("fold_index")) % F.size("train_family_ids")).cast("int")
    out = folds.filter(F.size("train_family_ids") >= 2).withColumn("validation_family", F.get("train_family_ids", at))
    return out.withColumn("fit_family_ids", F.array_except("train_family_ids", F.array("validation_family"))).withColumn("fold_seed", F.lit(seed) + 100 * F.col("fold_index"))


def fold_members(samples: DataFrame, folds: DataFrame) -> DataFrame:
    """samples by fold with their part, train or test: as many rows as samples times folds, for small tables."""
    return samples.join(F.broadcast(folds.select("fold_index", "held_out_family")), F.lit(True)).withColumn("part", F.when(F.col("family_id") == F.col("held_out_family"), "test").otherwise("train"))


def hashed_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def random_kfold(samples: DataFrame, k: int = 10, seed: int = 42, key: str = "sample_id") -> DataFrame:
    """samples with fold_index: parts of a hashed order whose sizes differ by one at most, larger ones first.

    Ranks are found by counting within ranges of the hash first, so no task orders the whole table.
    """
    head = lambda c: F.substring(c, 1, 2)
    hashed = samples.withColumn("_h", hashed_order(F.col(key), seed)).withColumn("_b", head(F.col("_h")))
    sizes = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # 256 rows at most
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    ranked = hashed.join(F.broadcast(before), "_b").withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1)
    q, r = F.floor(F.col("_total") / k), F.col("_total") % k
    fold = F.when(F.col("_i") < r * (q + 1), F.floor(F.col("_i") / (q + 1))).otherwise(r + F.floor(F.try_divide(F.col("_i") - r * (q + 1), q)))
    return ranked.withColumn("fold_index", fold.cast("int")).drop("_h", "_b", "_before", "_total", "_i")


def inner_holdout(folded: DataFrame, key: str = "sample_id") -> DataFrame:
    """For each fold, max(1, floor(n / 10)) of its n training samples, by an order hashed with the fold.

    folded: samples with fold_index (that of the part they test). Rows: fold (of training), key. As many samples as make a
    tenth are found by counting within 4096 ranges of the hash; only the range in which the tenth ends is put in order.
    """
    folds = folded.select(F.col("fold_index").alias("fold")).distinct()
    train = folded.join(F.broadcast(folds), F.col("fold_index") != F.col("fold"))
    hashed = train.withColumn("_h", F.md5(F.concat_ws(":", F.col("fold").cast("string"), F.col(key).cast("string")))).withColumn("_b", F.substring("_h", 1, 3))
    counts = hashed.groupBy("fold", "_b").agg(F.count(F.lit(1)).alias("_n"))  # 4096 rows a fold at most
    by = Window.partitionBy("fold")
    total, before = F.sum("_n").over(by), F.coalesce(F.sum("_n").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = counts.select("fold", "_b", "_n", before.alias("_before"), F.greatest(F.lit(1), F.floor(total / 10)).alias("_take")).filter("_before < _take")
    near = hashed.join(F.broadcast(cut), ["fold", "_b"])
    whole = near.filter("_before + _n <= _take").select("fold", key)
    at = F.col("_before") + F.row_number().over(Window.partitionBy("fold", "_b").orderBy("_h", key))
    return whole.unionByName(near.filter("_before + _n > _take").withColumn("_at", at).filter("_at <= _take").select("fold", key))


def group_kfold(samples: DataFrame, k: int = 5) -> DataFrame:
    """family_id, n, fold_index: families by size, largest first, each to the fold that is lightest then.

    Greedy over the family table (a row for each family) on the driver.
    """
    rows = samples.groupBy("family_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "family_id").collect()
    load, out = [0] * k, []
    for r in rows:
        fold = load.index(min(load))
        load[fold] += r["n"]
        out.append((r["family_id"], r["n"], fold))
    return samples.sparkSession.createDataFrame(out, f"family_id {samples.schema['family_id'].dataType.simpleString()}, n long, fold_index int")


def row_sum_digest(text: Column) -> Column:
    """Aggregate: a number that stands for the set of the rows' texts, whatever their order and partitions."""
    return F.sum(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)"))


def split_digest(samples: DataFrame, folds: DataFrame, strategy: str = "leave_one_family_out") -> DataFrame:
    """One row, split_digest: sha256 over the strategy, the samples with their places, and the folds with their families.

    Samples are folded into one number a family by map-side sums, so no task holds a family. folds: a row for each fold.
    """
    row = F.concat_ws(":", F.col("sample_pos").cast("string"), F.col("sample_id").cast("string"))
    per = samples.groupBy("family_id").agg(F.count(F.lit(1)).alias("n"), row_sum_digest(row).alias("d"))
    families = per.agg(F.array_sort(F.collect_list(F.concat_ws("=", F.col("family_id").cast("string"), F.col("n").cast("string"), F.col("d").cast("string")))).alias("f"))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    fold = F.concat_ws(":", F.lpad(F.col("fold_index").cast("string"), 6, "0"), ids("train_family_ids"), ids("test_family_ids"))
    plan = folds.agg(F.array_sort(F.collect_list(fold)).alias("p"))
    text = F.concat_ws(";", F.lit(strategy), F.array_join("f", "|"), F.array_join("p", "|"))
    return families.join(F.broadcast(plan), F.lit(True)).select(F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("split_digest"))


#: Places of a leaf of the sample tree; children of an inner node.
LEAF, FANOUT = 256, 16


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes one level up: of at most `fanout` children each, in order."""
    up = nodes.select("family_id", (F.col("level") + 1).alias("level"), F.floor(F.col("node") / fanout).cast("bigint").alias("node"), F.struct("node", "digest").alias("c"), "n")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: F.concat_ws("=", x["node"].cast("string"), x["digest"])), "|")
    return up.groupBy("family_id", "level", "node").agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("digest"))


def sample_tree(samples: DataFrame, leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """family_id, level, node, n, digest of a hash tree over the samples (family_id, sample_pos, sample_id) of each family.

    Node k of level 0 is the SHA-256 of the samples at the places from k * leaf on, in order, with their places; a node above
    is that of its children's numbers and digests. The one node of a family's highest level stands for the family: samples,
    places and membership. A group holds `leaf` places or `fanout` nodes (places are unique in a family; several samples at
    one all count, by name). Levels end where every family has one node, so their number is the logarithm of the largest.
    """
    name = F.struct(F.col("sample_pos").alias("p"), F.col("sample_id").cast("string").alias("s"))
    rows = samples.select(F.col("family_id").cast("string").alias("family_id"), F.floor(F.col("sample_pos") / leaf).cast("bigint").alias("node"), name.alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat_ws(":", x["p"].cast("string"), F.coalesce(x["s"], F.lit("")))), "|")
    level = rows.groupBy("family_id", "node").agg(F.count(F.lit(1)).alias("n"), F.sha2(text, 256).alias("digest")).select("family_id", F.lit(0).alias("level"), "node", "n", "digest")
    top = samples.agg(F.max("sample_pos").alias("m")).first()["m"]
    out, nodes = level, (int(top) // leaf + 1) if top is not None else 0
    while nodes > 1:
        level = _parents(level, fanout)
        out, nodes = out.unionByName(level), -(-nodes // fanout)
    return out


def tree_root(tree: DataFrame, folds: DataFrame, strategy: str = "leave_one_family_out") -> DataFrame:
    """One row, split_digest: SHA-256 of the strategy, the families' highest nodes and the folds (a row for each) with their
    families."""
    top = tree.groupBy("family_id").agg(F.max_by("digest", "level").alias("d"))
    families = top.agg(F.array_sort(F.collect_list(F.concat_ws("=", "family_id", "d"))).alias("f"))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    fold = F.concat_ws(":", F.lpad(F.col("fold_index").cast("string"), 6, "0"), ids("train_family_ids"), ids("test_family_ids"))
    plan = folds.agg(F.array_sort(F.collect_list(fold)).alias("p"))
    text = F.concat_ws(";", F.lit(strategy), F.array_join("f", "|"), F.array_join("p", "|"))
    return families.join(F.broadcast(plan), F.lit(True)).select(F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("split_digest"))


def tree_difference(a: DataFrame, b: DataFrame, leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """family_id, first_place, last_place of the leaves in which two trees (of the same leaf and fanout) differ.

    From the highest level down: only children of nodes that differ, or that one tree lacks, are compared. Trees should be
    stored: each level reads them.
    """
    top = max((x for x in (t.agg(F.max("level").alias("m")).first()["m"] for t in (a, b)) if x is not None), default=None)
    if top is None:
        return a.select("family_id", F.lit(0).cast("bigint").alias("first_place"), F.lit(0).cast("bigint").alias("last_place"))
    sides = a.select("level", "family_id", "node", F.col("digest").alias("da"), F.lit(None).cast("string").alias("db"))
    sides = sides.unionByName(b.select("level", "family_id", "node", F.lit(None).cast("string").alias("da"), F.col("digest").alias("db")))
    differing = None
    for level in range(top, -1, -1):
        own = sides.filter(F.col("level") == level)
        if differing is not None:
            own = own.withColumn("parent", F.floor(F.col("node") / fanout).cast("bigint")).join(differing.withColumnRenamed("node", "parent"), ["family_id", "parent"], "left_semi")
        both = own.groupBy("family_id", "node").agg(F.max("da").alias("da"), F.max("db").alias("db"))
        differing = both.filter(~F.col("da").eqNullSafe(F.col("db"))).select("family_id", "node")
    return differing.select("family_id", (F.col("node") * leaf).alias("first_place"), ((F.col("node") + 1) * leaf - 1).alias("last_place"))
