import gzip
import hashlib

import pytest

from family_files import write_family, write_smoke
from lociframe.operators import qc
from lociframe.plans import workloads
from lociframe.sources import readers, sinks


def parts(spark, folder):
    files = readers.list_family_files(spark, str(folder))
    return readers.read_phenotypes(spark, files), readers.read_genotype_headers(spark, files), readers.read_calls(spark, files)


def checks(spark, folder):
    return {(r["check"], r["kind"], r["family_id"]): r["ids"] for r in qc.validate(*parts(spark, folder)).collect()}


def test_parent_is_left_out_and_missing_calls_are_null(spark, tmp_path):
    write_family(tmp_path, "P1_NAM01", ["P1", "RIL-1", "RIL-2"], [400, 500, 600], ["m1", "m2"], [["A", "-", "B"], ["B", "A/B", "A"]])
    _, samples, dosage = workloads.load_strict(spark, str(tmp_path))
    got = {(r["sample_id"], r["marker_id"]): (r["dosage"], r["yield"]) for r in dosage.collect()}
    assert got == {("RIL-1", "m1"): (None, 500.0), ("RIL-1", "m2"): (0, 500.0), ("RIL-2", "m1"): (1, 600.0), ("RIL-2", "m2"): (-1, 600.0)}
    assert samples.count() == 2


def test_blank_trait_is_dropped_and_text_is_an_error(spark, tmp_path):
    write_family(tmp_path, "P1_NAM01", ["RIL-1", "RIL-2"], ["", "5"], ["m1"], [["A", "B"]])
    assert [r["sample_id"] for r in workloads.load_strict(spark, str(tmp_path))[1].collect()] == ["RIL-2"]
    write_family(tmp_path, "P1_NAM01", ["RIL-1", "RIL-2"], ["abc", "5"], ["m1"], [["A", "B"]])
    with pytest.raises(qc.ValidationError, match="abc"):
        workloads.load_strict(spark, str(tmp_path))


def test_rejections(spark, tmp_path):
    write_family(tmp_path, "P1_NAM01", ["R1", "R1", " "], [1, 2, 3], ["m1", "m1"], [["A", "B", "X"], ["A", "B", "A"]])
    write_family(tmp_path, "P2_NAM02", ["R3"], [1], ["m2", "m1"], [["A"], ["Q"]])
    found = checks(spark, tmp_path)
    assert found["duplicate id", "phenotype sample", "P1_NAM01"] == ["R1"]
    assert found["duplicate id", "genotype sample", "P1_NAM01"] == ["R1"]
    assert ("empty id", "phenotype sample", "P1_NAM01") in found and ("empty id", "genotype sample", "P1_NAM01") in found
    assert found["duplicate id", "marker", "P1_NAM01"] == ["m1"]
    assert found["unknown call", "symbol", "P2_NAM02"] == ["Q"]
    assert found["marker set differs", "marker", "P2_NAM02"] == ["m2"]


def test_marker_order(spark, tmp_path):
    write_family(tmp_path, "P1_NAM01", ["R1"], [1], ["m1", "m2"], [["A"], ["B"]])
    write_family(tmp_path, "P2_NAM02", ["R2"], [1], ["m2", "m1"], [["A"], ["B"]])
    assert checks(spark, tmp_path) == {("marker order differs", "marker", "P2_NAM02"): ["m1", "m2"]}


def test_pairing_errors(spark, tmp_path):
    write_family(tmp_path, "P1_NAM01", ["R1"], [1], ["m1"], [["A"]])
    (tmp_path / "P2_NAM02_phenotype_data.tsv.gz").write_bytes(gzip.compress(b"Corrected Strain\tYld (kg/ha)\n"))
    with pytest.raises(readers.InputError, match="P2_NAM02"):
        readers.list_family_files(spark, str(tmp_path))
    (tmp_path / "P2_NAM02_phenotype_data.tsv.gz").unlink()
    write_family(tmp_path, "P1_NAM01", ["R1"], [1], ["m1"], [["A"]], number="")
    with pytest.raises(readers.InputError, match="several"):
        readers.list_family_files(spark, str(tmp_path))


def test_missing_trait_column(spark, tmp_path):
    write_family(tmp_path, "P1_NAM01", ["R1"], [1], ["m1"], [["A"]], trait_column="Weight")
    with pytest.raises(readers.InputError, match="P1_NAM01"):
        readers.read_phenotypes(spark, readers.list_family_files(spark, str(tmp_path)))


def test_run_publishes_once_and_notices_changes(spark, tmp_path):
    data, out = tmp_path / "data", tmp_path / "out"
    data.mkdir()
    write_smoke(data)
    final = workloads.run_gblup(spark, str(data), str(out), "run-1")
    oof = spark.read.parquet(f"{final}/oof")
    assert oof.columns == sinks.OOF_COLUMNS and oof.count() == 18
    assert spark.read.option("header", True).csv(f"{out}/oof_predictions").count() == 18
    with pytest.raises(FileExistsError):
        workloads.run_gblup(spark, str(data), str(out), "run-1")
    files = readers.list_family_files(spark, str(data)).collect()
    files = spark.createDataFrame(files)
    found = readers.describe_input_files(spark, files)
    before = spark.createDataFrame(found.collect(), found.schema)
    readers.verify_inputs_unchanged(readers.describe_input_files(spark, files), before)
    with gzip.open(data / "Founder1_NAM01_phenotype_data.tsv.gz", "at") as f:
        f.write("x\tnew\t1\n")
    with pytest.raises(readers.InputError, match="Founder1_NAM01"):
        readers.verify_inputs_unchanged(readers.describe_input_files(spark, files), before)
    digest = hashlib.sha256((data / "Founder2_NAM02_phenotype_data.tsv.gz").read_bytes()).hexdigest()
    assert before.filter("family_id = 'Founder2_NAM02'").first()["phenotype_sha256"] == digest


def test_sinks_keep_order_and_replace(spark, tmp_path):
    rows = [("B", f"s{9 - i}", i, 1.0, 2.0) for i in range(10)] + [("A", f"t{i}", 20 - i, 1.0, 2.0) for i in range(10)]
    df = spark.createDataFrame(rows, "family_id string, sample_name string, sample_pos int, observed_yield_kg_ha double, predicted_yield_kg_ha double")
    path = str(tmp_path / "oof")
    for n in (1, 2):
        sinks.write_oof(df.repartition(5), path)
        lines = [x for p in sorted((tmp_path / "oof").glob("part-*")) for x in p.read_text().split("\n")[1:] if x]
        assert [x.split(",")[1] for x in lines] == [f"t{i}" for i in range(9, -1, -1)] + [f"s{9 - i}" for i in range(10)]
    assert [p.name for p in tmp_path.iterdir()] == ["oof"]
    table = str(tmp_path / "table")
    for n in (3, 4):
        sinks.write_modelling_table(df.limit(n), table)
        assert readers.read_modelling_table(spark, table).count() == n
    with pytest.raises(OSError):
        sinks.publish(spark, str(tmp_path / "nothing"), table, replace=True)
    assert readers.read_modelling_table(spark, table).count() == 4


def test_processed_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",yield,family_id\ns1,1.5,A\ns2,x,B\ns3,2,A\n")
    (tmp_path / "b.csv").write_text(",yield\n" + "".join(f"s{i},{i}\n" for i in range(25)))
    samples, plan = readers.read_processed_phenotypes(spark, str(tmp_path / "a.csv"))
    assert {(r["sample_id"], r["yield"], r["family_id"], r["fold_index"]) for r in samples.collect()} == {("s1", 1.5, "A", 0), ("s2", None, "B", 1), ("s3", 2.0, "A", 0)} and plan.count() == 2
    samples, plan = readers.read_processed_phenotypes(spark, str(tmp_path / "b.csv"), k=5)
    assert plan.count() == 5 and sorted(r["count"] for r in samples.groupBy("fold_index").count().collect()) == [5] * 5
    (tmp_path / "map.csv").write_text("snp,chrom,gene\n0,1,4\n1,1,5\n")
    (tmp_path / "edges.csv").write_text("u,v\n4,5\n5,4\n")
    assert [tuple(r) for r in readers.read_marker_map(spark, str(tmp_path / "map.csv")).collect()] == [(0, 4), (1, 5)]
    assert [tuple(r) for r in readers.read_edges(spark, str(tmp_path / "edges.csv")).collect()] == [(4, 5), (5, 4)]
    (tmp_path / "edges.csv").write_text("u,v\n4,\n")
    with pytest.raises(readers.InputError):
        readers.read_edges(spark, str(tmp_path / "edges.csv"))
