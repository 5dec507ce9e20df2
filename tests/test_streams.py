import gzip
import hashlib
import os

import numpy as np
import pytest
from family_files import write_family

from lociframe.operators import encode
from lociframe.plans import workloads
from lociframe.sources import readers, sinks, streams


def test_lines_are_numbered_by_file(spark, tmp_path):
    want = set()
    for f in range(12):
        lines = [f"h{f}", *[f"l{f}.{i}" if i % 5 else "" for i in range(1, 40 + f)]]
        with gzip.open(tmp_path / f"F{f}_SNP_genotype_Wm82.a1.tsv.gz", "wt", newline="") as out:
            out.write(("\r\n" if f % 2 else "\n").join(lines) + "\n")
        want |= {(f"F{f}", i, x) for i, x in enumerate(lines) if x}
    got = streams.numbered_lines(spark, [str(p) for p in tmp_path.iterdir()]).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_ragged_lines(spark, tmp_path):
    with gzip.open(tmp_path / "A_SNP_genotype_Wm82.a1.tsv.gz", "wt") as f:
        f.write("m\ts1\t s2 \nx\tA\nNA\tA\tNA\tB\n\ny\n")
    cells = readers.read_genotypes(spark, spark.createDataFrame([(str(tmp_path / "A_SNP_genotype_Wm82.a1.tsv.gz"),)], "genotype_path string"))
    assert sorted(map(tuple, readers.genotype_headers(cells).collect())) == [("A", 0, "s1"), ("A", 1, "s2")]
    got = sorted(tuple(r)[1:] for r in readers.genotype_calls(cells).collect())
    assert got == [(0, "x", 0, "s1", "A"), (1, "", 0, "s1", "A"), (1, "", 1, "s2", None), (1, "", 2, "", "B")]


def test_headers_without_samples(spark, tmp_path):
    write_family(tmp_path, "P1_NAM01", ["R1"], [1], ["m1"], [["A"]])
    with gzip.open(tmp_path / "P2_NAM02_SNP_genotype_Wm82.a1.tsv.gz", "wt") as f:
        f.write("marker\nx\n")
    files = spark.createDataFrame([(str(p),) for p in tmp_path.glob("*genotype*")], "genotype_path string")
    with pytest.raises(readers.InputError, match="P2_NAM02"):
        readers.read_genotype_headers(spark, files)


def test_files_of_over_two_gigabytes(spark, tmp_path):
    """More text than a row or a Java array can hold, in a session whose driver has 3 GB for everything."""
    path = tmp_path / "Big_SNP_genotype_Wm82.a1.tsv.gz"
    long, n = "n" * 4_000_000, 560
    with gzip.open(path, "wb", compresslevel=1) as f:
        f.write(b"marker\ts1\n")
        for i in range(n):
            f.write(f"{i}{long}\tA\n".encode())
    assert n * len(long) > 2**31
    cells = readers.genotype_calls(readers.read_genotypes(spark, spark.createDataFrame([(str(path),)], "genotype_path string")))
    got = cells.selectExpr("count(*) n", "sum(marker_pos) m", "min(length(marker_id)) low", "count_if(call = 'A' and sample_id = 's1') a").first()
    assert (got["n"], got["m"], got["a"]) == (n, n * (n - 1) // 2, n) and got["low"] == len(long) + 1


def test_checks_and_encoding_share_one_scan(spark, tmp_path):
    write_family(tmp_path, "P1_NAM01", ["R1", "R2"], [1, 2], ["m1"], [["A", "B"]])
    _, _, dosage = workloads.load_strict(spark, str(tmp_path))
    plan = dosage._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan and {(r["sample_id"], r["dosage"]) for r in dosage.collect()} == {("R1", -1), ("R2", 1)}


def test_digests_do_not_depend_on_pieces(spark, tmp_path, monkeypatch):
    data = {f"{i}.bin": os.urandom(size) for i, size in enumerate((0, 1, streams.PIECE - 1, streams.PIECE, 2 * streams.PIECE + 7))}
    for name, x in data.items():
        (tmp_path / name).write_bytes(x)
    paths = [f"file:{tmp_path}/{name}" for name in data]
    got = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in streams.digests(spark, paths).collect()}
    assert got == {name: hashlib.sha256(x).hexdigest() for name, x in data.items()}


def processed(folder, n=7, m=5, rows=None, trait="Yld (kg/ha)", family=True):
    x = np.random.default_rng(1).integers(-1, 2, (rows or n, m)).astype(np.int8)
    np.save(folder / "matrix.npy", x)
    head = f",{trait}" + (",family_id" if family else "")
    (folder / "y.csv").write_text(head + "\n" + "".join(f"s{i},{i + 0.5}" + (f",F{i % 3}" if family else "") + "\n" for i in range(n)))
    (folder / "map.csv").write_text("snp_id,gene_id,chromosome\n" + "".join(f"{j},{j % 2},9\n" for j in range(m)))
    return x, str(folder / "y.csv"), str(folder / "matrix.npy"), str(folder / "map.csv")


@pytest.mark.parametrize("family", [True, False])
def test_matrix_rows_stand_beside_their_samples(spark, tmp_path, monkeypatch, family):
    monkeypatch.setattr(streams, "RANGE", 10)
    monkeypatch.setattr(streams, "PIECE", 6)
    x, y, matrix, genes = processed(tmp_path, family=family)
    geno, plan = readers.read_processed(spark, y, matrix, genes, k=3)
    got = {r["sample_pos"]: r for r in geno.collect()}
    assert sorted(got) == list(range(7)) and plan.count() == 3
    for i, r in got.items():
        assert r["sample_id"] == f"s{i}" and r["yield"] == i + 0.5 and np.frombuffer(r["dosages"], np.int8).tolist() == x[i].tolist()
        assert not family or r["family_id"] == f"F{i % 3}"
    assert [r["gene_id"] for r in readers.read_marker_map(spark, genes).orderBy("marker_pos").collect()] == [0, 1, 0, 1, 0]
    assert encode.unpack(geno).count() == 35


def test_matrices_that_do_not_fit(spark, tmp_path):
    _, y, matrix, genes = processed(tmp_path, rows=6)
    with pytest.raises(readers.InputError, match="6 rows"):
        readers.read_processed(spark, y, matrix)
    _, y, matrix, genes = processed(tmp_path)
    (tmp_path / "map.csv").write_text("snp_id,gene_id\n0,1\n")
    with pytest.raises(readers.InputError, match="1 rows for 5"):
        readers.read_processed(spark, y, matrix, genes)
    for bad in (np.zeros((7, 5)), np.zeros(7, np.int8), np.asfortranarray(np.zeros((7, 5), np.int8))):
        np.save(tmp_path / "bad.npy", bad)
        with pytest.raises(ValueError, match="int8"):
            readers.read_processed(spark, y, str(tmp_path / "bad.npy"))
    processed(tmp_path, trait="weight")
    with pytest.raises(readers.InputError, match="Yld"):
        readers.read_processed(spark, y, matrix)


def test_a_run_id_survives_a_crash_and_samples_keep_their_order(spark, tmp_path):
    from family_files import write_smoke

    data, out = tmp_path / "data", tmp_path / "out"
    data.mkdir()
    write_smoke(data)
    # Names that sort against the order of the file.
    calls = [["A", "B", "A/B"] * 2 for _ in range(6)]
    calls[1] = calls[2] = ["B", "A", "A", "B", "B", "A"]
    write_family(data, "Founder4_NAM04", [f"r{9 - i}" for i in range(6)], [3000 + i * i for i in range(6)], [f"marker_{m:03d}" for m in range(12)], calls * 2)
    (out / ".tmp-run-1" / "oof").mkdir(parents=True)
    workloads.run_gblup(spark, str(data), str(out), "run-1")
    lines = [x for p in sorted((out / "oof_predictions").glob("part-*")) for x in p.read_text().split("\n")[1:] if x]
    assert [x.split(",")[1] for x in lines if x.startswith("Founder4")] == [f"r{9 - i}" for i in range(6)]
    assert spark.read.parquet(f"{out}/run-1/oof").columns == sinks.OOF_COLUMNS
