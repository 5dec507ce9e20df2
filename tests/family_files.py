"""Small family files for reader and workload tests."""

import gzip

SYMBOL = {-1: "A", 0: "A/B", 1: "B"}


def write_family(folder, family, samples, traits, markers, calls, trait_column="Yld (kg/ha)", number="_4312"):
    with gzip.open(folder / f"{family}_phenotype_data.tsv.gz", "wt") as f:
        f.write(f"Other\tCorrected Strain\t{trait_column}\n")
        for s, y in zip(samples, traits):
            f.write(f"x\t{s}\t{y}\n")
    with gzip.open(folder / f"{family}{number}_SNP_genotype_Wm82.a1.tsv.gz", "wt") as f:
        f.write("\t".join(["marker", *samples]) + "\n")
        for m, row in zip(markers, calls):
            f.write("\t".join([m, *row]) + "\n")


def write_smoke(folder):
    for f in (1, 2, 3):
        samples = [f"F{f:02d}_RIL_{s:03d}" for s in range(6)]
        calls = [[SYMBOL[(-1, 0, 1)[(s + m + f) % 3]] for s in range(6)] for m in range(12)]
        write_family(folder, f"Founder{f}_NAM{f:02d}", samples, [3000 + 100 * f + 25 * s for s in range(6)], [f"marker_{m:03d}" for m in range(12)], calls)
