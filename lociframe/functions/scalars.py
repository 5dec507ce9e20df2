"""Column functions: identifiers, file names, allele arithmetic, labels, digests, sweep draws."""

from __future__ import annotations

import datetime
import secrets

from pyspark.sql import Column, functions as F

#: File name endings of phenotype and genotype files; the genotype ending may lack its number.
PHENOTYPE_SUFFIX = "_phenotype_data.tsv.gz"
GENOTYPE_SUFFIX = "_SNP_genotype_Wm82.a1.tsv.gz"
GENOTYPE_NUMBER = "_4312"
#: Call symbols and their dosages; missing symbols; cells that table readers take as missing.
DOSAGE_OF = {"A": -1, "A/A": -1, "H": 0, "A/B": 0, "B": 1, "B/B": 1}
MISSING_CALL = "-"
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def stripped(c: Column) -> Column:
    """Text without white space at its ends; null gives the empty text."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def founder_of(family: Column) -> Column:
    """The parent that a family is named after: what comes before the first _NAM."""
    return F.split(family, "_NAM", 2)[0]


def family_of_file(name: Column) -> Column:
    """Family id of a phenotype or genotype file name; null for other names."""
    return (
        F.when(name.endswith(PHENOTYPE_SUFFIX), F.left(name, F.char_length(name) - len(PHENOTYPE_SUFFIX)))
        .when(name.endswith(GENOTYPE_NUMBER + GENOTYPE_SUFFIX), F.left(name, F.char_length(name) - len(GENOTYPE_NUMBER + GENOTYPE_SUFFIX)))
        .when(name.endswith(GENOTYPE_SUFFIX), F.left(name, F.char_length(name) - len(GENOTYPE_SUFFIX)))
    )


def legacy_family_of_file(name: Column) -> Column:
    """The text before the first underscore."""
    return F.split_part(name, F.lit("_"), F.lit(1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def redacted(argument: Column) -> Column:
    """A recorded command-line argument with the directories of its data and output paths left out."""
    return F.regexp_replace(argument, r"(--(?:data|output)-dir[= ])(?:[^ ]*/)?([^ /]+)/?", "$1$2")


def dosage_of(call: Column) -> Column:
    """-1, 0 or 1 of a call symbol; null for missing and unknown ones."""
    out = None
    for symbol, value in DOSAGE_OF.items():
        test = stripped(call) == symbol
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.cast("tinyint")


def is_missing_call(call: Column) -> Column:
    return call.isNull() | (stripped(call) == MISSING_CALL)


def trait_of(raw: Column) -> Column:
    """A finite number, or null."""
    x = F.trim(raw).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def na_to_null(c: Column, tokens: list[str] = NA_TOKENS) -> Column:
    return F.when(~c.isin(tokens), c)


def finite(x: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def allele_frequency(mean: Column) -> Column:
    return (mean + 1) / 2


def clipped(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def minor(p: Column) -> Column:
    return F.least(p, 1 - p)


def heterozygosity(p: Column) -> Column:
    return 2 * p * (1 - p)


def fold_label(fold: Column, array: str, stage: str | None = None) -> Column:
    """fold_<number>[_<stage>]_<array>."""
    return F.format_string(f"fold_%03d{'_' + stage if stage else ''}_{array}", fold)


def run_id(now: datetime.datetime | None = None) -> str:
    """A new run id: UTC time to the second and eight random hex digits."""
    now = now or datetime.datetime.now(datetime.timezone.utc)
    return f"{now:%Y%m%dT%H%M%SZ}-{secrets.token_hex(4)}"


def log_uniform(u: Column, lo: float, hi: float) -> Column:
    return F.exp(F.log(F.lit(lo)) + u * (F.log(F.lit(hi)) - F.log(F.lit(lo))))


def uniform(u: Column, lo: float, hi: float) -> Column:
    return lo + u * (hi - lo)


def choice(u: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))
