"""Names and paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File-name taxonomy, tried in this order.
KNOCKOUT_LINE = r"^(Otof_AVCN\d+_[0-9A-Za-z]+)_(WT|KO)"
TOMOGRAM_ID = r"^(\d+_[A-Za-z]\d+)"
ANIMAL_ID = r"^(WT|KO|M)(\d+)"
TOMOGRAM_SOURCE = "cooper"
ANIMAL_SOURCE = "wichmann"
# Hyper-parameter tags, halo prefix and block name.
RUN_TAGS = {"sd": r"sd(\d+)", "ft": r"ft(\d+)", "bt": r"bt(\d+)"}
HALO_PREFIX = r"^.*halo_z\d+_y\d+_x\d+_"
BLOCK_NAME = r"block_z(\d{6})_(\d{6})_y(\d{6})_(\d{6})_x(\d{6})_(\d{6})"
BLOCK_FORMAT = "block_z%06d_%06d_y%06d_%06d_x%06d_%06d.h5"
# Removed, in this order, before model and recording names are compared.
MODEL_MARKS = ["_model2", "_model", ".mod", "model"]
RECORDING_MARKS = ["_SP.rec", "_rec", ".rec", ".mrc"]

BLOCK_FIELDS = ["z0", "z1", "y0", "y1", "x0", "x1"]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def specimen(path: Column) -> Column:
    """``struct(source, genotype, specimen)`` of a file path."""
    base = basename(path)
    line = F.regexp_extract(base, KNOCKOUT_LINE, 1)
    tomo = F.regexp_extract(base, TOMOGRAM_ID, 1)
    animal = F.regexp_extract(base, ANIMAL_ID, 1)
    genotype = (
        F.when(line != "", F.concat(F.lit("Otof-"), F.regexp_extract(base, KNOCKOUT_LINE, 2)))
        .when(tomo != "", F.lit(TOMOGRAM_SOURCE)).when(animal != "", animal).otherwise("other"))
    unit = (
        F.when(line != "", line).when(tomo != "", tomo)
        .when(animal != "", F.regexp_extract(base, ANIMAL_ID, 0)).otherwise(F.substring_index(base, "_", 1)))
    source = F.when(path.contains(TOMOGRAM_SOURCE), TOMOGRAM_SOURCE).otherwise(ANIMAL_SOURCE)
    return F.struct(source.alias("source"), genotype.alias("genotype"), unit.alias("specimen"))


def run_parameter(name: Column, tag: str) -> Column:
    found = F.regexp_extract(name, RUN_TAGS[tag], 1)
    return found.try_cast("long")


def after_halo(name: Column) -> Column:
    return F.regexp_replace(name, HALO_PREFIX, "")


def block_box(name: Column) -> list[Column]:
    return [F.regexp_extract(name, BLOCK_NAME, i + 1).try_cast("long").alias(c) for i, c in enumerate(BLOCK_FIELDS)]


def block_name(*box: Column) -> Column:
    return F.format_string(BLOCK_FORMAT, *box)


def parameter_tag(**values: Column) -> Column:
    """``sd1_bp15_...``: values without the decimal point."""
    parts = [F.concat(F.lit(k), F.regexp_replace(v.cast("string"), r"\.", "")) for k, v in values.items()]
    return F.concat_ws("_", *parts)


def strip_marks(name: Column, marks: list[str]) -> Column:
    for mark in marks:
        name = F.replace(name, F.lit(mark), F.lit(""))
    return name


def canonical_label(text: Column) -> Column:
    """Dataset key for a free-text structure name; the first rule that fits."""
    # The texts looked for and the keys they stand for.
    low = F.lower(text)
    inner = low.contains("cristae") | low.contains("inner")
    return (
        F.when(low.contains("az"), "labels/az")
        .when(low.contains("mito") & ~inner, "labels/mitochondria")
        .when(low.contains("cm") | inner, "labels/cristae")
        .when(low.contains("endbulb"), "labels/endbulb")
        .otherwise(F.concat(F.lit("labels/"), text)))


def contains_any(path: Column, needles: list[str]) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | path.contains(n)
    return hit
