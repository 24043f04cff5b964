"""File manifests, tables, catalogs and resumable output."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STORE = r"^(.*\.zarr)(/|$)"


def manifest(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path, length, modified`` of the files whose name matches, contents
    unread; a chunked store counts once, under its own name, and its members
    do not count as files."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(root).select("path", "length", "modificationTime"))
    store = F.regexp_extract("path", STORE, 1)
    unit = F.when(store != "", store).otherwise(F.col("path"))
    units = files.groupBy(unit.alias("path")).agg(F.sum("length").alias("length"), F.max("modificationTime").alias("modified"))
    return units.where(F.substring_index("path", "/", -1).rlike("^" + fnmatch.translate(glob)))


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """Measurement or score CSV with a declared schema."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def read_padded(spark: SparkSession, path: str, list_columns: list[str] = ()) -> DataFrame:
    """CSV whose values are padded with blanks; ``;`` lists become arrays."""
    raw = (spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "true")
           .option("ignoreTrailingWhiteSpace", "true").csv(path))
    out = raw.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in raw.columns])
    for c in list_columns:
        out = out.withColumn(c, F.transform(F.split(c, ";"), F.trim))
    return out


SPLIT_SCHEMA = T.StructType([T.StructField(s, T.ArrayType(T.StringType())) for s in ("train", "val", "test")])


def read_split(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``{"train": [...], "val": [...], "test": [...]}`` as ``path, split``."""
    wide = spark.read.schema(SPLIT_SCHEMA).option("multiLine", str(multi_line).lower()).json(path)
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("paths")) for s in ("train", "val", "test")]))
    return wide.select(sides.alias("s")).select(F.explode("s.paths").alias("path"), F.col("s.split").alias("split"))


def resolve_voxel_size(dataset_attr: Column, root_attr: Column, dataset_order: Column, root_order: Column, default: Column) -> Column:
    """zyx voxel size: dataset attribute, else root attribute, else default.

    The order text belongs to the attribute used; without one the stored
    values are taken as xyz.
    """
    def clean(order):
        return F.regexp_replace(F.lower(order), r"[^zyx]", "")

    def zyx(value, order):
        return F.when(clean(order).startswith("z"), value).otherwise(F.reverse(value))

    return (F.when(dataset_attr.isNotNull(), zyx(dataset_attr, dataset_order))
            .when(root_attr.isNotNull(), zyx(root_attr, root_order)).otherwise(default))


def pending(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without an output row yet."""
    return tasks.join(done, keys, "left_anti")


def append_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("append").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """All appended score rows with the union of their columns."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def round_significant(v: Column, digits: int = 10) -> Column:
    """Rounded to a number of significant digits; 0 stays 0."""
    scale = F.pow(F.lit(10.0), digits - F.ceil(F.log10(F.abs(v))))
    return F.when(v == 0, F.lit(0.0)).otherwise(F.round(v * scale) / scale)


def repair_multiscale(levels: DataFrame, default: list[float], unit: str = "micrometer") -> DataFrame:
    """Voxel size of every pyramid level and the rebuilt metadata document.

    ``levels``: store, parent, level (``s0`` ...), shape array, voxel_size array
    (known only at ``s0``, or NULL).  A store without a size takes that of its
    first sibling with the same ``s0`` shape, else ``default``.
    """
    base = levels.where("level = 's0'").select("store", "parent", F.col("shape").alias("shape0"), F.col("voxel_size").alias("own"))
    known = base.where("own is not null").groupBy("parent", "shape0").agg(F.min(F.struct("store", "own")).alias("_s"))
    base = base.join(known, ["parent", "shape0"], "left").select(
        "store", "shape0", F.coalesce("own", "_s.own", F.array(*[F.lit(float(d)) for d in default])).alias("size0"))
    sized = levels.join(base, "store")
    size = F.transform(F.arrays_zip("size0", "shape0", "shape"), lambda e: round_significant(e["size0"] * e["shape0"] / e["shape"]))
    return sized.select("store", "level", "shape", size.alias("voxel_size"))


def multiscale_document(sizes: DataFrame, unit: str = "micrometer") -> DataFrame:
    """One JSON document per store; a store has a handful of levels."""
    axes = F.array(*[F.struct(F.lit(a).alias("name"), F.lit("space").alias("type"), F.lit(unit).alias("unit")) for a in ("z", "y", "x")])
    entry = F.struct(F.col("level").alias("path"), F.array(F.struct(F.lit("scale").alias("type"), F.col("voxel_size").alias("scale"))).alias("coordinateTransformations"))
    number = F.regexp_extract("level", r"(\d+)", 1).cast("int")
    listed = sizes.groupBy("store").agg(F.array_sort(F.collect_list(F.struct(number.alias("i"), entry.alias("e")))).alias("_l"))
    doc = F.struct(F.lit("0.4").alias("version"), axes.alias("axes"), F.transform("_l", lambda s: s["e"]).alias("datasets"))
    return listed.select("store", F.to_json(F.struct(F.array(doc).alias("multiscales"))).alias("attrs"))


def guarded_copy(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Source datasets whose shape equals the target's; only these may be copied."""
    shape = ["nz", "ny", "nx"]
    return source.join(target.select(*keys, *[F.col(s).alias(f"_{s}") for s in shape]), keys).where(
        (F.col("nz") == F.col("_nz")) & (F.col("ny") == F.col("_ny")) & (F.col("nx") == F.col("_nx"))).drop(*[f"_{s}" for s in shape])
