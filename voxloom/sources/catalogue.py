"""The catalogue of raw volumes: files below a root, listed by Spark without reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: top folders of the data that are a source group by themselves; all others are grouped below ``others``.
KEPT_GROUPS = ("MedidasDB",)


def catalogued(paths: DataFrame, root: str, kept: tuple[str, ...] = KEPT_GROUPS) -> DataFrame:
    """(volume_id, path, source_group) of those ``paths`` below ``root`` that end in .tif or .tiff, in any case.

    The id is the path below the root without its ending, with ``__`` for slashes and ``_`` for spaces. A file right in
    the root belongs to ``others/ungrouped``.
    """
    plain = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "%20", " ")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    rel = F.substring(plain, len(base) + 1, 1 << 30)
    rows = paths.where(F.lower("path").rlike(r"\.tiff?$") & plain.startswith(base)).withColumn("_rel", rel)
    top = F.split_part("_rel", F.lit("/"), F.lit(1))
    group = F.when(~F.contains("_rel", F.lit("/")), "others/ungrouped").when(top.isin(*kept), top).otherwise(F.concat(F.lit("others/"), top)) if kept else F.when(~F.contains("_rel", F.lit("/")), "others/ungrouped").otherwise(F.concat(F.lit("others/"), top))
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace("_rel", r"(?i)\.tiff?$", ""), "/", "__"), " ", "_")
    return rows.select(name.alias("volume_id"), "path", group.alias("source_group"))


def discovered(spark: SparkSession, root: str, kept: tuple[str, ...] = KEPT_GROUPS) -> DataFrame:
    """The catalogue of a folder; only names are listed, no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][iI][fF]*").load(root)
    return catalogued(files.select("path"), root, kept)
