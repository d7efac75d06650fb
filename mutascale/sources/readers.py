"""Readers. Types are declared, never inferred; text tables are tab-separated."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mutascale.functions.scalar import decode_number, quoted
from mutascale.session import files
from mutascale.sources import schemas
from mutascale.sources.writers import COMMITTED


def read_text_table(
    spark: SparkSession, path: str, columns: list[str] | None = None, separator: str = "\t"
) -> DataFrame:
    """Header table with every column as text; ``columns`` prunes the scan."""
    table = _existing(path, lambda: spark.read.option("sep", separator).option("header", True).csv(path))
    return table if columns is None else table.select(*[quoted(c) for c in columns])


def read_typed_table(spark: SparkSession, path: str, schema: T.StructType, separator: str = "\t") -> DataFrame:
    """Header table with the types of the given columns, found by name."""
    text = read_text_table(spark, path, schema.fieldNames(), separator)
    return text.select(*[quoted(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_sheet(spark: SparkSession, path: str, schema: T.StructType, columns: list[int], skip_rows: int) -> DataFrame:
    """Headerless comma-separated exports of sheets: pick columns by position, name them, skip the leading lines of each file.

    A sheet is a small file; ``multiLine`` keeps it unsplit, so the ids of its rows are consecutive and a row's place is its
    id less the smallest one of the file. The path may be a folder of such files.
    """
    layout = ", ".join(f"_c{i} string" for i in range(max(columns) + 1))
    raw = _existing(path, lambda: spark.read.schema(layout).option("multiLine", True).csv(path))
    placed = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__at"))
    line = F.col("__at") - F.min("__at").over(Window.partitionBy("__file"))
    kept = placed.withColumn("__line", line).where(F.col("__line") >= skip_rows)
    return kept.select(*[
        quoted(f"_c{place}").cast(f.dataType).alias(f.name) for place, f in zip(columns, schema.fields, strict=True)
    ])


def read_annotator_input(spark: SparkSession, path: str) -> DataFrame:
    """The headerless table that ``write_annotator_input`` wrote, every column as text."""
    layout = ", ".join(f"`{c}` string" for c in schemas.ANNOTATOR_INPUT)
    return _existing(path, lambda: spark.read.schema(layout).option("sep", "\t").csv(path))


def read_annotation(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """The annotator's output: row hash and ``keys`` as text, frequencies as numbers (``.`` is missing)."""
    text = read_text_table(spark, path, ["hash", *(keys or []), *schemas.ANNOTATION_FREQUENCIES, "cosmic96_coding"])
    return text.withColumns({c: decode_number(quoted(c)) for c in schemas.ANNOTATION_FREQUENCIES})


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table; a missing path is a FileNotFoundError."""
    return _existing(path, lambda: spark.read.parquet(path))


def read_panels(spark: SparkSession, folder: str, panels: list[str] | None = None) -> DataFrame:
    """All interval files ``panel*bed`` of a folder in one scan: panel, chr, istart, iend.

    The panel is the file name up to the first underscore. ``panels`` keeps files whose first seven characters are
    listed. An empty selection is a FileNotFoundError.
    """
    files = _existing(folder, lambda: (
        spark.read.schema(schemas.INTERVALS).option("sep", "\t").option("pathGlobFilter", "panel*bed").csv(folder)
    ))
    name = F.col("_metadata.file_name")
    named = files.select(F.split(name, "_")[0].alias("panel"), name.alias("__file"), "chr", "istart", "iend")
    if panels is not None:
        named = named.where(F.substring("__file", 1, 7).isin(panels))
    if named.isEmpty():
        raise FileNotFoundError(f"no panel in {folder}")
    return named.drop("__file")


def read_publication(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of the newest committed version of a published set."""
    versions = files(spark, f"{folder.rstrip('/')}/set-*/{COMMITTED}")
    if not versions:
        raise FileNotFoundError(f"no published set in {folder}")
    return read_parquet(spark, f"{versions[-1].rsplit('/', 1)[0]}/{table}")


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """Sweep results of all panels, as written by ``write_by_panel``."""
    return read_parquet(spark, folder)


def read_unique_panels(spark: SparkSession, path: str) -> DataFrame:
    """The panel id list without the repeats of a panel (new ids with a letter b-e)."""
    ids = read_typed_table(spark, path, schemas.PANEL_IDS, separator=",")
    return ids.where(~F.col("newID").rlike("[bcde]"))


def _existing(path: str, load):
    try:
        return load()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise
