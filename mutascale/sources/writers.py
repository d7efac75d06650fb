"""Writers."""

from __future__ import annotations

import time
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame

from mutascale.functions.scalar import quoted
from mutascale.session import files, file_system
from mutascale.sources import schemas

#: The file that makes a version of a published set visible; written last.
COMMITTED = "_COMMITTED"


def write_parquet(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Parquet table, replaced if it exists."""
    writer = df.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)


def write_text_table(df: DataFrame, path: str, header: bool = True, separator: str = "\t") -> None:
    """Text table, tab-separated by default."""
    df.write.mode("overwrite").option("sep", separator).option("header", header).csv(path)


def write_annotator_input(df: DataFrame, path: str) -> None:
    """The six columns an annotator reads: headerless, tab-separated."""
    write_text_table(df.select(*schemas.ANNOTATOR_INPUT), path, header=False)


def write_by_panel(df: DataFrame, path: str) -> None:
    """Sweep results, one folder per panel."""
    df.write.mode("overwrite").partitionBy("panel_id").parquet(path)


def write_publications(df: DataFrame, folder: str) -> dict[str, str]:
    """The complete, concise and minimal tables as lz4 parquet below ``folder``.

    The complete table is written first and read back for the other two, so the plan behind ``df`` runs once and
    nothing is held in memory for it.
    """
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in ("complete", "concise", "minimal")}
    write_parquet(df, paths["complete"], "lz4_raw")
    stored = df.sparkSession.read.parquet(paths["complete"])
    for name, columns in (("concise", schemas.CONCISE_COLUMNS), ("minimal", schemas.MINIMAL_COLUMNS)):
        write_parquet(stored.select(*[quoted(c) for c in columns]), paths[name], "lz4_raw")
    return paths


def publish_set(df: DataFrame, folder: str) -> str:
    """The three tables as a new version below ``folder``, visible as a whole or not at all; returns the version's folder.

    A version counts once its marker is there, and the marker is written after the tables. So a reader never sees one table
    without the others, a run that fails leaves the version before it in force, and no rename has to be atomic.
    """
    path = f"{folder.rstrip('/')}/set-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    write_publications(df, path)
    fs, marker = file_system(df.sparkSession, f"{path}/{COMMITTED}")
    fs.create(marker, False).close()
    return path


def write_panels(panels: DataFrame, folder: str) -> None:
    """Interval files ``<panel>_<number>.bed`` without a header, as ``read_panels`` takes them; a large panel gets several.

    Only file names pass through the driver. A panel's name may not hold an underscore, since the reader cuts there.
    """
    spark, folder = panels.sparkSession, folder.rstrip("/")
    staged = f"{folder}/_staged-{uuid.uuid4().hex}"
    rows = panels.select("panel", "chr", "istart", "iend").hint("rebalance", "panel")
    rows.write.partitionBy("panel").option("sep", "\t").csv(staged)
    for number, source in enumerate(files(spark, f"{staged}/panel=*/part-*")):
        panel = unquote(source.rsplit("/", 2)[1].split("=", 1)[1])
        fs, target = file_system(spark, f"{folder}/{panel}_{number}.bed")
        if not fs.rename(file_system(spark, source)[1], target):
            raise OSError(f"cannot name {source} {target}")
    fs, path = file_system(spark, staged)
    fs.delete(path, True)
