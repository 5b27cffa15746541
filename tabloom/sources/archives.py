"""Binary inputs: ZIP entries and image files."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.session import checkpoint_dir

ENTRY = "archive string, entry_no int, name string, content binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def zip_entries(archives: DataFrame) -> DataFrame:
    """(archive, entry_no, name, content) for every file entry; folders are skipped, names lose their path."""

    def unpack(batches):
        import pandas as pd

        for batch in batches:
            for archive, content in zip(batch["archive"], batch["content"]):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for i, info in enumerate(z.infolist()):
                        if not info.is_dir():
                            rows.append((archive, i, info.filename.rsplit("/", 1)[-1], z.read(info)))
                yield pd.DataFrame(rows, columns=["archive", "entry_no", "name", "content"])

    return archives.select("archive", "content").mapInPandas(unpack, ENTRY)


def last_by_name(entries: DataFrame) -> DataFrame:
    """One row per base name: the last entry of the last archive wins."""
    row = F.struct("archive", "entry_no", "content")
    return entries.groupBy("name").agg(F.max_by(row, F.struct("archive", "entry_no")).alias("r")).select("name", "r.*")


def store_files(files: DataFrame, folder: str) -> DataFrame:
    """Write (name, content) rows as files below a shared folder; returns (name, size)."""
    target = folder if "://" in folder else folder.replace("file:", "", 1)
    if "://" not in target and not files.sparkSession.sparkContext.master.startswith("local"):
        # A folder that all machines mount has to be named as such: a local one would differ between executors.
        if not target.startswith(checkpoint_dir(files.sparkSession).replace("file://", "", 1).replace("file:", "", 1)):
            raise ValueError("name a shared folder: each executor would write to its own disk")

    def put(batches):
        import pandas as pd
        from pyarrow import fs

        filesystem, base = fs.FileSystem.from_uri(target)
        filesystem.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                with filesystem.open_output_stream(f"{base}/{name}") as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"name": batch["name"], "size": batch["content"].map(len)})

    return files.select("name", "content").mapInPandas(put, "name string, size bigint")


def read_images(spark: SparkSession, path: str, seen: DataFrame | None = None) -> DataFrame:
    """(name, size, image struct) of decodable files; (name, size) pairs of ``seen`` are skipped."""
    sizes = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    base = F.element_at(F.split("path", "/"), -1)
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image", F.col("image.origin").alias("origin"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    joined = images.join(sizes, plain(F.col("origin")) == plain(F.col("path"))).select(base.alias("name"), "size", "image")
    unique = joined.dropDuplicates(["name", "size"])
    return unique.join(seen.select("name", "size"), ["name", "size"], "left_anti") if seen is not None else unique
