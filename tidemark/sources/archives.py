"""Export archives: the latest one, safe extraction, and their tables."""

from __future__ import annotations

import os
import re
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CONVERSATION, PROJECT
from .json_arrays import elements
from .json_lines import exists


def latest_export(spark: SparkSession, folder: str, pattern: str = r"data-.*\.zip$") -> str | None:
    """The path of the newest file whose name matches."""
    if not exists(spark, f"{folder.rstrip('/')}/*.zip"):
        return None
    files = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/*.zip").select("path", "modificationTime").where(F.regexp_extract("path", "([^/]+)$", 1).rlike(f"^{pattern}"))
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()["p"]


def extract(archive: str, folder: str) -> list[str]:
    """Unpack an archive; a member that would land outside ``folder`` is refused before anything is written."""
    base = os.path.realpath(folder)
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            parts = re.split(r"[\\/]", name)
            if name.startswith(("/", "\\")) or ".." in parts or re.match(r"[A-Za-z]:", name) or os.path.commonpath([base, os.path.realpath(os.path.join(base, name))]) != base:
                raise ValueError(f"unsafe path in archive: {name}")
        z.extractall(base)
        return z.namelist()


def _rows(spark: SparkSession, path: str, schema) -> DataFrame:
    return elements(spark, path).select(F.from_json("raw", schema).alias("c")).select("c.*")


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """The conversations of an export; the file must be there and hold an array. A path may match several files, each with an array."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return _rows(spark, path, CONVERSATION)


def read_optional(spark: SparkSession, path: str, schema) -> DataFrame:
    """Another member of an export (USERS, MEMORIES, projects); a missing or broken file gives no rows, and so does an element without the first member."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    try:
        found = _rows(spark, path, schema) if exists(spark, path) else None
    except ValueError:
        found = None
    return spark.createDataFrame([], schema) if found is None else found.where(F.col(schema[0].name).isNotNull())


def project_names(spark: SparkSession, path: str) -> DataFrame:
    """(name, pos) of the projects of an export, pos ascending in its order; a missing or broken file gives none."""
    try:
        found = elements(spark, path) if exists(spark, path) else None
    except ValueError:
        found = None
    if found is None:
        return spark.createDataFrame([], "name string, pos string")
    return found.select(F.from_json("raw", PROJECT).alias("c"), F.col("at").alias("pos")).where("c.uuid IS NOT NULL AND c.name IS NOT NULL").select("c.name", "pos")


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """The projects of an export; a missing or broken file gives none."""
    return read_optional(spark, path, PROJECT)


USERS = "uuid string, full_name string, email_address string"
MEMORIES = "conversations_memory string, account_uuid string"


def upload(spark: SparkSession, local: str, folder: str) -> None:
    """Copy a local folder of extracted files to a folder that executors can read."""
    conf = spark._jsc.hadoopConfiguration()
    to = spark._jvm.org.apache.hadoop.fs.Path(folder)
    to.getFileSystem(conf).copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), to)


def mask_label(name: str) -> str:
    """A file name that doesn't tell whose export it is: long hexadecimal runs are cut to four digits."""
    return re.sub(r"[0-9a-f]{8,}(?:-[0-9a-f]{4,})*", lambda m: m[0][:4] + "…", name, flags=re.I)
