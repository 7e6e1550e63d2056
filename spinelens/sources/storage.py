"""Files of a corpus as Python tasks open them: local paths and the URIs that Arrow's file systems know."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyarrow import fs
from pyspark.sql import SparkSession


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a path or URI (``file:``, ``s3:``, ``s3a:``, ``hdfs:``, ``gs:``)."""
    if not re.match("[a-zA-Z][a-zA-Z0-9+.-]*:/", path):
        return fs.LocalFileSystem(), os.path.abspath(path)
    uri = re.sub("^file:/+", "file:///", re.sub("^s3[an]://", "s3://", path))
    if uri.startswith("file:///"):
        return fs.LocalFileSystem(), uri.removeprefix("file://")
    return fs.FileSystem.from_uri(uri)


def importable(spark: SparkSession) -> None:
    """Let Python workers that find this library on the driver's path import it too."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
