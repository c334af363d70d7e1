"""Reference panels: a folder with a manifest of checksums, a description, the profiles' table and their fractions."""

from __future__ import annotations

import hashlib
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countaxis.schema import check_panel
from countaxis.sources.tables import delimited


def verified(folder: Path, name: str, digest: str) -> Path:
    """A member of the folder with the given SHA-256; names that lead out of it are refused."""
    path = (folder / name).resolve()
    if not path.is_relative_to(folder.resolve()):
        raise ValueError(f"{name} leads out of the panel")
    with path.open("rb") as f:
        if hashlib.file_digest(f, "sha256").hexdigest() != digest:
            raise ValueError(f"{name} has another checksum")
    return path


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    """(panel: gene, profile, fraction; profiles; description). Members: dataset.toml ([files] name = sha256), panel.toml
    (schema_version 1, units fraction), profiles.tsv, and expression.parquet or expression.tsv (gene, profile, fraction)."""
    root = Path(folder)
    files = tomllib.loads((root / "dataset.toml").read_text())["files"]
    paths = {name: verified(root, name, digest) for name, digest in files.items()}
    about = tomllib.loads(paths["panel.toml"].read_text())
    if about.get("schema_version") != 1 or about.get("units") != "fraction":
        raise ValueError("unknown panel schema or units")
    profiles = delimited(spark, str(paths["profiles.tsv"]))
    source = next((n for n in paths if n.startswith("expression.")), None)
    if source is None:
        raise ValueError("the panel has no expression table")
    rows = spark.read.parquet(str(paths[source])) if source.endswith(".parquet") else delimited(spark, str(paths[source]))
    panel = rows.select("gene", "profile", F.col("fraction").cast("double").alias("fraction"))
    check_panel(panel)
    return panel, profiles, about
