"""Digest snapshots: one Parquet folder per relation, under a version and a snapshot id."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def write(relations: dict[str, DataFrame], folder: str, snapshot: str) -> None:
    """Writes all relations and, last, the manifest: a snapshot without it is incomplete and isn't read."""
    at = f"{folder.rstrip('/')}/v{VERSION}/{snapshot}"
    spark = next(iter(relations.values())).sparkSession
    for name, df in relations.items():
        df.write.mode("overwrite").parquet(f"{at}/{name}")
    manifest = json.dumps({"version": VERSION, "snapshot": snapshot, "relations": sorted(relations)})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/manifest")


def try_write(relations: dict[str, DataFrame], folder: str, snapshot: str) -> str | None:
    """As :func:`write`, but a failure is told, not raised: the digest is there even if it can't be kept.

    Returns why nothing was written, or None.  A local folder that is a link, or is reached through one below the given
    folder, isn't written into.  What was begun has no manifest, so it isn't read.
    """
    local = folder.removeprefix("file://") if folder.startswith("file:") or "://" not in folder else None
    if local is not None:
        at = local.rstrip("/")
        for part in ("", f"v{VERSION}", snapshot):
            at = os.path.join(at, part) if part else at
            if os.path.islink(at):
                return f"{at} is a link"
    try:
        write(relations, folder, snapshot)
    except Exception as e:
        return " ".join(str(e).split())[:200] or type(e).__name__
    return None


def read(spark: SparkSession, folder: str, snapshot: str) -> dict[str, DataFrame]:
    """All relations of a snapshot; one that is missing or of another version is refused."""
    at = f"{folder.rstrip('/')}/v{VERSION}/{snapshot}"
    try:
        manifest = json.loads(spark.read.text(f"{at}/manifest").first()[0])
    except Exception as e:
        raise FileNotFoundError(f"no snapshot {snapshot} of version {VERSION} in {folder}") from e
    if manifest["version"] != VERSION:
        raise ValueError(f"snapshot {snapshot} has version {manifest['version']}, not {VERSION}")
    return {name: spark.read.parquet(f"{at}/{name}") for name in manifest["relations"]}


def newest(registry: DataFrame, by: str = "repo", at: str = "generated_at") -> DataFrame:
    """The newest row of each group."""
    rest = [c for c in registry.columns if c != by]
    return registry.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(at, "id")).alias("x")).select(by, *[f"x.{c}" for c in rest])


def write_json(df: DataFrame, path: str) -> None:
    """A relation as JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
