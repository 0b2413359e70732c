"""Extraction over a table of files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.extract import javascript, python

SYMBOLS = "array<struct<name:string,kind:string,line:int,end_line:int,exported:boolean,doc:string>>"
IMPORTS = "array<struct<raw:string,line:int>>"
SCHEMA = f"path string, language string, symbols {SYMBOLS}, imports {IMPORTS}, parse_errors int, reason string"
#: Characters of a failure's reason.
REASON = 200


def extract(files: DataFrame) -> DataFrame:
    """One row per parse target of ``files`` (path, language, text); a file that fails has a reason, and never
    stops the others."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, language, text in zip(frame["path"], frame["language"], frame["text"]):
                try:
                    got = (python if language == "python" else javascript).extract(text or "")
                    rows.append((path, language, got["symbols"], got["imports"], got["errors"], None))
                except Exception as e:
                    rows.append((path, language, [], [], 1, " ".join(str(e).split())[:REASON] or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "language", "symbols", "imports", "parse_errors", "reason"])

    return files.select("path", "language", "text").mapInPandas(run, SCHEMA)


def symbols(extracts: DataFrame) -> DataFrame:
    """The flat relation of symbols, with their position in the file."""
    return extracts.select("path", F.posexplode("symbols").alias("pos", "s")).select("path", F.col("pos").cast("long"), "s.*")


def imports(extracts: DataFrame) -> DataFrame:
    return extracts.select("path", "language", F.posexplode("imports").alias("pos", "i")).select("path", "language", F.col("pos").cast("long"), "i.*")


def scaffolds(files: DataFrame) -> DataFrame:
    """``files`` (path, language, text, ranges array<struct<start,end,step>>) with their bodies cut out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for language, text, ranges in zip(frame["language"], frame["text"], frame["ranges"]):
                spans = [(r["start"], r["end"], r["step"]) for r in (ranges if ranges is not None else [])]
                out.append((python if language == "python" else javascript).scaffold(text or "", spans))
            yield pd.DataFrame({"path": frame["path"], "text": out})

    return files.select("path", "language", "text", "ranges").mapInPandas(run, "path string, text string")
