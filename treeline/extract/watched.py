"""Extraction in a watched process, and the memo of texts that killed it."""

from __future__ import annotations

import json
import os
import selectors
import struct
import subprocess
import sys
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.extract import api
from treeline.operators import lookup as L
from treeline.plans.session import kept

#: Memory and seconds that the parsing of one text may take.
MEGABYTES, SECONDS = 2048, 30.0


class Parser:
    """A parsing process with limits, begun anew after each death."""

    def __init__(self, megabytes: int, seconds: float, command: list[str] | None = None) -> None:
        self.seconds, self.run = seconds, None
        self.command = command or [sys.executable, "-m", "treeline.extract.child", str(megabytes)]

    def close(self) -> None:
        if self.run:
            self.run.kill()
            self.run.wait()
            self.run.stdin.close()
            self.run.stdout.close()
            self.run = None

    def parse(self, language: str, text: str) -> dict:
        """``got``, ``failed`` (why it isn't understood) or ``fatal`` (how it ended the process)."""
        if self.run is None:
            env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
            self.run = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=env)
            os.set_blocking(self.run.stdout.fileno(), False)
            os.set_blocking(self.run.stdin.fileno(), False)
        body = json.dumps({"language": language, "text": text}).encode()
        out, said, until = memoryview(struct.pack("<q", len(body)) + body), bytearray(), time.monotonic() + self.seconds
        with selectors.DefaultSelector() as ready:
            ready.register(self.run.stdin, selectors.EVENT_WRITE)
            ready.register(self.run.stdout, selectors.EVENT_READ)
            while True:
                left = until - time.monotonic()
                if left <= 0:
                    self.close()
                    return {"fatal": f"took more than {self.seconds:g} seconds"}
                for key, _ in ready.select(left):
                    if key.fileobj is self.run.stdin:
                        try:
                            out = out[os.write(key.fd, out[: 1 << 16]) :]
                        except OSError:
                            out = out[:0]
                        if not out:
                            ready.unregister(self.run.stdin)
                        continue
                    chunk = os.read(key.fd, 1 << 20)
                    if not chunk:
                        status = self.run.wait()
                        self.close()
                        return {"fatal": f"killed by signal {-status}" if status < 0 else "ended its process"}
                    said += chunk
                    if len(said) >= 8 and len(said) >= 8 + struct.unpack("<q", said[:8])[0]:
                        return json.loads(said[8:])


def watched(files: DataFrame, megabytes: int = MEGABYTES, seconds: float = SECONDS, command: list[str] | None = None) -> DataFrame:
    """As ``api.extract``, with ``fatal``: whether the text ended the process that parsed it, for the ``reason`` given.

    Each task has one such process; a text that ends it costs its own row and a new process, and no other text.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = Parser(megabytes, seconds, command)
        try:
            for frame in frames:
                rows = []
                for path, language, text in zip(frame["path"], frame["language"], frame["text"]):
                    told = parser.parse(language, text or "")
                    if got := told.get("got"):
                        rows.append((path, language, [tuple(s) for s in got["symbols"]], [tuple(i) for i in got["imports"]], got["errors"], None, False))
                    else:
                        rows.append((path, language, [], [], 1, (told.get("fatal") or told["failed"])[: api.REASON], "fatal" in told))
                yield pd.DataFrame(rows, columns=["path", "language", "symbols", "imports", "parse_errors", "reason", "fatal"])
        finally:
            parser.close()

    return files.select("path", "language", "text").mapInPandas(run, api.SCHEMA + ", fatal boolean")


def remembered(files: DataFrame, memo: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:  # noqa: ANN003
    """Extracts of ``files`` (path, language, sha, text) and the memo (language, sha, reason) for the next time.

    Texts in ``memo`` aren't parsed again; they have its reason.  Of equal texts that end the process, each costs its row
    this time and none the next.
    """
    fresh, known = L.unpoisoned(files, memo)
    got = kept(watched(fresh, **limits))
    empty = F.array().cast
    gone = known.select("path", "language", empty(api.SYMBOLS).alias("symbols"), empty(api.IMPORTS).alias("imports"), F.lit(1).alias("parse_errors"), "reason")
    died = got.filter("fatal").select("path", "reason").join(files.select("path", "language", "sha"), "path")
    memo = memo.select("language", "sha", "reason").unionByName(died.groupBy("language", "sha").agg(F.min("reason").alias("reason")))
    return got.drop("fatal").unionByName(gone), memo
