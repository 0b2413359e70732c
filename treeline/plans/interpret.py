"""Interpretation by a model: content keys, a cache, and a provider that may be missing or fail.

A provider is ``DataFrame (key, prompt) -> DataFrame (key, answer)``.  It sees only what the cache hasn't; a null
answer is a failure: it is reported, never cached, and never counts as no change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.functions import keys as K
from treeline.functions import text as T

#: Version of the prompt, characters of a line and of all source in a prompt.
VERSION, LINE_CHARS, SOURCE_CHARS = "1", 1000, 200_000
MEANINGS = "array<struct<start:bigint,end:bigint,what:string,why:string,summary:string>>"


def excerpts(files: DataFrame, budget: int = SOURCE_CHARS) -> DataFrame:
    """``path``, ``excerpt``, ``left_out``: numbered lines, long ones clipped, as far as the budget goes."""
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("i", "raw"))
    lines = lines.withColumn("line", F.concat((F.col("i") + 1).cast("string"), F.lit(": "), T.clip(F.col("raw"), LINE_CHARS)))
    used = F.sum(F.length("line") + 1).over(W.partitionBy("path").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    lines = lines.withColumn("fits", used <= budget)
    rows = F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("i", "line"))))
    out = lines.groupBy("path").agg(rows.alias("rows"), F.count_if(~F.col("fits")).alias("left_out"))
    return out.select("path", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("excerpt"), "left_out")


def prompts(files: DataFrame, stops: DataFrame, importers: DataFrame, writer: str | None = None) -> DataFrame:
    """One (key, path, prompt) per file with stops; the key changes with all that the answer depends on."""
    ranges = stops.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    met = files.join(ranges, "path").join(excerpts(files), "path").join(importers.select("path", F.col("n").alias("importers")), "path", "left")
    places = F.array_join(F.transform("ranges", lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ", ")
    used_by = F.when(F.coalesce("importers", F.lit(0)) > 0, F.concat(F.lit("Imported by "), T.plural(F.col("importers"), "file"), F.lit("."))).otherwise("Nothing imports it.")
    prompt = F.concat_ws(
        "\n\n", F.concat(F.lit("File "), F.col("path"), F.lit(". "), used_by), F.concat(F.lit("Explain what and why, as JSON, for lines "), places),
        "excerpt", F.when(F.col("left_out") > 0, F.concat(T.plural(F.col("left_out"), "line"), F.lit(" left out."))),
    )
    key = K.digest(F.lit(VERSION), "sha256", places, F.lit(writer).cast("string"), F.when(F.col("left_out") > 0, F.sha2("excerpt", 256)), size=32)
    return met.select(key.alias("key"), "path", prompt.alias("prompt"))


def answers(asked: DataFrame, cache: DataFrame, provider: Callable[[DataFrame], DataFrame] | None) -> tuple[DataFrame, DataFrame]:
    """(key, answer) known or new, and the keys that have none.  Without a provider only the cache answers."""
    known = asked.select("key").distinct().join(cache.select("key", "answer"), "key")
    if provider is not None:
        fresh = provider(asked.select("key", "prompt").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti"))
        known = known.unionByName(fresh.select("key", "answer").filter("answer IS NOT NULL"))
    return known, asked.join(known.select("key"), "key", "left_anti").select("key", "path")


def meanings(asked: DataFrame, got: DataFrame) -> DataFrame:
    """Answers as rows (path, start, end, what, why, summary); an answer of another shape gives none."""
    parsed = asked.select("key", "path").join(got, "key").withColumn("m", F.explode(T.model_json(F.col("answer"), MEANINGS)))
    return parsed.select("path", "m.*").filter("start IS NOT NULL AND what IS NOT NULL")


def full_text(what: Column, why: Column, size: int = 1400) -> Column:
    return T.compress(F.concat_ws(" ", what, why), size)
