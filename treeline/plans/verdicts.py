"""Verdicts of a model on how far each file of a change moved: prompts, keys, answers, and what stands in for a failed one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.functions import keys as K
from treeline.functions import text as T
from treeline.plans.interpret import answers

#: Version of the prompt, characters of the diff in it, importers named, kinds of an answer, from which
#: magnitude a file changed, and the magnitude of an answer that can't be read.
VERSION, DIFF_CHARS, NAMED = "1", 9000, 12
KINDS = ("refactor", "behaviour", "surface", "new", "removed", "unclear")
CHANGED, UNKNOWN = 0.15, 0.5
ANSWER = "struct<kind:string,magnitude:double,headline:string,narrative:string>"
ASK = 'How far did the meaning of this file move, from 0 (not at all) to 1? Answer as JSON with "kind" (one of ' + ", ".join(KINDS) + '), "magnitude", "headline" and "narrative".'


def shown_diffs(lines: DataFrame, size: int = DIFF_CHARS) -> DataFrame:
    """``path``, ``diff``: the start of each file's diff (file, pos, line), with a note if more follows.

    Only the lines that fit are brought together; a line is cut at the size before, so one more than fits is enough.
    """
    cut = lines.select(F.col("file").alias("path"), "pos", F.substring("line", 1, size + 1).alias("line"))
    before = F.coalesce(F.sum(F.length("line") + 1).over(W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    some = cut.withColumn("before", before).filter(F.col("before") <= size)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return some.groupBy("path").agg(text.alias("text")).select("path", T.clip(F.col("text"), size, "\n… (more follows)").alias("diff"))


def named_importers(edges: DataFrame, n: int = NAMED) -> DataFrame:
    """``path``, ``importers`` (how many), ``named``: the first of them by name."""
    order = W.partitionBy("to").orderBy("from")
    first = edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).groupBy(F.col("to").alias("path")).agg(F.array_sort(F.collect_list("from")).alias("named"))
    return edges.groupBy(F.col("to").alias("path")).agg(F.count("*").alias("importers")).join(first, "path")


def prompts(changed: DataFrame, lines: DataFrame, edges: DataFrame, meanings: DataFrame | None = None, writer: str | None = None) -> DataFrame:
    """(key, path, prompt) of each file of a change (``changed``: path, base_blob, head_blob, see ``sources.change``).

    ``meanings`` (path, what, why) say what was known of a file before.  The key changes with the version, the path, the
    two contents, what was known, who imports it, and who answers.
    """
    known = meanings if meanings is not None else changed.select("path", F.lit(None).cast("string").alias("what"), F.lit(None).cast("string").alias("why")).limit(0)
    known = known.groupBy("path").agg(F.min_by(F.struct("what", "why"), F.struct("what", "why")).alias("m"))
    met = changed.join(shown_diffs(lines), "path", "left").join(known, "path", "left").join(named_importers(edges), "path", "left")
    count = F.coalesce("importers", F.lit(0))
    more = F.when(count > NAMED, F.concat(F.lit(" and "), (count - NAMED).cast("string"), F.lit(" more"))).otherwise("")
    used = F.when(count > 0, F.concat(F.lit("Imported by "), T.plural(count, "file"), F.lit(": "), F.array_join("named", ", "), more, F.lit("."))).otherwise("Nothing imports it.")
    prompt = F.concat_ws(
        "\n\n", F.concat(F.lit("File "), F.col("path"), F.lit(".")), F.concat(F.lit("Before this change: "), F.col("m.what")), F.concat(F.lit("Because: "), F.col("m.why")), used,
        F.concat(F.lit("The diff:\n"), F.coalesce("diff", F.lit("(none is shown)"))), F.lit(ASK),
    )
    key = K.digest(F.lit(VERSION), "path", "base_blob", "head_blob", F.coalesce("m.what", F.lit("")), F.coalesce("m.why", F.lit("")), used, F.lit(writer or ""), size=32)
    return met.select(key.alias("key"), "path", prompt.alias("prompt"))


def judged(asked: DataFrame, cache: DataFrame, provider: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Every asked (key, path, prompt) with its verdict: kind, magnitude, changed, headline, narrative, source.

    ``cache`` and the provider's result have key, answer (JSON, with or without words around it).  A missing or unreadable
    answer, and a cached one that can't be read and isn't answered anew, is ``unavailable``: unclear, of magnitude 0.5, so
    that it never reads as no change.  A magnitude beyond 0 to 1 is 0.5 as well.
    """
    read = lambda df: df.withColumn("v", T.model_json(F.col("answer"), ANSWER)).filter("v IS NOT NULL")
    known = read(cache.select("key", "answer"))
    got, _ = answers(asked, known.select("key", "answer"), provider)
    told = read(got).join(known.select("key", F.lit("cache").alias("source")), "key", "left").dropDuplicates(["key"])
    met = asked.select("key", "path").join(told, "key", "left")
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    there = F.col("v").isNotNull()
    magnitude = F.when(F.col("v.magnitude").between(0, 1), F.col("v.magnitude")).otherwise(UNKNOWN)
    headline = F.coalesce(text(F.col("v.headline")), F.when(there, "no headline was given").otherwise("not judged: there was no answer that could be read"))
    out = met.select(
        "key", "path", F.when(F.col("v.kind").isin(*KINDS), F.col("v.kind")).otherwise("unclear").alias("kind"), magnitude.alias("magnitude"), headline.alias("headline"),
        F.coalesce(text(F.col("v.narrative")), headline).alias("narrative"), F.when(~there, "unavailable").otherwise(F.coalesce("source", F.lit("model"))).alias("source"),
    )
    return out.withColumn("changed", (F.col("source") != "unavailable") & (F.col("magnitude") >= CHANGED))


def verdicts(rows: DataFrame) -> DataFrame:
    """``path``, ``verdict``, ``headline`` as ``plans.review`` takes them: unavailable ones decide nothing."""
    return rows.filter("source <> 'unavailable'").select("path", F.col("magnitude").alias("verdict"), "headline")
