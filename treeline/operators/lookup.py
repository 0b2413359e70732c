"""Lookups in registries of tours, pages, files and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import paths as P

#: Digits of a tour's id, and how old (or how far ahead) the mark of a build may be to be taken up again.
ID_DIGITS, RESUME_SECONDS, SLACK_SECONDS = 10, 6 * 60 * 60, 10 * 60
MESSAGES = "array<struct<role:string,content:string,stopIndex:int,stopTitle:string,file:string,ts:long>>"


def tour_id(head: Column, dirty: Column) -> Column:
    """The start of the head, or ``working`` for a tree that differs from it."""
    return F.when(dirty, "working").otherwise(F.substring(head, 1, ID_DIGITS))


def find(registry: DataFrame, wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """Per ``want`` of ``wanted``, the tour (id, generated_at, page) of that id; else the newest whose id begins with it.

    Tours whose page is not in ``pages`` (page) are left out.  Equal ids meet by a join; what is left of the requests
    meets the ids' prefixes of the lengths asked for, of which there are at most as many as the longest id has characters.
    """
    alive = registry.join(pages.select("page").distinct(), "page", "left_semi")
    tour = F.struct("id", "generated_at", "page")
    asked = wanted.select("want").filter("want IS NOT NULL").distinct()
    newest = F.max_by(tour, F.struct("generated_at", "id")).alias("t")
    same = alive.join(asked, F.col("id") == F.col("want")).groupBy("want").agg(newest)
    rest = asked.join(same, "want", "left_anti")
    longest = alive.agg(F.max(F.length("id")).alias("longest"))
    sizes = rest.select(F.length("want").alias("size")).distinct().join(F.broadcast(longest)).filter("size < longest").select("size")
    cut = alive.join(F.broadcast(sizes), F.length("id") > F.col("size")).withColumn("want", F.expr("left(id, size)"))
    begun = cut.join(rest, "want", "left_semi").groupBy("want").agg(newest)
    return wanted.join(same.unionByName(begun), "want", "left").select("want", "t.*")


def with_heads(tours: DataFrame, heads: DataFrame) -> DataFrame:
    """``tours`` (id, repo, head) with ``state`` against the repositories' heads (repo, now): ``uncommitted``,
    ``current``, ``moved``, or null where the head isn't known."""
    met = tours.join(heads.select("repo", "now"), "repo", "left")
    state = F.when(F.col("id") == "working", "uncommitted").when(F.col("head") == F.col("now"), "current").when(F.col("now").isNotNull(), "moved")
    return met.withColumn("state", state).drop("now")


def beneath_others(paths: DataFrame) -> DataFrame:
    """Per path, the other paths beneath it, which a diff of it leaves out: (path, excluded)."""
    below = paths.select(F.col("path").alias("inner"), F.explode(P.ancestors(F.col("path"))).alias("path"))
    met = below.join(paths.select("path").distinct(), "path")
    return met.groupBy("path").agg(F.array_sort(F.collect_set("inner")).alias("excluded"))


def at_commit(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """``wanted`` paths with the blob a commit lists for them (path, blob, mode), or ``absent``."""
    state = F.when(F.col("blob").isNull(), "absent").when(F.col("mode") == "120000", "symlink").when(F.col("mode") == "160000", "submodule").otherwise("file")
    return wanted.join(listed, "path", "left").withColumn("state", state)


def transcript(raw: Column) -> Column:
    """A stored transcript read back leniently: other roles count as the user's, missing fields have defaults,
    messages without text go; what isn't a list is empty."""
    read = F.coalesce(F.from_json(raw, MESSAGES, {"mode": "PERMISSIVE"}), F.from_json(F.lit("[]"), MESSAGES))
    told = F.filter(read, lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) != "")
    return F.transform(told, lambda m: F.struct(
        F.when(m["role"] == "assistant", "assistant").otherwise("user").alias("role"), m["content"].alias("content"),
        F.coalesce(m["stopIndex"], F.lit(-1)).alias("stop"), m["stopTitle"].alias("title"), m["file"].alias("file"), F.coalesce(m["ts"], F.lit(0)).alias("ts"),
    ))


def store_key(kind: str, repo: Column, change: Column) -> Column:
    """The name under which a repository's ``chat`` or ``notes`` are kept, and those on one of its changes apart; not by
    commit, so that they outlive a new digest."""
    return F.concat(F.lit(f"treeline:{kind}:"), repo, F.when(F.coalesce(change, F.lit(0)) != 0, F.concat(F.lit("#pr-"), change.cast("string"))).otherwise(""))


def stamped(role: Column, content: Column, stop: Column, title: Column, file: Column, ts: Column) -> Column:
    """A message with where its reader stood (stop -1: nowhere on the tour) and when, as :func:`transcript` reads it back."""
    return F.struct(
        role.alias("role"), content.alias("content"), F.coalesce(stop, F.lit(-1)).cast("int").alias("stopIndex"), title.alias("stopTitle"), file.alias("file"), ts.cast("long").alias("ts"),
    )


def note_of(exchanges: DataFrame) -> DataFrame:
    """``exchanges`` (an anchor's columns with start; question, answer, ts) as notes: the answer is the body."""
    id_ = F.concat(F.col("ts").cast("string"), F.lit("-"), F.col("start").cast("string"))
    return exchanges.withColumns({"id": id_, "body": F.col("answer"), "source": F.lit("tutor")}).drop("answer", "ts")


def at_stop(messages: Column, stop: Column) -> Column:
    return F.filter(messages, lambda m: m["stop"] == stop)


def resumable(started: Column, now: Column) -> Column:
    """Whether a build's mark is recent enough to go on with it, and not from the future."""
    age = F.unix_timestamp(now) - F.unix_timestamp(started)
    return (age > -SLACK_SECONDS) & (age < RESUME_SECONDS)


def page_for(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per repository of ``wanted`` (repo, fingerprint, version), its page: ``exact`` if fingerprint and version are the
    same, else the newest as ``stale``.  ``pages`` has repo, fingerprint, version, built_at, page."""
    now = [F.col(c).alias(f"now_{c}") for c in ("fingerprint", "version")]
    met = pages.join(wanted.select("repo", *now), "repo")
    exact = (F.col("fingerprint") == F.col("now_fingerprint")) & (F.col("version") == F.col("now_version"))
    best = F.max_by(F.struct("page", exact.alias("exact")), F.struct(exact, "built_at", "page"))
    return met.groupBy("repo").agg(best.alias("p")).select("repo", "p.page", F.when(F.col("p.exact"), "exact").otherwise("stale").alias("state"))


def unpoisoned(files: DataFrame, poison: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``files`` (language, sha) without contents that a parser has died of (language, sha, reason), and those, with the reason."""
    key = ["language", "sha"]
    return files.join(poison.select(*key), key, "left_anti"), files.join(poison.dropDuplicates(key), key)
