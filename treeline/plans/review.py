"""Change review: two sides of a change, what moved in meaning, and how far it ripples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.extract import api
from treeline.functions import text as T
from treeline.operators import classify as CL
from treeline.operators import delta as D
from treeline.operators import diff as DF
from treeline.operators import graph as G
from treeline.operators import intervals as IV
from treeline.operators import rank as R
from treeline.operators import reports as RP
from treeline.operators import windows as WN
from treeline.plans.session import kept
from treeline.sources import change as CH
from treeline.sources import git
from treeline.sources.files import inventory

#: Fixed value: stops of a change tour.
STOPS = 12


def review(
    spark: SparkSession, repo: str, base: str, head: str, edges: DataFrame, verdicts: DataFrame | None = None, meanings: tuple[DataFrame, DataFrame] | None = None,
    body: str | None = None, checkpoint: str | None = None, side_bytes: int | None = None, diff_bytes: int | None = None,
) -> dict[str, DataFrame]:
    """Deltas by meaning, hunks, ripple, stops, reasons, staleness and notices of a change, compared from the merge base.

    ``edges`` is the import graph as of ``checkpoint``, the commit that was digested (None if unknown); ``verdicts`` (path,
    verdict, headline) come from a cache or a model and may be missing; a row without a verdict is a call that failed, and
    counts as unavailable.  ``meanings`` are the interpretations (path, what, why) of both sides; ``body`` is the change's
    description.  A side larger than ``side_bytes``, and a diff larger than ``diff_bytes``, aren't read; the latter are
    counted in ``too_big``.
    """
    start = git.merge_base(repo, base, head)
    changed = kept(CH.paths(spark, repo, start, head))
    before, after = (kept(CH.side(spark, repo, start, head, which, side_bytes)) for which in ("base", "head"))
    old, new = (kept(extracted(CH.raw(s))) for s in (before, after))
    surface = D.surface(exported(old), exported(new))
    state = lambda side, got, c: CH.states(side, got).select("path", F.col("state").alias(c), F.col("link").alias(f"{c}_link"))
    absent = F.struct(F.lit("absent").alias("kind"), F.lit(None).cast("string").alias("reason"))
    rows = changed.join(state(before, old, "b"), "path", "left").join(state(after, new, "a"), "path", "left").join(surface, "path", "left")
    judged = verdicts if verdicts is not None else changed.select("path", F.lit(None).cast("double").alias("verdict"), F.lit(None).cast("string").alias("headline")).limit(0)
    rows = rows.join(judged, "path", "left")
    far = changed.select("path", F.lit(None).cast("double").alias("distance")).limit(0)
    if meanings is not None:
        far = distances(claims(meanings[0], old), claims(meanings[1], new))
    rows = rows.join(far, "path", "left")
    unread = D.link_sides(D.unread(F.coalesce("b", absent), F.coalesce("a", absent)), F.col("status"), F.col("b_link"), F.col("a_link"))
    rows = rows.withColumns({
        "unread": unread.isNotNull(), "sides": unread, "lines_changed": F.col("lines"),
        **{f"n_{c}": F.coalesce(F.size(c), F.lit(0)) for c in ("added", "removed", "changed")},
    })
    deltas = kept(D.file_delta(rows).select("path", "status", "from_path", "lines_changed", "meaning_delta", "basis", "reason", "added", "removed", "changed", "sides"))
    diff = kept(CH.diff(spark, repo, start, head, limit=diff_bytes))
    lines = diff.filter("NOT too_big").select("file", "pos", "line")
    hunks = DF.hunks(lines).withColumnRenamed("file", "path")
    moved = deltas.filter(D.band(F.col("meaning_delta")) == "moved")
    commits = git.log(spark, [repo], f"{git.safe_ref(start)}..{git.safe_ref(head)}").select("pos", "sha", "message").distinct()
    reasons = D.told_why(D.why(deltas.select("path"), commits), F.lit(body).cast("string"), F.lit(body is not None))
    ripple = G.ripple(moved.select("path"), edges)
    stale = kept(unseen(spark, repo, checkpoint, base, changed))
    return {
        "deltas": deltas, "hunks": hunks, "diff": DF.numbered(lines), "too_big": diff.filter("too_big").select("file", "added", "removed", "blobs"), "ripple": ripple,
        "stops": stops(deltas, hunks), "reasons": reasons, "unread": unread_files(deltas), "opening": opening(deltas), "staleness": stale, "notices": notices(stale, deltas, ripple),
    }


def unseen(spark: SparkSession, repo: str, checkpoint: str | None, base: str, changed: DataFrame) -> DataFrame:
    """How far the digested commit is behind the base, and which changed paths the base gained since the two parted."""
    tip = (git.git(repo, "rev-parse", git.safe_ref(base)) or "").strip() or None
    if checkpoint is None or checkpoint == tip:
        nothing = changed.select("path").limit(0)
        return D.staleness(checkpoint, tip, nothing, nothing, changed)
    missed = git.log(spark, [repo], f"{git.safe_ref(checkpoint)}..{git.safe_ref(base)}").select("sha").distinct()
    return D.staleness(checkpoint, tip, missed, CH.paths(spark, repo, git.merge_base(repo, checkpoint, base), base).select("path"), changed)


def notices(stale: DataFrame, deltas: DataFrame, ripple: DataFrame) -> DataFrame:
    """``ordinal``, ``chapter``, ``file``, ``start``, ``end``, ``title``, ``text``: what a tour says besides its files.

    In the chapter ``what``: changed files that the digest hasn't seen change, and files that weren't read on a side; in
    the chapter ``ripple``: who imports what moved, one hop on (to be read again) and beyond.  Each only if there is any.
    """
    plural, shown = T.plural, lambda n, name, title: [F.lit(n).cast("long").alias("ordinal"), F.lit(name).alias("chapter"), F.col("file"), F.lit(1).alias("start"), F.lit(30 if n == 0 else 40).alias("end"), F.lit(title).alias("title"), F.col("text")]
    seen = stale.filter(F.size("overlap") > 0).select(F.col("overlap")[0].alias("file"), F.concat(
        F.lit("The digest is "), plural(F.col("behind"), "commit"), F.lit(" behind the base, and "), plural(F.size("overlap"), "file"), F.lit(" changed here changed there as well.")).alias("text"))
    first = deltas.filter("sides IS NOT NULL").agg(F.min("path").alias("file"))
    unread = unread_files(deltas).filter("n > 0").join(F.broadcast(first)).select("file", "text")
    hops = ripple.agg(F.count_if(F.col("hop") == 1).alias("near"), F.count_if(F.col("hop") > 1).alias("far"), F.min(F.struct("hop", "path")).alias("first"))
    beyond = hops.filter("near + far > 0").select(F.col("first.path").alias("file"), F.concat(
        plural(F.col("near"), "file"), F.when(F.col("near") == 1, " imports").otherwise(" import"), F.lit(" what moved here, unchanged; "), F.col("far").cast("string"), F.lit(" more lie beyond.")).alias("text"))
    out = seen.select(*shown(0, "what", "Changed on the base as well"))
    return out.unionByName(unread.select(*shown(1, "what", "Not read"))).unionByName(beyond.select(*shown(2, "ripple", "Beyond this change")))


def extracted(raw: DataFrame) -> DataFrame:
    """Symbols and imports of one side's files."""
    return api.extract(inventory(raw).filter(CL.parse_target(F.col("path"), F.col("class"), F.col("binary"))))


def exported(extracts: DataFrame) -> DataFrame:
    """Exported symbols of one side."""
    return api.symbols(extracts).filter("exported").select("path", "name", "kind", "pos")


def stops(deltas: DataFrame, hunks: DataFrame, n: int = STOPS) -> DataFrame:
    """The tour of a change: scored files by meaning, n at most, each at its changed lines and in its chapter.

    Moved and shifted files come first (chapter ``moved``), steady ones fill the places left (``quiet``).  A file that
    could not be read isn't scored and has no stop here; see :func:`unread_files`.
    """
    scored = deltas.filter("basis <> 'unread'").withColumn("band", D.band(F.col("meaning_delta")))
    placed = R.numbered(scored, D.by_meaning(), "ordinal").filter(F.col("ordinal") <= n)
    placed = placed.withColumn("chapter", F.when(F.col("band") == "steady", "quiet").otherwise("moved"))
    return placed.join(IV.change_stop(hunks, ["path"]), "path", "left").withColumns({"start": F.coalesce("start", F.lit(1)), "end": F.coalesce("end", F.lit(40))})


def unread_files(deltas: DataFrame) -> DataFrame:
    """One row for the chapter ``what``: how many files weren't read on a side, and the first of them with the reason."""
    told = deltas.filter("sides IS NOT NULL").select("path", F.concat("path", F.lit(" "), D.not_read_on(F.col("sides"))).alias("told"))
    first = told.orderBy("path").limit(RP.NOTICE).agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "told"))), lambda x: x["told"]).alias("items"))
    rows = told.agg(F.count("*").alias("n")).join(F.broadcast(first))
    return rows.select("n", RP.notice(F.col("items"), "file was not read", "files were not read", total=F.col("n")).alias("text"))


def opening(deltas: DataFrame) -> DataFrame:
    """One row: files changed, moved, steady and not scored, the biggest diff and the biggest change of meaning."""
    scored, band = F.col("basis") != "unread", D.band(F.col("meaning_delta"))
    count = lambda c: F.count_if(c).alias
    return deltas.agg(
        F.count("*").alias("files"), count(scored & (band != "steady"))("moved"), count(scored & (band == "steady"))("steady"), count(~scored)("not_scored"),
        F.max_by("path", F.struct("lines_changed", "path")).alias("biggest_diff"),
        F.min_by("path", F.when(scored, F.struct(-F.col("meaning_delta"), -F.col("lines_changed"), F.col("path")))).alias("biggest_change"),
    )


def claims(meanings: DataFrame, extracts: DataFrame) -> DataFrame:
    """Per path of one side, what its interpretation says and names: text (what and why), names, vocab.

    ``meanings`` (path, what, why) may have several rows a path; ``extracts`` has path, symbols, imports.
    """
    said = meanings.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("what", "why"))), lambda m: F.concat_ws(" ", m["what"], m["why"])), " ").alias("text"))
    names = F.coalesce(F.transform("symbols", lambda s: s["name"]), F.array().cast("array<string>"))
    specs = F.coalesce(F.transform("imports", lambda i: i["raw"]), F.array().cast("array<string>"))
    return said.join(extracts.select("path", "symbols", "imports"), "path", "left").select("path", "text", names.alias("names"), specs.alias("specs"))


def distances(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path``, ``distance`` of the claims of both sides (see :func:`claims`), by the vocabulary of both."""
    old = before.select("path", F.col("text").alias("old"), F.col("names").alias("old_names"), F.col("specs").alias("old_specs"))
    both = old.join(after, "path").withColumn("names", F.array_union("old_names", "names"))
    both = both.withColumn("vocab", D.vocabulary(F.flatten(F.array("names", "old_specs", "specs"))))
    return both.select("path", D.text_distance(F.col("old"), F.col("text"), F.col("names"), F.col("vocab")).alias("distance"))


def adjudicate(asked: DataFrame, cache: DataFrame, provider: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Verdicts for (key, path, prompt): those in ``cache`` (key, verdict, headline), and the provider's for the
    rest.  A null answer is unavailable, is not in the result, and must not be cached."""
    known = asked.join(cache, "key").select("key", "path", "verdict", "headline")
    if provider is None:
        return known
    fresh = provider(asked.join(cache, "key", "left_anti")).filter("verdict IS NOT NULL").select("key", "path", "verdict", "headline")
    return known.unionByName(fresh)


def conversation(turns: DataFrame) -> DataFrame:
    """What a question's prompt may quote: the last turns of each chat."""
    return WN.chat_window(turns)
