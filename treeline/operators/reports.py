"""Projections that assemble output: payload rows, layouts, exports, totals, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.functions import text as T
from treeline.operators import windows as WN
from treeline.operators.search import limited

#: Rendered pages kept of a repository, items a notice names.
PAGES, NOTICE = 4, 3


def diff_payload(numbered: DataFrame) -> DataFrame:
    """Rows of a diff view: one for each hunk's header, then its lines; in order of file, hunk and place."""
    head = numbered.groupBy("file", "hunk").agg(F.min("pos").alias("pos"), F.min("header").alias("text"))
    none = F.lit(None).cast("long")
    head = head.select("file", "hunk", (F.col("pos") - 1).alias("pos"), F.lit("hunk").alias("kind"), none.alias("old_no"), none.alias("new_no"), "text")
    return head.unionByName(numbered.select(*head.columns))


def system_diagram(layers: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places of parts (layer, part) as x and y, and strokes of edges (from, to, count)."""
    column = F.row_number().over(W.partitionBy("layer").orderBy("part")) - 1
    width = F.count("*").over(W.partitionBy("layer"))
    boxes = layers.withColumn("x", (column - (width - 1) / 2).cast("double")).withColumn("y", F.col("layer").cast("double"))
    return boxes, edges.withColumn("stroke", F.least(F.lit(4.0), 1 + F.log2(F.col("count").cast("double"))))


def retained(pages: DataFrame, by: str = "repo", at: str = "built_at", n: int = PAGES) -> DataFrame:
    """The newest n pages of each repository."""
    return WN.best(pages, [by], [F.col(at).desc(), F.col("id")], n).drop("rank")


def notes_markdown(notes: DataFrame) -> DataFrame:
    """One Markdown text per file from its notes (file, start, end, quote, body), in line order."""
    place = F.concat(F.lit("### Lines "), F.col("start").cast("string"), F.lit("–"), F.col("end").cast("string"))
    quoted = F.when(F.coalesce("quote", F.lit("")) != "", F.concat(F.lit("\n\n> "), F.replace(F.col("quote"), F.lit("\n"), F.lit("\n> ")))).otherwise("")
    one = F.concat(place, quoted, F.lit("\n\n"), F.col("body"))
    rows = notes.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "end", one.alias("text")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n")
    return rows.select("file", F.concat(F.lit("## "), F.col("file"), F.lit("\n\n"), body).alias("markdown"))


def costs(calls: DataFrame) -> DataFrame:
    """One row of totals over interpretation calls; metered only if every call was."""
    out = calls.agg(
        F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("usd").alias("usd"), F.coalesce(F.every("metered"), F.lit(False)).alias("metered"),
        F.count_if(F.col("failure").isNotNull()).alias("failures"),
    )
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("calls", "tokens", "usd")})


def sections(entries: DataFrame, by: str, order: str) -> DataFrame:
    """Groups in the order in which they first occur, each with its entries in order."""
    rest = [c for c in entries.columns if c not in (by, order)]
    return entries.groupBy(by).agg(F.min(order).alias("first"), F.array_sort(F.collect_list(F.struct(order, *rest))).alias("entries"))


def change_word(status: Column, kind: Column, unread: Column) -> Column:
    """The word for a change: fixed for added and deleted, else the verdict's kind, else the status's."""
    plain = F.when(status == "A", "added").when(status == "D", "deleted").when(status == "R", "renamed").when(status == "T", "type changed").otherwise("modified")
    return F.when(status.isin("A", "D") | unread | kind.isNull(), plain).otherwise(kind)


def stop_text(band: Column, delta: Column, lines: Column, added: Column, removed: Column, changed: Column) -> Column:
    """``band · 0.50 · 3 lines · +1 −0 ~0``; the surface only where it moved."""
    surface = F.concat(F.lit("+"), added.cast("string"), F.lit(" −"), removed.cast("string"), F.lit(" ~"), changed.cast("string"))
    return F.concat_ws(" · ", band, F.format_string("%.2f", delta), T.plural(lines, "line"), F.when(added + removed + changed > 0, surface))


def symbol_text(doc: Column, kind: Column, name: Column, start: Column, end: Column, exported: Column) -> Column:
    """A symbol's description: the author's, or its kind and place; its span; whether others can use it."""
    what = F.coalesce(doc, F.concat(kind, F.lit(" "), name, F.lit(" at line "), start.cast("string")))
    return F.concat_ws(". ", what, T.plural(end - start + 1, "line"), F.when(exported, "public").otherwise("private"))


def list_phrase(items: Column, n: int = 4) -> Column:
    """The first n of a list and how many more there are, or ``nothing``."""
    return F.when(F.size(items) == 0, "nothing").otherwise(limited(items, n))


def file_question(exports: Column, imports: Column) -> Column:
    """``struct<question, consequence>`` of a file's step; null lists stand for a file that wasn't parsed."""
    read = exports.isNotNull() & imports.isNotNull()
    asked = F.concat(F.lit("It exports "), list_phrase(exports), F.lit(" and imports "), list_phrase(imports), F.lit(". Why is it a module of its own?"))
    owns = F.concat(T.plural(F.size(exports), "exported symbol"), F.lit(", "), T.plural(F.size(imports), "import"), F.lit("."))
    unread = F.struct(F.lit("Why is this a file of its own, and of this kind?").alias("question"), F.lit("Its exports and imports aren't known: it wasn't parsed.").alias("consequence"))
    return F.when(read, F.struct(asked.alias("question"), owns.alias("consequence"))).otherwise(unread)


def symbol_question(name: Column, kind: Column, start: Column, end: Column) -> Column:
    asked = F.concat(F.lit("Fill in "), name, F.lit(": how should this "), kind, F.lit(" do its work?"))
    return F.struct(asked.alias("question"), F.concat(name, F.lit(" has "), T.plural(end - start + 1, "line"), F.lit(" of "), kind, F.lit(".")).alias("consequence"))


def shape_question(title: Column, files: Column, loc: Column) -> Column:
    asked = F.concat(F.lit("Why is "), title, F.lit(" a part of its own?"))
    return F.struct(asked.alias("question"), F.concat(title, F.lit(" is a chapter of "), T.plural(files, "file"), F.lit(" and "), T.plural(loc, "line"), F.lit(".")).alias("consequence"))


def decision(question: Column, why: Column, source: Column) -> Column:
    """A step's decision: the question, with the author's choice as the one option, taken."""
    option = F.struct(F.lit("author").alias("id"), F.lit("What the author did").alias("label"), question["consequence"].alias("consequence"), F.lit(True).alias("taken"))
    return F.struct(
        question["question"].alias("question"), F.array(option).alias("options"), F.lit("author").alias("author_choice"), F.lit("author").alias("chosen"),
        why.alias("why"), source.alias("why_source"),
    )


def notice(items: Column, one: str, many: str, n: int = NOTICE, total: Column | None = None) -> Column:
    """How many there are and the first of them by name; null for none.  With ``total``, ``items`` are but the first."""
    there = F.size(items) if total is None else total
    count = F.concat(there.cast("string"), F.when(there == 1, f" {one}: ").otherwise(f" {many}: "))
    more = F.when(there > n, F.concat(F.lit(" and "), (there - n).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(there > 0, F.concat(count, F.array_join(F.slice(items, 1, n), ", "), more))
