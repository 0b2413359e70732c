"""Build plans: a tree taught file by file, in an order in which nothing is used before it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.functions import keys as K
from treeline.functions import paths as P
from treeline.operators import classify as CL
from treeline.operators import graph as G
from treeline.operators import intervals as IV
from treeline.operators import order as O
from treeline.operators import rank as R
from treeline.operators import reports as RP
from treeline.operators import windows as WN
from treeline.plans.session import kept


def chapters(relations: dict[str, DataFrame], roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Taught files with their chapter, and the files that are reproduced as they are.

    A file belongs to the longest root above it, else to its first directory.
    """
    files = relations["ranked"].withColumn("taught", CL.teachable(F.col("class"), F.col("binary")))
    owned = G.owner(files, roots).withColumn("chapter", F.coalesce("owner", F.substring_index("path", "/", 1))).drop("owner")
    return owned.filter("taught"), owned.filter("NOT taught").select("path")


def build_plan(relations: dict[str, DataFrame], roots: DataFrame, witnesses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps (ordinal, id, chapter, kind, path, start, end, depends_on, sha, date) and the reproduced files.

    Per chapter, in dependency order: its shape, then each file, tests after their subjects, then the file's
    load-bearing symbols.  Ids stay when bodies change.
    """
    taught, rest = chapters(relations, roots)
    taught = kept(taught.join(witnesses, "path", "left"))
    edges = relations["edges"]
    owner = taught.select("path", "chapter")
    one = taught.groupBy("chapter").agg(F.max("score").alias("score")).withColumn("tie", F.concat(F.format_string("%012.9f", 2 - F.col("score")), F.col("chapter")))
    between = G.contracted(edges, owner.withColumnRenamed("chapter", "owner"))
    book = O.dependency_order(one.select(F.lit("all").alias("chapter"), F.col("chapter").alias("node"), "tie"), between.select(F.lit("all").alias("chapter"), "from", "to"))
    book = book.select(F.col("node").alias("chapter"), F.col("ordinal").alias("chapter_pos"))
    tie = F.concat(F.coalesce("date", F.lit("9999")), F.format_string("%012.9f", 2 - F.col("score")), F.col("path"))
    nodes = taught.select("chapter", F.col("path").alias("node"), tie.alias("tie"))
    inside = edges.join(owner.select(F.col("path").alias("from"), "chapter"), "from").join(owner.select(F.col("path").alias("to"), F.col("chapter").alias("other")), "to")
    files = O.dependency_order(nodes, inside.filter("chapter = other").select("chapter", "from", "to"))
    placed = files.select("chapter", F.col("node").alias("path"), F.col("ordinal").alias("pos")).join(taught.select("path", (F.col("class") == "test").alias("test")), "path")
    placed = O.beside_subjects(placed).select("chapter", "path", "place")
    shape = book.select("chapter_pos", "chapter", F.lit("shape").alias("kind"), F.col("chapter").alias("path"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit("").alias("name"))
    met = placed.join(book, "chapter")
    first = W.partitionBy("chapter").orderBy("place", "path")
    met = met.withColumn("file_pos", F.row_number().over(first))
    file = met.select("chapter_pos", "chapter", F.lit("file").alias("kind"), "path", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit("").alias("name"), "file_pos")
    symbols = picks(relations["symbols"]).join(met.select("chapter_pos", "chapter", "path", "file_pos"), "path")
    symbol = symbols.select("chapter_pos", "chapter", F.lit("symbol").alias("kind"), "path", "start", "end", F.concat_ws("::", "symbol_kind", "name").alias("name"), "file_pos")
    steps = shape.withColumn("file_pos", F.lit(0)).unionByName(file).unionByName(symbol)
    rank = F.when(F.col("kind") == "symbol", 1).otherwise(0)
    steps = WN.occurrence(steps, ["path", "kind", "name"], ["start"])
    steps = steps.withColumn("id", K.step_id(F.col("path"), F.col("kind"), F.col("name"), F.col("n")))
    steps = R.numbered(kept(steps), [F.col("chapter_pos"), F.col("file_pos"), rank, F.col("start"), F.col("path"), F.col("name")], "ordinal")
    ids = steps.filter("kind = 'file'").select(F.col("path").alias("to"), F.col("id").alias("need"))
    needs = edges.join(ids, "to").groupBy(F.col("from").alias("path")).agg(F.array_sort(F.collect_list("need")).alias("depends_on"))
    out = steps.join(needs, "path", "left").join(witnesses, "path", "left")
    depends = F.when(F.col("kind") == "file", F.coalesce("depends_on", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return out.select("ordinal", "id", "chapter", "kind", "path", "name", "start", "end", depends.alias("depends_on"), "sha", "date"), rest


def picks(symbols: DataFrame) -> DataFrame:
    """Each file's load-bearing symbols: exported ones, else those of enough span that hold no other."""
    span = F.col("end_line") - F.col("line") + 1
    rows = symbols.select("path", "pos", "name", F.col("kind").alias("symbol_kind"), F.col("line").cast("long").alias("start"), F.col("end_line").cast("long").alias("end"), "exported", span.alias("span"))
    any_public = rows.withColumn("public", F.max("exported").over(W.partitionBy("path")))
    fit = any_public.filter(F.when(F.col("public"), F.col("exported")).otherwise(F.lit(True)) & IV.eligible(F.col("symbol_kind"), F.col("span")))
    held = IV.strictly_containing(fit, ["path"]).filter("NOT (symbol_kind IN ('variable', 'type') AND contains)")
    taken = IV.load_bearing(held, ["path"])
    return held.join(taken.select("path", "pos"), ["path", "pos"], "left_semi")


def scaffold_ranges(steps: DataFrame) -> DataFrame:
    """Per file, the ranges to cut out with their steps, for ``extract.api.scaffolds``."""
    one = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("ordinal").cast("int").alias("step"))
    return steps.filter("kind = 'symbol'").groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("ranges"))


def decisions(steps: DataFrame, extracts: DataFrame, sizes: DataFrame) -> DataFrame:
    """``id``, ``decision`` of each step (ordinal, id, kind, path, name, start, end, sha, date).

    ``extracts`` has path, symbols, imports; ``sizes`` (chapter, files, loc) the chapters'.
    """
    names = F.transform(F.filter("symbols", lambda s: s["exported"]), lambda s: s["name"])
    facts = extracts.select("path", names.alias("exports"), F.transform("imports", lambda i: i["raw"]).alias("raws"))
    met = steps.join(facts, "path", "left").join(sizes.select(F.col("chapter").alias("path"), "files", "loc"), "path", "left")
    kind, name = F.substring_index("name", "::", 1), F.element_at(F.split("name", "::"), -1)
    asked = (
        F.when(F.col("kind") == "shape", RP.shape_question(F.col("path"), F.coalesce("files", F.lit(0)), F.coalesce("loc", F.lit(0))))
        .when(F.col("kind") == "file", RP.file_question(F.col("exports"), F.col("raws"))).otherwise(RP.symbol_question(name, kind, F.col("start"), F.col("end")))
    )
    why = F.when(F.col("sha").isNotNull(), F.concat(F.lit("added in "), F.substring("sha", 1, 8)))
    return met.withColumn("__q", asked).select("id", RP.decision(F.col("__q"), why, F.when(F.col("sha").isNotNull(), "commit").otherwise("none")).alias("decision"))


#: Fixed value: lines of a file that its own step shows.
HEAD_LINES = 120


def ranges(steps: DataFrame, loc: DataFrame) -> DataFrame:
    """``steps`` with ``from``, ``to``: the lines an interpretation is asked for; null where there is nothing to show.

    A symbol's own lines, the head of a file (``loc``: path, loc), and none for the shape of a chapter.
    """
    met = steps.join(loc.select("path", "loc"), "path", "left")
    head = F.when(F.col("loc") > 0, F.least("loc", F.lit(HEAD_LINES)))
    last = F.when(F.col("kind") == "symbol", F.col("end")).when(F.col("kind") == "file", head).cast("long")
    first = F.when(F.col("kind") == "symbol", F.col("start")).when(head.isNotNull() & (F.col("kind") == "file"), F.lit(1)).cast("long")
    return met.withColumns({"from": F.when(last.isNotNull(), first), "to": F.when(first.isNotNull(), last)}).drop("loc")


def asked(steps: DataFrame, loc: DataFrame) -> DataFrame:
    """``path``, ``start``, ``end`` to be interpreted, each once, whoever asks for the same lines."""
    return ranges(steps, loc).filter("from IS NOT NULL").select("path", F.col("from").alias("start"), F.col("to").alias("end")).distinct()


def interpreted(steps: DataFrame, decided: DataFrame, loc: DataFrame, meanings: DataFrame) -> DataFrame:
    """``id``, ``decision`` of every step, with what an interpretation of its lines says, where there is one.

    ``meanings`` has path, start, end, summary, why, alternatives (array<struct<label,consequence>>).  The author's choice
    stays as it is, only what follows from it is told by the summary; alternatives become options that weren't taken.  A
    step without a meaning keeps its decision.
    """
    said = meanings.select("path", F.col("start").cast("long").alias("from"), F.col("end").cast("long").alias("to"), F.struct("summary", "why", "alternatives").alias("m"))
    met = ranges(steps, loc).join(said, ["path", "from", "to"], "left").select("id", "m").join(decided, "id")
    d, m = F.col("decision"), F.col("m")
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    option = lambda id_, label, consequence, taken: F.struct(id_.alias("id"), label.alias("label"), consequence.alias("consequence"), taken.alias("taken"))
    own = F.transform(
        F.filter(d["options"], lambda o: o["id"] == d["author_choice"]), lambda o: option(o["id"], o["label"], F.coalesce(text(m["summary"]), o["consequence"]), o["taken"])
    )
    none = F.array().cast("array<struct<label:string,consequence:string>>")
    other = F.transform(F.coalesce(m["alternatives"], none), lambda a, i: option(F.concat(F.lit("alt-"), (i + 1).cast("string")), a["label"], a["consequence"], F.lit(False)))
    folded = F.struct(
        d["question"].alias("question"), F.concat(own, other).alias("options"), d["author_choice"].alias("author_choice"), d["chosen"].alias("chosen"),
        F.coalesce(text(m["why"]), d["why"]).alias("why"), F.lit("interpret").alias("why_source"),
    )
    return met.select("id", F.when(m.isNotNull(), folded).otherwise(d).alias("decision"))
