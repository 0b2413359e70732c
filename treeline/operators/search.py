"""Search, citations, and cache lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.functions import paths as P
from treeline.functions import text as T

#: Least query, most matches, largest file, characters shown of a line.
LEAST_QUERY, MATCHES, FILE_BYTES, SHOWN = 2, 40, 120_000, 200


def search(files: DataFrame, query: str, limit: int | None = MATCHES) -> DataFrame:
    """Lines that hold ``query``, in any case, as (path, line, shown), by path and line.

    A query of one character is refused.  Larger files aren't searched.  ``limit`` is the report's size.
    """
    if len(query) < LEAST_QUERY:
        raise ValueError(f"a query needs {LEAST_QUERY} characters")
    small = files.filter((F.octet_length("text") <= FILE_BYTES) & F.contains(F.lower("text"), F.lit(query.lower())))
    rows = small.select("path", F.posexplode(F.split("text", "\r?\n")).alias("n", "raw"))
    hits = rows.filter(F.contains(F.lower("raw"), F.lit(query.lower())))
    shown = hits.select("path", (F.col("n") + 1).cast("long").alias("line"), F.substring(F.trim("raw"), 1, SHOWN).alias("shown"))
    return shown.orderBy("path", "line").limit(limit) if limit else shown


def references(text: Column) -> Column:
    """File references of a text in order: ``array<struct<token, path, line>>``.

    A text is cut at everything that can't be in a path.  Of what is left, a reference is the longest run of whole
    segments whose last one is a file's name: it begins with a letter or underscore and has an ending that begins
    with a letter, of which at most six characters count.  A line number follows directly, after a colon.
    """
    pieces = F.split(F.replace(F.regexp_replace(text, "[^A-Za-z0-9_./:-]", "\n"), F.lit(":"), F.lit("\n:")), "\n")

    def read(piece: Column, after: Column) -> Column:
        word = F.ltrim(piece, F.lit(":"))
        segments = F.split(word, "/")

        def named(segment: Column, k: Column) -> Column:
            stem = F.regexp_extract(segment, r"^.+\.[A-Za-z][A-Za-z0-9]{0,5}", 0)
            fit = (stem != "") & (F.upper(F.substring(segment, 1, 1)).between("A", "Z") | segment.startswith("_"))
            whole = ~F.exists(F.slice(segments, F.lit(1), k), lambda s: s == "")
            return F.when(fit & whole, F.array_join(F.concat(F.slice(segments, F.lit(1), k), F.array(stem)), "/"))

        path = F.element_at(F.filter(F.concat(F.array(F.lit(None).cast("string")), F.transform(segments, named)), lambda x, k: x.isNotNull() | (k == 0)), -1)
        tail = F.when(path == word, F.regexp_extract(after, "^:[0-9]+(-[0-9]+)?", 0)).otherwise("")
        line = F.nullif(F.regexp_extract(tail, "[0-9]+", 0), F.lit("")).cast("long")
        return F.struct(F.concat(path, F.coalesce(tail, F.lit(""))).alias("token"), F.regexp_replace(path, r"^\./", "").alias("path"), line.alias("line"))

    following = F.concat(F.slice(pieces, F.lit(2), F.size(pieces)), F.array(F.lit("")))
    return F.filter(F.zip_with(pieces, following, read), lambda r: r["path"].isNotNull())


def citations(texts: DataFrame, supplied: DataFrame, exists: DataFrame) -> DataFrame:
    """File references in texts (id, text), each with path, line and verdict.

    ``supplied`` (id, path): files given with a text; a bare name that only one of them has means it.
    ``exists`` (path): all files.  Verdicts: supplied, unshown (exists), unknown (a path of no file).  Other
    bare words and paths that climb out of the tree aren't citations.
    """
    rows = texts.select("id", F.posexplode(references(F.col("text"))).alias("n", "r")).select("id", "n", "r.token", "r.path", "r.line")
    given = supplied.select("id", F.regexp_replace("path", r"^\./", "").alias("path")).distinct().withColumn("given", F.lit(True))
    one = given.groupBy("id", P.basename(F.col("path")).alias("base")).agg(F.count("*").alias("k"), F.min("path").alias("full")).filter("k = 1")
    met = rows.join(given, ["id", "path"], "left").join(exists.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    met = met.join(one.select("id", F.col("base").alias("path"), "full"), ["id", "path"], "left")
    slash = F.contains("path", F.lit("/"))
    out = F.col("path").startswith("../") | F.contains("path", F.lit("/../"))
    verdict = (
        F.when(F.col("given"), "supplied").when(~slash & F.col("full").isNotNull(), "supplied").when(F.col("there"), "unshown")
        .when(out, None).when(slash, "unknown")
    )
    resolved = F.when(~slash & F.col("given").isNull() & F.col("full").isNotNull(), F.col("full")).otherwise(F.col("path"))
    return met.select("id", F.col("n").cast("long"), "token", resolved.alias("path"), "line", verdict.alias("verdict")).filter("verdict IS NOT NULL")


def table_view(files: DataFrame, kind: str | None = None, part: str = "", sort: str = "path", descending: bool = False) -> DataFrame:
    """The digest table as a reader filters it: a class, a part of the path in any case, any sort column."""
    out = files.filter(F.contains(F.lower("path"), F.lit(part.lower())))
    if kind:
        out = out.filter(F.col("class") == kind)
    key = F.collate(F.col(sort), "UNICODE") if dict(files.dtypes)[sort] == "string" else F.col(sort)
    return out.orderBy(key.desc() if descending else key)


def upsert(registry: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """``registry`` with ``rows``; a row of the same id is replaced."""
    return registry.join(rows.select(key), key, "left_anti").unionByName(rows)


def check_symbols(reference: DataFrame, learner: DataFrame) -> DataFrame:
    """Exported symbols (file, kind, name) as present, missing or extra."""
    keys = ["file", "kind", "name"]
    a, b = reference.select(*keys).distinct().withColumn("a", F.lit(1)), learner.select(*keys).distinct().withColumn("b", F.lit(1))
    status = F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").otherwise("present")
    return a.join(b, keys, "full").select(*keys, status.alias("status"))


def check_imports(reference: DataFrame, learner: DataFrame) -> DataFrame:
    """What a reference file imports (file, pos, raw), each once and in the order declared, as present or missing.

    What only the learner imports isn't judged.
    """
    first = reference.groupBy("file", "raw").agg(F.min("pos").alias("pos"))
    there = learner.select("file", "raw").distinct().withColumn("there", F.lit(1))
    order = W.partitionBy("file").orderBy("pos", "raw")
    status = F.when(F.col("there").isNull(), "missing").otherwise("present")
    return first.join(there, ["file", "raw"], "left").select("file", F.row_number().over(order).cast("long").alias("ordinal"), "raw", status.alias("status"))


def check_report(files: DataFrame, symbols: DataFrame, imports: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per reference file: missing symbols and imports, parse errors with a reason, and whether all is well.

    ``parsed`` (file, parse_errors) are the learner's files; one that gave nothing counts as one error.
    """
    lost = lambda df, c: df.groupBy("file").agg(F.count_if(F.col("status") == "missing").alias(c))
    met = files.select("file").distinct().join(lost(symbols, "symbols"), "file", "left").join(lost(imports, "imports"), "file", "left")
    met = met.join(parsed.select("file", F.col("parse_errors").alias("errors")), "file", "left")
    n = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("symbols", "imports")}
    errors = F.coalesce("errors", F.lit(1)).cast("long")
    reason = F.when(F.col("errors").isNull(), "nothing could be read from this file").when(errors > 0, F.concat(F.lit("parsed with "), T.plural(errors, "error")))
    ok = (n["symbols"] == 0) & (n["imports"] == 0) & (errors == 0)
    return met.select("file", n["symbols"].alias("missing_symbols"), n["imports"].alias("missing_imports"), errors.alias("parse_errors"), reason.alias("reason"), ok.alias("ok"))


def limited(items, n: int, joiner: str = ", "):  # noqa: ANN001, ANN201
    """A list column as words: the first n, and ``and N more`` if any were left out."""
    more = F.size(items) - n
    return F.concat(F.array_join(F.slice(items, F.lit(1), F.lit(n)), joiner), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))
