"""More registered queries: scalars, lookups, checks, extraction, and the parts of plans, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.extract import api
from treeline.functions import keys as K
from treeline.functions import paths as P
from treeline.functions import text as T
from treeline.operators import classify as CL
from treeline.operators import delta as D
from treeline.operators import graph as G
from treeline.operators import intervals as IV
from treeline.operators import lookup as L
from treeline.operators import order as O
from treeline.operators import reports as RP
from treeline.operators import search as S
from treeline.plans import architecture as AR
from treeline.plans import review as RV
from treeline.plans import tour as TR
from treeline.queries import query, table, text_of


def said(*parts: object) -> Column:
    """Columns and texts, one after the other."""
    return F.concat(*[x if isinstance(x, Column) else F.lit(str(x)) for x in parts])


def docs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, n_chars FROM documents)"
SQUEEZED = r"regexp_replace(regexp_replace(text, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g'), '[ \t\n\v\f\r]+', ' ', 'g')"


# Scalars -------------------------------------------------------------------------------------------------


@query(rf"""WITH {DOCS}, c AS (SELECT doc_id, text, {SQUEEZED} AS clean FROM d),
e AS (SELECT *, string_split_regex(clean, '[.!?]+') AS between, regexp_extract_all(clean, '[.!?]+') AS stops FROM c),
s AS (SELECT *, [trim(between[i]) || stops[i] for i in range(1, len(stops) + 1) if trim(between[i]) <> '' AND between[i + 1][1] IN ('', ' ') AND (between[i + 1] <> '' OR i = len(stops))] AS told FROM e),
f AS (SELECT *, list_filter(list_transform(range(1, least(len(told), 200) + 1), lambda i: array_to_string(told[1:i], ' ')), lambda x: length(x) <= 400) AS fits,
  clean[1:399] AS cut FROM s),
w AS (SELECT *, regexp_replace(cut, ' [^ ]*$', '') AS words FROM f),
n AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'written' WHEN length(clean) <= 400 THEN clean WHEN len(fits) > 0 THEN fits[-1]
  ELSE rtrim(CASE WHEN length(words) > 200 THEN words ELSE cut END) || '…' END AS summary FROM w)
SELECT doc_id, summary, length(trim(text)) > length(summary) + 8 AS expandable FROM n""")
def narration(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.narrate(F.col("text"), F.when(F.col("doc_id") % 3 == 0, "written"))
    return docs(spark, sf_dir).withColumn("n", n).select("doc_id", F.col("n.summary").alias("summary"), F.col("n.expandable").alias("expandable"))


@query(rf"""WITH {DOCS}, c AS (SELECT doc_id, text, text[1:120] AS cut FROM d),
p AS (SELECT *, greatest(length(cut) - coalesce(nullif(instr(reverse(cut), ' .'), 0), 999) , length(cut) - coalesce(nullif(instr(reverse(cut), ' ?'), 0), 999),
  length(cut) - coalesce(nullif(instr(reverse(cut), ' !'), 0), 999)) AS last FROM c)
SELECT doc_id, CASE WHEN length(text) <= 120 THEN text WHEN last - 1 > 60 THEN cut[1:last] ELSE rtrim(cut) || '…' END AS clamped FROM p""")
def sentence_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.clamp(F.col("text"), 120).alias("clamped"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'partBy ' || p_name || '.' WHEN p_partkey % 3 = 1 THEN upper(p_name[1]) || p_name[2:] || '.' ELSE 'a_b ' || p_name || '!' END AS line,
  'a' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '"' END AS bare FROM part""")
def sentence_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    raw = F.when(k % 3 == 0, said("  partBy ", name)).when(k % 3 == 1, said(" ", name, " ")).otherwise(said("a_b ", name, "!"))
    quoted = F.when(k % 2 == 0, said('"a', text_of("p_partkey"), '"')).otherwise(said("a", text_of("p_partkey"), '"'))
    return table(spark, sf_dir, "part").select("p_partkey", T.as_sentence(T.opener(raw)).alias("line"), T.unquote(quoted).alias("bare"))


@query("""SELECT c_custkey, c_custkey || ' file' || CASE WHEN c_custkey = 1 THEN '' ELSE 's' END AS files,
  CASE WHEN c_custkey < 1 THEN 'just now' WHEN c_custkey < 60 THEN c_custkey || ' min ago' WHEN c_custkey // 60 < 24 THEN c_custkey // 60 || ' hour' || CASE WHEN c_custkey // 60 = 1 THEN '' ELSE 's' END || ' ago'
    ELSE c_custkey // 1440 || ' day' || CASE WHEN c_custkey // 1440 = 1 THEN '' ELSE 's' END || ' ago' END AS ago FROM customer WHERE c_custkey < 1000
UNION ALL SELECT c_custkey, (c_custkey // 1000) || ',' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || ' files',
  CASE WHEN c_custkey // 60 < 24 THEN c_custkey // 60 || ' hour' || CASE WHEN c_custkey // 60 = 1 THEN '' ELSE 's' END || ' ago'
    ELSE c_custkey // 1440 || ' day' || CASE WHEN c_custkey // 1440 = 1 THEN '' ELSE 's' END || ' ago' END FROM customer WHERE c_custkey >= 1000""")
def plurals_and_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, now = F.col("c_custkey"), F.lit("2024-05-01 12:00:00").cast("timestamp")
    then = F.timestamp_seconds(F.unix_timestamp(now) - k * 60 - 30)
    return table(spark, sf_dir, "customer").select("c_custkey", T.plural(k, "file").alias("files"), T.ago(then, now).alias("ago"))


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped,
  replace(replace(replace(html, '<', chr(92) || 'u003c'), '>', chr(92) || 'u003e'), '&', chr(92) || 'u0026') AS scripted,
  'a' || chr(92) || 'u001b' || page_id || chr(92) || 'u202e' AS shown FROM pages""")
def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = said("a\x1b", text_of("page_id"), "‮")
    return table(spark, sf_dir, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"), T.json_in_script(F.col("html")).alias("scripted"), T.visible(odd).alias("shown"))


@query("""SELECT s_suppkey, 'n' || s_nationkey || '/f' || s_suppkey || '.py' AS short, 'f' || s_suppkey AS subject, s_nationkey < 5 AS inside,
  CASE WHEN s_suppkey % 2 = 0 THEN 'o' || s_suppkey || '/r' END AS slug FROM supplier""")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = text_of("s_suppkey"), text_of("s_nationkey")
    url = F.when(F.col("s_suppkey") % 2 == 0, said("git@github.com:o", s, "/r.git")).otherwise(said("git@host:o", s, "/r"))
    test = F.when(F.col("s_suppkey") % 3 == 0, said("t/test_f", s, ".py")).when(F.col("s_suppkey") % 3 == 1, said("t/f", s, "_test.go")).otherwise(said("t/f", s, ".spec.ts"))
    root = F.when(F.col("s_nationkey") < 5, said("src/n", n)).otherwise(said("src/n", n, "/f"))
    path = said("src/n", n, "/f", s, ".py")
    return table(spark, sf_dir, "supplier").select("s_suppkey", P.short_name(path).alias("short"), O.test_subject(test).alias("subject"), P.beneath(path, root).alias("inside"), T.repo_slug(url).alias("slug"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'file' WHEN event_id % 4 = 1 THEN 'search' END AS verb,
  CASE WHEN event_id % 4 < 2 THEN event_type || event_id END AS argument, CASE WHEN event_id % 3 > 0 THEN user_id END AS k FROM events""")
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, what = F.col("event_id"), said(F.col("event_type"), text_of("event_id"))
    reply = F.when(k % 4 == 0, said("```\nFETCH: file `", what, "`\n```")).when(k % 4 == 1, said(" fetch: SEARCH  ", what)).when(k % 4 == 2, said("see FETCH: file ", what)).otherwise(said("FETCH: file ", what, "\nmore"))
    answer = F.when(k % 3 == 0, said("no list ", what)).when(k % 3 == 1, said('```json\n[{"k": ', text_of("user_id"), "}]\n```")).otherwise(said('Here: [{"k": ', text_of("user_id"), ', "x": 1}] done'))
    e = table(spark, sf_dir, "events").select("event_id", T.fetch_request(reply).alias("r"), T.model_json(answer, "array<struct<k:long>>").alias("j"))
    return e.select("event_id", F.col("r.verb").alias("verb"), F.col("r.argument").alias("argument"), F.get("j", F.lit(0))["k"].alias("k"))


@query("""SELECT c_custkey, left(sha256('v1' || chr(0) || c_name || chr(0) || '3' || chr(0) || (c_custkey + 3) || chr(0) || c_mktsegment || chr(0) || 'x' || c_custkey), 32) AS key FROM customer""")
def stop_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", K.stop_key("v1", F.col("c_name"), F.lit(3), k + 3, F.col("c_mktsegment"), said("x", k.cast("string"))).alias("key"))


# Predicates and ranges -----------------------------------------------------------------------------------


@query("""SELECT p_partkey, p_size % 5 <> 0 AND p_size > 3 AND p_size % 7 NOT IN (1, 2, 3) AND p_partkey * 300 <= 400000 AND p_partkey % 11 <> 0 AS admitted,
  least(p_size + 59, greatest(p_size * 2, 1))::BIGINT AS last, least(greatest(least(p_size - 1, 24), 6), greatest(p_size * 2, 1))::BIGINT AS opening,
  p_size % 5 <> 0 AND p_size % 7 NOT IN (1, 2) AS parsed, p_size % 5 <> 0 AND p_size % 7 IN (0, 4, 5) AS taught FROM part""")
def file_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("source", "generated", "vendored", "lockfile", "test", "structural", "data")]), (size % 7 + 1).cast("int"))
    binary, path = size % 5 == 0, said("src/f", text_of("p_partkey"), ".py")
    loc = F.when(size > 3, size * 2).otherwise(0)
    return table(spark, sf_dir, "part").select(
        "p_partkey", IV.admissible(path, kind, binary, loc, k * 300, k % 11 == 0).alias("admitted"), IV.interpreted_stop(size, size * 2).cast("long").alias("last"),
        IV.opening(size, size * 2).cast("long").alias("opening"), CL.parse_target(path, kind, binary).alias("parsed"), CL.teachable(kind, binary).alias("taught"),
    )


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_nationkey = 3 WHEN 1 THEN true WHEN 2 THEN false ELSE s_nationkey < 10 END AS matches,
  s_suppkey % 3 = 0 OR s_nationkey = 7 AS screened FROM supplier""")
def path_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), text_of("s_nationkey")
    glob = F.when(k % 4 == 0, "/src/n3/**").when(k % 4 == 1, "*.py").when(k % 4 == 2, "/n*.py").otherwise("n?/")
    glob = F.when(k % 4 == 3, "n?/*.py").otherwise(glob)
    path = said("src/n", n, "/f", text_of("s_suppkey"), ".py")
    hidden = F.when(k % 3 == 0, said(".git/f", n)).when(k % 3 == 1, said(".github/n", n, "/x")).otherwise(said("a/n", n, "/x"))
    s = table(spark, sf_dir, "supplier").withColumns({"regex": CL.attribute_pattern(glob), "path": path})
    return s.select("s_suppkey", F.regexp("path", F.col("regex")).alias("matches"), CL.screened(hidden, ["n7"]).alias("screened"))


@query("""WITH r AS (SELECT p_partkey, p_size + 1 AS s, p_size + 100 + p_partkey % 150 AS e FROM part), n AS (SELECT *, least(ceil((e - s + 1) / 45.0), 3)::INT AS n,
  list_filter(range(10, 401, 10), lambda b: b >= s + 5 AND b <= e - 5) AS blanks FROM r),
p AS (SELECT *, CASE WHEN e - s + 1 <= 1.4 * 45 OR len(blanks) = 0 OR n < 2 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, n), lambda i:
  list_sort(list_transform(blanks, lambda b: {'far': abs(b - (s + (e - s + 1) * i / n::DOUBLE)), 'line': b}))[1].line))) END AS cuts FROM n)
SELECT p_partkey, array_to_string(list_transform(range(1, len(cuts) + 2), lambda i: (CASE WHEN i = 1 THEN s ELSE cuts[i - 1] + 1 END) || '-' || (CASE WHEN i > len(cuts) THEN e ELSE cuts[i] END)), ',') AS sections FROM p""")
def stop_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size") + 1
    blanks = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: i * 10)
    parts = IV.sections(s, s + 99 + k % 150, blanks)
    shown = F.array_join(F.transform(parts, lambda x: said(x["start"].cast("string"), "-", x["end"].cast("string"))), ",")
    return table(spark, sf_dir, "part").select("p_partkey", shown.alias("sections"))


# Checks of a learner's work ------------------------------------------------------------------------------

CHECKS = """
ref AS (SELECT o_orderpriority AS file, o_orderkey AS pos, 'm' || o_custkey % 40 AS raw FROM orders WHERE o_orderstatus <> 'F'),
own AS (SELECT o_orderpriority AS file, 'm' || o_custkey % 50 AS raw FROM orders WHERE o_orderkey % 40 = 0),
f AS (SELECT file, raw, min(pos) AS pos FROM ref GROUP BY ALL),
i AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY pos, raw) AS ordinal, raw,
  CASE WHEN EXISTS (SELECT 1 FROM own WHERE own.file = f.file AND own.raw = f.raw) THEN 'present' ELSE 'missing' END AS status FROM f)"""


def import_check(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "file").withColumn("pos", F.col("o_orderkey"))
    raw = lambda n: said("m", (F.col("o_custkey") % n).cast("string")).alias("raw")
    own = o.filter("o_orderkey % 40 = 0").select("file", raw(50))
    return o, S.check_imports(o.filter("o_orderstatus <> 'F'").select("file", "pos", raw(40)), own)


@query(f"WITH {CHECKS} SELECT * FROM i")
def check_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_check(spark, sf_dir)[1]


@query(f"""WITH {CHECKS}, p AS (SELECT o_orderpriority AS file, count(*) % 3 AS n FROM orders GROUP BY 1 HAVING o_orderpriority < '4'),
s AS (SELECT file, count(*) FILTER (status = 'missing') AS n FROM i GROUP BY file)
SELECT file, 0::BIGINT AS missing_symbols, coalesce(s.n, 0) AS missing_imports, coalesce(p.n, 1) AS parse_errors,
  CASE WHEN p.n IS NULL THEN 'nothing could be read from this file' WHEN p.n > 0 THEN 'parsed with ' || p.n || ' error' || CASE WHEN p.n = 1 THEN '' ELSE 's' END END AS reason,
  coalesce(s.n, 0) = 0 AND coalesce(p.n, 1) = 0 AS ok FROM (SELECT DISTINCT o_orderpriority AS file FROM orders) LEFT JOIN s USING (file) LEFT JOIN p USING (file)""")
def check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, imports = import_check(spark, sf_dir)
    parsed = o.groupBy("file").agg((F.count("*") % 3).alias("parse_errors")).filter("file < '4'")
    symbols = o.select("file", F.lit("present").alias("status"))
    return S.check_report(o.select("file"), symbols, imports, parsed)


# Extraction ----------------------------------------------------------------------------------------------


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file for each part."""
    k, size = text_of("p_partkey"), text_of("p_size")
    text = said('"""Part."""\nimport os\nfrom .m', size, " import x\nK", k, " = 1\n\n\ndef f", k, '(a):\n    """Does ', F.col("p_name"), '.\n\n    More.\n    """\n    return a\n\n\nclass C', k, ":\n    def run(self):\n        return 1\n\n    def _hide(self):\n        pass\n")
    return table(spark, sf_dir, "part").select(said("src/p", k, ".py").alias("path"), F.lit("python").alias("language"), text.alias("text"))


@query("""WITH s(pos, name, kind, line, end_line, exported) AS (VALUES (0, 'K', 'variable', 4, 4, true), (1, 'f', 'function', 7, 12, true), (2, 'C', 'class', 15, 20, true),
  (3, 'run', 'method', 16, 17, true), (4, '_hide', 'method', 19, 20, false))
SELECT 'src/p' || p_partkey || '.py' AS path, pos::BIGINT AS pos, CASE WHEN pos < 3 THEN name || p_partkey ELSE name END AS name, kind, line, end_line, exported,
  CASE WHEN pos = 1 THEN 'Does ' || p_name || '.' END AS doc FROM part, s""")
def python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.symbols(api.extract(python_files(spark, sf_dir)))


@query("""SELECT 'src/p' || p_partkey || '.py' AS path, pos::BIGINT AS pos, raw, line FROM part, LATERAL (VALUES (0, 'os', 2), (1, '.m' || p_size, 3)) AS t(pos, raw, line)""")
def python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.imports(api.extract(python_files(spark, sf_dir))).select("path", "pos", "raw", "line")


def script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = text_of("s_suppkey")
    text = said(
        "import { a } from './n", text_of("s_nationkey"), ".js';\nimport x from 'lib';\n\nexport interface O", k, " { a: number }\nexport type T", k, " = string;\n\nexport function f", k,
        "(n: string): string {\n  return `hi ${n ? `x}` : \"}\"}`;\n}\n\nexport const V", k, " = 1;\n\nfunction hidden() { return require('./u'); }\n",
    )
    return table(spark, sf_dir, "supplier").select(said("src/s", k, ".ts").alias("path"), F.lit("typescript").alias("language"), text.alias("text"))


@query("""WITH s(pos, name, kind, line, end_line, exported) AS (VALUES (0, 'O', 'interface', 4, 4, true), (1, 'T', 'type', 5, 5, true), (2, 'f', 'function', 7, 9, true),
  (3, 'V', 'variable', 11, 11, true), (4, 'hidden', 'function', 13, 13, false))
SELECT 'src/s' || s_suppkey || '.ts' AS path, pos::BIGINT AS pos, CASE WHEN pos < 4 THEN name || s_suppkey ELSE name END AS name, kind, line, end_line, exported FROM supplier, s""")
def script_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.symbols(api.extract(script_files(spark, sf_dir))).drop("doc")


@query("""SELECT 'src/s' || s_suppkey || '.ts' AS path, pos::BIGINT AS pos, raw, line FROM supplier, LATERAL (VALUES (0, './n' || s_nationkey || '.js', 1), (1, 'lib', 2), (2, './u', 13)) AS t(pos, raw, line)""")
def script_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.imports(api.extract(script_files(spark, sf_dir))).select("path", "pos", "raw", "line")


@query("""SELECT 'src/p' || p_partkey || '.py' AS path, p_partkey % 9 = 0 AS poisoned FROM part""")
def poison_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", said("src/p", text_of("p_partkey"), ".py").alias("path"), F.lit("python").alias("language"), F.sha2(text_of("p_partkey"), 256).alias("sha"))
    fatal = p.filter("p_partkey % 9 = 0").select("language", "sha", F.lit("ran out of memory").alias("reason"))
    kept, gone = L.unpoisoned(p, fatal)
    return kept.select("path", F.lit(False).alias("poisoned")).unionByName(gone.select("path", F.lit(True).alias("poisoned")))


# Reviews -------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT doc_id, doc_id % 4 AS b, doc_id // 4 % 4 AS h FROM documents), w AS (SELECT doc_id,
  CASE WHEN b = 1 OR (b = 2 AND h IN (0, 1)) THEN ['read', 'too large', 'symlink', 'none'][b + 1] END AS base, CASE WHEN h = 1 OR (h = 2 AND b IN (0, 1)) THEN ['read', 'too large', 'symlink', 'none'][h + 1] END AS head FROM s)
SELECT doc_id, CASE WHEN base IS NOT NULL AND base = head THEN 'on both sides: ' || base WHEN base IS NOT NULL AND head IS NOT NULL THEN 'on both sides (base: ' || base || '; head: ' || head || ')'
  WHEN head IS NOT NULL THEN 'on the head side: ' || head WHEN base IS NOT NULL THEN 'on the base side: ' || base END AS told FROM w""")
def unread_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    side = lambda i: F.struct(pick(("read", "failed", "skipped", "absent"), i).alias("kind"), pick(("read", "too large", "symlink", "none"), i).alias("reason"))
    k = F.col("doc_id")
    return docs(spark, sf_dir).select("doc_id", D.not_read_on(D.unread(side(k % 4), side(F.floor(k / 4) % 4))).alias("told"))


REVIEW = """r AS (SELECT doc_id, 'f' || doc_id AS path, n_chars AS lines_changed, round((doc_id % 101) / 101.0, 3)::DOUBLE AS delta, doc_id % 6 = 0 AS unread FROM documents)"""


def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    sides = F.when(k % 6 == 0, F.struct(F.lit(None).cast("string").alias("base"), F.lit("too large").alias("head")))
    return table(spark, sf_dir, "documents").select(
        said("f", k.cast("string")).alias("path"), F.col("n_chars").cast("long").alias("lines_changed"), F.round((k % 101) / 101.0, 3).cast("double").alias("meaning_delta"),
        F.when(k % 6 == 0, "unread").otherwise("structure").alias("basis"), sides.alias("sides"), "doc_id",
    )


@query(f"""WITH {REVIEW}, o AS (SELECT *, row_number() OVER (ORDER BY delta DESC, lines_changed DESC, path) AS ordinal FROM r WHERE NOT unread)
SELECT ordinal, path, CASE WHEN delta >= 0.15 THEN 'moved' ELSE 'quiet' END AS chapter, greatest(doc_id % 50 + 1 - 3, 1) AS start, doc_id % 50 + 1 + 20 + 3 AS "end" FROM o WHERE ordinal <= 12""")
def review_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_rows(spark, sf_dir)
    hunk = lambda a, b: rows.select("path", (F.col("doc_id") % 50 + a).alias("start"), (F.col("doc_id") % 50 + b).alias("end"))
    return RV.stops(rows, hunk(1, 4).unionByName(hunk(10, 21))).select("ordinal", "path", "chapter", "start", "end")


@query(f"""WITH {REVIEW} SELECT count(*) AS files, count(*) FILTER (NOT unread AND delta >= 0.15) AS moved, count(*) FILTER (NOT unread AND delta < 0.15) AS steady,
  count(*) FILTER (unread) AS not_scored, max_by(path, (lines_changed, path)) AS biggest_diff, min_by(path, (-delta, -lines_changed, path)) FILTER (NOT unread) AS biggest_change FROM r""")
def review_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RV.opening(review_rows(spark, sf_dir))


@query(f"""WITH {REVIEW}, u AS (SELECT list_sort(list('f' || doc_id || ' on the head side: too large')) AS items FROM r WHERE unread), o AS (SELECT list(path || ' on the head side: too large' ORDER BY path) AS items FROM r WHERE unread)
SELECT len(items)::BIGINT AS n, len(items) || ' files were not read: ' || array_to_string(items[1:3], ', ') || CASE WHEN len(items) > 3 THEN ' and ' || (len(items) - 3) || ' more' ELSE '' END AS text FROM o""")
def unread_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RV.unread_files(review_rows(spark, sf_dir))


@query("""SELECT 'src/part' || p_partkey || '.py' AS path, CASE p_partkey % 3 WHEN 0 THEN 'fix part ' || p_partkey WHEN 1 THEN 'A line of more than twenty characters' ELSE 'the author recorded no reason' END AS reason,
  CASE p_partkey % 3 WHEN 0 THEN 'commit ' || left(sha256(p_partkey::VARCHAR), 8) WHEN 1 THEN 'the description' END AS source FROM part""")
def told_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(
        said("src/part", k.cast("string"), ".py").alias("path"), F.when(k % 3 == 0, said("fix part ", k.cast("string"))).alias("why"), F.when(k % 3 == 0, F.sha2(k.cast("string"), 256)).alias("why_sha"),
        F.when(k % 3 == 1, "# A heading that is long enough\nshort\n  A line of more than twenty characters\nmore").otherwise("# none").alias("body"),
    )
    return D.told_why(files, F.col("body"), F.lit(True)).select("path", "reason", "source")


# Plans ---------------------------------------------------------------------------------------------------

PARTS = """
p AS (SELECT 'src/' || lower(replace(n_name, ' ', '_')) AS root, n_nationkey AS k FROM nation),
f AS (SELECT 'src/' || lower(replace(n_name, ' ', '_')) AS root, count(*) AS files, sum(c_custkey)::BIGINT AS loc, max_by('x/c' || c_custkey, c_custkey) AS top FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
m AS (SELECT p.root, k, coalesce(files, 0) AS files, coalesce(loc, 0) AS loc, top FROM p LEFT JOIN f USING (root)),
e AS (SELECT a.root AS "from", b.root AS "to", a.k + 1 AS n FROM p a JOIN p b ON b.k = a.k * 2 + 1 AND a.k < 10)"""


def part_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    root = said("src/", F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), root.alias("root"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("k"))
    sums = c.agg(F.count("*").alias("file_count"), F.sum("c_custkey").alias("loc"), F.array(F.max_by(said("x/c", text_of("c_custkey")), "c_custkey")).alias("top"))
    met = nation.join(sums, "k", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("file_count", "loc")})
    parts = met.select("root", "k", F.when(F.col("k") % 5 == 0, "repo").otherwise("directory").alias("kind"), "file_count", "loc", F.col("k").alias("public_symbols"), F.coalesce("top", F.array().cast("array<string>")).alias("top"))
    a, b = nation.filter("k < 10").select((F.col("k") * 2 + 1).alias("k"), F.col("root").alias("from"), (F.col("k") + 1).alias("count")), nation.select("k", F.col("root").alias("to"))
    return parts, a.join(b, "k").select("from", "to", "count")


@query(f"""WITH {PARTS}, i AS (SELECT "to" AS root, string_agg("from"[5:], ', ' ORDER BY "from"[5:]) AS users FROM e GROUP BY 1), o AS (SELECT "from" AS root, string_agg("to"[5:], ', ' ORDER BY "to"[5:]) AS used FROM e GROUP BY 1),
a AS (SELECT m.*, users, used FROM m LEFT JOIN i USING (root) LEFT JOIN o USING (root)), x AS (SELECT (SELECT string_agg(root[5:], ', ' ORDER BY root[5:]) FROM a WHERE users IS NULL AND used IS NULL) AS alone,
  (SELECT sum(n) FROM e)::BIGINT AS crossing, (SELECT sum(files) FROM m)::BIGINT AS inside, (SELECT count(*) + 7 FROM customer) AS n, (SELECT count(*) FROM m) AS parts),
c AS (SELECT *, format('{{:,}}', n) AS nn FROM x)
SELECT 0::BIGINT AS ordinal, NULL AS part, 'tree' AS title, parts || ' parts carry ' || nn || ' files. ' || format('{{:,}}', crossing) || ' imports cross between them.' || coalesce(' Unconnected: ' || alone || '.', '') || ' 7 files lie outside.' AS text FROM c
UNION ALL SELECT row_number() OVER (ORDER BY root), root, root, format('{{:,}}', files) || ' code file' || CASE WHEN files = 1 THEN '' ELSE 's' END || ', ' || format('{{:,}}', loc) || ' line' || CASE WHEN loc = 1 THEN '' ELSE 's' END || ', ' || k || ' public symbol' || CASE WHEN k = 1 THEN '' ELSE 's' END
  || CASE WHEN k % 5 = 0 THEN ', a repository of its own' ELSE '' END || '. ' || CASE WHEN users IS NULL AND used IS NULL THEN 'No import connects it to the other parts.'
  ELSE 'It is ' || concat_ws('; ', 'imported by ' || users, 'imports ' || used) || '.' END || coalesce(' Most of its weight: ' || top[3:] || '.', '') FROM a""")
def architecture_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, edges = part_tables(spark, sf_dir)
    total = table(spark, sf_dir, "customer").agg((F.count("*") + 7).alias("n"))
    return AR.steps(parts, edges, total, "tree")


@query(f"""WITH RECURSIVE {PARTS}, r("to", layer) AS (SELECT root, 0 FROM p WHERE root IN (SELECT "from" FROM e) AND root NOT IN (SELECT "to" FROM e) UNION ALL SELECT e."to", layer + 1 FROM r JOIN e ON e."from" = r."to" AND layer < 30)
SELECT p.root, max(layer)::BIGINT AS layer FROM p LEFT JOIN r ON r."to" = p.root GROUP BY p.root""")
def architecture_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AR.layered(*part_tables(spark, sf_dir))


@query("""WITH t AS (SELECT p_partkey AS k, p_size AS z, ['shape', 'file', 'symbol'][p_partkey % 3 + 1] AS kind FROM part)
SELECT k, kind, CASE kind WHEN 'shape' THEN 'Why is c' || k || ' a part of its own?' WHEN 'symbol' THEN 'Fill in f' || k || ': how should this function do its work?'
    ELSE CASE WHEN z % 7 = 0 THEN 'Why is this a file of its own, and of this kind?' ELSE 'It exports ' || CASE WHEN z % 7 = 1 THEN 'nothing' ELSE array_to_string(list_transform(range(1, least(z % 7, 5)), lambda i: 'e' || i), ', ')
      || CASE WHEN z % 7 > 5 THEN ' and ' || (z % 7 - 5) || ' more' ELSE '' END END || ' and imports os. Why is it a module of its own?' END END AS question,
  CASE kind WHEN 'shape' THEN 'c' || k || ' is a chapter of ' || z || ' file' || CASE WHEN z = 1 THEN '' ELSE 's' END || ' and 10 lines.' WHEN 'symbol' THEN 'f' || k || ' has ' || (z + 1) || ' lines of function.'
    ELSE CASE WHEN z % 7 = 0 THEN 'Its exports and imports aren''t known: it wasn''t parsed.' ELSE (z % 7 - 1) || ' exported symbol' || CASE WHEN z % 7 = 2 THEN '' ELSE 's' END || ', 1 import.' END END AS consequence, 'author' AS chosen FROM t""")
def plan_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("shape", "file", "symbol")]), (k % 3 + 1).cast("int"))
    names = F.when(z % 7 == 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), z % 7 - 1), lambda i: said("e", i.cast("string"))))
    asked = F.when(kind == "shape", RP.shape_question(said("c", k.cast("string")), z, F.lit(10))).when(kind == "symbol", RP.symbol_question(said("f", k.cast("string")), F.lit("function"), F.lit(1), z + 1))
    asked = asked.otherwise(RP.file_question(F.when(z % 7 > 0, names), F.array(F.lit("os"))))
    none = F.lit(None).cast("string")
    made = table(spark, sf_dir, "part").select(k.alias("k"), kind.alias("kind"), RP.decision(asked, none, F.lit("none")).alias("d"))
    return made.select("k", "kind", F.col("d.question").alias("question"), F.col("d.options")[0]["consequence"].alias("consequence"), F.col("d.chosen").alias("chosen"))


@query("""WITH r AS (SELECT 'f' || p_partkey AS path, p_size % 7 / 10.0 AS score, p_size * 20 AS loc, p_partkey % 13 AS churn, p_partkey % 17 AS deg FROM part)
SELECT (SELECT max_by(path, (score, -loc, path)) FROM r) AS top, (SELECT max_by(path, (churn, (score, -loc, path))) FROM r WHERE score > 0 AND loc > 0 AND loc < 400 AND churn > 0) AS churned_small,
  (SELECT max_by(path, (loc, (score, -loc, path))) FROM r WHERE loc > 0) AS largest, (SELECT max_by(path, (deg, (score, -loc, path))) FROM r WHERE deg > 0) AS hub,
  (SELECT max_by('d' || n_nationkey, (n_nationkey % 7 / 7.0, 'd' || n_nationkey)) FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 > 1) AS subsystem,
  (SELECT sum(r_regionkey * 10 + 1)::BIGINT FROM region) AS commits, 'a/b/4' AS deepest""")
def overlay_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    ranked = table(spark, sf_dir, "part").select(said("f", k.cast("string")).alias("path"), (z % 7 / 10.0).alias("score"), (z * 20).alias("loc"), (k % 13).alias("churn"), (k % 17).alias("in_degree"))
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    kinds = table(spark, sf_dir, "nation").select(said("d", n.cast("string")).alias("dir"), F.when(n % 2 == 0, "subsystem").otherwise("directory").alias("kind"), (n % 3).alias("file_count"), (n % 7 / 7.0).alias("score"))
    repos = table(spark, sf_dir, "region").select(F.when(r == 4, "a/b/4").otherwise(r.cast("string")).alias("root"), (r * 10 + 1).cast("long").alias("commit_count"))
    return TR.overlay({"ranked": ranked, "kinds": kinds}, repos)


# Registries and messages ---------------------------------------------------------------------------------


@query("""WITH t AS (SELECT 't' || o_orderkey AS id, o_orderkey AS made, o_orderkey % 5 > 0 AS alive FROM orders), w AS (SELECT 't' || c_custkey AS want FROM customer)
SELECT want, arg_max(id, ((id = want), made, id)) AS id FROM w LEFT JOIN t ON alive AND starts_with(id, want) GROUP BY want""")
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    tours = table(spark, sf_dir, "orders").select(said("t", k.cast("string")).alias("id"), k.alias("generated_at"), said("p", k.cast("string")).alias("page"))
    pages = table(spark, sf_dir, "orders").filter("o_orderkey % 5 > 0").select(said("p", k.cast("string")).alias("page"))
    wanted = table(spark, sf_dir, "customer").select(said("t", text_of("c_custkey")).alias("want"))
    return L.find(tours, wanted, pages).select("want", "id")


@query("""SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'working' ELSE left(sha256(o_orderkey::VARCHAR), 10) END AS id, o_custkey AS repo,
  CASE WHEN o_orderkey % 10 = 0 THEN 'uncommitted' WHEN o_custkey % 3 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'current' ELSE 'moved' END AS state FROM orders JOIN customer ON c_custkey = o_custkey""")
def library_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    head = F.when(k % 4 == 1, said("h", text_of("o_custkey"))).otherwise(said("x", text_of("o_orderkey")))
    tours = table(spark, sf_dir, "orders").select(L.tour_id(F.sha2(k.cast("string"), 256), k % 10 == 0).alias("id"), F.col("o_custkey").alias("repo"), head.alias("head"))
    tours = tours.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo")), "repo")
    heads = table(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("repo"), said("h", text_of("c_custkey")).alias("now"))
    return L.with_heads(tours, heads).select("id", "repo", "state")


@query("""WITH p AS (SELECT 'n' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN '/s' || s_suppkey ELSE '' END AS path FROM supplier GROUP BY 1)
SELECT a.path, string_agg(b.path, ',' ORDER BY b.path) AS excluded FROM p a JOIN p b ON starts_with(b.path, a.path || '/') GROUP BY a.path""")
def excluded_beneath(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("s_suppkey") % 2 == 0, said("n", text_of("s_nationkey"), "/s", text_of("s_suppkey"))).otherwise(said("n", text_of("s_nationkey")))
    got = L.beneath_others(table(spark, sf_dir, "supplier").select(path.alias("path")))
    return got.select("path", F.array_join("excluded", ",").alias("excluded"))


@query("""SELECT 'f' || p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN 'absent' ELSE ['file', 'symlink', 'submodule'][p_partkey % 5 % 3 + 1] END AS state FROM part""")
def blobs_at_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    mode = F.element_at(F.array(F.lit("100644"), F.lit("120000"), F.lit("160000")), (k % 5 % 3 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", said("f", k.cast("string")).alias("path"), F.sha2(k.cast("string"), 256).alias("blob"), mode.alias("mode"))
    return L.at_commit(p.select("path"), p.filter("p_partkey % 3 > 0").drop("p_partkey")).select("path", "state")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 4 = 1 THEN 1 ELSE 2 END AS n, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'user' ELSE 'assistant' END AS last_role,
  CASE WHEN event_id % 4 > 1 THEN 1 ELSE 0 END AS here FROM events""")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, id_ = F.col("event_id"), text_of("event_id")
    two = said('[{"role": "user", "content": "q', id_, '"}, {"role": "assistant", "content": "a", "stopIndex": 7, "ts": ', id_, '}, {"role": "user", "content": "  "}]')
    raw = F.when(k % 4 == 0, said("not json ", id_)).when(k % 4 == 1, said('[{"role": "robot", "content": "x', id_, '"}]')).otherwise(two)
    e = table(spark, sf_dir, "events").select("event_id", L.transcript(raw).alias("m"))
    return e.select("event_id", F.size("m").alias("n"), F.get("m", F.size("m") - 1)["role"].alias("last_role"), F.size(L.at_stop(F.col("m"), F.lit(7))).alias("here"))


@query("""SELECT event_id, epoch(TIMESTAMP '2024-01-10 00:00:00') - epoch(date_trunc('second', ts)) > -600 AND epoch(TIMESTAMP '2024-01-10 00:00:00') - epoch(date_trunc('second', ts)) < 21600 AS again FROM events""")
def resumable_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", L.resumable(F.col("ts"), F.lit("2024-01-10 00:00:00").cast("timestamp")).alias("again"))


@query("""WITH p AS (SELECT o_custkey AS repo, 'f' || o_orderkey % 7 AS fp, 'v' || o_orderkey % 2 AS v, o_orderkey AS page FROM orders), w AS (SELECT c_custkey AS repo, 'f' || c_custkey % 7 AS fp FROM customer),
m AS (SELECT repo, page, p.fp = w.fp AND v = 'v1' AS exact FROM p JOIN w USING (repo))
SELECT repo, arg_max(page, (exact, page)) AS page, CASE WHEN bool_or(exact) THEN 'exact' ELSE 'stale' END AS state FROM m GROUP BY repo""")
def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pages = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("repo"), said("f", (k % 7).cast("string")).alias("fingerprint"), said("v", (k % 2).cast("string")).alias("version"), k.alias("built_at"), k.alias("page")
    )
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo"), said("f", (F.col("c_custkey") % 7).cast("string")).alias("fingerprint"), F.lit("v1").alias("version"))
    return L.page_for(pages, wanted)


# Reports -------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) SELECT o_custkey AS repo, o_orderkey AS id FROM r WHERE n <= 4""")
def retained_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("built_at"))
    return RP.retained(o).select("repo", "id")


@query("""SELECT count(*) AS calls, sum(user_id)::BIGINT AS tokens, sum(event_id % 7)::BIGINT AS usd, bool_and(event_id >= 0) AS metered, count(*) FILTER (event_type = 'error') AS failures FROM events""")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1).cast("long").alias("calls")
    failure = F.when(F.col("event_type") == "error", "failed").alias("failure")
    return RP.costs(table(spark, sf_dir, "events").select(one, F.col("user_id").cast("long").alias("tokens"), (F.col("event_id") % 7).alias("usd"), (F.col("event_id") >= 0).alias("metered"), failure))


@query("""SELECT 'f' || l_suppkey AS file, '## f' || l_suppkey || chr(10) || chr(10) || string_agg('### Lines ' || l_orderkey || '–' || (l_orderkey + l_linenumber) || CASE WHEN l_linenumber % 2 = 0 THEN chr(10) || chr(10) || '> a' || chr(10) || '> b' ELSE '' END
  || chr(10) || chr(10) || 'n' || l_partkey, chr(10) || chr(10) ORDER BY l_orderkey, l_orderkey + l_linenumber, 'n' || l_partkey) AS markdown FROM lineitem GROUP BY l_suppkey""")
def notes_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    notes = table(spark, sf_dir, "lineitem").select(
        said("f", text_of("l_suppkey")).alias("file"), F.col("l_orderkey").cast("long").alias("start"), (F.col("l_orderkey") + line).cast("long").alias("end"),
        F.when(line % 2 == 0, "a\nb").alias("quote"), said("n", text_of("l_partkey")).alias("body"),
    )
    return RP.notes_markdown(notes)


@query("""WITH s AS (SELECT o_orderpriority AS part, min(o_orderkey) AS first, list(o_custkey ORDER BY o_orderkey) AS k FROM orders GROUP BY 1) SELECT part, first, sha256(array_to_string(k, ',')) AS entries FROM s""")
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("part"), "o_orderkey", "o_custkey")
    told = F.array_join(F.transform("entries", lambda e: e["o_custkey"].cast("string")), ",")
    return RP.sections(o, "part", "o_orderkey").select("part", "first", F.sha2(told, 256).alias("entries"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 2) THEN ['added', 'modified', 'deleted', 'renamed', 'type changed'][p_partkey % 5 + 1] WHEN p_size % 4 = 0 OR p_size % 3 = 0 THEN ['added', 'modified', 'deleted', 'renamed', 'type changed'][p_partkey % 5 + 1]
    ELSE 'reworked' END AS word, 'moved · ' || printf('%.2f', p_size / 50.0) || ' · ' || p_size || ' line' || CASE WHEN p_size = 1 THEN '' ELSE 's' END || CASE WHEN p_size % 3 + p_size % 2 > 0 THEN ' · +' || p_size % 3 || ' −' || p_size % 2 || ' ~0' ELSE '' END AS told FROM part""")
def change_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size").cast("long")
    status = F.element_at(F.array(*[F.lit(x) for x in "AMDRT"]), (k % 5 + 1).cast("int"))
    word = RP.change_word(status, F.when(z % 3 > 0, "reworked"), z % 4 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", word.alias("word"), RP.stop_text(F.lit("moved"), z / 50.0, z, z % 3, z % 2, F.lit(0)).alias("told"))


@query("""WITH f AS (SELECT c_name AS path, c_mktsegment AS class, c_custkey AS loc FROM customer) SELECT path, loc FROM f WHERE class = 'BUILDING' AND contains(lower(path), '7')""")
def table_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("path"), F.col("c_mktsegment").alias("class"), F.col("c_custkey").alias("loc"))
    return S.table_view(c, "BUILDING", "7", "loc", True).select("path", "loc")


@query("""WITH l AS (SELECT r_regionkey AS layer, 'n' || n_nationkey AS part FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT part, (row_number() OVER (PARTITION BY layer ORDER BY part) - 1 - (count(*) OVER (PARTITION BY layer) - 1) / 2.0)::DOUBLE AS x, layer::DOUBLE AS y FROM l""")
def diagram_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("layer"), said("n", text_of("n_nationkey")).alias("part"))
    none = n.select(F.col("part").alias("from"), F.col("part").alias("to"), F.lit(1).alias("count"))
    return RP.system_diagram(n, none)[0].select("part", "x", "y")


@query("""WITH t AS (SELECT p_brand AS chapter, p_partkey AS k, p_partkey % 3 = 0 AS test FROM part), n AS (SELECT *, CASE WHEN test THEN 'm' || k // 9 ELSE 'm' || k // 6 END AS name FROM t),
s AS (SELECT chapter, name, min(k) AS subject FROM n WHERE NOT test GROUP BY ALL)
SELECT n.chapter, n.k, row_number() OVER (PARTITION BY n.chapter ORDER BY CASE WHEN test THEN coalesce(subject, 2147483648) ELSE n.k END, test, n.k) AS place FROM n LEFT JOIN s ON s.chapter = n.chapter AND s.name = n.name AND n.test""")
def tests_beside_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, said("t/test_m", F.floor(k / 9).cast("string"), ".py")).otherwise(said("s/", k.cast("string"), "/m", F.floor(k / 6).cast("string"), ".py"))
    files = table(spark, sf_dir, "part").select(F.col("p_brand").alias("chapter"), path.alias("path"), k.alias("pos"), (k % 3 == 0).alias("test"))
    order = W.partitionBy("chapter").orderBy("place", "pos")
    return O.beside_subjects(files).select("chapter", F.col("pos").alias("k"), F.row_number().over(order).cast("long").alias("place"))


@query("""WITH RECURSIVE n AS (SELECT p_brand AS c, p_partkey AS k, p_type AS tie FROM part), e AS (SELECT a.c, a.k AS f, b.k AS t FROM n a JOIN n b ON b.c = a.c AND b.k = a.k // 2 AND a.k <> b.k
  UNION SELECT a.c, a.k, b.k FROM n a JOIN n b ON b.c = a.c AND b.k = a.k // 3 AND a.k <> b.k), r(c, k, lev) AS (SELECT c, k, 0 FROM n UNION SELECT e.c, e.f, lev + 1 FROM r JOIN e ON e.c = r.c AND e.t = r.k),
m AS (SELECT c, k, max(lev) AS lev FROM r GROUP BY ALL)
SELECT m.c AS chapter, m.k::VARCHAR AS node, row_number() OVER (PARTITION BY m.c ORDER BY lev, tie, m.k::VARCHAR) AS ordinal FROM m JOIN n ON n.c = m.c AND n.k = m.k""")
def dependency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("chapter"), text_of("p_partkey").alias("node"), F.col("p_partkey").alias("k"), "p_type")
    p = p.withColumns({"half": F.floor(F.col("k") / 2), "third": F.floor(F.col("k") / 3)})
    need = p.select("chapter", F.col("node").alias("from"), F.explode(F.array(text_of("half"), text_of("third"))).alias("to"))
    return O.dependency_order(p.select("chapter", "node", F.col("p_type").alias("tie")), need)
