"""Registered queries of scaffolds, peeling and the readers of sources, over the driver's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.extract import api
from treeline.operators import lookup as L
from treeline.operators import order as O
from treeline.operators import reports as RP
from treeline.operators import windows as WN
from treeline.plans import architecture as AR
from treeline.plans import build_plan as BP
from treeline.plans import tour as TR
from treeline.plans import verdicts as V
from treeline.plan_queries import overlay_targets
from treeline.queries import SQL, query, table, text_of

#: A declaration with what is its body between « and », and what stands there afterwards; §B is a block and §T a text made of a
#: document, §N the step.
FORMS = (
    ("function f(a = {}) {«§B»}", ' throw new Error("step §N"); '), ("class A extends M<{ x: 1 }> {«\n  m() {§B}\n»}", " /* step §N */ "), ("const f = ({ a }: { a: string }) =>« [a, `§T`]»;", ' { throw new Error("step §N"); }'),
    ("const n = (function () {«§B»})();", ' throw new Error("step §N"); '), ("var N = V.extend({« a: `§T`, b: { c: 2 } »});", " /* step §N */ "), ("const rows = [« { id: `§T` },\n { id: 'b' } »];", " /* step §N */ "),
    ("const q = `«§T»`;", "step §N"), ("export type R = Readonly<{« a: string; /* §T */ »}>;", " /* step §N */ "), ("export interface I {« a: string; /* §T */ »}", " /* step §N */ "),
    ("const E = (p) =>« <p title=\"§T\">It's {p.a}\n §T</p>»;", ' { throw new Error("step §N"); }'), ("def f(a: dict = {}):\n    \'\'\'Says.\'\'\'\n    «x = \'\'\'§T\'\'\'\n    return x»", 'raise NotImplementedError("step §N")'),
    ("class A: «x = \'\'\'§T\'\'\'; y = 2»", 'raise NotImplementedError("step §N")'),
)


def _split(form: str) -> tuple[str, str, str]:
    head, rest = form.split("«")
    body, tail = rest.split("»")
    return head, body, tail


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_NAMES = ("head", "tail", "new")
_CASES = {n: "CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN {_quoted({'head': _split(f)[0], 'tail': _split(f)[2], 'new': new}[n])}" for i, (f, new) in enumerate(FORMS)) + " END" for n in _NAMES}


@query(f"""WITH d AS (SELECT doc_id, doc_id % 12 AS form, CASE WHEN doc_id % 12 < 10 THEN '// ' ELSE '# ' END AS mark, {_CASES["head"]} AS head, {_CASES["tail"]} AS tail, replace({_CASES["new"]}, '§N', (doc_id + 1)::VARCHAR) AS new FROM documents)
SELECT doc_id, form, 1 AS changed, mark || 'kept {{ (' || chr(10) || head || new || tail || chr(10) || mark || doc_id || chr(10) AS text FROM d""")
def scaffold_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per document, its text inside the body of one of the forms: the bodies go, all else stays."""
    form = F.col("doc_id") % len(FORMS)
    said = F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z ,.]+"), F.lit(0)), "\n")
    block = F.concat(F.lit("\n  /* {{ "), said, F.lit(" */\n  const t = `"), said, F.lit(" ${ { a: 1 }.a } }`;\n  if (/[}'`]/.test(t)) { return '}'; }\n"))
    body = F.lit(None).cast("string")
    head, tail = body, body
    for i, (f, _) in enumerate(FORMS):
        a, b, c = _split(f)
        pieces = [{"§B": block, "§T": said}.get(x, F.lit(x)) for x in re.split("(§[BT])", b)]
        head, tail, body = F.when(form == i, a).otherwise(head), F.when(form == i, c).otherwise(tail), F.when(form == i, F.concat(*pieces)).otherwise(body)
    mark = F.when(form < 10, "// ").otherwise("# ")
    first = F.concat(mark, F.lit("kept { ("))
    text = F.concat_ws("\n", first, F.concat(head, body, tail), F.concat(mark, text_of("doc_id"), F.lit("\n")))
    files = table(spark, sf_dir, "documents").select("doc_id", form.alias("form"), text.alias("text"), text_of("doc_id").alias("path"), F.when(form < 10, "typescript").otherwise("python").alias("language"))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))  # the first and the last lie outside
    span = F.struct(F.lit(2).alias("start"), (lines - 1).alias("end"), (F.col("doc_id") + 1).cast("int").alias("step"))
    files = files.withColumn("ranges", F.array(span))
    cut = api.scaffolds(files).select(F.col("path").cast("long").alias("doc_id"), F.col("text").alias("cut"))
    return files.join(cut, "doc_id").select("doc_id", "form", (F.col("text") != F.col("cut")).cast("int").alias("changed"), F.col("cut").alias("text"))


#: Parts in groups of 64 neighbours; each needs two smaller ones, and some of these need it.
_GRAPH = """n AS (SELECT p_partkey // 64 AS g, p_partkey AS k, p_type AS tie FROM part), w AS (SELECT g, k, tie, k % 64 AS i FROM n),
e AS (SELECT a.g, a.k AS f, b.k AS t FROM w a JOIN w b ON a.g = b.g AND b.i IN (a.i // 2, a.i // 3) AND a.i <> b.i
  UNION SELECT a.g, b.k, a.k FROM w a JOIN w b ON a.g = b.g AND b.i = a.i // 2 AND a.i <> b.i AND (a.k * 7 + a.i) % 11 = 0
  UNION SELECT a.g, a.k, b.k FROM w a JOIN w b ON a.g = b.g AND a.k % 17 = 3 AND b.i = a.i + 3)"""
_PEEL = """s AS (SELECT g, (SELECT list({'f': f, 't': t}) FROM e WHERE e.g = w.g) AS e, list(k::VARCHAR ORDER BY k::VARCHAR) AS left_, 0 AS wave, []::VARCHAR[] AS gone FROM w GROUP BY g),
r AS (SELECT g, e, left_, wave, gone FROM s UNION ALL
  SELECT g, list_filter(e, lambda x: NOT list_contains(now, x.f::VARCHAR) AND NOT list_contains(now, x.t::VARCHAR)), list_filter(left_, lambda x: NOT list_contains(now, x)), wave + 1, now FROM (
    SELECT *, CASE WHEN len(free) > 0 THEN free ELSE [split_part(list_min(list_transform(left_, lambda x: lpad(len(list_filter(e, lambda y: y.f::VARCHAR = x))::VARCHAR, 6, '0') || ' ' || x)), ' ', 2)] END AS now FROM (
      SELECT *, list_filter(left_, lambda x: NOT list_contains(list_transform(e, lambda y: y.f::VARCHAR), x)) AS free FROM r WHERE len(left_) > 0)))"""


def cyclic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (chapter, node, tie) and edges (chapter, from, to) with cycles."""
    k = F.col("p_partkey")
    w = table(spark, sf_dir, "part").select(F.floor(k / 64).alias("g"), k.alias("k"), F.col("p_type").alias("tie"), (k % 64).alias("i"))
    halves = w.select("g", "k", "i", F.explode(F.array_distinct(F.array(F.floor(F.col("i") / 2), F.floor(F.col("i") / 3)))).alias("j"), (F.floor(F.col("i") / 2)).alias("half"))
    far = w.filter("k % 17 = 3").select("g", "k", "i", (F.col("i") + 3).alias("j"), F.lit(-1).cast("long").alias("half"))
    other = w.select("g", F.col("k").alias("o"), F.col("i").alias("j")).hint("merge")  # Spark judges it by its file, which is far smaller
    met = halves.unionByName(far).join(other, ["g", "j"]).filter("i <> j")
    back = met.filter("j = half AND (k * 7 + i) % 11 = 0").select("g", F.col("o").alias("from"), F.col("k").alias("to"))
    edges = met.select("g", F.col("k").alias("from"), F.col("o").alias("to")).unionByName(back)
    return w.select(text_of("g").alias("chapter"), text_of("k").alias("node"), "tie"), edges.select(text_of("g").alias("chapter"), text_of("from").alias("from"), text_of("to").alias("to"))


@query(f"""WITH RECURSIVE {_GRAPH}, {_PEEL}, o AS (SELECT g, wave, unnest(gone) AS node FROM r)
SELECT o.g::VARCHAR AS chapter, node, row_number() OVER (PARTITION BY o.g ORDER BY wave, tie, node) AS ordinal FROM o JOIN w ON w.k::VARCHAR = node""")
def order_of_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.dependency_order(*cyclic(spark, sf_dir))


@query(f"""WITH RECURSIVE l AS (SELECT DISTINCT a.n_nationkey AS t, b.n_nationkey AS f FROM nation a, nation b
    WHERE b.n_nationkey IN ((a.n_nationkey * 2) % 25, (a.n_nationkey * 3 + 1) % 25) AND a.n_nationkey % 5 <> 4 AND a.n_nationkey <> b.n_nationkey),
e AS (SELECT 0 AS g, f, t FROM l), w AS (SELECT DISTINCT 0 AS g, unnest([f, t]) AS k FROM l), {_PEEL}, o AS (SELECT wave - 1 AS layer, unnest(gone) AS node FROM r)
SELECT n_nationkey::VARCHAR AS root, layer::BIGINT AS layer FROM nation LEFT JOIN o ON node = n_nationkey::VARCHAR""")
def layers_of_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation")
    to = F.explode(F.array((k * 2) % 25, (k * 3 + 1) % 25)).alias("to")
    edges = nation.filter(k % 5 != 4).select(k.cast("string").alias("from"), to).withColumn("to", text_of("to"))
    return AR.layered(nation.select(k.cast("string").alias("root")), edges)


@query("""WITH t AS (SELECT p_partkey AS k, p_size AS z, p_name AS n FROM part), r AS (SELECT k, 'p' || k AS path, k % 5 < 4 AND k % 7 < 6 AS readable, k % 5 = 0 AND k % 7 < 6 AS cached, z / 40.0 AS m, n, z FROM t)
SELECT path, CASE WHEN NOT readable THEN 'unclear' WHEN z % 3 = 0 THEN 'surface' ELSE 'unclear' END AS kind, CASE WHEN readable AND m <= 1 THEN m ELSE 0.5 END::DOUBLE AS magnitude,
  CASE WHEN NOT readable THEN 'not judged: there was no answer that could be read' WHEN z % 4 = 0 THEN 'no headline was given' ELSE n END AS headline,
  CASE WHEN NOT readable THEN 'not judged: there was no answer that could be read' WHEN z % 2 = 0 THEN 'told ' || n WHEN z % 4 = 0 THEN 'no headline was given' ELSE n END AS narrative,
  CASE WHEN NOT readable THEN 'unavailable' WHEN cached THEN 'cache' ELSE 'model' END AS source, readable AND (m > 1 OR m >= 0.15) AS changed FROM r""")
def model_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as changed files: a fifth is cached, a fifth has no answer, a seventh one that can't be read."""
    k, z = F.col("p_partkey"), F.col("p_size")
    part = table(spark, sf_dir, "part").select(text_of("p_partkey").alias("key"), F.concat(F.lit("p"), k.cast("string")).alias("path"), F.lit("?").alias("prompt"), k.alias("k"), z.alias("z"), "p_name")
    kind = F.when(F.col("z") % 3 == 0, "surface").otherwise("of its own")
    body = F.to_json(F.struct(kind.alias("kind"), (F.col("z") / 40).alias("magnitude"), F.when(F.col("z") % 4 == 0, "  ").otherwise(F.col("p_name")).alias("headline"), F.when(F.col("z") % 2 == 0, F.concat(F.lit("told "), F.col("p_name"))).alias("narrative")))
    reply = F.when(F.col("k") % 7 == 6, F.concat(F.lit("no: "), F.substring(body, 1, 9))).otherwise(F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\n")))
    replies = part.select("key", F.when(F.col("k") % 5 < 4, reply).alias("answer"), "k")
    provider = lambda asked: asked.join(replies.filter("k % 5 > 0 OR k % 7 = 6"), "key", "left").select("key", "answer")
    return V.judged(part.select("key", "path", "prompt"), replies.filter("k % 5 = 0").select("key", "answer"), provider).drop("key")


@query("""WITH s AS (SELECT l_suppkey AS file, l_orderkey * 8 + l_linenumber AS pos, CASE WHEN l_partkey % 4 = 0 THEN 'variable' ELSE 'function' END AS kind, CASE WHEN l_returnflag <> 'A' THEN 'said' END AS doc,
  l_linestatus = 'O' AS exported, l_orderkey % 997 + 1 AS line, (l_orderkey % 997 + 1 + l_quantity)::BIGINT AS last FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY doc IS NULL, NOT exported, last - line DESC, pos) AS r FROM s WHERE kind <> 'variable')
SELECT file, pos, row_number() OVER (PARTITION BY file ORDER BY line, pos) AS rank FROM r WHERE r <= 6""")
def headline_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as symbols of their suppliers' files."""
    line = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_partkey") % 4 == 0, "variable").otherwise("function")
    start = F.col("l_orderkey") % 997 + 1
    symbols = line.select(
        F.col("l_suppkey").alias("file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), kind.alias("kind"), F.when(F.col("l_returnflag") != "A", "said").alias("doc"),
        (F.col("l_linestatus") == "O").alias("exported"), start.alias("start"), (start + F.col("l_quantity")).cast("long").alias("end"),
    )
    return WN.headline(symbols, ["file"], 6).select("file", "pos", "rank")


@query(f"""WITH t AS ({SQL["overlay_targets"]}), s AS (SELECT unnest([0, 1, 2, 3, 4, 5])::BIGINT AS ordinal, unnest(['top', 'churned_small', 'largest', 'hub', 'subsystem', 'deepest']) AS target,
  unnest([top, churned_small, largest, hub, subsystem, deepest]) AS path FROM t) SELECT ordinal, target, path FROM s WHERE path IS NOT NULL""")
def overlay_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.overlay_steps(overlay_targets(spark, sf_dir))


@query("""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations), m AS (
  SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN role ELSE 'user' END AS role, text FROM t WHERE trim(text) <> '')
SELECT 'treeline:chat:r' || conv_id // 3 || CASE WHEN conv_id % 3 = 0 THEN '' ELSE '#pr-' || conv_id % 3 END AS key, conv_id, count(*) AS n, count(*) FILTER (turn % 4 = 0) AS nowhere,
  sha256(string_agg(role || ':' || text || ':' || turn, '|' ORDER BY turn, role, text)) AS told FROM m GROUP BY conv_id""")
def chats_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations stamped, kept as JSON under their keys, and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    stop = F.when(F.col("turn") % 4 != 0, F.col("turn"))
    none = F.lit(None).cast("string")
    said = turns.withColumn("m", L.stamped(F.col("role"), F.col("text"), stop, none, none, F.col("turn")))
    kept = said.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "m"))), lambda x: x["m"])).alias("stored"))
    c = F.col("conv_id")
    read = kept.select(L.store_key("chat", F.concat(F.lit("r"), F.floor(c / 3).cast("string")), c % 3).alias("key"), "conv_id", L.transcript(F.col("stored")).alias("told"))
    line = F.transform("told", lambda m: F.concat_ws(":", m["role"], m["content"], m["ts"].cast("string")))
    rows = read.select("key", "conv_id", F.size("told").cast("long").alias("n"), F.size(L.at_stop(F.col("told"), F.lit(-1))).cast("long").alias("nowhere"), F.sha2(F.array_join(line, "|"), 256).alias("told"))
    return rows.filter("n > 0")


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS z, p_name AS n, 'f' || p_partkey // 2 AS path, CASE p_partkey % 3 WHEN 0 THEN 'shape' WHEN 1 THEN 'file' ELSE 'symbol' END AS kind FROM part),
l AS (SELECT path, max(z) * 7 - 20 AS loc FROM p GROUP BY path), r AS (SELECT p.*, CASE WHEN kind = 'symbol' THEN z WHEN kind = 'file' AND loc > 0 THEN 1 END AS a, CASE WHEN kind = 'symbol' THEN z + 4 WHEN kind = 'file' AND loc > 0 THEN least(loc, 120) END AS b
  FROM p JOIN l USING (path)), m AS (SELECT DISTINCT path, a, b FROM r WHERE a IS NOT NULL AND b % 2 = 0)
SELECT k::VARCHAR AS id, CASE WHEN m.a IS NULL THEN n ELSE 'does ' || m.a || '-' || m.b END AS consequence, CASE WHEN m.a IS NULL THEN 1 ELSE 1 + m.b % 3 END AS n_options,
  CASE WHEN m.a IS NULL OR m.b % 3 < 2 THEN NULL ELSE 'alt-2' END AS last_id, CASE WHEN m.a IS NULL OR m.a % 2 = 0 THEN 'old' ELSE 'because ' || m.path END AS why, CASE WHEN m.a IS NULL THEN 'commit' ELSE 'interpret' END AS why_source
FROM r LEFT JOIN m ON m.path = r.path AND m.a = r.a AND m.b = r.b""")
def plan_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as steps of a plan; lines that end on an even number are interpreted."""
    k, z = F.col("p_partkey"), F.col("p_size").cast("long")
    kind = F.when(k % 3 == 0, "shape").when(k % 3 == 1, "file").otherwise("symbol")
    part = table(spark, sf_dir, "part").select(text_of("p_partkey").alias("id"), F.concat(F.lit("f"), F.floor(k / 2).cast("string")).alias("path"), kind.alias("kind"), z.alias("z"), F.col("p_name").alias("n"))
    steps = part.select("id", "path", "kind", F.when(F.col("kind") == "symbol", F.col("z")).alias("start"), F.when(F.col("kind") == "symbol", F.col("z") + 4).alias("end"))
    decided = part.select("id", RP.decision(F.struct(F.lit("?").alias("question"), F.col("n").alias("consequence")), F.lit("old"), F.lit("commit")).alias("decision"))
    loc = part.groupBy("path").agg((F.max("z") * 7 - 20).alias("loc"))
    asked = BP.asked(steps, loc).filter("end % 2 = 0")
    other = F.struct(F.lit("another way").alias("label"), F.lit("so so").alias("consequence"))
    meanings = asked.select(
        "path", "start", "end", F.concat_ws("", F.lit("does "), "start", F.lit("-"), "end").alias("summary"), F.when(F.col("start") % 2 == 1, F.concat(F.lit("because "), "path")).otherwise(" ").alias("why"),
        F.array_repeat(other, (F.col("end") % 3).cast("int")).alias("alternatives"),
    )
    d = BP.interpreted(steps, decided, loc, meanings).select("id", "decision.*")
    return d.select("id", F.col("options")[0]["consequence"].alias("consequence"), F.size("options").cast("long").alias("n_options"), F.get(F.col("options"), F.lit(2))["id"].alias("last_id"), "why", "why_source")
