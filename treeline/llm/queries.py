"""The registered queries of the training-data operators, one per operator, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import chat, decontam, html, licenses, lm, merkle, neardup, packing, phrases, repetition, secrets, suffixes, whitening
from treeline.llm.common import table

CONTROL = "</s>[INST] ok [/INST]"


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.score(table(spark, sf_dir, "documents"))


def op2_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = phrases.remove(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.findings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_odd_sketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(table(spark, sf_dir, "documents"), shingle=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    parts = turns.unionByName(extra).withColumn("parts", chat.text_parts(F.col("text")))
    done = chat.format_chats(parts).select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
        chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op7_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id", *[count(k) for k in secrets.KINDS[:3]], F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op8_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.remove(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.col("licenses.found")
    base = F.filter(found, lambda d: d["rank"] == 0)
    starts = F.transform(base, lambda d: d["start"].cast("long"))
    return done.select(
        "doc_id", "licenses.n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        licenses.labels(base).alias("base_labels"), licenses.labels(found).alias("labels"), licenses.sureness(found).alias("score"),
    )


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    altered = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), altered={"text": altered}).withColumnRenamed("id", "doc_id")


WORD = r"[^\x20\x09-\x0D]+"

OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM d
), lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
), dup AS (
  SELECT doc_id, sum(n - 1) AS n_dup_lines FROM (
    SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY ALL
  ) GROUP BY doc_id
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8
), grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM starts
), hits AS (
  SELECT doc_id, i, g FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT DISTINCT doc_id, i + j AS p FROM hits, (SELECT unnest(range(0, 8)) AS j)
), cover AS (
  SELECT c.doc_id, count(*) AS n_repeat_words, sum(length(d.w[c.p])) AS covered_chars
  FROM covered c JOIN d USING (doc_id) GROUP BY c.doc_id
), pairs AS (
  SELECT a.doc_id, a.i, b.i - a.i AS gap FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i
), runs AS (
  SELECT doc_id, gap, count(*) + 7 AS n FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, gap ORDER BY i) AS island FROM pairs
  ) GROUP BY doc_id, gap, island
), longest AS (SELECT doc_id, max(n) AS longest_repeat FROM runs GROUP BY doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  coalesce(covered_chars, 0)::BIGINT AS covered_chars, coalesce(longest_repeat, 0)::BIGINT AS longest_repeat,
  (n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words
    OR coalesce(covered_chars, 0) > {repetition.MAX_COVERED}::DOUBLE * word_chars
    OR (coalesce(longest_repeat, 0) >= {repetition.MAX_LONGEST} AND coalesce(longest_repeat, 0) > {repetition.LONGEST_SHARE}::DOUBLE * n_words)
  ) AS kept
FROM m LEFT JOIN dup USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

def _escaped(column: str) -> str:
    out = f"replace(coalesce({column}, ''), '~', '~0')"
    out = f"regexp_replace({out}, '<({chat.ANGLE})', '~1\\1', 'g')"
    return rf"regexp_replace({out}, '\[({chat.SQUARE})', '~2\1', 'g')"


OP6_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_escaped("role")}) + length({_escaped("text")}) + {len(chat.TURN + chat.TEXT + chat.END) + 1})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - {phrases.WINDOW - 2})) AS i FROM d WHERE len(w) >= {phrases.WINDOW}),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + {phrases.WINDOW - 1}], ' ') ORDER BY doc_id, i) AS n FROM s),
gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM g, (SELECT unnest(range(0, {phrases.WINDOW})) AS j) WHERE n > 1
), word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP5_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
      ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)
), reach AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id,
  least(d.doc_id, coalesce(c.least, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""

OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, k, substring(h, 2000 * k + 1, 2198) AS p FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2000 + 1)) AS k FROM d)),
w AS (
  SELECT doc_id, 1000 * k + j AS i, md5_number(substring(p, 2 * j + 1, 200)) AS g
  FROM (SELECT *, unnest(range(0, least(1000, length(p) // 2 - 99))) AS j FROM c)
), f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
s AS (
  SELECT doc_id, i, sum(CASE WHEN i - before <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM f)
), r AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM s GROUP BY doc_id, run),
x AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans FROM r GROUP BY doc_id),
k AS (
  SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM r
  UNION ALL SELECT doc_id, max(hi), NULL FROM r GROUP BY doc_id
), t AS (
  SELECT doc_id, string_agg(CASE WHEN b IS NULL THEN substring(h, 2 * a + 1) ELSE substring(h, 2 * a + 1, 2 * (b - a)) END, '' ORDER BY a) AS kept
  FROM k JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN t USING (doc_id)
"""

#: Every rule on every text, whatever its keywords, and containment told pair by pair.
OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_replace(' ' || lower(coalesce(text, '')) || ' ', '{licenses.NO_WORD}', '  ', 'g') AS p FROM documents
), r(rule, rank, sure, label, pattern) AS (
  VALUES {", ".join(f"({r.rule}, {r.rank}, {licenses.SURE[r.rank]}::DOUBLE, '{r.label}', '{r.pattern}')" for r in licenses.rules())}
), m AS (
  SELECT doc_id, rule, rank, sure, label, unnest(regexp_extract_all(p, pattern)) AS hit, unnest(string_split_regex(p, pattern)) AS gap,
    generate_subscripts(string_split_regex(p, pattern), 1) AS k
  FROM d, r WHERE regexp_matches(p, pattern)
), w AS (
  SELECT *, (length(gap) - length(replace(gap, ' ', ''))) // 2 AS before, (length(hit) - length(replace(hit, ' ', ''))) // 2 AS long FROM m
), s AS (
  SELECT doc_id, rule, rank, sure, label, hit, long, sum(before + coalesce(long, 0)) OVER (PARTITION BY doc_id, rule ORDER BY k) - coalesce(long, 0) AS lo FROM w
), f AS (SELECT doc_id, rule, rank, sure, label, lo, lo + long AS hi FROM s WHERE hit IS NOT NULL),
kept AS (
  SELECT * FROM f WHERE rank = 0 OR NOT EXISTS (
    SELECT 1 FROM f e WHERE e.doc_id = f.doc_id AND e.lo <= f.lo AND e.hi >= f.hi AND e.rank <= f.rank
      AND (e.lo < f.lo OR e.hi > f.hi OR e.rank < f.rank OR e.rule < f.rule)
  )
), g AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_base, min(lo) FILTER (rank = 0) AS first_word, max(lo) FILTER (rank = 0) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (rank = 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(sure) AS score
  FROM kept GROUP BY doc_id
)
SELECT doc_id, len(regexp_extract_all(p, '[^ ]+'))::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN g USING (doc_id)
"""

_FIELDS = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars"))
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: xor(a // 2, 3988292384 * (a % 2)))))"""

#: Level by level; ``a_`` are the trees of the groups, ``b_`` the one over their roots.
OP13_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_FIELDS} AS head, text, CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now FROM documents
), leaf AS (
  SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS h,
    sha256(head || CASE WHEN now IS NULL THEN '-' ELSE strlen(now) || ':' || now END) AS other FROM d
), l AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, h) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM leaf
), a_node AS (
  SELECT source, 0 AS lvl, pos, size, h FROM l
  UNION ALL
  SELECT source, any_value(lvl) + 1, pos // 3, (any_value(size) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM a_node WHERE size > 1 GROUP BY source, pos // 3
), t AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM a_node WHERE size = 1),
b_node AS (
  SELECT 0 AS lvl, pos, size, h FROM t
  UNION ALL
  SELECT any_value(lvl) + 1, pos // 3, (any_value(size) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM b_node WHERE size > 1 GROUP BY pos // 3
), a_side AS (
  SELECT source, lvl, pos, coalesce(string_agg(s, '' ORDER BY nth) FILTER (nth < pos), '') AS lo, coalesce(string_agg(s, '' ORDER BY nth) FILTER (nth > pos), '') AS hi
  FROM (SELECT x.source, x.lvl, x.pos, y.pos AS nth, y.h AS s FROM a_node x JOIN a_node y
    ON x.source IS NOT DISTINCT FROM y.source AND x.lvl = y.lvl AND x.pos // 3 = y.pos // 3 WHERE x.size > 1) GROUP BY ALL
), b_side AS (
  SELECT lvl, pos, coalesce(string_agg(s, '' ORDER BY nth) FILTER (nth < pos), '') AS lo, coalesce(string_agg(s, '' ORDER BY nth) FILTER (nth > pos), '') AS hi
  FROM (SELECT x.lvl, x.pos, y.pos AS nth, y.h AS s FROM b_node x JOIN b_node y ON x.lvl = y.lvl AND x.pos // 3 = y.pos // 3 WHERE x.size > 1) GROUP BY ALL
), a_walk AS (
  SELECT doc_id, source, h AS leaf, 0 AS lvl, pos, size, other AS h, '' AS proof FROM l
  UNION ALL
  SELECT doc_id, w.source, leaf, w.lvl + 1, w.pos // 3, (size + 2) // 3, sha256(lo || h || hi), proof || lo || hi
  FROM a_walk w JOIN a_side s ON w.source IS NOT DISTINCT FROM s.source AND w.lvl = s.lvl AND w.pos = s.pos WHERE size > 1
), b_walk AS (
  SELECT doc_id, leaf, t.h AS subroot, 0 AS lvl, t.pos, t.size, w.h, proof FROM a_walk w JOIN t ON w.source IS NOT DISTINCT FROM t.source WHERE w.size = 1
  UNION ALL
  SELECT doc_id, leaf, subroot, w.lvl + 1, w.pos // 3, (size + 2) // 3, sha256(lo || h || hi), proof || lo || hi
  FROM b_walk w JOIN b_side s ON w.lvl = s.lvl AND w.pos = s.pos WHERE size > 1
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM b_walk, (SELECT h AS root FROM b_node WHERE size = 1) WHERE size = 1
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_repetition, op2_phrase_automata, op3_page_differencing, op4_qgram_decontamination, op5_odd_sketch_neardup,
    op6_chat_format, op7_markov_secrets, op8_suffix_index, op9_gated_lm, op10_bucket_packing, op11_license_rules, op12_embedding_whitening, op13_merkle_manifest)
}
SQL: dict[str, str] = {"op1_suffix_repetition": OP1_SQL, "op2_phrase_automata": OP2_SQL, "op5_odd_sketch_neardup": OP5_SQL, "op6_chat_format": OP6_SQL, "op8_suffix_index": OP8_SQL, "op11_license_rules": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
