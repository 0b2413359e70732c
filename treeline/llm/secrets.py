r"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.
DataFrame functions only.

Two first-order character models, of random strings and of ordinary identifiers, are trained from labelled
samples.  Candidates are runs ``[A-Za-z0-9+/_=-]+`` of at least ``MIN_CHARS`` characters; one whose mean
log-likelihood ratio per transition reaches ``MIN_RATIO`` is a secret.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in their order, with pattern and least length (of group 2 for assign).
ASSIGN = (
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
)
VALUE = r"[A-Za-z0-9+/_.=-]+"
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
#: Production parameters of the method.
TOKEN, MIN_CHARS, MIN_RATIO = r"[A-Za-z0-9+/_=-]+", 20, 0.6
#: Labelled samples: this many random strings, and identifiers of so many words; the bound of the fit.
SAMPLES = 4000
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
WORDS = (
    "get set is has make build read write open close load save parse format index count total value name key list "
    "map table column row field user account order item price date time start end first last next previous size "
    "length width height color image file path folder source target input output result error message request "
    "response server client host port query filter group merge split sort search find match replace update delete "
    "insert create remove check test run stop wait send receive buffer stream record batch chunk offset position "
    "limit range page number string integer boolean double option config setting default version release module "
    "package class function method object node tree graph edge path weight score rank label model train document "
    "language word sentence paragraph section chapter book author title review comment thread the and with from "
    "that for this have not but they will what about which when make like time just know take people into year "
    "your good some could them see other than then now look only come over think also back after use two how our "
    "work well way even new want because any these give day most international understanding environment government "
    "information development organization administration communication particularly responsibility straightforward "
    "nacional desarrollo informaciones conocimiento entonces tambien donde cuando siempre trabajo importante gobierno "
    "verantwortung entwicklung gesellschaft wirtschaft bundesregierung zusammenarbeit zwischen wahrscheinlich nicht "
    "developpement gouvernement aujourd connaissance toujours ensemble beaucoup maintenant pourquoi travail monde"
).split()


def train(spark: SparkSession, samples: int = SAMPLES, alphabet: str = ALPHABET) -> list[float]:
    """Log-likelihood ratios (natural log, random against ordinary) of all character pairs, row by row.

    The labelled samples are ``samples`` strings of 40 characters in base64 or base62-like digits made from
    digests (label 1), and as many identifiers joined from ``WORDS`` as snake case, camel case, kebab case or
    plain runs, some with a number (label 0).  Both are expressions of the row number, so every fit gives the
    same model.  The result has ``len(alphabet) ** 2`` numbers, whatever the input.
    """
    n = len(alphabet)
    ids = spark.range(samples)
    digest = F.unhex(F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256))
    b64 = F.substring(F.base64(digest).cast("string"), 1, 40)
    random = F.when(F.col("id") % 3 == 0, F.lower(F.hex(digest)).substr(1, 40)).when(
        F.col("id") % 3 == 1, F.translate(b64, "+/", "-_")
    ).otherwise(b64)
    vocabulary = F.array(*[F.lit(w) for w in WORDS])
    pick = lambda k: F.element_at(vocabulary, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    four = F.array(*[pick(k) for k in range(4)])
    style = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(6))
    number = (F.pmod(F.xxhash64("id", F.lit(10)), F.lit(3000))).cast("string")
    ordinary = (
        F.when(style == 0, F.array_join(four, "_")).when(style == 1, F.array_join(F.transform(four, F.initcap), ""))
        .when(style == 2, F.array_join(four, "-")).when(style == 3, F.array_join(four, ""))
        .when(style == 4, F.upper(F.array_join(four, "_"))).otherwise(F.concat(F.array_join(four, "/"), number))
    )
    labelled = ids.select(random.alias("s"), F.lit(1).alias("label")).unionByName(ids.select(ordinary.alias("s"), F.lit(0).alias("label")))
    chars = F.filter(F.split("s", ""), lambda c: c != "")
    codes = F.transform(chars, lambda c: F.instr(F.lit(alphabet), c) - 1)
    pairs = labelled.select("label", codes.alias("c")).select(
        "label", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: a * n + b)).alias("pair")
    )
    counts = {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}
    out = []
    for a in range(n):
        rows = [[counts.get((label, a * n + b), 0) + 0.25 for b in range(n)] for label in (0, 1)]
        totals = [sum(r) for r in rows]
        out += [math.log(rows[1][b] / totals[1]) - math.log(rows[0][b] / totals[0]) for b in range(n)]
    return out


def matches(text: Column, pattern: str, kind: str, keep) -> Column:  # noqa: ANN001
    """Leftmost non-overlapping matches as ``array<struct<start, end, kind, token>>`` in code points.

    The gaps between matches come from ``split``, the matches from ``regexp_extract_all``; running sums of
    their lengths are the positions.  ``keep`` tells from a match's text whether it counts.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string,token:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        one = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("token"))
        return F.struct(end.alias("at"), F.when(keep(x["hit"]), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    both = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(both, start, step, lambda acc: acc["out"])


def ratio(token: Column, table: Column, alphabet: str = ALPHABET) -> Column:
    """Mean log-likelihood ratio per transition of a token's characters."""
    n = len(alphabet)
    codes = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.instr(F.lit(alphabet), F.substring(token, i, F.lit(1))) - 1)

    def step(acc: Column, c: Column) -> Column:
        add = F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.element_at(table, (acc["last"] * n + c + 1).cast("int")))
        return F.struct(c.cast("int").alias("last"), (acc["sum"] + add).alias("sum"))

    zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    return F.aggregate(codes, zero, step, lambda acc: acc["sum"] / F.greatest(F.length(token) - 1, F.lit(1)))


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model: list[float] | None = None, min_chars: int = MIN_CHARS,
    min_ratio: float = MIN_RATIO, out_name: str = "spans",
) -> DataFrame:
    """All columns of ``docs`` and ``spans array<struct<start, end, kind>>``, by start and then kind.

    A column of ``docs`` with the result's name (``out_name``) gives way to it.

    Positions are code points of the whole text, ends exclusive.  A null or empty text has no spans (an empty
    array).  Spans of the fixed patterns always stay; a model's span is added unless
    one of them holds it whole, so the two may overlap.
    No shuffle; each regular expression runs only on texts that a cheap test lets through.
    """
    docs = docs.drop(out_name)
    if model is None:
        model = train(docs.sparkSession)
    table = F.split(F.lit(",".join(f"{x:.9g}" for x in model)), ",").cast("array<double>")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,kind:string,token:string>>")
    value = lambda hit: F.length(F.regexp_replace(hit, "^" + ASSIGN, "")) >= 6
    long = lambda least: lambda hit: F.length(hit) >= least
    found = {
        "assign": F.when(body.rlike(ASSIGN + VALUE), matches(body, ASSIGN + VALUE, "assign", value)).otherwise(none),
        "access": F.when(body.contains("AKIA"), matches(body, "AKIA[A-Z0-9]{16,}", "access", long(20))).otherwise(none),
        "hex": F.when(body.rlike("[0-9a-f]{24}"), matches(body, "[0-9a-f]{24,}", "hex", long(24))).otherwise(none),
    }
    token = TOKEN[:-1] + "{%d,}" % min_chars
    looks = matches(body, token, "markov", lambda hit: ratio(hit, table) >= min_ratio)
    names = [f"__{k}" for k in KINDS]
    out = docs.select("*", *[v.alias(f"__{k}") for k, v in found.items()], F.when(body.rlike(token), looks).otherwise(none).alias("__markov"))
    base = F.concat("__assign", "__access", "__hex")
    extra = F.filter("__markov", lambda m: ~F.exists(base, lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"])))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    ranked = F.array_sort(F.transform(F.concat(base, extra), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return out.withColumn(out_name, spans).drop(*names)


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every span found replaced by ``mark``; overlapping spans by one mark.  Other columns stay.

    A null text stays null.  A text without spans is returned unchanged.
    """
    found = scan(docs, key, text, out_name="__spans", **options)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(F.col(text), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        first = (acc["at"] == 0) & (s["start"] == 0)
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh | first, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text)))
    masked = F.aggregate("__spans", start, step, rest)
    return found.withColumn(text, F.when(F.size("__spans") > 0, masked).otherwise(F.col(text))).drop("__spans")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
