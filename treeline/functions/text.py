"""Text columns: lines, clips, summaries, references, escapes.  Lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a summary.
SUMMARY_CHARS = 400


def line_count(text: Column, truncated: Column | None = None) -> Column:
    """Lines of a text: 0 if empty; a last line without a line feed counts.  -1 where ``truncated``."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    count = F.when(F.length(text) == 0, 0).otherwise(feeds + F.when(text.endswith("\n"), 0).otherwise(1))
    return (F.when(truncated, -1).otherwise(count) if truncated is not None else count).cast("long")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")


def clip(text: Column, size: int, note: str = "…") -> Column:
    """At most ``size`` characters, and a note where something was cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(note))).otherwise(text)


def sentences(text: Column) -> Column:
    """The sentences of a squeezed text, in order.

    A sentence ends with stops before a space or the end; of what lies before it, only what follows the last stop
    inside a word belongs to it.
    """
    marked = F.split(F.regexp_replace(text, "(?<=[.!?]) ", "\x01"), "\x01")
    stops = F.lit(".!?")

    def told(piece: Column) -> Column:
        body = F.rtrim(piece, stops)
        own = F.regexp_replace(body, "^.*[.!?]", "")
        return F.when((body != piece) & (own != ""), F.concat(own, F.substring(piece, F.length(body) + 1, F.length(piece))))

    return F.filter(F.transform(marked, lambda x: told(x)), lambda x: x.isNotNull())


def compress(text: Column, size: int = SUMMARY_CHARS) -> Column:
    """Whole sentences up to ``size`` characters; else a cut at a word past half of it, with an ellipsis."""
    clean = squeeze(text)
    some = F.slice(sentences(clean), 1, size // 2)  # no sentence is shorter than two characters and its space
    none = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))

    def more(acc: Column, s: Column) -> Column:
        longer = F.concat(acc["text"], F.when(acc["text"] == "", "").otherwise(" "), s)
        fits = acc["open"] & (F.length(longer) <= size)
        return F.struct(F.when(fits, longer).otherwise(acc["text"]).alias("text"), fits.alias("open"))

    whole = F.aggregate(some, none, more, lambda acc: acc["text"])
    cut = F.substring(clean, 1, size - 1)
    words = F.regexp_replace(cut, " [^ ]*$", "")
    hard = F.concat(F.rtrim(F.when(F.length(words) > size * 0.5, words).otherwise(cut)), F.lit("…"))
    return F.when(F.length(clean) <= size, clean).otherwise(F.coalesce(F.nullif(whole, F.lit("")), hard))


def clamp(text: Column, size: int) -> Column:
    """At most ``size`` characters: the sentences that end before a space within them, if these are over half of it; else a
    cut with an ellipsis."""
    head = F.substring(text, 1, size)
    whole = F.regexp_extract(head, r"(?s)^.*[.?!](?= )", 0)
    return F.when(F.length(text) <= size, text).when(F.length(whole) * 2 > size + 2, whole).otherwise(F.concat(F.rtrim(head), F.lit("…")))


def as_sentence(text: Column) -> Column:
    """A text with one stop at its end; nothing stays nothing."""
    t = F.trim(text)
    return F.when((t == "") | F.right(t, F.lit(1)).isin(".", "!", "?"), t).otherwise(F.concat(t, F.lit(".")))


def opener(text: Column) -> Column:
    """A text with a capital first, unless its first word is spelled as code: a capital right after a small letter, an
    underscore, a dot or a call's parentheses."""
    t = F.trim(text)
    word = F.regexp_extract(t, r"^\S*", 0)
    small = "abcdefghijklmnopqrstuvwxyz"
    shape = F.translate(word, small + small.upper(), "a" * 26 + "A" * 26)
    marks = [shape.contains("aA"), *[word.contains(x) for x in ("_", ".", "()")]]
    code = marks[0] | marks[1] | marks[2] | marks[3]
    return F.when(code, t).otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t))))


def unquote(text: Column) -> Column:
    """A text without one pair of equal quotes around it."""
    first, last = F.substring(text, 1, 1), F.right(text, F.lit(1))
    return F.when((F.length(text) > 1) & (first == last) & first.isin('"', "'", "`"), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def narrate(text: Column, summary: Column) -> Column:
    """``struct<summary, full, expandable>``: a written summary if there is one, else the text compressed."""
    written = F.trim(F.coalesce(summary, F.lit("")))
    short = F.when(F.length(written) > 0, written).otherwise(compress(text))
    return F.struct(short.alias("summary"), text.alias("full"), (F.length(F.trim(text)) > F.length(short) + 8).alias("expandable"))


#: The words that close an issue.
CLOSING = ("close", "closes", "closed", "fix", "fixes", "fixed", "resolve", "resolves", "resolved")


def issue_refs(text: Column) -> Column:
    """``#n`` references, those after a closing word first, each once, in order.

    A reference begins a word.  One behind a word that ends in a closing word may go on after its digits; any other ends
    there, or goes on with something that isn't part of a name.
    """
    words = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    before = F.concat(F.array(F.lit("")), words)
    digits = lambda w: F.regexp_extract(w, r"^#(\d+)", 1)
    name = lambda w: F.regexp_extract(w, r"^#([A-Za-z0-9_]*)", 1)
    closes = lambda w: F.lower(F.regexp_extract(w, r"[A-Za-z0-9_]*$", 0)).isin(*CLOSING)
    closed = F.transform(words, lambda w, i: F.when(closes(F.element_at(before, i + 1)), digits(w)).otherwise(""))
    named = F.transform(words, lambda w: F.when(name(w) == digits(w), name(w)).otherwise(""))
    found = F.array_distinct(F.filter(F.concat(closed, named), lambda n: n != ""))
    return F.transform(found, lambda n: F.concat(F.lit("#"), n))


def plural(n: Column, word: str) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def ago(then: Column, now: Column) -> Column:
    """``N min ago``, ``N hours ago`` or ``N days ago``."""
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 60)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    unit = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago"))).when(hours < 24, unit(hours, "hour")).otherwise(unit(days, "day"))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def json_in_script(text: Column) -> Column:
    """JSON that can stand inside a script element."""
    for raw, safe in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def visible(text: Column) -> Column:
    """Control and direction characters as ``\\uXXXX``; runs only where a text holds one."""
    odd = r"[\x00-\x08\x0b-\x1f\x7f-\x9f\u200e\u200f\u202a-\u202e\u2066-\u2069]"
    code = lambda c: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))
    chars = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(odd), code(c)).otherwise(c))
    return F.when(text.rlike(odd), F.array_join(chars, "")).otherwise(text)


def repo_slug(url: Column, host: str = "github.com") -> Column:
    """``owner/name`` of a remote URL on ``host``; null if it has none."""
    rest = F.ltrim(F.substring_index(F.trim(url), host, -1), F.lit(":/"))
    there = F.contains(url, F.lit(f"{host}/")) | F.contains(url, F.lit(f"{host}:"))
    slug = F.regexp_replace(rest, r"\.git$", "")
    return F.when(there & slug.rlike("^[^/]+/.+"), slug)


def fetch_request(reply: Column) -> Column:
    """``struct<verb, argument>`` of a reply that is one request line, perhaps in one fence; else null."""
    whole = F.btrim(reply, F.lit(" \t\r\n"))
    lines = F.split(whole, "\n")
    fenced = (F.size(lines) > 1) & F.get(lines, F.lit(0)).rlike("(?i)^```[a-z]*$") & whole.endswith("```")
    inner = F.substring(whole, F.instr(whole, "\n") + 1, F.greatest(F.length(whole) - F.instr(whole, "\n") - 3, F.lit(0)))
    line = F.when(fenced, F.btrim(inner, F.lit(" \t\r\n"))).otherwise(whole)
    said = F.ltrim(F.substring(line, F.lit(7), F.length(line)))
    verb = F.lower(F.element_at(F.split(said, r"\s"), 1))
    argument = F.trim(F.regexp_replace(F.trim(F.substring(said, F.length(verb) + 1, F.length(said))), "^['\"`]|['\"`]$", ""))
    good = (F.upper(F.substring(line, 1, 6)) == "FETCH:") & ~F.contains(line, F.lit("\n")) & verb.isin("file", "search") & (argument != "")
    return F.when(good, F.struct(verb.alias("verb"), argument.alias("argument")))


def model_json(reply: Column, schema: str) -> Column:
    """The outermost array or object of a model's answer, fence or not, read leniently; null if there is none."""
    body = F.regexp_extract(reply, r"(?s)(\[.*\]|\{.*\})", 1)
    return F.when(body != "", F.from_json(body, schema, {"mode": "PERMISSIVE"}))
