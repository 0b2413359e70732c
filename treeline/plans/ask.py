"""Questions about a tree: what a prompt quotes, and a bounded number of lookups.

The loop runs on the driver; its lookups are queries over the files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions import paths as P
from treeline.operators import classify as CL
from treeline.operators import search as S
from treeline.sources.files import NEVER

#: Lookups and characters of a question, characters of a fetched file, of each section.
LOOKUPS, BUDGET, FILE_CHARS = 6, 40_000, 60_000
SECTIONS = {"stop": 3000, "explanation": 1500, "page": 2000, "notes": 2000, "file": 8000, "importers": 800, "history": 600}


def context(parts: dict[str, str]) -> str:
    """Sections in a fixed order, each clipped with a note; empty ones left out."""
    out = []
    for name, size in SECTIONS.items():
        text = (parts.get(name) or "").strip()
        if text:
            out.append(f"## {name}\n" + (text if len(text) <= size else text[:size] + f"\n… {len(text) - size} characters left out"))
    return "\n\n".join(out)


def fetch(files: DataFrame, path: str) -> str:
    """A file's text, a folder's listing, or a refusal.  Screened and climbing paths are refused."""
    path = path.strip().removeprefix("./").rstrip("/")
    if path.startswith(("/", "../")) or "/../" in path or path.endswith("/.."):
        return f"refused: {path} is outside the tree"
    here = files.filter(~CL.screened(F.col("path"), NEVER))
    row = here.filter(F.col("path") == path).select("binary", F.substring("text", 1, FILE_CHARS).alias("text"), F.length("text").alias("n")).first()
    if row:
        if row["binary"]:
            return f"{path} is binary"
        return row["text"] + (f"\n… clipped at {FILE_CHARS} characters" if row["n"] > FILE_CHARS else "")
    start = path + "/" if path else ""
    below = here.filter(F.col("path").startswith(start)).select(F.substring_index(F.expr(f"substring(path, {len(start) + 1})"), "/", 1).alias("name")).distinct()
    names = [r["name"] for r in below.orderBy("name").limit(500).collect()]
    return "\n".join(names) if names else f"refused: no file {path}"


def search(files: DataFrame, query: str) -> str:
    if len(query) < S.LEAST_QUERY:
        return f"refused: a search needs {S.LEAST_QUERY} characters"
    hits = S.search(files.filter("NOT binary").select("path", "text"), query, S.MATCHES + 1).collect()
    lines = [f"{h['path']}:{h['line']}: {h['shown']}" for h in hits[: S.MATCHES]]
    return "\n".join(lines + (["… more matches were left out"] if len(hits) > S.MATCHES else [])) or f"no match for {query}"


def parse_request(reply: str) -> tuple[str, str] | None:
    """Verb and argument of a reply that is one request line, perhaps in one fence (as ``text.fetch_request``)."""
    line = reply.strip()
    head, feed, rest = line.partition("\n")
    if feed and head.startswith("```") and (head[3:].isalpha() or not head[3:]) and rest.endswith("```"):
        line = rest[:-3].strip()
    if "\n" in line or line[:6].upper() != "FETCH:":
        return None
    verb, _, argument = line[6:].strip().partition(" ")
    argument = argument.strip()
    argument = argument[argument[:1] in ("'", '"', "`") :]
    argument = argument[: len(argument) - (argument[-1:] in ("'", '"', "`"))].strip()
    return (verb.lower(), argument) if verb.lower() in ("file", "search") and argument else None


def ask(files: DataFrame, question: str, parts: dict[str, str], model: Callable[[str], str]) -> Iterator[tuple[str, str]]:
    """Events of one question: (lookup, what was asked) and, exactly once and last, (answer, text) or (failed,
    reason).  A model that asks for more than is allowed is told so."""
    prompt, used = context(parts) + f"\n\n# Question\n{question}", 0
    for turn in range(LOOKUPS + 1):
        try:
            reply = model(prompt)
        except Exception as e:
            yield "failed", " ".join(str(e).split())[:200]
            return
        request = parse_request(reply)
        if request is None:
            yield "answer", reply
            return
        verb, argument = request
        yield "lookup", f"{verb} {argument}"
        if turn == LOOKUPS or used >= BUDGET:
            got = "refused: no lookups are left; answer now"
        else:
            got = fetch(files, argument) if verb == "file" else search(files, argument)
            got = got[: BUDGET - used]
            used += len(got)
        prompt += f"\n\n# {verb} {argument}\n{got}"
    yield "failed", "the model asked for more lookups than allowed"


def cited(files: DataFrame, answer: str, supplied: list[str]) -> DataFrame:
    """File references of an answer with their verdicts."""
    spark = files.sparkSession
    texts = spark.createDataFrame([(1, answer)], "id long, text string")
    given = spark.createDataFrame([(1, p) for p in supplied], "id long, path string")
    return S.citations(texts, given, files.select("path")).withColumn("name", P.basename(F.col("path")))
