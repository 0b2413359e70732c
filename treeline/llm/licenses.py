"""License scans: ordered signature rules behind a keyword filter, overlaps resolved by rank and containment.
DataFrame functions only.

A text becomes its lower-case words with two spaces between them, so that each has a space of its own on either side: a
rule is a regular expression over whole words, matches never share a space, and counting spaces gives word numbers.
Rules come from ``FAMILIES`` by five forms of mention each, and from ``TEXTS``, passages of the licenses themselves.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.arrays import running

#: What separates words, and the phrases that always count, with their labels.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Label; keywords (every mention has all words of one of them); names; versions.
#: A name that ends in ``!`` needs no "license" behind it.  In names and passages, ``a|b`` is either word, ``a?`` a word that may lack, ``*3`` up to three words of any kind.
FAMILIES = (
    ("mit", "mit license|mit licence|expat", "mit|expat", ""),
    ("mit-0", "mit no|mit 0", "mit no attribution|0", ""),
    ("x11", "x11 license|x11 licence", "x11", ""),
    ("apache", "apache license|apache licence|apache software", "apache software?", "1.0 1.1 2.0"),
    ("gpl", "general public|gpl", "gnu? general public/gnu? gpl!", "1.0 2.0 3.0"),
    ("lgpl", "lesser general|library general|lgpl", "gnu? lesser|library general public/gnu? lgpl!", "2.0 2.1 3.0"),
    ("agpl", "affero general|agpl", "gnu? affero general public/gnu? agpl!", "1.0 3.0"),
    ("gfdl", "free documentation|gfdl|fdl", "gnu? free documentation/gfdl!/gnu fdl!", "1.1 1.2 1.3"),
    ("mpl", "mozilla public|mpl", "mozilla public/mpl!", "1.0 1.1 2.0"),
    ("epl", "eclipse public|epl", "eclipse public/epl!", "1.0 2.0"),
    ("cddl", "cddl|common development", "common development and distribution/cddl!", "1.0 1.1"),
    ("cpl", "cpl|common public", "common public/cpl", "1.0"),
    ("cpal", "cpal|common public", "common public attribution/cpal", "1.0"),
    ("eupl", "eupl|european union", "european union public/eupl!", "1.0 1.1 1.2"),
    ("bsd", "bsd", "bsd", ""),
    ("bsd-2-clause", "bsd|freebsd", "bsd 2|two clause!/simplified bsd!/freebsd/2|two clause bsd!", ""),
    ("bsd-3-clause", "bsd", "bsd 3|three clause!/new|modified|revised bsd/3|three clause bsd!", ""),
    ("bsd-4-clause", "bsd", "bsd 4|four clause!/original bsd/4|four clause bsd!", ""),
    ("0bsd", "bsd|0bsd", "0bsd!/zero clause bsd!/bsd zero clause!", ""),
    ("isc", "isc license|isc licence", "isc", ""),
    ("zlib", "zlib", "zlib/zlib libpng", ""),
    ("libpng", "libpng", "libpng", "2.0"),
    ("bsl", "boost software|bsl", "boost software/bsl", "1.0"),
    ("busl", "business source|busl", "business source/busl!", "1.1"),
    ("artistic", "artistic license|artistic licence", "artistic/perl artistic", "1.0 2.0"),
    ("afl", "academic free|afl", "academic free/afl", "1.1 1.2 2.0 2.1 3.0"),
    ("osl", "open software|osl", "open software/osl", "1.0 1.1 2.0 2.1 3.0"),
    ("ecl", "educational community|ecl", "educational community/ecl", "1.0 2.0"),
    ("ofl", "ofl|open font", "sil open font/ofl/open font", "1.0 1.1"),
    ("ms-pl", "microsoft public|ms pl", "microsoft public/ms pl!", ""),
    ("ms-rl", "microsoft reciprocal|ms rl", "microsoft reciprocal/ms rl!", ""),
    ("python", "python license|python licence|python software|psf", "python software foundation/psf/python", "2.0"),
    ("php", "php license|php licence", "php", "3.0 3.01"),
    ("ruby", "ruby license|ruby licence", "ruby", ""),
    ("vim", "vim license|vim licence", "vim", ""),
    ("openssl", "openssl", "openssl", ""),
    ("unicode", "unicode license|unicode licence", "unicode", ""),
    ("postgresql", "postgresql", "postgresql", ""),
    ("ncsa", "ncsa", "university of illinois ncsa open? source?/ncsa", ""),
    ("w3c", "w3c", "w3c software? and? document? notice? and?", ""),
    ("curl", "curl license|curl licence", "curl", ""),
    ("wtfpl", "wtfpl", "wtfpl!", ""),
    ("unlicense", "unlicense", "unlicense!", ""),
    ("public-domain", "public domain", "public domain dedication|mark!", ""),
    ("odbl", "odbl|open database", "open database/odc? odbl!", "1.0"),
    ("odc-by", "odc by|data commons", "open data commons attribution/odc by", "1.0"),
    ("pddl", "pddl", "pddl!/odc pddl!", "1.0"),
    ("sspl", "server side|sspl", "server side public/sspl!", "1.0"),
    ("elastic", "elastic license|elastic licence", "elastic", "1.0 2.0"),
    ("polyform", "polyform", "polyform noncommercial|strict|shield|perimeter", "1.0"),
    ("cecill", "cecill", "cecill!", "1.0 2.0 2.1"),
    ("ogl", "ogl|open government", "open government/ogl", "1.0 2.0 3.0"),
    ("openrail", "openrail|bigscience", "openrail m?!/bigscience rail!", ""),
    ("cc0", "cc0|commons zero", "cc0!/creative commons cc0!/creative commons zero!", "1.0"),
    ("cc-by", "cc by|commons attribution", "cc by!/creative commons attribution!", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "cc by|commons attribution", "cc by sa!/creative commons attribution share? sharealike|alike!", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "cc by|commons attribution", "cc by nd!/creative commons attribution no? noderivs|noderivatives|derivatives|derivs!", "2.0 3.0 4.0"),
    ("cc-by-nc", "cc by|commons attribution", "cc by nc!/creative commons attribution non? noncommercial|commercial!", "1.0 2.0 3.0 4.0"),
    ("cc-by-nc-sa", "cc by|commons attribution", "cc by nc sa!/creative commons attribution non? noncommercial|commercial share? sharealike|alike!", "1.0 2.0 3.0 4.0"),
    ("cc-by-nc-nd", "cc by|commons attribution", "cc by nc nd!/creative commons attribution non? noncommercial|commercial no? noderivs|noderivatives|derivatives|derivs!", "2.0 3.0 4.0"),
)
#: Label, keyword and passage of a license's own text or of a notice that its authors ask for.
TEXTS = (
    ("mit", "person obtaining", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "distribute sublicense", "to use copy modify merge publish distribute sublicense and or sell copies"),
    ("bsd", "binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or", "neither the name *12 nor the names of its|any contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display"),
    ("isc", "without fee", "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("gpl", "redistribute it", "is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "lesser general", "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "affero general", "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl-2.0-or-later", "your option", "version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "your option", "version 3 of the license or at your option any later version"),
    ("apache-2.0", "apache org", "you may not use this file except in compliance with the license *12 www apache org licenses license 2 0"),
    ("apache-2.0", "is basis", "distributed on an as is basis without warranties or conditions of any kind"),
    ("mpl-2.0", "mozilla public", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2.0", "eclipse public", "made available under the terms of the eclipse public license 2 0"),
    ("bsl-1.0", "boost software", "distributed under the boost software license version 1 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "released|placed|dedicated *3 into|in|to the public domain"),
    ("cc0-1.0", "has waived", "has waived all copyright and related or neighboring rights"),
    ("wtfpl", "the fuck", "you just do what the fuck you want to"),
    ("artistic-2.0", "verbatim copies", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("ofl-1.1", "font software", "this font software is licensed under the sil open font license"),
    ("proprietary", "rights reserved", "all rights reserved"),
    ("proprietary", "proprietary and", "proprietary and confidential"),
    ("proprietary", "strictly prohibited", "unauthorized copying|reproduction|distribution *6 is strictly prohibited"),
)
#: Ranks, best first, and how sure a detection of each is: fixed phrase, identifier, passage, granted version, version,
#: granted name, bare name.
SURE = (0.9, 1.0, 1.0, 0.95, 0.9, 0.8, 0.6)
DETECTION = "struct<start:int,end:int,rank:int,rule:int,label:string>"


class Rule(NamedTuple):
    """A signature: ``rule`` is its place in the order; every match holds all words of one of ``keywords`` (``a b|c``)."""

    rule: int
    rank: int
    label: str
    keywords: str
    pattern: str


def atoms(phrase: str) -> str:
    """The regular expression of a phrase over padded words."""
    out = ""
    for token in phrase.split():
        if token.startswith("*"):
            out += "(?: [^ ]+ ){0,%s}" % token[1:]
        else:
            word = f"(?: {' | '.join(token.rstrip('?').split('|'))} )"
            out += word + "?" * token.endswith("?")
    return out


def _version(number: str) -> str:
    first, second = number.split(".")
    return f"(?:(?: version | v )?(?: {first} )|(?: v{first} ))" + (f"(?: {second} )" + "?" * (second == "0"))


def rules() -> list[Rule]:
    """All rules in order.  A passage has no version form; a family without versions only the unversioned ones."""
    out: list[tuple[int, str, str, str]] = []
    granted = "(?: (?:licensed|released|distributed|available|published|provided|offered|governed|covered) )" + atoms("*4 under|by the? terms? of? the?")
    for phrase, label in BASE:
        out.append((0, label, phrase, "".join(f" {w} " for w in phrase.split())))
    for label, keyword, phrase in TEXTS:
        out.append((2, label, keyword, atoms(phrase)))
    for label, keywords, names, versions in FAMILIES:
        licence = atoms("public? license|licence")
        name = "|".join(atoms(n.rstrip("!")) + f"(?:{licence})" + "?" * n.endswith("!") for n in names.split("/"))
        tag = atoms("spdx license identifier " + " ".join(label.split("-")))
        for v in versions.split():
            full = f"{label}-{v}"
            out.append((1, full, keywords, tag + _version(v) + atoms("only|or? later?")))
            glued = [f"{w}v{v[0]}" for w in keywords.split("|") if " " not in w]  # as in gplv3
            mention = f"(?:{name})" + _version(v)
            if glued:
                mention = f"(?:{mention}|(?: {' | '.join(glued)} )(?: {v[2:]} )?)"
            keys = "|".join([keywords, *glued])
            out.append((3, full, keys, granted + mention))
            out.append((4, full, keys, mention))
        if not versions:
            out.append((1, label, keywords, tag))
        out.append((5, label, keywords, f"{granted}(?:{name})"))
        out.append((6, label, keywords, f"(?:{name})"))
    return [Rule(i, rank, label, keys, pattern) for i, (rank, label, keys, pattern) in enumerate(out)]


def padded(text: Column) -> Column:
    """The words of a text in lower case, with two spaces before and after each; two spaces without words.

    Lower case beyond A-Z changes no word boundary and gives no phrase of the rules.
    """
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(" ")), NO_WORD, "  ")


def count_words(text: Column) -> Column:
    """How many words a piece of a padded text has, if its first and last words are whole."""
    return F.shiftright(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))), 1)


def places(text: Column, pattern: Column) -> Column:
    """Where a pattern matches a padded text, leftmost without overlaps: ``array<struct<start, end>>`` in words."""
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(count_words(g).alias("gap"), count_words(h).alias("hit")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        return at + x["gap"] + x["hit"], F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["hit"]).alias("end"))

    return running(both, F.lit(0), "struct<start:int,end:int>", step)


def resolved(found: Column, ranks: int = len(SURE)) -> Column:
    """Detections without those that another one of as good a rank contains (of equal ones, the first rule stays).

    Sorted by start and then falling end, what may contain a detection stands before it; so the furthest end of each
    rank or better so far decides, and one pass does.  Rank 0 always stays.
    """
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), d["rank"].alias("rank"), d["rule"].alias("rule"), d["label"].alias("label"))))

    def step(ends: Column, d: Column) -> tuple[Column, Column]:
        stays = (d["rank"] == 0) | (F.element_at(ends, d["rank"] + 1) < -d["back"])
        after = F.transform(ends, lambda e, r: F.when(r >= d["rank"], F.greatest(e, -d["back"])).otherwise(e))
        return after, F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), F.when(stays, d["rank"]).alias("rank"), d["rule"].alias("rule"), d["label"].alias("label"))

    return F.filter(running(ordered, F.array(*[F.lit(-1)] * ranks), DETECTION, step), lambda d: d["rank"].isNotNull())


def scan(docs: DataFrame, text: str = "text", signatures: list[Rule] | None = None, out_name: str = "licenses") -> DataFrame:
    """All columns of ``docs`` and ``licenses struct<n_words, found array<struct<start, end, rank, rule, label>>>``.

    Places are words of the whole text, from 0, ends exclusive; ``found`` is ordered by start, longest first.  A null
    or empty text has no words and nothing found; repeated rows are repeated.  A column of ``docs`` named as the
    result gives way to it.  No shuffle: a text meets the rules of the keywords it holds, and no other.
    """
    groups: dict[str, list[Rule]] = {}
    for r in signatures if signatures is not None else rules():
        groups.setdefault(r.keywords, []).append(r)
    strings = lambda xs: F.array(*[F.lit(x) for x in xs])
    literal = F.array(*[
        F.struct(
            F.array(*[strings(k.split()) for k in keys.split("|")]).alias("keywords"),
            F.array(*[F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.rank).alias("rank"), F.lit(r.rule).alias("rule"), F.lit(r.label).alias("label")) for r in own]).alias("rules"),
        )
        for keys, own in groups.items()
    ])
    body = docs.drop(out_name).withColumn("__padded", padded(F.col(text))).withColumn("__words", F.split("__padded", "  "))
    vocabulary = strings(sorted({w for keys in groups for k in keys.split("|") for w in k.split()}))
    body = body.withColumn("__keys", F.array_intersect(vocabulary, F.col("__words")))
    held = F.filter(literal, lambda g: F.exists(g["keywords"], lambda k: F.forall(k, lambda w: F.array_contains(F.col("__keys"), w))))
    body = body.withColumn("__rules", F.when(F.size("__keys") > 0, F.flatten(F.transform(held, lambda g: g["rules"]))))

    def hits(r: Column) -> Column:
        return F.transform(places(F.col("__padded"), r["pattern"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), r["rank"].alias("rank"), r["rule"].alias("rule"), r["label"].alias("label")))

    body = body.withColumn("__found", F.flatten(F.transform("__rules", hits)))
    found = F.when(F.size("__found") > 0, resolved(F.col("__found"))).otherwise(F.array().cast(f"array<{DETECTION}>"))
    n_words = (F.size("__words") - 2).cast("long")
    return body.withColumn(out_name, F.struct(n_words.alias("n_words"), found.alias("found"))).drop("__padded", "__words", "__keys", "__rules", "__found")


def labels(found: Column) -> Column:
    """Distinct labels of detections, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")


def sureness(found: Column) -> Column:
    """How sure the best detection is, from 0 (none) to 1."""
    table = F.array(*[F.lit(x) for x in SURE])
    return F.coalesce(F.array_max(F.transform(found, lambda d: F.element_at(table, d["rank"] + 1))), F.lit(0.0))
