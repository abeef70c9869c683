"""Licence scan by canonical digests.

A text is put into a canonical form - ASCII letters lower-cased, lines that only state a copyright left
out, equivalent spellings made one, everything but letters and digits turned into single spaces - and the
SHA-256 digest of the whole form is joined with the digests of known licence texts and notices. The scan
looks up each whole document, each whole line of it, and its paragraphs: blocks between lines without letters
and digits, line breaks joined, copyright lines left out. A known text is in a document if all of its
paragraphs follow each other there, so one with other text around is found as long as its paragraphs are
kept. Everything is DataFrame functions.

Texts are read once. Each row gives the digest of its whole form, and those of its lines and paragraphs that can be a
known one: a cheap test of the first word comes before the canonical form, and leaves out most of them. What is left
is stored under a number of the row and joined by digest.

Nulls: a null text is an empty one. An empty canonical form has no licence. Rows are told apart by a number of
their own, so rows that repeat a ``doc_id``, and rows of a null one, each get the licences of their own text. Known
rows with a null name or text are left out; if two names share a digest the alphabetically first counts. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steadypace.operators.skew import broadcast_if_small
from steadypace.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Whole texts, a file for each licence; the notice of a text's owner is left out of some.
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
# Titles and lines that often stand before texts, and the line after which appendices begin.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License",
                     "BSD 3-Clause \"New\" or \"Revised\" License"),
    "Unlicense": ("The Unlicense",),
}
RESERVED = "All rights reserved."
END = "END OF TERMS AND CONDITIONS"

# Notices as they are usually written.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
            "without fee is hereby granted, provided that the above copyright notice and this "
            "permission notice appear in all copies."),
]
# What parts paragraphs, a line that is only a copyright statement, and spellings that mean the same.
PARAGRAPH_END = r"\n[^A-Za-z0-9]*\n"
# A wrapped line of a text may begin with the word too, as in "copyright notice".
COPYRIGHT_LINE = (
    r"(^|\n)[ \t]*(copyright(?![ \t\r]*(\n|$|[,.;:)/'\"-]|(notices?|holders?|owners?|laws?|licen[cs]es?|interests?|"
    r"statements?|permission|protection|treat(y|ies)|disclaimers?|rights?|status|acts?|and|or|on|to|of|in|is|for|as|"
    r"under|that|the[ \t\r]*(\n|software|program|library|work))\b))|\(c\)[ \t]*(copyright|[0-9\[<{])|©)[^\n]*"
)
# Each with a part that a text must have for it to apply (empty: any text).
SPELLINGS = [
    ("licence", r"licence", "license"), ("licens", r"sub-?licens", "sublicens"),
    ("noninfringement", r"noninfringement", "non-infringement"),
    ("copyright", r"copyright\s+holders?", "copyright owner"), ("http", r"https?://", "//"),
    ("", r"\bv(ersion)? ?([0-9])", "version $2"),
]
# First words of a raw text that the canonical form may change.
CHANGED_FIRST = r"^(sub|sublicen.*|licence.*|noninfringement.*|https?|v|v[0-9].*|version[0-9].*|copyright|c)$"
FIRST_WORDS = 2000  # a longer list of known first words is not tested


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _respelled(part: str, spelled: str, meant: str) -> Callable[[Column], Column]:
    return lambda f: F.when(f.contains(part), F.regexp_replace(f, spelled, meant)).otherwise(f)


def canonical(text: Column) -> Column:
    form = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    form = _let(form, lambda f: F.when(
        f.contains("copyright") | f.contains("(c)") | f.contains("©"), F.regexp_replace(f, COPYRIGHT_LINE, "$1")
    ).otherwise(f))
    for part, spelled, meant in SPELLINGS:
        if part:
            form = _let(form, _respelled(part, spelled, meant))
        else:
            form = F.regexp_replace(form, spelled, meant)
    return F.trim(F.regexp_replace(form, r"[^a-z0-9]+", " "))


def digest(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def whole_texts() -> list[tuple[str, str]]:
    """Known licence texts, with and without usual titles and appendices."""
    out = []
    for file in sorted(os.listdir(TEXTS)):
        name = file.removesuffix(".txt")
        with open(os.path.join(TEXTS, file), encoding="utf-8") as opened:
            text = opened.read()
        texts = [text]
        if END in text:
            texts.append(text[: text.index(END) + len(END)])
        if name.startswith("BSD"):
            texts.append(f"{RESERVED}\n\n{text}")
        texts += [f"{title}\n\n{text}" for title in TITLES.get(name, ()) for text in texts]
        out += [(name, text) for text in texts]
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*KNOWN, *whole_texts()], "license string, text string")


def paragraphs(text: Column) -> Column:
    """Raw texts of the paragraphs that have a canonical form, in order."""
    blocks = F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH_END), lambda p: p.rlike("[A-Za-z0-9]"))
    # Only a statement of copyright can be all that a paragraph with letters or digits has.
    stated = lambda p: p.rlike(r"(?i)(copyright|\(c\)|©)")
    return F.filter(blocks, lambda p: F.when(stated(p), canonical(p) != "").otherwise(True))


def known_parts(known: DataFrame) -> DataFrame:
    """What is looked up: digest, license, and of which run of ``n`` paragraphs it is the ``k``-th (one row of
    ``n = 0`` for a text as a whole or a line)."""
    texts = known.dropna().select("license", canonical(F.col("text")).alias("form"), paragraphs(F.col("text")).alias("p"))
    blocks = texts.select("license", F.transform("p", canonical).alias("blocks"))
    whole = texts.where(F.col("form") != "").select("license", "form", F.lit("").alias("run"), F.lit(0).alias("n"),
                                                     F.lit(0).alias("k"))
    runs = blocks.select("license", digest(F.array_join("blocks", "\n")).alias("run"), F.size("blocks").alias("n"),
                         F.posexplode("blocks").alias("k", "form"))
    return (
        whole.unionByName(runs.select(*whole.columns))
        .groupBy("run", "n", "k", "form").agg(F.min("license").alias("license"))
        .select(digest(F.col("form")).alias("digest"), "license", "run", "n", "k",
                F.substring_index("form", " ", 1).alias("first"))
    )


def _may_be_known(raw: Column, words: list[str] | None) -> Column:
    """Whether a line or paragraph can have one of the known canonical forms, by its first word."""
    first = F.translate(F.regexp_extract(raw, "[A-Za-z0-9]+", 0), UPPER, LOWER)
    if words is None:
        return first != ""
    return first.isin(words) | first.rlike(CHANGED_FIRST) | raw.rlike("^[^A-Za-z0-9]*©")


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, text_sha256 (of the whole canonical form), license (of the whole text,
    else null), licenses (of its lines, runs of paragraphs and the whole, sorted, comma-joined; else empty)."""
    parts = materialise(known_parts(known))
    words = [r[0] for r in parts.select("first").distinct().limit(FIRST_WORDS + 1).collect()]
    words = None if len(words) > FIRST_WORDS else sorted(words)
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: _may_be_known(x, words))
    lines = F.transform(F.array_distinct(F.transform(lines, canonical)),
                        lambda form: F.struct(F.lit(-1).alias("at"), digest(form).alias("digest")))
    blocks = F.transform(paragraphs(text), lambda p, i: F.struct(i.alias("at"), p.alias("p")))
    blocks = F.transform(F.filter(blocks, lambda b: _may_be_known(b["p"], words)),
                         lambda b: F.struct(b["at"].alias("at"), digest(canonical(b["p"])).alias("digest")))
    # A text of one paragraph is looked up as a whole.
    blocks = F.when(text.rlike(PARAGRAPH_END), blocks).otherwise(F.array().cast("array<struct<at:int,digest:string>>"))
    signed = materialise(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", digest(canonical(F.col("text"))).alias("text_sha256"),
        F.concat(lines, blocks).alias("posted"),
    ))
    table = broadcast_if_small(parts.drop("first"))
    met = signed.select("row", F.inline("posted")).join(table, "digest")
    met = met.where((F.col("at") < 0) == (F.col("n") == 0))
    runs = (
        met.where("n > 0").groupBy("row", "run", "license", "n", (F.col("at") - F.col("k")).alias("start"))
        .agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") == F.col("n")).select("row", "license")
    )
    inside = met.where("n = 0").select("row", "license").unionByName(runs).groupBy("row").agg(
        F.collect_set("license").alias("inside"))
    whole = broadcast_if_small(
        parts.where("n = 0").select(F.col("digest").alias("text_sha256"), "license"))
    found = signed.drop("posted").join(whole, "text_sha256", "left").join(inside, "row", "left")
    every = F.array_sort(F.array_distinct(F.concat(
        F.coalesce("inside", F.expr("cast(array() as array<string>)")),
        F.array_compact(F.array("license")),
    )))
    return found.select("doc_id", "text_sha256", "license", F.array_join(every, ",").alias("licenses"))
