"""Markdown rule files as arrays of structs: sections, labelled blocks, quotations, numbered headings, watch lists, licences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosescan.functions import text as T


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def heading_number(heading: Column) -> Column:
    """struct<number, title>: a heading's leading number, null if it has none."""
    shape = r"^(\d{1,3})\s*[.、:：)）]?\s*(\S.*)$"
    bare = F.trim(heading)
    return F.when(bare.rlike(shape), F.struct(F.regexp_extract(bare, shape, 1).cast("int").alias("number"), F.trim(F.regexp_extract(bare, shape, 2)).alias("title"))).otherwise(F.struct(F.lit(None).cast("int").alias("number"), bare.alias("title")))


def sections(text: Column, level: int) -> Column:
    """array<struct<heading, number, title, body>> of the sections at a heading level."""
    parts = F.split(text, rf"(?md)^(?=#{{{level}}}[ \t])")
    mine = F.filter(parts, lambda p: p.rlike(rf"\A#{{{level}}}[ \t]"))

    def made(p: Column) -> Column:
        heading = F.trim(F.regexp_extract(p, rf"\A#{{{level}}}[ \t]+([^\n]*)", 1))
        n = heading_number(heading)
        return F.struct(heading.alias("heading"), n["number"].alias("number"), n["title"].alias("title"), F.regexp_replace(p, r"\A[^\n]*\n?", "").alias("body"))

    return F.transform(mine, made)


def labelled_blocks(text: Column) -> Column:
    """array<struct<label, content>> of blocks that open with a bold label and a colon."""
    parts = F.filter(F.split(text, r"(?md)^(?=\s*\*\*[^\n]+?[:：]\*\*)"), lambda p: p.rlike(r"\A\s*\*\*[^\n]+?[:：]\*\*"))
    shape = r"(?s)\A\s*\*\*([^\n]+?)[:：]\*\*[ \t]*(.*)\z"
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, shape, 1)).alias("label"), T.trim_all(F.regexp_extract(p, shape, 2)).alias("content")))


def unquoted(text: Column) -> Column:
    """Text without blockquote markers."""
    return T.trim_all(F.regexp_replace(text, r"(?md)^[ \t]*>[ \t]?", ""))


def blockquotes(text: Column) -> Column:
    """The runs of quoted lines, unquoted."""
    return F.filter(F.transform(T.extract(text, r"(?md)(?:^[ \t]*>[^\n]*(?:\n|\z))+"), unquoted), lambda q: q != "")


# Lines that open a numbered section: a heading with its title, a bold lead, a heading with its number only.
HEADED = r"^\s{0,3}#{1,6}\s*(\d{1,3})\s*[.、:：)）]?\s+(.+?)\s*#*\s*$"
LED = r"^\s*\*\*\s*(\d{1,3})\s*[.、:：)）]\s*(.+?)\s*\*\*"
BARE = r"^\s{0,3}#{1,6}\s*(\d{1,3})\s*$"


def numbered_headings(text: Column) -> Column:
    """array<struct<number, title>> by number: headings, bold leads and bare numbers whose title follows; the first of a number counts."""
    ls = lines(text)
    rows = F.transform(F.sequence(F.lit(1), F.size(ls)), lambda i: F.struct(F.try_element_at(ls, i).alias("line"), T.trim_all(F.concat_ws("\n", F.slice(ls, i + 1, 3))).alias("below")))

    def found(r: Column) -> Column:
        line = r["line"]
        under = F.regexp_replace(F.regexp_extract(r["below"], r"\A([^\n]+)", 1), r"^[*_`]+|[*_`]+$", "")
        ways = [(HEADED, F.trim(F.regexp_extract(line, HEADED, 2))), (LED, F.trim(F.regexp_extract(line, LED, 2))), (BARE, under)]
        each = F.array(*[F.when(line.rlike(p), F.struct(F.regexp_extract(line, p, 1).cast("int").alias("number"), title.alias("title"))) for p, title in ways])
        return F.get(F.filter(each, lambda h: h.isNotNull()), 0)

    hits = F.filter(F.transform(rows, found), lambda h: h.isNotNull() & (h["title"] != ""))
    start = F.array().cast("array<struct<number:int,title:string>>")
    return F.array_sort(F.aggregate(hits, start, lambda a, h: F.when(F.exists(a, lambda x: x["number"] == h["number"]), a).otherwise(F.array_append(a, h))))


def split_note(phrase: Column) -> Column:
    """struct<text, note>: a phrase and the remark in parentheses that closes it."""
    shape = r"^(\S.*?)\s*[(（]([^)）]*[^)）\s][^)）]*)[)）]\s*$"
    return F.when(phrase.rlike(shape), F.struct(F.regexp_extract(phrase, shape, 1).alias("text"), F.trim(F.regexp_extract(phrase, shape, 2)).alias("note"))).otherwise(F.struct(phrase.alias("text"), F.lit(None).cast("string").alias("note")))


def watch_list(text: Column) -> Column:
    """array<struct<text, note, kind>> of a list parted by semicolons and commas outside of quotes and brackets."""
    piece = r"""(?:"[^"]*"|“[^”]*”|「[^」]*」|\([^)]*\)|（[^）]*）|\[[^\]]*\]|【[^】]*】|[^,，、;；"“「(（\[【])+"""
    clean = lambda p: F.regexp_replace(F.regexp_replace(p, r"\*\*|`", ""), r"""^[\s"“「*_\-•]+|[\s"”」*_.。]+$""", "")
    entries = F.filter(F.transform(T.extract(text, piece), lambda p: split_note(T.trim_all(p))), lambda e: clean(e["text"]) != "")
    kind = lambda t: F.when(t.rlike(r"(?<![A-Za-z])[XYZN](?![A-Za-z])|\[[^\]]*\]|…|\.\.\."), "template").otherwise("literal")
    return F.transform(entries, lambda e: F.struct(clean(e["text"]).alias("text"), e["note"].alias("note"), kind(e["text"]).alias("kind")))


def copyright_holders(text: Column) -> Column:
    """The copyright lines of a licence, white space collapsed."""
    return F.transform(F.filter(F.transform(lines(text), T.trim_all), lambda x: x.rlike(r"(?i)^copyright\b")), lambda x: F.regexp_replace(x, r"\s+", " "))


# A licence's family, then the phrases it is known by; all parts between bars must be there, each by one of its ways between slashes. The first that fits counts.
LICENCES = """
AGPL: gnu affero general public license
LGPL: gnu lesser general public license
GPL: gnu general public license
Apache-2.0: apache license | version 2.0
BSD-3-Clause: bsd 3-clause / redistribution and use in source and binary forms | neither the name of the copyright holder
BSD-2-Clause: bsd 3-clause / redistribution and use in source and binary forms
MIT: mit license / permission is hereby granted, free of charge
MPL-2.0: mozilla public license
ISC: isc license
"""


def license_family(text: Column) -> Column:
    """A licence's family by the table above; 'unknown' for null and for a text that fits none."""
    table = [line.split(": ", 1) for line in LICENCES.strip().split("\n")]
    known = F.array(*[F.struct(F.lit(name).alias("family"), F.array(*[F.array(*[F.lit(way) for way in part.split(" / ")]) for part in parts.split(" | ")]).alias("parts")) for name, parts in table])
    low = F.lower(F.coalesce(text, F.lit("")))
    fits = F.filter(known, lambda k: F.forall(k["parts"], lambda ways: F.exists(ways, lambda way: F.contains(low, way))))
    return F.coalesce(F.get(fits, 0)["family"], F.lit("unknown"))


def license_delta(before: Column, after: Column) -> Column:
    """struct<before, after, changed, lost>: the families of two versions of a licence and the copyright lines that the later one lacks; a missing version is empty."""
    old, new = license_family(before), license_family(after)
    lost = F.array_except(copyright_holders(F.coalesce(before, F.lit(""))), copyright_holders(F.coalesce(after, F.lit(""))))
    return F.struct(old.alias("before"), new.alias("after"), (old != new).alias("changed"), lost.alias("lost"))
