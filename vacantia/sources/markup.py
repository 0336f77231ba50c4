"""Tags, scripts and text of stored pages, told apart as a browser does.

A page is one run of tokens: comments, scripts and styles with their bodies, and
tags whose attributes are read by their states (a name, then a bare value up to a
blank, or a quoted one up to its quote). What a comment or a script holds is never
taken for a tag, and a ">" or an odd quote inside a value doesn't end one. A quote
that is never closed is taken for a letter. All repeats are possessive or lazy over
single characters, so they run in loops at any length of a page.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ATTRIBUTES = r"""(?:[\s/=]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++)?+)?+)*+"""
COMMENT = r"<!--.*?(?:-->|\z)"
#: Group 1 is the open tag, 2 its name, 3 its attributes, 4 the body.
WITH_BODY = rf"(<(script|style)(?=[\s/>])({ATTRIBUTES})>)(.*?)(?:</\2[\s/]*+>|\z)"
TAG = rf"</?[a-z]{ATTRIBUTES}>|<[!?][^>]*+>"


def bare_markup(html: Column) -> Column:
    """The page without comments and without the bodies of scripts and styles."""
    return F.regexp_replace(html, f"(?is){COMMENT}|{WITH_BODY}", "$1")


def visible_text(html: Column) -> Column:
    """Page text without comments, scripts, styles and tags."""
    return F.trim(F.regexp_replace(F.coalesce(html, F.lit("")), f"(?is){COMMENT}|{WITH_BODY}|{TAG}", ""))


def script_bodies(html: Column, kind: str) -> Column:
    """Bodies of the scripts whose attributes name ``kind``, in page order."""
    whole = F.lit(f"(?is){COMMENT}|{WITH_BODY}")
    page = F.coalesce(html, F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(page, whole, F.lit(3)).alias("a"), F.regexp_extract_all(page, whole, F.lit(4)).alias("b"))
    named = F.filter(pairs, lambda p: F.contains(F.lower(p["a"]), F.lit(kind)))
    return F.transform(named, lambda p: p["b"])
