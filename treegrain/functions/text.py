"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokenize(text: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and _ of at least two characters; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]{2,}"), F.lit(0))


def slug(title: Column, *, fold_accents: bool = False, limit: int = 32) -> Column:
    """Lower case, runs of other characters become one hyphen, at most `limit` characters, `section` if nothing is left."""
    t = F.translate(title, _ACCENTED, _PLAIN) if fold_accents else title
    t = F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), F.lit("-"))
    t = F.substring(t, 1, limit)
    return F.rtrim(F.when(t == "", "section").otherwise(t), F.lit("-"))


def parent_path(path: Column) -> Column:
    """The path without its last dotted part; empty for a root."""
    return F.when(F.instr(path, ".") == 0, "").otherwise(F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, ".", -1)) - 1))


def path_name(path: Column) -> Column:
    """The last dotted part."""
    return F.substring_index(path, ".", -1)


def chunk_key(path: Column, text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of path, a pipe and text."""
    return F.substring(F.sha2(F.concat(path, F.lit("|"), text), 256), 1, 16)


def summary_prompt(path: Column, text: Column) -> Column:
    """What a summarizer is asked about a chunk: at most 400 characters of it."""
    return F.concat(F.lit("Summarize in one sentence what this part covers.\nPath: "), path, F.lit("\nText: "), strip(F.substring(text, 1, 400)))


def article_number(heading: Column) -> Column:
    """Number of an article heading (`Art. 5`, `Article 5`), or null."""
    n = F.regexp_extract(heading, r"(?i)\bArt(?:icle|\.)?\s*(\d+)\b", 1)
    return F.when(n != "", n.cast("int"))


def point_letter(ordinal: Column) -> Column:
    """0 is a, 1 is b."""
    return F.char(F.lit(97) + ordinal)


def chapter_title(name: Column) -> Column:
    """Underscores to spaces, words capitalized."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def numbered_depth(number: Column) -> Column:
    """Parts of a dotted number, between 1 and 4."""
    return F.least(F.greatest(F.size(F.split(number, r"\.")), F.lit(1)), F.lit(4))


def module_name(relative_path: Column) -> Column:
    """Dotted name of a Python file: a/b.py is a.b, a/__init__.py is a."""
    return F.translate(F.regexp_replace(relative_path, r"(/__init__)?\.py$", ""), "/", ".")


def charset(content_type: Column) -> Column:
    """Charset of a Content-Type header, UTF-8 if it names none."""
    c = F.trim(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset=([^;]+)", 1))
    return F.when(c == "", "utf-8").otherwise(F.lower(F.trim(c, F.lit("\"'"))))


def main_index(user: Column) -> Column:
    """Name of a user's own index."""
    return F.concat(user, F.lit("_main"))
