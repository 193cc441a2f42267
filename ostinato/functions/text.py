"""Text, path and code functions of columns."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Codes that label no style and are left out when labels are learnt. Fixed values.
NOT_LABELS = ("A", "C", "F", "L", "R", "U")
#: Codes in capital letters, then stars. Fixed value.
CODED = r"^([A-Z]+)(-[A-Z]+)*(-\*[1-5])?$"


def normalize(c: Column) -> Column:
    """Lower case without punctuation, single spaces; null as empty."""
    bare = F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def stem(c: Column) -> Column:
    """File name without its last extension; a name that begins with the only dot keeps it."""
    base = F.regexp_extract(c, r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=[^/])\.[^./]*$", "")


def normalize_filename(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(stem(c)), "[^a-z0-9]", " "))


def parse_filename(c: Column) -> Column:
    """struct(artist, title) of "Artist - Title.ext", cut at the first " - "; without one, artist is empty."""
    s = stem(c)
    parts = F.split(s, " - ", 2)
    cut = F.size(parts) == 2
    return F.struct(F.when(cut, F.trim(F.element_at(parts, 1))).otherwise("").alias("artist"), F.trim(F.when(cut, F.try_element_at(parts, F.lit(2))).otherwise(s)).alias("title"))


def tokens(c: Column, least: int = 3) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: F.length(w) >= least))


def display_label(artist: Column, title: Column, filename: Column, filepath: Column) -> Column:
    filled = lambda x: F.coalesce(x, F.lit("")) != ""
    head = F.when(filled(artist) & filled(title), F.concat(artist, F.lit(" - "), title)).when(filled(title), title).otherwise(filename)
    return F.when(filled(filepath), F.concat(head, F.lit("\n"), filepath)).otherwise(head)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, which isn't symmetric: a is what is asked for, b what is known."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letter_masks(c: Column, each: int = 4) -> Column:
    """How often each letter, digit and space stands in a lower-cased text, up to `each` times: one bit a time, in longs; last, how many characters that leaves out."""
    count_of = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    per = 63 // each
    bits = lambda x, i: F.shiftleft(F.element_at(F.array(*[F.lit(2**n - 1).cast("long") for n in range(each + 1)]), F.least(count_of(x), F.lit(each)) + 1), each * i)
    masks = []
    for at in range(0, len(LETTERS), per):
        mask = F.lit(0).cast("long")
        for i, x in enumerate(LETTERS[at : at + per]):
            mask = mask.bitwiseOR(bits(x, i))
        masks.append(mask)
    told = sum((F.bit_count(m) for m in masks), F.lit(0))
    return F.array(*masks, (F.length(c) - told).cast("long"))


def letters_in_common(a: str, b: str, each: int = 4) -> Column:
    """At least as many characters as two texts of these masks have in common, places aside."""
    longs = -(-len(LETTERS) // (63 // each))
    both = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseAND(F.get(b, F.lit(i)))) for i in range(longs)), F.lit(0))
    return both + F.least(F.get(a, F.lit(longs)), F.get(b, F.lit(longs)))


@F.pandas_udf(StringType())
def nfc(a: pd.Series) -> pd.Series:
    """Canonical composition."""
    return a.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def label_codes(genre: Column) -> Column:
    """Single capital letters of a coded genre, less those that are no labels; empty for other strings."""
    codes = F.filter(F.split(F.coalesce(genre, F.lit("")), "-"), lambda x: F.trim(x).rlike("^[A-Z]$"))
    return F.array_distinct(F.filter(F.transform(codes, F.trim), lambda x: ~x.isin(*NOT_LABELS)))


def filter_codes(genre: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(genre, F.lit("")), "-"), F.trim)
    return F.filter(parts, lambda x: (x != "") & ~x.startswith("*"))


def rating(genre: Column) -> Column:
    found = F.regexp_extract(F.coalesce(genre, F.lit("")), r"(?:^|-)\*(\d+)", 1)
    return F.when(found == "", 0).otherwise(found.cast("int"))


def is_coded(genre: Column) -> Column:
    return F.coalesce(genre.rlike(CODED), F.lit(False))


def toggle_code(genre: Column, code: str) -> Column:
    """Without the code if it was there; else with it, all codes sorted. The rating stays last."""
    codes, stars = filter_codes(genre), rating(genre)
    new = F.when(F.array_contains(codes, code), F.array_remove(codes, code)).otherwise(F.array_sort(F.array_append(codes, F.lit(code))))
    return F.array_join(F.concat(new, F.when(stars > 0, F.array(F.concat(F.lit("*"), stars.cast("string")))).otherwise(F.array().cast("array<string>"))), "-")


def cycle_rating(genre: Column) -> Column:
    """One star more; after five none."""
    codes, stars = filter_codes(genre), (rating(genre) + 1) % 6
    return F.array_join(F.concat(codes, F.when(stars > 0, F.array(F.concat(F.lit("*"), stars.cast("string")))).otherwise(F.array().cast("array<string>"))), "-")


def search_words(haystack: Column, query: str) -> Column:
    """Every word of the query stands somewhere in the text."""
    lower = F.lower(haystack)
    found = F.lit(True)
    for w in query.lower().split():
        found = found & lower.contains(w)
    return found


def code_switches(codes: Column, on: list[str], off: list[str]) -> Column:
    """All codes switched on, none switched off."""
    wanted, barred = F.array(*map(F.lit, on)).cast("array<string>"), F.array(*map(F.lit, off)).cast("array<string>")
    return (F.size(F.array_except(wanted, codes)) == 0) & ~F.arrays_overlap(barred, codes)


class ExpressionError(ValueError):
    """A filter expression that is none: empty, an unknown code, a bad character, a bracket left open, or something left over."""


def code_expression(text: str, known: set[str], codes: Column) -> Column:
    """A filter of codes with not, and, or and brackets as one column; not binds closest, or loosest. Case doesn't count."""
    words = re.findall(r"\s*(?:([A-Za-z0-9_]+)|(\S))", text)
    for _, other in words:
        if other and other not in "()":
            raise ExpressionError(f"unexpected character {other!r}")
    items = [(w or o).upper() for w, o in words]
    if not items:
        raise ExpressionError("empty expression")
    at = 0

    def peek() -> str | None:
        return items[at] if at < len(items) else None

    def take() -> str:
        nonlocal at
        at += 1
        return items[at - 1]

    def chain(joint: str, part, join) -> Column:
        left = part()
        while peek() == joint:
            take()
            left = join(left, part())
        return left

    def either() -> Column:
        return chain("OR", both, lambda a, b: a | b)

    def both() -> Column:
        return chain("AND", one, lambda a, b: a & b)

    def one() -> Column:
        if peek() == "NOT":
            take()
            return ~one()
        if peek() == "(":
            take()
            inner = either()
            if peek() != ")":
                raise ExpressionError("missing )")
            take()
            return inner
        if peek() is None or peek() not in known:
            raise ExpressionError(f"unknown code {peek()!r}")
        return F.array_contains(codes, take())

    found = either()
    if peek() is not None:
        raise ExpressionError(f"left over: {peek()!r}")
    return found


def safe_filename(c: Column) -> Column:
    """Characters that file systems refuse, replaced; outer blanks and dots gone."""
    return F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*]', "_"), r"^[ .]+|[ .]+$", "")


def clean_tag(c: Column, most: int = 500) -> Column:
    """Without control characters, at most so many long."""
    return F.left(F.regexp_replace(c, r"[\x00-\x1F\x7F]", ""), F.lit(most))


def organized_path(artist: Column, album: Column, track: Column, title: Column) -> Column:
    unknown = lambda c, what: F.when(F.coalesce(c, F.lit("")) == "", F.lit(what)).otherwise(c)
    return F.concat_ws("/", unknown(artist, "Unknown Artist"), unknown(album, "Unknown Album"), F.concat(F.lpad(F.coalesce(track, F.lit(0)).cast("string"), 2, "0"), F.lit(" - "), unknown(title, "Unknown Title")))


def month_folder(path: Column) -> Column:
    """The last part of a path that looks like 2024-07."""
    return F.try_element_at(F.filter(F.split(path, "/"), lambda p: p.rlike(r"^\d{4}-..$")), F.lit(-1))


def size_display(n: Column) -> Column:
    return F.when(n >= 1024 * 1024, F.concat(F.round(n / (1024 * 1024), 1).cast("string"), F.lit(" MB"))).when(n >= 1024, F.concat(F.round(n / 1024, 1).cast("string"), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))
