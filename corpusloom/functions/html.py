"""HTML to Markdown-shaped text, by built-in expressions only.

A page is cut at its preformatted sections. Outside them runs of blanks become one, and
each tag is replaced by the Markdown it stands for; inside them only tags go. Elements
whose content is no text are removed first. Character references are resolved between
tags by the rules of HTML 5: all its names, the old ones also without a semicolon, and all
numbers. A reference to a blank counts as a blank.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html import unescape
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let

# Elements without readable content, and what a tag becomes.
UNREAD = r"(?is)<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>"
PREFORMATTED = r"(?is)</?pre\b[^>]*>"
FENCE = "````"
TAGS = (
    (r"(?is)<br\b[^>]*>", "\n"),
    (r"(?is)<li\b[^>]*>", "\n- "),
    (r"(?is)<t[dh]\b[^>]*>", " | "),
    (r"(?is)</?(?:p|div|section|article|tr)\b[^>]*>", "\n"),
    *((rf"(?is)<h{n}\b[^>]*>", "\n\n" + "#" * n + " ") for n in range(1, 7)),
    (r"(?is)</h[1-6]\s*>", "\n"),
    (r"(?s)</?[A-Za-z!?][^>]*>", ""),
)
ANY_TAG = TAGS[-1][0]

# The 2,231 names of HTML 5. Those that go without a semicolon end where the
# longest of them ends, so "&notit;" is "\u00acit;".
SHORT = r"^(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[^\t\n\f <&#;]{1,32};?)"

# Fixed values of HTML 5: numbers that stand for another character, and for none.
MOVED = {n: c for n in (0, *range(0x80, 0xA0)) if (c := unescape(f"&#{n};")) != chr(n)}
NONE = ((0x1, 0x8), (0xB, 0xB), (0xE, 0x1F), (0x7F, 0x7F), (0xFDD0, 0xFDEF))

# What counts as a blank, as a character or as a reference to one.
BLANK_NUMBERS = (*range(9, 11), 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
BLANK_NAMES = "|".join(sorted(n for n, c in html5.items() if n.endswith(";") and c.isspace()))
BLANK_REFERENCE = (
    rf"&(?:{BLANK_NAMES}|nbsp|#0*(?:{'|'.join(map(str, BLANK_NUMBERS))})(?:;|(?![0-9]))"
    rf"|#[xX]0*(?i:{'|'.join(f'{n:x}' for n in BLANK_NUMBERS)})(?:;|(?![0-9A-Fa-f])))"
)
BLANKS = r"(?:[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|" + BLANK_REFERENCE + ")+"


def _names() -> Column:
    """First letter -> name -> characters, so that a look-up passes over few names."""
    by: dict[str, dict[str, str]] = {}
    for name, chars in html5.items():
        by.setdefault(name[0], {})[name] = chars
    return F.from_json(F.lit(json.dumps(by)), "map<string, map<string, string>>")


def _woven(text: Column, pattern: str, turned: Callable[[Column], Column]) -> Column:
    """``text`` with everything that ``pattern`` finds turned into something else."""

    def weave(t: Column) -> Column:
        between = F.split(t, pattern, -1)
        found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), turned)
        return let(found, lambda f: F.array_join(F.flatten(F.transform(between, lambda part, i: F.array(part, F.coalesce(F.get(f, i), F.lit(""))))), ""))

    return let(text, weave)


def _numbered(ref: Column) -> Column:
    """The character of a reference by number, as HTML 5 reads it."""

    def character(number: Column) -> Column:
        # UTF-32 spells every code point as its number in eight digits.
        out = F.when(number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), "\ufffd")
        for n, c in MOVED.items():
            out = out.when(number == n, c)
        none = number.bitwiseAND(0xFFFE) == 0xFFFE
        for low, high in NONE:
            none = none | number.between(low, high)
        return out.when(none, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))

    # Nine digits and more are beyond every character.
    digits = F.concat(F.lit("0"), F.substr(F.regexp_extract(ref, "#[xX]?0*([0-9A-Fa-f]*)", 1), F.lit(1), F.lit(9)))
    hexadecimal = F.lower(F.substr(ref, F.lit(3), F.lit(1))) == "x"
    return let(F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long"), character)


def _named(ref: Column, names: Column) -> Column:
    """The characters of a reference by name; what is no name stays."""
    known = lambda name: names[F.substr(name, F.lit(1), F.lit(1))][name]
    short = lambda s, name: F.when(name != "", F.concat(known(name), F.substr(s, F.length(name) + 1)))
    whole = lambda s: F.coalesce(known(s), let(F.regexp_extract(s, SHORT, 0), lambda name: short(s, name)), ref)
    return let(F.substr(ref, F.lit(2)), whole)


def _resolved(text: Column, names: Column, tags=TAGS) -> Column:
    """Each tag of ``text`` becomes its mark and each reference its characters. Both are
    found in one pass, so that no reference reaches over a tag."""

    def turned(found: Column) -> Column:
        tag = found
        for pattern, mark in tags:
            tag = F.regexp_replace(tag, pattern, mark)
        return F.when(found.startswith("<"), tag).when(found.startswith("&#"), _numbered(found)).otherwise(_named(found, names))

    return _woven(text, f"{ANY_TAG}|{REFERENCE}", turned)


def html_to_text(budget: int | None = None) -> Callable[[Column], Column]:
    """Column function: html -> struct<text, partial>.

    With a ``budget`` of characters a longer text is left out and marked partial.
    """

    def convert(html: Column) -> Column:
        sections = F.split(F.regexp_replace(F.coalesce(html, F.lit("")), UNREAD, ""), PREFORMATTED, -1)
        fenced = lambda s, names: F.concat(F.lit(f"\n\n{FENCE}\n"), _resolved(s, names, TAGS[-1:]), F.lit(f"\n{FENCE}\n"))
        flowing = lambda s, names: _resolved(F.regexp_replace(s, BLANKS, " "), names)
        text = let(_names(), lambda names: F.array_join(F.transform(sections, lambda s, i: F.when(i % 2 == 1, fenced(s, names)).otherwise(flowing(s, names))), ""))
        over = (lambda t: F.lit(False)) if budget is None else (lambda t: F.length(t) > budget)
        return let(text, lambda t: F.struct(F.when(~over(t), t).alias("text"), over(t).alias("partial")))

    return convert
