"""Text rules as column expressions. All patterns live here, with the flags that give them their Unicode meaning."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, separators of information included.
SPACE = r"[\s\x1c-\x1f]"
#: The same characters, one by one.
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS_PER_MINUTE = 200
#: Endings that a flexible keyword may take.
SUFFIXES = "(?:s|es|is|ns|ais|eis|ais|ies|ed|ing)?"


def named(name: str) -> Column:
    """The column of a name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(c, f"(?U){SPACE}+", " "))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, f"(?U){SPACE}+", -1), lambda w: w != "")).cast("int")


def reading_minutes(words: Column) -> Column:
    """At least 1; halves go to the even minute."""
    return F.greatest(F.lit(1), F.bround(words / float(WORDS_PER_MINUTE)).cast("int"))


def density(total: Column, words: Column) -> Column:
    """Occurrences per thousand words."""
    return F.bround(total * 1000 / F.greatest(F.lit(1), words), 2)


def dehyphenate(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")


def clean_space(c: Column) -> Column:
    """Line ends, soft hyphens, blanks and blank lines brought to one form."""
    c = F.replace(F.regexp_replace(c, r"\r\n?", "\n"), F.lit("\u00ad"), F.lit(""))
    c = F.regexp_replace(c, "[ \t\u00a0]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(c, " ?\n ?", "\n"), "\n{3,}", "\n\n"))


# --- folding: lower case without accents ---------------------------------------------------------------------

#: Code points whose folds are worked out ahead: Latin, Greek, Cyrillic, punctuation, currency, arrows, operators, shapes.
_RANGES = ((0x80, 0x24F), (0x370, 0x52F), (0x1E00, 0x1EFF), (0x2010, 0x2060), (0x20A0, 0x20C0), (0x2190, 0x22FF), (0x25A0, 0x27BF))


class _Folds(dict):
    """What each character becomes, worked out when first met: none, one or several characters."""

    def __missing__(self, c: str) -> str:
        self[c] = out = "".join(filter(_is_base, unicodedata.normalize("NFKD", c.lower())))
        return out


def _is_base(c: str) -> bool:
    return not unicodedata.combining(c)


_FOLDS = _Folds()


def fold_text(text: str) -> str:
    return "".join(map(_FOLDS.__getitem__, text))


def fold_with_map(text: str) -> tuple[str, np.ndarray]:
    """Folded text and, for each of its characters, the place of the character that it comes from."""
    sizes = np.fromiter((len(_FOLDS[c]) for c in text), np.int32, len(text))
    return fold_text(text), np.repeat(np.arange(len(text), dtype=np.int32), sizes)


@cache
def _tables() -> tuple[str, str, str, str]:
    """Characters that change, what they become, and patterns: characters that don't fold one to one, runs of common ones that do."""
    source, target, simple = [], [], []
    for low, high in _RANGES:
        for code in range(low, high + 1):
            c = chr(code)
            folded = fold_text(c)
            if len(folded) == 1 and not unicodedata.combining(c):
                simple.append(code)
                if folded != c:
                    source.append(c)
                    target.append(folded)
    spans: list[list[int]] = [[0, 0x7F]]
    for code in simple:
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    listed = lambda most: "".join(f"\\x{{{a:x}}}-\\x{{{min(b, most):x}}}" for a, b in spans if a <= most)
    return "".join(source), "".join(target), f"[^{listed(0xFFFF)}]", f"[{listed(0xFF)}]+"


def folds_simply(c: Column) -> Column:
    """Whether folding leaves every character at its place.

    Java tries the many ranges of the class one after the other for each character, so Latin letters are taken out first.
    """
    _, _, other, common = _tables()
    return ~F.regexp_replace(c, common, "").rlike(other)


def _slow_fold(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in texts:
        yield pd.DataFrame([(None, None) if t is None else fold_with_map(t) for t in part], columns=["norm", "places"])


def _slow_fold_only(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(lambda t: None if t is None else fold_text(t))


def _not_simple(c: Column) -> Column:
    """The text if its characters don't fold one to one, else null: then the Arrow function gets nothing to read."""
    return F.when(~folds_simply(c), c)


def slow_fold(c: Column) -> Column:
    """struct<norm,places> of texts that need it, in an Arrow function; null for all others."""
    return F.pandas_udf("norm string, places array<int>")(_slow_fold)(_not_simple(c))


def fold(c: Column | str) -> Column:
    """Folded text, whatever its characters."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.pandas_udf("string")(_slow_fold_only)(_not_simple(c)), fold_simple(c))


def fold_simple(c: Column) -> Column:
    """Fold of text whose characters fold one to one."""
    source, target, *_ = _tables()
    # ASCII first: translate alone sees all other letters, whatever the session's rules for lower case are.
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, capitals + source, capitals.lower() + target)


def keyword_pattern(keyword: str, flexible: bool = True) -> str | None:
    """Java pattern over folded text for a keyword; None for one without parts (blank, or hyphens only)."""
    parts = [p for p in re.split(r"[\s\-]+", fold_text(keyword).strip()) if p]
    if not parts:
        return None
    suffix = SUFFIXES if flexible else ""
    body = r"[\s\-]+".join("".join("\\" + c if not (c.isalnum() or c == "_") and c.isascii() else c for c in p) + suffix for p in parts)
    return rf"(?U)(?<!\w){body}(?!\w)"


def keyword_chips(c: Column) -> Column:
    """Keywords of a list as they are shown: parted like parsed ones, but with quotes and repeats; none of a null."""
    parts = F.filter(F.transform(F.split(c, "[,;\n]+", -1), strip), lambda t: t != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def without_chip(c: Column, term: Column) -> Column:
    """The list without a keyword, parted by commas."""
    return F.array_join(F.filter(keyword_chips(c), lambda t: t != term), ", ")


# --- places --------------------------------------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """The body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column) -> Column:
    """Sums of an array up to each place, by doubling: each round adds what lies a power of two before."""

    def summed(given: Column) -> Column:
        # As many rounds as the size has binary digits.
        rounds = F.when(F.size(given) > 1, F.sequence(F.lit(0), F.length(F.bin(F.size(given) - 1)) - 1)).otherwise(F.array().cast("array<int>"))
        add = lambda sums, k: let(F.pow(F.lit(2), k).cast("int"), lambda step: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - step), F.lit(0))))
        return F.aggregate(rounds, given, add)

    return let(values, summed)


def match_spans(text: Column, pattern: str) -> Column:
    """Half-open places of all matches: array<struct<start:int,end:int>>."""

    def placed(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        ends = running_sums(F.zip_with(matches, gaps, lambda m, g: F.length(m) + F.length(g)))
        spans = F.zip_with(matches, ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end")))
        # Most texts have no match; they are not split.
        return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def page_at(pages: Column, offset: Column) -> Column:
    """Number of the page with the offset; else of the last page; 0 without pages."""
    hit = F.filter(pages, lambda p: (p["start"] <= offset) & (offset < p["end"]))
    return F.coalesce(F.get(hit, F.lit(0))["number"], F.try_element_at(pages, F.lit(-1))["number"], F.lit(0))


def section_at(sections: Column, offset: Column) -> Column:
    """Title of the first section with the offset, else null."""
    return F.get(F.filter(sections, lambda s: (s["start"] <= offset) & (offset < s["end"])), F.lit(0))["title"]


def section_text(text: Column, sections: Column, name: str, limit: int = 4000) -> Column:
    """The beginning of a section's text, else an empty text."""
    s = F.get(F.filter(sections, lambda x: x["name"] == name), F.lit(0))
    return F.coalesce(F.left(F.substr(text, s["start"] + 1, s["end"] - s["start"]), F.lit(limit)), F.lit(""))


def snippet(text: Column, start: Column, end: Column, window: int = 220) -> Column:
    """The match between asterisks with what stands around it, on one line."""
    left, right = F.greatest(F.lit(0), start - window), F.least(F.length(text), end + window)
    one_line = lambda a, b: F.replace(F.substr(text, a + 1, b - a), F.lit("\n"), F.lit(" "))
    whole = F.concat(F.when(left > 0, "...").otherwise(""), one_line(left, start), F.lit("**"), one_line(start, end), F.lit("**"), one_line(end, right), F.when(right < F.length(text), "...").otherwise(""))
    return strip(F.regexp_replace(whole, f"(?U){SPACE}{{2,}}", " "))


def mark(c: Column) -> Column:
    """Snippets as HTML: escaped, with the match marked."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, r"(?s)\*\*(.+?)\*\*", "<mark>$1</mark>")


def page_label(c: Column) -> Column:
    """"2" or "1-3" from what a model calls a page; else an empty text."""
    pattern = r"(\d{1,4})(?:\s*[-–]\s*(\d{1,4}))?"
    first, last = F.regexp_extract(c, f"(?U){pattern}", 1), F.regexp_extract(c, f"(?U){pattern}", 2)
    return F.coalesce(F.when((last != "") & (last != first), F.concat(first, F.lit("-"), last)).otherwise(first), F.lit(""))


def label_pages(label: Column) -> Column:
    """Pages of a label; null (any page) if it names none."""
    clean = page_label(label)
    first, last = F.substring_index(clean, "-", 1).try_cast("int"), F.substring_index(clean, "-", -1).try_cast("int")
    return F.when(clean != "", F.sequence(F.least(first, last), F.greatest(first, last)))
