"""Ordered pattern cascades over text columns.

Patterns are Java regular expressions; ``d`` keeps the line feed as the only line end, ``U`` and ``i`` fold
accented letters. No pattern may repeat a group or reach over lines without bound: what lies between two anchors, however
long, is cut out by ``between``, in time linear in the text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?dUi)"


def rx(pattern: str, flags: str = FLAGS) -> str:
    return flags + pattern


def filled(text: Column) -> Column:
    """Null for an empty string. The text is written down once in the expression: ``nullif`` repeats it wherever it stands in a branch or a
    lambda, so that a nested search is worked out twice at each level."""
    return F.get(F.array_remove(F.array(text), F.lit("")), F.lit(0))


def find(text: Column, pattern: str, group: int = 1, flags: str = FLAGS) -> Column:
    """The trimmed group of the first match; null if there is none or it is empty."""
    return filled(F.trim(F.regexp_extract(text, rx(pattern, flags), group)))


def find_by(text: Column, pattern: Column, group: int = 1) -> Column:
    """As ``find``, with a pattern that is itself a column."""
    return filled(F.trim(F.call_function("regexp_extract", text, pattern, F.lit(group))))


def cascade(text: Column, *patterns: str, group: int = 1, flags: str = FLAGS) -> Column:
    """The first pattern that matches gives the value."""
    found = [find(text, p, group, flags) for p in patterns]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def which(text: Column, patterns: dict[str, str], flags: str = FLAGS) -> Column:
    """The name of the first pattern that matches, in order; null if none does."""
    out = None
    for name, p in patterns.items():
        hit = F.regexp_like(text, F.lit(rx(p, flags)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def find_all(text: Column, pattern: str, group: int = 1, flags: str = FLAGS) -> Column:
    """All matches, as an array in order."""
    return F.regexp_extract_all(text, F.lit(rx(pattern, flags)), F.lit(group))


def find_distinct(text: Column, pattern: str, group: int = 1, flags: str = FLAGS) -> Column:
    """Distinct matches in order of first occurrence."""
    return F.array_distinct(find_all(text, pattern, group, flags))


def matches(text: Column, pattern: str, flags: str = FLAGS) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(rx(pattern, flags))), F.lit(False))


def any_of(text: Column, patterns: Sequence[str], flags: str = FLAGS) -> Column:
    return reduce(lambda a, b: a | b, [matches(text, p, flags) for p in patterns])


def hits(text: Column, patterns: Sequence[str], flags: str = FLAGS) -> Column:
    """How many of the patterns match."""
    return reduce(lambda a, b: a + b, [matches(text, p, flags).cast("int") for p in patterns])


def contains_count(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur anywhere in the text (a plain substring test); the text is worked out once."""
    listed = F.array(*map(F.lit, words))
    return once(text, lambda t: F.size(F.filter(listed, lambda w: F.contains(t, w))))


def squeeze(text: Column) -> Column:
    """White space runs become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def replace_all(text: Column, pairs: Sequence[tuple[str, str]], flags: str = FLAGS) -> Column:
    """Replacements one after another."""
    return reduce(lambda t, p: F.regexp_replace(t, rx(p[0], flags), p[1]), pairs, text)


def first_rule(rules: Sequence[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first rule whose condition holds; one ``when`` chain."""
    out = F.when(*rules[0])
    for condition, value in rules[1:]:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def present(column: Column) -> Column:
    """Null for an empty or blank string."""
    return filled(F.trim(column))


def segments(text: Column, marker: str) -> Column:
    """The pieces of a text between marker positions, each piece beginning with its marker; text before the first is dropped."""
    return F.filter(F.split(text, f"(?={marker})"), lambda s: F.regexp_like(s, F.lit(rf"\A{marker}")))


def around(text: Column, key: Column, before: int, after: int) -> Column:
    """The text from ``before`` characters ahead of the key's first position to ``after`` behind it; null if the key is missing."""
    at = F.instr(text, key)
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + after))


def behind(text: Column, anchor: str, flags: str = FLAGS) -> Column:
    """The text behind the first match of an anchor; null if there is none."""
    return F.try_element_at(F.split(text, rx(anchor, flags), 2), F.lit(2))


def once(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def before(text: Column, anchor: str, flags: str = FLAGS, open_end: bool = True) -> Column:
    """The text ahead of the first match of an anchor; without one the whole text if ``open_end``, else null."""
    parts = F.split(text, rx(anchor, flags), 2)
    if open_end:
        return F.try_element_at(parts, F.lit(1))
    return once(parts, lambda p: F.when(F.size(p) == 2, F.try_element_at(p, F.lit(1))))


def between(text: Column, begins: str, ends: str, flags: str = FLAGS, open_end: bool = True) -> Column:
    """What lies between two anchors, trimmed; null if it is empty."""
    return present(before(behind(text, begins, flags), ends, flags, open_end))


def first_of(values: Column) -> Column:
    """The first value of an array that is not null."""
    return F.try_element_at(F.array_compact(values), F.lit(1))


def pieces_behind(text: Column, anchor: str, flags: str = FLAGS) -> Column:
    """For each match of an anchor the text from there to the next, as an array."""
    parts = F.split(text, rx(anchor, flags))
    return F.slice(parts, 2, F.size(parts))


def near(text: Column, anchor: str, pattern: str, reach: int, width: int, flags: str = FLAGS) -> Column:
    """The first match of a pattern of up to ``width`` characters that begins within ``reach`` characters behind an anchor."""
    return first_of(F.transform(pieces_behind(text, anchor, flags), lambda s: find(F.substring(s, 1, reach + width), pattern, 1, flags)))


#: What folds to one plain symbol, one for one, so that a text and its folded form have the same positions.
_FOLDS = {"a": "ÁÀÂÃÄÅáàâãäåª", "c": "Çç", "e": "ÉÈÊËéèêë", "i": "ÍÌÎÏíìîï", "n": "Ññ", "o": "ÓÒÔÕÖóòôõöº°", "u": "ÚÙÛÜúùûü", "-": "–—", " ": "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space as patterns have it.
BLANKS = " \t\n\v\f\r"


def folded(text: Column) -> Column:
    """The text without capitals, accents, long dashes and odd blanks; every symbol stays at its position."""
    return F.translate(text, _UPPER + "".join(_FOLDS.values()), _UPPER.lower() + "".join(k * len(v) for k, v in _FOLDS.items()))


@dataclass(frozen=True)
class Anchored:
    """A text beside its folded form, two columns of one row.

    Anchors are plain patterns over the folded text (no flags, no accents: a search for their first letters), and what follows
    one is cut out of the text itself by position. Every look-up is one search and one cut, linear in the text.
    """

    text: Column
    fold: Column

    @classmethod
    def of(cls, text: Column) -> Anchored:
        return cls(text, folded(text))

    def _rest(self, anchor: str) -> Column:
        return F.try_element_at(F.split(self.fold, anchor, 2), F.lit(2))

    def has(self, pattern: str) -> Column:
        return F.coalesce(F.regexp_like(self.fold, F.lit(pattern)), F.lit(False))

    def code(self, pattern: str, group: int = 1) -> Column:
        """The group of the first match in the folded text: for digits and fixed words."""
        return filled(F.regexp_extract(self.fold, pattern, group))

    def behind(self, anchor: str) -> Column:
        """The text behind the first match of an anchor; null if there is none."""
        return F.substring(self.text, F.char_length(self.text) - F.char_length(self._rest(anchor)) + 1, F.char_length(self.text))

    def line(self, anchor: str) -> Column:
        """What stands behind an anchor, from the first that is not blank to the end of its line."""
        return first_line(self.behind(anchor))

    def between(self, begins: str, ends: str) -> Column:
        """What lies between two anchors, trimmed; null if either is missing or nothing does."""
        # struct(rest: its length, parts: the rest ahead of the end and behind it)
        bounds = once(self._rest(begins), lambda r: F.struct(F.char_length(r).alias("rest"), F.split(r, ends, 2).alias("parts")))
        cut = once(bounds, lambda b: F.when(F.size(b["parts"]) == 2, F.substring(self.text, F.char_length(self.text) - b["rest"] + 1, F.char_length(F.try_element_at(b["parts"], F.lit(1))))))
        return filled(F.trim(cut, F.lit(BLANKS)))


def first_line(text: Column) -> Column:
    """The first line that is not blank, trimmed; null if there is none."""
    return present(F.substring_index(F.ltrim(text, F.lit(BLANKS)), "\n", 1))


def upto(text: Column, anchor: str) -> Column:
    """The text ahead of the first match of a plain pattern, whatever its case, or the whole text; trimmed, null if empty."""
    return present(F.try_element_at(F.split(text, f"(?i){anchor}", 2), F.lit(1)))


def lines_around(text: Column, key: Column, below: int) -> Column:
    """The line in which ``key`` first stands and up to ``below`` more, as far as an empty one; null if it stands nowhere.

    The key is found once and lines are cut off on both sides of it; no line is searched."""
    def cut(at: Column) -> Column:
        behind = F.slice(F.split(F.substring(text, at, F.length(text)), "\n", below + 2), 1, below + 1)
        near = once(behind, lambda b: F.slice(b, 1, F.when(F.array_position(b, "") > 1, F.array_position(b, "").cast("int") - 1).otherwise(F.size(b))))
        ahead = F.substring_index(F.substring(text, F.lit(1), F.greatest(at - 1, F.lit(0))), "\n", -1)
        return F.when(at > 0, F.concat(ahead, F.array_join(near, "\n")))

    return once(F.instr(text, key), cut)


def behind_each(text: Column, key: Column) -> Column:
    """For each place of a key without special characters what follows it, as an array."""
    parts = F.split(text, key)
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
