"""Text analysis for search (R1): tokens and stems, all in built-in functions.

Tokens are runs of letters, digits and private-use characters, lower case, without diacritics.
Stems follow Porter (1980) in its revised form, as SQLite's full-text index applies it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import rules


@cache
def _foldings() -> tuple[str, str]:
    """Characters for translate: a letter with one mark counts as its base letter, a variant form
    as the letter it case-folds to; loose marks come last, without counterpart, and fall away."""
    marked, plain = [], []
    for char in map(chr, range(0x80, 0x2000)):
        parts = unicodedata.normalize("NFD", char.casefold())
        if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha() and parts[1] in rules.DROPPED_MARKS:
            marked.append(char)
            plain.append(parts[0])
        elif len(char.casefold()) == 1 and char.casefold() != char.lower():
            marked.append(char)
            plain.append(char.casefold())
    return "".join(marked) + rules.DROPPED_MARKS, "".join(plain)


def tokens(text: Column) -> Column:
    """R1 without stems: array of tokens in text order; a NULL text has none."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), *_foldings())
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


# Porter's measure over words in which a consonant y is written Y: lower-case y is a vowel.
_VOWEL, _CONSONANT = "[aeiouy]", "[^aeiouy]"
HAS_VOWEL = _VOWEL
MEASURE_1_UP = _VOWEL + _CONSONANT
MEASURE_2_UP = f"{_VOWEL}{_CONSONANT}+{_VOWEL}+{_CONSONANT}"
# The index looks at bytes: letters beyond ASCII are several and end neither of these.
SHORT_END = f"{_CONSONANT}{_VOWEL}[b-df-hj-np-tvz0-9]$"
DOUBLE_END = "[b-df-hjkmnp-rtv-x0-9]$"


def suffix_pattern(suffixes) -> str:
    """The leftmost match is the longest suffix that leaves at least one letter."""
    return ".(" + "|".join(sorted(suffixes, key=len, reverse=True)) + ")$"


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once.

    A lambda variable keeps the whole expression linear in the number of steps: plain columns
    would be copied at each use, and copies of copies grow without bound.
    """
    return F.transform(F.array(value), use)[0]


def _suffix(word: Column, suffixes) -> Column:
    """The suffix found, '' for none. Only the end of the word is searched."""
    longest = max(map(len, suffixes))
    return F.regexp_extract(F.right(word, F.lit(longest + 1)), suffix_pattern(suffixes), 1)


def _rest(word: Column, suffix: Column) -> Column:
    return F.substr(word, F.lit(1), F.length(word) - F.length(suffix))


def _drop_last(word: Column) -> Column:
    return F.substr(word, F.lit(1), F.length(word) - 1)


def _swap(mapping: dict[str, str], condition: str | None) -> Callable[[Column], Column]:
    """The step that exchanges a suffix when the rest of the word meets the condition."""
    new_ends = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])

    def step(word: Column) -> Column:
        def exchanged(suffix: Column) -> Column:
            found = suffix != ""
            if condition:
                found = found & _rest(word, suffix).rlike(condition)
            return F.when(found, F.concat(_rest(word, suffix), F.element_at(new_ends, suffix))).otherwise(word)

        return _bind(_suffix(word, mapping), exchanged)

    return step


def _past_forms(word: Column) -> Column:
    """1b: -eed, -ed and -ing; what remains of a shortened word is mended."""

    def mended(rest: Column) -> Column:
        doubled = rest.rlike(DOUBLE_END) & (F.length(rest) > 1) & (
            F.substring(rest, -2, 1) == F.right(rest, F.lit(1))
        )
        short = rest.rlike(MEASURE_1_UP) & ~rest.rlike(MEASURE_2_UP) & rest.rlike(SHORT_END)
        return (
            F.when(rest.rlike("(at|bl|iz)$"), F.concat(rest, F.lit("e")))
            .when(doubled, _drop_last(rest))
            .when(short, F.concat(rest, F.lit("e")))
            .otherwise(rest)
        )

    def changed(suffix: Column) -> Column:
        rest = _rest(word, suffix)
        return (
            F.when((suffix == "eed") & rest.rlike(MEASURE_1_UP), F.concat(rest, F.lit("ee")))
            .when(suffix.isin("ed", "ing") & rest.rlike(HAS_VOWEL), _bind(rest, mended))
            .otherwise(word)
        )

    return _bind(_suffix(word, ["eed", "ed", "ing"]), changed)


def _final_y(word: Column) -> Column:
    """1c: y after a vowel."""
    turned = word.rlike("[yY]$") & _drop_last(word).rlike(HAS_VOWEL)
    return F.when(turned, F.concat(_drop_last(word), F.lit("i"))).otherwise(word)


def _fallen_ends(word: Column) -> Column:
    """4: endings that fall away; -ion only after s or t."""

    def changed(suffix: Column) -> Column:
        rest = _rest(word, suffix)
        falls = (suffix != "") & rest.rlike(MEASURE_2_UP) & ((suffix != "ion") | rest.rlike("[st]$"))
        return F.when(falls, rest).otherwise(word)

    return _bind(_suffix(word, rules.STEM_STEP_4), changed)


def _final_e(word: Column) -> Column:
    """5a."""
    rest = _drop_last(word)
    falls = rest.rlike(MEASURE_2_UP) | (rest.rlike(MEASURE_1_UP) & ~rest.rlike(SHORT_END))
    return F.when(word.endswith("e") & falls, rest).otherwise(word)


def _final_ll(word: Column) -> Column:
    """5b."""
    return F.when(
        word.endswith("ll") & _drop_last(word).rlike(MEASURE_2_UP), _drop_last(word)
    ).otherwise(word)


def stem(word: Column) -> Column:
    """The stem of a token. Meant for a vocabulary, where every token occurs once."""
    steps = [
        _swap({"sses": "ss", "ies": "i", "ss": "ss", "s": ""}, None),
        _past_forms,
        _final_y,
        _swap(rules.STEM_STEP_2, MEASURE_1_UP),
        _swap(rules.STEM_STEP_3, MEASURE_1_UP),
        _fallen_ends,
        _final_e,
        _final_ll,
    ]
    out = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiouy])y", "$1Y")
    for step in steps:
        out = _bind(out, step)
    long_enough = F.octet_length(word).between(rules.STEM_MIN_BYTES, rules.STEM_MAX_BYTES)
    return F.when(long_enough, F.lower(out)).otherwise(word)
