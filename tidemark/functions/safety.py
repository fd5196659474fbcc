"""Safety columns: commands, credentials, placeholder keys."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions.text import ascii_lower, matches, pattern


#: Signs without case that every match of a pattern holds: what its regex starts or ends with -> sign.
_NEEDED_SIGNS = [
    (r"+/", "/"), (r"+~", "~"), (r"\$HOME", "$"), ("if=", "="), (r":\(\)", ":()"), (r"[^|]*\|", "|"),
    ("/dev/", ">"), ("777", "777"), (r"\s+-R", "-"),
]


def is_dangerous(text: Column, regex: str) -> Column:
    """One pattern over a text; the regex runs only where the sign it needs occurs."""
    found = matches(text, regex, "i")
    sign = next((sign for part, sign in _NEEDED_SIGNS if part in regex), None)
    return found if sign is None else text.contains(sign) & found


def dangerous_hits(text: Column) -> Column:
    """X1 for one text: array of the matching patterns, in list order."""
    return F.array_compact(
        F.array(*[F.when(is_dangerous(text, regex), F.lit(regex)) for regex in rules.DANGEROUS_PATTERNS])
    )


def may_match(text: Column, rule: tuple) -> Column:
    """A cheap test that is true for every text the rule matches: the plain beginning of its
    pattern, or for the rule in any case the end of it, which starts with a rare character."""
    if "i" in rule[2]:
        return matches(text, rules.ASSIGNMENT_END)
    return text.contains(re.match(r"(?:\\b)?([A-Za-z_-]+)", rule[1])[1])


def scrub(text: Column) -> Column:
    """All replacements in order, each on the result of the one before."""
    return reduce(
        lambda out, rule: F.regexp_replace(out, pattern(rule[1], rule[2]), rule[3]),
        rules.CREDENTIAL_RULES,
        text,
    )


def may_hold_credentials(text: Column) -> Column:
    """False only when no credential rule can match; far cheaper than fourteen regex passes."""
    return reduce(lambda found, rule: found | may_match(text, rule), rules.CREDENTIAL_RULES, F.lit(False))


def shell_match(command: Column) -> Column:
    """The last matching rule of the shell gate, NULL when none matches."""
    lowered = ascii_lower(command)
    rules_in_order = [(name, lowered.contains(name.lower())) for name in rules.SHELL_STRINGS]
    # grep tests line by line, so neither \s nor . may cross a newline.
    rules_in_order += [
        (name, command.rlike("(?di)" + regex.replace(r"\s", r"[^\S\n]")))
        for name, regex in rules.SHELL_LINE_PATTERNS
    ]
    return F.coalesce(*[F.when(hit, F.lit(name)) for name, hit in reversed(rules_in_order)])


def is_placeholder(value: Column) -> Column:
    """X4."""
    plain = F.translate(F.lower(value), "-_", "  ")
    words = F.array_distinct(F.regexp_extract_all(plain, F.lit(r"(?U)[^\s]+"), F.lit(0)))
    markers = F.array(*[F.lit(word) for word in rules.PLACEHOLDER_WORDS])
    return (
        (F.size(F.array_intersect(words, markers)) >= 2)
        | plain.isin(rules.PLACEHOLDER_STRINGS)
        | (F.length(value) < rules.SHORTEST_KEY)
    )


def masked(value: Column) -> Column:
    """X6."""
    return F.when(
        F.length(value) > 12, F.concat(F.left(value, F.lit(4)), F.lit("..."), F.right(value, F.lit(4)))
    ).otherwise("****")
