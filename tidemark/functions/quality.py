"""Text quality gate columns (Q1-Q5)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions.text import matches, pattern, strip


def _any_match(text: Column, patterns: list[tuple[str, str]]) -> Column:
    found = F.lit(False)
    for regex, flags in patterns:
        found = found | matches(text, regex, flags)
    return found


def _all_hits(text: Column, patterns: list[tuple[str, str]]) -> list[Column]:
    """All hits of each pattern."""
    return [F.regexp_extract_all(text, F.lit(pattern(regex, flags)), F.lit(0)) for regex, flags in patterns]


def _hits(text: Column, patterns: list[tuple[str, str]], per_pattern: int, in_all: int) -> Column:
    """First hits of each pattern, in pattern order: what a sentence for readers names."""
    found = [F.slice(hits, 1, per_pattern) for hits in _all_hits(text, patterns)]
    return F.slice(F.flatten(F.array(*found)), 1, in_all)


def gate_findings(text: Column) -> Column:
    """All matches of Q1 and Q3 in pattern order; the sentences of gate_details name only the first ones."""
    return F.flatten(F.array(*_all_hits(text, rules.TAG_PATTERNS), *_all_hits(text, rules.INJECTION_PATTERNS)))


def has_tags(text: Column) -> Column:
    """Q1. Every pattern starts with '<', so texts without one skip the regexes."""
    return text.contains("<") & _any_match(text, rules.TAG_PATTERNS)


def has_injection(text: Column) -> Column:
    """Q3. Every pattern needs one of '[', '<' or ':'."""
    bracketed = [p for p in rules.INJECTION_PATTERNS if p[0][:2] == r"\["]
    angled = [p for p in rules.INJECTION_PATTERNS if p[0][0] == "<"]
    others = [p for p in rules.INJECTION_PATTERNS if p not in bracketed and p not in angled]
    return (
        (text.contains("[") & _any_match(text, bracketed))
        | (text.contains("<") & _any_match(text, angled))
        | (text.contains(":") & _any_match(text, others))
    )


def tag_penalty(text: Column) -> Column:
    return F.when(has_tags(text), rules.TAG_PENALTY).otherwise(F.lit(0.0))


def injection_penalty(text: Column) -> Column:
    return F.when(has_injection(text), rules.INJECTION_PENALTY).otherwise(F.lit(0.0))


def _unbalanced(stripped: Column) -> Column:
    def surplus(left: str, right: str) -> Column:
        def count(mark: str) -> Column:
            return F.length(stripped) - F.length(F.replace(stripped, F.lit(mark), F.lit("")))

        return F.abs(count(left) - count(right))

    starts = stripped.startswith("{") | stripped.startswith("[")
    return starts & ((surplus("{", "}") > 1) | (surplus("[", "]") > 1))


def format_penalty(stripped: Column) -> Column:
    """Q2 over stripped text."""
    return F.when((stripped == "") | _unbalanced(stripped), rules.FORMAT_PENALTY).otherwise(F.lit(0.0))


def _repeats(stripped: Column) -> Column:
    return matches(stripped, rules.REPEATED_CHAR_PATTERN)


def _non_ascii_run(stripped: Column) -> Column:
    return matches(stripped, rules.NON_ASCII_RUN_PATTERN)


def _cut_off(stripped: Column) -> Column:
    marks = list(rules.TERMINAL_MARKS)
    return (F.length(stripped) > 200) & ~F.right(stripped, F.lit(1)).isin(marks)


def coherence_penalty(stripped: Column) -> Column:
    """Q4 over stripped text: the worst finding, not the sum.

    The dots that excuse a cut-off end in a terminal mark themselves, so no rule is needed for
    them.
    """
    return (
        F.when(
            (F.length(stripped) < 10) | _repeats(stripped) | _non_ascii_run(stripped),
            rules.COHERENCE_PENALTY,
        )
        .when(_cut_off(stripped), rules.TRUNCATION_PENALTY)
        .otherwise(F.lit(0.0))
    )


@dataclass
class GateColumns:
    """The four penalties and what follows from them."""

    xml_hallucination: Column
    formatting_violation: Column
    prompt_injection: Column
    coherence: Column

    @property
    def raw_score(self) -> Column:
        # Left to right from 1.0 in doubles: the pass mark is tested before rounding.
        total = (
            F.lit(1.0)
            + self.xml_hallucination
            + self.formatting_violation
            + self.prompt_injection
            + self.coherence
        )
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))

    def checks(self) -> Column:
        return F.create_map(
            F.lit("xml_hallucination"), self.xml_hallucination,
            F.lit("formatting_violation"), self.formatting_violation,
            F.lit("prompt_injection"), self.prompt_injection,
            F.lit("coherence"), self.coherence,
        )


def gate_columns(text: Column) -> GateColumns:
    stripped = strip(text)
    return GateColumns(
        tag_penalty(text), format_penalty(stripped), injection_penalty(text), coherence_penalty(stripped)
    )


def gate_details(text: Column) -> Column:
    """Findings in words, as an array, in check order."""
    stripped = strip(text)
    empty = stripped == ""
    tag_hits = _hits(text, rules.TAG_PATTERNS, 3, 5)
    marker_hits = F.transform(_hits(text, rules.INJECTION_PATTERNS, 2, 5), strip)
    return F.array_compact(
        F.array(
            F.when(has_tags(text), F.concat(F.lit("XML hallucination detected: "), F.array_join(tag_hits, ", "))),
            F.when(empty, "Empty response").when(
                _unbalanced(stripped), "Unbalanced brackets in JSON-like response"
            ),
            F.when(
                has_injection(text),
                F.concat(F.lit("Prompt injection markers: "), F.array_join(marker_hits, ", ")),
            ),
            F.when(empty, "Empty response"),
            F.when(
                ~empty & (F.length(stripped) < 10),
                F.concat(F.lit("Suspiciously short response ("), F.length(stripped).cast("string"), F.lit(" chars)")),
            ),
            F.when(_repeats(stripped), "Repeated character pattern detected"),
            F.when(_non_ascii_run(stripped), "Excessive non-ASCII character sequence"),
            F.when(_cut_off(stripped), "Response may be truncated (no terminal punctuation)"),
        )
    )
