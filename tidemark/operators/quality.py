"""Quality gate over a table of texts (Q1-Q5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions.quality import GateColumns, coherence_penalty, format_penalty, gate_details, gate_findings
from tidemark.functions.quality import injection_penalty, tag_penalty
from tidemark.functions.text import strip

CHECKS = ["xml_hallucination", "formatting_violation", "prompt_injection", "coherence"]


def with_penalties(texts: DataFrame, text: str = "text") -> DataFrame:
    """Add the four penalties. A row-wise projection: no shuffle, any text length.

    The stripped text is a column of its own so that it is computed once per row. A NULL text is
    judged as an empty one.
    """
    held = F.coalesce(F.col(text), F.lit(""))
    return (
        texts.withColumn("_stripped", strip(held))
        .withColumns({
            "xml_hallucination": tag_penalty(held),
            "formatting_violation": format_penalty(F.col("_stripped")),
            "prompt_injection": injection_penalty(held),
            "coherence": coherence_penalty(F.col("_stripped")),
        })
        .drop("_stripped")
    )


def score_texts(
    texts: DataFrame, text: str = "text", threshold: float = rules.PASS_MARK, details: bool = False
) -> DataFrame:
    """Q5: add score, passed and the penalties; with details also checks (map), details and
    findings (all matches)."""
    scored = with_penalties(texts, text)
    held = F.coalesce(F.col(text), F.lit(""))
    gate = GateColumns(*[F.col(name) for name in CHECKS])
    if details:
        scored = scored.withColumns({"checks": gate.checks(), "details": gate_details(held), "findings": gate_findings(held)})
    return (
        scored.withColumn("_raw", gate.raw_score)
        .withColumns({"score": F.round("_raw", 3), "passed": F.col("_raw") >= threshold})
        .drop("_raw")
    )
