"""Operator 7: personal data by weak supervision.

One pass over the whole texts finds spans. Base spans follow fixed patterns and always count. Looser
patterns propose more spans of the same kinds (spelt-out e-mail addresses, IPv6, card numbers with
other separators, phone numbers without a plus sign).

Labelers vote yes, no or nothing on every span, base ones included: shape, check digit or value
range, gazetteers (top-level domains, issuer prefixes, country codes), context words before, signs of
other uses, and what touches the span. Votes are counted by pattern over all documents. Expectation
maximisation per kind estimates how reliable each labeler is and how likely each pattern is to be
personal data; a logistic span classifier is trained on these probabilities, with the votes and the
span's length class as features. Proposed spans that it finds likelier than ACCEPT are added.

Only counts per pattern reach the driver: their number is bounded by the votes' combinations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit
from tidemark.session import stage

KINDS = ["email", "ip", "card", "phone"]
ACCEPT = 0.9
CONTEXT_CHARS = 48
ROUNDS = 60

# Gazetteers of the labelers.
TOP_DOMAINS = frozenset(
    "com org net edu gov mil int info biz name io co me tv us uk de fr es it nl be ch at se no dk fi pl pt ie ru ua cz gr tr "
    "in cn jp kr au nz br mx ar cl za ca eu app dev ai".split())
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 94".split())
CONTEXT = [
    re.compile(r"e-?mail|mailto|contact|correo|courriel|write to|schreib", re.I),
    re.compile(r"\bip\b|address|host|server|addr|adresse|direcci", re.I),
    re.compile(r"card|visa|mastercard|amex|credit|karte|carte|tarjeta", re.I),
    re.compile(r"\btel\b|phone|call|mobile|cell|fax|t[ée]l[ée]|telefon|m[óo]vil|handy", re.I),
]
OTHER_USE = re.compile(r"version|\bv\.?\s*$|order|invoice|token|password|passwd|secret|\bid\b|isbn|serial|build|hash|key|=\s*[\"']?[0-9a-f]*$", re.I)

# The base patterns.
_BASE_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOOSE = [
    re.compile(r"\b[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\sat\s)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\sdot\s|\.)\s?[A-Za-z0-9-]{2,63}){1,4}\b", re.I),
    re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[./_ ]|\x20{2})[0-9]{4}(?:[./_ ]|\x20{2})[0-9]{4}(?:[./_ ]|\x20{2})[0-9]{1,7}(?![0-9A-Za-z])"),
    re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\)|00[0-9]{1,3}|0[0-9]{1,4}|[0-9]{3})[\x20./-][0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,3}(?![0-9A-Za-z])"),
]
_NUMERIC = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns by kind, then start; positions in code points."""
    found = []
    at = text.find("@")
    last = 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        match = _BASE_DOMAIN.match(text, at + 1) if start < at else None
        if match:
            last = match.end()
            found.append((0, start, last))
        at = text.find("@", max(at + 1, last))
    if _NUMERIC.search(text):
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def proposed_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the looser patterns that overlap no base span."""
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    found = []
    lower = text.lower()
    numeric = _NUMERIC.search(text) is not None
    for kind, pattern in enumerate(_LOOSE):
        if kind == 0 and not ("(at)" in lower or "[at]" in lower or " dot " in lower or "(dot)" in lower) or kind > 0 and not numeric or kind == 1 and ":" not in text:
            continue
        for m in pattern.finditer(text):
            i = np.searchsorted(starts, m.end()) - 1
            if i < 0 or all(e <= m.start() for _, e in taken[max(0, i - 3) : i + 1]):
                found.append((kind, m.start(), m.end()))
    return found


def votes(text: str, kind: int, start: int, end: int, base: bool) -> int:
    """The labelers' votes (0 none, 1 yes, 2 no) and the length class of a span, as one number.

    Base 3, lowest first: form, value, gazetteer, context, other use, surroundings; then the length
    class (0 to 3) and the kind.
    """
    span = text[start:end]
    digits = "".join(c for c in span if c.isdigit() and c.isascii())
    before = text[max(0, start - CONTEXT_CHARS) : start]
    touched = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    form = 1 if base else 0
    if kind == 0:
        value = 1 if 5 <= len(span) <= 254 and ".." not in span else 2
        gazetteer = 1 if re.split(r"[.\s()\[\]]+", span.rstrip(")]"))[-1].lower() in TOP_DOMAINS else 2
    elif kind == 1:
        value = 1 if ":" in span or not any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else 2
        gazetteer = 2 if span.split(".")[0] in ("0", "00") or span in ("127.0.0.1",) or len(digits) == 4 else 0
    elif kind == 2:
        value = 1 if luhn(digits) else 2
        gazetteer = 1 if digits[:1] in ("3", "4", "5", "6") else 2
    else:
        value = 1 if 9 <= len(digits) <= 15 else 2
        code = digits[2:] if digits.startswith("00") else digits
        gazetteer = 1 if (span[0] == "+" or digits.startswith("00")) and any(code[:n] in COUNTRY_CODES for n in (1, 2)) else (0 if span[0] in "(0" else 2)
    context = 1 if CONTEXT[kind].search(before) else 0
    other = 2 if OTHER_USE.search(before[-24:]) else 0
    around = 2 if touched else 1
    code = 0
    for vote in (around, other, context, gazetteer, value, form):
        code = 3 * code + vote
    size = min(3, len(span) // 8)
    return (kind * 4 + size) * 729 + code


def _unpack(code: int) -> tuple[int, int, list[int]]:
    rest, own = divmod(code, 729)
    return rest // 4, rest % 4, [own // 3**k % 3 for k in range(6)]


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: key, base and more (arrays of kind, start, end, code)."""
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in textkit.blocks(batches, "text"):
            texts = pc.fill_null(block.column("text"), "")
            some = pc.match_substring_regex(texts, r"[0-9@]|(?i:[(\[](?:at|dot)[)\]]| dot )").to_pylist()
            base, more = [[] for _ in some], [[] for _ in some]
            for i in np.flatnonzero(some):
                own = texts[int(i)].as_py()
                found = base_spans(own)
                base[i] = [(k, s, e, votes(own, k, s, e, True)) for k, s, e in found]
                more[i] = [(k, s, e, votes(own, k, s, e, False)) for k, s, e in proposed_spans(own, found)]
            as_rows = lambda lists: pa.array([[dict(zip(("kind", "start", "end", "code"), x, strict=True)) for x in row] for row in lists], pa.list_(span))
            yield pa.RecordBatch.from_arrays([block.column("key"), as_rows(base), as_rows(more)], ["key", "base", "more"])

    kind = docs.schema[key].dataType.simpleString()
    spans = "array<struct<kind: int, start: int, end: int, code: int>>"
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, base {spans}, more {spans}")


def reliabilities(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation maximisation over vote patterns of one kind.

    Returns each pattern's probability of being personal data, and P(vote | class) as
    [class, labeler, vote]. It starts from the balance of votes; counts are smoothed by one.
    """
    table = np.array([_unpack(int(c))[2] for c in codes])
    balance = (table == 1).sum(axis=1) - (table == 2).sum(axis=1)
    p = 1 / (1 + np.exp(-balance.astype(float)))
    for _ in range(ROUNDS):
        weight = np.stack([counts * (1 - p), counts * p])
        share = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        tables = np.stack([[[(w[table[:, l] == v].sum() + 1) for v in range(3)] for l in range(table.shape[1])] for w in weight])  # noqa: E741
        tables /= tables.sum(axis=2, keepdims=True)
        score = np.log(share)[:, None] + np.log(tables)[:, np.arange(table.shape[1])[:, None], table.T].sum(axis=1)
        after = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        if np.abs(after - p).max() < 1e-9:
            break
        p = after
    return p, tables


def _features(codes: np.ndarray) -> np.ndarray:
    rows = []
    for code in codes:
        kind, size, own = _unpack(int(code))
        rows.append([1.0] + [float(kind == k) for k in range(4)] + [float(size == s) for s in range(4)] + [float(v == x) for v in own[1:] for x in (1, 2)])
    return np.array(rows)


def span_classifier(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability of each pattern by the classifier: ridge logistic regression on the EM labels.

    The form labeler (is it a base pattern?) is no feature, so proposed spans are judged by the rest.
    """
    target = np.zeros(len(codes))
    kinds = np.array([_unpack(int(c))[0] for c in codes])
    for kind in np.unique(kinds):
        own = kinds == kind
        target[own], _ = reliabilities(codes[own], counts[own])
    x, beta = _features(codes), np.zeros(_features(codes[:1]).shape[1])
    weight = counts * (len(codes) / counts.sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (target - p)) - 0.05 * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        step = np.linalg.solve(curve, gradient)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))


def accepted_codes(scanned: DataFrame, accept: float = ACCEPT) -> list[int]:
    """Vote patterns of proposed spans that count as personal data."""
    every = scanned.select(F.explode(F.concat("base", "more")).alias("x")).groupBy("x.code").agg(F.count(F.lit(1)).alias("n")).orderBy("code").collect()
    if not every:
        return []
    codes, counts = np.array([r["code"] for r in every]), np.array([r["n"] for r in every], float)
    likely = span_classifier(codes, counts)
    # A checked value is a condition, not a vote: without it a number is not added.
    return [int(c) for c, p in zip(codes, likely, strict=True) if p >= accept and _unpack(int(c))[2][0] == 0 and _unpack(int(c))[2][1] == 1]


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, base and spans (arrays of kind, start, end; by kind, then start).

    spans holds base and what the method adds. Positions are code points, ends exclusive. A null
    or empty text has no spans. Repeated rows come out as they go in and count as often.
    """
    scanned = stage(scan(docs, key, text), "spans")
    codes = accepted_codes(scanned)
    more = F.filter("more", lambda x: x["code"].isin(codes)) if codes else F.slice("more", 1, 0)
    plain = lambda spans: F.sort_array(F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
    return scanned.select(F.col("key").alias(key), plain(F.col("base")).alias("base"), plain(F.concat("base", more)).alias("spans"))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans as text."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        key, *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets.

    Overlapping spans (a card inside a phone number) are replaced as one, by the first. Votes are
    counted in one pass over the texts; a second one finds the spans again and replaces them, so
    rows need no key and texts are not shuffled. A null text stays.
    """
    codes = set(accepted_codes(stage(scan(docs, key, text), "spans")))
    names = [f"<{k}>" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in textkit.blocks(batches, text):
            texts = block.column(text)
            some = pc.fill_null(pc.match_substring_regex(texts, r"[0-9@]|(?i:[(\[](?:at|dot)[)\]]| dot )"), False).to_pylist()
            new = texts.to_pylist()
            for i in np.flatnonzero(some):
                own = new[i]
                base = base_spans(own)
                spans = base + [x for x in proposed_spans(own, base) if votes(own, *x, False) in codes]
                parts, last = [], 0
                for start, end, kind in sorted((s, e, k) for k, s, e in spans):
                    if start >= last:
                        parts += [own[last:start], names[kind]]
                    last = max(last, end)
                new[i] = "".join([*parts, own[last:]])
            yield block.set_column(block.schema.get_field_index(text), text, pa.array(new, texts.type))

    return docs.mapInArrow(run, docs.schema)
