"""Operator 4: repeated passages, by overlapping windows of three consecutive lines.

From every line with a word starts the window of that line and the next two with a word. A long
passage may have fewer lines, so where one or two lines already hold LONG_WORDS words they are a
window too, besides the three-line one. Windows are hashed (128 bits), repeated hashes are found
globally, and of each repeated window all occurrences but the first (by key, then position) are
covered. The covered ranges of a document are merged and their lines removed.

Everything is DataFrame functions. Only hashes, keys and positions are shuffled for the search;
the texts are met once, by the covered ranges of their document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage

WINDOW_LINES = 3
#: A window that already has this many words ends early: a long passage may be one or two lines.
LONG_WORDS = 50
# Names that no input column will have.
_DOC, _RANGES = "__covered_doc", "__covered_ranges"
_WORD = "[^\\x20\\x09-\\x0D]+"


def _worded_lines(text: Column) -> Column:
    """array<struct<i, w, a, b>>: position, words and two hashes of each line with a word."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(
        F.transform(lines, lambda line, i: F.struct(
            i.alias("i"), F.regexp_count(line, F.lit(_WORD)).alias("w"),
            F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit("second")).alias("b"))),
        lambda line: line["w"] > 0)


def _windows(x: Column, k: Column) -> Column:
    """array<struct<pos, last, h1, h2>>: the windows from entry x, number k of column `full`."""
    one, two = F.get("full", k + 1), F.get("full", k + 2)

    def window(n: int) -> Column:
        parts = [x, one, two][:n]
        hashed = {f: F.xxhash64(F.lit(n), *[part[f] for part in parts]) for f in "ab"}
        return F.struct(x["i"].alias("pos"), parts[-1]["i"].alias("last"), hashed["a"].alias("h1"), hashed["b"].alias("h2"))

    short = F.when(x["w"] >= LONG_WORDS, window(1)).when(x["w"] + one["w"] >= LONG_WORDS, window(2))
    return F.array_compact(F.array(short, F.when(two["w"].isNotNull(), window(WINDOW_LINES))))


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, pos, last, h1, h2): one row per window; lines without a word are skipped over."""
    return (
        docs.select(docs[key].alias("doc"), _worded_lines(docs[text]).alias("full"))
        .select("doc", F.explode(F.flatten(F.transform("full", _windows))).alias("x")).select("doc", "x.*"))


def covered_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, ranges): the sorted, merged ranges of lines under later occurrences of repeated windows."""
    found = stage(windows(docs, key, text), "windows")
    first = (
        found.groupBy("h1", "h2").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("h1", "h2", "first"))
    later = found.join(first, ["h1", "h2"]).where("doc > first.doc or (doc = first.doc and pos > first.pos)")
    grouped = later.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("pos", "last"))).alias("found"))
    none = F.array().cast("array<struct<pos:int,last:int>>")

    def merge(done: Column, x: Column) -> Column:
        end = F.try_element_at(done, F.lit(-1))
        apart = F.size(done) == 0
        joined = F.struct(end["pos"].alias("pos"), F.greatest(end["last"], x["last"]).alias("last"))
        return F.when(apart | (x["pos"] > end["last"] + 1), F.concat(done, F.array(x))).otherwise(
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)))

    return grouped.select("doc", F.aggregate("found", none, merge).alias("ranges"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs with the text cleaned, and n_lines, n_removed (long).

    Lines are split at \\n only. A document keeps its row even if all its lines go (the text is
    then empty); blank lines go only if they lie inside a covered window. A null text stays null
    with no lines. Rows with equal keys are one document for the order of occurrences, so repeated
    rows are treated alike; rows with a null key are kept as they are. Input columns named n_lines
    or n_removed are replaced.
    """
    covered = covered_lines(docs.where(docs[key].isNotNull()), key, text).select(F.col("doc").alias(_DOC), F.col("ranges").alias(_RANGES))
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    joined = docs.select(*[docs[c] for c in others]).join(covered, docs[key] == covered[_DOC], "left")
    lines, ranges = F.split(F.col(text), "\n"), F.col(_RANGES)
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.exists(ranges, lambda r: i.between(r["pos"], r["last"]))), "\n")
    removed = F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["pos"] + 1)
    return joined.select(
        *[F.when(ranges.isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else F.col(c) for c in others],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"))


ORACLE = """
with lines as (
  select doc_id, i, string_split(text, chr(10))[i + 1] as line
  from (select doc_id, text, unnest(range(len(string_split(text, chr(10))))) as i from documents)
), worded as (
  select *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as w from lines
), near as (
  select *, lead(i, 1) over d as i1, lead(i, 2) over d as i2, lead(w, 1) over d as w1,
    lead(line, 1) over d as l1, lead(line, 2) over d as l2
  from worded where w > 0 window d as (partition by doc_id order by i)
), sized as (
  select *, case when w >= 50 then 1 when w + w1 >= 50 then 2 end as n from near
  union all select *, 3 as n from near where i2 is not null
), windows as (
  select doc_id, i, case n when 1 then i when 2 then i1 else i2 end as last,
    n::varchar || chr(1) || line || case when n > 1 then chr(10) || l1 else '' end || case when n > 2 then chr(10) || l2 else '' end as body
  from sized where n is not null
), ranked as (
  select *, row_number() over (partition by body order by doc_id, i) as k from windows
), covered as (
  select distinct doc_id, unnest(range(i, last + 1)) as i from ranked where k > 1
), marked as (
  select l.doc_id, l.i, l.line, c.i is not null as gone
  from lines l left join covered c on l.doc_id = c.doc_id and l.i = c.i
)
select doc_id, coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '') as text,
  count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_removed
from marked group by doc_id
"""
