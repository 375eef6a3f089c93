"""Substring dedup by line hashing, of whole lines and of the clauses within them.

A unit is a line or, within one, a clause: what ends with a line feed or a run of marks. Units are normalised (A-Z in
lower case, white space runs as one blank, trimmed) and hashed. Of all lines with one digest in the corpus, and of all
pairs of neighbouring clauses with one digest, the earliest by (doc_id, place) stays and the others are repeats. A line
is removed if it has enough words, and a run of clauses, each of which is with its neighbour a repeat, if the
run has; so a passage is found inside a line and across lines. Removals keep the offsets of the original text.

A digest that many documents share meets itself in the task that reads them: there, all but the first few
are known to be repeats and do not go to the digest's place, so no place holds more than a few rows for each task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldline.llm.shared import cut, fresh_name, stretches

#: Words that a repeated line needs, and a run of repeated clauses or a single clause.
LINE_WORDS, RUN_WORDS = 20, 40
#: Marks that end a clause, with a line feed.
MARKS = ".!?,;:|"
#: Digests that a task remembers at a time.
SEEN = 100_000

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BLANKS = " \t\n\r\x0b\x0c"
_clauses = re.compile(rf"[^\n{MARKS}]*(?:\n|[{MARKS}]+)|[^\n{MARKS}]+").finditer
_digest = xxhash.xxh3_128_digest

#: What a unit is: a pair of neighbouring clauses, a clause of enough words alone, a line.
PAIR, CLAUSE, LINE = 0, 1, 2
#: span: start << 32 | end, in code points; size: words << 32 | words of the last clause << 2 | what the unit is.
UNIT = "doc_id long, span long, size long, d1 long, d2 long, known boolean"


def units(text: str, line_words: int, run_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(span, size, digest) of each unit of a text."""
    before = None  # of the clause before: words, start, digest
    line: list = []  # of the line so far: start, end, words
    for m in _clauses(text.translate(_LOWER)):
        clause = m.group()
        if words := clause.encode().split():
            start = m.start() + len(clause) - len(clause.lstrip(_BLANKS))
            end = m.start() + len(clause.rstrip(_BLANKS))
            n, digest = len(words), _digest(b" ".join(words))
            if before:
                yield before[1] << 32 | end, (before[0] + n) << 32 | n << 2 | PAIR, _digest(before[2] + digest)
            if n >= run_words:
                yield start << 32 | end, n << 32 | n << 2 | CLAUSE, _digest(digest)
            before = n, start, digest
            line = [line[0] if line else start, end, line[2] + words if line else words]
        if line and (clause[-1] == "\n" or m.end() == len(text)):
            start, end, words = line
            if len(words) >= line_words:
                yield start << 32 | end, len(words) << 32 | LINE, _digest(b"\n" + b" ".join(words))
            line = []


def _units(docs: DataFrame, line_words: int, run_words: int) -> DataFrame:
    """UNIT rows of all documents; known: a repeat of an earlier place that this task has sent to the digest's place, with another."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}  # digest -> the earliest place, and how many places were sent
        names = [c.split()[0] for c in UNIT.split(", ")]
        for batch in batches:
            for part in stretches(batch, 1, 500, 1 << 21):
                out: list = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    for span, size, digest in units(text.as_py(), line_words, run_words):
                        held = seen.get(digest)
                        if held is None:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen[digest] = [(doc, span), 1]
                            known = False
                        else:
                            known = held[1] > 1 and (doc, span) > held[0]
                            if not known:
                                held[0], held[1] = min(held[0], (doc, span)), held[1] + 1
                        out.append((doc, span, size, digest, known))
                doc, span, size, digest, known = zip(*out) if out else ((),) * 5
                halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (doc, span, size)), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(known, pa.bool_())], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(find, UNIT)


def repeated_spans(docs: DataFrame, folder: str, line_words: int = LINE_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """The spans to remove: a row per repeated passage but the kept one.

    docs: doc_id, text; other columns are not read. Returns doc_id, span_start, span_end (code points of the
    original text, end excluded) and kept_doc_id, kept_start: the earliest place of the unit that the passage begins with. Lines of
    line_words words, and runs of neighbouring clauses of run_words words of which each pair is a repeat, count; passages that
    overlap are one. Null and empty texts have no units; rows with a null doc_id take no part; rows
    of one doc_id count as one document, so that equal rows are no repeats of each other; of equal units of a
    document the first stays. Texts of any length are read whole, clause by clause. Empty tables give no rows.
    """
    # A known repeat has a place of its own; the others of a digest meet, in order, so that no group is held.
    own = F.when(F.col("known"), F.xxhash64("doc_id", "span")).otherwise(F.lit(0))
    order = Window.partitionBy("d1", "d2", "own").orderBy("doc_id", "span").rowsBetween(Window.unboundedPreceding, 0)
    rows = _units(docs, line_words, run_words).withColumn("own", own).withColumn("kept", F.first(F.struct("doc_id", "span")).over(order))
    rows = rows.where("known or doc_id <> kept.doc_id or span <> kept.span").withColumn("kept", F.expr("if(known, null, kept)"))
    rows = cut(rows.drop("own", "known"), f"{folder}/repeats")

    # Units that overlap are one passage; the words of a run are those of its pairs' first clauses and of its last clause.
    rows = rows.select("doc_id", "size", "d1", "d2", "kept", _high("span").alias("a"), _low("span").alias("b"), (F.col("size") % 4).alias("what"), _high("size").alias("words"), F.shiftright(_low("size"), 2).alias("tail"))
    runs = _joined(rows.where(f"what <> {LINE}").distinct()).groupBy("doc_id", "run").agg(
        F.coalesce(F.sum(F.expr(f"if(what = {PAIR}, words - tail, null)")) + F.max_by("tail", F.struct("b", "a")), F.max("words")).alias("words"), *_passage()
    )  # fmt: skip
    lines = rows.where(f"what = {LINE}").select("doc_id", "a", "b", F.struct("a", "what", "d1", "d2", "kept").alias("unit"))
    passages = runs.where(F.col("words") >= run_words).select("doc_id", "a", "b", "unit").unionByName(lines.distinct())
    passages = _joined(passages).groupBy("doc_id", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("unit").alias("unit")).select("doc_id", "a", "b", "unit.d1", "unit.d2", "unit.kept")
    # A known repeat's earliest place is with the repeats of its digest that were not known.
    first = rows.where("kept is not null").groupBy("d1", "d2").agg(F.min("kept").alias("first"))
    passages = passages.join(first, ["d1", "d2"]).withColumn("kept", F.coalesce("kept", "first"))
    return passages.select("doc_id", F.col("a").cast("int").alias("span_start"), F.col("b").cast("int").alias("span_end"), F.col("kept.doc_id").alias("kept_doc_id"), _high("kept.span").cast("int").alias("kept_start"))


def _high(c: str) -> Column:
    return F.shiftright(F.col(c), 32)


def _low(c: str) -> Column:
    return F.col(c).bitwiseAND(F.lit((1 << 32) - 1))


def _passage() -> list[Column]:
    return [F.min("a").alias("a"), F.max("b").alias("b"), F.min(F.struct("a", "what", "d1", "d2", "kept")).alias("unit")]


def _joined(spans: DataFrame) -> DataFrame:
    """spans (doc_id, a, b and more) with run: the number of the group of overlapping ones, within the document."""
    order = Window.partitionBy("doc_id").orderBy("a", "b")
    ends = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("a") < ends, 0).otherwise(1)
    return spans.withColumn("run", opens).withColumn("run", F.sum("run").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the spans (doc_id, span_start, span_end) taken out of text; all columns and rows stay.

    Rows of one doc_id lose the same spans; rows with a null doc_id, without spans or without text are as they were.
    """
    gone = fresh_name("gone", docs.columns)
    held = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("span_start", "span_end"))).alias(gone))
    left = F.expr(f"""aggregate({gone}, named_struct('out', '', 'at', 0),
      (x, s) -> named_struct('out', concat(x.out, substring(text, x.at + 1, greatest(0, s.span_start - x.at))), 'at', greatest(x.at, s.span_end)),
      x -> concat(x.out, substring(text, x.at + 1)))""")
    return docs.join(held, "doc_id", "left").withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)).select(*docs.columns)


_joined_sql = """sum(opens) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN a < max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM"""

#: The same spans of documents in SQL.
ORACLE = rf"""
WITH cut AS (
  SELECT doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^
{MARKS}]*(?:
|[{MARKS}]+)|[^
{MARKS}]+') AS cs
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
clauses AS (SELECT doc_id, unnest(cs) AS c, unnest(range(len(cs))) AS k FROM cut),
placed AS (
  SELECT *, coalesce(sum(length(c)) OVER w, 0) AS pos, coalesce(sum(CASE WHEN right(c, 1) = chr(10) THEN 1 ELSE 0 END) OVER w, 0) AS line_no
  FROM clauses WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
worded AS (
  SELECT doc_id, line_no, k, trim(regexp_replace(c, '[ 	-]+', ' ', 'g')) AS norm,
    CAST(pos + length(c) - length(regexp_replace(c, '^[ 	-]+', '')) AS BIGINT) AS a, CAST(pos + length(regexp_replace(c, '[ 	-]+$', '')) AS BIGINT) AS b
  FROM placed),
counted AS (SELECT *, len(string_split(norm, ' ')) AS n FROM worded WHERE norm <> ''),
paired AS (SELECT *, lead(norm) OVER w AS norm2, lead(b) OVER w AS b2, lead(n) OVER w AS n2 FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
units AS (
  SELECT doc_id, {PAIR} AS what, a, b2 AS b, n + n2 AS words, n2 AS tail, norm || chr(10) || norm2 AS unit FROM paired WHERE norm2 IS NOT NULL
  UNION ALL SELECT doc_id, {CLAUSE}, a, b, n, n, norm FROM counted WHERE n >= {RUN_WORDS}
  UNION ALL SELECT doc_id, {LINE}, min(a), max(b), sum(n), 0, string_agg(norm, ' ' ORDER BY k) FROM counted GROUP BY doc_id, line_no HAVING sum(n) >= {LINE_WORDS}),
ranked AS (SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(a) OVER w AS kept_start, row_number() OVER w AS place FROM units WINDOW w AS (PARTITION BY what, unit ORDER BY doc_id, a)),
repeats AS (SELECT * FROM ranked WHERE place > 1),
runs AS (
  SELECT doc_id, min(a) AS a, max(b) AS b, min({{'a': a, 'what': what, 'kept_doc_id': kept_doc_id, 'kept_start': kept_start}}) AS first,
    coalesce(sum(CASE WHEN what = {PAIR} THEN words - tail END) + arg_max(tail, {{'b': b, 'a': a}}), max(words)) AS words
  FROM (SELECT *, {_joined_sql} repeats WHERE what <> {LINE})) GROUP BY doc_id, run),
passages AS (
  SELECT doc_id, a, b, first FROM runs WHERE words >= {RUN_WORDS}
  UNION ALL SELECT doc_id, a, b, {{'a': a, 'what': what, 'kept_doc_id': kept_doc_id, 'kept_start': kept_start}} FROM repeats WHERE what = {LINE}),
found AS (SELECT doc_id, min(a) AS a, max(b) AS b, min(first) AS f FROM (SELECT *, {_joined_sql} passages)) GROUP BY doc_id, run)
SELECT doc_id, CAST(a AS INTEGER) AS span_start, CAST(b AS INTEGER) AS span_end, f.kept_doc_id AS kept_doc_id, CAST(f.kept_start AS INTEGER) AS kept_start FROM found
"""
