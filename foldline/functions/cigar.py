"""Alignment strings as columns: tokens, residue pairs, validation.

D advances the reference, I the query, M both, P both and pairs the two residues. A missing count is one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([0-9]*)([A-Za-z])"
#: A letter that is no operation.
OTHER = "[A-CE-HJ-LNOQ-Za-z]"
STRICT = r"^(?:[0-9]*[IDMP])+$"


def tokens(cigar: str | Column) -> Column:
    """array<struct<n: long, op: string>>; what is neither digit nor letter is ignored."""
    s = F.col(cigar) if isinstance(cigar, str) else cigar
    count = lambda t: F.when(F.length(t) == 1, F.lit(1).cast("long")).otherwise(F.substring(t, F.lit(1), F.length(t) - 1).try_cast("long"))
    return F.transform(F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0)), lambda t: F.struct(count(t).alias("n"), F.substring(t, -1, 1).alias("op")))


def runs(cigar: str | Column) -> Column:
    """array<struct<k, i, j, n>>: each run of pairs by its first pair number and residues; one fold over the tokens.

    Letters other than I, D, M and P raise an error, which is looked for once in the string.
    """
    text = F.col(cigar) if isinstance(cigar, str) else cigar
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("k"), zero.alias("i"), zero.alias("j"), F.array().cast("array<struct<k:bigint,i:bigint,j:bigint,n:bigint>>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        paired = t.op == "P"
        return F.struct(
            F.when(paired, s.k + t.n).otherwise(s.k).alias("k"),
            F.when(t.op == "I", s.i).otherwise(s.i + t.n).alias("i"),
            F.when(t.op == "D", s.j).otherwise(s.j + t.n).alias("j"),
            F.when(paired & (t.n > 0), F.concat(s.out, F.array(F.struct(s.k.alias("k"), s.i.alias("i"), s.j.alias("j"), t.n.alias("n"))))).otherwise(s.out).alias("out"),
        )

    found = F.aggregate(tokens(text), start, step, lambda s: s.out)
    return F.when(text.rlike(OTHER), F.raise_error(F.concat(F.lit("operation not supported: "), F.regexp_extract(text, OTHER, 0)))).otherwise(found)


def pairs(cigar: str | Column) -> Column:
    """array<struct<k, i, j>> of all residue pairs, in order."""
    zero = F.lit(0).cast("long")
    return F.flatten(F.transform(runs(cigar), lambda r: F.transform(F.sequence(zero, r.n - 1), lambda t: F.struct((r.k + t).alias("k"), (r.i + t).alias("i"), (r.j + t).alias("j")))))


def pair_count(cigar: str | Column) -> Column:
    return F.aggregate(tokens(cigar), F.lit(0).cast("long"), lambda s, t: s + F.when(t.op == "P", t.n).otherwise(0))


def run_total(cigar: str | Column) -> Column:
    """The sum of n over runs(), from the counts of P alone, and its error for other letters."""
    text = F.col(cigar) if isinstance(cigar, str) else cigar
    one = lambda t: F.when(t == "", F.lit(1).cast("long")).otherwise(F.coalesce(t.try_cast("long"), F.lit(0).cast("long")))
    found = F.aggregate(F.regexp_extract_all(text, F.lit("([0-9]*)P"), F.lit(1)), F.lit(0).cast("long"), lambda n, t: n + one(t))
    return F.when(text.rlike(OTHER), F.raise_error(F.concat(F.lit("operation not supported: "), F.regexp_extract(text, OTHER, 0)))).otherwise(found)


def spans(cigar: str | Column) -> Column:
    """struct<ref, query>: residues that the alignment advances over."""
    add = lambda ops: F.aggregate(tokens(cigar), F.lit(0).cast("long"), lambda s, t: s + F.when(t.op.isin(*ops), t.n).otherwise(0))
    return F.struct(add("DMP").alias("ref"), add("IMP").alias("query"))


def problem(cigar: str | Column, n_ref: Column, n_query: Column) -> Column:
    """Null for a valid string, else malformed, zero_length, ref_overrun or query_overrun: the first met from the left."""
    s = F.col(cigar) if isinstance(cigar, str) else cigar
    start = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(None).cast("string").alias("bad"))

    def step(a: Column, t: Column) -> Column:
        i = a.i + F.when(t.op.isin("D", "M", "P"), t.n).otherwise(0)
        j = a.j + F.when(t.op.isin("I", "M", "P"), t.n).otherwise(0)
        bad = F.when(a.bad.isNotNull(), a.bad).when(t.n == 0, "zero_length").when(i > n_ref, "ref_overrun").when(j > n_query, "query_overrun")
        return F.struct(i.alias("i"), j.alias("j"), bad.alias("bad"))

    return F.when(s.isNull() | ~s.rlike(STRICT), "malformed").otherwise(F.aggregate(tokens(s), start, step, lambda a: a.bad))


def token_list(cigar: str) -> list[tuple[int, str]]:
    """tokens() of one string in Python; letters other than I, D, M and P raise ValueError."""
    found = [(int(n or 1), op) for n, op in re.findall(TOKEN, cigar)]
    for _, op in found:
        if op not in "IDMP":
            raise ValueError(f"operation not supported: {op}")
    return found
