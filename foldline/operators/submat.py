"""Counts of aligned letters, mutual information, log-odds scores, state usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldline.functions import cigar


def aligned_letters(alignments: DataFrame, sequences: DataFrame) -> DataFrame:
    """k, i, j, a, b and a_prev, b_prev (the letter before, where the pair before is that letter's) per pair, of alignments whose sequences are both there.

    alignments: alignment_id, sid1, sid2, cigar; sequences: sid, seq. A pair's predecessor is in its own run of pairs or ends the
    run before, so that no pair is shuffled.
    """
    s1 = sequences.select(F.col("sid").alias("sid1"), F.col("seq").alias("seq1"))
    s2 = sequences.select(F.col("sid").alias("sid2"), F.col("seq").alias("seq2"))
    rows = alignments.select("alignment_id", "sid1", "sid2", "cigar").join(s1, "sid1").join(s2, "sid2").where("seq1 <> '' and seq2 <> ''")
    # The outer form, as Spark infers filters from the other and makes the runs again for each.
    runs = rows.select("alignment_id", "seq1", "seq2", cigar.runs("cigar").alias("runs")).select("alignment_id", "seq1", "seq2", "runs", F.posexplode_outer("runs").alias("at", "r")).where("r is not null")
    before = F.when(F.col("at") > 0, F.get("runs", F.col("at") - 1))
    # Of each sequence only the run's letters go on, after the one before them (a blank where there is none).
    part = lambda s, k: F.expr(f"concat(if(r.{k} > 0 and r.{k} <= char_length({s}), substring({s}, cast(r.{k} as int), 1), ' '), substring({s}, cast(r.{k} + 1 as int), cast(r.n as int)))")
    runs = runs.select("alignment_id", part("seq1", "i").alias("part1"), part("seq2", "j").alias("part2"), "r.k", "r.i", "r.j", "r.n", *((before[c] + before["n"] - 1).alias(f"{c}_before") for c in "ij"))
    pairs = runs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("t"))
    at = lambda c: F.col(c) + F.col("t")
    previous = lambda c: F.when(F.col("t") > 0, at(c) - 1).otherwise(F.col(f"{c}_before"))
    pairs = pairs.select("alignment_id", "part1", "part2", "t", at("k").alias("k"), at("i").alias("i"), at("j").alias("j"), previous("i").alias("i_prev"), previous("j").alias("j_prev"))
    letter = lambda s, less: F.nullif(F.substring(s, (F.col("t") + 2 - less).cast("int"), F.lit(1)), F.lit(""))
    return pairs.select(
        "alignment_id", "k", "i", "j", "i_prev", "j_prev", letter("part1", 0).alias("a"), letter("part2", 0).alias("b"),
        F.when(F.col("i_prev") == F.col("i") - 1, letter("part1", 1)).alias("a_prev"), F.when(F.col("j_prev") == F.col("j") - 1, letter("part2", 1)).alias("b_prev"),
    )


def _in(letters: str, c: str) -> Column:
    return F.col(c).isNotNull() & (F.instr(F.lit(letters), F.col(c)) > 0)


def _tallied(pairs: DataFrame, letters: str, *columns: str) -> DataFrame:
    """n of each combination of columns, of pairs of known letters: what directions and kinds are made of, after the pairs are counted."""
    return pairs.where(_in(letters, "a") & _in(letters, "b")).groupBy(*columns).agg(F.count("*").alias("n"))


def joint_counts(pairs: DataFrame, letters: str) -> DataFrame:
    """a, b, n of aligned letters, counted in both directions."""
    kept = _tallied(pairs, letters, "a", "b")
    both = kept.select("n", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    return both.groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))


def lagged_counts(pairs: DataFrame, letters: str) -> DataFrame:
    """a, b, n of a letter and the other sequence's letter one before, in unbroken runs."""
    kept = _tallied(pairs, letters, "a", "b", "a_prev", "b_prev")
    made = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    each = kept.select("n", F.explode(F.array(made("a", "b_prev"), made("b", "a_prev"))).alias("p")).select("n", "p.*")
    return each.where(_in(letters, "b")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def counts_by_kind(pairs: DataFrame, letters: str) -> DataFrame:
    """kind (aligned, lagged), a, b, n: joint_counts and lagged_counts in one pass over the pairs."""
    kept = _tallied(pairs, letters, "a", "b", "a_prev", "b_prev")
    made = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"))
    each = kept.select("n", F.explode(F.array(made("aligned", "a", "b"), made("aligned", "b", "a"), made("lagged", "a", "b_prev"), made("lagged", "b", "a_prev"))).alias("p")).select("n", "p.*")
    return each.where(_in(letters, "b")).groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def with_probabilities(counts: DataFrame, *by: str) -> DataFrame:
    """counts (a, b, n, and columns that tell tables apart) with p, pa and pb."""
    total = F.sum("n").over(Window.partitionBy(*by or [F.lit(0)]))
    rows = counts.groupBy(*by, "a", "b").agg(F.sum("n").alias("n"))  # alphabet squared: small whatever the corpus
    share = F.col("n").cast("double") / total
    return rows.withColumn("p", share).withColumns({"pa": F.sum("p").over(Window.partitionBy(*by, "a")), "pb": F.sum("p").over(Window.partitionBy(*by, "b"))})


def _term() -> Column:
    return F.col("p") * F.log2(F.col("p") / (F.col("pa") * F.col("pb")))


def mutual_information(counts: DataFrame) -> DataFrame:
    """One row, mi in bits; 0 without counts."""
    return with_probabilities(counts).where("n > 0").agg(F.coalesce(F.sum(_term()), F.lit(0.0)).alias("mi"))


#: Fixed value: the share of the lagged information that is not subtracted.
LAG_SHARE = 0.057


def adjusted_information(counts: DataFrame) -> DataFrame:
    """mi, mi_prev and mi_adjusted of counts_by_kind()'s rows."""
    rows = with_probabilities(counts, "kind").where("n > 0")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, _term())), F.lit(0.0))
    return rows.agg(of("aligned").alias("mi"), of("lagged").alias("mi_prev")).select("mi", "mi_prev", (F.col("mi") - (1 - LAG_SHARE) * F.col("mi_prev")).alias("mi_adjusted"))


def scores(counts: DataFrame, letters: DataFrame) -> DataFrame:
    """a, b, score for all pairs of letters (column letter): 2 log2 odds, rounded half to even, 0 where nothing was counted."""
    odds = with_probabilities(counts).where("n > 0").select("a", "b", F.rint(2 * F.log2(F.col("p") / (F.col("pa") * F.col("pb")))).cast("int").alias("s"))
    grid = letters.select(F.col("letter").alias("a")).crossJoin(letters.select(F.col("letter").alias("b")))
    return grid.join(odds, ["a", "b"], "left").select("a", "b", F.coalesce("s", F.lit(0)).alias("score"))


def merge_states(counts: DataFrame, gone: str, into: str) -> DataFrame:
    """counts with one letter's rows and columns added to another's."""
    name = lambda c: F.when(F.col(c) == gone, into).otherwise(F.col(c)).alias(c)
    return counts.select(name("a"), name("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n"))


def usage(sequences: DataFrame, letters: DataFrame) -> DataFrame:
    """letter, n over all letters of the alphabet."""
    seen = sequences.select(F.explode(F.split("seq", "")).alias("letter")).where("letter <> ''").groupBy("letter").agg(F.count("*").alias("n"))
    return letters.join(seen, "letter", "left").select("letter", F.coalesce("n", F.lit(0)).alias("n"))


def diagnostics(counts: DataFrame) -> DataFrame:
    """dead_fraction, normalized_entropy and perplexity of state counts (letter, n)."""
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    rows = counts.withColumn("p", F.coalesce(F.try_divide(F.col("n").cast("double"), total), F.lit(0.0)))
    entropy = -F.sum(F.col("p") * F.log(F.col("p") + 1e-10))
    return rows.agg(
        F.when(F.sum("n") > 0, F.avg((F.col("p") < 1e-5).cast("double"))).otherwise(1.0).alias("dead_fraction"),
        F.when(F.sum("n") > 0, F.coalesce(F.try_divide(entropy, F.log(F.count("*").cast("double"))), F.lit(0.0))).otherwise(0.0).alias("normalized_entropy"),
        F.exp(entropy).alias("perplexity"),
    )


def matrix_lines(matrix: DataFrame) -> DataFrame:
    """line_no, value: the matrix as text, a header of letters and a row for each, cells right-aligned to four characters."""
    cell = lambda c: F.lpad(c.cast("string"), 4, " ")
    rows = matrix.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("b", "score"))).alias("r"))
    head = rows.agg(F.sort_array(F.collect_list("a")).alias("h")).select(F.lit("").alias("a"), F.concat(F.lit(" "), F.array_join(F.transform("h", lambda x: F.lpad(x, 4, " ")), "")).alias("value"))
    body = rows.select("a", F.concat("a", F.array_join(F.transform("r", lambda x: cell(x.score)), "")).alias("value"))
    return head.union(body).select((F.row_number().over(Window.orderBy("a")) - 1).alias("line_no"), "value")
