"""Quality rules of documents, and verdicts on the hosts that they come from.

Every document is measured once, and its rules are booleans of those measures. Failures are counted by
host, rule by rule. A host's rate is shrunk towards the rate of all hosts by a beta prior, whose mean and strength are
fitted to the hosts themselves (method of moments: the spread of their rates beyond what chance gives), so that a host with
few documents is judged by what is usual and one with many by its own. A host of which more than
half is expected to fail a rule is rejected, and the verdict is joined back to its documents. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.llm.decontaminate import once
from foldline.llm.shared import cut

#: Words of a window, fewest words of a document, and the most of its words, in percent, that repeated windows may cover.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: The other rules: symbols for each 100 words, repeated lines for each 100 words, and code points in a word on average.
MOST_SYMBOLS, MOST_DUP_LINES, MEAN_CHARS = 10, 10, (2, 20)
#: Shrunk rate of failures above which a host is rejected.
REJECT = 0.5
#: Documents that the prior counts as, at least and at most.
STRENGTH = (1.0, 10_000.0)

#: SQL conditions over the measures that are true where a rule fails.
RULES = {
    "base": f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words",
    "symbols": f"100 * n_symbols > {MOST_SYMBOLS} * n_words",
    "lines": f"100 * n_dup_lines > {MOST_DUP_LINES} * n_words",
    "length": f"word_chars < {MEAN_CHARS[0]} * n_words or word_chars > {MEAN_CHARS[1]} * n_words",
}
#: Blanks between words, and what counts as a symbol.
BLANKS, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """How many of an array's words lie in windows of n that occur twice or more in it, the first of them included."""
    size = lambda a: F.size(a).cast("long")

    def windows(h: Column) -> Column:
        firsts = F.slice(h, F.lit(1), F.greatest(F.lit(0), F.size(h) - (n - 1)))
        return F.transform(firsts, lambda w, i: F.xxhash64(w, *(F.get(h, i + k) for k in range(1, n))))

    def covered(at: Column) -> Column:  # starts in order: a window covers n words, or those up to the next one
        return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(n), F.get(at, k + 1) - x)), F.lit(0).cast("long"), lambda a, x: a + x)

    def starts(placed: Column) -> Column:
        again = F.filter(placed, lambda x, k: (F.get(placed, k - 1)["w"] == x["w"]) | (F.get(placed, k + 1)["w"] == x["w"]))
        return F.sort_array(F.transform(again, lambda x: x["at"]))

    def among(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("at"))))
        return F.when(size(F.array_distinct(w)) == size(w), F.lit(0).cast("long")).otherwise(once(once(placed, starts), covered))

    return once(once(F.transform(words, lambda w: F.xxhash64(w)), windows), among)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text; null counts as empty."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c: c.cast("long")

    def counts(w: Column) -> Column:
        return F.struct(long(F.size(w)).alias("n_words"), long(F.char_length(F.array_join(w, ""))).alias("word_chars"), repeated_words(w).alias("n_repeat_words"))

    of_words = once(F.array_remove(F.split("text", BLANKS), ""), counts)
    dup_lines = once(lines, lambda x: long(F.size(x) - F.size(F.array_distinct(x))))
    out = rows.select("doc_id", "source", of_words.alias("m"), long(F.regexp_count("text", F.lit(SYMBOLS))).alias("n_symbols"), dup_lines.alias("n_dup_lines"))
    return out.select("doc_id", "source", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words")


def host_rates(docs: DataFrame) -> DataFrame:
    """host, rule, n, failed, rate (shrunk) from a row per document with host and a boolean for each rule; a null host is none."""
    sums = docs.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(rule).alias(rule) for rule in RULES))
    hosts = sums.select("host", "n", F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("failed")) for rule in RULES))).alias("r")).select("host", "n", "r.*")
    every = hosts.groupBy("rule").agg(F.count("*").alias("hosts"), F.sum("n").alias("total"), F.sum("failed").alias("failures"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares"))
    # The spread of the hosts' rates about their mean, weighted by documents, less what chance alone gives.
    mean = F.col("failures") / F.col("total")
    prior = every.select("rule", mean.alias("mean"), (F.col("squares") / F.col("total") - mean * mean - mean * (1 - mean) * F.col("hosts") / F.col("total")).alias("spread"))
    lowest, highest = map(F.lit, STRENGTH)
    strength = F.when(F.col("spread") > 0, F.greatest(lowest, F.least(highest, F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1))).otherwise(highest)
    prior = prior.select("rule", "mean", strength.alias("strength"))  # a row per rule
    rate = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return hosts.join(F.broadcast(prior), "rule").select("host", "rule", "n", "failed", rate.alias("rate"))


def host_verdicts(docs: DataFrame, folder: str) -> DataFrame:
    """A row per document: doc_id, the measures, base_failed, host_rejected (null without a host) and kept.

    docs: doc_id, text, source (the host); other columns are not read. folder: a shared folder for this run's table.
    A null text has no words and so fails the base rules; a null source has no verdict, and its documents are kept unless they fail
    themselves. Null and repeated ids are rows like others, and equal rows fare alike. Texts of any length are read whole. A
    rate equal to REJECT is not above it. An empty table gives no rows.
    """
    rows = cut(measured(docs).select(F.col("source").alias("host"), "*").withColumns({rule: F.expr(test) for rule, test in RULES.items()}).drop("source"), f"{folder}/measures")
    judged = host_rates(rows).groupBy("host").agg((F.max("rate") > REJECT).alias("host_rejected"))
    joined = rows.join(judged, "host", "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("base").alias("base_failed"), (~F.col("base") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"))


#: The same verdicts in SQL.
ORACLE = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM texts),
grams AS (SELECT r, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
repeats AS (SELECT r, CAST(sum(coalesce(least({WINDOW}, nxt - i), {WINDOW})) AS BIGINT) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM again) GROUP BY r),
m AS (
  SELECT doc_id, host, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
    (SELECT CAST(len(l) - len(list_distinct(l)) AS BIGINT) FROM (SELECT list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l)) AS n_dup_lines,
    coalesce(repeats.n, 0) AS n_repeat_words
  FROM words LEFT JOIN repeats USING (r)),
ruled AS (SELECT *, {', '.join(f'({test}) AS rule_{rule}' for rule, test in RULES.items())} FROM m),
hosts AS (
  {' UNION ALL '.join(f"SELECT host, '{rule}' AS rule, count(*) AS n, count(*) FILTER (WHERE rule_{rule}) AS failed FROM ruled WHERE host IS NOT NULL GROUP BY host" for rule in RULES)}),
prior AS (
  SELECT rule, mean, CASE WHEN spread > 0 THEN greatest({STRENGTH[0]}, least({STRENGTH[1]}, mean * (1 - mean) / spread - 1)) ELSE {STRENGTH[1]} END AS strength
  FROM (SELECT rule, sum(failed) / sum(n) AS mean, sum(failed * failed / n) / sum(n) - pow(sum(failed) / sum(n), 2) - sum(failed) / sum(n) * (1 - sum(failed) / sum(n)) * count(*) / sum(n) AS spread FROM hosts GROUP BY rule)),
verdicts AS (SELECT host, max((failed + mean * strength) / (n + strength)) > {REJECT} AS rejected FROM hosts JOIN prior USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, rule_base AS base_failed, NOT rule_base AND NOT coalesce(rejected, false) AS kept
FROM ruled LEFT JOIN verdicts USING (host)
"""
