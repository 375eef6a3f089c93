"""Inputs derived from the driver's tables: chains, alignments, state sequences, classes.

Each has the same definition as Spark columns and as a DuckDB WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldline.operators.ranks import numbered
from foldline.sources.scratch import shared_folder

STATES = ["A", "B", "C", "D", "E"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chain, idx, valid, ca, cb, n, c and their components ca_x .. c_z; every eleventh residue is invalid."""
    e = lambda k: F.element_at("embedding", k).cast("double")
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("chain"), "vec_id", *(e(k + 1).alias(f"e{k}") for k in range(12)))
    # Chains are few and long: places come from ranges, as a window would put a chain in one task.
    rows = numbered(rows, [F.col("chain"), F.col("vec_id")], shared_folder(spark, "chains"), "_place")
    first = rows.groupBy(F.col("chain").alias("_of")).agg(F.min("_place").alias("_first"))
    rows = rows.join(F.broadcast(first), F.col("chain").eqNullSafe(F.col("_of"))).withColumn("idx", (F.col("_place") - F.col("_first")).cast("int"))
    atoms = {}
    for k, d in enumerate("xyz"):
        atoms[f"ca_{d}"] = F.col(f"e{k}") * 10.0
        for m, atom in enumerate(("cb", "n", "c")):
            atoms[f"{atom}_{d}"] = F.col(f"e{k}") * 10.0 + F.col(f"e{3 * (m + 1) + k}")
    rows = rows.select("chain", "idx", (F.col("vec_id") % 11 != 3).alias("valid"), *(c.alias(name) for name, c in atoms.items()))
    return rows.withColumns({a: F.array(*(f"{a}_{d}" for d in "xyz")) for a in ("ca", "cb", "n", "c")})


_coords = ", ".join(
    [f"10.0::DOUBLE * e[{k + 1}]::DOUBLE AS ca_{d}" for k, d in enumerate("xyz")]
    + [f"10.0::DOUBLE * e[{k + 1}]::DOUBLE + e[{3 * (m + 1) + k + 1}]::DOUBLE AS {a}_{d}" for m, a in enumerate(("cb", "n", "c")) for k, d in enumerate("xyz")]
)
CHAINS = f"""raw AS (SELECT label AS chain, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS idx, vec_id % 11 <> 3 AS valid, embedding AS e FROM embeddings),
chains AS (SELECT chain, idx, valid, {_coords} FROM raw)"""


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alignment_id, sid1, sid2, cigar of every line item."""
    q = lambda n: (F.col("l_partkey") % n).cast("int")
    text = F.concat(F.col("l_linenumber").cast("string"), F.lit("P"), (q(7) + 1).cast("string"), F.when(q(2) == 0, "D").otherwise("I"), F.when(q(3) == 0, "M").otherwise("2M"), (q(5) + 2).cast("string"), F.lit("P"))
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    # Items alike in all four are alike in every column made here; the second and later have their number in the id.
    rows = table(spark, sf_dir, "lineitem").select(*key, F.row_number().over(Window.partitionBy(*key).orderBy("l_orderkey")).alias("again"))
    return rows.select(F.concat_ws(":", F.lit("l"), *key, F.when(F.col("again") > 1, F.col("again").cast("string"))).alias("alignment_id"), F.concat(F.lit("d"), F.col("l_suppkey") % 40).alias("sid1"), F.concat(F.lit("d"), F.col("l_partkey") % 50).alias("sid2"), text.alias("cigar"))


_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_ITEMS = f"""SELECT concat_ws(':', 'l', {_ID}, CASE WHEN row_number() OVER (PARTITION BY {_ID}) > 1 THEN row_number() OVER (PARTITION BY {_ID}) END) AS alignment_id, 'd' || (l_suppkey % 40) AS sid1, 'd' || (l_partkey % 50) AS sid2, l_orderkey, l_partkey,
  concat(l_linenumber, 'P', l_partkey % 7 + 1, CASE WHEN l_partkey % 2 = 0 THEN 'D' ELSE 'I' END, CASE WHEN l_partkey % 3 = 0 THEN 'M' ELSE '2M' END, l_partkey % 5 + 2, 'P') AS cigar
  FROM lineitem"""
_EXPANDED = """toks AS (SELECT alignment_id, sid1, sid2, cigar, unnest(regexp_extract_all(cigar, '[0-9]*[A-Za-z]')) AS tok, generate_subscripts(regexp_extract_all(cigar, '[0-9]*[A-Za-z]'), 1) AS pos FROM alignments),
ops AS (SELECT *, right(tok, 1) AS op, coalesce(try_cast(left(tok, length(tok) - 1) AS BIGINT), 1) AS n FROM toks),
placed AS (SELECT *,
  coalesce(sum(CASE WHEN op IN ('D', 'M', 'P') THEN n ELSE 0 END) OVER w, 0) AS i0, coalesce(sum(CASE WHEN op IN ('I', 'M', 'P') THEN n ELSE 0 END) OVER w, 0) AS j0,
  coalesce(sum(CASE WHEN op = 'P' THEN n ELSE 0 END) OVER w, 0) AS k0
  FROM ops WINDOW w AS (PARTITION BY alignment_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pairs AS (SELECT alignment_id, sid1, sid2, CAST(k0 + t AS INTEGER) AS k, CAST(i0 + t AS INTEGER) AS i, CAST(j0 + t AS INTEGER) AS j FROM (SELECT *, unnest(range(n)) AS t FROM placed WHERE op = 'P'))"""
ALIGNMENTS = f"alignments AS ({_ITEMS}),\n{_EXPANDED}"
#: ALIGNMENTS dealt onto all users, as aligned_users() has them.
USER_ALIGNMENTS = f"""places AS (SELECT 'd' || user_id AS sid, row_number() OVER (ORDER BY user_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)),
items AS ({_ITEMS}),
alignments AS (SELECT alignment_id, x.sid AS sid1, y.sid AS sid2, cigar FROM items JOIN places x ON x.place = l_orderkey % x.n JOIN places y ON y.place = l_partkey % y.n),
{_EXPANDED}"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, seq: every user's events in order of time as letters A to E by event type in order; sid is d and the user."""
    events = table(spark, sf_dir, "events")
    types = events.select("event_type").distinct().select("event_type", F.substring(F.lit("".join(STATES)), F.row_number().over(Window.orderBy("event_type")), F.lit(1)).alias("letter"))
    rows = events.join(F.broadcast(types), "event_type").where("user_id is not null")
    return rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "letter"))), lambda x: x.letter), "").alias("seq")).select(F.concat(F.lit("d"), "user_id").alias("sid"), "seq")


def aligned_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alignments with sid1 and sid2 dealt onto all users: the order's and the part's number modulo the users, in order of user_id."""
    users = table(spark, sf_dir, "events").where("user_id is not null").select(F.col("user_id").cast("long").alias("user_id")).distinct()
    places = numbered(users, [F.col("user_id")], shared_folder(spark, "users"), "place").select(F.concat(F.lit("d"), "user_id").alias("sid"), "place")
    n = places.agg(F.count("*").alias("n"))
    key = F.split("alignment_id", ":")
    rows = alignments(spark, sf_dir).select("alignment_id", "cigar", F.get(key, F.lit(1)).cast("long").alias("order"), F.get(key, F.lit(3)).cast("long").alias("part"))
    rows = rows.crossJoin(F.broadcast(n)).where("n > 0").withColumns({"p1": F.col("order") % F.col("n"), "p2": F.col("part") % F.col("n")})
    for k in "12":
        rows = rows.join(places.select(F.col("place").alias(f"p{k}"), F.col("sid").alias(f"sid{k}")), f"p{k}")
    return rows.select("alignment_id", "sid1", "sid2", "cigar")


SEQUENCES = """types AS (SELECT event_type, substr('ABCDE', CAST(row_number() OVER (ORDER BY event_type) AS INTEGER), 1) AS letter FROM (SELECT DISTINCT event_type FROM events)),
sequences AS (SELECT 'd' || user_id AS sid, string_agg(letter, '' ORDER BY ts, event_id) AS seq FROM events JOIN types USING (event_type) WHERE user_id IS NOT NULL GROUP BY user_id)"""



def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b: the letters of a user's successive events."""
    events = table(spark, sf_dir, "events")
    types = events.select("event_type").distinct().select("event_type", F.substring(F.lit("".join(STATES)), F.row_number().over(Window.orderBy("event_type")), F.lit(1)).alias("letter"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.join(F.broadcast(types), "event_type").select(F.col("letter").alias("b"), F.lag("letter").over(order).alias("a"))
    return rows.where("a is not null").select("a", "b")


EVENT_PAIRS = """types AS (SELECT event_type, substr('ABCDE', CAST(row_number() OVER (ORDER BY event_type) AS INTEGER), 1) AS letter FROM (SELECT DISTINCT event_type FROM events)),
steps AS (SELECT a, b FROM (SELECT letter AS b, lag(letter) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events JOIN types USING (event_type)) WHERE a IS NOT NULL),
counts AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM steps UNION ALL SELECT b, a FROM steps) GROUP BY a, b)"""


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, class: parts under dotted classes of two to four components."""
    p = F.col("p_partkey")
    text = lambda c: c.cast("string")
    dotted = F.concat_ws(".", F.substring(F.lit("abcd"), (p % 3 + 1).cast("int"), F.lit(1)), text(p % 4), F.when(p % 9 != 0, text(p % 5)), F.when((p % 9 != 0) & (p % 7 != 0), text(p % 2)))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("d"), text(p)).alias("sid"), dotted.alias("class"))


CLASSES = """classes AS (SELECT 'd' || p_partkey AS sid, concat_ws('.', substr('abcd', CAST(p_partkey % 3 + 1 AS INTEGER), 1), CAST(p_partkey % 4 AS VARCHAR),
  CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_partkey % 5 AS VARCHAR) END, CASE WHEN p_partkey % 9 <> 0 AND p_partkey % 7 <> 0 THEN CAST(p_partkey % 2 AS VARCHAR) END) AS class FROM part)"""


def letters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in STATES], "letter string")
