"""Prefix trie of conversations, with subtree totals by leaf-peeling message passing.

Turns. Conversations are read as rows, never as lists: a turn's place in its conversation comes from a
range partition of all turns, so one conversation may hold any share of them. Only a digest and
a word count of each turn travel on. A prefix is named by the exclusive or of the digests of its (place, turn) pairs, a running
total that needs no whole conversation either, and nodes are a grouping by that name.

Peeling. Each node has a leader, the member that comes first by a hash of its id. Nodes of one leader are
a path down the trie, and paths form a tree that is about as deep as the logarithm of the number of conversations,
however long those are. Every path has a counter of paths that hang on its nodes and have not reported yet. In each round
those whose counter is zero send their totals of leaves and saved words to the node that they hang on, the counters of
their receivers go down, and it ends when only the root's path is left and finishes. Within a
path the nodes' totals are running sums from its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm.shared import cut, drop
from foldline.operators.ranks import PIECE, numbered, running

#: Conversations that share one base, and the turns taken from it at most.
SHARE, MOST_LENT = 20, 3
#: Words of a turn.
WORD = r"[^\x20\x09-\x0D]+"
#: Ids that are joined to one block of text before they are hashed.
IDS = 1024
EMPTY = hashlib.sha256().hexdigest()
NODE = ["depth", "ka", "kb"]


def rebuilt(conversations: DataFrame, folder: str) -> DataFrame:
    """Rows of rebuilt conversations: conv_id, depth (0: the root's row), a and b (the turn's digest), words, ends (the last row)."""
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    turns = turns.select("conv_id", "turn", "role", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    turns = numbered(turns, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("a"), F.col("b")], f"{folder}/turns").drop("turn", "role")
    convs = turns.groupBy("conv_id").agg(F.min("number").alias("start"), F.count("*").alias("n"))
    convs = convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4, "base": F.expr(f"conv_id - conv_id % {SHARE}")})
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("length", F.expr("lent + greatest(0, n - h)"))
    convs = cut(convs.select("conv_id", "start", "n", "h", "base", "lent", "length"), f"{folder}/conversations")
    placed = turns.join(convs, "conv_id").withColumn("place", F.expr("number - start + 1"))
    own = placed.where("place > h").select("conv_id", F.expr("place - h + lent").alias("depth"), "a", "b", "words", F.expr("place - h + lent = length").alias("ends"))
    heads = placed.where(f"conv_id = base and place <= {MOST_LENT}").select("base", F.col("place").alias("depth"), "a", "b", "words")
    lent = convs.where("lent > 0").select("conv_id", "base", "lent", "length").join(heads, "base").where("depth <= lent").select("conv_id", "depth", "a", "b", "words", F.expr("depth = length").alias("ends"))
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(c) for c in ("a", "b", "words")), F.expr("length = 0").alias("ends"))
    rows = root.unionByName(lent).unionByName(own)
    # What a turn adds to the name of its prefix; the root's name is 0.
    step = {"ga": F.when(F.col("depth") > 0, F.xxhash64("depth", "a", "b")).otherwise(0), "gb": F.when(F.col("depth") > 0, F.xxhash64(F.lit(2), "b", "a", "depth")).otherwise(0)}
    return cut(rows.withColumns(step).drop("a", "b"), f"{folder}/rebuilt")


def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (node, conv_id), in order, as rows of (node, first id, up to IDS ids joined by commas)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(4)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
        starts = [x for a, b in zip([0, *new], [*new, batch.num_rows]) for x in range(a, b, IDS)]
        ids = batch.column(3).cast(pa.string()).to_pylist()
        texts = [",".join(ids[a:b]) for a, b in zip(starts, [*starts[1:], batch.num_rows])]
        yield pa.RecordBatch.from_arrays([pa.array(c[starts]) for c in columns] + [pa.array(texts, pa.string())], [*NODE, "first", "ids"])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (node, first id, ids), in order, as (node, SHA-256 of all its ids): a hash is fed, no list is kept."""
    node, state = None, None
    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(k).to_pylist() for k in (0, 1, 2, 4)]
        for *key, ids in zip(*columns):
            if key != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield _rows(out)
    if node is not None:
        yield _rows([(*node, state.hexdigest())])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], [*NODE, "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """NODE and ends_sha256 from rows of NODE and conv_id.

    Ids are sorted by range, so that a node that many end at is spread, and joined to blocks there; only
    these blocks meet at their node, as SHA-256 has to read them in order.
    """
    order = [*NODE, "conv_id"]
    blocks = ends.repartitionByRange(*order).sortWithinPartitions(*order).select(*order).mapInArrow(join_ids, "depth long, ka long, kb long, first long, ids string")
    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, "depth long, ka long, kb long, ends_sha256 string")


def subtree_totals(paths: DataFrame, folder: str) -> DataFrame:
    """What paths send when they are complete: leader and depth of the receiving node, leaves, saved.

    paths: leader, up (the leader of the node that the path hangs on, null for the root's), hang (that node's depth), leaves and saved
    (of its own nodes). Each round is a written table; a round that fails is made again from the last.
    """
    spark = paths.sparkSession
    waiting = paths.where("up is not null").groupBy(F.col("up").alias("leader")).agg(F.count("*").alias("waiting"))
    state = cut(paths.join(waiting, "leader", "left").withColumn("waiting", F.coalesce("waiting", F.lit(0)).cast("long")), f"{folder}/state-0")
    sent, k = [], 0
    while not state.isEmpty():
        ready = state.where("waiting = 0 and up is not null")
        ready.select(F.col("up").alias("leader"), F.col("hang").alias("depth"), "leaves", "saved").write.parquet(f"{folder}/sent-{k}")
        sent.append(f"{folder}/sent-{k}")
        got = spark.read.parquet(sent[-1]).groupBy("leader").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("heard"))
        rest = state.where("waiting > 0").join(got, "leader", "left")
        add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
        rest = rest.select("leader", "up", "hang", add("leaves", "more_leaves").alias("leaves"), add("saved", "more_saved").alias("saved"), (F.col("waiting") - F.coalesce("heard", F.lit(0))).alias("waiting"))
        state = cut(rest, f"{folder}/state-{k + 1}")
        drop(spark, f"{folder}/state-{k}")
        k += 1
    if not sent:
        return spark.createDataFrame([], "leader long, depth long, leaves long, saved long")
    return spark.read.schema("leader long, depth long, leaves long, saved long").parquet(*sent)


def prefix_trie(conversations: DataFrame, folder: str, piece: int = PIECE) -> DataFrame:
    """A row per node of the trie of rebuilt conversations.

    conversations: conv_id, turn, role, text; other columns are not read. Conversation c is rebuilt from the first h turns of conversation
    c - c % 20 (the remainder has the sign of c, as in SQL) and its own turns after the first h, h = crc32(c as text) % 4. folder: a shared
    folder for this run's tables. Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. A null role or text is empty; a null turn comes first, and turns with one number are
    ordered by role, then by a hash of role and text; repeated rows are turns of their own. Rows with a null conv_id take no part. Texts
    of any length are read whole, and conversations may have any number of turns. An empty table has no nodes, not
    even the root. piece: places of one piece of a running total.
    """
    rows = rebuilt(conversations, folder)
    seen = running(rows, ["conv_id"], "depth", {"ka": ("bit_xor", "ga"), "kb": ("bit_xor", "gb")}, piece)
    seen = cut(seen, f"{folder}/prefixes")
    first = F.min(F.struct(F.xxhash64("conv_id"), "conv_id"))["conv_id"]
    nodes = seen.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), first.alias("leader"), F.max("words").alias("words"), F.max(F.col("ka").bitwiseXOR(F.col("ga"))).alias("pa"), F.max(F.col("kb").bitwiseXOR(F.col("gb"))).alias("pb"))
    nodes = cut(nodes, f"{folder}/nodes")
    above = (F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")
    children = nodes.where("depth > 0").select(*above).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("depth").alias("up_depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("leader").alias("up"))
    nodes = nodes.join(children, NODE, "left").withColumn("up_depth", F.when(F.col("depth") > 0, F.col("depth") - 1)).join(parents, ["up_depth", "pa", "pb"], "left")
    nodes = nodes.select(*NODE, "conv_id", "parent_conv_id", "n_convs", "leader", "up", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.expr("(n_convs - 1) * words").alias("saved"))
    nodes = cut(nodes.withColumn("leaves", F.expr("cast(n_children = 0 as bigint)")), f"{folder}/family")

    top = F.min(F.struct("depth", "up"))
    paths = nodes.groupBy("leader").agg(top["up"].alias("up"), (top["depth"] - 1).alias("hang"), F.max("depth").alias("bottom"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    paths = cut(paths, f"{folder}/paths")
    messages = subtree_totals(paths.drop("bottom"), folder).groupBy("leader", "depth").agg(F.sum("leaves").alias("got_leaves"), F.sum("saved").alias("got_saved"))
    owned = nodes.join(messages, ["leader", "depth"], "left").join(paths.select("leader", "bottom"), "leader")
    owned = owned.withColumns({"from_end": F.col("bottom") - F.col("depth"), "leaves": F.col("leaves") + F.coalesce("got_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("got_saved", F.lit(0))})
    owned = cut(owned.drop("bottom", "got_leaves", "got_saved", "up"), f"{folder}/owned")
    totals = running(owned, ["leader"], "from_end", {"n_leaves": ("sum", "leaves"), "saved_tokens": ("sum", "saved")}, piece)
    out = totals.join(ends_digests(seen.where("ends").select(*NODE, "conv_id")), NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


#: The same nodes in SQL, every subtree by its leaves' and nodes' prefixes.
ORACLE = rf"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, list(x ORDER BY p) AS xs FROM turns GROUP BY c),
hashed AS (
  SELECT c, xs, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
    lambda a, s: list_reduce(range(8), lambda b, k: xor(b >> 1, (b & 1) * 3988292384), xor(a, s)), 4294967295::BIGINT), 4294967295) % 4 AS h FROM convs),
made AS (SELECT a.c, list_concat(coalesce(b.xs[1 : a.h], []), a.xs[a.h + 1 :]) AS xs FROM hashed a LEFT JOIN convs b ON b.c = a.c - a.c % {SHARE}),
prefixes AS (SELECT c, d, xs[1 : d] AS path, d = len(xs) AS ends FROM (SELECT c, xs, unnest(range(0, len(xs) + 1)) AS d FROM made)),
nodes AS (
  SELECT path, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256,
    CASE WHEN any_value(d) = 0 THEN 0 ELSE len(list_filter(string_split_regex(any_value(path[d].t), '[\x20\x09-\x0D]+'), lambda w: w <> '')) END AS words
  FROM prefixes GROUP BY path),
children AS (SELECT path[1 : depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
above AS (SELECT n_convs, words, children.path IS NULL AS leaf, nodes.path AS path, unnest(range(0, depth + 1)) AS k FROM nodes LEFT JOIN children ON nodes.path = children.path),
totals AS (SELECT path[1 : k] AS path, count(*) FILTER (WHERE leaf) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM above GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(children.n_children, 0) AS n_children, totals.n_leaves, CAST(totals.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN totals ON n.path = totals.path LEFT JOIN children ON n.path = children.path LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1 : n.depth - 1]
"""
