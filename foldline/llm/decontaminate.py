"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document if the document holds at least the given share of the item's
distinct word shingles, however much longer it is. Under one hash order an item's sketch is its
smallest shingles, as many as it may miss and one more, so a document that holds enough of the item
holds one of the sketch: the search loses nothing. An item of fewer words than a shingle is one shingle, the whole of it. Items and documents are partitioned by size in
powers of two, and a document is a candidate only if its partition has room for what is
needed of the item. Documents are searched for sketches alone; only candidates are read again, and verified by
exact counts of the shingles that they share with their items. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.llm.shared import cut, work_dir

SHINGLE, SHARE = 5, 80
#: Shingles of the benchmark that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def once(value: Column, use) -> Column:
    """use(value) with value evaluated once per row: a lambda's variable is not put in place of its uses."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _run(h: Column, at: Column, n: int) -> Column:
    """The hash of the n word hashes of h from a place on."""
    return F.xxhash64(*(F.get(h, at + k) for k in range(n)))


def _runs(h: Column, n: int) -> Column:
    """The hashes of all runs of n words."""
    firsts = F.slice(h, F.lit(1), F.greatest(F.lit(0), F.size(h) - (n - 1)))
    return F.transform(firsts, lambda w, i: F.xxhash64(w, *(F.get(h, i + k) for k in range(1, n))))


def shingles(text: str, lengths: list[int]) -> Column:
    """array<struct<shingle, size>>: the distinct hashes of the runs of each of lengths words, each with their number."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    runs = lambda h: F.array_distinct(F.concat(*(_runs(h, n) for n in lengths)) if len(lengths) > 1 else _runs(h, lengths[0]))
    return once(once(hashed, runs), lambda a: F.transform(a, lambda x: F.struct(x.alias("shingle"), F.size(a).alias("size"))))


def exploded(rows: DataFrame, key: str, lengths: list[int]) -> DataFrame:
    """key, shingle, size of rows with a key and text. An outer explode: the inner one would make the shingles twice."""
    rows = rows.select(F.col(key).cast("long"), F.col("text").cast("string")).where(f"{key} is not null and text is not null")
    return rows.select(key, F.explode_outer(shingles("text", lengths)).alias("s")).where("s is not null").select(key, "s.shingle", "s.size")


def item_shingles(benchmark: DataFrame, n: int) -> DataFrame:
    """item_id, shingle: the runs of n words of items, and of one with fewer words its whole sequence."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    hashed = F.transform(words("text"), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        out = F.when(F.size(h) >= n, _runs(h, n))
        for m in range(1, n):
            out = out.when(F.size(h) == m, F.array(_run(h, F.lit(0), m)))
        return out

    return rows.select("item_id", F.explode(once(hashed, runs)).alias("shingle")).distinct()


def _lengths(benchmark: DataFrame, n: int) -> list[int]:
    """The lengths of runs that documents are searched for: n, and those of items with fewer words, at most n in all."""
    size = F.size(words(F.col("text").cast("string")))
    short = benchmark.where("item_id is not null and text is not null").select(size.alias("m")).where((F.col("m") > 0) & (F.col("m") < n)).distinct().collect()
    return [n, *sorted(r["m"] for r in short)]


def _items(benchmark: DataFrame, n: int, percent: int) -> DataFrame:
    """item_id, item_shingles, required, shingle, in_sketch: a row per distinct shingle of an item."""
    items = item_shingles(benchmark, n).groupBy("item_id").agg(F.array_sort(F.collect_set("shingle")).alias("shingles"))
    required = F.expr(f"(size(shingles) * {percent} + 99) div 100")
    items = items.select("item_id", F.size("shingles").cast("long").alias("item_shingles"), required.alias("required"), F.posexplode("shingles").alias("rank", "shingle"))
    return items.withColumn("in_sketch", F.col("rank") <= F.col("item_shingles") - F.col("required")).drop("rank")


def _few(rows: DataFrame) -> DataFrame:
    """rows, marked for broadcast if there are few enough."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _partition(size: str | Column) -> Column:
    return F.floor(F.log2(size)).cast("int")


def candidates(docs: DataFrame, benchmark: DataFrame, n: int = SHINGLE, percent: int = SHARE, folder: str | None = None) -> DataFrame:
    """doc_id, item_id of documents that hold a shingle of the item's sketch and are of a size to hold enough of it.

    What the search meets is written below folder, by default a new one of work_dir().
    """
    sketches = _items(benchmark, n, percent).where("in_sketch").select("item_id", "shingle", _partition("required").alias("least"))
    met = exploded(docs, "doc_id", _lengths(benchmark, n)).join(_few(sketches), "shingle").groupBy("doc_id", "item_id", "least").agg(_partition(F.max("size")).alias("room"))
    met = cut(met, f"{folder or work_dir(docs.sparkSession, 'items')}/met")
    # Rows of one id are one document, whose size is not that of a row; only ids without room need to be looked at.
    tight = met.where("room < least").select("doc_id").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(tight, "doc_id", "left_semi")
    several = rows.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", "rows")
    return met.join(several, "doc_id", "left").where("room >= least or rows is not null").select("doc_id", "item_id")


def contained_items(docs: DataFrame, benchmark: DataFrame, n: int = SHINGLE, percent: int = SHARE, folder: str | None = None) -> DataFrame:
    """The benchmark items that documents hold.

    docs: doc_id, text; benchmark: item_id, text; other columns are not read. Returns doc_id, item_id, matched
    and item_shingles (distinct shingles), with 100 * matched >= percent * item_shingles. An item of fewer than n
    words is one shingle, its whole sequence, so a document that holds those words in a row holds the item. Null or empty texts
    and null ids have no shingles and are never found or searched. Repeated rows of an id
    count once, with the shingles of all its texts. Texts of any length are read whole, and a document may hold
    any number of items. Empty tables give no rows. Candidates are written below folder, by default a new one of work_dir().
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = folder or work_dir(docs.sparkSession, "items")
    pairs = cut(candidates(docs, benchmark, n, percent, folder), f"{folder}/candidates")
    wanted = pairs.join(_few(_items(benchmark, n, percent).select("item_id", "shingle", "item_shingles", "required")), "item_id")
    texts = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    held = exploded(texts, "doc_id", _lengths(benchmark, n)).select("doc_id", "shingle").join(wanted, ["doc_id", "shingle"])
    found = held.groupBy("doc_id", "item_id", "item_shingles", "required").agg(F.countDistinct("shingle").alias("matched"))
    return found.where("matched >= required").select("doc_id", "item_id", "matched", "item_shingles")


def without_items(docs: DataFrame, benchmark: DataFrame, n: int = SHINGLE, percent: int = SHARE) -> DataFrame:
    """docs without the documents that hold a benchmark item; all columns stay.

    Rows with a null doc_id or without text stay; of a doc_id that goes, all rows go. An empty benchmark takes nothing, an empty
    table stays empty; texts of any length are searched whole, and columns of the benchmark's names stay as they are.
    """
    return docs.join(contained_items(docs, benchmark, n, percent).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


#: The same pairs of documents and benchmark in SQL.
ORACLE = rf"""
WITH tokens AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
  UNION ALL SELECT 'b', item_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM tokens)
  UNION SELECT 'b', id, array_to_string(w, ' ') FROM tokens WHERE kind = 'b' AND len(w) BETWEEN 1 AND {SHINGLE - 1}
  UNION SELECT 'd', id, array_to_string(w[i : i + m - 1], ' ')
  FROM (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM tokens, (SELECT DISTINCT len(w) AS m FROM tokens WHERE kind = 'b' AND len(w) BETWEEN 1 AND {SHINGLE - 1}) WHERE kind = 'd')),
items AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE kind = 'b')
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS matched, any_value(b.n) AS item_shingles
FROM shingles d JOIN items b ON d.s = b.s WHERE d.kind = 'd'
GROUP BY d.id, b.id HAVING 100 * count(*) >= {SHARE} * any_value(b.n)
"""
