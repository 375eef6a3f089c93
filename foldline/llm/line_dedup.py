"""Line dedup by a segment-partition edit join.

Two lines within `edits` edits share, of the edits + 1 segments that the shorter is cut into, at least one
unchanged. Segments of distinct lines are indexed under (line length, segment number, segment); a line
probes the lengths up to its own with the substrings at positions that a match of so few edits
can have left it at. Keys that only one line has are dropped by a combined aggregate before any
pair is made, without the lines' texts. Lines that share a key are compared inside the join, so that only links leave it, by the
banded bit-parallel edit distance of what is left without their common beginning and end. Classes are what chains of links connect; the earliest line
of a class stays. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.llm.shared import components, cut, drop, fresh_name

EDITS = 2
#: Lines of fewer characters are compared without edits: short lines are within few edits of each other by chance.
MIN_CHARS = 30
#: Characters of a block that lines are compared by to find what they begin or end with in common, and of the rest's beginning.
BLOCK, HEAD = 16, 16
#: Keys that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def probes(edits: int) -> Column:
    """A constant array of (less, k, shift): segment k of a line `less` shorter may stand `shift` further on.

    Those that a match within the edits needs, if the k - 1 segments before and the rest after share them.
    """
    found = [(less, k, shift) for less in range(edits + 1) for k in range(1, edits + 2) for shift in range(-edits, edits + 1) if abs(shift) <= k - 1 and abs(shift - less) <= edits + 1 - k]
    return F.array(*(F.struct(F.lit(a).alias("less"), F.lit(k).alias("k"), F.lit(s).alias("shift")) for a, k, s in found))


def with_keys(lines: DataFrame, edits: int) -> DataFrame:
    """lines (line, n and more) once for each probe: key, and indexed for the line's own segments.

    One short expression on exploded constants: written out for each probe, the generated method
    would be too long for the JVM to compile.
    """
    parts = edits + 1
    rows = lines.select("*", F.explode(probes(edits)).alias("p")).select(*lines.columns, "p.*")
    # The last n % parts segments are one longer; start counts from 1.
    start = f"1 + ((n - less) div {parts}) * (k - 1) + greatest(0, (n - less) % {parts} - ({parts} - (k - 1))) + shift"
    size = f"(n - less) div {parts} + if({parts} - k < (n - less) % {parts}, 1, 0)"
    rows = rows.withColumns({"_at": F.expr(f"cast({start} as int)"), "_size": F.expr(f"cast({size} as int)")}).where("_at >= 1 and _at + _size - 1 <= n")
    key = F.expr("xxhash64(n - less, k, substring(line, _at, _size))")
    return rows.select(*lines.columns, key.alias("key"), F.expr("less = 0 and shift = 0").alias("indexed"))


def let(name: str, value: str, body: str) -> str:
    """body with name standing for value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def common_head(a: str, b: str, size: str, times: int) -> str:
    """How many characters a and b begin with in common, counted in blocks of a size, the first so many of them."""
    return f"aggregate(sequence(0, {times - 1}), 0, (p, k) -> if(p = k * {size} and substring({a}, p + 1, {size}) = substring({b}, p + 1, {size}), p + {size}, p))"


def without_head(a: str, b: str, edits: int) -> str:
    """struct(a, b) without what both begin with, in blocks and then in finer ones; more than edits characters of each are left."""
    cut = lambda p: let("c", f"least({p}, x.n) + 1", "named_struct('a', substring(x.a, c), 'b', substring(x.b, c), 's', x.s)")
    room = f"greatest(0, least(char_length(y.a), char_length(y.b)) - {edits + 1})"
    held = lambda value, body: let("y", value, let("x", f"named_struct('a', y.a, 'b', y.b, 'n', {room}, 's', y.s)", body))
    first = f"named_struct('a', {a}, 'b', {b}, 's', cast(greatest({BLOCK}, char_length({a}) div {2 * BLOCK} + 1) AS int))"
    coarse = held(first, cut(common_head("x.a", "x.b", "x.s", 2 * BLOCK)))
    return held(coarse, cut(common_head("x.a", "x.b", f"cast(x.s div {BLOCK} AS int)", BLOCK)))


def within(a: str, b: str, edits: int) -> Column:
    """The edit distance of a and b is at most edits; both are longer than that, and their lengths differ by no more.

    What both begin and end with goes; the rest's beginning is compared before all of it.
    """
    middle = let("t", without_head(a, b, edits), without_head("reverse(t.a)", "reverse(t.b)", edits))
    head = lambda c, n: f"substring({c}, greatest(1, char_length({c}) - {n - 1}))"  # noqa: E731  # reversed, so the end of what is left
    start = distance("m.ha", "m.hb", edits, whole=False)
    return F.expr(let("z", middle, let("m", f"named_struct('a', z.a, 'b', z.b, 'ha', reverse({head('z.a', HEAD)}), 'hb', reverse({head('z.b', HEAD + edits)}))", f"{start} <= {edits} and {distance('m.a', 'm.b', edits)} <= {edits}")))


def edit_distance(a: str, b: str, edits: int) -> Column:
    """The edit distance of two columns if it is at most edits, else a larger number; both are longer than edits."""
    return F.expr(distance(a, b, edits))


def distance(a: str, b: str, edits: int, whole: bool = True) -> str:
    """edit_distance as SQL; with whole=False the least distance of a and a beginning of b, of those the band reaches.

    One bit for each diagonal of the band; a step for each character of b. vp and vn are the bits
    where the column above rises and falls; the distance d is followed down the lowest diagonal
    to the last row of a, then along that row, where least is the smallest so far.
    """
    top, mask = 2 * edits, (1 << (2 * edits + 1)) - 1
    same = " | ".join(f"if(get(w.ca, j - {edits} + {k} - 1) = get(w.cb, j - 1), {1 << k}L, 0L)" for k in range(top + 1))
    down = f"j <= size(w.ca) - {edits}"
    along = f"{top} - (j - (size(w.ca) - {edits}))"
    d = f"s.d + if({down}, 1 - cast(shiftright(d0, {top}) & 1L AS int), cast((shiftright(hp, {along}) & 1L) - (shiftright(d0 & s.vp, {along}) & 1L) AS int))"
    step = f"named_struct('vp', ((d0 & s.vp) | ~(shiftright(d0, 1) | hp)) & {mask}L, 'vn', shiftright(d0, 1) & hp, 'd', {d}, 'least', s.least)"
    kept = let("r", let("hp", f"(s.vn | ~(d0 | s.vp)) & {mask}L", step), f"named_struct('vp', r.vp, 'vn', r.vn, 'd', r.d, 'least', if(j >= size(w.ca) - {edits}, least(s.least, r.d), s.least))")
    moved = let("eq", f"({same})", let("d0", f"((((eq & s.vp) + s.vp) ^ s.vp) | eq | s.vn) & {mask}L", kept))
    start = f"named_struct('vp', {((1 << (edits + 1)) - 1) << edits}L, 'vn', 0L, 'd', {edits}, 'least', if(size(w.ca) <= {edits}, size(w.ca), {1 << 30}))"
    return let("w", f"struct(split({a}, '') AS ca, split({b}, '') AS cb)", f"aggregate(sequence(1, size(w.cb)), {start}, (s, j) -> {moved}, s -> s.{'d' if whole else 'least'})")


def few(rows: DataFrame) -> DataFrame:
    """rows, marked for broadcast if there are few enough."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def line_classes(docs: DataFrame, folder: str, edits: int = EDITS, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """Lines that are repeated within few edits: a row per line of a class with at least two lines.

    docs: doc_id, text; other columns are not read. Returns doc_id, line_no (from 0), kept_doc_id, kept_line_no
    (the class's earliest line, which names the class) and links (other texts within the edits).
    Lines of fewer than min_chars characters take part with short=True only, as exact repeats without links; empty lines
    take no part, nor do null texts and rows with a null doc_id; repeated rows of a
    doc_id count as one document. Lines of any length are compared whole; ties in length or place do not arise, as a
    class's earliest line has one doc_id and number. Empty tables give no rows.
    """
    if min_chars <= edits:
        raise ValueError("min_chars must be greater than edits")
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    split = F.split("text", "\n", -1)
    lines = docs.select("doc_id", F.posexplode_outer(split).alias("line_no", "line")).withColumns({"n": F.char_length("line"), "id": F.xxhash64("line")})
    # A line is named by two hashes; candidates are found by the first.
    digest = F.struct("id", F.xxhash64(F.lit(1), "line").alias("other")).alias("digest")
    places = cut(lines.where(F.col("n") >= (1 if short else min_chars)).select("doc_id", "line_no", digest), f"{folder}/places")

    held = cut(with_keys(lines.where(F.col("n") >= min_chars).select("id", "line", "n"), edits).select("key", "id", "indexed"), f"{folder}/segments")
    shared = held.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    shared = cut(shared, f"{folder}/keys")
    met = cut(held.join(few(shared), "key").select("key", "id", "indexed").distinct(), f"{folder}/met")
    for read in ("segments", "keys"):
        drop(docs.sparkSession, f"{folder}/{read}")
    # Candidates' texts, from one place of each.
    spots = places.join(few(met.select("id").distinct().withColumnRenamed("id", "of")), F.col("digest.id") == F.col("of")).groupBy("digest").agg(F.min(F.struct("doc_id", "line_no")).alias("at"))
    spots = few(cut(spots.select("digest", "at.doc_id", "at.line_no"), f"{folder}/spots"))
    texts = docs.join(spots, "doc_id").select("digest", F.get(split, F.col("line_no")).alias("line"))
    texts = cut(texts.where(F.xxhash64("line") == F.col("digest.id")).withColumn("n", F.char_length("line")).dropDuplicates(["digest"]), f"{folder}/texts")
    met = met.join(texts, F.col("id") == F.col("digest.id")).select("key", "indexed", "digest", "line", "n")
    index = met.where("indexed").select("key", F.col("digest").alias("a"), F.col("line").alias("la"), F.col("n").alias("na"))
    probe = met.select("key", F.col("digest").alias("b"), F.col("line").alias("lb"), F.col("n").alias("nb"), "indexed")
    near = index.join(probe, "key").where("a <> b and (not indexed or a < b) and abs(na - nb) <= " + str(edits))
    near = near.where(within("la", "lb", edits))
    links = cut(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{folder}/links")

    classes = components(links, f"{folder}/classes").select(F.col("node").alias("digest"), F.col("component").alias("class"))
    degrees = links.select(F.col("a").alias("digest")).union(links.select("b")).groupBy("digest").agg(F.count("*").alias("links"))
    texts_of = places.groupBy("digest").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("times"))
    texts_of = texts_of.join(classes, "digest", "left").join(degrees, "digest", "left").withColumn("class", F.coalesce("class", "digest"))
    texts_of = cut(texts_of.where("times > 1 or links is not null"), f"{folder}/distinct")
    kept = texts_of.groupBy("class").agg(F.min("first").alias("kept"))
    named = texts_of.join(kept, "class").select("digest", "kept", F.coalesce("links", F.lit(0)).alias("links"))
    return places.join(named, "digest").select("doc_id", "line_no", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no"), "links").distinct()


def keep_first_lines(docs: DataFrame, folder: str, edits: int = EDITS, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """docs with every line of a class but its earliest taken out of text; other columns stay, and n_chars, if there, follows.

    A document that loses all its lines goes; other rows stay, those without text or doc_id too. Rows
    of one doc_id lose the lines of the same numbers. Empty tables give no rows; texts of any length are read whole.
    """
    gone, kept = (fresh_name(x, docs.columns) for x in ("gone", "kept"))
    found = line_classes(docs, folder, edits, min_chars, short).where("doc_id <> kept_doc_id or line_no <> kept_line_no")
    found = found.groupBy("doc_id").agg(F.collect_set("line_no").alias(gone))
    left = F.filter(F.split("text", "\n", -1), lambda _, k: ~F.array_contains(F.col(gone), k))
    out = docs.join(found, "doc_id", "left").withColumn(kept, F.when(F.col(gone).isNotNull(), left))
    out = out.where(F.col(kept).isNull() | (F.size(kept) > 0)).withColumn("text", F.when(F.col(kept).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
