"""Ranked search: local alignment of all sequences, sensitivity up to the first false positive, curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldline.functions import hierarchy
from foldline.operators.ranks import numbered
from foldline.sources.scratch import cut, shared_folder

GAP_OPEN, GAP_EXTEND, LEAST_SCORE = 8, 2, 50
#: What the seeds' sensitivities (family, superfamily, fold) are divided by.
NORMALISERS = (0.928162, 0.662063, 0.275436)
#: Queries, and targets, that meet in a task, at most, and letters of each as if they had so many.
BLOCK, TARGETS, LENGTH = 256, 4096, 128
#: Vectors on each side of a block.
VECTORS = 1024
#: Tasks that the pairs of blocks are dealt to, at most.
PARTITIONS = 4096
#: Ids of one text that travel together, about.
LOT = 4096
#: Letters of the targets that a query is aligned with at once.
CELLS = 2**18


def smith_waterman(a: np.ndarray, b: np.ndarray, matrix: np.ndarray, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND) -> int:
    """Best local alignment score with affine gaps (a gap of n costs gap_open + (n - 1) gap_extend), one row at a time."""
    n = len(b)
    if not len(a) or not n:
        return 0
    above, down = np.zeros(n + 1, np.int64), np.full(n + 1, -(10**9), np.int64)
    step, best = np.arange(n + 1) * gap_extend, 0
    for letter in a:
        down[1:] = np.maximum(down[1:] - gap_extend, above[1:] - gap_open)
        row = np.zeros(n + 1, np.int64)
        row[1:] = np.maximum(0, np.maximum(above[:-1] + matrix[letter, b], down[1:]))
        # A gap along the row: the best earlier cell, less what the gap costs; one pass of running maxima.
        reach = np.maximum.accumulate(row + step)
        row[1:] = np.maximum(row[1:], reach[:-1] - gap_open - step[1:] + gap_extend)
        above, best = row, max(best, int(row.max()))
    return best


class Lined:
    """Sequences side by side, which any query of at most a length is aligned with at once; gap costs are not negative.

    Cells of one antidiagonal do not need each other, so an antidiagonal of all sequences is one step. Scores are in their common
    unit and rise by a gap's extension from step to step, so that a gap costs nothing to carry on; they are brought back before
    they leave their range. Cells have the 8, 16 or 32 bits that no score can leave. Shorter sequences are filled up at
    the end with a letter that scores 0, so their best stays.
    """

    def __init__(self, many: list[np.ndarray], matrix: np.ndarray, longest: int, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND):
        n, matrix = max(map(len, many), default=0), np.asarray(matrix, dtype=np.int64)
        self.unit = max(1, int(np.gcd.reduce([gap_open, gap_extend, *np.abs(matrix).ravel()])))
        own, self.open, self.extend = matrix // self.unit, gap_open // self.unit, gap_extend // self.unit
        most = int(np.abs(own).max(initial=0))
        low, high = self.open + self.extend + most, (min(longest, n) + 1) * most + self.open + 3 * self.extend
        for self.form in (np.int8, np.int16, np.int32):
            room = np.iinfo(self.form)
            self.zero = int(room.min) + low
            if (spare := int(room.max) - self.zero - high) >= 8 * self.extend:
                break
        self.spare, self.negative = spare, bool((own < 0).any())
        b = np.full((n, len(many)), len(own))
        for k, one in enumerate(many):
            b[: len(one), k] = one
        # Score by letter, place and sequence, with what an antidiagonal and the one after it rise.
        self.cells = (np.concatenate([own, np.zeros((len(own), 1), np.int64)], axis=1) + 2 * self.extend).astype(self.form)[:, b]

    def scores(self, a: np.ndarray, some: np.ndarray | None = None) -> np.ndarray:
        """Best local alignment score of a with each sequence, or with some of them."""
        cells = self.cells if some is None else np.ascontiguousarray(self.cells[:, :, some])
        (_, n, m), rows, form, zero, extend = cells.shape, len(a), self.form, self.zero, self.extend
        if not rows or not n or not m:
            return np.zeros(m, np.int64)
        flat, starts, opening = cells.reshape(-1, m), np.asarray(a, dtype=np.int64) * n - np.arange(rows), form(self.open - extend)
        made = lambda k: np.full((k, m), zero, form)
        # Row i of an antidiagonal is at i + 1, after the edge; new, one and two: this antidiagonal and those before it.
        new, one, two, opened, down, below = (made(rows + 2) for _ in range(6))
        along, gain, best, high = made(rows), made(rows), np.full(m, zero, form), np.empty(m, form)
        two -= form(extend)
        rise = 0
        for d in range(rows + n - 1):
            first, last = max(0, d - n + 1), min(rows, d + 1)
            if rise + extend > self.spare:
                for held in (one, two, along[:last], down[1:]):
                    held -= form(rise)
                rise = 0
            rise += extend
            np.subtract(one[first : last + 1], opening, out=opened[first : last + 1])
            if d < rows:
                along[d] = zero
            own, across, under, up = new[first + 1 : last + 1], along[first:last], below[first + 1 : last + 1], gain[: last - first]
            np.maximum(across, opened[first + 1 : last + 1], out=across)
            np.maximum(down[first:last], opened[first:last], out=under)
            np.take(flat, starts[first:last] + d, axis=0, out=up, mode="clip")
            np.add(two[first:last], up, out=own)
            np.maximum(own, across, out=own)
            np.maximum(own, under, out=own)
            if self.negative:
                np.maximum(own, np.full(m, zero + rise, form), out=own)
            np.maximum.reduce(own, axis=0, out=high)
            np.subtract(high, form(rise), out=high)
            np.maximum(best, high, out=best)
            if not first:
                new[0] = zero + rise
            if last == d + 1:
                new[last + 1] = zero + rise
            new, one, two, down, below = two, new, one, below, down
        return (best.astype(np.int64) - zero) * self.unit

    def reach(self, a: np.ndarray, least: int) -> np.ndarray:
        """Of which sequences diagonal_bounds() is at least so much.

        It is a sum over diagonals, none of them below 0, so the long ones in the middle come first, and only sequences
        that these have not decided meet the others.
        """
        (_, n, m), rows = self.cells.shape, len(a)
        if not rows or not n or not m:
            return np.full(m, least <= 0)
        wide, twice = np.promote_types(self.form, np.int16), 2 * self.extend
        want = -(-least // self.unit) - self.open
        found, rest, cells, total = np.full(m, want <= 0), np.arange(m), self.cells, np.zeros(m, np.int64)
        edges = sorted({1 - rows, n, *range(1, n, 16), *range(0, 1 - rows, -16)})
        for start, stop in sorted(zip(edges, edges[1:]), key=lambda band: min(map(abs, band))):
            if len(left := np.flatnonzero(total < want)) < len(rest):
                found[rest[total >= want]] = True
                rest, total = rest[left], total[left]
                if not len(rest):
                    break
                cells = np.ascontiguousarray(cells[:, :, left])
            # On each diagonal: the best inside a stretch, and the best outside of one.
            inside, outside = np.full((stop - start, len(rest)), -self.open, wide), np.zeros((stop - start, len(rest)), wide)
            for i in range(max(0, 1 - stop), min(rows, n - start)):
                some = slice(max(0, -i - start), min(stop, n - i) - start)
                stretch = np.maximum(inside[some], outside[some] - wide.type(self.open)) - wide.type(twice)
                np.maximum(outside[some], inside[some], out=outside[some])
                np.add(stretch, cells[a[i], i + start + some.start : i + start + some.stop], out=inside[some])
            total += np.maximum(inside, outside).sum(0, dtype=np.int64)
        found[rest[total >= want]] = True
        return found


def smith_waterman_many(a: np.ndarray, many: list[np.ndarray], matrix: np.ndarray, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND) -> np.ndarray:
    """smith_waterman of a and each of many, an antidiagonal of all of them at a time."""
    return Lined(many, matrix, len(a), gap_open, gap_extend).scores(a)


def count_bounds(a: np.ndarray, b: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """For each pair of rows of letters' counts, a score that no local alignment of such sequences exceeds.

    Every aligned pair of letters is paid for by the first letter, by the second, or half by each, at the best score that
    it has with a letter that the other sequence holds; gaps only cost.
    """
    gain = np.maximum(matrix, 0)
    best = lambda there, cells: np.stack([np.where(there, cells[k], 0).max(1, initial=0) for k in range(len(cells))], axis=1)
    half = np.maximum(gain.max(1, initial=0), gain.max(0, initial=0)) / 2
    return np.minimum(np.minimum(a @ best(b > 0, gain).T, best(a > 0, gain.T) @ b.T), (a @ half)[:, None] + (b @ half)[None, :])


def diagonal_bounds(a: np.ndarray, many: list[np.ndarray], matrix: np.ndarray, gap_open: int = GAP_OPEN) -> np.ndarray:
    """For a and each of many, a score that no local alignment with gaps of at least gap_open exceeds.

    An alignment is stretches of diagonals with gaps between them, so it scores at most gap_open more than what all
    diagonals give together if each stretch pays for a gap; a row of all of many at a time. Lined.reach() stops where it is large enough.
    """
    m, n = len(many), max(map(len, many), default=0)
    if not len(a) or not n:
        return np.zeros(m, np.int64)
    b = np.full((n, m), len(matrix))
    for k, one in enumerate(many):
        b[: len(one), k] = one
    scores = np.concatenate([matrix, np.full((len(matrix), 1), -(10**6))], axis=1)
    # On the diagonal that ends at each place of b: the best inside a stretch, and the best outside of one.
    inside, outside, total = np.full((n, m), -(10**9)), np.zeros((n, m), np.int64), np.zeros(m, np.int64)
    for letter in a:
        stretch, out = np.maximum(inside, outside - gap_open), np.maximum(inside, outside)
        total += out[-1]  # this diagonal has left b
        inside[1:], outside[1:] = stretch[:-1], out[:-1]
        inside[0], outside[0] = -gap_open, 0
        inside += scores[letter][b]
    return total + np.maximum(inside, outside).sum(0) + gap_open


def alike(sequences: DataFrame, folder: str | None = None) -> DataFrame:
    """sid, seq, sids: sequences (sid, seq) with one text under the first of their ids, in lots of about LOT ids; written below folder.

    A text of very many ids has several lots, by a hash of the id, so that no group grows with its copies.
    """
    lots = F.pmod(F.xxhash64("sid"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / LOT)))
    sizes = sequences.groupBy("seq").agg(F.count("*").alias("n")).where(F.col("n") > LOT)
    rows = sequences.select("sid", "seq").join(sizes, "seq", "left").select("sid", "seq", F.when(F.col("n").isNull(), 0).otherwise(lots).alias("lot"))
    found = rows.groupBy("seq", "lot").agg(F.array_sort(F.collect_list("sid")).alias("sids")).select(F.get("sids", F.lit(0)).alias("sid"), "seq", "sids")
    return cut(found, folder or shared_folder(sequences.sparkSession, "alike"))


def _met(sequences: DataFrame, queries: DataFrame, letters: str, matrix: np.ndarray, least: int, counting: bool = False, carried: bool = True) -> DataFrame:
    """Pairs of lots (of alike()) from a least score: queries, targets (both sides' ids) and score, or query, target and score if not carried.

    counting: rows without a target instead, with how many pairs of a lot's queries and a block's targets there are: query, queries, pairs, counted, aligned.
    """
    matrix = np.asarray(matrix)

    def able(rows: DataFrame, gain: np.ndarray) -> Column:
        """A sequence's letters, each at its best score, reach the least one."""
        length = lambda c: F.char_length("seq") - F.char_length(F.replace("seq", F.lit(c)))
        return sum((length(c) * int(gain[k]) for k, c in enumerate(letters)), F.lit(0)) >= least

    gain = np.maximum(matrix, 0)
    ids = F.col("sids") if carried else F.lit(None).cast("array<string>")
    asked, held = (rows.select("sid", "seq", ids.alias("sids"), F.size("sids").alias("times"), able(rows, g).alias("able")) for rows, g in ((queries, gain.max(1)), (sequences, gain.max(0))))
    sizes = [rows.agg(F.count("*"), *(F.coalesce(F.sum(c), F.lit(0)) for c in (F.size("sids"), F.char_length("seq")))).first() for rows in (queries, sequences)]
    # Texts of many ids make many rows of few alignments, and long ones long alignments: then blocks are smaller, so that more tasks make them.
    blocks = lambda size, most: max(1, -(-size[0] // most), min(size[0], max(-(-size[1] // (16 * BLOCK)), -(-size[2] // (most * LENGTH)))))
    nx, ny = blocks(sizes[0], BLOCK), blocks(sizes[1], TARGETS)
    at = lambda n: F.pmod(F.xxhash64("sid"), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.select(F.col("sid").alias("q"), F.when(F.col("able"), F.col("seq")).alias("qs"), F.col("sids").alias("queries"), at(nx).alias("x"), every(ny).alias("y"))
    right = held.select(F.col("sid").alias("t"), F.when(F.col("able"), F.col("seq")).alias("ts"), F.col("sids").alias("targets"), "times", every(nx).alias("x"), at(ny).alias("y"))

    def kernel(one: pa.Table, two: pa.Table) -> pa.Table:
        known = sorted((ord(c), k) for k, c in enumerate(letters))
        points, codes = (np.array(v, np.int64) for v in zip(*known))

        def read(text: str) -> np.ndarray:
            found = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            place = np.minimum(np.searchsorted(points, found), len(points) - 1)
            return codes[place[points[place] == found]]

        def able(rows: pa.Table, name: str) -> list[tuple[int, np.ndarray]]:
            return [(k, read(s)) for k, s in enumerate(rows[name].to_pylist()) if s is not None]

        counts = lambda rows: np.array([np.bincount(s, minlength=len(matrix)) for _, s in rows], np.int64).reshape(len(rows), len(matrix))
        asked, held = able(one, "qs"), sorted(able(two, "ts"), key=lambda x: len(x[1]))
        places, longest = np.array([k for k, _ in held], np.int64), max((len(s) for _, s in asked), default=0)
        times = two["times"].to_numpy().astype(np.int64)
        hopeful = count_bounds(counts(asked), counts(held), matrix) >= least
        counted, aligned = (np.zeros(len(one), np.int64) for _ in range(2))
        out, start = [], 0
        while start < len(held):
            stop = start + 1
            while stop < len(held) and (stop + 1 - start) * len(held[stop][1]) <= CELLS:
                stop += 1
            # Its targets side by side serve all queries.
            lined = Lined([s for _, s in held[start:stop]], matrix, longest)
            for n, (q, s) in enumerate(asked):
                hope = hopeful[n, start:stop]
                if not hope.any():
                    continue
                kept = np.flatnonzero(hope & lined.reach(s, least))
                if counting:
                    counted[q] += times[places[start:stop][hope]].sum()
                    aligned[q] += times[places[start:stop][kept]].sum()
                elif len(kept):
                    score = lined.scores(s)[kept] if 2 * len(kept) > len(hope) else lined.scores(s, kept)
                    good = score >= least
                    out.append((np.full(int(good.sum()), q), places[start:stop][kept[good]], score[good]))
            start = stop
        if counting:
            return pa.table({"query": one["q"], "queries": one["queries"], "pairs": np.full(len(one), times.sum()), "counted": counted, "aligned": aligned})
        q, t, score = (np.concatenate([rows[k] for rows in out] or [np.empty(0, np.int64)]) for k in range(3))
        names = ("queries", "targets") if carried else ("query", "target")
        return pa.table(dict(zip((*names, "score"), (one["queries" if carried else "q"].take(q), two["targets" if carried else "t"].take(t), score))))

    # The rows are few and the work is not: a stated number of partitions is not merged into one, and most have one block at most.
    dealt = lambda df: df.repartition(min(4 * nx * ny, PARTITIONS), "x", "y").groupBy("x", "y")
    ids = "queries array<string>, targets array<string>, score long" if carried else "query string, target string, score long"
    form = "query string, queries array<string>, pairs long, counted long, aligned long" if counting else ids
    return dealt(left.toDF(*left.columns)).cogroup(dealt(right.toDF(*right.columns))).applyInArrow(kernel, form)


def _lots(sequences: DataFrame, queries: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    held = alike(sequences)
    return held, held if queries is None else alike(queries)


def all_against_all(sequences: DataFrame, letters: str, matrix: np.ndarray, least: int = LEAST_SCORE, queries: DataFrame | None = None) -> DataFrame:
    """query, target, score of all pairs from a least score: blocks of queries against blocks of targets.

    sequences and queries (by default all sequences): sid, seq. Every different query meets every different target, which is what this
    search is; sequences of one text are aligned once, and only the rows that come out are theirs. Neither
    side is collected, and a task holds one block of each. Only pairs that neither of two bounds, from the letters' counts and
    from the diagonals, keeps below the least score are aligned; sequences that can reach it with nothing travel without their letters.
    """
    held, asked = _lots(sequences, queries)
    rows = _met(held, asked, letters, matrix, least)
    return rows.select(F.explode("queries").alias("query"), "targets", "score").select("query", F.explode("targets").alias("target"), "score")


def all_texts_against_all(sequences: DataFrame, letters: str, matrix: np.ndarray, least: int = LEAST_SCORE, queries: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """all_against_all() without a row for each pair of copies: query, target, score of lots, and the lots' members (of, sid) among queries and targets."""
    held, asked = _lots(sequences, queries)
    members = lambda rows: rows.select(F.col("sid").alias("of"), F.explode("sids").alias("sid"))
    return _met(held, asked, letters, matrix, least, carried=False), members(asked), members(held)


def screening(sequences: DataFrame, letters: str, matrix: np.ndarray, least: int = LEAST_SCORE, queries: DataFrame | None = None) -> DataFrame:
    """query, pairs (with all targets), counted (those that the letters' counts leave) and aligned (those that both bounds leave) of all_against_all()."""
    held, asked = _lots(sequences, queries)
    rows = _met(held, asked, letters, matrix, least, counting=True).groupBy("query").agg(F.first("queries").alias("queries"), *(F.sum(c).alias(c) for c in ("pairs", "counted", "aligned")))
    return rows.select(F.explode("queries").alias("query"), "pairs", "counted", "aligned")


def class_sizes(lookup: DataFrame) -> DataFrame:
    """sid, fam, sfam, fold and the number of ids in each; ids without a class count together.

    One rollup, combined before its shuffle, gives the sizes of all levels; there is a row of them for each class, and ids meet theirs by a join.
    """
    rows = lookup.select("sid", F.col("class").alias("fam"), hierarchy.parent("class").alias("sfam")).withColumn("fold", hierarchy.parent("sfam"))
    sizes = rows.rollup("fold", "sfam", "fam").agg(F.count("*").alias("n"), F.grouping_id().alias("without"))
    at = lambda name, without: sizes.where(F.col("without") == without).select(F.col(name).alias(f"_{name}"), F.col("n").alias(f"{name}_count"))
    fams = sizes.where("without = 0").select(F.col("fam").alias("_of"), F.col("sfam").alias("_in"), F.col("fold").alias("_within"), F.col("n").alias("fam_count"))
    fams = fams.join(at("sfam", 1), F.col("_in").eqNullSafe(F.col("_sfam"))).join(at("fold", 3), F.col("_within").eqNullSafe(F.col("_fold")))
    return rows.join(fams, F.col("fam").eqNullSafe(F.col("_of"))).select("sid", "fam", "sfam", "fold", "fam_count", "sfam_count", "fold_count")


def first_fp_hits(hits: DataFrame, lookup: DataFrame, queries: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """query and its hits in family, superfamily and fold before the first hit of another fold, and fp (0 or 1), for known ids.

    hits: query, target, score, each pair once. With queries and targets (of, sid) a hit is between any member of its query and of
    its target; each sid has one `of`. Hits come by falling score, then by target. No query's hits are sorted: the first of another fold is a
    minimum, for all queries of one fold under one name together, and what stands before it is counted.
    """
    sizes, counts = class_sizes(lookup), ["fam_count", "sfam_count", "fold_count"]
    itself = lambda c: hits.select(F.col(c).alias("of"), F.col(c).alias("sid")).distinct()
    named = lambda rows, p, more: rows.join(sizes, "sid").select(F.col("of").alias(f"{p}_of"), F.col("sid").alias(f"{p}_sid"), *(F.col(c).alias(f"{p}_{c}") for c in ("fam", "sfam", "fold")), *more)
    asked, held = named(itself("query") if queries is None else queries, "q", counts), named(itself("target") if targets is None else targets, "t", [])
    groups = asked.select("q_of", "q_fold").distinct()
    by_fold = held.groupBy("t_of", "t_fold").agg(F.min("t_sid").alias("t_sid"))
    pairs = hits.select(F.col("query").alias("q_of"), F.col("target").alias("t_of"), "score")
    met = pairs.join(by_fold, "t_of").join(groups, "q_of")
    wrong = F.coalesce(F.col("q_fold") != F.col("t_fold"), F.lit(False))
    ends = met.groupBy("q_of", "q_fold").agg(F.max(F.when(wrong, F.col("score"))).alias("end")).select(F.col("q_of").alias("e_of"), F.col("q_fold").alias("e_fold"), "end")
    group = (F.col("q_of") == F.col("e_of")) & F.col("q_fold").eqNullSafe(F.col("e_fold"))
    # Of the hits at that score, the first by target.
    last = met.join(ends, group & (F.col("score") == F.col("end"))).where(wrong).groupBy("e_of", "e_fold").agg(F.min("t_sid").alias("stop"))
    last = ends.join(last.select(F.col("e_of").alias("l_of"), F.col("e_fold").alias("l_fold"), "stop"), (F.col("e_of") == F.col("l_of")) & F.col("e_fold").eqNullSafe(F.col("l_fold")), "left").drop("l_of", "l_fold")
    before = met.where("q_fold = t_fold").drop("t_sid").join(last, group & (F.col("end").isNull() | (F.col("score") >= F.col("end"))))
    before = before.select("q_of", "t_of", F.col("q_fold").alias("fold"), "score", "end", "stop").join(held.select("t_of", "t_sid", "t_fam", "t_sfam", F.col("t_fold").alias("fold")), ["t_of", "fold"])
    before = before.where("end is null or score > end or t_sid < stop").groupBy("q_of", "fold", "t_sfam", "t_fam").agg(F.count("*").alias("n"))
    rows = asked.join(last, group).join(before.select(F.col("q_of").alias("b_of"), F.col("fold").alias("b_fold"), "t_sfam", "t_fam", "n"), (F.col("q_of") == F.col("b_of")) & (F.col("q_fold") == F.col("b_fold")), "left")
    same = lambda c: F.col(f"q_{c}") == F.col(f"t_{c}")
    hit = lambda of: F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0).cast("long"))
    return rows.groupBy(F.col("q_sid").alias("query"), *counts).agg(
        hit(same("fam")).alias("fam_hits"), hit(same("sfam") & ~same("fam")).alias("sfam_hits"), hit(~same("sfam")).alias("fold_hits"),
        F.max(F.col("end").isNotNull().cast("int")).alias("fp"),
    )


def first_fp_hits_of_vectors(queries: DataFrame, targets: DataFrame, digits: int) -> DataFrame:
    """first_fp_hits of vectors by rounded dot products, without a row for each pair.

    queries and targets: sid, vec, class (of four parts); class sizes are those of the targets, and the queries
    are among them. Blocks of queries meet blocks of targets twice: for the first target of another
    fold, a row per query and block, and for the counts of what stands before it.
    """
    sizes = class_sizes(targets.select("sid", "class"))
    counts = ["fam_count", "sfam_count", "fold_count"]
    held = targets.select("sid", "vec").join(sizes.select("sid", "fam", "sfam", "fold"), "sid")
    asked = queries.select("sid", "vec").join(sizes, "sid")
    nx, ny = (max(1, -(-df.count() // VECTORS)) for df in (queries, targets))
    at = lambda n: F.pmod(F.xxhash64("sid"), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # toDF gives columns of their own, as both sides may come from one table.
    dealt = lambda df: df.toDF(*df.columns).repartition(min(nx * ny, PARTITIONS), "x", "y").groupBy("x", "y")
    right = dealt(held.select("*", at(ny).alias("y")).select("*", every(nx).alias("x")))
    left = lambda df: dealt(df.select("*", at(nx).alias("x")).select("*", every(ny).alias("y")))

    def met(one: pd.DataFrame, two: pd.DataFrame):
        """The block's scores, targets in order of their ids, and which are of one family, superfamily and fold."""
        two = two.sort_values("sid", kind="stable", ignore_index=True)
        x, y = (np.stack(list(df["vec"])).astype(np.float64) for df in (one, two))
        score = np.multiply.outer(x[:, 0], y[:, 0])
        for k in range(1, x.shape[1]):  # component by component: the same sums in every block
            score += np.multiply.outer(x[:, k], y[:, k])
        same = {}
        for c in ("fam", "sfam", "fold"):
            codes = pd.factorize(pd.concat([one[c], two[c]]))[0]
            same[c] = codes[: len(one), None] == codes[None, len(one) :]
        return two["sid"].to_numpy(), np.round(score, digits), same

    def first(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"sid": [], "score": [], "target": []})
        ids, score, same = met(one, two)
        score[same["fold"]] = -np.inf
        best = score.argmax(axis=1)
        out = pd.DataFrame({"sid": one["sid"], "score": score[np.arange(len(one)), best], "target": ids[best]})
        return out[~same["fold"].all(axis=1)]

    def before(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"sid": [], "f1": [], "f2": [], "f3": []})
        ids, score, same = met(one, two)
        end = one["score"].fillna(-np.inf).to_numpy()[:, None]
        place = np.searchsorted(ids.astype(str), one["target"].fillna("").to_numpy().astype(str))
        good = (score > end) | ((score == end) & (np.arange(len(ids))[None, :] < place[:, None]))
        fam, sfam, fold = (good & same[c] for c in ("fam", "sfam", "fold"))
        return pd.DataFrame({"sid": one["sid"], "f1": fam.sum(1), "f2": (sfam & ~fam).sum(1), "f3": (fold & ~sfam).sum(1)})

    ends = left(asked).cogroup(right).applyInPandas(first, "sid string, score double, target string")
    # The first: the highest score, ties to the smallest target.
    ends = ends.groupBy("sid").agg(F.min(F.struct((-F.col("score")).alias("s"), "target")).alias("e")).select("sid", (-F.col("e.s")).alias("score"), "e.target")
    rows = asked.join(ends, "sid", "left")
    found = left(rows).cogroup(right).applyInPandas(before, "sid string, f1 long, f2 long, f3 long")
    found = found.groupBy("sid").agg(*(F.sum(f"f{k}").alias(f"{c}_hits") for k, c in enumerate(("fam", "sfam", "fold"), 1)))
    fp = rows.select("sid", *counts, F.col("target").isNotNull().cast("int").alias("fp"))
    return fp.join(found, "sid").select(F.col("sid").alias("query"), *counts, "fam_hits", "sfam_hits", "fold_hits", "fp")


def sensitivity(hits: DataFrame, lookup: DataFrame) -> DataFrame:
    """query, fam, sfam, fold, fp: shares found, of queries whose superfamily has another family and whose fold has another superfamily."""
    return shares(first_fp_hits(hits, lookup))


def shares(found: DataFrame) -> DataFrame:
    """sensitivity of the rows that first_fp_hits gives."""
    rows = found.where("sfam_count > fam_count and fold_count > sfam_count")
    share = lambda a, b: F.col(a).cast("double") / b
    return rows.select("query", share("fam_hits", F.col("fam_count")).alias("fam"), share("sfam_hits", F.col("sfam_count") - F.col("fam_count")).alias("sfam"), share("fold_hits", F.col("fold_count") - F.col("sfam_count")).alias("fold"), "fp")


def mean_sensitivity(rows: DataFrame, with_header: bool = False) -> DataFrame:
    """Means over queries; with_header=True divides by one more, as a count of lines with the header does."""
    n = F.count("*") + (1 if with_header else 0)
    return rows.agg(*(F.try_divide(F.sum(c), n).alias(c) for c in ("fam", "sfam", "fold")))


def seed_score(fam: Column, sfam: Column, fold: Column) -> Column:
    """A seed's mean ratio to the fixed normalisers."""
    return (fam / NORMALISERS[0] + sfam / NORMALISERS[1] + fold / NORMALISERS[2]) / 3


def best_seed(runs: DataFrame) -> DataFrame:
    """The run (seed, fam, sfam, fold) of the highest score, compared as numbers; ties to the smaller seed."""
    return runs.withColumn("score", seed_score(F.col("fam"), F.col("sfam"), F.col("fold"))).orderBy(F.desc("score"), "seed").limit(1)


def curve(rows: DataFrame, column: str, key: str = "query", folder: str | None = None) -> DataFrame:
    """Points of the empirical curve: share of queries (x) with at least so much (y, at most 1). Ranks come from ranges, by any number of tasks."""
    ranked = numbered(rows.select(key, F.col(column).alias("v")), [F.desc("v"), F.col(key)], folder or shared_folder(rows.sparkSession, "curve"), "place")
    rank = (F.col("place") + 1).cast("int")
    return ranked.crossJoin(F.broadcast(ranked.agg(F.count("*").alias("n")))).select(rank.alias("rank"), (rank / F.col("n")).alias("x"), F.least("v", F.lit(1.0)).alias("y"))


def fold_curves(points: DataFrame, weights: DataFrame, steps: int = 100) -> DataFrame:
    """x, mean and std over folds of curves (fold_id, x, y), each read off at the same x by linear interpolation; the mean by fold weight."""
    order = Window.partitionBy("fold_id").orderBy("x")
    spans = points.withColumns({"x1": F.lead("x").over(order), "y1": F.lead("y").over(order)})
    grid = points.sparkSession.range(1, steps + 1).select((F.col("id") / steps).alias("g"))
    met = spans.join(F.broadcast(grid), (F.col("g") >= F.col("x")) & ((F.col("g") < F.col("x1")) | (F.col("x1").isNull() & (F.col("g") >= F.col("x")))))
    at = met.select("fold_id", "g", F.coalesce(F.col("y") + F.try_divide((F.col("y1") - F.col("y")) * (F.col("g") - F.col("x")), F.col("x1") - F.col("x")), F.col("y")).alias("v"))
    return at.join(F.broadcast(weights), "fold_id").groupBy(F.col("g").alias("x")).agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("mean"), F.stddev_pop("v").alias("std"))
