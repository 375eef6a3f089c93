"""Set similarity join over word n-grams by a prefix tree.

Every document's distinct n-grams, as hashes, are its set. Equal sets are joined at once by their
digest; one document stands for each set. The join of the rest has two parts.

Candidates. Under one global order of n-grams (of their hashes) two sets with enough overlap share at least k of
the first |x| - ceil(t |x|) + k n-grams of each. Only these prefixes are shuffled, by n-gram. An
n-gram that no other prefix has links nothing and goes; a set with fewer than k others' n-grams left
in its prefix has no partner and goes. This repeats on what is left. Sets that share prefix n-grams
form candidate groups, found as connected components with one edge per set and n-gram, so that no
pairs are made within an n-gram's sets; the sets of a common n-gram are dealt to several places, whose
first sets are joined.

Tree. The whole sets of a group meet in one task (a large group is cut into bounded blocks, and each
two blocks whose sizes allow a link meet). N-grams are ordered by how many of the block's sets have
them, the most frequent first, and the sets are stored in a trie whose edges hold runs of n-grams. A
probe goes down level by level: each node's overlap with the probe is counted once for all sets
below it, and a subtree is left when its overlap so far plus what remains, of the probe and of the
longest set below, cannot reach the overlap needed. What is left at the leaves is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldline.llm.shared import components, cut, drop

#: Odd constants of the hash of words and n-grams.
_STEP, _MIX, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: N-grams of one block of a candidate group, which bounds a task's memory.
BLOCK = 1_000_000
#: Sets of a batch that make an n-gram common, and the places that a common n-gram's sets are dealt to.
COMMON, SHARES = 16, 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the step and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_STEP, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, A-Z in lower case; words end at blanks and 09-0D."""
    raw = _LOWER[np.frombuffer(text, np.uint8)]
    if not len(raw):
        return np.empty(0, np.uint64)
    edge = np.diff(np.concatenate(([True], _SPACE[raw], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power(len(raw))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up, dtype=np.uint64)))
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """The distinct n-grams as sorted hashes; with fewer words, the whole sequence as one."""
    words = word_hashes((text or "").encode())
    if not len(words):
        return words
    n = min(n, len(words))
    grams = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        grams = _mix(grams * _STEP + words[k : len(words) - n + 1 + k])
    return np.unique(grams)


def needed(x: int, y, percent: int):
    """The least overlap at which 100 * overlap >= percent * union."""
    return -(-percent * (x + y) // (100 + percent))


def prefix_share(size: int, percent: int) -> int:
    """k: how many n-grams two linked sets share in their prefixes; half of what a set may lack."""
    return max(1, size * (100 - percent) // 200)


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (the set's digest, null if empty), prefix (the first n-grams in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, first, second, prefixes = [], [], [], []
                for text in part.column(1):
                    grams = ngram_set(text.as_py(), n)
                    size = len(grams)
                    sizes.append(size)
                    digest = np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), np.int64)
                    first.append(int(digest[0]) if size else None)
                    second.append(int(digest[1]) if size else None)
                    keep = size - -(-percent * size // 100) + prefix_share(size, percent)
                    prefixes.append(grams[:keep].view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *prefixes])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists], ["doc_id", "n_shingles", "d1", "d2", "prefix"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, prefix array<long>")


class Tree:
    """A trie over sets given as lists of n-gram numbers in one order, its edges holding runs."""

    #: Longest run on one edge, so that a probe can leave a subtree early.
    RUN = 64

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">i8").tobytes())
        sizes = np.array([len(s) for s in sets])
        parents, runs, leaf, longest, level = [], [], [], [], []
        path: list[tuple[int, int]] = []  # open nodes: (node, depth at its end)
        before = np.empty(0, np.int64)
        for k in order:
            s = sets[k]
            m = min(len(s), len(before))
            differ = np.flatnonzero(s[:m] != before[:m])
            depth = int(differ[0]) if len(differ) else m
            while path and path[-1][1] > depth:
                path.pop()
            at = path[-1][1] if path else 0
            # The shared part below the last whole node is split off by repeating its run's head.
            while at < len(s) or not path:
                stop = min(len(s), at + self.RUN)
                if at < depth < stop:
                    stop = depth
                parents.append(path[-1][0] if path else -1)
                level.append(len(path))
                runs.append(s[at:stop])
                leaf.append(-1)
                longest.append(0)
                path.append((len(runs) - 1, stop))
                at = stop
            node = path[-1][0]
            if leaf[node] >= 0:  # the same end as another set: a node of its own
                parents.append(node)
                level.append(len(path))
                runs.append(s[:0])
                leaf.append(-1)
                longest.append(0)
                node = len(runs) - 1
            leaf[node] = k
            for open_node, _ in path:
                longest[open_node] = max(longest[open_node], len(s))
            longest[node] = max(longest[node], len(s))
            before = s
        self.leaf, self.sizes = np.array(leaf), sizes
        self.parent, self.longest = np.array(parents), np.array(longest)
        self.length = np.array([len(r) for r in runs])
        self.depth = np.zeros(len(runs), np.int64)
        for k, p in enumerate(parents):
            self.depth[k] = self.length[k] + (self.depth[p] if p >= 0 else 0)
        self.start = np.concatenate(([0], np.cumsum(self.length)))
        self.tokens = np.concatenate([np.empty(0, np.int64), *runs])
        # Children of each node, one after another.
        self.by_parent = np.argsort(self.parent, kind="stable")
        self.first_child = np.searchsorted(self.parent[self.by_parent], np.arange(-1, len(runs)))
        self.first_child = np.append(self.first_child, len(runs))
        self.levels = level

    def probe(self, own: np.ndarray, mark: np.ndarray, percent: int) -> np.ndarray:
        """The sets whose overlap with own (mark is true at its numbers) is enough."""
        found, size = [], len(own)
        nodes, base = self.by_parent[self.first_child[0] : self.first_child[1]], None
        while len(nodes):
            lengths = self.length[nodes]
            ends = np.cumsum(lengths)
            at = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + np.repeat(self.start[nodes], lengths)
            hits = np.concatenate(([0], np.cumsum(mark[self.tokens[at]])))
            overlap = hits[ends] - hits[ends - lengths]
            if base is not None:
                overlap += base
            # The longest set below bounds what remains; no set below needs less than one just long enough.
            longest = self.longest[nodes]
            least = -(-percent * size // 100)
            remaining = np.minimum(longest - self.depth[nodes], size - overlap)
            alive = (overlap + remaining >= least) & (longest >= least)
            ends_here = alive & (self.leaf[nodes] >= 0)
            sets = self.leaf[nodes[ends_here]]
            found.append(sets[overlap[ends_here] >= needed(size, self.sizes[sets], percent)])
            nodes, overlap = nodes[alive], overlap[alive]
            first, last = self.first_child[nodes + 1], self.first_child[nodes + 2]
            counts = last - first
            total = np.cumsum(counts)
            if not len(total) or not total[-1]:
                break
            at = np.arange(total[-1]) - np.repeat(total - counts, counts) + np.repeat(first, counts)
            nodes, base = self.by_parent[at], np.repeat(overlap, counts)
        return np.concatenate(found) if found else np.empty(0, np.int64)


def link_sets(sets: list[np.ndarray], side: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect whatever linked pairs connect; pairs within side 1 or within 2 are left to other tasks, unless there is one side.

    A set is dropped once fewer of its n-grams than a link needs occur elsewhere.
    """
    alive, links = list(range(len(sets))), []
    while True:
        if len(alive) < 2:
            return links
        grams, where, counts = np.unique(np.concatenate([sets[k] for k in alive]), return_inverse=True, return_counts=True)
        shared = np.concatenate(([0], np.cumsum(counts[where] > 1)))
        ends = np.cumsum([len(sets[k]) for k in alive])
        sizes = np.array([len(sets[k]) for k in alive])
        keep = shared[ends] - shared[ends - sizes] >= -(-percent * sizes // 100)
        if keep.all():
            break
        alive = [k for k, x in zip(alive, keep) if x]
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, -counts))] = np.arange(len(grams))
    own = [np.sort(rank[where[e - s : e]]) for e, s in zip(ends, sizes)]
    tree, mark = Tree(own), np.zeros(len(grams), bool)
    root = list(range(len(alive)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    apart, both = len(alive), len(set(side)) > 1
    for k, grams_of_k in enumerate(own):
        if apart == 1:
            break
        mark[grams_of_k] = True
        for j in tree.probe(grams_of_k, mark, percent).tolist():
            if j != k and not (both and side[alive[j]] == side[alive[k]]) and (a := find(k)) != (b := find(j)):
                root[a] = b
                apart -= 1
                links.append((alive[k], alive[j]))
        mark[grams_of_k] = False
    return links


GRAM = "rep long, least int, gram long, share int, bridge boolean"


def dealt(batches: Iterator[pa.RecordBatch], common: int, shares: int) -> Iterator[pa.RecordBatch]:
    """GRAM rows of (rep, least, prefix) rows: one per n-gram, and a mark (bridge) for each common one.

    An n-gram that many sets of a batch have is dealt to several places by rep, so that none holds them all; where it is not
    as common it has the place 0. A mark at place 0 says that there are other places; it stands for no set.
    """
    for batch in batches:
        lists = batch.column(2)
        n = np.diff(lists.offsets.to_numpy())
        rep, least = (np.repeat(batch.column(k).to_numpy(), n) for k in (0, 1))
        gram = lists.flatten().to_numpy()
        if not len(gram):
            continue
        _, where, counts = np.unique(gram, return_inverse=True, return_counts=True)
        own = (_mix(rep.view(np.uint64)) % np.uint64(shares)).astype(np.int32) + 1
        share = np.where(counts[where] > common, own, 0).astype(np.int32)
        hot = np.flatnonzero(share)
        _, first = np.unique(where[hot], return_index=True)
        more = hot[first]
        columns = [np.concatenate([c, c[more]]) for c in (rep, least, gram)]
        share, bridge = np.concatenate([share, np.zeros(len(more), np.int32)]), np.arange(len(gram) + len(more)) >= len(gram)
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(share), pa.array(bridge)], [c.split()[0] for c in GRAM.split(", ")])


def similarity_classes(docs: DataFrame, folder: str, n: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents that chains of links connect; two link at 100 * overlap >= percent * union.

    docs: doc_id, text; other columns are not read. folder: a shared folder for this run's tables.
    Returns a row per input row: doc_id, n_shingles (the set's size) and component_id (the smallest
    doc_id in the class). A null, empty or blank text has an empty set, which links with nothing.
    Rows with a null doc_id are returned with a null component_id and take no part; repeated
    rows of one doc_id are one document if their texts agree, and their classes join
    otherwise. Texts of any length are read whole; the smallest doc_id settles ties. An empty table gives no rows.
    """
    sigs = cut(signatures(docs, n, percent), f"{folder}/signatures")
    sets = sigs.where("d1 is not null and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("size"))
    sets = cut(sets, f"{folder}/sets")
    reps = sigs.join(sets.select("d1", "d2", "rep"), ["d1", "d2"]).where("doc_id = rep").dropDuplicates(["rep"]).select("rep", F.col("n_shingles").alias("size"), "prefix")

    # What a set must find of others' n-grams in its prefix: k for the smallest partner.
    least = F.greatest(F.lit(1), F.expr(f"((size * {percent} + 99) div 100) * {100 - percent} div 200")).cast("int").alias("least")
    grams = reps.select("rep", least, "prefix").mapInArrow(partial(dealt, common=COMMON, shares=SHARES), GRAM)
    for k in (1, 2):
        place = Window.partitionBy("gram", "share")
        grams = grams.withColumns({"sharing": F.count("*").over(place), "leader": F.min(F.when(~F.col("bridge"), F.col("rep"))).over(place), "dealt": (F.col("share") > 0) | F.max("bridge").over(place)})
        grams = cut(grams.where("sharing > 1 or dealt").drop("sharing"), f"{folder}/shared-{k}")
        if k == 2:
            drop(docs.sparkSession, f"{folder}/shared-1")
        enough = grams.where("not bridge").groupBy("rep").agg(F.count("*").alias("found"), F.first("least").alias("least")).where("found >= least").select("rep")
        grams = grams.where("not bridge").join(enough, "rep", "left_semi").unionByName(grams.where("bridge"))
    # A set is joined to the leader of its place, and the places' leaders, of sets that are left, to the least of their n-gram.
    held = grams.where("not bridge")
    places = held.where("dealt").groupBy("gram", "share").agg(F.min("leader").alias("leader"))
    least_leader = places.groupBy("gram").agg(F.min("leader").alias("a"))
    edges = held.select(F.col("leader").alias("a"), F.col("rep").alias("b")).union(places.join(least_leader, "gram").select("a", F.col("leader").alias("b")))
    groups = components(edges.distinct(), f"{folder}/groups")

    drop(docs.sparkSession, f"{folder}/shared-2")

    # A group is one block, or if it is large, classes of set size, each dealt to blocks of bounded size; sets of classes further apart than one cannot link.
    size_class = F.floor(F.log("size") / (math.log(100 / percent) * (1 + 1e-9))).cast("int") if percent < 100 else F.col("size").cast("int")
    members = groups.withColumnRenamed("node", "rep").join(sets.select("rep", "size").dropDuplicates(["rep"]), "rep")
    members = cut(members, f"{folder}/members")
    large = members.groupBy("component").agg(F.sum("size").alias("grams")).where(F.col("grams") > BLOCK).select("component", F.lit(True).alias("large"))
    members = members.join(large, "component", "left").withColumn("class", F.when(F.col("large"), size_class).otherwise(-1)).drop("large")
    blocks = members.groupBy("component", "class").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
    members = cut(members.join(blocks, ["component", "class"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("block", F.struct("class", "block")).drop("blocks", "class"), f"{folder}/dealt")
    spans = blocks.select("component", "class", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("n")).select("component", F.struct("class", F.col("n").alias("block")).alias("block"))
    meet = spans.alias("a").join(spans.alias("b"), (F.col("a.component") == F.col("b.component")) & (F.col("a.block") <= F.col("b.block")) & (F.col("b.block.class") - F.col("a.block.class") <= 1))
    meet = meet.select(F.col("a.component").alias("component"), F.col("a.block").alias("x"), F.col("b.block").alias("y"))
    sides = meet.select("component", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"), "x", "y")
    wanted = members.join(sides, ["component", "block"]).select("rep", "component", "x", "y", F.when(F.col("block") == F.col("x"), 1).otherwise(2).alias("side"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string")).join(members.select("rep").distinct(), "rep", "left_semi")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                grams = [ngram_set(t.as_py(), n).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(grams, pa.binary())], ["rep", "grams"])

    whole = texts.mapInArrow(shingle, "rep long, grams binary").dropDuplicates(["rep", "grams"])

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        reps = group["rep"].tolist()
        found = link_sets([np.frombuffer(g, np.uint64) for g in group["grams"]], group["side"].tolist(), percent)
        return pd.DataFrame({"a": [reps[i] for i, _ in found], "b": [reps[j] for _, j in found]}, dtype="int64")

    links = wanted.join(whole, "rep").groupBy("component", "x", "y").applyInPandas(solve, "a long, b long")
    # Documents whose repeated rows hold different texts stand for several sets.
    same = sigs.where("doc_id is not null and d1 is not null").join(sets.select("d1", "d2", "rep"), ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    split = same.where("a <> b").groupBy("a").agg(F.countDistinct("b").alias("sets")).where("sets > 1").select("a")
    links = links.union(same.join(split, "a", "left_semi"))
    classes = components(links, f"{folder}/classes").select(F.col("node").alias("rep"), "component")

    out = sigs.drop("prefix").where("d1 is not null").join(sets.select("d1", "d2", "rep"), ["d1", "d2"]).join(classes, "rep", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))
    return out.union(sigs.where("d1 is null").select("doc_id", "n_shingles", "doc_id"))
