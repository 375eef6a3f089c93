import hashlib
import random
import re
import zlib

import duckdb

from foldline.llm.conversation_trie import ORACLE, prefix_trie
from foldline.llm.shared import work_dir

FORM = "conv_id long, turn long, role string, text string, depth int, a string, leader long"


def brute(rows) -> set:
    """Every node by its sequence of turns, with sums over all nodes that begin with it."""
    turns = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    members = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        made = (*turns.get(base, [])[:h], *own[h:])
        for d in range(len(made) + 1):
            members.setdefault(made[:d], []).append((c, d == len(made)))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t[-1][1])) if t else 0
    kids = {}
    for t in members:
        if t:
            kids.setdefault(t[:-1], []).append(t)
    out = set()
    for t, own in members.items():
        below, open_nodes = [], [t]
        while open_nodes:
            below.append(open_nodes.pop())
            open_nodes += kids.get(below[-1], [])
        ends = ",".join(str(c) for c in sorted(c for c, last in own if last))
        out.add((min(c for c, _ in own), len(t), min(c for c, _ in members[t[:-1]]) if t else None, len(own), len(kids.get(t, [])), sum(x not in kids for x in below), sum((len(members[x]) - 1) * words(x) for x in below), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(spark, rows, **options) -> set:
    frame = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], FORM).repartition(3)
    found = [tuple(r) for r in prefix_trie(frame, work_dir(spark, "t"), **options).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, None, "user", "b c"), (-45, 0, "user", "one two"), (-45, 1, "x", " \t"), (-40, 3, "user", "under")]
    for c in range(0, 130):
        if c in (40, 41):
            continue  # a base that is absent
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn * 3, "user" if turn % 2 == 0 else "assistant", rng.choice(["a b", "a", "", "c d  e", None])))
    rows += [(200 + 20 * k, 0, "user", "hello there") for k in range(50)]  # many end at one node
    assert nodes(spark, rows) == brute(rows)


def test_long_and_nested_conversations(spark):
    """Every conversation is a prefix of the next, and a turn's place needs several pieces of a running total."""
    rows = [(c, t, "user", f"w{t} x") for c in range(20, 32) for t in range(3 * (c - 19))]
    rows += [(500, t, "user", f"w{t} x") for t in range(150)]
    want = brute(rows)
    assert nodes(spark, rows, piece=4) == want


def test_very_long_text_and_repeats(spark):
    rows = [(1, 0, "user", "word " * 200_000)] * 2 + [(2, 0, "user", "word " * 200_000)]
    assert nodes(spark, rows) == brute(rows)


def test_empty(spark):
    assert nodes(spark, []) == set() == nodes(spark, [(None, 1, "user", "a")])


def test_sql(spark):
    place = "/root/testdata/sf0.001/conversations.parquet"
    table = spark.read.parquet(place)
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{place}'")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    found = {tuple(r) for r in prefix_trie(table, work_dir(spark, "t")).collect()}
    assert found == set(duck.execute(ORACLE).fetchall()) == brute(rows)
