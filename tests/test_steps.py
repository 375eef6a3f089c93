"""What is made where: steps that grew faster than their input, seen in the plans."""

from pyspark.sql import functions as F

from foldline.operators import neighbors, pairs, ranks, submat
from foldline.plans import inputs
from foldline.sources.scratch import shared_folder

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_strings_are_parsed_once_and_pairs_counted_once(spark):
    letters = submat.aligned_letters(inputs.alignments(spark, SF).select("alignment_id", "sid1", "sid2", "cigar"), inputs.sequences(spark, SF))
    for counts in (submat.joint_counts, submat.lagged_counts, submat.counts_by_kind):
        made = plan(counts(letters, "ABCDE"))
        assert "Union" not in made and made.count("regexp_extract_all") == 1


def test_a_caps_hash_is_made_behind_the_shuffle(spark):
    rows = pairs.expand(inputs.alignments(spark, SF))
    made = plan(pairs.capped(rows, 6, 5))
    assert "sha2" in made and "sha2" not in made[made.index("RepartitionByExpression"):]


def test_levels_are_looked_up_for_ids_that_occur(spark):
    assert "LeftSemi" in plan(pairs.with_levels(inputs.alignments(spark, SF), inputs.classes(spark, SF)))


def test_keys_of_an_order_are_not_kept(spark):
    rows = spark.range(300).repartition(7)
    got = ranks.numbered(rows, ["_h", F.col("id")], shared_folder(spark, "t"), "place", {"_h": F.unhex(F.sha2(F.col("id").cast("string"), 256))})
    assert got.columns == ["id", "place"]
    want = ranks.numbered(rows, [F.sha2(F.col("id").cast("string"), 256), F.col("id")], shared_folder(spark, "t"), "place")
    assert {(r.id, r.place) for r in got.collect()} == {(r.id, r.place) for r in want.collect()}


def test_residues_meet_in_stated_partitions(spark, monkeypatch):
    seen, cut = [], neighbors.cut
    monkeypatch.setattr(neighbors, "TASK", 50)
    monkeypatch.setattr(neighbors, "cut", lambda frame, path: (seen.append((path, plan(frame))), cut(frame, path))[1])
    chains = inputs.chains(spark, SF)
    assert "Window" not in plan(chains)
    neighbors.nearest(chains, ["cb_x", "cb_y", "cb_z"], digits=9).count()
    assert all("RepartitionByExpression" in p for path, p in seen if "round-" in path)
