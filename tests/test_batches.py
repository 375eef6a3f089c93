from collections import Counter

from pyspark.sql import functions as F

from foldline import facade
from foldline.operators import search
from foldline.operators.batches import batch_plan, spans
from foldline.sources import writers
from foldline.sources.scratch import shared_folder


def test_batches_span_as_many_alignments_as_they_can(spark):
    rows = [(f"a{a}", k) for a, n in ((0, 90), (1, 30), (2, 7), (3, 1), (4, 1), (5, 40)) for k in range(n)]
    frame = spark.createDataFrame(rows, "alignment_id string, k int").repartition(3)
    plan = batch_plan(frame, 16, seed=1).collect()
    assert Counter(r.batch for r in plan) == {b: 16 for b in range(10)} and len({(r.alignment_id, r.k) for r in plan}) == 160
    assert max(Counter((r.batch, r.alignment_id) for r in plan).values()) <= 9 and all(r.alignments >= 3 for r in spans(batch_plan(frame, 16, seed=1)).collect())
    again = {(r.alignment_id, r.k): r.batch for r in batch_plan(frame.repartition(5), 16, seed=1).collect()}
    assert again == {(r.alignment_id, r.k): r.batch for r in plan} != {(r.alignment_id, r.k): r.batch for r in batch_plan(frame, 16, seed=1, epoch=1).collect()}
    assert batch_plan(frame, 1000, seed=1).count() == 0


def test_a_run_replaces_its_own_rows(spark):
    path = shared_folder(spark, "log")
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    for run, values in (("a", (1, 2)), ("b", (3,)), ("a", (4,)), ("a", (4,))):
        writers.append_run(rows(*values), run, path)
    assert sorted((r.run, r.v) for r in spark.read.parquet(path).collect()) == [("a", 4), ("b", 3)]


def test_class_sizes_count_ids_without_a_class(spark):
    rows = spark.createDataFrame([("x", "a.1.2"), ("y", "a.1.3"), ("z", None), ("w", None), ("v", "b.1")], "sid string, class string")
    got = {r.sid: (r.fam_count, r.sfam_count, r.fold_count) for r in search.class_sizes(rows).collect()}
    assert got == {"x": (1, 2, 2), "y": (1, 2, 2), "z": (2, 2, 2), "w": (2, 2, 2), "v": (1, 1, 1)}


def test_sql_functions(spark):
    facade.register(spark)
    one = spark.sql("SELECT class_fold('a.1.2.3') AS a, class_family('a.1.2') AS b, class_parent('a.1.2') AS c, domain_group('d1abca_') AS d, mebibytes(3145728) AS e, vector_unit(array(0D, 3D, 4D)) AS f, vector_unit(array(0D, 0D, 0D)) AS g, separation_of(signed_log(-7D)) AS h, class_fold(NULL) AS i").first()
    assert tuple(one) == ("a.1", None, "a.1", "1abc", "3.0 MiB", [0.0, 0.6, 0.8], [None, None, None], 7, None)
    plan = spark.range(1).select(F.expr("vector_norm(array(3D, 0D, 4D))").alias("n"))
    assert plan.first().n == 5.0 and "Python" not in plan._jdf.queryExecution().executedPlan().toString()
