import corpus_pipeline
from foldline.llm.catalog import QUERIES


def test_short_lines_go_as_exact_repeats(spark, tmp_path):
    rows = [(1, "own words of document one only, which is long\nShare this\n", "en"), (2, "Share this\nshare this\n\nShare thus", "en"), (3, "Share this", "en"), (4, "\n", "en"), (None, "Share this", "en"), (5, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["op9_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 1, 1, 0), (2, 0, 1, 1, 0), (3, 0, 1, 1, 0)}
    left = {(r.doc_id, r.text) for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()}
    assert left == {(1, rows[0][1]), (2, "share this\n\nShare thus"), (4, "\n"), (None, "Share this"), (5, None)}
