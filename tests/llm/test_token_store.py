import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from foldline.llm.shared import work_dir  # noqa: E402
from foldline.llm.token_store import chunk_ends, joined_crcs, merkle, read_store, store_and_read  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_round_trip(spark):
    library = Tokenizer.from_file(PATH)
    long = " ".join(f"word{i * 7919 % 1000}" for i in range(6000))
    texts = {3: "b", 1: None, 2: "", 9: long, 7: long, 5: "x <|endoftext|> y", 8: "shared start " + long, 4: "a  b\t c "}
    folder = work_dir(spark, "test")
    rows = store_and_read(spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, digest string"), PATH, 2, folder).orderBy("doc_id").collect()
    start = 0
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32, r.verified) == (start, len(ids), zlib.crc32(np.array(ids, "<u4")), True)
        start += len(ids)
    assert [r.doc_id for r in rows] == sorted(texts)
    entries = spark.read.parquet(f"{folder}/entries")
    assert entries.where("data is not null").count() == entries.select("digest").distinct().count() < entries.count()
    # An altered chunk shows.
    bad = work_dir(spark, "test")
    spark.read.parquet(f"{folder}/manifest").write.parquet(f"{bad}/manifest")
    entries.selectExpr("doc_id", "row_key", "pos", "n", "digest", "if(doc_id = 3, unhex('0102'), data) as data").write.parquet(f"{bad}/entries")
    assert {r.doc_id for r in read_store(spark, bad).where("not verified").collect()} == {3}


def test_repeated_rows_and_empty_table(spark):
    form = "doc_id long, text string"
    rows = store_and_read(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], form), PATH, 2, work_dir(spark, "test")).collect()
    assert sorted(r.start for r in rows) == [0, 2, 4] and all(r.verified for r in rows)
    assert store_and_read(spark.createDataFrame([], form), PATH, 2, work_dir(spark, "test")).count() == 0


def test_parts():
    ids = np.random.default_rng(1).integers(0, 50000, 20000).astype("<u2")
    ends, other = chunk_ends([ids, ids[5000:]])
    assert len({e + 5000 for e in other} - set(ends)) <= 2  # the same cuts wherever a passage starts
    assert ends[-1] == len(ids) and all(b > a for a, b in zip(ends, ends[1:]))
    parts = [ids[a:b].astype("<u4") for a, b in zip([0, *ends], ends)]
    rows = [*parts, parts[0]]
    joined = joined_crcs(np.array([zlib.crc32(p) for p in rows]), np.array([p.nbytes for p in rows]), np.array([len(parts), 1]))
    assert joined.tolist() == [zlib.crc32(ids.astype("<u4")), zlib.crc32(parts[0])]
    assert chunk_ends([np.zeros(10000, "<u2"), ids[:0]])[0][-1] == 10000 and chunk_ends([ids[:0]]) == [[]] and chunk_ends([]) == [] and merkle([b"a"]) == b"a" and merkle([b"a", b"b", b"c"]) != merkle([b"c", b"b", b"a"])
