import hashlib
import json
import sys
from itertools import accumulate

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from foldline.llm import bpe_transducer  # noqa: E402
from foldline.llm.bpe_transducer import encode_decode, transducer  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
BITS = st.sampled_from(["a", "th", "in", " ", "  ", "\n", "\t", "é", "ß", "日本", "😀", "'s", "'", "1", "²", "\xa0", "\x1c", "-", "<|endoftext|>", "\r\n", "A"])


@settings(max_examples=300, deadline=None)
@given(st.lists(BITS, max_size=30).map("".join))
def test_ids_and_text_are_the_librarys(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert transducer(PATH).encode(text) == ids
    assert transducer(PATH).decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 2000, "-" * 3000, "the" * 2000, "é" * 1500])
def test_long_pieces_stream(text):
    raw, tables = text.encode(), transducer(PATH)
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert list(tables.stream(raw[i : i + 7] for i in range(0, len(raw), 7))) == ids


def test_rows(spark):
    texts = [None, "", "one word", "one word", "long " * 9000]
    rows = encode_decode(spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int"), PATH).collect()
    empty = hashlib.sha256(b"").hexdigest()
    for r in rows:
        ids = LIBRARY.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert {r.ids_sha256 for r in rows if r.doc_id < 2} == {empty} and len(rows) == 5
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(BITS, max_size=40).map("".join), st.integers(1, 9))
def test_stretches_change_nothing(text, size):
    tables = transducer(PATH)
    blocks = tables.packed(text[k : k + size] for k in range(0, len(text), size))
    assert [i for b in blocks for i in memoryview(b).cast(tables.code)] == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 30000, " " + "é" * 9000 + "\t" * 9000 + "x", "\n" * 9000, "-" * 9000 + "'re", "1" * 9000 + " " * 9000 + "b"])
def test_long_pieces_come_in_chunks(text, monkeypatch):
    tables, most = transducer(PATH), [0]
    read = bpe_transducer.Piece._read

    def watched(self, chunk):
        read(self, chunk)
        most[0] = max(most[0], len(self.last))

    monkeypatch.setattr(bpe_transducer.Piece, "_read", watched)
    blocks = tables.packed(text[k : k + 1000] for k in range(0, len(text), 1000))
    assert [i for b in blocks for i in memoryview(b).cast(tables.code)] == LIBRARY.encode(text, add_special_tokens=False).ids
    assert most[0] <= 2 * (tables.lookahead + bpe_transducer.STEP)


def test_every_id_comes_from_the_transducer(monkeypatch):
    tables, given = bpe_transducer.Transducer(PATH), []
    end = bpe_transducer.Piece.end
    monkeypatch.setattr(bpe_transducer.Piece, "end", lambda self: given.append(1) or end(self))
    ids = tables.encode("Some words, and some words again")
    assert tables.decode(ids) == "Some words, and some words again" and len(given) == 6  # each distinct piece once


@settings(max_examples=200, deadline=None)
@given(st.text("abtheins -", max_size=700), st.text("abtheins -", max_size=40))
def test_lookahead_suffices(text, more):
    """Tokens that end a lookahead before the end of what was read stay when more comes."""
    tables = transducer(PATH)
    ends = lambda t: {e for e in accumulate(len(tables.raw[i]) for i in tables.stream((t.encode(),)))}
    bound = len(text) - tables.lookahead
    assert {e for e in ends(text) if e <= bound} == {e for e in ends(text + more) if e <= bound}


def test_memos_are_bounded():
    tables = bpe_transducer.Transducer(PATH, memo_bytes=200_000, table_bytes=100_000)
    for k in range(0, 30000, 1000):
        words = [f"w{j * 7919} x{j}y" for j in range(k, k + 1000)]
        for text, blocks in zip(words, tables.batch(words)):
            assert [i for b in blocks for i in memoryview(b).cast(tables.code)] == LIBRARY.encode(text, add_special_tokens=False).ids
    memo, table = tables.splitter.piece, tables.splitter.table
    assert sum(sys.getsizeof(a) + sys.getsizeof(b) for d in (memo, memo.older) for a, b in d.items()) < 300_000
    assert table.words.nbytes + table.pool.nbytes < 300_000


def test_other_formats_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"ignore_merges": True}}):
        (tmp_path / "v.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe_transducer.Transducer(str(tmp_path / "v.json"))


def test_null_ids_and_very_long_texts(spark):
    texts = ["x" * 200_000, "word " * 60_000]
    rows = encode_decode(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string"), PATH).collect()
    assert {r.doc_id for r in rows} == {None}
    assert sorted(r.decoded_sha256 for r in rows) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert sorted(r.n_tokens for r in rows) == sorted(len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts)
