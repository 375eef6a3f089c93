"""Splitting text into the pieces that a byte-level BPE never merges across.

The pattern below is the published one of the byte-level vocabulary; `check_format` raises for a vocabulary
file that asks for anything else. A blank-separated word has the same pieces wherever it stands, so texts
without runs of white space are split at blanks, many at a time, and each distinct word's ids are looked up in a
table of arrays. Any other text goes through the pattern, with a memo by piece. Table and memo live as long as the
Python worker and are bounded by bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex

#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of more characters are not kept.
MEMO_CHARS = 64
#: Bytes that an entry takes in a dict besides its key and value.
SLOT = 70

#: Marks that are a piece of their own after a word of letters.
MARKS = tuple(",.;:!?")

#: All white space but the blank and the line feed.
_OTHER = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_OTHER_ASCII = [c for c in _OTHER if c.isascii()]

find = regex.compile(PATTERN).finditer


def check_format(spec: dict) -> None:
    """Raises ValueError unless the vocabulary file describes byte-level BPE with PATTERN and no other step."""
    model, before, after, back = (spec.get(k) for k in ("model", "pre_tokenizer", "post_processor", "decoder"))
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        raise ValueError("not a plain BPE model")
    if spec.get("normalizer") or not before or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True):
        raise ValueError("not the byte-level pre-tokenizer without a normalizer or prefix space")
    if after and after["type"] != "ByteLevel" or not back or back["type"] != "ByteLevel":
        raise ValueError("not the byte-level post-processor and decoder")
    for t in spec.get("added_tokens", []):
        if t["single_word"] or t["lstrip"] or t["rstrip"] or not all("!" <= c <= "~" for c in t["content"]):
            raise ValueError(f"added token {t['content']!r} is not a plain ASCII mark")


def plain(text: str) -> bool:
    """No white space in text but single blanks and line feeds."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in (_OTHER_ASCII if text.isascii() else _OTHER))


class Memo(dict):
    """piece -> the bytes that encode makes of it; the older generation is kept beside until the next is full."""

    def __init__(self, encode: Callable[[str], bytes], budget: int):
        super().__init__()
        self.encode, self.most, self.held, self.older = encode, budget // 2, 0, {}

    def __missing__(self, piece: str) -> bytes:
        made = self.older.get(piece)
        if made is None:
            made = self.encode(piece)
        if len(piece) <= MEMO_CHARS:
            if self.held >= self.most:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[piece] = made
            self.held += getsizeof(piece) + getsizeof(made) + SLOT
        return made


class WordTable:
    """Words and their packed ids, as arrays: looked up and added to many at a time.

    When it has grown over its bytes, what the last look-ups did not meet goes, and if that is not half, all.
    """

    def __init__(self, dtype: np.dtype, most: int):
        self.dtype, self.most = dtype, most
        self._keep(np.empty(0, np.int64), pa.array([], pa.large_string()), np.empty(0, dtype), np.empty(0, np.int64))

    def _keep(self, rows: np.ndarray, words: pa.Array, pool: np.ndarray, sizes: np.ndarray) -> None:
        begins = np.cumsum(sizes) - sizes
        self.words, self.sizes = words.take(pa.array(rows)), sizes[rows]
        self.pool = pool[spread(begins[rows], self.sizes)]
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.met = np.zeros(len(rows), bool)

    def rows(self, words: pa.Array, make: Callable[[list[str]], list[bytes]]) -> np.ndarray:
        """The row of each of some distinct words; make gives the packed ids of words that are new."""
        if self.words.nbytes + self.pool.nbytes + 17 * len(self.sizes) > self.most:
            kept = np.flatnonzero(self.met)
            self._keep(kept if len(kept) <= len(self.met) // 2 else kept[:0], self.words, self.pool, self.sizes)
        at = pa.compute.fill_null(pa.compute.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(at < 0)
        self.met[at[at >= 0]] = True
        if len(fresh):
            new = words.take(pa.array(fresh))
            made = make(new.to_pylist())
            at[fresh] = np.arange(len(fresh)) + len(self.sizes)
            self.words = pa.concat_arrays([self.words, new])
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(made), self.dtype)])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, made), np.int64, len(made)) // self.dtype.itemsize])
            self.begins = np.cumsum(self.sizes) - self.sizes
            self.met = np.concatenate([self.met, np.zeros(len(fresh), bool)])
        return at


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1 and on for sizes[0] numbers, then the same of the others."""
    ends = np.cumsum(sizes)
    out = np.arange(ends[-1] if len(ends) else 0)
    out += np.repeat(begins - (ends - sizes), sizes)
    return out


class Splitter:
    """Texts to packed ids, by words and pieces.

    one: a piece's packed ids; words: those of many words that the table does not hold, if not by pieces.
    """

    def __init__(self, one: Callable[[str], bytes], dtype: np.dtype, memo_bytes: int, table_bytes: int, words: Callable[[list[str]], list[bytes]] | None = None):
        self.dtype, self.make = dtype, words or self.words
        self.piece = Memo(one, memo_bytes)
        self.table = WordTable(dtype, table_bytes)
        self.line_end = one("\n")

    def words(self, words: list[str]) -> list[bytes]:
        """The packed ids of each word with a blank before it, or with the line feed that it begins with."""
        piece, out = self.piece, []
        for word in words:
            stem, mark = (word[:-1], word[-1]) if word[-1:] in MARKS else (word, "")
            if stem.isalpha():
                out.append(piece[" " + stem] + piece[mark] if mark else piece[" " + stem])
            else:
                out.append(b"".join([piece[m.group()] for m in find(word if word[:1] == "\n" else " " + word)]))
        return out

    def ids(self, text: str) -> bytes:
        """The packed ids of a whole text, or of a stretch that begins and ends between pieces."""
        return b"".join([self.piece[m.group()] for m in find(text)])

    def batch(self, texts: list[str], easy: Callable[[str], bool]) -> list[np.ndarray | None]:
        """The ids of the texts that are easy, which must be plain; every distinct word of all of them is looked up once."""
        out: list = [None] * len(texts)
        chosen = [k for k, t in enumerate(texts) if easy(t)]
        if not chosen:
            return out
        lines = pa.compute.replace_substring(pa.array(["\n" + texts[k] for k in chosen], pa.large_string()), "\n", " \n")
        split = pa.compute.split_pattern(pa.compute.utf8_slice_codeunits(lines, 1), " ")
        coded = split.flatten().dictionary_encode()
        rows = self.table.rows(coded.dictionary, self.make)[coded.indices.to_numpy()]
        sizes = self.table.sizes[rows]
        bounds = np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        ids = self.table.pool[spread(self.table.begins[rows], sizes)]
        # The line end that was put before each text stays out.
        lead = len(self.line_end) // self.dtype.itemsize
        for k, a, b in zip(chosen, bounds[:-1].tolist(), bounds[1:].tolist()):
            out[k] = ids[a + lead : b]
        return out
