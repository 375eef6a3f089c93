"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Encoding reads bytes from left to right and keeps, for each of the last few positions, the token
that ends there when the text so far is encoded: of all tokens that end at a position, exactly one
may follow the token that ends where it starts. Whether b may follow a is decided from the merge
list alone: replay the merges along a's right edge and b's left edge in rank order, and see whether
one across the border comes first.

The lookahead is computed from the merge list. Let text that is yet to come change how the text read so far
is encoded. Replay the merges in rank order with and without it: the two differ behind a border only, which at
first is the end of the text read, and merge (u, v) moves the border back by u's length if u ends at it and v
starts there in one of the two, that is if v comes from the text to come or if u of an earlier merge that moved the border
is on v's left edge. The longest way back over such chains of merges bounds what may still change: tokens that
end at least so many bytes before the end of the text read are emitted. Memory is that window.

Text comes in stretches; pieces of the pre-token pattern are encoded each on its own, a piece without end
chunk by chunk. Decoding feeds each emitted id's bytes into an incremental byte-to-text machine, which holds back
at most the three bytes of an unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm.pieces import Splitter, check_format, find, plain
from foldline.llm.shared import stretches

#: Bytes of a piece between two looks for stable tokens, and characters of a text that are read at a time.
STEP, STRETCH = 512, 1 << 16
#: Characters of a piece that has not ended from which on it is encoded chunk by chunk.
LONG_PIECE = 4096
#: Bytes of a Python worker's table of words and memo of pieces, and entries of its memo of pairs of tokens.
TABLE_BYTES, MEMO_BYTES, PAIRS = 32 << 20, 24 << 20, 200_000

_space = regex.compile(r"\s").match
#: What goes on a piece that began with such a character.
_CLASSES = tuple(map(regex.compile, (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")))


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary file -> that byte."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = (b for b in range(256) if b not in set(keep))
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(spare)}


class Transducer:
    """One vocabulary's tables, and encoding and decoding by them."""

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES, table_bytes: int = TABLE_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_format(spec)
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        marks = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.id_of = {as_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in marks}
        bytes_of = {i: b for b, i in self.id_of.items()} | {i: s.encode() for s, i in marks.items()}
        #: By id: its bytes, and itself in decimal.
        self.raw = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.decimal = [b"%d" % i for i in range(len(self.raw))]
        self.code = "H" if len(self.raw) <= 1 << 16 else "I"
        self.marks = marks
        longest_first = sorted(marks, key=len, reverse=True)
        self.longest_mark = max(map(len, marks), default=0)
        self.mark = regex.compile("|".join(map(regex.escape, longest_first))) if marks else None
        self.merges: dict[tuple[int, int], int] = {}
        self.made_from: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (as_bytes(s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b, c = self.id_of[left], self.id_of[right], self.id_of[left + right]
            if c in self.made_from:
                raise ValueError("a token is made by two merges")
            self.merges[a, b] = rank
            self.made_from[c] = (a, b, rank)
        #: Finds all tokens that end at each byte, in one pass.
        self.ends = ahocorasick.Automaton()
        for token, i in self.id_of.items():
            self.ends.add_word(token.decode("latin-1"), (i, len(token)))
        self.ends.make_automaton()
        self.never = len(self.merges)
        #: The sufficient lookahead in bytes.
        self.lookahead = self._sufficient()
        self.known: dict[int, bool] = {}
        self.splitter = Splitter(self._piece, np.dtype(f"<u{array(self.code).itemsize}"), memo_bytes, table_bytes)

    def _sufficient(self) -> int:
        """The farthest that text to come can move the border between what is settled and what is not."""
        back: dict[int, int] = {}  # u of a merge that moved the border -> how far back the border then is, at most
        farthest = 0
        for u, v in self.merges:  # in rank order
            before, token = 0, v
            while True:
                before = max(before, back.get(token, 0))
                if token not in self.made_from:
                    break
                token = self.made_from[token][0]
            far = len(self.raw[u]) + before
            back[u] = max(back.get(u, 0), far)
            farthest = max(farthest, far)
        return farthest

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Along a token's left (0) or right (1) edge, from byte to token: the part, and the rank at which it is merged away."""
        found, part, rank = [], token, self.never
        while True:
            found.append((part, rank))
            if part not in self.made_from:
                break
            made = self.made_from[part]
            part, rank = made[side], made[2]
        found.reverse()
        return found

    def follows(self, a: int, b: int) -> bool:
        """The text of a and b, encoded together, is a then b."""
        key = a << 20 | b
        known = self.known.get(key)
        if known is None:
            left, right = self._edge(a, 1), self._edge(b, 0)
            i = j = 0
            known = True
            while True:
                (x, x_goes), (y, y_goes) = left[i], right[j]
                # Of equal merges the leftmost comes first: a's own, then the one across, then b's.
                across = self.merges.get((x, y), self.never)
                if across < x_goes and across <= y_goes and across < self.never:
                    known = False
                    break
                if x_goes == y_goes == self.never:
                    break
                if x_goes <= y_goes:
                    i += 1
                else:
                    j += 1
            if len(self.known) >= PAIRS:
                self.known.clear()
            self.known[key] = known
        return known

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """The ids of one piece whose bytes come in chunks; each as soon as it is stable."""
        piece = Piece(self)
        for chunk in chunks:
            yield from piece.feed(chunk)
        yield from piece.end()

    def pack(self, ids: Iterable[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        made = Piece(self)
        ids = made.feed(piece.encode())
        return self.pack(ids + made.end())

    def _split_marks(self, stretches: Iterable[str]) -> Iterator[tuple[str, str | None]]:
        """The text in stretches, and the added token that ends a stretch if one does; none reaches over two stretches."""
        rest = ""
        for stretch in stretches:
            if self.mark is None:
                yield stretch, None
                continue
            rest += stretch
            last = len(rest) - self.longest_mark  # a mark that begins later may still become a longer one
            while (m := self.mark.search(rest)) and m.start() <= last:
                yield rest[: m.start()], m.group()
                rest, last = rest[m.end() :], last - m.end()
            if last >= 0:
                yield rest[: last + 1], None
                rest = rest[last + 1 :]
        while self.mark and (m := self.mark.search(rest)):
            yield rest[: m.start()], m.group()
            rest = rest[m.end() :]
        yield rest, None

    def packed(self, stretches: Iterable[str]) -> Iterator[bytes]:
        """The packed ids of a text that comes in stretches, in blocks; each as soon as its pieces are settled."""
        rest, piece, kind, hold = "", None, None, 0
        for text, mark in self._split_marks(stretches):
            rest += text
            if piece is not None:  # goes on as far as its kind does; of white space, the last belongs to what follows
                end = m.end() if (m := kind.match(rest)) else 0
                ended, all_of_it = end < len(rest), end == len(rest) and mark is not None
                upto = end if all_of_it else end - hold
                yield self.pack(piece.feed(rest[:upto].encode()))
                rest = rest[upto:]
                if ended or all_of_it:
                    yield self.pack(piece.end())
                    piece = None
                else:
                    continue
            if mark is not None:
                yield self.splitter.ids(rest)
                yield self.pack([self.marks[mark]])
                rest = ""
                continue
            if at := settled(rest):
                yield self.splitter.ids(rest[:at])
                rest = rest[at:]
            elif len(rest) >= LONG_PIECE:
                own = rest[0] == " " and not _space(rest[1])
                kind = next(k for k in _CLASSES if k.match(rest, own))
                hold = int(kind is _CLASSES[-1])
                piece = Piece(self)
                if own:  # the blank before a word is the piece's first byte
                    yield self.pack(piece.feed(b" "))
                    rest = rest[1:]
        if piece is not None:
            yield self.pack(piece.feed(rest.encode()))
            yield self.pack(piece.end())
        else:
            yield self.splitter.ids(rest)

    def batch(self, texts: list[str]) -> Iterator[Iterable[bytes]]:
        """The packed ids of each text, in blocks. Texts of one stretch share the look-up of their words."""
        easy = lambda t: len(t) <= STRETCH and plain(t) and not (self.mark and self.mark.search(t))
        for text, ids in zip(texts, self.splitter.batch(texts, easy)):
            yield self.packed(stretched(text)) if ids is None else (ids.tobytes(),)

    def encode(self, text: str) -> list[int]:
        return [i for block in self.packed(stretched(text)) for i in memoryview(block).cast(self.code)]

    def decode(self, ids: Iterable[int]) -> str:
        machine = TextMachine()
        return "".join([*(machine.feed(self.raw[i]) for i in ids), machine.end()])


class Piece:
    """One piece of a text as its bytes come: ids in the order of the text, each as soon as it is stable."""

    __slots__ = ("tables", "found", "read", "base", "before", "last", "size")

    def __init__(self, tables: Transducer):
        self.tables, self.found = tables, None
        self.read = self.base = 0  # bytes read, and those of them that are emitted
        self.before = -1  # the token emitted last
        self.last, self.size = [-1], [0]  # at each border since: the token that ends there, and its bytes

    def feed(self, chunk: bytes) -> list[int]:
        out, tables = [], self.tables
        for at in range(0, len(chunk), STEP):
            self._read(chunk[at : at + STEP].decode("latin-1"))
            if len(self.last) > tables.lookahead + STEP:
                out += self._stable()
        return out

    def _read(self, chunk: str) -> None:
        tables, last, size, before = self.tables, self.last, self.size, self.before
        if self.found is None:
            self.found = tables.ends.iter(chunk)
        else:
            self.found.set(chunk)
        known, base, border = tables.known.get, self.base - 1, len(last)
        for end, (token, n) in self.found:
            end -= base
            if end < border or end < n:  # the border has its token, or this one would begin before the window
                continue
            previous = last[end - n] if end > n else before
            if previous >= 0:
                fits = known(previous << 20 | token)
                if fits is None:
                    fits = tables.follows(previous, token)
                if not fits:
                    continue
            last.append(token)
            size.append(n)
            border += 1
        self.read += len(chunk)

    def _stable(self) -> list[int]:
        """Tokens that end a lookahead before the last byte read; the window then begins behind them."""
        last, size, at = self.last, self.size, len(self.last) - 1
        bound, ends = at - self.tables.lookahead, []
        while at:
            if at <= bound:
                ends.append(at)
            at -= size[at]
        if not ends:
            return []
        cut, out = ends[0], [last[p] for p in reversed(ends)]
        self.before, self.base = last[cut], self.base + cut
        self.last, self.size = [-1, *last[cut + 1 :]], [0, *size[cut + 1 :]]
        return out

    def end(self) -> list[int]:
        at, out = len(self.last) - 1, []
        while at:
            out.append(self.last[at])
            at -= self.size[at]
        return out[::-1]


def settled(text: str) -> int:
    """A border behind a piece without white space that holds whatever follows, as far on as is easily found; 0 if there is none."""
    at = max(text.rfind(" "), text.rfind("\n"))
    if at > 0:
        at = len(text[:at].rstrip(" \n"))
        if at and not _space(text[at - 1]):
            return at  # before white space after a word
    # A piece that ends before the last two characters ends there whatever follows.
    return max((m.end() for m in find(text) if m.end() <= len(text) - 2 and not _space(m.group()[-1])), default=0)


def stretched(text: str) -> Iterator[str]:
    return (text[k : k + STRETCH] for k in range(0, len(text), STRETCH))


class TextMachine:
    """Bytes in, text out; an unfinished character waits for its remaining bytes."""

    def __init__(self) -> None:
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, raw: bytes) -> str:
        return self._state.decode(raw)

    def end(self) -> str:
        return self._state.decode(b"", True)


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The vocabulary's transducer, built once in each Python process, which keeps one vocabulary at a time."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Transducer(path)
    return _loaded[path]


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Documents and bytes of text that are encoded at a time.
ROWS, BYTES = 1000, 3 << 20


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    docs: doc_id, text, and any other columns, which are not read. path: the vocabulary file, at the
    same place on every executor; ValueError if it asks for more than byte-level BPE. Returns a row per input
    row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the text that
    the emitted ids decode to, in UTF-8). A null or empty text has no ids, and both hashes are that of the empty string. A very
    long text goes through in stretches, and a very long piece in chunks. Repeated rows give repeated
    rows; a null doc_id stays null; an empty table gives no rows. No shuffle and no state but the
    bounded memos, so any task can run again elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = transducer(path)
        decimal, raw, code = tables.decimal.__getitem__, tables.raw.__getitem__, tables.code
        for batch in batches:
            for part in stretches(batch, 1, ROWS, BYTES):
                counts, ids_hash, text_hash = [], [], []
                for blocks in tables.batch([t or "" for t in part.column(1).to_pylist()]):
                    ids, n, decoded, machine = hashlib.sha256(), 0, hashlib.sha256(), TextMachine()
                    for block in blocks:
                        if block:
                            emitted = memoryview(block).cast(code)
                            if n:
                                ids.update(b",")
                            ids.update(b",".join(map(decimal, emitted)))
                            n += len(emitted)
                            decoded.update(machine.feed(b"".join(map(raw, emitted))).encode())
                    decoded.update(machine.end().encode())
                    counts.append(n)
                    ids_hash.append(ids.hexdigest())
                    text_hash.append(decoded.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)
