"""Token ids in a content-addressed store.

A rolling hash over the last few ids cuts each document's ids into chunks, so that equal passages give
equal chunks wherever they start. A chunk is named by its digest and its bytes are stored once. A
document's recipe lists its chunks; a manifest row holds the recipe, the document's place in the
stream of all ids in ascending doc_id order, and the Merkle root over its chunk digests. Reading
back recomputes digests, roots and checksums from the stored bytes.

Layout below one folder, all Parquet:
  entries/   a row per chunk of each document: doc_id, row_key, pos, n, digest, and data (little-endian
             ids of two or four bytes), which only one row of each digest has
  manifest/  a row per document, range-partitioned and sorted by doc_id: doc_id, row_key, part,
             n_tokens, chunks, root
"""

from __future__ import annotations

import hashlib
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldline.llm.bpe_transducer import byte_alphabet
from foldline.llm.pieces import MARKS, Splitter, check_format, plain, spread
from foldline.llm.shared import stretches

#: Ids that the rolling hash sees, the mean chunk in ids as a power of two, and the bounds of a chunk.
WINDOW, CUT_BITS, LEAST, MOST = 8, 9, 64, 4096
#: Digests that a task keeps to send a chunk's bytes once; more are settled after the shuffle.
SEEN = 50_000

#: Bytes of a Python worker's table of words and of its memos of pieces, and characters of the texts that are encoded at a time.
TABLE_BYTES, MEMO_BYTES, CHARS = 20 << 20, 8 << 20, 4 << 20

ENTRY = "doc_id long, row_key long, pos int, n int, digest binary, data binary"


class IdEncoder:
    """The tokenizers library's ids of whole texts.

    With a vocabulary file of the known format, each distinct word of some texts is looked up in a table, and the
    library's model called for new ones; texts of any other file go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.marks = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        with open(path, encoding="utf-8") as f:
            try:
                check_format(json.load(f))
            except ValueError:
                self.splitter = None
            else:
                self.as_vocabulary = {b: c for c, b in byte_alphabet().items()}
                self.splitter = Splitter(self._piece, self.dtype, MEMO_BYTES, TABLE_BYTES, self._words)

    def _piece(self, piece: str) -> bytes:
        """A piece is what the library's pre-tokenizer hands to its model; the model alone is called."""
        found = self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.as_vocabulary))
        return array(self.code, [t.id for t in found]).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """The splitter's words(), with no look-up for words of letters."""
        code, tokenize, table, blank = self.code, self.library.model.tokenize, self.as_vocabulary, self.as_vocabulary[0x20]
        piece, other, out = self.splitter.piece, self.splitter.words, []
        for word in words:
            stem, mark = (word[:-1], word[-1]) if word[-1:] in MARKS else (word, "")
            if stem.isalpha():
                found = tokenize(blank + (stem if stem.isascii() else stem.encode().decode("latin-1").translate(table)))
                ids = array(code, [t.id for t in found]).tobytes()
                out.append(ids + piece[mark] if mark else ids)
            else:
                out += other([word])
        return out

    def _one(self, text: str) -> np.ndarray:
        if self.splitter is None or any(m in text for m in self.marks):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)
        return np.frombuffer(self.splitter.ids(text), self.dtype)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        if self.splitter is None:
            return [self._one(t) for t in texts]
        found = self.splitter.batch(texts, lambda t: plain(t) and not any(m in t for m in self.marks))
        return [self._one(t) if own is None else own for t, own in zip(texts, found)]


_encoders: dict[str, IdEncoder] = {}


def id_encoder(path: str) -> IdEncoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = IdEncoder(path)
    return _encoders[path]


def _gear() -> np.ndarray:
    """A pseudo-random word for each id below 65536; larger ids use their low bits."""
    x = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def chunk_ends(texts: list[np.ndarray]) -> list[list[int]]:
    """Where each text's chunks end: after ids whose rolling hash has its top bits zero, within the bounds."""
    sizes = np.array([len(t) for t in texts], np.int64)
    # Texts one after the other, with room before each for what the hash sees of nothing.
    starts = np.cumsum(sizes + WINDOW) - sizes
    words = np.zeros(int((sizes + WINDOW).sum()), np.uint32)
    words[spread(starts, sizes)] = GEAR[np.concatenate([np.empty(0, np.int64), *texts]).astype(np.int64) & 0xFFFF]
    rolling = words.copy()
    for k in range(1, WINDOW):
        rolling[k:] += words[:-k] << np.uint32(k)
    hits = np.flatnonzero(rolling >> np.uint32(32 - CUT_BITS) == 0) + 1
    first, last = np.searchsorted(hits, starts, side="right"), np.searchsorted(hits, starts + sizes, side="right")
    out = []
    for at, n, i, j in zip(starts.tolist(), sizes.tolist(), first.tolist(), last.tolist()):
        ends, start = [], 0
        for end in (hits[i:j] - at).tolist():
            while end - start > MOST:
                start += MOST
                ends.append(start)
            if end - start >= LEAST:
                ends.append(end)
                start = end
        while n - start > MOST:
            start += MOST
            ends.append(start)
        if start < n:
            ends.append(n)
        out.append(ends)
    return out


def name(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(digests: list[bytes]) -> bytes:
    """The root over digests in order; an odd one out moves up a level as it is."""
    level = list(digests)
    while len(level) > 1:
        level = [name(b"".join(level[k : k + 2])) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else name(b"")


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the checksum's polynomial, bits reversed."""
    out, b = np.zeros_like(b), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = b >> np.uint32(1) ^ np.where(b & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return out


def shifted(crcs: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What each crc32 adds to the whole's when so many bytes follow: the crc times x to the power of 8 bytes."""
    crcs, after, square = crcs.astype(np.uint32), after.astype(np.int64), np.full(1, 0x00800000, np.uint32)  # x**8
    while after.any():
        odd = (after & 1).astype(bool)
        crcs[odd] = _times(np.broadcast_to(square, odd.sum()), crcs[odd])
        square, after = _times(square, square), after >> 1
    return crcs


def joined_crcs(crcs: np.ndarray, sizes: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """crc32 of each concatenation; parts: how many of the (crc32, bytes) rows each is made of, at least one."""
    ends = np.cumsum(parts)
    total = np.cumsum(sizes)
    after = np.repeat(total[ends - 1], parts) - total
    return np.bitwise_xor.reduceat(shifted(crcs, after), ends - parts)


def write_store(docs: DataFrame, path: str, end_id: int, folder: str) -> None:
    """Encodes every whole text and writes the store below folder.

    docs: doc_id, text; other columns are not read. A null text counts as empty, and its ids are the
    end id alone. Each input row has a row_key, so repeated or null doc_ids stay apart.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row, sent = id_encoder(path), TaskContext.get().partitionId() << 33, set()
        end, width = np.array([end_id], encoder.dtype), encoder.dtype.itemsize
        for batch in batches:
            for part in stretches(batch, 1, 1000, CHARS):
                out = ([], [], [], [], [], [])
                found = [np.concatenate([ids, end]) for ids in encoder.batch([t or "" for t in part.column(1).to_pylist()])]
                for doc, ids, stops in zip(part.column(0).to_pylist(), found, chunk_ends(found)):
                    data, start = ids.tobytes(), 0
                    for pos, stop in enumerate(stops):
                        chunk = data[start * width : stop * width]
                        digest = name(chunk)
                        for to, value in zip(out, (doc, row, pos, stop - start, digest, None if digest in sent else chunk)):
                            to.append(value)
                        if len(sent) < SEEN:
                            sent.add(digest)
                        start = stop
                    row += 1
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["doc_id", "row_key", "pos", "n", "digest", "data"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            digests, data = np.frombuffer(b"".join(batch.column(4).to_pylist()), "V16"), batch.column(5)
            there = data.is_valid().to_numpy(zero_copy_only=False)
            # Rows with bytes come first, in order of their digests.
            again = np.concatenate([[digests[0] == before], digests[1:] == digests[:-1]])
            before, keep = digests[-1] if there[-1] else None, there & ~again
            data = pa.compute.if_else(pa.array(keep), data, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], data], batch.schema.names)

    spark = docs.sparkSession
    entries = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, ENTRY)
    # Rows that bring bytes meet the others of their digest; the rest, of hot chunks too, spread evenly.
    where = F.when(F.col("data").isNotNull(), F.xxhash64("digest")).otherwise(F.xxhash64("row_key", "pos"))
    entries = entries.repartition(where).sortWithinPartitions(F.col("data").isNull(), "digest", "row_key", "pos")
    entries.mapInArrow(once, ENTRY).write.option("compression", "zstd").parquet(f"{folder}/entries")

    def seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [merkle([c["digest"] for c in chunks]) for chunks in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], [*batch.schema.names, "root"])

    recipes = (
        spark.read.schema(ENTRY).parquet(f"{folder}/entries")
        .groupBy("doc_id", "row_key")
        .agg(F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("pos", "n", "digest"))).alias("chunks"))
        .repartitionByRange("doc_id", "row_key")
        .sortWithinPartitions("doc_id", "row_key")
    )
    form = "doc_id long, row_key long, n_tokens long, chunks array<struct<pos:int,n:int,digest:binary>>, root binary"
    recipes.mapInArrow(seal, form).withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{folder}/manifest")


RESULT = "doc_id long, row_key long, n_tokens long, ids_crc32 long, whole boolean"


def read_store(spark, folder: str, id_bytes: int = 2) -> DataFrame:
    """Reads a store back and verifies it: every chunk's digest and every document's root.

    Returns a row per document: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit
    words), verified. A document with a missing or altered chunk has verified false.
    """
    dtype = "<u2" if id_bytes == 2 else "<u4"

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, found, crcs, sizes = batch.column(0).to_pylist(), [], [], []
            for data in batch.column(1).to_pylist():
                wide = np.frombuffer(data, dtype).astype("<u4")
                found.append(name(data))
                crcs.append(zlib.crc32(wide))
                sizes.append(wide.nbytes)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(found, pa.binary()), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64())], ["digest", "found", "crc", "bytes"])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            if not len(lists):
                continue
            found, parts = lists.flatten().field("found").to_pylist(), lists.value_lengths().to_numpy()
            # A chunk that is missing counts as no bytes, and makes its document fail.
            crcs, sizes = (pa.compute.fill_null(lists.flatten().field(f), 0).to_numpy() for f in ("crc", "bytes"))
            ends, whole = np.cumsum(parts), []
            for root, end, n in zip(batch.column(2).to_pylist(), ends.tolist(), parts.tolist()):
                own = found[end - n : end]
                whole.append(None not in own and merkle(own) == root)
            counts = np.add.reduceat(sizes, ends - parts) // 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(joined_crcs(crcs, sizes, parts).astype(np.int64)), pa.array(whole, pa.bool_())], ["doc_id", "row_key", "n_tokens", "ids_crc32", "whole"])

    manifest = spark.read.parquet(f"{folder}/manifest")
    chunks = spark.read.schema(ENTRY).parquet(f"{folder}/entries").where("data is not null").select("digest", "data").mapInArrow(check, "digest binary, found binary, crc long, bytes long")
    wanted = manifest.select("doc_id", "row_key", "root", F.explode("chunks").alias("c")).select("doc_id", "row_key", "root", "c.pos", "c.digest")
    whole = (
        wanted.join(chunks, "digest", "left")
        .groupBy("doc_id", "row_key", "root")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "found", "crc", "bytes"))).alias("chunks"))
        .mapInArrow(rebuild, RESULT)
    )
    # Each part's first place from the parts' sums (a row per part), then a running sum within the part.
    sums = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    places, total = [], 0
    for r in sums:
        places.append((r["part"], total))
        total += r["n"]
    places = spark.createDataFrame(places, "part int, base long")
    running = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("doc_id", "row_key").rowsBetween(Window.unboundedPreceding, -1))
    starts = manifest.select("doc_id", "row_key", "part", running.alias("before")).join(F.broadcast(places), "part").select("doc_id", "row_key", (F.col("base") + F.coalesce("before", F.lit(0))).alias("start"))
    on = [F.col("a.row_key") == F.col("b.row_key")]
    return starts.alias("a").join(whole.alias("b"), on).select("a.doc_id", "a.start", "b.n_tokens", "b.ids_crc32", F.col("b.whole").alias("verified"))


def store_and_read(docs: DataFrame, path: str, end_id: int, folder: str) -> DataFrame:
    """Writes the store below folder, which must be shared, and returns read_store()'s rows.

    Documents come in ascending doc_id (null first, repeated ids in the order of the input). An
    empty table gives an empty store and no rows.
    """
    write_store(docs, path, end_id, folder)
    return read_store(docs.sparkSession, folder, id_encoder(path).dtype.itemsize)
