"""Quality classifier: hashed word n-gram logistic regression.

Weights are learned by follow-the-regularised-leader updates, one document at a time, and a score is
a sparse dot product. A word counts as itself and as its form (letter case, digits and punctuation,
runs shortened); neighbouring words count as a pair of words, as a pair of forms, and by whether the
two are the same word, which is how pairs of words that were never seen are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm.ngram_join import word_hashes
from foldline.llm.sampling import bounded_sample, held_out

#: Labelled documents to learn from, at most (chosen by a hash of doc_id), and how often each is read.
SAMPLE, PASSES = 10_000, 3
#: Weights for words, and for forms and pairs.
WORD_BITS, FORM_BITS = 16, 14
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.5
#: Score from which a document is predicted good.
THRESHOLD = 0.7

_FORM = np.arange(256, dtype=np.uint8)
_FORM[0x30:0x3A] = ord("0")
_FORM[0x41:0x5B] = 1  # upper case
_FORM[0x61:0x7B] = ord("a")
_FORM[0x80:] = ord("a")
_SAME = (1 << WORD_BITS) + 2 * (1 << FORM_BITS)
#: Pairs of words, hashed to as many weights as single ones.
_PAIRS = _SAME + 2
#: One weight for each doubling of the number of words, for texts too short to show their words' kind.
_LENGTH, LENGTH_VALUE = _PAIRS + (1 << WORD_BITS), 0.5
SIZE = _LENGTH + 32 + 1


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Weights' numbers in order and their values; those of words and pairs have length 1 in all, the last is the bias."""
    raw = (text or "").encode()
    words = word_hashes(raw)
    if not len(words):
        return np.array([SIZE - 1], np.int32), np.ones(1, np.float32)
    codes = _FORM[np.frombuffer(raw, np.uint8)]
    keep = np.ones(len(codes), bool)
    keep[1:] = codes[1:] != codes[:-1]
    forms = word_hashes(codes[keep].tobytes())
    ids = [words >> np.uint64(64 - WORD_BITS), (forms >> np.uint64(64 - FORM_BITS)) + np.uint64(1 << WORD_BITS)]
    if len(forms) > 1:
        pairs = forms[:-1] * np.uint64(0x9E3779B97F4A7C15) + forms[1:]
        ids.append((pairs >> np.uint64(64 - FORM_BITS)) + np.uint64((1 << WORD_BITS) + (1 << FORM_BITS)))
    if len(words) > 1:
        pairs = (words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) * np.uint64(0xD6E8FEB86659FD93)
        ids.append((pairs >> np.uint64(64 - WORD_BITS)) + np.uint64(_PAIRS))
        ids.append(np.where(words[:-1] == words[1:], np.uint64(_SAME), np.uint64(_SAME + 1)))
    where, counts = np.unique(np.concatenate(ids).astype(np.int32), return_counts=True)
    values = np.log1p(counts).astype(np.float32)
    values /= np.sqrt((values * values).sum())
    length = _LENGTH + min(31, len(words).bit_length())
    return np.append(where, np.array([length, SIZE - 1], np.int32)), np.append(values, np.array([LENGTH_VALUE, 1], np.float32))


class Leader:
    """Follow-the-regularised-leader logistic regression with per-weight rates."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(SIZE), np.zeros(SIZE)

    def _at(self, ids: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, ids: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self._at(ids)
        g = (probability(float(w @ values)) - label) * values
        n = self.n[ids]
        grown = n + g * g
        self.z[ids] += g - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
        self.n[ids] = grown

    def weights(self) -> np.ndarray:
        return self._at(slice(None)).astype(np.float32)


def probability(x: float) -> float:
    return float(1 / (1 + np.exp(-min(35.0, max(-35.0, x)))))


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights learned from labelled documents outside the held-out fold; zeros without any."""
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality")).where("doc_id is not null and quality is not null").where(~held_out())
    marked = marked.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    sample = bounded_sample(marked, "doc_id", SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.tobytes() for a, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())], ["doc_id", "label", "ids", "vals"])

    found = texts.select("doc_id", "text", "label").mapInArrow(take, "doc_id long, label int, ids binary, vals binary").toArrow()
    ids, vals, marks = found["ids"], found["vals"], found["label"].to_pylist()
    keys = (np.array(found["doc_id"].to_pylist(), dtype=np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).tolist()
    # The same order however rows arrive: by a hash of the id, and rows of one id by what they hold.
    order = sorted(range(len(marks)), key=lambda k: (keys[k], ids[k].as_py(), vals[k].as_py()))
    leader = Leader()
    for _ in range(PASSES):
        for k in order:
            leader.learn(np.frombuffer(ids[k].as_buffer(), np.int32), np.frombuffer(vals[k].as_buffer(), np.float32), marks[k])
    return leader.weights()


RESULT = "doc_id long, held_out boolean, score double, predicted int"


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labels.quality and scores every whole text.

    docs: doc_id, text; labels: doc_id, quality (0 or 1; null labels are skipped, repeated ones
    averaged). Returns a row per input row: doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD). A null,
    empty or blank text has the score of the bias alone; without labels every score is 0.5. Repeated rows
    give repeated rows, and each row of a labelled id is learned from; a null doc_id is scored and not held out. Texts of any
    length are read whole; equal texts have equal scores, and one of THRESHOLD counts as good. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # SIZE weights, whatever the corpus

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            scores = []
            for text in batch.column(2):
                ids, values = features(text.as_py())
                scores.append(probability(float(weights[ids] @ values)))
            scored = np.array(scores, np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scored), pa.array((scored >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(score, RESULT)
