"""Language identification by multilingual mixture inference.

A language is a distribution over hashed byte n-grams of lower-cased letters. A document is a mixture of
languages: expectation-maximisation estimates the proportions from its n-grams' likelihoods. Which
languages take part is chosen by penalised likelihood: from all, the smallest is left out as long
as the log-likelihood it adds is less than the penalty for its parameter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldline.llm.sampling import bounded_sample, held_out
from foldline.llm.shared import fresh_name

#: Labelled documents that the distributions are fitted on, at most (chosen by a hash of doc_id).
SAMPLE = 12_000
BINS_LOG2, GRAM = 15, 4
SMOOTHING = 0.5
#: Log-likelihood that a language has to add, in units of log(n) / 2; overlapping n-grams repeat evidence.
PENALTY = 8.0
ROUNDS, SETTLED = 30, 1e-3
UNDETERMINED = "und"

_letter = regex.compile(r"\p{L}").search
_CLASS = np.zeros(256, np.uint32)
_CLASS[0x61:0x7B] = np.arange(1, 27)
_CLASS[0x80:] = np.arange(27, 155)


def grams(text: str) -> np.ndarray:
    """The bin of each n-gram of letters; what is no letter counts as one blank."""
    codes = _CLASS[np.frombuffer(text.lower().encode(), np.uint8)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
    codes = np.concatenate((np.zeros(1, np.uint32), codes[keep], np.zeros(GRAM - 1, np.uint32)))
    n = len(codes) - GRAM + 1
    mixed = codes[:n].copy()
    for k in range(1, GRAM):
        mixed = mixed * np.uint32(0x01000193) + codes[k : n + k]
    mixed *= np.uint32(0x9E3779B1)
    return (mixed >> np.uint32(32 - BINS_LOG2)).astype(np.int64)


class Mixture:
    """The learned languages; log_p has a row for each bin."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        p = counts + SMOOTHING
        self.log_p = np.log(p / p.sum(0)).astype(np.float32)

    def proportions(self, text: str) -> np.ndarray:
        """Each language's share of the text; zero for those that are not selected."""
        ids = grams(text)
        total = len(ids)
        if total > 4096:
            counts = np.bincount(ids, minlength=1 << BINS_LOG2)
            ids = np.flatnonzero(counts)
            counts = counts[ids].astype(np.float32)
        else:
            counts = np.ones(total, np.float32)
        log_p = self.log_p[ids]
        top = log_p.max(1, keepdims=True)
        p = np.exp(log_p - top)
        floor = float(counts @ top[:, 0])
        single = counts @ log_p
        chosen = np.arange(len(self.languages))
        penalty = PENALTY * math.log(max(total, 2)) / 2
        share = np.zeros(len(chosen))
        share[int(single.argmax())] = 1.0
        best_single = float(single.max())
        while len(chosen) > 1:
            pi = self._em(p[:, chosen], counts)
            likelihood = floor + float(counts @ np.log(np.maximum(p[:, chosen] @ pi, 1e-30)))
            if likelihood - best_single < penalty * (len(chosen) - 1):
                # This mixture is not worth its parameters; the smallest language goes.
                if len(chosen) == 2:
                    break
                chosen = np.delete(chosen, int(pi.argmin()))
                continue
            small = int(pi.argmin())
            if len(chosen) > 2:
                rest = np.delete(chosen, small)
                pi_rest = self._em(p[:, rest], counts)
                if likelihood - floor - float(counts @ np.log(np.maximum(p[:, rest] @ pi_rest, 1e-30))) < penalty:
                    chosen = rest
                    continue
            share[:] = 0
            share[chosen] = pi
            break
        return share

    @staticmethod
    def _em(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        pi = np.full(p.shape[1], 1 / p.shape[1], np.float32)
        for _ in range(ROUNDS):
            joint = p * pi
            new = (counts / np.maximum(joint.sum(1), 1e-30)) @ joint
            new /= new.sum()
            moved = float(np.abs(new - pi).max())
            pi = new
            if moved < SETTLED:
                break
        return pi


def fit(docs: DataFrame) -> Mixture | None:
    """Learns from text and non-null lang of documents outside the held-out fold; None without any."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                if lang not in found:
                    found[lang] = np.zeros(1 << BINS_LOG2, np.int64)
                found[lang] += np.bincount(grams(text.as_py()), minlength=1 << BINS_LOG2)
        for lang, counts in found.items():
            there = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array(there, pa.int32()), pa.array(counts[there], pa.int64())], ["lang", "bin", "n"])

    sample = bounded_sample(rows, "doc_id", SAMPLE).select("text", "lang")
    found = sample.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()  # bins x languages
    languages = sorted({r["lang"] for r in found})
    if not languages:
        return None
    counts = np.zeros((1 << BINS_LOG2, len(languages)))
    at = {lang: k for k, lang in enumerate(languages)}
    for r in found:
        counts[r["bin"], at[r["lang"]]] = r["n"]
    return Mixture(languages, counts)


def tag(docs: DataFrame, model: Mixture | None, lang: str, score: str) -> DataFrame:
    """docs, with all its columns, and two more of these names: the language of each whole text, and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bins x languages, whatever the corpus
    at = docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = shared.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column(at):
                text = text.as_py()
                if mixture is None or not text or not _letter(text):
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                share = mixture.proportions(text)
                best = int(share.argmax())
                names.append(mixture.languages[best])
                scores.append(min(1.0, float(share[best])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, lang, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(predict, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Fits the mixture and predicts each whole text's main language.

    docs: doc_id, text, lang. Returns a row per input row: doc_id, held_out, lang_pred (a learned
    lang, or "und" if text is null or has no letter, or nothing could be learned), score (the main
    language's share in the selected mixture, 0 for "und"). Repeated rows give repeated rows;
    ties go to the language first in order; a null doc_id is not held out. Texts of any length are read
    whole; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return tag(rows, fit(docs), "lang_pred", "score").select("doc_id", "held_out", "lang_pred", "score")


def with_language(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language is undetermined; lang is the predicted one, other columns stay.

    A null, empty or letterless text is undetermined. If nothing could be learned (no row has a lang), nothing is
    rejected and lang stays. Repeated rows and rows with a null doc_id are judged by their text alike; an empty table gives no rows.
    """
    model = fit(docs)
    if model is None:
        return docs
    lang, score = (fresh_name(x, docs.columns) for x in ("lang_pred", "lang_score"))
    return tag(docs, model, lang, score).where(F.col(lang) != UNDETERMINED).withColumn("lang", F.col(lang)).select(*docs.columns)
