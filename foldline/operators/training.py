"""Training over a table of examples: every task of a barrier stage holds its share of the rows and the whole, small model.

A step is a batch: rows are dealt to an epoch's batches by a hash of seed, epoch and row, so a batch holds the same rows
however many tasks there are. Each task makes the gradient of its own rows of the batch, the tasks exchange gradients, and all
take the same step. The driver receives the log and the weights. If an executor is lost Spark runs the stage again from its start.
"""

from __future__ import annotations

import base64
import json
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.operators.network import Adam, Model, MovingAverage, checked, loss_and_slope, slopes


def batch_of(ids: np.ndarray, seed: int, epoch: int, batches: int) -> np.ndarray:
    """The batch of each row in an epoch."""
    h = ids.astype(np.int64).view(np.uint64) + np.uint64((seed * 1_000_003 + epoch) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, mix in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(mix)
    return (h % np.uint64(batches)).astype(np.int64)


def exchanged(context: BarrierTaskContext, arrays: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Every task's arrays, in the order of tasks."""
    sent = base64.b64encode(pickle.dumps(arrays)).decode()
    return [pickle.loads(base64.b64decode(m)) for m in context.allGather(sent)]


class Share:
    """One task's rows, standardised, and its part in the steps."""

    def __init__(self, context: BarrierTaskContext, batches: Iterator[pa.RecordBatch], model: Model):
        ids, train, x, y = [], [], [], []
        width = len(model.mean)
        for b in batches:
            ids.append(b.column(0).to_numpy(zero_copy_only=False))
            train.append(b.column(1).to_numpy(zero_copy_only=False))
            for part, c in ((x, 2), (y, 3)):
                part.append(b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width))
        join = lambda parts, empty: np.concatenate(parts) if parts else empty
        self.ids, self.is_train = join(ids, np.empty(0, np.int64)), join(train, np.empty(0, bool)).astype(bool)
        self.x, self.y = checked(join(x, np.empty((0, width))), join(y, np.empty((0, width))), model.mean, model.std)
        order = np.argsort(self.ids, kind="stable")
        self.ids, self.is_train, self.x, self.y = self.ids[order], self.is_train[order], self.x[order], self.y[order]
        self.context, self.model = context, model

    def step(self, rows: np.ndarray, loss: str, gradient: str, commitment: float) -> tuple[float, int, list[list[np.ndarray]], np.ndarray]:
        """Of the whole batch: mean loss, rows, gradients, and latents in order of the rows' ids."""
        value, z, grads = slopes(self.model, self.x[rows], self.y[rows], loss, gradient, commitment) if len(rows) else (0.0, None, None)
        own = [np.array([len(rows), value * len(rows)])] + ([self.ids[rows], z] + [g * len(rows) for part in grads for g in part] if len(rows) else [])
        got = [m for m in exchanged(self.context, own) if m[0][0]]
        n = int(sum(m[0][0] for m in got))
        if not n:
            return 0.0, 0, [], np.empty((0, 0))
        total = [sum(m[3 + k] for m in got) / n for k in range(len(got[0]) - 3)]
        split = len(self.model.encoder.weights)
        order = np.argsort(np.concatenate([m[1] for m in got]), kind="stable")
        return float(sum(m[0][1] for m in got) / n), n, [total[:split], total[split:]], np.concatenate([m[2] for m in got])[order]

    def validate(self, loss: str) -> dict:
        """val_loss as a mean over rows, perplexity and unused states over all validation rows."""
        rows = np.flatnonzero(~self.is_train)
        counts, value = np.zeros(self.model.config["n_states"]), 0.0
        if len(rows):
            states, q = self.model.quantize(self.model.encoder.forward(self.x[rows]))
            value, counts = loss_and_slope(self.model.decoder.forward(q), self.y[rows], loss)[0] * len(rows), np.bincount(states, minlength=len(counts)).astype(float)
        value, n, counts = (sum(p) for p in zip(*exchanged(self.context, [np.float64(value), np.float64(len(rows)), counts])))
        if not n:
            return {"val_loss": None, "perplexity": None, "dead_states": len(counts)}
        u = counts / n
        return {"val_loss": float(value / n), "perplexity": float(np.exp(-(u * np.log(u + 1e-10)).sum())), "dead_states": int((counts == 0).sum())}


def train_table(model: Model, examples: DataFrame, tasks: int, *, epochs: int = 50, batch: int = 512, lr: float = 1e-3, decay: float = 0.01, loss: str = "smooth_l1", scheduler: str = "none", patience: int = 5, commitment: float = 0.25, gradient: str = "ste", seed: int = 0, clip_norm: float = 1.0, ema_decay: float = 0.99, min_count: float = 1.0, warm_up: int = 500) -> list[dict]:
    """Trains model on a table and gives its log; the model gets the weights of the best validation loss (the last, without validation rows).

    examples: id (long, of one row each), split (train or val), x and y (arrays of features). tasks: how many run at once, which the
    cluster must have room for. An epoch has n // batch batches of about that many rows. Null features are an error.
    """
    n = examples.where("split = 'train'").count()
    if n < batch:
        raise ValueError(f"{n} rows do not fill a batch of {batch}")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        share, nets = Share(context, rows, model), (model.encoder, model.decoder)
        own = np.flatnonzero(share.is_train)
        adam = Adam(nets, decay, clip_norm)
        ema = MovingAverage(model.codes, decay=ema_decay, warm_up=warm_up, dead=min_count, seed=seed, normalize=model.config.get("l2_normalize", True)) if model.codes is not None else None
        log, best, kept, waited = [], np.inf, None, 0
        for epoch in range(epochs):
            rate = lr * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) if scheduler == "cosine" else 1.0)
            at, losses = batch_of(share.ids[own], seed, epoch, n // batch), []
            for k in range(n // batch):
                value, size, grads, z = share.step(own[at == k], loss, gradient, commitment)
                if not size:
                    continue
                if ema is not None:
                    ema.update(z)
                    model.codes = ema.codes
                adam.step(grads, rate)
                losses.append(value)
            row = {"epoch": epoch, "train_loss": float(np.mean(losses))} | share.validate(loss)
            log.append(row)
            if row["val_loss"] is None or row["val_loss"] < best:
                best, waited = row["val_loss"] if row["val_loss"] is not None else best, 0
                kept = pickle.dumps(([w.copy() for w in model.encoder.weights], [w.copy() for w in model.decoder.weights], None if model.codes is None else model.codes.copy()))
            elif (waited := waited + 1) >= patience:
                break
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(log)]), pa.array([kept], pa.binary())], ["log", "weights"])

    rows = examples.select(F.col("id").cast("long"), (F.col("split") == "train").alias("train"), *(F.col(c).cast("array<float>") for c in "xy"))
    (found,) = rows.repartition(tasks, "id").mapInArrow(run, "log string, weights binary", barrier=True).collect()  # one row
    model.encoder.weights, model.decoder.weights, model.codes = pickle.loads(found["weights"])
    return json.loads(found["log"])
