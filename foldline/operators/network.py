"""The encoder, quantizer and decoder: a small network trained by one process and applied by all.

Forty thousand weights need no distributed training; preparing its input and encoding structures do,
and are Spark's. Gradients are written out by hand in NumPy.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldline.functions.quantize import LETTERS, basis
from foldline.operators.codebook import MovingAverage

FEATURES, HIDDEN = 10, 64
QUANTIZERS, LOSSES, SCHEDULERS = ("vq", "ema_vq", "fsq"), ("smooth_l1", "mse"), ("none", "cosine")


def _silu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    return x * s, s * (1 + x * (1 - s))


class Mlp:
    """Linear, `depth` residual blocks of norm, SiLU, linear, SiLU, linear, then norm, SiLU, linear."""

    def __init__(self, n_in: int, n_hidden: int, n_out: int, depth: int, rng: np.random.Generator):
        linear = lambda a, b: [rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)]
        norm = lambda: [np.ones(n_hidden), np.zeros(n_hidden)]
        self.depth, self.weights = depth, linear(n_in, n_hidden)
        for _ in range(depth):
            self.weights += norm() + linear(n_hidden, n_hidden) + linear(n_hidden, n_hidden)
        self.weights += norm() + linear(n_hidden, n_out)

    def forward(self, x: np.ndarray) -> np.ndarray:
        w = iter(self.weights)
        self.tape: list = []
        x = self._linear(x, w)
        for _ in range(self.depth):
            y = self._act(self._norm(x, w))
            y = self._act(self._linear(y, w))
            x = x + self._linear(y, w)
        return self._linear(self._act(self._norm(x, w)), w)

    def _linear(self, x, w):
        a, b = next(w), next(w)
        self.tape.append(("linear", x, a))
        return x @ a + b

    def _norm(self, x, w):
        g, b = next(w), next(w)
        mean, sd = x.mean(1, keepdims=True), np.sqrt(x.var(1, keepdims=True) + 1e-5)
        n = (x - mean) / sd
        self.tape.append(("norm", n, sd, g))
        return n * g + b

    def _act(self, x):
        y, slope = _silu(x)
        self.tape.append(("act", slope))
        return y

    def backward(self, d: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Gradients of the input and of the weights, in the weights' order."""
        grads: list[np.ndarray] = []

        def back(d: np.ndarray, count: int) -> np.ndarray:
            for _ in range(count):
                kind, *kept = self.tape.pop()
                if kind == "linear":
                    x, a = kept
                    grads.extend((d.sum(0), x.T @ d))
                    d = d @ a.T
                elif kind == "norm":
                    n, sd, g = kept
                    grads.extend((d.sum(0), (d * n).sum(0)))
                    d = d * g
                    d = (d - d.mean(1, keepdims=True) - n * (d * n).mean(1, keepdims=True)) / sd
                else:
                    d = d * kept[0]
            return d

        d = back(d, 3)
        for _ in range(self.depth):
            d = d + back(d, 5)
        d = back(d, 1)
        return d, grads[::-1]


class Model:
    """Encoder, quantizer, decoder, scaler and provenance."""

    def __init__(self, config: dict, encoder: Mlp, decoder: Mlp, codes: np.ndarray | None, mean: np.ndarray, std: np.ndarray):
        self.config, self.encoder, self.decoder, self.codes, self.mean, self.std = config, encoder, decoder, codes, mean, std

    @classmethod
    def fresh(cls, seed: int = 0, quantizer: str = "fsq", levels: list[int] | None = None, n_states: int = 20, z_dim: int = 2, provenance: dict | None = None, hidden: int = HIDDEN, features: int = FEATURES, normalize: bool = True) -> Model:
        if quantizer not in QUANTIZERS:
            raise ValueError(f"quantizer must be one of {', '.join(QUANTIZERS)}")
        levels = list(levels or [5, 4]) if quantizer == "fsq" else None
        if levels:
            n_states, z_dim = int(np.prod(levels)), len(levels)
        if n_states > len(LETTERS):
            raise ValueError(f"at most {len(LETTERS)} states have a letter")
        rng = np.random.default_rng(seed)
        encoder, decoder = Mlp(features, hidden, z_dim, 3, rng), Mlp(z_dim, hidden, features, 2, rng)
        codes = None if levels else rng.standard_normal((n_states, z_dim))
        config = {"quantizer": quantizer, "levels": levels, "n_states": n_states, "z_dim": z_dim, "letters": LETTERS[:n_states], "hidden_dim": hidden, "input_dim": features, "l2_normalize": normalize} | (provenance or {})
        return cls(config, encoder, decoder, codes, np.zeros(features), np.ones(features))

    def quantize(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and quantized latents."""
        if self.codes is not None:
            scaled = (lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)) if self.config.get("l2_normalize", True) else (lambda v: v)
            unit, codes = scaled(z), scaled(self.codes)
            states = ((codes**2).sum(1) - 2 * unit @ codes.T).argmin(1)
            return states, codes[states]
        t, levels = np.tanh(z), self.config["levels"]
        states, out = np.zeros(len(z), np.int64), np.empty_like(t)
        for k, (n, b) in enumerate(zip(levels, basis(levels))):
            shift = 0 if n % 2 else 1 / n
            digit = np.clip(np.rint((t[:, k] + 1 - shift) / 2 * (n - 1)), 0, n - 1)
            out[:, k] = digit / max(n - 1, 1) * (2 - 2 * shift) - 1 + shift
            states += digit.astype(np.int64) * b
        return states, out

    def encode(self, features: np.ndarray) -> np.ndarray:
        return self.quantize(self.encoder.forward((features - self.mean) / self.std))[0]

    def decode(self, features: np.ndarray) -> np.ndarray:
        return self.decoder.forward(self.quantize(self.encoder.forward((features - self.mean) / self.std))[1])

    def save(self, folder: str) -> None:
        """A directory on the driver: weights.npz, config.json, scaler.json and codebook.npy or fsq_levels.json."""
        os.makedirs(folder, exist_ok=True)
        np.savez(f"{folder}/weights.npz", **{f"{part}_{k}": w for part, net in (("encoder", self.encoder), ("decoder", self.decoder)) for k, w in enumerate(net.weights)})
        for name, value in (("config", self.config), ("scaler", {"mean": self.mean.tolist(), "std": self.std.tolist()})):
            with open(f"{folder}/{name}.json", "w") as f:
                json.dump(value, f, indent=2, sort_keys=True, allow_nan=False)
        if self.codes is None:
            with open(f"{folder}/fsq_levels.json", "w") as f:
                json.dump(self.config["levels"], f)
        else:
            np.save(f"{folder}/codebook.npy", self.codes)

    @classmethod
    def load(cls, folder: str) -> Model:
        """Reads save()'s directory; anything missing, of a wrong shape or not finite raises ValueError."""
        try:
            with open(f"{folder}/config.json") as f:
                config = json.load(f)
            with open(f"{folder}/scaler.json") as f:
                scaler = json.load(f)
            stored = np.load(f"{folder}/weights.npz")
        except (OSError, json.JSONDecodeError) as e:
            raise ValueError(f"not a model directory: {e}") from e
        if config.get("quantizer") not in QUANTIZERS:
            raise ValueError("config.json: unknown quantizer")
        model = cls.fresh(0, config["quantizer"], config.get("levels"), config.get("n_states", 20), config.get("z_dim", 2), hidden=config.get("hidden_dim", HIDDEN), features=config.get("input_dim", FEATURES), normalize=config.get("l2_normalize", True))
        model.config = config
        if len(config.get("letters", "")) != config["n_states"] or len(set(config["letters"])) != config["n_states"]:
            raise ValueError("config.json: letters must be as many as states, and different")
        for part, net in (("encoder", model.encoder), ("decoder", model.decoder)):
            for k, w in enumerate(net.weights):
                found = stored.get(f"{part}_{k}")
                if found is None or found.shape != w.shape or not np.isfinite(found).all():
                    raise ValueError(f"weights.npz: {part}_{k} is missing, of another shape or not finite")
                net.weights[k] = found
        model.mean, model.std = (np.array(scaler.get(k, []), float) for k in ("mean", "std"))
        width = (config.get("input_dim", FEATURES),)
        if model.mean.shape != width or model.std.shape != width or not np.isfinite(model.mean).all() or not (np.isfinite(model.std) & (model.std > 0)).all():
            raise ValueError("scaler.json: mean and std must be finite, and std positive")
        if model.codes is None:
            with open(f"{folder}/fsq_levels.json") as f:
                if json.load(f) != config["levels"]:
                    raise ValueError("fsq_levels.json and config.json differ")
        else:
            codes = np.load(f"{folder}/codebook.npy")
            if codes.shape != (config["n_states"], config["z_dim"]) or not np.isfinite(codes).all():
                raise ValueError("codebook.npy: wrong shape or not finite")
            model.codes = codes
        return model


def rotation_gradient(z: np.ndarray, q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The gradient at z of the quantized q by the rotation that carries z's direction to q's, scaled by their lengths."""
    size = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-8)
    e, f = z / size, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-8)
    r = e + f
    r /= np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-8)
    turned = d - 2 * (d * r).sum(1, keepdims=True) * r + 2 * (d * f).sum(1, keepdims=True) * e
    return turned * np.linalg.norm(q, axis=1, keepdims=True) / size


def loss_and_slope(p: np.ndarray, y: np.ndarray, kind: str) -> tuple[float, np.ndarray]:
    d = p - y
    if kind == "mse":
        return float((d * d).mean()), 2 * d / d.size
    small = np.abs(d) < 1
    return float(np.where(small, 0.5 * d * d, np.abs(d) - 0.5).mean()), np.where(small, d, np.sign(d)) / d.size


def checked(x: np.ndarray, y: np.ndarray, mean: np.ndarray, std: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Standardised pairs; raises ValueError for a bad scaler or values that are not finite."""
    if not (np.isfinite(mean).all() and np.isfinite(std).all() and (std > 0).all()):
        raise ValueError("scaler must be finite, and std positive")
    x, y = (x - mean) / std, (y - mean) / std
    if bad := int((~np.isfinite(x)).sum() + (~np.isfinite(y)).sum()):
        raise ValueError(f"{bad} values are not finite")
    return x, y


def batches_by_alignment(alignments: np.ndarray, size: int, least: int, seed: int, epoch: int) -> Iterator[np.ndarray]:
    """len // size full batches of rows, in an order by seed and epoch, that span as many alignments as they can.

    Rows stand by alignment, both shuffled, and are dealt to the batches in turn. least: a batch that spans fewer, where there are so
    many alignments, is an error, as one alignment then has more rows than a batch of this size can avoid.
    """
    rng = np.random.default_rng([seed, epoch])
    rows = rng.permutation(len(alignments))
    names, where = np.unique(alignments, return_inverse=True)
    by = rows[np.argsort(rng.permutation(len(names))[where[rows]], kind="stable")]
    batches = len(by) // size
    for k in range(batches):
        batch = by[k : batches * size : batches]
        if len(np.unique(where[batch])) < min(least, len(names)):
            raise ValueError(f"a batch of {size} rows spans fewer than {least} alignments")
        yield rng.permutation(batch)


def slopes(model: Model, x: np.ndarray, y: np.ndarray, loss: str, gradient: str, commitment: float) -> tuple[float, np.ndarray, list[list[np.ndarray]]]:
    """A batch's mean loss, its latents, and the gradients of the encoder's and decoder's weights."""
    z, learned = model.encoder.forward(x), model.codes is not None
    _, q = model.quantize(z)
    value, slope = loss_and_slope(model.decoder.forward(q), y, loss)
    dq, g_dec = model.decoder.backward(slope)
    dz = rotation_gradient(z, q, dq) if gradient == "rotation" and learned else dq
    dz = dz + commitment * 2 * (z - q) / z.size if learned else dz * (1 - np.tanh(z) ** 2)
    _, g_enc = model.encoder.backward(dz)
    return value, z, [g_enc, g_dec]


class Adam:
    """AdamW with clipped gradients over the weights of nets."""

    def __init__(self, nets: tuple[Mlp, ...], decay: float, clip_norm: float):
        self.nets, self.decay, self.clip_norm, self.steps = nets, decay, clip_norm, 0
        self.moments = [[(np.zeros_like(w), np.zeros_like(w)) for w in net.weights] for net in nets]

    def step(self, grads: list[list[np.ndarray]], rate: float) -> None:
        size = np.sqrt(sum(float((g * g).sum()) for part in grads for g in part))
        clip, self.steps = min(1.0, self.clip_norm / (size + 1e-6)), self.steps + 1
        for net, part, moment in zip(self.nets, grads, self.moments):
            for k, g in enumerate(part):
                m, v = moment[k]
                m += 0.1 * (g * clip - m)
                v += 0.001 * ((g * clip) ** 2 - v)
                w = net.weights[k]
                if w.ndim > 1:
                    w *= 1 - rate * self.decay
                w -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


def train(model: Model, train_xy: tuple[np.ndarray, np.ndarray], val_xy: tuple[np.ndarray, np.ndarray], *, epochs: int = 50, batch: int = 512, lr: float = 1e-3, decay: float = 0.01, loss: str = "smooth_l1", scheduler: str = "none", patience: int = 5, commitment: float = 0.25, gradient: str = "ste", seed: int = 0, clip_norm: float = 1.0, ema_decay: float = 0.99, min_count: float = 1.0, warm_up: int = 500) -> list[dict]:
    """AdamW with clipped gradients; stops when the validation loss has not improved, and restores the best weights. Returns the log."""
    if loss not in LOSSES or scheduler not in SCHEDULERS or gradient not in ("ste", "rotation"):
        raise ValueError(f"loss: {', '.join(LOSSES)}; scheduler: {', '.join(SCHEDULERS)}; gradient: ste, rotation")
    (x, y), (vx, vy) = (checked(*xy, model.mean, model.std) for xy in (train_xy, val_xy))
    if len(x) < batch:
        raise ValueError(f"{len(x)} rows do not fill a batch of {batch}")
    nets = (model.encoder, model.decoder)
    adam = Adam(nets, decay, clip_norm)
    ema = MovingAverage(model.codes, decay=ema_decay, warm_up=warm_up, dead=min_count, seed=seed, normalize=model.config.get("l2_normalize", True)) if model.codes is not None else None
    log, best, best_weights, waited = [], np.inf, None, 0
    for epoch in range(epochs):
        rate = lr * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) if scheduler == "cosine" else 1.0)
        order, losses = np.random.default_rng([seed, epoch]).permutation(len(x)), []
        for at in range(0, len(order) - batch + 1, batch):
            rows = order[at : at + batch]
            if ema is not None:
                model.codes = ema.codes
            value, z, grads = slopes(model, x[rows], y[rows], loss, gradient, commitment)
            if ema is not None:
                ema.update(z)
                model.codes = ema.codes
            adam.step(grads, rate)
            losses.append(value)
        row = {"epoch": epoch, "train_loss": float(np.mean(losses))} | evaluate(model, vx, vy, batch, loss)
        log.append(row)
        if row["val_loss"] < best:
            best, waited = row["val_loss"], 0
            best_weights = ([w.copy() for net in nets for w in net.weights], None if model.codes is None else model.codes.copy())
        elif (waited := waited + 1) >= patience:
            break
    if best_weights:
        weights, model.codes = best_weights
        for net in nets:
            net.weights, weights = weights[: len(net.weights)], weights[len(net.weights) :]
    return log


def evaluate(model: Model, x: np.ndarray, y: np.ndarray, batch: int, loss: str) -> dict:
    """val_loss and perplexity as means over batches, and the states that no row has."""
    values, perplexities, counts = [], [], np.zeros(model.config["n_states"], np.int64)
    for at in range(0, len(x), batch):
        states, q = model.quantize(model.encoder.forward(x[at : at + batch]))
        values.append(loss_and_slope(model.decoder.forward(q), y[at : at + batch], loss)[0])
        own = np.bincount(states, minlength=len(counts))
        u = own / own.sum()
        perplexities.append(float(np.exp(-(u * np.log(u + 1e-10)).sum())))
        counts += own
    return {"val_loss": float(np.mean(values)), "perplexity": float(np.mean(perplexities)), "dead_states": int((counts == 0).sum())}


def encode_states(rows: DataFrame, model: Model) -> DataFrame:
    """rows (feat: array<float> of ten) with state, null where feat is null or not whole."""
    shared, width = rows.sparkSession.sparkContext.broadcast(model), len(model.mean)
    at = rows.columns.index("feat")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feats = batch.column(at).to_pylist()
            good = [k for k, f in enumerate(feats) if f is not None and len(f) == width and None not in f]
            states: list[int | None] = [None] * len(feats)
            if good:
                for k, s in zip(good, shared.value.encode(np.array([feats[k] for k in good], np.float64)).tolist()):
                    states[k] = s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, pa.int32())], [*batch.schema.names, "state"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("state", T.IntegerType())]))


def discretize(model: Model | Mlp, features: np.ndarray, centroids: np.ndarray | None = None) -> np.ndarray:
    """States of features: a model's own, or the nearest of the given centroids to a bare encoder's latents."""
    if isinstance(model, Model):
        return model.encode(features)
    if centroids is None:
        raise ValueError("an encoder without a quantizer needs centroids")
    z = model.forward(features)
    return ((centroids**2).sum(1) - 2 * z @ centroids.T).argmin(1)


def jittered(rows: DataFrame, columns: list[str], std: float, seed: int) -> DataFrame:
    """rows with Gaussian noise on the coordinates (arrays of three) of valid ones; unchanged for std <= 0."""
    if std <= 0:
        return rows
    noisy = lambda c, n: F.when(F.col("valid"), F.array(*(F.get(c, F.lit(k)) + F.randn(seed + 3 * n + k) * std for k in range(3)))).otherwise(F.col(c))
    return rows.withColumns({c: noisy(c, n).cast(rows.schema[c].dataType) for n, c in enumerate(columns)})


def sequences(rows: DataFrame) -> DataFrame:
    """sid, seq: a letter for each residue in order, X where there is no state."""
    from foldline.functions.quantize import letter

    ordered = F.array_sort(F.collect_list(F.struct("idx", letter(F.col("state")).alias("ch"))))
    return rows.groupBy("sid").agg(F.array_join(F.transform(ordered, lambda x: x.ch), "").alias("seq"))


def jitter(coords: np.ndarray, valid: np.ndarray, std: float, rng: np.random.Generator) -> np.ndarray:
    """coords with Gaussian noise on valid rows; unchanged for std <= 0."""
    if std <= 0:
        return coords
    out = coords.copy()
    out[valid] += rng.normal(0, std, out[valid].shape).astype(out.dtype)
    return out
