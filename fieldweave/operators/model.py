"""The encoder of names and the classifier of pairs: small enough for every task to hold.

Encoder: character embeddings, convolutions of several widths, the maximum over all places, one
linear map, unit length. Classifier: two hidden layers over both vectors, their distance and product.
Inference runs inside Spark tasks (see matching). Training is synchronous: the tasks of one barrier
stage hold a part of the pairs each, every batch is dealt over all of them, and the sums of their
gradients, which have the size of the model, are exchanged after each batch.
"""

from __future__ import annotations

import json
import os
import socket
from collections.abc import Callable, Iterator
from contextlib import closing
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.config import MatcherConfig
from fieldweave.functions.text import LABEL_NUMBERS

Weights = dict[str, np.ndarray]


def initial_weights(config: MatcherConfig, vocabulary: int, seed: int) -> Weights:
    rng = np.random.default_rng(seed)

    def layer(n_in: int, n_out: int, name: str) -> Weights:
        bound = 1 / np.sqrt(n_in)
        return {f"{name}.w": rng.uniform(-bound, bound, (n_in, n_out)), f"{name}.b": rng.uniform(-bound, bound, n_out)}

    w: Weights = {"chars": rng.normal(size=(vocabulary, config.char_embedding_dim))}
    w["chars"][0] = 0
    for k in config.cnn_kernel_sizes:
        w |= layer(k * config.char_embedding_dim, config.cnn_channels, f"conv{k}")
    w |= layer(len(config.cnn_kernel_sizes) * config.cnn_channels, config.field_embedding_dim, "out")
    w |= layer(4 * config.field_embedding_dim, config.classifier_hidden_dim, "hidden1")
    w |= layer(config.classifier_hidden_dim, config.classifier_second_hidden_dim, "hidden2")
    return w | layer(config.classifier_second_hidden_dim, 3, "labels")


def encode(w: Weights, kernels: tuple[int, ...], ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Unit vectors of encoded names (rows of ids); ``keep`` gathers what the way back needs."""
    x = w["chars"][ids]
    n, length, dim = x.shape
    pooled = []
    for k in kernels:
        windows = np.lib.stride_tricks.sliding_window_view(x, k, axis=1).transpose(0, 1, 3, 2).reshape(n, length - k + 1, k * dim)
        y = windows @ w[f"conv{k}.w"] + w[f"conv{k}.b"]
        best = y.argmax(axis=1)
        top = np.take_along_axis(y, best[:, None, :], axis=1)[:, 0]
        pooled.append(np.maximum(top, 0))
        if keep is not None:
            keep[k] = windows, best, top > 0
    p = np.concatenate(pooled, axis=1)
    z = p @ w["out.w"] + w["out.b"]
    norm = np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-12)
    if keep is not None:
        keep |= {"ids": ids, "p": p, "v": z / norm, "norm": norm}
    return z / norm


def encode_back(w: Weights, kernels: tuple[int, ...], kept: dict, d_v: np.ndarray) -> Weights:
    """Gradients of the encoder's weights from those of its vectors."""
    v = kept["v"]
    d_z = (d_v - v * (v * d_v).sum(axis=1, keepdims=True)) / kept["norm"]
    grads = {"out.w": kept["p"].T @ d_z, "out.b": d_z.sum(axis=0), "chars": np.zeros_like(w["chars"])}
    d_p = d_z @ w["out.w"].T
    channels, dim = w[f"conv{kernels[0]}.b"].shape[0], w["chars"].shape[1]
    for i, k in enumerate(kernels):
        windows, best, active = kept[k]
        d = d_p[:, i * channels : (i + 1) * channels] * active
        chosen = np.take_along_axis(windows, best[:, :, None], axis=1)  # rows x channels x (k * dim)
        grads[f"conv{k}.w"] = np.einsum("nc,nck->kc", d, chosen)
        grads[f"conv{k}.b"] = d.sum(axis=0)
        back = (d[:, :, None] * w[f"conv{k}.w"].T[None]).reshape(len(d), channels, k, dim)
        places = best[:, :, None] + np.arange(k)[None, None, :]
        tokens = np.take_along_axis(kept["ids"], places.reshape(len(d), channels * k), axis=1).ravel()
        np.add.at(grads["chars"], tokens, back.reshape(-1, dim))
    grads["chars"][0] = 0  # padding stays nothing
    return grads


def pair_features(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate((a, b, np.abs(a - b), a * b), axis=1)


def logits(w: Weights, a: np.ndarray, b: np.ndarray, keep: dict | None = None, mask: np.ndarray | None = None) -> np.ndarray:
    x = pair_features(a, b)
    h1 = np.maximum(x @ w["hidden1.w"] + w["hidden1.b"], 0)
    if mask is not None:
        h1 = h1 * mask
    h2 = np.maximum(h1 @ w["hidden2.w"] + w["hidden2.b"], 0)
    if keep is not None:
        keep |= {"x": x, "h1": h1, "h2": h2, "a": a, "b": b, "mask": mask}
    return h2 @ w["labels.w"] + w["labels.b"]


def logits_back(w: Weights, kept: dict, d: np.ndarray) -> tuple[Weights, np.ndarray, np.ndarray]:
    """Gradients of the classifier's weights and of both vectors."""
    grads = {"labels.w": kept["h2"].T @ d, "labels.b": d.sum(axis=0)}
    d2 = (d @ w["labels.w"].T) * (kept["h2"] > 0)
    grads |= {"hidden2.w": kept["h1"].T @ d2, "hidden2.b": d2.sum(axis=0)}
    d1 = (d2 @ w["hidden2.w"].T) * (kept["h1"] > 0)
    if kept["mask"] is not None:
        d1 = d1 * kept["mask"]
    grads |= {"hidden1.w": kept["x"].T @ d1, "hidden1.b": d1.sum(axis=0)}
    da, db, dist, prod = np.split(d1 @ w["hidden1.w"].T, 4, axis=1)
    a, b = kept["a"], kept["b"]
    sign = np.sign(a - b)
    return grads, da + dist * sign + prod * b, db - dist * sign + prod * a


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cosine_loss(a: np.ndarray, b: np.ndarray, match: np.ndarray, weight: np.ndarray, margin: float, of: int | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss of unit vectors and its gradients: 1 - cos for a match, what exceeds the margin otherwise;
    weights multiply each pair's loss before the mean over the batch, which has ``of`` pairs (these
    alone, if not given)."""
    of = of or len(a)
    cos = (a * b).sum(axis=1)
    loss = np.where(match, 1 - cos, np.maximum(0, cos - margin))
    d = weight * np.where(match, -1.0, (cos > margin).astype(float)) / of
    return float((weight * loss).sum() / of), d[:, None] * b, d[:, None] * a


def label_loss(x: np.ndarray, y: np.ndarray, weight: np.ndarray, of: int | None = None) -> tuple[float, np.ndarray]:
    of = of or len(y)
    p = softmax(x)
    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))
    d = p.copy()
    d[np.arange(len(y)), y] -= 1
    return float((weight * loss).sum() / of), d * weight[:, None] / of


class AdamW:
    def __init__(self, rate: float, decay: float):
        self.rate, self.decay, self.t = rate, decay, 0
        self.m: Weights = {}
        self.v: Weights = {}

    def step(self, w: Weights, grads: Weights) -> None:
        self.t += 1
        for name, g in grads.items():
            m = self.m[name] = 0.9 * self.m.get(name, 0.0) + 0.1 * g
            v = self.v[name] = 0.999 * self.v.get(name, 0.0) + 0.001 * g * g
            w[name] *= 1 - self.rate * self.decay
            w[name] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


@dataclass
class Pairs:
    """Encoded pairs: ids of both names, label numbers, weights, and the number of each among all pairs."""

    a: np.ndarray
    b: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    number: np.ndarray


@dataclass
class ModelBundle:
    """All that inference needs; ``save`` and ``load`` keep it as a directory."""

    config: MatcherConfig
    tokens: list[str]
    weights: Weights
    labels: dict[str, int] = field(default_factory=lambda: dict(LABEL_NUMBERS))

    def encode(self, ids: np.ndarray) -> np.ndarray:
        return encode(self.weights, self.config.cnn_kernel_sizes, ids)

    def probabilities(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return softmax(logits(self.weights, a, b))

    def save(self, folder: str | Path) -> None:
        folder = Path(folder)
        folder.mkdir(parents=True, exist_ok=True)
        self.config.save(folder / "config.json")
        for name, value in (("vocab.json", {"tokens": self.tokens}), ("label_map.json", self.labels)):
            (folder / name).write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
        np.savez(folder / "weights.npz", **self.weights)

    @classmethod
    def load(cls, folder: str | Path) -> ModelBundle:
        folder = Path(folder)
        missing = [n for n in ("config.json", "vocab.json", "label_map.json", "weights.npz") if not (folder / n).is_file()]
        if missing:
            raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
        tokens = json.loads((folder / "vocab.json").read_text(encoding="utf-8-sig"))["tokens"]
        labels = label_map(json.loads((folder / "label_map.json").read_text(encoding="utf-8-sig")))
        with np.load(folder / "weights.npz", allow_pickle=False) as f:
            return cls(MatcherConfig.load(folder / "config.json"), tokens, {k: f[k] for k in f.files}, labels)


#: Other names that callers know it by.
SiameseFieldMatcher = SiameseModel = ModelBundle


def label_map(raw: dict) -> dict[str, int]:
    """Names to numbers, from either direction; the numbers must be those that models are made with."""
    numbers = {str(k): int(v) for k, v in raw.items()} if not all(str(k).isdigit() for k in raw) else {str(v): int(k) for k, v in raw.items()}
    if sorted(numbers.values()) != list(range(len(raw))):
        raise ValueError("the label map must count from 0, without a gap or a repeated number")
    if numbers != LABEL_NUMBERS:
        raise ValueError("the label map is not the known one")
    return numbers


def random_bundle(tokens: list[str], config: MatcherConfig | None = None, seed: int = 0) -> ModelBundle:
    config = config or MatcherConfig(char_embedding_dim=8, cnn_channels=8, field_embedding_dim=16, classifier_hidden_dim=16, classifier_second_hidden_dim=8, max_length=24)
    return ModelBundle(config, tokens, initial_weights(config, len(tokens), seed))


_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _hashed(x: np.ndarray, key: int) -> np.ndarray:
    """64 even bits for each number, others for another key."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(key & (1 << 64) - 1)) * _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def _key(*parts: int) -> int:
    key = 0
    for p in parts:
        key = int(_hashed(np.array([p], dtype=np.uint64), key)[0])
    return key


def permuted(number: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed permutation of 0 .. n - 1 puts each number; every task can tell for its own.

    Feistel rounds permute the least square power of two that holds n; what falls outside goes on
    through them until it is inside.
    """
    half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    low = (np.uint64(1) << half) - np.uint64(1)
    out, left = number.astype(np.uint64), np.arange(len(number))
    while len(left):
        x = out[left]
        high, rest = x >> half, x & low
        for turn in range(6):
            high, rest = rest, high ^ (_hashed(rest, _key(key, turn)) & low)
        out[left] = (high << half) | rest
        left = left[out[left] >= n]
    return out.astype(np.int64)


def kept_units(number: np.ndarray, units: int, dropout: float, key: int) -> np.ndarray:
    """The factor of each hidden unit of each pair: 0 with probability ``dropout``, by a hash."""
    with np.errstate(over="ignore"):
        each = number.astype(np.uint64)[:, None] * np.uint64(units) + np.arange(units, dtype=np.uint64)
    u = (_hashed(each, key) >> np.uint64(11)) / float(1 << 53)
    return (u >= dropout) / (1 - dropout)


class Team(Protocol):
    """Those who train together: ``total`` gives each of them the sum of what all bring."""

    def total(self, x: np.ndarray) -> np.ndarray: ...


class Alone:
    def total(self, x: np.ndarray) -> np.ndarray:
        return x


class Together:
    """The tasks of a barrier stage. They meet once through Spark, to learn where the first of them
    listens; sums then go through its sockets, since each exchange by the barrier itself takes a second.

    The first adds up in the order of the tasks and sends all the same sum. A lost task breaks the
    sockets of the others, and the stage starts again.
    """

    def __init__(self, patience: float = 600) -> None:
        context = BarrierTaskContext.get()
        everyone = context.getTaskInfos()
        self.first = context.partitionId() == 0
        server = socket.create_server(("", 0)) if self.first else None
        meeting = f"{server.getsockname()[1]} {os.urandom(16).hex()}" if server else ""
        port, word = context.allGather(meeting)[0].split()
        if server:
            server.settimeout(patience)
            met: dict[int, socket.socket] = {}
            while len(met) < len(everyone) - 1:
                other = server.accept()[0]
                other.settimeout(patience)
                hello = self._read(other, 36)
                if hello[:32].decode("ascii", "replace") == word:
                    met[int.from_bytes(hello[32:], "little")] = other
                else:
                    other.close()
            server.close()
            self.others = [met[k] for k in sorted(met)]
        else:
            host = everyone[0].address.rsplit(":", 1)[0].strip("[]")
            own = socket.create_connection((host, int(port)), timeout=patience)
            own.sendall(word.encode("ascii") + context.partitionId().to_bytes(4, "little"))
            self.others = [own]
        for s in self.others:
            s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    @staticmethod
    def _read(s: socket.socket, n: int) -> bytearray:
        out = bytearray()
        while len(out) < n:
            got = s.recv(min(n - len(out), 1 << 20))
            if not got:
                raise ConnectionError("another task of the training is gone")
            out += got
        return out

    def total(self, x: np.ndarray) -> np.ndarray:
        if not self.first:
            self.others[0].sendall(x.tobytes())
            return np.frombuffer(self._read(self.others[0], x.nbytes), dtype=x.dtype).copy()
        out = x.copy()
        for s in self.others:
            out += np.frombuffer(self._read(s, x.nbytes), dtype=x.dtype)
        for s in self.others:
            s.sendall(out.tobytes())
        return out

    def close(self) -> None:
        for s in self.others:
            s.close()


def _summed(team: Team, figures: list[float], grads: Weights) -> tuple[list[float], Weights]:
    """Figures and gradients of all together, in one exchange."""
    names = sorted(grads)
    whole = team.total(np.concatenate([np.array(figures, dtype=np.float64), *[grads[k].ravel() for k in names]]))
    out, at = {}, len(figures)
    for k in names:
        out[k] = whole[at : at + grads[k].size].reshape(grads[k].shape)
        at += grads[k].size
    return whole[: len(figures)].tolist(), out


def _epochs(config: MatcherConfig, phase: int, w: Weights, train: Pairs, n: int, step: Callable, check: Callable | None) -> list[dict]:
    """Shuffled batches, early stopping by the validation loss, the best weights restored; without a
    check (no validation pairs) every epoch runs and the last weights stay."""
    best, stale, kept, history = np.inf, 0, {k: v.copy() for k, v in w.items()}, []
    for epoch in range(1, (config.embedding_epochs, config.classifier_epochs)[phase] + 1):
        place = permuted(train.number, n, _key(config.seed, phase, epoch))
        order, total, right = np.argsort(place), 0.0, 0.0
        cuts = np.searchsorted(place[order], np.arange(0, n + config.batch_size, config.batch_size))
        for k in range(-(-n // config.batch_size)):
            size = min(config.batch_size, n - k * config.batch_size)
            loss, hits = step(order[cuts[k] : cuts[k + 1]], size, epoch)
            total += loss * size
            right += hits
        loss, accuracy = check() if check else (None, None)
        history.append({"epoch": epoch, "train_loss": total / n, "train_accuracy": right / n, "validation_loss": loss, "validation_accuracy": accuracy})
        if not check or loss < best - config.early_stopping_min_delta:
            best, stale, kept = loss, 0, {k: v.copy() for k, v in w.items()}
        else:
            stale += 1
            if config.early_stopping_patience and stale >= config.early_stopping_patience:
                break
    w.update(kept)
    return history


def train_model(train: Pairs, validation: Pairs, tokens: list[str], config: MatcherConfig, team: Team | None = None) -> tuple[ModelBundle, dict]:
    """Encoder first (cosine loss), then the classifier (with the encoder, if the settings say so).

    train and validation are all pairs, or those of one of a ``team`` whose others hold the rest; each
    gets the whole model. Batches and dropped units follow from the pairs' numbers, so the same seed
    gives the same weights however the pairs are dealt, but for the last bits of sums. Validation
    pairs weigh 1. Without any (one component of names may hold all rows) all epochs run, and the
    history's validation figures are None.
    """
    team, kernels = team or Alone(), config.cnn_kernel_sizes
    w = initial_weights(config, len(tokens), config.seed)
    n, n_validation = (int(x) for x in team.total(np.array([len(train.label), len(validation.label)], dtype=np.float64)))
    if not n:
        raise ValueError("training needs training pairs")
    ones = np.ones(len(validation.label))

    def vectors(p: Pairs) -> tuple[np.ndarray, np.ndarray]:
        sides = [np.concatenate([np.zeros((0, config.field_embedding_dim)), *[encode(w, kernels, ids[i : i + 512]) for i in range(0, len(ids), 512)]]) for ids in (p.a, p.b)]
        return sides[0], sides[1]

    optimizer = AdamW(config.learning_rate, config.weight_decay)

    def encoder_step(at: np.ndarray, size: int, epoch: int) -> list[float]:
        kept_a, kept_b = {}, {}
        a, b = encode(w, kernels, train.a[at], kept_a), encode(w, kernels, train.b[at], kept_b)
        match = train.label[at] != LABEL_NUMBERS["NO_MATCH"]
        loss, da, db = cosine_loss(a, b, match, train.weight[at], config.cosine_margin, size)
        left, right = encode_back(w, kernels, kept_a, da), encode_back(w, kernels, kept_b, db)
        figures, grads = _summed(team, [loss, float((((a * b).sum(axis=1) >= 0) == match).sum())], {k: left[k] + right[k] for k in left})
        optimizer.step(w, grads)
        return figures

    def encoder_check() -> list[float]:
        a, b = vectors(validation)
        match = validation.label != LABEL_NUMBERS["NO_MATCH"]
        hits = ((a * b).sum(axis=1) >= 0) == match
        return team.total(np.array([cosine_loss(a, b, match, ones, config.cosine_margin, n_validation)[0], hits.sum() / n_validation])).tolist()

    history = {"encoder": _epochs(config, 0, w, train, n, encoder_step, encoder_check if n_validation else None)}
    second = AdamW(config.classifier_learning_rate, config.weight_decay)
    frozen = None if config.fine_tune_encoder else (vectors(train), vectors(validation))

    def classifier_step(at: np.ndarray, size: int, epoch: int) -> list[float]:
        kept_a, kept_b, kept = {}, {}, {}
        if frozen:
            a, b = frozen[0][0][at], frozen[0][1][at]
        else:
            a, b = encode(w, kernels, train.a[at], kept_a), encode(w, kernels, train.b[at], kept_b)
        x = logits(w, a, b, kept, kept_units(train.number[at], config.classifier_hidden_dim, config.dropout, _key(config.seed, 2, epoch)))
        loss, d = label_loss(x, train.label[at], train.weight[at], size)
        grads, da, db = logits_back(w, kept, d)
        if not frozen:
            left, right = encode_back(w, kernels, kept_a, da), encode_back(w, kernels, kept_b, db)
            grads |= {k: left[k] + right[k] for k in left}
        figures, grads = _summed(team, [loss, float((x.argmax(axis=1) == train.label[at]).sum())], grads)
        second.step(w, grads)
        return figures

    def classifier_check() -> list[float]:
        a, b = frozen[1] if frozen else vectors(validation)
        x = logits(w, a, b)
        hits = x.argmax(axis=1) == validation.label
        return team.total(np.array([label_loss(x, validation.label, ones, n_validation)[0], hits.sum() / n_validation])).tolist()

    history["classifier"] = _epochs(config, 1, w, train, n, classifier_step, classifier_check if n_validation else None)
    return ModelBundle(config, tokens, w), history


#: Pairs of a batch that make a task worth while; bytes of all tasks' gradients that the first one gets for a batch; pairs that a task holds.
TASK_PAIRS, EXCHANGED, HELD = 32, 64 << 20, 4_000_000


def training_tasks(config: MatcherConfig, tokens: int, pairs: int, slots: int) -> int:
    """How many tasks train together: no more than slots (a barrier stage runs all at once), enough to hold the pairs."""
    message = sum(x.nbytes for x in initial_weights(config, tokens, 0).values())
    wanted = min(slots, -(-config.batch_size // TASK_PAIRS), max(1, EXCHANGED // message))
    needed = -(-pairs // HELD)
    if needed > slots:
        raise ValueError(f"{pairs} pairs need {needed} tasks at once; there are {slots}")
    return max(1, wanted, needed)


def dealt(pairs: DataFrame, tasks: int) -> DataFrame:
    """``pairs`` in as many partitions as tasks, by their number. A barrier stage of more partitions than
    slots never starts, so the partition is named outright, not left to a hash over some number of them."""
    return pairs.repartitionById(tasks, F.pmod("number", F.lit(tasks)).cast("int"))


def train_on(train: DataFrame, validation: DataFrame, tokens: list[str], config: MatcherConfig, tasks: int | None = None) -> tuple[ModelBundle, dict]:
    """``train_model`` by the tasks of a barrier stage; both tables have number, a, b, label, weight.

    Numbers count the rows of each table from 0. Pairs go to tasks by their number and stay
    there; the model alone comes to the driver. If a task is lost, the stage starts again, with the
    same result.
    """
    wide = np.int16 if len(tokens) < 1 << 15 else np.int32
    columns = ["number", "a", "b", "label", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: tuple[list, list] = ([], [])
        for batch in batches:
            own = batch.column("validation").to_numpy(zero_copy_only=False)
            for part, mine in zip(parts, (~own, own), strict=True):
                some = batch.filter(pa.array(mine))
                ids = [some.column(c).flatten().to_numpy().astype(wide).reshape(-1, config.max_length) for c in ("a", "b")]
                part.append((*ids, some.column("label").to_numpy().astype(np.int64), some.column("weight").to_numpy(), some.column("number").to_numpy()))
        none = (np.zeros((0, config.max_length), wide),) * 2 + (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        with closing(Together()) as team:
            bundle, history = train_model(*[Pairs(*map(np.concatenate, zip(none, *p, strict=True))) for p in parts], tokens, config, team)
        if BarrierTaskContext.get().partitionId() == 0:
            blobs = {k: (list(v.shape), v.tobytes()) for k, v in bundle.weights.items()} | {"": ([], json.dumps(history).encode())}
            yield pa.RecordBatch.from_arrays([pa.array(list(blobs)), pa.array([x[0] for x in blobs.values()], pa.list_(pa.int32())), pa.array([x[1] for x in blobs.values()], pa.binary())], names=["name", "shape", "blob"])

    both = train.select(*columns, F.lit(False).alias("validation")).unionByName(validation.select(*columns, F.lit(True).alias("validation")))
    wrong = F.coalesce(~F.col("weight").between(0, 1) | (F.col("weight") <= 0) | F.isnan("weight"), F.lit(True)).alias("weights outside of 0 to 1")
    label = F.coalesce(~F.col("label").isin(list(LABEL_NUMBERS.values())), F.lit(True)).alias("labels that the map lacks")
    length = F.coalesce((F.size("a") != config.max_length) | (F.size("b") != config.max_length), F.lit(True)).alias("names of another length")
    checked = both.select(wrong, label, length)
    found = checked.agg(F.count("*").alias("pairs"), *[F.count_if(f"`{c}`").alias(c) for c in checked.columns]).first().asDict()
    pairs = found.pop("pairs")
    if any(found.values()):
        raise ValueError("pairs have " + ", ".join(f"{k} ({n})" for k, n in found.items() if n))
    tasks = tasks or training_tasks(config, len(tokens), pairs, both.sparkSession.sparkContext.defaultParallelism)
    rows = dealt(both, tasks).mapInArrow(run, "name string, shape array<int>, blob binary", barrier=True).collect()
    found = {r["name"]: (r["shape"], bytes(r["blob"])) for r in rows}
    history = json.loads(found.pop("")[1])
    weights = {k: np.frombuffer(blob, dtype=np.float64).reshape(shape).copy() for k, (shape, blob) in found.items()}
    return ModelBundle(config, tokens, weights), history
