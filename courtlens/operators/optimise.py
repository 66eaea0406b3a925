"""Many models fitted at once by sums over the rows of all of them.

The rows become blocks of numbers, one key (a season, say) to a block, that stay on the executors. A round of
an optimiser sends out the current parameters of every model, each task sums what its blocks
contribute (loss, gradient, curvature), and a tree of additions brings one vector for
each key to the driver, where only parameters live. So a key may have any number of rows, rows are never
grouped into a task, and all models take their rounds together.

Blocks are kept serialised in memory and on disk, as the rounds are many and short; a lost executor's
blocks are read again from the table that they came from.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# functions travel to the workers by value and data as plain tuples, so workers need only numpy and pandas
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_KIND = "key string, size int, x binary, y binary, w binary"
#: (key, rows x inputs, rows x targets, weights of the rows)
Block = tuple[str, np.ndarray, np.ndarray, np.ndarray]


def blocks(rows: DataFrame, key: str, x: list[Column], y: list[Column], w: Column) -> RDD:
    """Blocks of the rows of a table that is written; call ``unpersist`` on them after the fits."""
    inputs, targets = len(x), len(y)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, part in b.groupby("key", sort=False):
                yield pd.DataFrame([{
                    "key": k, "size": len(part), "x": np.stack(part["x"].to_numpy()).tobytes(),
                    "y": np.stack(part["y"].to_numpy()).tobytes(), "w": part["w"].to_numpy(float).tobytes()}])

    def block(r) -> Block:
        at = lambda b: np.frombuffer(bytes(b))
        return r["key"], at(r["x"]).reshape(r["size"], inputs), at(r["y"]).reshape(r["size"], targets), at(r["w"])

    whole = lambda cols: F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    d = rows.select(F.col(key).cast("string").alias("key"), whole(x).alias("x"), whole(y).alias("y"), w.cast("double").alias("w"))
    return d.mapInPandas(run, _KIND).rdd.map(block).persist(StorageLevel.MEMORY_AND_DISK)


def summed(data: RDD, state: dict, part: Callable[[object, Block], np.ndarray]) -> dict[str, np.ndarray]:
    """The sum over blocks of ``part(state[key], block)`` for each key that ``state`` holds."""
    shared = data.context.broadcast(state)

    def task(some: Iterator[Block]) -> Iterator[dict[str, np.ndarray]]:
        total: dict[str, np.ndarray] = {}
        for b in some:
            key = b[0]
            if key in shared.value:
                v = part(shared.value[key], b)
                total[key] = total[key] + v if key in total else v
        yield total

    def both(a: dict, b: dict) -> dict:
        return {k: a[k] + b[k] if k in a and k in b else a.get(k, b.get(k)) for k in a.keys() | b.keys()}

    out = data.mapPartitions(task).treeReduce(both) if data.getNumPartitions() else {}
    shared.unpersist()
    return out


@dataclass
class Scale:
    """Rows, label sums, means and population deviations of the inputs of one key."""
    n: float
    positive: np.ndarray
    mean: np.ndarray
    sd: np.ndarray


def scales(data: RDD, groups: dict[object, list[str]], inputs: int, scaled: int) -> dict[object, Scale]:
    """For each group of keys the scale of its first ``scaled`` inputs.

    The others, and inputs that do not vary, stay as they are. Sums are taken once for each key, however many groups
    it is in, so the scale of all folds but one is a sum of sums. Groups without rows are left out.
    """
    keys = sorted({k for ks in groups.values() for k in ks})
    first = summed(data, dict.fromkeys(keys), lambda _, b: np.concatenate([[b[3].sum()], b[3] @ b[1], b[3] @ b[2]]))
    middle = {k: v[1: inputs + 1] / v[0] for k, v in first.items()}
    second = summed(data, middle, lambda m, b: b[3] @ (b[1] - m) ** 2)
    out = {}
    for group, ks in groups.items():
        ks = [k for k in ks if k in first]
        if not ks:
            continue
        total = sum(first[k] for k in ks)
        mean = total[1: inputs + 1] / total[0]
        var = sum(second[k] + first[k][0] * (middle[k] - mean) ** 2 for k in ks) / total[0]
        sd = np.sqrt(var)
        sd = np.where(sd > 1e-12 * np.maximum(1.0, np.abs(mean)), sd, 1.0)
        mean[scaled:], sd[scaled:] = 0.0, 1.0
        out[group] = Scale(float(total[0]), total[inputs + 1:], mean, sd)
    return out


# --- logistic regression -------------------------------------------------------

@dataclass
class Fit:
    """One model on its way: the best parameters so far and the next ones to try."""
    b: np.ndarray
    trial: np.ndarray
    loss: float = np.inf
    step: np.ndarray | None = None
    t: float = 1.0
    done: bool = False

    def take(self, loss: float, gradient: np.ndarray, curvature: np.ndarray, weight: float) -> None:
        """Accept the trial and make a Newton step, or come back half of the last step."""
        if loss <= self.loss + 1e-9 * abs(self.loss) or self.step is None:
            self.b, self.loss, self.t = self.trial, loss, 1.0
            self.done = float(np.abs(gradient).max()) < max(1e-7, 1e-13 * weight)
            self.step = np.linalg.solve(curvature, gradient)
        else:
            self.t /= 2
            self.done = self.t < 1e-8
        self.trial = self.b - self.t * self.step


@dataclass
class Logistic:
    intercept: float
    coefficients: list[float] = field(default_factory=list)   # on the raw scale


#: (means, deviations, target, parameters to try)
Trial = tuple[np.ndarray, np.ndarray, int, np.ndarray]


def _newton_part(trials: list[Trial], block: Block) -> np.ndarray:
    """(loss, gradient, curvature) of every trial on a block."""
    (_, x, ys, w), out = block, []
    for mean, sd, target, beta in trials:
        a = np.column_stack([np.ones(len(x)), (x - mean) / sd])
        z = a @ beta
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
        y = ys[:, target]
        out += [[w @ (np.logaddexp(0.0, z) - y * z)], a.T @ (w * (p - y)),
                ((a * (w * p * (1 - p))[:, None]).T @ a).ravel()]
    return np.concatenate(out)


@dataclass
class Wanted:
    """A model to fit: the target it predicts and the keys whose rows it learns from."""
    scale: Scale
    target: int
    keys: list[str]


def logistic(data: RDD, wanted: dict[object, Wanted], penalty: float = 1.0, rounds: int = 100) -> dict[object, Logistic]:
    """L2 logistic models with a free intercept, all at once.

    They minimise log-loss + penalty * |beta|^2 / 2 on scaled inputs. Newton steps are damped by halving;
    a model that has arrived takes no further part. Models may share keys.
    """
    fits = {m: Fit(np.zeros(len(x.scale.mean) + 1), np.zeros(len(x.scale.mean) + 1)) for m, x in wanted.items()}
    for _ in range(rounds):
        live: dict[str, list] = {}
        for m, f in fits.items():
            for key in wanted[m].keys if not f.done else []:
                live.setdefault(key, []).append(m)
        if not live:
            break
        state = {key: [(wanted[m].scale.mean, wanted[m].scale.sd, wanted[m].target, fits[m].trial) for m in ms]
                 for key, ms in live.items()}
        total: dict[object, np.ndarray] = {}
        for key, v in summed(data, state, _newton_part).items():
            for m, part in zip(live[key], np.split(v, len(live[key]))):
                total[m] = total[m] + part if m in total else part
        for m, part in total.items():
            beta = fits[m].trial
            size, free = len(beta), np.full(len(beta), penalty)
            free[0] = 0.0
            fits[m].take(part[0] + 0.5 * (free * beta * beta).sum(), part[1: size + 1] + free * beta,
                         part[size + 1:].reshape(size, size) + np.diag(free + 1e-12), wanted[m].scale.n)
    out = {}
    for m, f in fits.items():
        raw = f.b[1:] / wanted[m].scale.sd
        out[m] = Logistic(float(f.b[0] - raw @ wanted[m].scale.mean), [float(c) for c in raw])
    return out


# --- perceptron with rectified units ---------------------------------------------

#: (means and deviations of the inputs, weights and offsets of the layers)
Network = tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]


def _passed(net: Network, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """What each layer takes in, and what the last unit gives."""
    mean, sd, layers = net
    h = [(x - mean) / sd]
    for w, c in layers[:-1]:
        h.append(np.maximum(h[-1] @ w + c, 0.0))
    return h, (h[-1] @ layers[-1][0] + layers[-1][1])[:, 0]


def chance(net: Network, x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(_passed(net, x)[1], -700, 700)))


def flat(net: Network) -> np.ndarray:
    return np.concatenate([a.ravel() for layer in net[2] for a in layer])


def with_values(net: Network, v: np.ndarray) -> Network:
    layers, at = [], 0
    for w, c in net[2]:
        layers.append((v[at: at + w.size].reshape(w.shape), v[at + w.size: at + w.size + c.size]))
        at += w.size + c.size
    return net[0], net[1], layers


def new_network(scale: Scale, hidden: tuple[int, ...], seed: int) -> Network:
    """Uniform start weights of width sqrt(6 / (in + out)), sqrt(2 / (in + out)) into the last unit."""
    rng, sizes = np.random.default_rng(seed), [len(scale.mean), *hidden, 1]
    layers = []
    for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
        width = np.sqrt((6.0 if i < len(hidden) else 2.0) / (a + b))
        layers.append((rng.uniform(-width, width, (a, b)), rng.uniform(-width, width, b)))
    return scale.mean, scale.sd, layers


def held_out(x: np.ndarray, share: float) -> np.ndarray:
    """Whether a row belongs to the set that stops the run: by its inputs, so equal states stay together."""
    v = np.ascontiguousarray(x).view(np.uint64)
    h = np.zeros(len(x), np.uint64)
    for column in v.T:
        h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53 < share


def network_part(net: Network, block: Block, share: float) -> np.ndarray:
    """(training weight, training loss, held-out weight, held-out loss, gradient) of a block."""
    _, x, ys, w = block
    keep, y = ~held_out(x, share), ys[:, 0]
    h, z = _passed(net, x)
    loss = w * (np.logaddexp(0.0, z) - y * z)
    back = ((1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))) - y) * w * keep)[:, None]
    out: list[np.ndarray] = []
    for (weights, _), below in zip(reversed(net[2]), reversed(h)):
        out = [(below.T @ back).ravel(), back.sum(axis=0), *out]
        back = (back @ weights.T) * (below > 0)
    return np.concatenate([[w @ keep, loss @ keep, w @ ~keep, loss @ ~keep], *out])


@dataclass
class Training:
    """A network in training with its two running means and the best state on the held-out rows."""
    net: Network
    m: np.ndarray
    v: np.ndarray
    best: np.ndarray
    best_loss: float = np.inf
    stale: int = 0
    rounds: int = 0
    done: bool = False

    def take(self, part: np.ndarray, rate: float, alpha: float, tolerance: float, patience: int) -> None:
        n, now = max(part[0], 1e-12), flat(self.net)
        seen = part[3] / part[2] if part[2] else part[1] / n   # too few rows to hold any out
        self.stale = 0 if seen < self.best_loss - tolerance else self.stale + 1
        if seen < self.best_loss:
            self.best, self.best_loss = now, seen
        if self.stale > patience:
            self.done = True
            return
        self.rounds += 1
        g = (part[4:] + alpha * now) / n
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        step = (self.m / (1 - 0.9**self.rounds)) / (np.sqrt(self.v / (1 - 0.999**self.rounds)) + 1e-8)
        self.net = with_values(self.net, now - rate * step)


def networks(data: RDD, scale: dict[str, Scale], hidden: tuple[int, ...], rounds: int, seed: int, rate: float = 0.01,
             alpha: float = 1e-4, share: float = 0.1, tolerance: float = 1e-4, patience: int = 10) -> dict[str, Network]:
    """One perceptron with rectified units for each key, trained by Adam on whole gradients.

    A share of the rows, chosen by their inputs, is held out; a network stops when its loss there has not
    fallen by ``tolerance`` for ``patience`` rounds, and is given back as it was at its best.
    """
    runs = {}
    for k, s in scale.items():
        net = new_network(s, hidden, seed)
        zero = np.zeros(len(flat(net)))
        runs[k] = Training(net, zero, zero, flat(net))
    for _ in range(rounds + 1):
        live = {k: r.net for k, r in runs.items() if not r.done}
        if not live:
            break
        for k, part in summed(data, live, lambda net, b: network_part(net, b, share)).items():
            runs[k].take(part, rate, alpha, tolerance, patience)
    return {k: with_values(r.net, r.best) for k, r in runs.items()}
