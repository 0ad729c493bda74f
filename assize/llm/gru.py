"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, state carried across windows.

Tokens are numbers: those below ``HEAD`` are words of their own, in classes of ``CLASS`` by frequency; the ones after them
are kinds of rarer words, each a class by itself. The model gives the probability of a token's class and, within a class
of the head, that of the token. Weights that say nothing at first and biases of log frequencies make it begin as the
unigram model of its counts.
"""

from __future__ import annotations

import ctypes
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np

HEAD, CLASS, KINDS = 1024, 32, 16
CLASSES = HEAD // CLASS
HIDDEN = 24
#: Steps that are propagated back through; steps whose outputs are computed at once.
WINDOW = 32
RATE, CLIP, SEED = 0.1, 5.0, 12
#: Freed memory that a worker keeps.
KEPT_BYTES = 128 << 20
#: The token that ends a text, which also stands before it.
END = 0

Weights = dict[str, np.ndarray]


def one_thread() -> None:
    """Keep numpy's BLAS to the thread it is called from, as a task has a core and matrices here are too small to share, and what a window frees for the next one."""
    try:
        with open("/proc/self/maps") as maps:
            libraries = {m for m in re.findall(r"\S*openblas\S*\.so\S*", maps.read())}
    except OSError:  # no such system; threads cost time, not results
        return
    for library in libraries:
        loaded = ctypes.CDLL(library)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(loaded, name):
                getattr(loaded, name)(1)
    try:  # else every window's arrays are mapped anew; 1: blocks below are kept, 3: mapped above
        system = ctypes.CDLL("libc.so.6")
        system.mallopt(-1, KEPT_BYTES)
        system.mallopt(-3, KEPT_BYTES // 4)
    except (OSError, AttributeError):
        return


def started(counts: np.ndarray) -> Weights:
    """Weights for tokens counted as ``counts`` (the head's, then the kinds')."""
    rng = np.random.default_rng(SEED)
    head = np.log(counts[:HEAD] + 0.1).reshape(CLASSES, CLASS)
    within = head - np.logaddexp.reduce(head, axis=1, keepdims=True)
    masses = np.log(np.concatenate([counts[:HEAD].reshape(CLASSES, CLASS).sum(axis=1), counts[HEAD:]]) + 1.0)
    weights = {
        "E": rng.normal(0, 0.3, (HEAD + KINDS, 3 * HIDDEN)),
        "U": rng.normal(0, 0.3 / HIDDEN**0.5, (HIDDEN, 3 * HIDDEN)),
        "C": np.zeros((HIDDEN, CLASSES + KINDS)),
        "c": masses - np.logaddexp.reduce(masses),
        "W": np.zeros((HEAD, HIDDEN)),
        "w": within.ravel(),
    }
    return {k: v.astype(np.float32) for k, v in weights.items()}


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def shaped(values: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def steps(weights: Weights, x: np.ndarray, keep: np.ndarray, h: np.ndarray, kept: list | None = None) -> np.ndarray:
    """The states after each of ``x`` (steps by lanes), beginning with ``h``; where ``keep`` is 0 a lane begins anew.

    Within, lanes lie side by side, so that what a gate takes is in one piece; ``kept`` gets it so.
    """
    e, u = weights["E"], weights["U"].T.copy()
    out = np.empty((len(x), *h.shape), np.result_type(h, u))
    h = h.T.copy()
    for t in range(len(x)):
        before = h if keep[t].all() else h * keep[t]
        g, a = u @ before, e[x[t]].T
        zr = g[: 2 * HIDDEN] + a[: 2 * HIDDEN]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, g = zr[:HIDDEN], zr[HIDDEN:], g[2 * HIDDEN :]
        n = r * g
        n += a[2 * HIDDEN :]
        np.tanh(n, out=n)
        apart = before - n
        h = z * apart
        h += n
        out[t] = h.T
        if kept is not None:
            kept.append((before, z, r, n, g, apart))
    return out


def _class_of(y: np.ndarray) -> np.ndarray:
    return np.where(y < HEAD, y // CLASS, y - HEAD + CLASSES)


def _by_class(y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice, slice]]]:
    """An order of tokens ``y`` by class, in which the head's come first, and (class, its part of that order, its tokens) of the head's."""
    of = _class_of(y).astype(np.uint8)
    ends = np.cumsum(np.bincount(of, minlength=CLASSES)[:CLASSES]).tolist()
    return np.argsort(of, kind="stable"), [(k, slice(a, b), slice(k * CLASS, (k + 1) * CLASS)) for k, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]


def _within(weights: Weights, states: np.ndarray, classes: list[tuple[int, slice, slice]]) -> np.ndarray:
    """What ``states`` of the head's tokens, in order of class, say of each token of their class."""
    x = np.empty((classes[-1][1].stop if classes else 0, CLASS), np.result_type(states, weights["W"]))
    for _, rows, part in classes:
        np.matmul(states[rows], weights["W"][part].T, out=x[rows])
        x[rows] += weights["w"][part]
    return x


def log_probabilities(weights: Weights, states: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural logs of the probabilities of tokens ``y``, given the states before them; of a kind, that of its class alone."""
    order, classes = _by_class(y)
    states, y = states[order], y[order]
    logs = _chosen(states @ weights["C"] + weights["c"], _class_of(y))[0]
    x = _within(weights, states, classes)
    logs[: len(x)] += _chosen(x, y[: len(x)] % CLASS)[0]
    out = np.empty_like(logs)
    out[order] = logs
    return out


def _chosen(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log of the softmax of every row of ``x`` at place ``of``, and the sums of the exponentials, which ``x`` becomes."""
    np.clip(x, -80, 80, out=x)
    named = x[np.arange(len(of)), of]
    sums = np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype)
    return named - np.log(sums), sums


def _loss(x: np.ndarray, of: np.ndarray) -> float:
    """The loss of the softmax of every row of ``x`` at place ``of``; ``x`` becomes its gradient."""
    logs, sums = _chosen(x, of)
    x *= np.reciprocal(sums)[:, None]
    x[np.arange(len(of)), of] -= 1
    return -float(logs.sum())


def gradients(weights: Weights, x: np.ndarray, keep: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[Weights, np.ndarray, np.ndarray, float]:
    """Gradients of the loss of tokens ``y`` (-1: none) over one window, the rows of E that its own stand for, the state after it, and the loss."""
    kept: list = []
    states = steps(weights, x, keep, h, kept)
    s, target = states.reshape(-1, HIDDEN), y.ravel()
    real = np.flatnonzero(target >= 0)
    order, classes = _by_class(target[real])
    real = real[order]
    some, t = s[real], target[real]
    grown = {"W": np.zeros_like(weights["W"]), "w": np.zeros_like(weights["w"])}
    d = some @ weights["C"] + weights["c"]
    loss = _loss(d, _class_of(t))
    grown["C"], grown["c"] = some.T @ d, np.ones(len(d), d.dtype) @ d
    ds = d @ weights["C"].T
    d = _within(weights, some, classes)
    loss += _loss(d, t[: len(d)] % CLASS)
    ones = np.ones(len(d), d.dtype)
    for _, rows, part in classes:
        np.matmul(d[rows].T, some[rows], out=grown["W"][part])
        np.matmul(ones[rows], d[rows], out=grown["w"][part])
        ds[rows] += d[rows] @ weights["W"][part]
    full = np.zeros_like(s)
    full[real] = ds
    full = full.reshape(states.shape)
    # de is of the sums in E, dg of those in U
    de = np.empty((*x.shape, 3 * HIDDEN), s.dtype)
    dg = np.empty((3 * HIDDEN, x.shape[1]), s.dtype)
    du, back, u = np.zeros_like(weights["U"]), np.zeros_like(kept[0][0]), weights["U"]
    for k in range(len(x) - 1, -1, -1):
        before, z, r, n, g, apart = kept[k]
        dh = back
        dh += full[k].T
        dn = (1 - z) * dh
        n *= n
        dn *= np.subtract(1, n, out=n)
        apart *= dh
        dh *= z
        np.multiply(apart, z - z * z, out=dg[:HIDDEN])
        g *= dn
        np.multiply(g, r - r * r, out=dg[HIDDEN : 2 * HIDDEN])
        de[k, :, 2 * HIDDEN :] = dn.T
        np.multiply(dn, r, out=dg[2 * HIDDEN :])
        de[k, :, : 2 * HIDDEN] = dg[: 2 * HIDDEN].T
        du += before @ dg.T
        back = u @ dg
        back += dh
        if not keep[k].all():
            back *= keep[k]
    order = np.argsort(x.ravel().astype(np.uint16), kind="stable")
    met = x.ravel()[order]
    starts = np.flatnonzero(np.diff(met, prepend=-1))
    grown["E"] = np.add.reduceat(de.reshape(-1, 3 * HIDDEN)[order], starts, axis=0)
    grown["U"] = du
    return grown, met[starts], states[-1], loss


def lanes(sequences: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Sequences laid one after another in lanes of like length: inputs, marks of what goes on (0: a beginning), targets (-1: none), and (lane, first step) of each.

    Lanes stand in order of length, longest first.
    """
    width = max(1, min(width, len(sequences)))
    queue = [(0, k) for k in range(width)]
    placed, filled = [(0, 0)] * len(sequences), [0] * width
    for i in sorted(range(len(sequences)), key=lambda i: -len(sequences[i])):
        at, lane = heapq.heappop(queue)
        placed[i], filled[lane] = (lane, at), at + len(sequences[i])
        heapq.heappush(queue, (filled[lane], lane))
    rank = {lane: k for k, lane in enumerate(sorted(range(width), key=lambda lane: -filled[lane]))}
    shape = (width, max(filled))
    x, y, keep = np.zeros(shape, np.int32), np.full(shape, -1, np.int32), np.ones(shape, np.float32)
    for i, (lane, at) in enumerate(placed):
        lane, tokens = rank[lane], sequences[i]
        placed[i] = (lane, at)
        y[lane, at : at + len(tokens)] = tokens
        x[lane, at], x[lane, at + 1 : at + len(tokens)] = END, tokens[:-1]
        keep[lane, at] = 0
    return x.T.copy(), keep.T.copy(), y.T.copy(), placed


def scored(weights: Weights, sequences: list[np.ndarray], width: int = 512, window: int = WINDOW // 2) -> np.ndarray:
    """The natural log of every sequence's probability; the state goes on from window to window to a sequence's end."""
    if not sequences:
        return np.zeros(0)
    x, keep, y, placed = lanes(sequences, width)
    logs = np.zeros(y.shape, np.float64)
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    busy = (y >= 0).sum(axis=0)
    for k in range(0, len(x), window):
        open_ = int((busy > k).sum())
        part = slice(k, k + window)
        states = steps(weights, x[part, :open_], keep[part, :open_], h[:open_])
        h = states[-1]
        target = y[part, :open_].ravel()
        real = np.flatnonzero(target >= 0)
        found = np.zeros(len(target))
        found[real] = log_probabilities(weights, states.reshape(-1, HIDDEN)[real], target[real])
        logs[part, :open_] = found.reshape(-1, open_)
    running = np.concatenate([np.zeros((1, logs.shape[1])), np.cumsum(logs, axis=0)])
    lane, at = np.array(placed).T
    return running[at + np.array([len(s) for s in sequences]), lane] - running[at, lane]


def trained(weights: Weights, slices: Iterable[list[np.ndarray]], width: int = 256, window: int = WINDOW) -> tuple[Weights, int]:
    """``weights`` after one pass over whole sequences by AdaGrad, and the number of tokens learned from; the state goes on from window to window to a sequence's end."""
    weights, learned = {k: v.copy() for k, v in weights.items()}, 0
    seen = {k: np.full_like(v, 1e-2) for k, v in weights.items()}
    for sequences in slices:
        total = sum(map(len, sequences))
        # lanes beside a sequence far longer than the others would stand empty
        x, keep, y, _ = lanes(sequences, min(width, max(1, 8 * total // max(map(len, sequences)))))
        busy = (y >= 0).sum(axis=0)
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        for k in range(0, len(x), window):
            open_ = int((busy > k).sum())
            part = slice(k, k + window)
            grown, met, h, _ = gradients(weights, x[part, :open_], keep[part, :open_], y[part, :open_], h[:open_])
            size = np.sqrt(sum(float((g * g).sum()) for g in grown.values()))
            scale = min(1.0, CLIP * open_ / size) / open_**0.5 if size else 0.0
            for name, g in grown.items():
                rows = met if name == "E" else slice(None)
                g = g * np.float32(scale)
                seen[name][rows] += g * g
                weights[name][rows] -= np.float32(RATE) * g / np.sqrt(seen[name][rows])
        learned += total
    return weights, learned
