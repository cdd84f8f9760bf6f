"""A gated recurrent network with a class-factored softmax, in numpy."""

from __future__ import annotations

import heapq

import numpy as np

#: Hidden units; classes and words of a class (their product is the vocabulary); steps of a truncated window.
HIDDEN, CLASSES, PER_CLASS, STEPS = 16, 64, 64, 32
#: Streams that go side by side in scoring; tokens whose outputs are worked out together.
STREAMS, BLOCK = 512, 16384
#: Rows whose class probabilities are worked out at a time.
TILE = 512
LEARNING_RATE = 0.01
#: Logits are held under this, so that no power overflows; the probabilities still sum to one.
_MOST = 80.0

Params = dict[str, np.ndarray]


def initial(log_p: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES, per_class: int = PER_CLASS, seed: int = 0) -> Params:
    """Small random weights; output biases that give each word its unigram log-probability ``log_p``."""
    rng = np.random.default_rng(seed)
    words = classes * per_class
    grid = log_p.reshape(classes, per_class)
    of_class = np.logaddexp.reduce(grid, axis=1)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {
        # layers: update gate, reset gate, candidate; a word's part, the state's part, biases
        "x": normal(3, words, hidden, scale=0.3),
        "u": normal(3, hidden, hidden, scale=1 / np.sqrt(hidden)),
        "b": np.zeros((3, hidden), np.float32),
        "c": normal(hidden, classes, scale=0.01),
        "cb": of_class.astype(np.float32),
        "w": normal(classes, per_class, hidden, scale=0.01),
        "wb": (grid - of_class[:, None]).astype(np.float32),
    }


def _halved(p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Input tables (biases added) and recurrent weights with the two sigmoid gates halved: a sigmoid is then
    (1 + tanh) / 2."""
    x, u = p["x"] + p["b"][:, None], p["u"].copy()
    x[:2] *= 0.5
    u[:2] *= 0.5
    return x, u


def _step(x: np.ndarray, u: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next state; gates, candidate and its recurrent part. ``x``: the tokens' rows of the halved tables, by layer."""
    a = np.matmul(h, u)
    gates = a[:2]
    gates += x[:2]
    np.tanh(gates, out=gates)
    gates += 1
    gates *= 0.5
    m = gates[1] * a[2]
    m += x[2]
    np.tanh(m, out=m)
    new = h - m
    new *= gates[0]
    new += m
    return new, gates, m, a[2]


def _softmax(logits: np.ndarray, target: np.ndarray, share: float = 0.0) -> np.ndarray:
    """Log-probability of each row's target. With ``share``, ``logits`` become that part of the gradient of the negative
    log-probability; else they are used up."""
    np.minimum(logits, _MOST, out=logits)
    rows = np.arange(len(target))
    own = logits[rows, target]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    if share:
        logits *= (share / total)[:, None]
        logits[rows, target] -= share
    return own - np.log(total)


def _sum(x: np.ndarray) -> np.ndarray:
    return np.ones(len(x), x.dtype) @ x


def log_probabilities(p: Params, h: np.ndarray, target: np.ndarray, grads: Params | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probability of each target after each state; with ``grads``, adds the gradients of the mean negative
    log-probability to it and returns the states' gradients too. Rows go by class, and in tiles that stay in the cache."""
    classes, per_class = p["wb"].shape
    n = len(target)
    kind = target // per_class
    order = np.argsort(kind.astype(np.uint16), kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=classes))]).tolist()
    h, word, kind = np.take(h, order, axis=0), np.take(target - kind * per_class, order), np.take(kind, order)
    share = 0.0 if grads is None else 1 / n
    logp = np.empty(n, h.dtype)
    dh = None if grads is None else np.empty_like(h)
    out_of_class = np.ascontiguousarray(p["c"].T)
    for lo in range(0, n, TILE):
        hi = min(lo + TILE, n)
        own = h[lo:hi]
        d = own @ p["c"]
        d += p["cb"]
        logp[lo:hi] = _softmax(d, kind[lo:hi], share)
        if grads is not None:
            grads["c"] += own.T @ d
            grads["cb"] += _sum(d)
            np.matmul(d, out_of_class, out=dh[lo:hi])
    for k in range(classes):
        lo, hi = bounds[k], bounds[k + 1]
        if lo == hi:
            continue
        own = h[lo:hi]
        d = own @ p["w"][k].T
        d += p["wb"][k]
        logp[lo:hi] += _softmax(d, word[lo:hi], share)
        if grads is not None:
            grads["w"][k] += d.T @ own
            grads["wb"][k] += _sum(d)
            dh[lo:hi] += d @ p["w"][k]
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return np.take(logp, back), None if dh is None else np.take(dh, back, axis=0)


def gradients(p: Params, tokens: np.ndarray, target: np.ndarray, start: np.ndarray, fresh: int) -> tuple[Params, float, np.ndarray]:
    """Gradients of a window (steps by streams), its mean negative log-probability and the states at its end.

    A state is set to zero before the token ``fresh``, which stands between documents.
    """
    steps, streams = tokens.shape
    n = start.shape[1]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    table, u = _halved(p)
    kind = table.dtype
    before, states, z, r, m, am = (np.empty((steps, streams, n), kind) for _ in range(6))
    ends = tokens == fresh
    h = start
    for t in range(steps):
        if ends[t].any():
            h = h.copy()
            h[ends[t]] = 0
        before[t] = h
        h, (z[t], r[t]), m[t], am[t] = _step(np.take(table, tokens[t], axis=1), u, h)
        states[t] = h
    logp, dflat = log_probabilities(p, states.reshape(-1, n), target.ravel(), g)
    dstates = dflat.reshape(steps, streams, n)
    da, dm = np.empty((3, steps, streams, n), kind), m  # the candidate's own gradient takes its place
    dh, back = np.zeros_like(h), np.ascontiguousarray(p["u"].transpose(0, 2, 1))
    for t in range(steps - 1, -1, -1):
        dh += dstates[t]
        zt, rt, mt, dz, dr = z[t], r[t], m[t], da[0, t], da[1, t]
        rest = 1 - zt
        np.subtract(before[t], mt, out=dz)
        dz *= zt
        dz *= rest
        dz *= dh
        slope = mt * mt
        np.subtract(1, slope, out=slope)
        slope *= rest
        np.multiply(dh, slope, out=dm[t])
        np.subtract(1, rt, out=dr)
        dr *= rt
        dr *= am[t]
        dr *= dm[t]
        np.multiply(dm[t], rt, out=da[2, t])
        dh *= zt
        for k in range(3):
            dh += da[k, t] @ back[k]
        if ends[t].any():
            dh[ends[t]] = 0
    flat = tokens.ravel()
    order = np.argsort(flat.astype(np.uint16) if p["x"].shape[1] <= 1 << 16 else flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    before = before.reshape(-1, n).T
    for k, dx in enumerate((da[0], da[1], dm)):
        g["u"][k] = before @ da[k].reshape(-1, n)
        dx = dx.reshape(-1, n)
        g["b"][k] = _sum(dx)
        g["x"][k, flat[first]] = np.add.reduceat(np.take(dx, order, axis=0), first, axis=0)
    return g, float(-logp.mean()), h


class Trainer:
    """Truncated backpropagation over streams of documents, with per-weight step sizes."""

    def __init__(self, p: Params, fresh: int, rate: float = LEARNING_RATE) -> None:
        self.p = {k: v.copy() for k, v in p.items()}
        self.fresh, self.rate, self.n = fresh, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def learn(self, ids: np.ndarray, streams: int = STREAMS, steps: int = STEPS) -> None:
        """One pass over whole documents that stand after another, each ended by ``fresh``. States are carried from
        window to window."""
        if not len(ids):
            return
        inputs = np.concatenate([[self.fresh], ids[:-1]])
        streams = max(1, min(streams, len(ids) // steps))
        long = -(-len(ids) // streams)
        # the last stream is filled up from the front, so that every token is learned from
        place = np.arange(streams * long) % len(ids)
        inputs, target = inputs[place].reshape(streams, long).T, ids[place].reshape(streams, long).T
        h = np.zeros((streams, self.p["u"].shape[1]), np.float32)
        for t in range(0, long, steps):
            g, _, h = gradients(self.p, inputs[t : t + steps], target[t : t + steps], h, self.fresh)
            self._update(g)

    def _update(self, g: Params) -> None:
        self.n += 1
        norm = np.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
        scale = np.float32(min(1.0, 1.0 / max(norm, 1e-12)))
        rate = np.float32(self.rate * np.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n))
        for k, x in g.items():
            x *= scale
            m, v = self.m[k], self.v[k]
            m *= np.float32(0.9)
            m += np.float32(0.1) * x
            x *= x
            v *= np.float32(0.99)
            x *= np.float32(0.01)
            v += x
            np.sqrt(v, out=x)
            x += np.float32(1e-6)
            np.divide(m, x, out=x)
            x *= rate
            self.p[k] -= x


def score_documents(p: Params, ids: np.ndarray, ends: np.ndarray, fresh: int, streams: int = STREAMS, block: int = BLOCK) -> np.ndarray:
    """Natural log-probability of each whole document; document i is ids[ends[i-1]:ends[i]], its last id ``fresh``.

    Documents are dealt to streams, longest first; a state is zero at a document's start and carried to its end.
    """
    n_docs = len(ends)
    if not n_docs:
        return np.zeros(0)
    starts = np.concatenate([[0], ends[:-1]])
    size = ends - starts
    heap = [(0, s) for s in range(min(streams, n_docs))]
    dealt: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-size, kind="stable").tolist():
        total, s = heapq.heappop(heap)
        dealt[s].append(d)
        heapq.heappush(heap, (total + int(size[d]), s))
    dealt.sort(key=lambda ds: -int(size[ds].sum()))
    long = np.array([size[ds].sum() for ds in dealt])
    # tokens step after step: streams still going at a step stand side by side, longest first
    active = np.searchsorted(-long, -np.arange(int(long[0])), side="left")
    offset = np.concatenate([[0], np.cumsum(active)])
    where = np.empty(len(ids), np.int64)
    for s, ds in enumerate(dealt):
        where[offset[: long[s]] + s] = np.concatenate([np.arange(starts[d], ends[d]) for d in ds])
    inputs = np.concatenate([[fresh], ids[:-1]])  # the id before a document's first is another's end, or the start
    inputs[starts] = fresh
    inputs, target = inputs[where], ids[where]
    table, u = _halved(p)
    n = u.shape[1]
    result = np.empty(len(ids), np.float32)
    begins = np.logical_or.reduceat(inputs == fresh, offset[:-1]).tolist()
    offset = offset.tolist()
    h, k = np.zeros((len(dealt), n), table.dtype), 0
    while k < len(begins):
        begun, last = offset[k], k + 1
        while offset[last] - begun < block and last < len(begins):
            last += 1
        rows = np.take(table, inputs[begun : offset[last]], axis=1)  # of a block at once
        states = np.empty((offset[last] - begun, n), table.dtype)
        for k in range(k, last):
            lo, hi = offset[k], offset[k + 1]
            h = h[: hi - lo]
            if begins[k]:
                h[inputs[lo:hi] == fresh] = 0
            h = _step(rows[:, lo - begun : hi - begun], u, h)[0]
            states[lo - begun : hi - begun] = h
        k = last
        result[where[begun : offset[last]]] = log_probabilities(p, states, target[begun : offset[last]])[0]
    return np.add.reduceat(result.astype(np.float64), starts)
