"""A small causal self-attention model over subword ids, in numpy, with a softmax of two levels."""

from __future__ import annotations

import numpy as np

#: Ids of a window; of these the first CONTEXT are context only, so each token is scored once, in one window.
WINDOW = 32
CONTEXT = 8
STEP = WINDOW - CONTEXT
DIM = 24
#: The softmax first chooses a group and then one of the group's classes.
GROUPS, MEMBERS = 32, 32
CLASSES = GROUPS * MEMBERS
#: The commonest ids have a class each; the classes of the last group hold all others.
SINGLE = CLASSES - MEMBERS
_CHUNK = 512
#: Sums over short rows are products with ones, which numpy does faster.
_ONES = np.ones((max(WINDOW, GROUPS, MEMBERS, DIM), 1), np.float32)
_CAUSAL = np.where(np.arange(WINDOW)[None, :] <= np.arange(CONTEXT, WINDOW)[:, None], 0.0, -1e9).astype(np.float32)


def token_classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each token, log10 probability of the token in its class, with one added to each count).

    The commonest tokens have a class each; the others are dealt by rank to classes of about equal mass.
    """
    order = np.argsort(-counts, kind="stable")
    of = np.empty(len(counts), np.int64)
    of[order[:SINGLE]] = np.arange(SINGLE)
    rest = order[SINGLE:]
    mass = np.cumsum(counts[rest] + 1.0)
    of[rest] = SINGLE + np.minimum((mass / mass[-1] * MEMBERS).astype(np.int64), MEMBERS - 1)
    total = np.bincount(of, counts + 1.0, CLASSES)
    return of, np.log10((counts + 1.0) / total[of])


def first_weights(tokens: int, of: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(3)
    some = lambda *shape, by=0.1: (rng.standard_normal(shape) * by).astype(np.float32)
    mass = np.bincount(of, counts + 1.0, CLASSES).reshape(GROUPS, MEMBERS)
    w = {"e": some(tokens, DIM, by=0.3), "p": some(WINDOW, DIM), **{n: some(DIM, DIM, by=0.3) for n in "qkvo"}}
    w |= {"c": some(DIM, GROUPS), "b": np.log(mass.sum(1)).astype(np.float32), "c2": some(GROUPS, DIM, MEMBERS), "b2": np.log(mass).astype(np.float32)}
    return w | {"b": w["b"] - w["b"].max(), "b2": w["b2"] - w["b2"].max(1, keepdims=True)}


def windows_of(texts: list[np.ndarray], begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, text of each window) for lists of ids: -1 where there is none.

    The input of a place is the id before it (at first `begin`), its target the id itself; targets of the context are
    scored in the window before.
    """
    sizes = np.array([-(-len(t) // STEP) for t in texts], np.int64)
    total = int(sizes.sum()) * STEP + CONTEXT * len(texts)
    x, y = np.full(total, -1, np.int64), np.full(total, -1, np.int64)
    starts, at = [], 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        if n:
            a = at + CONTEXT
            x[a] = begin
            x[a + 1 : a + len(t)] = t[:-1]
            y[a : a + len(t)] = t
        starts.append(at + STEP * np.arange(n))
        at += CONTEXT + STEP * n
    index = np.concatenate(starts)[:, None] + np.arange(WINDOW) if starts else np.zeros((0, WINDOW), np.int64)
    return np.take(x, index), np.take(y, index[:, CONTEXT:]), np.repeat(np.arange(len(texts)), sizes)


def _swapped(m: np.ndarray) -> np.ndarray:
    """The matrices of a stack transposed, in memory too: products of small matrices take twice as long on a mere view."""
    return np.ascontiguousarray(m.transpose(0, 2, 1))


def _over_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b for long and narrow a and b, by blocks of rows that fit the cache."""
    n = len(a) // 128 * 128
    out = a[n:].T @ b[n:]
    if n:
        out += np.matmul(a[:n].reshape(n // 128, 128, -1).transpose(0, 2, 1), b[:n].reshape(n // 128, 128, -1)).sum(0)
    return out


def _attend(w: dict[str, np.ndarray], x: np.ndarray):
    """(embeddings, queries, keys and values, attention, what it gathers, states at the places to be scored)."""
    z = np.take(w["e"], np.maximum(x, 0), axis=0)
    z += w["p"]
    zq = np.ascontiguousarray(z[:, CONTEXT:]).reshape(-1, DIM)
    k, v = ((z.reshape(-1, DIM) @ w[n]).reshape(len(x), WINDOW, DIM) for n in "kv")
    q = (zq @ (w["q"] * np.float32(DIM**-0.5))).reshape(len(x), STEP, DIM)
    a = q @ _swapped(k)
    a += _CAUSAL
    if x.min(initial=0) < 0:  # the windows where a text begins or ends
        rows = np.flatnonzero(x.min(1) < 0)
        a[rows] += np.where(x[rows] < 0, np.float32(-1e9), np.float32(0))[:, None, :]
    if a.max(initial=0) > 60:  # else no exponential overflows
        a -= a.max(-1, keepdims=True)
    np.exp(a, out=a)
    share = (a.reshape(-1, WINDOW) @ _ONES[:WINDOW]).reshape(len(x), STEP, 1)
    np.reciprocal(np.maximum(share, np.float32(1e-30), out=share), out=share)
    o = a @ v
    o *= share
    o = o.reshape(-1, DIM)
    return z.reshape(-1, DIM), zq, q, k, v, a, share, o, zq + o @ w["o"]


def _log_softmax(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    value = logits[np.arange(len(logits)), chosen]
    if (top := logits.max(initial=0)) > 60:
        logits -= top
        value = value - top
    np.exp(logits, out=logits)
    return value - np.log(np.maximum(logits @ _ONES[: logits.shape[1]], np.float32(1e-37)))[:, 0]


def _by_group(t: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(group, member, places in the order of their groups, (group, from, to) of those that have places) of the targets' classes."""
    classes = np.take(of, np.maximum(t, 0))
    group = classes // MEMBERS
    member = classes - group * MEMBERS
    sizes = np.bincount(group, minlength=GROUPS)
    ends = np.cumsum(sizes)
    return group, member, np.argsort(group.astype(np.uint8), kind="stable"), [(g, b - n, b) for g, (b, n) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)) if n]


def _second_logits(w: dict[str, np.ndarray], h: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Logits of the members of each place's own group, for states in the order of their groups."""
    logits = np.empty((len(h), MEMBERS), h.dtype)
    for g, i, j in spans:
        np.matmul(h[i:j], w["c2"][g], out=logits[i:j])
        logits[i:j] += w["b2"][g]
    return logits


def class_log10(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, of: np.ndarray) -> np.ndarray:
    """log10 probability of each target's class given the inputs up to its place; 0 where there is no target."""
    out = np.zeros(y.shape, np.float32)
    for i in range(0, len(x), _CHUNK):
        h = _attend(w, x[i : i + _CHUNK])[-1]
        t = y[i : i + _CHUNK].reshape(-1)
        group, member, order, spans = _by_group(t, of)
        logits = h @ w["c"]
        logits += w["b"]
        score = _log_softmax(logits, group)
        score[order] += _log_softmax(_second_logits(w, np.take(h, order, axis=0), spans), member[order])
        out[i : i + _CHUNK] = np.where(t < 0, 0, score / np.float32(np.log(10))).reshape(-1, STEP)
    return out


class Learner:
    """Adagrad on the log loss of the classes."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.08):
        self.w = {n: x.copy() for n, x in weights.items()}
        self.g = {n: np.full(x.shape, 1e-4, np.float32) for n, x in weights.items()}
        self.rate, self.seen = rate, np.zeros(len(weights["e"]), np.float32)

    def _step(self, name: str, grad: np.ndarray, rows=None) -> None:
        if rows is None:
            self.g[name] += grad * grad
            self.w[name] -= self.rate * grad / np.sqrt(self.g[name])
        else:
            square = np.take(self.g[name], rows, axis=0) + grad * grad
            self.g[name][rows] = square
            self.w[name][rows] -= self.rate * grad / np.sqrt(square)

    def learn(self, x: np.ndarray, y: np.ndarray, of: np.ndarray) -> None:
        w = self.w
        z, zq, q, k, v, a, share, o, h = _attend(w, x)
        a *= share
        t = y.reshape(-1)
        real = t >= 0
        weight = real.astype(np.float32) / np.float32(max(int(real.sum()), 1))
        group, member, order, spans = _by_group(t, of)
        ones = np.ones(len(t), np.float32)  # sums over places are products with it

        def error(logits, chosen, weight):
            if logits.max(initial=0) > 60:
                logits -= logits.max(1, keepdims=True)
            np.exp(logits, out=logits)
            logits *= weight[:, None] / np.maximum(logits @ _ONES[: logits.shape[1]], np.float32(1e-30))
            logits[np.arange(len(logits)), chosen] -= weight
            return logits

        logits = h @ w["c"]
        logits += w["b"]
        p = error(logits, group, weight)
        dh = p @ w["c"].T
        c2, b2 = np.zeros_like(w["c2"]), np.zeros_like(w["b2"])
        sorted_h, second = np.take(h, order, axis=0), np.empty_like(h)
        e = error(_second_logits(w, sorted_h, spans), member[order], weight[order])
        for g, i, j in spans:
            np.matmul(sorted_h[i:j].T, e[i:j], out=c2[g])
            np.matmul(ones[i:j], e[i:j], out=b2[g])
            np.matmul(e[i:j], w["c2"][g].T, out=second[i:j])
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        dh += np.take(second, back, axis=0)
        do = dh @ w["o"].T
        gathered = ((do * o) @ _ONES[:DIM]).reshape(len(x), STEP, 1)  # what the attention's own change of sum takes back
        do = do.reshape(len(x), STEP, DIM)
        ds = do @ _swapped(v)
        ds -= gathered
        ds *= a
        # q is scaled already; the scale of its own gradient comes with the weights.
        scale = np.float32(DIM**-0.5)
        dq = (ds @ k).reshape(-1, DIM)
        dkv = np.empty((len(x), WINDOW, 2 * DIM), ds.dtype)
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[:, :, :DIM])
        np.matmul(a.transpose(0, 2, 1), do, out=dkv[:, :, DIM:])
        dkv = dkv.reshape(-1, 2 * DIM)
        dz = dkv @ np.hstack([w["k"], w["v"]]).T
        dh_z = dq @ (w["q"] * scale).T
        dh_z += dh
        dz.reshape(len(x), WINDOW, DIM)[:, CONTEXT:] += dh_z.reshape(len(x), STEP, DIM)
        of_kv = _over_rows(z, dkv)
        for name, grad in {"c": _over_rows(h, p), "b": ones @ p, "c2": c2, "b2": b2, "o": _over_rows(o, dh), "q": _over_rows(zq, dq) * scale, "k": of_kv[:, :DIM], "v": of_kv[:, DIM:], "p": dz.reshape(len(x), WINDOW, DIM).sum(0)}.items():
            self._step(name, grad)
        ids = x.reshape(-1) + 1  # 0: nothing there
        order = np.argsort(ids.astype(np.uint16) if len(w["e"]) < 65_535 else ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        de, ids = np.add.reduceat(np.ascontiguousarray(np.take(dz, order, axis=0).T), first, axis=1).T, ids[first] - 1
        if ids[0] < 0:
            ids, de = ids[1:], de[1:]
        self._step("e", de, ids)
        self.seen[ids] += 1
