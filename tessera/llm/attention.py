"""A small causal self-attention model over classes of subword ids, in numpy.

P(id | context) = P(class | context) P(id | class). The class logits are the corpus' class-bigram log probabilities of the last id
plus a learned projection of one attention layer's output over a window of classes. The projection starts at zero, so training starts from the bigram model.

Windows overlap: a window holds WINDOW ids, of which the last STRIDE are scored; the ones before are context only, so each id is scored
once, with at least WINDOW - STRIDE ids of context once there are as many. What lies before a text is masked.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

WINDOW, STRIDE, WIDTH, CLASSES = 32, 24, 16, 128
CHUNK = 128


def initial(bigrams: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """bigrams: log P(class | last class)."""
    rng, k = np.random.default_rng(seed), len(bigrams)
    made = lambda *shape: (rng.standard_normal(shape) * shape[0] ** -0.5).astype(np.float32)
    return {"embed": (rng.standard_normal((k, WIDTH)) * 0.5).astype(np.float32), "place": (rng.standard_normal((WINDOW, WIDTH)) * 0.1).astype(np.float32), "qkv": made(WIDTH, 3 * WIDTH), "mix": made(WIDTH, WIDTH), "out": np.zeros((WIDTH, k), np.float32), "bigrams": bigrams.astype(np.float32)}


#: Parameters that training changes, in the order in which they are laid out as one vector.
LEARNED = ("embed", "place", "qkv", "mix", "out")


def vector(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in LEARNED])


def _views(v: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The parameters in the vector itself, so that they change with it."""
    ends = np.cumsum([like[k].size for k in LEARNED]).tolist()
    return like | {k: v[end - like[k].size : end].reshape(like[k].shape) for k, end in zip(LEARNED, ends)}


def from_vector(v: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = dict(like), 0
    for k in LEARNED:
        out[k] = v[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


_CAUSAL = (np.arange(WINDOW)[None, :] <= np.arange(WINDOW - STRIDE, WINDOW)[:, None]).astype(np.float32)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts of so many inputs, one after the other: for each window its first place (may lie before its text) and its text's first place."""
    n = -(-lengths // STRIDE)
    text = np.repeat(np.cumsum(lengths) - lengths, n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return text + k * STRIDE - (WINDOW - STRIDE), text


#: Arrays that batches share, by name: new ones of a megabyte each would cost more in page faults than what is computed in them.
_rooms: dict[str, np.ndarray] = {}


def _room(name: str, *shape: int, kind: type = np.float32) -> np.ndarray:
    """An array for the batch at hand; its content is left over from the last one."""
    size = math.prod(shape)
    if name not in _rooms or _rooms[name].size < size:
        _rooms[name] = np.empty(size, kind)
    return _rooms[name][:size].reshape(shape)


def _exponentials() -> Callable[[np.ndarray], None]:
    """Exponentials of floats of 32 bits in place by ONNX Runtime, where it is installed; numpy's take three times as long without AVX-512."""
    try:
        import onnxruntime
    except ImportError:
        return lambda x: np.exp(x, out=x)
    field = lambda tag, x: bytes([tag << 3 | 2, len(x)]) + x
    value = lambda name: field(1, name) + field(2, field(1, b"\x08\x01" + field(2, field(1, field(2, b"n")))))  # noqa: E731  # floats in one axis
    graph = field(1, field(1, b"x") + field(2, b"y") + field(4, b"Exp")) + field(2, b"exp") + field(11, value(b"x")) + field(12, value(b"y"))
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    # an ONNX model of IR version 8 and operators of version 13
    session, bound = onnxruntime.InferenceSession(b"\x08\x08" + field(7, graph) + field(8, field(1, b"") + b"\x10\x0d"), options, providers=["CPUExecutionProvider"]), {}

    def run(x: np.ndarray) -> None:
        at = x.__array_interface__["data"][0], x.size
        if at not in bound:
            if len(bound) > 64:
                bound.clear()
            bound[at] = session.io_binding()
            bound[at].bind_input("x", "cpu", 0, np.float32, (x.size,), at[0])
            bound[at].bind_output("y", "cpu", 0, np.float32, (x.size,), at[0])
        session.run_with_iobinding(bound[at])

    return run


_run: list[Callable[[np.ndarray], None]] = []


def exponentials(x: np.ndarray) -> np.ndarray:
    """Of a contiguous array of floats of 32 bits, in place."""
    if not _run:  # made in the process that uses it
        _run.append(_exponentials())
    if x.size:
        _run[0](x)
    return x


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows, (windows, STRIDE, 1)."""
    made = np.multiply(x, y, out=_room("dots", *x.shape))
    return (made.reshape(-1, x.shape[2]) @ np.ones(x.shape[2], np.float32)).reshape(*x.shape[:2], 1)


class Tables(NamedTuple):
    """Weights (WIDTH, 3 * WIDTH) of scaled queries, keys and mixed values; the three by class and by place; the longest of the classes' factors in `out` and the bigrams' greatest size."""

    weights: np.ndarray
    classes: tuple[np.ndarray, ...]
    places: tuple[np.ndarray, ...]
    reach: tuple[float, float]


def tables(p: dict[str, np.ndarray]) -> Tables:
    """A place's input is the sum of its class' and its place's, so the same holds for its query, key and value, and for the mixture of values: none needs a product per place."""
    weights = np.concatenate([p["qkv"][:, :WIDTH] * np.float32(WIDTH**-0.5), p["qkv"][:, WIDTH : 2 * WIDTH], p["qkv"][:, 2 * WIDTH :] @ p["mix"]], axis=1)
    parts = lambda y: tuple(y @ weights[:, k : k + WIDTH] for k in range(0, 3 * WIDTH, WIDTH))
    return Tables(weights, parts(p["embed"]), parts(p["place"]), (float(np.square(p["out"]).sum(axis=0).max(initial=0)) ** 0.5, float(np.abs(p["bigrams"]).max())))


def forward(p: dict[str, np.ndarray], kinds: np.ndarray, known: np.ndarray, t: Tables | None = None) -> tuple[np.ndarray, tuple]:
    """Logits (windows, STRIDE, classes) of what follows the last STRIDE places, in arrays that the next call uses again. known: places that lie in the text; t: the parameters' tables."""
    b, own, number, t = len(kinds), WINDOW - STRIDE, p["bigrams"].shape[1], t or tables(p)
    mine = kinds[:, own:]

    def placed(name: str, of: np.ndarray, places: np.ndarray, at: np.ndarray) -> np.ndarray:
        y = of.take(at, axis=0, out=_room(name, *at.shape, WIDTH), mode="clip")
        y += places
        return y

    q = placed("q", t.classes[0], t.places[0][own:], mine)
    k, v = (placed(name, t.classes[i], t.places[i], kinds) for i, name in ((1, "k"), (2, "v")))
    a = np.matmul(q, k.transpose(0, 2, 1), out=_room("a", b, STRIDE, WINDOW))
    exponentials(np.minimum(a, 30, out=a))
    a *= _CAUSAL
    if not known.all():
        a *= known[:, None, :].astype(np.float32)
    z = np.maximum(a.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32), np.float32(1e-20)).reshape(b, STRIDE, 1)  # a window's last texts may end before it
    o = np.matmul(a, v, out=_room("o", b, STRIDE, WIDTH))
    o /= z
    u = placed("u", p["embed"], p["place"][own:], mine)
    u += o
    logits = np.matmul(u.reshape(-1, WIDTH), p["out"], out=_room("logits", b * STRIDE, number)).reshape(b, STRIDE, number)
    logits += p["bigrams"].take(mine, axis=0, out=_room("bigrams", b, STRIDE, number), mode="clip")
    return logits, (q, k, v, a, z, o, u)


def _narrow(p: dict[str, np.ndarray], u: np.ndarray, logits: np.ndarray, t: Tables | None = None) -> bool:
    """Whether no logit is far from 0: by the lengths of the factors, else by the logits themselves."""
    factor, bigrams = (t or tables(p)).reach
    return float(_dots(u, u).max(initial=0)) ** 0.5 * factor + bigrams < 59 or -60 < float(logits.min()) <= float(logits.max()) < 60


def _cut(kinds: np.ndarray, first: np.ndarray, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes at the windows' places, which of them lie in the text, and the places."""
    place = first[:, None] + np.arange(WINDOW)
    known = (place >= text[:, None]) & (place < ends[:, None])
    return kinds.take(np.minimum(np.maximum(place, text[:, None]), ends[:, None] - 1)), known, place


def scores(p: dict[str, np.ndarray], kinds: np.ndarray, targets: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural log P(targets[i] | kinds up to i in its text), for texts of so many places, one after the other, and of the mean of `starts` over the classes there."""
    out, some_of = np.zeros(len(kinds), np.float32), np.zeros(len(kinds), np.float32)
    sums, t = np.stack([np.ones(len(starts)), starts], axis=1).astype(np.float32), tables(p)
    first, text = windows(lengths)
    ends = np.repeat(np.cumsum(lengths), -(-lengths // STRIDE))
    for lo in range(0, len(first), CHUNK):
        some = slice(lo, lo + CHUNK)
        own, known, place = _cut(kinds, first[some], text[some], ends[some])
        logits, (*_, u) = forward(p, own, known, t)
        place, valid = place[:, WINDOW - STRIDE :], known[:, WINDOW - STRIDE :]
        want = targets.take(np.minimum(np.maximum(place, 0), len(targets) - 1))
        flat, size = logits.reshape(-1), logits.shape[2]
        hit = flat.take(np.arange(want.size) * size + want.ravel()).reshape(want.shape)
        top = np.float32(0)
        if not _narrow(p, u, logits, t):  # seldom: exponents that need a shift
            top = logits.max(axis=2)
            logits -= top[:, :, None]
            hit = hit - top
        total, begin = (exponentials(logits).reshape(-1, size) @ sums).reshape(*want.shape, 2).transpose(2, 0, 1)
        place = place[valid]
        out[place] = (hit - np.log(total))[valid]
        some_of[place] = np.log(begin / total)[valid]
    return out, some_of


def gradients(p: dict[str, np.ndarray], kinds: np.ndarray, known: np.ndarray, want: np.ndarray, valid: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the valid targets, and its gradients."""
    b, own, number, t = len(kinds), WINDOW - STRIDE, p["bigrams"].shape[1], tables(p)
    logits, (q, k, v, a, z, o, u) = forward(p, kinds, known, t)
    if not _narrow(p, u, logits, t):  # seldom: exponents that need a shift
        logits -= logits.max(axis=2, keepdims=True)
    flat = lambda y: y.reshape(-1, y.shape[-1])
    d = flat(exponentials(logits))
    total, count = d @ np.ones(number, np.float32), max(1, int(valid.sum()))
    at = np.arange(want.size) * number + want.ravel()
    hit = d.reshape(-1).take(at)
    loss = float(-np.log(np.maximum((hit / total)[valid.ravel()], 1e-30)).sum() / count)
    # of softmax less target, times total; the places' weights go to the narrow factors instead
    d.reshape(-1)[at] = hit - total
    weight = (valid.ravel() / (np.float32(count) * total))[:, None]
    by_out = d.T @ np.multiply(flat(u), weight, out=_room("weighted", b * STRIDE, WIDTH))
    du = np.matmul(d, p["out"].T, out=_room("du", b * STRIDE, WIDTH))
    du *= weight
    du = du.reshape(u.shape)
    do = np.divide(du, z, out=_room("do", *du.shape))  # a is not divided by its sums z
    ds = np.matmul(do, v.transpose(0, 2, 1), out=_room("ds", *a.shape))
    ds -= _dots(do, o)
    ds *= a
    made = _room("made", b, WINDOW, 3 * WIDTH)
    made[:, :own, :WIDTH] = 0
    made[:, own:, :WIDTH] = np.matmul(ds, k, out=_room("dq", *q.shape))
    made[:, :, WIDTH : 2 * WIDTH] = np.matmul(ds.transpose(0, 2, 1), q, out=_room("dk", *k.shape))
    made[:, :, 2 * WIDTH :] = np.matmul(a.transpose(0, 2, 1), do, out=_room("dk", *k.shape))
    x = p["embed"].take(kinds, axis=0, out=_room("x", b, WINDOW, WIDTH), mode="clip")
    x += p["place"]
    by_weights = flat(x).T @ flat(made)
    dx = np.matmul(flat(made), t.weights.T, out=_room("dx", b * WINDOW, WIDTH)).reshape(x.shape)
    dx[:, own:] += du
    slots = np.arange(p["embed"].size).reshape(-1, WIDTH).take(kinds, axis=0, out=_room("slots", *x.shape, kind=np.int64), mode="clip")
    values = _room("values", *x.shape, kind=np.float64)
    values[:] = dx
    by_value = by_weights[:, 2 * WIDTH :]
    return loss, {
        "embed": np.bincount(slots.ravel(), values.ravel(), p["embed"].size).reshape(p["embed"].shape).astype(np.float32), "place": dx.sum(axis=0), "out": by_out.T, "mix": p["qkv"][:, 2 * WIDTH :].T @ by_value,
        "qkv": np.concatenate([by_weights[:, :WIDTH] * np.float32(WIDTH**-0.5), by_weights[:, WIDTH : 2 * WIDTH], by_value @ p["mix"].T], axis=1),
    }


def trained(p: dict[str, np.ndarray], kinds: np.ndarray, targets: np.ndarray, lengths: np.ndarray, rate: float = 0.01, batch: int = 128, seed: int = 0) -> tuple[dict[str, np.ndarray], list[float]]:
    """One pass of Adam over the texts' windows in a fixed random order."""
    first, text = windows(lengths)
    ends = np.repeat(np.cumsum(lengths), -(-lengths // STRIDE))
    order = np.random.default_rng(seed).permutation(len(first))
    grown, losses = vector(p), []
    p = _views(grown, p)
    m, s = np.zeros_like(grown), np.zeros_like(grown)
    for t, lo in enumerate(range(0, len(order), batch), 1):
        some = order[lo : lo + batch]
        own, known, place = _cut(kinds, first[some], text[some], ends[some])
        valid = known[:, WINDOW - STRIDE :]
        loss, g = gradients(p, own, known, targets[np.where(valid, place[:, WINDOW - STRIDE :], 0)], valid)
        losses.append(loss)
        g = vector(g)
        m += 0.1 * (g - m)
        s += 0.01 * (g**2 - s)
        grown -= np.float32(rate) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + np.float32(1e-6))
    return p, losses
