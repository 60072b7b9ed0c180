"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, many streams at once."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Hidden units, least and most steps of a backpropagation window, streams side by side, and symbols that fill a window:
#: where fewer streams go on, a window has more steps.
HIDDEN, STEPS, MOST, STREAMS, FILL = 24, 16, 128, 512, 8_192
#: Symbols of a window where nothing is learnt: rows of a class lie together in longer runs.
SCORED = 32_768
#: A training window has LEAST symbols at least, up to FILL as long as a pass has STEPS_WANTED steps.
LEAST, STEPS_WANTED = 1_024, 192
#: Rows of the output layer that are worked on at a time.
BLOCK = 1_536
#: Vocabularies of fewer symbols have classes of equal width.
EQUAL_BELOW = 1_024
#: Share of a class in the sum of square roots of probability: 1 has the fewest logits, more has fewer products.
SHARE = 2.0
#: Parameters that the optimiser moves at a time, so that arrays stay in the cache.
STRIDE = 16_384
#: Ids of the two symbols that every vocabulary has; words follow by rank.
UNK, END = 0, 1


@dataclass
class Shape:
    """vocab symbols in classes of consecutive ids; edges has where they begin, and the end of the last.

    A symbol costs as many logits as there are classes and as its class is wide. Over a corpus that is least where a class
    holds an equal share, SHARE, in the sum of square roots of probability: frequent symbols lie in narrow classes, the most frequent
    alone, and rare ones in wide classes. Few symbols, and those of unknown frequency, lie in classes of equal `width`,
    about the square root of their number; the last one is filled up.
    """

    vocab: int
    edges: np.ndarray
    width: int | None

    @classmethod
    def of(cls, vocab: int, frequency: np.ndarray | None = None) -> Shape:
        if frequency is None or vocab < EQUAL_BELOW:
            width = max(2, int(np.ceil(np.sqrt(vocab))))
            return cls(vocab, np.arange(-(-vocab // width) + 1) * width, width)
        f = np.maximum(frequency.astype(float), 1)
        root = np.sqrt(f / f.sum())
        share = np.floor((np.cumsum(root) - root / 2) / SHARE)  # the class at a symbol's middle
        return cls(vocab, np.append(np.flatnonzero(np.append(True, share[1:] != share[:-1])), vocab), None)

    @property
    def classes(self) -> int:
        return len(self.edges) - 1

    def sizes(self) -> list[tuple[str, tuple[int, ...]]]:
        h = HIDDEN
        words = (h + 1, self.vocab) if self.width is None else (self.classes, h + 1, self.width)
        return [("x", (self.vocab, 3 * h)), ("u", (h, 3 * h)), ("cw", (h + 1, self.classes)), ("ww", words)]

    def words(self, ww: np.ndarray, k: int) -> np.ndarray:
        """(hidden + 1, width): the part of the word layer that is class k's."""
        return ww[:, self.edges[k] : self.edges[k + 1]] if self.width is None else ww[k]


def split(flat: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    """Views of the flat parameter vector: input table (embedding and gate bias in one), recurrent weights, class and word layers, whose
    last rows are biases."""
    out, at = {}, 0
    for name, size in shape.sizes():
        n = int(np.prod(size))
        out[name] = flat[at : at + n].reshape(size)
        at += n
    return out


def start(shape: Shape, frequency: np.ndarray) -> np.ndarray:
    """First parameters: small weights, and output biases that give each symbol its frequency."""
    rng = np.random.Generator(np.random.PCG64(11))
    n = sum(int(np.prod(s)) for _, s in shape.sizes())
    flat = (rng.standard_normal(n) * 0.08).astype(np.float32)
    p = split(flat, shape)
    f = np.full(shape.edges[-1], 1e-9)
    f[: shape.vocab] += frequency / frequency.sum()
    by_class = np.add.reduceat(f, shape.edges[:-1])
    p["cw"][-1] = np.log(by_class)
    bias = np.log(f / np.repeat(by_class, np.diff(shape.edges)))
    bias[shape.vocab :] = -30.0  # no symbol
    p["ww"][..., -1, :] = bias.reshape(p["ww"][..., -1, :].shape)
    p["x"][:, :HIDDEN] += 1.0  # keep the state at first
    return flat


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    """tanh in place by the exponential, which numpy has in half the time."""
    x *= 2
    _sigmoid(x)
    x *= 2
    x -= 1
    return x


def _gates(u: np.ndarray) -> np.ndarray:
    """(3, hidden, hidden): recurrent weights gate by gate, so that a gate of all streams lies together."""
    return np.ascontiguousarray(u.reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))


def forward(p: dict[str, np.ndarray], tokens: np.ndarray, first: np.ndarray, h: np.ndarray, keep: bool):
    """States (steps, streams, hidden) before each symbol is read in; tokens are what has been read before it.

    tokens[t] is the symbol before the t-th one; first[t] says that the t-th begins a document, whose state is zero.
    """
    steps, n = tokens.shape
    u, table = _gates(p["u"]), p["x"].reshape(-1, HIDDEN)
    hs = np.empty((steps, n, HIDDEN), u.dtype)
    at = tokens[:, None].astype(np.intp) * 3 + np.arange(3)[:, None]  # rows of the table, gate by gate
    opens = first.any(axis=1).tolist()
    tape = []
    for t in range(steps):
        if opens[t]:
            h = np.where(first[t][:, None], np.float32(0), h)
        g = table.take(at[t], axis=0)
        hu = np.matmul(h, u)
        zr, c = g[:2], g[2]
        zr += hu[:2]
        _sigmoid(zr)
        c += zr[1] * hu[2]
        _tanh(c)
        if keep:
            tape.append((h, zr, hu[2], c))
        new = np.subtract(h, c, out=hs[t])
        new *= zr[0]
        new += c
        h = new
    return hs, h, tape


def _small(p: dict[str, np.ndarray]) -> bool:
    """States lie between -1 and 1, so no logit is above the sum of its weights."""
    return bool(max(np.abs(p["cw"]).sum(0).max(), np.abs(p["ww"]).sum(-2).max()) < 60)


def _exp(x: np.ndarray, small: bool) -> None:
    """exp of logits in place, cut at 60 instead of shifted by their maximum unless they are known to be small."""
    if not small:
        np.minimum(x, 60.0, out=x)
    np.exp(x, out=x)


def output(p: dict[str, np.ndarray], shape: Shape, hs: np.ndarray, target: np.ndarray, grads: dict[str, np.ndarray] | None = None, small: bool | None = None):
    """(log-probability of each target, gradient of hs or None). hs: (n, hidden).

    Rows are sorted by class, so that each class is one product of neighbouring rows, and taken BLOCK at a time, so that
    arrays stay in the cache; words of a class lie side by side in `pw`, row after row. The softmax is not divided by its sums; the few columns that it is multiplied with are.
    """
    n = len(target)
    small = _small(p) if small is None else small
    wide = np.diff(shape.edges)
    ones, tiny = np.ones(max(shape.classes, wide.max()), hs.dtype), np.float32(1e-30)  # rows are summed by products
    cls = np.repeat(np.arange(shape.classes), wide)[target]
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    cls = cls[order]
    word = target[order] - shape.edges[cls]
    x = np.ones((n, HIDDEN + 1), hs.dtype)
    x[:, :-1] = hs.take(order, axis=0)
    logp, dx = np.empty(n, np.float64), None if grads is None else np.empty((n, HIDDEN), hs.dtype)
    for a in range(0, n, BLOCK):
        rows = slice(a, min(a + BLOCK, n))
        c, w, y = cls[rows], word[rows], x[rows]
        at = np.arange(len(c))
        pc = y @ p["cw"]
        _exp(pc, small)
        total = pc @ ones[: shape.classes] + tiny
        hit = pc[at, c]
        here = np.flatnonzero(np.append(True, c[1:] != c[:-1])).tolist()
        parts = [(int(c[i]), slice(i, j)) for i, j in zip(here, [*here[1:], len(c)], strict=True)]
        start_of = np.cumsum(wide[c]) - wide[c]  # of each row in pw
        pw = np.empty(int(start_of[-1] + wide[c[-1]]), y.dtype)
        layer = []
        for k, part in parts:
            i, m = int(start_of[part.start]), part.stop - part.start
            layer.append((part, shape.words(p["ww"], k), pw[i : i + m * int(wide[k])].reshape(m, -1)))
            np.matmul(y[part], layer[-1][1], out=layer[-1][2])
        _exp(pw, small)
        inner = np.empty(len(c), y.dtype)
        for part, _, odds in layer:
            np.matmul(odds, ones[: odds.shape[1]], out=inner[part])
        inner += tiny
        w = w + start_of
        logp[rows] = np.log(np.maximum(hit / total, 1e-30)) + np.log(np.maximum(pw[w] / inner, 1e-30))
        if grads is None:
            continue
        pc[at, c] -= total
        pw[w] -= inner
        share = y / total[:, None]
        grads["cw"] += share.T @ pc
        d = pc @ p["cw"][:-1].T
        d /= total[:, None]
        np.divide(y, inner[:, None], out=share)
        e = np.empty_like(d)
        for (k, _), (part, weights, odds) in zip(parts, layer, strict=True):
            mine = shape.words(grads["ww"], k)
            mine += share[part].T @ odds
            np.matmul(odds, weights[:-1].T, out=e[part])
        e /= inner[:, None]
        d += e
        dx[rows] = d
    out = np.empty(n, np.float64)
    out[order] = logp
    if grads is None:
        return out, None
    dh = np.empty_like(dx)
    dh[order] = dx
    return out, dh


def _sums(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of neighbouring rows from each edge on: long runs by a product, short ones one more row of each at a time."""
    size, out = np.diff(np.append(edge, len(x))), x.take(edge, axis=0)
    long = np.flatnonzero(size > 8)
    ones = np.ones(int(size.max()), x.dtype)
    for k, a, m in zip(long.tolist(), edge[long].tolist(), size[long].tolist(), strict=True):
        np.matmul(ones[:m], x[a : a + m], out=out[k])
    rest = np.flatnonzero(size <= 8)
    for j in range(1, 8):
        rest = rest[size[rest] > j]
        if not len(rest):
            break
        out[rest] += x.take(edge[rest] + j, axis=0)
    return out


def backward(p: dict[str, np.ndarray], tokens: np.ndarray, first: np.ndarray, tape: list, dhs: np.ndarray, grads: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Backpropagation through the window; what comes from beyond it is cut off. Gives the gradient of the input table as
    (symbols, rows), as only symbols of the window have one; it is added to grads where they have the table."""
    steps, n = tokens.shape
    back = np.ascontiguousarray(_gates(p["u"]).transpose(0, 2, 1))
    dx = np.empty((steps, n, 3, HIDDEN), np.float32)
    du = np.empty((3, steps, n, HIDDEN), np.float32)
    dh = np.zeros((n, HIDDEN), np.float32)
    opens = first.any(axis=1).tolist()
    for t in range(steps - 1, -1, -1):
        h, zr, hun, c = tape[t]
        dh = dh + dhs[t]
        keep = 1 - zr
        dc = dh * keep[0]
        dc *= 1 - c * c
        g = du[:, t]
        keep *= zr
        np.subtract(h, c, out=g[0])
        g[0] *= dh
        np.multiply(dc, hun, out=g[1])
        g[:2] *= keep
        dx[t, :, :2] = g[:2].transpose(1, 0, 2)
        dx[t, :, 2] = dc
        np.multiply(dc, zr[1], out=g[2])
        dh = dh * zr[0]
        for part in np.matmul(g, back):
            dh += part
        if opens[t]:
            dh[first[t]] = 0
    before = np.concatenate([x[0] for x in tape]).T
    for k in range(3):
        grads["u"][:, k * HIDDEN : (k + 1) * HIDDEN] += before @ du[k].reshape(-1, HIDDEN)
    flat = tokens.reshape(-1)
    order = np.argsort(flat.astype(np.uint16) if len(p["x"]) <= 1 << 16 else flat, kind="stable")
    ids = flat[order]
    edge = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    ids, rows = ids[edge], _sums(dx.reshape(-1, 3 * HIDDEN).take(order, axis=0), edge)
    if "x" in grads:
        grads["x"][ids] += rows
    return ids, rows


class Adam:
    """Adam over the flat vector. Of the input table, with which it begins, only the rows that a window touches move, so a
    step costs what the window holds, whatever the vocabulary."""

    def __init__(self, n: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(n, np.float32), np.zeros(n, np.float32), 0, rate

    def step(self, flat: np.ndarray, grad: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """grad: of what follows the table, used up; rows: of the table's rows ids."""
        self.t += 1
        size = self.rate / (1 - 0.9**self.t)
        even = np.float32(1 / (1 - 0.99**self.t))
        k, wide = len(flat) - len(grad), (-1, 3 * HIDDEN)
        room = np.empty(min(STRIDE, len(grad)), np.float32)
        for a in range(0, len(grad), STRIDE):
            g = grad[a : a + STRIDE]
            here = slice(k + a, k + a + len(g))
            m, v, tenth = self.m[here], self.v[here], room[: len(g)]
            m *= np.float32(0.9)
            m += np.multiply(g, np.float32(0.1), out=tenth)
            v *= np.float32(0.99)
            g *= g
            g *= np.float32(0.01)
            v += g
            np.multiply(v, even, out=g)
            np.sqrt(g, out=g)
            g += np.float32(1e-8)
            np.divide(m, g, out=g)
            g *= np.float32(size)
            flat[here] -= g
        table, m, v = flat[:k].reshape(wide), self.m[:k].reshape(wide), self.v[:k].reshape(wide)
        some = STRIDE // wide[1]
        for a in range(0, len(ids), some):
            at, g = ids[a : a + some], rows[a : a + some]
            m_new, v_new = m.take(at, axis=0), v.take(at, axis=0)
            m_new += 0.1 * (g - m_new)
            v_new += 0.01 * (g * g - v_new)
            m[at], v[at] = m_new, v_new
            v_new *= even
            np.sqrt(v_new, out=v_new)
            v_new += np.float32(1e-8)
            m_new /= v_new
            m_new *= np.float32(size)
            table[at] -= m_new


def fill_of(tokens: int) -> int:
    """Symbols of a training window: a share of what a task has, so that few symbols still make many steps of the optimiser."""
    return max(LEAST, min(FILL, tokens // STEPS_WANTED))


def segments(bounds: np.ndarray, longest: int) -> np.ndarray:
    """Bounds of documents with even cuts in those of more than `longest` symbols."""
    size = np.diff(bounds)
    parts = -(-size // longest)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.append(np.repeat(bounds[:-1], parts) + k * np.repeat(size, parts) // np.repeat(parts, parts), bounds[-1])


def windows(tokens: np.ndarray, bounds: np.ndarray, streams: int = STREAMS, fill: int = FILL, opens: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(before, target, first, doc, active) windows over documents dealt to streams, the longest first to the least full.

    tokens[bounds[d]:bounds[d + 1]] is document d, which ends with END and lies whole and in order in one stream. Rows
    are streams by falling length; only those that go on are given, so `active` falls. doc is -1 beyond a stream's end. Where
    bounds are those of segments, opens has the places at which documents begin.
    Memory is that of the tokens and of one window, however long a document is.
    """
    size = np.diff(bounds)
    n = min(streams, len(size))
    if not n:
        return
    heap, dealt = [(0, s) for s in range(n)], [[] for _ in range(n)]
    for d in np.argsort(-size, kind="stable").tolist():
        load, s = heap[0]
        dealt[s].append(d)
        heapq.heapreplace(heap, (load + int(size[d]), s))
    loads = sorted(((load, s) for load, s in heap), reverse=True)
    length = np.array([load for load, _ in loads])
    docs = np.concatenate([dealt[s] for _, s in loads]).astype(np.int64)
    m = size[docs]
    place = np.arange(len(tokens)) + np.repeat(bounds[docs] - (np.cumsum(m) - m), m)  # in tokens, stream after stream
    doc_of = np.repeat(docs.astype(np.int32), m)
    begins = np.zeros(len(tokens), bool)
    begins[np.cumsum(m) - m] = True
    offset = np.cumsum(length) - length
    alone = np.zeros(len(tokens), bool)  # what has no symbol before it
    alone[bounds[:-1] if opens is None else opens] = True
    at = 0
    while at < length[0]:
        active = int(np.count_nonzero(length > at))
        steps = min(int(length[0]) - at, max(STEPS, min(MOST, fill // active)))
        step = at + np.arange(steps)[:, None]
        real = step < length[:active]
        i = np.where(real, offset[:active] + step, 0)
        first = begins[i] & real
        here = place[i]
        before = np.where(real & ~alone[here], tokens[here - 1], END).astype(np.int32)
        yield before, np.where(real, tokens[here], END).astype(np.int32), first, np.where(real, doc_of[i], -1), active
        at += steps


def train(flat: np.ndarray, shape: Shape, tokens: np.ndarray, bounds: np.ndarray, adam: Adam) -> None:
    """One pass over the documents, a step of the optimiser per window.

    Documents much longer than a stream's share are cut, and the state begins anew at a cut: else the last windows would hold
    little beside the longest text. Every symbol is learnt from, after the one that stands before it.
    """
    fill = fill_of(len(tokens))
    streams = fill // STEPS
    cut = segments(bounds, max(LEAST, len(tokens) // streams))
    p, grad, h = split(flat, shape), np.zeros(len(flat) - shape.vocab * 3 * HIDDEN, np.float32), None
    grads, at = {}, 0
    for name, size in shape.sizes()[1:]:
        n = int(np.prod(size))
        grads[name] = grad[at : at + n].reshape(size)
        at += n
    for before, target, first, doc, active in windows(tokens, cut, streams, fill, bounds[:-1]):
        h = np.zeros((active, HIDDEN), np.float32) if h is None else h[:active]
        hs, h, tape = forward(p, before, first, h, True)
        real = doc.reshape(-1) >= 0
        flat_hs = hs.reshape(-1, HIDDEN)
        grad[:] = 0
        if real.all():
            _, dh = output(p, shape, flat_hs, target.reshape(-1), grads)
        else:
            dh = np.zeros_like(flat_hs)
            dh[real] = output(p, shape, flat_hs[real], target.reshape(-1)[real], grads)[1]
        ids, rows = backward(p, before, first, tape, dh.reshape(hs.shape), grads)
        scale = 1 / max(1, int(real.sum()))
        norm = scale * float(np.sqrt(np.dot(grad, grad) + np.einsum("ij,ij->", rows, rows)))
        scale *= min(1.0, 1.0 / max(norm, 1e-30))
        grad *= np.float32(scale)
        rows *= np.float32(scale)
        adam.step(flat, grad, ids, rows)


def log_likelihood(flat: np.ndarray, shape: Shape, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each whole document, state carried from window to window."""
    p, total, h = split(flat, shape), np.zeros(len(bounds) - 1), None
    small = _small(p)
    for before, target, first, doc, active in windows(tokens, bounds, fill=SCORED):
        h = np.zeros((active, HIDDEN), np.float32) if h is None else h[:active]
        hs, h, _ = forward(p, before, first, h, False)
        doc, target, flat_hs = doc.reshape(-1), target.reshape(-1), hs.reshape(-1, HIDDEN)
        real = doc >= 0
        if not real.all():
            doc, target, flat_hs = doc[real], target[real], flat_hs[real]
        logp, _ = output(p, shape, flat_hs, target, small=small)
        total += np.bincount(doc, weights=logp, minlength=len(total))
    return total
