"""A small causal self-attention model in numpy: forward, gradients, training and scoring.

Input is a matrix of classes, a row for each window. At each place the model sees the class
there and the one before, adds what one attention head finds at earlier places of the window
(its own place included), and gives the probabilities of the next class in two steps: of its
group, then of the class within its group. What follows each class in the corpus is a fixed
table of output biases; training learns all else on top of it.
"""

from __future__ import annotations

import math

import numpy as np

WINDOW, STRIDE, WIDTH, GROUPS = 32, 24, 16, 32
FIXED = ("after", "after_group")


def arranged(pairs: np.ndarray) -> np.ndarray:
    """The classes in an order in which neighbours follow similar classes.

    Groups are cut from this order: the sign and size of the leading singular vector of the
    pairs' association tell, for instance, languages apart.
    """
    n = pairs.sum() + 1
    expected = np.outer(pairs.sum(axis=1) + 1, pairs.sum(axis=0) + 1) / n
    association = np.log1p(np.minimum(pairs / expected, 50))
    _, _, right = np.linalg.svd(association - association.mean(axis=0), full_matrices=False)
    return np.argsort(right[0], kind="stable")


def start(pairs: np.ndarray, width: int = WIDTH, window: int = WINDOW, seed: int = 3) -> dict[str, np.ndarray]:
    """Parameters before training, from the counts of neighbouring classes (before, after)."""
    rng = np.random.default_rng(seed)
    n = len(pairs)
    share = pairs.sum(axis=0) + 0.1
    share /= share.sum()
    after = (pairs + 10 * share) / (pairs.sum(axis=1, keepdims=True) + 10)
    after_group = after.reshape(n, GROUPS, -1).sum(axis=2)
    draw = lambda *shape, by: (rng.normal(size=shape) * by).astype(np.float32)
    side = 1 / np.sqrt(width)
    return {
        "here": draw(n, width, by=0.5), "before": draw(n, width, by=0.3), "place": draw(window, width, by=0.1),
        "query": draw(width, width, by=side), "key": draw(width, width, by=side), "value": draw(width, width, by=side),
        "mix": draw(width, width, by=0.3 * side), "out": draw(width, n, by=0.05), "out_group": draw(width, GROUPS, by=0.05),
        # In C order, so that looking at them by group copies nothing.
        "after": np.log(after).astype(np.float32, order="C"), "after_group": np.log(after_group).astype(np.float32, order="C"),
    }


def _mask(n: int) -> np.ndarray:
    return np.triu(np.full((n, n), -1e9, np.float32), 1)


def _heads(p: dict) -> np.ndarray:
    """Weights of query (scaled), key and mixed value side by side, and a column of zeros."""
    scale = p["query"].dtype.type(1 / np.sqrt(len(p["query"])))
    return np.concatenate([p["query"] * scale, p["key"], p["value"] @ p["mix"], np.zeros_like(p["mix"][:, :1])], axis=1)


def hidden(p: dict, ids: np.ndarray):
    """The state at every place, and what the gradients need."""
    n = ids.shape[1]
    last = np.concatenate([np.zeros_like(ids[:, :1]), ids[:, :-1]], axis=1)
    x = p["here"][ids] + p["before"][last] + p["place"][:n]
    q, k, v = x @ p["query"], x @ p["key"], x @ p["value"]
    q *= np.float32(1 / np.sqrt(x.shape[2]))
    a = q @ k.transpose(0, 2, 1)
    a += _mask(n)
    a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(axis=2, keepdims=True)
    c = a @ v
    return x + c @ p["mix"], (last, x, q, k, v, a, c)


def _inputs(p: dict, ids: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At every place what the model sees, and query, key, mixed value and a one, so that a product
    with the values also gives the sum of weights."""
    x = p["here"].take(ids, axis=0)
    x[:, 1:] += p["before"].take(ids[:, :-1], axis=0)
    x[:, 0] += p["before"][0]
    x += p["place"][: ids.shape[1]]
    qkv = (x.reshape(-1, x.shape[2]) @ heads).reshape(*ids.shape, -1)
    qkv[..., -1] = 1
    return x, qkv


def states(p: dict, ids: np.ndarray, heads: np.ndarray, mask: np.ndarray, first: int = 0) -> np.ndarray:
    """``hidden`` of the places from ``first``, for scoring."""
    n, width = ids.shape[1], p["here"].shape[1]
    x, qkv = _inputs(p, ids, heads)
    a = qkv[:, first:, :width] @ qkv[..., width : 2 * width].transpose(0, 2, 1)
    a += mask[first:n, :n]
    np.exp(a, out=a)
    c = a @ qkv[..., 2 * width :]
    h = c[..., :width] * (1 / c[..., width:])
    h += x[:, first:]
    return h


def _by_group(target: np.ndarray, members: int):
    """Group and member of each target and the order that brings groups together, with its cuts."""
    group, member = np.divmod(target, members)
    order = np.argsort(group.astype(np.uint8) if GROUPS <= 256 else group, kind="stable")
    cuts = np.searchsorted(group.take(order), np.arange(GROUPS + 1)).tolist()
    return group, member, order, [(k, slice(i, j)) for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]


def _logits(p: dict, h: np.ndarray, here: np.ndarray, group: np.ndarray, groups: list) -> tuple[np.ndarray, np.ndarray]:
    """Of all groups, and of the members of each row's group; rows are sorted by group."""
    members = len(p["after"]) // GROUPS
    first = h @ p["out_group"]
    first += p["after_group"].take(here, axis=0)
    second = p["after"].reshape(-1, members).take(here * GROUPS + group, axis=0)
    for k, rows in groups:
        second[rows] += h[rows] @ p["out"][:, k * members : (k + 1) * members]
    return first, second


def _exponentials(logits: np.ndarray, target: np.ndarray):
    """Log probability of the targets, the sums of exponentials, and where the targets stand;
    leaves the exponentials in ``logits``, without taking the largest of each row first."""
    at = np.arange(len(logits)) * logits.shape[1] + target
    chosen = logits.reshape(-1).take(at)
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    return chosen - np.log(total), total, at


def scored(p: dict, h: np.ndarray, here: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``output`` without gradients, and without taking the largest of each row first."""
    group, member, order, groups = _by_group(target, len(p["after"]) // GROUPS)
    group, member = group.take(order), member.take(order)
    first, second = _logits(p, h.take(order, axis=0), here.take(order), group, groups)
    result = np.empty(len(h), np.float32)
    result[order] = _exponentials(first, group)[0] + _exponentials(second, member)[0]
    return result


def _softmax(logits: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of the targets, and all probabilities, in place."""
    rows = np.arange(len(logits))
    top = logits.max(axis=1)
    logits -= top[:, None]
    chosen = logits[rows, target]
    np.exp(logits, out=logits)
    total = logits.sum(axis=1)
    logits /= total[:, None]
    return chosen - np.log(total), logits


def output(p: dict, h: np.ndarray, here: np.ndarray, target: np.ndarray, gradient: np.ndarray | None = None):
    """Log probability of each row's target; with ``gradient`` (a weight for each row) also the
    gradients of the weighted sum of losses, for the rows and the output parameters."""
    members = len(p["after"]) // GROUPS
    group, member = np.divmod(target, members)
    result, first = _softmax(h @ p["out_group"] + p["after_group"][here], group)
    back, g = None, {}
    if gradient is not None:
        first[np.arange(len(h)), group] -= 1
        first *= gradient[:, None]
        g = {"out_group": h.T @ first, "out": np.zeros_like(p["out"])}
        back = first @ p["out_group"].T
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(GROUPS + 1))
    after = p["after"].reshape(len(p["after"]), GROUPS, members)
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        rows = order[cuts[k] : cuts[k + 1]]
        weights = p["out"][:, k * members : (k + 1) * members]
        log_p, second = _softmax(h[rows] @ weights + after[here[rows], k], member[rows])
        result[rows] += log_p
        if gradient is not None:
            second[np.arange(len(rows)), member[rows]] -= 1
            second *= gradient[rows][:, None]
            g["out"][:, k * members : (k + 1) * members] = h[rows].T @ second
            back[rows] += second @ weights.T
    return result, back, g


def _careful_gradients(p: dict, ids: np.ndarray, target: np.ndarray, counts: np.ndarray):
    """``loss_and_gradients`` for parameters beyond the range of plain exponentials."""
    h, (last, x, q, k, v, a, c) = hidden(p, ids)
    n = max(int(counts.sum()), 1)
    weight = (counts / n).astype(np.float32).reshape(-1)
    flat = lambda m: m.reshape(-1, m.shape[2])
    log_p, back, g = output(p, flat(h), ids.reshape(-1), target.reshape(-1), weight)
    loss = float(-(log_p * weight).sum())
    dh = back.reshape(h.shape)
    g["mix"] = flat(c).T @ flat(dh)
    dc = dh @ p["mix"].T
    da = dc @ v.transpose(0, 2, 1)
    dv = a.transpose(0, 2, 1) @ dc
    ds = a * (da - (da * a).sum(axis=2, keepdims=True))
    scale = np.float32(1 / np.sqrt(x.shape[2]))
    dq, dk = ds @ k * scale, ds.transpose(0, 2, 1) @ q
    dx = dh + dq @ p["query"].T + dk @ p["key"].T + dv @ p["value"].T
    for name, m in (("query", dq), ("key", dk), ("value", dv)):
        g[name] = flat(x).T @ flat(m)
    g["place"] = np.zeros_like(p["place"])
    g["place"][: ids.shape[1]] = dx.sum(axis=0)
    for name, at in (("here", ids), ("before", last)):
        # Rows of equal classes are summed as a product with their indicator.
        g[name] = np.zeros_like(p[name])
        order = np.argsort(at, axis=None, kind="stable")
        values = at.reshape(-1)[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        g[name][values[first]] = np.add.reduceat(flat(dx)[order], first, axis=0)
    return loss, g


def loss_and_gradients(p: dict, ids: np.ndarray, target: np.ndarray, counts: np.ndarray):
    """Mean cross-entropy over the places with ``counts`` true, and its gradients."""
    with np.errstate(all="ignore"):
        loss, g = _quick_gradients(p, ids, target, counts)
    return (loss, g) if np.isfinite(loss) else _careful_gradients(p, ids, target, counts)


def _quick_gradients(p: dict, ids: np.ndarray, target: np.ndarray, counts: np.ndarray):
    (many, n), width, kind = ids.shape, p["here"].shape[1], p["here"].dtype
    heads = _heads(p)
    x, qkv = _inputs(p, ids, heads)
    x = x.reshape(-1, width)
    q, k, v = qkv[..., :width], qkv[..., width : 2 * width], qkv[..., 2 * width :]
    a = q @ k.transpose(0, 2, 1)
    a += _mask(n)
    np.exp(a, out=a)
    c = (a @ v).reshape(-1, width + 1)
    share = 1 / c[:, width:]
    c = c[:, :width] * share
    h = c + x
    at = np.flatnonzero(counts)
    back, log_p, g = _output_gradients(p, h, ids.reshape(-1), target.reshape(-1), at)
    dh = np.zeros_like(x)
    dh[back[0]] = back[1]
    dc = np.empty((len(x), width + 1), kind)
    np.multiply(dh, share, out=dc[:, :width])
    np.multiply(np.einsum("ij,ij->i", dh, c), -share[:, 0], out=dc[:, width])
    dc = dc.reshape(many, n, -1)
    d = np.empty((many, n, 3 * width), kind)
    np.matmul(a.transpose(0, 2, 1), dc[..., :width], out=d[..., 2 * width :])
    a *= dc @ v.transpose(0, 2, 1)
    np.matmul(a, k, out=d[..., :width])
    np.matmul(a.transpose(0, 2, 1), q, out=d[..., width : 2 * width])
    d = d.reshape(len(x), -1)
    dx = d @ heads[:, :-1].T
    dx += dh
    by_head = x.T @ d
    by_head[:, :width] *= kind.type(1 / np.sqrt(width))
    g["query"], g["key"], by_value = by_head[:, :width], by_head[:, width : 2 * width], by_head[:, 2 * width :]
    g["value"], g["mix"] = by_value @ p["mix"].T, p["value"].T @ by_value
    by_place = dx.reshape(many, n, width)
    g["place"] = np.zeros_like(p["place"])
    g["place"][:n] = by_place.sum(axis=0)
    # A class is "before" at the next place: both tables' rows are summed in one order of the classes.
    both = np.zeros((many, n, 2 * width), kind)
    both[..., :width] = by_place
    both[:, :-1, width:] = by_place[:, 1:]
    order = np.argsort(ids.reshape(-1).astype(np.uint16 if len(p["here"]) <= 1 << 16 else np.int64), kind="stable")
    values = ids.reshape(-1).take(order)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    values, sums = values[first], np.add.reduceat(both.reshape(len(x), -1).take(order, axis=0), first, axis=0)
    g["here"], g["before"] = np.zeros_like(p["here"]), np.zeros_like(p["before"])
    g["here"][values] = sums[:, :width]
    g["before"][values] = sums[:, width:]
    g["before"][0] += by_place[:, 0].sum(axis=0)
    return -float(log_p.sum()) / max(len(at), 1), g


def _output_gradients(p: dict, h: np.ndarray, here: np.ndarray, target: np.ndarray, at: np.ndarray):
    """Gradients for the states at the places ``at`` (these in the order worked in), log
    probabilities there, and gradients of the output parameters."""
    members, n = len(p["after"]) // GROUPS, max(len(at), 1)
    group, member, order, groups = _by_group(target.take(at), members)
    group, member, at = group.take(order), member.take(order), at.take(order)
    h = h.take(at, axis=0)
    first, second = _logits(p, h, here.take(at), group, groups)
    g, log_p, back = {"out": np.zeros_like(p["out"])}, 0, 0
    for logits, chosen in ((first, group), (second, member)):
        found, total, place = _exponentials(logits, chosen)
        log_p = log_p + found
        logits.reshape(-1)[place] -= total
        part = (1 / (total * n)).astype(h.dtype)[:, None]
        weighted = h * part
        if logits is first:
            g["out_group"] = weighted.T @ logits
            back = logits @ p["out_group"].T
        else:
            more = np.empty_like(h)
            for k, rows in groups:
                columns = slice(k * members, (k + 1) * members)
                g["out"][:, columns] = weighted[rows].T @ logits[rows]
                np.dot(logits[rows], p["out"][:, columns].T, out=more[rows])
            more *= part
            return (at, back + more), log_p, g
        back *= part


def train(p: dict, windows: np.ndarray, rate: float = 0.02, seed: int = 1) -> dict:
    """One pass of Adam over windows of classes; a class below 0 is no target.

    Steps are of 32 to 128 windows, a hundred steps where there are windows enough, and larger steps go
    further; every window is in one of them.
    """
    p = {k: v.copy() for k, v in p.items()}
    m = {k: np.zeros_like(v) for k, v in p.items() if k not in FIXED}
    s = {k: np.zeros_like(v) for k, v in m.items()}
    batch = min(128, max(32, len(windows) // 100))
    rate *= math.sqrt(batch / 32)
    order = np.random.default_rng(seed).permutation(len(windows))
    steps = -(-len(order) // batch)
    for step in range(steps):
        part = windows.take(order[step * batch : (step + 1) * batch], axis=0)
        ids, target = part[:, :-1], part[:, 1:]
        _, g = loss_and_gradients(p, np.maximum(ids, 0), np.maximum(target, 0), target >= 0)
        now = rate * min(1, (step + 1) / 10) * (1 - 0.7 * step / steps)
        for k in m:
            m[k] *= 0.9
            m[k] += 0.1 * g[k]
            s[k] *= 0.99
            s[k] += 0.01 * (g[k] * g[k])
            p[k] -= (now / (1 - 0.9 ** (step + 1))) * m[k] / (np.sqrt(s[k] / (1 - 0.99 ** (step + 1))) + 1e-8)
    return p


def log_probabilities(p: dict, classes: np.ndarray, bounds: np.ndarray, begin: int, stride: int = STRIDE, batch: int = 32) -> np.ndarray:
    """Natural log probability of every class of every text, each scored once.

    Windows of a text overlap: the first scores all its places, each later one its last
    ``stride`` places, for which the earlier ones are context. ``begin`` stands before a text.
    """
    window = len(p["place"])
    n = np.diff(bounds)
    number = np.where(n > 0, 1 + np.maximum(0, -(-(n - window) // stride)), 0)
    text = np.repeat(np.arange(len(n)), number)
    at = (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)) * stride
    out = np.zeros(len(classes), np.float32)
    # Inputs are the classes one place earlier.
    shifted = np.empty(len(classes) + window + 1, np.int64)
    shifted[1 : len(classes) + 1] = classes
    shifted[len(classes) + 1 :] = begin
    shifted[bounds[:-1][n > 0]] = begin
    shifted[0] = begin
    base = bounds[:-1][text] + at
    size = np.minimum(window, n[text] - at)
    # Windows of equal length together, so short texts are not padded, and first ones apart from later ones.
    order = np.lexsort((size, at > 0))
    heads, mask = _heads(p), _mask(window)
    with np.errstate(all="ignore"):
        for chunk in range(0, len(order), 512):
            found, places = [], []
            part = order[chunk : chunk + 512]
            for at_each, first, inside in _windows(base, size, at, part, batch, window, stride):
                h = states(p, shifted.take(at_each), heads, mask, first)
                found.append(_inside(h, inside))
                places.append(_inside(at_each[:, first:, None], inside).reshape(-1))
            where = np.concatenate(places)
            h = np.concatenate(found)
            log_p = scored(p, h, shifted.take(where), classes.take(where))
            if not np.isfinite(log_p).all():  # beyond the range of the short way
                h = np.concatenate([
                    _inside(hidden(p, shifted[a])[0][:, f:], i) for a, f, i in _windows(base, size, at, part, batch, window, stride)
                ])
                log_p, _, _ = output(p, h, shifted[where], classes[where])
            out[where] = log_p
    return out


def _inside(values: np.ndarray, inside: np.ndarray | None) -> np.ndarray:
    flat = values.reshape(-1, values.shape[2])
    return flat if inside is None else flat.take(inside, axis=0)


def _windows(base, size, at, order, batch, window, stride):
    """Places of each batch of windows, the first that the windows score, and numbers of those that are
    scored from there (None: all)."""
    cut = int(np.count_nonzero(at[order] == 0))
    for low, high in [(i, min(i + batch, cut)) for i in range(0, cut, batch)] + [
        (i, min(i + batch, len(order))) for i in range(cut, len(order), batch)
    ]:
        mine = order[low:high]
        sizes = size[mine]
        width, first = int(sizes[-1]), window - stride if low >= cut else 0
        inside = None if sizes[0] == width else np.flatnonzero(np.arange(first, width) < sizes[:, None])
        yield base[mine][:, None] + np.arange(width), first, inside
