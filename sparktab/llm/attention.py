"""A small causal self-attention language model in numpy: forward, loss gradient, training.

One head over windows of subword ids. Probabilities are factored through classes of ids:
the model gives P(class | context), corpus counts give P(id | class), so that an output is a
few dozen numbers instead of a vocabulary.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Model width, inputs a window holds, classes of outputs, ids with an embedding of their own.
WIDTH, WINDOW, CLASSES, EMBEDDED = 16, 32, 64, 2048
#: Inputs by which one window follows another; the rest of a window is context.
STRIDE = 28
#: Windows computed at a time, in scoring and in training.
BATCH, TRAIN_BATCH = 256, 128

SHAPES = {
    "embed": (EMBEDDED, WIDTH),
    "place": (WINDOW, WIDTH),
    "mix": (WIDTH, 3 * WIDTH),
    "out": (WIDTH, WIDTH),
    "top": (WIDTH, CLASSES),
    "bias": (CLASSES,),
}
#: Attention logits are held below this, so that their exponentials need no shift.
TOP_LOGIT = np.float32(60)
#: Class logits with their bias up to this need no shift either.
SAFE_LOGIT = 80
_PAST = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_SCALE = np.float32(WIDTH**-0.5)
#: Where the numbers of each embedding row lie.
_CELLS = np.arange(EMBEDDED * WIDTH).reshape(EMBEDDED, WIDTH)

Parameters = dict[str, np.ndarray]


def flatten(parameters: Parameters) -> np.ndarray:
    return np.concatenate([parameters[name].ravel() for name in SHAPES])


def unflatten(flat: np.ndarray) -> Parameters:
    parameters, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        parameters[name] = flat[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return parameters


@dataclass
class Vocabulary:
    """What corpus counts say of every id: its embedding row, its class, log P(id | class)."""

    row: np.ndarray
    group: np.ndarray
    within: np.ndarray
    prior: np.ndarray

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Vocabulary:
        """Embedding rows for the most frequent ids; classes of about equal mass by falling count."""
        smooth = counts + 0.5
        order = np.argsort(-smooth, kind="stable")
        row = np.full(len(counts), EMBEDDED - 1, np.int64)
        row[order[: EMBEDDED - 1]] = np.arange(min(EMBEDDED - 1, len(counts)))
        mass = np.cumsum(smooth[order]) - smooth[order] / 2
        group = np.empty(len(counts), np.int64)
        group[order] = np.minimum((mass / smooth.sum() * CLASSES).astype(np.int64), CLASSES - 1)
        totals = np.bincount(group, smooth, CLASSES)
        within = np.log(smooth / totals[group])
        prior = np.log(np.maximum(totals, 1e-3) / totals.sum())
        return cls(row, group, within, prior)


def first_parameters(vocabulary: Vocabulary, seed: int = 7) -> Parameters:
    """Small random weights; the output bias makes the untrained model a class unigram model."""
    rng = np.random.default_rng(seed)
    parameters = {name: (rng.standard_normal(shape) * 0.1).astype(np.float32) for name, shape in SHAPES.items()}
    parameters["bias"] = vocabulary.prior.astype(np.float32)
    return parameters


class Room:
    """Arrays that are written again for every batch, so that none is allocated and paged in anew."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        size, held = math.prod(shape), self.held.get(name)
        if held is None or held.size < size or held.dtype != kind:
            self.held[name] = held = np.empty(size, kind)
        return held[:size].reshape(shape)


def _scaled(mix: np.ndarray) -> np.ndarray:
    mix = mix.copy()
    mix[:, :WIDTH] *= _SCALE
    return mix


def _attend(p: Parameters, rows: np.ndarray, room: Room, first: int = 0) -> tuple[np.ndarray, ...]:
    """Inputs, scaled queries beside keys and values; of places from ``first`` on attention and its row sums,
    mixed values, hidden states."""
    n, kind = len(rows), p["embed"].dtype
    x = room("x", (n * WINDOW, WIDTH), kind)
    np.take(p["embed"], rows.ravel(), axis=0, out=x, mode="clip")
    by_window = x.reshape(n, WINDOW * WIDTH)
    by_window += p["place"].ravel()
    mixed = np.matmul(x, _scaled(p["mix"]), out=room("mixed", (n * WINDOW, 3 * WIDTH), kind))
    q, k, v = _thirds(mixed)
    weights = room("weights", (n, WINDOW - first, WINDOW), kind)
    np.matmul(q[:, first:], k.transpose(0, 2, 1), out=weights)
    if weights.size and weights.max() > TOP_LOGIT:
        np.minimum(weights, TOP_LOGIT, out=weights)
    np.exp(weights, out=weights)
    weights *= _PAST[first:]
    mass = (weights.reshape(-1, WINDOW) @ np.ones(WINDOW, kind))[:, None]
    seen = np.matmul(weights, v, out=room("seen", (n, WINDOW - first, WIDTH), kind)).reshape(-1, WIDTH)
    seen /= mass
    hidden = np.matmul(seen, p["out"], out=room("hidden", seen.shape, kind))
    by_window = hidden.reshape(n, (WINDOW - first) * WIDTH)
    by_window += x.reshape(n, WINDOW * WIDTH)[:, first * WIDTH :]
    return x, mixed, weights, mass, seen, hidden


def _thirds(mixed: np.ndarray) -> list[np.ndarray]:
    parts = mixed.reshape(-1, WINDOW, 3 * WIDTH)
    return [parts[:, :, i * WIDTH : (i + 1) * WIDTH] for i in range(3)]


def _chances(p: Parameters, hidden: np.ndarray, goal: np.ndarray, room: Room) -> tuple[np.ndarray, ...]:
    """Exponentials of the logits without their bias, that of the bias, weighted sums, log P(goal), where goals lie."""
    chance = np.matmul(hidden, p["top"], out=room("chance", (len(hidden), CLASSES), hidden.dtype))
    at, bias = np.arange(0, chance.size, CLASSES) + goal, p["bias"]
    # No logit exceeds the largest state times a class's absolute weights; mostly that settles it.
    most = max(hidden.max(), -hidden.min()) * np.abs(p["top"]).sum(axis=0).max() if chance.size else 0
    if most + np.abs(bias).max() > SAFE_LOGIT and max(chance.max(), -chance.min()) + np.abs(bias).max() > SAFE_LOGIT:
        chance += bias
        chance -= chance.max(axis=1, keepdims=True)
        bias = np.zeros_like(bias)
    chosen = chance.ravel()[at] + bias[goal]
    np.exp(chance, out=chance)
    ratio = np.exp(bias)
    sums = chance @ ratio
    return chance, ratio, sums, chosen - np.log(sums), at


def class_scores(p: Parameters, rows: np.ndarray, wanted: np.ndarray, scored: np.ndarray, room: Room | None = None) -> np.ndarray:
    """log P(class) of the wanted classes where ``scored``, in row order."""
    room, context = room or Room(), WINDOW - STRIDE
    first = 0 if scored[:, :context].any() else context
    hidden, live = _attend(p, rows, room, first)[-1], np.flatnonzero(scored[:, first:])
    if len(live) < len(hidden):
        hidden = np.take(hidden, live, axis=0, out=room("flat", (len(live), WIDTH), hidden.dtype), mode="clip")
    return _chances(p, hidden, wanted[scored], room)[3]


def gradient(
    p: Parameters, rows: np.ndarray, wanted: np.ndarray, scored: np.ndarray, room: Room | None = None
) -> tuple[float, Parameters]:
    """Mean loss over the scored places of a batch, and its gradient; that of the embedding lies in ``room``.

    Attention stays unnormalised, and exponentials of logits without their bias: the factors
    that are missing are put on narrower arrays.
    """
    room, kind = room or Room(), p["embed"].dtype
    x, mixed, weights, mass, seen, hidden = _attend(p, rows, room)
    n, live = len(rows), np.flatnonzero(scored)
    flat = np.take(hidden, live, axis=0, out=room("flat", (len(live), WIDTH), kind), mode="clip")
    goal, total = wanted.ravel()[live], max(len(live), 1)
    chance, ratio, sums, found, at = _chances(p, flat, goal, room)
    loss = -float(found.sum(dtype=np.float64)) / total
    chance.ravel()[at] -= sums / ratio[goal]
    share = 1 / (sums * total)
    grads = {"bias": (share @ chance) * ratio}
    d_flat = room("d_flat", (len(live) + 1, WIDTH), kind)
    np.matmul(chance, p["top"].T * ratio[:, None], out=d_flat[:-1])
    d_flat[:-1] *= share[:, None]
    d_flat[-1] = 0  # of the places that are not scored
    flat *= share[:, None]
    grads["top"] = (chance.T @ flat).T * ratio
    source = np.full(len(hidden), len(live))
    source[live] = np.arange(len(live))
    d_hidden = np.take(d_flat, source, axis=0, out=room("d_hidden", hidden.shape, kind), mode="clip")
    grads["out"] = seen.T @ d_hidden
    d_seen = np.matmul(d_hidden, p["out"].T, out=room("d_seen", seen.shape, kind))
    d_seen /= mass
    q, k, v = _thirds(mixed)
    d_mixed = room("d_mixed", mixed.shape, kind)
    d_q, d_k, d_v = _thirds(d_mixed)
    by_window = d_seen.reshape(n, WINDOW, WIDTH)
    d_weights = np.matmul(by_window, v.transpose(0, 2, 1), out=room("d_weights", weights.shape, kind))
    d_weights -= np.einsum("ij,ij->i", d_seen, seen).reshape(n, WINDOW, 1)
    d_weights *= weights
    np.matmul(d_weights, k, out=d_q)
    np.matmul(d_weights.transpose(0, 2, 1), q, out=d_k)
    np.matmul(weights.transpose(0, 2, 1), by_window, out=d_v)
    grads["mix"] = _scaled((d_mixed.T @ x).T)
    d_x = np.matmul(d_mixed, _scaled(p["mix"]).T, out=room("d_x", x.shape, kind))
    d_x += d_hidden
    grads["place"] = d_x.reshape(n, -1).sum(axis=0).reshape(WINDOW, WIDTH)
    grads["embed"] = room("d_embed", p["embed"].shape, kind)
    grads["embed"][...] = 0
    cells = np.take(_CELLS, rows.ravel(), axis=0, out=room("cells", x.shape, _CELLS.dtype), mode="clip")
    np.add.at(grads["embed"].ravel(), cells.ravel(), d_x.ravel())
    return loss, grads


def train(p: Parameters, rows: np.ndarray, wanted: np.ndarray, scored: np.ndarray, rate: float, batch: int = TRAIN_BATCH) -> Parameters:
    """One pass of Adam over the windows in their order."""
    flat, room = flatten(p), Room()
    p, at = {}, 0
    for name, shape in SHAPES.items():
        p[name] = flat[at : at + math.prod(shape)].reshape(shape)  # a view: steps move the flat numbers
        at += p[name].size
    first, second, move, root, g = (np.zeros_like(flat) for _ in range(5))
    for step, at in enumerate(range(0, len(rows), batch), 1):
        part = slice(at, at + batch)
        _, grads = gradient(p, rows[part], wanted[part], scored[part], room)
        np.concatenate([grads[name].ravel() for name in SHAPES], out=g)
        first *= 0.9
        first += np.multiply(g, 0.1, out=move)
        second *= 0.99
        g *= g
        second += np.multiply(g, 0.01, out=move)
        np.sqrt(np.multiply(second, 1 / (1 - 0.99**step), out=root), out=root)
        root += 1e-8
        np.multiply(first, rate / (1 - 0.9**step), out=move)
        flat -= np.divide(move, root, out=move)
    return p


def windows(ids: np.ndarray, counts: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over the texts' ids: (position of each target or -1, inputs, owner).

    Inputs are the ids shifted by one behind a start id. The first window of a text scores
    all its places, a later one those after the context it shares with the one before, so
    every id is scored once.
    """
    number = 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE))
    number[counts == 0] = 0
    owner = np.repeat(np.arange(len(counts)), number)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    begins = np.cumsum(counts) - counts
    local = nth[:, None] * STRIDE + np.arange(WINDOW)
    inside = local < counts[owner][:, None]
    place = begins[owner][:, None] + local
    before = np.where(inside & (local > 0), place - 1, 0)
    inputs = np.where(inside & (local > 0), ids[before] if len(ids) else 0, start)
    fresh = (nth[:, None] == 0) | (np.arange(WINDOW) >= WINDOW - STRIDE)
    return np.where(inside & fresh, place, -1), inputs, owner


def log_probabilities(p: Parameters, vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray, start: int) -> np.ndarray:
    """Natural log probability of every text, given all its ids in order and their numbers.

    The windows are those of ``windows``. The first ones of texts come first, so that the
    others, which score no place of their context, share batches.
    """
    if not len(ids):
        return np.zeros(len(counts))
    room, ends = Room(), np.cumsum(counts)
    begins, last = ends - counts, len(ids) - 1
    before = np.empty(len(ids), np.int64)  # embedding row of the id before each id
    before[1:] = vocabulary.row[ids[:-1]]
    before[begins[counts > 0]] = vocabulary.row[start]
    group, found = vocabulary.group[ids], vocabulary.within[ids]
    more = np.maximum(0, -(-(counts - WINDOW) // STRIDE))
    first = np.flatnonzero(counts)
    nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    owner = np.concatenate([first, np.repeat(np.arange(len(counts)), more)])
    opens = np.concatenate([begins[first], begins[owner[len(first) :]] + nth * STRIDE])
    context = np.arange(WINDOW) >= WINDOW - STRIDE
    for low, high, fresh in ((0, len(first), context | True), (len(first), len(opens), context)):
        for at in range(low, high, BATCH):
            part = slice(at, min(at + BATCH, high))
            place = opens[part, None] + np.arange(WINDOW)
            scored = (place < ends[owner[part], None]) & fresh
            np.minimum(place, last, out=place)
            found[place[scored]] += class_scores(p, before[place], group[place], scored, room)
    return np.bincount(np.repeat(np.arange(len(counts)), counts), found, len(counts))
