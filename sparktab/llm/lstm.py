"""A bidirectional LSTM that labels sequences, in numpy: training with Adam, batched scoring."""

from __future__ import annotations

import numpy as np

HIDDEN = 16
Parameters = dict[str, np.ndarray]


def first_parameters(inputs: int, seed: int = 3) -> Parameters:
    rng = np.random.default_rng(seed)
    parameters: Parameters = {}
    for way in "fb":
        parameters[f"in_{way}"] = rng.standard_normal((inputs, 4 * HIDDEN)) * (0.5 / np.sqrt(inputs) + 0.02)
        parameters[f"back_{way}"] = rng.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2
        bias = np.zeros(4 * HIDDEN)
        bias[HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
        parameters[f"bias_{way}"] = bias
    parameters["top"] = rng.standard_normal(2 * HIDDEN) * 0.2
    parameters["top_bias"] = np.zeros(1)
    return {name: value.astype(np.float32) for name, value in parameters.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _run(gates_in: np.ndarray, back: np.ndarray, live: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (T, n, HIDDEN) of one direction; the state stands still where ``live`` is 0."""
    steps, n = gates_in.shape[:2]
    h = c = np.zeros((n, HIDDEN), np.float32)
    states, trace = np.zeros((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        z = gates_in[t] + h @ back
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        on = live[t][:, None]
        c_new = f * c + i * g
        squashed = np.tanh(c_new)
        if keep:
            trace.append((i, f, o, g, c, h, squashed))
        c = on * c_new + (1 - on) * c
        h = on * (o * squashed) + (1 - on) * h
        states[t] = h
    return states, trace


def logits(p: Parameters, x: np.ndarray, live: np.ndarray) -> np.ndarray:
    """(T, n) scores of padded sequences x (T, n, inputs); ``live`` is 1 inside a sequence."""
    forward, _ = _run(x @ p["in_f"] + p["bias_f"], p["back_f"], live, False)
    backward, _ = _run((x @ p["in_b"] + p["bias_b"])[::-1], p["back_b"], live[::-1], False)
    return forward @ p["top"][:HIDDEN] + backward[::-1] @ p["top"][HIDDEN:] + p["top_bias"]


def _backward(p: Parameters, way: str, x: np.ndarray, live: np.ndarray, trace: list, d_states: np.ndarray) -> Parameters:
    """Gradient of one direction's parameters; all arrays in that direction's order."""
    back = p[f"back_{way}"]
    d_gates = np.zeros((*live.shape, 4 * HIDDEN), np.float32)
    d_back = np.zeros_like(back)
    d_h = d_c = np.zeros((live.shape[1], HIDDEN), np.float32)
    for t in range(len(live) - 1, -1, -1):
        i, f, o, g, c_old, h_old, squashed = trace[t]
        on = live[t][:, None]
        d_h = d_h + d_states[t]
        d_out, d_cell = d_h * on, d_c * on
        d_cell = d_cell + d_out * o * (1 - squashed**2)
        d_z = np.concatenate(
            [d_cell * g * i * (1 - i), d_cell * c_old * f * (1 - f), d_out * squashed * o * (1 - o), d_cell * i * (1 - g**2)],
            axis=1,
        )
        d_gates[t] = d_z
        d_back += h_old.T @ d_z
        d_h = d_h * (1 - on) + d_z @ back.T
        d_c = d_c * (1 - on) + d_cell * f
    flat = d_gates.reshape(-1, 4 * HIDDEN)
    return {f"in_{way}": x.reshape(len(flat), -1).T @ flat, f"back_{way}": d_back, f"bias_{way}": flat.sum(axis=0)}


def gradient(p: Parameters, x: np.ndarray, live: np.ndarray, wanted: np.ndarray, weight: np.ndarray) -> tuple[float, Parameters]:
    """Mean log loss over the weighted places, and its gradient."""
    forward, trace_f = _run(x @ p["in_f"] + p["bias_f"], p["back_f"], live, True)
    backward, trace_b = _run((x @ p["in_b"] + p["bias_b"])[::-1], p["back_b"], live[::-1], True)
    both = np.concatenate([forward, backward[::-1]], axis=2)
    chance = _sigmoid(both @ p["top"] + p["top_bias"])
    total = max(float(weight.sum()), 1.0)
    sure = np.where(wanted > 0, chance, 1 - chance)
    loss = float(-(np.log(sure + 1e-9) * weight).sum() / total)
    d_logit = (chance - wanted) * weight / total
    grads: Parameters = {"top": np.einsum("tn,tnh->h", d_logit, both), "top_bias": np.array([d_logit.sum()])}
    d_both = d_logit[:, :, None] * p["top"]
    grads |= _backward(p, "f", x, live, trace_f, d_both[:, :, :HIDDEN])
    grads |= _backward(p, "b", x[::-1], live[::-1], trace_b, d_both[::-1, :, HIDDEN:])
    return loss, grads


def pad(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(T, n, ...) padded with zeros, and (T, n) with 1 inside a sequence."""
    steps = max(len(s) for s in sequences)
    out = np.zeros((steps, len(sequences), *sequences[0].shape[1:]), np.float32)
    live = np.zeros((steps, len(sequences)), np.float32)
    for n, sequence in enumerate(sequences):
        out[: len(sequence), n] = sequence
        live[: len(sequence), n] = 1
    return out, live


def train(
    p: Parameters, sequences: list[np.ndarray], labels: list[np.ndarray], epochs: int, rate: float, batch: int = 32, seed: int = 5
) -> Parameters:
    """Adam over shuffled batches of sequences of similar length; a label of -1 has no say."""
    rng = np.random.default_rng(seed)
    p = {name: value.copy() for name, value in p.items()}
    first = {name: np.zeros_like(value) for name, value in p.items()}
    second = {name: np.zeros_like(value) for name, value in p.items()}
    by_length = np.argsort([len(s) for s in sequences], kind="stable")
    starts, step = np.arange(0, len(sequences), batch), 0
    for _ in range(epochs):
        for at in rng.permutation(starts):
            chosen = by_length[at : at + batch]
            x, live = pad([sequences[i] for i in chosen])
            wanted, _ = pad([labels[i].astype(np.float32) for i in chosen])
            weight = live * (wanted >= 0)
            _, grads = gradient(p, x, live, np.maximum(wanted, 0), weight)
            step += 1
            for name, g in grads.items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                p[name] -= rate * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    return {name: value.astype(np.float32) for name, value in p.items()}


def label(p: Parameters, sequences: list[np.ndarray], cells: int = 40_000) -> list[np.ndarray]:
    """Scores of every place of every sequence, in batches of similar length and bounded size."""
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(sequences)
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and (end + 1 - begin) * len(sequences[order[end]]) <= cells:
            end += 1
        chosen = [i for i in order[begin:end] if len(sequences[i])]
        if chosen:
            x, live = pad([sequences[i] for i in chosen])
            found = logits(p, x, live)
            for n, i in enumerate(chosen):
                out[i] = found[: len(sequences[i]), n]
        begin = end
    return out
