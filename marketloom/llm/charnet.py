"""A character BiLSTM with a linear-chain CRF in numpy: training by gradient descent, batched decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Characters: ASCII as they are, then other letters, other digits, other white space, anything else, padding.
VOCABULARY = 133
PAD = 132


def _outer_class(c: str) -> int:
    return 128 if c.isalpha() else 129 if c.isdigit() else 130 if c.isspace() else 131


_classes: list[np.ndarray] = []


def encode(text: str) -> np.ndarray:
    if not _classes:
        _classes.append(np.array([p if p < 128 else 131 if 0xD800 <= p < 0xE000 else _outer_class(chr(p)) for p in range(0x10000)] + [131], np.uint8))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _classes[0][np.minimum(points, 0x10000)]


@dataclass
class Net:
    """Two directions of (input table, recurrent matrix), an output layer and tag transitions."""

    inputs: np.ndarray  # (2, VOCABULARY, 4 * hidden): gates i, f, o, g
    recurrent: np.ndarray  # (2, hidden, 4 * hidden)
    out: np.ndarray  # (2 * hidden, tags)
    bias: np.ndarray  # (tags,)
    moves: np.ndarray  # (tags, tags)
    start: np.ndarray  # (tags,)

    @classmethod
    def fresh(cls, hidden: int, tags: int, seed: int) -> Net:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        inputs = draw(2, VOCABULARY, 4 * hidden, scale=0.3)
        inputs[:, :, hidden : 2 * hidden] += 1.0
        zeros = np.zeros
        return cls(inputs, draw(2, hidden, 4 * hidden, scale=0.3), draw(2 * hidden, tags, scale=0.3), zeros(tags, np.float32), zeros((tags, tags), np.float32), zeros(tags, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.out, self.bias, self.moves, self.start]


def _gates(z: np.ndarray, hidden: int) -> np.ndarray:
    """Activations in place: the sigmoid of i, f, o by way of tanh, and tanh of g."""
    z[..., : 3 * hidden] *= 0.5
    np.tanh(z, out=z)
    z[..., : 3 * hidden] *= 0.5
    z[..., : 3 * hidden] += 0.5
    return z


def _run(net: Net, ids: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states of both directions (batch, time, 2 * hidden); with ``keep`` also what training needs."""
    batch, length = ids.shape
    hidden = net.recurrent.shape[1]
    states = np.empty((2, length, batch, hidden), np.float32)
    kept = []
    h = np.zeros((2, batch, hidden), np.float32)
    c = np.zeros((2, batch, hidden), np.float32)
    for t in range(length):
        z = h @ net.recurrent
        z[0] += net.inputs[0][ids[:, t]]
        z[1] += net.inputs[1][ids[:, length - 1 - t]]
        g = _gates(z, hidden)
        before = c
        c = g[..., hidden : 2 * hidden] * c + g[..., :hidden] * g[..., 3 * hidden :]
        squashed = np.tanh(c)
        h = g[..., 2 * hidden : 3 * hidden] * squashed
        states[:, t] = h
        if keep:
            kept.append((g, before, squashed))
    return np.concatenate([states[0], states[1, ::-1]], axis=2).transpose(1, 0, 2), kept


def scores(net: Net, ids: np.ndarray) -> np.ndarray:
    """Tag scores of every character of every window: (windows, length, tags)."""
    return np.concatenate([_run(net, ids[i : i + 512], False)[0] @ net.out + net.bias for i in range(0, len(ids), 512)])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def gradients(net: Net, ids: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log likelihood of the tag paths and its gradient for every part of the net."""
    batch, length = ids.shape
    hidden, kinds = net.recurrent.shape[1], net.out.shape[1]
    states, kept = _run(net, ids, True)
    emit = states @ net.out + net.bias
    ahead = np.empty((length, batch, kinds), np.float32)
    ahead[0] = net.start + emit[:, 0]
    for t in range(1, length):
        ahead[t] = _lse(ahead[t - 1][:, :, None] + net.moves, 1) + emit[:, t]
    behind = np.zeros((length, batch, kinds), np.float32)
    for t in range(length - 2, -1, -1):
        behind[t] = _lse(net.moves + (emit[:, t + 1] + behind[t + 1])[:, None, :], 2)
    whole = _lse(ahead[-1], 1)
    at = np.arange(batch)
    gold = net.start[tags[:, 0]] + np.take_along_axis(emit, tags[:, :, None], 2).sum(axis=(1, 2)) + net.moves[tags[:, :-1], tags[:, 1:]].sum(axis=1)
    d_emit = np.exp(ahead + behind - whole[None, :, None]).transpose(1, 0, 2)
    d_start = d_emit[:, 0].sum(axis=0)
    np.subtract.at(d_start, tags[:, 0], 1)
    d_moves = np.zeros_like(net.moves)
    for t in range(1, length):
        d_moves += np.exp(ahead[t - 1][:, :, None] + net.moves + (emit[:, t] + behind[t])[:, None, :] - whole[:, None, None]).sum(axis=0)
    np.subtract.at(d_moves, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    d_emit[at[:, None], np.arange(length)[None, :], tags] -= 1
    d_out = np.tensordot(states, d_emit, ((0, 1), (0, 1)))
    d_states = (d_emit @ net.out.T).transpose(1, 0, 2)
    d_states = np.stack([d_states[:, :, :hidden], d_states[::-1, :, hidden:]])
    d_z = np.empty((length, 2, batch, 4 * hidden), np.float32)
    d_h = np.zeros((2, batch, hidden), np.float32)
    d_c = np.zeros((2, batch, hidden), np.float32)
    past = states.transpose(1, 0, 2)
    past = np.stack([past[:, :, :hidden], past[::-1, :, hidden:]])
    for t in range(length - 1, -1, -1):
        g, before, squashed = kept[t]
        i, f, o, n = (g[..., k * hidden : (k + 1) * hidden] for k in range(4))
        d_h = d_h + d_states[:, t]
        d_c = d_c + d_h * o * (1 - squashed**2)
        z = d_z[t]
        z[..., :hidden] = d_c * n * i * (1 - i)
        z[..., hidden : 2 * hidden] = d_c * before * f * (1 - f)
        z[..., 2 * hidden : 3 * hidden] = d_h * squashed * o * (1 - o)
        z[..., 3 * hidden :] = d_c * i * (1 - n**2)
        d_c = d_c * f
        d_h = z @ net.recurrent.transpose(0, 2, 1)
    d_recurrent = np.stack([np.tensordot(past[k, :-1], d_z[1:, k], ((0, 1), (0, 1))) for k in range(2)])
    d_inputs = np.zeros_like(net.inputs)
    for k, order in enumerate((ids.T, ids[:, ::-1].T)):
        hot = np.zeros((order.size, VOCABULARY), np.float32)
        hot[np.arange(order.size), order.ravel()] = 1
        d_inputs[k] = hot.T @ d_z[:, k].reshape(-1, 4 * hidden)
    every = [d_inputs, d_recurrent, d_out, d_emit.sum(axis=(0, 1)), d_moves, d_start]
    return float((whole - gold).mean()), [d / batch for d in every]


def train(ids: np.ndarray, tags: np.ndarray, hidden: int, kinds: int, epochs: int, seed: int = 7, batch: int = 64, rate: float = 0.02) -> Net:
    """Adam over shuffled batches with a falling rate; the same input gives the same net."""
    net, rng = Net.fresh(hidden, kinds, seed), np.random.default_rng(seed)
    mean, square, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    for epoch in range(epochs):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            _, found = gradients(net, ids[some], tags[some])
            size = np.sqrt(sum(float((d**2).sum()) for d in found))
            step += 1
            now = rate * (1 - epoch / epochs) + 0.001
            for part, d, m, s in zip(net.parts(), found, mean, square, strict=True):
                d = d * min(1.0, 5.0 / (size + 1e-9))
                m += 0.1 * (d - m)
                s += 0.01 * (d * d - s)
                part -= (now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def viterbi(net: Net, emit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best tag path of each row of (rows, length, tags); entries past a row's length mean nothing."""
    rows, length, kinds = emit.shape
    back = np.zeros((length, rows, kinds), np.uint8)
    best = net.start + emit[:, 0]
    ends = np.where(lengths == 1, best.argmax(axis=1), 0)
    for t in range(1, length):
        reach = best[:, :, None] + net.moves
        back[t] = reach.argmax(axis=1)
        best = np.take_along_axis(reach, back[t][:, None, :].astype(np.int64), 1)[:, 0] + emit[:, t]
        last = lengths == t + 1
        if last.any():
            ends[last] = best[last].argmax(axis=1)
    path = np.zeros((rows, length), np.uint8)
    tag, at = ends, np.arange(rows)
    for t in range(length - 1, -1, -1):
        tag = np.where(t >= lengths - 1, ends, tag)
        path[:, t] = tag
        tag = back[t][at, tag].astype(np.int64)
    return path
