"""A character tagger in numpy: bidirectional LSTM with CRF transitions."""

from __future__ import annotations

import numpy as np

#: Inputs: code points below 128 as they are, other letters and other characters.
CHARACTERS = 130
EMBED, HIDDEN = 12, 20


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, points, np.where(points < 0x2000, 128, 129)).astype(np.int64)


def _log_sum_exp(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(values - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """``weights`` maps names to arrays; all work is on batches of equally long windows.

    Windows are padded with character 0; ``mask`` marks real positions, which come first.
    """

    def __init__(self, tags: int, seed: int = 11):
        random = np.random.default_rng(seed)

        def uniform(*shape: int) -> np.ndarray:
            bound = np.sqrt(1.0 / shape[-1])
            return random.uniform(-bound, bound, shape)

        self.tags = tags
        self.weights = {"embed": random.normal(0, 0.3, (CHARACTERS, EMBED)), "out": uniform(tags, 2 * HIDDEN),
                        "out_bias": np.zeros(tags), "move": np.zeros((tags, tags)), "start": np.zeros(tags), "end": np.zeros(tags)}
        for way in ("ahead", "back"):
            self.weights[f"{way}_in"] = uniform(4 * HIDDEN, EMBED)
            self.weights[f"{way}_state"] = uniform(4 * HIDDEN, HIDDEN)
            self.weights[f"{way}_bias"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]

    # Gates lie in the order input, forget, output, candidate.
    def _lstm(self, way: str, inputs: np.ndarray, mask: np.ndarray, keep: bool):
        steps, rows = inputs.shape[:2]
        driven = inputs @ self.weights[f"{way}_in"].T + self.weights[f"{way}_bias"]
        state, cell = np.zeros((rows, HIDDEN)), np.zeros((rows, HIDDEN))
        outputs, trace = np.empty((steps, rows, HIDDEN)), []
        recurrent = self.weights[f"{way}_state"].T
        for t in (range(steps) if way == "ahead" else range(steps - 1, -1, -1)):
            raw = driven[t] + state @ recurrent
            gates = _sigmoid(raw[:, :3 * HIDDEN])
            candidate = np.tanh(raw[:, 3 * HIDDEN:])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            live = mask[t][:, None]
            fresh = live * (f * cell + i * candidate)
            squashed = np.tanh(fresh)
            if keep:
                trace.append((t, i, f, o, candidate, cell, squashed, state, live))
            cell, state = fresh, live * o * squashed
            outputs[t] = state
        return outputs, trace

    def _lstm_gradient(self, way: str, inputs: np.ndarray, trace: list, upstream: np.ndarray, gradient: dict) -> np.ndarray:
        recurrent = self.weights[f"{way}_state"]
        d_driven = np.zeros((*inputs.shape[:2], 4 * HIDDEN))
        d_state = np.zeros(upstream.shape[1:])
        d_cell = np.zeros_like(d_state)
        d_recurrent = np.zeros_like(recurrent)
        for t, i, f, o, candidate, before, squashed, state, live in reversed(trace):
            d_state = (d_state + upstream[t]) * live
            d_fresh = (d_state * o * (1 - squashed**2) + d_cell) * live
            raw = np.concatenate([d_fresh * candidate * i * (1 - i), d_fresh * before * f * (1 - f),
                                  d_state * squashed * o * (1 - o), d_fresh * i * (1 - candidate**2)], axis=1)
            d_driven[t] = raw
            d_recurrent += raw.T @ state
            d_state, d_cell = raw @ recurrent, d_fresh * f
        gradient[f"{way}_state"] = d_recurrent
        gradient[f"{way}_in"] = np.einsum("tbg,tbe->ge", d_driven, inputs)
        gradient[f"{way}_bias"] = d_driven.sum(axis=(0, 1))
        return d_driven @ self.weights[f"{way}_in"]

    def emissions(self, codes: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Tag scores, time first, from codes and mask with windows first."""
        inputs = self.weights["embed"][codes.T]
        ahead, trace_a = self._lstm("ahead", inputs, mask.T, keep)
        back, trace_b = self._lstm("back", inputs, mask.T, keep)
        joined = np.concatenate([ahead, back], axis=2)
        return joined @ self.weights["out"].T + self.weights["out_bias"], (inputs, joined, trace_a, trace_b)

    def _forward(self, scores: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log sums of all paths up to each step, and of whole paths."""
        alpha = np.empty_like(scores)
        alpha[0] = scores[0] + self.weights["start"]
        for t in range(1, len(scores)):
            step = _log_sum_exp(alpha[t - 1][:, :, None] + self.weights["move"], 1) + scores[t]
            alpha[t] = np.where(mask[t][:, None], step, alpha[t - 1])
        return alpha, _log_sum_exp(alpha[-1] + self.weights["end"], 1)

    def _backward(self, scores: np.ndarray, mask: np.ndarray) -> np.ndarray:
        beta = np.empty_like(scores)
        beta[-1] = self.weights["end"]
        for t in range(len(scores) - 2, -1, -1):
            step = _log_sum_exp((scores[t + 1] + beta[t + 1])[:, None, :] + self.weights["move"], 2)
            beta[t] = np.where(mask[t + 1][:, None], step, beta[t + 1])
        return beta

    def loss_and_gradient(self, codes: np.ndarray, mask: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag paths, and its gradient."""
        scores, (inputs, joined, trace_a, trace_b) = self.emissions(codes, mask, keep=True)
        live, path = mask.T, tags.T
        steps, rows = live.shape
        alpha, whole = self._forward(scores, live)
        beta = self._backward(scores, live)
        at = np.arange(rows)
        last = live.sum(axis=0) - 1
        gold = self.weights["start"][path[0]] + self.weights["end"][path[last, at]]
        gold = gold + (np.take_along_axis(scores, path[:, :, None], 2)[:, :, 0] * live).sum(axis=0)
        gold = gold + (self.weights["move"][path[:-1], path[1:]] * live[1:]).sum(axis=0)

        marginal = np.exp(alpha + beta - whole[:, None]) * live[:, :, None]
        d_scores = marginal.copy()
        np.add.at(d_scores, (np.arange(steps)[:, None], at[None, :], path), -live.astype(float))
        gradient = {name: np.zeros_like(value) for name, value in self.weights.items()}
        for t in range(1, steps):
            joint = np.exp(alpha[t - 1][:, :, None] + self.weights["move"] + (scores[t] + beta[t])[:, None, :] - whole[:, None, None])
            gradient["move"] += (joint * live[t][:, None, None]).sum(axis=0)
            np.add.at(gradient["move"], (path[t - 1], path[t]), -live[t].astype(float))
        gradient["start"] += marginal[0].sum(axis=0)
        np.add.at(gradient["start"], path[0], -1.0)
        gradient["end"] += marginal[last, at].sum(axis=0)
        np.add.at(gradient["end"], path[last, at], -1.0)

        gradient["out"] = np.einsum("tbk,tbh->kh", d_scores, joined)
        gradient["out_bias"] = d_scores.sum(axis=(0, 1))
        d_joined = d_scores @ self.weights["out"]
        d_inputs = self._lstm_gradient("ahead", inputs, trace_a, d_joined[:, :, :HIDDEN], gradient)
        d_inputs = d_inputs + self._lstm_gradient("back", inputs, trace_b, d_joined[:, :, HIDDEN:], gradient)
        np.add.at(gradient["embed"], codes.T, d_inputs)
        return float((whole - gold).mean()), {name: value / rows for name, value in gradient.items()}

    def decode(self, codes: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag path of each window, and the posterior of each of its tags."""
        scores, _ = self.emissions(codes, mask)
        live = mask.T
        alpha, whole = self._forward(scores, live)
        posterior = np.exp(alpha + self._backward(scores, live) - whole[:, None])
        steps, rows = live.shape
        best = scores[0] + self.weights["start"]
        came = np.empty((steps, rows, self.tags), np.int64)
        stay = np.arange(self.tags)
        for t in range(1, steps):
            options = best[:, :, None] + self.weights["move"]
            came[t] = np.where(live[t][:, None], options.argmax(axis=1), stay)
            best = np.where(live[t][:, None], options.max(axis=1) + scores[t], best)
        path = np.empty((steps, rows), np.int64)
        path[-1] = (best + self.weights["end"]).argmax(axis=1)
        at = np.arange(rows)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = came[t, at, path[t]]
        return path.T, np.take_along_axis(posterior, path[:, :, None], 2)[:, :, 0].T

    def train(self, codes: np.ndarray, mask: np.ndarray, tags: np.ndarray, steps: int, batch: int, rate: float, seed: int = 5) -> None:
        """So many steps of Adam, pass after pass over the windows, with a rate that falls to zero."""
        random = np.random.default_rng(seed)
        first = {n: np.zeros_like(w) for n, w in self.weights.items()}
        second = {n: np.zeros_like(w) for n, w in self.weights.items()}
        order = np.empty(0, np.int64)
        for step in range(1, steps + 1):
            if not len(order):
                order = random.permutation(len(codes))
            some, order = order[:batch], order[batch:]
            _, gradient = self.loss_and_gradient(codes[some], mask[some], tags[some])
            norm = np.sqrt(sum((g**2).sum() for g in gradient.values()))
            now = rate * (1 - (step - 1) / steps)
            for name, g in gradient.items():
                g = g * min(1.0, 5.0 / max(norm, 1e-12))
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g**2
                self.weights[name] -= now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
