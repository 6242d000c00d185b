"""Bit predictors by hashed context, combined by gated weights in the logistic domain, on numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tablescout.llm.common import Rolling, mixed

RATE = 0.15
AT_ONCE = 16_384  # rows whose inputs stay in the cache
LIMIT = 11.0
STEPS = 33

# Bytes of a word: contexts of the last 1, 2, 3 and 4 bytes, of the last 3 with the class of the text, and of all before.
CONTEXTS = 6
SLOT_BITS = 18
GATES = 256 * 4
END_OF_WORD = 32


def stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.3) / (n0 + 0.3))


def squashed(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -LIMIT, LIMIT)))


def confidence(n: np.ndarray) -> np.ndarray:
    """Four steps of how often a context was met."""
    return np.searchsorted([1, 4, 32], n, "right")


class Mixer:
    """Weights per gate, learned online in small batches with steps that shrink by the gradients seen."""

    def __init__(self, gates: int, inputs: int):
        self.weights = np.full((gates, inputs), 1.2 / (inputs - 1))
        self.weights[:, -1] = 0
        self.squares = np.full((gates, inputs), 1e-3)

    def mix(self, inputs: np.ndarray, gate: np.ndarray) -> np.ndarray:
        weights = np.ascontiguousarray(self.weights.T)
        logit = weights[0].take(gate) * inputs[:, 0]
        for j in range(1, inputs.shape[1]):
            logit += weights[j].take(gate) * inputs[:, j]
        return np.clip(logit, -LIMIT, LIMIT)

    def learn(self, inputs: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> np.ndarray:
        gates, logit = len(self.weights), np.empty(len(gate))
        total, step = np.zeros(gates), np.zeros((inputs.shape[1], gates))
        for low in range(0, len(gate), AT_ONCE):
            part = slice(low, low + AT_ONCE)
            x, g, m = inputs[part], gate[part], weight[part]
            logit[part] = self.mix(x, g)
            error = (squashed(logit[part]) - bit[part]) * m
            total += np.bincount(g, m, gates)
            for j, sums in enumerate(step):
                sums += np.bincount(g, error * x[:, j], gates)
        step = (step / np.maximum(total, 1e-9)).T
        self.squares += step * step
        self.weights -= RATE * step / np.sqrt(self.squares)
        return logit


@dataclass(frozen=True)
class Refinement:
    """Adaptive map from a gate and a mixed probability to the share of ones met there."""

    ones: np.ndarray
    seen: np.ndarray

    @staticmethod
    def cell(logit: np.ndarray, gate: np.ndarray) -> np.ndarray:
        step = np.rint((logit + LIMIT) * ((STEPS - 1) / (2 * LIMIT))).astype(np.int64)
        return gate // 256 * STEPS + step

    def refined(self, logit: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Mean of the mixed probability and of the share, which falls back to the former where little was met."""
        cell, p = self.cell(logit, gate), squashed(logit)
        share = (self.ones[cell] + 20 * p) / (self.seen[cell] + 20)
        return np.clip((p + share) / 2, 1e-6, 1 - 1e-6)


def _previous(data: np.ndarray, first: np.ndarray, back: int) -> np.ndarray:
    out = np.zeros(len(data), np.uint64)
    out[back:] = data[:-back]
    since = np.arange(len(data)) - first
    out[since < back] = 0
    return out


class Spelling:
    """The bits of words spelled as bytes and an end byte, with the slots of their contexts."""

    def __init__(self, words: list[bytes], classes: np.ndarray, rolling: Rolling):
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        end = np.cumsum(sizes)
        self.word = np.repeat(np.arange(len(words)), sizes)
        data = np.frombuffer(b" ".join(words) + b" ", np.uint8)[: len(self.word)]
        self.data = data.astype(np.uint64)
        first = np.repeat(end - sizes, sizes)
        back = [_previous(self.data, first, k) for k in (1, 2, 3, 4)]
        past = [back[0] + np.uint64(1)]
        for b in back[1:]:
            past.append(past[-1] * np.uint64(256) + b + np.uint64(1))
        past.append(past[2] * np.uint64(64) + classes[self.word].astype(np.uint64))
        past.append(rolling.of(rolling.prefix(data), first, np.arange(len(data))))
        self.base = [mixed(p * np.uint64(8) + np.uint64(i)) for i, p in enumerate(past)]

    def bits(self):
        """For each of the eight bits: the bit, its slots in the context tables, and the part of the gate it gives."""
        for k in range(7, -1, -1):
            head = (self.data | np.uint64(256)) >> np.uint64(k + 1)
            bit = ((self.data >> np.uint64(k)) & np.uint64(1)).astype(np.int64)
            spread = head * np.uint64(0x9E3779B97F4A7C15)
            slots = [(mixed(b + spread) >> np.uint64(64 - SLOT_BITS)).view(np.int64) for b in self.base]
            yield bit, slots, head.view(np.int64)


def _predictions(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return stretched(n0, n1).astype(np.float32)


def predictions(tables: np.ndarray, without_one: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """Stretched prediction of every slot of each context, and how well the slots of the last four bytes are known.

    ``without_one`` gives them by slot and bit, for a present occurrence of the bit that is left out of the counts, as it would be
    for a new text.
    """
    found, known = [], None
    for j, (n0, n1) in enumerate((t[:, 0], t[:, 1]) for t in tables):
        if without_one:
            less0, less1 = np.maximum(n0 - 1, 0), np.maximum(n1 - 1, 0)
            found.append(np.stack([_predictions(less0, n1), _predictions(n0, less1)], 1).ravel())
            known = np.stack([less0 + n1, n0 + less1], 1).ravel() if j == 3 else known
        else:
            found.append(_predictions(n0, n1))
            known = n0 + n1 if j == 3 else known
    return found, confidence(known).astype(np.uint8)


def inputs_of(slots: list[np.ndarray], found: tuple[list[np.ndarray], np.ndarray], bit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Predictions of the contexts with a constant, and a gate from how well the last four bytes are known; with ``bit`` from those without one."""
    at = slots if bit is None else [2 * slot + bit for slot in slots]
    columns = [x.take(spot) for x, spot in zip(found[0], at)]
    return np.stack([*columns, np.full(len(slots[0]), 0.3)]).T, found[1].take(at[3]).astype(np.int64)
