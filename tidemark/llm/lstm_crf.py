"""A character-level bidirectional LSTM with a linear-chain CRF on top, trained and applied in numpy.

All windows of a batch advance together, one character a step, so a step is one small matrix product over the batch. Arrays are laid out (units, batch).
Input weights are a table with one column per character class (embedding and bias included). Gates are input, forget, output, cell.
Squashing is x / (1 + |x|), and half of it plus a half for gates: numpy computes it four times faster than tanh, which would take most of the time.
"""

from __future__ import annotations

import numpy as np

FORBIDDEN = -1e4


def squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _sides(cls: np.ndarray, side: str) -> np.ndarray:
    return cls if side == "f" else cls[::-1]


class Tagger:
    """`classes` character classes, `hidden` units a direction, `tags` tags with tag 0 outside; `allowed[a, b]`: b may follow a."""

    def __init__(self, classes: int, hidden: int, allowed: np.ndarray, starts: np.ndarray, seed: int = 7):
        rng, tags = np.random.default_rng(seed), len(allowed)
        self.hidden, self.barred, self.barred_start = hidden, ~allowed, ~starts
        p = {}
        for s in "fb":
            p["table" + s] = rng.normal(0, 0.3, (4 * hidden, classes))
            p["table" + s][hidden:2 * hidden] += 1.0
            p["loop" + s] = rng.normal(0, 1 / np.sqrt(hidden), (4 * hidden, hidden))
            p["out" + s] = rng.normal(0, 1 / np.sqrt(hidden), (tags, hidden))
        p["bias"], p["trans"], p["start"], p["end"] = np.zeros((tags, 1)), np.zeros((tags, tags)), np.zeros(tags), np.zeros(tags)
        p["bias"][0] = 2.0
        self.params = {k: v.astype(np.float32) for k, v in p.items()}

    def transitions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = self.params
        return (np.where(self.barred, FORBIDDEN, p["trans"]).astype(np.float32), np.where(self.barred_start, FORBIDDEN, p["start"]).astype(np.float32), p["end"])

    # application

    def emissions(self, cls: np.ndarray) -> np.ndarray:
        """(steps, tags, batch) from character classes (steps, batch)."""
        steps, batch = cls.shape
        h3 = 3 * self.hidden
        out = np.empty((steps, len(self.params["bias"]), batch), np.float32)
        z, add = (np.empty((4 * self.hidden, batch), np.float32) for _ in range(2))
        size = add[:self.hidden]
        for side in "fb":
            table, loop, project = (self.params[k + side] for k in ("table", "loop", "out"))
            h, c = np.zeros((self.hidden, batch), np.float32), np.zeros((self.hidden, batch), np.float32)
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                np.take(table, cls[t], axis=1, out=z, mode="clip")
                np.matmul(loop, h, out=add)
                z += add
                np.abs(z, out=add)
                add += 1
                z /= add
                gates = z[:h3]
                gates *= 0.5
                gates += 0.5
                i, f, o = gates.reshape(3, self.hidden, batch)
                c *= f
                i *= z[h3:]
                c += i
                np.abs(c, out=size)
                size += 1
                np.divide(c, size, out=h)
                h *= o
                if side == "f":
                    np.matmul(project, h, out=out[t])
                    out[t] += self.params["bias"]
                else:
                    out[t] += project @ h
        return out

    def surely_outside(self, emit: np.ndarray) -> np.ndarray:
        """Windows whose best path is proven to be outside throughout.

        All tags are merged into one state that enters, stays and leaves at the best price of any of them, relative to staying outside.
        If even this state never gains, no tagged stretch does."""
        trans, start, end = self.transitions()
        base, outer = trans[0, 0], emit[:, 0]
        opens = [k for k in range(1, len(trans)) if not self.barred[0, k]]
        enter, stay = emit[:, opens].max(axis=1) - outer, emit[:, 1:].max(axis=1) - outer
        enter += (trans[0, opens] - base).max()
        stay[0] += (start[1:] - start[0]).max()
        stay[1:] += (trans[1:, 1:] - base).max()
        leave, final = (trans[1:, 0] - base).max(), (end[1:] - end[0]).max()
        inside = stay[0]
        gains = inside + leave > 0
        for t in range(1, len(emit)):
            inside = np.maximum(enter[t], inside + stay[t])
            gains |= inside + (leave if t + 1 < len(emit) else final) > 0
        return ~gains

    def decode(self, emit: np.ndarray) -> np.ndarray:
        """Best tags (steps, batch) by Viterbi."""
        trans, start, end = self.transitions()
        steps, _, batch = emit.shape
        score, back = start[:, None] + emit[0], np.empty((steps, *emit.shape[1:]), np.int8)
        for t in range(1, steps):
            every = score[:, None, :] + trans[:, :, None]
            back[t] = every.argmax(axis=0)
            score = every.max(axis=0) + emit[t]
        tags = np.empty((steps, batch), np.int8)
        tags[-1] = (score + end[:, None]).argmax(axis=0)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t][tags[t], np.arange(batch)]
        return tags

    # training

    def _forward(self, cls: np.ndarray, side: str) -> dict[str, np.ndarray]:
        table, loop, n = self.params["table" + side], self.params["loop" + side], self.hidden
        steps, batch = cls.shape
        gates, cells, states = (np.empty((steps, k, batch), np.float32) for k in (4 * n, n, n))
        h = c = np.zeros((n, batch), np.float32)
        for t in range(steps):
            z = table[:, cls[t]] + loop @ h
            z = squash(z)
            z[:3 * n] = 0.5 + 0.5 * z[:3 * n]
            c = z[n:2 * n] * c + z[:n] * z[3 * n:]
            h = z[2 * n:3 * n] * squash(c)
            gates[t], cells[t], states[t] = z, c, h
        return {"gates": gates, "cells": cells, "states": states}

    def _backward(self, cls: np.ndarray, side: str, seen: dict[str, np.ndarray], grad_states: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        loop, n = self.params["loop" + side], self.hidden
        steps, batch = cls.shape
        gates, cells, states = seen["gates"], seen["cells"], seen["states"]
        dh, dc, dz = np.zeros((n, batch), np.float32), np.zeros((n, batch), np.float32), np.empty((steps, 4 * n, batch), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, o, g = gates[t].reshape(4, n, batch)
            dh = dh + grad_states[t]
            shown = squash(cells[t])
            dc = dc + dh * o * (1 - np.abs(shown)) ** 2
            before = cells[t - 1] if t else 0.0
            d = dz[t]
            d[:3 * n] = 0.5 * (1 - np.abs(2 * gates[t][:3 * n] - 1)) ** 2
            d[:n] *= dc * g
            d[n:2 * n] *= dc * before
            d[2 * n:3 * n] *= dh * shown
            d[3 * n:] = dc * i * (1 - np.abs(g)) ** 2
            dc = dc * f
            dh = loop.T @ d
        grads["loop" + side] = np.einsum("tzb,thb->zh", dz[1:], states[:-1], optimize=True)
        flat = np.zeros((self.params["table" + side].shape[1], 4 * n), np.float32)
        np.add.at(flat, cls.ravel(), dz.transpose(0, 2, 1).reshape(-1, 4 * n))
        grads["table" + side] = flat.T

    def gradients(self, cls: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags (steps, batch) and its gradients."""
        p, (steps, batch) = self.params, cls.shape
        seen = {s: self._forward(_sides(cls, s), s) for s in "fb"}
        states = {"f": seen["f"]["states"], "b": seen["b"]["states"][::-1]}
        emit = sum(np.einsum("kh,thb->tkb", p["out" + s], states[s], optimize=True) for s in "fb") + p["bias"]
        trans, start, end = self.transitions()

        def total(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis=axis, keepdims=True)
            return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

        ahead = np.empty_like(emit)
        ahead[0] = start[:, None] + emit[0]
        for t in range(1, steps):
            ahead[t] = total(ahead[t - 1][:, None, :] + trans[:, :, None], 0) + emit[t]
        behind = np.empty_like(emit)
        behind[-1] = end[:, None]
        for t in range(steps - 2, -1, -1):
            behind[t] = total(trans[:, :, None] + (emit[t + 1] + behind[t + 1])[None], 1)
        norm = total(ahead[-1] + end[:, None], 0)
        share = np.exp(ahead + behind - norm)
        pairs = np.zeros_like(trans)
        for t in range(1, steps):
            pairs += np.exp(ahead[t - 1][:, None, :] + trans[:, :, None] + (emit[t] + behind[t])[None] - norm).sum(axis=2)
        b, n_tags = np.arange(batch), len(trans)
        gold = start[tags[0]] + end[tags[-1]] + np.take_along_axis(emit, tags[:, None, :].astype(np.int64), 1)[:, 0].sum(axis=0) + trans[tags[:-1], tags[1:]].sum(axis=0)
        d = share
        d[np.arange(steps)[:, None], tags, b[None]] -= 1
        d /= batch
        np.add.at(pairs, (tags[:-1].ravel(), tags[1:].ravel()), -1)
        grads = {"bias": d.sum(axis=(0, 2))[:, None], "trans": np.where(self.barred, 0, pairs / batch)}
        first, final = np.exp(ahead[0] + behind[0] - norm), np.exp(ahead[-1] + end[:, None] - norm)
        grads["start"] = np.where(self.barred_start, 0, first.mean(axis=1) - np.bincount(tags[0], minlength=n_tags) / batch)
        grads["end"] = final.mean(axis=1) - np.bincount(tags[-1], minlength=n_tags) / batch
        for s in "fb":
            grads["out" + s] = np.einsum("tkb,thb->kh", d, states[s], optimize=True)
            back = np.einsum("kh,tkb->thb", p["out" + s], d, optimize=True)
            self._backward(_sides(cls, s), s, seen[s], back if s == "f" else back[::-1], grads)
        return float((norm - gold).mean()), grads

    def train(self, cls: np.ndarray, tags: np.ndarray, epochs: int, batch: int, rate: float, seed: int = 11) -> list[float]:
        """Adam over shuffled batches with a falling rate; (steps, windows) classes and tags. Returns the mean loss of each epoch."""
        rng, losses, step = np.random.default_rng(seed), [], 0
        first, second = ({k: np.zeros_like(v) for k, v in self.params.items()} for _ in range(2))
        rounds = epochs * -(-cls.shape[1] // batch)
        for _ in range(epochs):
            order, seen = rng.permutation(cls.shape[1]), []
            for at in range(0, len(order), batch):
                some = order[at:at + batch]
                loss, grads = self.gradients(cls[:, some], tags[:, some])
                seen.append(loss)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                step += 1
                now = rate * (1 - 0.9 * step / rounds)
                for k, g in grads.items():
                    g = g.astype(np.float32) * min(1.0, 5.0 / (norm + 1e-9))
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.params[k] -= (now * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses
