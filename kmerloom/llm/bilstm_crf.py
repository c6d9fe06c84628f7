"""A character-level bidirectional LSTM with CRF transitions, in numpy: training by backpropagation, Viterbi and marginals.

Gates are piecewise linear and states x / (1 + |x|), in training as in use: exponentials were most of a step's cost.
"""

from __future__ import annotations

import numpy as np

BLOCKED = -1e4


def gate(x: np.ndarray) -> np.ndarray:
    return np.clip(x * 0.25 + 0.5, 0, 1)


def bounded(x: np.ndarray) -> np.ndarray:
    """Between -1 and 1; its slope is (1 - |bounded(x)|) squared."""
    return x / (1 + np.abs(x))


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def logproduct(x: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """log(exp(x) @ ways), row by row without overflow."""
    top = x.max(1, keepdims=True)
    return top + np.log(np.maximum(np.exp(x - top) @ ways, 1e-300))


class Tagger:
    """Tags sequences of character ids. `allowed[i, j]` says whether tag j may follow tag i, `first[j]` whether it may come first."""

    def __init__(self, n_chars: int, n_tags: int, allowed: np.ndarray, first: np.ndarray, embed: int = 12, hidden: int = 20, seed: int = 3):
        rng = np.random.default_rng(seed)
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.hidden, self.allowed, self.first = hidden, allowed, first
        self.p = {"emb": g(n_chars, embed) * 4, "out": g(2 * hidden, n_tags), "bias": np.zeros(n_tags, np.float32), "trans": np.zeros((n_tags, n_tags), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": g(embed, 4 * hidden), f"h{d}": g(hidden, 4 * hidden), f"c{d}": np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)}

    # The network: gates in the order input, forget, output, candidate; masked steps keep a zero state.

    def _run(self, d: str, e: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        n, t, _ = e.shape
        k, wh = self.hidden, self.p[f"h{d}"]
        x = e @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out, tape = np.zeros((n, t, k), np.float32), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = x[:, i] + h @ wh
            s, g = gate(z[:, : 3 * k]), bounded(z[:, 3 * k :])
            m = mask[:, i, None]
            new = (s[:, k : 2 * k] * c + s[:, :k] * g) * m
            th = bounded(new)
            if keep:
                tape.append((i, h, c, s, g, th, m))
            c, h = new, s[:, 2 * k :] * th * m
            out[:, i] = h
        return out, tape

    def _back(self, d: str, e: np.ndarray, dout: np.ndarray, tape: list, grads: dict) -> np.ndarray:
        n, t, _ = e.shape
        k, wh = self.hidden, self.p[f"h{d}"]
        dx = np.zeros((n, t, 4 * k), np.float32)
        dh, dc = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        for i, h, c, s, g, th, m in reversed(tape):
            dh = (dh + dout[:, i]) * m
            o = s[:, 2 * k :]
            dc = (dc + dh * o * (1 - np.abs(th)) ** 2) * m
            dz = np.concatenate([dc * g, dc * c, dh * th], 1) * (0.25 * ((s > 0) & (s < 1)))
            dz = np.concatenate([dz, dc * s[:, :k] * (1 - np.abs(g)) ** 2], 1)
            dx[:, i] = dz
            grads[f"h{d}"] += h.T @ dz
            dh, dc = dz @ wh.T, dc * s[:, k : 2 * k]
        flat = dx.reshape(-1, 4 * k)
        grads[f"x{d}"] += e.reshape(-1, e.shape[2]).T @ flat
        grads[f"c{d}"] += flat.sum(0)
        return dx @ self.p[f"x{d}"].T

    def scores(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Emission scores (sequence, position, tag); masked positions come last and have none that mean anything.

        The same network as in training, for speed with sequences along the last axis, so that each gate is one stretch of memory,
        with one product a step, and with sequences reversed by themselves so that neither direction meets masked steps first.
        """
        n, t = ids.shape
        k, last = self.hidden, mask.sum(1).astype(np.int64) - 1
        full = bool((last == t - 1).all())
        back = np.maximum(last[:, None] - np.arange(t), 0)
        emb, size = self.p["emb"], self.p["emb"].shape[1]
        emit = np.empty((t, len(self.p["bias"]), n), np.float32)
        z, c, above = np.empty((4 * k, n), np.float32), np.empty((k, n), np.float32), np.empty((k, n), np.float32)
        gates, enter, forget, leave, new = z[: 3 * k], z[:k], z[k : 2 * k], z[2 * k : 3 * k], z[3 * k :]
        chars, more = np.empty((n, size), np.float32), np.empty(emit.shape[1:], np.float32)
        for d in "bf":
            w = np.concatenate([self.p[f"x{d}"], self.p[f"h{d}"], self.p[f"c{d}"][None]]).T.astype(np.float32)
            w[: 3 * k] *= 0.25
            w[: 3 * k, -1] += 0.5
            steps = np.ascontiguousarray((ids if d == "f" else ids[:, ::-1] if full else np.take_along_axis(ids, back, 1)).T)
            out = np.ascontiguousarray((self.p["out"][:k] if d == "f" else self.p["out"][k:]).T)
            given = np.ones((size + k + 1, n), np.float32)  # a step's characters, the state before it, and 1
            h = given[size:-1]
            h[:], c[:] = 0, 0
            for i in range(t):
                given[:size] = np.take(emb, steps[i], axis=0, out=chars, mode="clip").T
                np.matmul(w, given, out=z)
                np.clip(gates, 0, 1, out=gates)
                np.abs(new, out=above)
                above += 1
                new /= above
                c *= forget
                new *= enter
                c += new
                np.abs(c, out=above)
                above += 1
                np.divide(c, above, out=h)
                h *= leave
                if d == "f":
                    emit[i] += np.matmul(out, h, out=more)
                else:
                    np.matmul(out, h, out=emit[i])
            if d == "b":
                emit = emit[::-1] if full else np.take_along_axis(emit, back.T[:, None, :], 0)
                emit += self.p["bias"][:, None]
        return emit.transpose(2, 0, 1)

    def quiet(self, emit: np.ndarray) -> np.ndarray:
        """Which sequences surely have tag 0 throughout as their best tags, for tags in pairs (begin, inside) after tag 0, an inside one only after its own pair.

        The greatest gain over tag 0 of a run of other tags that ends in a pair is followed over the positions, with the
        best transition of all wherever a pair follows another one; no run gains if it is never more than the end takes. Masked
        positions count like others.
        """
        trans, first = (x.astype(np.float32) for x in self.transitions())
        enter = np.maximum(trans[0, 1::2] - trans[0, 0], first[1::2] - first[0])
        switch = trans[1:, 1::2].max(0) - trans[0, 0]
        stay = np.array([max(trans[i, i + 1], trans[i + 1, i + 1]) for i in range(1, len(trans), 2)], np.float32) - trans[0, 0]
        leave = np.maximum(np.array([max(trans[i, 0], trans[i + 1, 0]) for i in range(1, len(trans), 2)], np.float32) - trans[0, 0], 0)
        enter, switch, stay, leave = (x[:, None] for x in (enter, switch, stay, leave))
        run = np.full((len(enter), len(emit)), -1e9, np.float32)
        most = run.copy()
        for e in emit.transpose(1, 2, 0):
            fresh = np.maximum(run.max(0) + switch, enter)
            fresh += e[1::2]
            run += stay
            run += e[2::2]
            np.maximum(run, fresh, out=run)
            run -= e[0]
            np.maximum(most, run, out=most)
        return ((most + leave) < -1e-3).all(0)

    def transitions(self) -> tuple[np.ndarray, np.ndarray]:
        return np.where(self.allowed, self.p["trans"], BLOCKED), np.where(self.first, 0, BLOCKED).astype(np.float32)

    # The CRF.

    def forward_backward(self, emit: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(alpha, beta, log partition, transitions) in log space; masked positions at the end copy on."""
        trans, first = self.transitions()
        n, t, k = emit.shape
        alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
        ways = np.exp(trans)
        alpha[:, 0] = emit[:, 0] + first
        for i in range(1, t):
            new = logproduct(alpha[:, i - 1], ways) + emit[:, i]
            alpha[:, i] = np.where(mask[:, i, None] > 0, new, alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            new = logproduct(emit[:, i + 1] + beta[:, i + 1], ways.T)
            beta[:, i] = np.where(mask[:, i + 1, None] > 0, new, beta[:, i + 1])
        return alpha, beta, logsumexp(alpha[:, -1], 1), trans

    def marginals(self, emit: np.ndarray, mask: np.ndarray) -> np.ndarray:
        alpha, beta, total, _ = self.forward_backward(emit, mask)
        return np.exp(alpha + beta - total[:, None, None])

    def viterbi(self, emit: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The best allowed tags (sequence, position); 0 where masked."""
        trans, first = self.transitions()
        n, t, k = emit.shape
        best, back = emit[:, 0] + first, np.zeros((n, t, k), np.int16)
        for i in range(1, t):
            way = best[:, :, None] + trans
            step = way.argmax(1)
            live = mask[:, i, None] > 0
            back[:, i] = np.where(live, step, np.arange(k))
            best = np.where(live, np.take_along_axis(way, step[:, None], 1)[:, 0] + emit[:, i], best)
        tags = np.zeros((n, t), np.int64)
        at = best.argmax(1)
        for i in range(t - 1, -1, -1):
            tags[:, i] = np.where(mask[:, i] > 0, at, 0)
            at = back[np.arange(n), i, at]
        return tags

    def loss(self, ids: np.ndarray, mask: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood per sequence, and its gradients."""
        n, t = ids.shape
        e = self.p["emb"][ids]
        (hf, tf), (hb, tb) = self._run("f", e, mask, True), self._run("b", e, mask, True)
        h = np.concatenate([hf, hb], 2)
        emit = (h @ self.p["out"] + self.p["bias"]).astype(np.float64)
        alpha, beta, total, trans = self.forward_backward(emit, mask)
        k = emit.shape[2]
        hot = np.eye(k)[tags] * mask[:, :, None]
        demit = (np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None] - hot) / n
        before, after, live = alpha[:, :-1], emit[:, 1:] + beta[:, 1:], mask[:, 1:]
        a, b = before.max(2), after.max(2)
        weight = np.exp(np.minimum(a + b - total[:, None], 700)) * live
        near, far = (np.exp(before - a[:, :, None]) * weight[:, :, None]).reshape(-1, k), np.exp(after - b[:, :, None]).reshape(-1, k)
        seen = (hot[:, :-1] * live[:, :, None]).reshape(-1, k).T @ hot[:, 1:].reshape(-1, k)
        dtrans = (near.T @ far * np.exp(trans) - seen) / n * self.allowed
        score = (emit * hot).sum((1, 2)) + (trans[tags[:, :-1], tags[:, 1:]] * live).sum(1)
        grads = {name: np.zeros_like(x) for name, x in self.p.items()}
        demit = demit.astype(np.float32)
        flat = demit.reshape(-1, k)
        grads["out"] += h.reshape(-1, h.shape[2]).T @ flat
        grads["bias"] += flat.sum(0)
        grads["trans"] += dtrans.astype(np.float32)
        dh = demit @ self.p["out"].T
        de = self._back("f", e, dh[:, :, : self.hidden], tf, grads) + self._back("b", e, dh[:, :, self.hidden :], tb, grads)
        np.add.at(grads["emb"], ids.ravel(), de.reshape(-1, de.shape[2]))
        return float((total - score).mean()), grads

    def train(self, ids: np.ndarray, mask: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 5) -> list[float]:
        """Adam with clipped gradients; the mean loss of each epoch. A batch has sequences of about one length."""
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in self.p.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            order, found = rng.permutation(len(ids)), []
            order = np.concatenate([x[np.argsort(mask[x].sum(1), kind="stable")] for x in np.array_split(order, max(1, len(order) // (16 * batch)))])
            for s in rng.permutation(np.arange(0, len(order), batch)).tolist():
                own = order[s : s + batch]
                longest = int(mask[own].sum(1).max())
                value, grads = self.loss(ids[own, :longest], mask[own, :longest], tags[own, :longest])
                found.append(value)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                step += 1
                now = rate * (1 - epoch / epochs) + rate / 20
                for name, g in grads.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[name] -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(found)))
        return losses
