"""A character-level bidirectional LSTM with CRF transitions in numpy: training, decoding, window reconciliation."""

from __future__ import annotations

import numpy as np

#: Kinds of the base patterns, then kinds that only the tagger knows.
KINDS = ("email", "ip", "card", "phone", "secret")
#: O, then B and I of each kind.
N_TAGS = 1 + 2 * len(KINDS)
WINDOW, STRIDE = 64, 32
_CHARS = "@.-+() _%:/=\"'[]{},;#\n"
N_CODES = 2 + 26 + 1 + len(_CHARS) + 1


def _code_table() -> np.ndarray:
    """Codes: 0 other ASCII, 1 padding, 2-27 letters, 28 digits, then single characters, last non-ASCII."""
    table = np.zeros(128, np.int64)
    for i in range(26):
        table[97 + i] = table[65 + i] = 2 + i
    table[48:58] = 28
    for i, c in enumerate(_CHARS):
        table[ord(c)] = 29 + i
    return table


_TABLE = _code_table()


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _TABLE[np.minimum(points, 127)], N_CODES - 1).astype(np.int8)


class Tagger:
    """Embedding, two LSTMs (one from each side), a linear layer and CRF transitions.

    Gates stand in the order in, forget, out, new. Sums over tag sequences are taken by scaled forward and backward
    passes: every step is divided by its total, and the totals' logarithms add up to the normaliser's.
    """

    def __init__(self, width: int = 12, hidden: int = 20, seed: int = 5, dtype=np.float32) -> None:
        rng = np.random.default_rng(seed)
        self.hidden, self.dtype = hidden, dtype
        p = {"emb": rng.normal(0, 0.3, (N_CODES, width)), "out": rng.normal(0, 0.2, (2 * hidden, N_TAGS)), "bias": np.zeros(N_TAGS), "trans": np.zeros((N_TAGS, N_TAGS)), "first": np.zeros(N_TAGS)}
        for d in "fb":
            p[f"wx{d}"] = rng.normal(0, width**-0.5, (width, 4 * hidden))
            p[f"wh{d}"] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden))
            p[f"wb{d}"] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]
        self.p = {k: v.astype(dtype) for k, v in p.items()}

    def _lstm(self, codes: np.ndarray, d: str, keep: bool):
        """States of each step, (steps, rows, hidden); with keep also what the way back needs."""
        n, steps = codes.shape
        h = self.hidden
        table = self.p["emb"] @ self.p[f"wx{d}"] + self.p[f"wb{d}"]
        state, cell = np.zeros((n, h), self.dtype), np.zeros((n, h), self.dtype)
        out, tape = np.empty((steps, n, h), self.dtype), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gates = state @ self.p[f"wh{d}"]
            gates += table[codes[:, t]]
            ifo = gates[:, : 3 * h]
            # a sigmoid is half a tanh of half its argument, and a half
            ifo *= 0.5
            np.tanh(gates, out=gates)
            ifo *= 0.5
            ifo += 0.5
            before, last = cell, state
            cell = ifo[:, h : 2 * h] * cell + ifo[:, :h] * gates[:, 3 * h :]
            squashed = np.tanh(cell)
            state = ifo[:, 2 * h :] * squashed
            out[t] = state
            if keep:
                tape.append((t, gates, before, last, squashed))
        return out, tape

    def _lstm_back(self, codes: np.ndarray, d: str, tape: list, grad: np.ndarray, g: dict) -> None:
        h = self.hidden
        dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        dxs = np.empty((*grad.shape[:2], 4 * h), self.dtype)
        for t, gates, before, last, squashed in reversed(tape):
            dh = dh + grad[t]
            i, f, o, new = (gates[:, k * h : (k + 1) * h] for k in range(4))
            dc = dc + dh * o * (1 - squashed**2)
            dgate = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)], axis=1)
            g[f"wh{d}"] += last.T @ dgate
            dxs[t] = dgate
            dh, dc = dgate @ self.p[f"wh{d}"].T, dc * f
        hot = (codes.T.ravel()[:, None] == np.arange(N_CODES)).astype(self.dtype)
        table = hot.T @ dxs.reshape(-1, 4 * h)
        g["emb"] += table @ self.p[f"wx{d}"].T
        g[f"wx{d}"] += self.p["emb"].T @ table
        g[f"wb{d}"] += table.sum(axis=0)

    def _emissions(self, codes: np.ndarray, keep: bool = False):
        (fwd, tape_f), (bwd, tape_b) = (self._lstm(codes, d, keep) for d in "fb")
        both = np.concatenate([fwd, bwd], axis=2)
        return both @ self.p["out"] + self.p["bias"], both, tape_f, tape_b

    def _sums(self, e: np.ndarray):
        """Scaled forward and backward weights of each step and tag, step weights, and the normaliser's logarithm."""
        e = e.astype(np.float64)
        top = e.max(axis=2, keepdims=True)
        w = np.exp(e - top)
        trans = np.exp(self.p["trans"].astype(np.float64))
        alpha, beta = np.empty_like(w), np.ones_like(w)
        now = w[0] * np.exp(self.p["first"].astype(np.float64))
        z = top.sum(axis=(0, 2))
        for t in range(len(w)):
            now = now if t == 0 else (alpha[t - 1] @ trans) * w[t]
            total = now.sum(axis=1, keepdims=True)
            alpha[t] = now / total
            z = z + np.log(total[:, 0])
        for t in range(len(w) - 2, -1, -1):
            now = (beta[t + 1] * w[t + 1]) @ trans.T
            beta[t] = now / now.sum(axis=1, keepdims=True)
        return alpha, beta, w, trans, z

    def loss(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags and its gradients."""
        n, steps = codes.shape
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        e, both, tape_f, tape_b = self._emissions(codes, True)
        alpha, beta, w, trans, z = self._sums(e)
        marginal = alpha * beta
        marginal /= marginal.sum(axis=2, keepdims=True)
        gold_tags = tags.T
        at = np.arange(steps)[:, None], np.arange(n)[None], gold_tags
        gold = e[at].sum(axis=0) + self.p["first"][gold_tags[0]] + self.p["trans"][gold_tags[:-1], gold_tags[1:]].sum(axis=0)
        de = marginal
        de[at] -= 1
        de /= n
        pairs = np.zeros_like(trans)
        for t in range(1, steps):
            right = w[t] * beta[t]
            total = np.einsum("ni,ij,nj->n", alpha[t - 1], trans, right)
            pairs += alpha[t - 1].T @ (right / total[:, None])
        g["trans"] = (pairs * trans / n).astype(self.dtype)
        np.subtract.at(g["trans"], (gold_tags[:-1].ravel(), gold_tags[1:].ravel()), 1 / n)
        de = de.astype(self.dtype)
        g["first"] = de[0].sum(axis=0)
        g["out"] = both.reshape(-1, both.shape[2]).T @ de.reshape(-1, N_TAGS)
        g["bias"] = de.sum(axis=(0, 1))
        dboth = de @ self.p["out"].T
        self._lstm_back(codes, "f", tape_f, dboth[:, :, : self.hidden], g)
        self._lstm_back(codes, "b", tape_b, dboth[:, :, self.hidden :], g)
        return float((z - gold).mean()), g

    def fit(self, codes: np.ndarray, tags: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.014, seed: int = 3) -> Tagger:
        """Adam on shuffled batches."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(codes))
            for lo in range(0, len(codes), batch):
                pick = order[lo : lo + batch]
                _, g = self.loss(codes[pick], tags[pick])
                step += 1
                norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
                scale = min(1.0, 5.0 / (norm + 1e-9))
                for k in self.p:
                    d = g[k] * scale
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.p[k] -= (rate * 0.6 ** max(0, epoch - 1) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(self.dtype)
        return self

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags of a batch of windows, and the CRF's marginal probability of each."""
        e = self._emissions(codes)[0]
        steps, n, _ = e.shape
        best = e[0] + self.p["first"]
        back = np.empty((steps, n, N_TAGS), np.int8)
        for t in range(1, steps):
            options = best[:, :, None] + self.p["trans"]
            back[t] = options.argmax(axis=1)
            best = options.max(axis=1) + e[t]
        tags = np.empty((steps, n), np.int64)
        tags[-1] = best.argmax(axis=1)
        rows = np.arange(n)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t, rows, tags[t]]
        alpha, beta = self._sums(e)[:2]
        marginal = alpha * beta
        marginal /= marginal.sum(axis=2, keepdims=True)
        return tags.T, marginal[np.arange(steps)[:, None], rows[None], tags].T

    def tag(self, texts: list[np.ndarray], regions: list[tuple[int, int, int]], batch: int = 512) -> list[tuple[int, int, int, int, float]]:
        """(text, kind, start, end, confidence) in regions (text, start, end): overlapping windows are decoded, each
        character takes tag and marginal from the window in which it lies nearest to the middle, and a span's confidence
        is the mean of its characters' marginals."""
        places = [(i, lo, hi, at) for i, (_, lo, hi) in enumerate(regions) for at in range(lo, max(lo + 1, hi - WINDOW + STRIDE), STRIDE)]
        tags = {i: (np.zeros(hi - lo, np.int64), np.zeros(hi - lo), np.full(hi - lo, WINDOW)) for i, (_, lo, hi) in enumerate(regions)}
        far = np.abs(np.arange(WINDOW) * 2 - (WINDOW - 1))
        for b in range(0, len(places), batch):
            part = places[b : b + batch]
            codes = np.ones((len(part), WINDOW), np.int8)
            for k, (i, _, hi, at) in enumerate(part):
                own = texts[regions[i][0]][at : min(hi, at + WINDOW)]
                codes[k, : len(own)] = own
            for (i, lo, hi, at), row, sure in zip(part, *self.decode(codes), strict=True):
                n = min(hi, at + WINDOW) - at
                here = slice(at - lo, at - lo + n)
                mine, how, near = tags[i]
                use = far[:n] < near[here]
                mine[here][use], how[here][use], near[here][use] = row[:n][use], sure[:n][use], far[:n][use]
        out = []
        for i, (text, lo, _) in enumerate(regions):
            row, how, _ = tags[i]
            kind = (row + 1) // 2
            edge = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | ((row[1:] % 2 == 1) & (row[1:] > 0))])
            for a, z in zip(edge, np.r_[edge[1:], len(row)], strict=True):
                if kind[a]:
                    out.append((text, int(kind[a]) - 1, lo + int(a), lo + int(z), float(how[a:z].mean())))
        return out


def tag_codes(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """B and I tags of labelled spans."""
    tags = np.zeros(length, np.int64)
    for kind, start, end in spans:
        k = KINDS.index(kind)
        tags[start:end] = 2 + 2 * k
        tags[start] = 1 + 2 * k
    return tags
