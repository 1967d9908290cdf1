"""A linear-chain conditional random field over word-shape features, in numpy.

Features belong to word types; the score of a label at a token is the sum of the weights of the features of the words at
offsets -REACH..REACH. So a batch is scored by one small table per offset and a gather, and decoded by Viterbi over all its
texts at once, step by step.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

REACH = 4
OFFSETS = range(-REACH, REACH + 1)
#: Marks a word in training whose letters are hidden, so that weight goes to shapes and neighbours as well.
BLIND = "\0"
TOKEN = re.compile(r"\r\n|\n|\r|[^\W_]+|_|[^\w\s]")


def tokens(text: str) -> tuple[list[str], list[int], list[int]]:
    """Words, signs and line ends of a text as (types, starts, ends); a type knows whether a blank stands before it."""
    types, starts, ends = [], [], []
    last = 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        w = m.group()
        types.append("\n" if w[0] in "\r\n" else (" " + w if a > last or not a else w))
        starts.append(a)
        ends.append(b)
        last = b
    return types, starts, ends


def features(token: str) -> list[str]:
    """The features of a word type; a type that ends in BLIND shows its shape only."""
    if token.endswith(BLIND):
        return [f for f in features(token[:-1]) if f[0] not in "=<>"]
    if token in ("\n", ""):
        return [f"={token or 'edge'}"]
    blank = token[0] == " "
    w = token[1:] if blank else token
    low = w.lower()
    out = [f"b{blank:d}", f"={low}"]
    if not w[0].isalnum():
        return [*out, f"={low}{blank:d}"]
    if w.isdigit():
        return [*out, "digits", f"d{min(len(w), 12)}", f"d{min(len(w), 12)}{blank:d}", f"z{w[:2]}{min(len(w), 12)}"]
    shape = re.sub(r"\d", "9", re.sub(r"[^\W\d_]", lambda m: "X" if m.group().isupper() else "x", w))
    short = re.sub(r"(.)\1+", r"\1", shape)
    out += [f"s{short}", f"s{short}{blank:d}", f"f{shape}" if len(w) < 4 or "9" in shape else "long"]
    out += [f"<{low[:3]}", f">{low[-4:]}", f">{low[-3:]}", f">{low[-2:]}"]
    if "9" in shape:
        out.append("mixed")
    elif w[0].isupper():
        out.append("upper" if w.isupper() and len(w) > 1 else "title")
    return out


@dataclass
class Model:
    """Weights of a trained field: feature numbers, weights by offset, transitions, first labels."""

    labels: list[str]
    index: dict[str, int]
    weights: np.ndarray  # offsets x features x labels
    step: np.ndarray  # labels x labels
    first: np.ndarray  # labels

    def table(self, types: list[str]) -> np.ndarray:
        """offsets x types x labels: the score that each type adds at each offset."""
        ids = [[self.index[f] for f in features(t) if f in self.index] for t in types]
        width = max((len(i) for i in ids), default=1) or 1
        grid = np.zeros((len(ids), width), dtype=np.int32)
        for r, i in enumerate(ids):
            grid[r, : len(i)] = i
        return self.weights[:, grid].sum(axis=2)  # feature 0 is a dummy of weight 0

    def decode(self, texts: list[list[str]], space: int = 300_000) -> list[np.ndarray]:
        """The best label numbers of each text (a list of token types)."""
        vocab: dict[str, int] = {"": 0}
        flat = [np.fromiter((vocab.setdefault(t, len(vocab)) for t in text), dtype=np.int32, count=len(text)) for text in texts]
        scores = self.table(list(vocab)).astype(np.float32)
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(texts)
        order = sorted((i for i in range(len(texts)) if len(flat[i])), key=lambda i: len(flat[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(flat[order[end]]) <= space:
                end += 1
            rows = order[at:end]
            for i, path in zip(rows, self._viterbi([flat[i] for i in rows], scores), strict=True):
                out[i] = path
            at = end
        return out

    def _viterbi(self, seqs: list[np.ndarray], scores: np.ndarray) -> list[np.ndarray]:
        n, most = len(seqs), max(map(len, seqs))
        grid = np.zeros((n, most + 2 * REACH), dtype=np.int32)
        for r, s in enumerate(seqs):
            grid[r, REACH : REACH + len(s)] = s
        size = np.array([len(s) for s in seqs])
        step = self.step.astype(np.float32)
        back = np.zeros((most, n, len(self.labels)), dtype=np.int8)
        best = np.zeros((n, len(self.labels)), dtype=np.float32)
        final = np.zeros_like(best)
        for t in range(most):
            emit = sum(scores[k, grid[:, t + k]] for k in range(2 * REACH + 1))
            if t == 0:
                best = self.first.astype(np.float32) + emit
            else:
                ways = best[:, :, None] + step
                back[t] = ways.argmax(axis=1)
                best = ways.max(axis=1) + emit
            done = size == t + 1
            final[done] = best[done]
        path = np.zeros((n, most), dtype=np.int8)
        here = final.argmax(axis=1)
        for t in range(most - 1, -1, -1):
            here = np.where(size == t + 1, final.argmax(axis=1), here)
            path[:, t] = here
            here = back[t][np.arange(n), here]
        return [path[r, : size[r]] for r in range(n)]


def train(texts: list[list[str]], tags: list[list[str]], labels: list[str], epochs: int = 8, batch: int = 64, rate: float = 0.08, decay: float = 2e-4, least: int = 2, seed: int = 1) -> Model:
    """Maximum likelihood by mini-batch Adam; features seen fewer than `least` times are left out."""
    vocab: dict[str, int] = {"": 0}
    flat = [np.array([vocab.setdefault(t, len(vocab)) for t in text], dtype=np.int32) for text in texts]
    number = {l: i for i, l in enumerate(labels)}
    gold = [np.array([number[t] for t in tag], dtype=np.int32) for tag in tags]
    seen: dict[str, int] = {}
    counts = np.bincount(np.concatenate(flat), minlength=len(vocab))
    feats = [features(t) for t in vocab]
    for f, c in zip(feats, counts, strict=True):
        for x in f:
            seen[x] = seen.get(x, 0) + int(c)
    index = {f: i + 1 for i, f in enumerate(sorted(f for f, c in seen.items() if c >= least or f == "=edge"))}
    width = max(len(f) for f in feats)
    grid = np.zeros((len(vocab), width), dtype=np.int32)
    for r, f in enumerate(feats):
        ids = [index[x] for x in f if x in index]
        grid[r, : len(ids)] = ids
    L, K, O = len(labels), len(index) + 1, len(OFFSETS)
    params = [np.zeros((O, K, L)), np.zeros((L, L)), np.zeros(L)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    rng, rounds = np.random.default_rng(seed), 0
    steps = epochs * -(-len(flat) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(flat))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            grads = _gradient([flat[i] for i in rows], [gold[i] for i in rows], params, grid)
            rounds += 1
            lr = rate * (1 - rounds / (steps + 1))
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                g += decay * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= lr * (m / (1 - 0.9**rounds)) / (np.sqrt(v / (1 - 0.99**rounds)) + 1e-6)
            params[0][:, 0] = 0.0
    return Model(labels, index, params[0].astype(np.float32), params[1], params[2])


def _gradient(seqs: list[np.ndarray], gold: list[np.ndarray], params: list[np.ndarray], grid: np.ndarray) -> list[np.ndarray]:
    """The mean gradient of the negative log-likelihood of a batch."""
    weights, step, first = params
    O, K, L = weights.shape
    n, most = len(seqs), max(map(len, seqs))
    types = np.zeros((n, most + 2 * REACH), dtype=np.int32)
    truth = np.full((n, most), -1, dtype=np.int32)
    for r, (s, g) in enumerate(zip(seqs, gold, strict=True)):
        types[r, REACH : REACH + len(s)] = s
        truth[r, : len(g)] = g
    real = truth >= 0
    used, local = np.unique(types, return_inverse=True)
    local = local.reshape(types.shape)
    table = weights[:, grid[used]].sum(axis=2)
    emit = sum(table[k][local[:, k : k + most]] for k in range(O))
    emit -= emit.max(axis=2, keepdims=True)
    like, move = np.exp(emit), np.exp(step - step.max())
    alpha, beta = np.zeros((most, n, L)), np.ones((most, n, L))
    a = np.exp(first - first.max()) * like[:, 0]
    alpha[0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, most):
        a = (alpha[t - 1] @ move) * like[:, t]
        a /= a.sum(axis=1, keepdims=True)
        alpha[t] = np.where(real[:, t, None], a, alpha[t - 1])
    for t in range(most - 2, -1, -1):
        b = (beta[t + 1] * like[:, t + 1]) @ move.T
        b /= b.sum(axis=1, keepdims=True)
        beta[t] = np.where(real[:, t + 1, None], b, 1.0)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    delta = post.transpose(1, 0, 2).copy()
    r, t = np.nonzero(real)
    delta[r, t, truth[r, t]] -= 1.0
    delta[~real] = 0.0
    dfirst = delta[:, 0].sum(axis=0)
    pair = alpha[:-1, :, :, None] * move * (beta[1:] * like.transpose(1, 0, 2)[1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    pair *= real.T[1:, :, None, None]
    dstep = pair.sum(axis=(0, 1))
    r, t = np.nonzero(real[:, 1:])
    np.subtract.at(dstep, (truth[r, t], truth[r, t + 1]), 1.0)
    dweights = np.zeros_like(weights)
    feats = grid[used]
    for k in range(O):
        where = local[:, k : k + most].ravel()
        for l in range(L):
            per = np.bincount(where, weights=delta[:, :, l].ravel(), minlength=len(used))
            dweights[k, :, l] = np.bincount(feats.ravel(), weights=np.repeat(per, feats.shape[1]), minlength=K)
    return [dweights / n, dstep / n, dfirst / n]
