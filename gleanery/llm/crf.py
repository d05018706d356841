"""Linear-chain and skip-chain conditional random fields over tokens, in numpy, for whole batches of texts at once.

Features of a token are hashed, so a model is a table of SIZE x labels and a transition matrix. A skip chain also links a
token to the next one in its document that is the same or similar (see skip_links); linked tokens share a potential over
their kinds of entity, and loopy belief propagation passes messages over these links and along the chains in turn.
Each token has at most two links, so the work is linear in the tokens.
"""

import functools
import io
import pkgutil
import re
import zlib

import numpy as np

BITS = 18
SIZE = 1 << BITS
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|\S", re.S)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _h(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) + 1


def _shape(w: str) -> str:
    if w.isdigit():
        return f"d{min(len(w), 10)}"
    if not w[0].isalpha():
        return w
    return ("X" if w[0].isupper() else "x") + ("X" if len(w) > 1 and w[1:].isupper() else "m" if len(w) > 1 and w[1:] != w[1:].lower() else "x" if len(w) > 1 else "") + ("'" if not w.isalpha() else "")


class Words:
    """Hashed features of word forms, each computed once per worker; forgotten when there are too many."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.rows = [(_h("<edge>"),) * 5]
        self.table = np.zeros((0, 5), np.uint64)

    def ids(self, words: list[str]) -> np.ndarray:
        if len(self.index) > 500_000:
            self.clear()
        out = []
        for w in words:
            i = self.index.get(w)
            if i is None:
                low = re.sub("[0-9]", "0", w.lower()).replace("’", "'")[:40]
                i = self.index[w] = len(self.rows)
                self.rows.append((_h("w" + low), _h("s" + _shape(w)), _h("e" + low[-3:]), _h("b" + low[:3]), _h(f"l{min(len(low), 12)}{low.isalpha()}")))
            out.append(i)
        if len(self.table) < len(self.rows):
            self.table = np.array(self.rows, np.uint64)
        return np.array(out, np.int64)


WORDS = Words()


def _mix(*parts) -> np.ndarray:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ p) * _MIX
            h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(ids: np.ndarray, spaced: np.ndarray, real: np.ndarray) -> np.ndarray:
    """(tokens, features) of a flat array of words, 0 at the edges of texts; only rows of real tokens are returned."""
    pad = 3
    t = WORDS.table[np.r_[np.zeros(pad, np.int64), ids, np.zeros(pad, np.int64)]]
    n = len(ids)
    at = lambda o, k: t[pad + o : pad + o + n, k][real]
    w, s, e, b = (lambda o, k=k: at(o, k) for k in range(4))
    u = np.uint64
    sp = np.r_[spaced, 1, 1].astype(np.uint64)
    glue = (sp[:n] * u(2) + sp[1 : n + 1])[real] + u(7)
    columns = [(u(1), w(0)), (u(2), s(0), glue), (u(3), e(0)), (u(4), b(0)), (u(5), at(0, 4)), (u(6), s(0))]
    for o, c in ((-1, 10), (1, 20), (-2, 30), (2, 40), (-3, 50), (3, 60)):
        columns.append((u(c), w(o)))
        if abs(o) < 3:
            columns.append((u(c + 1), s(o)))
        if abs(o) == 1:
            columns += [(u(c + 2), e(o)), (u(c + 3), w(o), s(0)), (u(c + 4), s(o), s(0), glue), (u(c + 5), w(o), w(0))]
    columns += [(u(70), w(-2), w(-1)), (u(71), w(1), w(2)), (u(72), s(-1), s(0), s(1)), (u(73), s(-2), s(-1), s(0)), (u(74), s(0), s(1), s(2)), (u(75), w(-1), w(1)), (u(76), w(-2), w(-1), s(0)), (u(77), w(1), w(2), s(0)), (u(78), w(-1), w(0), w(1)), (u(79), s(-2), s(-1), s(0), s(1), s(2))]
    return np.stack([_mix(*c) for c in columns], axis=1)


class Batch:
    """Texts as tokens: text index, character places, features, and the positions of texts by their length."""

    def __init__(self, texts: list[str], documents: list[int] | None = None):
        self.texts, self.documents = texts, documents if documents is not None else list(range(len(texts)))
        words, flat, spaced, start, end, text_of = [""] * 3, [], [0] * 3, [], [], []
        position = 3
        self.first = [0]
        for i, text in enumerate(texts):
            last = -1
            for m in TOKEN.finditer(text):
                words.append(m[0])
                spaced.append(int(m.start() != last))
                last = m.end()
                start.append(m.start())
                end.append(last)
                text_of.append(i)
                flat.append(position)
                position += 1
            # neighbouring texts of a document are within sight of each other, behind an edge
            k = 1 if i + 1 < len(texts) and self.documents[i + 1] == self.documents[i] else 3
            words += [""] * k
            spaced += [0] * k
            position += k
            self.first.append(len(start))
        self.words = [words[p] for p in flat]
        self.start, self.end, self.text_of = np.array(start, np.int64), np.array(end, np.int64), np.array(text_of, np.int64)
        self._ids, self._spaced, self._real = WORDS.ids(words), np.array(spaced), np.array(flat, np.int64)
        first = np.array(self.first)
        lengths = np.diff(first)
        self.by_length = [first[:-1][lengths == n][:, None] + np.arange(n)[None, :] for n in np.unique(lengths) if n]

    def features(self) -> np.ndarray:
        return features(self._ids, self._spaced, self._real) if len(self.start) else np.zeros((0, 1), np.int64)


def skip_links(batch: Batch, common: set[str]) -> np.ndarray:
    """(m, 2): each token that isn't common with the next of its document that has the same beginning, so near spellings link as well."""
    last: dict[tuple, int] = {}
    out = []
    for i, w in enumerate(batch.words):
        if len(w) >= 4 and w[0].isalpha() and (low := w.lower()) not in common:
            key = (batch.documents[batch.text_of[i]], low[:5])
            j = last.get(key)
            if j is not None:
                out.append((j, i))
            last[key] = i
    return np.array(out, np.int64).reshape(-1, 2)


class Field:
    """Weights of a conditional random field; kinds gives the kind of entity of each label, over which linked tokens share a potential."""

    def __init__(self, labels: list[str], weights=None, transitions=None, skip=None, common=()):
        self.labels, self.n = labels, len(labels)
        self.weights = np.zeros((SIZE, self.n), np.float32) if weights is None else weights
        self.transitions = np.zeros((self.n, self.n)) if transitions is None else transitions
        kinds = [x.split("-")[-1] for x in labels]
        self.kind_of = np.array([sorted(set(kinds)).index(k) for k in kinds])
        self.skip = np.zeros((self.kind_of.max() + 1,) * 2) if skip is None else skip
        self.common = set(common)

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), self.n))
        for i in range(0, len(features), 20_000):
            out[i : i + 20_000] = self.weights[features[i : i + 20_000]].sum(axis=1)
        return out

    def chain_beliefs(self, unary: np.ndarray, batch: Batch, expected: np.ndarray | None = None) -> np.ndarray:
        """Marginals of every token by forward and backward messages; adds expected transitions if asked."""
        a = np.exp(self.transitions)
        beliefs = np.empty_like(unary)
        psi = np.exp(unary - unary.max(axis=1, keepdims=True))
        for at in batch.by_length:
            p, t = psi[at], at.shape[1]
            f, b = np.empty_like(p), np.empty_like(p)
            f[:, 0] = p[:, 0] / p[:, 0].sum(axis=1, keepdims=True)
            for i in range(1, t):
                x = (f[:, i - 1] @ a) * p[:, i]
                f[:, i] = x / x.sum(axis=1, keepdims=True)
            b[:, -1] = 1
            for i in range(t - 2, -1, -1):
                x = (p[:, i + 1] * b[:, i + 1]) @ a.T
                b[:, i] = x / x.sum(axis=1, keepdims=True)
            m = f * b
            beliefs[at] = m / m.sum(axis=2, keepdims=True)
            if expected is not None:
                for i in range(1, t):
                    pair = f[:, i - 1, :, None] * a * (p[:, i] * b[:, i])[:, None, :]
                    expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return beliefs

    def beliefs(self, emissions: np.ndarray, batch: Batch, links: np.ndarray, rounds: int = 3, expected: np.ndarray | None = None):
        """Loopy propagation: chain passes and messages over the links in turn. Also the links' pair beliefs over kinds."""
        if not len(links):
            return self.chain_beliefs(emissions, batch, expected), np.zeros((0,) + self.skip.shape), emissions
        s = np.exp(self.skip)[self.kind_of][:, self.kind_of]
        i, j = links.T
        to_j, to_i = np.ones((len(links), self.n)), np.ones((len(links), self.n))
        for r in range(rounds + 1):
            unary = emissions.copy()
            np.add.at(unary, j, np.log(to_j))
            np.add.at(unary, i, np.log(to_i))
            b = self.chain_beliefs(unary, batch, expected if r == rounds else None)
            out_i, out_j = b[i] / to_i, b[j] / to_j
            if r < rounds:
                to_j, to_i = out_i @ s, out_j @ s.T
                to_j, to_i = np.maximum(to_j / to_j.sum(1, keepdims=True), 1e-9), np.maximum(to_i / to_i.sum(1, keepdims=True), 1e-9)
        pair = out_i[:, :, None] * s * out_j[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        kinds = np.eye(len(self.skip))[self.kind_of]
        return b, np.einsum("mab,ak,bl->mkl", pair, kinds, kinds), unary

    def viterbi(self, unary: np.ndarray, batch: Batch) -> np.ndarray:
        """The best labels of every text."""
        out = np.zeros(len(unary), np.int64)
        for at in batch.by_length:
            e, t = unary[at], at.shape[1]
            score, back = e[:, 0], []
            for i in range(1, t):
                x = score[:, :, None] + self.transitions[None]
                back.append(x.argmax(axis=1))
                score = x.max(axis=1) + e[:, i]
            best = score.argmax(axis=1)
            path = [best]
            for b in reversed(back):
                best = b[np.arange(len(best)), best]
                path.append(best)
            out[at] = np.stack(path[::-1], axis=1)
        return out

    def train(self, batches: list[tuple[Batch, np.ndarray]], epochs: int = 6, rate: float = 0.2, ridge: float = 2e-6, with_links: bool = False, seed: int = 1) -> "Field":
        """Adagrad on the likelihood; with links, its gradient takes the beliefs of loopy propagation."""
        rng = np.random.default_rng(seed)
        squares, t_squares, s_squares = np.full((SIZE, self.n), 1e-6, np.float32), np.full_like(self.transitions, 1e-6), np.full_like(self.skip, 1e-6)
        prepared = [(b, y, b.features(), skip_links(b, self.common) if with_links else np.zeros((0, 2), np.int64)) for b, y in batches]
        for _ in range(epochs):
            for k in rng.permutation(len(prepared)):
                batch, y, x, links = prepared[k]
                n = len(batch.texts)
                expected = np.zeros_like(self.transitions)
                b, pair, _ = self.beliefs(self.emissions(x), batch, links, 2, expected)
                off = b.copy()
                off[np.arange(len(y)), y] -= 1
                flat = x.ravel()
                g = np.stack([np.bincount(flat, np.repeat(off[:, c], x.shape[1]), minlength=SIZE) for c in range(self.n)], axis=1).astype(np.float32) / n + ridge * self.weights
                squares += g * g
                self.weights -= (rate * g / np.sqrt(squares)) * (np.abs(g) > 1e-12)
                inner = np.flatnonzero(batch.text_of[1:] == batch.text_of[:-1])
                seen = np.zeros_like(self.transitions)
                np.add.at(seen, (y[inner], y[inner + 1]), 1)
                g = (expected - seen) / n
                t_squares += g * g
                self.transitions -= rate * g / np.sqrt(t_squares)
                if len(links):
                    seen = np.zeros_like(self.skip)
                    np.add.at(seen, (self.kind_of[y[links[:, 0]]], self.kind_of[y[links[:, 1]]]), 1)
                    g = (pair.sum(axis=0) - seen) / n
                    g = (g + g.T) / 2 + 1e-4 * self.skip
                    s_squares += g * g
                    self.skip -= rate * g / np.sqrt(s_squares)
        return self

    def saved(self, least: float = 0.02) -> bytes:
        """Weights above the least, as half floats."""
        at = np.flatnonzero(np.abs(self.weights).max(axis=1) > least)
        f = io.BytesIO()
        np.savez_compressed(f, labels=self.labels, at=at.astype(np.int32), weights=self.weights[at].astype(np.float16), transitions=self.transitions, skip=self.skip, common=sorted(self.common))
        return f.getvalue()


@functools.cache
def load(name: str) -> Field:
    """A model of this package, read once per worker (from a zip as well)."""
    z = np.load(io.BytesIO(pkgutil.get_data("gleanery.llm", f"models/{name}.npz")))
    weights = np.zeros((SIZE, len(z["labels"])), np.float32)
    weights[z["at"]] = z["weights"]
    return Field([str(x) for x in z["labels"]], weights, z["transitions"], z["skip"], [str(x) for x in z["common"]])
