"""Linear-chain conditional random field over words, in numpy.

A word's potentials come from hashed features of the word itself (affixes, character n-grams, the word, lexicon
membership); learned transitions tie neighbours. Because potentials depend on the word alone they are kept in a
bounded table by word, and forward-backward runs in lockstep over all documents of a batch. A word of any length is one
word, with features over all its characters.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import repeat

import numpy as np

from .common import slices

BITS = 17  #: hashed feature space: 2**17 rows of weights
ORDERS = (1, 2, 3, 4)  #: character n-grams; those that touch a word boundary are the affixes
EMPTY = 1 << BITS  #: the row of weights that stays 0
CHARACTERS_AT_ONCE = 150_000  #: of new words whose features are in memory together
LONG = 1024  #: characters from which a word's features are summed stretch by stretch, and the word isn't kept in a table
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7, 8), (3, 4, 5, 6)  #: lengths of affixes, where a model goes by them alone


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (2**BITS + 1, labels) float32
    transitions: np.ndarray  # (labels, labels), log
    start: np.ndarray  # (labels,), log
    lexicon: dict[str, int] = field(default_factory=dict)  # word -> label whose lexicon holds it
    by_affixes: bool = False  # features are the word and its affixes instead of n-grams


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


def _grams(words: list[str]):
    """(starts of words among characters, feature id of the n-gram at each character for every order, whole-word ids).

    Where the word ends before the n-gram does, the id is that of the empty last row.
    """
    marked = ["\x02" + w + "\x03" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    left = np.repeat(ends, lengths) - np.arange(len(chars))  # characters from here to the word's end
    by_order = []
    h = np.zeros(len(chars), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            h[: max(0, len(chars) - n + 1)] += chars[n - 1 :]
            if n in ORDERS:
                by_order.append(np.where(left >= n, (_mix(h) >> np.uint64(64 - BITS)).astype(np.int64), EMPTY))
        spot = _mix(chars * np.uint64(0xD6E8FEB86659FD93) + left.astype(np.uint64))
        whole = (_mix(np.add.reduceat(spot, starts)) >> np.uint64(64 - BITS)).astype(np.int64)
    return starts, by_order, whole


def _flags(words: list[str], lexicon) -> np.ndarray:
    """Row of the lexicon that holds the word (the first rows of the table), or the empty row."""
    return np.fromiter((lexicon.get(w, EMPTY) for w in words), dtype=np.int64, count=len(words))


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids of all words in a row, index where each word's ids start). Words must not be empty."""
    starts, by_order, whole = _grams(words)
    owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(by_order[0]))))
    ids = np.concatenate([*by_order, whole, _flags(words, lexicon)])
    owners = np.concatenate([owner] * len(by_order) + [np.arange(len(words))] * 2)
    ids, owners = ids[ids != EMPTY], owners[ids != EMPTY]
    order = np.argsort(owners, kind="stable")
    return ids[order], np.searchsorted(owners[order], np.arange(len(words)))


def _whole_row(word: str) -> int:
    """Row of a whole word, from a sum over its characters that is made stretch by stretch."""
    total = np.zeros(1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(word), LONG):
            chars = np.frombuffer(word[at : at + LONG].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            left = len(word) - at - np.arange(len(chars))
            total += _mix(chars * np.uint64(0xD6E8FEB86659FD93) + left.astype(np.uint64)).sum(dtype=np.uint64)
        return int(_mix(total)[0] >> np.uint64(64 - BITS))


def affixes(words: list[str]) -> np.ndarray:
    """Feature ids of each word (words x features): the word, its longer prefixes and suffixes; the empty row where it is too short.

    A long word has the same features as a short one; only memory is saved: its ends give its affixes, its whole is summed up.
    """
    ends = max(PREFIXES) + 1, max(SUFFIXES) + 1
    rows = _affixes([w if len(w) < LONG else w[: ends[0]] + w[-ends[1] :] for w in words])
    for i, w in enumerate(words):
        if len(w) >= LONG:
            rows[i, 0] = _whole_row(w)
    return rows


def _affixes(words: list[str]) -> np.ndarray:
    chars = np.frombuffer(("".join(words) + " " * max(PREFIXES)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    row = lambda h: (_mix(h) >> np.uint64(64 - BITS)).astype(np.int64)
    with np.errstate(over="ignore"):
        left = np.repeat(ends, lengths) - np.arange(ends[-1])
        out = [row(np.add.reduceat(_mix(chars[: ends[-1]] * np.uint64(0xD6E8FEB86659FD93) + left.astype(np.uint64)), starts))]
        for salt, sizes, at in ((0x9E3779B97F4A7C15, PREFIXES, lambda n: starts + n - 1), (0xC2B2AE3D27D4EB4F, SUFFIXES, lambda n: np.maximum(ends - n, 0))):
            h = np.zeros(len(words), dtype=np.uint64)
            for n in range(1, max(sizes) + 1):
                h = (h + chars[at(n)]) * np.uint64(salt) + np.uint64(n)
                if n in sizes:
                    out.append(np.where(lengths > n, row(h), EMPTY))
    return np.stack(out, axis=1)


def _long_potential(model: Model, word: str) -> np.ndarray:
    """Of one long word: the sum over its n-grams, whose memory doesn't grow with the word."""
    marked, most = "\x02" + word + "\x03", max(ORDERS)
    total, whole = np.zeros(model.weights.shape[1]), np.zeros(1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(marked), LONG):
            chars = np.frombuffer(marked[at : at + LONG + most - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            n_here, left = min(LONG, len(marked) - at), len(marked) - at - np.arange(len(chars))
            h = np.zeros(len(chars), dtype=np.uint64)
            for n in range(1, most + 1):
                h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
                h[: max(0, len(chars) - n + 1)] += chars[n - 1 :]
                if n in ORDERS:
                    own = (left >= n)[:n_here]
                    total += model.weights[(_mix(h[:n_here][own]) >> np.uint64(64 - BITS)).astype(np.int64)].sum(axis=0, dtype=np.float64)
            whole += _mix(chars[:n_here] * np.uint64(0xD6E8FEB86659FD93) + left[:n_here].astype(np.uint64)).sum(dtype=np.uint64)
        total += model.weights[int(_mix(whole)[0] >> np.uint64(64 - BITS))]
    return total + model.weights[_flags([word], model.lexicon)[0]]


def potentials(model: Model, words: list[str]) -> np.ndarray:
    """Log potentials of words, of which none is empty."""
    if model.by_affixes:
        return model.weights[affixes(words)].sum(axis=1)
    if any(len(w) >= LONG for w in words):
        out = np.empty((len(words), model.weights.shape[1]), dtype=np.float32)
        short = [i for i, w in enumerate(words) if len(w) < LONG]
        if short:
            out[short] = potentials(model, [words[i] for i in short])
        for i, w in enumerate(words):
            if len(w) >= LONG:
                out[i] = _long_potential(model, w)
        return out
    starts, by_order, whole = _grams(words)
    total = model.weights[by_order[0]]
    for ids in by_order[1:]:
        total += model.weights[ids]
    return np.add.reduceat(total, starts, axis=0) + model.weights[whole] + model.weights[_flags(words, model.lexicon)]


class WordTable:
    """Potentials by word. Beyond `cap` words the half that was looked up least goes, at a batch's end; long words always do."""

    def __init__(self, model: Model, word_of, cap: int = 120_000):
        """word_of: raw token -> the word whose features count, or None if the token takes no part."""
        self.model, self.word_of, self.cap = model, word_of, cap
        self.index: dict[str, int] = {}
        self.log = np.zeros((cap, len(model.labels)), dtype=np.float32)
        self.hits = np.zeros(cap, dtype=np.int64)
        self.n, self.long = 0, False

    def lookup(self, tokens: list[str], counts: np.ndarray) -> np.ndarray:
        """Row of each distinct token, -2 for one that takes no part; counts: how often each stands in the batch.

        Looking up more new tokens than the table has room for grows it until the next trim.
        """
        idx = np.fromiter(map(self.index.get, tokens, repeat(-1)), dtype=np.int64, count=len(tokens))
        missing = np.flatnonzero(idx == -1)
        if len(missing):
            new = [tokens[i] for i in missing]
            bare = list(map(self.word_of, new))
            some = [i for i, w in enumerate(bare) if w]
            rows = np.full(len(new), -2, dtype=np.int64)
            rows[some] = np.arange(self.n, self.n + len(some))
            if some:
                room = max(len(self.log), self.n + len(some))
                if room > len(self.log):
                    more = room + self.cap - len(self.log)
                    self.log = np.concatenate([self.log, np.zeros((more, self.log.shape[1]), dtype=np.float32)])
                    self.hits = np.concatenate([self.hits, np.zeros(more, dtype=np.int64)])
                sizes = [len(bare[i]) for i in some]
                for lo, hi in slices(sizes, CHARACTERS_AT_ONCE):
                    self.log[self.n + lo : self.n + hi] = potentials(self.model, [bare[i] for i in some[lo:hi]])
                self.n += len(some)
            self.index.update(zip(new, rows.tolist()))
            self.long = self.long or max(map(len, new)) >= LONG
            idx[missing] = rows
        real = idx >= 0
        self.hits[idx[real]] += counts[real]
        return idx

    def trim(self) -> None:
        """Call between batches: rows move, so indexes from before are void."""
        if len(self.index) <= self.cap and not self.long:
            return
        whole = len(self.index) <= self.cap
        keep = np.arange(self.n) if whole else np.argsort(-self.hits[: self.n], kind="stable")[: self.cap // 2]
        place = np.full(self.n + 1, -1, dtype=np.int64)
        place[keep] = np.arange(len(keep))
        self.index = {t: int(place[i]) for t, i in self.index.items() if i >= 0 and place[i] >= 0 and len(t) < LONG}
        log, hits = self.log[keep], self.hits[keep] // 2
        self.log = np.zeros((max(self.cap, len(keep)), log.shape[1]), dtype=np.float32)
        self.hits = np.zeros(len(self.log), dtype=np.int64)
        self.log[: len(keep)], self.hits[: len(keep)], self.n, self.long = log, hits, len(keep), False


def forward_backward(model: Model, potential: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (words x labels, in the input's order) and the log partition of each sequence.

    potential: log potentials of all sequences in a row; lengths: words of each sequence, none 0.
    All sequences advance together, longest first, so that a step's live sequences are a prefix.
    """
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    begins = (np.cumsum(lengths) - lengths)[order]
    steps = int(sorted_lengths[0])
    live = np.searchsorted(-sorted_lengths, -np.arange(steps), side="left")  # sequences longer than t
    at = np.cumsum(live) - live
    # source row of (t, i): begins[i] + t
    place = np.concatenate([[0], np.cumsum(live)])
    source = np.empty(place[-1], dtype=np.int64)
    for t0, t1 in _time_slices(live):
        ks = live[t0:t1]
        seq = np.arange(ks.sum()) - np.repeat(np.cumsum(ks) - ks, ks)
        source[place[t0] : place[t1]] = begins[seq] + np.repeat(np.arange(t0, t1), ks)
    e = potential[source].astype(np.float64)
    top = e.max(axis=1, keepdims=True)
    e = np.exp(e - top)
    trans, start = np.exp(model.transitions.astype(np.float64)), np.exp(model.start.astype(np.float64))
    alpha = np.empty_like(e)
    log_z = np.zeros(len(lengths))
    a = None
    for t in range(steps):
        k, o = live[t], at[t]
        a = (start if t == 0 else a[:k] @ trans) * e[o : o + k]
        s = a.sum(axis=1)
        a /= s[:, None]
        alpha[o : o + k] = a
        log_z[:k] += np.log(s) + top[o : o + k, 0]
    b = np.ones((live[steps - 1], e.shape[1]))
    trans_t = trans.T.copy()
    for t in range(steps - 1, -1, -1):
        k, o = live[t], at[t]
        if t < steps - 1:
            grown = np.ones((k, e.shape[1]))
            grown[: live[t + 1]] = b
            b = grown
        m = alpha[o : o + k] * b
        alpha[o : o + k] = m / m.sum(axis=1)[:, None]
        b = (b * e[o : o + k]) @ trans_t
        b /= b.sum(axis=1)[:, None]
    marginals = np.empty_like(alpha)
    marginals[source] = alpha
    back = np.empty(len(lengths))
    back[order] = log_z
    return marginals, back


def _time_slices(live: np.ndarray, most: int = 1 << 20):
    t0 = 0
    while t0 < len(live):
        t1 = t0 + max(1, int(most // max(1, live[t0])))
        yield t0, min(t1, len(live))
        t0 = t1


def train(sequences: list[list[str]], tags: list[np.ndarray], labels: list[str], lexicon: dict[str, int], epochs: int = 4, batch: int = 64, rate: float = 0.05, l2: float = 1e-5, seed: int = 7) -> Model:
    """Maximises the conditional likelihood with Adam; sequences must have one length, so that a batch is a block.

    The gradient of a potential is (gold - marginal), that of a transition (gold pairs - expected pairs).
    """
    k, rng = len(labels), np.random.default_rng(seed)
    model = Model(labels, np.zeros((EMPTY + 1, k), dtype=np.float32), np.zeros((k, k)), np.zeros(k), lexicon)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for s in sequences for w in s))}
    ids, starts = features(list(vocabulary), lexicon)
    sizes = np.diff(np.append(starts, len(ids)))
    words = np.array([[vocabulary[w] for w in s] for s in sequences])
    gold = np.stack(tags)
    steps_done = 0
    m, v = np.zeros_like(model.weights), np.zeros_like(model.weights)
    small = {n: [np.zeros_like(getattr(model, n)), np.zeros_like(getattr(model, n))] for n in ("transitions", "start")}
    length = words.shape[1]
    for epoch in range(epochs):
        for chosen in np.array_split(rng.permutation(len(words)), max(1, len(words) // batch)):
            w, y = words[chosen], gold[chosen]
            distinct, inverse = np.unique(w, return_inverse=True)
            inverse = inverse.reshape(w.shape)
            n = sizes[distinct]
            flat = np.repeat(starts[distinct] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            feature = ids[flat]
            logs = np.add.reduceat(model.weights[feature], np.cumsum(n) - n, axis=0).astype(np.float64)
            e = logs[inverse]  # batch x length x labels
            e = np.exp(e - e.max(axis=2, keepdims=True))
            trans, start = np.exp(model.transitions), np.exp(model.start)
            alpha, beta = np.empty_like(e), np.ones_like(e)
            for t in range(length):
                a = (start if t == 0 else alpha[:, t - 1] @ trans) * e[:, t]
                alpha[:, t] = a / a.sum(axis=1, keepdims=True)
            for t in range(length - 2, -1, -1):
                b = (beta[:, t + 1] * e[:, t + 1]) @ trans.T
                beta[:, t] = b / b.sum(axis=1, keepdims=True)
            marginal = alpha * beta
            marginal /= marginal.sum(axis=2, keepdims=True)
            pair = alpha[:, :-1, :, None] * trans[None, None] * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            truth = np.eye(k)[y]
            gap = (truth - marginal).reshape(-1, k)
            by_word = np.stack([np.bincount(inverse.ravel(), weights=gap[:, c], minlength=len(distinct)) for c in range(k)], axis=1)
            spread = np.repeat(by_word, n, axis=0)
            touched, where = np.unique(feature, return_inverse=True)
            g = np.stack([np.bincount(where, weights=spread[:, c], minlength=len(touched)) for c in range(k)], axis=1) / len(chosen) - l2 * model.weights[touched]
            steps_done += 1
            r = rate * np.sqrt(1 - 0.999**steps_done) / (1 - 0.9**steps_done)
            m[touched] = 0.9 * m[touched] + 0.1 * g
            v[touched] = 0.999 * v[touched] + 0.001 * g * g
            model.weights[touched] += (r * m[touched] / (np.sqrt(v[touched]) + 1e-8)).astype(np.float32)
            pairs = np.zeros((k, k))
            np.add.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            for name, grad in (("transitions", (pairs - pair.sum(axis=(0, 1))) / len(chosen)), ("start", (truth[:, 0] - marginal[:, 0]).mean(axis=0))):
                p, q = small[name]
                p += 0.1 * (grad - p)
                q += 0.001 * (grad * grad - q)
                getattr(model, name)[...] += r * p / (np.sqrt(q) + 1e-8)
    return model


def purity_lexicon(counts: dict[str, np.ndarray], least: int, share: float) -> dict[str, int]:
    """Words seen `least` times of which one label holds `share` or more."""
    return {w: int(c.argmax()) for w, c in counts.items() if c.sum() >= least and c.max() >= share * c.sum()}
