"""Byte-pair encoding without running merges over whole texts.

Two tokens may stand next to each other in an encoding exactly if encoding their concatenation gives the two back: the
merges inside either would have come before any merge over the border. `Merges.compatible` decides that by undoing the
latest merge at the border again and again, and asking each time whether the two pieces that then touch would have
merged earlier. Both encoders below rest on it:

* `Backtracking` (operator 5): the longest token at each place, from an Aho-Corasick automaton, shorter ones on
  conflict; every place is left at most once by each token, so time is linear in the text.
* `Prefixes` (operator 2): the last token of every prefix is unique, which gives each prefix's exact token count from
  that of a shorter one.
"""

from __future__ import annotations

import ahocorasick


class Merges:
    """Tokens as strings over a unit alphabet (bytes as latin-1, or characters) with a priority for each merge result."""

    def __init__(self, tokens: list[str | None], rank: dict[int, int], pairs: dict[tuple[int, int], int] | None = None):
        """tokens[i]: string of id i, or None if no merge makes or uses it. rank[i]: lower merges first; units have rank -1.

        pairs: (left, right) -> result; by default any two tokens whose concatenation is a token.
        """
        self.tokens, self.rank, self.pairs = tokens, rank, pairs
        self.ids = {t: i for i, t in reversed(list(enumerate(tokens))) if t is not None}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}  # the pair-compatibility table, filled as pairs come up

    def merged(self, a: int, b: int) -> int | None:
        if self.pairs is not None:
            return self.pairs.get((a, b))
        got = self.ids.get(self.tokens[a] + self.tokens[b])
        return got if got is not None and self.rank[got] >= 0 else None

    def units(self, text: str) -> list[int]:
        return [self.ids[c] for c in text]

    def merge_all(self, text: str, history: list | None = None) -> list[int]:
        """The definition: merge the pair of lowest rank, the leftmost of equals, until none is left. For short strings."""
        out = self.units(text)
        while len(out) > 1:
            best = min(((self.rank[m], i, m) for i, (a, b) in enumerate(zip(out, out[1:])) if (m := self.merged(a, b)) is not None), default=None)
            if best is None:
                break
            _, i, m = best
            if history is not None:
                history.append((out[i], out[i + 1]))
            out[i : i + 2] = [m]
        return out

    def parts(self, token: int) -> tuple[int, int] | None:
        """The last merge that makes the token; None for a unit. A token that encoding never gives has itself as parts."""
        got = self.split.get(token, 0)
        if got == 0:
            history: list = []
            whole = self.merge_all(self.tokens[token], history) == [token]
            got = self.split[token] = (history[-1] if history else None) if whole else (token, token)
        return got

    def reachable(self, token: int) -> bool:
        return self.parts(token) != (token, token)

    def reached(self) -> dict[str, int]:
        """The tokens that encoding their own string gives: only these stand in any encoding."""
        return {t: i for t, i in self.ids.items() if self.reachable(i)}

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) > 400_000:
                self.fits.clear()
            got = self.fits[key] = self._compatible(a, b)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        rank = self.rank
        until_left, until_right = 1 << 60, 1 << 60  # when the piece at the border was merged away on its own side
        while True:
            m = self.merged(a, b)
            # A border merge takes its place before its equal on the right, after its equal on the left.
            if m is not None and rank[m] < until_left and rank[m] <= until_right:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                until_left = ra
                a = self.parts(a)[1]
            else:
                until_right = rb
                b = self.parts(b)[0]


def _automaton(tokens: dict[str, int]):
    found = ahocorasick.Automaton()
    for t, i in tokens.items():
        found.add_word(t, (i, len(t)))
    found.make_automaton()
    return found


class Backtracking:
    """Encodes a string of units; the automaton and the table of next shorter tokens are built once."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.ids = merges.reached()
        self.length = {i: len(t) for t, i in self.ids.items()}
        self.find = _automaton(self.ids)
        self.shorter: dict[int, int | None] = {}

    def _shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of the token."""
        got = self.shorter.get(token, -1)
        if got == -1:
            t, ids = self.merges.tokens[token], self.ids
            got = self.shorter[token] = next((i for n in range(len(t) - 1, 0, -1) if (i := ids.get(t[:n])) is not None), None)
        return got

    def encode(self, text: str) -> list[int]:
        whole = self.ids.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        longest: list = [None] * (n + 1)
        for end, (i, size) in self.find.iter(text):  # matches by their last unit: the last seen for a start is the longest
            longest[end + 1 - size] = i
        fits, compatible, length = self.merges.fits, self.merges.compatible, self.length
        out: list[int] = []
        at, last = 0, -1
        dead = None  # places from which no encoding goes on
        nxt = longest[0]
        while at < n:
            while nxt is not None:
                end = at + length[nxt]
                if dead is None or end not in dead:
                    if last < 0:
                        break
                    ok = fits.get(last << 20 | nxt)
                    if ok or ok is None and compatible(last, nxt):
                        break
                nxt = self._shorter(nxt)
            if nxt is None:
                dead = dead or set()
                dead.add(at)
                nxt = out.pop()
                at -= length[nxt]
                last = out[-1] if out else -1
                nxt = self._shorter(nxt)
            else:
                out.append(nxt)
                last, at = nxt, end
                nxt = longest[at]
        return out


class Prefixes:
    """Exact token counts of every prefix of a string of units."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.find = _automaton(merges.reached())

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """(tokens of text[:i], last token of text[:i]) for every i from 0.

        Of the tokens that end at i exactly one is compatible with the last token of the prefix before it.
        """
        fits, compatible = self.merges.fits, self.merges.compatible
        counts, last = [0] * (len(text) + 1), [-1] * (len(text) + 1)
        for end, (i, size) in self.find.iter(text):
            end += 1
            if last[end] < 0:
                start = end - size
                if start:
                    before = last[start]
                    ok = fits.get(before << 20 | i)
                    if not (ok or ok is None and compatible(before, i)):
                        continue
                counts[end], last[end] = counts[start] + 1, i
        return counts, last
