"""Operator 2, token counts: prefix dynamic programming over a SentencePiece BPE model.

The normaliser of the model must be the identity with a dummy prefix (`▁` before a text, `▁` for a space); this is
checked on loading. A text falls into chunks between which no merge is possible (before a run of `▁`, around a character
without a piece, between two characters that no piece holds side by side), so that counts add up over chunks and one
table of a chunk's prefixes serves every text that has the chunk.

Defined results: null text counts as empty: 0 bytes, 0 tokens. Special strings in a text are ordinary text. Repeated
rows are counted one by one; null ids stay null; other columns pass by unread; an empty table gives an empty table. A
text of any length is counted whole.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from .bpe import Merges, Prefixes
from .common import Memo, hold, local, map_arrow, shipped

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MEMO_BYTES = 160_000_000  #: of counted chunks that a worker keeps
SPACE = "▁"


class Pieces(Merges):
    """Pieces whose merge order is that of their scores; all runs of `▁` share a score, so ties among them go left."""

    def _compatible(self, a: int, b: int) -> bool:
        s, t = self.tokens[a], self.tokens[b]
        if s[0] == t[0] == SPACE:  # both may be of a tied run
            return self.merge_all(s + t) == [a, b]
        return super()._compatible(a, b)


class Counter:
    """Counts tokens of texts and of their prefixes under a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        assert sp.normalize(" a  ﬁ ") == f"{SPACE}{SPACE}a{SPACE}{SPACE}ﬁ{SPACE}", "the normaliser isn't the identity with a dummy prefix"
        n = sp.get_piece_size()
        normal = [None if sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i) else sp.id_to_piece(i) for i in range(n)]
        order = sorted({sp.get_score(i) for i in range(n) if normal[i]}, reverse=True)
        place = {s: k for k, s in enumerate(order)}
        rank = {i: -1 if len(t) == 1 else place[sp.get_score(i)] for i, t in enumerate(normal) if t}
        self.merges = Pieces(normal, rank)
        self.prefixes = Prefixes(self.merges)
        assert all(SPACE not in t.lstrip(SPACE) and "\n" not in t for t in normal if t), "a piece spans words, so texts can't be cut there"
        self.units = {t for t in normal if t and len(t) == 1}
        self.beside = {t[i : i + 2] for t in normal if t for i in range(len(t) - 1)}
        self.size = Memo(lambda chunk: self.table(chunk)[-1], MEMO_BYTES)
        self._break = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")

    def _runs(self, chunk: str) -> list[str]:
        """The chunk, cut wherever no piece holds the two characters at the cut side by side."""
        out, start = [], 0
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in self.beside:
                out.append(chunk[start:i])
                start = i
        return [*out, chunk[start:]]

    def table(self, chunk: str) -> list[int]:
        """Exact token count of every prefix of a chunk, from the empty one on."""
        if self.units.issuperset(chunk):
            return self.prefixes.table(chunk)[0]
        out = [0]
        for run in self._runs(chunk):
            if run in self.units or len(run) > 1:
                out += [out[-1] + c for c in self.prefixes.table(run)[0][1:]]
            else:  # no piece: its UTF-8 bytes
                out.append(out[-1] + len(run.encode("utf-8", "surrogatepass")))
        return out

    def chunks(self, text: str) -> list[str]:
        return self._break.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(self.size.__getitem__, self.chunks(text or "")))

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Tokens of text[:i] for every i from 0 to len(text); the empty prefix has none."""
        out, total = [], 0
        for chunk in self.chunks(text or ""):
            table = self.table(chunk)
            out += [total + c for c in table[1:]]
            total += table[-1]
        return np.array([0, *out[1:]] if out else [0])

    def fitting(self, text: str | None, limit: int) -> tuple[int, int]:
        """(tokens of the whole text, characters of its longest prefix within `limit` tokens at every step up to it)."""
        chunks = self.chunks(text or "")
        sizes = list(map(self.size.__getitem__, chunks))
        total = sum(sizes)
        if total <= limit:
            return total, len(text or "")
        ends = np.cumsum(sizes)
        k = int(np.searchsorted(ends, limit, side="right"))
        before = int(ends[k - 1]) if k else 0
        inside = next((i - 1 for i, c in enumerate(self.table(chunks[k])) if before + c > limit), 0)
        return total, max(0, sum(map(len, chunks[:k])) + inside - 1)  # less the dummy prefix


def counter(path: str) -> Counter:
    return hold(("counter", path), lambda: Counter(path))


def count_tokens(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_chars: characters that stay if the text is cut to the limit."""

    name = shipped(documents.sparkSession, path)

    def run(c):
        own = counter(local(name))
        found = [own.fitting(t, limit) for t in c["text"]]
        return {
            "doc_id": c["doc_id"],
            "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in c["text"]],
            "n_tokens": [n for n, _ in found],
            "over_limit": [n > limit for n, _ in found],
            "fit_chars": [k for _, k in found],
        }

    return map_arrow(documents.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
