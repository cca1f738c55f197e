"""Words for the sequence models, and how a batch of texts becomes sequences of table rows."""

from __future__ import annotations

import re

import numpy as np

from . import crf
from .common import slices

_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:!?\"'()[]{}|#$%&*-_"
STEP_WORDS = 250_000  #: words of one forward-backward call, unless one text alone has more
TRAINING_CHARACTERS = 200_000  #: longer texts aren't drawn to learn from


def tokens_of(text: str | None) -> list[str]:
    """Tokens between white space."""
    return (text or "").split()


def word_of(token: str) -> str:
    """The token's letters in lower case; empty if it has none."""
    if token.isalpha():
        return token.lower()
    bare = token.strip(_EDGE)
    return bare.lower() if bare.isalpha() else "".join(filter(str.isalpha, token)).lower()


def words_of(text: str | None) -> list[str]:
    return [w for t in tokens_of(text) if (w := word_of(t))]


def token_spans(text: str) -> list[tuple[int, int]]:
    """Offsets of tokens_of(text)."""
    return [m.span() for m in _TOKEN.finditer(text)]


def _coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """tokens_of() of all texts, coded: (tokens of each text, code of each token, token of each code)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.utf8_split_whitespace(pa.array([t or "" for t in texts], type=pa.large_string()))
    flat = parts.flatten()
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    empty = pc.equal(flat, "")  # before leading and after trailing white space
    if pc.any(empty).as_py():
        gone = empty.to_numpy(zero_copy_only=False)
        counts = counts - np.bincount(np.repeat(np.arange(len(counts)), counts)[gone], minlength=len(counts))
        flat = flat.filter(pc.invert(empty))
    coded = flat.dictionary_encode()
    return counts.astype(np.int64), coded.indices.to_numpy(), coded.dictionary.to_pylist()


def marginals_of(table: crf.WordTable, texts: list[str | None]):
    """Yields (index of the text, its token positions that take part, marginals, log partition) for each text with a word.

    Texts go in order of length, so that those that advance together are about as long.
    """
    sizes = [len(t or "") for t in texts]
    order = sorted(range(len(texts)), key=lambda i: -sizes[i])
    for lo, hi in slices([max(1, sizes[i] // 6) for i in order], STEP_WORDS):
        table.trim()
        counts, codes, tokens = _coded([texts[i] for i in order[lo:hi]])
        if not len(codes):
            continue
        rows = table.lookup(tokens, np.bincount(codes, minlength=len(tokens)))[codes]
        kept = np.flatnonzero(rows >= 0)
        if not len(kept):
            continue
        owner = np.repeat(np.arange(len(counts)), counts)[kept]
        lengths = np.bincount(owner, minlength=len(counts))
        some = np.flatnonzero(lengths)
        marginals, log_z = crf.forward_backward(table.model, table.log[rows[kept]], lengths[some])
        first = np.cumsum(counts) - counts
        ends = np.cumsum(lengths[some])
        for j, end, z in zip(some, ends, log_z.tolist()):
            own = slice(end - lengths[j], end)
            yield order[lo + j], kept[own] - first[j], marginals[own], z
