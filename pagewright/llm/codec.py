"""Operator 5, byte-level BPE: a backtracking encoder over Aho-Corasick longest matches, and an offset-table decoder.

Defined results: null text counts as empty: no tokens. The file's added special tokens are taken out of a text first, as
the library does by default. Repeated rows are encoded one by one; null ids stay null; other columns pass by unread; an
empty table gives an empty table. A text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import regex
from pyspark.sql import DataFrame

from .bpe import Backtracking, Merges
from .common import Memo, hold, local, map_arrow, shipped

MEMO_BYTES = 110_000_000  #: of encoded words that a worker keeps
FILE = "byte_bpe_50k.json"
#: Fixed value: the split of byte-level BPE before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Character that stands for a byte in the file -> the byte: printable ones stand for themselves, others follow from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        split = file.get("pre_tokenizer") or {}
        assert file.get("normalizer") is None, "the file has a normaliser"
        assert split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space"), "the file splits texts in another way"
        alphabet = byte_alphabet()
        model = file["model"]
        raw = lambda t: "".join(chr(alphabet[c]) for c in t)
        vocab = {raw(t): i for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        names = [t.encode() for t in self.special]
        size = max([*vocab.values(), *self.special.values()]) + 1
        tokens: list[str | None] = [None] * size
        merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs, rank = {}, {i: -1 for t, i in vocab.items() if len(t) == 1}
        for k, (a, b) in enumerate(merged):
            a, b = raw(a), raw(b)
            pairs[vocab[a], vocab[b]] = vocab[a + b]
            rank.setdefault(vocab[a + b], k)
        for t, i in vocab.items():
            if i in rank:
                tokens[i] = t
        self.encoder = Backtracking(Merges(tokens, rank, pairs))
        spelled = [b""] * size
        for t, i in vocab.items():
            spelled[i] = t.encode("latin-1")
        for name, i in zip(names, self.special.values()):
            spelled[i] = name
        self.lengths = np.array([len(t) for t in spelled], dtype=np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.words = Memo(self._word, MEMO_BYTES)
        self._split = regex.compile(PATTERN)
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _word(self, word: str) -> bytes:
        return np.array(self.encoder.encode(word.encode("utf-8", "surrogatepass").decode("latin-1")), dtype="<u4").tobytes()

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if self._special is not None and any(s in text for s in self.special):
            return b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if p in self.special else self._plain(p) for p in self._special.split(text) if p)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self._split.findall(text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, gathered by the offset table; bytes that are no UTF-8 become replacement characters."""
        lengths = self.lengths[ids]
        place = np.repeat(self.offsets[ids] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        out = self.bytes[place].tobytes()
        try:
            out.decode("utf-8")
            return out
        except UnicodeDecodeError:
            return out.decode("utf-8", "replace").encode()

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, dtype=np.int64)).decode()


def codec(path: str) -> Codec:
    return hold(("codec", path), lambda: Codec(path))


def round_trip(documents: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; `keep` carries other columns."""
    keep = keep or []
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", `{c}` {kinds[c]}" for c in keep)

    name = shipped(documents.sparkSession, path)

    def run(c):
        own = codec(local(name))
        out: dict = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in c["text"]:
            ids = own.encode_bytes(text)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(own.decode_bytes(np.frombuffer(ids, dtype="<u4"))).hexdigest())
        return out | {"doc_id": c["doc_id"]}

    return map_arrow(documents.select("doc_id", "text", *keep), run, schema, keep)


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """All columns of documents and `ids`, an array of token ids: for writing a tokenised corpus."""
    from pyspark.sql import functions as F, types as T

    name = shipped(documents.sparkSession, path)

    def ids(batches):
        import pandas as pd

        own = codec(local(name))
        for texts in batches:
            yield pd.Series([own.encode(t) for t in texts])

    return documents.withColumn("ids", F.pandas_udf(ids, T.ArrayType(T.IntegerType()), F.PandasUDFType.SCALAR_ITER)("text"))
