"""Byte-level BPE: encoding by a priority queue of merges over a linked symbol list, decoding by vocabulary strings.

The text is cut at special tokens, then into pieces by the vocabulary's pattern. A piece starts as a doubly linked list
of byte symbols; a heap holds the adjacent pairs that may merge, by rank and then place. A popped entry is stale, and
skipped, if a neighbour has changed since it was pushed. Decoding concatenates the tokens' vocabulary strings. Results
equal the tokenizers library's.

Edge cases: null and empty text give no tokens; a text of any length is encoded whole; repeated rows are encoded each;
an empty table gives an empty result; other columns pass through, columns named like the added ones are replaced.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

#: The pattern of byte-level BPE's pieces, with white space spelled out as Unicode's White_Space.
SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """One vocabulary; pieces seen before are looked up, in a cache of bounded size."""

    def __init__(self, path: str, cache: int = 300_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        self.bytes = [0] * 256
        self.strings = {i: bytes(letters[c] for c in s) for s, i in vocab.items()}
        for c, b in letters.items():
            self.bytes[b] = vocab[c]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.cache: dict[str, bytes] = {}
        self.most = cache

    def merged(self, piece: str) -> bytes:
        """The ids of one piece, as little-endian unsigned 32-bit integers."""
        ids = [self.bytes[b] for b in piece.encode()]
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for k in range(n - 1):
            if (m := self.ranks.get((ids[k], ids[k + 1]))) is not None:
                heap.append((m[0], k, ids[k], ids[k + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = right[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue  # stale: one of the two has merged meanwhile
            ids[k], ids[j] = new, -1
            right[k] = right[j]
            if right[j] >= 0:
                left[right[j]] = k
                if (m := self.ranks.get((new, ids[right[k]]))) is not None:
                    heapq.heappush(heap, (m[0], k, new, ids[right[k]], m[1]))
            if left[k] >= 0 and (m := self.ranks.get((ids[left[k]], new))) is not None:
                heapq.heappush(heap, (m[0], left[k], ids[left[k]], new, m[1]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, in bytes."""
        out = []
        get = self.cache.get
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            for piece in self.pieces.findall(part):
                got = get(piece)
                if got is None:
                    got = self.merged(piece)
                    if len(piece) <= 64:
                        if len(self.cache) >= self.most:
                            self.cache.clear()
                        self.cache[piece] = got
                out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with n_tokens and token_ids (little-endian unsigned 32-bit integers)."""
    docs = docs.drop("n_tokens", "token_ids")

    def make():
        bpe = Bpe(path)

        def run(col):
            ids = [bpe.encode(t or "") for t in col.to_pylist()]
            return [len(x) // 4 for x in ids], ids

        return run

    return add_columns(docs, [text], [("n_tokens", T.LongType()), ("token_ids", T.BinaryType())], make)


def decoded(df: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """df with decoded, the text of its ids (null: empty)."""
    df = df.drop("decoded")

    def make():
        bpe = Bpe(path)
        return lambda col: ([bpe.decode(x or b"") for x in col.to_pylist()],)

    return add_columns(df, [ids], [("decoded", T.StringType())], make)


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with n_tokens and the SHA-256 of ids and decoded text, made in one pass so that neither leaves the task."""
    import hashlib

    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256")

    def make():
        bpe = Bpe(path)

        def run(col):
            rows = []
            for t in col.to_pylist():
                ids = bpe.encode(t or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            return list(zip(*rows, strict=True)) if rows else [[]] * 3

        return run

    return add_columns(docs, [text], [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], make)
