"""Token sequences as length-delimited records with masked checksums, and an offset index for reads in any order.

A record is an 8-byte length, its masked CRC-32C, the payload and its masked CRC-32C, all little-endian. The payload is a
sequence's ids as unsigned 16-bit integers if the vocabulary allows it, else 32-bit. Each data file has an index file
of fixed-width entries (id, offset, length, place of the first token in the file). Documents are dealt to parts by
ranges of their id, one or more files each, so files and records follow the ids; the place of a token in the corpus is
the file's first token plus the entry's.

Edge cases: null and empty text give the end id alone; null ids come first and stay null; rows with the same id follow
each other, ordered by their tokens; an empty table gives no files and an empty result; only the id and the text
are stored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import arrow_rows, shared_dir, written
from .storage import opened, store

#: Fixed values of the record format: the reversed Castagnoli polynomial and the mask's constant.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
INDEX = np.dtype([("has_id", "<u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("first", "<u8")])
CHUNK = 256


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The checksum's byte table, and the four tables that move a checksum over CHUNK zero bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    moved = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    for _ in range(CHUNK):
        moved = (moved >> 8) ^ t[moved & 255]
    return t, moved


def masked_crcs(parts: list[bytes]) -> np.ndarray:
    """The masked CRC-32C of each part.

    Parts are padded at the front with zero bytes to whole chunks: a checksum that starts at 0 does not see them. All
    chunks of all parts advance together byte by byte, then each part's chunks are chained. The usual start value is
    put in by flipping the part's first four bytes; parts of less than four bytes are done one by one.
    """
    t, moved = _tables()
    n = np.array([-(-len(p) // CHUNK) for p in parts], np.int64)
    begin = np.concatenate(([0], np.cumsum(n)))
    data = np.zeros((int(begin[-1]), CHUNK), np.uint8)
    flat = data.reshape(-1)
    out = np.zeros(len(parts), np.uint32)
    for k, p in enumerate(parts):
        if len(p) >= 4:
            at = begin[k + 1] * CHUNK - len(p)
            flat[at : at + len(p)] = np.frombuffer(p, np.uint8)
            flat[at : at + 4] ^= 255
        else:
            c = 0xFFFFFFFF
            for b in p:
                c = (c >> 8) ^ int(t[(c ^ b) & 255])
            out[k] = c
    columns = np.ascontiguousarray(data.T)
    c = np.zeros(len(data), np.uint32)
    for row in columns:
        c = (c >> np.uint32(8)) ^ t[(c ^ row) & 255]
    long = np.array([k for k, p in enumerate(parts) if len(p) >= 4], np.int64)
    order = long[np.argsort(-n[long], kind="stable")]
    own = np.zeros(len(order), np.uint32)
    for step in range(int(n[order[0]]) if len(order) else 0):
        live = int(np.searchsorted(-n[order], -step, "left"))
        x = own[:live]
        x = moved[0][x & 255] ^ moved[1][(x >> 8) & 255] ^ moved[2][(x >> 16) & 255] ^ moved[3][x >> 24]
        own[:live] = x ^ c[begin[order[:live]] + step]
    out[order] = own
    c = ~out
    return ((c >> np.uint32(15)) | (c << np.uint32(17))) + np.uint32(MASK)


class Recent(dict):
    """A cache of two generations: make(key) for unknown keys, and what is used moves from the old generation to this one."""

    def __init__(self, make, old: dict | None = None):
        self.make, self.old = make, old or {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def aged(self, most: int) -> Recent:
        """Itself, or a new generation if there are more than ``most`` entries."""
        if len(self) <= most:
            return self
        self.old = {}
        return Recent(self.make, self)


class WordTokenizer:
    """The tokenizers library over words, each encoded once: its vocabulary here drops white space, so words don't touch each other.

    Most words are letters with some punctuation behind them, which the library's pattern cuts apart and its normalizers
    only lower-case. If the vocabulary is of that kind, new words of this form are cut here, and new parts go to the
    library's model past the normalizers. All other words go through the whole library.
    """

    #: Latin letters whose lower case and composition are themselves single letters, then ASCII punctuation.
    SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")

    def __init__(self, path: str, words: int = 500_000, parts: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = "<u4" if self.library.get_vocab_size(True) > 65_536 else "<u2"
        self.raw = [x.tobytes() for x in np.arange(self.library.get_vocab_size(True), dtype=self.kind)]
        self.model = self.library.model
        self.letters = {b: c for c, b in byte_letters().items()}
        spec = json.loads(self.library.to_str())
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        pattern = steps[0].get("pattern", {}).get("Regex", "") if steps else ""
        self.cuts = r"[\p{L}]+" in pattern.split("|") and {"type": "Lowercase"} in (spec["normalizer"] or {}).get("normalizers", []) and steps[-1]["type"] == "ByteLevel"
        self.most_words, self.most_parts = words, parts
        self.words, self.parts = Recent(self.word), Recent(self.part)

    def whole(self, text: str) -> bytes:
        return b"".join([self.raw[i] for i in self.library.encode(text, add_special_tokens=False).ids])

    def part(self, text: str) -> bytes:
        if not text.isascii():  # byte-level vocabularies spell bytes by letters, those of ASCII by themselves
            text = text.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.raw[t.id] for t in self.model.tokenize(text)])

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        m = self.SIMPLE.fullmatch(text) if self.cuts else None
        if m is None:
            return self.whole(text)
        letters, marks = m.groups()
        ids = self.parts[letters.lower()]
        return ids + self.parts[marks] if marks else ids

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text (in UTF-8) in self.kind, in bytes."""
        out = []
        for t in texts:
            self.words, self.parts = self.words.aged(self.most_words), self.parts.aged(self.most_parts)
            out.append(b"".join(map(self.words.__getitem__, (t or b"").split())))
        return out


@cache
def tokenizer_of(path: str) -> WordTokenizer:
    """One for all tasks that a Python worker runs; its memory is bounded by its caches."""
    return WordTokenizer(path)


def tokenized(docs: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids: each document's tokens and the end id, in the file format's integers."""

    def run(batches):
        t = tokenizer_of(path)
        end = np.array([end_id], t.kind).tobytes()
        for b in batches:
            text, out = b.column(1).cast(pa.binary()), []
            for k in range(0, len(text), 64):
                out += [x + end for x in t.encode(text.slice(k, 64).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    df = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return df.mapInArrow(run, "doc_id long, ids binary")


def write_records(df: DataFrame, folder: str, width: int, file_bytes: int = 32 << 20) -> DataFrame:
    """Writes doc_id and ids to files below folder; returns the manifest: part, file (in the part), data, index, tokens."""
    # df is a written table, so the sampling of the ranges re-reads it and encodes nothing again.
    n = max(1, df.rdd.getNumPartitions())
    df = df.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")

    def run(batches):
        from pyspark import TaskContext

        no = TaskContext.get().partitionId()
        held: list[tuple[int | None, bytes]] = []
        size = files = 0

        def flush():
            entries = np.zeros(len(held), INDEX)
            lengths = [len(x) for _, x in held]
            heads = [struct.pack("<Q", k) for k in lengths]
            bodies = [x for _, x in held]
            crcs = np.concatenate([masked_crcs(x[k : k + 256]) for x in (heads, bodies) for k in range(0, len(held), 256)]).astype("<u4")
            entries["has_id"] = [i is not None for i, _ in held]
            entries["doc_id"] = [i or 0 for i, _ in held]
            entries["length"] = lengths
            entries["offset"] = np.cumsum([0, *[k + 16 for k in lengths[:-1]]])
            entries["first"] = np.cumsum([0, *[k // width for k in lengths[:-1]]])

            def fill(f):
                for k, (_, x) in enumerate(held):
                    f.write(heads[k] + crcs[k].tobytes() + x + crcs[len(held) + k].tobytes())

            data = store(f"{folder}/part-{no:06d}-{files:04d}.rec", fill)
            return pa.RecordBatch.from_pydict({"part": [no], "file": [files], "data": [data], "index": [store(f"{folder}/part-{no:06d}-{files:04d}.idx", lambda f: f.write(entries.tobytes()))], "tokens": [sum(lengths) // width]})

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and size + len(x) > file_bytes:
                    yield flush()
                    held, size, files = [], 0, files + 1
                held.append((i, x))
                size += len(x) + 16
        if held:
            yield flush()

    out = df.select("doc_id", "ids").mapInArrow(run, "part long, file long, data string, index string, tokens long")
    files = written(out, "manifest")
    # One row per file: a running sum gives each file's first token.
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return written(files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).repartition(n), "starts")


def read_records(manifest: DataFrame, width: int) -> DataFrame:
    """doc_id, start, n_tokens, ids (unsigned 32-bit) and their crc32 of every record, read through the index, with both checksums compared."""

    def run(batches):
        for b in batches:
            for data, index, start in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("data", "index", "start")], strict=True):
                with opened(index) as f:
                    entries = np.frombuffer(f.read(), INDEX)
                with opened(data) as f:
                    for k in range(0, len(entries), 256):
                        e = entries[k : k + 256]
                        heads, sums, bodies = [], [], []
                        for at, length in zip(e["offset"].tolist(), e["length"].tolist(), strict=True):
                            f.seek(at)
                            x = f.read(length + 16)
                            heads.append(x[:8])
                            bodies.append(x[12:-4])
                            sums.append((x[8:12], x[-4:]))
                        got = masked_crcs([*heads, *bodies]).astype("<u4").tobytes()
                        if got != b"".join(s[0] for s in sums) + b"".join(s[1] for s in sums):
                            raise ValueError(f"checksum mismatch in {data}")
                        ids = [i if has else None for i, has in zip(e["doc_id"].tolist(), e["has_id"].tolist(), strict=True)]
                        wide = [np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in bodies]
                        columns = [(ids, pa.int64()), (e["first"].astype(np.int64) + start, pa.int64()), ([len(x) // 4 for x in wide], pa.int64()), (wide, pa.binary()), ([zlib.crc32(x) for x in wide], pa.int64())]
                        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in columns], names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    return manifest.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def stored(docs: DataFrame, path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes docs, writes the files and reads them back: doc_id, start, n_tokens, ids (unsigned 32-bit), ids_crc32."""
    from tokenizers import Tokenizer

    width = 4 if Tokenizer.from_file(path).get_vocab_size(True) > 65_536 else 2
    with arrow_rows(docs.sparkSession, 1_000):
        tokens = written(tokenized(docs, path, end_id, doc_id, text), "tokens")
        manifest = write_records(tokens, shared_dir(docs.sparkSession, "records"), width)
    return read_records(manifest, width)
