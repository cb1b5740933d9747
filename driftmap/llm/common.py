"""What the operators share: written tables in the cluster's shared folder, Arrow column maps, checked broadcasts."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cut import released, shared_dir, written

__all__ = ["BLANKS", "BROADCAST_ROWS", "Spans", "WordHashes", "add_columns", "arrow_rows", "mixed", "released", "shared_dir", "small", "tidied", "written"]

#: Rows up to which a table counted beforehand is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: The separators of words in every contract: space and the controls 9 to 13. ``bytes.split()`` splits at these and at no others.
BLANKS = " \t\n\x0b\f\r"


def tidied(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans run inside hand Python at most so many rows at once: for long texts, as both sides hold the batches in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (a written table) marked for broadcast if it has at most ``rows`` rows, else as it is: the join then shuffles and AQE splits skewed keys."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def add_columns(df: DataFrame, inputs: list[str], fields: list[tuple[str, T.DataType]], make: Callable[[], Callable]) -> DataFrame:
    """df with more columns, computed batch by batch in Arrow.

    make() runs once per task and returns a function from the input columns (Arrow arrays) to one sequence per field.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(n, t) for n, t in fields])
    kinds = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}[t.simpleString()] for _, t in fields]
    names = [n for n, _ in fields]
    places = [df.columns.index(c) for c in inputs]

    def run(batches):
        f = make()
        for b in batches:
            got = f(*[b.column(k) for k in places])
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(v, k) for v, k in zip(got, kinds, strict=True)]], names=[*b.schema.names, *names])

    return df.mapInArrow(run, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Spans:
    """Hashes of spans of a sequence by prefix sums of a polynomial modulo 2**64, with a base and its inverse powers."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(self.base, m, 2**64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(self.inverse, m, 2**64))))
        return self.up[:n], self.down[:n]

    def sums(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers(len(values))[0], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans [start, end); spans of different lengths differ too."""
        down = self.powers(len(sums))[1]
        return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


class WordHashes:
    """64-bit hashes of a text's words, from its bytes; words are what lies between BLANKS."""

    LONG, PIECE = 200, 1 << 20

    def __init__(self):
        self.spans = Spans(0xD1342543DE82EF95)
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.word = np.ones(256, bool)
        self.word[list(BLANKS.encode())] = False

    def of(self, text: bytes) -> np.ndarray:
        """Long texts are taken in pieces that end at blanks, so that the arrays stay small."""
        if len(text) <= self.PIECE:
            return self.piece(text)
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + self.PIECE)
            while end < len(text) and self.word[text[end]]:
                end += 1
            out.append(self.piece(text[at:end]))
            at = end
        return np.concatenate(out)

    def piece(self, text: bytes) -> np.ndarray:
        x = np.frombuffer(text, np.uint8)
        word = np.zeros(len(x) + 2, bool)
        word[1:-1] = self.word[x]
        edge = np.flatnonzero(word[1:] != word[:-1])
        start, end = edge[::2], edge[1::2]
        h = self.spans.of(self.spans.sums(self.values[x]), start, end)
        # A polynomial is safe for words, but very long strings could be made to collide.
        for k in np.flatnonzero(end - start > self.LONG):
            h[k] = xxhash.xxh3_64_intdigest(text[start[k] : end[k]])
        return h
