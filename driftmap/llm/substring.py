"""Substring dedup on a de Bruijn graph of token k-mers.

A window is ``window`` consecutive words of one document. Each window names the k-mer in it with the smallest hash (the
leftmost of equals), so windows of equal words name the same k-mer at the same place; only named k-mers, about one in
eight, are edges of the graph. Edges met once cannot lie in repeats. Where all occurrences of an edge go on, over equal
words, to the same next edge, and all of that come from this one, the path does not branch; joins bring these
facts back to the occurrences, and each document's run of such edges is compacted to one span. Every occurrence of a
window inside a span lies in an occurrence of the whole span, so one row stands for all its windows. The other windows
that name repeated edges have a row each. Rows are compared by 128-bit hashes of the words at their source coordinates;
all but the first occurrence, by id and start, are removed.

Edge cases: null and empty texts have no words; texts of less than a window lose nothing; rows that share an id are one
document for "earlier", so equal rows with the same id remove nothing from each other; a null id comes before all
others; an empty table gives an empty result; other columns pass through, columns named like the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Spans, WordHashes, add_columns, mixed, released, tidied, written

KMER = 6
NO_ID = -(2**63)
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F)


class Words:
    """Per task: word hashes, span hashes and the named k-mers of texts."""

    def __init__(self, window: int):
        self.window, self.k = window, min(KMER, window)
        self.hashes, self.one, self.two = WordHashes(), Spans(BASES[0]), Spans(BASES[1])

    def named(self, h: np.ndarray) -> np.ndarray:
        """For each window, the place of the k-mer that it names."""
        starts = np.arange(len(h) - self.k + 1)
        kmers = self.one.of(self.one.sums(h), starts, starts + self.k)
        views = np.lib.stride_tricks.sliding_window_view(kmers, self.window - self.k + 1)
        return views.argmin(1) + np.arange(len(views))


def edges(docs: DataFrame, window: int) -> DataFrame:
    """(__d, __t, pos, h, succ, pred): the named k-mers of each text, with hashes of the words up to the next and from the previous one (0: none)."""
    schema = "__d long, __t long, pos int, h long, succ long, pred long"

    def run(batches):
        w = Words(window)
        for b in batches:
            out = []
            for d, t, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                h = w.hashes.of((text or "").encode())
                if len(h) < window:
                    continue
                at = np.unique(w.named(h))
                sums = w.one.sums(h)
                next_ = w.one.of(sums, at[:-1], at[1:] + w.k) | np.uint64(1)
                none = np.zeros(1, np.uint64)
                own = w.one.of(sums, at, at + w.k)
                out.append((np.full(len(at), d), np.full(len(at), t), at.astype(np.int32), own.view(np.int64), np.concatenate((next_, none)).view(np.int64), np.concatenate((none, next_)).view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["__d", "__t", "pos", "h", "succ", "pred"])

    return docs.mapInArrow(run, schema)


def spans(df: DataFrame, window: int) -> DataFrame:
    """From (__d, __t, text, __at) the rows (a, b, __d, __t, start, size) to compare: spans of unbranched paths, and single windows.

    __at: sorted places of repeated edges, times four, plus 2 if all go on alike and 1 if all come from one edge.
    """
    schema = "a long, b long, __d long, __t long, start int, size int"

    def run(batches):
        w = Words(window)
        for batch in batches:
            out = []
            for d, t, text, places in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                h = w.hashes.of((text or "").encode())
                named = w.named(h)
                flags = np.array(places, np.int64)
                at = flags >> 2
                joined = np.concatenate((((flags[:-1] & 2) > 0) & ((flags[1:] & 1) > 0), [False]))
                tails = np.flatnonzero(~joined)
                heads = np.concatenate(([0], tails[:-1] + 1))
                begin, end = at[heads], at[tails] + w.k
                long = end - begin >= window
                begin, end = begin[long], end[long]
                repeated = np.zeros(len(h), bool)
                repeated[at] = True
                single = repeated[named]
                depth = np.zeros(len(named) + 1, np.int64)
                np.add.at(depth, begin, 1)
                np.add.at(depth, end - window + 1, -1)
                starts = np.flatnonzero(single & (np.cumsum(depth)[:-1] == 0))
                start, stop = np.concatenate((begin, starts)), np.concatenate((end, starts + window))
                a = w.one.of(w.one.sums(h), start, stop)
                b = w.two.of(w.two.sums(mixed(h)), start, stop)
                out.append((a.view(np.int64), b.view(np.int64), np.full(len(start), d), np.full(len(start), t), start.astype(np.int32), (stop - start).astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b", "__d", "__t", "start", "size"])

    return df.select("__d", "__t", "text", "__at").mapInArrow(run, schema)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with the keys of a row: __d, the id, and __t, a 64-bit hash of the text that tells rows of one id apart."""
    return docs.withColumns({"__d": F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), "__t": F.xxhash64(text)})


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """(__d, __t, __cut): for each text that loses words, the array of (start, size) to cut."""
    spark = docs.sparkSession
    own = keyed(docs.select(F.col(doc_id), F.col(text)), doc_id, text).select("__d", "__t", F.col(text).alias("text"))
    met = written(edges(own, window), "edges")
    nodes = met.groupBy("h").agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("succ", "pred") for k, f in (("min", F.min), ("max", F.max))]).where("n > 1")
    sole = lambda c: F.when((F.col(f"min_{c}") == F.col(f"max_{c}")) & (F.col(f"min_{c}") != 0), 1).otherwise(0)
    nodes = written(nodes.select("h", (2 * sole("succ") + sole("pred")).alias("flags")), "nodes")
    tidied(spark)
    places = met.select("h", "__d", "__t", "pos").join(nodes, "h").groupBy("__d", "__t").agg(F.array_sort(F.collect_set(F.col("pos").cast("long") * 4 + F.col("flags"))).alias("__at"))
    places = written(places, "places")
    released(met, nodes)
    tidied(spark)
    rows = written(spans(own.join(places.hint("merge"), ["__d", "__t"]), window), "spans")
    tidied(spark)
    first = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("__d", "start")).alias("first")).where("n > 1").select("a", "b", "first")
    later = rows.join(written(first, "first"), ["a", "b"]).where((F.col("__d") != F.col("first.__d")) | (F.col("start") != F.col("first.start")))
    cut = written(later.groupBy("__d", "__t").agg(F.collect_set(F.struct("start", "size")).alias("__cut")), "cut")
    released(places)
    tidied(spark)
    return cut


def deduped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """docs with n_words, n_removed and kept_text (the kept words joined by one space)."""
    docs = docs.drop("n_words", "n_removed", "kept_text")
    df = keyed(docs, doc_id, text).join(removals(docs, doc_id, text, window).hint("merge"), ["__d", "__t"], "left")

    def make():
        def one(text, cuts):
            words = (text or "").encode().split()
            if not cuts:
                return len(words), 0, b" ".join(words).decode()
            gone = np.zeros(len(words) + 1, np.int64)
            for c in cuts:
                gone[c["start"]] += 1
                gone[c["start"] + c["size"]] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            return len(words), len(words) - len(kept), b" ".join(kept).decode()

        return lambda col, cuts: zip(*map(one, col.to_pylist(), cuts.to_pylist()), strict=True) if len(col) else [[]] * 3

    df = add_columns(df, [text, "__cut"], [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType())], make)
    return df.select(*docs.columns, "n_words", "n_removed", "kept_text")
