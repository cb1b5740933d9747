"""Line dedup over levelled sorted runs of line hashes; DataFrame functions only.

A line's key is the line stripped of blanks at both ends, A-Z lower-cased, as two 64-bit hashes. Documents come in
batches. A run holds the keys of some batches, sorted, each with the number of documents that have it. A new batch
merge-anti-joins the runs against keys that are already known to be frequent (they need no more counting) and adds the
rest as a run of level 0; ``fanout`` runs of a level are merged into one of the next level. At the end the runs are
merged once more, and keys of at least ``min_docs`` documents lose all their lines: a join gives each document the places
of its dropped lines.

Edge cases: null or empty text is one empty line; a key shorter than ``min_chars`` never counts; rows with the same id
are one document when documents are counted, and each row loses its lines; an empty table gives an empty result; other
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, released, small, written

ID, ROW = "__doc", "__text"
ADDED = ("n_lines", "n_dropped", "kept_text")


def lower_ascii(c: Column) -> Column:
    """A stand-in for c with A-Z lower-cased that is equal for equal results and only for them.

    The text's UTF-8 bytes are read as Latin-1 and lower-cased. That also moves lead bytes C0-DE to E0-FE, which then are
    followed by too few continuation bytes to be mistaken for others. It is much faster than translate().
    """
    return F.lower(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"))


def line_key(line: Column) -> Column:
    """struct(a, b) of two hashes of the line's key."""
    key = lower_ascii(F.btrim(line, F.lit(BLANKS)))
    return F.struct(F.xxhash64(F.lit(1), key).alias("a"), F.xxhash64(F.lit(2), key).alias("b"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levels of sorted runs (a, b, n): keys and the number of documents that have them."""

    def __init__(self, min_docs: int, fanout: int = 3):
        self.min_docs, self.fanout, self.levels = min_docs, fanout, [[]]

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        df = runs[0]
        for r in runs[1:]:
            df = df.unionByName(r)
        return df.groupBy("a", "b").agg(F.sum("n").alias("n"))

    def add(self, batch: DataFrame) -> None:
        """batch: distinct (ID, a, b)."""
        counts = batch.groupBy("a", "b").agg(F.count("*").alias("n"))
        known = [r.where(F.col("n") >= self.min_docs).select("a", "b") for r in self.runs()]
        for frequent in known:
            counts = counts.join(frequent.hint("merge"), ["a", "b"], "left_anti")
        self.levels[0].append(written(counts.sortWithinPartitions("a", "b"), "run"))
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                old, self.levels[k] = self.levels[k], []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(written(self.merged(old).sortWithinPartitions("a", "b"), "run"))
                released(*old)

    def frequent(self) -> DataFrame:
        return self.merged(self.runs()).where(F.col("n") >= self.min_docs).select("a", "b")


def deduped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text (the other lines joined by newlines)."""
    docs = docs.drop(*ADDED)
    long_enough = F.length(F.btrim("line", F.lit(BLANKS))) >= min_chars
    lines = docs.select(F.col(doc_id).alias(ID), F.xxhash64(text).alias(ROW), F.posexplode(lines_of(F.col(text))).alias("pos", "line")).where(long_enough)
    lines = written(lines.select(ID, ROW, "pos", line_key(F.col("line")).alias("k")).select(ID, ROW, "pos", "k.*", F.pmod(F.xxhash64(ID), F.lit(batches)).cast("int").alias("batch")), "lines")
    runs = LineRuns(min_docs)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k).select(ID, "a", "b").distinct())
    frequent = small(written(runs.frequent(), "frequent"))
    released(*runs.runs())
    drop = written(lines.join(frequent, ["a", "b"]).groupBy(ID, ROW).agg(F.collect_set("pos").alias("__drop")), "drop")
    released(lines)
    df = docs.withColumn("__row", F.xxhash64(text)).join(drop.hint("merge"), docs[doc_id].eqNullSafe(F.col(ID)) & (F.col("__row") == F.col(ROW)), "left").drop(ID, ROW, "__row")
    df = df.withColumn("__lines", lines_of(F.col(text)))
    # Places are told apart by hash sets, so a long document with many dropped lines takes time in proportion to its lines.
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop")), lambda k: F.get("__lines", k))
    kept = F.when(F.col("__drop").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(stay, "\n"))
    return df.withColumns({"n_lines": F.size("__lines").cast("long"), "n_dropped": F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long"), "kept_text": kept}).drop("__drop", "__lines")
