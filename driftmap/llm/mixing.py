"""Mixing sources to target weights by Pfair scheduling.

Every source's documents, in a seeded random order, are cut into blocks. A source that shall have the share p of the mix
owes its block i between the release time floor(i / p) and the deadline ceil((i + 1) / p), counted in slots of one block.
Earliest deadline first among the released blocks gives every source, at every slot, less than one block more or less
than its share. Shares are exact fractions of the weights over the whole schedule; only if a number of slots is given,
weights are rounded to whole slots of a round of so many. The schedule is made in one pass in one task from one row a source, block by block,
with one heap entry a source (about 2 microseconds a block); the documents themselves are never brought together. Where a source has run out, its slots stay empty and the others keep their proportions: no
document is dropped or repeated.

Edge cases: a null source is a source of its own; rows that agree in id, source and text share one place; an empty table
gives an empty result; other columns pass through, also those named like the added ones; sources without a given weight, weights of zero or less, weights
so small that their last deadline is no 64-bit number, and more than MOST_SOURCES sources raise.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

#: Sources up to which one task makes the schedule; target weights are a configuration.
MOST_SOURCES = 1_000_000
ADDED = ("source_block", "release", "deadline", "slot", "position")


def rounded(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Weights as whole slots of a round, at least one each."""
    total, spare = sum(weights.values()), slots - len(weights)
    exact = {k: spare * w / total for k, w in weights.items()}
    own = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (own[k] - exact[k], str(k)))[: spare - sum(own.values())]:
        own[k] += 1
    return {k: n + 1 for k, n in own.items()}


def whole(weights: dict[str, float]) -> dict[str, int]:
    """The weights as integers in exactly the same proportions."""
    exact = {k: Fraction(w) for k, w in weights.items()}
    unit = math.lcm(*(x.denominator for x in exact.values()))
    return {k: int(x * unit) for k, x in exact.items()}


def schedule(share: dict[str, int], counts: dict[str, int], block: int) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(source, its block, release, deadline, slot, rows in earlier slots) of all blocks, slot after slot."""
    total = sum(share.values())
    waiting = [(0, k, 0) for k in sorted(share)]
    ready: list[tuple[int, str, int, int]] = []
    slot = at = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])  # the slots of sources that have run out
        while waiting and waiting[0][0] <= slot:
            release, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // share[k]), k, i, release))
        deadline, k, i, release = heapq.heappop(ready)
        yield k, i, release, deadline, slot, at
        at += min(block, counts[k] - i * block)
        slot += 1
        if (i + 1) * block < counts[k]:
            heapq.heappush(waiting, ((i + 1) * total // share[k], k, i + 1))


def schedule_table(counts: DataFrame, weights: dict[str, float] | None, power: float, block: int, slots: int | None) -> DataFrame:
    """The schedule as a written table, made batch by batch in one task from counts (__key, n), one row a source."""
    names = ["__key", "source_block", "release", "deadline", "slot", "__at"]

    def run(batches):
        own = {k.as_py(): n.as_py() for b in batches for k, n in zip(*b.columns, strict=True)}
        if not own:
            return
        target = {k: weights[k] if weights is not None else n**power for k, n in own.items()}
        share = rounded(target, max(slots, 16 * len(own))) if slots else whole(target)
        total = sum(share.values())
        if any(-(-n // block) * total // share[k] >= 2**62 for k, n in own.items()):
            raise ValueError("a source's weight is too small for its number of documents")
        blocks = schedule(share, own, block)
        while rows := list(itertools.islice(blocks, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k else pa.string()) for k, c in enumerate(zip(*rows, strict=True))], names=names)

    return written(counts.select("__key", "n").coalesce(1).mapInArrow(run, "__key string, source_block long, release long, deadline long, slot long, __at long"), "schedule")


def key_of(source: str | None) -> str:
    return "" if source is None else f"={source}"


def scheduled(docs: DataFrame, weights: dict[str | None, float] | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text", block: int = 64, slots: int | None = None, power: float = 0.5, seed: int = 17) -> DataFrame:
    """One row per distinct (id, source, text): __id, __source, __hash and source_block, release, deadline, slot, position.

    weights: target weight per source (a configuration); by default the document count to the given power.
    slots: if given, weights are rounded to whole slots of a round of so many (16 a source at least).
    """
    units = docs.select(F.col(doc_id).alias("__id"), F.col(source).alias("__source"), F.xxhash64(F.lit(seed), F.col(text)).alias("__hash")).distinct()
    units = units.withColumns({"__order": F.xxhash64(F.lit(seed), "__id", "__hash"), "__key": F.coalesce(F.concat(F.lit("="), F.col("__source").cast("string")), F.lit(""))})
    units = written(units, "units")
    counts = written(units.groupBy("__key").agg(F.count("*").alias("n")), "counts")
    own = None if weights is None else {key_of(k): w for k, w in weights.items() if w > 0}
    sources, most, without = counts.agg(F.count("*"), F.max("n"), F.count(F.when(~F.col("__key").isin(list(own)), 1)) if own is not None else F.lit(0)).first()
    if sources > MOST_SOURCES:
        raise ValueError(f"the schedule is made in one task for at most {MOST_SOURCES} sources; there are {sources}")
    if without:
        raise ValueError("every source needs a target weight above zero")
    table = schedule_table(counts, own, power, block, slots)
    # Places within a source: rows are dealt by hash to parts, numbered in each, and moved by the parts' running sums. With
    # the square root of the count as their number, neither a part nor the list of a source's parts is large.
    units = units.withColumn("__part", F.pmod("__order", F.lit(max(1, math.isqrt(most or 1)))))
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(units.groupBy("__key", "__part").count().withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count"), "sums")
    inside = Window.partitionBy("__key", "__part").orderBy("__order", "__id", "__hash")
    ranked = units.withColumn("__rank", F.row_number().over(inside) - 1).join(small(sums), ["__key", "__part"])
    rank = F.col("__rank") + F.col("__before")
    ranked = ranked.withColumn("source_block", F.floor(rank / block)).withColumn("__inside", rank % block)
    placed = ranked.join(small(table), ["__key", "source_block"]).withColumn("position", F.col("__at") + F.col("__inside"))
    return placed.select("__id", "__source", "__hash", *ADDED)


def mixed_order(docs: DataFrame, weights: dict[str | None, float] | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17, place: str | None = None, **how) -> DataFrame:
    """docs in the order of the mix: partition after partition, row after row, so files written from it hold the mix.

    place: a column to add with the row's position, as readers of the files may change their order; it replaces one of that name.
    """
    plan = written(scheduled(docs, weights, doc_id, source, text, seed=seed, **how).withColumnRenamed("position", "__position"), "plan")
    kept = [c for c in docs.columns if c != place]
    n = max(1, docs.rdd.getNumPartitions())
    most = plan.agg(F.max("__position")).first()[0] or 0
    df = docs.select(*kept, F.col(doc_id).alias("__own_id"), F.col(source).alias("__own_source"), F.xxhash64(F.lit(seed), F.col(text)).alias("__own_hash"))
    df = df.join(plan.select("__id", "__source", "__hash", "__position").hint("merge"), F.col("__own_id").eqNullSafe(F.col("__id")) & F.col("__own_source").eqNullSafe(F.col("__source")) & (F.col("__own_hash") == F.col("__hash")))
    df = df.withColumn("__p", F.floor(F.col("__position") * n / (most + 1)).cast("int"))
    return df.repartitionById(n, F.col("__p")).sortWithinPartitions("__position", "__own_id").select(*kept, *([F.col("__position").alias(place)] if place else []))
