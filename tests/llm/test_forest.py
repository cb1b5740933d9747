"""The LSH forest of op10: what its neighbours alone find, and the cases that its exact join is for."""

import random
from collections import defaultdict

import numpy as np
import pytest

from driftmap.llm import neardup

WORDS = [f"w{k}" for k in range(5000)]


def texts_near(rng, base, n, changes):
    """n texts, each with at most so many words of base changed."""
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randint(0, changes)):
            words[at] = rng.choice(WORDS)
        out.append(" ".join(words))
    return out


def shingle_set(text, n):
    w = text.lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def similar_pairs(rows, n, percent=80):
    own = [(i, shingle_set(t or "", n)) for i, t in rows]
    at = defaultdict(list)
    for k, (_, s) in enumerate(own):
        for g in s:
            at[g].append(k)
    common = defaultdict(int)
    for ks in at.values():
        for y in range(len(ks)):
            for x in range(y):
                common[ks[x], ks[y]] += 1
    return {(own[x][0], own[y][0]) for (x, y), c in common.items() if 100 * c >= percent * (len(own[x][1]) + len(own[y][1]) - c)}


@pytest.mark.parametrize("source", ["sf0.01", "made"])
def test_recall_of_the_forest_alone(spark, sf, source):
    """Before the exact join, at least 0.9 of the similar pairs lie in one component."""
    if source == "made":
        rng = random.Random(5)
        rows = [t for _ in range(40) for t in texts_near(rng, rng.choices(WORDS, k=120), 8, 5)] + texts_near(rng, rng.choices(WORDS, k=100), 200, 4)
        rows = list(enumerate(rows))
    else:
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    _, classes, shared = neardup.prepared(docs, "doc_id", "text", 2)
    found = neardup.forest_rows(classes)
    groups, _ = neardup.grown(found, classes, shared, docs, "doc_id", "text", 2, 80)
    component = {r.id: r.component for r in groups.collect()}
    first = {}
    for i, t in sorted(rows):
        first.setdefault(frozenset(shingle_set(t or "", 2)), i)
    by_class = {i: first[frozenset(shingle_set(t or "", 2))] for i, t in rows}
    pairs = {(by_class[a], by_class[b]) for a, b in similar_pairs(rows, 2)}
    pairs = {(a, b) for a, b in pairs if a != b}
    caught = sum(component.get(a, a) == component.get(b, b) for a, b in pairs)
    assert len(pairs) >= 20 and caught >= 0.9 * len(pairs)
    assert {c for c in component.values()} <= set(component)


def test_crowded_regions_and_frequent_shingles(spark):
    """A template that many documents share is no link; near copies among them are."""
    rng = random.Random(6)
    template = rng.choices(WORDS, k=60)
    rows = [" ".join([*template, *rng.choices(WORDS, k=18)]) for _ in range(400)]
    rows += [t + " " + rng.choice(WORDS) for t in rows[:30]]
    rows = list(enumerate(rows))
    got = {r.id: r.component_id for r in neardup.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), words=2).collect()}
    up = {i: i for i, _ in rows}
    for a, b in sorted(similar_pairs(rows, 2)) * 2:
        up[a] = up[b] = min(up[a], up[b])
    assert got == up and sum(i != c for i, c in got.items()) >= 30


def test_rows_that_share_an_id_are_one_document(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(7, a), (7, b), (3, a + " z"), (9, b + " y"), (11, "other text")]
    got = sorted((r.id, r.component_id, r.kept) for r in neardup.linked(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect())
    assert got == [(3, 3, True), (7, 3, False), (7, 3, False), (9, 3, False), (11, 11, True)]


def test_depth_adapts_to_the_region():
    near = np.concatenate((np.full(20, 5), [2], np.full(200, 6), [3], np.full(100, 8))).astype(np.int8)
    depth = neardup.needed_depth(near)
    assert set(depth[:20]) == {5} and set(depth[21:221]) == {7} and set(depth[222:]) == {8}


def test_common_prefixes():
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**63), 2**63 - 1, 300)
    y = x ^ (rng.integers(1, 256, 300) << (8 * rng.integers(0, 8, 300)))
    want = [next((k for k, (p, q) in enumerate(zip(int(a).to_bytes(8, "big", signed=True), int(b).to_bytes(8, "big", signed=True), strict=True)) if p != q), 8) for a, b in zip(x, y, strict=True)]
    assert neardup.common_prefix(x, y).tolist() == want and neardup.common_prefix(x, x).tolist() == [8] * 300


def test_more_links_join_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (20, 21), (30, 31)]
    groups = neardup.components(spark.createDataFrame(links, "a long, b long"))
    got = {r.id: r.component for r in neardup.joined(groups, spark.createDataFrame([(3, 21), (11, 40), (50, 51), (2, 1)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 21: 1, 10: 10, 11: 10, 40: 10, 30: 30, 31: 30, 50: 50, 51: 50}
