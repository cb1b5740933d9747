"""Where the operators once did less than the whole job."""

import math
from collections import Counter
from fractions import Fraction

import pytest

from driftmap.llm import bpe, linededup, media, mixing, queries, substring, urls, warc


def verdicts(spark, rows):
    df = urls.judged(spark.createDataFrame(rows, "page_id long, url string, bad boolean"), [], label="bad", words=())
    return {r.page_id: (r.template, r.verdict) for r in df.collect()}


def word(k):
    return "".join(chr(97 + int(c)) for c in f"{k:03}")


def test_new_slugs_inherit_their_siblings_labels(spark):
    rows = [(k, f"http://h.org/{part}/{word(k)}", part == "spam") for k in range(60) for part in ("spam", "news")]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)] + [(1000, "http://h.org/spam/new", None), (1001, "http://h.org/news/new", None), (1002, "http://h.org/other/new", None), (1003, "http://h.org/spam/deep/er", None)]
    got = verdicts(spark, rows)
    assert got[1000] == ("/spam/*", "block") and got[1001] == ("/news/*", "allow") and got[1002][1] == "allow"


def test_sections_do_not_inherit(spark):
    """Few branches with many pages each are no variable segment."""
    rows = [(100 * p + k, f"http://h.org/{part}/{word(k)}", True if part in ("spam", "junk") else None) for p, part in enumerate(("spam", "junk", "news", "blog")) for k in range(60)]
    got = verdicts(spark, rows)
    assert {v for i, (_, v) in got.items() if i >= 200} == {"allow"} and {v for i, (_, v) in got.items() if i < 200} == {"block"}


def test_templates_without_labels_are_not_rejected(spark):
    rows = [(k, f"http://h.org/spam/{k}", True) for k in range(50)] + [(99, "http://clean.org/page", None)]
    assert verdicts(spark, rows)[99][1] == "allow"


def test_segments_below_the_fourth_are_told_apart(spark):
    rows = [(100 * p + k, f"http://h.org/a/b/c/d/{part}/{k}/x", part == "junk") for p, part in enumerate(("junk", "fine")) for k in range(40)]
    got = verdicts(spark, rows + [(900, "http://h.org/" + "/".join("s" * 1 for _ in range(300)), None)])
    assert {v for i, v in got.items() if i < 100} == {("/*/b/c/d/junk/#/x", "block")} and {v for i, v in got.items() if 100 <= i < 900} == {("/*/b/c/d/fine/#/x", "allow")}
    assert got[900][1] == "allow"


def test_unwanted_words_label_urls(spark):
    rows = [(k, f"http://www.win-casino.org/{'abc'[k % 3]}/{k}", None) for k in range(12)] + [(20 + k, f"http://good.org/a/{k}", False) for k in range(12)] + [(40, "http://casinos.org/a/1", None), (41, "http://once.org/Casino", None)]
    df = urls.judged(spark.createDataFrame(rows, "page_id long, url string, bad boolean"), [], label="bad")
    got = {r.page_id: r.verdict for r in df.collect()}
    assert {got[k] for k in range(12)} == {"block"} and {got[k] for k in (*range(20, 32), 40, 41)} == {"allow"}


def test_url_edge_cases(spark):
    rows = [(1, "http://h.org/a/1", True), (1, "http://h.org/a/1", True), (2, "http://h.org/a/1", None), (None, None, None), (3, None, True), (4, "", False), (5, "http://h.org/" + "x" * 100_000, None), (6, "x://" + "y" * 50_000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean").selectExpr("*", "1 AS host", "2 AS verdict", "3 AS template", "4 AS labelled", "5 AS level")
    got = sorted(map(str, urls.judged(df, [("block", "h.org/a/")], label="bad").select("page_id", "rule", "verdict").collect()))
    assert len(got) == 8 and sum("block" in x for x in got) == 3
    assert urls.judged(df.where("page_id > 10"), []).count() == 0


@pytest.mark.parametrize("weights", [None, {f"s{k}": 0.5 if k == 0 else 1e-5 if k == 1 else 0.5 / 18 for k in range(20)}])
def test_mix_keeps_to_the_exact_weights(spark, weights):
    """Less than one block from the target share at every slot, for as long as a source has blocks."""
    rows = [(k, "s0" if k % 3 == 0 else f"s{1 + k % 19}", f"t{k}") for k in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.scheduled(docs, weights, block=1).select("__source", "slot", "source_block", "position").collect()
    counts = Counter(s for _, s, _ in rows)
    w = weights or {s: n**0.5 for s, n in counts.items()}
    total, done = sum(w[s] for s in counts), Counter()
    assert sorted(r.position for r in got) == list(range(20_000)) and len({r.slot for r in got}) == 20_000
    for n, r in enumerate(sorted(got, key=lambda r: r.slot)):
        assert r.position == n and r.source_block == done[r[0]]
        done[r[0]] += 1
        if done[r[0]] < counts[r[0]]:
            assert abs(done[r[0]] - (r.slot + 1) * w[r[0]] / total) < 1 + 1e-6 and abs(done[r[0]] - 1 - r.slot * w[r[0]] / total) < 1 + 1e-6


def plain_schedule(weights, counts, block):
    """Earliest deadline first, slot by slot over all sources, with windows from exact fractions of the weights."""
    share = {s: Fraction(weights[s]) / sum(Fraction(weights[s]) for s in counts) for s in counts}
    blocks, done, out, slot = {s: -(-n // block) for s, n in counts.items()}, Counter(), {}, 0
    while any(done[s] < blocks[s] for s in counts):
        ready = [(math.ceil((done[s] + 1) / share[s]), s) for s in counts if done[s] < blocks[s] and math.floor(done[s] / share[s]) <= slot]
        if ready:
            s = min(ready)[1]
            out[slot] = (s, done[s], math.floor(done[s] / share[s]), math.ceil((done[s] + 1) / share[s]))
            done[s] += 1
        slot += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.7, "b": 0.2999, "c": 0.0001}, {"a": 1e-3, "b": 5.0, "c": 3.0}])
def test_schedule_equals_a_plain_one(spark, weights):
    """Every block's slot, and less than one block from the target weight at every slot while all sources have blocks."""
    counts = {"a": 130, "b": 77, "c": 3}
    docs = spark.createDataFrame([(k, s, f"{s}{k}") for s, n in counts.items() for k in range(n)], "doc_id long, source string, text string")
    got = mixing.scheduled(docs, weights, block=2).select("slot", "__source", "source_block", "release", "deadline").distinct().collect()
    want = plain_schedule(weights, counts, 2)
    assert {r.slot: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    total, done = sum(map(Fraction, weights.values())), Counter()
    for slot in range(max(want) + 1):
        if slot in want:
            done[want[slot][0]] += 1
        for s, n in counts.items():
            if done[s] < -(-n // 2):
                assert abs(done[s] - (slot + 1) * Fraction(weights[s]) / total) < 1


def test_mix_with_clashing_names_and_without_sources(spark):
    docs = spark.createDataFrame([(k, "ab"[k % 2], f"t{k}", k, "x") for k in range(10)] + [(3, "b", "t3", 3, "y"), (None, None, None, 0, "z")], "doc_id long, source string, text string, position long, slot string")
    assert sorted(mixing.mixed_order(docs).columns) == sorted(docs.columns) and mixing.mixed_order(docs).count() == 12
    got = mixing.mixed_order(docs, place="position").collect()
    assert [r.position for r in got] == sorted(r.position for r in got) and len(got) == 12 and {r.position for r in got} == set(range(11))
    with pytest.raises(ValueError):
        mixing.scheduled(docs, {"a": 1.0, "b": 0.0, None: 1.0})


def test_long_documents_with_many_dropped_lines(spark):
    """Time grows with the lines, not with lines times dropped ones; rows of one id keep their own lines."""
    common = [f"common line {k}" for k in range(30_000)]
    rows = [(d, "\n".join(x for k in range(30_000) for x in (common[k], f"own {d} {k}"))) for d in range(3)] + [(3, "x\ncommon line 5\ny"), (3, "common line 5"), (None, "common line 7"), (None, None)]
    df = linededup.deduped(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_lines, r.n_dropped, len(r.kept_text)) for r in df.collect())
    assert [x[:3] for x in got] == [(-1, 1, 0), (-1, 1, 1), (0, 60_000, 30_000), (1, 60_000, 30_000), (2, 60_000, 30_000), (3, 1, 1), (3, 3, 1)]
    assert got[-1][3] == 3 and got[-2][3] == 0


def test_rows_of_one_id_lose_their_own_words(spark):
    run = [f"r{k}" for k in range(25)]
    rows = [(1, " ".join(run)), (2, " ".join(["a", *run, "b"])), (2, " ".join(["c", "d", *run])), (2, "short")]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.deduped(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(1, 25, 0, " ".join(run)): 1, (2, 27, 25, "a b"): 1, (2, 27, 25, "c d"): 1, (2, 1, 0, "short"): 1})


def test_pages_interleave_lines_and_pictures(spark):
    rows = [(1, "one\n\n <two> & three \nfour\nfive"), (2, None), (3, "x"), (4, " \n\t"), (5, "y" * 70_000)]
    got = media.document_media(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {i: [(r.pos, r.kind, r.text or r.caption) for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.pos)] for i, _ in rows}
    assert by[1] == [(0, "text", "one"), (1, "text", "<two> & three"), (2, "image", "30 bytes"), (3, "text", "four"), (4, "text", "five")]
    assert by[2] == [(0, "image", "0 bytes")] and by[3] == [(0, "text", "x"), (1, "image", "1 bytes")] and by[4] == [(0, "image", "3 bytes")]
    assert by[5][0][2] == "y" * 70_000 and all(r.n_items == len(by[r.doc_id]) for r in got) and all((r.payload_sha256 is None) == (r.kind == "text") for r in got)


def test_resolved_with_clashing_names_and_unanswered_references(spark):
    page = "<p>a<img src=k alt=A>b<img src=gone>"
    df = spark.createDataFrame([(1, page, "old", "old", 9, "old")], "id long, html string, text string, ref string, pos int, payload string")
    store = spark.createDataFrame([("k", "bytes")], "digest string, payload string")
    got = sorted((r.pos, r.kind, r.text, r.ref, r.caption, r.payload) for r in media.resolved(media.with_items(df).drop("html"), store).collect())
    assert got == [(0, "text", "a", None, None, None), (1, "image", None, "k", "A", "bytes"), (2, "text", "b", None, None, None), (3, "image", None, "gone", None, None)]


def test_archived_urls(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "http://a/\r\nb: c", "z"), (4, "http://é/ ü", None), (None, "u", "x"), (1, "again", "x")]
    df = warc.packed(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS size"))
    got = Counter((r.page_id, r.url, r.record_type) for r in df.collect())
    assert got == Counter({(1, None, "response"): 1, (1, "again", "response"): 1, (None, "u", "revisit"): 1, (2, "", "response"): 1, (3, "http://a/%0D%0Ab: c", "response"): 1, (4, "http://é/ ü", "response"): 1})


def test_tokens_of_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "a b", 5, "i"), (1, "a b", 6, "j"), (None, None, 7, None), (2, "", 8, "k")]
    df = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids_sha256 string"), queries.tokenizer("byte_bpe_50k.json"))
    assert sorted(r.n_tokens for r in df.collect()) == [0, 0, 2, 2]
