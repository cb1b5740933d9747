"""corpus_pipeline.run() and its stages against plain Python: whole sf0.01 documents and edge rows."""

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from driftmap.llm import mixing, queries

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k}" for k in range(200))


def edge_rows():
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, LONG, None, None), (3, LONG, None, None), (4, LONG.upper(), "en", "a"), (5, LONG.replace("w9 ", "v9 "), "en", "b"), (None, LONG + " z", "fr", "b"), (6, "word " * 30_000, "en", "c"), (7, " ".join(f"x{k}" for k in range(60_000)), "de", "c")]
    rows += [(100 + k, "Shared LINE \n" + " ".join(f"t{k}x{j}" for j in range(60)) + "\n\tshared line", "en", "d") for k in range(12)]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


@pytest.fixture(scope="module", params=["edge", "sf"])
def rows(request, spark, sf):
    if request.param == "edge":
        return edge_rows()
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]


def plain_quality(rows):
    def failed(t):
        w = WORDS.findall(t or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if grams[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        return len(w) < 50 or 100 * len(covered) > 50 * len(w)

    fails, by = [failed(r[1]) for r in rows], defaultdict(list)
    for r, f in zip(rows, fails, strict=True):
        if r[3] is not None:
            by[r[3]].append(f)
    total = sum(map(len, by.values()))
    mean = min(max(sum(map(sum, by.values())) / total, 1e-6), 1 - 1e-6)
    rates = [sum(x) / len(x) for x in by.values()]
    center = sum(rates) / len(rates)
    own = max(sum((r - center) ** 2 for r in rates) / len(rates) - mean * (1 - mean) * sum(1 / len(x) for x in by.values()) / len(by), 1e-6)
    weight = min(max(mean * (1 - mean) / own - 1, 1.0), 1e6)
    rejected = {h for h, x in by.items() if (sum(x) + mean * weight) / (len(x) + weight) > 0.8}
    return [r for r, f in zip(rows, fails, strict=True) if not f and r[3] not in rejected]


def plain_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOW)
    seen = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            seen[key(x)].add(r[0])
    common, out = {k for k, ids in seen.items() if k and len(ids) >= 10}, []
    for i, t, lang, s, n in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in common]
        out.append((i, "\n".join(kept), lang, s, len("\n".join(kept))) if len(kept) < len(lines) else (i, t, lang, s, n))
    return out


def plain_near(rows):
    own = []
    for r in rows:
        w = (r[1] or "").translate(LOW)
        w = WORDS.findall(w)
        own.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = {r[0]: r[0] for r in rows if r[0] is not None}
    at, common = defaultdict(list), Counter()
    for k, s in enumerate(own):
        for g in s:
            at[g].append(k)
    for ks in at.values():
        common.update((a, b) for n, b in enumerate(ks) for a in ks[:n])
    links = {(rows[a][0], rows[b][0]) for (a, b), c in common.items() if 100 * c >= 80 * (len(own[a]) + len(own[b]) - c) and rows[a][0] is not None and rows[b][0] is not None}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if up[a] != up[b]:
                up[a] = up[b] = min(up[a], up[b])
                changed = True
    return [r for r in rows if r[0] is None or up[r[0]] == r[0]]


def plain_slots(counts, block=64):
    """(source, block) in the order of earliest deadlines, windows from the square roots of the counts."""
    weights = {s: Fraction(n**0.5) for s, n in counts.items()}
    share = {s: w / sum(weights.values()) for s, w in weights.items()}
    done, order, slot = Counter(), [], 0
    while any(done[s] * block < n for s, n in counts.items()):
        ready = [(math.ceil((done[s] + 1) / share[s]), "" if s is None else "=" + s, s) for s, n in counts.items() if done[s] * block < n and math.floor(done[s] / share[s]) <= slot]
        if ready:
            s = min(ready, key=lambda r: r[:2])[2]
            order.append((s, min(block, counts[s] - done[s] * block)))
            done[s] += 1
        slot += 1
    return order


def test_run_equals_plain_python(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    want = plain_near(plain_lines(plain_quality(rows)))
    t = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    ids = lambda x: t.encode(x or "", add_special_tokens=False).ids
    columns = set(got[0])
    assert {"doc_id", "source", "position"} <= columns
    # Repeated rows share a place, so places count distinct rows.
    distinct = {(i, s, x) for i, x, _, s, _ in want}
    assert sorted({r["position"] for r in got}) == list(range(len(distinct))) and [r["position"] for r in got] == sorted(r["position"] for r in got)
    back = {c for c in columns if isinstance(got[0][c], (bytes, bytearray, list))}.pop()
    raw = lambda r: bytes(r[back]) if isinstance(r[back], (bytes, bytearray)) else b"".join(int(k).to_bytes(4, "little") for k in r[back])
    assert Counter((r["doc_id"], r["source"], raw(r)) for r in got) == Counter((i, s, b"".join(k.to_bytes(4, "little") for k in ids(x))) for i, x, _, s, _ in want)
    places = {}
    for r in got:
        places[r["position"]] = r["source"]
    order = plain_slots(Counter(s for _, s, _ in distinct))
    assert [places[k] for k in range(len(distinct))] == [s for s, n in order for _ in range(n)]


def test_stages_keep_columns_and_bear_empty_tables(spark, tmp_path):
    rows = [(*r, f"extra{k}", k) for k, r in enumerate(edge_rows())]
    docs = spark.createDataFrame(rows, SCHEMA + ", n_words string, kept int").repartition(2)
    for d in (docs, docs.where("doc_id < -5")):
        df = d
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = corpus_pipeline.written(stage(spark, df, str(tmp_path)), name.replace(" ", "-"))
            assert set(d.columns) <= set(df.columns), name
        assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() == df.count()
    assert mixing.mixed_order(docs.where("doc_id < -5"), place="position").count() == 0
