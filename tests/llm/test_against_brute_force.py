"""Every operator's query logic against plain Python, on whole sf0.01 tables and on edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from driftmap.llm import bpe, linededup, media, mixing, neardup, quality, queries, records, substring, urls, warc

BYTE, WORD = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("word_bpe_49k.json")
WORDS = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = " ".join(f"w{k}" for k in range(300))
EDGE = [
    (1, None, "a"), (2, "", "a"), (3, "one", None), (4, "x" * 50_000, "a"), (5, BASE, "b"), (6, BASE, "b"), (7, BASE.replace("w7 ", "v7 "), "b"),
    (8, BASE.upper(), "b"), (9, "same line\n" + BASE[:600], "a"), (10, " Same LINE\t\nother\n\n", "a"), (11, "É\x1c\x85\xa0  tab\tnl\r\n <|endoftext|>x<|endoftext|>", "a"),
    (12, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a", "c"), (13, "%%% ### && a|b <x>", "c"), (14, "two words", "c"), (15, "two words", "c"), (15, "two words", "c"),
    *[(100 + k, f"shared boilerplate line number one\nunique {k} text here it is", "d") for k in range(12)],
    (200, "  leading  and trailing  \n\n\n", "d"), (201, "I'm you're 1234 ñandú ÀÉ naïve 漢字かな 🙂🙂 \u2028x\u3000y", "d"), (202, BASE + " " + BASE, "d"),
]


@pytest.fixture(scope="module", params=["edge", "sf"])
def docs(request, spark, sf):
    if request.param == "edge":
        return spark.createDataFrame(EDGE, "doc_id long, text string, source string").repartition(3)
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def test_quality(docs, rows):
    def rules(text):
        text = text or ""
        w = WORDS.findall(text)
        lines, seen, dup = text.split("\n"), set(), 0
        for x in lines:
            dup += bool(x in seen and WORDS.search(x))
            seen.add(x)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)

    want = {(i, *(r := rules(t)), r[0] < 50 or 100 * r[4] > 50 * r[0]) for i, t, _ in rows}
    df = quality.judged(docs)
    got = df.collect()
    assert {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == want
    fails = defaultdict(list)
    for r in got:
        fails[r.source].append(r.base_failed)
    hosts = {h: x for h, x in fails.items() if h is not None}
    total = sum(map(len, hosts.values()))
    mean = sum(map(sum, hosts.values())) / total
    rates = [sum(x) / len(x) for x in hosts.values()]
    spread = sum((r - sum(rates) / len(rates)) ** 2 for r in rates) / len(rates)
    noise = sum(1 / len(x) for x in hosts.values()) / len(hosts)
    weight = min(max(mean * (1 - mean) / max(spread - mean * (1 - mean) * noise, 1e-6) - 1, 1.0), 1e6)
    for r in got:
        if r.source is None:
            assert r.host_rate is None and r.kept == (not r.base_failed)
        else:
            rate = (sum(fails[r.source]) + mean * weight) / (len(fails[r.source]) + weight)
            assert r.host_rate == pytest.approx(rate) and r.kept == (not r.base_failed and rate <= 0.8)


def test_line_dedup(docs, rows):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOW)
    by = defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            by[key(x)].add(i)
    frequent = {k for k, v in by.items() if len(v) >= 10 and k}
    want = Counter()
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in frequent]
        want[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    for batches in (1, 5):
        assert bag(linededup.deduped(docs, batches=batches).select("doc_id", "n_lines", "n_dropped", "kept_text")) == want


def test_bpe(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    want = Counter()
    for i, x, _ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        raw = b"".join(k.to_bytes(4, "little") for k in ids)
        want[(i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert bag(bpe.digests(docs, BYTE).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == want
    back = bpe.decoded(bpe.encoded(docs, BYTE), BYTE)
    assert bag(back.select("doc_id", "decoded")) == Counter((i, x or "") for i, x, _ in rows)


def test_bpe_on_every_letter():
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(BYTE), bpe.Bpe(BYTE)
    letters = [chr(k) for k in range(1, 0x3100) if not 0xD800 <= k < 0xE000]
    differ = [c for c in letters for x in (f"a{c}b", f"a {c} {c}1{c}") if own.encode(x) != b"".join(k.to_bytes(4, "little") for k in t.encode(x, add_special_tokens=False).ids)]
    assert len(differ) <= 0, [hex(ord(c)) for c in differ][:40]


def test_records(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    got = sorted(tuple(r) for r in records.stored(docs, WORD, 1).select("doc_id", "start", "n_tokens", "ids", "ids_crc32").collect())
    want, start = [], 0
    own = sorted((i, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x, _ in rows)
    for i, ids in own:
        raw = b"".join(k.to_bytes(4, "little") for k in ids)
        want.append((i, start, len(ids), raw, zlib.crc32(raw)))
        start += len(ids)
    assert got == sorted(want)


def test_record_checksums():
    def crc(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        c ^= 0xFFFFFFFF
        return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF

    parts = [b"", b"a", b"abc", b"123456789", bytes(range(256)) * 3, b"\0" * 32, b"x" * 255, b"y" * 256, b"z" * 257, bytes(5000)]
    assert records.masked_crcs(parts).tolist() == [crc(p) for p in parts]
    assert records.masked_crcs([]).tolist() == []


def test_mixing(docs, rows):
    df = mixing.scheduled(docs, block=4, slots=64)
    got = [r.asDict() for r in df.collect()]
    units = {(i, s, t) for i, t, s in rows}
    assert len(got) == len(units)
    assert sorted(r["position"] for r in got) == list(range(len(units)))
    counts = Counter(s for _, s, _ in units)
    slots = max(64, 16 * len(counts))
    share = mixing.rounded({"=" + s if s else "": n**0.5 for s, n in counts.items()}, slots)
    done, slot_of = Counter(), {}
    for r in got:
        assert r["release"] <= r["slot"] < r["deadline"]
        assert slot_of.setdefault(r["slot"], (r["__source"], r["source_block"])) == (r["__source"], r["source_block"])
    blocks = Counter(s for s, _ in slot_of.values())
    for t in range(max(slot_of) + 1):
        if t in slot_of:
            done[slot_of[t][0]] += 1
        for s, n in done.items():
            if n < blocks[s]:
                assert abs(n - (t + 1) * share["=" + s if s else ""] / slots) < 1
    order = mixing.mixed_order(docs, block=4, slots=64)
    place = {(r["__id"], r["__source"]): r["position"] for r in got}
    seen = [place[(r.doc_id, r.source)] for r in order.collect()]
    assert seen == sorted(seen) and len(seen) == len(rows)


def test_media(docs, rows):
    got = media.document_media(docs).where("kind = 'image'").collect()
    assert len(got) == len(rows)
    texts = defaultdict(set)
    for i, t, _ in rows:
        texts[i].add(t or "")
    for r in got:
        sha = set()
        for t in texts[r.doc_id]:
            raw = t.encode()
            p = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
            stored = media.to_pixmap(p)
            sha.add((len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), media.feature_of(p), f"{len(raw)} bytes"))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature, r.caption) in sha


def test_substring(docs, rows):
    for window in (20, 5):
        first, places = {}, defaultdict(list)
        for i, t, _ in sorted(rows, key=lambda r: r[0]):
            w = WORDS.findall(t or "")
            for k in range(len(w) - window + 1):
                first.setdefault(tuple(w[k : k + window]), (i, k))
        want = Counter()
        for i, t, _ in rows:
            w = WORDS.findall(t or "")
            gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] != (i, k) for j in range(window)}
            want[(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
        assert bag(substring.deduped(docs, window=window).select("doc_id", "n_words", "n_removed", "kept_text")) == want


def near_brute(rows, n, percent=80):
    own = []
    for i, t, _ in rows:
        w = WORDS.findall((t or "").translate(LOW))
        own.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    up = {i: i for i, _ in own}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    at = defaultdict(list)
    for k, (_, s) in enumerate(own):
        for g in s:
            at[g].append(k)
    common = Counter()
    for ks in at.values():
        for x in range(len(ks)):
            for y in range(x):
                common[ks[y], ks[x]] += 1
    for (x, y), c in common.items():
        if 100 * c >= percent * (len(own[x][1]) + len(own[y][1]) - c):
            a, b = sorted((find(own[x][0]), find(own[y][0])))
            up[b] = a
    return Counter((i, len(s), find(i), find(i) == i) for i, s in own)


@pytest.mark.parametrize("words", [2, 5])
def test_near_dedup(docs, rows, words):
    assert bag(neardup.linked(docs, words=words)) == near_brute(rows, words)


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(50, 60), (60, 70), (99, 99), (80, 70)]
    got = {r.id: r.component for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {50: 50, 60: 50, 70: 50, 80: 50}


def test_urls(spark, sf):
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows += [(-1, None), (-2, "no scheme"), (-3, "http://WWW.Example.COM"), (-4, "HTTP://www.EXAMPLE.com/en/x?a=/fr/"), (-5, "x://net/es/"), (-6, "x://a.net/es"), (-7, "://notexample.com/en/1#a"), (-8, "x://"), (-9, "x://é.org/ñ/" + "9" * 9999)]
    got = urls.judged(spark.createDataFrame(rows, "page_id long, url string"), queries.RULES).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    for i, url in rows:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host) :])[0]
            host = host.translate(LOW)
        best = None
        for act, rule in queries.RULES:
            h, p = rule.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
                best = act, rule
        r = by[i]
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]), url
        assert r.verdict == (best[0] if best else "block" if r.purity >= 0.8 else "allow")


def test_url_templates(spark):
    rows = [(k, f"http://h.org/{part}/{k}", part == "spam", ) for k in range(300) for part in ("spam", "news", "blog")] + [(10_000 + k, f"http://h.org/{p}/{k}", None) for k in range(50) for p in ("spam", "other")]
    df = urls.judged(spark.createDataFrame(rows, "page_id long, url string, bad boolean"), [], label="bad", words=())
    got = {(r.path.split("/")[1], r.template, r.verdict) for r in df.collect()}
    assert got == {("spam", "/spam/#", "block"), ("news", "/news/#", "allow"), ("blog", "/blog/#", "allow"), ("other", "/?/#", "allow")}


def test_warc(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows += [(90_001 + k, f"http://x/{k}", h) for k, h in enumerate([None, "", "same", "same", "é" * 100_000, rows[0][2]])]
    import base64

    def digest(h):
        return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()

    first, many = {}, Counter(h or "" for _, _, h in rows)
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    df = warc.packed(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    want = Counter((i, len((h or "").encode()), digest(h), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in rows)
    assert bag(df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == want
    assert many["same"] == 2 and all(r.payload.decode() == h for r in df.where("record_type = 'response'").collect() for h in [{i: x or "" for i, _, x in rows}[r.page_id]])


def test_zip64_directory(tmp_path):
    import zipfile

    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for k in range(66_000):
            z.writestr(f"m{k}", str(k))
    with open(path, "rb") as f:
        got = warc.members(f, path.stat().st_size)
        at, size = got["m65999"]
        f.seek(at)
        assert len(got) == 66_000 and f.read(size) == b"65999"


def test_html_sequences():
    html = "<p>A &amp; b<figure><img src=x alt=old><figcaption>Cap <b>t</b></figcaption></figure>tail<script>no</script><video src=v></video><img>"
    assert [(i["pos"], i["kind"], i["text"], i["ref"], i["caption"]) for i in media.items_of(html)] == [(0, "text", "A & b", None, None), (1, "image", None, "x", "Cap t"), (2, "text", "tail", None, None), (3, "video", None, "v", None)]
    assert media.items_of(None) == []


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, kept int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (quality.judged(docs), linededup.deduped(docs), bpe.digests(docs, BYTE), records.stored(docs, WORD), mixing.scheduled(docs), mixing.mixed_order(docs), media.document_media(docs), substring.deduped(docs), neardup.linked(docs), neardup.deduped(docs), urls.judged(pages, queries.RULES), warc.packed(pages)):
        assert df.count() == 0


def test_null_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, BASE, "a", 1, 2), (1, BASE, None, 3, 4), (None, None, "a", 5, 6)], "doc_id long, text string, source string, n_words int, n int")
    assert quality.judged(docs).count() == 3
    assert linededup.deduped(docs).count() == 3
    assert sorted((r.n_removed for r in substring.deduped(docs).collect())) == [0, 0, 300]
    assert neardup.linked(docs).where("kept").count() == 3
    assert neardup.deduped(docs).columns == docs.columns
    assert mixing.mixed_order(docs).count() == 3
    assert records.stored(docs, WORD).count() == 3
    assert media.document_media(docs).where("kind = 'image'").count() == 3
