"""Each operator against brute force, a round trip or held-out labels, and its odd inputs."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinarium.llm import common, hnsw, media, minhash, packing, pieces, pii, quality, queries, repeats, urls, wrappers

DOCS = "doc_id long, text string"
ODD = [None, "", " ", "\n", "a", "слово", "😀", "x" * 3000, "один два три четыре пять шесть", "a b c d e f g " * 200, "tail\n" * 400]


def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(len(ODD) + i, t) for i, t in enumerate(ODD)] + [(3, ODD[3])]
    df = spark.createDataFrame(rows, DOCS)
    clash = ["key", "digest", "sketch", "spans", "score", "ids", "n_tokens", "packed", "contexts", "starts", "node", "component", "held_out"]
    return df.withColumns({c: F.lit("x") for c in clash})


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# --- components ---


def components_of(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {x: root(x) for x in parent}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(rng.randrange(2000, 2080), rng.randrange(2000, 2080)) for _ in range(60)] + [(5, 5)]
    got = {r[0]: r[1] for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == components_of([e for e in edges if e[0] != e[1]])
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_word_hashes():
    text = "one two  three\tone\n два one"
    h = common.word_hashes(text.encode())
    words = text.split()
    assert len(h) == len(words) and [h[0] == x for x in h] == [words[0] == w for w in words]
    assert len(common.word_hashes(b"")) == 0 and len(common.shingle_hashes(b"a b")) == 1
    assert len(set(common.shingle_hashes(b"a b c d e f a b c d e").tolist())) == 6


# --- op1 ---


def links_of(rows):
    ok = {i: (lab, np.array(v, float)) for i, v, lab in rows if lab is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    edges, count = [], Counter()
    ids = list(ok)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            (p, x), (q, y) = ok[i], ok[j]
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                edges.append((i, j))
                count[i] += 1
                count[j] += 1
    comp = components_of(edges)
    return {i: (count[i], comp.get(i, i), comp.get(i, i) == i) for i, _, _ in rows}


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + rng.normal(scale=0.05, size=16)).astype("f4").tolist(), i % 2) for i in range(150)]
    rows += [(200 + i, rows[0][1], 0) for i in range(30)]
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [float("nan")] * 16, 0), (304, [float("inf")] + [0.0] * 15, 0), (305, [None] + [1.0] * 15, 0), (306, rows[0][1], None), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r[0]: tuple(r)[1:] for r in hnsw.link_vectors(df.withColumn("node", F.lit(1))).collect()}
    assert got == links_of([(i, [None if c is None else float(np.float32(c)) for c in v] if v else v, lab) for i, v, lab in rows])
    assert hnsw.link_vectors(df.where("1 = 0")).count() == 0


def test_vectors_of_several_shards_and_blocks(spark, monkeypatch):
    """Links and components across many small shards that grow, asked in several blocks, equal brute force."""
    for name, value in (("SHARD", 40), ("SHARDS", 4), ("QUERIES", 150), ("AUDIT", 32), ("SMALL", 16), ("STEP", 32)):
        monkeypatch.setattr(hnsw, name, value)
    rng = np.random.default_rng(23)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[i % 60] + rng.normal(scale=0.09, size=16)).astype("f4").tolist(), int(i % 7 == 0)) for i in range(700)]
    got = {r[0]: tuple(r)[1:] for r in hnsw.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == links_of([(i, [float(np.float32(c)) for c in v], lab) for i, v, lab in rows])


def test_graph_recall():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    x = (centres[rng.integers(0, 40, 3000)] + rng.normal(scale=0.06, size=(3000, 32))).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x)
    beam = hnsw.audited(graph, x[::50], 0.98)
    truth = int((x[:500] @ x.T >= 0.98).sum())
    found = [r.tolist() for r in graph.within(x[:500], 0.98, beam)]
    assert len(found[0]) >= 0.999 * truth
    assert [r.tolist() for r in hnsw.Graph.loaded(x, graph.saved()).within(x[:500], 0.98, beam)] == found
    assert hnsw.Graph(x[:1]).within(x[:1], 0.9, 4)[1].tolist() == [0]


def plant_links(rng, n, d):
    """n vectors, each linked with exactly one other: turned copies of n / 2 random ones."""
    x = rng.normal(size=(n // 2, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.concatenate([x, x + 0.15 / d**0.5 * rng.normal(size=x.shape)])


def test_graphs_answer_and_brute_force_only_audits():
    """24,000 vectors with one link each, in three shards: few queries are compared outright, and nearly no link is missed."""
    rng, found, asked, compared = np.random.default_rng(14), 0, 0, 0
    x = plant_links(rng, 24000, 48)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = int((np.einsum("ij,ij->i", unit[:12000], unit[12000:]) >= 0.98).sum()) * 2
    owner = rng.permutation(24000) % 3
    for s in range(3):
        ids = np.flatnonzero(owner == s)
        shard = hnsw._Shard(hnsw.shard_row(ids.tolist(), [1] * len(ids), x[ids].tolist()), 0.98)
        assert shard.graph is not None and shard.beam >= hnsw.BEAM
        told = shard.ask([{"node": i, "vector": v} for i, v in enumerate(x.tolist())])
        found += sum(links for _, _, links in told)
        asked, compared = asked + len(x), compared + shard.compared
    assert truth > 20000 and compared <= 0.05 * asked and 0.99 * truth <= found <= truth


def test_small_shards_have_no_graph():
    x = np.random.default_rng(3).normal(size=(hnsw.SMALL, 8))
    row = hnsw.shard_row(list(range(len(x))), [1] * len(x), x.tolist())
    assert row["graph"] == b"" and len(hnsw._Shard(row, 0.98).ask([{"node": -1, "vector": x[0].tolist()}])) == 1
    more = hnsw.shard_row(list(range(len(x) + 1)), [1] * (len(x) + 1), [*x.tolist(), x[0].tolist()])
    assert more["graph"] and more["beam"] >= hnsw.BEAM


def test_audit_of_sparse_links():
    """The first queries have no links, each of the later ones has one; no audit of theirs takes place any more."""
    rng = np.random.default_rng(14)
    x = rng.normal(size=(4000, 64))
    shard = hnsw._Shard(hnsw.shard_row(list(range(4000)), [1] * 4000, x.tolist()), 0.98)
    ask = lambda first, vectors: {n: (other, links) for n, other, links in shard.ask([{"node": first + i, "vector": v} for i, v in enumerate(vectors.tolist())])}
    assert set(ask(10000, rng.normal(size=(500, 64))).values()) == {(None, 0)}
    assert shard.audits <= 0
    got = ask(20000, x[:1500] + rng.normal(scale=0.1, size=(1500, 64)))
    assert sum(got[20000 + i] == (i, 1) for i in range(1500)) >= 1498


# --- op2 ---


def test_pieces(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    reference = sentencepiece.SentencePieceProcessor(model_file=pieces.model_file())
    t = pieces.Transducer(pieces.model_file())
    rng = random.Random(6)
    parts = ["a b", "  ", "\n", "é", "Hello World", "▁", "日本", "😀", "<0x41>", "ing", " tion", "xxxxxxx", "?!", "   \t", "<s>", " " * 40]
    for _ in range(1500):
        text = "".join(rng.choice(parts) if rng.random() < 0.6 else chr(rng.randint(32, 0x250)) for _ in range(rng.randint(0, 14)))
        ids = t.encode(text)
        assert ids == reference.encode(text)
        assert "▁" in text or t.decode(ids) == text
    long = "ab,cd" * 5000 + "é" * 3000
    assert t.encode(long) == reference.encode(long) and long not in t.words
    out = by_id(pieces.digest(odd(spark)), "n_tokens", "ids_crc32", "lossless")
    for i, text in enumerate(ODD):
        ids = reference.encode(text or "")
        assert out[i] == out[i + len(ODD)] == (len(ids), zlib.crc32(np.array(ids, "<u4")), True)
    encoded = pieces.decode(pieces.encode(odd(spark)))
    assert all((r["text"] or "") == r["decoded"] for r in encoded.collect())
    assert pieces.digest(odd(spark).where("1 = 0")).count() == 0


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def unigram_file(path, scores):
    """A model file of the unigram kind with byte fallback."""
    field = lambda number, data: varint(number << 3 | 2) + varint(len(data)) + data
    number = lambda number, value: varint(number << 3) + varint(value)
    piece = lambda name, score, kind: field(1, field(1, name.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + number(3, kind))
    made = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3) + b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256)) + b"".join(piece(k, v, 1) for k, v in scores.items())
    made += field(2, number(3, 1) + number(35, 1)) + field(3, field(1, b"identity") + number(3, 1) + number(4, 0) + number(5, 1))
    path.write_bytes(made)
    return str(path)


def segmentations(text, pieces):
    if not text:
        yield []
    for n in range(1, len(text) + 1):
        if n == 1 or text[:n] in pieces:
            for rest in segmentations(text[n:], pieces):
                yield [text[:n], *rest]


def test_shortest_paths_of_real_weights(tmp_path):
    """Invented weights: the least of all segmentations' sums, by enumeration, and the library's ids."""
    rng = random.Random(31)
    scores = {c: -rng.uniform(1, 12) for c in "abc▁"} | {"".join(rng.choices("abc▁", k=rng.randint(2, 5))): -rng.uniform(1, 16) for _ in range(60)}
    path = unigram_file(tmp_path / "m", scores)
    t = pieces.Transducer(path)
    assert not t.merges
    worst = 10 - min(scores.values())
    weigh = lambda parts: sum(-scores.get(p, -worst) for p in parts)
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=path)
    for _ in range(400):
        text = "".join(rng.choices("abc xé", k=rng.randint(1, 9)))
        ids, marked = t.encode(text), "▁" + text.replace(" ", "▁")
        best = min(segmentations(marked, scores), key=weigh)
        want = [i for p in best for i in ([t.ids[p]] if p in t.ids else [t.byte[b] for b in p.encode()])]
        assert ids == want == library.encode(text), text
        assert t.decode(ids) == text


def test_only_one_path_of_a_merging_model_is_finite():
    """By enumeration over the arcs: of all segmentations into pieces that merging makes one has no forbidden neighbours."""
    t, rng = pieces.Transducer(pieces.model_file()), random.Random(32)
    live = {p for p in t.rank if len(p) > 1 and p[1] != "▁" and t.merged(p) == [p]}
    for _ in range(150):
        text = "".join(rng.choices(["the", "ing", "a", "er", "s", "on", "re", "t"], k=rng.randint(1, 4)))[:9]
        finite = [s for s in segmentations(text, live) if all(t.pair(a, b) < pieces.NEVER for a, b in zip(s, s[1:]))]
        assert finite == [t.merged(text)] and t.path(text) == b"".join(t.known[p] for p in finite[0])


# --- op3 ---


def test_urls(spark):
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "b.org/"), ("block", "org/x")]
    listed = ["spam.net/", "org/y"]
    cases = {
        "http://a.com/en/1": ("a.com", "/en/1", "com/en/", "block"), "https://WWW.Example.com/en/77?x#y": ("www.example.com", "/en/77", "example.com/en/7", "allow"),
        "http://acom/en/": ("acom", "/en/", None, "allow"), "http://q.b.org": ("q.b.org", "", None, "allow"), "http://q.b.org/x": ("q.b.org", "/x", "b.org/", "block"), "http://c.org/xx": ("c.org", "/xx", "org/x", "block"),
        "http://m.spam.net/a": ("m.spam.net", "/a", None, "block"), "ftp://c.org/y": ("c.org", "/y", None, "block"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "http://a.com#/en/": ("a.com", "", None, "allow"), "a://b://c.com/en/": ("b:", "//c.com/en/", None, "allow"), "http:///en/": ("", "/en/", None, "allow"), "http://ÄA.com/en/\n": ("Äa.com", "/en/\n", "com/en/", "block"),
        "http://spam.net": ("spam.net", "", None, "block"), "http://u@M.spam.net:80?x": ("u@m.spam.net:80", "", None, "block"), "http://spam.net./": ("spam.net.", "/", None, "block"), "http://c.org:1/y": ("c.org:1", "/y", None, "block"),
        "http://c.org:1/x": ("c.org:1", "/x", None, "allow"), "http://xspam.net/": ("xspam.net", "/", None, "allow"), "http://" + "a." * 20000 + "spam.net/": ("a." * 20000 + "spam.net", "/", None, "block"),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)] * 2, "page_id long, url string").withColumns({"rule": F.lit(1), "key": F.lit("k"), "block": F.lit(2)})
    out = urls.judge(df, urls.entries(spark, rules, listed)).collect()
    assert len(out) == 2 * len(cases)
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases[r["url"]]
    assert urls.judge(df.where("1 = 0"), urls.entries(spark, rules, listed)).count() == 0
    assert {r["verdict"] for r in urls.judge(df, urls.entries(spark, rules, []).where("1 = 0")).collect()} == {"allow"}


def test_filter_is_native_and_passes_all_listed(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".com/")).alias("key"))
    filled = urls.bloom(keys, 128)
    hit = keys.withColumn("block", urls._block("key", 128)).join(filled, "block")
    for i in range(urls.WORDS):
        hit = hit.where(F.col(f"w{i}").bitwiseAND(urls._bit("key", i)) != 0)
    assert hit.count() == 3000
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = urls.judge(df, urls.entries(spark, [("block", "com/")], []))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- op4 ---


def brute(texts, window):
    count = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i] += 1
                gone[i + window] -= 1
        cover = np.cumsum(gone)[: len(t)] > 0
        kept = bytes(b for b, c in zip(t, cover) if not c)
        out.append((len(t), int(cover.sum()), int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [256, 2])
def test_repeats(spark, most):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdéя ") for _ in range(rng.randint(3, 60)))
    shared = [word() * 3 for _ in range(4)]
    texts = ["".join(rng.choice(shared) if rng.random() < 0.5 else word() for _ in range(rng.randint(0, 9))) for _ in range(60)]
    texts += [texts[0], texts[1], "ab" * 300, "q" * 500, "q" * 99, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumns({"key": F.lit(1), "anchor": F.lit(2)})
    units = (replace(repeats.BYTES, window=100), replace(repeats.WORDS, window=9, seed=2))
    got = by_id(repeats.digest(df, units=units, most=most), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_words")
    words = [[w for w in re.split(r"[ \t\n\x0b\f\r]+", t or "") if w] for t in texts]
    assert got == {i: (*x, n) for i, (x, n) in enumerate(zip(brute([(t or "").encode() for t in texts], 100), repeated_words(words, 9), strict=True))}


def repeated_words(lists, window):
    count = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    return [len({i + k for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for k in range(window)}) for w in lists]


def test_long_repeats(spark):
    """Passages of 400 to 2000 bytes, whole or cut, at the full window."""
    rng = random.Random(21)
    text = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    shared = [text(rng.randint(400, 2000)) for _ in range(12)]
    cut = lambda p: p[rng.randint(0, 150) : len(p) - rng.randint(0, 150)]
    texts = [text(rng.randint(0, 300)).join(rng.choice([cut, str])(rng.choice(shared)) for _ in range(rng.randint(1, 3))) + text(rng.randint(0, 500)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    for most in (256, 2):
        assert by_id(repeats.digest(df, most=most), "n_bytes", "n_removed", "n_spans", "kept_sha256") == dict(enumerate(brute([t.encode() for t in texts], 400)))


def test_clean_takes_passages_of_fifty_words_out(spark):
    """Passages of 50 words go from all texts that hold them; those of 49, and texts of their own, stay."""
    rng = random.Random(22)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4))) for _ in range(n))
    long, short = words(50), words(49)
    own = [words(rng.randint(5, 200)) for _ in range(8)]
    texts = [f"{own[0]}\n{long}\n{own[1]}", f"{long} {own[2]}", f"{own[3]} {long}", f"{own[4]} {short} {own[5]}", f"{own[6]} {short}", own[7], None, ""]
    cleaned = [r["text"] for r in repeats.clean(spark.createDataFrame(list(enumerate(texts)), DOCS)).orderBy("doc_id").collect()]
    assert cleaned == [f"{own[0]}\n{own[1]}", own[2], f"{own[3]} ", *texts[3:]]


def test_suffix_arrays():
    rng = random.Random(8)
    for round_ in range(120):
        low = rng.choice([0, 97])
        raw = np.array([rng.randint(low, low + rng.choice([0, 1, 2, 25])) for _ in range(rng.randint(1, 300))], np.uint8 if round_ % 2 else np.uint64)
        order, b = repeats.suffix_array(raw), tuple(raw.tolist())
        assert [b[i:] for i in order] == sorted(b[i:] for i in range(len(b)))
        lcp = repeats.common_prefixes(raw, order, 40)
        for i in range(1, len(b)):
            x, y = b[order[i] :][:40], b[order[i - 1] :][:40]
            n = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            assert lcp[i] == n


def test_equal_windows_beyond_the_depth_of_doubling():
    """Contexts that share more than 512 bytes, and one of other bytes."""
    rng = random.Random(15)
    for _ in range(400):
        text = lambda n: bytes(rng.choice(b"ab ") for _ in range(n))  # noqa: B023, E731
        shared = text(560)
        parts = [text(rng.randint(0, 40)) + shared + text(rng.randint(0, 60)), text(rng.randint(0, 40)) + shared + text(rng.randint(0, 60)), text(700)]
        part, start, group = repeats.equal_windows([np.frombuffer(p, np.uint8) for p in parts])
        windows = [parts[p][s : s + 400] for p, s in zip(part.tolist(), start.tolist())]
        assert len(set(zip(windows, group.tolist()))) == len(set(windows)) == len(set(group.tolist()))


def test_repeats_odd_inputs(spark):
    got = by_id(repeats.digest(odd(spark)), "n_bytes", "n_removed")
    for i, t in enumerate(ODD):
        n = len((t or "").encode())
        assert got[i] == (n, n if n >= 400 else 0)
    cleaned = repeats.clean(odd(spark))
    assert cleaned.columns == odd(spark).columns and cleaned.count() == 2 * len(ODD) + 1
    assert repeats.digest(odd(spark).where("1 = 0")).count() == 0


# --- op5 ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{x:1}}</style><script>var a="</p><p>no</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li><li><a href="/x">{0}</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<{1}><h1>Title {0} &amp; more</h1><p>One <b>two</b>
 three&nbsp;&#233;<br>{0}<p>Second<!-- <p>hidden</p> --> {0}</p><div class="ad">Buy {0}</div><blockquote>Quote</blockquote><section id="comments"><p>nice {0}</p></section></{2}>
<aside>side {0}</aside><form><p>name</p></form><footer>&copy; site</footer></body></html>"""


def test_wrappers(spark):
    pages = [(i, f"http://{h}.com/{i}", PAGE.format(f"w{i}", *tag)) for i, (h, tag) in enumerate([("a", ("article", "article"))] * 6 + [("b", ('div class="post-content"', "div"))] * 6 + [("c", ("main", "main"))])]
    pages += [(50, None, None), (51, "", ""), (52, "http://a.com/", "plain words & so <b>on"), (53, "http://a.com/", "<"), (54, "http://d.com", "<p>" * 300 + "x" * 5000)]
    df = spark.createDataFrame(pages * 2, "page_id long, url string, html string").withColumns({"text": F.lit("old"), "host": F.lit("h"), "wrapper": F.lit(1)})
    out = wrappers.extract(df).collect()
    assert len(out) == 2 * len(pages)
    for r in out:
        i = r["page_id"]
        if i < 50:
            assert r["text"] == f"Title w{i} & more\nOne two three é w{i}\nSecond w{i}\nQuote"
        else:
            assert r["text"] == {50: "", 51: "", 52: "plain words & so on", 53: "<", 54: "x" * 5000}[i]
    assert wrappers.extract(df.where("1 = 0")).count() == 0


SITES = {
    # Article in an element of its own, menus and comments around it by element or name.
    "news": "<body><div id=topNav><a href=/>x{n}</a></div><main><header><h1>{0}</h1><p>{1}</p></header><p>{2}<aside>more {n}</aside><figure><img src=a><figcaption>{3}</figcaption></figure><div class='related-stories'><p>see {n}</div></main><div class=cookieBanner>c</div></body>",
    # No named region: a table of the last century.
    "old": "<table><tr><td><a href=1>a{n}</a><br><a href=2>b</a></td><td><h2>{0}</h2><p>{1}<p>{2}<table><tr><td>{3}</td></tr></table></td></tr></table>",
    # Lists, definitions, quotes and code in a div named like one.
    "wiki": "<nav>m{n}</nav><div class='mw post'><h1>{0}</h1><ul><li>{1}<li>{2}</ul><dl><dt>{3}</dl></div><form><label>f</label></form><div role=contentinfo>i{n}</div>",
    # Roles instead of elements; hidden text and templates.
    "app": "<div role=banner>b{n}</div><div role=main><div><section><h1>{0}</h1></section><section><p>{1}</p><p hidden>h</p><template><p>t</p></template></section></div><blockquote>{2}</blockquote><pre>{3}</pre><ol class=comments><li>k{n}</ol></div><div role=navigation>v</div>",
}


def test_invented_sites(spark):
    """The true text of every page of several sites, some with many pages, one with one."""
    rng = random.Random(24)
    words = lambda: " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(3, 40)))
    pages, truth = [], {}
    for site, count in (("news", 30), ("old", 12), ("wiki", 7), ("app", 1)):
        for n in range(count):
            blocks = [words() for _ in range(4)]
            truth[len(pages)] = "\n".join(blocks)
            pages.append((len(pages), f"https://{site}.example/{n}", SITES[site].format(*(b.replace(" ", rng.choice([" ", "\n", " <i>", "&nbsp;"]), 1) for b in blocks), n=n)))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for parts in (1, 5):  # the wrapper may be aligned in any order
        assert {r["page_id"]: r["text"] for r in wrappers.extract(df.repartition(parts)).collect()} == truth


def test_deep_pages():
    deep = "<div>" * 5000
    assert wrappers.extracted(f"{deep}<nav>menu</nav><p>text</p>", [], []) == "text"
    assert wrappers.extracted(f"<article>{deep}<p>a</p><div class=ad><p>ad{'</div>' * 5001}<p>b</article>", [["article"]], []) == "a\nb"
    assert len(wrappers.blocks("<li><b>" * 50000 + "</x>" * 50000 + "t")[0]) == 1


def extracted_from(pages):
    wrapper = wrappers.tree(pages[0])
    for p in pages[1:]:
        wrapper = wrappers.merged(wrapper, wrappers.tree(p))
    found = wrappers.region(wrapper)
    return [wrappers.extracted(p, *found) for p in pages]


@pytest.mark.parametrize("siblings", [1, 5, 63, 80, 500])
@pytest.mark.parametrize("count", [2, 4, 5, 60])
def test_texts_are_judged_alike_at_any_number(siblings, count):
    """A quote, a byline and a closing note that all pages share stay, a closing line of copyright goes: with any number of siblings and pages."""
    body = lambda i: "".join(f"<p>body {i} {k}</p>" for k in range(siblings))
    html = lambda i: f"<article><h1>t{i}</h1><div class=byline>By A</div>{body(i)}<blockquote>Quote</blockquote><ul><li>z{i}</ul><div class=end>Site</div><div class=fine>&copy; 2024 Site</div></article>"
    want = lambda i: "\n".join([f"t{i}", "By A", *(f"body {i} {k}" for k in range(siblings)), "Quote", f"z{i}", "Site"])
    assert extracted_from([html(i) for i in range(count)]) == [want(i) for i in range(count)]
    # Where no element is named like an article, what all pages share at the edges of the region is the template's.
    plain = lambda i: f"<div class=top>Site</div><div><div class=lead>Lead</div>{body(i)}<blockquote>Quote</blockquote><pre>z{i}</pre><div class=end>End</div></div>"
    want = lambda i: "\n".join([*(f"body {i} {k}" for k in range(siblings)), "Quote", f"z{i}"])
    assert extracted_from([plain(i) for i in range(count)]) == [want(i) for i in range(count)]


def test_texts_of_one_page_or_of_copies_of_one_stay():
    html = "<article><h1>t</h1><p>body</p><div class=fine>&copy; Site</div></article>"
    assert extracted_from([html]) == ["t\nbody\n© Site"] and extracted_from([html] * 7) == ["t\nbody\n© Site"] * 7
    few = lambda i: f"<article><h1>t{i}</h1><p>body {i}</p>{'<blockquote>© Quote</blockquote>' if i < 6 else ''}</article>"
    assert extracted_from([few(i) for i in range(40)]) == [f"t{i}\nbody {i}" + ("\n© Quote" if i < 6 else "") for i in range(40)]


def test_regions_of_any_size_stay():
    """A main element beside a shorter article, a post beside a shorter content: both count; lists of links in either don't."""
    long, short = "long words here " * 40, "short"
    assert extracted_from([f"<main><p>{long}{i}</main><article><p>{short}{i}</article>" for i in range(6)]) == [f"{long}{i}\n{short}{i}" for i in range(6)]
    assert extracted_from([f"<div class=post><p>{long}{i}</div><div class=content><p>{short}{i}</div>" for i in range(6)]) == [f"{long}{i}\n{short}{i}" for i in range(6)]
    assert extracted_from([f"<article><p>{short}{i}</article><article class=teaser><a href=x>{long}{i}</a></article>" for i in range(6)]) == [f"{short}{i}" for i in range(6)]


def test_names_within_an_article_are_evidence_only():
    """Sections whose names articles have, too, stay unless they are mostly links; adverts and comments go by name."""
    for name in ("form", "menu", "rail", "widget", "discussion", "social", "promotion", "notice"):
        page = f"<article><h1>t</h1><section class={name}><p>told in words</p><p><a href=x>link link</a></p></section><div class=ads>buy</div><div class=comments>nice</div></article><div class={name}>outside</div>"
        assert extracted_from([page]) == ["t\ntold in words"], name
    assert extracted_from(["<article><p>t</p></article><div class=feedback><p>nice one</p></div>"]) == ["t"]


def test_wrapper_expressions():
    a, b = (wrappers.tree(f"<article><h1>t{k}</h1>{'<p>x</p>' * n}{tail}</article>") for k, n, tail in ((1, 3, ""), (2, 1, "<ul><li>z</ul>")))
    assert wrappers.expression(wrappers.merged(a, b)) == '<article><h1>#</h1>(<p>#</p>)+(<ul><li>"z"</li></ul>)?</article>'
    many = wrappers.tree("<article>" + "".join(f"<p>x</p><h{1 + k % 5}>y</h{1 + k % 5}><div class='{'abcdefg'[k % 7]}'>z</div>" for k in range(60)) + "</article>")
    assert len(many[wrappers.CHILDREN][0][wrappers.CHILDREN]) <= wrappers.SIBLINGS
    pairs = wrappers.tree("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>")
    assert wrappers.expression(pairs) == "<dl>(<dt>#</dt>)+(<dd>#</dd>)+</dl>"


# --- op6 ---


def shingle_set(text):
    words = re.split("[ \t\n\v\f\r]+", text.strip(" \t\n\v\f\r")) if text.strip(" \t\n\v\f\r") else []
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = []
    for _ in range(25):
        base = make(rng.randint(30, 150))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    passage = make(40)
    texts += [" ".join(passage + make(rng.randint(2, 30))) for _ in range(40)]
    texts += [texts[0], "a b", "a b", "", "", None, " \n"]
    sets = {t: shingle_set(t or "") for t in texts}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t or "", i)
    ids = [(t, i) for t, i in first.items() if sets.get(t, set())]
    edges = [(i, j) for k, (s, i) in enumerate(ids) for t, j in ids[:k] if len(sets[s] & sets[t]) >= 0.8 * len(sets[s] | sets[t])]
    comp = components_of(edges)
    want = {i: (comp.get(first[t or ""], first[t or ""]),) for i, t in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumns({"digest": F.lit(1), "node": F.lit(2)})
    assert by_id(minhash.near_duplicates(df), "class_id") == want
    kept = minhash.first_of_each(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (c,) in want.items() if c == i)
    nameless = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "a b")], DOCS)
    assert sorted(((r["doc_id"] or -1), r["kept"]) for r in minhash.near_duplicates(nameless).collect()) == [(-1, True), (-1, True), (4, True)]
    assert minhash.near_duplicates(odd(spark)).count() == 2 * len(ODD) + 1
    assert minhash.near_duplicates(df.where("1 = 0")).count() == 0


def test_near_duplicates_with_unequal_counts(spark):
    """Copies whose shared lines stand once more in one and 20 times more in the other."""
    rng = random.Random(12)
    pairs = []
    for k in range(80):
        line, rest = [[f"{k}x{rng.randrange(10**6)}" for _ in range(n)] for n in (25, 67)]
        other = list(rest)
        if k % 2:
            other[20] = other[40] = "changed"
        pairs.append((" ".join(rest + 2 * line), " ".join(other + 21 * line)))
    assert all(len(shingle_set(a) & shingle_set(b)) >= 0.8 * len(shingle_set(a) | shingle_set(b)) for a, b in pairs)
    same = list(pairs[0])
    assert len(set(minhash._sketch(same)[-1])) == 1 and len(set(minhash._fine(same)[0])) == 1
    df = spark.createDataFrame([(2 * k + i, t) for k, pair in enumerate(pairs) for i, t in enumerate(pair)], DOCS)
    assert by_id(minhash.near_duplicates(df), "class_id") == {i: (i - i % 2,) for i in range(160)}


def test_one_row_of_each_class_stays(spark):
    rng = random.Random(13)
    base = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(6)]
    near = lambda t: t + " more"
    rows = [(7, base[0]), (7, base[0]), (7, base[0])]  # a repeated row
    rows += [(None, base[1]), (None, base[1]), (None, near(base[1]))]  # nothing but null ids
    rows += [(None, base[2]), (8, near(base[2]))]  # a null id and another
    rows += [(1, base[3]), (9, base[3]), (9, base[4])]  # a copy's id on a text of its own
    rows += [(None, None), (None, "")]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = [(r["doc_id"], r["text"]) for r in minhash.first_of_each(df).collect()]
    nameless = [t for i, t in got if i is None]
    assert len(nameless) == 2 and sum(not t for t in nameless) == 1 and {t for t in nameless if t} <= {base[1], near(base[1])}
    assert sorted((i, t) for i, t in got if i is not None) == sorted([(7, base[0]), (8, near(base[2])), (1, base[3]), (9, base[4])])
    assert minhash.first_of_each(df.where("1 = 0")).count() == 0


def test_sketches_estimate_probability_jaccard():
    rng = np.random.default_rng(10)
    for _ in range(5):
        n = int(rng.integers(20, 200))
        keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        x, y = rng.integers(1, 5, n) * (rng.random(n) < 0.8), rng.integers(1, 5, n) * (rng.random(n) < 0.8)
        exact = sum(1 / np.maximum(x / x[d], y / y[d]).sum() for d in range(n) if x[d] and y[d])
        a, b = minhash.sketches([(keys[x > 0], x[x > 0].astype(float)), (keys[y > 0], y[y > 0].astype(float))], 4096)
        assert abs((a == b).mean() - exact) < 0.04


# --- op7 ---


def test_packing(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = odd(spark).union(spark.createDataFrame([(100 + i, "Some words, more words 123 " * (i * 7)) for i in range(60)] + [(900, "<|endoftext|> x"), (901, "a<|endoftext|><|endoftext|>  b <|endoftext"), (902, "x" * 5000 + "<|endoftext|>" + " y" * 3000)], DOCS).withColumns({c: F.lit("x") for c in odd(spark).columns[2:]})).dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    rows = packing.pack(df.coalesce(1)).collect()
    for i, text in texts.items():
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [0], "<u4")
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in mine) == len(ids)
        at = 0
        for r in mine:
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]])
            at += r["length"]
    windows: dict[int, list] = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at and n > 0
            at += n
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(windows) <= -(-total // 1024) * 1.05 + 1
    assert packing.pack(df.where("1 = 0")).count() == 0


def test_differencing():
    rng = np.random.default_rng(11)
    for _ in range(30):
        sizes, k = rng.integers(1, 100, int(rng.integers(1, 60))), int(rng.integers(1, 12))
        to = packing.difference(sizes, k)
        loads = np.bincount(to, sizes, k)
        assert loads.sum() == sizes.sum() and to.max() < k
        if len(sizes) >= 6 * k:
            assert loads.max() - loads.min() <= 15
        assert np.bincount(packing.windows(sizes, 128), sizes).max() <= 128


# --- op8 ---


def test_media(spark):
    rng = random.Random(12)
    block = "".join(chr(rng.randint(97, 122)) for _ in range(60_000))
    extra = [(100, block), (101, block[:30_000] + "CUT" + block[30_000:]), (102, block * 2), (103, block), (104, "é" * 64), (105, "a" * 64)]
    df = odd(spark).union(spark.createDataFrame(extra, DOCS).withColumns({c: F.lit("x") for c in odd(spark).columns[2:]}))
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    store = media.MediaStore(df)
    out = store.verified()
    got = by_id(out, *names)
    assert out.count() == df.count()
    for i, text in [*enumerate(ODD), *extra]:
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert got[i][:5] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload) + 44)
        assert got[i][5] == hashlib.sha256(media.wav(payload)).hexdigest() and media.samples_of(media.wav(payload)) == payload
    stored = store.chunks.select(F.explode("chunks").alias("c")).agg(F.sum(F.length("c.data")), F.count("*"), F.count_distinct("c.digest")).first()
    assert stored[1] == stored[2] and stored[0] < 220_000  # the long texts share nearly all of their chunks
    assert media.MediaStore(df.where("1 = 0")).verified().count() == 0


def test_chunks_are_local():
    rng = np.random.default_rng(13)
    data = rng.integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    a, b = media.chunks(data), media.chunks(data[:1000] + b"new" + data[1000:])
    assert b"".join(a) == data and len(set(a) & set(b)) >= len(a) - 3
    assert all(media.MIN_CHUNK <= len(c) <= media.MAX_CHUNK for c in a[:-1])


# --- op9 ---

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(s):
        d = digits(s)[::-1]
        return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0

    ok = {
        "email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(s), "phone": lambda s: 8 <= len(digits(s)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok[k](m[0])]


def test_pii_equals_patterns(spark):
    rng = random.Random(14)
    parts = ["a@b.co", "x.y@c-d.e.f", "@", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 ", "+1 (499) 555-6503", "+", " ", "-", "7", "é", "\n", "1" * 20, "http://a.b/c", "account: AB12-34567", "00", "(", ")", "user", "%", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for t in texts:
        assert [s for s in pii.find(t) if s[0] in pii.BASE] == base_spans(t), t
    df = spark.createDataFrame(list(enumerate(texts[:300])) + [(9000, None), (9001, "")], DOCS)
    got = by_id(pii.digest(pii.find_pii(df.withColumn("spans", F.lit(1)))), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")
    for i, t in [*enumerate(texts[:300]), (9000, ""), (9001, "")]:
        found = base_spans(t)
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert got[i][:5] == (*(sum(s[0] == k for s in found) for k in PATTERNS), hashlib.sha256(told.encode()).hexdigest())
        assert set(told.split(",")) - {""} <= set(got[i][5].split(",")) and got[i][6] == len([x for x in got[i][5].split(",") if x])


def test_pii_extra_spans_and_redaction(spark):
    text = 'mail a@b.co now, token = "1eb9c654e721" at 12 Main Street, see https://x.y/z?q=1.'
    assert pii.redacted(text, pii.find(text)) == 'mail [EMAIL] now, token = "[ACCOUNT]" at [ADDRESS], see [URL].'
    for clean in ("no data here 12 34", "a token of thanks", "account of events", "5 + 6"):
        assert pii.redacted(clean, pii.find(clean)) == clean
    big = "1" * 200_000 + "@" + "a." * 100_000 + " " + "x" * 200_000 + "@y"
    assert len(pii.find(big)) <= 2
    out = pii.redact_pii(odd(spark))
    assert out.columns == odd(spark).columns and {r["doc_id"]: r["text"] for r in out.collect()} == {r["doc_id"]: r["text"] for r in odd(spark).collect()}
    assert pii.find_pii(odd(spark).where("1 = 0")).count() == 0


# --- op10 ---


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score_documents(docs, labels)
    told = out.join(labels, "doc_id").where("held_out").select("score", "quality", "predicted").collect()
    good, bad = ([r["score"] for r in told if r["quality"] == q] for q in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in told]) > 0.95
    for r in out.limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out.where("predicted = 1").collect()}


def test_quality_ignores_held_out_labels(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert by_id(quality.score_documents(docs, labels), "score") == by_id(quality.score_documents(docs, turned), "score")


def test_quality_odd_inputs(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = by_id(quality.score_documents(odd(spark), none), "score", "predicted")
    assert set(out.values()) == {(0.5, 0)} and len(out) == 2 * len(ODD)
    one = spark.createDataFrame([(0, 1, None), (0, 1, 0), (1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert set(by_id(quality.score_documents(odd(spark), one), "predicted").values()) <= {(0,), (1,)}
    assert quality.score_documents(odd(spark).where("1 = 0"), none).count() == 0
    assert np.isfinite([quality.statistics(t or "") for t in ODD]).all()


def test_trees_equal_a_walk():
    rng = np.random.default_rng(15)
    x = rng.normal(size=(600, len(quality.NAMES)))
    y = (x[:, 3] + x[:, 7] * x[:, 1] > 0).astype(float)
    t = quality.grow(x, y, rounds=20)
    for row in x[:50]:
        total = t.bias
        for feature, cut, leaf in zip(t.feature, t.cut, t.leaf):
            at = 0
            for _ in range(t.depth):
                at = 2 * at + (2 if row[feature[at]] > cut[at] else 1)
            total += leaf[at - (2**t.depth - 1)]
        assert np.isclose(t.margin(row[None])[0], total)
    assert ((t.score(x) > 0.5) == y).mean() > 0.9


# --- queries and the pipeline ---


def test_queries_run(spark):
    names = sorted(queries.QUERIES)
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in names}) == list(range(1, 14))
    for n in ("op3_url_filter", "op5_wrappers", "op9_pii"):
        assert queries.QUERIES[n](spark, "/root/testdata/sf0.001").count() > 0


def test_oracles(spark):
    import glob
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, sf).toArrow(), con.sql(sql).to_arrow_table()
        columns = sorted(got.column_names)
        rows = lambda t: sorted(zip(*[t[c].to_pylist() for c in columns]), key=repr)
        assert columns == sorted(want.column_names) and rows(got) == rows(want), name


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf), name.replace(" ", "-"))
        assert docs.columns == columns and docs.count() <= before
        kept.append(docs.count())
        before = docs.count()
    assert 0 < kept[1] < kept[0] < 200 and kept[2] == kept[3] == kept[1]
    assert not any(s[0] in pii.BASE for r in docs.collect() for s in pii.find(r["text"]))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in docs.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, last.select("doc_id", "start", "length", "ids_crc32").collect()))
