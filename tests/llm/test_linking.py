"""Near-duplicates, suffix-tree scores, license scans, url filters, tool calls, pipeline: against brute force."""

import hashlib
import json
import math
import os
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import graph, licenses, neardup, reputation, setsketch, suffixtree, toolcalls
from stratalog.llm.common import fold_of

WORD = re.compile("[^ \t-\r]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, k):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_groups(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_rows(seed=0, n=240):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocab) for _ in range(rng.choice([3, 4, 6, 40, 150]))] for _ in range(12)]
    rows = []
    for i in range(n):
        t = list(bases[min(rng.randrange(24), 11)])  # one hot family
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        rows.append((i, " ".join(t).upper() if i % 7 == 0 else "\n".join(t)))
    return rows + [(9001, ""), (9002, None), (9003, " \t"), (None, rows[5][1]), (3, rows[3][1]), (3, rows[3][1]), (9004, "one"), (9005, "ONE")]


def test_near_duplicates(spark):
    for seed, k in ((0, 4), (1, 5)):
        rows = near_rows(seed)
        df = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, fp binary").repartition(3)
        got = neardup.groups(df, k=k).collect()
        assert sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(repr, brute_groups(rows, k)))
        assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)
    one = neardup.one_of_each(df, k=5)
    assert one.columns == df.columns
    want = brute_groups(rows, 5)
    groups = len({c for _, n, c in want if n}) + sum(n == 0 for _, n, _ in want)
    assert one.count() == groups
    assert neardup.groups(df.where("doc_id < 0")).count() == 0


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = near_rows(4)
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(repr, brute_groups(rows, 4)))


def test_sketches():
    rng = np.random.default_rng(0)
    err = []
    for j in (0.3, 0.6, 0.8, 0.95):
        for _ in range(30):
            n = int(rng.integers(50, 600))
            both, each = int(2 * n * j / (1 + j)), int(n * (1 - j) / (1 + j))
            h = np.unique(rng.integers(0, 1 << 63, both + 2 * each + 8).astype(np.uint64))[: both + 2 * each]
            rng.shuffle(h)
            a, b = np.sort(h[: both + each]), np.sort(np.concatenate([h[:both], h[both + each :]]))
            sk = setsketch.sketches([a, b, np.union1d(a, b)])
            assert (setsketch.merge(sk[0], sk[1]) == sk[2]).all()
            true = both / (both + 2 * each)
            est = setsketch.similarity(sk[:1], sk[1:2], np.array([len(a)]), np.array([len(b)]))[0]
            err.append(est - true)
            above, below = (sk[0] > sk[1]).sum(keepdims=True), (sk[0] < sk[1]).sum(keepdims=True)
            for limit in (0.5, 0.7):
                if abs(est - limit) > 0.01:
                    assert setsketch.reaches(limit, above, below, np.array([len(a)]), np.array([len(b)]))[0] == (est > limit)
    assert abs(np.mean(err)) < 0.02 and np.std(err) < 0.06
    assert (setsketch.sketches([np.zeros(0, np.uint64)]) == 0).all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(30)] + [(5, 5), (7, 200)]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for u, v in edges:
        root[find(u)] = find(v)
    assert set(got) == {x for u, v in edges for x in (u, v) if u != v}
    root = {x: r for x, r in root.items() if x in got}
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in root for b in (7, 100, 1000) if b in root)
    assert len(set(got.values())) == len({find(a) for a in root})
    assert graph.components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


def brute_tree(rows):
    """The suffix tree's definition, in dictionaries."""
    E = "\n"
    docs = [(d, WORD.findall(lower(t)) + [E], zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0) for d, t in rows]
    c0, c1, c2 = Counter(), Counter(), Counter()
    for _, w, held in docs:
        if not held:
            for i, x in enumerate(w):
                v = w[i - 1] if i else E
                c0[x] += 1
                c1[v, x] += 1
                if i:
                    c2[w[i - 2] if i > 1 else E, v, x] += 1
    n, kinds = sum(c0.values()), len(c0)
    p0 = lambda x: (c0[x] + 0.1) / (n + 0.1 * (kinds + 1))
    one, two = defaultdict(dict), defaultdict(dict)
    for (v, x), c in c1.items():
        one[v][x] = c
    for (u, v, x), c in c2.items():
        two[u, v][x] = c

    def kept(nexts, total, parent):
        if total < suffixtree.MIN_COUNT:
            return False
        gain = sum(c * math.log((c - 1) / total / parent(x)) for x, c in nexts.items() if c > 1)
        once = sum(c == 1 for c in nexts.values())
        return gain + once * math.log(max(once, 1) / total) >= suffixtree.GAIN and len(nexts) > 0

    D = suffixtree.DISCOUNT
    state1 = {v for v in one if kept(one[v], c0[v], p0)}
    p1 = lambda v, x: (max(one[v].get(x, 0) - D, 0) + D * len(one[v]) * p0(x)) / c0[v] if v in state1 else p0(x)
    state2 = {(u, v) for u, v in two if c0[u] >= suffixtree.MIN_COUNT and kept(two[u, v], c1[u, v], lambda x, v=v: p1(v, x))}
    out = []
    for d, w, held in docs:
        s = b = 0.0
        for i, x in enumerate(w):
            v = w[i - 1] if i else E
            u = (w[i - 2] if i > 1 else E) if i else None
            b += math.log10(p0(x))
            p = p1(v, x)
            if (u, v) in state2:
                p = (max(two[u, v].get(x, 0) - D, 0) + D * len(two[u, v]) * p) / c1[u, v]
            s += math.log10(p)
        out.append((d, held, len(w), sum(c0[x] > 0 for x in w), n, b, s))
    return out, len(state1), len(state2)


def test_suffix_tree(spark, monkeypatch):
    monkeypatch.setattr(suffixtree, "BLOCK", 3000)
    monkeypatch.setattr(suffixtree, "RANGE", 50)
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(30)]
    phrase = [[rng.choice(vocab) for _ in range(6)] for _ in range(5)]
    text = lambda: " ".join(x for _ in range(rng.randint(0, 12)) for x in (rng.choice(phrase) if rng.random() < 0.6 else [rng.choice(vocab)]))
    rows = [(i, text() if i % 9 else text().upper()) for i in range(200)] + [(500, None), (501, ""), (None, text()), (7, "v1 v2"), (7, "v1 v2"), (502, "unseen words here")]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, score double").repartition(3)
    got = suffixtree.score(df, fold_of("doc_id", 10) == 0).collect()
    want, n1, n2 = brute_tree(rows)
    assert n1 > 5 and n2 > 5
    key = lambda r: (repr(r[0]), r[2], round(r[6], 6))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-9) and g[6] == pytest.approx(w[6], abs=1e-9)
    assert suffixtree.score(df.where("doc_id < 0"), F.lit(False)).count() == 0
    none = suffixtree.score(df.where("doc_id = 500"), F.lit(True)).first()
    assert none.train_tokens == 0 and none.n_tokens == 1 and none.n_known == 0


def brute_deep(rows):
    """Scores of a tree of any depth, in dictionaries: one distribution for each suffix of each past."""
    E = "\n"
    docs = [([E, *WORD.findall(lower(t)), E], held) for _, t, held in rows]
    nexts = defaultdict(Counter)
    for w, held in docs:
        if not held:
            for i in range(1, len(w)):
                for k in range(i + 1):
                    nexts[tuple(w[i - k : i])][w[i]] += 1
    c0 = nexts[()]
    n, kinds = sum(c0.values()), len(c0)
    D, state = suffixtree.DISCOUNT, {}

    def p(ctx, x):
        if not ctx:
            return (c0[x] + 0.1) / (n + 0.1 * (kinds + 1))
        c = nexts.get(ctx, {})
        if ctx not in state:
            total, once = sum(c.values()), sum(v == 1 for v in c.values())
            state[ctx] = total >= suffixtree.MIN_COUNT and sum(v * math.log((v - 1) / total / p(ctx[1:], y)) for y, v in c.items() if v > 1) + once * math.log(max(once, 1) / total) >= suffixtree.GAIN
        up = p(ctx[1:], x)
        return (max(c.get(x, 0) - D, 0) + D * len(c) * up) / sum(c.values()) if state[ctx] else up

    return [sum(math.log10(p(tuple(w[:i]), w[i])) for i in range(1, len(w))) for w, _ in docs], Counter(len(c) for c, s in state.items() if s)


def test_deep_contexts(spark, monkeypatch):
    monkeypatch.setattr(suffixtree, "BLOCK", 3000)
    monkeypatch.setattr(suffixtree, "RANGE", 300)
    rng = random.Random(8)
    common = {n: " ".join(f"s{n}x{i}" for i in range(n)) for n in (2, 3, 5, 9, 30)}
    rows = []
    for i in range(300):
        n = rng.choice(list(common))
        side = rng.randrange(2)  # the word after the passage is told by the one before it
        lead = " ".join(rng.choice("pqr") for _ in range(rng.randrange(3)))
        rows.append((i, f"{lead} from{side} {common[n]} to{side if rng.random() < 0.97 else 1 - side} {'la ' * rng.choice([0, 0, 3, 25])}", i % 10 == 0))
    got = {r.doc_id: r.score for r in suffixtree.score(spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(3), F.col("held"), deep=True).collect()}
    want, states = brute_deep(rows)
    assert {4, 6, 10, 31} <= set(states)
    assert [got[i] for i in range(300)] == pytest.approx(want, abs=1e-9)


def test_tree_probabilities_sum_to_one(spark):
    rng = random.Random(3)
    train = [(i, " ".join(rng.choice(["a b c", "a c b", "b b", "c a"]) for _ in range(8)), False) for i in range(60)]
    probe = [(1000, "a b"), (1001, "a b a"), (1002, "a b b"), (1003, "a b c")]
    df = spark.createDataFrame(train + [(i, t, True) for i, t in probe], "doc_id long, text string, held boolean")
    s = {r.doc_id: r.score for r in suffixtree.score(df, F.col("held")).collect() if r.held_out}
    base = spark.createDataFrame(train + [(1, "a", True)], "doc_id long, text string, held boolean")
    assert all(v < 0 for v in s.values()) and base.count() == 61


ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_licenses(spark):
    rng = random.Random(1)
    fill = lambda n: " ".join(rng.choice(["alpha", "beta", "the", "license", "mit", "by"]) for _ in range(n))
    mit = licenses.TEMPLATES[3].text.split()
    gap = mit[:8] + ["oops"] + mit[8:]
    texts = [None, "", "cc by", "CC-BY-NC", "Under the MIT license. " * 3, "under\nthe M\u0130T license", "under the mit licens\u00e9", f"{fill(30)} Apache License, Version 2.0 {fill(9)}", " ".join(gap), " ".join(mit[:7]), "wor\u212a", "Licensed under the GNU General Public License, version 3."]
    texts += [fill(rng.randint(0, 60)) + " " + rng.choice(["under the mit license ", "cc by nc ", "apache license version 2 ", ""]) + fill(3) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, labels string").repartition(3)
    df = df.union(df.where("doc_id = 4")).union(spark.createDataFrame([(None, texts[4], "l")], df.schema))
    got = licenses.labels(df).collect()
    assert len(got) == len(texts) + 2 and sum(r.n_base == 3 and r.doc_id in (4, None) for r in got) == 3
    base = [(t.label, t.text.split()) for t in licenses.TEMPLATES if t.base]
    for r in got:
        w = ALNUM.findall(lower(texts[4 if r.doc_id is None else r.doc_id]))
        places = [(i, label) for label, p in base for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        assert (r.n_words, r.n_base) == (len(w), len(places)), texts[r.doc_id]
        assert r.first_word == min((i for i, _ in places), default=None) and r.last_word == max((i for i, _ in places), default=None)
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    by = {r.doc_id: r for r in got}
    assert by[8].labels == "mit" and by[8].n_base == 0 and 0.8 <= by[8].score < 1 and by[9].labels == ""
    assert by[11].labels == "gpl-3" and by[4].score == 1.0 and by[1].score == 0.0
    assert licenses.labels(df.where("doc_id < 0")).count() == 0


def test_url_filters(spark):
    urls = [None, "", "nothing", "http://", "http://A.Example.COM/en/7", "https://example.com/en/5?x=/en/7", "x://net/de/8", "http://example.net/de/81#t", "http://myexample.net/de/8", "ftp://es.org/es/", "org/es/", "http://u@h.org:80/es", "a\n://b.com/en/", "http://x://y.com/en/"]
    pages = [(i, u, 0.0) for i, u in enumerate(urls)] + [(100 + i, f"http://bad.spam.test/{i}", 0.0) for i in range(40)] + [(200 + i, f"http://good.fine.test/{i}", 0.0) for i in range(40)] + [(300, "http://bad.spam.test/x", 0.0)] * 2
    labels = [(100 + i, 0, 1) for i in range(40)] + [(200 + i, 1, 0) for i in range(40)] + [(4, None, None), (None, 1, 1)]
    p = spark.createDataFrame(pages, "page_id long, url string, bound double")
    got = reputation.judge(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = {r.page_id: r for r in got.collect()}
    assert got.count() == len(pages)
    for i, u in enumerate(urls):
        m = re.search(r"\A.*?://([^/?#]*)([^?#]*)", u or "", re.S)
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(len(h + q), h + q, v) for v, h, q in reputation.RULES if (host == h or host.endswith("." + h)) and path.startswith(q)]
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, max(fits)[1] if fits else None)
        assert rows[i].verdict == (max(fits)[2] if fits else "allow")
    assert all(rows[100 + i].verdict == "block" and rows[200 + i].verdict == "allow" for i in range(40)) and rows[300].verdict == "block"
    empty = reputation.judge(p.where("page_id < 0"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.count() == 0
    assert reputation.judge(p, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("verdict = 'block' AND rule IS NULL").count() == 0


def test_hosts_without_labels(spark):
    seen = [("bad.test", h, 1) for h in range(6)] + [("fine.test", h, 0) for h in range(6)] + [(f"d{i}.evil", 0, 1) for i in range(6)]
    pages = [(i * 50 + j, f"http://h{h}.{d}/{j}") for i, (d, h, _) in enumerate(seen) for j in range(30)]
    labels = [(i * 50 + j, 1, bad) for i, (_, _, bad) in enumerate(seen) for j in range(30)]
    new = {9000: "http://new.bad.test/", 9001: "http://new.fine.test/", 9002: "http://new.other.evil/", 9003: "http://new.other.zone/", 9004: "none"}
    p, k = spark.createDataFrame(pages + list(new.items()), "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = {r.page_id: r for r in reputation.judge(p, k, limit=0.45).collect()}
    assert len(rows) == len(pages) + len(new)
    assert [rows[i].verdict for i in new] == ["block", "allow", "block", "allow", "allow"]
    assert rows[9004].bound is None and rows[9000].bound > 0.45 > rows[9003].bound
    at = {r.host: r for r in reputation.reputation(reputation.outcomes(p, k), hosts=p.select(reputation.host_and_path(F.col("url"))[0].alias("host"))).collect()}
    plain = {r.host: r for r in reputation.reputation(reputation.outcomes(p, k)).collect()}
    assert at["new.bad.test"].n == 0 and all(at[h] == r for h, r in plain.items()) and len(at) == len(plain) + 4


SCHEMAS = {"add": {"x": ("integer", True), "y": ("number", False)}, "say": {"text": ("string", True), "tags": ("array", False), "meta": ("object", False), "loud": ("boolean", False)}, "now": {}}


def test_tool_calls(spark):
    calls = [
        (1, 0, "a", "add", '{"y": 2.5, "x": 1}', None),
        (1, 2, "b", "say", '{"text":"h\\u00e9","meta":{"b":1,"a":[{"d":1,"c":2}]}}', "a"),
        (1, 4, "c", "now", "{}", "b"),
        (1, 5, "d", "add", '{"x": "1"}', "c"),
        (1, 6, "e", "say", "{}", "missing"),
        (1, 7, "f", "say", '{"text": "x", "extra": 1}', None),
        (1, 8, "g", "fly", "{}", None),
        (1, 9, "h", "now", "[1]", None),
        (1, 10, "i", "now", "not json", None),
        (1, 11, "j", "now", None, None),
        (2, 0, "a", "now", "{}", "b"),
        (2, 1, "b", "now", "{}", "a"),
        (2, 2, "c", "now", "{}", "b"),
        (3, 0, "a", "now", "{}", None),
        (3, 1, "a", "now", "{}", None),
        (3, 2, None, "now", "{}", None),
        (None, 0, "a", "now", "{}", None),
    ]
    calls += [(4, i, f"n{i}", "now", "{}", f"n{i - 1}" if i else None) for i in range(40)]
    results = [(1, 1, "a", "3"), (1, 3, "b", "ok"), (1, 3, "b", "ok"), (1, 9, "zz", "?"), (3, 5, "a", "x"), (3, 6, None, "y"), (4, 50, "n39", "last")]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after string")
    r = spark.createDataFrame([(*x, "z") for x in results], "conv_id long, turn long, call_id string, content string, depth string")
    got = toolcalls.link(c.repartition(3), r, SCHEMAS).collect()
    assert len(got) == len(calls) + len(results)
    by = {(x.conv_id, x.call_id, x.turn): x for x in got if x.kind == "call"}
    status = lambda *k: by[k].status
    assert [status(1, x, t) for x, t in (("a", 0), ("b", 2), ("c", 4), ("d", 5), ("e", 6), ("f", 7), ("g", 8), ("h", 9), ("i", 10), ("j", 11))] == ["ok", "ok", "unanswered", "bad_arguments", "bad_arguments", "bad_arguments", "unknown_tool", "bad_json", "bad_json", "bad_json"]
    assert {status(2, x, t) for x, t in (("a", 0), ("b", 1), ("c", 2))} == {"cycle"} and by[2, "a", 0].topo is None
    assert status(3, "a", 0) == status(3, "a", 1) == "duplicate_id" and status(3, None, 2) == "no_id" and status(None, "a", 0) == "no_id"
    assert [by[4, f"n{i}", i].depth for i in range(40)] == list(range(40)) and [by[1, x, t].topo for x, t in (("a", 0), ("b", 2), ("c", 4), ("e", 6))] == [0, 2, 4, 0]
    assert by[1, "a", 0].json == '{"arguments":{"x":1,"y":2.5},"id":"a","name":"add"}'
    assert by[1, "b", 2].json == '{"after":"a","arguments":{"meta":{"a":[{"c":2,"d":1}],"b":1},"text":"hé"},"id":"b","name":"say"}'
    assert json.loads(by[1, "i", 10].json)["arguments"] == "not json"
    res = sorted((x.conv_id, x.call_id or "", x.status, x.topo) for x in got if x.kind == "result")
    assert res == [(1, "a", "ok", 1), (1, "b", "ok", 3), (1, "b", "ok", 3), (1, "zz", "orphan", None), (3, "", "orphan", None), (3, "a", "ambiguous", None), (4, "n39", "ok", 79)]
    assert toolcalls.link(c.where("turn < 0"), r.where("turn < 0"), SCHEMAS).count() == 0


def test_turns_and_messages(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", None), (2, 0, "assistant", "x"), (2, 1, None, "y"), (3, 0, "user", "q"), (3, 0, "user", "q"), (None, 0, "user", "z"), (4, None, "user", "z")]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = toolcalls.link(*toolcalls.from_turns(t), toolcalls.TURN_SCHEMAS)
    rows = {(x.conv_id, x.turn): x for x in got.collect()}
    assert got.count() == len(turns)
    assert [rows[1, i].status for i in range(4)] == ["unanswered", "ok", "ok", "bad_arguments"] and [rows[1, i].topo for i in range(4)] == [0, 2, 3, 4]
    assert rows[2, 0].status == "orphan" and rows[2, 1].status == "unknown_tool" and rows[3, 0].status == "duplicate_id" and rows[None, 0].status == "no_id" and rows[4, None].status == "no_id"
    m = spark.createDataFrame([(1, 0, "assistant", '{"tool_calls":[{"id":"a","name":"now","arguments":{"k":1}}]}'), (1, 1, "tool", '{"tool_call_id":"a","content":"noon"}'), (1, 2, "user", "hi"), (1, 3, "user", None)], "conv_id long, turn long, role string, text string")
    calls, results = toolcalls.from_json(m)
    assert [(x.call_id, json.loads(x.arguments)) for x in calls.collect()] == [("a", {"k": 1})] and [x.content for x in results.collect()] == ["noon"]


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    tokenizers = pytest.importorskip("tokenizers")
    import corpus_pipeline
    from stratalog.llm import bpe, ledger, rulefit
    from stratalog.llm.queries import WORD_BPE

    from .test_decontam import brute as contaminated

    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rules = {r.doc_id for r in ledger.ledger(docs).where(ledger.passes(ledger.CURRENT)).collect()}
    good = {r.doc_id for r in rulefit.score(docs, rulefit.train(docs, labels)).where("predicted = 1").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in rules & good)
    kept = {d for d, _, c in brute_groups(rows, 5) if d == c}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    rows = [r for r in rows if r[0] in kept]
    bad = {r[0] for r in contaminated(rows, bench) if r[2]}
    lib = tokenizers.Tokenizer.from_file(bpe.file_of(WORD_BPE))
    want = {}
    for i, t in rows:
        if i not in bad:
            ids = lib.encode(t, add_special_tokens=False).ids
            want[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, d).collect()}
    assert got == want and 50 < len(want) < 200
    odd = docs.limit(40).select("*", F.lit(1).alias("n_words"), F.lit("x").alias("contaminated"), F.lit(2).alias("node"), F.lit(3).alias("score"), F.lit(4).alias("fp"), F.lit(5).alias("n_lines"), F.lit(6).alias("predicted"))
    blank = [(None, None), (1, ""), (1, ""), (2, "word " * 40000)]
    odd = odd.unionByName(spark.createDataFrame(blank, "doc_id long, text string"), allowMissingColumns=True).cache()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, d)
        assert name == "encoding" or out.columns == odd.columns
        assert out.count() <= odd.count() and stage(spark, odd.where("doc_id < 0"), d).count() == 0


def test_levels_of_hosts(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "u@x.y.com:80": ("y.com", "com"), "10.0.0.1:8": ("10.0.0.1", reputation.ADDRESS), "[::1]": ("[::1]", reputation.ADDRESS), "host": ("host", "host"), "": ("", ""), "1.2.3.com": ("3.com", "com")}
    domain, suffix = reputation.levels(F.col("h"))
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", domain.alias("d"), suffix.alias("s")).collect()
    assert {r.h: (r.d, r.s) for r in got} == hosts


def test_hosts_worse_than_the_mean(spark):
    """By default a host is blocked where its bound is above the mean: a bad host among many good ones, by query and SQL alike."""
    duckdb = pytest.importorskip("duckdb")
    from stratalog.llm.queries import ORACLE

    rng = random.Random(4)
    rate = {f"h{i}.site{i % 7}.{['test', 'co.uk'][i % 2]}": 0.8 if i in (3, 11) else 0.1 for i in range(40)}
    pages = [(i, f"http://{rng.choice(list(rate))}/{i}") for i in range(3000)] + [(9000, "http://new.site3.co.uk/"), (9001, "http://new.other.test/"), (9002, "http://1.2.3.4/x"), (9003, "nothing")]
    host = lambda u: u.split("/")[2]
    labels = [(i, 1, int(rng.random() < rate[host(u)])) for i, u in pages[:3000] if rng.random() < 0.7]
    got = reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).drop("bound").collect()
    blocked = {r.host for r in got if r.verdict == "block" and r.rule is None}
    assert {"h3.site3.co.uk", "h11.site4.co.uk"} <= blocked and len(blocked) <= 4 and len(got) == len(pages)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    con.execute("CREATE TABLE labels(doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    want = con.execute(ORACLE["op8_url_filter"]).fetchall()
    assert sorted(want) == sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got)


def test_near_duplicates_of_shared_ids(spark):
    """Null ids, and one id of many texts, cost no more than unique ids: rows meet by their texts."""
    rng = random.Random(6)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(500)) for _ in range(60)]
    texts = [" ".join(rng.choice(["x", "y", "z"]) + str(rng.randrange(3000)) if rng.random() < 0.01 else w for w in base) for _ in range(1500)]
    took = {}
    for name, ids in (("unique", range(1500)), ("null", [None] * 1500), ("shared", [7] * 1500)):
        df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        t = time.perf_counter()
        got = neardup.groups(df).collect()
        took[name] = time.perf_counter() - t
        assert len(got) == 1500
        if name == "unique":
            assert 0 < sum(r.kept for r in got) < 750
        assert name == "unique" or {r.component_id for r in got} == set(ids)
    assert took["null"] < 3 * took["unique"] + 10 and took["shared"] < 3 * took["unique"] + 10, took


def test_one_of_each_keeps_any_column(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5), (2, "a b c d e f", 6), (3, None, 7)], "doc_id long, text string, __mark long")
    assert sorted(map(tuple, neardup.one_of_each(df).collect())) == [(1, "a b c d e f", 5), (3, None, 7)]


def test_suffix_tree_of_groups(spark, monkeypatch):
    """Sums in a tree of blocks of several levels give the same scores."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)) + " one same end of all", i % 10 == 0) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(2)
    monkeypatch.setattr(suffixtree, "RANGE", 400)
    monkeypatch.setattr(suffixtree, "BLOCK", 1000)
    got = []
    for fan in (512, 2):
        monkeypatch.setattr(suffixtree, "FAN", fan)
        got.append({r.doc_id: r.score for r in suffixtree.score(df, F.col("held")).collect()})
    assert len(suffixtree._levels(7, 3000)) >= 3
    assert got[1] == pytest.approx(got[0], abs=1e-9) and len(got[0]) == 70


def test_growing_places_send_little(monkeypatch):
    """The state of places holds no hash for each, and widths beyond the first that is ruled out are not counted."""
    rng = random.Random(4)
    block = suffixtree.block_of([" ".join(rng.choices("abcdefgh", k=300)).encode() for _ in range(20)], np.zeros(20, bool))
    at = np.flatnonzero(np.arange(len(block.tokens)) % 301 >= 40)
    sums = np.zeros(20)
    grown = suffixtree.Growing((block.words, block.tokens, block.counts, block.held), at, np.where(at % 2, 0.25, 0.5), *[sums] * 3)
    assert sum(len(x) for x in grown.rows(1).column("body").to_pylist()) < len(at)
    every, tried = [grown.n_rows(2, w) for w in suffixtree.WIDTHS], []
    monkeypatch.setattr(suffixtree, "CELLS", 3 * len(at))
    count = grown.n_rows
    monkeypatch.setattr(grown, "n_rows", lambda depth, width: tried.append(width) or count(depth, width))
    found = grown.widths(2)
    fits = [w * n <= suffixtree.CELLS for w, n in zip(suffixtree.WIDTHS, every, strict=True)]
    assert [w * n <= suffixtree.CELLS for w, n in zip(suffixtree.WIDTHS, found, strict=True)] == fits
    assert sum(fits) + 1 == len(tried) < len(every) and found[: len(tried)] == every[: len(tried)]


def test_answers_hold_changed_probabilities_alone():
    rng = np.random.default_rng(5)
    n = 4000
    columns = [rng.integers(1, 1 << 63, n).astype(np.uint64), rng.integers(1, 1 << 63, n).astype(np.uint64), rng.random(n).view(np.uint64), np.ones(n, np.uint64), np.zeros(n, np.uint64), rng.integers(1, 1 << 63, n).astype(np.uint64)]
    (back,) = suffixtree._grow_range([{"tag": 20, "r": 0, "node": 3, "body": suffixtree._pack(*columns)}])
    assert back.num_rows == 1 and len(back.column("body")[0].as_py()) < n


def exchanged(blocks):
    """Rows of blocks (texts, which are held out) with all answers to them, sums, and for each tag how many messages they sent."""
    rows, sums, sent = [], (0.0, 0.0), {}
    for i, (texts, held) in enumerate(blocks):
        b = suffixtree.block_of([t.encode() for t in texts], np.array(held))
        rows.append({"bid": i, "counts": suffixtree._pack(b.counts), "words": suffixtree._pack(suffixtree._steps(b.words)), "tokens": suffixtree._pack(b.tokens), "held": held, "answers": []})
        sums = (sums[0] + float(b.train.sum()), 0.0)
    for i, tags in enumerate(suffixtree._ROUNDS):
        messages = []
        for r in rows:
            b = suffixtree._restore(r, sums, i)
            messages += [m for t in tags for x in suffixtree._messages(t, r["bid"], *b.ask(t), 0) for m in x.to_pylist()]
        known = 0
        for tag in tags:
            mine = [m for m in messages if m["tag"] == tag]
            sent[tag] = len(mine)
            for x in suffixtree._totals(mine) if mine else ():
                for m in x.to_pylist():
                    if m["node"] < 0:
                        known += int(suffixtree._unpack(m["body"])[0][0])
                    else:
                        rows[m["node"]]["answers"].append(m)
        sums = (sums[0], float(known)) if i == 0 else sums
    return rows, sums, sent


def test_contexts_counted_twice_are_known_at_home():
    """A block with a training place of a context that occurs twice asks for no sums, unless a block without one does."""
    texts, other = [f"u{i} v x{i}" for i in range(16)], [" ".join(f"w{i}" for i in range(400))]
    no, n = [False] * 16, 16 * 4
    rows, sums, sent = exchanged([(texts, no), (texts, no), (other, [False])])
    assert sent[suffixtree.TRIPLE] == 2 and sent[suffixtree.PAIR_STATS] == 0
    last = suffixtree._restore(rows[0], sums, 3)
    assert len(last.ctx2) == (last.p2 > last.p1[last.vx2] + 0.1).sum() == 16  # and yet those contexts are states
    whole = exchanged([(texts + texts + other, [*no, *no, False])])
    p = [suffixtree._restore(r, s, 3).places()[0] for rs, s in ((rows, sums), whole[:2]) for r in rs]
    assert p[0] == pytest.approx(p[3][:n]) and p[1] == pytest.approx(p[3][n : 2 * n])
    rows, sums, sent = exchanged([(texts, no), (texts, no), (other, [False]), (texts, [True] * 16)])
    assert sent[suffixtree.PAIR_STATS] == 3
    assert all(suffixtree._restore(rows[i], sums, 3).places()[0] == pytest.approx(p[0]) for i in (0, 1, 3))


def test_growing_states_hold_their_texts():
    """Once places are left in a small part of a block only, its state is read without the block, and asks the same."""
    rng = random.Random(6)
    block = suffixtree.block_of([" ".join(rng.choices("abcdefgh", k=300)).encode() for _ in range(20)], np.arange(20) % 3 == 0)
    at = np.array([301 * t + k for t in (2, 3, 11) for k in range(20, 60)])
    sums = np.arange(20.0)
    grown = suffixtree.Growing((block.words, block.tokens, block.counts, block.held), at, np.where(at % 2, 0.25, 0.5), *[sums] * 3)
    again = suffixtree.Growing.read({"answers": grown.rows(1).to_pylist()})
    assert len(again.tokens) == 180 and len(again.counts) == 20
    for width in (1, 4, 32):
        one, two = grown.ask(3, width, 2), again.ask(3, width, 2)
        assert [grown.message([c[: k + 1] for c in one[1:]]) == again.message([c[: k + 1] for c in two[1:]]) for k in (0, len(one[0]) - 1)] == [True, True]
    third = suffixtree.Growing.read({"answers": again.rows(1).to_pylist()})
    assert (third.totals() == grown.totals()).all() and (third.place == grown.place).all()


def test_deep_scores_of_many_blocks(spark, monkeypatch):
    """Scores do not depend on how texts are dealt to blocks: copies, copies held out, and texts of few places left."""
    rng = random.Random(11)
    words = [f"v{i}" for i in range(30)]
    passage = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(4)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)) + (" " + passage[i % 4] if i % 3 == 0 else ""), i % 10 == 0) for i in range(90)]
    rows += [(900 + i, rows[3 * i][1], i % 2 == 0) for i in range(6)] + [(990, None, False), (991, "", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(2)
    got = []
    for block, keys, fan in ((4 << 20, 1_500_000, 512), (900, 300, 2)):
        monkeypatch.setattr(suffixtree, "BLOCK", block)
        monkeypatch.setattr(suffixtree, "RANGE", keys)
        monkeypatch.setattr(suffixtree, "FAN", fan)
        got.append({r.doc_id: r.score for r in suffixtree.score(df, F.col("held"), deep=True).collect()})
    assert got[1] == pytest.approx(got[0], abs=1e-9) and len(got[0]) == len(rows)
