import random
import re

from stratalog.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench, window=13):
    out = []
    for doc_id, text in docs:
        ws, hit, items = words(text), set(), set()
        for item, t in bench:
            bs = words(t)
            if item is None or not bs:
                continue
            k = min(window, len(bs))
            wins = {tuple(bs[i : i + k]) for i in range(len(bs) - k + 1)}
            for i in range(len(ws) - k + 1):
                if tuple(ws[i : i + k]) in wins:
                    hit.update(range(i, i + k))
                    items.add(str(item))
        out.append((doc_id, len(ws), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=repr)


def fixture(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "C", "été", "x1"] if seed % 2 else [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "."]) for _ in range(n))
    bench = [(i, text(rng.choice([1, 3, 12, 13, 14, 30, 60]) + 4 * (seed % 2))) for i in range(12)]
    bench += [(50, bench[3][1]), (51, None), (52, ""), (53, "..."), (None, text(20))]
    docs = []
    for i in range(60):
        t = text(rng.randint(0, 80))
        if rng.random() < 0.5:
            t += " " + rng.choice(bench[:12])[1] + " " + text(5)
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, "!!!"), (None, bench[5][1]), (3, docs[3][1]), (3, docs[3][1])]
    docs.append((103, " ".join([bench[6][1]] * 200)))
    return docs, bench


def test_matches_brute_force(spark):
    for seed in range(4):
        docs, bench = fixture(seed)
        d = spark.createDataFrame([(*x, "n") for x in docs], "doc_id long, text string, n_words string").repartition(3)
        b = spark.createDataFrame(bench, "item_id long, text string")
        for limit in (1 << 20, 150):  # one block of items, and many
            got = decontam.search(d, b, limit=limit)
            rows = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got.collect()]
            assert sorted(rows, key=repr) == brute(docs, bench), (seed, limit)


def test_spans_cover_hits(spark):
    docs, bench = fixture(2)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for r in decontam.search(d, spark.createDataFrame(bench, "item_id long, text string")).collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_hit
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_longest_match(spark):
    docs, bench = fixture(0)
    got = decontam.longest_matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string"))
    found = {r.item_id: r for r in got.collect()}
    texts = [words(t) for _, t in docs]
    for item, t in bench:
        bs = words(t)
        if item is None or not bs:
            assert str(item) not in found
            continue
        n = 0
        for k in range(len(bs), 0, -1):
            wins = {tuple(bs[i : i + k]) for i in range(len(bs) - k + 1)}
            if any(tuple(ws[i : i + k]) in wins for ws in texts for i in range(len(ws) - k + 1)):
                n = k
                break
        r = found[str(item)]
        assert r.length == n
        at = [w for (d, _), w in zip(docs, texts, strict=True) if str(d) == r.doc_id or (d is None and r.doc_id is None)]
        assert any(w[r.doc_word : r.doc_word + n] == bs[r.item_word : r.item_word + n] for w in at)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.search(none, items).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = decontam.search(one, items).first()
    assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (2, 0, [], False)
    assert decontam.longest_matches(one, items).count() == 0


def test_clashing_names_and_blocks_written_between(spark):
    docs, bench = fixture(1)
    names = "doc_id long, __n string, __items string, __spans string, __text string, c0 string, spans string"
    d = spark.createDataFrame([(i, *"nnnnn", t) for i, t in docs], names)
    b = spark.createDataFrame(bench, "item_id long, text string")
    for limit in (1 << 20, 150):
        got = decontam.search(d, b, text="spans", limit=limit)
        assert got.columns == ["doc_id", "__n", "__items", "__spans", "__text", "c0", "n_words", "n_hit", "items", "spans", "contaminated"]
        rows = got.collect()
        assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows], key=repr) == brute(docs, bench)
        assert all(r["__n"] == r["__text"] == r["c0"] == "n" for r in rows)
