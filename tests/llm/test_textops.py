"""Ledger, rule ensemble, word pieces, BPE: against brute force and the tokenizer library."""

import hashlib
import os
import random
import re
import struct

import numpy as np
import pytest

from stratalog.llm import bpe, ledger, rulefit, textstats, wordpiece
from stratalog.llm.queries import BYTE_BPE, WORD_BPE

WORD = re.compile("[^ \t-\r]+")
TEXTS = ["", None, " \n\t", "a", "a b c d e f g h " * 5, "x\n\nx\nx \n  \ny", "é ü # $ <>|", "\x1c\x1d \x85  x", "w " * 5000, "one two\nthree " * 30]


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    wins = {}
    for i in range(len(w) - 7):
        wins.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {p for at in wins.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(set(w)), len(lines))


def random_texts(n=60):
    rng = random.Random(3)
    return ["".join(rng.choice(["a", "b", "ab ", " ", "\n", "#", "é", "|", "c d e f g h i j ", "\t"]) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def test_statistics(spark):
    texts = TEXTS + random_texts()
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").repartition(3)
    got = {r.doc_id: r for r in textstats.with_stats(df, keep=("doc_id",)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_distinct, r.n_lines) == brute(t), t
    assert textstats.with_stats(df.where("doc_id < 0"), keep=("doc_id",)).count() == 0


def test_ledger_policies_and_ablation(spark):
    texts = TEXTS + random_texts() + ["good words here stand in a row and are not repeated at all so that they may pass every rule there is"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    led = ledger.ledger(df).withColumn("base", ledger.passes(ledger.BASE)).withColumn("now", ledger.passes(ledger.CURRENT)).cache()
    rows = led.collect()
    for r in rows:
        failed = [x.name for i, x in enumerate(ledger.RULES) if r.fail_bits >> i & 1]
        assert r.base == (not set(failed) & set(ledger.POLICIES[1])) and r.now == (not set(failed) & set(ledger.POLICIES[2]))
        assert (not r.base) == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert sum(r.now for r in rows) >= 2
    for a in ledger.ablation(led, ledger.CURRENT).collect():
        bit = 1 << [x.name for x in ledger.RULES].index(a.rule)
        assert a.n_broken == sum(bool(r.fail_bits & bit) for r in rows)
        assert a.n_alone == sum(r.fail_bits & ledger.mask(ledger.CURRENT) == bit for r in rows)


def test_rule_ensemble(spark):
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(rulefit.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.4) | (x[:, 5] > 0.9)).astype(float)
    model = rulefit.fit(x[:2000], y[:2000])
    assert 0 < len(model.rules) < 200
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[2000:]], ", ".join(f"{n} double" for n in rulefit.FEATURES))
    p = np.array([r[0] for r in df.select(model.column()).collect()])
    assert ((p >= 0.5) == (y[2000:] > 0)).mean() > 0.97 and ((p >= 0) & (p <= 1)).all()
    assert rulefit.fit(x[:0], y[:0]).rules == () and rulefit.fit(x[:9], y[:9] * 0).rules == ()


def test_classifier_on_tables(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    from stratalog.llm.queries import QUERIES

    got = QUERIES["op2_quality_classifier"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97
    assert spark.read.parquet(f"{d}/documents.parquet").count() == QUERIES["op2_quality_classifier"](spark, d).count()
    empty = spark.createDataFrame([(1, None), (None, ""), (1, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert rulefit.score(empty, rulefit.train(empty, labels)).where("score BETWEEN 0 AND 1").count() == 3


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    if not os.path.exists(bpe.file_of(WORD_BPE)):
        pytest.skip("no tokenizer files here")
    lib = tokenizers.Tokenizer.from_file(bpe.file_of(WORD_BPE))
    rng = random.Random(1)
    alphabet = list("aAbB'sStTreRE ve  ll\n\t\x0b\x1c\x1d\x85\xa0 é́ΣσςİIıſ数学字1²½٣६!?<|>#_—​‍\U0001f600ﬁǅ﻿\x00ßẞ")
    alphabet += ["<|startoftext|>", "<|endoftext|>", "aaaa", "Σ ", "ΑΣ", "the ", "ing"]
    texts = [None, "", "a" * 3000, "lalala " * 400] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, ids long").repartition(3)
    plain = {r.doc_id: r for r in bpe.encode(df, WORD_BPE).collect()}
    digests = {r.doc_id: r for r in bpe.encode(df, WORD_BPE, digest=True).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, WORD_BPE), WORD_BPE).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert plain[i].ids == ids and plain[i].n_tokens == len(ids), t
        assert back[i] == text
        assert digests[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(df.where("doc_id < 0"), WORD_BPE).count() == 0


def greedy(word, initial, inner):
    n = i = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in (inner if i else initial)), None)
        if j is None:
            return wordpiece.UNKNOWN
        n, i = n + 1, j
    return n


def test_longest_match():
    rng = random.Random(2)
    for _ in range(200):
        piece = lambda: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5)))
        initial, inner = {piece() for _ in range(6)}, {piece() for _ in range(6)}
        m = wordpiece.LongestMatch(initial, inner)
        for _ in range(60):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
            assert m.count(w) == greedy(w, initial, inner), (w, initial, inner)


def test_token_counts(spark):
    if not os.path.exists(bpe.file_of(BYTE_BPE)):
        pytest.skip("no tokenizer files here")
    initial, inner = wordpiece.vocabulary(BYTE_BPE)
    texts = TEXTS + random_texts() + ["Tokenization UNBELIEVABLE naïve 数学"]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").repartition(2)
    for r in wordpiece.token_counts(df, BYTE_BPE).collect():
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or "")
        each = [greedy(w.encode(), initial, inner) for w in WORD.findall(lower)]
        assert (r.n_words, r.n_tokens, r.max_word_tokens) == (len(each), sum(each), max(each, default=0))


def test_kept_columns_with_the_names_of_results(spark):
    from stratalog.llm import licenses

    names = ["doc_id", "text", "n_words", "fail_bits", "score", "predicted", "n_tokens", "ids", "labels", "max_word_tokens"]
    df = spark.createDataFrame([(1, "a b " * 30, *"xxxxxxxx"), (1, None, *"xxxxxxxx")], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    keep = tuple(n for n in names if n != "text")
    model = rulefit.Model(0.0, ())
    for out, made in (
        (ledger.ledger(df, keep=keep), "n_words"),
        (rulefit.score(df, model, keep), "score"),
        (wordpiece.token_counts(df, BYTE_BPE, keep=keep), "n_tokens"),
        (bpe.encode(df, WORD_BPE, keep=keep), "n_tokens"),
        (licenses.labels(df, keep=keep), "n_words"),
    ):
        assert len(set(out.columns)) == len(out.columns) and out.count() == 2
        assert all(r[made] != "x" for r in out.collect()), made


def test_stutter_judges_texts_of_any_length(spark):
    few = " ".join(f"w{(i * i + i // 7) % 97}" for i in range(5000))
    many = " ".join(f"w{int((i * 7919 % 5000) ** 0.95)}" for i in range(5000))
    df = spark.createDataFrame([(1, few), (2, few[:900]), (3, many)], "doc_id long, text string")
    bit = 1 << [r.name for r in ledger.RULES].index("stutter")
    got = {r.doc_id: (r.n_words, r.n_distinct, bool(r.fail_bits & bit)) for r in ledger.ledger(df, keep=("doc_id",)).collect()}
    for n, d, broken in got.values():
        assert broken == (4 * d < n if n <= 1000 else d < (62.5 * n) ** 0.5)
    assert got[1][2] and not got[3][2]
