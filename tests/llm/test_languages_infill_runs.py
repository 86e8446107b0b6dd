"""Language mixtures, fill-in-middle and periodic runs against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cytoloom.llm import infill, languages, queries, runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, h long, form string, score double, held_out string"
ODD = ["", " \n\t ", "1234 !? 56", "a", "<P>", "x <S> y", "a<", "<S", "\u0001\u0002\u0001", "\u0002e\u0002m\u0001", "é́😀 ü" * 9, "a\r\nb c\u0085", "$1 \\$0 " * 4]


def rows_of(texts, lang=None):
    return [(i, t, lang, None, None, None, None, None, None, None) for i, t in enumerate(texts)]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# ---- languages


def language_rows(seed=5):
    rng = random.Random(seed)
    parts = {"aa": ["the", "ing", "ou", "sh"], "bb": ["sch", "ung", "ber", "ö"], "cc": ["eau", "que", "é", "tion"]}
    say = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, say(lang, 60), lang) for i, lang in enumerate(["aa", "aa", "bb", "cc"] * 40)]
    mixed = [(1000, say("aa", 60) + ". " + say("bb", 40), None), (1001, say("cc", 300) + " " + say("bb", 30), None), (1002, say("bb", 3000), None)]
    other = [(2000, None, "aa"), (2001, "", "bb"), (2002, "12 - 34", "cc"), (2003, "́́", None), (None, say("cc", 30), None), rows[7], (2004, "Ω", None), (2005, "THE SHOU!", None)]
    return [(*r, *[None] * 7) for r in rows + mixed + other]


def test_languages(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long, n long, bin long, cnt long, score double, held_out string"
    rows = language_rows()
    got = languages.predict_languages(spark.createDataFrame(rows, columns).repartition(3)).collect()
    assert len(got) == len(rows) and {r["held_out"] for r in got} == {True, False}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and abs(sum(r["shares"]) - (r["lang_pred"] != "und")) < 1e-6
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == lang for i, _, lang, *_ in rows[:160])
    assert by_id[1000]["languages"] == ["aa", "bb"] and 0.4 < by_id[1000]["shares"][0] < 0.7
    assert by_id[1001]["languages"] == ["cc", "bb"] and by_id[1001]["shares"][0] > 0.8
    assert by_id[1002]["languages"] == ["bb"] and by_id[1002]["score"] > 0.99
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 and by_id[i]["languages"] == [] for i in range(2000, 2004))
    assert by_id[None]["lang_pred"] == "cc" and by_id[2005]["lang_pred"] == "aa"
    assert by_id[2004]["lang_pred"] == "aa", "what says nothing goes to the language with most documents"


def test_languages_do_not_see_labels(spark):
    rows = language_rows()
    frame = spark.createDataFrame(rows, DOCS)
    held = languages.held_out(F.col("doc_id"))
    wrong = frame.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("zz"))
    names = ["doc_id", "lang_pred", "score", "shares"]
    key = lambda df: sorted(map(repr, df.select(names).collect()))
    assert key(languages.predict_languages(frame)) == key(languages.predict_languages(wrong))


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame(rows_of(["some text", None, "4"]), DOCS)
    assert {r["lang_pred"] for r in languages.predict_languages(frame).collect()} == {"und"}
    assert languages.predict_languages(spark.createDataFrame([], DOCS)).count() == 0


def test_trigrams_counted_by_hand(monkeypatch):
    text = "Ab-c é́x"

    def bins(x):
        return sorted(np.concatenate([g for _, g, _ in languages.trigrams([x])]).tolist())
    assert len(bins(text)) == 6 and bins(text) == bins("aB c É́X ") == sorted(bins("ab") + bins("c") + bins("é́x"))
    whole = ["ab " * 50, None, "xyz" * 40, "", "7"]
    monkeypatch.setattr(languages, "PIECE", 30)
    pieces = list(languages.trigrams(whole))
    assert len(pieces) > 5 and sum(len(g) for _, g, _ in pieces) == 220 and {o for owners, _, _ in pieces for o in owners.tolist()} == {0, 2}


def test_mixture_is_the_most_likely_one():
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(40), 3)
    counts = rng.multinomial(3000, np.array([0.5, 0.3, 0.2]) @ p).astype(float)
    shares, likelihood = languages.mixture(np.log(p), counts, 400)
    grid = [np.array([a, b, 100 - a - b]) / 100 for a in range(101) for b in range(101 - a)]
    best = max(grid, key=lambda s: counts @ np.log(np.maximum(s @ p, 1e-300)))
    assert np.abs(shares - best).max() < 0.02 and likelihood >= counts @ np.log(best @ p) - 1e-6


def test_a_search_that_is_skipped_would_have_found_one_language():
    rng = np.random.default_rng(4)
    p = rng.dirichlet(np.ones(60), 3)
    model = languages.LanguageModel(["a", "b", "c"], np.log(np.ones(3) / 3), np.log(p).astype(np.float32))
    skipped = 0
    for _ in range(200):
        share = rng.choice([0, 0, 0.05, 0.4])
        counts = rng.multinomial(rng.integers(5, 400), (1 - share) * p[0] + share * p[1]).astype(float)
        bins = np.flatnonzero(counts)
        chosen, _, _ = languages._choose(model, bins, counts[bins])
        if len(chosen) == 1:
            skipped += 1
            n, alone = counts.sum(), np.log(p[chosen[0]]) @ counts
            penalty = np.log(n / languages.OVERLAP + 1) / 2 * languages.OVERLAP
            ranked = np.argsort(-languages.mixture(np.log(p)[:, bins], counts[bins])[0])
            assert languages.mixture(np.log(p)[ranked[:2]][:, bins], counts[bins])[1] - penalty <= alone + 1e-3
    assert 20 < skipped < 200


# ---- fill in the middle


def plain_infill(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not n or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, s, m = "<P>" + text[:a], "<S>" + text[b:], "<M>" + text[a:b]
    return (n, "spm", a, b - a, s + p + m) if h[3] % 100 < 20 else (n, "psm", a, b - a, p + s + m)


def test_infill(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab<PSM>\u0001\u0002em \n😀é") for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["long text. " * 40_000]
    rows = rows_of(texts) + rows_of([None])[:1] + [(None, "null id", *[None] * 8), rows_of(texts)[3]]
    made = infill.infill(spark.createDataFrame(rows, DOCS).repartition(3))
    got = made.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", infill.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_infill(r["doc_id"], r["text"])
        assert r["back"] == r["text"]
    assert infill.infill_report(spark.createDataFrame([], DOCS)).count() == 0
    forms = infill.infill(spark.createDataFrame(rows_of(["abc"] * 50), DOCS), rate=100, spm=0).select("form").distinct().collect()
    assert [r[0] for r in forms] == ["psm"]


def test_infill_needs_no_python(spark):
    plan = infill.infill_report(spark.createDataFrame(rows_of(["a"]), DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ---- runs


def plain_runs(w, least):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        s = 0
        while s + p < len(w):
            e = s
            while e + p < len(w) and w[e] == w[e + p]:
                e += 1
            if e > s and e + p - s >= max(least, 2 * p):
                found.setdefault((s, e + p - s), p)
            s = e + 1
    return sorted((s, k, p) for (s, k), p in found.items())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=5), st.sampled_from([2, 3, 5, 12]))
def test_runs_of_all_texts(texts, least):
    got = runs.find_runs([np.array(t, np.int64) for t in texts], least)
    assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(t, least) for t in texts]


def test_runs_of_words(spark):
    rng = random.Random(2)
    words = [b"a", b"b", "é".encode(), b"dd"]
    texts = ODD + [None, "a " * 500, "a b " * 6, "a b c d e f g " * 2 + "a b"] + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 120))) for _ in range(150)] + [b" ".join(rng.choice(words) for _ in range(20_000)).decode()]
    rows = rows_of(texts) + [(None, "x y " * 9, *[None] * 8), rows_of(texts)[20]]
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    got = sorted(runs.run_report(frame).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(rows)
    planted = 0
    for r, (doc_id, text, *_) in zip(got, want):
        w = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            planted += 1
        if len(w) > 5000:
            number = {x: k for k, x in enumerate(set(w))}
            found = [tuple(x) for x in runs.find_runs([np.array([number[x] for x in w])])[0].tolist()]
        else:
            found = plain_runs(w, 12)
        dropped = {i for s, k, p in found for i in range(s + p, s + k)}
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert r["doc_id"] == doc_id and r["n_runs"] == len(found)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3) and r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{k},{p}\n" for s, k, p in found))
        assert r["collapsed_sha256"] == sha(b" ".join(x for i, x in enumerate(w) if i not in dropped))
    assert planted > 10
    assert runs.run_report(spark.createDataFrame([], DOCS)).count() == 0
    kept = {r["doc_id"]: r["text"] for r in runs.collapse_runs(frame).collect()}
    assert kept[len(ODD)] is None and kept[len(ODD) + 1] == "a" and kept[len(ODD) + 2] == "a b" and kept[1] == texts[1]


def test_long_period_and_chunks(monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 50)
    rng = random.Random(3)
    rows = [{"text": " ".join(rng.choice("ab") for _ in range(30)), "h": None} for _ in range(20)]
    assert runs._reports(rows) == [(k, *runs._reports([r])[0][1:]) for k, r in enumerate(rows)]
    block = [rng.randrange(1000) for _ in range(5000)]
    found = runs.find_runs([np.array([1001, *block, *block, *block[:7], 1002])])[0]
    assert found.tolist() == [[1, 10007, 5000]]


@pytest.mark.parametrize("name", ["op11_language_mixture", "op12_infill", "op13_periodic_runs"])
def test_registered(name):
    assert name in queries.QUERIES
