from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from netloom.llm import langid
from netloom.llm.queries import op7_language_id

SCHEMA = "doc_id long, text string, lang string"


def plain_counts(text):
    out, word = Counter(), "_"
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word != "_":
            word += "_"
            for n in (1, 2, 3):
                for i in range(len(word) - n + 1):
                    g = word[i : i + n]
                    if g != "_":
                        out[g] += 1
            word = "_"
    return out


def number(gram):
    out = 0
    for c in gram:
        out = out << 21 | (langid.EDGE if c == "_" else ord(c))
    return out


def top(counts):
    return sorted(counts, key=lambda g: (-counts[g], number(g)))[: langid.RANKS]


def plain(text, known):
    mine = top(plain_counts(text))
    if not mine:
        return "und", 0.0
    far = {k: sum(abs(i - p.index(g)) if g in p else langid.RANKS for i, g in enumerate(mine)) for k, p in known.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (langid.RANKS * len(mine))


def test_against_plain_version(spark):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()[:60]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in rows]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 !!", None), (903, "the " * 9000, None), (904, "ÀÉ a_b 9x", "fr"), (904, "ÀÉ a_b 9x", "fr"), (None, "Σας ΣΑΣ", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    sums = {}
    for _, text, lang in rows:
        if lang is not None:
            sums.setdefault(lang, Counter()).update(plain_counts(text))
    want = {k: top(c) for k, c in sums.items()}
    known = langid.profiles(df)
    assert {(r.lang, r["rank"]): r.gram for r in known.collect()} == {(k, i): number(g) for k, p in want.items() for i, g in enumerate(p)}
    got = langid.identify(df, known, ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, score = plain(r.text, want)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-12
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.profiles(empty).count() == 0 and langid.identify(empty, known, ["doc_id"]).count() == 0
    assert {tuple(r)[1:] for r in langid.identify(df, langid.profiles(empty), ["doc_id"]).collect()} == {("und", 0.0)}


def test_any_number_of_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda i: letters[i % 26] + letters[i // 26 % 26] + letters[i // 676]
    rows = [(i, f"{name(i)} {name(i)}{name(i)}", f"l{i}") for i in range(langid.AT_ONCE + 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    known = langid.profiles(df)
    assert known.select("lang").distinct().count() == langid.AT_ONCE + 1
    some = df.filter("doc_id % 50 = 0")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(some, known, ["doc_id"]).collect()}
    want = {k: top(plain_counts(t)) for _, t, k in rows}
    for i in got:
        lang, score = plain(rows[i][1], want)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-12


def test_counts_are_passed_on_and_names_may_clash(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD", 5)
    rows = [(i, f"word{i % 3} and", "en") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as score", "'y' as lang_pred")
    known = langid.profiles(df)
    assert known.count() == len(top(sum((plain_counts(t) for _, t, _ in rows), Counter())))
    got = langid.identify(df, known, ["doc_id", "score", "lang", "lang_pred"])
    assert got.columns == ["doc_id", "score", "lang", "lang_pred", "lang_pred_found", "score_found"]
    assert {tuple(r)[1:5] for r in got.collect()} == {("x", "en", "y", "en")}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.001"
    got = op7_language_id(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    hit = got.join(docs, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert hit > 0.95
    assert got.count() == docs.count()
