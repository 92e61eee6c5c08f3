import random
import re

import pyarrow.parquet as pq

from netloom.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, n_chars long, spans string, lang string"


def plain(rows):
    """doc (id, text): the words that go."""
    docs = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    key = lambda d: sd_key(d[0], d[1], d[2])
    seen = {}
    for d in docs:
        ws = re.findall(r"[^\x20\x09-\x0D]+", d[2])
        for i in range(len(ws) - 49):
            place = (d[0], d[1], key(d), i)
            g = tuple(ws[i : i + 50])
            seen[g] = min(seen.get(g, place), place)
    gone = {}
    for d in docs:
        ws = re.findall(r"[^\x20\x09-\x0D]+", d[2])
        for i in range(len(ws) - 49):
            if seen[tuple(ws[i : i + 50])] < (d[0], d[1], key(d), i):
                gone.setdefault((None if d[0] else d[1], d[2]), set()).update(range(i, i + 50))
    return gone


KEYS = {}


def sd_key(none, doc, text):
    return KEYS[(None if none else doc, text)]


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    KEYS.clear()
    KEYS.update({(r.doc_id, r.text or ""): r["__doc"] for r in sd.keyed(df).collect()})
    want = plain(rows)
    got = {}
    for r in sd.find_repeats(df).collect():
        got.setdefault(r.doc_id, []).append(set(range(r.start_word, r.stop_word)))
        assert r.n_words == r.stop_word - r.start_word >= 50
    by = {}
    for (doc, _), words in want.items():
        by.setdefault(doc, set()).update(words)
    assert {k: set().union(*v) for k, v in got.items()} == by
    kept = {}
    for r in sd.remove_repeats(df).collect():
        kept.setdefault((r.doc_id, r.lang), []).append(r)
    for r in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        left = [w for i, w in enumerate(ws) if i not in want.get((r[0], r[1] or ""), ())]
        if ws and not left:
            assert (r[0], r[4]) not in kept
            continue
        same = [x for x in kept[r[0], r[4]] if re.findall(r"[^\x20\x09-\x0D]+", x.text or "") == left]
        assert same
        if (r[0], r[1] or "") not in want:
            assert any(x.text == r[1] for x in same)
        elif r[1] is not None:
            assert same[0].n_chars == len(same[0].text)


def test_whole_table_against_brute_force(spark):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    check(spark, [(r["doc_id"], r["text"], r["n_chars"], "clash", str(i)) for i, r in enumerate(rows)])


def test_planted_passages(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 57, 60, 74, 75, 140)]
    rows = []
    for i in range(120):
        ws = [word() for _ in range(rng.randrange(0, 160))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(ws) + 1)
            p = rng.choice(shared)
            cut = rng.randrange(0, 12)
            ws[at:at] = p[cut:] if rng.random() < 0.5 else p
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(ws) + rng.choice(["", "\n", " "]), 0, "s", str(i)))
    check(spark, rows)


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(70))
    rows = [(1, None, None, None, "0"), (2, "", 0, "", "1"), (3, "short text", 1, "", "2"), (None, long, 1, "", "3"), (5, long + " tail", 1, "", "4"), (5, long + " tail", 1, "", "4"),
            (5, "head " + long, 1, "", "5"), (None, long, 1, "", "6"), (7, "same " * 3000, 1, "", "7"), (8, "É " + long, 2, "", "8")]
    check(spark, rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert sd.find_repeats(empty).count() == 0 and sd.remove_repeats(empty).columns == empty.columns
