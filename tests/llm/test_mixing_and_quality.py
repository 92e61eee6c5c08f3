from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from netloom.llm import mixing, quality_rules
from netloom.llm.oracles import MIXED, ORACLES, quality_sql
from netloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, size int, kept string, block string"
PROSE = "The cat sat in the house of the king and it was cold. " * 3 + "".join(f"word{i} and the thing{i} is to be of use, " for i in range(60))
ROWS = [
    (1, None, "en", "a", 9, "x", "b"), (2, "", "en", "a", 9, "x", "b"), (3, " \t\n\x0b\x0c\r ", None, None, 9, "x", "b"), (4, "one", "xx", "b", 9, "x", "b"), (4, "one", "xx", "b", 9, "x", "b"), (None, "two words", "en", None, 9, "x", "b"),
    (None, None, None, None, None, None, None), (5, PROSE, "en", "", 9, "x", "b"), (6, PROSE.upper(), "en", "é", 9, "x", "b"), (7, "a b c " * 30000, "de", "b", 9, "x", "b"), (8, "same line\nsame line\n\n \nother", "fr", "Z", 9, "x", "b"),
    (9, "x#y $1 <tag> | 50% & *" * 20, "es", "z", 9, "x", "b"), (10, PROSE.replace(" ", " | "), None, "z", 9, "x", "b"), (11, "á " * 49 + "end", "es", "z", 9, "x", "b"), (12, "wïth nbsp   and　wide 日本語 🙂", "en", "z", 9, "x", "b"),
]


def arrow(rows):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def sql(text, rows):
    db = duckdb.connect()
    db.register("odd", arrow(rows))
    return sorted((tuple(r) for r in db.execute(text).fetchall()), key=str)


@pytest.mark.parametrize("rows", [ROWS, ROWS * 7, ROWS[:1], ROWS[3:5], [(i, "w " * (i % 37 + 1), None, f"s{i % 11 if i % 3 else 0}", 1, "", "") for i in range(900)]])
def test_mix_against_sql(spark, rows):
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA))
    got = got.selectExpr("doc_id", "size", "source_size", "target", "copies * size as taken").collect()
    assert sorted(map(tuple, got), key=str) == sql(MIXED.replace("{docs}", "odd").replace("SELECT doc_id, size,", "SELECT doc_id, size,"), rows)
    total = sum(r.size for r in got)
    assert sum(r.taken for r in got) <= total and all(r.taken <= 3 * r.size for r in got)


def test_targets_fill_caps_and_share_the_rest(spark):
    d = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(d).collect()}
    assert got == {"a": 30.0, "b": 960.0, "c": 30.0, None: 0.0}


def test_mix_is_in_order_and_takes_other_ids(spark):
    rows = [(f"d{i}", "w " * (i % 9 + 1), f"s{i % 4}", i, "x") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string, size int, finish string")
    got = mixing.mix_sources(df, ["size", "finish"])
    assert got.columns == ["size", "finish", "doc_id", "source", "size_found", "source_size", "target", "finish_found", "copies"]
    time = {r.doc_id: (r.finish_found, r.source_size / r.target, r.copies) for r in got.collect()}
    taken = [r.doc_id for r in mixing.take_mix(df).collect()]
    assert Counter(taken) == {k: c for k, (_, _, c) in time.items() if c}
    seen, order = Counter(), []
    for d in taken:
        order.append(time[d][0] + seen[d] * time[d][1])
        seen[d] += 1
    assert order == sorted(order)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_sources(empty).count() == 0 and mixing.take_mix(empty).columns == empty.columns
    assert quality_rules.apply_quality_rules(empty, ["doc_id"]).count() == 0 and quality_rules.keep_good(empty).columns == empty.columns


@pytest.mark.parametrize("rows", [ROWS, ROWS * 3, [r for r in ROWS if r[2] is None], ROWS[:1]])
def test_quality_against_sql(spark, rows):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = quality_rules.apply_quality_rules(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sql(quality_sql("odd", ", ".join(names)).replace("SELECT doc_id, n_words", "SELECT d.doc_id, n_words").replace(", kept FROM d JOIN v", ", v.kept FROM d JOIN v"), rows)


def test_keep_good_keeps_rows_as_they_are(spark):
    prose = [(100 + j, " ".join(f"Word{i}{j} and the thing{i} is of use{i}, for that was in house{i}." for i in range(30)), "en", "a", 9, "x", "b") for j in range(8)]
    kept = quality_rules.keep_good(spark.createDataFrame([*ROWS, *prose, prose[0]], SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id and r.doc_id >= 100) == sorted([*range(100, 108), 100])
    assert not {r.doc_id for r in kept} & {1, 2, 3, 4, 6, 7, 8, 9, 10} and all(r.kept == "x" and r["size"] == 9 for r in kept)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_sql(spark, name):
    import glob

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM read_parquet('{f}')")
    got = QUERIES[name](spark, sf)
    names = sorted(got.columns)
    want = db.execute(ORACLES[name]).to_arrow_table().to_pylist()
    assert sorted(want[0]) == names
    row = lambda r: tuple(r[n] for n in names)
    assert sorted(map(row, got.collect()), key=str) == sorted(map(row, want), key=str)


def test_languages_without_listed_words_have_references_of_their_own(spark):
    import random

    rng = random.Random(4)
    letters = "".join(map(chr, range(0x0627, 0x064A)))
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 8)))
    common = [word() for _ in range(8)]
    clean = [" ".join(rng.choice(common) if rng.random() < 0.3 else word() for _ in range(200)) for _ in range(30)]
    latin = [" ".join(rng.choice(["een", "het", "van", "niet"]) if rng.random() < 0.3 else f"w{rng.choice('abcdef')}{rng.getrandbits(30):x}" for _ in range(200)) for _ in range(30)]
    junk = " ".join(f"{rng.getrandbits(40)}#|{rng.getrandbits(20)}" for _ in range(200))
    prose = " ".join(f"Word{i} and the thing{i} is of use{i}, for that was in house{i}." for i in range(30))
    rows = [(i, t, "ar", "a", 9, "x", "b") for i, t in enumerate(clean)] + [(100 + i, t, "nl", "a", 9, "x", "b") for i, t in enumerate(latin)]
    rows += [(200, junk, "ar", "a", 9, "x", "b"), (201, prose, "en", "a", 9, "x", "b"), (202, clean[0], None, "a", 9, "x", "b")]
    got = {r.doc_id for r in quality_rules.keep_good(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {r[0] for r in rows} - {200}
