import math

from pyspark.sql import functions as F

from netloom.llm import toxicity
from netloom.llm.queries import op2_toxicity

SCHEMA = "doc_id long, text string, label int, score string"


def test_features_are_words_pairs_and_skips():
    a, b, c = (toxicity.features(t.encode()) for t in ("One, TWO three", "one two\tthree!", "three two one"))
    assert len(a) == 6 and list(a) == list(b) and sorted(a) != sorted(c)
    assert set(a[:3]) == set(c[:3])
    assert len(toxicity.features(None)) == len(toxicity.features(b"")) == len(toxicity.features(b" .,")) == 0


def test_learns_a_word_and_handles_odd_rows(spark):
    rows = [(i, f"plain words w{i % 7} " + ("awful " if i % 4 == 0 else "") + f"more x{i}", int(i % 4 == 0), "z") for i in range(2000)]
    rows += [(None, None, 0, None), (7, "", 0, None), (8, "no label", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(df)
    assert model == toxicity.fit(df) and 0 < len(model[1]) < 100
    tests = [(1, "awful stuff", 0, "q"), (2, "plain words", 0, "q"), (None, None, 0, "q"), (4, "", 0, "q"), (4, "", 0, "q"), (5, "x " * 100000 + "awful", 0, "q")]
    got = toxicity.score(spark.createDataFrame(tests, SCHEMA), model, ["doc_id"]).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[1].predicted == 1 and by[2].predicted == 0 and by[5].score > by[4].score
    bias, weights = model
    at = set(toxicity.features(b"awful stuff").tolist())
    assert abs(by[1].score - 1 / (1 + math.exp(-bias - sum(weights.get(i, 0) for i in at)))) < 1e-9
    assert abs(by[None].score - 1 / (1 + math.exp(-bias))) < 1e-9
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity.fit(empty) == (0.0, {}) and toxicity.score(empty, model, ["doc_id"]).count() == 0


def plain_ftrl(rows):
    """FTRL-proximal with dicts, one coordinate after the other: intercept and weights."""
    z, n, bias, bias_n = {}, {}, 0.0, 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return (sign * toxicity.L1 - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for text, y in rows:
            at = sorted(set(toxicity.features(text.encode()).tolist()))
            w = {i: weight(i) for i in at}
            p = 1 / (1 + math.exp(-(sum(w.values()) + bias)))
            for i in at:
                new = n.get(i, 0.0) + (p - y) ** 2
                z[i] = z.get(i, 0.0) + (p - y) - (math.sqrt(new) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA * w[i]
                n[i] = new
            bias_n += (p - y) ** 2
            bias -= toxicity.ALPHA * (p - y) / (toxicity.BETA + math.sqrt(bias_n))
    return bias, {i: weight(i) for i in z if weight(i)}


def test_fit_against_plain_ftrl(spark):
    rows = [(i, f"some w{i % 5} {'vile' if i % 3 == 0 else 'kind'} thing x{i % 11}", int(i % 3 == 0), "z") for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    order = [r.doc_id for r in df.orderBy(F.xxhash64(F.lit(5), "doc_id", "text"), "label").collect()]
    bias, weights = plain_ftrl([(rows[i][1], rows[i][2]) for i in order])
    got = toxicity.fit(df)
    assert len(weights) > 3 and set(weights) == set(got[1])
    assert abs(bias - got[0]) < 1e-9 and all(abs(weights[i] - got[1][i]) < 1e-9 for i in weights)


def test_repeated_ids_give_one_text_and_names_may_clash(spark):
    docs = spark.createDataFrame([(1, f"text {i}", 0, "s") for i in range(300)] + [(2, None, 0, "s"), (None, "x", 0, "s")], SCHEMA)
    sample = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, label int")
    got = toxicity.labelled_texts(docs, sample).collect()
    assert sorted(r.doc_id for r in got) == [1, 2] and got == toxicity.labelled_texts(docs, sample).collect()
    out = toxicity.score(docs, (0.5, {}), ["score", "text"])
    assert out.columns == ["score", "text", "score_found", "predicted"]
    assert {(r.score, r.predicted) for r in out.collect()} == {("s", 0)}  # a tie of all: the intercept's score


def test_sample_is_bounded_and_one_row_an_id(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    assert {tuple(r) for r in toxicity.bounded_sample(labels, "toxic").collect()} == {(1, 1), (3, 0), (4, 0)}
    assert toxicity.bounded_sample(labels, "toxic", 2).count() == 2


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = op2_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out")
    hits = got.groupBy("toxic").agg(F.avg("predicted")).collect()
    share = {r[0]: r[1] for r in hits}
    assert share[1] > 0.6 and share[0] < 0.01
