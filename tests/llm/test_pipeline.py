import hashlib

import duckdb
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from netloom.llm import suffix_dedup as sd
from netloom.llm.oracles import MIXED, quality_sql
from tests.llm import test_simhash, test_suffix_dedup

SF = "/root/testdata/sf0.001"


def plain_run(spark):
    db = duckdb.connect()
    docs = pq.read_table(f"{SF}/documents.parquet")
    db.register("a", docs)
    rows = db.execute(quality_sql("a", "doc_id, text, lang, source").replace("JOIN v USING (row_id)", "JOIN v USING (row_id) WHERE v.kept")).fetchall()
    rows.sort()
    rows = [r for i, (r, g) in enumerate(zip(rows, test_simhash.plain_copies(rows), strict=True)) if i == g]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    test_suffix_dedup.KEYS.clear()
    test_suffix_dedup.KEYS.update({(r.doc_id, r.text or ""): r["__doc"] for r in sd.keyed(frame).collect()})
    gone = test_suffix_dedup.plain(rows)
    left = []
    for r in rows:
        words = gone.get((r[0], r[1]), set())
        spans = []
        for w in sorted(words):
            if spans and w == spans[-1]["stop"]:
                spans[-1]["stop"] = w + 1
            else:
                spans.append({"start": w, "stop": w + 1})
        text = sd.cut(r[1].encode(), spans).decode() if spans else r[1]
        if text.strip() or not spans:
            left.append((r[0], text, r[3]))
    db.register("b", pa.Table.from_pandas(pd.DataFrame(left, columns=["doc_id", "text", "source"])))
    mixed = db.execute(MIXED.replace("{docs}", "b").replace("SELECT doc_id, size, source_size, target, ", "SELECT doc_id, size, ")).fetchall()
    times = {d: taken // size for d, size, taken in mixed if size}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for doc, text, source in left:
        ids = t.encode(text, add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out += [(doc, source, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))] * times.get(doc, 0)
    return out


def test_run_against_plain_version(spark):
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got and got == sorted(plain_run(spark))


def test_stages_handle_odd_and_no_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, copies int, __x map<string,int>"
    text = " ".join(f"the w{i} of and" for i in range(90))
    rows = [(1, text, "en", "a", 1, 1, "k", 1, {"a": 1}), (1, text, "en", "a", 1, 1, "k", 1, {"a": 1}), (2, None, None, None, None, None, None, None, None), (3, "", "", "", 0, 0, "", 0, {}),
            (None, text + " x", None, None, None, None, None, None, None), (4, "word " * 60000, "en", "b", 2, 2, "k", 2, {})]
    for _, stage in corpus_pipeline.STAGES:
        for some in (rows, []):
            docs = spark.createDataFrame(some, schema)
            out = stage(spark, docs, SF)
            assert out.count() <= 3 * len(some)
            if stage is not corpus_pipeline.tokens:
                assert out.dtypes == docs.dtypes
