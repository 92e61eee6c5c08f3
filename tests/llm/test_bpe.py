import hashlib
import uuid
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from netloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \t\n ", "Hello, world!", "It's don't we'll I'd", "<|startoftext|>Hi<|endoftext|> a<|endoftext|>b", "ÀÉ é ́x ΑΣ İstanbul ß",
       "a b   c d", "12345 67 3.14", "日本語 テスト 🙂🙂", "x" * 3000, "\x1c a\x1db \x85 c", "a​b ﻿", "The and THE " * 500, "l'été qu'il"]


def whole(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


def check(spark, texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode(df, PATH, ["doc_id"], texts=True).collect()}
    assert len(got) == len(texts)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, text in enumerate(texts):
        ids, decoded = whole(t, text)
        r = got[i]
        assert (r.token_ids, r.decoded) == (ids, decoded), (text, r, ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))


def test_odd_texts(spark):
    check(spark, ODD)


def test_whole_table(spark):
    check(spark, pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist())


def test_many_blocks_and_shares(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 200)
    monkeypatch.setattr(bpe, "SHARE", 500)
    check(spark, ODD + [f"the {i} cat {'very ' * (i % 40)}w{i % 7}" for i in range(300)])


def test_words_are_told_apart_and_counted():
    kinds, codes, sizes = bpe.split(pa.array([" b a b ", None, "", "\t \n", "a b"]))
    assert kinds.to_pylist() == ["b", "a"] and codes.tolist() == [0, 1, 0, 1, 0] and sizes.tolist() == [3, 0, 0, 0, 2]
    kinds, codes, sizes = bpe.split(pa.array([None, ""], pa.string()))
    assert not len(kinds) and not len(codes) and sizes.tolist() == [0, 0]
    some = np.array([0, 1, 255, 256, 70000, 2**32 - 1])
    assert bpe.unpacked(bpe.packed(some)).tolist() == some.tolist() and not len(bpe.unpacked(bpe.packed(some[:0])))


def test_each_distinct_word_is_encoded_once(spark, tmp_path, monkeypatch):
    log = str(tmp_path)

    class Counted(bpe.Vocabulary):
        def encode(self, words):
            if not set(words) <= {w for t in bpe.PROBES for w in t.split()}:
                (Path(log) / uuid.uuid4().hex).write_text("\n".join(words))
            return super().encode(words)

    monkeypatch.setattr(bpe, "BLOCK", 300)
    monkeypatch.setattr(bpe, "Vocabulary", Counted)
    monkeypatch.setattr(bpe, "vocabulary", lambda path: Counted(path))
    texts = [f"same words here and w{i % 50}" for i in range(400)]
    bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, ["doc_id"]).collect()
    words = [w for f in tmp_path.iterdir() for w in f.read_text().split("\n")]
    assert sorted(words) == sorted({w for t in texts for w in t.split()})


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_vocabularies_are_refused(name):
    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path(name))


def test_carried_names_that_clash(spark):
    rows = [(1, "a b c", "x", 7), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string, block int")
    got = bpe.encode(df, PATH, ["doc_id", "text", "ids_sha256", "block"])
    assert got.columns == ["doc_id", "text", "ids_sha256", "block", "n_tokens", "ids_sha256_found", "decoded_sha256"]
    assert {(r.doc_id, r.text, r.ids_sha256, r.block, r.n_tokens) for r in got.collect()} == {(1, "a b c", "x", 7, 3), (None, None, None, None, 0)}


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert bpe.encode(spark.createDataFrame([], schema), PATH, ["doc_id"]).count() == 0
    rows = bpe.encode(spark.createDataFrame([(None, "a b"), (None, "a b")], schema), PATH, ["doc_id"]).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
