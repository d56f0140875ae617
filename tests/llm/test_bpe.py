from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import clashing, documents, sha

import __spark_entry__ as entry
from marginalia.llm import bpe
from marginalia.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def hard_texts():
    rng = random.Random(5)
    words = ["it's", "naïve", "Straße", "e\u0301te\u0301", "\u0130stanbul", "ΣΑΣ", "x.y,z", "don't!", "12,345.6", "日本語", "👍🏽", "a" * 90,
             "<|endoftext|>", "<|startoftext|>x", "q<|", "\u00a0", "\u2028", "end."]
    shared = " ".join(rng.choice(words) + rng.choice("abcdef") for _ in range(900))
    texts = [None, "", " \n\t ", "one", shared, "start " + shared, shared[:3000] + " cut " + shared[3000:], shared]
    texts += ["".join(rng.choice("ab c.\n'é\u0301<|>5") for _ in range(700)) for _ in range(20)]
    texts += ["z" * 5000 + " " + shared + "y" * 3000, "\n".join([shared] * 3)]
    return texts


def check(rows, texts, tokenizer, ids=None):
    want = []
    for i, t in zip(range(len(texts)) if ids is None else ids, texts, strict=True):
        out = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(out), np.array(out, dtype="<u4").tobytes(), tokenizer.decode(out, skip_special_tokens=False)))
    got = [(r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_same_as_the_library_on_hard_texts(spark, tokenizer):
    texts = hard_texts()
    check(bpe.encode_decode(clashing(documents(spark, texts)), tokenizer_path()).collect(), texts, tokenizer)


def test_repeated_rows_and_null_ids(spark, tokenizer):
    texts = [hard_texts()[4]] * 4 + [None, "a b"]
    ids = [1, 1, None, None, 2, 2]
    check(bpe.encode_decode(documents(spark, texts, ids), tokenizer_path()).collect(), texts, tokenizer, ids)


def test_empty_table(spark):
    assert bpe.encode_decode(documents(spark, []), tokenizer_path()).collect() == []


def test_chunks_are_shared_and_shift_resistant():
    text = hard_texts()[4].encode()
    first, second = bpe.cores_of([text, b"some other beginning " + text])
    cores = {text[x:y] for x, y in first}
    assert len(first) > 3
    assert len(cores & {(b"some other beginning " + text)[x:y] for x, y in second}) >= len(first) - 2


def test_query(spark, tokenizer):
    rows = {r["doc_id"]: r for r in entry.queries()["op1_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids
        r = rows[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(np.array(ids, dtype="<u4").tobytes()))
        assert r["decoded_sha256"] == sha(tokenizer.decode(ids, skip_special_tokens=False))
