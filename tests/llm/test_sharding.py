"""Shards: borders, slots and copies against a plain sort of all rows."""

from __future__ import annotations

import random
import zlib

import pytest
from helpers import clashing, documents
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marginalia.llm import sharding


def checked(rows, shards, slack):
    """Rows (order, size, shard, slot) as the law wants them: in order, gapless, borders where the bytes put them."""
    total = sum(r[1] for r in rows)
    placed = sorted(rows, key=lambda r: (r[2], r[3]))
    assert [r[0] for r in placed] == sorted(r[0] for r in rows)
    below = 0
    for s in range(shards):
        own = [r for r in placed if r[2] == s]
        assert [r[3] for r in own] == list(range(len(own)))
        below += sum(r[1] for r in own)
        last = [r[1] for r in own[-1:]] + [r[1] for r in placed if r[2] == s + 1][:1]
        assert abs(below - total * (s + 1) / shards) <= slack * total / shards + max(last, default=0), s


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_borders_and_slots(spark, shards):
    rng = random.Random(shards)
    rows = [(i, rng.choice([rng.getrandbits(63) - 2**62, 7, -(2**63), 2**63 - 1]), int(rng.paretovariate(1.1))) for i in range(3000)]
    rows = [(rng.choice([i, -i, 2**62 - i, -(2**63) + i]), k, s) for i, k, s in rows]
    frame = clashing(spark.createDataFrame(rows, "doc_id long, key0 long, size0 long")).repartition(7)
    found = sharding.sharded(frame, F.col("size0"), F.col("key0"), shards=shards, bin_rows=64, bin_bytes=4000).collect()
    assert sorted((r["doc_id"], r["key0"], r["size"]) for r in found) == sorted(rows)
    assert {r["_row"] for r in found} == {"given _row"}
    checked([((r["key0"], r["doc_id"]), r["size"], r["shard"], r["slot"]) for r in found], shards, sharding.TOLERANCE)


def test_one_group_of_copies_and_repeated_rows(spark):
    """A group larger than a shard is cut by id, rows that are equal in all by number; small groups stay together."""
    texts = ["copy " * 9] * 500 + ["same"] * 500 + [f"text {i // 3} " * (i % 5) for i in range(600)] + [None] * 30 + [""] * 20 + ["long " * 20_000]
    docs = documents(spark, texts, [*range(500), *[None] * 250, *[7] * 250, *range(1000, 1651)])
    found = sharding.shard_documents(docs).collect()
    assert len(found) == len(texts)
    sizes = [len((r["text"] or "").encode()) + 1 for r in found]
    assert [r["size"] for r in found] == sizes
    total, shares, slots = sum(sizes), [0] * 8, {}
    for r in found:
        shares[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(shares) <= max(max(sizes), total / 8 * 1.1)
    small = {}
    for r in found:
        if r["text"] is not None and r["text"].startswith("text"):
            small.setdefault(r["text"], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in small.values()) <= 7


def test_no_rows_few_rows_other_ids(spark, tmp_path):
    assert sharding.shard_documents(documents(spark, [])).collect() == []
    one = sharding.shard_documents(documents(spark, ["a"])).collect()
    assert [(r["slot"], r["size"]) for r in one] == [(0, 2)]
    named = spark.createDataFrame([(f"id{i % 40}", "t" * i) for i in range(100)], "doc_id string, text string")
    rows = sharding.shard_documents(named)
    shares = [0] * 8
    for r in rows.collect():
        shares[r["shard"]] += r["size"]
    assert max(shares) - min(shares) <= 202
    sharding.write_shards(rows, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 8


def test_shard_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = entry.queries()["op13_sharding"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    for r in found:
        text = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "bytes", None)
    keys = {r["doc_id"]: r["k"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.xxhash64("text").alias("k")).collect()}
    checked([((keys[r["doc_id"]], r["doc_id"]), r["size"], r["shard"], r["slot"]) for r in found], 8, sharding.TOLERANCE)
