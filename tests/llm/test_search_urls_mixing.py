"""Exact top k, URL rules and mixing, and the pipeline."""

from __future__ import annotations

import math
import random

import oracle
import pytest
from helpers import clashing, documents
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from marginalia.llm import mixing, topk, urls

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("name", ["op2_exact_top_k", "op4_url_filters"])
def test_same_rows_as_sql(spark, name):
    con = oracle.connect(SF)
    found, expected = oracle.compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert found == expected


# Top k -------------------------------------------------------------------------------------------------------------------

def plain_top(rows, k):
    cells = []
    for i, (vec_id, v) in enumerate(rows):
        if vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            cells.append((i, vec_id, [math.floor(64 * x) for x in v]))
    out = []
    for i, q, v in cells:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), c) for j, c, w in cells if j != i)
            out += [(q, n, c, -s) for n, (s, c) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_top_k_with_ties_and_unsound_vectors(spark):
    rng = random.Random(3)
    near = [1.0, 0.5, -0.25]
    rows = [(i, near if i % 3 else [round(rng.uniform(-2, 2), 2) for _ in range(3)]) for i in range(70)]
    rows += [(100, None), (120, [1.0, None, 0.0]), (140, [float("nan"), 0.0, 0.0]), (160, [float("inf"), 0.0, 0.0]), (None, near),
             (180, near), (180, near), (7, near), (200, [0.5])]
    frame = clashing(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS))
    for k in (5, 200):
        found = topk.top_k(frame, F.col("vec_id") % 20 == 0, k=k).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == plain_top(rows, k)


def test_top_k_in_small_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows = [(i, [float(F32) for F32 in __import__("numpy").float32(v)]) for i, v in rows]
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "BINS", 7)
    found = topk.top_k(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS), F.col("vec_id") % 20 == 0, k=6).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == plain_top(rows, 6)


def test_top_k_of_few_or_no_rows(spark):
    condition = F.col("vec_id") % 20 == 0
    assert topk.top_k(spark.createDataFrame([], VECTORS), condition).collect() == []
    assert topk.top_k(spark.createDataFrame([(20, [1.0], 0)], VECTORS), condition).collect() == []
    assert topk.top_k(spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 0)], VECTORS), condition).collect() == []


# URLs ----------------------------------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "http://Example.COM/en/x", "http://www.example.com/en/", "http://www.example.com/EN/", "x://a.b.com",
    "https://com/", "http://xcom/", "http://foo.net/es/1?a#b", "http://foo.net?/es/", "http://foo.net/fr", "a://b://c.net/es/", "http://ÄB.net/es/é",
    "http://a.example.com/en/" + "p" * 20_000, "http://user@h.com:80/x", "http://.com/", "http://com./",
]


def plain_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [
        (len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_url_rules(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    texts = URLS * 3 + [f"http://h{i % 7}.example.com/en/{i}" for i in range(300)]
    frame = spark.createDataFrame([(i if i % 11 else None, u, "kept out") for i, u in enumerate(texts)], "page_id long, url string, key string")
    found = urls.judge_urls(frame, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    got = sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in found)
    want = []
    for i, u in enumerate(texts):
        host, path, rule, verdict = plain_verdict(u, rules)
        want.append((str(i if i % 11 else None), host, path, str(rule), verdict))
    assert got == sorted(want)


def test_many_nested_rules(spark):
    rng = random.Random(4)
    labels = ["a", "b", "c", "com"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 4)))
    rules = sorted({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in [(host(), path()) for _ in range(250)]}.values())
    pages = [(i, f"http://{host()}{path()}") for i in range(500)]
    frame = spark.createDataFrame(rules + [("q", None, "block"), (None, "/", "block")], "host string, path string, verdict string")
    found = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), frame, default="block").collect()
    for r in found:
        _, _, rule, verdict = plain_verdict(pages[r["page_id"]][1], rules, "block")
        assert (r["rule"] is None) == (rule is None)
        assert len(r["rule"] or "") == len(rule or "")
        assert r["verdict"] == verdict or r["rule"] != rule


def test_urls_of_no_rows(spark):
    rules = spark.createDataFrame([("com", "/", "allow")], "host string, path string, verdict string")
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), rules).collect() == []
    none = urls.judge_urls(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), rules.limit(0), default="block").collect()
    assert [(r["rule"], r["verdict"]) for r in none] == [(None, "block")]


# Mixing ----------------------------------------------------------------------------------------------------------------------

def plain_rake(cells, targets, sweeps=200):
    factor = dict.fromkeys(cells, 1.0)
    for _ in range(sweeps):
        for d, target in enumerate(targets):
            sums = {}
            for c, n in cells.items():
                sums[c[d]] = sums.get(c[d], 0.0) + n * factor[c]
            total = sum(sums.values())
            for c in cells:
                if sums[c[d]] > 0:
                    factor[c] *= target.get(c[d], 0.0) / (sums[c[d]] / total)
    top = max(factor.values())
    return {c: f / top for c, f in factor.items()}


def test_mixing(spark):
    rng = random.Random(2)
    texts = [None if i % 29 == 0 else " ".join(["w" * rng.randint(1, 9)] * rng.randint(0, 40)) for i in range(400)] + ["b " * 100_000]
    docs = clashing(documents(spark, texts))
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(texts)
    assert [r["_row"] for r in rows] == ["given _row"] * len(texts)
    cells = {}
    for r in rows:
        c = (r["source"] or "", r["lang"] or "", r["topic"])
        cells[c] = cells.get(c, 0) + len((r["text"] or "").split())
        assert r["tokens"] == len((r["text"] or "").split())
    targets = []
    for d in range(3):
        sums = {}
        for c, n in cells.items():
            sums[c[d]] = sums.get(c[d], 0) + n
        raised = {v: n**0.7 for v, n in sums.items() if n}
        targets.append({v: x / sum(raised.values()) for v, x in raised.items()})
    want = plain_rake(cells, targets)
    for r in rows:
        assert abs(r["probability"] - want[r["source"] or "", r["lang"] or "", r["topic"]]) < 1e-4
    share = sum(r["drawn"] for r in rows) / len(rows)
    assert abs(share - sum(r["probability"] for r in rows) / len(rows)) < 0.1


def test_mixing_to_given_targets(spark):
    docs = documents(spark, ["a b c d e"] * 300).na.fill("xx", ["lang", "source"])
    half = spark.createDataFrame([("en", 0.5), ("fr", 0.5)], "value string, target double")
    source = spark.createDataFrame([("src0", 0.4), ("src1", 0.4), ("xx", 0.2)], "value string, target double")
    topic = spark.createDataFrame([("all", 1.0)], "value string, target double")
    rows = mixing.mixed(docs, {"source": source, "lang": half, "topic": topic}, topic=F.lit("all")).collect()
    assert {r["probability"] for r in rows if r["lang"] == "xx"} == {0.0}
    mass = {}
    for r in rows:
        mass[r["lang"]] = mass.get(r["lang"], 0.0) + r["probability"] * r["tokens"]
    assert abs(mass["en"] - mass["fr"]) < 1e-3 * mass["en"]
    again = mixing.mixed(docs, {"source": source, "lang": half, "topic": topic}, topic=F.lit("all")).where("drawn").count()
    assert again == sum(r["drawn"] for r in rows)


def test_mixing_to_a_budget(spark, tmp_path):
    """One short row of an unseen language, or a cell without words, takes nothing from the others."""
    rows = [(i, "a b c d e", ("en", "fr")[i % 4 == 0], f"s{i % 3}", 9) for i in range(600)]
    rows += [(600, "rare words", "xx", "s0", 10), (601, "", "yy", "s9", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(
        f"{tmp_path}/documents.parquet")
    out = entry.queries()["op7_mixing"](spark, str(tmp_path)).collect()
    tokens = sum(r["n_tokens"] for r in out)
    assert abs(sum(r["n_tokens"] * r["probability"] for r in out) - mixing.BUDGET * tokens) < 1e-6 * tokens
    assert abs(sum(r["kept"] for r in out) / len(out) - mixing.BUDGET) < 0.08
    chance = {r["lang"]: r["probability"] for r in out}
    assert chance["xx"] == 1.0 and 1.0 >= chance["fr"] > chance["en"] > 0.5


def test_budget_of_no_rows_or_words(spark):
    assert mixing.mixed(documents(spark, []), budget=0.5).collect() == []
    assert mixing.mixed(documents(spark, [None, "", " "]), budget=0.5).count() == 3


def test_scale_for_a_budget(spark):
    cells = [(100, 1.0), (50, 3.0), (7, 40.0), (0, 900.0), (30, 0.0), (11, 3.5)]
    raked = spark.createDataFrame(cells, "tokens long, factor double")
    for budget in (0.01, 0.3, 0.6, 0.8):
        scale = mixing.scale_for(raked, budget)
        assert abs(sum(n * min(1.0, scale * f) for n, f in cells) - budget * 198) < 1e-9
    assert mixing.scale_for(raked, 0.9) == math.inf


def test_mixing_of_no_rows_or_words(spark):

    assert mixing.mixed(documents(spark, [])).collect() == []
    assert mixing.mixed(documents(spark, [None, "", " "])).count() == 3


# Pipeline --------------------------------------------------------------------------------------------------------------------

def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.dtypes == docs.dtypes, name
        assert 0 < after.count() <= before.count(), name
        before = after
    assert entry.queries()["pipeline"](spark, SF).count() > 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    texts = [None, "", "a " * 40, "a " * 40, "b\nc\n" * 30, " ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(300))]
    for rows in (documents(spark, texts, [None, 1, 2, 2, 3, 4, 5]), documents(spark, [])):
        path = str(tmp_path / f"sf{rows.count()}")
        rows.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        corpus_pipeline.run(spark, path).collect()
