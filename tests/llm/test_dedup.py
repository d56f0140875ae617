"""Line dedup, near-duplicates and repeated byte strings against plain Python."""

from __future__ import annotations

import itertools
import random
import uuid
from collections import Counter

import pytest
import zstandard
from helpers import clashing, documents, sha, without_repeats
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

import __spark_entry__ as entry
from marginalia.llm import linededup, neardup, suffixes
from marginalia.llm.common import written

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)]


# Lines -----------------------------------------------------------------------------------------------------------------

def plain_lines(pairs):
    """(id, text) in order of rows; what is left of each text, and the removed lines."""
    order = sorted(range(len(pairs)), key=lambda i: (pairs[i][0] is None, pairs[i][0] or 0, i))
    met, out = set(), {}
    for i in order:
        text = pairs[i][1]
        if text is None:
            out[i] = (None, [])
            continue
        lines, gone = text.encode().split(b"\n"), set()
        for x, y in linededup.runs_of(lines):
            body = b"\n".join(lines[x:y])
            if body.strip():
                if body in met:
                    gone.update(range(x, y))
                met.add(body)
        out[i] = (b"\n".join(v for k, v in enumerate(lines) if k not in gone).decode(), sorted(gone))
    return [out[i] for i in range(len(pairs))]


def line_texts():
    rng = random.Random(2)
    passage = "\n".join(" ".join(words(rng, 8)) for _ in range(12))
    own = lambda n: "\n".join(" ".join(words(rng, 6)) for _ in range(n))
    return [None, "", "\n\n\n", "one line", passage, own(5) + "\n" + passage + "\n" + own(3), own(1) + "\n" + passage, passage, passage,
            passage + "\n" + passage, own(40), "a\nb\n" * 50, "x" * 100_000 + "\n" + passage]


def test_line_dedup(spark):
    texts = line_texts()
    ids = [5, 4, 3, 2, 9, 1, 7, None, 8, 8, 8, 0, None]
    rows = linededup.line_dedup(clashing(documents(spark, texts, ids).coalesce(1))).collect()
    want = plain_lines(list(zip(ids, texts, strict=True)))
    key = lambda r: repr(r)
    got = [(r["doc_id"], r["text"], r["removed"], r["_row"]) for r in rows]
    assert sorted(got, key=key) == sorted(((i, *w, "given _row") for i, w in zip(ids, want, strict=True)), key=key)
    assert sum(len(w[1]) for w in want) > 40


def test_line_dedup_of_no_rows(spark):
    assert linededup.line_dedup(documents(spark, [])).collect() == []


def test_runs_resist_shifts():
    rng = random.Random(8)
    lines = [" ".join(words(rng, 5)).encode() for _ in range(60)]
    runs = {tuple(lines[x:y]) for x, y in linededup.runs_of(lines)}
    moved = [b"new", *lines]
    assert len(runs & {tuple(moved[x:y]) for x, y in linededup.runs_of(moved)}) >= len(runs) - 2


def test_line_dedup_takes_whole_passages(spark):
    """Repeated passages of two lines and more, and long single lines, between own lines; the truth knows nothing of runs."""
    rng = random.Random(31)
    line = lambda n=7: " ".join(words(rng, n))
    passages = [[line() for _ in range(n)] for n in (2, 2, 2, 3, 5, 9)] + [[line(60)], [line(), "", "", "", "", line()]]
    texts = []
    for i in range(40):
        parts = [[line()], *[p for p in rng.sample(passages, 3) for p in (p, [line()])]]
        texts.append("\n".join(x for p in parts for x in p) if i != 7 else passages[6][0])
    met, singles, want = set(), set(), []
    for text in texts:
        lines = text.split("\n")
        gone = set()
        for i, x in enumerate(lines):
            if len(x.split()) > 50:
                gone |= {i} if x in singles else set()
                singles.add(x)
            for j in range(i + 1, len(lines)):
                if (x or lines[j]) and (j == i + 1 or x and lines[j] and not any(lines[i + 1 : j])):
                    gone |= set(range(i, j + 1)) if tuple(lines[i : j + 1]) in met else set()
                    met.add(tuple(lines[i : j + 1]))
        want.append(sorted(gone))
    rows = linededup.line_dedup(documents(spark, texts)).orderBy("doc_id").collect()
    assert [r["removed"] for r in rows] == want
    kept = Counter(x for r in rows for x in r["text"].split("\n"))
    assert all(kept[x] == 1 for p in passages for x in p if x)
    assert set(kept) >= {x for t in texts for x in t.split("\n") if x}


def test_line_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = plain_lines([(d["doc_id"], d["text"]) for d in docs])
    rows = {r["doc_id"]: r for r in entry.queries()["op3_line_dedup"](spark, SF).collect()}
    assert len(rows) == len(docs)
    for d, (text, gone) in zip(docs, want, strict=True):
        assert rows[d["doc_id"]]["kept_sha256"] == sha(text)
        assert rows[d["doc_id"]]["removed"] == ",".join(map(str, gone))


# Near-duplicates --------------------------------------------------------------------------------------------------------

def edited(rng, base, n):
    out = list(base)
    for i in rng.sample(range(len(base)), n):
        out[i] = words(rng, 1)[0]
    return out


def classes(rows):
    by = {}
    for r in rows:
        by.setdefault(r["class_id"], set()).add(r["doc_id"])
    return sorted(map(sorted, by.values()))


def test_near_duplicates(spark):
    rng = random.Random(6)
    base, other = words(rng, 300), words(rng, 300)
    texts = [" ".join(base), " ".join(edited(rng, base, 3)), " ".join(base).upper() + "!", " ".join(other), " ".join(words(rng, 300)),
             None, "", "?!", "two words", "Two, words", " ".join(edited(rng, other, 120)), " ".join(words(rng, 30_000))]
    rows = neardup.class_ids(clashing(documents(spark, texts))).collect()
    assert classes(rows) == [[0, 1, 2], [3], [4], [5], [6], [7], [8, 9], [10], [11]]
    kept = neardup.one_of_each(clashing(documents(spark, texts)))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 8, 10, 11]
    assert [r["links"] for r in kept.collect()] == ["given links"] * 9


def test_near_duplicates_of_repeated_rows_and_none(spark):
    text = " ".join(words(random.Random(1), 50))
    rows = neardup.class_ids(documents(spark, [text, text, text, "x"], [None, 3, 3, None])).collect()
    assert sorted(str((r["doc_id"], r["class_id"])) for r in rows) == ["(3, None)", "(3, None)", "(None, None)", "(None, None)"]
    assert neardup.one_of_each(documents(spark, [text, text, text, "x"], [None, 3, 3, None])).count() == 2
    assert neardup.class_ids(documents(spark, [])).collect() == []


def test_family_in_parts(spark, monkeypatch):
    """Copies that are alike only through the text they were made from, dealt out to many parts."""
    rng = random.Random(7)
    base = words(rng, 200)
    texts = [" ".join(base), *[" ".join(edited(rng, base, 4)) for _ in range(120)], *[" ".join(words(rng, 200)) for _ in range(10)]]
    monkeypatch.setattr(neardup, "PART_DOCS", 20)
    rows = neardup.class_ids(documents(spark, texts)).collect()
    assert classes(rows) == [list(range(121)), *[[i] for i in range(121, 131)]]


def test_tasks_of_rounds_are_bounded(spark, monkeypatch, tmp_path):
    """Pages of one template, alike enough for bands but not for one class: the pivots of a round come to a task in blocks."""
    rng = random.Random(14)
    base = words(rng, 200)
    texts = [" ".join(edited(rng, base, 8)) for _ in range(40)] + [" ".join(base)]
    monkeypatch.setattr(neardup, "PART_DOCS", 8)
    apply = PandasCogroupedOps.applyInPandas

    def counted(self, meet, schema):
        def noted(left, right):
            (tmp_path / uuid.uuid4().hex).write_text(f"{len(left)} {len(right)}")
            return meet(left, right)

        return apply(self, noted, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", counted)
    rows = neardup.class_ids(documents(spark, texts)).collect()
    seen = [tuple(map(int, p.read_text().split())) for p in tmp_path.iterdir()]
    assert seen and max(right for _, right in seen) <= 8
    monkeypatch.undo()
    assert classes(rows) == classes(neardup.class_ids(documents(spark, texts)).collect())


def test_chain_over_parts(spark, monkeypatch):
    """Each text is alike only to the one before and the one after, and nearly each is in a part of its own."""
    rng = random.Random(12)
    chain = [words(rng, 200)]
    for _ in range(25):
        chain.append(edited(rng, chain[-1], 3))
    monkeypatch.setattr(neardup, "PART_DOCS", 1)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    rows = neardup.class_ids(documents(spark, [" ".join(c) for c in chain])).collect()
    assert classes(rows) == [list(range(26))]


def test_near_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sets = {d["doc_id"]: set(h.tolist()) for d, (h, _, _) in zip(docs, neardup.shingles([d["text"] or "" for d in docs]), strict=True)}
    class_of = {r["doc_id"]: r["class_id"] for r in entry.queries()["op6_near_duplicates"](spark, SF).collect()}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        share = both / max(1, len(sets[a]) + len(sets[b]) - both)
        if share >= 0.82:
            assert class_of[a] == class_of[b]
        if share >= 0.78:
            parent[root(a)] = root(b)
    assert all(root(d) == root(c) for d, c in class_of.items())


# Repeated strings ---------------------------------------------------------------------------------------------------------

def string_texts(rng, length):
    letters = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, longer = letters(2 * length), letters(6 * length)
    texts = [None, "", "short", passage, letters(50) + passage + letters(70), longer, longer[: 3 * length] + "X" + longer[3 * length :],
             longer, "z" * (4 * length), "ab" * (3 * length), letters(length), letters(5 * length), longer[length:] + longer[:length]]
    texts += [letters(rng.randint(0, 30)) + passage[:length] + letters(rng.randint(0, 30)) for _ in range(25)]
    return texts


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("crowded", [500, 3])
def test_repeats(spark, monkeypatch, keep_first, crowded):
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    texts = string_texts(random.Random(11), 60)
    want = without_repeats([(t or "").encode() for t in texts], 60, keep_first)
    docs = clashing(documents(spark, texts).coalesce(1))
    rows = suffixes.remove_repeats(docs, length=60, gram=20, keep_first=keep_first).orderBy("doc_id").collect()
    got = [(bytes(r["kept"]), [(s["start"], s["end"]) for s in r["spans"]]) for r in rows]
    assert got == want
    assert [r["n_bytes"] for r in rows] == [len((t or "").encode()) for t in texts]


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("crowded", [500, 3])
def test_shorter_passages(spark, monkeypatch, keep_first, crowded):
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    monkeypatch.setattr(suffixes, "WORDS", 4)
    texts = string_texts(random.Random(12), 60)
    bodies = [(t or "").encode() for t in texts]
    rows = suffixes.remove_repeats(
        documents(spark, texts).coalesce(1), length=60, gram=12, keep_first=keep_first, least=30).orderBy("doc_id").collect()
    assert [(bytes(r["kept"]), [(s["start"], s["end"]) for s in r["spans"]]) for r in rows] == without_repeats(bodies, 60, keep_first)
    shorter = [[(a, z) for a, z in spans if len(b[a:z].split()) > 4] for b, (_, spans) in zip(bodies, without_repeats(bodies, 30, keep_first), strict=True)]
    assert any(shorter)
    assert [[(s["start"], s["end"]) for s in r["passages"]] for r in rows] == shorter


def common(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_longest_previous_factors_position_by_position():
    rng = random.Random(5)
    for text in [*("".join(rng.choice("ab") for _ in range(n)) for n in (1, 2, 3, 17, 60, 90)), "a" * 30, "abc" * 12]:
        order = sorted(range(len(text)), key=lambda i: text[i:])
        lcp = [0] + [common(text[i:], text[j:]) for i, j in itertools.pairwise(order)]
        got = dict(zip(order, suffixes.previous_factors(order, lcp), strict=True))
        assert got == {i: max((common(text[i:], text[j:]) for j in range(i)), default=0) for i in range(len(text))}


def test_suffix_orders_of_one_anchor():
    rng = random.Random(6)
    bodies = ["".join(rng.choice("ab") for _ in range(14)) + "X" + "".join(rng.choice("ab") for _ in range(9)) for _ in range(40)]
    group = [(1, 1, i, 0, 14, 14, zstandard.compress(b.encode())) for i, b in enumerate(bodies)]
    met = 0
    for distance, order, lcp in suffixes.suffix_orders(group, 3):
        tails = [bodies[i][14 - distance :] for i in order]
        assert tails == sorted(tails)
        assert lcp.tolist()[1:] == [common(a, b) for a, b in itertools.pairwise(tails)]
        met += 1
    assert met > 5


def test_what_contexts_share_outside_their_piece():
    rng = random.Random(15)
    every = sorted((rng.randint(0, 3), "".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode()) for _ in range(60))
    for first, end in ((0, 60), (0, 20), (20, 41), (41, 60), (30, 31)):
        outside = suffixes.shared_outside(every[first:end], 9)
        for (anchor, right), most in zip(every[first:end], outside.tolist(), strict=True):
            assert most >= max((common(right, r) for a, r in every[:first] + every[end:] if a == anchor), default=0)
    assert (suffixes.shared_outside(every, 9)[1:-1] < 9).any()


@pytest.mark.parametrize("keep_first", [True, False])
def test_repeats_across_pieces(spark, monkeypatch, keep_first):
    monkeypatch.setattr(suffixes, "CROWDED", 3)
    monkeypatch.setattr(suffixes, "BATCH", 2 * 60 * 4)
    monkeypatch.setattr(suffixes, "WORDS", 4)
    texts = string_texts(random.Random(13), 60)
    bodies = [(t or "").encode() for t in texts]
    rows = suffixes.remove_repeats(
        documents(spark, texts).repartition(3), length=60, gram=12, keep_first=False, least=30).orderBy("doc_id").collect()
    want = without_repeats(bodies, 60, False)
    assert [(bytes(r["kept"]), [(s["start"], s["end"]) for s in r["spans"]]) for r in rows] == want
    rows = suffixes.remove_repeats(
        documents(spark, texts).coalesce(1), length=60, gram=12, keep_first=keep_first, least=30).orderBy("doc_id").collect()
    assert [(bytes(r["kept"]), [(s["start"], s["end"]) for s in r["spans"]]) for r in rows] == without_repeats(bodies, 60, keep_first)
    shorter = [[(a, z) for a, z in spans if len(b[a:z].split()) > 4] for b, (_, spans) in zip(bodies, without_repeats(bodies, 30, keep_first), strict=True)]
    assert [[(s["start"], s["end"]) for s in r["passages"]] for r in rows] == shorter


def test_a_crowded_passage_makes_few_rows(spark, monkeypatch):
    """What is written beyond the contexts follows the texts, not the strings of each copy."""
    rows_of = {}

    def counted(rows, label):
        out = written(rows, label)
        rows_of[label] = out.count()
        return out

    monkeypatch.setattr(suffixes, "CROWDED", 50)
    monkeypatch.setattr(suffixes, "written", counted)
    rng = random.Random(14)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = letters(450)
    texts = [letters(rng.randint(60, 90)) + passage + letters(rng.randint(450, 500)) for _ in range(300)]
    rows = suffixes.remove_repeats(documents(spark, texts), keep_first=False).orderBy("doc_id").collect()
    assert [(bytes(r["kept"]), [(s["start"], s["end"]) for s in r["spans"]]) for r in rows] == without_repeats([t.encode() for t in texts], 400, False)
    later = {k: n for k, n in rows_of.items() if k not in ("anchors", "contexts", "bodies")}
    assert max(later.values()) <= 20 * len(texts)


def test_repeats_of_no_rows_and_null_ids(spark):
    assert suffixes.remove_repeats(documents(spark, [])).collect() == []
    rows = suffixes.remove_repeats(documents(spark, ["q" * 300 + "w" * 300] * 2, [None, None]), keep_first=False).collect()
    assert [(r["doc_id"], bytes(r["kept"])) for r in rows] == [(None, b"")] * 2


def test_repeat_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = without_repeats([(d["text"] or "").encode() for d in docs], 400, False)
    rows = {r["doc_id"]: r for r in entry.queries()["op8_suffix_dedup"](spark, SF).collect()}
    assert len(rows) == len(docs)
    for d, (kept, spans) in zip(docs, want, strict=True):
        r = rows[d["doc_id"]]
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (sum(b - a for a, b in spans), len(spans), sha(kept))
    shorter = without_repeats([(d["text"] or "").encode() for d in docs], 256, False)
    for d, (_, spans) in zip(docs, shorter, strict=True):
        body = (d["text"] or "").encode()
        assert rows[d["doc_id"]]["n_passages"] == sum(len(body[a:z].split()) > 50 for a, z in spans)
