"""Near-duplicate classes: consistent weighted samples of TF-IDF shingles, banded, verified by weighted Jaccard similarity.

1. Document frequencies of all shingles are counted in hashed counters, whose number does not grow with the corpus.
2. Improved consistent weighted sampling draws ``BANDS * ROWS`` samples from the weights of each document; documents that
   agree on all samples of a band are candidates. Documents with equal words are one node from here on.
3. The candidate graph links each bucket's members to its first; its components are families. Each text goes once to its
   family's task, where pairs that share a band are compared until the components within the family are known. A family
   too large for one task is dealt out in parts; then members of the components meet the members outside, in rounds.
4. Components of the verified links are the classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import numbered, parallelism, shielded, slices, small_batches, unshielded, written, written_small
from marginalia.llm.graph import components

GRAM = 5
SIMILAR = 0.8
BANDS, ROWS = 10, 3
COUNTERS = 1 << 18
#: A shingle weighs from 1 (in every document) to 1 + ``RARE`` (in one), times its count in the text. The range is kept small: in a
#: large group of near copies the shared shingles are common and the edits rare, and a steeper weight would part them.
RARE = 0.05
#: Documents and bytes of text that one task compares.
PART_DOCS, PART_BYTES = 600, 8 << 20
#: Members of a family in parts that meet all others, in the first round.
PIVOTS = 32
#: Blocks of ``PART_DOCS`` pivots that a later round has at most; a task holds one block and one part.
BLOCKS = 16
#: What stands between words.
BETWEEN = r"[^\pL\pM\pN_]+"

_rng = np.random.default_rng(20240608)
_PLACES = 14
_r = _rng.gamma(2.0, 1.0, 1 << _PLACES)
_beta = _rng.random(1 << _PLACES)
_log_c = np.log(_rng.gamma(2.0, 1.0, 1 << _PLACES))
#: For each place, the parts of a consistent weighted sample that do not depend on the weight: 1 / r, beta, r; the value at level 0,
#: ln c - r + r beta; and the logarithm of the weight from which the level is 1 or more, r - r beta. A shingle finds its places by
#: multiplication with the odd numbers of ``_TURN``.
_RATE, _BETA, _R, _BASE, _STEP = (x.astype(np.float32) for x in (1 / _r, _beta, _r, _log_c - _r + _r * _beta, _r - _r * _beta))
_TURN = _rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _runs(h: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each run of ``gram`` word hashes."""
    run = np.zeros(len(h) - gram + 1, dtype=np.uint64)
    for i in range(gram):
        run = _mixed(run * np.uint64(3) + h[i : i + len(run)] + np.uint64(i + 1))
    return run


def shingles(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, bytes]]:
    """For each text, the sorted distinct 64-bit hashes of its shingles, their counts, and a digest of its words."""
    lower = pc.utf8_lower(pa.array(texts, pa.large_string()))
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.replace_substring_regex(lower, BETWEEN, " ")))
    coded = split.values.dictionary_encode()
    names = [xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    empty = xxhash.xxh64_intdigest(b"")
    h = np.array(names, dtype=np.uint64)[coded.indices.to_numpy(zero_copy_only=False)]
    all_runs = _runs(h, GRAM) if len(h) >= GRAM else h
    out = []
    bounds = split.offsets.to_numpy()
    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = h[x:y]
        if y - x == 0 or (y - x == 1 and int(own[0]) == empty):
            out.append((np.array([], np.uint64), np.array([], np.int64), b""))
            continue
        runs = all_runs[x : y - GRAM + 1] if y - x >= GRAM else _runs(own, y - x)
        out.append((*np.unique(runs, return_counts=True), hashlib.blake2b(own.tobytes(), digest_size=16).digest()))
    return out


def _weights(hashes: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Count times damped inverse document frequency; ``table`` has it for each counter."""
    return counts * table[hashes & np.uint64(len(table) - 1)]


def _drawn(places: np.ndarray, log_w: np.ndarray) -> np.ndarray:
    """Value of each draw. Most weights are near 1 and stay at level 0, so only the others compute their level."""
    values = _BASE[places]
    at = np.flatnonzero(np.broadcast_to(log_w, places.shape) >= _STEP[places])
    if len(at):
        own = places.reshape(-1)[at]
        values.reshape(-1)[at] -= _R[own] * _level(own, np.broadcast_to(log_w, places.shape).reshape(-1)[at])
    return values


def _level(places: np.ndarray, log_w: np.ndarray) -> np.ndarray:
    return np.floor(log_w * _RATE[places] + _BETA[places])


def _places(half: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return ((half * turn) >> np.uint32(32 - _PLACES)).astype(np.int32)


#: Shingles whose draws are held at a time.
_BLOCK = 4096


def _draw(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One 64-bit code for each consistent weighted sample of a text: the shingle drawn and its level."""
    log_w = np.log(weights).astype(np.float32)
    half = (hashes >> np.uint64(32)).astype(np.uint32)
    least, best = np.full(len(_TURN), np.inf, np.float32), np.zeros(len(_TURN), np.int64)
    for start in range(0, len(hashes), _BLOCK):
        own = slice(start, start + _BLOCK)
        places = _places(half[own], _TURN[:, None])
        values = _drawn(places, log_w[own])
        # Of equal values the smallest hash is drawn, as the hashes are sorted.
        first = np.argmin(values, axis=1)
        value = values[np.arange(len(_TURN)), first]
        closer = value < least
        least[closer], best[closer] = value[closer], start + first[closer]
    places = _places(half[best], _TURN)
    level = np.where(log_w[best] >= _STEP[places], _level(places, log_w[best]), 0)
    return hashes[best] ^ _mixed(level.astype(np.int64).astype(np.uint64))


def _bands(samples: np.ndarray) -> list[int]:
    codes = np.zeros(BANDS, dtype=np.uint64)
    for i, column in enumerate(samples.reshape(BANDS, ROWS).T):
        codes = _mixed(codes * np.uint64(5) + column + np.uint64(i))
    return codes.astype(np.int64).tolist()


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """Damped inverse document frequency of each counter, from all rows of ``text``.

    Tasks are merged to a few for each core first, so that what they send does not grow with the number of files.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = np.zeros(COUNTERS, dtype=np.int64), 0
        for b in batches:
            texts = b["text"].to_pylist()
            for s in slices(map(len, texts)):
                found = [hashes for hashes, _, _ in shingles(texts[s])]
                seen += sum(len(hashes) > 0 for hashes in found)
                # Two shingles of one text seldom share a counter; the few that do count twice.
                at = (np.concatenate(found) & np.uint64(COUNTERS - 1)).astype(np.int64)
                held += np.bincount(at, minlength=COUNTERS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(held[at], seen))], ["at", "n"])

    tasks = max(64, 4 * parallelism(rows.sparkSession))
    counts = rows.select("text").coalesce(tasks).mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # at most COUNTERS + 1 rows
    total = int(found.loc[found["at"] == -1, "n"].sum())
    df = np.zeros(COUNTERS)
    real = found[found["at"] >= 0]
    df[real["at"].to_numpy()] = real["n"].to_numpy()
    df = np.minimum(df, total)
    return 1 + RARE * np.log((1 + total) / (1 + df)) / np.log(2 + total)


def _signatures(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, numbers = b["text"].to_pylist(), b["_row"].to_pylist()
            for s in slices(map(len, texts)):
                rows, keys, sizes, bands = [], [], [], []
                for row, text, (hashes, counts, key) in zip(numbers[s], texts[s], shingles(texts[s]), strict=True):
                    if len(hashes):
                        rows.append(row)
                        keys.append(key)
                        sizes.append(len(text))
                        bands.append(_bands(_draw(hashes, _weights(hashes, counts, table))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                     pa.array(bands, pa.list_(pa.int64()))], ["_row", "key", "size", "bands"])

    return run


class Family:
    """Texts of one task, compared by weighted Jaccard similarity."""

    def __init__(self, table: np.ndarray, similar: float) -> None:
        self.table, self.similar = table, similar

    def load(self, packed: Iterable[bytes]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """Shingles, weights and total weight of each text."""
        texts = [zstandard.decompress(p).decode() for p in packed]
        out = []
        for s in slices(map(len, texts)):
            for hashes, counts, _ in shingles(texts[s]):
                weights = _weights(hashes, counts, self.table)
                out.append((hashes, weights, float(weights.sum())))
        return out

    def alike(self, a: tuple, b: tuple) -> bool:
        if min(a[2], b[2]) < self.similar * max(a[2], b[2]):
            return False
        at = np.searchsorted(b[0], a[0])
        at[at == len(b[0])] = 0
        same = b[0][at] == a[0]
        both = float(np.minimum(a[1][same], b[1][at[same]]).sum())
        return both >= self.similar * (a[2] + b[2] - both)

    def links(self, texts: list, bands: np.ndarray) -> list[tuple[int, int]]:
        """A link for each step that joins two components; candidates share a band and are compared until one is found."""
        label = np.arange(len(texts))
        degree = np.zeros(len(texts), dtype=np.int64)
        out = []
        for i in range(1, len(texts)):
            near = np.flatnonzero((bands[:i] == bands[i]).any(axis=1))
            # Best-linked members first, so that a text is likely to meet its match at once.
            for j in near[np.argsort(-degree[near], kind="stable")].tolist():
                if label[j] != label[i] and self.alike(texts[i], texts[j]):
                    out.append((i, j))
                    degree[[i, j]] += 1
                    label[label == label[j]] = label[i]
        return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        i = b.schema.get_field_index("text")
        yield b.set_column(i, pa.field("text", pa.binary()), pa.array([pack(t.as_buffer()) for t in b["text"].cast(pa.binary())]))


def classes_of(texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """_row, class_row (the smallest _row of the class) and links of each row of the written table ``texts`` that has words.

    ``texts`` has _row and text, neither of them null.
    """
    with small_batches(texts.sparkSession):
        return _classes_of(texts, similar)


def _classes_of(texts: DataFrame, similar: float) -> DataFrame:
    table = document_frequencies(texts)
    signed = written(
        texts.mapInArrow(_signatures(table), "_row long, key binary, size long, bands array<long>"), "signatures")

    # Equal words: one node, named by its first row.
    nodes = written(
        signed.groupBy("key").agg(F.min(F.struct("_row", "size", "bands")).alias("first"))
        .select("key", F.col("first._row").alias("node"), "first.size", "first.bands"), "nodes")
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "code"))
    stars = written_small(buckets.groupBy("band", "code").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1"), "stars")
    candidates = buckets.join(stars, ["band", "code"]).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    families = components(candidates)

    # Size of each family decides into how many parts it is dealt; a part is compared within one task.
    sized = written(families.join(nodes.select("node", "size", "bands"), "node"), "members")
    parts = written_small(
        sized.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("chars")).select(
            "root", F.ceil(F.greatest(F.col("n") / PART_DOCS, F.col("chars") / PART_BYTES)).cast("int").alias("parts")),
        "parts")
    dealt = sized.join(parts, "root").select(
        "node", "root", "parts", "size", "bands", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    packed = texts.mapInArrow(_packed, "_row long, text binary")
    members = written(
        dealt.join(packed, dealt.node == packed._row).select("node", "root", "parts", "part", "size", "bands", "text"), "families")

    family = Family(table, similar)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        nodes_here = group["node"].tolist()
        found = family.links(family.load(group["text"]), np.stack(group["bands"].to_numpy()))
        return pd.DataFrame({"a": [nodes_here[i] for i, _ in found], "b": [nodes_here[j] for _, j in found]}, dtype="int64")

    # Comparing costs more than the bytes tell, hence a number of tasks of our own.
    spread_out = members.repartition(4 * parallelism(texts.sparkSession), "root", "part")
    links = written(spread_out.groupBy("root", "part").applyInPandas(compare, "a long, b long"), "links")

    # Families in parts: members meet all that share a band with them in the other components. The best-linked member of each component
    # comes first, of large components before small ones, which mostly leaves one component; then those still outside
    # the largest component, sixteen times as many each round up to ``BLOCKS`` blocks. Pivots are dealt into blocks by number and
    # bytes, and each part meets each block in a task of its own. Once all of these have had their turn, any link between two
    # components would have been found, as one of its ends is outside the largest.
    large = members.where("parts > 1")
    tried: DataFrame | None = None
    pivots_now = PIVOTS
    more = bool(large.limit(1).count())
    while more:
        labels = components(links)
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
        now = written_small(
            large.select("node", F.col("root").alias("family"), "part", "size").join(labels, "node", "left").join(degree, "node", "left")
            .select("node", "family", "part", "size", F.coalesce("root", "node").alias("class"), F.coalesce("n", F.lit(0)).alias("n")),
            "now")
        classes_now = written_small(
            now.groupBy("family", "class").agg(
                F.count("*").alias("members"), F.max(F.struct("n", (-F.col("node")).alias("back"), "size")).alias("top"))
            .select("family", "class", "members", (-F.col("top.back")).alias("head"), F.col("top.size").alias("head_size")), "classes")
        biggest = classes_now.groupBy("family").agg(F.max(F.struct("members", "class")).alias("big")).select(
            "family", F.col("big.class").alias("largest"))
        heads = classes_now.select("family", "class", "members", F.col("head").alias("pivot"), F.col("head_size").alias("size"), F.lit(0).alias("turn"))
        others = now.join(classes_now.drop("family", "head_size"), "class").join(biggest, "family").where("class <> largest and node <> head").select(
            "family", "class", "members", F.col("node").alias("pivot"), "size", F.lit(1).alias("turn"))
        waiting = heads.unionByName(others)
        if tried is not None:
            waiting = waiting.join(tried, "pivot", "left_anti")
        order = Window.partitionBy("family").orderBy("turn", F.desc("members"), "pivot")
        # Both parts of the sum only grow, so a block has the same of either: at most PART_DOCS pivots and PART_BYTES plus one text.
        before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        placed = waiting.withColumns({"place": F.row_number().over(order), "before": before}).where(F.col("place") <= pivots_now)
        block = F.floor((F.col("place") - 1) / PART_DOCS) + F.floor(F.col("before") / PART_BYTES)
        pivots = written_small(placed.withColumn("block", block.cast("int")), "pivots")
        if not pivots.limit(1).count():
            break
        tried = written_small(pivots.select("pivot") if tried is None else tried.union(pivots.select("pivot")), "tried")
        texts_of = large.select(F.col("node").alias("pivot"), F.col("text").alias("p_text"), F.col("bands").alias("p_bands"))
        spread = pivots.select("family", F.col("class").alias("p_class"), "pivot", "block").join(texts_of, "pivot").join(
            parts.select(F.col("root").alias("family"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "family"
        ).select("family", "part", "block", "pivot", "p_class", "p_bands", "p_text").toDF(
            "to_family", "to_part", "to_block", "pivot", "p_class", "p_bands", "p_text")
        blocks = pivots.select("family", "block").distinct()
        outside = large.select("node", "bands", "text").join(now, "node").join(blocks, "family").select(
            "family", "part", "block", "node", "class", "bands", "text")

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(left) and len(right):
                bands = np.stack(right["p_bands"].to_numpy())
                nodes_here, classes_here = right["pivot"].tolist(), right["p_class"].to_numpy()
                near_of = [
                    np.flatnonzero((bands == own).any(axis=1) & (classes_here != cls)).tolist()
                    for own, cls in zip(left["bands"], left["class"], strict=True)]
                # Both sides are bounded by a part and a block; texts that nothing meets are not opened.
                asked = [i for i, near in enumerate(near_of) if near]
                met = sorted({k for near in near_of for k in near})
                ours = dict(zip(asked, family.load(left["text"].iloc[asked]), strict=True))
                theirs = dict(zip(met, family.load(right["p_text"].iloc[met]), strict=True))
                for i in asked:
                    known = {left["class"].iloc[i]}
                    for k in near_of[i]:
                        if classes_here[k] not in known and family.alike(ours[i], theirs[k]):
                            known.add(classes_here[k])
                            out.append((left["node"].iloc[i], nodes_here[k]))
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        found = written(
            outside.groupBy("family", "part", "block").cogroup(spread.groupBy("to_family", "to_part", "to_block")).applyInPandas(
                meet, "a long, b long"),
            "found")
        links = written(links.union(found), "links")
        pivots_now = max(PIVOTS, min(16 * pivots_now, BLOCKS * PART_DOCS))

    labels = components(links)
    counts = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    classes = written_small(
        nodes.select("key", "node").join(labels, "node", "left").join(counts, "node", "left").select(
            "key", F.coalesce("root", "node").alias("class_row"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
    return written(signed.select("_row", "key").join(classes, "key").select("_row", "class_row", "links"), "rows")


def near_duplicates(docs: DataFrame, text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` with row, class_row (the smallest row of the class) and links.

    Rows are numbered in the order of the table. links counts the links that were verified to put the row's text in its class. Words are runs of
    letters, digits and underscores in lower case, shingles are five words, a shorter text is one shingle. Rows with equal
    words are always in one class. A null text or one without words is a class of its own. Repeated rows fall into one
    class. All columns stay, but for those that have the names of the results. An empty table gives an empty result.
    """
    inner, names = shielded(docs)
    held = numbered(inner, "docs")
    found = classes_of(held.select("_row", F.coalesce(F.col(names[text_col]), F.lit("")).alias("text")), similar)
    return unshielded(held.join(found, "_row", "left"), names, {
        "row": F.col("_row"), "class_row": F.coalesce("class_row", "_row"), "links": F.coalesce("links", F.lit(0)).cast("long")})


def class_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per document: its id, class_id (the id of the first row of its class) and links. Ids may repeat or be null."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = written(near_duplicates(slim, "text", similar).drop("text"), "classified")
    names = written(found.where("row = class_row").select("class_row", F.col("id").alias("class_id")), "names")
    return found.join(names, "class_row").select(F.col("id").alias(id_col), "class_id", "links")


def one_of_each(docs: DataFrame, text_col: str = "text", similar: float = SIMILAR, blanks_apart: bool = True) -> DataFrame:
    """The first row of each class, with the columns of ``docs``.

    Texts without words are classes of their own; without ``blanks_apart`` they are one class.
    """
    inner, names = shielded(docs)
    held = numbered(inner, "docs")
    found = classes_of(held.select("_row", F.coalesce(F.col(names[text_col]), F.lit("")).alias("text")), similar)
    # The merge keeps to one plan at every size: what goes grows with the table.
    later = found.where("_row <> class_row").select("_row")
    if not blanks_apart:
        blank = held.select("_row").join(found.select("_row").hint("merge"), "_row", "left_anti")
        first = blank.agg(F.min("_row")).first()[0]
        later = later.unionByName(blank.where(F.col("_row") > F.lit(first)))
    return unshielded(held.join(later.hint("merge"), "_row", "left_anti"), names, {})
