"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes of a text chooses chunk borders, so equal passages give equal chunks wherever they stand.
The core of a chunk runs from its first white space to its last; the tokenizer always splits there, so the tokens of a
core are the same in any text. A core that occurs more than once in the corpus is encoded once, in the first document
that holds it, and its tokens are joined to the others. What lies between two cores is the join: it is encoded anew,
outward from the border to the white space on either side, through whole chunks if they hold none, which is where both
neighbours agree. The result equals encoding each whole text.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import slices, written

#: A border falls where the top ``BITS`` bits of the rolling hash over ``SPAN`` bytes are zero, ``LEAST`` bytes apart.
SPAN, BITS, LEAST = 32, 10, 256
#: Cores below this many bytes are not worth a row.
SMALL = 64
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 13, 32]] = True
GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint32)


def _tokenizer(path: str):
    """Loaded once in each task that has rows."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, the hash of the ``SPAN`` bytes that end there, by doubling."""
    h, n = GEAR[data], 1
    while n < SPAN:
        longer = h.copy()
        longer[n:] += h[:-n] << np.uint32(n)
        h, n = longer, 2 * n
    return h


def cores_of(texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each text, the start and end of each chunk's core, in order."""
    joined = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if not len(joined):
        return [[] for _ in texts]
    marks = np.flatnonzero(_rolling(joined) >> np.uint32(32 - BITS) == 0) + 1
    white = np.flatnonzero(WHITE[joined])
    found, start = [], 0
    for text in texts:
        end = start + len(text)
        borders = [start]
        for m in marks[np.searchsorted(marks, start + LEAST) : np.searchsorted(marks, end)].tolist():
            if m - borders[-1] >= LEAST:
                borders.append(m)
        borders.append(end)
        cores = []
        for a, b in zip(borders, borders[1:], strict=False):
            i, j = np.searchsorted(white, (a, b))
            first = a if a == start else (int(white[i]) if i < j else b)
            last = b if b == end else (int(white[j - 1]) if i < j else a)
            if last - first >= SMALL:
                cores.append((first - start, last - start))
        found.append(cores)
        start = end
    return found


def _digest(core: bytes) -> bytes:
    return hashlib.blake2b(core, digest_size=16).digest()


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, texts = b["key"].to_pylist(), [t.as_buffer() for t in b["text"].cast(pa.binary())]
        for s in slices(map(len, texts)):
            part = [t.to_pybytes() for t in texts[s]]
            rows = [
                (key, i, _digest(text[x:y]))
                for key, text, cores in zip(keys[s], part, cores_of(part), strict=True)
                for i, (x, y) in enumerate(cores)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([r[2] for r in rows], pa.binary())], ["key", "idx", "chunk"])


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        small = [pack(t.as_buffer()) for t in b["text"].cast(pa.binary())]
        i = b.schema.get_field_index("text")
        yield b.set_column(i, pa.field("text", pa.binary()), pa.array(small, pa.binary()))


def _unpacked(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(t) for t in column.to_pylist()]


class Encoder:
    """Encodes many pieces at once: each distinct word of a batch is given to the tokenizer once.

    Words are what stands between ASCII white space; a blank is also put between an ASCII letter and a mark behind it, where
    the tokenizer splits anyway. Pieces with the beginning of a special token are encoded as they are.
    """

    JOINED = 500

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        if self.tokenizer.decoder is not None:
            raise ValueError("the tokens of a text must be decoded one by one and joined by blanks")
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        words = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.ends = np.array([w.endswith("</w>") for w in words])
        self.vocabulary = pa.array(words, pa.string())

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[list[int]]:
        """Ids of words of letters, many in one call: each is one unit of the tokenizer, whose last token has the word end."""
        out: list[list[int]] = []
        for i in range(0, len(words), self.JOINED):
            part = words[i : i + self.JOINED]
            ids = self._plain([" ".join(part)])[0]
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            # Every word has an end at least, so that equal numbers mean one each.
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                out += [ids[x:y] for x, y in zip([0, *cuts], cuts, strict=False)]
            else:
                out += self._plain(part)
        return out

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        own = [i for i, p in enumerate(pieces) if b"<|" in p]
        texts = pa.array([b"" if b"<|" in p else p for p in pieces], pa.binary()).cast(pa.large_string())
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, r"([A-Za-z])([.,;:!?])", r"\1 \2"))
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        letters = pc.utf8_is_alpha(coded.dictionary).to_pylist()
        found: list[list[int]] = [[]] * len(words)
        for group, how in ((True, self._letters), (False, self._plain)):
            at = [i for i, alpha in enumerate(letters) if alpha is group and words[i]]
            for i, ids in zip(at, how([words[i] for i in at]), strict=True):
                found[i] = ids
        sizes = np.array([len(f) for f in found], dtype=np.int64)
        flat = np.fromiter((i for f in found for i in f), dtype="<u4", count=int(sizes.sum()))
        index = coded.indices.to_numpy(zero_copy_only=False)
        counts = sizes[index]
        ends = np.append(0, np.cumsum(counts))
        source = np.repeat((np.cumsum(sizes) - sizes)[index] - ends[:-1], counts) + np.arange(ends[-1])
        ids = flat[source]
        bounds = ends[split.offsets.to_numpy()]
        out = [ids[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        for i, e in zip(own, self._plain([pieces[i].decode() for i in own]), strict=True):
            out[i] = np.array(e, dtype="<u4")
        return out

    def decode(self, ids: list[np.ndarray]) -> pa.Array:
        """The tokens of each list of ids, joined by blanks."""
        offsets = np.append(0, np.cumsum([len(i) for i in ids]))
        tokens = self.vocabulary.take(pa.array(np.concatenate([np.array([], "<u4"), *ids])))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens), " ")


def _encode_shared(path: str):
    """Rows of packed texts with the chunks that each is to encode for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        seen: set[bytes] = set()
        for b in batches:
            encoder = encoder or Encoder(path)
            for s in slices(3 * len(t) for t in b["text"].to_pylist()):
                part = b.slice(s.start, s.stop - s.start)
                texts = _unpacked(part["text"])
                chunks, pieces = [], []
                for key, text, cores, own in zip(
                    part["key"].to_pylist(), texts, cores_of(texts), part["own"].to_pylist(), strict=True
                ):
                    # A repeated row holds the same chunks; should it come to another task, they are joined twice over.
                    for one in own if key not in seen else ():
                        x, y = cores[one["idx"]]
                        chunks.append(one["chunk"])
                        pieces.append(text[x:y])
                    seen.add(key)
                ids = [zstandard.compress(i.tobytes(), 3) for i in encoder.encode(pieces)]
                yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.binary()), pa.array(ids, pa.binary())], ["chunk", "ids"])

    return run


def _assemble(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        encoder = None
        for b in batches:
            encoder = encoder or Encoder(path)
            for s in slices(3 * len(t) for t in b["text"].to_pylist()):
                part = b.slice(s.start, s.stop - s.start)
                texts = _unpacked(part["text"])
                plans, pieces = [], []
                for text, cores, known in zip(texts, cores_of(texts), part["known"].to_pylist(), strict=True):
                    given = {one["idx"]: one["ids"] for one in known or ()}
                    plan, at = [], 0
                    for i, (x, y) in enumerate(cores):
                        if i in given:
                            if at < x:
                                plan.append(len(pieces))
                                pieces.append(text[at:x])
                            plan.append(given[i])
                            at = y
                    # Cores that nobody shares are encoded together with the joins around them.
                    if at < len(text):
                        plan.append(len(pieces))
                        pieces.append(text[at:])
                    plans.append(plan)
                fresh = encoder.encode(pieces)
                ids = [
                    np.concatenate([np.array([], "<u4"), *[
                        fresh[p] if isinstance(p, int) else np.frombuffer(unpack(p), "<u4") for p in plan]])
                    for plan in plans]
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary()),
                     encoder.decode(ids)], ["id", "n_tokens", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_tokens, ids (little-endian unsigned 32-bit, packed) and decoded, the text of the ids.

    ``tokenizer`` is the path of a file of the tokenizers library that splits at white space and is present on every
    executor. A null text counts as empty and has no ids. Repeated rows and ids, also null ones, give a row each. An empty
    table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own_id = F.col(f"`{id_col}`")
    # Rows of equal id and text share a key, and also all results; it needs no row numbers.
    key = F.unhex(F.md5(F.concat_ws("\0", F.coalesce(own_id.cast("string"), F.lit("-")), text)))
    keyed = docs.select(own_id.alias("id"), key.alias("key"), text.alias("text"))
    id_type = keyed.schema["id"].dataType.simpleString()

    chunks = written(keyed.select("key", "text").mapInArrow(_chunk_rows, "key binary, idx int, chunk binary"), "chunks")
    shared = chunks.groupBy("chunk").agg(F.count("*").alias("n"), F.min(F.struct("key", "idx")).alias("first")).where("n > 1")
    owners = shared.groupBy("first.key").agg(F.collect_list(F.struct(F.col("first.idx").alias("idx"), "chunk")).alias("own"))
    # A key that cannot be null needs no filter before a join, so that both joins below share one exchange of the texts.
    packed = keyed.mapInArrow(_packed_rows, T.StructType([
        T.StructField("id", keyed.schema["id"].dataType), T.StructField("key", T.BinaryType(), False),
        T.StructField("text", T.BinaryType())]))

    encoded = packed.join(owners.hint("merge"), "key").mapInArrow(_encode_shared(tokenizer), "chunk binary, ids binary")
    known = chunks.join(encoded, "chunk").groupBy("key").agg(F.collect_list(F.struct("idx", "ids")).alias("known"))
    result = packed.join(known.hint("merge"), "key", "left").select("id", "text", "known").mapInArrow(
        _assemble(tokenizer), f"id {id_type}, n_tokens long, ids binary, decoded string")
    return result.withColumnRenamed("id", id_col)
