"""Token-id files of patched frame-of-reference blocks.

A stream of integers is cut into blocks of ``BLOCK``. From each value the block's minimum is taken; the rest is packed
at the width that holds ``PERCENT`` of the block's values, and the values that are wider go to an exception list
(position in the block, value). The start of every block is indexed, so that a range of ids is read without the rest.

A file holds the documents of one stretch of ids in ascending order, as three streams: ids of the documents, their
lengths, and all token ids one after another. Layout, little-endian: ``PFOR``, u32 version, u64 documents, u64 leading
documents without id, 3 x u64 stream lengths, the streams. A stream: u64 values, u32 blocks, i64 minima, u8 widths,
u16 exceptions a block, u64 block starts (one more than blocks), packed bits, u16 positions, u64 values.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.llm.files import open_new, open_range
from loomspan.operators.tables import new_path, written

BLOCK, PERCENT = 1024, 95
#: Token ids after which a file is closed and the next begun.
FILE_TOKENS = 1 << 21
#: Words and pieces that a worker keeps encoded.
KEPT = 1 << 19


def pack(values: np.ndarray) -> bytes:
    """The stream of ``values`` (integers of up to 63 bits)."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return struct.pack("<QIQ", 0, 0, 0)
    padded = np.full(blocks * BLOCK, values[-1], dtype=np.int64)
    padded[:n] = values
    table = padded.reshape(blocks, BLOCK)
    low = table.min(axis=1)
    rest = (table - low[:, None]).view(np.uint64)
    at = BLOCK * PERCENT // 100
    widths = np.ceil(np.log2(np.partition(rest, at, axis=1)[:, at].astype(np.float64) + 1)).astype(np.uint8)
    wide = (rest >> widths[:, None].astype(np.uint64)) > 0
    where = np.nonzero(wide)
    sizes = BLOCK * widths.astype(np.int64) // 8
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    packed = np.zeros(int(starts[-1]), np.uint8)
    for w in map(int, np.unique(widths)):
        if w:
            own = np.flatnonzero(widths == w)
            unit = 2 if w <= 16 else 8
            bits = np.unpackbits(np.ascontiguousarray(rest[own].astype(f"<u{unit}")).view(np.uint8), bitorder="little").reshape(len(own), BLOCK, unit * 8)
            rows = np.packbits(bits[:, :, :w].reshape(len(own), -1), axis=1, bitorder="little")
            packed[(starts[own].astype(np.int64)[:, None] + np.arange(sizes[own[0]]))] = rows
    return b"".join(
        [struct.pack("<QI", n, blocks), low.astype("<i8").tobytes(), widths.tobytes(), wide.sum(axis=1).astype("<u2").tobytes(), starts.tobytes(), packed.tobytes(), where[1].astype("<u2").tobytes(), rest[where].astype("<u8").tobytes()]
    )


def unpack(stream: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values from ``first`` up to before ``last``; only the blocks that hold them are unpacked."""
    n, blocks = struct.unpack_from("<QI", stream)
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.int64)
    at = 12
    parts = []
    for kind, many in (("<i8", blocks), ("u1", blocks), ("<u2", blocks), ("<u8", blocks + 1)):
        parts.append(np.frombuffer(stream, kind, many, at))
        at += parts[-1].nbytes
    low, widths, spare, starts = parts
    spare = spare.astype(np.int64)
    body = np.frombuffer(stream, np.uint8, int(starts[-1]), at)
    at += int(starts[-1])
    total = int(spare.sum())
    places, patches = np.frombuffer(stream, "<u2", total, at), np.frombuffer(stream, "<u8", total, at + 2 * total)
    a, b = first // BLOCK, -(-last // BLOCK)
    out = np.zeros((b - a, BLOCK), np.uint64)
    for w in map(int, np.unique(widths[a:b])):
        if w:
            own = a + np.flatnonzero(widths[a:b] == w)
            rows = body[starts[own].astype(np.int64)[:, None] + np.arange(BLOCK * w // 8)]
            unit = 16 if w <= 16 else 64
            bits = np.zeros((len(own), BLOCK, unit), np.uint8)
            bits[:, :, :w] = np.unpackbits(rows, axis=1, bitorder="little").reshape(len(own), BLOCK, w)
            out[own - a] = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little").view(f"<u{unit // 8}")
    skip = int(spare[:a].sum())
    upto = skip + int(spare[a:b].sum())
    out[np.repeat(np.arange(b - a), spare[a:b]), places[skip:upto]] = patches[skip:upto]
    return (out.view(np.int64) + low[a:b, None]).ravel()[first - a * BLOCK : last - a * BLOCK]


def file_bytes(ids: list, lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    nulls = sum(x is None for x in ids)
    streams = [pack(np.array(ids[nulls:], dtype=np.int64)), pack(lengths), pack(tokens)]
    return b"".join([b"PFOR", struct.pack("<IQQ3Q", 1, len(ids), nulls, *map(len, streams)), *streams])


def read_file(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Ids, lengths and tokens of a file."""
    if data[:4] != b"PFOR":
        raise ValueError("not a token-id file")
    _, _, nulls, *sizes = struct.unpack_from("<IQQ3Q", data, 4)
    cuts = np.cumsum([48, *sizes])
    ids, lengths, tokens = (unpack(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
    return [None] * nulls + ids.tolist(), lengths, tokens


#: Words that the library lower-cases and splits as Python does, so that their pieces can be looked up one by one.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")


# The normalizer and the pre-tokenizer of a file whose words can be encoded one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class WordEncoder:
    """Encodes as the tokenizers library does with a file, without adding special tokens; those that a text spells out keep their ids.

    Where white space only separates words (the normalizer and pre-tokenizer above) words are encoded once and kept;
    words that hold a special token go to the library. With any other file every text goes to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        plan = json.loads(self.whole.to_str())
        added = plan["added_tokens"]
        whole_words = plan["normalizer"] == _NORMALIZER and plan["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]} and plan["model"]["type"] == "BPE" and not plan["post_processor"]
        self.by_word = whole_words and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in added)
        self.special = [t["content"] for t in added]
        self.kind = "u2" if max(self.whole.get_vocab_size(), *(t["id"] + 1 for t in added), 0, 0) <= 1 << 16 else "u4"
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in kept]
        self.letters = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}

    def _part(self, part: str) -> bytes:
        if (got := self.parts.get(part)) is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            got = self.parts[part] = self._packed([x.id for x in self.whole.model.tokenize(shown)])
        return got

    def _packed(self, ids: list[int]) -> bytes:
        return array.array("H" if self.kind == "u2" else "I", ids).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if not _PLAIN.fullmatch(text) or any(t in text for t in self.special):
            return self._packed(self.whole.encode(text, add_special_tokens=False).ids)
        text = text.lower()
        if text.isalpha():
            return self._part(text)
        if text[:-1].isalpha():  # and a symbol or digit
            return self._part(text[:-1]) + self._part(text[-1])
        return b"".join(map(self._part, self.cut(text)))

    def __call__(self, text: bytes) -> np.ndarray:
        if not self.by_word:
            return np.array(self.whole.encode(text.decode(), add_special_tokens=False).ids, self.kind)
        words, kept = text.split(), self.words
        try:
            got = b"".join([kept[w] for w in words])
        except KeyError:
            if len(kept) > KEPT:
                kept.clear()
            if len(self.parts) > KEPT:
                self.parts.clear()
            for w in set(words):
                if w not in kept:
                    kept[w] = self._word(w)
            got = b"".join([kept[w] for w in words])
        return np.frombuffer(got, self.kind)


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_corpus(documents: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the documents' ids, ``end_id`` after each, and returns the manifest ``(uri, n_docs, n_tokens, start)``.

    Documents are ordered by id, nulls first, rows of one id by text; ids are integers. Null and empty texts have only
    the end id. ``start`` counts the ids in the files before. Files are named by attempt and listed only by the task
    that ended, so a lost executor leaves none half-written in the manifest. Other columns are not read.
    """
    folder = new_path(documents.sparkSession, "token-files")
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def write(batches):
        encode, part, seq = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, chunks, lengths, held = [], [], [], 0
        end = np.array([end_id], "<u4")

        def close():
            uri = f"{folder}/part-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.pfor"
            tokens = np.concatenate(chunks)
            with open_new(uri) as out:
                out.write(file_bytes(ids, np.array(lengths, np.int64), tokens))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "uri": [uri], "n_docs": [len(ids)], "n_tokens": [len(tokens)]}, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            texts = batch.column(1).cast(pa.binary() if batch.column(1).type == pa.string() else pa.large_binary())
            for key, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                got = encode(text.as_py() or b"")
                ids.append(key)
                lengths.append(len(got) + 1)
                chunks += [got, end]
                held += len(got) + 1
                if held >= FILE_TOKENS:
                    yield close()
                    seq += 1
                    ids, chunks, lengths, held = [], [], [], 0
        if ids:
            yield close()

    ranged = docs.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")  # rows of one id, or of none, are several tasks
    manifest = written(ranged.mapInArrow(write, "part int, seq int, uri string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return written(manifest.select("uri", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start")), "starts")


def read_corpus(manifest: DataFrame, tokens: bool = True) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32[, tokens])`` of every document, from the files of a manifest."""
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open_range(row["uri"]) as f:
                    ids, lengths, values = read_file(f.read())
                cuts = np.concatenate([[0], np.cumsum(lengths)])
                flat = values.astype("<u4")
                sums = [zlib.crc32(flat[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                columns = {"id": pa.array(ids, pa.int64()), "start": pa.array(cuts[:-1] + row["start"]), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(sums, pa.int64())}
                if tokens:
                    columns["tokens"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", tokens array<int>" * tokens
    return manifest.repartition(n, "uri").mapInArrow(read, schema)
