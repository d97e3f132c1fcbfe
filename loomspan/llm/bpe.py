"""Byte-level BPE as a monoid: a text is halved down to leaves, and encodings of neighbours are joined up the tree.

An element is a stretch of text with its ids. Joining two neighbours re-encodes only a window around the border. The
window grows, on either side, until it ends at a place where the split pattern has a match border whatever stands
around it: a border between a letter, number or symbol and white space after it, or between two of these three kinds
(an apostrophe apart, which contractions tie to letters). Matches are encoded one by one and the scan looks at nothing
before a match, so the ids outside such a window are final.

A long run of white space, letters, numbers or symbols has no such place inside. It is one match, whose ends follow from
the characters beside it, and is a tree of its own: there the window is one of tokens, and grows until its outer tokens
are stable next to their neighbours, as a sequence of byte pair tokens is the encoding of its bytes exactly if each
adjacent pair encodes to itself.

Decoding joins the bytes of the leaves up the same kind of tree.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.memory import tidy

#: Code points of a leaf, and of the first window on each side of a border.
LEAF, WINDOW = 512, 48
#: A run is long if it holds a whole block of so many characters that begins at a multiple of it. Bytes of a leaf in a run.
BLOCK, PIECE = 1024, 512
#: Ids of a leaf when decoding.
DECODE_LEAF = 1 << 14


@functools.lru_cache(maxsize=4)
def load(path: str, pattern: str):
    """The encoder of a file of ranks; kept by each worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(f"ranks-{len(ranks)}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1 << 16)
def _kind(c: str) -> str:
    """white space, letter, number or symbol, as the split pattern has them; apostrophes are of no kind."""
    if c.isspace() and c not in "\x1c\x1d\x1e\x1f":
        return "W"
    major = unicodedata.category(c)[0]
    if major in "LN":
        return major
    return "?" if c == "'" or major == "C" else "S"


def _border(a: str, b: str) -> bool:
    """Whether every scan has a match border between the characters a and b."""
    x, y = _kind(a), _kind(b)
    return x != y and "?" not in (x, y) and x != "W"


# The white space of the split pattern, and its contractions.
_WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CONTRACTED = ("s", "t", "re", "ve", "m", "ll", "d")
_RUN_OF = [regex.compile(c) for c in (rf"[{_WHITE}]++", r"\p{L}++", r"\p{N}++", rf"[^{_WHITE}\p{{L}}\p{{N}}]++")]
_SYMBOL = _RUN_OF[3]


def long_runs(text: str):
    """``(start, end)`` of the matches of the split pattern that long runs of one kind are."""
    done, n = 0, len(text)
    for block in range(0, n - BLOCK + 1, BLOCK):
        if block < done:
            continue
        kind = next((k for k, run in enumerate(_RUN_OF) if run.fullmatch(text, block, block + BLOCK)), None)
        if kind is None:
            continue
        i, j = block, _RUN_OF[kind].match(text, block).end()
        while i > done and _RUN_OF[kind].match(text[i - 1]):
            i -= 1
        done = j
        if kind == 0:
            yield i, j - (j < n)  # the last blank before something belongs to what follows
            continue
        before = text[i - 1 : i]
        if before == " ":
            i -= 1
        elif _RUN_OF[0].match(before):
            yield i - 1, i  # a match of its own, and not the end of the blanks before it
        elif before == "'" and kind == 1 and text[i - 2 : i - 1] != " " and not (i > 1 and _SYMBOL.match(text[i - 2])):
            i += next((len(c) for c in _CONTRACTED if text.startswith(c, i)), 0)
        yield i, j


class Bpe:
    """Encodes and decodes by the ranks at ``path``, cut into matches of ``pattern``."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF):
        self.encoding, self.leaf = load(path, pattern), max(2, leaf)
        self._ids = self.encoding.encode_ordinary
        self._single, self._piece = self.encoding.decode_single_token_bytes, self.encoding._encode_single_piece

    def encode(self, text: str) -> list[int]:
        out, at = [], 0
        for i, j in long_runs(text):
            out += [*self._tree(text, at, i), *self._run(text[i:j].encode())]
            at = j
        return out + self._tree(text, at, len(text)) if at else self._tree(text, 0, len(text))

    def _tree(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self._ids(text[start:end])
        middle = (start + end) // 2
        return self._join(text, start, middle, end, self._tree(text, start, middle), self._tree(text, middle, end))

    def _join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        width = WINDOW
        while True:
            a = next((i for i in range(middle - 1, max(start, middle - width), -1) if _border(text[i - 1], text[i])), None)
            b = next((i for i in range(middle + 1, min(end, middle + width)) if _border(text[i - 1], text[i])), None)
            a = start if a is None and middle - width <= start else a
            b = end if b is None and middle + width >= end else b
            if a is not None and b is not None:
                break
            width *= 4
        keep = len(left) - len(self._ids(text[a:middle])) if a > start else 0
        drop = len(self._ids(text[middle:b])) if b < end else len(right)
        return [*left[:keep], *self._ids(text[a:b]), *right[drop:]]

    def _run(self, data: bytes) -> list[int]:
        """The ids of one match, from those of its halves."""
        if len(data) <= PIECE:
            return self._piece(data) if data else []
        middle = len(data) // 2
        left, right = self._run(data[:middle]), self._run(data[middle:])
        stable = lambda p, q: self._piece(self._single(p) + self._single(q)) == [p, q]
        width = 4
        while True:
            ids = self._piece(b"".join(map(self._single, (*left[-width:], *right[:width]))))
            done = width >= len(left) or stable(left[-width - 1], ids[0])
            if done and (width >= len(right) or stable(ids[-1], right[width])):
                return [*left[:-width], *ids, *right[width:]]
            width *= 4

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return self.encoding.decode_bytes(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def with_ids(documents: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded])`` for every row.

    ``ids`` are those of every whole text without special tokens, ``decoded`` the bytes that they decode to. Null and
    empty texts have no ids. Rows repeat as they come; ids may be null; other columns are not read. ``keep`` names
    the large columns to return.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def encode(batches):
        bpe = Bpe(path, pattern)
        for batch in batches:
            n, ids, bytes_, digests, more = [], [], [], [], []
            for x in batch.column(1):
                got = bpe.encode(x.as_py() or "")
                n.append(len(got))
                packed = np.array(got, dtype="<u4").tobytes()
                digests.append(hashlib.sha256(packed).hexdigest())
                back = bpe.decode(got)
                more.append(hashlib.sha256(back).hexdigest())
                ids.append(packed)
                bytes_.append(back if "decoded" in keep else None)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(more, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if "ids" in keep:
                cuts = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                names.append("ids")
            if "decoded" in keep:
                columns.append(pa.array(bytes_, pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ("ids" in keep) + ", decoded binary" * ("decoded" in keep)
    return docs.mapInArrow(tidy(encode), schema)
