"""Byte-level BPE encoding and decoding as a reduction over a tree of text halves.

A text is halved down to leaves of LEAF characters. A leaf is encoded alone; two neighbours are
joined by encoding a window around their boundary anew. Which ids outside the window stay is
proved, not assumed: at a position where a character other than white space is followed by a
space or newline, every match of the splitting pattern ends, whatever stands before, because no
match goes on from another character to white space; and no match looks further ahead than that
white space. So ids left of such a position in the left half, and right of one in the right
half, are those of the whole text. The window grows until it has such a position on both sides
or reaches the end of the half. Decoding concatenates bytes up the same kind of tree.

The result equals Encoding.encode_ordinary of the tiktoken library. Defined cases: a null text
is an empty one; the empty text has no ids; a text of any length without white space is one
window. Rows are independent, so ties, repeated rows and empty tables need no rule; further
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from panelspark.llm.shared import slices

LEAF = 2048
WINDOW = 64
ARROW = {"array<int>": pa.list_(pa.int32()), "long": pa.int64(), "string": pa.string()}
# Python's white space includes that of the pattern's engine, so [^\s] is none in both.
BOUNDARY = re.compile(r"[^\s](?=[ \n])")


class TreeEncoder:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: str, pattern: str, leaf: int = LEAF):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table,
                                          special_tokens={})
        self.token = [b""] * (max(table.values()) + 1)
        for piece, rank in table.items():
            self.token[rank] = piece
        self.leaf = leaf

    def flat(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def encode(self, text: str, lo: int = 0, hi: int | None = None) -> list[int]:
        hi = len(text) if hi is None else hi
        if hi - lo <= self.leaf:
            return self.flat(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self.encode(text, lo, mid),
                         self.encode(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int],
             right: list[int]) -> list[int]:
        """ids of text[lo:hi] from those of its two parts."""
        size = WINDOW
        while True:
            start, stop = max(lo, mid - size), min(hi, mid + size)
            # The character after the boundary lies in the left half, so what precedes is settled.
            before = [m.end() for m in BOUNDARY.finditer(text, start, mid)]
            after = BOUNDARY.search(text, mid, stop)
            p = before[-1] if before else lo if start == lo else None
            q = after.end() if after else hi if stop == hi else None
            if p is not None and q is not None:
                break
            size *= 2
        self.drop_tail(left, len(text[p:mid].encode()))
        left += self.flat(text[p:q])
        left += right[self.head(right, len(text[mid:q].encode())):]
        return left

    def drop_tail(self, ids: list[int], size: int) -> None:
        """Cut the last `size` bytes off; a boundary of matches is one of ids."""
        k = len(ids)
        while size > 0:
            k -= 1
            size -= len(self.token[ids[k]])
        del ids[k:]

    def head(self, ids: list[int], size: int) -> int:
        k = 0
        while size > 0:
            size -= len(self.token[ids[k]])
            k += 1
        return k

    def decode(self, ids: list[int], lo: int = 0, hi: int | None = None) -> bytes:
        hi = len(ids) if hi is None else hi
        if hi - lo <= self.leaf:
            return b"".join(map(self.token.__getitem__, ids[lo:hi]))
        mid = (lo + hi) // 2
        return self.decode(ids, lo, mid) + self.decode(ids, mid, hi)


@lru_cache(maxsize=4)
def worker_coder(ranks: str, pattern: str) -> TreeEncoder:
    return TreeEncoder(ranks, pattern)


def _map(docs: DataFrame, column: str, ranks: str, pattern: str,
         row: Callable[[TreeEncoder, object], tuple], schema: str) -> DataFrame:
    names, kinds = zip(*[x.split() for x in schema.split(", ")], strict=True)
    first = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(ranks, pattern)
        for batch in (slices(batches) if column == "text" else batches):
            rows = [row(coder, x) for x in batch.column(column).to_pylist()]
            cells = [pa.array(list(v), ARROW[kind]) for v, kind in
                     zip(zip(*rows, strict=True), kinds, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cells],
                                                 names=["doc_id", *names])

    return docs.select("doc_id", column).mapInArrow(run, f"doc_id {first}, {schema}")


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ids array<int> of documents(doc_id, text)."""
    return _map(docs, "text", ranks, pattern, lambda c, t: (c.encode(t or ""),),
                "ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and text of rows(doc_id, ids); bytes that are not UTF-8 are replaced."""
    return _map(encoded, "ids", ranks, pattern,
                lambda c, ids: (c.decode(ids or []).decode(errors="replace"),), "text string")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Encode and decode each text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    def digest(coder: TreeEncoder, text: str | None) -> tuple[int, str, str]:
        ids = coder.encode(text or "")
        return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(coder.decode(ids)).hexdigest())

    return _map(docs, "text", ranks, pattern, digest,
                "n_tokens long, ids_sha256 string, decoded_sha256 string")


