"""Ids of the word-end BPE vocabulary for whole batches of texts.

The result equals Tokenizer.encode(text, add_special_tokens=False). A text is encoded by its
chunks between spaces and newlines: the vocabulary's normalizer and splitter never join
characters across white space, so chunks are independent, and a chunk met again costs a lookup.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 400_000
# Beyond Latin-1, lower-casing and composing characters may depend on neighbours: left to the library.
BEYOND = r"[^\x00-\x{ff}]"
# Punctuation before a full stop or comma: both may be one piece, so these texts are not cut there.
JOINED = r"[^0-9A-Za-zÀ-ÖØ-öø-ÿ\s][.,][ \n]"


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in shown else chr(256 + extra))
        extra += b not in shown
    return out


class WordEncoder:
    """Encodes text columns; one per Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}

    def chunk(self, chunk: str) -> bytes:
        """uint32 ids of a chunk; one of plain lower-case Latin letters goes straight to the merges."""
        got = self.known.get(chunk)
        if got is None:
            if chunk.isalpha() and chunk.isascii() and chunk.islower():
                ids = [t.id for t in self.model.tokenize(chunk)]
            elif chunk.isalpha() and chunk == chunk.lower() and ord(max(chunk)) < 256:
                ids = [t.id for t in self.model.tokenize(
                    "".join(self.letters[b] for b in chunk.encode()))]
            else:
                ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[chunk] = got = np.array(ids, "<u4").tobytes()
        return got

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another as uint32 and the number per text; end_id closes each."""
        texts = pc.fill_null(texts, "")
        plain = pc.invert(pc.match_substring_regex(texts, BEYOND))
        low = pc.if_else(plain, pc.utf8_lower(texts), texts)
        cut = low
        for mark in (".", ","):
            for gap in (" ", "\n"):
                cut = pc.replace_substring(cut, mark + gap, f" {mark} ")
        low = pc.if_else(pc.match_substring_regex(low, JOINED), low, cut)
        lists = pc.split_pattern(pc.replace_substring(low, "\n", " "), " ")
        coded = lists.values.dictionary_encode()
        parts = [self.chunk(c) if c else b"" for c in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ids = np.frombuffer(b"".join(parts), "<u4")
        first = np.cumsum(size) - size
        index = coded.indices.to_numpy()
        # The end id of a text is one more chunk after its last one.
        ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
        index = np.insert(index, ends, len(size))
        size, first = np.append(size, 1), np.append(first, len(ids))
        ids = np.append(ids, np.uint32(end_id)).astype(np.uint32)
        each = size[index]
        stops = np.cumsum(each)
        place = np.arange(stops[-1] if len(stops) else 0) - np.repeat(
            stops - each - first[index], each)
        ends = ends + np.arange(1, len(ends) + 1)
        per_text = np.diff(np.concatenate([[0], stops[ends - 1]])) if len(ends) else np.zeros(
            0, np.int64)
        return ids[place], per_text


@lru_cache(maxsize=4)
def worker_encoder(path: str) -> WordEncoder:
    """One encoder per Python worker, so that later tasks find earlier chunks."""
    return WordEncoder(path)
