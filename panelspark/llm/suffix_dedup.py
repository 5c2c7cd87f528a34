"""Removal of long strings that occur twice, by sorting suffixes of the parsed texts.

Texts are cut where a hash of the last CONTEXT bytes falls below a limit, about every MEAN bytes,
so equal stretches are cut alike. A piece with the CONTEXT bytes before it has a name, a
hash. The suffixes of this parse are sorted first: each begins at a piece, holds the names up to
all that a window from its first piece can reach, and then the name of the piece before it. A
suffix shares with a neighbour in the order the longest run of names that it shares with any
other, so whole runs of pieces tell which windows of LENGTH bytes surely occur twice (all pieces
that the window touches are repeated in a row), and which surely do not (the pieces wholly inside
are not). What is left are windows at the ends of common stretches. These suffixes, cut at LENGTH
bytes, are sorted in a second pass together with one window of each other variant around the same
inner pieces; the inner pieces stand as their hash, the bytes on both sides as they are. Equal
strings are windows that occur twice. Both sorts are merge sorts of front-coded runs with loser
trees (`suffix_runs`).

Windows without a cut (rare, or in texts of one repeated character) stand as the hash of their
middle and the bytes on both sides. Pieces that occur once can't be part of the first sort: they
are counted before it, where equal pieces of a task travel once. No pair of texts is formed anywhere.

Defined cases: a null text is empty; texts shorter than LENGTH keep all bytes; rows of equal id
and text are texts of their own and repeat each other; a row without an id counts as any other;
an empty table gives no rows; further columns are ignored. Two texts of one id are told apart by
a 32-bit hash, names by 48 bits and more; a false match needs unlike pieces of equal hash
between equal ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.shared import mix, slices, stored
from panelspark.llm.suffix_runs import LoserTree, common_prefix, opened, run_pieces

LENGTH = 400
CONTEXT, MEAN = 8, 40  # bytes of one 64-bit number
BLOCK = 1 << 16  # bytes hashed at once
SLICE = 1 << 18  # bytes of texts parsed at once, but for a longer text
RUN_BYTES = 20 << 20  # strings of one sorted run
PART_BYTES = 32 << 20  # strings that a part should hold
SIDE = 48  # bytes on both sides of a window without a cut that stand as they are
NAME = 6  # bytes of a name in the strings of the first sort
ZERO = bytes(NAME)
PARSED_TEXTS = 256  # texts whose suffixes are made at once
SAMPLED_DOCS = 3000  # documents whose strings set the bounds of the parts
U = np.uint64
BASE = 0x9E3779B97F4A7C15
CUT_SEED = 0xF452E46763661434  # runs of one ASCII character have no cut
TABLE = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD6E8FEB86659FD93)) | U(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below n."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 19)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


class Parsed:
    """Hashes and cuts of the texts of a column, laid end to end."""

    def __init__(self, texts: list[bytes]):
        self.edge = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        self.data = b"".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        up, self.down = powers(len(raw) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64),
                                    np.cumsum(TABLE[raw] * up[:-1], dtype=np.uint64)])
        found = [np.zeros(0, np.int64)]
        context = np.ndarray(max(len(raw) - CONTEXT + 1, 0), "<u8", self.data, strides=(1,))
        for lo in range(0, len(context), BLOCK):  # bounds what the hashes of a block take
            h = mix(context[lo:lo + BLOCK] ^ U(CUT_SEED))
            found.append(np.flatnonzero(h < U((1 << 64) // MEAN)) + lo + CONTEXT)
        cut = np.concatenate(found)
        text = np.searchsorted(self.edge, cut - CONTEXT, "right") - 1
        inside = cut <= self.edge[text + 1]
        self.cut, text = cut[inside], text[inside]
        self.first = np.searchsorted(text, np.arange(len(texts) + 1))

    def hashed(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the bytes from start to stop, never zero."""
        h = mix((self.sums[stop] - self.sums[start]) * self.down[start]
                ^ mix((stop - start).astype(np.uint64)))
        return np.where(h == 0, U(1), h)

    def cuts(self, i: int) -> np.ndarray:
        """Cuts of text i, from its first byte on."""
        return self.cut[self.first[i]:self.first[i + 1]] - self.edge[i]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with the key (d, th) of a row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(0)).alias("d"),
        F.hash(F.col("doc_id").isNull(), "text").alias("th"), "text")


def pieces(keyed: DataFrame) -> DataFrame:
    """d, th, at, h, state of each piece of the long texts.

    at is its number in the text times 2 ** 32 plus its length; state is 0 for a name that occurs
    once in its batch, else 1 for one and 2 for the others that carry it. A text with a window
    that may hold no piece has a row of state 3 besides.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, th, at, names, bare = [], [], [], [], [[], []]
            for part in slices(iter([batch]), most=SLICE):
                p = Parsed(_texts(part))
                n = np.diff(p.first) + 1
                text = np.repeat(np.arange(part.num_rows), n)
                t = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
                # Piece t of a text runs from its cut t - 1, or its start, to cut t, or its end.
                cut = np.concatenate([p.cut, [0]])
                k = p.first[text] + t
                start = np.where(t == 0, p.edge[text], cut[np.maximum(k - 1, 0)])
                stop = np.where(t == n[text] - 1, p.edge[text + 1], cut[np.minimum(k, len(cut) - 1)])
                begin = np.where(t == 0, start, start - CONTEXT)
                d.append(part.column("d").to_numpy()[text])
                th.append(part.column("th").to_numpy()[text])
                at.append(t << 32 | stop - start)
                names.append(p.hashed(begin, stop))
                size = stop - start
                two = size + np.where(t == n[text] - 1, 0, np.append(size[1:], 0))
                few = np.unique(text[two > LENGTH - 2 * CONTEXT])
                bare[0].append(part.column("d").to_numpy()[few])
                bare[1].append(part.column("th").to_numpy()[few])
            h = np.concatenate(names)
            _, first, inverse, count = np.unique(h, return_index=True, return_inverse=True,
                                                 return_counts=True)
            state = np.where(count[inverse] > 1, 2, 0).astype(np.int8)
            state[first[count > 1]] = 1
            yield pa.RecordBatch.from_pydict({
                "d": np.concatenate(d), "th": np.concatenate(th), "at": np.concatenate(at),
                "h": h.view(np.int64), "state": state})
            few = len(np.concatenate(bare[0]))
            yield pa.RecordBatch.from_pydict({
                "d": np.concatenate(bare[0]), "th": np.concatenate(bare[1]),
                "at": np.zeros(few, np.int64), "h": np.zeros(few, np.int64),
                "state": np.full(few, 3, np.int8)})

    return keyed.where(F.octet_length("text") >= LENGTH).select("d", "th", "text").mapInArrow(
        run, "d long, th int, at long, h long, state byte")


def repeated_pieces(found: DataFrame) -> DataFrame:
    """(d, th, pieces): the pieces (at, h) of each text whose name occurs twice or more."""
    # Of a batch one row per name is counted, so a frequent name meets itself once per batch.
    counted = found.where("state < 2").withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("n > 1 or state = 1")
    rows = counted.select("d", "th", "at", "h").union(
        found.where("state = 2").select("d", "th", "at", "h"))
    return rows.groupBy("d", "th").agg(F.collect_set(F.struct("at", "h")).alias("pieces"))


def parse_suffixes(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], dict]]:
    """The suffixes of the repeated pieces of some texts each: strings and (d, th, t, names).

    A string holds names, a zero and the name before; where the next piece occurs once, which no
    other text shares, it ends in what tells it from all others.
    """
    for lo in range(0, batch.num_rows, PARSED_TEXTS):
        part = batch.slice(lo, PARSED_TEXTS)
        lists = part.column("pieces")
        flat = lists.flatten()
        of = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
        at, h = (flat.field(i).to_numpy() for i in (0, 1))
        order = np.lexsort((at, of))
        t, size = at[order] >> 32, at[order] & 0xFFFFFFFF
        text = h[order].astype(">i8").view(np.uint8).reshape(-1, 8)[:, 8 - NAME:].copy()
        text[(text == 0).all(axis=1), -1] = 1  # zero ends the names
        text = text.tobytes()
        n = len(t)
        gap = np.append(True, (np.diff(t) != 1) | (np.diff(of) != 0))[:n]
        ends = np.append(np.flatnonzero(gap)[1:], n)
        run_end = ends[np.cumsum(gap) - 1]
        total = np.concatenate([[0], np.cumsum(size)])
        reach = np.searchsorted(total, total[1:] + LENGTH)
        stop = np.minimum(reach, run_end)
        d, th = part.column("d").to_numpy()[of], part.column("th").to_numpy()[of]
        mark = np.rec.fromarrays([d, th, t], dtype=[("d", ">i8"), ("th", ">i4"), ("t", ">u4")]
                                 ).tobytes()
        strings = []
        for k, (place, end, first, open_end) in enumerate(zip(
                t.tolist(), stop.tolist(), gap.tolist(), (reach > run_end).tolist(),
                strict=True)):
            if not first:
                before = text[NAME * (k - 1):NAME * k]
            elif place == 0:
                before = bytes(NAME)
            else:
                before = hashlib.blake2b(mark[16 * k:16 * k + 16], digest_size=NAME).digest()
            s = text[NAME * k:NAME * end] + ZERO + before
            strings.append(s + mark[16 * k:16 * k + 16] if open_end else s)
        yield strings, {"d": d, "th": th, "t": t.astype(np.int32),
                        "names": (stop - np.arange(n)).astype(np.int32)}


def _flushed(rows: Iterator[tuple[list[bytes], dict, dict]], bounds: list[bytes]
             ) -> Iterator[pa.RecordBatch]:
    """Strings with payload and settled rows gathered to runs of RUN_BYTES, cut into pieces."""
    def joined(parts: list[dict]) -> dict:
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}

    def out() -> pa.RecordBatch:
        made = list(run_pieces(strings, joined(payload), bounds, joined(settled)))
        return pa.RecordBatch.from_pydict({
            "part": pa.array([p for p, _ in made], pa.int32()),
            "piece": pa.array([b for _, b in made], pa.binary())})

    strings, payload, settled, size = [], [], [], 0
    for own, rest, done in rows:
        strings += own
        payload.append(rest)
        if done:
            settled.append(done)
        size += sum(map(len, own))
        if size >= RUN_BYTES:
            yield out()
            strings, payload, settled, size = [], [], [], 0
    if payload:
        yield out()


def _bounds(rows: DataFrame, make: Callable, n: int) -> list[tuple[bytes, dict]]:
    """Strings of sampled texts, with their payload, that cut the sort into parts.

    `make` gives the strings and payload of a batch's texts; there are about n texts.
    """
    every = max(1, n // SAMPLED_DOCS)
    step = 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in make(batch):
                strings, payload = item[0], item[1]
                if not strings:
                    continue
                took = np.arange(int(payload["d"][0]) * 7 % step, len(strings), step)
                yield pa.RecordBatch.from_pydict({
                    "s": pa.array([strings[i] for i in took], pa.binary()),
                    "size": pa.array([len(strings[i]) for i in took], pa.int64()),
                    **{k: pa.array(payload[k][took].astype(np.int64))
                       for k in ("d", "th", "t", "names")}})

    some = rows.where(F.pmod(F.xxhash64("d", "th"), F.lit(every)) == 0)
    found = stored(some.mapInArrow(run, "s binary, size long, d long, th long, t long, names long"),
                   "suffix-sample").dropDuplicates(["s"])
    rows_of = sorted((bytes(r["s"]), r["size"], r["d"], r["th"], r["t"], r["names"])
                     for r in found.limit(SAMPLED_DOCS * 32).collect())
    total = sum(r[1] for r in rows_of) * step * every
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                total // PART_BYTES + 1)
    cut, held, out = sum(r[1] for r in rows_of) / parts, 0, []
    for r in rows_of:
        if held >= cut:
            out.append((r[0], dict(zip(("d", "th", "t", "names"), r[2:], strict=True))))
            held = 0
        held += r[1]
    return out


SIZES = [n.to_bytes(2, "big") for n in range(LENGTH + 1)]
MARK_BITS = 9  # a string holds at most LENGTH + 1 names


def _packed(t: np.ndarray, *counts: np.ndarray | int) -> np.ndarray:
    """t, most, other and both same in one long, each count in MARK_BITS bits, one above it."""
    mark = np.asarray(t, np.int64)
    for c in counts:
        mark = mark << MARK_BITS | np.asarray(c, np.int64) + 1
    return mark


def _unpacked(mark: np.ndarray) -> list[np.ndarray]:
    low = (1 << MARK_BITS) - 1
    counts = [(mark >> MARK_BITS * k & low) - 1 for k in (3, 2, 1, 0)]
    return [mark >> 4 * MARK_BITS, *counts]


def shared_names(texts: DataFrame) -> DataFrame:
    """(d, th, mark): for each suffix of the parse t, most, other and same, packed in a long.

    most is the number of names it shares with any other suffix; other is that shared with a
    neighbour in the order that has another piece before, same those with the at most two that
    have the same and go on in another way (-1: none).
    """
    bounds = _bounds(texts, parse_suffixes, texts.count())
    cuts = [b for b, _ in bounds]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _flushed(((s, p, {}) for batch in batches for s, p in parse_suffixes(batch)),
                            cuts)

    def before(s: bytes, names: int) -> bytes:
        return s[NAME * names + NAME:NAME * names + 2 * NAME]

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        runs = [opened(p) for p in rows.column("piece").to_pylist()]
        names = [r[4]["names"].tolist() if r[4] else [] for r in runs]
        multi = [r[3].tolist() for r in runs]
        start = np.cumsum([0] + [len(m) for m in multi]).tolist()
        n = start[-1]
        part = key[0].as_py()
        tail = bounds[part] if part < len(bounds) else None
        size = n + (tail is not None)
        place, most, other = [0] * size, [0] * size, [-1] * size
        same_before, same_after = [-1] * size, [-1] * size
        last, last_n, last_before, row = b"", 0, b"", -1
        tree = iter(LoserTree([r[:3] for r in runs]))
        while True:
            item = next(tree, None)
            if item is not None:
                run, i, s, shared = item
                own = names[run][i]
                place[row + 1] = start[run] + i
                if multi[run][i]:
                    most[row + 1] = own
            elif tail is not None and n:
                s, own = tail[0], tail[1]["names"]
                shared = common_prefix(last, s)
            else:
                break
            row += 1
            own_before = before(s, own)
            if row:
                common = min(shared // NAME, own, last_n)
                if common > most[row - 1]:
                    most[row - 1] = common
                if common > most[row]:
                    most[row] = common
                if shared < len(s) or len(s) != len(last):
                    if own_before != last_before:
                        if common > other[row - 1]:
                            other[row - 1] = common
                        other[row] = common
                    else:
                        same_after[row - 1] = same_before[row] = common
            last, last_n, last_before = s, own, own_before
            if item is None:
                break
        place = np.array(place, np.int64)
        most, other, same_before, same_after = (
            np.array(x, np.int32) for x in (most, other, same_before, same_after))
        payload = {k: np.concatenate([r[4][k] for r in runs if r[4]] or [np.zeros(0, np.int64)])[
            place[:n]] for k in ("d", "th", "t")}
        if tail is not None and n:
            payload = {k: np.append(v, tail[1][k]) for k, v in payload.items()}
        else:
            most, other, same_before, same_after = (
                x[:n] for x in (most, other, same_before, same_after))
        copies = {k: np.concatenate([r[5][k] for r in runs if r[5]] or [np.zeros(0, np.int64)])
                  for k in ("d", "th", "t", "names")}
        return pa.table({
            "d": np.concatenate([payload["d"], copies["d"]]).astype(np.int64),
            "th": np.concatenate([payload["th"], copies["th"]]).astype(np.int32),
            "mark": np.concatenate([
                _packed(payload["t"], most, other, same_before, same_after),
                _packed(copies["t"], copies["names"], -1, -1, -1)])})

    return texts.mapInArrow(deal, "part int, piece binary").groupBy("part").applyInArrow(
        merge, "d long, th int, mark long")


def open_windows(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], dict, dict]]:
    """The windows that the parse leaves open, and settled (d, th, start, n) of others.

    The batch has d, th, text and marks, a list of the longs of `shared_names`. Windows come in
    groups of a bounded size, those without a cut by text.
    """
    lists = batch.column("marks")
    offset = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    t, most, other, *same = _unpacked(lists.flatten().to_numpy())
    d, th = batch.column("d").to_numpy(), batch.column("th").to_numpy()
    texts = _texts(batch)
    parsed = Parsed(texts)
    data, cut, edge = parsed.data, parsed.cut, parsed.edge
    # Piece t of text i has place first[i] + 2 * i + t, since a text has a cut less than pieces
    # and a place more for what follows its last one.
    place = (parsed.first[:-1] + 2 * np.arange(len(texts))).repeat(np.diff(offset)) + t
    whole = np.zeros(len(cut) + 2 * len(texts), np.int64)
    differs = np.full(len(whole), -1)
    np.maximum.at(whole, place, most)
    np.maximum.at(differs, place, other)
    goes_on = np.concatenate([(place << MARK_BITS | s)[s >= 0] for s in same])
    # Windows from one event to the next have the same first and last cut inside.
    last = edge[1:] - LENGTH + 1
    event = np.concatenate([cut - CONTEXT + 1, cut - LENGTH])
    of = np.tile(np.repeat(np.arange(len(texts)), np.diff(parsed.first)), 2)
    event = np.unique(np.concatenate([edge[:-1][last > edge[:-1]],
                                      event[(event >= edge[of]) & (event < last[of])]]))
    of = np.searchsorted(edge, event, "right") - 1
    stop = np.minimum(np.append(event[1:], edge[-1])[:len(event)], last[of])
    j = np.searchsorted(cut, event + CONTEXT)
    m = np.searchsorted(cut, event + LENGTH, "right") - 1
    inner = m - j  # names wholly inside; below zero: not even a cut
    at = j + 2 * of
    sure = (inner >= 0) & (whole[at] >= inner + 2)
    maybe = (inner <= 0) | (differs[at + 1] >= inner)
    rest = np.flatnonzero(~maybe)
    maybe[rest] = np.isin(at[rest] + 1 << MARK_BITS | inner[rest], goes_on)
    # Neighbouring sure events of a text are one range.
    joined = sure[1:] & sure[:-1] & (of[1:] == of[:-1])
    head = sure & ~np.append(False, joined)[:len(sure)]
    tail = sure & ~np.append(joined, False)[:len(sure)]
    yield [], _windows(d, th, of[:0], event[:0]), {
        "d": d[of[head]], "th": th[of[head]], "t": (event[head] - edge[of[head]]).astype(np.int32),
        "n": (stop[tail] - event[head]).astype(np.int32)}

    found = np.flatnonzero(maybe & (inner >= 0))
    x, y = cut[j[found]] - CONTEXT, cut[m[found]]
    name = parsed.hashed(x, y).astype(">u8").tobytes()
    count = stop[found] - event[found]
    size = np.cumsum(count * (10 + LENGTH - (y - x)))
    group = np.searchsorted(size, np.arange(0, size[-1] if len(size) else 0, RUN_BYTES // 4))
    for lo, hi in zip(group, np.append(group, len(found))[1:], strict=True):
        own, strings = slice(lo, hi), []
        for k, (s0, s1, left, right) in enumerate(zip(
                event[found[own]].tolist(), stop[found[own]].tolist(), x[own].tolist(),
                y[own].tolist(), strict=True), lo):
            key = name[8 * k:8 * k + 8]
            strings += [key + SIZES[left - s] + data[s:left] + data[right:s + LENGTH]
                        for s in range(s0, s1)]
        n = count[own]
        start = np.arange(len(strings)) + np.repeat(event[found[own]] - np.cumsum(n) + n, n)
        of_start = np.repeat(of[found[own]], n)
        yield strings, _windows(d, th, of_start, start - edge[of_start]), {}

    bare = np.flatnonzero(inner < 0)
    for own in np.split(bare, np.flatnonzero(np.diff(of[bare])) + 1) if len(bare) else []:
        # Mostly texts of short periods: a window that comes back in its text is settled.
        where = np.concatenate([np.arange(event[e], stop[e]) for e in own])
        h = parsed.hashed(where, where + LENGTH)
        _, first, inverse, times = np.unique(h, return_index=True, return_inverse=True,
                                             return_counts=True)
        i = of[own[:1]]
        again = where[times[inverse] > 1] - edge[i]
        head = np.flatnonzero(np.diff(again, prepend=-2) != 1)
        n = np.diff(np.append(head, len(again)))
        where = where[first]
        inner_of = parsed.hashed(where + SIDE, where + LENGTH - SIDE).astype(">u8").tobytes()
        strings = [bytes(8) + inner_of[8 * k:8 * k + 8] + data[s:s + SIDE]
                   + data[s + LENGTH - SIDE:s + LENGTH] for k, s in enumerate(where.tolist())]
        yield strings, _windows(d, th, i.repeat(len(where)), where - edge[i]), {
            "d": d[i].repeat(len(n)), "th": th[i].repeat(len(n)),
            "t": again[head].astype(np.int32), "n": n.astype(np.int32)}


def _windows(d: np.ndarray, th: np.ndarray, of: np.ndarray, start: np.ndarray) -> dict:
    """Payload of the windows at `start` in the texts `of`."""
    return {"d": d[of], "th": th[of], "t": start.astype(np.int32),
            "names": np.zeros(len(of), np.int32)}


def repeated_windows(texts: DataFrame, n: int) -> DataFrame:
    """(d, th, start, n): runs of n starts of windows that occur twice; runs may overlap.

    The about n `texts` have d, th, text and marks, as `shared_names` gives them.
    """
    cuts = [b for b, _ in _bounds(texts, open_windows, n)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _flushed((x for batch in batches for part in slices(iter([batch]), most=SLICE)
                             for x in open_windows(part)), cuts)

    def merge(rows: pa.Table) -> pa.Table:
        runs = [opened(p) for p in rows.column("piece").to_pylist()]
        start = np.cumsum([0] + [len(r[3]) for r in runs]).tolist()
        twice = np.concatenate([r[3] for r in runs])
        last, last_at = None, -1
        for run, i, s, shared in LoserTree([r[:3] for r in runs]):
            at = start[run] + i
            if shared == len(s) and last == shared and last_at >= 0:
                twice[at] = twice[last_at] = True
            last, last_at = len(s), at

        def column(k: str, kind: type) -> np.ndarray:
            own = [r[4][k] for r in runs if r[4]]
            held = np.concatenate(own)[twice] if own else np.zeros(0, kind)
            return np.concatenate([held.astype(kind)] + [r[5][k].astype(kind) for r in runs if r[5]])

        d, th, t = column("d", np.int64), column("th", np.int32), column("t", np.int32)
        order = np.lexsort((t, th, d))
        d, th, t = d[order], th[order], t[order]
        new = np.ones(len(d), bool)
        new[1:] = (np.diff(d) != 0) | (np.diff(th) != 0) | (np.diff(t) > 1)
        first = np.flatnonzero(new)
        last_of = np.append(first[1:], len(d)) - 1
        sure = {k: [r[6][k] for r in runs if r[6]] for k in ("d", "th", "t", "n")}
        own = {"d": d[first], "th": th[first], "t": t[first], "n": t[last_of] - t[first] + 1}
        return pa.table({name: np.concatenate([own[k].astype(kind), *[x.astype(kind)
                                                                     for x in sure[k]]])
                         for name, k, kind in (("d", "d", np.int64), ("th", "th", np.int32),
                                               ("start", "t", np.int32), ("n", "n", np.int32))})

    return texts.mapInArrow(deal, "part int, piece binary").groupBy("part").applyInArrow(
        merge, "d long, th int, start int, n int")


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) and kept_sha256 of each row."""
    keyed = _keyed(docs)
    found = stored(pieces(keyed), "suffix-pieces")
    texts = stored(repeated_pieces(found), "suffix-texts")
    names = stored(shared_names(texts), "suffix-names")
    bare = found.where("state = 3").select(
        "d", "th", F.lit(1 << 3 * MARK_BITS).cast("long").alias("mark"))  # shares no name
    marks = names.union(bare).groupBy("d", "th").agg(
        F.collect_list("mark").alias("marks"))
    long = keyed.where(F.octet_length("text") >= LENGTH)
    once = long.select("d", "th", "text").join(marks, ["d", "th"])
    windows = stored(repeated_windows(once, texts.count()), "suffix-windows")
    equal = long.groupBy("d", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "d", "th", F.lit(-1).alias("start"), F.lit(0).alias("n"))
    spans = windows.union(equal).groupBy("d", "th").agg(
        F.collect_list(F.struct("start", "n")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch])):
                out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept",
                                                        "kept_sha256")}
                for text, spans_of in zip(_texts(part), part.column("spans"), strict=True):
                    kept, n_spans = _without(text, spans_of.values)
                    out["n_bytes"].append(len(text))
                    out["n_removed"].append(len(text) - len(kept))
                    out["n_spans"].append(n_spans)
                    out["kept"].append(kept)
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_bytes": pa.array(out["n_bytes"], pa.int64()),
                    "n_removed": pa.array(out["n_removed"], pa.int64()),
                    "n_spans": pa.array(out["n_spans"], pa.int64()),
                    "kept": pa.array(out["kept"], pa.binary()),
                    "kept_sha256": pa.array(out["kept_sha256"], pa.string())})

    none = F.lit(None).cast("array<struct<start:int,n:int>>").alias("spans")
    short = keyed.where(F.octet_length("text") < LENGTH).select("doc_id", "text", none)
    rows = long.join(spans, ["d", "th"], "left").select("doc_id", "text", "spans").union(short)
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, "
                                "kept binary, kept_sha256 string")


def _without(text: bytes, spans: pa.StructArray | None) -> tuple[bytes, int]:
    """The text without the bytes that its repeated windows cover, and the number of runs."""
    if spans is None or not len(spans):
        return text, 0
    start, n = (spans.field(i).to_numpy() for i in (0, 1))
    if (start < 0).any():
        return b"", 1
    order = np.argsort(start)
    start, stop = start[order], np.maximum.accumulate((start + n - 1 + LENGTH)[order])
    new = start[1:] > stop[:-1]
    start, stop = start[np.append(True, new)].tolist(), stop[np.append(new, True)].tolist()
    kept = [text[lo:hi] for lo, hi in zip([0, *stop], [*start, len(text)], strict=True)]
    return b"".join(kept), len(start)
