"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through the threshold (100 bytes), most significant digit first; a group of one is
settled after any pass and leaves, and the groups that are left after the last pass are exactly the repeated windows.

* The first digit of a suffix is a fingerprint: the least one of a 32-byte block inside its first 100 bytes. Equal
  windows have equal first digits, so this pass parts none of them. Neighbouring suffixes mostly share the digit; a
  maximal run of them is one row. Only digits are shuffled, and runs alone under their digit are settled (1.7e9 suffixes a
  GB cannot be shuffled one by one).
* All further digits are raw bytes, eight at a time. Runs that are left send their bytes to the task of their first
  digit. There whole runs are ordered first: all but the first of equal runs are repeats in every window. Of
  the runs that remain, those whose digit has several kinds, and those that could repeat inside themselves, are
  ordered window by window. Fingerprints decide where bytes meet, never that they are equal.

Every task orders what it has before it sends anything, and keeps one row of equal ones, so a passage in a third of
all documents sends one row a task. Digits with very many kinds (passages with many different surroundings) do not
meet in one task: their windows are dealt by their own fingerprints. Texts are cut into pieces that overlap by a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quillon.llm.blocks import bucket_of, bundle, deltas, mixed, partitions, sliced, summed, trimmed, unbundle
from quillon.session import saved

WINDOW, BLOCK, PIECE, GROUP = 100, 32, 1 << 20, 512
CROWD, CROWD_BITS = 4096, 22
ODD = 0x9E3779B97F4A7C15 | 1
LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
APART = np.uint64(0x94D049BB133111EB)
NONE = np.zeros(0, np.int64)


class Prints:
    """Fingerprints of any stretch of a buffer from one pass of prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        up, down = np.full(n, ODD, np.uint64), np.full(n, pow(ODD, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        self.down = np.cumprod(down)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(LETTERS[data] * up[:-1], out=self.sums[1:])

    def each(self, width: int) -> np.ndarray:
        return mixed((self.sums[width:] - self.sums[:-width]) * self.down[:-width])


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def runs(data: np.ndarray, sizes: np.ndarray, window: int, block: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same first digit, in pieces of `sizes` bytes laid end to end: (piece, place in data, number of windows, digit, could repeat inside)."""
    many = np.maximum(sizes - window + 1, 0)
    if not many.sum():
        return NONE, NONE, NONE, NONE.astype(np.uint64), NONE.astype(bool)
    begin = np.cumsum(sizes) - sizes
    each = Prints(data).each(block)
    digit = least(each, window - block + 1)
    again = np.r_[0, np.cumsum(each[: len(digit)] == digit, dtype=np.int32)]
    piece = np.repeat(np.arange(len(sizes)), many)
    at = np.arange(int(many.sum())) + np.repeat(begin - (np.cumsum(many) - many), many)
    d = digit[at]
    first = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (d[1:] != d[:-1])])
    left, right = at[first], at[np.r_[first[1:], len(at)] - 1]
    # mixed once more, as least values crowd at the low end
    return piece[first], left, right - left + 1, mixed(d[first]), again[right] - again[left] > 0


def ordered(data: np.ndarray, start: np.ndarray, size: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """Radix passes over strings of data: equal numbers for equal digit, size and bytes.

    After each pass only groups of several strings go on, and only groups that the pass parts are sorted.
    """
    padded = np.r_[data, np.zeros(8, np.uint8)]
    eight = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))
    order = np.lexsort((size, digit))
    new = np.r_[True, (digit[order][1:] != digit[order][:-1]) | (size[order][1:] != size[order][:-1])] if len(order) else np.zeros(0, bool)
    number = np.empty(len(start), np.int64)
    group = np.cumsum(new) - 1
    number[order] = group
    fresh = len(order)
    held = np.bincount(group, minlength=1)[group] > 1 if len(order) else new
    rows, group, depth = order[held], group[held], 0
    while len(rows):
        some = size[rows] > depth
        rows, group = rows[some], group[some]
        if not len(rows):
            break
        rest = size[rows] - depth
        key = eight[start[rows] + depth].astype(np.uint64)
        short = rest < 8
        key[short] >>= (8 * (8 - rest[short])).astype(np.uint64)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        width = np.diff(np.r_[first, len(rows)])
        parted = np.add.reduceat(key != np.repeat(key[first], width), first) > 0
        if parted.any():
            mine = np.repeat(parted, width)
            r, g, k = rows[mine], group[mine], key[mine]
            o = np.lexsort((k, g))
            r, g, k = r[o], g[o], k[o]
            new = np.r_[True, (g[1:] != g[:-1]) | (k[1:] != k[:-1])]
            g = np.cumsum(new) - 1
            number[r] = g + fresh
            several = np.bincount(g)[g] > 1
            rows, group = np.r_[rows[~mine], r[several]], np.r_[group[~mine], g[several] + fresh]
            fresh += int(new.sum())
        depth += 8
    return number


def firsts(number: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first row of each number by place, rows with an earlier place under the same number)."""
    order = np.lexsort((start, doc, number))
    n = number[order]
    first = np.flatnonzero(np.r_[True, n[1:] != n[:-1]]) if len(n) else NONE
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(n)]))
    d, s = doc[order], start[order]
    later = (d != d[first][group]) | (s != s[first][group])
    return order[first], order[later]


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document in order, without overlap."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.r_[True, doc[1:] != doc[:-1]]
    lift = (np.cumsum(new) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    fresh = new | np.r_[True, (start + lift)[1:] > reach[:-1]]
    first = np.flatnonzero(fresh)
    return doc[first], start[first], (reach - lift)[np.r_[first[1:], len(reach)] - 1]


ROWS, NAMES = "bucket int, kind byte, blob binary, data binary", ["bucket", "kind", "blob", "data"]
MEET, KNOWN, SPAN, CROWDED = 0, 1, 2, 3
TYPES = (pa.int32(), pa.int8(), pa.binary(), pa.binary())


def batched(rows: Iterator[tuple], most: int = 64) -> Iterator[pa.RecordBatch]:
    out = []
    for r in rows:
        out.append(r)
        if len(out) == most:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], NAMES)
            out = []
    if out:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], NAMES)


def home(digit: np.ndarray, parts: int) -> np.ndarray:
    """The task of each first digit; in the order of digits."""
    return ((digit >> np.uint64(48)) * np.uint64(parts) >> np.uint64(16)).astype(np.int64)


def texts_in(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """Rows of (doc_id, bytes of the text as an array without a copy, other columns' values)."""
    for batch in batches:
        ids, others = batch.column("doc_id").to_pylist(), [batch.column(c) for c in more]
        for i, (key, text) in enumerate(zip(ids, batch.column("text"))):
            raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and len(text.as_buffer()) else np.zeros(0, np.uint8)
            yield key, raw, *(c[i] for c in others)


def sort_runs(parts: int, window: int, block: int, piece: int, most: int = 16 << 20):
    """Orders the runs of a task; sends first digits to where they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # data, then runs in it: document, start in its text, place in data, windows, digit, inside
        waiting: list[tuple[int, int, np.ndarray]] = []
        size = waits = 0

        def wait_over() -> None:
            nonlocal waits
            keys, offsets, raws = (np.array(x) if i < 2 else x for i, x in enumerate(zip(*waiting)))
            sizes = np.fromiter(map(len, raws), np.int64, len(raws))
            data = np.concatenate(raws)
            found, place, count, digit, inside = runs(data, sizes, window, block)
            begin = np.cumsum(sizes) - sizes
            held.append((data, keys[found], place - begin[found] + offsets[found], place, count, digit, inside))
            waiting.clear()
            waits = 0

        def flush() -> Iterator[tuple]:
            base = np.cumsum([0] + [len(h[0]) for h in held])
            data, doc, start, count, digit, inside = (np.concatenate([h[i] for h in held]) for i in (0, 1, 2, 4, 5, 6))
            place = np.concatenate([h[3] + b for h, b in zip(held, base)])
            held.clear()
            if not len(doc):
                return
            keep, far = firsts(ordered(data, place, count + window - 1, digit), doc, start)
            through = int(doc[0]) % parts
            if len(far):
                yield through, SPAN, bundle(*merged(doc[far], start[far], start[far] + count[far] + window - 1)), None
            doc, start, count, digit, inside = (x[keep] for x in (doc, start, count, digit, inside))
            order = np.argsort(digit, kind="stable")
            doc, start, count, digit, inside = (x[order] for x in (doc, start, count, digit, inside))
            first = np.flatnonzero(np.r_[True, digit[1:] != digit[:-1]])
            kinds = np.diff(np.r_[first, len(digit)])
            known = (kinds > 1) | (np.add.reduceat(inside, first) > 0)
            mine = np.repeat(known, kinds)
            if mine.any():
                yield through, KNOWN, bundle(doc[mine], start[mine], np.where(inside[mine], -count[mine], count[mine])), None
            # a digit that is known to go on sends the number of its kinds only
            doc, start, count, digit = doc[first], start[first], np.where(known, -kinds, count[first]), digit[first]
            for b, s in sliced(home(digit, parts)):
                yield b, MEET, bundle(*deltas(digit[s]), doc[s], start[s], count[s]), None

        for key, raw in texts_in(batches):
            for a in range(0, max(len(raw) - window + 1, 0), piece):
                part = raw[a : a + piece + window - 1]
                waiting.append((key, a, part.copy()))
                waits += len(part)
                size += len(part)
                if waits >= piece:
                    wait_over()
                if size >= most:
                    if waiting:
                        wait_over()
                    yield from batched(flush())
                    size = 0
        if waiting:
            wait_over()
        if held:
            yield from batched(flush())

    return run


def by_group(groups: int, kind: int, doc: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    at = bucket_of(doc, groups)
    order = np.argsort(at, kind="stable")
    doc, *columns = (x[order] for x in (doc, *columns))
    for b, s in sliced(at[order]):
        yield b, kind, bundle(doc[s], *(c[s] for c in columns)), None


def gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, list]:
    found: dict[int, list] = {}
    for batch in batches:
        for kind, blob, data in zip(*(batch.column(c).to_pylist() for c in NAMES[1:])):
            found.setdefault(kind, []).append((*unbundle(blob), *([] if data is None else [np.frombuffer(data, np.uint8)])))
    return found


def joined(rows: list | None, n: int) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*rows)] if rows else [NONE] * n


def meet(groups: int, window: int):
    """Runs whose first digit other runs have too, for the groups of their documents; digits with very many kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = gathered(batches)
        doc, start, count = joined(found.get(KNOWN), 3)
        span = joined(found.get(SPAN), 3)
        crowds = []
        if MEET in found:
            digit = np.concatenate([summed(r[:3]) for r in found[MEET]])
            d, s, c = joined([r[3:] for r in found[MEET]], 3)
            order = np.argsort(digit, kind="stable")
            digit, d, s, c = digit[order], d[order], s[order], c[order]
            first = np.flatnonzero(np.r_[True, digit[1:] != digit[:-1]])
            kinds = np.add.reduceat(np.where(c < 0, -c, 1), first)
            # a known digit of one kind could repeat inside; a digit of one task has no one to meet
            here = (np.repeat(kinds, np.diff(np.r_[first, len(digit)])) > 1) & (c > 0)
            doc, start, count = np.r_[doc, d[here]], np.r_[start, s[here]], np.r_[count, c[here]]
            big = kinds >= CROWD
            if big.any():
                crowds.append((0, CROWDED, bundle(digit[first[big]].view(np.int64), kinds[big]), None))
            crowds.append((0, CROWDED, bundle(NONE, np.array([kinds.sum()])), None))
        yield from batched(iter(crowds))
        yield from batched(by_group(groups, KNOWN, doc, start, count))
        yield from batched(by_group(groups, SPAN, *span))

    return run


def lists(doc: np.ndarray, *columns: np.ndarray, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """A row for each document (doc is sorted) with its values as lists."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else NONE
    cuts = np.r_[first, len(doc)]
    for i in range(0, len(first), most):
        j = min(len(first), i + most)
        offsets = pa.array((cuts[i : j + 1] - cuts[i]).astype(np.int32))
        yield pa.record_batch([pa.array(doc[first[i:j]]), *(pa.ListArray.from_arrays(offsets, pa.array(c[cuts[i] : cuts[j]])) for c in columns)], ["doc_id", "starts", "ends"])


SPANS = "doc_id long, starts array<long>, ends array<long>"


def left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's runs that go on: starts, and numbers of windows as ends."""
    doc, start, count = joined(gathered(batches).get(KNOWN), 3)
    order = np.lexsort((start, doc))
    yield from lists(doc[order], start[order], count[order])


def spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from lists(*merged(*joined(gathered(batches).get(SPAN), 3)))


def picked(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The strings of data end to end."""
    at = np.arange(int(size.sum()), dtype=np.int64) + np.repeat(start - (np.cumsum(size) - size), size)
    return data[at]


def windows(place: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each window of runs: (its run, its place)."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + place[owner]


def first_digits(data: np.ndarray, place: np.ndarray, sizes: np.ndarray, window: int, block: int, crowded: np.ndarray, most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First digits of the strings of data, each a run, some strings at a time; and the prints of windows of those that are crowded."""
    a = 0
    while a < len(place):
        b = max(a + 1, int(np.searchsorted(place, place[a] + most, "right")) - 1)
        begin = place[a:b] - place[a]
        prints = Prints(data[place[a] : place[b - 1] + sizes[b - 1]])
        # the least block of a run is in its first window, as in all others
        digit = mixed(np.minimum.reduceat(np.r_[prints.each(block), np.uint64(0)], np.ravel(np.column_stack([begin, begin + window - block + 1])))[::2])
        at = windows(begin[many], sizes[a:b][many] - window + 1)[1] if len(crowded) and (many := within(digit, crowded)).any() else NONE
        yield digit, mixed(prints.each(window)[at] ^ APART) if len(at) else NONE.astype(np.uint64)
        a = b


def within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted ones."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def send_bytes(parts: int, window: int, block: int, crowd, most: int = 8 << 20):
    """Bytes of the runs that go on, in order and each once, to the tasks of their digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded = crowd.value
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[tuple]:
            data, doc, start, count = (np.concatenate(x) for x in zip(*held))
            held.clear()
            inside, count = count < 0, np.abs(count)
            sizes = count + window - 1
            place = np.cumsum(sizes) - sizes
            digit, each = (np.concatenate(x) for x in zip(*first_digits(data, place, sizes, window, block, crowded)))
            if len(each):
                many = within(digit, crowded)
                owner, at = windows(place[many], count[many])
                rest = ~many
                doc, start = np.r_[doc[rest], doc[many][owner]], np.r_[start[rest], start[many][owner] + at - place[many][owner]]
                place, count, digit, inside = np.r_[place[rest], at], np.r_[count[rest], np.ones(len(at), np.int64)], np.r_[digit[rest], each], np.r_[inside[rest], np.zeros(len(at), bool)]
                sizes = count + window - 1
            keep, far = firsts(ordered(data, place, sizes, digit), doc, start)
            if len(far):
                yield int(doc[0]) % parts, SPAN, bundle(*merged(doc[far], start[far], start[far] + sizes[far])), None
            keep = keep[np.argsort(digit[keep], kind="stable")]
            for b, s in sliced(home(digit[keep], parts)):
                k = keep[s]
                yield b, MEET, bundle(*deltas(digit[k]), doc[k], start[k], np.where(inside[k], -count[k], count[k])), picked(data, place[k], sizes[k]).tobytes()

        for key, raw, starts, counts in texts_in(batches, "starts", "ends"):
            start, count = starts.values.to_numpy(), counts.values.to_numpy()
            ends = np.cumsum(np.abs(count) + window - 1)
            for i in range(0, int(ends[-1]), most):
                a, b = np.searchsorted(ends, [i, i + most], "right") if i else (0, np.searchsorted(ends, most, "right"))
                if i + most >= ends[-1]:
                    b = len(ends)
                if b > a:
                    held.append((picked(raw, start[a:b], np.abs(count[a:b]) + window - 1), np.full(b - a, key), start[a:b], count[a:b]))
                    size += len(held[-1][0])
                if size >= most:
                    yield from batched(flush())
                    size = 0
        if held:
            yield from batched(flush())

    return run


def sort_bytes(groups: int, window: int, most: int = 300_000):
    """Orders all runs of a digit by their bytes, then the windows of what could still repeat: repeated spans for the groups of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = gathered(batches)
        span = found.get(SPAN, [])
        if MEET in found:
            rows = found.pop(MEET)
            digit = np.concatenate([summed(r[:3]) for r in rows])
            doc, start, count, data = joined([r[3:] for r in rows], 4)
            del rows
            inside, count = count < 0, np.abs(count)
            sizes = count + window - 1
            place = np.cumsum(sizes) - sizes
            keep, far = firsts(ordered(data, place, sizes, digit), doc, start)
            span.append(merged(doc[far], start[far], start[far] + sizes[far]))
            keep = keep[np.argsort(digit[keep], kind="stable")]
            d = digit[keep]
            first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            kinds = np.diff(np.r_[first, len(d)])
            keep = keep[np.repeat((kinds > 1) | (np.add.reduceat(inside[keep], first) > 0), kinds)]
            # some digits at a time
            d, total = digit[keep], np.cumsum(count[keep])
            a = 0
            while a < len(keep):
                b = int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right"))
                b = int(np.searchsorted(d, d[max(a, b - 1)], "right"))
                k = keep[a:b]
                owner, at = windows(place[k], count[k])
                w_doc, w_start = doc[k][owner], start[k][owner] + at - place[k][owner]
                _, far = firsts(ordered(data, at, np.full(len(at), window), digit[k][owner]), w_doc, w_start)
                span.append(merged(w_doc[far], w_start[far], w_start[far] + window))
                a = b
        yield from batched(by_group(groups, SPAN, *merged(*joined(span, 3))))

    return run


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes a document's spans out of its bytes."""
    out = []
    for doc, raw, starts, ends in texts_in(batches, "starts", "ends"):
        spans = [(s, min(e, len(raw))) for s, e in zip(starts.values.to_pylist(), ends.values.to_pylist()) if s < len(raw)] if starts.is_valid else []
        kept = hashlib.sha256()
        at = 0
        for s, e in spans:
            kept.update(raw[at:s])
            at = e
        kept.update(raw[at:])
        out.append((doc, len(raw), sum(e - s for s, e in spans), len(spans), kept.hexdigest(), ",".join(f"{s}:{e}" for s, e in spans)))
        if len(out) == 5000:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(),) * 4 + (pa.string(),) * 2)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
            out = []
    if out:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(),) * 4 + (pa.string(),) * 2)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def kinds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digits with many kinds; without a digit the kinds of all."""
    for digit, n in gathered(batches).get(CROWDED, []):
        yield pa.record_batch([pa.array(digit) if len(digit) else pa.nulls(1, pa.int64()), pa.array(n)], ["digit", "n"])


def crowds(met: DataFrame) -> np.ndarray:
    """Sorted first digits with at least CROWD kinds and a 2**-CROWD_BITS part of all kinds, so at most 2**CROWD_BITS of them."""
    kinds = met.filter(F.col("kind") == CROWDED).mapInArrow(kinds_of, "digit long, n long")
    total = kinds.filter("digit is null").agg(F.sum("n")).first()[0] or 0
    found = kinds.filter(F.col("digit").isNotNull() & (F.col("n") >= max(CROWD, total >> CROWD_BITS))).toArrow()
    return np.sort(found["digit"].to_numpy().view(np.uint64))


def repeated_spans(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """For docs(doc_id, text, ...): each document's size, the bytes that repeat an earlier window, and what is left.

    A byte is removed if a `window`-byte string over it also starts earlier (at a smaller doc_id, or earlier
    in the same document). Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start:end in
    bytes). Null text is empty. Texts shorter than the window lose nothing, and neither do rows with a null
    doc_id, which have no place among the others. Rows that share a doc_id have one place: none counts as earlier
    than the other, and spans found in one apply to all, as far as each reaches. Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = min(partitions(spark), 65536)
    groups = max(1, min(parts, docs.count() // GROUP))
    texts = docs.filter("doc_id is not null").select("doc_id", "text")
    met = saved(texts.mapInArrow(trimmed(sort_runs(parts, window, block, piece)), ROWS).repartitionById(parts, "bucket").mapInArrow(trimmed(meet(groups, window)), ROWS), "runs")
    crowd = spark.sparkContext.broadcast(crowds(met))
    left = met.filter(F.col("kind") == KNOWN).repartitionById(groups, "bucket").mapInArrow(left_over, SPANS)
    held = texts.repartition(max(parts, 2), "doc_id")
    sent = held.join(left.hint("shuffle_hash"), "doc_id").mapInArrow(trimmed(send_bytes(parts, window, block, crowd)), ROWS)
    spans = sent.repartitionById(parts, "bucket").mapInArrow(trimmed(sort_bytes(groups, window)), ROWS)
    every = met.filter(F.col("kind") == SPAN).union(spans).repartitionById(groups, "bucket").mapInArrow(spans_of, SPANS)
    out = held.join(every.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "starts", "ends").mapInArrow(cut, OUT)
    loose = docs.filter("doc_id is null").selectExpr("doc_id", "text", "cast(null as array<long>) starts", "cast(null as array<long>) ends").mapInArrow(cut, OUT)
    return out.union(loose)


def op4_repeats(spark, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings of all documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans. Edge cases as in repeated_spans."""
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
