"""Suffix-array deduplication: bytes covered by long strings that start more than once, by merging shard BWTs.

A string of WINDOW bytes is repeated if it starts at two places of the corpus. Sorting all suffixes of a corpus to
find such strings is not possible in bounded memory, so the work is narrowed first, without losing a repeat:

1. Anchors. Each window's anchor is the GRAM-byte string in it whose hash is least (winnowing). Equal windows have
   equal anchors at equal offsets, so a window can be repeated only if its anchor's hash occurs twice.
2. Segments. The windows that share an anchor occurrence are a run; a run of an anchor that occurs twice is cut into
   parts of PART windows at fixed offsets from the anchor. All windows of a part share its middle bytes, and equal
   windows lie in parts with equal middles, so parts are grouped by these; the bytes that a part's windows span are
   its segment. A part whose group has no other is done. Equal segments are folded into one: if there were
   several, all their windows are repeated. A group of one segment needs no more; the others send each different
   segment once, as witnesses. So what only the neighbourhoods of a frequent passage have stays apart.
3. Shard BWTs. The segments of a group meet in one task, which gathers segments into shards of bounded size.
   A shard's suffixes, as sequences of BLOCK-byte symbols, are put in order, which gives its Burrows-Wheeler
   transform: for each suffix in order, the symbol before it.
4. Merge. The shards' transforms are merged by interleave refinement (Holt and McMillan): from an interleave that is
   right for t symbols, one stable pass by BWT symbol gives the one for t + 1. Boundaries carried along are the
   common prefixes: after WINDOW / BLOCK passes, the intervals between boundaries are the groups of suffixes that
   agree in WINDOW bytes. No suffix of the merged set is sorted again. Bytes are compared before a group counts.

A group of more than HOT bytes (the edge of a passage that stands in very many different surroundings) is not merged
in one task: its parts are cut in halves, whose middles are longer, and grouped again, until the groups are small or a
part is one window, which is its own middle. Only the half that holds the passage's edge stays large, and a step moves
its places alone, so no task ever holds a group without bound.

Texts that are equal are processed once; all of a text that has copies is repeated, if it has WINDOW bytes.

The same work is done on words (WORDS): a text as the sequence of its words' hashes, in which strings of more than 50
words that start more than once are passages. These are counted, not removed; most of them are shorter than WINDOW bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._shared import small, stored, tidied

#: Bytes of a string that must repeat, of the string that anchors it, and of a symbol of the transforms.
WINDOW, GRAM, BLOCK = 400, 40, 100
#: Bytes of segments in a shard, and in the shards that are merged at a time (more if one group has more).
SHARD, MERGE = 1 << 17, 1 << 20
#: Windows in a part of a run, of bytes and of words.
PART, WORD_PART = 64, 24
#: Bytes of a group's different segments above which its parts are cut in halves rather than merged in one task.
HOT = 1 << 20
#: Bytes (or words) of a text that are looked at together.
STRIDE = 1 << 22


@dataclass(frozen=True)
class Scale:
    """Units of a string that must repeat, of its anchor and of a symbol, and the bytes that stand for a unit."""

    window: int
    gram: int
    block: int
    unit: int

    def array(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, np.uint8 if self.unit == 1 else np.uint64)


BYTES = Scale(WINDOW, GRAM, BLOCK, 1)
#: Words, each as a 64-bit hash. A group's key says its scale by the lowest bit: 0 for bytes, 1 for words.
WORDS = Scale(51, 8, 17, 8)
SCALES = (BYTES, WORDS)


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_FACTOR = 0x9E3779B97F4A7C13
_LETTERS = np.random.default_rng(4).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_UP, _DOWN = _powers(_FACTOR, 1 << 12), _powers(pow(_FACTOR, -1, 1 << 64), 1 << 12)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text in UTF-8: a polynomial over its bytes, from prefix sums."""
    global _UP, _DOWN
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + STRIDE)
        if end < len(raw):  # up to the end of the word that stands there
            found = _SPACE.search(raw, end)
            end = found.start() if found else len(raw)
        data = np.frombuffer(raw, np.uint8)[at:end]
        if len(data) > len(_UP):
            _UP, _DOWN = _powers(_FACTOR, len(data)), _powers(pow(_FACTOR, -1, 1 << 64), len(data))
        space = np.ones(len(data) + 2, bool)
        space[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
        edges = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edges[0::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTERS[data] * _UP[: len(data)], out=sums[1:])
        value = (sums[ends] - sums[starts]) * _DOWN[starts]
        out.append(_mixed(value, (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _words(data: np.ndarray) -> np.ndarray:
    """The 8-byte word that starts at each byte."""
    n = len(data) - 7
    out = data[:n].astype(np.uint64)
    for k in range(1, 8):
        out |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return out


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = (a ^ (b >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(32)
        return out * np.uint64(0xD6E8FEB86659FD93)


def hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the size units that start at each: of bytes (8 to 127), or of numbers."""
    if len(data) < size:
        return np.empty(0, np.uint64)
    out, width = (_words(data), 8) if data.dtype == np.uint8 else (data, 1)
    while width * 2 <= size:
        out = _mixed(out[:-width], out[width:])
        width *= 2
    shift = size - width
    return _mixed(out[: len(out) - shift], out[shift:]) if shift else _mixed(out, out)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(raw: bytes, scale: Scale = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor place, first window, last window) of each run of windows that share an anchor."""
    keys, places, firsts, lasts = [], [], [], []
    data = scale.array(raw)
    for at in range(0, max(0, len(data) - scale.window + 1), STRIDE):
        part = data[at : at + STRIDE + scale.window - 1]
        h = hashes(part, scale.gram)
        # the upper bits order, the lower ones say where: of equal hashes the leftmost counts
        low = _least((h & ~np.uint64((1 << 23) - 1)) | np.arange(len(h), dtype=np.uint64), scale.window - scale.gram + 1)
        where = (low & np.uint64((1 << 23) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        keys.append(h[where[first]])
        places.append(where[first] + at)
        firsts.append(first + at)
        lasts.append(np.append(first[1:] - 1, len(where) - 1) + at)
    if not keys:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    return tuple(np.concatenate(x) for x in (keys, places, firsts, lasts))


# -- the merge


def _step(symbol: np.ndarray, classes: np.ndarray, closing: int) -> tuple[np.ndarray, np.ndarray]:
    """One refinement pass, from an order by t symbols to one by t + 1.

    symbol[i] is the symbol before the i-th suffix (-1 for none) and classes[i] its group. The suffixes that begin
    one symbol earlier follow from a stable sort by symbol; the `closing` suffixes shorter than a symbol come first,
    each a group of its own. Returns where each suffix that has a predecessor comes from, and the new groups.
    """
    has = np.flatnonzero(symbol >= 0)
    keyed = np.sort((symbol[has].astype(np.uint64) << np.uint64(32)) | has.astype(np.uint64))
    source, now = keyed.astype(np.uint32).astype(np.int32), (keyed >> np.uint64(32)).astype(np.int32)
    was = classes[source]
    fresh = np.concatenate([[True], (now[1:] != now[:-1]) | (was[1:] != was[:-1])]) if len(source) else np.empty(0, bool)
    return source, np.concatenate([np.arange(closing, dtype=np.int32), closing - 1 + np.cumsum(fresh, dtype=np.int32)])


def shard_bwt(members: np.ndarray, before: np.ndarray, ends: np.ndarray, passes: int, block: int = BLOCK) -> np.ndarray:
    """A shard's suffixes in the order of their first `passes` symbols, from any order; before is by place in the chunk."""
    order, classes = members, np.zeros(len(members), np.int32)
    for _ in range(passes):
        source, classes = _step(before[order], classes, len(ends))
        order = np.concatenate([ends, order[source] - np.int32(block)])
    return order


def merge(orders: list[np.ndarray], ends: list[np.ndarray], before: np.ndarray, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards' suffixes in one order, and the group of each: equal groups agree in the first `passes` symbols.

    orders are the shards' sorted suffixes; only the interleave (which shard comes next) is refined. The symbols
    are read off the shards' transforms in turn, and which suffix stands where follows from the interleave alone.
    """
    transforms = np.concatenate([before[o] for o in orders])
    sizes = [len(o) for o in orders]
    interleave = np.repeat(np.arange(len(orders), dtype=np.uint16), sizes)
    closing = np.repeat(np.arange(len(orders), dtype=np.uint16), [len(e) for e in ends])
    classes = np.zeros(len(interleave), np.int32)
    for _ in range(passes):
        turn = np.argsort(interleave, kind="stable")  # a radix sort: the places of shard 0, then of shard 1, ...
        symbol = np.empty_like(transforms)
        symbol[turn] = transforms
        source, classes = _step(symbol, classes, len(closing))
        interleave = np.concatenate([closing, interleave[source]])
    merged = np.empty(len(interleave), np.int32)
    merged[np.argsort(interleave, kind="stable")] = np.concatenate(orders)
    return merged, classes


def ranks(found: np.ndarray, n: int) -> np.ndarray:
    """Numbers for equal hashes, padded to n places.

    Hashes are sorted together with their places by their upper bits alone, which is one sort of plain numbers;
    if those bits put different hashes together, all bits are sorted instead.
    """
    bits = np.uint64(max(1, len(found)).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    keyed = np.sort((found & ~low) | np.arange(len(found), dtype=np.uint64))
    order = (keyed & low).astype(np.int32)
    fresh = np.concatenate([[True], keyed[1:] >> bits != keyed[:-1] >> bits]) if len(found) else np.empty(0, bool)
    whole = found[order]
    out = np.full(n, -1, np.int32)
    if (~fresh[1:] & (whole[1:] != whole[:-1])).any():
        out[: len(found)] = np.unique(found, return_inverse=True)[1]
    else:
        out[order] = np.cumsum(fresh) - 1
    return out


def repeated(segments: list[bytes], shard: int = SHARD, scale: Scale = BYTES) -> list[np.ndarray]:
    """For each segment, which of its windows occur twice or more among all windows of all segments."""
    lengths = np.array([len(s) // scale.unit for s in segments])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])  # one unit after each segment is its empty suffix
    data = scale.array((b"\0" * scale.unit).join([*segments, b""]))
    n = len(data)
    places = np.arange(n, dtype=np.int32)
    left = np.repeat(starts + lengths, lengths + 1).astype(np.int32) - places  # units up to the segment's end
    symbols = ranks(hashes(data, scale.block), n)
    symbols[left < scale.block] = -1
    inner = np.flatnonzero(places - np.repeat(starts, lengths + 1) >= scale.block)  # those with a whole symbol before them
    before = np.full(n, -1, np.int32)
    before[inner] = symbols[inner - scale.block]
    owner = np.repeat((np.cumsum(lengths + 1) - 1) * scale.unit // shard, lengths + 1)
    passes = scale.window // scale.block
    cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
    orders, ends = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        members = places[a:b]
        ends.append(members[left[a:b] < scale.block])
        orders.append(shard_bwt(members, before, ends[-1], passes, scale.block))
    merged, classes = merge(orders, ends, before, passes)
    same = np.flatnonzero(classes[1:] == classes[:-1])
    # units decide: hashes of blocks only brought the suffixes together
    for at in range(0, len(same), 1 << 15):
        some = same[at : at + (1 << 15)]
        view = np.lib.stride_tricks.sliding_window_view(data, scale.window)
        equal = (view[merged[some]] == view[merged[some + 1]]).all(axis=1)
        same[at : at + (1 << 15)] = np.where(equal, some, -1)
    same = same[same >= 0]
    twice = np.zeros(n, bool)
    twice[merged[same]] = True
    twice[merged[same + 1]] = True
    return [twice[s : s + max(0, x - scale.window + 1)] for s, x in zip(starts, lengths, strict=True)]


def covered(windows: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs (start, end) of units that the marked windows cover."""
    at = np.flatnonzero(windows)
    if not len(at):
        return at, at
    gap = np.flatnonzero(at[1:] > at[:-1] + window)
    return at[np.concatenate([[0], gap + 1])], at[np.concatenate([gap, [len(at) - 1]])] + window


def union(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Overlapping and touching spans made one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


# -- on Spark


def _text_id(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _units(raw: bytes) -> tuple[bytes, bytes]:
    """A text in the units of each scale."""
    return raw, word_hashes(raw).tobytes()


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text) -> one row for each different text of a batch: its copies there, sizes, digest and runs."""
    uid = TaskContext.get().partitionId() << 40
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            held: dict[tuple[int, int], list] = {}
            for a, b, text in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True):
                if (a, b) in held:
                    held[a, b][0] += 1
                    continue
                raw = text.encode("utf-8")
                units = _units(raw)
                found = [runs(u, scale) for u, scale in zip(units, SCALES, strict=True)]
                keys = [(k & ~np.uint64(1)) | np.uint64(kind) for kind, (k, *_) in enumerate(found)]
                spans = [np.concatenate(x).astype(np.int32) for x in zip(*(f[1:] for f in found), strict=True)]
                held[a, b] = [1, len(raw), len(units[1]) // WORDS.unit, hashlib.sha256(raw).hexdigest(), np.concatenate(keys).view(np.int64), *spans]
            columns = list(zip(*held.values(), strict=True)) if held else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(uid, uid + len(held)), pa.int64()),
                    pa.array([k[0] for k in held], pa.int64()),
                    pa.array([k[1] for k in held], pa.int64()),
                    *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)),
                ],
                ["uid", "a", "b", "copies", "n_bytes", "n_words", "whole_sha256", "keys", "places", "firsts", "lasts"],
            )
            uid += len(held)


def _group(middle: bytes, seed: int, kind: int) -> int:
    return xxhash.xxh3_64_intdigest(middle, seed) & ~1 | kind


def parts(raw: bytes, place: int, first: int, last: int, kind: int, part: int) -> Iterator[tuple[int, int, int, int]]:
    """(group, top, start, end) of the parts of a run: the hash of a part's middle, and its segment's units.

    A part's windows start at top - part + 1 to top, as far as the run has them; its middle is what these share.
    """
    window, unit = SCALES[kind].window, SCALES[kind].unit
    while first <= last:
        n = (place - first) // part
        top = place - n * part
        high = min(last, top)
        yield _group(raw[top * unit : (top - part + 1 + window) * unit], n, kind), top, first, high + window
        first = high + 1


def halves(raw: bytes, key: int, top: int, start: int, end: int, part: int) -> Iterator[tuple[int, int, int, int]]:
    """(group, top, start, end) of the halves of a part of `part` windows: the same cut again, within its group."""
    kind = key & 1
    window, unit = SCALES[kind].window, SCALES[kind].unit
    half = -(-part // 2)
    for n in range(2):
        now = top - n * half
        first, high = max(start, now - half + 1), min(end - window, now)
        if first <= high:
            yield _group(raw[now * unit : (now - half + 1 + window) * unit], (key + n) % (1 << 64), kind), now, first, high + window


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


MEMBER = "uid long, key long, x long, top int, at int, size int"


def _members(cut, width: int):
    """(uid, text, specs) -> MEMBER rows of every part that cut gives: its group, its segment's hash, top and units."""
    digest = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                flat = some.column(2).flatten()
                specs = zip(*(flat.field(i).to_pylist() for i in range(width)), strict=True)
                uids, keys, xs, tops, starts, sizes = [], [], [], [], [], []
                for uid, text, n in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2).value_lengths().to_pylist(), strict=True):
                    units = _units(text.encode("utf-8"))
                    for _ in range(n):
                        for key, top, start, end in cut(units, *next(specs)):
                            unit = SCALES[key & 1].unit
                            uids.append(uid)
                            keys.append(key)
                            xs.append(digest(units[key & 1][start * unit : end * unit]))
                            tops.append(top)
                            starts.append(start)
                            sizes.append(end - start)
                columns = [pa.array(uids, pa.int64()), _signed(keys), _signed(xs), *(pa.array(c, pa.int32()) for c in (tops, starts, sizes))]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "key", "x", "top", "at", "size"])

    return tidied(run)


def _first_cut(part: int, word_part: int):
    def cut(units: tuple[bytes, bytes], place: int, first: int, last: int, kind: int) -> Iterator[tuple[int, int, int, int]]:
        return parts(units[kind], place, first, last, kind, word_part if kind else part)

    return _members(cut, 4)


def _second_cut(part: int, word_part: int):
    def cut(units: tuple[bytes, bytes], key: int, top: int, at: int, size: int) -> Iterator[tuple[int, int, int, int]]:
        return halves(units[key & 1], key % (1 << 64), top, at, at + size, word_part if key & 1 else part)

    return _members(cut, 4)


def _witnesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, segments) -> (key, x, n, bytes) of the segments that this text sends."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            flat = some.column(1).flatten()
            keys, xs, ns = (flat.field(i) for i in range(3))
            spans = zip(keys.to_pylist(), flat.field(3).to_pylist(), flat.field(4).to_pylist(), strict=True)
            out = []
            for text, n in zip(some.column(0).to_pylist(), some.column(1).value_lengths().to_pylist(), strict=True):
                units = _units(text.encode("utf-8"))
                for _ in range(n):
                    key, start, size = next(spans)
                    unit = SCALES[key & 1].unit
                    out.append(units[key & 1][start * unit : (start + size) * unit])
            yield pa.RecordBatch.from_arrays([keys, xs, ns, pa.array(out, pa.binary())], ["key", "x", "n", "bytes"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, x, n, bytes) by key -> (key, x, starts, ends) of segments with repeated windows, relative to the segment.

    Whole groups are merged together until they have MERGE bytes; a group has HOT bytes at most.
    """
    held: list[tuple[list, ...]] = [([], [], [], []) for _ in SCALES]
    size, now = [0] * len(SCALES), None

    def told(kind: int) -> pa.RecordBatch:
        scale, out = SCALES[kind], []
        for key, x, n, segment, twice in zip(*held[kind], repeated(held[kind][3], SHARD, scale), strict=True):
            starts, ends = covered(np.ones(len(segment) // scale.unit - scale.window + 1, bool) if n > 1 else twice, scale.window)
            if len(starts):
                out.append((key, x, starts.tolist(), ends.tolist()))
        held[kind], size[kind] = ([], [], [], []), 0
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "x", "starts", "ends"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            kind = row[0] & 1
            if row[0] != now and size[kind] >= MERGE:
                yield told(kind)
            now = row[0]
            for values, value in zip(held[kind], row, strict=True):
                values.append(value)
            size[kind] += len(row[3])
    for kind in range(len(SCALES)):
        if held[kind][0]:
            yield told(kind)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text, spans) -> (a, b, n_removed, n_spans, kept_sha256, n_passages, n_passage_words, spans): what is left of each text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = []
            for a, b, text, spans in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                raw = text.encode("utf-8")
                own, passages = (union([s["start"] for s in spans if s["kind"] == k], [s["end"] for s in spans if s["kind"] == k]) for k in range(2))
                kept, last = hashlib.sha256(), 0
                for start, end in own:
                    kept.update(raw[last:start])
                    last = end
                kept.update(raw[last:])
                counts = (len(passages), sum(e - s for s, e in passages))
                rows.append((a, b, sum(e - s for s, e in own), len(own), kept.hexdigest(), *counts, [{"start": s, "end": e} for s, e in own]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [*[pa.int64()] * 4, pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words", "spans"])


def _judged(members: DataFrame) -> DataFrame:
    """Different segments of groups that have others, with their number of places and one of these, and the group's sizes."""
    different = members.groupBy("key", "x").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("uid", "at", "size"), F.struct("uid", "at")).alias("r"))
    unit = F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, WORDS.unit).otherwise(BYTES.unit)
    groups = different.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all"), F.sum(F.col("r.size") * unit).alias("volume"))
    return stored(different.join(groups.where(F.col("all") > 1), "key"), "repeats-segments")


def _grouped(bodies: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """(members, judged) of the parts of all runs, then of the halves of hot groups' parts; no judged group is hot."""
    part, word_part, hot_bytes = PART, WORD_PART, HOT
    members = stored(bodies.select("uid", "text", "runs").mapInArrow(_first_cut(part, word_part), MEMBER), "repeats-members")
    out = []
    while True:
        judged = _judged(members)
        hot = (F.col("kinds") > 1) & (F.col("volume") > hot_bytes)
        if max(part, word_part) == 1 or not judged.where(hot).limit(1).count():
            return [*out, (members, judged)]
        keys = stored(judged.where(hot).select("key").distinct(), "repeats-hot")
        out.append((members, judged.where(~hot)))
        again = members.join(small(keys), "key").groupBy("uid").agg(F.collect_list(F.struct("key", "top", "at", "size")).alias("runs"))
        members = stored(bodies.select("uid", "text").join(again, "uid").mapInArrow(_second_cut(part, word_part), MEMBER), "repeats-members")
        part, word_part = -(-part // 2), -(-word_part // 2)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words and spans for every row of df.

    A null text is empty. A byte is removed if a WINDOW-byte string that covers it also starts elsewhere, in the
    same text or another; matches do not cross texts, overlaps count, and all strings are judged on the input.
    spans are the removed byte ranges, in order. Passages are the maximal runs of words covered by strings of
    WORDS.window words that also start elsewhere; they are counted whether or not they are removed.
    Other columns of df are not read; an empty table gives no rows. A text has less than 2 GB.

    Identity of texts, middles and segments is by pairs of 64-bit hashes, and of a word by one; the merge compares
    bytes, or words' hashes. Groups of equal texts, however large, are processed once.
    """
    whole = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("t", _text_id(F.col("text")))
    schema = "uid long, a long, b long, copies long, n_bytes long, n_words long, whole_sha256 string, keys array<long>, places array<int>, firsts array<int>, lasts array<int>"
    seen = stored(whole.select("t.a", "t.b", "text").mapInArrow(tidied(_anchors), schema), "repeats-anchors")
    texts = seen.groupBy("a", "b").agg(F.sum("copies").alias("copies"), *(F.max(c).alias(c) for c in ("n_bytes", "n_words", "whole_sha256")))

    # anchors that occur at two places (of the same text, or of different ones)
    each = seen.select("uid", "a", "b", F.explode(F.arrays_zip("keys", "places", "firsts", "lasts")).alias("r"))
    spot = F.xxhash64("a", "b", "r.firsts")
    often = each.groupBy(F.col("r.keys").alias("key")).agg(F.min(spot).alias("low"), F.max(spot).alias("high")).where("low <> high").select("key")
    often = stored(often, "repeats-often")  # a table of its own, so that Spark may split a frequent anchor's side of the join
    kind = F.col("key").bitwiseAND(F.lit(1)).cast("int")
    found = each.select("uid", F.col("r.keys").alias("key"), "r.places", "r.firsts", "r.lasts").join(often, "key")
    found = found.groupBy("uid").agg(F.collect_list(F.struct("places", "firsts", "lasts", kind.alias("kind"))).alias("runs")).join(seen.select("uid", "a", "b"), "uid")
    wanted = stored(found.groupBy("a", "b").agg(F.min("uid").alias("uid"), F.min_by("runs", "uid").alias("runs")), "repeats-runs")

    bodies = whole.select("t.a", "t.b", "text").join(small(wanted.select("a", "b")), ["a", "b"], "left_semi")
    bodies = bodies.groupBy("a", "b").agg(F.first("text").alias("text")).join(wanted, ["a", "b"])
    bodies = stored(bodies.select("a", "b", "uid", "text", "runs"), "repeats-bodies")
    levels = _grouped(bodies)

    def union_of(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionAll(f)
        return out

    judged, members = union_of([j for _, j in levels]), union_of([m.drop("top") for m, _ in levels])
    alone = judged.where("kinds = 1").select("key", "x", F.array(F.lit(0)).alias("starts"), F.array(F.col("r.size")).alias("ends"))
    sent = judged.where("kinds > 1").groupBy("r.uid").agg(F.collect_list(F.struct("key", "x", "n", "r.at", "r.size")).alias("segments"))
    bytes_ = bodies.select("uid", "text").join(sent, "uid").select("text", "segments").mapInArrow(tidied(_witnesses), "key long, x long, n long, bytes binary")
    merged = bytes_.repartition("key").sortWithinPartitions("key", "x").mapInArrow(tidied(_repeats), "key long, x long, starts array<int>, ends array<int>")
    told = stored(alone.unionAll(merged), "repeats-told")  # a table, so that Spark may split the places of a frequent segment

    spans = members.join(told, ["key", "x"])
    place = lambda s: F.struct(kind.alias("kind"), (s["starts"] + F.col("at")).alias("start"), (s["ends"] + F.col("at")).alias("end"))
    of_text = spans.select("uid", F.transform(F.arrays_zip("starts", "ends"), place).alias("s")).groupBy("uid").agg(F.flatten(F.collect_list("s")).alias("spans"))
    result = "a long, b long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long, spans array<struct<start:int,end:int>>"
    done = bodies.select("uid", "a", "b", "text").join(of_text, "uid").select("a", "b", "text", "spans").mapInArrow(tidied(_cut), result)

    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= WINDOW)
    recited = (F.col("copies") > 1) & (F.col("n_words") >= WORDS.window)
    everything = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    answer = texts.join(done, ["a", "b"], "left").select(
        "a",
        "b",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, hashlib.sha256().hexdigest()).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        F.when(recited, 1).otherwise(F.coalesce("n_passages", F.lit(0))).cast("long").alias("n_passages"),
        F.when(recited, F.col("n_words")).otherwise(F.coalesce("n_passage_words", F.lit(0))).cast("long").alias("n_passage_words"),
        F.when(copied, everything).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))).alias("spans"),
    )
    answer = stored(answer, "repeats-answer")  # a table, so that Spark may split the rows of a text with very many copies
    rows = whole.select("id", "t.a", "t.b")
    return rows.join(answer, ["a", "b"]).select(F.col("id").alias(key), *answer.columns[2:])


def _windows_sql(name: str, units: str, parts: tuple[int, ...]) -> str:
    """CTEs: a hash of the string of sum(parts) units that starts at each place, from hashes of twice as many units at a time, and what repeats cover."""
    after = lambda h, k: f"lead({h}, {k}) OVER (PARTITION BY doc_id ORDER BY p)"
    out, width, last = [f"{name}_1 AS (SELECT doc_id, p, c, hash(c) AS h1 FROM {units})"], 1, f"{name}_1"
    while width < parts[0]:
        out.append(f"{name}_{2 * width} AS (SELECT *, CASE WHEN {after(f'h{width}', width)} IS NOT NULL THEN hash(h{width}, {after(f'h{width}', width)}) END AS h{2 * width} FROM {last})")
        width, last = 2 * width, f"{name}_{2 * width}"
    pieces, at = [], 0
    for n in parts:
        pieces.append(after(f"h{n}", at) if at else f"h{n}")
        at += n
    out.append(f"{name}_w AS (SELECT doc_id, p, c, CASE WHEN {pieces[-1]} IS NOT NULL THEN hash({', '.join(pieces)}) END AS w FROM {last})")
    out.append(f"{name}_r AS (SELECT w FROM {name}_w WHERE w IS NOT NULL GROUP BY w HAVING count(*) > 1)")
    out.append(f"{name}_m AS (SELECT doc_id, p, c, r.w IS NOT NULL AS starts FROM {name}_w x LEFT JOIN {name}_r r ON r.w = x.w)")
    out.append(f"{name}_c AS (SELECT doc_id, p, c, max(starts) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {at - 1} PRECEDING AND CURRENT ROW) AS gone FROM {name}_m)")
    out.append(f"{name}_s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM {name}_c)")
    return ", ".join(out)


#: Every window of bytes and of words, by hashes: for tables of some thousand rows.
ORACLE_SQL = rf"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), bytes AS (SELECT doc_id, unnest(b) AS c, generate_subscripts(b, 1) AS p FROM texts), spoken AS (SELECT doc_id, unnest(w) AS c, generate_subscripts(w, 1) AS p FROM texts),
{_windows_sql('b', 'bytes', (256, 128, 16))}, {_windows_sql('w', 'spoken', (32, 16, 2, 1))},
cut AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, sha256(unhex(coalesce(string_agg(c, '' ORDER BY p) FILTER (NOT gone), ''))) AS kept_sha256 FROM b_s GROUP BY doc_id),
said AS (SELECT doc_id, count(*) FILTER (begins) AS n_passages, count(*) FILTER (gone) AS n_passage_words FROM w_s GROUP BY doc_id)
SELECT doc_id, len(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256,
  coalesce(n_passages, 0) AS n_passages, coalesce(n_passage_words, 0) AS n_passage_words FROM texts LEFT JOIN cut USING (doc_id) LEFT JOIN said USING (doc_id)
"""
