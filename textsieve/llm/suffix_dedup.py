"""Exact substring dedup with suffix arrays.

Every byte goes that is covered by a ``LENGTH``-byte string which also starts earlier (in a document
with a smaller id, or earlier in the same one). Strings are judged on the input.

*Routing.* Each string of LENGTH bytes has one anchor, the rightmost of its KGRAM-byte grams with the
least hash, so equal strings have equal anchors at equal places. A string can repeat only if its anchor
does; anchors (about 3 for 100 bytes) are grouped globally, and those that occur once are done.
A repeated anchor's strings are sent to the shard of the anchor's first document: all occurrences of an
anchor meet there, and neighbouring anchors of a copied passage share it, so that passages travel as
single pieces. Anchors that occur more than ``HOT`` times are split over subshards by their document.

*Shards.* The pieces of a shard are concatenated in (document, offset) order. Their suffix array is refined
by Larsson and Sadakane's method in numpy (only unsorted groups are sorted again, by the ranks of two places, or of three
if they fit into a key) to a depth of LENGTH, so that ranks are equal where LENGTH bytes are; Kasai's recurrence gives common prefixes, many text lanes at a time. In each run of suffixes
that share LENGTH bytes all but the first in text order are repeats.

*Merging.* Subshards of a split anchor give back the first occurrence of each string in suffix order;
these sorted runs are merged by binary search, strings being dealt out by their checksum into buckets (a run's strings of
one bucket travel as one row), and all but the earliest of equal ones are repeats as well.

Memory: a shard task works on pieces of about ``BATCH`` bytes at a time; a key with more than twice ``CHUNK`` bytes
is worked off in parts, whose first occurrences are merged like those of subshards. Very common anchors are found in a sample of the documents and counted by
partial sums, so that none of them is gathered in one task; the sample only decides the route, never the result.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; rows that share an id are
ordered by their text's hash, and equal rows get equal results; a null id is smaller than all others;
extra columns stay.
"""

from __future__ import annotations

import itertools
import sys
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH, KGRAM, HOT, CHUNK = 100, 32, 512, 1 << 20
VIEW, BATCH, RANKS = 1 << 16, 1 << 18, 1 << 21  # arrays of a view or a batch stay in a core's cache; smaller ranks than RANKS fit into a key three at a time
GRAMS = LENGTH - KGRAM + 1
SAMPLE, COMMON, HOT_LIST, BUCKETS = 64, 48, 100_000, 1024
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LOW = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated texts that end at ends: (text number, anchor hash, first start, last start), starts within the text.

    Every start of a LENGTH-byte string lies in just one of the ranges."""
    begins = np.concatenate([[0], ends[:-1]])
    seen: list[tuple[np.ndarray, ...]] = []
    for v in range(0, max(1, len(data) - LENGTH + 1), VIEW):  # views of VIEW starts, and the LENGTH - 1 bytes that their last strings need
        view = data[v:v + VIEW + LENGTH - 1]
        skip = int(np.searchsorted(ends, v, side="right"))
        until = int(np.searchsorted(begins, v + len(view)))
        t, a, lo, hi, place = _anchors(view, np.minimum(ends[skip:until], v + len(view)) - v)
        t = t + skip
        shift = np.maximum(0, v - begins[t]) if len(t) else t
        lo, hi, place = lo + shift, hi + shift, place + v
        if seen and len(t) and len(seen[-1][0]) and seen[-1][0][-1] == t[0] and seen[-1][4][-1] == place[0]:  # a range that the view's edge cuts
            lo[0] = seen[-1][2][-1]
            seen[-1] = tuple(x[:-1] for x in seen[-1])
        seen.append((t, a, lo, hi, place))
    t, a, lo, hi = (np.concatenate(x) for x in list(zip(*seen, strict=True))[:4])
    return t, a, lo, hi


def _anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchors() of fewer than 2^24 bytes, and the anchors' places."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    n = len(data) - LENGTH + 1
    if n < 1:
        return none
    h, width, power = data.astype(np.uint64) + np.uint64(1), 1, int(M1)
    while width < KGRAM:
        h = h[:-width] * np.uint64(power) + h[width:]
        width, power = 2 * width, power * power & (1 << 64) - 1
    h = _mix(h)
    least = (h & ~LOW) | (LOW - np.arange(len(h), dtype=np.uint64))
    width = 1
    while 2 * width <= GRAMS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < GRAMS:
        least = np.minimum(least[:n], least[GRAMS - width:GRAMS - width + n])
    place = (LOW - (least[:n] & LOW)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    text = np.repeat(np.arange(len(ends)), ends - starts)[:n]
    valid = np.arange(n) + LENGTH <= ends[text]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    new &= valid
    first = np.flatnonzero(new)
    if not len(first):
        return none
    stop = np.ones(n + 1, bool)  # a range ends where another begins or strings are not valid any more
    stop[:n] = new | ~valid
    nexts = np.flatnonzero(stop)
    last = nexts[np.searchsorted(nexts, first, side="right")] - 1
    t = text[first]
    return t, h[place[first]], first - starts[t], last - starts[t], place[first]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and where each value ends."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets[1:] - offsets[0]


def _parts(batch: pa.RecordBatch, sizes: np.ndarray, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")) + at)
        yield batch.slice(at, to - at)
        at = to


def _anchor_rows(common: tuple | None, only_common: bool = False):
    """Rows (a, id, h, at, n, route) of all anchors, n and route of the common ones; or the counts and smallest ids of the common ones alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, route = common.value if common else (np.zeros(0, np.int64),) * 3
        for whole in batches:
            _, ends = _texts(whole.column(2))
            for batch in _parts(whole, np.diff(ends, prepend=0)):
                data, ends = _texts(batch.column(2))
                t, a, lo, hi = anchors(data, ends)
                a = a.view(np.int64)
                place = np.minimum(np.searchsorted(known, a), max(0, len(known) - 1))
                hit = known[place] == a if len(known) else np.zeros(len(a), bool)
                if only_common:
                    ids = batch.column(0).fill_null(-(1 << 62)).to_numpy()[t[hit]]
                    own, at = np.unique(a[hit], return_inverse=True)
                    least = np.full(len(own), (1 << 63) - 1)
                    np.minimum.at(least, at, ids)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(at, minlength=len(own))), pa.array(least)], names=["a", "n", "route"])
                else:
                    take = pa.array(t)
                    none = ~hit
                    n, r = (pa.array(x[place] if len(x) else np.zeros(len(a), np.int64), mask=none) for x in (count, route))
                    yield pa.RecordBatch.from_arrays([pa.array(a), batch.column(0).take(take), batch.column(1).take(take), pa.array(lo << 8 | hi - lo), n, r], names=["a", "id", "h", "at", "n", "route"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, h, text, hits): the text around runs of repeated anchors that have the same route."""
    for batch in batches:
        data, ends = _texts(batch.column(2))
        hits = batch.column(3)
        offsets = hits.offsets.to_numpy()
        at, route, split = (hits.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        out: list[list] = [[], [], [], [], []]
        rows = []
        for i in range(batch.num_rows):
            begin = ends[i - 1] if i else 0
            a, b = offsets[i], offsets[i + 1]
            order = np.argsort(at[a:b], kind="stable")
            p, r, k = at[a:b][order], route[a:b][order], split[a:b][order]
            lo, hi = p >> 8, (p >> 8) + (p & 255)
            cutting = np.flatnonzero((lo[1:] != hi[:-1] + 1) | (r[1:] != r[:-1]) | (k[1:] != k[:-1])) + 1
            own = _mix(np.array([hash((batch.column(0)[i].as_py(), batch.column(1)[i].as_py())) & (1 << 64) - 1], np.uint64))[0]
            for x, y in zip(np.concatenate([[0], cutting]), np.concatenate([cutting, [len(p)]]), strict=True):
                sub = int(own % np.uint64(k[x]))
                key = _mix(_mix(np.array([r[x]], np.int64).view(np.uint64) + np.uint64(k[x])) + np.uint64(sub))
                out[0].append(int(key.view(np.int64)[0]))
                out[1].append(bool(k[x] > 1))
                out[2].append(int(lo[x]))
                out[3].append(data[begin + lo[x]:begin + hi[y - 1] + LENGTH].tobytes())
                rows.append(i)
        take = pa.array(np.array(rows, dtype=np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_()), batch.column(0).take(take), batch.column(1).take(take), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())],
            names=["key", "hot", "id", "h", "lo", "piece"])


def suffix_array(data: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes in the order of their first depth bytes (8 at least; Larsson and Sadakane), each suffix's rank (one for suffixes that are equal so far), and the 8-byte words at each position."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(n, np.uint64)
    for j in range(8):
        words = words << np.uint64(8) | padded[j:n + j]
    order = np.argsort(words)
    rank = np.zeros(n + 2 * depth, np.int64)  # plus one; 0 beyond the end
    three = n < RANKS
    bits = 21 if three else 31

    def groups(keys: np.ndarray, slots: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
        """Gives each suffix its group's first slot as rank; the indexes that still share a group."""
        new = np.ones(len(keys) + 1, bool)
        new[1:-1] = keys[1:] != keys[:-1]
        rank[suffixes] = (slots[new[:-1]] + 1)[np.cumsum(new[:-1]) - 1]
        return np.flatnonzero(~(new[:-1] & new[1:]))

    slots = np.arange(n)
    slots = slots[groups(words[order], slots, order)]
    h = 8
    while h < depth and len(slots):
        suffixes = order[slots]
        keys = rank[suffixes] << bits | rank[suffixes + min(h, depth - h)]
        if three and 2 * h < depth:
            keys = keys << bits | rank[suffixes + min(2 * h, depth - h)]
            h *= 3
        else:
            h *= 2
        by = np.argsort(keys)
        order[slots] = suffixes[by]
        slots = slots[groups(keys[by], slots, suffixes[by])]
    return order, rank[:n] - 1, words


def common_prefixes(order: np.ndarray, rank: np.ndarray, words: np.ndarray, cap: int = LENGTH, lanes: int = 4096) -> np.ndarray:
    """For each place in the suffix array the prefix shared with the suffix before (Kasai), counted to cap.

    The next position's prefix is one shorter at least, as long as the two suffixes' order is known; where
    they were equal to the depth of the sort it is not, and the next prefix is counted anew unless equal ranks give it."""
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    tied = np.zeros(n, bool)
    tied[order[1:]] = rank[order[1:]] == rank[order[:-1]]
    text = np.concatenate([words, np.zeros(cap + 16, np.uint64)])
    limits = np.array([1 << 8 * i for i in range(1, 8)], dtype=np.uint64)  # leading equal bytes of a xor
    length = max(1, -(-n // lanes))
    count = -(-n // length)

    def steps(x: np.ndarray, fill: int) -> np.ndarray:
        """A row for each step, of all lanes."""
        return np.ascontiguousarray(np.append(x, np.full(count * length - n, fill, x.dtype)).reshape(count, length).T)

    others, ties = steps(before, -1), steps(tied, 0)
    shared = np.zeros((length, count), np.int64)
    begin = np.arange(0, count * length, length)
    have = np.zeros(count, np.int64)
    for step in range(length):
        other, tie = others[step], ties[step]
        have = np.where(tie, cap, np.where((have >= cap) | (other < 0), 0, np.maximum(have - 1, 0)))
        live = np.flatnonzero((other >= 0) & ~tie)
        at, by, k = begin[live] + step, other[live], have[live]
        while len(live):
            x = text[at + k] ^ text[by + k]
            k = k + np.where(x == 0, 8, 7 - np.searchsorted(limits, x, side="right"))
            have[live] = k
            on = (x == 0) & (k < cap)
            live, at, by, k = live[on], at[on], by[on], k[on]
        shared[step] = np.minimum(have, cap)
    return shared.T.ravel()[:n][order]


def repeats(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts of strings that also start earlier in data, and the others' first occurrences in suffix order; valid marks the starts that count."""
    order, rank, words = suffix_array(data)
    shared = common_prefixes(order, rank, words)
    begin = np.flatnonzero(np.concatenate([[True], shared[1:] < LENGTH]))
    ok = valid[order]
    first = np.minimum.reduceat(np.where(ok, order, len(data)), begin)
    own = np.repeat(first, np.diff(np.append(begin, len(order))))
    return order[ok & (order != own)], first[first < len(data)]


def _chunk(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (key, hot, id, h, lo, piece) of whole keys -> covered spans, and the split keys' first occurrences."""
    rows.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[3], r[4]))
    rows = [r for i, r in enumerate(rows) if not i or r[2:5] != rows[i - 1][2:5]]
    data = np.frombuffer(b"".join(r[5] for r in rows), dtype=np.uint8)
    sizes = np.array([len(r[5]) for r in rows])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    valid = np.ones(len(data), bool)
    for j in range(1, LENGTH):
        valid[begins + sizes - j] = False
    again, firsts = repeats(data, valid)
    again.sort()
    row = np.searchsorted(begins, again, side="right") - 1
    new = np.ones(len(again), bool)
    new[1:] = (again[1:] != again[:-1] + 1) | (row[1:] != row[:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(again))[:len(s)] - 1
    hot = np.array([r[1] for r in rows], dtype=bool)
    firsts = firsts[hot[np.searchsorted(begins, firsts, side="right") - 1]] if hot.any() else firsts[:0]
    owner = np.searchsorted(begins, firsts, side="right") - 1
    lo = np.array([r[4] for r in rows], dtype=np.int64)
    who = np.concatenate([row[s], owner]).astype(np.int64)
    low = np.concatenate([lo[row[s]] + again[s] - begins[row[s]], lo[owner] + firsts - begins[owner]])
    high = np.concatenate([lo[row[s]] + again[e] - begins[row[s]], lo[owner] + firsts - begins[owner]]) + LENGTH
    return _found(
        pa.array([rows[i][2] for i in who.tolist()], pa.int64()), pa.array([rows[i][3] for i in who.tolist()], pa.int64()), low, high, len(s), data.tobytes(), firsts)


def _found(ids: pa.Array, h: pa.Array, low: np.ndarray, high: np.ndarray, spans: int, raw: bytes, firsts: np.ndarray) -> pa.RecordBatch:
    """Rows of the first spans, one each, and of the first occurrences after them, which are packed: a row for each bucket of
    their strings' checksums, in suffix order."""
    strings = [raw[i:i + LENGTH] for i in firsts.tolist()]
    bucket = np.array([zlib.crc32(x) % BUCKETS for x in strings], dtype=np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    ends = np.append(edges, len(order)).astype(np.int32)
    take = pa.array(order + spans)
    text = [b"".join([strings[i] for i in order[x:y].tolist()]) for x, y in itertools.pairwise(ends.tolist())]

    def column(values: pa.Array | list, own: pa.Array | list, kind: pa.DataType) -> pa.Array:
        nulls = [pa.nulls(n, kind) for n in (spans, len(edges))]
        return pa.concat_arrays([nulls[0] if values is None else values.slice(0, spans), nulls[1] if own is None else own])

    lists = [pa.ListArray.from_arrays(pa.array(ends), x.take(take)) for x in (ids, h, pa.array(low, pa.int64()))]
    many, one = pa.list_(pa.int64()), pa.int64()
    columns = [column(x, None, one) for x in (ids, h, pa.array(low, one), pa.array(high, one))]
    columns += [column(None, pa.array(bucket[order][edges], one), one), *[column(None, x.cast(many), many) for x in lists], column(None, pa.array(text, pa.binary()), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["id", "h", "lo", "hi", "bucket", "ids", "hs", "los", "strings"])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's pieces, sorted by key; a key that is too large is cut, and its parts count as subshards."""
    rows, size, last, parts = [], 0, None, 0
    for batch in batches:
        for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if r[0] != last:
                if size >= min(BATCH, CHUNK):
                    yield _chunk(rows)
                    rows, size = [], 0
                last, own, parts = r[0], 0, 0
            elif own >= 2 * CHUNK:
                yield _chunk([(*x[:1], x[1] or x[0] == last, *x[2:]) for x in rows])
                rows, size, own, parts = [], 0, 0, parts + 1
            rows.append((*r[:1], r[1] or parts > 0, *r[2:]))
            size += len(r[5])
            own += len(r[5])
    if rows:
        yield _chunk(rows)


def merge_runs(runs: list[list[tuple[bytes, tuple]]]) -> tuple[list[tuple[bytes, tuple]], list[tuple]]:
    """Sorted runs of (string, place) with each string once -> the merged run, and the places of all but the earliest of equal strings."""
    gone: list[tuple] = []
    while len(runs) > 1:
        merged = []
        for i in range(0, len(runs) - 1, 2):
            small, large = sorted(runs[i:i + 2], key=len)
            strings, fresh = [s for s, _ in large], []
            for s, place in small:
                j = bisect_left(strings, s)
                if j < len(strings) and strings[j] == s:
                    gone.append(max(place, large[j][1]))
                    large[j] = (s, min(place, large[j][1]))
                else:
                    fresh.append((s, place))
            merged.append(sorted(large + fresh))  # two sorted runs
        runs = merged + runs[len(runs) - len(runs) % 2:]
    return (runs[0] if runs else []), gone


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows, sorted by bucket: spans (no bucket) go through, a bucket's first occurrences are merged."""
    runs: list[list[tuple[bytes, tuple]]] = []
    last = None

    def repeated() -> pa.RecordBatch:
        _, gone = merge_runs(runs)
        return pa.RecordBatch.from_arrays(
            [pa.array([p[1] if p[0] else None for p in gone], pa.int64()), pa.array([p[2] for p in gone], pa.int64()), pa.array([p[3] for p in gone], pa.int64()), pa.array([p[3] + LENGTH for p in gone], pa.int64())],
            names=["id", "h", "lo", "hi"])

    for batch in batches:
        span = batch.filter(pc.is_null(batch.column(4)))
        if span.num_rows:
            yield span.select(["id", "h", "lo", "hi"])
        packed = batch.filter(pc.is_valid(batch.column(4)))
        for i in range(packed.num_rows):
            bucket, ids, hs, los, text = (c[i].as_py() for c in packed.columns[4:])
            if bucket != last:
                yield repeated()
                runs, last = [], bucket
            runs.append([(text[k * LENGTH:(k + 1) * LENGTH], (x is not None, x or 0, h, lo)) for k, (x, h, lo) in enumerate(zip(ids, hs, los, strict=True))])
    yield repeated()


def union(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (lo, hi) spans."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > top[:-1]
    at = np.flatnonzero(new)
    return np.column_stack([spans[at, 0], top[np.append(at[1:], len(spans)) - 1]])


def _apply(text: bytes, spans: np.ndarray) -> tuple[bytes, np.ndarray]:
    runs = union(spans)
    keep, at = [], 0
    for lo, hi in runs.tolist():
        keep.append(text[at:lo])
        at = hi
    keep.append(text[at:])
    return b"".join(keep), runs


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds kept and spans; the last two columns are text and cover (null: nothing goes)."""
    for batch in batches:
        texts, cover = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        offsets = cover.offsets.to_numpy()
        pairs = np.column_stack([cover.values.field(0).to_numpy(zero_copy_only=False), cover.values.field(1).to_numpy(zero_copy_only=False)])
        kept, starts, ends, sizes = [], [], [], [0]
        for i in range(batch.num_rows):
            raw = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
            own = pairs[offsets[i]:offsets[i + 1]] if cover[i].is_valid else pairs[:0]
            if len(own):
                raw, runs = _apply(raw, own)
                starts.append(runs[:, 0])
                ends.append(runs[:, 1])
                sizes.append(len(runs))
            else:
                sizes.append(0)
            kept.append(raw)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends)]
        spans = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.StructArray.from_arrays([pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int64())], names=["start", "end"]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(kept, pa.binary()), spans], names=[*batch.schema.names[:-1], "kept", "spans"])


def covered(docs: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """docs (id, h, text) -> (id, h, lo, hi): spans to remove, which may overlap. whole: docs with the columns that the caller
    joins the spans to, so that one exchange of the texts serves both joins."""
    made = "a bigint, id bigint, h bigint, at bigint, n bigint, route bigint"
    whole = docs if whole is None else whole
    own = docs.where(F.octet_length("text") >= LENGTH)
    context = docs.sparkSession.sparkContext
    sample = own.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(SAMPLE)) == 0).mapInArrow(_anchor_rows(None), made).groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    # at most HOT_LIST numbers, whatever the input; they only decide which anchors are counted beforehand
    common = np.sort(np.array([r["a"] for r in sample.where(f"n >= {COMMON}").orderBy(F.desc("n"), "a").limit(HOT_LIST).collect()], dtype=np.int64))
    listed = None
    if len(common):
        sums = own.mapInArrow(_anchor_rows(context.broadcast((common, common, common)), True), "a bigint, n bigint, route bigint").groupBy("a").agg(F.sum("n").alias("n"), F.min("route").alias("route")).orderBy("a").collect()
        listed = context.broadcast(tuple(np.array([r[k] for r in sums], dtype=np.int64) for k in ("a", "n", "route")))
    rows = own.mapInArrow(_anchor_rows(listed), made)
    # a common anchor's rows are spread: its count and route are known
    group = Window.partitionBy("a", F.when(F.col("n").isNull(), -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(4096))))
    seen = rows.withColumns({"n": F.coalesce("n", F.count(F.lit(1)).over(group)), "route": F.coalesce("route", F.min("id").over(group))}).where("n > 1")
    split = F.when(F.col("n") <= HOT, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / HOT)))).cast("bigint")
    hits = seen.select(F.col("id").alias("_cid"), F.col("h").alias("_ch"), F.struct("at", F.coalesce("route", F.lit(-1)).alias("route"), split.alias("split")).alias("hit")).groupBy("_cid", "_ch").agg(F.collect_list("hit").alias("hits"))
    with_hits = whole.join(hits, F.col("id").eqNullSafe(F.col("_cid")) & (F.col("h") == F.col("_ch"))).select("id", "h", "text", "hits")
    pieces = with_hits.mapInArrow(_pieces, "key bigint, hot boolean, id bigint, h bigint, lo bigint, piece binary")
    found = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(
        _shard, "id bigint, h bigint, lo bigint, hi bigint, bucket bigint, ids array<bigint>, hs array<bigint>, los array<bigint>, strings binary")
    dealt = found.repartition(F.when(F.col("bucket").isNull(), F.xxhash64("id", "h", "lo")).otherwise(F.xxhash64("bucket")))
    return dealt.sortWithinPartitions("bucket").mapInArrow(_merge, "id bigint, h bigint, lo bigint, hi bigint")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with kept (the bytes that stay) and spans (start, end: the maximal removed runs, in bytes); columns of these names are replaced."""
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("d")).first()
    h = F.lit(0).cast("bigint") if ids["n"] == ids["d"] else F.xxhash64(text_or_empty(text))
    others = [c for c in docs.columns if c not in ("kept", "spans", text)]
    kind = dict(docs.dtypes)[key]
    rest = [c for c in others if c != key or kind != "bigint"]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("_rest"), F.col(key).cast("bigint").alias("id"), h.alias("h"), F.col(text).alias("text"))
    spans = covered(packed.select("id", "h", "text"), packed)
    cover = spans.groupBy(F.col("id").alias("_cid"), F.col("h").alias("_ch")).agg(F.collect_list(F.struct("lo", "hi")).alias("_cover"))
    ready = packed.join(cover, F.col("id").eqNullSafe(F.col("_cid")) & (F.col("h") == F.col("_ch")), "left").select("_rest", "id", "text", "_cover")
    kinds = ", ".join(f"`{n}` {t}" for n, t in ready.dtypes[:-1])
    made = ready.mapInArrow(_cleaned, f"{kinds}, kept binary, spans array<struct<start:bigint,end:bigint>>")
    own = {text: F.col("text")} | {c: F.col(f"_rest.`{c}`") for c in rest} | ({key: F.col("id")} if kind == "bigint" else {})
    return made.select(*[own[c].alias(c) for c in docs.columns if c in own], "kept", "spans")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.octet_length(text_or_empty()).cast("bigint")
    return made.select("doc_id", n.alias("n_bytes"), (n - F.octet_length("kept")).cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
