"""Removes long byte strings that an earlier document also holds, by a hash-compared suffix sort.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller doc_id; strings are judged on
the input. The work, over documents that are dealt once into buckets:

1. Each LENGTH-byte window has an anchor, the smallest hash of the ANCHOR-byte strings inside it, which depends on the
   window's bytes alone. A bucket posts its distinct anchors; anchors found in one document only are out.
2. An anchor with more than HOT_SEGMENTS different surroundings would bring too much to one task. Its windows are posted
   once more by the hash of the whole window, again once per bucket, and from here on a window that several documents
   hold goes by its own hash in place of its anchor. So a phrase of a third of all documents is dealt over all ranges.
3. Around the other shared anchors each bucket cuts segments (runs of windows with one anchor) and posts each distinct
   segment once, with the smallest doc_id that holds it. Copies thus weigh one segment per bucket, however many there are.
4. Per range of anchors, equal segments become one, and the windows of those left are suffixes in one buffer. They are
   sorted by a mergesort whose comparisons find the common extension of two suffixes by binary search over prefix
   polynomial hashes; neighbours that agree in LENGTH bytes by hash are compared byte for byte, and where different
   strings share a hash the range is done again with another base. Each class of equal windows gets its smallest doc_id,
   and each segment's windows learn whether that is smaller than their own.
5. The buckets apply the answers and cut the texts.

Edge cases: a null text is empty and stays empty; texts shorter than LENGTH bytes stay whole; a doc_id that occurs
several times is one document (its rows never cut each other); a null doc_id neither cuts nor is cut; very long texts
are used whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_row, with_fields

LENGTH = 50
ANCHOR = 16
#: A bucket holds about so many bytes of text.
BUCKET_BYTES = 4_000_000
#: Windows that one vectorised sort takes at a time.
SLICE_WINDOWS = 120_000
#: Windows of one segment at most; longer runs (periodic texts) are cut into several segments.
SEGMENT_WINDOWS = 48

#: An anchor with more distinct segments goes by whole windows; so many make about 100 MB of a sort's arrays.
HOT_SEGMENTS = 16_384

#: Bases of the hashes; the others are for ranges where two different strings share a hash.
_BASES = (6364136223846793005, 2862933555777941757, 3202034522624059733)
_MASK = 2**64
#: Anchors travel as their low six bytes; a chance agreement only makes a candidate that the sort then tells apart.
_LOW = np.uint64(2**48 - 1)


def _pack(anchors: np.ndarray) -> bytes:
    return np.ascontiguousarray(anchors.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return np.pad(six, ((0, 0), (0, 2))).view("<u8").ravel()


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2**64 and of its inverse."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, _MASK), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _CACHE or len(_CACHE[base][0]) < n:
        _CACHE[base] = _powers(max(1 << 16, 1 << (n - 1).bit_length()), base)
    return _CACHE[base]


class PrefixHashes:
    """Polynomial hashes of any substring of a buffer from its prefix hashes."""

    def __init__(self, data: np.ndarray, base: int = _BASES[0]):
        self.data = data
        self.up, down = powers(len(data) + 1, base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], out=self.sums[1:], dtype=np.uint64)

    def at(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.up[start]

    def every(self, length: int) -> np.ndarray:
        """The hash of each substring of that length, finished so that its order is random."""
        n = len(self.data) - length + 1
        h = (self.sums[length:] - self.sums[:-length]) * self.up[:n]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    span, low = 1, h
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


_STEP = 1 << 16


def _pieces(data: bytes) -> Iterator[tuple[int, PrefixHashes]]:
    """A text's windows in parts, so that a very long text's arrays stay small: first window, hashes of the part."""
    for a in range(0, len(data) - LENGTH + 1, _STEP):
        yield a, PrefixHashes(np.frombuffer(data, np.uint8, min(len(data) - a, _STEP + LENGTH - 1), a))


def window_runs(data: bytes, digests: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, anchor.

    digests collects, for each run before it is cut to SEGMENT_WINDOWS, its anchor with sixteen bits of a hash of its bytes.
    """
    n = len(data) - LENGTH + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    firsts, anchors = [], []
    for a, h in _pieces(data):
        low = _sliding_min(h.every(ANCHOR), LENGTH - ANCHOR + 1)
        new = np.ones(len(low), bool)
        new[1:] = low[1:] != low[:-1]
        at = np.flatnonzero(new)
        firsts.append(at + a)
        anchors.append(low[at] & _LOW)
        if digests is not None:
            size = np.diff(np.append(at, len(low))) + LENGTH - 1
            digests.append((anchors[-1] << np.uint64(16)) | ((h.at(at, size) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)))
    first, anchor = np.concatenate(firsts), np.concatenate(anchors)
    count = np.diff(np.append(first, n))
    if len(count) and count.max() > SEGMENT_WINDOWS:
        parts = -(-count // SEGMENT_WINDOWS)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(first, parts) + inner * SEGMENT_WINDOWS
        anchor = np.repeat(anchor, parts)
        count = np.minimum(np.repeat(count, parts) - inner * SEGMENT_WINDOWS, SEGMENT_WINDOWS)
    return first, count, anchor


def window_hashes(data: bytes) -> np.ndarray:
    """The low six bytes of the hash of each window."""
    parts = [h.every(LENGTH) & _LOW for _, h in _pieces(data)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_, values)
    at[at == len(sorted_)] = 0
    return sorted_[at] == values


def _inside(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The windows of runs, one by one."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _ranges(anchors: np.ndarray, n: int) -> np.ndarray:
    """Anchors are minima and so crowd at the low end; multiplied, they spread evenly over the ranges."""
    spread = (anchors * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
    return spread.astype(np.int64) * n >> 32


def _posts(bucket: int, ids: list, per_doc: list[np.ndarray], n_ranges: int, segments: np.ndarray | None = None) -> list[tuple]:
    """The bucket's distinct keys per range: those of one document, and those of several with how many segments they have.

    segments: key << 16 | digest of each run of windows, where segments are to be counted. The count only tells hot keys.
    """
    number = {i: k for k, i in enumerate(dict.fromkeys(i for i in ids if i is not None))}
    who = np.repeat([number[i] for i in ids if i is not None], [len(x) for i, x in zip(ids, per_doc) if i is not None]).astype(np.int64)
    keys = np.concatenate([np.zeros(0, np.uint64), *(x for i, x in zip(ids, per_doc) if i is not None)])
    order = np.argsort(keys, kind="stable")
    keys, who = keys[order], who[order]
    distinct, first = np.unique(keys, return_index=True)
    several = np.zeros(len(distinct), bool)
    counts = np.ones(len(distinct), np.int64)
    if len(distinct):
        several = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
        if segments is not None:
            told, times = np.unique(np.unique(segments) >> np.uint64(16), return_counts=True)
            counts = times[np.searchsorted(told, distinct)]
    r = _ranges(distinct, n_ranges)
    order = np.argsort(r, kind="stable")
    distinct, several, counts, r = distinct[order], several[order], np.minimum(counts[order], 65535).astype("<u2"), r[order]
    return [
        (int(r[a]), bucket, _pack(distinct[a:b][~several[a:b]]), _pack(distinct[a:b][several[a:b]]), counts[a:b][several[a:b]].tobytes())
        for a, b in _groups(r)
    ]


def post_anchors(bucket: int, ids: list, data: list[bytes], n_ranges: int) -> list[tuple]:
    """The bucket's anchors for each range."""
    segments: list[np.ndarray] = [np.zeros(0, np.uint64)]
    per_doc = [np.unique(window_runs(x, segments)[2]) for x in data]
    return _posts(bucket, ids, per_doc, n_ranges, np.concatenate(segments))


def post_windows(bucket: int, ids: list, data: list[bytes], hot: np.ndarray, n_ranges: int) -> list[tuple]:
    """The bucket's windows around hot anchors, by their own hashes, for each range."""
    per_doc = []
    for x in data:
        first, count, anchor = window_runs(x)
        some = _among(anchor, hot)
        per_doc.append(np.unique(window_hashes(x)[_inside(first[some], count[some])]) if some.any() else np.zeros(0, np.uint64))
    return _posts(bucket, ids, per_doc, n_ranges)


def _groups(values: np.ndarray) -> list[tuple[int, int]]:
    if not len(values):
        return []
    at = np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values)).tolist()
    return list(zip(at, at[1:]))


def shared_keys(rows: pd.DataFrame) -> pd.DataFrame:
    """Per bucket, which of its keys in this range several documents hold, and which of them are hot."""
    lists = [_unpack(x) for x in (*rows["single"], *rows["multiple"])]
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.concatenate(lists)
    n_single = sizes[: len(rows)].sum()
    several = np.arange(len(flat)) >= n_single
    counts = np.concatenate([np.ones(n_single, np.int64), np.frombuffer(b"".join(rows["counts"]), "<u2")])
    distinct, where, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    shared[where[several]] = True
    hot = np.bincount(where, counts, len(distinct)) > HOT_SEGMENTS
    out = {}
    for name, wanted in (("anchors", shared & ~hot), ("hot", shared & hot)):
        keep = wanted[where]
        ends = np.cumsum(np.append(0, keep))[np.append(0, np.cumsum(sizes))].tolist()
        data = _pack(flat[keep])
        parts = [data[6 * a : 6 * b] for a, b in zip(ends, ends[1:])]
        out[name] = [x + y for x, y in zip(parts, parts[len(rows) :])]
    return pd.DataFrame([(b, x or None, y or None) for b, x, y in zip(rows["bucket"], out["anchors"], out["hot"]) if x or y], columns=["bucket", "anchors", "hot"])


class Segments:
    """A bucket's segments around shared anchors, and its shared windows around hot ones; equal ones are one entry.

    keys and least tell each entry's anchor and bytes, and its smallest doc_id.
    """

    def __init__(self, ids: list, data: list[bytes], shared: np.ndarray, hot: np.ndarray, windows: np.ndarray):
        shared, hot, windows = np.sort(shared), np.sort(hot), np.sort(windows)
        self.doc, self.first, self.count, self.entry, self.least = [], [], [], [], []
        entries: dict[tuple[int, bytes], int] = {}
        docs, firsts, counts, entry, least = self.doc, self.first, self.count, self.entry, self.least
        if not len(shared) and not len(windows):
            data = []
        for d, (i, x) in enumerate(zip(ids, data)):
            if i is None or len(x) < LENGTH:
                continue
            first, count, anchor = window_runs(x)
            keep = np.flatnonzero(_among(anchor, shared))
            places, sizes, keys = first[keep].tolist(), count[keep].tolist(), anchor[keep].tolist()
            if len(windows) and (some := _among(anchor, hot)).any():
                at = _inside(first[some], count[some])
                own = window_hashes(x)[at]
                kept = _among(own, windows)
                places += at[kept].tolist()
                keys += own[kept].tolist()
                sizes += [1] * (len(places) - len(sizes))
            for p, n, a in zip(places, sizes, keys):
                key = (a, x[p : p + n + LENGTH - 1])
                e = entries.setdefault(key, len(entries))
                if e == len(least):
                    least.append(i)
                elif i < least[e]:
                    least[e] = i
                entry.append(e)
            docs += [d] * len(places)
            firsts += places
            counts += sizes
        self.keys = list(entries)

    def posts(self, bucket: int, n_ranges: int) -> list[tuple]:
        anchors = np.array([a for a, _ in self.keys], np.uint64)
        order = np.argsort(_ranges(anchors, n_ranges), kind="stable")
        r = _ranges(anchors[order], n_ranges)
        least = np.array(self.least, np.int64)
        rows = []
        for a, b in _groups(r):
            some = order[a:b]
            parts = [self.keys[e][1] for e in some.tolist()]
            lengths = np.array([len(x) for x in parts], np.uint32)
            rows.append((int(r[a]), bucket, _pack(anchors[some]), some.astype(np.uint32).tobytes(), least[some].tobytes(), lengths.tobytes(), zstandard.compress(b"".join(parts), 3)))
        return rows

    def cover(self, ids: list, marks: dict[int, int]) -> list[list[tuple[int, int]]]:
        """Per document, the removed runs of bytes. marks: entry -> bits of windows that an earlier document holds."""
        out: list[list[tuple[int, int]]] = [[] for _ in ids]
        for d, p, n, e in zip(self.doc, self.first, self.count, self.entry):
            if ids[d] > self.least[e]:
                out[d].append((p, p + n + LENGTH - 1))
            elif bits := marks.get(e, 0):
                for k in range(n):
                    if bits >> k & 1:
                        out[d].append((p + k, p + k + LENGTH))
        for spans in out:
            spans.sort()
            merged: list[tuple[int, int]] = []
            for s, e in spans:
                if merged and s <= merged[-1][1]:
                    if e > merged[-1][1]:
                        merged[-1] = (merged[-1][0], e)
                else:
                    merged.append((s, e))
            spans[:] = merged
        return out


def _extension(h: PrefixHashes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common extension of the suffixes at a and b, up to LENGTH bytes, by binary search over hashes.

    The whole length is tried first: among candidates most pairs are equal.
    """
    same = np.where(h.at(a, LENGTH) == h.at(b, LENGTH), LENGTH, 0)
    step = 1 << (LENGTH.bit_length() - 1)
    while step:
        fits = np.flatnonzero(same + step <= LENGTH)
        x, y = a[fits] + same[fits], b[fits] + same[fits]
        good = fits[h.at(x, step) == h.at(y, step)]
        same[good] += step
        step >>= 1
    return same


def _before(h: PrefixHashes, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether suffix a sorts before b, and whether both agree in LENGTH bytes."""
    same = _extension(h, a, b)
    equal = same == LENGTH
    k = np.where(equal, 0, same)
    return h.data[a + k] < h.data[b + k], equal


def sort_suffixes(h: PrefixHashes, suffixes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mergesort of each group of suffixes (groups begin at starts), all groups level by level at once."""
    order = suffixes.copy()
    n = len(order)
    sizes = np.diff(np.append(starts, n))
    width = 1
    while len(sizes) and width < sizes.max():
        big = sizes > width
        begin, size = np.repeat(starts[big], sizes[big]), np.repeat(sizes[big], sizes[big])
        local = np.arange(len(begin)) - np.repeat(np.cumsum(sizes[big]) - sizes[big], sizes[big])
        run = local // width
        other = (run ^ 1) * width
        lo, hi = np.minimum(other, size), np.minimum(other + width, size)
        low = lo.copy()
        me, left = order[begin + local], (run & 1) == 0
        active = np.flatnonzero(low < hi)
        while len(active):
            mid = (low[active] + hi[active]) >> 1
            before, equal = _before(h, order[begin[active] + mid], me[active])
            goes = before | (equal & ~left[active])  # ties: the left run first
            low[active] = np.where(goes, mid + 1, low[active])
            hi[active] = np.where(goes, hi[active], mid)
            active = active[low[active] < hi[active]]
        place = (run & ~1) * width + (local - run * width) + (low - lo)
        moved = order.copy()
        moved[begin + place] = me
        order = moved
        width *= 2
    return order


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> bool:
    """Whether data[a : a + length] equals data[b : b + length] for each pair, a bounded number of bytes at a time."""
    done, k = np.cumsum(lengths), 0
    while k < len(a):
        e = max(k + 1, int(np.searchsorted(done, (done[k - 1] if k else 0) + 1_000_000)))
        size = lengths[k:e]
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        if not (data[np.repeat(a[k:e], size) + offset] == data[np.repeat(b[k:e], size) + offset]).all():
            return False
        k = e
    return True


def _digests(data: np.ndarray, begin: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The hash of each of the strings that make up data, about 100,000 bytes at a time."""
    done, out, k = begin + lengths, [], 0
    while k < len(begin):
        e = max(k + 1, int(np.searchsorted(done, begin[k] + 100_000)))
        out.append(PrefixHashes(data[begin[k] : done[e - 1]], base).at(begin[k:e] - begin[k], lengths[k:e]))
        k = e
    return np.concatenate(out)


class HashCollision(ArithmeticError):
    """Two different strings have one hash."""


def resolve(rows: pd.DataFrame) -> pd.DataFrame:
    """Per bucket and entry, the bits of the windows that also start in a document before the entry's first."""
    for base in _BASES:
        try:
            return _resolve(rows, base)
        except HashCollision:
            continue
    raise HashCollision(f"different strings share a hash with each of {len(_BASES)} bases")


def _resolve(rows: pd.DataFrame, base: int) -> pd.DataFrame:
    """resolve with hashes of one base.

    Equal segments of different buckets are found by their hashes first and confirmed on the bytes: all but the earliest
    are covered whole, and one of them stands for all in the suffix sort. Anchors with one distinct segment need no sort.
    The sort works through the range in slices of whole anchors with about SLICE_WINDOWS windows each.
    """
    data = np.frombuffer(b"".join(map(zstandard.decompress, rows["data"])), np.uint8)
    lengths = np.frombuffer(b"".join(rows["lengths"]), np.uint32).astype(np.int64)
    anchors = _unpack(b"".join(rows["anchors"]))
    least = np.frombuffer(b"".join(rows["least"]), np.int64)
    entries = np.frombuffer(b"".join(rows["entries"]), np.uint32)
    bucket = np.repeat(rows["bucket"].to_numpy(), [len(x) // 4 for x in rows["entries"]])
    begin = np.cumsum(lengths) - lengths
    if not len(lengths):
        return pd.DataFrame({"bucket": [], "entries": [], "bits": []})

    digest = _digests(data, begin, lengths, base)
    order = np.lexsort((least, digest, lengths, anchors))
    new = np.ones(len(order), bool)
    for key in (anchors, lengths, digest):
        ranked = key[order]
        if key is anchors:
            new[1:] = ranked[1:] != ranked[:-1]
        else:
            new[1:] |= ranked[1:] != ranked[:-1]
    same = np.flatnonzero(~new)
    if not _equal_bytes(data, begin[order[same - 1]], begin[order[same]], lengths[order[same]]):
        raise HashCollision
    stands = order[new]  # of each distinct segment, the one with the smallest doc_id
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1

    several = np.flatnonzero(np.append(True, anchors[stands][1:] != anchors[stands][:-1]))
    sizes = np.diff(np.append(several, len(stands)))
    chosen = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    bits = np.zeros(len(stands), np.uint64)
    groups = np.flatnonzero(np.append(True, anchors[stands[chosen]][1:] != anchors[stands[chosen]][:-1])) if len(chosen) else np.zeros(0, np.int64)
    done, a = np.cumsum(lengths[stands[chosen]] - LENGTH + 1), 0
    while a < len(chosen):
        full = np.searchsorted(done, (done[a - 1] if a else 0) + SLICE_WINDOWS)
        nxt = int(np.searchsorted(groups, max(full, a + 1), side="left"))
        b = int(groups[nxt]) if nxt < len(groups) else len(chosen)
        some = stands[chosen[a:b]]
        size = lengths[some]
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        bits[chosen[a:b]] = _earlier_windows(data[np.repeat(begin[some], size) + offset], size, anchors[some], least[some], base)
        a = b

    windows = (lengths - LENGTH + 1).astype(np.uint64)
    whole = (np.uint64(1) << windows) - np.uint64(1)  # SEGMENT_WINDOWS is below 64
    mine = np.where(least > least[stands[kind]], whole, bits[kind])
    told = np.flatnonzero(mine)
    told = told[np.argsort(bucket[told], kind="stable")]
    out = [(int(bucket[told[a]]), entries[told[a:b]].tobytes(), mine[told[a:b]].tobytes()) for a, b in _groups(bucket[told])]
    return pd.DataFrame(out, columns=["bucket", "entries", "bits"])


def _word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number, in byte order."""
    word = np.zeros(len(at), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | data[at + k].astype(np.uint64)
    return word


def _earlier_windows(data: np.ndarray, lengths: np.ndarray, anchors: np.ndarray, least: np.ndarray, base: int) -> np.ndarray:
    """Per segment, the bits of its windows that a segment with a smaller doc_id also holds.

    Only suffixes that agree in anchor and in the first and last eight bytes of their windows, from more than one
    document, can tell anything; these groups are sorted.
    """
    begin = np.cumsum(lengths) - lengths
    windows = lengths - LENGTH + 1
    owner = np.repeat(np.arange(len(windows)), windows)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begin[owner] + inner
    bits = np.zeros(len(windows), np.uint64)
    keys = (anchors[owner], _word(data, at), _word(data, at + LENGTH - 8))
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = False
    for key in keys:
        ranked = key[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    mine = least[owner[order]]
    sizes = np.diff(np.append(starts, len(order)))
    told = np.repeat(np.minimum.reduceat(mine, starts) != np.maximum.reduceat(mine, starts), sizes)
    order, new = order[told], new[told]
    if not len(order):
        return bits
    starts = np.flatnonzero(new)
    h = PrefixHashes(data, base)
    ranked = sort_suffixes(h, at[order], starts)
    window = np.empty(len(data), np.int64)  # windows by place; places are distinct
    window[at] = np.arange(len(at))
    window = window[ranked]
    # Classes of equal windows: neighbours inside a group whose extension reaches LENGTH, confirmed on the bytes.
    pairs = np.flatnonzero(~new)
    equal = _extension(h, ranked[pairs - 1], ranked[pairs]) == LENGTH
    some = ranked[pairs[equal]]
    if not _equal_bytes(data, ranked[pairs[equal] - 1], some, np.full(len(some), LENGTH)):
        raise HashCollision
    fresh = new.copy()
    fresh[pairs] = ~equal
    heads = np.flatnonzero(fresh)
    mine = least[owner[window]]
    first = np.repeat(np.minimum.reduceat(mine, heads), np.diff(np.append(heads, len(mine))))
    hit = window[first < mine]
    np.bitwise_or.at(bits, owner[hit], np.uint64(1) << inner[hit].astype(np.uint64))
    return bits


def _sorted_ids(rows: pa.Table) -> tuple[list, list[bytes], list[int]]:
    """doc_ids and texts of a bucket in an order that does not depend on how rows arrive, and that order."""
    ids, data = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, data[k]))
    return [ids[k] for k in order], [data[k].encode() for k in order], order


def _rows_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def _keys_of(told: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(_unpack(x) for x in told.column(name).to_pylist() if x)])


_POSTS = "r long, bucket long, single binary, multiple binary, counts binary"
_SEGMENTS = "r long, bucket long, anchors binary, entries binary, least binary, lengths binary, data binary"
_POSTS_ARROW, _SEGMENTS_ARROW = (pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.binary()) for x in s.split(", ")]) for s in (_POSTS, _SEGMENTS))


def repeated_spans(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, keep: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans (array of begin, end in bytes: the runs to remove) and kept (the other bytes) of every row.

    as_text returns kept as a string; a character of which only some bytes go is dropped whole.
    keep names further columns of docs to carry along, in the struct "row".
    """
    spark = docs.sparkSession
    carried = [whole_row(docs, keep)] if keep else []
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carried)
    carries = bool(carried)
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / bucket_bytes))
    n_ranges = max(1, n // 2)
    # Buckets are dealt evenly, and their partitions stay bounded as the input grows.
    parts = max(1, min(n, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // 4)))
    bucket = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(n))
    dealt = own.withColumn("bucket", bucket).repartition(parts, "bucket")
    bare = dealt.select("doc_id", "text", "bucket")

    def post_group(rows: pa.Table) -> pa.Table:
        ids, data, _ = _sorted_ids(rows)
        return _rows_of(post_anchors(rows.column("bucket")[0].as_py(), ids, data, n_ranges), _POSTS_ARROW)

    def post_hot(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows or not len(_keys_of(told, "hot")):
            return _POSTS_ARROW.empty_table()
        ids, data, _ = _sorted_ids(rows)
        return _rows_of(post_windows(rows.column("bucket")[0].as_py(), ids, data, np.sort(_keys_of(told, "hot")), n_ranges), _POSTS_ARROW)

    def cut(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows or not told.num_rows:
            return _SEGMENTS_ARROW.empty_table()
        ids, data, _ = _sorted_ids(rows)
        found = Segments(ids, data, *(_keys_of(told, x) for x in ("anchors", "hot", "windows")))
        return _rows_of(found.posts(rows.column("bucket")[0].as_py(), n_ranges), _SEGMENTS_ARROW)

    def finish(rows: pa.Table, told: pa.Table) -> pa.Table:
        ids, data, order = _sorted_ids(rows)
        spans: list = [[] for _ in ids]
        if told.num_rows:
            marks: dict[int, int] = {}
            for e, b in zip(told.column("entries").to_pylist(), told.column("bits").to_pylist()):
                if e:
                    marks.update(zip(np.frombuffer(e, np.uint32).tolist(), np.frombuffer(b, np.uint64).tolist()))
            spans = Segments(ids, data, *(_keys_of(told, x) for x in ("anchors", "hot", "windows"))).cover(ids, marks)
        flat = [[x for span in s for x in span] for s in spans]
        kept = [remove_spans(x, s) for x, s in zip(data, flat)]
        out = {
            "doc_id": pa.array(ids, pa.int64()),
            "n_bytes": pa.array([len(x) for x in data], pa.int64()),
            "spans": pa.array(flat, pa.list_(pa.int64())),
            "kept": pa.array([x.decode(errors="ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
        }
        return pa.table(out | ({"row": rows.column("row").combine_chunks().take(pa.array(order, pa.int64()))} if carries else {}))

    shared_of = lambda posts: posts.repartition(parts, "r").groupBy("r").applyInPandas(shared_keys, "bucket long, anchors binary, hot binary")
    shared = shared_of(bare.groupBy("bucket").applyInArrow(post_group, _POSTS))
    windows = shared_of(bare.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(post_hot, _POSTS))
    none = F.lit(None).cast("binary")
    either = F.concat(F.coalesce("anchors", F.lit(b"")), F.coalesce("hot", F.lit(b"")))  # a window's hash is its last key
    known = shared.withColumn("windows", none).unionByName(windows.select("bucket", none.alias("anchors"), none.alias("hot"), either.alias("windows")))
    segments = bare.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(cut, _SEGMENTS)
    resolved = segments.repartition(parts, "r").groupBy("r").applyInPandas(resolve, "bucket long, entries binary, bits binary")
    told = known.unionByName(resolved, allowMissingColumns=True)
    columns = with_fields(f"doc_id long, n_bytes long, spans array<long>, kept {'string' if as_text else 'binary'}", own, ["row"] if carried else [])
    return dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(finish, columns)


def remove_spans(data: bytes, spans: list[int]) -> bytes:
    """data without the runs spans[0]:spans[1], spans[2]:spans[3], ..."""
    kept, at = [], 0
    for begin, end in zip(spans[::2], spans[1::2]):
        kept.append(data[at:begin])
        at = end
    return b"".join([*kept, data[at:]])


def kept_bytes(spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes."""
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    return spans.select("doc_id", "n_bytes", removed.alias("n_removed"), F.floor(F.size("spans") / 2).cast("long").alias("n_spans"), "kept")


def cut_documents(docs: DataFrame) -> DataFrame:
    """docs without the repeated runs, all columns kept and n_chars (if there) counted anew.

    A character of which only some bytes go is dropped whole.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = repeated_spans(docs, keep=others or None, as_text=True).withColumnRenamed("kept", "text")
    columns = {c: F.col("row")[c] for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*(columns[c].alias(c) for c in docs.columns))
