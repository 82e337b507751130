"""Exact substring de-duplication: equal contexts by hash, differing ones by difference-cover suffix sorting in each task.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts earlier, in an earlier document (smaller
id) or earlier in its own. Nothing crosses documents, and strings are judged on the input.

1. *Contexts.* Every window of LENGTH bytes has an anchor: its smallest K-gram hash, the leftmost of equal ones. Equal windows
   have equal anchors at equal offsets. The windows of one anchor follow each other; their text is the anchor's
   context. Contexts meet by K-gram hash: an anchor met once has no repeated window; of equal contexts all but the
   first are removed whole.
2. *Suffix sorting.* Contexts that share an anchor and differ are gathered by anchor and suffix-sorted in numpy by the
   difference-cover algorithm: sort the sampled triples (positions 1 and 2 mod 3), name them, recurse on
   the names, sort the rest by (symbol, rank behind) and merge. Neighbours in suffix order with equal prefixes of LENGTH
   bytes form classes; all windows but the first of each class are removed.
3. *Cutting.* The removed windows of a document are merged into runs and cut.

Copies are dropped before they are shuffled: within a batch only the first of equal contexts travels. An anchor
with many different contexts in one batch is hot (a passage or line that many documents share); its windows are cut
into bands by their offset, and a band goes where its common part sends it, so no task gets all contexts of a hot
anchor. Where that common part is itself in many documents (near the ends of a shared passage), its bytes are counted,
and from HEAVY_BYTES on its windows are not sorted but grouped, each by all its bytes: the common part's number
and what the window has besides. Suffix sorting stops at depth LENGTH, which is all that the comparison needs.

Contexts are compared by a 64-bit hash among those with one 64-bit K-gram hash, windows byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttera.llm.common import texts_in
from uttera.session import cut_lineage

LENGTH = 100
K = 32
#: Bytes of text for one bucket of anchors, about.
BUCKET_BYTES = 4 << 20
#: Different contexts of an anchor in a batch from which it is hot, and in a bucket.
HOT_IN_BATCH, HOT_IN_BUCKET = 16, 4096
BAND = 20
#: Bytes of pieces with one common part that go to one task.
HEAVY_BYTES = 4 << 20
#: Windows of heavy bands that a task holds at a time.
WINDOWS_HELD = 1 << 18
CHUNK = 1 << 18
WHOLE, PIECE, BANDS, BEACON, HEAVY = range(5)
LAST = (1 << 63) - 1

RECORD = np.dtype([
    ("f", "<u8"), ("c", "<u8"), ("d", "<i8"), ("h", "<i4"), ("lo", "<u4"), ("span", "u1"), ("at", "u1"), ("kind", "u1"),
])
_WINDOWS = LENGTH - K + 1
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_SIZE = CHUNK + 2 * LENGTH
_UP, _DOWN = _powers(_BASE, _SIZE), _powers(pow(_BASE, -1, 1 << 64), _SIZE)
_VALUES = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _anchors(flat: np.ndarray, bad: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(lo, hi, at, f, c): first and last window start and position of each anchor, with hashes.

    ``bad`` marks positions at which no window starts. Long buffers are worked off in chunks; a context that is cut
    at a chunk's end counts as two, which changes nothing in the result.
    """
    for base in range(0, max(0, len(flat) - LENGTH + 1), CHUNK):
        part = flat[base : base + CHUNK + LENGTH - 1]
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[part] * _UP[:n], out=sums[1:])
        grams = _mix((sums[K:] - sums[:-K]) * _DOWN[: n - K + 1])
        ranked = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)
        at = (_sliding_min(ranked, _WINDOWS) & np.uint64((1 << 24) - 1)).astype(np.int64)
        ok = np.flatnonzero(~bad[base : base + len(at)])
        if not len(ok):
            continue
        at = at[ok]
        first = np.flatnonzero(np.r_[True, (np.diff(ok) != 1) | (np.diff(at) != 0)])
        lo, hi, at = ok[first], ok[np.r_[first[1:], len(ok)] - 1], at[first]
        whole = _mix((sums[hi + LENGTH] - sums[lo]) * _DOWN[lo])
        shape = ((hi - lo) * 256 + (at - lo)).astype(np.uint64)
        yield lo + base, hi + base, at + base, grams[at], _mix(whole + shape * np.uint64(0x94D049BB133111EB))


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])


def _firsts(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records sorted by anchor, context and place; which are the first of their context (or that very place again),
    and the start of each context."""
    r = r[np.lexsort((r["lo"], r["h"], r["d"], r["c"], r["f"]))]
    starts = _groups(r["f"], r["c"])
    owner = np.repeat(starts, np.diff(np.r_[starts, len(r)]))
    same = (r["d"] == r["d"][owner]) & (r["h"] == r["h"][owner]) & (r["lo"] == r["lo"][owner])
    return r, same, starts


def _pack(r: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(r.view(np.uint8).reshape(len(r), -1).T).tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(flat.reshape(RECORD.itemsize, -1).T).reshape(-1).view(RECORD)


def _contexts(buckets: int):
    """(d, h, text) -> (bucket, blob): the anchors' records, and marks that are settled within the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The texts as they lie in the batch: one stretch of bytes and where each ends.
            if not batch.num_rows:
                continue
            column = batch.column(2).cast(pa.large_binary())  # one width of offsets, whatever Spark sends
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            held = column.buffers()[2]
            flat = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.empty(0, np.uint8)
            starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
            bad = np.zeros(len(flat), bool)  # where no window starts: the last bytes of each text
            for a, b in zip(np.maximum(starts, ends - LENGTH + 1).tolist(), ends.tolist(), strict=True):
                bad[a:b] = True
            d, h = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            made = []
            for lo, hi, at, f, c in _anchors(flat, bad):
                doc = np.searchsorted(ends, lo, "right")
                r = np.zeros(len(lo), RECORD)
                r["f"], r["c"], r["d"], r["h"] = f, c, d[doc], h[doc]
                r["lo"], r["span"], r["at"], r["kind"] = lo - starts[doc], hi - lo, at - lo, PIECE
                made.append(r)
            if not made:
                continue
            r, first, _ = _firsts(np.concatenate(made))
            copies = r[~first]
            copies["kind"] = WHOLE
            r = r[first]
            r = r[_groups(r["f"], r["c"])]  # a repeated row is met once
            by_anchor = _groups(r["f"])
            many = np.diff(np.r_[by_anchor, len(r)])
            hot = np.repeat(many >= HOT_IN_BATCH, many)
            beacons = r[by_anchor[many >= HOT_IN_BATCH]]
            beacons["kind"], beacons["c"] = BEACON, many[many >= HOT_IN_BATCH]  # how many the batch settles
            r["kind"][hot] = BANDS
            settled = np.concatenate([copies, r[hot]])
            out = np.concatenate([r[~hot], beacons, settled])
            place = out["f"].copy()
            place[len(out) - len(settled) :] = _mix(settled["d"].view(np.uint64) + settled["lo"])
            place = (place % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            out, place = out[order], place[order]
            cut = _groups(place)
            blobs = [_pack(out[a:b]) for a, b in zip(cut, np.r_[cut[1:], len(out)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(place[cut].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Rows of a sorted partition, bucket by bucket."""
    bucket, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket and rows:
                yield bucket, rows
                rows = []
            bucket = row["bucket"]
            rows.append(row)
    if rows:
        yield bucket, rows


MARKS = "d long, h int, kind int, lo long, hi long, at long"


def _marks(heavy_bytes: int):
    """What is known once all contexts of an anchor have met: windows to remove, contexts to compare further, and
    (as HEAVY, in d) the hashes of anchors of which a band may hold more than ``heavy_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            r = np.concatenate([_unpack(x["blob"]) for x in rows])
            settled = r[(r["kind"] == WHOLE) | (r["kind"] == BANDS)]
            lights = r[r["kind"] == BEACON]
            beacons, which = np.unique(lights["f"], return_inverse=True)
            sent = np.zeros(len(beacons), np.int64)
            np.add.at(sent, which, lights["c"].astype(np.int64))
            r, first, contexts = _firsts(r[r["kind"] == PIECE])
            copies = r[~first]
            copies["kind"] = WHOLE
            heads = r[contexts]
            by_anchor = _groups(heads["f"])
            many = np.diff(np.r_[by_anchor, len(heads)])
            many_of = np.repeat(many, many)
            lit = np.isin(heads["f"], beacons)
            heads["kind"] = np.where(lit | (many_of > HOT_IN_BUCKET), BANDS, PIECE)
            met, which = np.unique(np.r_[beacons, heads["f"][by_anchor]], return_inverse=True)
            contexts_of = np.zeros(len(met), np.int64)
            np.add.at(contexts_of, which, np.r_[sent, np.where(lit[by_anchor] | (many > HOT_IN_BUCKET), many, 0)])
            heavy = met[contexts_of * (LENGTH + BAND - 1) > heavy_bytes]
            told = np.zeros(len(heavy), RECORD)
            told["d"], told["kind"] = heavy.view(np.int64), HEAVY
            out = np.concatenate([settled, copies, heads[lit | (many_of > 1)], told])
            lo = out["lo"].astype(np.int64)
            columns = [out["d"], out["h"], out["kind"].astype(np.int32), lo, lo + out["span"], lo + out["at"]]
            for at in range(0, len(out), 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[at : at + (1 << 16)]) for c in columns], names=["d", "h", "kind", "lo", "hi", "at"]
                )

    return run


def _texts_and_marks(batch: pa.RecordBatch) -> Iterator[tuple]:
    columns = [batch.column(i).to_pylist() for i in range(4)]
    for d, h, z, marks in zip(*columns, strict=True):
        yield d, h, zstandard.decompress(z), marks


def _bands(text: bytes, mark: dict) -> Iterator[tuple[bytes, int, int, int]]:
    """(common part, its start, first window, last window) of each band of a context; the common part's first byte is
    the number of the band."""
    lo, hi, at = mark["lo"], mark["hi"], mark["at"]
    for near in range(0, _WINDOWS, BAND):
        far = min(near + BAND, _WINDOWS) - 1
        a, b = max(lo, at - far), min(hi, at - near)
        if a <= b:
            yield bytes([near]) + text[at - near : at - far + LENGTH], at - near, a, b


def _weights(anchors: np.ndarray):
    """(d, h, z, marks) -> (common, n): bytes that the bands of the given anchors have, by common part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight: dict[bytes, int] = {}
            for _, _, text, marks in _texts_and_marks(batch):
                marks = [m for m in marks if m["kind"] == BANDS]
                if not marks:
                    continue
                at = np.array([m["at"] for m in marks])
                grams = np.frombuffer(text, np.uint8)[at[:, None] + np.arange(K)]
                hashes = _mix((_VALUES[grams] * _UP[:K]).sum(axis=1, dtype=np.uint64))
                for i in np.flatnonzero(np.isin(hashes, anchors)).tolist():
                    for common, _, a, b in _bands(text, marks[i]):
                        weight[common] = weight.get(common, 0) + b - a + LENGTH
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(weight), pa.binary()), pa.array(list(weight.values()), pa.int64())], names=["common", "n"]
            )

    return run


def _windows(heavy: dict[bytes, int]):
    """(d, h, z, marks) -> (w, d, h, lo, hi): windows of the heavy bands, w being all the window's bytes in short: number
    of the common part, offset, bytes before and behind. Of WINDOWS_HELD the first of equal ones has a w; the
    others are settled, whatever other tasks hold, and leave as runs."""

    def out(first: dict[bytes, tuple], later: list[tuple]) -> Iterator[pa.RecordBatch]:
        d, h, s = np.array(sorted(later), np.int64).reshape(-1, 3).T
        starts = _groups(d, h, s - np.arange(len(s)))
        ends = np.r_[starts[1:], len(s)] - 1 if len(s) else starts
        places = np.array(list(first.values()), np.int64).reshape(-1, 3).T
        w = pa.array([*first, *[None] * len(starts)], pa.binary())
        d, h, lo = (np.r_[x, y] for x, y in zip(places, (d[starts], h[starts], s[starts]), strict=True))
        yield pa.RecordBatch.from_arrays(
            [w, pa.array(d), pa.array(h.astype(np.int32)), pa.array(lo), pa.array(np.r_[places[2], s[ends]])],
            names=["w", "d", "h", "lo", "hi"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple] = {}
        later: list[tuple] = []
        for batch in batches:
            for d, h, text, marks in _texts_and_marks(batch):
                for m in marks:
                    for common, start, a, b in _bands(text, m) if m["kind"] == BANDS else ():
                        number = heavy.get(common)
                        if number is None:
                            continue
                        end = start + len(common) - 1
                        for lo in range(a, b + 1):
                            w = number.to_bytes(4, "big") + bytes([start - lo]) + text[lo:start] + text[end : lo + LENGTH]
                            place = (d, h, lo)
                            met = first.setdefault(w, place)
                            if place < met:
                                first[w], met, place = place, place, met
                            if place != met:
                                later.append(place)
                    if len(first) + len(later) >= WINDOWS_HELD:
                        yield from out(first, later)
                        first, later = {}, []
        yield from out(first, later)

    return run


def _pieces(buckets: int, heavy: dict[bytes, int]):
    """(d, h, z, marks) -> pieces of text to compare: (bucket, d[], h[], lo[], windows[], text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[int, list] = {}
            for d, h, text, marks in _texts_and_marks(batch):
                for m in marks:
                    if m["kind"] == PIECE:
                        lo, hi, at = m["lo"], m["hi"], m["at"]
                        key = int.from_bytes(hashlib.blake2b(text[at : at + K], digest_size=8).digest(), "little")
                        made.setdefault(key % buckets, []).append((d, h, lo, hi - lo + 1, text[lo : hi + LENGTH]))
                        continue
                    for common, _, a, b in _bands(text, m):
                        if common not in heavy:
                            key = int.from_bytes(hashlib.blake2b(common, digest_size=8).digest(), "little")
                            made.setdefault(key % buckets, []).append((d, h, a, b - a + 1, text[a : b + LENGTH]))
            if made:
                rows = [(k, *map(list, zip(*v, strict=True))) for k, v in made.items()]
                k, d, h, lo, n, text = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k, pa.int32()), pa.array(d, pa.list_(pa.int64())), pa.array(h, pa.list_(pa.int32())),
                     pa.array(lo, pa.list_(pa.int64())), pa.array(n, pa.list_(pa.int32())),
                     pa.array([zstandard.compress(b"".join(t), 1) for t in text], pa.binary())],
                    names=["bucket", "d", "h", "lo", "n", "text"],
                )

    return run


def _names(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks of rows of symbols, and their number."""
    name, size = columns[0], int(columns[0].max(initial=0)) + 1
    for c in columns[1:]:
        width = int(c.max(initial=0)) + 1
        if size * width >= 1 << 62:
            name = np.unique(name, return_inverse=True)[1]
        name = name.astype(np.int64) * width + c
        size = size * width if size * width < 1 << 62 else int(name.max(initial=0)) + 1
    order = np.argsort(name, kind="stable")
    fresh = np.zeros(len(order), np.int64)
    fresh[1:] = name[order[1:]] != name[order[:-1]]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(fresh)
    return ranks, int(fresh.sum()) + 1 if len(order) else 0


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of s (symbols above 0) ordered by their first ``depth`` symbols at least, by the difference cover
    {1, 2} mod 3. Suffixes equal up to there come in any order."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    padded = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    # One dummy triple, should the first part not end in padding, parts the two halves of the names.
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    names, many = _names(padded[sample], padded[sample + 1], padded[sample + 2])
    if many < len(sample) and depth > 3:
        order = suffix_order(names + 1, -(-depth // 3))
    else:
        order = np.argsort(names, kind="stable")
    rank = np.zeros(n + 4, np.int64)
    # Equal names up to the depth may have different ranks; they are equal in all that is compared.
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zeros = np.arange(0, n, 3)
    width = len(sample) + 2
    zeros = zeros[np.argsort(padded[zeros] * width + rank[zeros + 1], kind="stable")]
    one = padded[zeros] * width + rank[zeros + 1]
    pair = np.concatenate([padded[zeros] * (int(padded.max()) + 1) + padded[zeros + 1], padded[sampled] * (int(padded.max()) + 1) + padded[sampled + 1]])
    pair = np.unique(pair, return_inverse=True)[1]
    two = pair[: len(zeros)] * width + rank[zeros + 2]
    own_two = pair[len(zeros) :] * width + rank[sampled + 2]
    own_one = padded[sampled] * width + rank[sampled + 1]
    before = np.where(sampled % 3 == 1, np.searchsorted(one, own_one), np.searchsorted(two, own_two))
    at = np.arange(len(sampled)) + np.maximum.accumulate(before)
    merged = np.empty(n, np.int64)
    rest = np.ones(n, bool)
    rest[at] = False
    merged[at], merged[rest] = sampled, zeros
    return merged


def _repeated(d, h, lo, n, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, h, start) of the windows of the pieces that also start earlier."""
    size = n + LENGTH - 1
    symbols = np.full(int(size.sum()) + len(size), 1, np.uint16)  # pieces end in 1
    begin = np.cumsum(size + 1) - size - 1
    inside = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    symbols[inside] = np.frombuffer(text, np.uint8).astype(np.uint16) + 2
    piece = np.repeat(np.arange(len(n)), n)
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    owner = np.full(len(symbols), -1, np.int64)
    owner[begin[piece] + offset] = np.arange(len(piece))
    order = suffix_order(symbols, LENGTH)
    order = order[owner[order] >= 0]
    windows = np.lib.stride_tricks.sliding_window_view(symbols, LENGTH)
    fresh = np.ones(len(order), bool)
    for a in range(1, len(order), 1 << 15):
        b = min(a + (1 << 15), len(order))
        fresh[a:b] = (windows[order[a:b]] != windows[order[a - 1 : b - 1]]).any(axis=1)
    group = np.cumsum(fresh)
    w = owner[order]
    wd, wh, ws = d[piece[w]], h[piece[w]], lo[piece[w]] + offset[w]
    again = np.r_[~fresh[1:], False] | ~fresh  # of a class with several members
    group, wd, wh, ws = group[again], wd[again], wh[again], ws[again]
    by = np.lexsort((ws, wh, wd, group))
    group, wd, wh, ws = group[by], wd[by], wh[by], ws[by]
    starts = _groups(group)
    first = np.repeat(starts, np.diff(np.r_[starts, len(group)]))
    later = (wd != wd[first]) | (wh != wh[first]) | (ws != ws[first])
    return wd[later], wh[later], ws[later]


SPANS = "d long, h int, lo long, hi long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a bucket -> runs of window starts (lo to hi) to remove."""
    for _, rows in _by_bucket(batches):
        cat = lambda k: np.concatenate([np.asarray(x[k], np.int64) for x in rows])  # noqa: E731, B023
        text = b"".join(zstandard.decompress(x["text"]) for x in rows)
        d, h, s = _repeated(cat("d"), cat("h"), cat("lo"), cat("n"), text)
        order = np.lexsort((s, h, d))
        d, h, s = d[order], h[order], s[order]
        starts = _groups(d, h, s - np.arange(len(s)))
        ends = np.r_[starts[1:], len(s)] - 1 if len(s) else starts
        yield pa.RecordBatch.from_arrays(
            [pa.array(d[starts]), pa.array(h[starts].astype(np.int32)), pa.array(s[starts]), pa.array(s[ends])],
            names=["d", "h", "lo", "hi"],
        )


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        z = [packer.compress(t) for t in texts_in(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], names=["d", "h", "z"])


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["lo"], x["hi"] + LENGTH) for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


CUT = "d long, h int, n_bytes long, runs array<long>, kept binary, kept_sha256 string"


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sizes, runs, kept, digests = [], [], [], []
            for z, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text = unpack(z)
                cut = _merged(spans or [])
                parts, last = [], 0
                for a, b in cut:
                    parts.append(text[last:a])
                    last = b
                rest = b"".join([*parts, text[last:]]) if cut else text
                sizes.append(len(text))
                runs.append([x for r in cut for x in r])
                kept.append(rest if with_text else None)
                digests.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(pa.int64())),
                 pa.array(kept, pa.binary()), pa.array(digests, pa.string())],
                names=["d", "h", "n_bytes", "runs", "kept", "kept_sha256"],
            )

    return run


def _heavy_windows(marked: DataFrame, heavy: dict[bytes, int]) -> DataFrame:
    """(d, h, lo, hi) of the windows of heavy bands that also start earlier. A task sends one window once in
    WINDOWS_HELD, so equal ones are few wherever they meet."""
    windows = cut_lineage(marked.mapInArrow(_windows(heavy), "w binary, d long, h int, lo long, hi long"))
    sent = windows.filter(F.col("w").isNotNull())
    place = F.struct("d", "h", "lo")
    first = sent.groupBy("w").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = sent.join(first, "w").filter(place != F.col("first"))
    return windows.filter(F.col("w").isNull()).drop("w").unionAll(later.select("d", "h", "lo", "hi"))


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True, heavy_bytes: int = HEAVY_BYTES
) -> DataFrame:
    """(doc_id, n_bytes, runs, kept, kept_sha256) per document.

    ``runs`` lists start, end, start, end ... of the removed bytes, ``kept`` has the remaining bytes (which need not be
    valid UTF-8; null without ``with_text``). Null texts are empty, null ids come last; rows of one id and different
    texts follow each other by a hash of the text; of repeated rows the first keeps what is left and the others go
    whole, if they have LENGTH bytes. An empty table gives no rows. ``doc_id`` is an integer. ``heavy_bytes`` changes
    the way, not the result.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("d"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("h"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition(buckets, "bucket").sortWithinPartitions("bucket")

    contexts = keyed.mapInArrow(_contexts(buckets), "bucket int, blob binary")
    marks = cut_lineage(by_bucket(contexts).mapInArrow(_marks(heavy_bytes), MARKS))
    small = keyed.mapInArrow(_shrink, "d long, h int, z binary")
    compared = F.col("kind").isin(PIECE, BANDS)
    wanted = marks.filter(compared).groupBy("d", "h").agg(F.collect_list(F.struct("kind", "lo", "hi", "at")).alias("marks"))
    # A repeated row sends its pieces again, under the same place, which removes nothing.
    marked = small.join(wanted, ["d", "h"])
    # Both lists are at most as long as the input has ``heavy_bytes``, times the bands that overlap.
    anchors = np.array([r["d"] for r in marks.filter(F.col("kind") == HEAVY).select("d").collect()], np.int64).view(np.uint64)
    heavy: dict[bytes, int] = {}
    if len(anchors):
        weights = marked.mapInArrow(_weights(anchors), "common binary, n long").groupBy("common").agg(F.sum("n").alias("n"))
        heavy = {bytes(r["common"]): i for i, r in enumerate(weights.filter(F.col("n") > heavy_bytes).select("common").collect())}
    pieces = marked.mapInArrow(
        _pieces(buckets, heavy), "bucket int, d array<long>, h array<int>, lo array<long>, n array<int>, text binary"
    )
    found = by_bucket(pieces).mapInArrow(_compare, SPANS)
    removed = marks.filter(F.col("kind") == WHOLE).select("d", "h", "lo", "hi").unionAll(found)
    if heavy:
        removed = removed.unionAll(_heavy_windows(marked, heavy))
    removed = removed.groupBy("d", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    cut = small.join(removed, ["d", "h"], "left").mapInArrow(_cut(with_text), CUT)
    copies = cut.groupBy("d", "h", "n_bytes", "runs", "kept", "kept_sha256").agg(F.count("*").alias("__n"))
    each = copies.select("*", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__copy"))
    again = (F.col("__copy") > 1) & (F.col("n_bytes") >= LENGTH)
    return each.select(
        F.when(F.col("d") != LAST, F.col("d")).alias("doc_id"),
        "n_bytes",
        F.when(again, F.array(F.lit(0).cast("long"), "n_bytes")).otherwise(F.col("runs")).alias("runs"),
        F.when(again & F.col("kept").isNotNull(), F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.when(again, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
