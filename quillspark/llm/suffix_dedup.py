"""Removal of repeated byte strings by enhanced suffix arrays and the tree of their common-prefix intervals.

`maximal_repeats` is the plain method: it sorts the suffixes of byte strings, computes their common prefixes, and scans
these with a stack. Each interval of suffixes with a common prefix of at least `least` bytes is a node of the interval
tree; it is a maximal repeat if the bytes to the left of its suffixes differ. It has all its occurrences.

Over a corpus no task can sort all suffixes, and sorting them by exchanges would move each byte some hundred times. So
equal strings are brought together first, and each such place is judged by its own enhanced suffix array:

1. Each window of `least` bytes chooses an anchor: the 32 bytes in it with the least hash, the last of equals. Equal
   windows choose alike, so all occurrences of a window meet at the anchor's hash. The windows that chose one anchor
   start side by side; their bytes together are the anchor's context.
2. Contexts that occur more than once as a whole, by a cryptographic digest of their bytes, are repeats of that length.
   A task settles those that it sees twice itself and passes one on, so that copies of a passage don't meet in one task.
3. The distinct contexts of an anchor that has several go to one place as bytes. A rolling hash leaves out suffixes
   that can't repeat; the others are sorted, their common prefixes are counted on the bytes, and the stack scan gives
   the intervals with all their occurrences. `repeats` returns the groups, `remove_repeats` what they cover.
4. Anchors with more than HOT distinct contexts are split: each window goes by its own digest, as contexts do in 2.

Copies of whole documents are found by SHA-256: they are covered wholly, and one of them stands for all in the rest.
Runs of a short period (lines of dashes) cover themselves; only their first period and their ends are passed on.

Defined results: null counts as empty; matches never cross documents, but a document may repeat itself; documents
shorter than `least` bytes lose nothing; rows are matched by id and a hash of the text, so repeated ids with different
texts are apart and repeated rows are copies of each other; other columns don't matter; an empty table gives an empty
result. Texts of any length are read in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import blocks_for, bucket_labels, materialize, small_enough, table
from quillspark.llm.vectors import U, mix, pack, pack_sorted, rolling, rows_of, unpack, unpack_sorted

LEAST = 200
GRAM = 32
HOT = 4096  # distinct contexts of one anchor that one suffix array takes
BATCH = 2000  # contexts judged side by side, unless one anchor has more
PIECE = 1 << 19  # bytes whose anchors are chosen at once
FLUSH = 100_000  # anchors that a task holds


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and per round the ranks by the first 2 ** round symbols; stops once ranks are distinct."""
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    levels, step, n = [rank], 1, len(text)
    order = np.argsort(rank)
    while n > 1 and rank[order[-1]] < n - 1:
        key = (rank + 1) << 32
        key[: n - step] |= rank[step:] + 1
        order = np.argsort(key)
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, sorted_[1:] != sorted_[:-1]))
        levels.append(rank)
        step *= 2
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it; the first has 0."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    out = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        # ranks at a level are alike only if that many symbols follow both, since separators are unique
        out[1:][same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return out


def maximal_repeats(strings: list[bytes], least: int = LEAST, classes: list[int] | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(string number, start), ...]) of each maximal repeat of at least `least` bytes, with all occurrences.

    Only strings of one class are compared; all are of one class by default.
    """
    if not strings:
        return []
    sizes = np.array([len(s) for s in strings])
    owner_start = np.append(0, np.cumsum(sizes + 1)[:-1])
    text = np.zeros(int(sizes.sum()) + len(strings), np.int64)
    joined = np.frombuffer(b"".join(strings), np.uint8)
    body = np.ones(len(text), bool)
    body[owner_start + sizes] = False
    text[body] = joined
    text[~body] = 256 + np.arange(len(strings))
    apart = np.repeat(np.array(classes if classes else [0] * len(strings), np.int64) << 9, sizes)
    symbols = np.where(text > 255, text << 40, 0)
    symbols[body] = text[body] + apart
    order, levels = suffix_array(symbols)
    lcp = common_prefixes(order, levels)
    left = np.append(-1, text[:-1])[order]  # separators and the first place differ from all bytes
    left = np.where((left < 0) | (left > 255), 256 + np.arange(len(order)), left)
    inside = np.append(lcp >= least, False)
    starts = np.flatnonzero(~inside[:-1] & inside[1:])
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    if not len(starts):
        return []
    # runs whose suffixes all have one byte to their left hold no maximal repeat
    bounds = np.stack([starts, ends], 1).ravel()
    bounds = bounds[:-1] if bounds[-1] == len(left) else bounds
    low, high = np.minimum.reduceat(left, bounds)[::2], np.maximum.reduceat(left, bounds)[::2]
    out = []
    for s, e in zip(starts[low != high], ends[low != high]):
        for depth, lo, hi in intervals(lcp[s:e], left[s:e], least):
            places = order[s + lo : s + hi]
            owner = np.searchsorted(owner_start, places, side="right") - 1
            out.append((depth, list(zip(owner.tolist(), (places - owner_start[owner]).tolist()))))
    return out


def intervals(lcp: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, from, to) of the common-prefix intervals of at least `least` whose left bytes differ, by a stack scan over
    sorted suffixes. `lcp`: common prefix of each suffix with the one before; that of the first is not read."""
    changes = np.append(0, np.cumsum(left[1:] != left[:-1])).tolist()
    heights = [*lcp.tolist()[1:], 0]
    stack = [(least - 1, 0)]
    for i, now in enumerate(heights, 1):
        at = i - 1
        while stack[-1][0] >= least and stack[-1][0] > now:
            depth, at = stack.pop()
            if changes[i - 1] > changes[at]:
                yield depth, at, i
        if now >= least and stack[-1][0] < now:
            stack.append((now, at))


def slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    step, out = 1, x
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


LOW = U((1 << 20) - 1)


def anchors_of(a: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(hash, place, first window, last window) of each anchor of some bytes, and the (start, end) of periodic runs."""
    h = rolling(a, GRAM)
    at = np.arange(len(h), dtype=U)
    chosen = slide_min((h & ~LOW) | (LOW - at), least - GRAM + 1)  # high bits of the hash, later places first
    place = (LOW - (chosen & LOW)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], len(place)) - 1
    place = place[first]
    key = mix(~h[place])  # least hashes, spread anew, so that they are dealt evenly
    runs = []
    # anchors of one hash at one distance: a run of that period, if its bytes are
    step = np.diff(place)
    same = (key[1:] == key[:-1]) & (step <= least // 2)
    alike = np.append(False, same[1:] & same[:-1] & (step[1:] == step[:-1]))
    if alike.sum() > 8:
        keep = np.ones(len(place), bool)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], alike.astype(np.int8), [0]])))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):  # anchors x - 1 to y are at distance d
            d, s, e = int(step[x]), int(place[x - 1]), int(place[y]) + GRAM
            if e - s >= least + d and np.array_equal(a[s : e - d], a[s + d : e]):
                runs.append((s, e))
                i = np.arange(x, y + 1)
                keep[i[(first[i] - d >= s) & (last[i] + least <= e)]] = False  # the windows of the anchor before say the same
        key, place, first, last = key[keep], place[keep], first[keep], last[keep]
    return key, place, first, last, np.array(runs, np.int64).reshape(-1, 2)


def document(b: bytes, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Of a document's anchors: hash, start, length and anchor's offset of the context; and its periodic runs."""
    parts = []
    for lo in range(0, max(len(b) - least + 1, 0), PIECE):
        size = min(len(b), lo + PIECE + least - 1) - lo
        key, place, first, last, runs = anchors_of(np.frombuffer(b, np.uint8, size, lo), least)
        parts.append((key, first + lo, last - first + least, place - first, runs + lo))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else ()


def encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def digests(b: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(n, 2) numbers: the 128-bit digests of spans."""
    f = hashlib.blake2b
    return np.frombuffer(b"".join([f(b[x:y], digest_size=16).digest() for x, y in zip(start.tolist(), end.tolist())]), U).reshape(-1, 2)


def joined_intervals(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as sorted disjoint ones that don't touch."""
    if not len(start):
        return start, end
    by = np.argsort(start, kind="stable")
    s, top = start[by], np.maximum.accumulate(end[by])
    head = np.append(True, s[1:] > top[:-1])
    return s[head], top[np.append(np.flatnonzero(head)[1:] - 1, len(s) - 1)]


def framed(cols: list[bytes]) -> bytes:
    return b"".join(len(c).to_bytes(4, "little") + c for c in cols)


def unframed(body: bytes) -> list[bytes]:
    cols, at = [], 0
    while at < len(body):
        n = int.from_bytes(body[at : at + 4], "little")
        cols.append(body[at + 4 : at + 4 + n])
        at += 4 + n
    return cols


# Rows of a document: its covers (packed starts and ends), contexts to be compared, contexts of hot anchors, or places
# of repeats (packed digests, starts and lengths).
COVER, ASK, SPLIT, GROUP = 0, 1, 2, 3
FOUND = "bucket int, doc_id long, key long, kind int, body binary"
FOUND_ARROW = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])


def by_document(ids: np.ndarray, none: np.ndarray, keys: np.ndarray, owner: np.ndarray, kind: int, cols: list[np.ndarray]) -> pa.RecordBatch:
    """A row per document of some numbers that belong to documents; `none`: documents without an id."""
    by = np.argsort(owner, kind="stable")
    owner, cols = owner[by], [c[by] for c in cols]
    who, first = np.unique(owner, return_index=True)
    cut = np.append(first, len(owner)).tolist()
    bodies = [framed([c[x:y].tobytes() for c in cols]) for x, y in zip(cut, cut[1:])]
    n = len(who)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, pa.int32()), pa.array(ids[who], pa.int64(), mask=none[who]), pa.array(keys[who], pa.int64()), pa.array(np.full(n, kind, np.int32)), pa.array(bodies, pa.binary())], schema=FOUND_ARROW
    )


class Postings:
    """Spans of documents under 64-bit keys, with digests: dealt over buckets of keys once there are FLUSH of them.

    Of spans with one key and digest, those after the first are settled here: all are covered, and the first goes on,
    marked as repeated. With `every`, all go on.
    """

    def __init__(self, labels: list[int], every: bool = False):
        self.labels, self.buckets, self.every, self.size = labels, len(labels), every, 0
        self.clear()

    def clear(self) -> None:
        self.cols: list[list[np.ndarray]] = [[] for _ in range(5)]
        self.digests, self.ids, self.none, self.keys, self.size = [], [], [], [], 0

    def add(self, doc_id: int | None, key: int, hashes: np.ndarray, digest: np.ndarray, start: np.ndarray, length: np.ndarray, offset: np.ndarray) -> None:
        for held, x in zip(self.cols, (hashes, start, length, offset, np.full(len(start), len(self.ids)))):
            held.append(x)
        self.digests.append(digest)
        self.ids.append(doc_id or 0), self.none.append(doc_id is None), self.keys.append(key)
        self.size += len(start)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        h, start, length, offset, doc = (np.concatenate(x) for x in self.cols)
        f = np.concatenate(self.digests)
        ids, none, keys = np.array(self.ids, np.int64), np.array(self.none, bool), np.array(self.keys, np.int64)
        self.clear()
        by = np.lexsort((f[:, 1], f[:, 0], h))
        h, f, start, length, offset, doc = h[by], f[by], start[by], length[by], offset[by], doc[by]
        head = np.append(True, (h[1:] != h[:-1]) | (f[1:] != f[:-1]).any(1) | self.every)
        times = np.diff(np.append(np.flatnonzero(head), len(h)))
        again = np.repeat(times > 1, times)
        if again.any():
            yield by_document(ids, none, keys, doc[again], COVER, [start[again], start[again] + length[again]])
        h, f, start, length, offset, doc, again = h[head], f[head], start[head], length[head], offset[head], doc[head], again[head]
        cut = np.searchsorted((((h >> U(32)) * U(self.buckets)) >> U(32)).astype(np.int64), np.arange(self.buckets + 1))
        numbers, bodies = [], []
        for i in range(self.buckets):
            x, y = int(cut[i]), int(cut[i + 1])
            if y > x:
                used, at = np.unique(doc[x:y], return_inverse=True)
                cols = [pack_sorted(h[x:y]), f[x:y].tobytes(), pack(start[x:y]), pack(length[x:y].astype(np.uint16)), pack(offset[x:y].astype(np.uint8)), pack(again[x:y].astype(np.uint8)), pack(at.astype(np.uint32)), pack(ids[used]), pack(none[used].astype(np.uint8)), pack(keys[used])]
                numbers.append(self.labels[i]), bodies.append(framed(cols))
        n = len(numbers)
        nulls = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), nulls, nulls, pa.nulls(n, pa.int32()), pa.array(bodies, pa.binary())], schema=FOUND_ARROW)


def anchor_rows(docs: DataFrame, labels: list[int], least: int, every: bool = False) -> DataFrame:
    """Postings of the anchors' contexts by bucket, and the covers of documents that are known already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Postings(labels, every)
        for b in batches:
            for i, k, text in rows_of(b):
                raw = encoded(text)
                if found := document(raw, least):
                    h, start, length, offset, runs = found
                    if len(runs):
                        yield by_document(np.array([i or 0]), np.array([i is None]), np.array([k]), np.zeros(len(runs), np.int64), COVER, [np.ascontiguousarray(runs[:, 0]), np.ascontiguousarray(runs[:, 1])])
                    held.add(i, k, h, digests(raw, start, start + length), start, length, offset)
                    if held.size > FLUSH:
                        yield from held.flush()
        yield from held.flush()

    return docs.select("doc_id", "key", "text").mapInArrow(run, FOUND)


def window_rows(docs: DataFrame, spans: DataFrame, labels: list[int], least: int, every: bool = False) -> DataFrame:
    """Postings of the single windows of hot anchors' contexts, each under its own digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Postings(labels, every)
        for b in batches:
            for i, k, text, bodies in rows_of(b):
                raw = encoded(text)
                for _, start, length, _ in map(contexts_in, bodies):
                    for x, n in zip(start.tolist(), length.tolist()):
                        at = np.arange(x, x + n - least + 1)
                        f = digests(raw, at, at + least)
                        held.add(i, k, f[:, 0].copy(), f, at, np.full(len(at), least), np.zeros(len(at), np.int64))
                        if held.size > FLUSH:
                            yield from held.flush()
        yield from held.flush()

    return with_bodies(docs, spans).mapInArrow(run, FOUND)


def contexts_in(body: bytes) -> tuple[np.ndarray, ...]:
    """(hash, start, length, offset) of a row of contexts."""
    h, start, length, offset = unframed(body)
    return np.frombuffer(h, np.int64), np.frombuffer(start, np.int64), np.frombuffer(length, np.int64), np.frombuffer(offset, np.int64)


def judged(rows: DataFrame, buckets: int, hot: int, groups: bool = False) -> DataFrame:
    """Per bucket and document: covers by contexts that occur more than once, and one of each distinct context of an
    anchor that has several, to be compared or, beyond `hot` of them, to be split. Known covers pass through.

    With `groups`: all places of contexts that are an anchor's only ones, and all contexts of the other anchors.
    """

    def bucket(bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts, base, docs = [], 0, []
        for body in bodies:
            c = unframed(body)
            d = np.stack([unpack(c[7], np.int64), unpack(c[8], np.uint8).astype(np.int64), unpack(c[9], np.int64)], 1)
            parts.append((unpack_sorted(c[0], U), np.frombuffer(c[1], U).reshape(-1, 2), unpack(c[2], np.int64), unpack(c[3], np.uint16), unpack(c[4], np.uint8), unpack(c[5], np.uint8) > 0, unpack(c[6], np.uint32).astype(np.int64) + base))
            docs.append(d)
            base += len(d)
        h, f, start, length, offset, again, doc = (np.concatenate(x) for x in zip(*parts))
        del parts
        d = np.concatenate(docs)
        by = np.argsort(h, kind="stable")
        live = h[by]
        twice = np.append(False, live[1:] == live[:-1])
        live = np.append(twice[1:], False) | twice | again[by]
        by = by[live]  # most anchors occur once
        h, f, start, length, offset, again, doc = h[by], f[by], start[by], length[by].astype(np.int64), offset[by].astype(np.int64), again[by], doc[by]
        by = np.lexsort((f[:, 1], f[:, 0], h))
        h, f, start, length, offset, again, doc = h[by], f[by], start[by], length[by], offset[by], again[by], doc[by]
        if not len(h):
            return
        new_h = np.append(True, h[1:] != h[:-1])
        new_f = new_h | np.append(True, (f[1:] != f[:-1]).any(1))
        kinds = np.bincount(np.cumsum(new_h) - 1, new_f)[np.cumsum(new_h) - 1]
        whole = (np.bincount(np.cumsum(new_f) - 1) > 1)[np.cumsum(new_f) - 1]
        none, ids, keys = d[:, 1] > 0, d[:, 0], d[:, 2]
        if groups:
            new_f[:] = True
            alone = whole & (kinds == 1)
            kinds = np.where(kinds > 1, np.bincount(np.cumsum(new_h) - 1)[np.cumsum(new_h) - 1], 1)
            if alone.any():
                yield by_document(ids, none, keys, doc[alone], GROUP, [f[alone, 0], f[alone, 1], start[alone], length[alone]])
        elif whole.any():
            yield by_document(ids, none, keys, doc[whole], COVER, [start[whole], start[whole] + length[whole]])
        for kind, mask in ((ASK, new_f & (kinds > 1) & (kinds <= hot)), (SPLIT, new_f & (kinds > hot))):
            if mask.any():
                yield by_document(ids, none, keys, doc[mask], kind, [h[mask].view(np.int64), start[mask], length[mask], offset[mask]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies, now = [], None
        for b in batches:
            dealt = pc.is_valid(b.column("bucket"))
            known = b.filter(pc.invert(dealt))
            if known.num_rows:
                yield known
            for number, _, _, _, body in rows_of(b.filter(dealt)):
                if number != now and bodies:
                    yield from bucket(bodies)
                    bodies = []
                now = number
                bodies.append(body)
        if bodies:
            yield from bucket(bodies)

    dealt = rows.repartition(buckets, F.coalesce("bucket", F.pmod("key", F.lit(buckets)).cast("int")))
    return dealt.sortWithinPartitions("bucket").mapInArrow(run, FOUND)


def per_document(found: DataFrame, kind: int) -> DataFrame:
    """(i, k, bodies): the rows of a kind, gathered by document."""
    return found.where(F.col("kind") == kind).groupBy(F.col("doc_id").alias("i"), F.col("key").alias("k")).agg(F.collect_list("body").alias("bodies"))


def with_bodies(docs: DataFrame, rows: DataFrame, how: str = "inner", more: tuple[str, ...] = ()) -> DataFrame:
    """Documents with their rows of `per_document`: a sort-merge join at every size, since the rows grow with the documents."""
    joined = docs.join(rows.hint("merge"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), how)
    return joined.select("doc_id", "key", "text", "bodies", *more)


def contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(group, doc_id, key, at, start, bytes): the bytes of the contexts that are to be compared."""
    schema = pa.schema([("group", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for i, k, text, bodies in rows_of(b):
                raw = encoded(text)
                h, start, length, offset = (np.concatenate(x) for x in zip(*map(contexts_in, bodies)))
                n = len(h)
                spans = pa.array([raw[x:y] for x, y in zip(start.tolist(), (start + length).tolist())], pa.binary())
                out.append(pa.RecordBatch.from_arrays([pa.array(h), pa.array([i] * n, pa.int64()), pa.array(np.full(n, k)), pa.array(offset), pa.array(start), spans], schema=schema))
                size += n
                if size > 5000:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out, size = [], 0
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return with_bodies(docs, asked).mapInArrow(run, "group long, doc_id long, key long, at long, start long, bytes binary")


def repeated_prefixes(a: np.ndarray, first: np.ndarray, last: np.ndarray, group: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(row, column, class, left byte) of the suffixes whose first `least` bytes another column of their group has at the
    same row by a rolling hash, where the bytes to the left differ; no other can start a maximal repeat."""
    rows, cols, classes, lefts, number = [], [], [], [], 0
    reach = a.shape[1] - least
    h = np.ascontiguousarray(rolling(a, least).T)
    group = np.unique(group, return_inverse=True)[1].astype(U)
    for s in range(reach + 1):
        ok = np.flatnonzero((first <= s) & (last >= s + least))
        if len(ok) > 1:
            key = (h[s, ok] & ~U(0xFFFF)) | group[ok]  # at most BATCH + 1 anchors
            by = np.argsort(key)
            ok, key = ok[by], key[by]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            times = np.diff(np.append(head, len(key)))
            left = np.where(first[ok] < s, a[ok, s - 1].astype(np.int64), 256 + ok)
            live = (times > 1) & (np.minimum.reduceat(left, head) != np.maximum.reduceat(left, head))
            take = np.repeat(live, times)
            rows.append(np.full(int(take.sum()), s)), cols.append(ok[take]), lefts.append(left[take])
            classes.append(np.repeat(np.arange(number, number + live.sum()), times[live]))
            number += int(live.sum())
    if not rows:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(classes), np.concatenate(lefts)


def sorted_suffixes(text: np.ndarray, cls: np.ndarray, length: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes (rows of bytes) within their classes, and the common prefix of each with the one before it.

    A class has one hash of the first `least` bytes, so the bytes after them decide the order; if the first bytes of
    two neighbours differ after all, classes are sorted by all bytes.
    """
    width = text.shape[1]
    key = np.ascontiguousarray(text[:, least:]).view(">u8").astype(U)
    by = np.lexsort([length, *key.T[::-1], cls])
    t, c = text[by], cls[by]
    same = c[1:] == c[:-1]
    if (t[1:, :least] != t[:-1, :least])[same].any():
        by = np.array(sorted(range(len(text)), key=lambda i: (cls[i], text[i].tobytes(), length[i])))
        t, c = text[by], cls[by]
        same = c[1:] == c[:-1]
    size = length[by]
    differ = t[1:] != t[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    return by, np.append(0, np.where(same, np.minimum(common, np.minimum(size[1:], size[:-1])), 0))


def context_repeats(held: list[tuple], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, columns, rows) of the maximal repeats among the contexts of one anchor, for some anchors, with all
    occurrences. Contexts stand side by side with their anchors in one column of bytes."""
    reach, m = least - GRAM, len(held)
    width = least + -(-reach // 8) * 8
    a = np.zeros((m, reach + width), np.uint8)
    first = np.array([reach - x[3] for x in held])
    last = first + np.array([len(x[5]) for x in held])
    for j, x in enumerate(held):
        a[j, first[j] : last[j]] = np.frombuffer(x[5], np.uint8)
    row, col, cls, left = repeated_prefixes(a[:, : reach + least], first, last, np.array([x[0] for x in held], np.int64), least)
    views = np.lib.stride_tricks.sliding_window_view(a, width, axis=1)
    cuts = np.append(np.flatnonzero(np.append(True, cls[1:] != cls[:-1])) if len(cls) else 0, len(row))
    # whole classes at a time, some tens of thousands of suffixes
    marks = np.unique(np.append(cuts[np.searchsorted(cuts, np.arange(0, len(row), 20_000))], len(row)))
    for lo, hi in zip(marks[:-1], marks[1:]):
        r, c, lf = row[lo:hi], col[lo:hi], left[lo:hi]
        by, lcp = sorted_suffixes(views[c, r], cls[lo:hi], last[c] - r, least)
        r, c, lf = r[by], c[by], lf[by]
        for depth, x, y in intervals(lcp, lf, least):
            yield depth, c[x:y], r[x:y]


def context_covers(held: list[tuple], least: int) -> list[tuple[int, int, int]]:
    """(position in `held`, start, end) of the bytes that belong to repeats, starts and ends as in the documents."""
    deep = np.zeros((len(held), least - GRAM + 1), np.int16)
    doc = {}
    who = np.array([doc.setdefault(x[1:3], len(doc)) for x in held])
    origin = np.array([x[4] - (least - GRAM - x[3]) for x in held])  # where a column's byte 0 lies in its document
    for depth, c, r in context_repeats(held, least):
        place = origin[c] + r
        if (who[c] != who[c[0]]).any() or (place != place[0]).any():  # else one place of a document, not a repeat
            deep[c, r] = np.maximum(deep[c, r], depth)
    c, r = np.nonzero(deep)
    wide = np.int64(1 << 40)  # columns side by side, apart from each other
    start = c * wide + origin[c] + r + least
    s, e = joined_intervals(start, start + deep[c, r])
    return list(zip((s // wide).tolist(), (s % wide - least).tolist(), (e % wide - least).tolist()))


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of contexts, those of an anchor together."""
    held, last = [], None
    for b in batches:
        for row in rows_of(b):
            if len(held) >= BATCH and row[0] != last:
                yield held
                held = []
            last = row[0]
            held.append(row)
    if held:
        yield held


def edge_covers(rows: DataFrame, buckets: int, least: int) -> DataFrame:
    """Covers of documents by the repeats among the contexts of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in grouped(batches):
            covers = context_covers(held, least)
            if covers:
                col, s, e = (np.array(x, np.int64) for x in zip(*covers))
                doc: dict = {}
                owner = np.array([doc.setdefault(held[j][1:3], len(doc)) for j in col.tolist()])
                ids = np.array([i or 0 for i, _ in doc], np.int64)
                yield by_document(ids, np.array([i is None for i, _ in doc]), np.array([k for _, k in doc], np.int64), owner, COVER, [s, e])

    return rows.repartition(buckets, "group").sortWithinPartitions("group").mapInArrow(run, FOUND)


def marked_copies(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, key, text, copy, keep): whether a text of `least` bytes has an equal in the table, and whether the row is
    the one that stands for them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    digest = F.sha2("text", 256)
    groups = rows.where(F.octet_length("text") >= least).groupBy(digest.alias("digest")).agg(F.count("*").alias("c"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("f"), F.first("key").alias("g_key")).where("c > 1")
    marks = groups.groupBy("g_key").agg(F.collect_list(F.struct("digest", F.col("f.doc_id").alias("id"))).alias("digests"))
    marks = materialize(marks, "repeat-copies")
    marks = F.broadcast(marks) if small_enough(marks) else marks
    own = F.get(F.filter("digests", lambda d: d["digest"] == digest), F.lit(0))  # the 64-bit key only finds the digest
    found = rows.join(marks, F.col("key") == F.col("g_key"), "left").withColumn("own", F.when(F.col("digests").isNotNull(), own))
    return found.select("doc_id", "key", "text", F.col("own").isNotNull().alias("copy"), (F.col("own").isNull() | F.col("doc_id").eqNullSafe(F.col("own.id"))).alias("keep"))


def repeated_spans(docs: DataFrame, least: int = LEAST, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, key, text, copy, keep), and covers (rows of FOUND) of those that aren't copies, to be united."""
    marked = marked_copies(docs, least)
    single = marked.where("keep").where(F.octet_length("text") >= least).select("doc_id", "key", "text")
    buckets = blocks_for(docs, 8)
    labels = bucket_labels(docs.sparkSession, buckets)
    found = materialize(judged(anchor_rows(single, labels, least), buckets, hot), "repeat-anchors")
    covers = found.where(F.col("kind") == COVER)
    if not found.where(F.col("kind") == SPLIT).isEmpty():
        windows = judged(window_rows(single, per_document(found, SPLIT), labels, least), buckets, hot)
        covers = covers.unionByName(windows.where(F.col("kind") == COVER))
    edges = edge_covers(contexts(single, per_document(found, ASK)), buckets, least)
    return marked, covers.unionByName(edges)


def repeats(docs: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """(repeat, length, doc_id, start): groups of equal strings of at least `least` bytes with all their occurrences.

    They are the maximal repeats of the strings whose windows chose one anchor: a longer repeat is given as several, which
    overlap or touch, and among the contexts of a hot anchor as its windows. `repeat` is the digest of the bytes. A row
    per occurrence, with those in copies of documents.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("text")).where(F.octet_length("text") >= least)
    buckets = blocks_for(docs, 8)
    labels = bucket_labels(docs.sparkSession, buckets)
    found = materialize(judged(anchor_rows(rows, labels, least, True), buckets, hot, True), "repeat-anchors")
    split = judged(window_rows(rows, per_document(found, SPLIT), labels, least, True), buckets, hot, True)
    out = "repeat string, length long, doc_id long, start long"
    schema = pa.schema([("repeat", pa.string()), ("length", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)] if rows else [pa.array([], t.type) for t in schema], schema=schema)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, body in zip(b.column("doc_id").to_pylist(), b.column("body").to_pylist()):
                x, y, start, length = (np.frombuffer(c, np.int64) for c in unframed(body))
                names = [r.tobytes().hex() for r in np.stack([x, y], 1)]
                yield batch([(n, k, doc_id, s) for n, k, s in zip(names, length.tolist(), start.tolist())])

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in grouped(batches):
            rows = []
            for depth, c, r in context_repeats(held, least):
                at = [(j, s - (least - GRAM - held[j][3])) for j, s in zip(c.tolist(), r.tolist())]
                places = {(held[j][1], held[j][4] + s) for j, s in at}
                if len(places) > 1:
                    name = hashlib.blake2b(held[at[0][0]][5][at[0][1] : at[0][1] + depth], digest_size=16).hexdigest()
                    rows += [(name, depth, i, s) for i, s in places]
            yield batch(rows)

    whole = found.unionByName(split).where(F.col("kind") == GROUP).mapInArrow(alone, out)
    asked = contexts(rows, per_document(found, ASK)).repartition(buckets, "group").sortWithinPartitions("group")
    return whole.unionByName(asked.mapInArrow(among, out))


def remove_repeats(docs: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, spans (starts and ends of removed runs), kept (bytes)."""
    marked, covers = repeated_spans(docs, least, hot)
    rows = with_bodies(marked, per_document(covers, COVER), "left", ("copy",))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                out = []
                for doc_id, _, text, bodies, copy in rows_of(b.slice(i, 256)):
                    raw = encoded(text)
                    n = len(raw)
                    if copy:
                        start, end = np.array([0]), np.array([n])
                    else:
                        cols = [unframed(x) for x in bodies or []]
                        start, end = joined_intervals(*(np.frombuffer(b"".join(c[j] for c in cols), np.int64) for j in (0, 1)))
                    kept, last = [], 0
                    for x, y in zip(start.tolist(), end.tolist()):
                        kept.append(raw[last:x])
                        last = y
                    kept.append(raw[last:])
                    out.append({"doc_id": doc_id, "n_bytes": n, "n_removed": int((end - start).sum()), "n_spans": len(start), "spans": np.stack([start, end], 1).ravel().tolist(), "kept": b"".join(kept)})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
