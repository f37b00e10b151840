"""Suffix-array dedup by bucket-pointer refinement, distributed.

Wanted: every byte that lies in a string of LENGTH bytes which also starts in a document with a smaller id. Only windows (strings of LENGTH bytes)
matter, so suffixes are sorted to that depth and no further:

1. Initial buckets. A window's anchor is its q-gram (GRAM bytes) of the least hash, the leftmost of equals; equal windows have equal anchors at equal places.
   Neighbouring windows with one anchor are a segment, so a document is a row of segments, about one per 16 bytes. Segments meet in buckets
   by anchor; batches of documents send (anchor, content hash, smallest and largest id) once per distinct segment.
   Before that, batches send only short names of each segment's sides: the anchor with the SIDE bytes before it, and with OTHER_SIDE bytes from its end. A window
   holds one side or the other whole, so a segment neither of whose sides is in another document has no window that is; it goes no further.
   Names have SIDE_BITS bits beside their part; those that look the same only let a segment pass that later steps then find alone.
2. A bucket that holds one document is done: nothing in it repeats. A bucket of several documents but one content is done, too: all its
   windows repeat, first in the smallest id. Contents are told apart by 64 bits beside the anchor's 32 bits and part; among the few contents of one anchor
   two that differ look the same with a probability of about 2**-64 a pair. All others are mixed, and only their distinct segments' bytes are sent on: of a
   content that several batches have, one is told to send them, and the others send names and ids.
3. Mixed buckets are refined: positions are put into buckets by 8 bytes, and these are refined by sorting on the bucket pointers at later offsets
   (8, then 16, then LENGTH - 32). Buckets of one are passed over, and new pointers are used at once for the buckets that a round refines later.
   Neighbours' bytes are compared at last. Mixed buckets with very many segments are dealt out by window before that, so no task gets all of one.
4. Batches mark the windows that start in a smaller id elsewhere, and cut the bytes they cover.

Batches, and the parts that anchors are dealt to, are as many as Spark's shuffle partitions ask for, so a task's share does not grow with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bytes_of, fresh, text_slices
from tessera.llm.shingles import U, mixed

LENGTH = 50
GRAM = 20
#: Bytes before an anchor, and behind it, of which a window with that anchor holds the former or the latter.
SIDE = (LENGTH - GRAM) // 2
OTHER_SIDE = LENGTH - GRAM - SIDE + 1
#: Bits of a side's name beside its part: few, so that their differences fit two bytes.
SIDE_BITS = 28
NO_SIDE = np.iinfo(U).max
#: Contents of one anchor from which a mixed bucket is dealt out by window, which takes some 12 times its bytes: as many as one task refines in about a second.
MANY = 1 << 15
#: Bytes of documents that segments are worked out for at once, so few that their arrays stay in a core's cache; a longer document is worked on in parts of this size.
CHUNK = 1 << 16
#: Bytes of mixed buckets that are refined at once; a bucket of half as many or more is refined alone.
BLOCK = 1 << 16
#: Bytes of texts that are dealt to batches at once.
DEAL_BYTES = 16 << 20
#: Parts that a round refines one after the other.
PARTS = 4
#: The first bytes of a big-endian number, by how many.
HEAD = np.array([(1 << 64) - (1 << 8 * (8 - n)) for n in range(9)], U)
#: Low bits that hold a place among CHUNK bytes.
PLACE = U((1 << 24) - 1)
NONE, SAME, MIXED, DEALT = 0, 1, 2, 3
#: What texts and messages are shuffled with; Spark's own codec makes them half as large again.
CODEC, LEVEL = "zstd", 3
#: What a message to a batch is about.
SIDES, ANCHORS, CONTENTS = 0, 1, 2
LOWEST = np.iinfo(np.int64).min


#: An odd number, the base of rolling hashes.
BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of BASE and of its inverse, modulo 2**64, for CHUNK bytes and a window."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up, self.down = (self.powers(base, size) for base in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]

    @staticmethod
    def powers(base: int, size: int) -> np.ndarray:
        out = np.ones(1, U)
        while len(out) < size:
            out = np.concatenate([out, out * U(pow(base, len(out), 1 << 64))])
        return out


POWERS = Powers()


class Texts:
    """Documents end to end, and their windows' segments: key (of the anchor), sides' names, content, first window's place, windows, document."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], parts: int):
        self.ids, self.texts = ids, texts
        self.at = np.cumsum([0, *map(len, texts)])
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        found = [self.segments(*piece) for piece in self.pieces()]
        none = [np.empty(0, U), np.empty(0, U), np.empty(0, U), np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)]
        anchor, left, right, self.content, self.start, self.n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else none
        self.key = part_key(anchor, parts)
        self.sides = np.concatenate([left, right])
        there = self.sides != NO_SIDE
        self.sides[there] = part_key(self.sides[there], parts, SIDE_BITS)
        self.doc = np.searchsorted(self.at, self.start, "right") - 1
        self.doc_id = ids[self.doc] if len(ids) else np.empty(0, np.int64)

    def pieces(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """First and last byte of about CHUNK bytes, several documents or part of a longer one, and which places from there start a window."""
        first, last = 0, 0
        while first < len(self.texts):
            last = max(first + 1, int(np.searchsorted(self.at, self.at[first] + CHUNK, "right")) - 1)
            low, high = int(self.at[first]), int(self.at[last])
            if last == first + 1:
                for a in range(low, high - LENGTH + 1, CHUNK):
                    b = min(a + CHUNK + LENGTH - 1, high)
                    yield a, b, np.ones(b - a - LENGTH + 1, bool)
            elif high - low >= LENGTH:
                windows = np.ones(high - low, bool)
                tail = np.minimum(np.diff(self.at[first : last + 1]), LENGTH - 1)
                windows[ragged(self.at[first + 1 : last + 1] - low - tail, tail)] = False
                if windows.any():
                    yield low, high, windows[: high - low - LENGTH + 1]
            first = last

    def segments(self, low: int, high: int, windows: np.ndarray) -> list[np.ndarray]:
        data = self.data[low:high]
        with np.errstate(over="ignore"):
            up, down = POWERS.upto(len(data) + 1)
            sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[: len(data)], dtype=U)])
            grams = (sums[GRAM:] - sums[:-GRAM]) * down[: len(sums) - GRAM]  # a power's upper bits are spread well enough to tell the least
            place = leftmost_least(grams, LENGTH - GRAM + 1)
            cuts = (place[1:] != place[:-1]) | ~windows[1:] | ~windows[:-1]
            start = np.flatnonzero(windows & np.append(True, cuts))
            n = np.flatnonzero(windows & np.append(cuts, True)) - start + 1
            end = start + n + LENGTH - 1
            at = place[start]
            anchor = mixed(grams[at])
            content = mixed(mixed((sums[end] - sums[start]) * down[start] + n.astype(U)) ^ anchor)
            left, right = np.full(len(at), NO_SIDE), np.full(len(at), NO_SIDE)
            has = at - start >= SIDE
            left[has] = mixed((sums[at[has] + GRAM] - sums[at[has] - SIDE]) * down[at[has] - SIDE])
            has = end - at >= GRAM + OTHER_SIDE
            right[has] = mixed((sums[at[has] + GRAM + OTHER_SIDE] - sums[at[has]]) * down[at[has]])
        return [anchor, left, right, content, start + low, n]

    def names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct names of the sides, sorted; an order of the sides by name, and where each name starts in it."""
        there = np.flatnonzero(self.sides != NO_SIDE)
        order, first = groups_of(self.sides[there])
        order = there[order]
        return self.sides[order[first]], order, first

    def keep_shared(self, told: pa.Table) -> Texts:
        """Only the segments with a side that the parts have found in several documents."""
        names, order, first = self.names()
        shared = np.zeros(len(names), bool)
        bits = {part: data for part, data, what in zip(told.column("part").to_pylist(), messages(told), told.column("what").to_pylist(), strict=True) if what == SIDES}
        for part, s in by_part(names):
            shared[s] = np.unpackbits(np.frombuffer(bits[part], np.uint8), count=s.stop - s.start)
        side = np.zeros(len(self.sides), bool)
        side[order] = np.repeat(shared, np.diff(np.append(first, len(order))))
        keep = np.flatnonzero(side[: len(self.key)] | side[len(self.key) :])
        self.key, self.content, self.start, self.n, self.doc, self.doc_id = (x[keep] for x in (self.key, self.content, self.start, self.n, self.doc, self.doc_id))
        return self

    def bytes_at(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.data[ragged(start, length)]

    def window_keys(self, start: np.ndarray) -> np.ndarray:
        """A hash of the window at each place."""
        out = np.zeros(len(start), U)
        with np.errstate(over="ignore"):
            for k in range(LENGTH):
                out = out * U(BASE) + self.data[start + k].astype(U) + U(1)
        return mixed(out)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of the runs that start so and are so long."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its least, the leftmost of equals. Values count with their upper bits; the lower ones hold the place."""
    least, span = values & ~PLACE | np.arange(len(values), dtype=U), 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return (least & PLACE).astype(np.int64)


def part_key(hashes: np.ndarray, parts: int, bits: int = 32) -> np.ndarray:
    """The part that a hash is dealt to, above its own upper bits."""
    return (hashes % U(parts)) << U(32) | hashes >> U(64 - bits)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length with their bytes in planes, so that high bytes that are all alike compress."""
    return b"".join([len(arrays[0]).to_bytes(8, "little"), *(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)])


def unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for kind in map(np.dtype, kinds):
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return [*out, np.frombuffer(data, np.uint8, len(data) - at, at)]


def groups_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys (the last one first), and where groups of equals start in it."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, np.flatnonzero(new)


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec(CODEC, LEVEL).compress(data, asbytes=True)


def messages(table: pa.Table) -> list[bytes]:
    codec = pa.Codec(CODEC, LEVEL)
    return [codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in table.column("data").to_pylist()]


def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (batch, id, text) as one row per batch, with its ids and texts as a compressed Arrow stream."""
    fresh()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec(CODEC, LEVEL))
    for whole in batches:
        for piece in text_slices(iter([whole]), 2, DEAL_BYTES):
            to = piece.column(0).to_numpy()
            order, first = groups_of(to)
            dealt = pa.table(piece.select(["id", "text"])).take(pa.array(order)).combine_chunks()
            data = []
            for a, b in zip(first, [*first[1:], len(order)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, dealt.schema, options=options) as out:
                    out.write_table(dealt.slice(a, b - a))
                data.append(sink.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(to[order[first]], pa.int32()), pa.array([d.to_pybytes() for d in data], pa.binary())], ["batch", "data"])


def opened(table: pa.Table) -> pa.Table:
    """A batch's ids and texts from the streams that it was dealt."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("data")])


def texts_of_batch(table: pa.Table, parts: int) -> Texts:
    table = opened(table)
    ids = table.column("id").combine_chunks().fill_null(LOWEST).to_numpy(zero_copy_only=False)
    column = table.column("text").combine_chunks()
    return Texts(ids, bytes_of(column), parts)


def distinct(content: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place for each content, and its smallest and largest id."""
    order, first = groups_of(content)
    if not len(order):
        return order, ids, ids
    return order[first], np.minimum.reduceat(ids[order], first), np.maximum.reduceat(ids[order], first)


def by_part(key: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The slices of sorted keys that go to one part each."""
    if not len(key):
        return
    part = (key >> U(32)).astype(np.int64)
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
        yield int(part[a]), slice(int(a), int(b))


def rows(out: list[tuple]) -> pa.Table:
    part, batch, data = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"part": pa.array(part, pa.int32()), "batch": pa.array(batch, pa.int32()), "data": pa.array(map(squeezed, data), pa.binary())})


def send_sides(table: pa.Table, parts: int) -> pa.Table:
    """The names of a batch's sides to their parts, and whether several of its documents have them."""
    t = texts_of_batch(table, parts)
    names, order, first = t.names()
    if not len(names):
        return rows([])
    ids = t.doc_id[order % len(t.key)]
    several = (np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)).astype(np.uint8)
    batch = table.column("batch")[0].as_py()
    return rows([(part, batch, packed(np.diff(names[s].astype(np.uint32), prepend=np.uint32(0)), several[s])) for part, s in by_part(names)])


def judge_sides(table: pa.Table) -> pa.Table:
    """For each batch one bit for each name that it sent, in its order: whether several documents have it. What two batches have counts as such."""
    read = [unpacked(x, np.uint32, np.uint8) for x in messages(table)]
    name = np.concatenate([np.cumsum(r[0], dtype=np.uint32) for r in read])
    several = np.concatenate([r[1] for r in read]).astype(bool)
    order, first = groups_of(name)
    size = np.diff(np.append(first, len(order)))
    shared = np.empty(len(name), bool)
    shared[order] = np.repeat((size > 1) | np.logical_or.reduceat(several[order], first), size)
    cuts = np.cumsum([0, *(len(r[0]) for r in read)])
    part = table.column("part")[0].as_py()
    return rows([(part, batch, np.packbits(shared[a:b]).tobytes()) for batch, a, b in zip(table.column("batch").to_pylist(), cuts[:-1], cuts[1:], strict=True)])


def send_segments(table: pa.Table, told: pa.Table, parts: int) -> pa.Table:
    """A batch's distinct segments whose sides are shared to the parts of their anchors."""
    if not table.num_rows or not told.num_rows:
        return rows([])
    t = texts_of_batch(table, parts).keep_shared(told)
    at, low, high = distinct(t.content, t.doc_id)
    order = np.argsort(t.key[at], kind="stable")
    at, low, high = at[order], low[order], high[order]
    batch = table.column("batch")[0].as_py()
    key, content = t.key[at], t.content[at]
    out = []
    for part, s in by_part(key):
        own = key[s].astype(np.uint32)
        out.append((part, batch, packed(np.diff(own, prepend=np.uint32(0)), content[s], low[s], high[s] - low[s])))
    return rows(out)


def judge_anchors(table: pa.Table) -> pa.Table:
    """Of a part's anchors: which several documents share, whether with one content (and which), and the smallest id; to each batch for its own.

    Beside them one bit for each segment in a mixed bucket that the batch named, in its order: whether it is the one to send the bytes.
    """
    read = [unpacked(x, np.uint32, U, np.int64, np.int64) for x in messages(table)]
    key = np.concatenate([np.cumsum(r[0], dtype=np.uint32) for r in read])
    content, low, span = (np.concatenate([r[i] for r in read]) for i in (1, 2, 3))
    source = np.repeat(np.arange(len(read)), [len(r[0]) for r in read])
    order, new_key = groups_of(key)
    if not len(order):
        return rows([])
    sorted_key, sorted_content = key[order], content[order]
    low_of, high_of = np.minimum.reduceat(low[order], new_key), np.maximum.reduceat((low + span)[order], new_key)
    size = np.diff(np.append(new_key, len(order)))
    one = np.logical_and.reduceat(sorted_content == np.repeat(sorted_content[new_key], size), new_key)
    group = np.repeat(np.arange(len(new_key)), size)
    several = np.flatnonzero(((low_of != high_of) & ~one)[group])
    copies, first = groups_of(sorted_content[several], group[several])
    contents = np.bincount(group[several][copies[first]], minlength=len(new_key))
    kind = np.where(low_of == high_of, NONE, np.where(one, SAME, np.where(contents <= MANY, MIXED, DEALT))).astype(np.uint8)
    # one batch sends the bytes of each content: any of those that have it, so that none sends more than its share
    pick = first + (sorted_content[several][copies[first]] % np.diff(np.append(first, len(copies))).astype(U)).astype(np.int64)
    asked, sends = np.zeros(len(key), bool), np.zeros(len(key), bool)
    asked[order[several]], sends[order[several][copies[pick]]] = True, True
    starts = np.cumsum([0, *(len(r[0]) for r in read)])
    told = kind[group] != NONE
    group, to, names = group[told], source[order][told], sorted_key[told]
    part = table.column("part")[0].as_py()
    batches = table.column("batch").to_pylist()
    one_content = sorted_content[new_key]
    by_batch = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[by_batch], np.arange(len(read) + 1))
    out = []
    for b in range(len(read)):
        own = by_batch[cuts[b] : cuts[b + 1]]
        if len(own):
            keep = np.append(True, names[own][1:] != names[own][:-1])
            g = group[own][keep]
            here = slice(starts[b], starts[b + 1])
            bits = np.packbits(sends[here][asked[here]]).tobytes()
            out.append((part, batches[b], packed(np.diff(names[own][keep], prepend=np.uint32(0)), kind[g], low_of[g]) + packed(one_content[g[kind[g] == SAME]]) + bits))
    return rows(out)


class Answers:
    """What parts have told a batch: of anchors (kind, smallest id, the content if there is one, by part whose bytes to send), and of contents (their windows' smallest ids, in runs)."""

    def __init__(self, table: pa.Table):
        key, kind, low, one, content, runs, lengths, ids = [[] for _ in range(8)]
        self.asked: dict[int, np.ndarray] = {}
        for part, data, what in zip(table.column("part").to_pylist(), messages(table), table.column("what").to_pylist(), strict=True):
            if what == CONTENTS:
                c, r, rest = unpacked(data, U, np.int32)
                n, i, _ = unpacked(rest.tobytes(), np.int32, np.int64)
                content.append(c), runs.append(r), lengths.append(n), ids.append(i)
            elif what == ANCHORS:
                k, d, m, rest = unpacked(data, np.uint32, np.uint8, np.int64)
                o = np.zeros(len(k), U)
                o[d == SAME], self.asked[part] = unpacked(rest.tobytes(), U)
                one.append(o)
                key.append(U(part) << U(32) | np.cumsum(k, dtype=np.uint32).astype(U)), kind.append(d), low.append(m)
        join = lambda x, d: np.concatenate(x) if x else np.empty(0, d)
        order = np.argsort(k := join(key, U))
        self.key, self.kind, self.low, self.one = k[order], join(kind, np.uint8)[order], join(low, np.int64)[order], join(one, U)[order]
        order = np.argsort(c := join(content, U), kind="stable")
        n = join(runs, np.int64)
        self.content, self.runs, self.first = c[order], n[order], (np.cumsum(n) - n)[order]
        self.lengths, self.ids = join(lengths, np.int64), join(ids, np.int64)

    @staticmethod
    def look(table: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Where each name is in the sorted table, or -1."""
        if not len(table):
            return np.full(len(names), -1)
        at = np.minimum(np.searchsorted(table, names), len(table) - 1)
        return np.where(table[at] == names, at, -1)

    def anchors(self, key: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kind and smallest id of each segment's anchor; a segment of another content than the only one that is shared is alone."""
        at = self.look(self.key, key)
        if not len(self.key):
            return np.zeros(len(key), np.uint8), np.zeros(len(key), np.int64)
        kind = np.where(at < 0, NONE, self.kind[at])
        return np.where((kind == SAME) & (self.one[at] != content), NONE, kind), self.low[at]

    def sends(self, key: np.ndarray) -> np.ndarray:
        """Whether to send the bytes of each of the distinct segments in mixed buckets, given by their sorted keys."""
        out = np.zeros(len(key), bool)
        for part, s in by_part(key):
            if len(self.asked[part]) != (s.stop - s.start + 7) // 8:
                raise ValueError("a part was told of other segments")
            out[s] = np.unpackbits(self.asked[part], count=s.stop - s.start)
        return out


def dealt_windows(t: Texts, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, key and document id of every window of the segments."""
    start = ragged(t.start[segments], t.n[segments])
    return start, t.window_keys(start), np.repeat(t.doc_id[segments], t.n[segments])


def send_mixed(table: pa.Table, told: pa.Table, parts: int) -> pa.Table:
    """A batch's distinct segments in mixed buckets whose sides are shared, or their single windows where those are dealt out; bytes (else no windows) if it is asked for them."""
    if not table.num_rows or not told.num_rows:
        return rows([])
    t = texts_of_batch(table, parts).keep_shared(told)
    answers = Answers(told)
    kind, _ = answers.anchors(t.key, t.content)
    segments = np.flatnonzero((kind == MIXED) | (kind == DEALT))
    at, low, high = distinct(t.content[segments], t.doc_id[segments])
    order = np.argsort(t.key[segments[at]], kind="stable")
    at, low, high = segments[at[order]], low[order], high[order]
    sends = answers.sends(t.key[at])
    d = np.flatnonzero(kind[at] == DEALT)
    single = ragged(t.start[at[d]], t.n[at[d]])
    name, owner = t.window_keys(single), np.repeat(d, t.n[at[d]])
    w, first = groups_of(name)
    if len(w):
        wlow, whigh, wsends = np.minimum.reduceat(low[owner[w]], first), np.maximum.reduceat(high[owner[w]], first), np.logical_or.reduceat(sends[owner[w]], first)
    else:
        wlow, whigh, wsends = low[:0], high[:0], sends[:0]
    w = w[first]
    m = np.flatnonzero(kind[at] == MIXED)
    key, content = np.concatenate([t.key[at[m]], part_key(name[w], parts)]), np.concatenate([t.content[at[m]], name[w]])
    start, n = np.concatenate([t.start[at[m]], single[w]]), np.concatenate([t.n[at[m]], np.ones(len(w), np.int64)])
    low, span, sends = np.concatenate([low[m], wlow]), np.concatenate([high[m] - low[m], whigh - wlow]), np.concatenate([sends[m], wsends])
    order = np.argsort(key, kind="stable")
    batch = table.column("batch")[0].as_py()
    out = []
    for part, s in by_part(key[order]):
        own = order[s]
        names = key[own].astype(np.uint32)
        bear = own[sends[own]]
        out.append((part, batch, packed(np.diff(names, prepend=np.uint32(0)), content[own], np.where(sends[own], n[own], 0).astype(np.int32), low[own], span[own]) + t.bytes_at(start[bear], n[bear] + LENGTH - 1).tobytes()))
    return rows(out)


def bucket_pointers(data: np.ndarray, left: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Equal pointers for places where equal strings of ``length`` bytes (8 at least) start; left: bytes from a place to the end of its piece.

    A bucket's pointer is its first place in the sorted order, where a piece's end comes before all bytes. A round refines the buckets part by part, and new
    pointers are used at once for the parts that follow, so those may be refined further than the round asks for. The last round refines windows alone and
    takes the pointers as they stand. The order is that of the strings at any depth, so equal windows end up side by side,
    and comparing neighbours' bytes tells where one window ends.
    """
    gram = np.zeros(len(data), U)
    for k in range(min(8, len(data))):
        gram[: len(data) - k] |= data[k:].astype(U) << U(8 * (7 - k))
    gram &= HEAD[np.minimum(left, 8)]
    order = np.argsort(gram)
    first = np.flatnonzero(np.append(True, gram[order[1:]] != gram[order[:-1]]))[: len(order)]
    size = np.diff(np.append(first, len(order)))
    pointer, alone = np.empty(len(data), np.int64), np.empty(len(data), bool)
    pointer[order], alone[order] = np.repeat(first, size), np.repeat(size == 1, size)

    def refined(here: np.ndarray, step: int) -> None:
        """Sorts the places of whole buckets by the pointers ``step`` bytes on; parts of a bucket get pointers inside it."""
        on = np.where(left[here] > step, pointer[np.minimum(here + step, len(data) - 1)] + 1, 0)
        key = pointer[here] * (len(data) + 1) + on
        sort = np.argsort(key)
        order, key = here[sort], key[sort]
        old = pointer[order]
        bucket = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(order)))
        alone[order] = np.repeat(size == 1, size)
        start = np.repeat(bucket, np.diff(np.append(bucket, len(order))))[first]
        pointer[order] = old + np.repeat(first - start, size)

    depth = 8
    while depth < length:
        step = min(depth, length - depth)
        last = depth + step >= length
        here = np.flatnonzero(~alone & (left >= length)) if last else np.flatnonzero(~alone)
        if len(here) and last:
            refined(here, step)
        elif len(here):
            at = pointer[here]
            cuts = np.quantile(at, np.arange(1, PARTS) / PARTS)
            part = np.searchsorted(cuts, at)
            for k in reversed(range(PARTS)):
                if len(own := here[part == k]):
                    refined(own, step)
        depth += step
    windows = np.flatnonzero(left >= length)
    order = windows[np.argsort(pointer[windows], kind="stable")]
    if len(order):
        new = np.append(True, pointer[order[1:]] != pointer[order[:-1]])
        close = np.flatnonzero(new[1:]) + 1  # one pointer: equal at any rate
        same = np.ones(len(close), bool)
        for k in [*range(0, length - 7, 8), length - 8]:
            same &= gram[order[close] + k] == gram[order[close - 1] + k]
        new[close[same]] = False
        pointer[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return pointer


def refine(table: pa.Table) -> pa.Table:
    """For each batch's contents that hold a window which starts in a smaller id too: the smallest id of each of their windows.

    Equal windows have equal anchors, so buckets are taken by anchor, BLOCK bytes at a time.
    """
    read = [unpacked(x, np.uint32, U, np.int32, np.int64, np.int64) for x in messages(table)]
    key = np.concatenate([np.cumsum(r[0], dtype=np.uint32) for r in read])
    content, n, low, span = (np.concatenate([r[i] for r in read]) for i in range(1, 5))
    n, high = n.astype(np.int64), low + span
    data = np.concatenate([r[5] for r in read])
    size = np.where(n > 0, n + LENGTH - 1, 0)
    at = np.cumsum(size) - size
    # what batches have in common is refined once, with the bytes of one of them
    order, first = groups_of(content, key)
    if not len(order):
        return rows([])
    of = np.empty(len(order), np.int64)
    of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    least_low = np.minimum.reduceat(low[order], first)
    bearer = np.maximum.reduceat(np.where(n[order] > 0, order, -1), first)
    if (bearer < 0).any():
        raise ValueError("no batch sent the bytes of a content")
    key, n, size, at = key[bearer], n[bearer], size[bearer], at[bearer]
    before = np.cumsum(size) - size
    bucket = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    block = np.repeat(blocks(np.diff(np.append(before[bucket], size.sum()))), np.diff(np.append(bucket, len(key))))
    cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    owners, lengths, ids = [], [], []
    smallest = np.empty(len(key), np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
        e = slice(a, b)
        end = np.cumsum(size[e])
        pointer = bucket_pointers(data[ragged(at[e], size[e])], np.repeat(end, size[e]) - np.arange(end[-1]))
        place = pointer[ragged(end - size[e], n[e])]
        owner = np.repeat(np.arange(a, b), n[e])
        least = np.full(len(pointer), np.iinfo(np.int64).max)
        np.minimum.at(least, place, least_low[owner])
        least = least[place]
        smallest[e] = np.minimum.reduceat(least, np.cumsum(n[e]) - n[e])
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])))
        owners.append(owner[first])
        lengths.append(np.diff(np.append(first, len(owner))).astype(np.int32))
        ids.append(least[first])
    runs = np.bincount(np.concatenate(owners), minlength=len(key))
    length, least, start = np.concatenate(lengths), np.concatenate(ids), np.cumsum(runs) - runs
    part = table.column("part")[0].as_py()
    ends = np.cumsum([0, *(len(r[0]) for r in read)])
    out = []
    for a, b, batch in zip(ends[:-1], ends[1:], table.column("batch").to_pylist(), strict=True):
        # a window of a content matters if one of the batch's documents with that content has a larger id than the window's smallest
        own = a + np.flatnonzero(smallest[of[a:b]] < high[a:b])
        if len(own):
            place = ragged(start[of[own]], runs[of[own]])
            out.append((part, batch, packed(content[own], runs[of[own]].astype(np.int32)) + packed(length[place], least[place])))
    return rows(out)


def blocks(size: np.ndarray) -> np.ndarray:
    """The block of each bucket, given their sizes: as many neighbours as fit BLOCK bytes; a bucket of half a block or more is alone."""
    out, block, filled = np.empty(len(size), np.int64), 0, 0
    large = size * 2 >= BLOCK
    for i, (n, alone) in enumerate(zip(size.tolist(), large.tolist(), strict=True)):
        if filled and (alone or filled + n > BLOCK):
            block, filled = block + 1, 0
        out[i] = block
        filled = BLOCK if alone else filled + n
    return out


def cut(table: pa.Table, told: pa.Table, parts: int) -> Iterator[tuple]:
    """For each document of the batch the mask of its bytes that go."""
    t = texts_of_batch(table, parts)
    edge = np.zeros(len(t.data) + 1, np.int32)

    def mark(start: np.ndarray, n: np.ndarray) -> None:
        np.add.at(edge, start, 1)
        np.add.at(edge, start + n + LENGTH - 1, -1)

    answers = Answers(told)
    kind, low = answers.anchors(t.key, t.content)
    same = np.flatnonzero((kind == SAME) & (low < t.doc_id))
    mark(t.start[same], t.n[same])
    segments = np.flatnonzero(kind == MIXED)
    single, name, ids = dealt_windows(t, np.flatnonzero(kind == DEALT))
    content, start, ids = np.concatenate([t.content[segments], name]), np.concatenate([t.start[segments], single]), np.concatenate([t.doc_id[segments], ids])
    at = answers.look(answers.content, content)
    content, start, ids, at = content[at >= 0], start[at >= 0], ids[at >= 0], at[at >= 0]
    if len(at):
        runs = answers.runs[at]
        place = ragged(answers.first[at], runs)
        length, least = answers.lengths[place], answers.ids[place]
        before = np.cumsum(length) - length
        inside = before - np.repeat(before[np.cumsum(runs) - runs], runs)
        go = least < np.repeat(ids, runs)
        mark((np.repeat(start, runs) + inside)[go], length[go])
    gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
    for i, text in enumerate(t.texts):
        yield t.texts[i], gone[t.at[i] : t.at[i + 1]]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, n_bytes, n_removed, n_spans (maximal runs of removed bytes) and kept (the other bytes, binary).

    Windows are judged on the input, not on what is left, and never cross documents. Rows that share an id don't count as repeats of each other;
    a null id counts as smaller than all others; a null text counts as empty; an empty table gives no rows; other columns of ``df`` are not read.
    """
    batches = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 2 * batches
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    docs = docs.select(F.pmod(F.xxhash64("id", "text"), F.lit(batches)).cast("int").alias("batch"), "id", "text").mapInArrow(deal, "batch int, data binary")
    sent = "part int, batch int, data binary"
    side_names = docs.groupBy("batch").applyInArrow(lambda t: send_sides(t, parts), sent)
    sides = side_names.groupBy("part").applyInArrow(judge_sides, sent).withColumn("what", F.lit(SIDES))
    segments = docs.groupBy("batch").cogroup(sides.groupBy("batch")).applyInArrow(lambda a, b: send_segments(a, b, parts), sent)
    anchors = segments.groupBy("part").applyInArrow(judge_anchors, sent).withColumn("what", F.lit(ANCHORS))
    mixed_rows = docs.groupBy("batch").cogroup(sides.union(anchors).groupBy("batch")).applyInArrow(lambda a, b: send_mixed(a, b, parts), sent)
    refined = mixed_rows.groupBy("part").applyInArrow(refine, sent).withColumn("what", F.lit(CONTENTS))

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        kept, removed, spans = [], [], []
        for text, gone in cut(table, told, parts) if table.num_rows else ():
            n = int(gone.sum())
            removed.append(n)
            spans.append(int((gone & ~np.append(False, gone[:-1])).sum()) if n else 0)
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes() if n else text)
        n_bytes = [len(k) + r for k, r in zip(kept, removed, strict=True)]
        ids = opened(table).column("id") if table.num_rows else pa.array([], pa.int64())
        return pa.table({"id": ids, "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    out = docs.groupBy("batch").cogroup(anchors.union(refined).groupBy("batch")).applyInArrow(finish, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)


def digests(cut_rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return cut_rows.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, bytes]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The plain definition, for tests: the smallest id of every window, then each document's own windows."""
    least: dict[bytes, int] = {}
    for i, text in docs:
        for p in range(len(text) - length + 1):
            w = text[p : p + length]
            least[w] = min(least.get(w, i), i)
    out = {}
    for i, text in docs:
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - length + 1):
            if least[text[p : p + length]] < i:
                gone[p : p + length] = True
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        out[i] = (len(text), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(text) else 0, hashlib.sha256(kept).hexdigest())
    return out
