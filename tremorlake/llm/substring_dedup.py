"""Substring deduplication: passages of ``MIN_WORDS`` words or more that other documents also hold, found by compact windows.

A document is the sequence of its 5-word shingles; in a run of one shingle its n-th place counts apart from the
others, and equal minima are told apart by scattered places (so trees of repetitive texts are shallow). For each of ``HASHES`` hash functions a Cartesian tree
over the shingles' hashes groups all subsequences of at least 46 shingles (50 words) by the place of their
minimum: a compact window (l, c, r) stands for every subsequence that starts in l..c and ends in c..r, all
with the min-hash of place c. Blocks of documents send each distinct min-hash once, bucket by bucket, with its
first holder in the block; a hash held by several documents gets its first holder of all (the smallest
doc_id) and the holder's place back. So a passage that a third of all documents hold costs one request per block. Windows of a
document that point to one holder, at whatever offsets, are joined as intervals, and where at least
``MIN_HASHES`` hash functions agree, the union of their intervals is a candidate. A candidate's shingles
are compared with the holder's around those offsets, or with all of the holder's where it has a minimum at
several places: first at each offset, then, for windows that hold enough of the holder's shingles but agree at no one
offset, within ``DRIFT`` places around the offsets, as inserted and deleted words move them. The passage is every
stretch of 46 shingles that has a Jaccard similarity of 0.75 or more with 46 or more neighbouring ones of the holder,
trimmed to shingles that agree.

Each document is compared with first holders and, where it is another one, with the holder before it (of the values that
both hold, the largest smaller doc_id), so a passage that thousands share costs two comparisons
per document, and the first holder keeps its text. What both miss has an exact way (``rest``): blocks also ask how many documents
hold each shingle, and then, for windows of 46 that aren't in found passages and 40 of whose shingles others hold, whether
an earlier document does. A window that still has 40 asks for its rarest shingles, at most 7, of which every holder of 40 has one, or for those that
reach the words not found yet, where fewer documents hold them; earlier documents that offer one are compared with it: some first, then
all with what is still open. So no passage depends on min-hashes or on which document is the first holder. Words that a window holds before its first
agreeing shingle or behind its last one are not in its passage.

Defined edge cases: a null or empty text, one of fewer than 50 words and a row without doc_id have no
passage; rows that share a doc_id are one document and not compared with each other; passages repeated
inside one document only are left; repeated rows each get their spans; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import answered, assembled, bucket_count, bundle, from_planes, pack, planes, squeeze, stretch, unbundle, unpack
from .common import fresh, hashed_words, let_go, mix, release, stage, table, window_hashes

WIDTH = 5
MIN_WORDS = 50
HASHES, MIN_HASHES = 4, 2
LENGTH = MIN_WORDS - WIDTH + 1
#: More shingles than a document has.
WHOLE = 1 << 28
#: Places by which inserted and deleted words may move a shingle within a passage.
DRIFT = LENGTH // 2
#: Agreeing shingles of LENGTH aligned ones for a Jaccard similarity of 0.75: m / (2 LENGTH - m) >= 0.75.
AGREE = -(-2 * LENGTH * 75 // 175)
#: A holder's stretch is at most so long: beyond it, even LENGTH agreeing shingles are less than 75 % of the union.
REACH = 100 * LENGTH // 75
#: Of at most so many asked values all tasks get the list, and documents offer no others.
LISTED = 2_000_000
#: Shingles of stretches that ask together.
CHUNK = 1 << 20
#: Places of equal shingles, at most, that are counted to leave offsets out.
COUNTED = 1 << 20
#: Before all of them are compared, one in so many offering stretches is.
SOME = 8


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, one text after another, and how many each has."""
    words, counts = hashed_words(texts)
    lengths, ends = np.maximum(counts - WIDTH + 1, 0), np.cumsum(counts)
    # windows that reach into the next text go
    left = np.repeat(ends, counts) - np.arange(len(words))
    return window_hashes(words, WIDTH)[left[: max(0, len(words) - WIDTH + 1)] >= WIDTH], lengths


def ascending(key: np.ndarray, bits: int) -> np.ndarray:
    """The stable order of keys of so many bits; where there is room beside them for their places, by one plain sort, which is several times faster."""
    place = np.uint64(max(1, len(key).bit_length()))
    if bits + int(place) > 64:
        return np.argsort(key, kind="stable")
    both = np.sort(key << place | np.arange(len(key), dtype=np.uint64))
    return (both & (np.uint64(1) << place) - np.uint64(1)).astype(np.int64)


def compact_windows(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the compact windows of all sequences h[start:end], all trees grown level by level."""
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    # places scattered by a golden-ratio step, so that equal hashes of repetitive texts still make shallow trees
    step = int(2 ** int(bits) * 0.6180339887498949) | 1
    back = np.uint64(pow(step, -1, 2 ** int(bits)))
    place = np.arange(len(h), dtype=np.uint64) * np.uint64(step) & mask
    key = np.append((h >> bits << bits) | place, np.uint64(0xFFFFFFFFFFFFFFFF))
    keep = ends - starts >= least
    lo, hi = starts[keep], ends[keep]
    out = []
    while len(lo):
        c = (np.minimum.reduceat(key, np.column_stack([lo, hi]).ravel())[::2] & mask) * back & mask
        c = c.astype(np.int64)
        out.append((lo, c, hi - 1))
        lo, hi = np.column_stack([lo, c + 1]).ravel(), np.column_stack([c, hi]).ravel()
        keep = hi - lo >= least
        lo, hi = lo[keep], hi[keep]
    return tuple(np.concatenate([x[i] for x in out]) if out else np.empty(0, np.int64) for i in range(3))


def numbered(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, its place in a run of equal neighbours), so that further copies of a passage in a document have its hashes."""
    place = np.arange(len(h))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    rank = place - np.maximum.accumulate(np.where(new, place, 0))
    return mix(h + rank.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Windows:
    """The compact windows of a block's documents, and the requests for them in a fixed order."""

    def __init__(self, payload, buckets: int):
        self.ids, texts, self.marks = unpack(payload)
        self.flat, lengths = shingles(["" if i is None else t for i, t in zip(self.ids, texts)])
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        del texts
        self.sequences = [self.flat[a:b] for a, b in zip(self.starts, self.ends)]
        flat = numbered(self.flat, np.repeat(np.arange(len(lengths)), lengths))
        parts = []
        for k in range(HASHES):
            hk = mix(flat + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
            l, c, r = compact_windows(hk, self.starts, self.ends)
            parts.append((np.full(len(l), k), l, c, r, mix(hk[c] + np.uint64(k))))
        del flat, hk
        self.k, self.l, self.c, self.r, value = (np.concatenate([p[i] for p in parts]) for i in range(5))
        self.doc = np.searchsorted(self.ends, self.c, "right")
        numbers = np.array([0 if i is None else i for i in self.ids], np.int64)
        owner, place = numbers[self.doc], self.c - self.starts[self.doc]
        bucket = (value >> np.uint64(32)) % np.uint64(buckets)
        value = value & np.uint64(0xFFFFFFFFFFFF)
        order = np.lexsort((place, owner, value, bucket))
        b, v = bucket[order], value[order]
        new = np.ones(len(order), bool)
        new[1:] = (b[1:] != b[:-1]) | (v[1:] != v[:-1])
        #: the request that answers each window: a block asks once for a value, in the name of its first holder in the block
        self.request = np.empty(len(order), np.int64)
        self.request[order] = np.cumsum(new) - 1
        # the holder before each window's document in the block: the last place of the group before the document's own
        at, head = np.arange(len(order)), np.ones(len(order), bool)
        head[1:] = new[1:] | (owner[order][1:] != owner[order][:-1])
        mine, group = np.maximum.accumulate(np.where(head, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
        previous = order[np.maximum(mine - 1, 0)]
        local = mine > group
        self.before, self.before_place = np.full(len(order), -1), np.full(len(order), -1)
        self.before[order[local]], self.before_place[order[local]] = owner[previous[local]], place[previous[local]]
        #: documents of the block that others of it name as the holder before them
        self.named = np.unique(self.doc[previous[local]])
        first = order[new]
        edges = np.flatnonzero(np.diff(bucket[first].astype(np.int64), prepend=-1))
        names, asked = bucket[first][edges].astype(np.int64).tolist(), []
        if len(first):
            several = np.maximum.reduceat(owner[order], np.flatnonzero(new)) != owner[first]
            # the last bits of a place: whether the document has the value elsewhere, whether another document of the block has it
            follower = np.append(order[1:], order[-1])[new]
            again = ~np.append(new[1:], True)[new] & (owner[follower] == owner[first]) & (place[follower] != place[first])
            asked = list(zip(*(np.split(x, edges[1:]) for x in (value[first], owner[first], 4 * place[first] + 2 * again + several))))
        singles = self.singles(np.repeat(numbers, lengths), lengths, buckets)
        #: buckets, and the windows and shingles for each; either may be empty
        self.names = sorted({*names, *singles})
        empty = np.empty(0, np.uint64)
        asked = dict(zip(names, asked))
        self.asked = [(*asked.get(b, (empty,) * 3), *singles.get(b, (empty,) * 2)) for b in self.names]

    def singles(self, owner: np.ndarray, lengths: np.ndarray, buckets: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By bucket, the distinct shingles of documents that may hold a passage, as 32 bits, and how many documents of the block hold each."""
        #: the shingles that are asked for, and the request that answers each
        self.at = np.flatnonzero(np.repeat(lengths >= LENGTH, lengths))
        if not len(self.at):
            self.single = self.at
            return {}
        flat = self.flat[self.at]
        key = ((flat >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | flat & np.uint64(0xFFFFFFFF)
        del flat
        order = ascending(key, 32 + buckets.bit_length())
        key, owner = key[order], owner[self.at][order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        other = new.copy()
        other[1:] |= owner[1:] != owner[:-1]
        self.single = np.empty(len(key), np.int64)
        self.single[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        held, bucket = np.add.reduceat(other.astype(np.uint64), first), (key[first] >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        return dict(zip(bucket[edges].tolist(), zip(np.split(key[first] & np.uint64(0xFFFFFFFF), edges[1:]), np.split(held, edges[1:]))))

    def regions(self, answers: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
        """Document, first and last place of the stretches in which it may share a passage, and how many documents hold each shingle there (255: or more).

        They are the spans of REACH places that hold AGREE shingles that others hold too, and the places around them that a window can reach.
        """
        held = np.ones(len(self.flat), np.uint8)
        held[self.at] = answers[self.single]
        at = np.flatnonzero(held > 1)
        doc = np.searchsorted(self.ends, at, "right")
        last = np.searchsorted(at, np.minimum(at + REACH, self.ends[doc]), "left") - 1
        good = np.flatnonzero(last - np.arange(len(at)) + 1 >= AGREE)
        lo, hi = np.maximum(at[good] - LENGTH + AGREE, self.starts[doc[good]]), np.minimum(at[last[good]] + LENGTH - AGREE, self.ends[doc[good]] - 1)
        # documents follow each other without a gap, so stretches are joined within a document only
        new = np.ones(len(lo), bool)
        new[1:] = (lo[1:] > np.maximum.accumulate(hi)[:-1] + 1) | (doc[good][1:] != doc[good][:-1])
        first = np.flatnonzero(new)
        if not len(first):
            return []
        return [(d, a, b, held[a : b + 1]) for d, a, b in zip(doc[good][first].tolist(), lo[first].tolist(), np.maximum.reduceat(hi, first).tolist())]


def _pairs(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(planes(values.astype(np.int64)))


def _unpairs(data: bytes) -> np.ndarray:
    import zstandard

    return from_planes(zstandard.ZstdDecompressor().decompress(data), np.int64)


def candidates(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of three kinds: candidates (``holder, low, high, shifts, start, shingles`` of a document; places low..high of the holder), holders (``holder`` and ``low`` null, all shingles) and stretches in which a document may share a passage with any other (``low`` WHOLE; how many documents hold each shingle in ``shifts``)."""
    blocks = pack(docs.withColumn("mark", F.xxhash64("text")), "mark").repartition("block")

    def ask(batches):
        import pyarrow as pa

        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = Windows(payload.as_buffer(), buckets)
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(w.names, pa.int32()),
                    "block": pa.array([number] * len(w.names), pa.int64()),
                    "hashes": pa.array([squeeze(x[0]) for x in w.asked], pa.binary()),
                    "docs": pa.array([_pairs(x[1]) for x in w.asked], pa.binary()),
                    "places": pa.array([_pairs(x[2]) for x in w.asked], pa.binary()),
                    "singles": pa.array([bundle(np.diff(x[3], prepend=np.uint64(0)).astype(np.uint32), x[4].astype(np.min_scalar_type(x[4].max(initial=0)))) for x in w.asked], pa.binary()),
                })
                del w
                release()

    def answer(requests):
        import pyarrow as pa

        hashes = [stretch(x) for x in requests.column("hashes").to_pylist()]
        ends = np.cumsum([len(x) for x in hashes])[:-1]
        value = np.concatenate(hashes)
        doc, place = (np.concatenate([_unpairs(x) for x in requests.column(c).to_pylist()]) for c in ("docs", "places"))
        order = np.lexsort((place, doc, value))
        v, d = value[order], doc[order]
        head = np.ones(len(v), bool)
        head[1:] = v[1:] != v[:-1]
        at = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        several = (np.maximum.reduceat(d, at) != d[at]) | (np.maximum.reduceat(place[order] & 1, at) > 0)
        # the holder before each request's, and whether there is one behind it
        mine, start = (np.maximum.accumulate(np.where(x, np.arange(len(v)), 0)) for x in (np.append(True, head[1:] | (d[1:] != d[:-1])), head))
        local, earlier = mine > start, np.maximum(mine - 1, 0)
        before, before_place, named = np.full(len(v), -1), np.full(len(v), -1), np.zeros(len(v), np.int64)
        before[order], before_place[order] = np.where(local, d[earlier], -1), np.where(local, place[order][earlier] >> 2, -1)
        named[order] = np.append(d, 0)[np.append(at[1:], len(v))[group] - 1] > d
        holder, where = np.full(len(v), -1), np.zeros(len(v), np.int64)
        # 0: nobody else; otherwise 1 + twice the holder's place + whether it has more of them, beside its id
        holder[order] = np.where(several[group], d[at][group], 0)
        where[order] = np.where(several[group], (place[order][at][group] >> 1) + 1, 0)
        out = {"block": requests.column("block"), "bucket": requests.column("bucket"), "holders": pa.array([_pairs(x) for x in np.split(holder, ends)], pa.binary()), "wheres": pa.array([_pairs(x) for x in np.split(where, ends)], pa.binary()), "others": pa.array([_pairs(np.concatenate(x)) for x in zip(*(np.split(y, ends) for y in (before, before_place, named)))], pa.binary())}
        del hashes, value, doc, place, order, v, d, head, group, mine, start, before, before_place, named, holder, where
        out["counts"] = pa.array(documents(requests.column("singles").to_pylist()), pa.binary())
        release()
        return pa.table(out)

    def assemble(packed, answers):
        import pyarrow as pa

        rows = []
        replies = {b: x for b, *x in zip(*(answers.column(c).to_pylist() for c in ("bucket", "holders", "wheres", "others", "counts")))}
        for payload in packed.column("payload"):
            w = Windows(payload.as_buffer(), buckets)
            if not w.names:
                continue
            holder, where = (np.concatenate([_unpairs(replies[b][i]) for b in w.names])[w.request] for i in (0, 1))
            numbers = np.array([0 if i is None else i for i in w.ids], np.int64)
            before, before_place, named = (np.concatenate(x)[w.request] for x in zip(*(_unpairs(replies[b][2]).reshape(3, -1) for b in w.names)))
            # the holder before a window's document, in the block or else before the block's first holder
            local = w.before_place >= 0
            before, before_place = np.where(local, w.before, before), np.where(local, w.before_place, before_place)
            own = (where > 0) & (holder == numbers[w.doc])
            holds = np.union1d(np.union1d(w.doc[own], w.named), w.doc[(named > 0) & ~local])
            for d in holds.tolist():
                rows.append((w.ids[d], w.marks[d], None, None, None, None, None, w.sequences[d].astype(np.uint32).tobytes(), None))
            for d, a, b, held in w.regions(np.concatenate([unbundle(replies[b][3])[0] for b in w.names])):
                rows.append((w.ids[d], w.marks[d], None, WHOLE, None, held.tobytes(), a - int(w.starts[d]), w.flat[a : b + 1].astype(np.uint32).tobytes(), None))
            # windows that the first holder holds, and those that the holder before holds, where that is another one
            hit = np.flatnonzero((where > 0) & ~own)
            other = np.flatnonzero((before_place >= 0) & (before != holder) & (before != numbers[w.doc]) & (where > 0))
            there, again = np.append(where[hit] - 1 >> 1, before_place[other]), np.append(where[hit] - 1 & 1, np.zeros(len(other), np.int64))
            second = np.arange(len(hit) + len(other)) >= len(hit)
            hit, theirs = np.append(hit, other), np.append(holder[hit], before[other])
            order = np.lexsort((w.l[hit], theirs, w.doc[hit]))
            hit, theirs, there, again, second = hit[order], theirs[order], there[order], again[order], second[order]
            base = w.starts[w.doc[hit]]
            shift = w.c[hit] - base - there
            new = np.ones(len(hit), bool)
            new[1:] = (w.doc[hit[1:]] != w.doc[hit[:-1]]) | (theirs[1:] != theirs[:-1])
            for group in np.split(np.arange(len(hit)), np.flatnonzero(new)[1:]) if len(hit) else []:
                i = hit[group]
                for l, r in agreed(w.k[i], w.l[i], w.r[i] + 1):
                    d, at = int(w.doc[i[0]]), int(base[group[0]])
                    inside = (w.l[i] >= l) & (w.r[i] < r)
                    moved = shift[group][inside]
                    low, high = (w.l[i][inside] - at - moved).min() - LENGTH, (w.r[i][inside] + 1 - at - moved).max() + LENGTH
                    if again[group][inside].any():
                        low, high = 0, WHOLE
                    moved, often = np.unique(moved, return_counts=True)
                    moved = moved[np.argsort(-often, kind="stable")].astype(np.int32)
                    rows.append((w.ids[d], w.marks[d], int(theirs[group[0]]), max(0, int(low)), int(high), moved.tobytes(), l - at, w.sequences[d][l - at : r - at].astype(np.uint32).tobytes(), bool(second[group][inside].any())))
            del w
        release()
        names, kinds = ("doc_id", "mark", "holder", "low", "high", "shifts", "start", "shingles", "second"), (*[pa.int64()] * 5, pa.binary(), pa.int64(), pa.binary(), pa.bool_())
        return pa.table({n: pa.array(c, t) for n, t, c in zip(names, kinds, zip(*rows) if rows else [[]] * 9)})

    answers = blocks.mapInArrow(ask, "bucket int, block bigint, hashes binary, docs binary, places binary, singles binary").groupBy("bucket").applyInArrow(answer, "block bigint, bucket int, holders binary, wheres binary, others binary, counts binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assemble, "doc_id bigint, mark bigint, holder bigint, low bigint, high bigint, shifts binary, start bigint, shingles binary, second boolean")


def documents(requests: list[bytes]) -> list[bytes]:
    """For each request (ascending distinct shingles, as differences, and how many documents of the block hold each) how many of all hold them (255: or more)."""
    read = [unbundle(x) for x in requests]
    value = np.concatenate([np.cumsum(x, dtype=np.uint64) for x, _ in read])
    order = ascending(value, 32)
    value = value[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    held = np.empty(len(value), np.uint8)
    if len(value):
        total = np.add.reduceat(np.concatenate([x.astype(np.uint64) for _, x in read])[order], np.flatnonzero(new))
        held[order] = np.minimum(total, 255).astype(np.uint8)[np.cumsum(new) - 1]
    return [bundle(x) for x in np.split(held, np.cumsum([len(x) for x, _ in read])[:-1])]


def agreed(k: np.ndarray, l: np.ndarray, r: np.ndarray) -> list[tuple[int, int]]:
    """Unions of overlapping intervals [l, r) that hold windows of at least MIN_HASHES hash functions."""
    order = np.argsort(l, kind="stable")
    out, seen, lo, hi = [], set(), 0, -1
    for a, b, x in zip(l[order].tolist(), r[order].tolist(), k[order].tolist()):
        if a >= hi:
            if len(seen) >= MIN_HASHES:
                out.append((lo, hi))
            seen, lo, hi = set(), a, b
        seen.add(x)
        hi = max(hi, b)
    if len(seen) >= MIN_HASHES:
        out.append((lo, hi))
    return out


def passages(good: np.ndarray, equal: np.ndarray) -> list[tuple[int, int, float]]:
    """[first, last] shingle and share of agreement of the stretches whose windows of LENGTH are good, trimmed to shingles that agree."""
    cover = np.zeros(len(equal) + 1, np.int64)
    cover[np.flatnonzero(good)] += 1
    cover[np.flatnonzero(good) + LENGTH] -= 1
    inside = np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(inside))
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        on = np.flatnonzero(equal[a:b])
        out.append((a + int(on[0]), a + int(on[-1]), float(equal[a + on[0] : a + on[-1] + 1].mean())))
    return out


def verbatim_runs(to: np.ndarray, first: int, last: int) -> np.ndarray:
    """[first, last] shingle of each run of LENGTH or more in first..last whose places in the holder (-1: none) follow each other."""
    t = to[first : last + 1]
    cut = np.flatnonzero((np.diff(t) != 1) | (t[1:] < 0) | (t[:-1] < 0)) + 1
    a, b = np.append(0, cut), np.append(cut, len(t)) - 1
    keep = b - a + 1 >= LENGTH
    return first + np.column_stack([a[keep], b[keep]]).ravel()


def in_windows(equal: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(equal)])
    return total[LENGTH:] - total[:-LENGTH]


def matchable(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each window of a, how many of its shingles can have a match of their own in b: no shingle more often than b holds it."""
    known, often = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(known, a), len(known) - 1)
    count = np.where(known[at] == a, often[at], 0)
    order = np.argsort(a, kind="stable")
    before = np.arange(len(a)) - count[order]
    behind = order[np.maximum(before, 0)]
    # the occurrence that has to be left of the window
    gone = np.empty(len(a), np.int64)
    gone[order] = np.where((before >= 0) & (a[behind] == a[order]), behind, -1)
    i = np.arange(len(a))
    lo, hi = np.maximum(gone + 1, np.maximum(i - LENGTH + 1, 0)), np.minimum(i, len(a) - LENGTH)
    ok = (count > 0) & (lo <= hi)
    n = len(a) - LENGTH + 2
    return np.cumsum(np.bincount(lo[ok], minlength=n) - np.bincount(hi[ok] + 1, minlength=n))[:-1]


class Places:
    """Where the holder's shingles stand, for searches in a band around an offset."""

    def __init__(self, b: np.ndarray):
        self.keys = np.sort(b.astype(np.uint64) << np.uint64(32) | np.arange(len(b), dtype=np.uint64))

    def near(self, a: np.ndarray, at: np.ndarray, offset: int) -> np.ndarray:
        """For each place ``at`` of a, the first place of its shingle within DRIFT of place + offset in the holder, or -1."""
        value = a[at].astype(np.uint64) << np.uint64(32)
        found = np.minimum(np.searchsorted(self.keys, value | np.maximum(at + offset - DRIFT, 0).astype(np.uint64)), len(self.keys) - 1)
        key = self.keys[found]
        place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return np.where((key >> np.uint64(32) == value >> np.uint64(32)) & (abs(place - at - offset) <= DRIFT), place, -1)

    def possible(self, a: np.ndarray, at: np.ndarray, offsets: range):
        """The offsets within DRIFT of which AGREE shingles of a at these places may stand in the holder (all offsets where equal shingles have too many places to count)."""
        value = a[at].astype(np.uint64) << np.uint64(32)
        lo, hi = np.searchsorted(self.keys, value), np.searchsorted(self.keys, value | np.uint64(0xFFFFFFFF), "right")
        n = hi - lo
        if n.sum() > COUNTED:
            return offsets
        i = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        moved = np.sort((self.keys[i] & np.uint64(0xFFFFFFFF)).astype(np.int64) - np.repeat(at, n))
        o = np.arange(offsets.start, offsets.stop, offsets.step)
        return o[np.searchsorted(moved, o + DRIFT, "right") - np.searchsorted(moved, o - DRIFT) >= AGREE].tolist()

    def voted(self, a: np.ndarray, at: np.ndarray) -> list[int]:
        """Offsets DRIFT apart around which shingles of a at these places stand in the holder (their first or last place there), most first."""
        value = a[at].astype(np.uint64) << np.uint64(32)
        found = np.minimum(np.searchsorted(self.keys, value), len(self.keys) - 1)
        last = np.maximum(np.searchsorted(self.keys, value | np.uint64(0xFFFFFFFF), "right") - 1, 0)
        offsets = []
        for x in (found, last):
            key = self.keys[x]
            known = key >> np.uint64(32) == value >> np.uint64(32)
            offsets.append((key[known] & np.uint64(0xFFFFFFFF)).astype(np.int64) - at[known])
        step, n = np.unique(np.concatenate(offsets) // DRIFT, return_counts=True)
        # a passage's offsets lie in two neighbouring steps at most
        both = n + np.where(np.append(step[1:], -WHOLE) == step + 1, np.append(n[1:], 0), 0) if len(n) else n
        keep = np.flatnonzero(both >= AGREE)
        return ((step[keep] + 1) * DRIFT)[np.argsort(-both[keep], kind="stable")].tolist()


def bands(offsets: list[int]) -> list[int]:
    """Fewer offsets, so that each given one has one of them within half of DRIFT."""
    out: list[int] = []
    for o in sorted(offsets):
        if not out or o > out[-1] + DRIFT // 2:
            out.append(o + DRIFT // 2)
    return out


def covered(windows: np.ndarray, n: int) -> np.ndarray:
    """The places of windows of LENGTH that start where ``windows`` is set."""
    cover = np.zeros(n + 1, np.int64)
    cover[np.flatnonzero(windows)] += 1
    cover[np.flatnonzero(windows) + LENGTH] -= 1
    return np.flatnonzero(np.cumsum(cover[:-1]) > 0)


def later(make):
    """What ``make()`` returns, asked for when it is needed."""
    yield from make()


def shared(a: np.ndarray, b: np.ndarray, offsets: list[int], everywhere: bool = False, only: np.ndarray | None = None) -> list[tuple[int, int, int, float, np.ndarray]]:
    """First and last shingle of a, the first one's place in b, the share of agreement and the verbatim runs, for each passage of a that b holds.

    Shingles are compared at the given offsets first, then within DRIFT places around them (or around every
    offset), so that words may be inserted and deleted, and at last around offsets that many shingles of what is left share.
    With ``only``, no more than these windows are looked for around offsets.
    """
    if len(a) < LENGTH or len(b) < LENGTH:
        return []
    out = []
    matching = lambda: (matchable(a, b) >= AGREE) & (True if only is None else only)
    rest = None  # not counted before an offset leaves windows open: one that agrees at an offset can be matched
    for offset in offsets:
        lo, hi = max(0, -offset), min(len(a), len(b) - offset)
        if hi - lo < LENGTH:
            continue
        if rest is not None and not rest.any():
            return out
        same = a[lo:hi] == b[lo + offset : hi + offset]
        if rest is None and hi - lo == len(a) and same.all():
            return [(0, len(a) - 1, offset, 1.0, np.array([0, len(a) - 1]))]
        equal = np.zeros(len(a), bool)
        equal[lo:hi] = same
        good = in_windows(equal) >= AGREE
        if good.any():
            to = np.where(equal, np.arange(len(a)) + offset, -1)
            out += [(first, last, first + offset, share, verbatim_runs(to, first, last)) for first, last, share in passages(good, equal)]
            if rest is None and good.all():
                return out
        rest = (matching() if rest is None else rest) & ~good
    if rest is None:
        rest = matching()
    if not rest.any():
        return out
    places = Places(b)
    view = np.lib.stride_tricks.sliding_window_view
    tried = places.possible(a, covered(rest, len(a)), range(-len(a) + LENGTH, len(b) - LENGTH + DRIFT, DRIFT)) if everywhere else bands(offsets)
    for offset in chain(tried, () if everywhere else later(lambda: places.voted(a, covered(rest, len(a))))):
        on = covered(rest, len(a))
        on = on[(on + offset >= -DRIFT) & (on + offset < len(b) + DRIFT)]
        j = places.near(a, on, offset) if len(on) else on
        i, j = on[j >= 0], j[j >= 0]
        if len(i) < AGREE:
            continue
        equal = np.zeros(len(a), bool)
        equal[i] = True
        m = in_windows(equal)
        if m.max() < AGREE:
            continue
        first, last = np.full(len(a), WHOLE), np.full(len(a), -1)
        first[i], last[i] = j, j
        span = view(last, LENGTH).max(1) - view(first, LENGTH).min(1) + 1
        # Jaccard similarity with the neighbouring shingles of the holder that hold all matches, LENGTH at least
        good = rest & (m > 0) & (100 * m >= 75 * (LENGTH + np.maximum(LENGTH, span) - m))
        if good.any():
            out += [(x, y, int(first[x]), share, verbatim_runs(last, x, y)) for x, y, share in passages(good, equal)]
            rest &= ~good
            if not rest.any():
                break
    return out


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, first_word, last_word, holder, holder_first_word, agreement``: the passages that a document shares with an earlier one.

    ``mark`` is xxhash64 of the text; several holders can claim overlapping passages of a document.
    """
    buckets = bucket_count(docs)
    rows = stage(candidates(docs, buckets), "candidates")
    let_go(docs.sparkSession)
    holders = rows.where("holder is null and low is null").select(F.col("doc_id").alias("holder"), "mark", F.col("shingles").alias("whole"))
    if holders.groupBy("holder").count().where("count > 1").limit(1).count():  # rows that share a doc_id
        holders = stage(holders.groupBy("holder").agg(F.min_by("whole", "mark").alias("whole")), "holders")
    else:
        holders = holders.drop("mark")
    # either way the join below is a plain one, whose hot holders Spark can split
    # four bytes a shingle: only the stretch of the holder around the offsets goes on
    stretch = F.substring("whole", (4 * F.col("low") + 1).cast("int"), (4 * (F.col("high") - F.col("low"))).cast("int"))
    joined = rows.where("holder is not null").join(holders, "holder").select("doc_id", "mark", "holder", "low", "shifts", "start", "shingles", stretch.alias("theirs"), (F.col("high") == WHOLE).alias("everywhere"), "second")

    def verify(batches):
        import pyarrow as pa

        names = ("doc_id", "mark", "first_word", "last_word", "holder", "holder_first_word", "agreement", "runs", "second")
        kinds = [pa.int64()] * 6 + [pa.float64(), pa.binary(), pa.bool_()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for doc_id, mark, holder, low, shifts, start, mine, theirs, everywhere, second in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    a, b = np.frombuffer(mine, np.uint32), np.frombuffer(theirs, np.uint32)
                    for first, last, there, share, runs in shared(a, b, (start - low - np.frombuffer(shifts, np.int32)).tolist(), everywhere):
                        out.append((doc_id, mark, start + first, start + last + WIDTH - 1, holder, low + there, share, (start + runs).astype(np.int32).tobytes(), second))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, kinds)], names=list(names))
        release()

    found = stage(joined.mapInArrow(verify, "doc_id bigint, mark bigint, first_word bigint, last_word bigint, holder bigint, holder_first_word bigint, agreement double, runs binary, second boolean").distinct(), "found")
    del joined
    let_go(docs.sparkSession)
    return without_second(found).drop("runs").unionByName(rest(rows, found, buckets))


def without_second(found: DataFrame) -> DataFrame:
    """The passages without those of holders before that lie in a passage of the first holder."""
    spans = found.where("not second").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first_word", "last_word")).alias("spans"))
    inside = F.exists("spans", lambda s: (s["first_word"] <= F.col("first_word")) & (s["last_word"] >= F.col("last_word")))
    second = found.where("second").join(spans, ["doc_id", "mark"], "left").where(~F.coalesce(inside, F.lit(False))).drop("spans")
    return found.where("not second").unionByName(second).drop("second")


def joined_runs(marked: np.ndarray) -> list[tuple[int, int]]:
    """[first, end) of the runs of places that are marked."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def marked(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the intervals [lo, hi)."""
    return np.cumsum(np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1))[:n] > 0


def offered(at: np.ndarray, n: int, runs: list[tuple[int, int]]) -> np.ndarray:
    """Which of n places lie in a span of REACH places with AGREE of the shared ones (``at``), from one shared place to another, that isn't in a verbatim run [a, b]: an earlier document holds that."""
    reach = np.full(n, -1)
    for a, b in runs:
        reach[max(a, 0) : max(b + 1, 0)] = np.maximum(reach[max(a, 0) : max(b + 1, 0)], b)
    last = np.searchsorted(at, at + REACH, "left") - 1
    good = (last - np.arange(len(at)) + 1 >= AGREE) & (at[last] > reach[at])
    return marked(at[good], at[last[good]] + 1, n)


def open_windows(shared: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Starts of the windows of LENGTH with AGREE shared shingles whose words, from the first shared shingle to the last, aren't all in found passages."""
    total = np.append(0, np.cumsum(shared))
    i = np.arange(len(shared))
    behind = np.minimum.accumulate(np.where(shared, i, len(i))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(shared, i, -1))
    p = np.flatnonzero(total[LENGTH:] - total[:-LENGTH] >= AGREE)
    left = np.append(0, np.cumsum(~found))
    return p[left[before[p + LENGTH - 1] + WIDTH] > left[behind[p]]]


def rarest(p: np.ndarray, held: np.ndarray, order: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The places of shared shingles of each open window of which any holder that adds to found passages holds one.

    They are its rarest ones, one more than a holder of AGREE shingles can do without, or, where fewer documents hold them, all that
    reach its first word outside found passages or lie behind it, or all that reach its last one or lie before it: the stretch that a holder agrees with ends there.
    """
    view = np.lib.stride_tricks.sliding_window_view(order, LENGTH)
    shared, n = held > 1, len(held)
    total, often = np.append(0, np.cumsum(shared)), np.append(0, np.cumsum(np.where(shared, held, 0), dtype=np.int64))
    place, words = np.arange(n), np.arange(len(known))
    behind = np.minimum.accumulate(np.where(shared, place, n)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(shared, place, -1))
    following = np.minimum.accumulate(np.where(known, len(known), words)[::-1])[::-1]
    last = np.maximum.accumulate(np.where(known, -1, words))
    k, rare, ranges = LENGTH - AGREE + 1, np.zeros(n + 1, bool), np.zeros(n + 1, np.int64)
    for i in range(0, len(p), 4096):
        at = p[i : i + 4096]
        end = at + LENGTH
        few = np.argpartition(view[at], k - 1, axis=1)[:, :k]
        few = np.take_along_axis(few, np.argsort(np.take_along_axis(view[at], few, axis=1), axis=1), axis=1) + at[:, None]
        few[np.arange(k) >= (total[end] - total[at] - AGREE + 1)[:, None]] = n
        right, left = np.maximum(at, following[behind[at]] - WIDTH + 1), np.minimum(end, last[before[end - 1] + WIDTH - 1] + 1)
        cost = np.stack([np.append(held, 0)[few].sum(1, dtype=np.int64), often[end] - often[right], often[left] - often[at]])
        best = cost.argmin(0)
        rare[few[best == 0].ravel()] = True
        for which, lo, hi in ((1, right, end), (2, at, left)):
            np.add.at(ranges, lo[best == which], 1)
            np.add.at(ranges, hi[best == which], -1)
    return np.flatnonzero((rare | (np.cumsum(ranges) > 0))[:n] & shared)


def asking(doc_id: int, mark: int, start: int, held: np.ndarray, value: np.ndarray, known: np.ndarray):
    """Rows of the stretches with open windows: their place, shingles, asked shingles, how many documents hold each shingle, and their words in found passages."""
    shared, n = held > 1, len(held)
    p = open_windows(shared, known)
    order = np.where(shared, held.astype(np.int64), 256) << 32 | value
    for a, b in joined_runs(marked(p, p + LENGTH, n)):
        inside = p[(p >= a) & (p < b)]
        yield doc_id, mark, start + a, value[a:b].astype(np.uint32).tobytes(), signed(np.unique(value[rarest(inside, held, order, known)])), held[a:b].tobytes(), known[a : b + WIDTH - 1].tobytes()


def signed(values: np.ndarray) -> np.ndarray:
    """32-bit hashes as Spark's integers."""
    return values.astype(np.uint32).view(np.int32)


def by_bucket(values: np.ndarray, buckets: int) -> tuple[list[int], list[np.ndarray]]:
    """The places of distinct ascending values by bucket."""
    bucket = (mix(values.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return bucket[order][edges].tolist(), np.split(order, edges[1:]) if len(edges) else []


def table_bytes(columns: dict) -> bytes:
    import pyarrow as pa

    sink, whole = pa.BufferOutputStream(), pa.table(columns)
    with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as stream:
        stream.write_table(whole)
    return sink.getvalue().to_pybytes()


LEFT = "doc_id bigint, mark bigint, start bigint, shingles binary, asks array<int>, held binary, known binary"


def left_rows(out: list[tuple]):
    import pyarrow as pa

    kinds = (*[pa.int64()] * 3, pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary())
    return pa.table({n: pa.array(c, t) for n, t, c in zip(("doc_id", "mark", "start", "shingles", "asks", "held", "known"), kinds, zip(*out) if out else [[]] * 7)})


def open_stretches(parts: DataFrame, buckets: int) -> DataFrame:
    """The stretches with open windows, and what they ask for: a shingle counts as shared where an earlier document offers it.

    Each chunk of rows asks once for each shingle, in the name of the first document of the chunk that has it, whether an earlier
    one offers it. So documents that hold a passage first, as most do, ask for nothing.
    """

    def request(columns: list[list]):
        import pyarrow as pa
        import xxhash

        kept, values, docs, mine = {n: [] for n in ("doc_id", "mark", "start", "shingles", "held", "known")}, [], [], []
        for doc_id, mark, start, shingles, held, known, offers in zip(*columns):
            value, held, known = np.frombuffer(shingles, np.uint32), np.frombuffer(held, np.uint8), np.frombuffer(known, bool)
            shared = held > 1
            p = open_windows(shared, known)
            asks = marked(p, p + LENGTH, len(held))
            use = shared & (np.frombuffer(offers, bool) | asks)
            values.append(value[use])
            docs.append(np.full(int(use.sum()), doc_id, np.int64))
            mine.append(asks[use])
            for a, b in joined_runs(asks):
                for n, x in zip(kept, (doc_id, mark, start + a, value[a:b], held[a:b].copy(), known[a : b + WIDTH - 1].tobytes())):
                    kept[n].append(x)
        value, doc, mine = (np.concatenate(x) for x in (values, docs, mine))
        order = np.lexsort((doc, value))
        value, doc, mine = value[order], doc[order], mine[order]
        at = np.flatnonzero(np.append(True, value[1:] != value[:-1])[: len(value)])
        if not len(at):
            return None
        distinct, first, asked = value[at], doc[at], np.logical_or.reduceat(mine, at)
        # what an earlier document of the chunk offers is known here
        local = [first[np.minimum(np.searchsorted(distinct, v), len(distinct) - 1)] < d for d, v in zip(kept["doc_id"], kept["shingles"])]
        kept["local"] = [x.tobytes() for x in local]
        kept["shingles"], kept["held"] = [x.tobytes() for x in kept["shingles"]], [x.tobytes() for x in kept["held"]]
        data = table_bytes(kept)
        number = -(xxhash.xxh64_intdigest(data + distinct.tobytes() + first.tobytes()) >> 1) - 1
        keys, cells = [number], [data]
        for b, i in zip(*by_bucket(distinct, buckets)):
            yes, no = i[asked[i]], i[~asked[i]]
            keys.append(b)
            cells.append(bundle(*(np.diff(distinct[x], prepend=np.uint32(0)).astype(np.uint32) if k == 0 else first[x] for x in (yes, no) for k in (0, 1))))
        return pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "block": pa.array([number] * len(keys), pa.int64()), "data": pa.array(cells, pa.binary())})

    def cut(batches):
        held, n = None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = [c.to_pylist() for c in batch.slice(at, 64).columns]
                held = part if held is None else [x + y for x, y in zip(held, part)]
                n += sum(map(len, part[4]))
                if n >= CHUNK:
                    if (out := request(held)) is not None:
                        yield out
                    held, n = None, 0
        if held and (out := request(held)) is not None:
            yield out
        release()

    def answer(requests: list[bytes]) -> list[bytes]:
        read = [unbundle(x) for x in requests]
        read = [(np.cumsum(a, dtype=np.uint32), b, np.cumsum(c, dtype=np.uint32), d) for a, b, c, d in read]
        value, doc = (np.concatenate([y for x in read for y in (x[i], x[i + 2])]) for i in (0, 1))
        order = np.lexsort((doc, value))
        value, doc = value[order], doc[order]
        at = np.flatnonzero(np.append(True, value[1:] != value[:-1])[: len(value)])
        distinct, first = value[at], doc[at]
        return [np.packbits(first[np.searchsorted(distinct, v)] < d).tobytes() for v, d, _, _ in read]

    def assemble(data: bytes, found: dict[int, bytes]):
        import pyarrow as pa

        rows, out = pa.ipc.open_stream(data).read_all().to_pylist(), []
        for r in rows:
            for n, kind in (("shingles", np.uint32), ("held", np.uint8), ("known", bool), ("local", bool)):
                r[n] = np.frombuffer(r[n], kind)
        distinct = np.unique(np.concatenate([np.empty(0, np.uint32), *(r["shingles"][r["held"] > 1] for r in rows)]))
        earlier = np.zeros(len(distinct), bool)
        for b, i in zip(*by_bucket(distinct, buckets)):
            earlier[i] = np.unpackbits(np.frombuffer(found[b], np.uint8), count=len(i))
        for r in rows:
            shared = r["held"] > 1
            shared[shared] = r["local"][shared] | earlier[np.searchsorted(distinct, r["shingles"][shared])]
            out += asking(r["doc_id"], r["mark"], r["start"], np.where(shared, r["held"], 1).astype(np.uint8), r["shingles"].astype(np.int64), r["known"])
        return left_rows(out)

    cells = parts.mapInArrow(cut, "key bigint, block bigint, data binary").repartition("key")
    return assembled(cells, answered(cells, answer), assemble, LEFT)


def rest(rows: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """The passages that neither the first holder of their min-hashes nor the holder before holds, edited or verbatim, whatever their min-hashes.

    A window that isn't in found passages and AGREE of whose shingles earlier documents offer asks for its rarest ones, and
    earlier documents that offer one of them are compared: the first for each shingle, then one in SOME, then all. What is found
    asks no more, so many near copies of one text are not compared with each other; told is what a holder adds to found passages. A
    stretch that is known to stand verbatim in an earlier document needn't be offered: the first document that holds it offers it.
    """
    spans = found.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first_word", "last_word", "runs")).alias("spans"))
    regions = rows.where(F.col("low") == WHOLE).select("doc_id", "mark", "start", F.col("shifts").alias("held"), "shingles").join(spans, ["doc_id", "mark"], "left").dropDuplicates(["doc_id", "mark", "start"])

    def part(batches):
        import pyarrow as pa

        kinds = pa.schema([*((n, pa.int64()) for n in ("doc_id", "mark", "start")), *((n, pa.binary()) for n in ("shingles", "held", "known", "offers"))])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for doc_id, mark, start, held, shingles, spans in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    shared = np.frombuffer(held, np.uint8) > 1
                    n, known, runs = len(shared), np.zeros(len(shared) + WIDTH - 1, bool), []
                    for s in spans or []:
                        known[max(s["first_word"] - start, 0) : max(s["last_word"] + 1 - start, 0)] = True
                        runs += (np.frombuffer(s["runs"], np.int32).reshape(-1, 2) - start).tolist()
                    offers = offered(np.flatnonzero(shared), n, runs)
                    if offers.any() or len(open_windows(shared, known)):
                        out.append((doc_id, mark, start, shingles, held, known.tobytes(), offers.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 7, kinds)], schema=kinds)
        release()

    def again(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for doc_id, mark, start, held, shingles, known, spans in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    known = np.frombuffer(known, bool).copy()
                    for s in spans or []:
                        known[max(s["first_word"] - start, 0) : max(s["last_word"] + 1 - start, 0)] = True
                    out += asking(doc_id, mark, start, np.frombuffer(held, np.uint8), np.frombuffer(shingles, np.uint32).astype(np.int64), known)
                yield from left_rows(out).to_batches()
        release()

    def verify(batches):
        import pyarrow as pa

        names = ("doc_id", "mark", "first_word", "last_word", "holder", "holder_first_word", "agreement")
        kinds = [pa.int64()] * 6 + [pa.float64()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for doc_id, mark, start, holder, there, mine, held, known, theirs in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    only = np.zeros(max(0, len(held) - LENGTH + 1), bool)
                    only[open_windows(np.frombuffer(held, np.uint8) > 1, np.frombuffer(known, bool))] = True
                    for first, last, where, share, _ in shared(np.frombuffer(mine, np.uint32), np.frombuffer(theirs, np.uint32), [], True, only):
                        out.append((doc_id, mark, start + first, start + last + WIDTH - 1, holder, there + where, share))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], names=list(names))
        release()

    parts = stage(regions.mapInArrow(part, "doc_id bigint, mark bigint, start bigint, shingles binary, held binary, known binary, offers binary"), "parts")

    def offer(batches, listed):
        import pyarrow as pa

        pad, kinds = LENGTH - AGREE, (*[pa.int64()] * 3, pa.binary(), pa.list_(pa.int32()))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for doc_id, mark, start, shingles, held, _, offers in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    value, use = np.frombuffer(shingles, np.uint32), np.frombuffer(offers, bool)
                    for a, b in joined_runs(use):
                        v = signed(np.unique(value[a:b][np.frombuffer(held, np.uint8)[a:b] > 1]))
                        if listed is not None:
                            v = v[listed.value[np.minimum(np.searchsorted(listed.value, v), len(listed.value) - 1)] == v]
                        if len(v):
                            lo, hi = max(0, a - pad), min(len(value), b + pad)
                            out.append((doc_id, mark, start + lo, value[lo:hi].tobytes(), v))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names=["holder", "holder_mark", "there", "shingles", "offers"])
        release()

    key, theirs = ["doc_id", "mark", "start"], ["holder", "holder_mark", "there"]
    left = stage(open_stretches(parts, buckets), "left")
    let_go(parts.sparkSession)
    turn = F.pmod(F.xxhash64("holder", "there"), F.lit(SOME))
    out = []
    for few in (lambda x: x.groupBy("value").agg(F.min(F.struct(*theirs)).alias("f")).select("value", "f.*"), lambda x: x.where(turn == 0), lambda x: x.where(turn != 0)):
        asks = left.select(*key, F.explode("asks").alias("value"))
        values = stage(asks.select("value").distinct(), "values")
        n = values.count()
        if not n:
            break
        listed = parts.sparkSession.sparkContext.broadcast(np.sort(values.toArrow().column(0).to_numpy())) if n <= LISTED else None
        offering = stage(parts.mapInArrow(partial(offer, listed=listed), "holder bigint, holder_mark bigint, there bigint, shingles binary, offers array<int>"), "offering")
        offers = offering.select(*theirs, F.explode("offers").alias("value"))
        offers = offers if listed else offers.join(values, "value", "left_semi")
        pairs = stage(asks.join(few(offers), "value").where(F.col("holder") < F.col("doc_id")).select(*key, *theirs).distinct(), "pairs")
        both = pairs.join(left.select(*key, F.col("shingles").alias("mine"), "held", "known").dropDuplicates(key), key).join(offering.select(*theirs, F.col("shingles").alias("theirs")).dropDuplicates(theirs), theirs)
        got = both.select("doc_id", "mark", "start", "holder", "there", "mine", "held", "known", "theirs").mapInArrow(verify, "doc_id bigint, mark bigint, first_word bigint, last_word bigint, holder bigint, holder_first_word bigint, agreement double")
        out.append(stage(got.distinct(), "rest"))
        if len(out) < 3:
            spans = out[-1].groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first_word", "last_word")).alias("spans"))
            open_ = left.join(spans, ["doc_id", "mark"], "left").select(*key, "held", "shingles", "known", "spans")
            left = stage(open_.mapInArrow(again, LEFT), "left")
    return reduce(DataFrame.unionByName, out, found.drop("runs", "second").where("false"))


def without_passages(docs: DataFrame) -> DataFrame:
    """The documents' columns, each text without the words of passages that an earlier document holds; ``n_chars`` follows.

    Rows of documents that keep no word go.
    """
    i, m, at, spans, new = fresh(docs, "_id", "_mark", "_at", "_spans", "_new")
    found = repeated_passages(docs).groupBy(F.col("doc_id").alias(i), F.col("mark").alias(m)).agg(F.collect_set(F.struct("first_word", "last_word")).alias(spans))
    joined = docs.withColumn(at, F.xxhash64("text")).join(found, (F.col("doc_id") == F.col(i)) & (F.col(at) == F.col(m)), "left")

    @F.pandas_udf("string")
    def cut(texts, spans):
        return texts.combine(spans, lambda t, s: t if s is None or t is None else remove_words(t, [(x["first_word"], x["last_word"]) for x in s]))

    same = F.col(spans).isNull()
    out = joined.withColumn(new, F.when(same, F.col("text")).otherwise(cut("text", spans))).where(same | F.col(new).rlike(r"[^\x20\x09-\x0D]"))
    replaced = {"text": F.col(new), "n_chars": F.when(same, F.col("n_chars")).otherwise(F.char_length(new).cast("bigint"))} if "n_chars" in docs.columns else {"text": F.col(new)}
    return out.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in docs.columns])


def remove_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its words first..last of each span and the blanks after them."""
    import re

    drop: set[int] = set()
    for a, b in spans:
        drop.update(range(a, b + 1))
    words = list(re.finditer(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text))
    kept = [m.group() for i, m in enumerate(words) if i not in drop]
    return (text[: words[0].start()] if words else text) + "".join(kept)


def merged_passages(passages: DataFrame) -> DataFrame:
    """``doc_id, mark, first_word, last_word, n_words, holders``: overlapping passages of a document as one, with all their holders."""
    w = Window.partitionBy("doc_id", "mark").orderBy("first_word", "last_word")
    before = F.max("last_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col("first_word") > before)).cast("int")
    return (
        passages.withColumn("_new", new)
        .withColumn("_span", F.sum("_new").over(w))
        .groupBy("doc_id", "mark", "_span")
        .agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.array_sort(F.collect_set("holder")).alias("holders"))
        .select("doc_id", "mark", "first_word", "last_word", (F.col("last_word") - F.col("first_word") + 1).alias("n_words"), "holders")
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per passage of 50 or more words that an earlier document holds too: none for clean documents."""
    return merged_passages(repeated_passages(table(spark, sf_dir, "documents"))).drop("mark")
