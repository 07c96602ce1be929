"""Near-duplicate sequences: all pairs whose sets of letter runs are similar enough.

Method: signature trees. A leaf holds up to LEAF records, a node above it up to FAN nodes; each has the OR of its
records' token bitmaps and the range of their set sizes. A dual traversal from (root, root) follows a pair of nodes only
if the most that any two of their records can have in common allows the similarity, and compares records exactly at the
leaves. One tree over everything would prune little: runs of eight letters are so few that unions of some hundred
unrelated records hold most of them. So records that may be similar are brought together first, and each tree holds up to
TREE of those: many families that have nothing to do with each other, which is what the traversal tells apart.

They are brought together by *anchors*: the least of the hashed runs of ANCHOR_RUN letters in each of ANCHORS parts of
their range. All that share an anchor form a block with the first of them. This is the only inexact step. Of a pair of
similarity 0.6, evenly spread edits leave about 0.36 for the longer runs, so that it misses all 32 anchors with a
probability of 6e-7. Runs that are frequent in the corpus come last; a record of which more than SHARED are frequent has
64 finer anchors as well, and one of more than FAMILIAR also 32 that treat all runs alike.

Copies (equal letters) are one record here, known by a hash of 128 bits, and get their ids back at the end.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbed.plans.runtime import materialise, release, shuffle_partitions, table

#: Letters in a run.
RUN = 8
#: Similarity as a fraction of integers, so that comparisons are exact.
SIMILARITY = (6, 10)
#: Anchors that a record shares with one of its family.
OF_FAMILY = 4
#: Letters of the runs that anchors come from, and anchors of a record.
ANCHOR_RUN, ANCHORS = 16, 40
#: Records with few different runs of RUN letters may share them but no long run: those whose runs hash to at most so many
#: of 64 numbers (all with at most so many runs, hardly any with twice that) are anchored by these runs too.
FEW = 40
#: A long run is frequent if its bin has more than this share of the number of records, and more than that many.
FREQUENT, OFTEN = 0.001, 256
#: Shares of frequent runs above which a record has further anchors. If one record of a pair of 0.6 has less than the
#: first, anchors see 0.32 of it at least; if one has less than the second, 64 of them see at least 0.2.
SHARED, FAMILIAR = 0.15, 0.35
BINS, SLICES = 1 << 20, 64
#: Records in a leaf, nodes in a node, and records in a tree; of a block of more records, a task takes two halves of that.
LEAF, FAN, TREE = 8, 4, 2048
#: Records whose tokens are worked on at a time; few, so that they stay in a core's cache.
PIECE = 512
#: Numbers of 64 bits of bitmaps that are compared at a time, for the same reason.
WORDS = 1 << 15
#: Bits of a node's bitmap and of the one that records are told apart by first, powers of two.
FOLD, NARROW = 1 << 13, 1024
#: Different records that a partition remembers while it collapses copies; more only makes later steps collapse them.
REMEMBERED = 200_000
#: Anchors that a task groups, of which it also remembers the different ones.
TASK_ANCHORS = 2_000_000

_BIN = np.uint64(64 - 20)
_UPPER = bytes(range(256)).upper()
_DROPPED = bytes(x for x in range(256) if not chr(x).isalpha() or x > 127)
_CODE = np.full(256, 4, np.uint8)
_CODE[list(b"ACGT")] = range(4)
_HEADS = [bytes((x,)) for x in range(4)]
_FOUR = np.frombuffer(b"ACGT", np.uint8)[(np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3]


def letters_of(raw: bytes | None) -> bytes:
    """ASCII letters in upper case."""
    return (raw or b"").translate(_UPPER, _DROPPED)


def packed(texts: list[bytes]) -> list[bytes]:
    """Two bits a letter where all are A, C, G or T, after a byte that tells how many letters fill up the last
    byte; else the byte 4 and the letters."""
    if not texts:
        return []
    fill = [-len(x) % 4 for x in texts]
    codes = _CODE[np.frombuffer(b"".join([x + b"AAA"[:n] if n else x for x, n in zip(texts, fill)]), np.uint8)]
    ends = np.cumsum([len(x) + n for x, n in zip(texts, fill)])
    starts = np.concatenate([[0], ends[:-1]])
    plain = (np.maximum.reduceat(codes, starts) < 4).tolist()
    four = codes.view("<u4")
    data = (four | four >> 6 | four >> 12 | four >> 18).astype(np.uint8).tobytes()
    cuts = zip(texts, fill, (starts // 4).tolist(), (ends // 4).tolist(), plain)
    return [_HEADS[n] + data[i:j] if ok else b"\x04" + x for x, n, i, j, ok in cuts]


def unpacked(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all items in one array, with the start and the length of each."""
    heads = np.array([x[0] for x in items])
    sizes = np.array([len(x) - 1 for x in items])
    two_bits = b"".join([x[1:] for x in items if x[0] < 4])
    raw = b"".join([x[1:] for x in items if x[0] == 4])
    buffer = np.concatenate([_FOUR[np.frombuffer(two_bits, np.uint8)].reshape(-1), np.frombuffer(raw, np.uint8)])
    small = heads < 4
    width = np.where(small, sizes * 4, 0)
    starts = np.where(small, np.cumsum(width) - width, 4 * len(two_bits) + np.cumsum(np.where(small, 0, sizes)) - np.where(small, 0, sizes))
    return buffer, starts, np.where(small, sizes * 4 - heads, sizes)


def _eight(buffer: np.ndarray) -> np.ndarray:
    """The eight letters from each place on as a 40-bit number."""
    c = (buffer & 31).astype(np.uint16)
    two = (c[:-1] << np.uint16(5) | c[1:]).astype(np.uint32)
    four = (two[:-2] << np.uint32(10) | two[2:]).astype(np.uint64)
    out = four[:-4] << np.uint64(20)
    out |= four[4:]
    return out


def _at(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """So many values from each start on, one after the other."""
    ends = np.cumsum(counts)
    return values[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


def tokens(buffer: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of eight letters as 40-bit numbers, of one record after the other, and the number of each record's.
    Records must have at least eight letters."""
    counts = lens - RUN + 1
    return _at(_eight(buffer), starts, counts), counts


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, without repetitions. On large arrays this is many times faster than NumPy's own, which hashes first."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, bytes) -> (id, key, letters): letters are null if the partition gave the key's before."""
    schema = pa.schema([("id", pa.int32()), ("key", pa.binary()), ("letters", pa.binary())])
    seen: set[bytes] = set()
    for batch in batches:
        ids, keys, texts, fresh = [], [], [], []
        for number, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = letters_of(raw)
            if number is None or len(text) < RUN:
                continue
            key = hashlib.blake2b(text, digest_size=16).digest()
            if key not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
                fresh.append(len(ids))
                texts.append(text)
            ids.append(number)
            keys.append(key)
        letters: list[bytes | None] = [None] * len(ids)
        for k, item in zip(fresh, packed(texts)):
            letters[k] = item
        yield pa.record_batch([pa.array(ids, pa.int32()), pa.array(keys, pa.binary()), pa.array(letters, pa.binary())], schema=schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, letters), sorted by key with letters first and then by id -> (record, id, letters): each key's record
    once, with one of its ids; rows without letters are the ids of a record that has several. Last come rows without id:
    how often the long runs of some bins occur (letters, as 32-bit numbers; record is the number of such a slice), the
    number of records after them."""
    schema = pa.schema([("record", pa.int64()), ("id", pa.int32()), ("letters", pa.binary())])
    number = (TaskContext.get().partitionId() << 40) - 1
    bins, records = np.zeros(BINS, np.int64), 0
    last, first, own = None, None, None
    for batch in batches:
        out: list[tuple[int, int, bytes | None]] = []
        texts: list[bytes] = []
        for key, who, item in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if key != last:
                number, last, first, own = number + 1, key, who, who
                out.append((number, who, item))
                texts.append(item)
            elif who != own:
                if first is not None:
                    out.append((number, first, None))
                    first = None
                out.append((number, who, None))
                own = who
        if texts:
            records += len(texts)
            found = [long_runs(*unpacked(texts[k : k + PIECE]))[0] >> _BIN for k in range(0, len(texts), PIECE)]
            bins += np.bincount(np.concatenate(found).view(np.int64), minlength=BINS)
        if out:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)
    if records:
        slices = [np.append(x, records).astype(np.uint32).tobytes() for x in np.split(bins, SLICES)]
        yield pa.record_batch([pa.array(range(SLICES), pa.int64()), pa.nulls(SLICES, pa.int32()), pa.array(slices, pa.binary())], schema=schema)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows (slice, counts) of some slices -> (bin, records): the frequent bins, and at -1 the number of records."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in zip(*(c.to_pylist() for c in batch.columns)):
            sums[k] = sums.get(k, 0) + np.frombuffer(counts, np.uint32).astype(np.int64)
    for k, counts in sums.items():
        at = np.flatnonzero(counts[:-1] > max(FREQUENT * counts[-1], OFTEN)) + k * (BINS // SLICES)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.full(len(at) + 1, counts[-1]))], names=["bin", "records"])


def long_runs(buffer: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ANCHOR_RUN letters, of one record after the other, and the number of each record's."""
    counts = np.maximum(lens - ANCHOR_RUN + 1, 0)
    if not counts.any():
        return np.empty(0, np.uint64), counts
    eight = _eight(buffer)
    return _at(mixed(eight[:-8] * np.uint64(0x9E3779B97F4A7C15) + eight[8:]), starts, counts), counts


def _few(buffer: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The records with few different runs of RUN letters."""
    hashed = _eight(buffer)
    hashed *= np.uint64(0x9E3779B97F4A7C15)
    hashed >>= np.uint64(58)
    # What is between a record's last run and the next record's first is left out.
    order = np.argsort(starts)
    cuts = np.stack([starts, starts + lens - RUN + 1], axis=1)[order].reshape(-1)
    seen = np.bitwise_or.reduceat(np.append(np.uint64(1) << hashed, np.uint64(0)), cuts)[::2]
    return np.sort(order[np.bitwise_count(seen) <= FEW])


def _least(run: np.ndarray, late: np.ndarray | None, counts: np.ndarray, parts: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row): the least hash of each record's runs in each of ``parts`` parts of the hashes' range; late runs come
    after all others."""
    part = (run & np.uint64(0xFFFFFF)) * np.uint64(parts) >> np.uint64(24)
    part += np.repeat(np.arange(0, len(counts) * parts, parts, dtype=np.uint64), counts)
    value = (run >> np.uint64(33)).astype(np.uint32)
    if late is not None:
        value |= late
    found = np.full(len(counts) * parts, 0xFFFFFFFF, np.uint32)
    np.minimum.at(found, part.astype(np.int64), value)
    at = np.flatnonzero(found != 0xFFFFFFFF)
    return mixed(found[at].astype(np.uint64) << np.uint64(32) | (at % parts + kind).astype(np.uint64)), at // parts


def _anchors(frequent: np.ndarray, parts: int):
    """(record, letters) -> (part, first, anchors): the anchors of some records that fall into a part, as a table of 32-bit
    hashes, then one of the records' last 16 bits, of which ``first`` has the rest."""
    late = np.zeros(BINS, np.uint32)
    late[frequent] = 1 << 31

    def of(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buffer, starts, lens = unpacked(items)
        run, counts = long_runs(buffer, starts, lens)
        last = late[(run >> _BIN).astype(np.int64)]
        ends = np.cumsum(counts)
        many = np.concatenate([[0], np.cumsum(last >> np.uint32(31), dtype=np.int64)])
        share = (many[ends] - many[ends - counts]) / np.maximum(counts, 1)
        found = [_least(run, last, counts, ANCHORS, 0)]
        for some, use, more, kind in ((share > SHARED, last, 2 * ANCHORS, 256), (share > FAMILIAR, None, ANCHORS, 512)):
            if some.any():
                inside = np.repeat(some, counts)
                anchor, row = _least(run[inside], None if use is None else use[inside], counts[some], more, kind)
                found.append((anchor, np.flatnonzero(some)[row]))
        few = _few(buffer, starts, lens)
        if len(few):
            token, counts = tokens(buffer, starts[few], lens[few])
            anchor, row = _least(mixed(token), None, counts, ANCHORS, 768)
            found.append((anchor, few[row]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def packets(anchor: np.ndarray, record: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = ((anchor >> np.uint64(32)) % np.uint64(parts)).astype(np.min_scalar_type(parts))
        order = np.argsort(record, kind="stable")
        order = order[np.argsort(part[order], kind="stable")]
        part, first = part[order], record[order] >> 16
        low, row = anchor[order].astype(np.uint32), record[order].astype(np.uint16)
        cuts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (first[1:] != first[:-1]), [True]]))
        blobs = [low[s:e].tobytes() + row[s:e].tobytes() for s, e in zip(cuts, cuts[1:])]
        at = cuts[:-1]
        yield pa.record_batch([pa.array(part[at].astype(np.int32)), pa.array(first[at]), pa.array(blobs, pa.binary())], names=["part", "first", "anchors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                piece = batch.slice(at, PIECE)
                anchor, row = of(piece.column(1).to_pylist())
                held.append((anchor, piece.column(0).to_numpy()[row]))
                if sum(len(x) for x, _ in held) > TASK_ANCHORS // 4:
                    yield from packets(*(np.concatenate(x) for x in zip(*held)))
                    held = []
        if held:
            yield from packets(*(np.concatenate(x) for x in zip(*held)))

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, first, anchors) -> (lead, record, n): records that share n anchors with the first of those that have
    them. A part's
    different anchors are remembered with their leads, its rows come and go, so a hot anchor takes no more room."""

    def star(pieces: list[tuple[int, bytes]], known: tuple[np.ndarray, np.ndarray]) -> tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray]]:
        anchor = np.concatenate([np.frombuffer(x, np.uint32, len(x) // 6) for _, x in pieces])
        record = np.concatenate([np.frombuffer(x, np.uint16, offset=len(x) // 6 * 4).astype(np.int64) + (f << 16) for f, x in pieces])
        order = np.argsort(anchor.astype(np.uint64) << np.uint64(32) | np.arange(len(anchor), dtype=np.uint64))
        anchor, record = anchor[order], record[order]
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        names, lead = anchor[new], record[new]
        if len(known[0]):
            at = np.minimum(np.searchsorted(known[0], names), len(known[0]) - 1)
            had = known[0][at] == names
            lead = np.where(had, known[1][at], lead)
            fresh = ~had
            both = np.concatenate([known[0], names[fresh]])
            order = np.argsort(both, kind="stable")
            known = both[order], np.concatenate([known[1], lead[fresh]])[order]
        else:
            known = names, lead
        lead = lead[np.cumsum(new) - 1]
        apart = lead != record
        lead, record = lead[apart], record[apart]
        # Leads are few: pairs are told apart by the lead's place and the record's.
        leads, x = np.unique(lead, return_inverse=True)
        records, y = np.unique(record, return_inverse=True)
        pair = np.sort(x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64))
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.empty(0, np.int64)
        times = np.diff(np.append(new, len(pair)))
        pair = pair[new]
        columns = [leads[(pair >> np.uint64(32)).astype(np.int64)], records[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)], times.astype(np.int32)]
        return pa.record_batch([pa.array(c) for c in columns], names=["lead", "record", "n"]), known

    nothing = np.empty(0, np.uint32), np.empty(0, np.int64)
    part, pieces, known, size = None, [], nothing, 0
    for batch in batches:
        for number, first, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if pieces and (number != part or size > TASK_ANCHORS):
                found, known = star(pieces, known)
                yield found
                pieces, size = [], 0
            if number != part:
                part, known = number, nothing
            pieces.append((first, blob))
            size += len(blob) // 6
    if pieces:
        yield star(pieces, known)[0]


def _enough(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Whether overlap / (a + b - overlap) reaches the similarity."""
    return overlap * sum(similarity) >= similarity[0] * (a + b)


def _starts(group: np.ndarray, most: int) -> np.ndarray:
    """Where to cut ascending groups so that no piece has more than ``most`` in it."""
    new = np.concatenate([[True], group[1:] != group[:-1]])
    return np.flatnonzero((np.arange(len(group)) - np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))) % most == 0)


def _bitmaps(at: np.ndarray, n: int) -> np.ndarray:
    """n bits, a multiple of 64, of which those at some places are set, as numbers of 64 bits."""
    flags = np.zeros(n, np.uint8)
    flags[at] = 1
    return np.packbits(flags, bitorder="little").view("<u8")


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of bits that two bitmaps have in common, row by row; a multiple of 512 bits, up to 65,472."""
    bits = np.bitwise_count(x & y).view(np.uint64)
    # Eight numbers of a byte each are added up as four of two bytes.
    bits = (bits & np.uint64(0x00FF00FF00FF00FF)) + (bits >> np.uint64(8) & np.uint64(0x00FF00FF00FF00FF))
    return (bits.sum(1) * np.uint64(0x0001000100010001) >> np.uint64(48)).astype(np.int64)


class SignatureTrees:
    """A tree for each block: leaves of up to ``leaf`` records in order, FAN nodes in one above them, up to one root. A node
    has the union of its records' bitmaps, in which tokens are folded to FOLD bits; the range of their sizes; and how many
    tokens a record has at most for which it has no bit of its own. All trees are traversed at once, level by level."""

    def __init__(self, block: np.ndarray, bits: np.ndarray, sizes: np.ndarray, folded: np.ndarray, leaf: int = LEAF):
        narrow = np.bitwise_or.reduce(bits.reshape(len(bits), FOLD // NARROW, NARROW // 64), axis=1)
        below = bits, sizes, sizes, folded
        self.levels = [(narrow, sizes, sizes, sizes - np.bitwise_count(narrow).sum(1, dtype=np.int64)), below]
        self.starts = [np.arange(len(bits) + 1)]
        most = leaf
        while len(self.levels) == 2 or len(block) > block[-1] + 1:
            at, most = _starts(block, most), FAN
            union, low, high, lost = below
            below = np.bitwise_or.reduceat(union, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(lost, at)
            self.levels.insert(0, below)
            self.starts.insert(0, np.append(at, len(union)))
            block = block[at]

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
        """Whether any record of node i may be similar to one of node j: they have at most as many tokens in common as the
        unions have bits, with those that had no bit of their own, and as the larger of the sets; sizes must be close
        enough."""
        union, low, high, lost = self.levels[level]
        one, all_ = similarity
        ok = (high[i] * all_ >= low[j] * one) & (high[j] * all_ >= low[i] * one)
        at = np.flatnonzero(ok & (i != j))
        step = WORDS // union.shape[1]
        for k in range(0, len(at), step):
            x, y = i[at[k : k + step]], j[at[k : k + step]]
            most = _common(union.take(x, 0), union.take(y, 0)) + np.minimum(lost[x], lost[y])
            ok[at[k : k + step]] = _enough(np.minimum(most, np.minimum(high[x], high[y])), low[x], low[y], similarity)
        return ok

    def pairs(self, similarity: tuple[int, int] = SIMILARITY, tally: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of records that the dual traversal from (root, root) leaves. ``tally`` gets, for each level, how many pairs
        of different nodes it came to and how many it followed."""
        i = j = np.arange(len(self.levels[0][1]))
        for level in range(len(self.levels)):
            if level:
                starts = self.starts[level - 1]
                p, q = starts[i], starts[j]
                n, m = starts[i + 1] - p, starts[j + 1] - q
                times = n * m
                inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                m = np.repeat(m, times)
                i, j = np.repeat(p, times) + inner // m, np.repeat(q, times) + inner % m
                real = i < j if level + 2 >= len(self.levels) else i <= j
                i, j = i[real], j[real]
            ok = self._possible(level, i, j, similarity)
            if tally is not None:
                tally.append((int((i != j).sum()), int((ok & (i != j)).sum())))
            i, j = i[ok], j[ok]
        return i, j


def block_pairs(block: np.ndarray, items: list[bytes], similarity: tuple[int, int] = SIMILARITY, leaf: int = LEAF, tally: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the similar pairs of records within each block: what the traversal of the blocks' trees leaves is compared
    exactly. block: numbers from 0, ascending, of at most 4096 blocks of at most 4096 records."""
    buffer, starts, lens = unpacked(items)
    token, counts = tokens(buffer, starts, lens)
    # Within a block records with the same least run come together.
    begun = np.cumsum(counts) - counts
    order = np.lexsort((np.minimum.reduceat((token * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32), begun), block))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    members = np.bincount(block)
    first = np.cumsum(members) - members
    head = block.astype(np.uint64) << np.uint64(52) | (place - first[block]).astype(np.uint64)
    key = distinct(np.repeat(head, counts) | token << np.uint64(12))
    # From here on records are known by their place.
    ends = np.append(np.searchsorted(key, np.arange(1, len(members), dtype=np.uint64) << np.uint64(52)), len(key))
    at = (key & np.uint64(4095)).astype(np.int64) + np.repeat(first, np.diff(ends, prepend=0))
    sizes = np.bincount(at, minlength=len(items))
    fold = (key >> np.uint64(12)) * np.uint64(0x9E3779B97F4A7C15 << 12 & 0xFFFFFFFFFFFFFFFF) >> np.uint64(64 - FOLD.bit_length() + 1)
    bits = _bitmaps(at * FOLD + fold.astype(np.int64), len(items) * FOLD).reshape(len(items), -1)
    folded = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
    p, q = SignatureTrees(block, bits, sizes, folded, leaf).pairs(similarity, tally)
    i, j = _exactly(key, at, block, sizes, p, q, similarity)
    return order[i], order[j]


def _exactly(key: np.ndarray, at: np.ndarray, block: np.ndarray, sizes: np.ndarray, p: np.ndarray, q: np.ndarray, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (p, q) that are similar, by bitmaps of the tokens that the block has more than once."""
    if not len(p):
        return p, q
    same = key >> np.uint64(12)
    starts = np.concatenate([[True], same[1:] != same[:-1]])
    shared = ~starts
    shared[:-1] |= ~starts[1:]
    rows, starts = at[shared], starts[shared]
    number = np.cumsum(starts)
    tokens_of = np.bincount(block[rows[starts]], minlength=int(block[-1]) + 1)
    words = -(-tokens_of // 64)
    row_at = np.cumsum(words[block]) - words[block]
    # Where a record's bits would begin if the first block's tokens were the first of them.
    begin = row_at * 64 - (np.cumsum(tokens_of) - tokens_of)[block] - 1
    bits = _bitmaps(begin[rows] + number, 64 * (int(words[block].sum()) + 1))
    some = words[block[p]] > 0
    p, q = p[some], q[some]
    out = []
    width = words[block[p]]
    cuts = np.searchsorted(np.cumsum(width), np.arange(WORDS, int(width.sum()) + WORDS, WORDS), "right")
    for s, e in zip(np.concatenate([[0], cuts]), np.append(cuts, len(p))):
        if s == e:
            continue
        w = width[s:e]
        ends = np.cumsum(w)
        inner = np.arange(ends[-1]) - np.repeat(ends - w, w)
        both = np.bitwise_count(bits[np.repeat(row_at[p[s:e]], w) + inner] & bits[np.repeat(row_at[q[s:e]], w) + inner])
        out.append(np.add.reduceat(both.astype(np.int64), ends - w))
    ok = _enough(np.concatenate(out), sizes[p], sizes[q], similarity) if out else np.zeros(0, bool)
    return p[ok], q[ok]


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Sorted rows (block, cell, record, id, letters) -> blocks from 0, records, ids and letters of whole blocks, about
    PIECE records at a time."""
    parts: list[pa.RecordBatch] = []
    held = 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            parts.append(batch)
            held += batch.num_rows
            if held < 16 * PIECE:
                continue
        if not held:
            continue
        rows = pa.Table.from_batches(parts).combine_chunks()
        lead, cell, record, who = (rows.column(k).to_numpy() for k in range(4))
        letters = rows.column(4)
        new = np.concatenate([[True], (lead[1:] != lead[:-1]) | (cell[1:] != cell[:-1])])
        begins = np.append(np.flatnonzero(new), len(lead))
        # The last block may go on in the next batch.
        last = len(begins) - (1 if batch is None else 2)
        at = 0
        while at < last:
            end = max(at + 1, int(np.searchsorted(begins, begins[at] + PIECE, "right")) - 1)
            end = min(end, last)
            a, b = begins[at], begins[end]
            yield np.cumsum(new[a:b]) - 1, record[a:b], who[a:b], letters.slice(a, b - a).to_pylist()
            at = end
        rest = int(begins[last])
        parts, held = (rows.slice(rest).to_batches(), rows.num_rows - rest) if rest < rows.num_rows else ([], 0)


def _compare(similarity: tuple[int, int]):
    """Whole blocks -> (a, b, id_a, id_b): similar records and an id of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, record, who, letters in _whole_blocks(batches):
            i, j = block_pairs(block, letters, similarity)
            i, j = np.where(record[i] < record[j], i, j), np.where(record[i] < record[j], j, i)
            if len(i):
                yield pa.record_batch([pa.array(x) for x in (record[i], record[j], who[i], who[j])], names=["a", "b", "id_a", "id_b"])

    return run


def similar_records(records: DataFrame, similarity: tuple[int, int] = SIMILARITY, tree: int = TREE) -> tuple[DataFrame, DataFrame]:
    """(id, bytes) -> (a, b, id_a, id_b): similar records, each with one of its ids, in either order of the ids; a pair may
    come twice. And (record, id): all ids of records that have several. The result without the pairs within groups of
    copies, nor those that copies of similar records make.

    Rows without id and records of fewer than eight letters (null and empty ones too) are in no pair. An id with
    several contents is several records. Repeated rows, ties and an empty table need no care; other columns are
    not read. Whole sequences count, however long.

    Shuffles: each content's letters once for each partition that has it, two bits each, and a hash of 16 bytes; six bytes
    an anchor; the blocks' members; and each record's letters to its blocks. A block of more than ``tree`` records is cut
    into a grid of pairs of halves of that, each a tree of its own. What goes to the driver is the list of frequent bins,
    at most ``BINS`` of them, and the number of records, from which the number of tasks follows.
    """
    spark = records.sparkSession
    n = shuffle_partitions(spark)
    by_key = records.select(F.col("id").cast("int").alias("id"), F.col("bytes").cast("binary").alias("bytes")).mapInArrow(_copies, "id int, key binary, letters binary")
    by_key = by_key.repartition(n, "key").sortWithinPartitions(F.col("key"), F.col("letters").isNull(), F.col("id"))
    rows = materialise(by_key.mapInArrow(_records, "record long, id int, letters binary"), "records")
    counts = rows.where("id IS NULL").select("record", "letters").repartition(SLICES, "record").mapInArrow(_frequent, "bin long, records long")
    counts = counts.distinct().collect()  # at most BINS rows and one
    total = max((r.records for r in counts), default=0)
    frequent = np.array([r.bin for r in counts if r.bin >= 0], np.int64)
    carriers = rows.where("id IS NOT NULL AND letters IS NOT NULL")
    parts = max(n, -(-total * ANCHORS // TASK_ANCHORS))
    anchors = carriers.select("record", "letters").mapInArrow(_anchors(frequent, parts), "part int, first long, anchors binary")
    stars = anchors.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "first").mapInArrow(_stars, "lead long, record long, n int")
    stars = materialise(stars.groupBy("lead", "record").agg(F.sum("n").alias("n")), "stars")
    # A lead that shares several anchors with leads of its own is of their family: its block goes whole into the nearest's.
    near = stars.where(F.col("n") >= OF_FAMILY).groupBy("record").agg(F.max_by("lead", "n").alias("block"))
    moved = stars.join(near.withColumnRenamed("record", "lead"), "lead", "left").select(F.coalesce("block", "lead").alias("block"), F.explode(F.array("record", "lead")).alias("record"))
    blocks = materialise(moved.distinct(), "blocks")
    release(stars)
    large = blocks.groupBy("block").count().where(F.col("count") > tree).select("block", F.ceil(2 * F.col("count") / tree).cast("int").alias("grid"))
    side = F.pmod(F.xxhash64("record", F.lit(7)), F.col("grid")).cast("int")
    cells = F.when(F.col("grid").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("grid") - 1), lambda x: F.least(x, side) * F.col("grid") + F.greatest(x, side))
    )
    placed = blocks.join(large, "block", "left").select("block", F.explode(cells).alias("cell"), "record")
    sent = placed.join(carriers, "record").select("block", "cell", "record", "id", "letters").repartition(n, "block", "cell").sortWithinPartitions("block", "cell")
    # Written before ids come back, so that the letters' shuffle files go first.
    pairs = materialise(sent.mapInArrow(_compare(similarity), "a long, b long, id_a int, id_b int"), "pairs")
    release(blocks)
    return pairs, rows.where("id IS NOT NULL AND letters IS NULL").select("record", "id")


def similar_pairs(records: DataFrame, similarity: tuple[int, int] = SIMILARITY, tree: int = TREE) -> DataFrame:
    """(id, bytes) -> (id_a, id_b), id_a < id_b: different ids whose sets of letter runs are similar enough. The pairs of
    :func:`similar_records` with all ids of their records, and those of copies."""
    pairs, copies = similar_records(records, similarity, tree)
    copies = materialise(copies, "copies")
    for end in ("a", "b"):
        several = copies.select(F.col("record").alias(end), F.col("id").alias("other"))
        pairs = pairs.join(several, end, "left").withColumn(f"id_{end}", F.coalesce("other", f"id_{end}")).drop("other")
    among = copies.withColumnRenamed("id", "id_a").join(copies.withColumnRenamed("id", "id_b"), "record").where("id_a < id_b").select("id_a", "id_b")
    both = pairs.select("id_a", "id_b").unionByName(among).where("id_a <> id_b")
    return both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(table(spark, sf_dir, "int_seq"))


QUERIES = {"p2_found": p2_found}
ORACLES = {
    "p2_found": """
WITH s AS (SELECT DISTINCT id, upper(regexp_replace(decode(bytes), '[^A-Za-z]', '', 'g')) AS t FROM int_seq WHERE id IS NOT NULL AND bytes IS NOT NULL),
g AS (SELECT DISTINCT id, substr(t, CAST(k AS BIGINT), 8) AS run FROM (SELECT id, t, UNNEST(range(1, length(t) - 6)) AS k FROM s WHERE length(t) >= 8)),
n AS (SELECT id, COUNT(*) AS n FROM g GROUP BY id),
o AS (SELECT a.id AS id_a, b.id AS id_b, COUNT(*) AS o FROM g a JOIN g b ON a.run = b.run AND a.id < b.id GROUP BY a.id, b.id)
SELECT id_a, id_b FROM o JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE o * 16 >= 6 * (x.n + y.n)"""
}
