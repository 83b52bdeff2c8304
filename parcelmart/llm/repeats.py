"""Removal of repeated byte strings by longest-previous-factor arrays over the places that can hold them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.staging import stage
from .hash_arrays import BLOB, Tables, batches_of, bounds, grouped, new_folder, save, send, shard_count, to_shards, unpack_all
from .textbytes import RangeHash, blocks, flat_utf8, mix, sorted_counts

LENGTH = 200
#: Bytes of an anchor; a string of ``LENGTH`` bytes holds LENGTH - ANCHOR + 1 of them and belongs to the one of least hash.
#: A third of the string: much shorter ones, a few words, stand in many texts by chance, and their zones would all be ordered.
ANCHOR = 64
#: Zones of one anchor that one task orders; anchors with more of them take the way of hashed strings.
GROUP_ZONES = 1_000
#: Bytes whose suffixes are ordered at once.
ORDER_BYTES = 1_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(2**63 - 1)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by windows of doubled width."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


class Zones:
    """Zones of a block of texts: a run of string starts that share an anchor.

    ``low`` and ``high``: first and last start; ``anchor``: hash of the anchor's bytes; ``content``: hash of all bytes of the
    zone's strings and of where the anchor stands in them. Equal strings have the same anchor at the same place, wherever they stand.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hasher: RangeHash, length: int, anchor: int) -> None:
        none = np.zeros(0, np.int64)
        self.low = self.high = self.at = self.row = none
        self.anchor = self.content = np.zeros(0, np.uint64)
        self.sums = np.zeros(0, np.uint64)
        if len(data) < length:
            return
        self.sums = sums = hasher.sums(data)
        place = np.arange(len(data) - anchor + 1, dtype=np.int64)
        grams = hasher.ranges(sums, place, place + anchor)
        coded = (grams >> np.uint64(32) << np.uint64(32)) | place.astype(np.uint64)
        least = (sliding_least(coded, length - anchor + 1) & np.uint64(2**32 - 1)).astype(np.int64)
        start = np.arange(len(least), dtype=np.int64)
        row = np.searchsorted(offsets, start, "right") - 1
        inside = start + length <= offsets[row + 1]
        start, least, row = start[inside], least[inside], row[inside]
        if not len(start):
            return
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])])
        head = np.flatnonzero(new)
        self.low, self.at, self.row = start[head], least[head], row[head]
        self.high = start[np.concatenate([head[1:], [len(start)]]) - 1]
        self.anchor = grams[self.at]
        self.content = mix(hasher.ranges(sums, self.low, self.high + length) + (self.at - self.low).astype(np.uint64) * _GOLD)

    @property
    def key(self) -> np.ndarray:
        return mix(self.anchor * _GOLD + self.content)


def _zones(batches: Iterator[pa.RecordBatch], length: int, anchor: int) -> Iterator[tuple]:
    """(batch, first row, last row, bytes, offsets, zones) for each block."""
    hasher = RangeHash()
    for batch in batches:
        data, offsets = flat_utf8(batch.column("text"))
        for start, stop in blocks(offsets):
            cut = offsets[start : stop + 1]
            own, ends = data[cut[0] : cut[-1]], cut - cut[0]
            yield batch, start, stop, own, ends, Zones(own, ends, hasher, length, anchor)


def _listed(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


#: A document with its zones: where each begins in the text, how many strings it has, and its hashes.
_WITH_ZONES = "id long, text string, low array<int>, n array<short>, anchor array<long>, key array<long>"


def _zone_rows(batches: Iterator[pa.RecordBatch], length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch, start, stop, _, ends, zones in _zones(batches, length, anchor):
        part, cuts = batch.slice(start, stop - start), np.searchsorted(zones.row, np.arange(stop - start + 1))
        columns = [
            part.column("id"),
            part.column("text"),
            _listed((zones.low - ends[zones.row]).astype(np.int32), cuts, pa.int32()),
            _listed((zones.high - zones.low + 1).astype(np.int16), cuts, pa.int16()),
            _listed(zones.anchor.view(np.int64), cuts, pa.int64()),
            _listed(zones.key.view(np.int64), cuts, pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "low", "n", "anchor", "key"])


class Known:
    """The zones of some documents as a pass before has written them; ``low`` counts from the text's own beginning."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        sizes = None
        for name in rows.schema.names:
            if name in ("low", "n", "anchor", "key"):
                column = rows.column(name)
                offsets = column.offsets.to_numpy()
                sizes = np.diff(offsets)
                values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
                setattr(self, name, values.view(np.uint64) if name in ("anchor", "key") else values.astype(np.int64))
        self.row = np.repeat(np.arange(rows.num_rows), sizes)


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(batch, first row, last row, bytes, offsets, zones) for each block of documents with zones."""
    for batch in batches:
        data, offsets = flat_utf8(batch.column("text"))
        for start, stop in blocks(offsets):
            cut = offsets[start : stop + 1]
            yield batch, start, stop, data[cut[0] : cut[-1]], cut - cut[0], Known(batch.slice(start, stop - start))


def _order(batch: pa.RecordBatch, start: int, stop: int) -> np.ndarray:
    """Order of documents: their ids as unsigned numbers, NULL last."""
    ids = batch.column("id").slice(start, stop - start).fill_null(int(_LAST))
    return ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


# Pass 1: anchors that stand at more than one place.


def _send_anchors(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[tuple]:
    held, size = [], 0

    def flush() -> Iterator[tuple]:
        key, _, n = sorted_counts(np.concatenate(held), np.ones(size, np.uint64))
        yield from send(1, key, [key, np.minimum(n, 2)], [8, 1], shards)

    for batch in batches:
        zones = Known(batch)
        held.append(zones.anchor)
        size += len(zones.anchor)
        if size > 2_000_000:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def _save_anchors(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple]:
    for _, shard, blobs in grouped(batches):
        key, n = unpack_all(blobs, [8, 1])
        key, _, n = sorted_counts(key, n)
        save(folder, "anchor", shard, key=key[n > 1])
        yield 0, 0, int((n > 1).sum()), b""


# Pass 2: zones that stand at more than one place, with the first of them, and anchors whose zones differ.


def _send_zones(batches: Iterator[pa.RecordBatch], shards: int, folder: str) -> Iterator[tuple]:
    tables = Tables(folder, shards)
    held: list[list[np.ndarray]] = []
    size = 0

    def flush() -> Iterator[tuple]:
        key, anchors, document, place = (np.concatenate([h[k] for h in held]) for k in range(4))
        order = np.lexsort((place, document, key))
        key, anchors, document, place = key[order], anchors[order], document[order], place[order]
        key, at, n = sorted_counts(key, np.ones(len(key), np.uint64))
        arrays = [key, anchors[at], np.minimum(n, 2), document[at], place[at]]
        yield from send(2, key, arrays, [8, 8, 1, 8, 5], shards)

    for batch in batches:
        zones = Known(batch)
        (found,) = tables.lookup("anchor", zones.anchor, {})
        at = np.flatnonzero(found)
        document = _order(batch, 0, batch.num_rows)[zones.row[at]]
        held.append([zones.key[at], zones.anchor[at], document, zones.low[at].astype(np.uint64)])
        size += len(at)
        if size > 1_000_000:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def _save_zones(batches: Iterator[pa.RecordBatch], shards: int, folder: str) -> Iterator[tuple]:
    for kind, shard, blobs in grouped(batches):
        if kind == 2:
            key, anchors, n, document, place = unpack_all(blobs, [8, 8, 1, 8, 5])
            order = np.lexsort((place, document, key))
            key, anchors, n, document, place = (x[order] for x in (key, anchors, n, document, place))
            key, at, n = sorted_counts(key, n)
            many = n > 1
            save(folder, "zone", shard, key=key[many], document=document[at][many], place=place[at][many])
            own, _, kinds, single = sorted_counts(anchors[at], np.ones(len(key), np.uint64), (~many).astype(np.uint64))
            most = np.uint64(GROUP_ZONES + 1)
            yield from send(3, own, [own, np.minimum(kinds, most), np.minimum(single, most)], [8, 4, 4], shards)
        elif kind == 3:
            own, kinds, single = unpack_all(blobs, [8, 4, 4])
            own, _, kinds, single = sorted_counts(own, kinds, single)
            some = kinds > 1
            save(folder, "open", shard, key=own[some], hot=(kinds > GROUP_ZONES)[some].astype(np.uint8))
            yield 4, 0, int(some.sum()), b""
        else:
            yield from ((kind, shard, n, body) for n, body in blobs)


# Pass 3: order the strings of differing zones of an anchor.


def _open_zones(batches: Iterator[pa.RecordBatch], length: int, shards: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Each zone of an open anchor once per block: anchor, key, bytes, whether the anchor has very many zones, and where it stands."""
    tables = Tables(folder, shards)
    for batch, start, stop, data, ends, zones in _known(batches):
        found, hot = tables.lookup("open", zones.anchor, {"hot": 1}, np.uint8)
        at = np.flatnonzero(found)
        document = _order(batch, start, stop)[zones.row[at]]
        place = zones.low[at]
        key = zones.key[at]
        order = np.lexsort((place, document, key))
        one = order[np.concatenate([[True], key[order][1:] != key[order][:-1]])] if len(order) else order
        at, document, place, key = at[one], document[one], place[one], key[one]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(zones.anchor[at].view(np.int64)),
                pa.array(key.view(np.int64)),
                pa.array([data[i : i + n + length - 1].tobytes() for i, n in zip(zones.low[at] + ends[zones.row[at]], zones.n[at])], pa.binary()),
                pa.array(hot[at, 0] > 0),
                pa.array((document ^ np.uint64(1 << 63)).view(np.int64)),
                pa.array(place),
            ],
            names=["anchor", "key", "bytes", "hot", "document", "place"],
        )


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of every suffix by its first ``length`` bytes (equal ones share a rank), by prefix doubling."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    code = np.zeros(n, np.uint64)
    for k in range(8):
        code = (code << np.uint64(8)) | padded[k : k + n]

    def ranked(value: np.ndarray) -> np.ndarray:
        order = np.argsort(value, kind="stable")
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(value[order[1:]] != value[order[:-1]])
        return rank

    rank, done = ranked(code), 8
    while done < length:
        step = min(done, length - done)
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        rank, done = ranked(rank * (n + 1) + after), done + step
    return rank


def common_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in ``order``, at most ``length``; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    for at in range(1, len(order), 20_000):
        stop = min(at + 20_000, len(order))
        unlike = windows[order[at - 1 : stop - 1]] != windows[order[at:stop]]
        out[at:stop] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), length)
    return out


def _smaller_before(place: list[int], shared: list[int]) -> list[int]:
    """Of each entry: the bytes shared with the nearest one before it whose place is smaller, 0 without one.

    ``shared`` are the bytes that an entry and the one before it have in common; two entries share the least of those between.
    """
    out, places, least = [], [], []
    for p, common in zip(place, shared):
        while places and places[-1] > p:
            places.pop()
            common = min(common, least.pop())
        out.append(common if places else 0)
        places.append(p)
        least.append(common)
    return out


def longest_factors(place: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The longest previous factor of each entry of a suffix order, whose suffixes start at ``place``.

    The suffix with which a start shares most among those at smaller places is, in suffix order, the nearest one of smaller place
    before it or behind it: the longer of the two shared prefixes is the longest previous factor.
    """
    before = _smaller_before(place.tolist(), shared.tolist())
    behind = _smaller_before(place[::-1].tolist(), np.concatenate([[0], shared[:0:-1]]).tolist())
    return np.maximum(np.array(before, np.int64), np.array(behind[::-1], np.int64))


def previous_factors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start: its longest previous factor and its longest next factor, counted up to ``length`` bytes.

    Starts are put in suffix order, told apart by ``length`` bytes and then by position. The next factor is the previous one of
    the positions read backwards.
    """
    rank = suffix_ranks(data, length)[starts]
    order = np.lexsort((starts, rank))
    place, shared = starts[order], common_prefixes(data, starts[order], length)
    earlier, later = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    earlier[order] = longest_factors(place, shared)
    later[order] = longest_factors(-place, shared)
    return earlier, later


_BITS = "shard int, key long, b0 long, b1 long, b2 long"


def _bit_batch(key: np.ndarray, owner: np.ndarray, step: np.ndarray, shards: int) -> pa.RecordBatch:
    """Bits of repeated strings: ``step`` is a string's number in its zone, ``owner`` the place of its zone in ``key``."""
    bits = np.zeros((3, len(key)), np.uint64)
    np.bitwise_or.at(bits, (step // 64, owner), np.uint64(1) << (step % 64).astype(np.uint64))
    some = np.flatnonzero(bits.any(axis=0))
    shard = np.searchsorted(bounds(shards), key[some], "right") - 1
    columns = [pa.array(np.minimum(shard, shards - 1).astype(np.int32)), pa.array(key[some].view(np.int64))]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(b[some].view(np.int64)) for b in bits)], names=["shard", "key", "b0", "b1", "b2"])


def _ordered_bits(batches: Iterator[pa.RecordBatch], length: int, shards: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Bits of the zones of whole anchors, as many at a time as ``ORDER_BYTES`` hold; rows come ordered by anchor, key, place."""
    held: list[tuple[int, int, bytes, tuple[int, int]]] = []
    size, last = 0, None

    def flush() -> pa.RecordBatch:
        rows = sorted(held, key=lambda r: r[3])
        # Strings never run from one zone into the next: starts end where a zone has no whole string left.
        data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        sizes = np.array([len(r[2]) for r in rows])
        number = sizes - length + 1
        owner = np.repeat(np.arange(len(rows)), number)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        earlier, later = previous_factors(data, (np.cumsum(sizes) - sizes)[owner] + step, length)
        found = (earlier >= length) | (later >= length) & (not keep_first)
        key = np.array([r[1] for r in rows], np.int64).view(np.uint64)
        return _bit_batch(key, owner[found], step[found], shards)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("anchor", "key", "bytes", "document", "place")]
        for anchor, key, body, document, place in zip(*columns):
            if last is not None and (anchor, key) == last:
                continue  # the same zone from another block, later in order
            if size > ORDER_BYTES and anchor != last[0]:
                yield flush()
                held, size = [], 0
            held.append((anchor, key, body, (document, place)))
            size += len(body)
            last = (anchor, key)
    if held:
        yield flush()


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every string of the zones as two hashes: for anchors with too many zones for one task."""
    first, second = RangeHash(), RangeHash()
    second.table = mix(second.table + _GOLD)
    for batch in batches:
        for key, body, document, place in zip(*(batch.column(c).to_pylist() for c in ("key", "bytes", "document", "place"))):
            data = np.frombuffer(body, np.uint8)
            start = np.arange(len(data) - length + 1)
            hashes = [h.ranges(h.sums(data), start, start + length).view(np.int64) for h in (first, second)]
            n = len(start)
            columns = [*hashes, np.full(n, key), start, np.full(n, document), start + place]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "key", "step", "document", "place"])


def _string_bits(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = batch.column("key").to_numpy().view(np.uint64)
        yield _bit_batch(key, np.arange(len(key)), batch.column("step").to_numpy(), shards)


def _save_bits(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    def write(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        key, *bits = (table.column(c).to_numpy().view(np.uint64) for c in ("key", "b0", "b1", "b2"))
        order = np.argsort(key)
        save(folder, "bits", shard, key=key[order], bits=np.stack([b[order] for b in bits], axis=1))
        return pa.RecordBatch.from_arrays([pa.array([len(key)], pa.int64())], names=["n"])

    now, held = None, []
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        for i in np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else ():
            j = int(np.searchsorted(shard, shard[i], "right"))
            if shard[i] != now and held:
                yield write(now, held)
                held = []
            now = int(shard[i])
            held.append(batch.slice(int(i), j - int(i)))
    if held:
        yield write(now, held)


# Pass 4: cut the texts.


def _marked(batch, start: int, stop: int, ends: np.ndarray, zones: Known, tables: Tables, keep_first: bool, size: int, length: int) -> np.ndarray:
    """Which bytes of a block go."""
    key = zones.key
    repeated, first_document, first_place = tables.lookup("zone", key, {"document": 1, "place": 1}, np.uint64)
    if keep_first:
        document, place = _order(batch, start, stop)[zones.row], zones.low.astype(np.uint64)
        repeated &= (document != first_document[:, 0]) | (place != first_place[:, 0])
    # A zone that stands at one place, or the first of several: what the order of its anchor's strings has shown.
    _, bits = tables.lookup("bits", key, {"bits": 3}, np.uint64)
    number = zones.n
    owner = np.repeat(np.arange(len(key)), number)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    word = bits.reshape(-1)[owner * 3 + step // 64] if len(owner) else np.zeros(0, np.uint64)
    go = repeated[owner] | ((word >> (step % 64).astype(np.uint64)) & np.uint64(1) > 0)
    begin = ((zones.low + ends[zones.row])[owner] + step)[go]
    change = np.bincount(begin, minlength=size + 1)[: size + 1] - np.bincount(begin + length, minlength=size + 1)[: size + 1]
    return np.cumsum(change)[:size] > 0


def _cut(batches: Iterator[pa.RecordBatch], length: int, shards: int, folder: str, keep_first: bool, names: list[str], with_text: bool):
    tables = Tables(folder, shards)
    for batch, start, stop, data, ends, zones in _known(batches):
        gone = _marked(batch, start, stop, ends, zones, tables, keep_first, len(data), length)
        n, removed, spans, kept = [], [], [], []
        for i, j in zip(ends[:-1], ends[1:]):
            own = gone[i:j]
            n.append(j - i)
            removed.append(int(own.sum()))
            spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
            kept.append(data[i:j][~own].tobytes() if removed[-1] else data[i:j].tobytes())
        part = batch.slice(start, stop - start)
        columns = [part.column(c) for c in names]
        columns += [pa.array(x, pa.int64()) for x in (n, removed, spans)]
        columns.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))
        if with_text:
            columns.append(pa.array(kept, pa.binary()))
        new = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_bytes"] * with_text
        yield pa.RecordBatch.from_arrays(columns, names=[*names, *new])


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    anchor: int = ANCHOR,
    keep_first: bool = True,
    with_text: bool = False,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes).

    Bytes covered by a string of ``length`` bytes that starts elsewhere too go: all but the first in order of key and
    position with ``keep_first``, else all of them. Matches may overlap and lie in one text, but never cross texts, and are judged
    on the input.

    A string belongs to the anchor of least hash inside it. Starts with a common anchor form a zone, and equal zones need no
    further look. Where zones of one anchor differ, which is at the ends of matches, their strings are put in suffix
    order, and longest previous (and next) factors tell which are repeated. Anchors with more than ``GROUP_ZONES``
    different zones (a short common phrase in many texts) are settled by two hashes for each string, added up before the shuffle.
    Both ways are exact but for collisions of 64-bit hashes that meet in anchor and content. So most strings are settled by
    hashes; factor arrays are made for the zones that differ.

    Texts are hashed once and written with their zones, and never shuffled; four passes read from these what they need. Between the
    passes stand sorted hash arrays in the checkpoint folder (repeated anchors, repeated zones, bits of zones), and a task sends an anchor or zone once, however often it
    stands in its texts. A NULL text is empty; keys are integers, NULL last in order; rows that repeat a key and a text
    are documents of their own, except that with ``keep_first`` they count as one place; an empty table gives no rows.
    """
    if not anchor <= length <= anchor + 191:
        raise ValueError("a zone has at most 192 strings: anchor <= length <= anchor + 191")
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    shards = shard_count(source)
    folder = new_folder(docs.sparkSession, "repeats")

    def run(sent: DataFrame) -> None:
        sent.agg(F.sum("n")).collect()

    # Hashing is most of the work: it is done once, and what it finds is written beside the texts.
    zoned = stage(source.mapInArrow(lambda b: _zone_rows(b, length, anchor), _WITH_ZONES), "repeat-texts")
    anchors = zoned.select("anchor").mapInArrow(lambda b: batches_of(_send_anchors(b, shards)), BLOB)
    run(to_shards(anchors, shards).mapInArrow(lambda b: batches_of(_save_anchors(b, folder)), BLOB))
    zones = zoned.select("id", "low", "anchor", "key").mapInArrow(lambda b: batches_of(_send_zones(b, shards, folder)), BLOB)
    for _ in range(2):
        zones = to_shards(zones, shards).mapInArrow(lambda b: batches_of(_save_zones(b, shards, folder)), BLOB)
    run(zones.filter("kind = 4"))

    # Staged, as both ways below read it; only bytes around the ends of matches.
    opened = stage(
        zoned.mapInArrow(
            lambda b: _open_zones(b, length, shards, folder),
            "anchor long, key long, bytes binary, hot boolean, document long, place long",
        ),
        "repeat-zones",
    )
    ordered = (
        opened.filter("not hot")
        .repartition(shards, "anchor")
        .sortWithinPartitions("anchor", "key", "document", "place")
        .mapInArrow(lambda b: _ordered_bits(b, length, shards, keep_first), _BITS)
    )
    # Of a zone that several blocks have sent, the first.
    first_of = F.min(F.struct("document", "place", "bytes")).alias("z")
    busy = opened.filter("hot").groupBy("key").agg(first_of).select("key", "z.*")
    strings = busy.mapInArrow(
        lambda b: _strings(b, length), "h1 long, h2 long, key long, step long, document long, place long"
    )
    where = F.struct("document", "place")
    counted = strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(where).alias("first")).filter("n > 1")
    repeated = strings.join(counted, ["h1", "h2"]).filter(where != F.col("first") if keep_first else F.lit(True))
    hashed = repeated.select("key", "step").mapInArrow(lambda b: _string_bits(b, shards), _BITS)
    bits = ordered.unionByName(hashed).groupBy("shard", "key").agg(*(F.bit_or(c).alias(c) for c in ("b0", "b1", "b2")))
    written = bits.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(lambda b: _save_bits(b, folder), "n long")
    run(written)

    out = StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text)
    schema = StructType([docs.select(F.col(key).cast("long").alias("id")).schema["id"], *out])
    cut = zoned.select("id", "text", "low", "n", "key").mapInArrow(lambda b: _cut(b, length, shards, folder, keep_first, ["id"], with_text), schema)
    return cut.withColumnRenamed("id", key)
