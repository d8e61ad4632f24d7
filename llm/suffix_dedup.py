"""Removal of repeated 50-byte strings by a depth-limited radix sort of suffixes.

Every start of a 50-byte string is a suffix of which only 50 bytes count. The
sort works from the most significant digit on and keeps to groups of more than
one document, since a suffix that stands alone can't be a repeated string:

* The first digit is content-defined: the smallest hash among the 26-byte runs
  inside the 50 bytes, with its place in them. Neighbouring suffixes share it, so
  one entry stands for a dozen suffixes. Entries meet by digit; those whose digit
  occurs in one document only are settled without their bytes being moved.
* Suffixes of the other entries are sent, with their bytes, to the task of their
  digit, and ordered there by further digits of eight bytes. Each pass splits the
  groups; what is left alone is dropped; after the last pass a group holds exactly
  the equal strings, and all but those of its smallest doc_id are repeats.

Both steps first settle what they can among the documents at hand and then send
one entry per distinct digit or string, so a passage that a third of all
documents share sends one entry per portion of text, not one per document.

Nulls and odd rows: a null or short text loses nothing; rows with a null doc_id
neither lose bytes nor make others lose them; rows with equal doc_id are parts
of one document, which do not affect each other; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import short_lived_shuffles, stage, text_column

LENGTH = 50
RUN = 26
SPAN = LENGTH - RUN + 1
DIGIT = 8
#: Bytes of text handled at a time, and per portion that meets in one task.
BYTES_AT_ONCE = 1 << 20
PORTION = 1 << 22
ENTRY_PORTION = 1 << 25

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = {n: np.uint64(pow(_BASE, n, 1 << 64)) for n in (1, 2, 4, 8, 10)}


def run_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``RUN`` bytes from each place on, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    size = 1
    kept = {}
    while size * 2 <= RUN:
        h = h[: len(h) - size] * _POWERS[size] + h[size:]
        size *= 2
        kept[size] = h
    n = len(data) - RUN + 1
    # 26 = 16 + 8 + 2
    out = (kept[16][:n] * _POWERS[8] + kept[8][16 : 16 + n]) * _POWERS[2] + kept[2][24 : 24 + n]
    out ^= out >> np.uint64(33)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per start of a string: place of its smallest run (leftmost), and the hash there; worked out piece by piece."""
    starts = len(data) - LENGTH + 1
    place, hashes = np.empty(starts, dtype=np.int64), np.empty(starts, dtype=np.uint64)
    for a in range(0, starts, BYTES_AT_ONCE):
        b = min(starts, a + BYTES_AT_ONCE)
        low = run_hashes(data[a : b + LENGTH - 1])
        offset = np.zeros(len(low), dtype=np.uint8)
        for step in (1, 2, 4, 8, SPAN - 16):
            left, right = low[: len(low) - step], low[step:]
            smaller = right < left
            offset = np.where(smaller, offset[step:] + np.uint8(step), offset[: len(offset) - step])
            low = np.where(smaller, right, left)
        place[a:b], hashes[a:b] = np.arange(a, b) + offset, low
    return place, hashes


class Strings:
    """Texts of several documents side by side, with the runs of suffixes that share their first digit."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        if len(self.data) < LENGTH:
            self.first = self.count = self.text = self.place = np.zeros(0, dtype=np.int64)
            self.hash = np.zeros(0, dtype=np.uint64)
            return
        place, hashes = anchors(self.data)
        # A start within the last 49 bytes of a text has no string of its own.
        tails = (self.bounds[1:, None] - np.arange(1, LENGTH)[None, :]).ravel()
        place[tails[(tails >= 0) & (tails < len(place))]] = -1
        text_starts = self.bounds[:-1][self.bounds[:-1] < len(place)]
        new = np.ones(len(place), dtype=bool)
        new[1:] = place[1:] != place[:-1]
        new[text_starts] = True
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(place)))
        valid = place[first] >= 0
        self.first, self.count = first[valid], count[valid]
        self.place, self.hash = place[self.first], hashes[self.first]
        self.text = np.searchsorted(self.bounds, self.first, side="right") - 1


def portions(texts: Iterator[tuple], limit: int = BYTES_AT_ONCE) -> Iterator[list[tuple]]:
    """(key, base, bytes) in lists of about ``limit`` bytes; longer texts are cut with an overlap of 49 bytes."""
    held, size = [], 0
    for key, text in texts:
        for base in range(0, max(1, len(text) - LENGTH + 1), limit):
            part = text[base : base + limit + LENGTH - 1] if len(text) > limit else text
            held.append((key, base, part))
            size += len(part)
            if size >= limit:
                yield held
                held, size = [], 0
            if len(text) <= limit:
                break
    if held:
        yield held


def _group_starts(*columns: np.ndarray) -> np.ndarray:
    """Start of every run of equal rows in sorted columns."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def several_documents(digits: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose digit occurs in more than one document, and the order by digit."""
    order = np.argsort(digits, kind="stable")
    starts = _group_starts(digits[order])
    low, high = np.minimum.reduceat(docs[order], starts), np.maximum.reduceat(docs[order], starts)
    several = np.zeros(len(digits), dtype=bool)
    several[order] = np.repeat(low < high, np.diff(np.append(starts, len(order))))
    return several, order


def repeats(data: np.ndarray, starts: np.ndarray, digit: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Suffixes equal through ``LENGTH`` bytes to one of a smaller document: most significant digit first."""
    repeated = np.zeros(len(starts), dtype=bool)
    if not len(starts):
        return repeated
    rows = np.argsort(digit, kind="stable")
    group = digit[rows]
    for depth in range(0, LENGTH + DIGIT, DIGIT):
        heads = _group_starts(group)
        sizes = np.diff(np.append(heads, len(rows)))
        # A group of one suffix, or of one document, has no repeat.
        low, high = np.minimum.reduceat(docs[rows], heads), np.maximum.reduceat(docs[rows], heads)
        alive = low < high
        if depth >= LENGTH:
            repeated[rows] = docs[rows] > np.repeat(low, sizes)
            break
        keep = np.repeat(alive, sizes)
        rows, sizes = rows[keep], sizes[alive]
        if not len(rows):
            break
        heads = np.cumsum(sizes) - sizes
        number = np.repeat(np.arange(len(sizes)), sizes)
        width = min(DIGIT, LENGTH - depth)
        bytes_ = np.zeros((len(rows), DIGIT), dtype=np.uint8)
        bytes_[:, :width] = data[starts[rows, None] + np.arange(depth, depth + width)]
        value = bytes_.view(np.uint64).ravel()
        differs = value != np.repeat(value[heads], sizes)
        if differs.any():
            mixed = np.zeros(len(sizes), dtype=bool)
            mixed[number[differs]] = True
            at = np.flatnonzero(mixed[number])
            sort = at[np.lexsort((value[at], number[at]))]
            rows[at], value[at] = rows[sort], value[sort]
        new = np.zeros(len(rows), dtype=np.int64)
        new[_group_starts(number, value)] = 1
        group = np.cumsum(new)
    return repeated


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


def whole_repeats(data: np.ndarray, start: np.ndarray, count: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Runs of suffixes equal, byte for byte, to a whole run of a smaller document: all their suffixes repeat."""
    settled = np.zeros(len(start), dtype=bool)
    if not len(start):
        return settled
    size = count + LENGTH - 1
    key = np.zeros(len(start), dtype=np.uint64)
    powers = _powers(_BASE, int(size.max()))
    for part in _slices(len(start)):
        place = _expand(np.zeros(len(part), dtype=np.int64), size[part])
        weighted = (data[_expand(start[part], size[part])].astype(np.uint64) + np.uint64(1)) * powers[place]
        key[part] = np.add.reduceat(weighted, np.cumsum(size[part]) - size[part]) ^ size[part].astype(np.uint64)
    order = np.lexsort((docs, key))
    heads = _group_starts(key[order])
    head = np.repeat(order[heads], np.diff(np.append(heads, len(order))))
    later = docs[order] > docs[head]
    row, head = order[later], head[later]
    for part in _slices(len(row)):
        a, b = row[part], head[part]
        same = size[a] == size[b]
        a, b = a[same], b[same]
        if len(a):
            equal = data[_expand(start[a], size[a])] == data[_expand(start[b], size[a])]
            settled[a] = np.logical_and.reduceat(equal, np.cumsum(size[a]) - size[a])
    return settled


def _slices(n: int, rows: int = 1 << 14) -> list[np.ndarray]:
    """Places of 0 to n in portions that bound the memory of what is gathered for them."""
    return [np.arange(a, min(n, a + rows)) for a in range(0, n, rows)]


def hashes_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Run hashes at some places only."""
    out = np.zeros(len(places), dtype=np.uint64)
    for part in _slices(len(places)):
        out[part] = run_hashes(data[places[part][:, None] + np.arange(RUN)].ravel())[::RUN]
    return out


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, … for each run."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(first, count)


def _digit(hashes: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return hashes + offset.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


# ---- first digit: entries that occur in several documents -------------------------------------------------------

_LOW = np.uint64((1 << 40) - 1)
_NO_DOC = np.iinfo(np.int64).min


def _pack(hashes: np.ndarray, docs: np.ndarray, first: np.ndarray) -> bytes:
    low = hashes & _LOW
    return b"".join([
        np.int64(len(docs)).tobytes(), low.astype(np.uint32).tobytes(), (low >> np.uint64(32)).astype(np.uint8).tobytes(),
        docs.astype(np.int64).tobytes(), first.astype(np.uint32).tobytes(),
    ])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    low = np.frombuffer(blob, np.uint32, n, 8).astype(np.uint64) | np.frombuffer(blob, np.uint8, n, 8 + 4 * n).astype(np.uint64) << np.uint64(32)
    return low, np.frombuffer(blob, np.int64, n, 8 + 5 * n), np.frombuffer(blob, np.uint32, n, 8 + 13 * n).astype(np.int64)


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(buckets):
        return
    order = np.argsort(buckets, kind="stable")
    heads = _group_starts(buckets[order])
    for a, b in zip(heads, np.append(heads[1:], len(order))):
        yield int(buckets[order[a]]), order[a:b]


_BLOBS = "bucket long, kind int, blob binary"
ASK, KNOWN = 0, 1


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    buckets, kinds, blobs = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"]
    )


def _entries(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1))
            for part in portions((d, t.as_py().encode()) for d, t in pairs):
                ids = np.array([k for k, _, _ in part], dtype=np.int64)
                bases = np.array([b for _, b, _ in part], dtype=np.int64)
                strings = Strings([t for _, _, t in part])
                owner = ids[strings.text]
                first = bases[strings.text] + strings.first - strings.bounds[strings.text]
                rows: list[tuple] = []
                if len(owner):
                    known, order = several_documents(strings.hash, owner)
                    if known.any():
                        rows.append((int(strings.hash[0] % np.uint64(buckets)), KNOWN, _pack(strings.hash[known], owner[known], first[known])))
                    # One entry for a digit that is known to repeat: it only tells others.
                    heads = np.zeros(len(owner), dtype=bool)
                    heads[order[_group_starts(strings.hash[order])]] = True
                    ask = np.flatnonzero(~known | heads)
                    told = np.where(known, _NO_DOC, owner)
                    for bucket, at in _by_bucket((strings.hash[ask] % np.uint64(buckets)).astype(np.int64)):
                        at = ask[at]
                        rows.append((bucket, ASK, _pack(strings.hash[at] // np.uint64(buckets), told[at], first[at])))
                yield _blobs(rows)

    return docs.mapInArrow(run, _BLOBS)


def _surviving(entries: DataFrame) -> DataFrame:
    """(doc_id, first) of entries whose digit occurs in another document too."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        blobs = table.column("blob").to_pylist()
        asked = [_unpack(b) for b, k in zip(blobs, kinds) if k == ASK]
        found = [_unpack(b)[1:] for b, k in zip(blobs, kinds) if k == KNOWN]
        if asked:
            digits, docs, first = (np.concatenate(c) for c in zip(*asked))
            several, _ = several_documents(digits, docs)
            several &= docs != _NO_DOC
            found.append((docs[several], first[several]))
        docs, first = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "first": pa.array(first, pa.int64())})

    return entries.groupBy("bucket").applyInArrow(run, "doc_id long, first long")


# ---- further digits: the bytes of the remaining suffixes --------------------------------------------------------


def _pack_strings(offsets, docs, tags, first, count, data) -> bytes:
    """Entries with the bytes of their suffixes, laid end to end."""
    return b"".join([
        np.int64(len(docs)).tobytes(), docs.astype(np.int64).tobytes(), tags.astype(np.uint32).tobytes(),
        first.astype(np.uint32).tobytes(), offsets.astype(np.uint8).tobytes(), count.astype(np.uint8).tobytes(), data.tobytes(),
    ])


def _unpack_strings(blob: bytes) -> tuple:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    at, out = 8, []
    for kind in (np.int64, np.uint32, np.uint32, np.uint8, np.uint8):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return *out, np.frombuffer(blob, np.uint8, offset=at)


def _tagged(pairs: Iterator[tuple], texts: pa.Table) -> Iterator[tuple]:
    """(doc_id, bytes, tag): texts of a repeated doc_id are told apart by a checksum, others have tag 0.

    All rows of a doc_id are in one group, so both users of the groups agree.
    """
    counted = texts.column("doc_id").value_counts()
    several = {c["values"].as_py() for c in counted if c["counts"].as_py() > 1}
    for doc, raw in pairs:
        yield doc, raw, crc32(raw) if doc in several else 0


_FOUND = "doc_id long, tag long, first long, last long"


def _runs(mask: np.ndarray, docs, tags, first, count) -> pa.Table:
    """Marked suffixes of the entries as (doc_id, tag, first, last)."""
    owner = np.repeat(np.arange(len(count)), count)
    place = _expand(first, count)
    at = np.flatnonzero(mask)
    owner, place = owner[at], place[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1 if len(at) else heads
    who = owner[heads]
    return pa.table({
        "doc_id": pa.array(docs[who].astype(np.int64)), "tag": pa.array(tags[who].astype(np.int64)),
        "first": pa.array(place[heads].astype(np.int64)), "last": pa.array(place[tails].astype(np.int64)),
    })


def _strings(docs: DataFrame, surviving: DataFrame, buckets: int, groups: int) -> DataFrame:
    """Surviving entries with their bytes by bucket, and the repeats already seen within a group of documents."""

    def run(texts: pa.Table, entries: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if entries.num_rows:
            ids, first = entries.column("doc_id").to_numpy(), entries.column("first").to_numpy()
            order = np.lexsort((first, ids))
            ids, first = ids[order], first[order]
            named = np.unique(ids)
            pairs = zip(texts.column("doc_id").to_pylist(), texts.column("text"))
            chosen = ((d, t.as_py().encode()) for d, t in pairs if (i := np.searchsorted(named, d)) < len(named) and named[i] == d)
            tagged = (((d, tag), t) for d, t, tag in _tagged(chosen, texts))
            for part in portions(tagged, PORTION):
                rows += local(part, ids, first)
        return pa.Table.from_batches([_blobs(rows)])

    def local(part: list[tuple], ids: np.ndarray, first: np.ndarray) -> list[tuple]:
        owners = np.array([k[0] for k, _, _ in part], dtype=np.int64)
        tags = np.array([k[1] for k, _, _ in part], dtype=np.uint32)
        bases = np.array([b for _, b, _ in part], dtype=np.int64)
        strings = Strings([t for _, _, t in part])
        keep = np.zeros(len(strings.first), dtype=bool)
        begin = bases[strings.text] + strings.first - strings.bounds[strings.text]
        heads = _group_starts(strings.text) if len(strings.text) else []
        for a, b in zip(heads, np.append(heads[1:], len(strings.text))):
            low, high = np.searchsorted(ids, [owners[strings.text[a]], owners[strings.text[a]] + 1])
            keep[a:b] = np.isin(begin[a:b], first[low:high])
        if not keep.any():
            return []
        text, start, count = strings.text[keep], strings.first[keep], strings.count[keep]
        hashes, offset, begin = strings.hash[keep], strings.place[keep] - start, begin[keep]
        docs_, tags_ = owners[text], tags[text]
        every = _expand(start, count)
        owner = np.repeat(np.arange(len(count)), count)
        seen = whole_repeats(strings.data, start, count, docs_)[owner]
        fresh = np.flatnonzero(~seen)
        digit = _digit(hashes[owner[fresh]], strings.place[keep][owner[fresh]] - every[fresh])
        seen[fresh] = repeats(strings.data, every[fresh], digit, docs_[owner[fresh]])
        out = []
        if seen.any():
            found = _runs(seen, docs_, tags_, begin, count)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, found.schema) as writer:
                writer.write_table(found)
            out.append((int(hashes[0] % np.uint64(buckets)), KNOWN, sink.getvalue().to_pybytes()))
        # What is left of an entry: from its first to its last suffix that is not settled yet.
        ends = np.cumsum(count)
        position = np.arange(len(every)) - np.repeat(ends - count, count)
        low = np.minimum.reduceat(np.where(seen, 1 << 20, position), ends - count)
        high = np.maximum.reduceat(np.where(seen, -1, position), ends - count)
        open_ = np.flatnonzero(low <= high)
        for bucket, at in _by_bucket((hashes[open_] % np.uint64(buckets)).astype(np.int64)):
            at = open_[at]
            size = high[at] - low[at] + 1
            data = strings.data[_expand(start[at] + low[at], size + LENGTH - 1)]
            # Offset of the smallest run from the first suffix that is sent; the digit of suffix i has offset - i.
            out.append((bucket, ASK, _pack_strings(offset[at] - low[at], docs_[at], tags_[at], begin[at] + low[at], size, data)))
        return out

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))

    return keyed(docs).groupBy("g").cogroup(keyed(surviving).groupBy("g")).applyInArrow(run, _BLOBS)


def _repeated(strings: DataFrame) -> DataFrame:
    """(doc_id, tag, first, last) of runs of suffixes that repeat one of a smaller document."""

    def run(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        out = [pa.ipc.open_stream(b).read_all() for b, k in zip(blobs, kinds) if k == KNOWN]
        asked = [_unpack_strings(b) for b, k in zip(blobs, kinds) if k == ASK]
        if asked:
            docs, tags, first, offset, count, data = (np.concatenate(c) for c in zip(*asked))
            first, count, offset = first.astype(np.int64), count.astype(np.int64), offset.astype(np.int64)
            lengths = count + LENGTH - 1
            start = np.cumsum(lengths) - lengths
            whole = whole_repeats(data, start, count, docs)
            out.append(_runs(np.ones(count[whole].sum(), dtype=bool), docs[whole], tags[whole], first[whole], count[whole]))
            docs, tags, first, count, offset, start = (x[~whole] for x in (docs, tags, first, count, offset, start))
            hashes = hashes_at(data, start + offset)
            every = _expand(start, count)
            owner = np.repeat(np.arange(len(count)), count)
            digit = _digit(hashes[owner], offset[owner] - (every - start[owner]))
            out.append(_runs(repeats(data, every, digit, docs[owner]), docs, tags, first, count))
        return pa.concat_tables(out)

    return strings.groupBy("bucket").applyInArrow(run, _FOUND)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,last:long>>"


def _cut(docs: DataFrame, repeated: DataFrame, groups: int) -> DataFrame:
    """Per row of ``docs``: what stays and the removed spans (first and last byte)."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        ids, tags = found.column("doc_id").to_numpy(), found.column("tag").to_numpy()
        order = np.lexsort((tags, ids))
        ids, tags = ids[order], tags[order]
        first, last = found.column("first").to_numpy()[order], found.column("last").to_numpy()[order]
        rows = []
        pairs = zip(texts.column("doc_id").to_pylist(), texts.column("text"))
        for doc, raw, tag in _tagged(((d, t.as_py().encode()) for d, t in pairs), texts):
            low = high = 0
            if doc is not None and len(ids):
                low, high = np.searchsorted(ids, [doc, doc + 1])
                if low < high:
                    low, high = low + np.searchsorted(tags[low:high], [tag, tag + 1])
            if low == high:
                rows.append((doc, len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), []))
                continue
            edge = np.zeros(len(raw) + 1, dtype=np.int32)
            np.add.at(edge, first[low:high], 1)
            np.add.at(edge, last[low:high] + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            change = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
            begins, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
            kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
            spans = [{"first": int(a), "last": int(b) - 1} for a, b in zip(begins, ends)]
            rows.append((doc, len(raw), int(gone.sum()), len(begins), hashlib.sha256(kept).hexdigest(), spans))
        columns = list(zip(*rows)) if rows else [[] for _ in range(6)]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    # Rows without an id have nothing to look up; their text spreads them.
    left = docs.withColumn("g", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text"))), F.lit(groups)))
    right = repeated.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    return left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(run, _RESULT)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans of removed bytes."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Portions of the text that meet in one task; their number follows the input.
    portions_, entry_buckets = max(32, total // PORTION), max(32, total // ENTRY_PORTION)
    named = texts.where("doc_id IS NOT NULL")
    with short_lived_shuffles(docs.sparkSession):
        surviving = stage(_surviving(_entries(named.where(F.octet_length("text") >= LENGTH), entry_buckets)), "repeated-digits")
        repeated = stage(_repeated(_strings(named, surviving, portions_, portions_)), "repeated-strings")
    return _cut(texts, repeated, portions_)


SQL = f"""
WITH texts AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, {2 * LENGTH}) AS w
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS p FROM texts)),
smallest AS (SELECT w, MIN(doc_id) AS owner FROM windows GROUP BY w HAVING MIN(doc_id) < MAX(doc_id)),
starts AS (SELECT doc_id, p FROM windows JOIN smallest USING (w) WHERE doc_id > owner),
marked AS (
  SELECT doc_id, p, CASE WHEN p - LAG(p) OVER (PARTITION BY doc_id ORDER BY p) <= {LENGTH} THEN 0 ELSE 1 END AS fresh FROM starts),
numbered AS (SELECT doc_id, p, SUM(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS no FROM marked),
spans AS (SELECT doc_id, no, MIN(p) AS a, MAX(p) + {LENGTH} AS z FROM numbered GROUP BY doc_id, no),
pieces AS (
  SELECT doc_id, no, a, z, COALESCE(LAG(z) OVER (PARTITION BY doc_id ORDER BY no), 0) AS y FROM spans),
kept AS (
  SELECT doc_id, CAST(SUM(z - a) AS BIGINT) AS n_removed, COUNT(*) AS n_spans, MAX(z) AS tail,
    string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY no) AS heads
  FROM pieces JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, COALESCE(n_removed, 0) AS n_removed, COALESCE(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN tail IS NULL THEN h ELSE heads || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""
