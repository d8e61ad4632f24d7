"""Language-model scores by an interpolated modified Kneser-Ney model of any order from 2 on.

Portions. Workers hash words to 64 bits and keep a portion of text as its distinct
words and, per token, the place of its word among them. The shards of words count
each word and number it, frequent words first, so that all that follows are small
numbers; from here on no text is read.

Counting and asking are one step. A portion sends its distinct n-grams of the highest
order, with their counts in the texts to learn from, to the shards of their histories;
frequent histories are also split by their word. A shard adds up what all portions
send and answers each with the counts of its n-grams and the figures of its histories
(how often followed, by how many words once, twice, more often). To the shards of the
next lower order it passes how many different words stand before an n-gram; that is
its count there. So no table of n-grams is written, and none travels twice. The figures
of the bounded number of frequent histories are added up by the driver.

Scoring. Portions meet their answers and add up the log probabilities of their
texts. No worker ever holds the whole model.

    p(w|uv) = (c(uvw) - D(c(uvw))) / c(uv) + g(uv) p(w|v)
    p(w|v)  = (n(vw) - D'(n(vw))) / n(v) + g(v) p(w)
    p(w)    = (n(w) - d(n(w))) / n + g / (V + 1)

with n(..) the number of different words before, and V + 1 for unseen words. As many
start marks as a history has words stand before a text.

Nulls and odd rows: a null text is empty and has one token, the end; a null
doc_id counts as an empty id for the split and is scored; repeated rows count and
score each; with nothing to learn from, all words are equally likely; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import discard, short_lived_shuffles, stage, stage_split, text_column

#: Order of the registered query.
ORDER = 3
#: Bytes of text of a portion, and those that a shard of n-grams and one of words stand for.
PORTION = 1 << 23
SHARD = 1 << 23
WORD_SHARD = 1 << 24
#: Bytes that workers hash at a time.
BYTES_AT_ONCE = 1 << 22
#: Histories with more than this share of a sample of the texts are split over so many shards. The sample
#: (texts by their place) only decides where rows go; all counts are over all rows.
HOT_SHARE = 1 / 2000
HOT_SAMPLE = 64
SPLIT = np.uint64(64)

_BASE = 0xD6E8FEB86659FD93
_MIX = np.uint64(0xFF51AFD7ED558CCD)
END = np.uint64(0x5851F42D4C957F2D)
#: Number of the start mark; those of words follow.
START = 0
#: Kinds of the rows that a step gives.
ANSWER, PASSED, TALLY = 0, 1, 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in lower-cased bytes."""
    space = np.concatenate([[True], _SPACE[data], [True]])
    change = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = change[::2], change[1::2]
    # Sums of bytes times powers of an odd number, counted from the end of a word backwards.
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data))[::-1])])
    return starts, _mixed((sums[ends] - sums[starts]) * _powers(pow(_BASE, -1, 1 << 64), len(data) + 1)[len(data) - ends])


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, each text's words and then one end, and the number of tokens per text."""
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    starts, hashes, low = [], [], 0
    while low < len(data):
        high = low + BYTES_AT_ONCE
        while high < len(data) and not _SPACE[data[high]]:
            high += 1
        at, found = _word_hashes(data[low:high])
        starts.append(at + low)
        hashes.append(found)
        low = high
    starts, hashes = np.concatenate(starts), np.concatenate(hashes)
    words = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])))
    out = np.full(len(hashes) + len(texts), END)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(texts)), words)] = hashes
    return out, words + 1


def _pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mixed(u * np.uint64(0x9E3779B97F4A7C15) ^ w)


def _dump(value) -> bytes:
    """Arrays in one value; most of their bytes are small numbers, which shrink well."""
    return zstandard.compress(pickle.dumps(value, 5), 1)


def _load(blob: bytes):
    return pickle.loads(zstandard.decompress(blob))


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in order and their places, equal ones in the order of places; sorted as one number each where both fit."""
    bits = len(keys).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits > 64:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    both = np.sort(keys.astype(np.uint64) << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64))
    return both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers in order, the first place of each, and the place of each number among them."""
    keys, order = _sorted(keys)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return keys[new], order[new], place


def _by(shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each shard, in their order."""
    shards, order = _sorted(shards)
    heads = np.flatnonzero(np.diff(shards.astype(np.int64), prepend=-1))
    for a, b in zip(heads, np.append(heads[1:], len(order))):
        yield int(shards[a]), order[a:b]


def _planes(x: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers as planes of their bytes, as many as the largest needs."""
    x = np.ascontiguousarray(x, dtype="<u8")
    width = (int(x.max(initial=0)).bit_length() + 7) // 8
    return len(x), x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(planes: tuple[int, bytes]) -> np.ndarray:
    size, data = planes
    out = np.zeros((size, 8), dtype=np.uint8)
    if data:
        out[:, : len(data) // size] = np.frombuffer(data, dtype=np.uint8).reshape(-1, size).T
    return out.reshape(-1).view("<u8")


def _table(names_kinds: dict, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(names_kinds)
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, names_kinds.values())], names=list(names_kinds))


_LONG, _BLOB = pa.int64(), pa.binary()
_SENT = {"shard": _LONG, "g": _LONG, "blob": _BLOB}
_SENT_SCHEMA = "shard long, g long, blob binary"
_GIVEN = {"kind": pa.int32(), **_SENT, "figures": pa.list_(_LONG)}
_GIVEN_SCHEMA = f"kind int, {_SENT_SCHEMA}, figures array<long>"


def _portions(docs: DataFrame) -> DataFrame:
    """Portions of the rows ``(doc_id, held_out, train, asked, text)``: their number, bytes of text, and one value with words and tokens."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        ids, held, train, asked, texts = zip(*rows)
        tokens, counts = token_hashes(list(texts))
        words, _, place = _distinct(tokens)
        # Frequent words get small places, which shrink better.
        order = np.argsort(-np.bincount(place), kind="stable")
        rank = np.empty(len(words), dtype=np.int64)
        rank[order] = np.arange(len(words))
        words, place = words[order], rank[place]
        learnt = np.bincount(place[np.repeat(np.array(train, dtype=bool), counts)], minlength=len(words))
        blob = _dump((ids, held, np.array(train, dtype=bool), any(asked), _planes(counts), _planes(place), words, _planes(learnt)))
        return pa.RecordBatch.from_arrays([pa.array([sum(map(len, texts))], _LONG), pa.array([blob], _BLOB)], ["size", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for *row, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((*row, text.encode()))
                size += len(rows[-1][-1])
                if size >= PORTION:
                    yield packed(rows)
                    rows, size = [], 0
        if rows:
            yield packed(rows)

    rows = docs.select("doc_id", "held_out", "train", "asked", "text").mapInArrow(run, "size long, blob binary")
    return rows.withColumn("g", F.monotonically_increasing_id())


def _numbered(portions: DataFrame, shards: int) -> DataFrame:
    """For every portion and shard of words, the words' numbers and counts; once a shard, how many tokens and words there are to learn from."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, blob in zip(*(batch.column(c).to_pylist() for c in ("g", "blob"))):
                *_, words, learnt = _load(blob)
                learnt = _numbers(learnt)
                rows = [(s, g, _dump((words[at], _planes(learnt[at])))) for s, at in _by((words % np.uint64(shards)).astype(np.int64))]
                yield from _table(_SENT, rows).to_batches()

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        parts = [_load(b) for b in table.column("blob").to_pylist()]
        words, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        count = np.bincount(place, weights=np.concatenate([_numbers(p[1]) for p in parts])).astype(np.int64)
        rank = np.empty(len(words), dtype=np.int64)
        rank[np.lexsort((words, -count))] = np.arange(len(words))
        number = rank * shards + shard + 1
        rows = [(TALLY, shard, None, None, [int(count.sum()), int((count > 0).sum())])]
        ends = np.cumsum([len(p[0]) for p in parts])
        for g, end, part in zip(table.column("g").to_pylist(), ends, parts):
            at = place[end - len(part[0]) : end]
            rows.append((ANSWER, shard, g, _dump((_planes(number[at]), _planes(count[at]))), None))
        return _table(_GIVEN, rows)

    return portions.select("g", "blob").mapInArrow(sent, _SENT_SCHEMA).groupBy("shard").applyInArrow(run, _GIVEN_SCHEMA)


def _coded(portions: DataFrame, numbered: DataFrame, shards: int) -> DataFrame:
    """Portions with the numbers and counts of their words, which are put in the order of the numbers."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table({"g": _LONG, "blob": _BLOB}, [])
        *docs, place, words, _ = _load(table.column("blob")[0].as_py())
        number, count = np.zeros(len(words), dtype=np.uint64), np.zeros(len(words), dtype=np.uint64)
        replies = dict(zip(answers.column("shard").to_pylist(), answers.column("blob").to_pylist()))
        for shard, at in _by((words % np.uint64(shards)).astype(np.int64)):
            number[at], count[at] = map(_numbers, _load(replies[shard]))
        order = np.argsort(number)
        rank = np.empty(len(words), dtype=np.uint64)
        rank[order] = np.arange(len(words))
        blob = _dump((*docs, _planes(rank[_numbers(place).astype(np.int64)]), _planes(np.diff(number[order], prepend=np.uint64(0))), _planes(count[order])))
        return _table({"g": _LONG, "blob": _BLOB}, [(table.column("g")[0].as_py(), blob)])

    rows = numbered.select("shard", "g", "blob")
    return portions.select("g", "blob").groupBy("g").cogroup(rows.groupBy("g")).applyInArrow(run, "g long, blob binary")


class _Portion:
    """A coded portion: documents, tokens as places among its words, and its distinct n-grams by order."""

    def __init__(self, blob: bytes):
        self.ids, self.held, self.train, self.asked, counts, tokens, numbers, known = _load(blob)
        self.counts, self.known = _numbers(counts).astype(np.int64), _numbers(known).astype(np.int64)
        #: Place 0 is the start mark's.
        self.tokens = _numbers(tokens).astype(np.int64) + 1
        self.numbers = np.append(np.uint64(START), np.cumsum(_numbers(numbers), dtype=np.uint64))
        self.heads = np.cumsum(self.counts) - self.counts

    def grams(self, order: int) -> Iterator[tuple]:
        """From order 2 on: each token's history and n-gram, and of the distinct n-grams in order the history (by its place) and word,
        and the columns of numbers of the histories. Place 0 of histories is that of start marks only."""
        here, columns = self.tokens, [self.numbers]
        for n in range(2, order + 1):
            before = np.empty_like(here)
            before[1:] = here[:-1]
            before[self.heads] = 0
            span = len(self.numbers)
            _, first, here = _distinct(before * span + self.tokens)
            histories, words = before[first], self.tokens[first]
            yield n, before, here, histories, words, columns
            columns = [np.append(np.uint64(START), c) for c in (*(c[histories] for c in columns), self.numbers[words])]
            here = here + 1


def _history(columns: list[np.ndarray]) -> np.ndarray:
    """Histories, given by the numbers of their words, in 48 bits; only tells where rows go."""
    out = _mixed(columns[0] + np.uint64(1))
    for column in columns[1:]:
        out = _pair(out, column)
    return out >> np.uint64(16)


def _shards(u: np.ndarray, w: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
    part = np.where(np.isin(u, hot), w % SPLIT, np.uint64(0))
    return (_mixed(u * SPLIT + part) % np.uint64(shards)).astype(np.int64)


def frequent(coded: DataFrame, order: int) -> np.ndarray:
    """Histories (48 bits) that hold a large share of a sample's tokens; at most 1 / ``HOT_SHARE`` of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                portion = _Portion(blob.as_py())
                step = max(1, min(HOT_SAMPLE, len(portion.counts) // 8))
                sample = np.arange(len(portion.counts)) % step == step // 2
                chosen = np.repeat(sample, portion.counts)
                portion.tokens, portion.counts = portion.tokens[chosen], portion.counts[sample]
                portion.heads = np.cumsum(portion.counts) - portion.counts
                for _, before, _, _, _, columns in portion.grams(order):
                    number = np.bincount(before, minlength=len(columns[0]))
                    large = number > HOT_SHARE * number.sum() / 4
                    keys = _history([c[large] for c in columns]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(number[large] / max(1, number.sum()))], ["history", "share"])

    found = coded.select("blob").mapInArrow(run, "history long, share double").groupBy("history").agg(F.max("share").alias("share"))
    rows = found.where(F.col("share") > HOT_SHARE).orderBy(F.col("share").desc(), "history").limit((order - 1) * int(1 / HOT_SHARE)).collect()
    starts = [_history([np.array([START], dtype=np.uint64)] * n)[0] for n in range(1, order)]
    return np.unique(np.array([*(r.history for r in rows), *starts], dtype=np.uint64))


def _packed(histories: list[np.ndarray], w: np.ndarray, number: np.ndarray) -> bytes:
    """N-grams in the order of their histories, each of which is kept once."""
    change = np.zeros(len(w), dtype=bool)
    change[:1] = True
    for column in histories:
        change[1:] |= column[1:] != column[:-1]
    heads = np.flatnonzero(change)
    first, *others = (c[heads] for c in histories)
    columns = [np.diff(first, prepend=np.uint64(0)), *others]
    return _dump(([_planes(c) for c in columns], _planes(np.diff(np.append(heads, len(w)))), _planes(w), _planes(number)))


def _unpacked(blob: bytes) -> tuple:
    (first, *others), *rest = _load(blob)
    return [np.cumsum(_numbers(first), dtype=np.uint64), *map(_numbers, others)], *map(_numbers, rest)


def _key(columns: list[np.ndarray]) -> np.ndarray:
    """Rows of numbers as one number each, in the same order."""
    key = columns[0]
    for column in columns[1:]:
        span = int(column.max(initial=0)) + 1
        if (int(key.max(initial=0)) + 1) * span >= 1 << 64:
            key = _distinct(key)[2].astype(np.uint64)
        key = key * np.uint64(span) + column
    return key


def _sent(coded: DataFrame, n: int, order: int, shards: int, hot: np.ndarray) -> DataFrame:
    """The portions' distinct n-grams of order ``n`` by shard, those of the highest order with their counts. A ``g`` below 0 asks nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, blob in zip(*(batch.column(c).to_pylist() for c in ("g", "blob"))):
                portion = _Portion(blob)
                if n < order and not portion.asked:
                    continue
                for _, _, here, histories, words, columns in portion.grams(n):
                    pass
                learnt = np.repeat(portion.train, portion.counts) if n == order else np.zeros(len(here), dtype=bool)
                number = np.bincount(here[learnt], minlength=len(words))
                w, rows = portion.numbers[words], []
                for shard, at in _by(_shards(_history(columns)[histories], w, shards, hot)):
                    rows.append((shard, g if portion.asked else -1, _packed([c[histories[at]] for c in columns], w[at], number[at])))
                    if len(rows) == 256:
                        yield from _table(_SENT, rows).to_batches()
                        rows = []
                yield from _table(_SENT, rows).to_batches()

    return coded.select("g", "blob").mapInArrow(run, _SENT_SCHEMA)


def _counted(sent: DataFrame, n: int, shards: int, word_shards: int, hot: np.ndarray) -> DataFrame:
    """Per shard the answers to the portions, what the next lower order gets, and tallies: of counts 1 to 4, and the figures of split histories."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpacked(b) for b in table.column("blob").to_pylist()]
        columns = [np.concatenate(c) for c in zip(*(p[0] for p in parts))]
        _, first, history = _distinct(_key(columns))
        columns = [c[first] for c in columns]
        owner = np.repeat(history, np.concatenate([p[1] for p in parts]).astype(np.int64))
        w = np.concatenate([p[2] for p in parts])
        _, first, place = _distinct(_key([owner.astype(np.uint64), w]))
        count = np.bincount(place, weights=np.concatenate([p[3] for p in parts])).astype(np.int64)
        owner, w = owner[first], w[first]
        size = len(columns[0])
        figures = [np.bincount(owner, weights=count, minlength=size).astype(np.int64)]
        figures += [np.bincount(owner[x], minlength=size) for x in (count == 1, count == 2, count > 2)]
        rows: list[tuple] = [(TALLY, -1, None, None, [int((count == i).sum()) for i in range(1, 5)])]
        keys = _history(columns)
        for i in np.flatnonzero(np.isin(keys, hot)):
            rows.append((TALLY, int(keys[i]), None, None, [int(f[i]) for f in figures]))
        grams = histories = 0
        for g, part in zip(table.column("g").to_pylist(), parts):
            of_grams, of_histories = place[grams : grams + len(part[2])], history[histories : histories + len(part[1])]
            grams, histories = grams + len(of_grams), histories + len(of_histories)
            if g >= 0:
                blob = _dump((_planes(count[of_grams]), [_planes(f[of_histories]) for f in figures]))
                rows.append((ANSWER, table.column("shard")[0].as_py(), g, blob, None))
        seen = count > 0
        owner, w = owner[seen], w[seen]
        if n > 2:
            lower = [c[owner] for c in columns[1:]]
            _, first, same = _distinct(_key([*lower, w]))
            lower, w, number = [c[first] for c in lower], w[first], np.bincount(same)
            for to, at in _by(_shards(_history(lower), w, shards, hot)):
                rows.append((PASSED, to, -1, _packed([c[at] for c in lower], w[at], number[at]), None))
        else:
            w, number = np.unique(w, return_counts=True)
            for to, at in _by((w % np.uint64(word_shards)).astype(np.int64)):
                rows.append((PASSED, to, -1, _dump((_planes(w[at]), _planes(number[at]))), None))
        return _table(_GIVEN, rows)

    return sent.groupBy("shard").applyInArrow(run, _GIVEN_SCHEMA)


def _sent_words(coded: DataFrame, shards: int) -> DataFrame:
    """The portions' words by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, blob in zip(*(batch.column(c).to_pylist() for c in ("g", "blob"))):
                portion = _Portion(blob)
                w = portion.numbers[1:] if portion.asked else portion.numbers[:0]
                rows = [(s, g, _dump((_planes(w[at]), _planes(np.zeros(len(at)))))) for s, at in _by((w % np.uint64(shards)).astype(np.int64))]
                yield from _table(_SENT, rows).to_batches()

    return coded.select("g", "blob").mapInArrow(run, _SENT_SCHEMA)


def _counted_words(sent: DataFrame) -> DataFrame:
    """Per shard of words the answers (how many different words stand before each), and tallies of counts 1 to 4, over 2, and all."""

    def run(table: pa.Table) -> pa.Table:
        parts = [tuple(map(_numbers, _load(b))) for b in table.column("blob").to_pylist()]
        _, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        count = np.bincount(place, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
        rows = [(TALLY, -1, None, None, [*(int((count == i).sum()) for i in range(1, 5)), int((count > 2).sum()), int(count.sum())])]
        ends = np.cumsum([len(p[0]) for p in parts])
        for g, end, part in zip(table.column("g").to_pylist(), ends, parts):
            if g >= 0:
                rows.append((ANSWER, table.column("shard")[0].as_py(), g, _dump(_planes(count[place[end - len(part[0]) : end]])), None))
        return _table(_GIVEN, rows)

    return sent.groupBy("shard").applyInArrow(run, _GIVEN_SCHEMA)


def discounts(tally: list[int]) -> list[float]:
    """Discounts for counts of one, two, and more, from how many counts are 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (max(1, t) for t in tally[:4])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [float(min(max(d, 0.1), 0.95 * (i + 1))) for i, d in enumerate(raw)]


def _sums(tallies: DataFrame, size: int) -> dict[int, list[int]]:
    """Tallies added up; bounded: one row, and one per frequent history."""
    rows = tallies.groupBy("shard").agg(*[F.sum(F.col("figures")[i]) for i in range(size)]).collect()
    return {r[0]: list(r[1:]) for r in rows}


@dataclass
class Model:
    """A model is given by the texts it learns from and its order; their n-grams are counted together with those that are asked for."""

    texts: DataFrame
    order: int


def train(docs: DataFrame, order: int = 2) -> Model:
    return Model(docs.select(text_column().cast("string").alias("text")), order)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORED = dict(zip(
    (c.split()[0] for c in _SCORES.split(", ")), (_LONG, pa.bool_(), _LONG, _LONG, _LONG, pa.float64(), pa.float64())
))


def _scored(coded: DataFrame, answers: DataFrame, order: int, total: int, types: int, tallies: dict, shards: int, word_shards: int, hot: np.ndarray) -> DataFrame:
    upper, split = {}, {}
    for n in range(2, order + 1):
        upper[n] = discounts(tallies[n].get(-1, [0] * 4))
        keys = np.array(sorted(k for k in tallies[n] if k >= 0), dtype=np.uint64)
        split[n] = keys, np.array([tallies[n][int(k)] for k in keys], dtype=np.float64).reshape(-1, 4)
    *low, more, n_all = tallies[1].get(-1, [0] * 6)
    lower = discounts(low)
    rest = (lower[0] * low[0] + lower[1] * low[1] + lower[2] * more) / n_all if n_all else 1.0

    def cut(count: np.ndarray, by: list[float]) -> np.ndarray:
        return np.array([0.0, *by])[np.minimum(count, 3).astype(np.int64)]

    def run(table: pa.Table, answered: pa.Table) -> pa.Table:
        portion = _Portion(table.column("blob")[0].as_py()) if table.num_rows else None
        if portion is None or not portion.asked:
            return _table(_SCORED, [])
        replies = {(k, s): b for k, s, b in zip(*(answered.column(c).to_pylist() for c in ("n", "shard", "blob")))}
        before = np.zeros(len(portion.numbers) - 1)
        for shard, at in _by((portion.numbers[1:] % np.uint64(word_shards)).astype(np.int64)):
            before[at] = _numbers(_load(replies[1, shard]))
        p = (before - cut(before, lower)) / max(1, n_all) + rest / (types + 1)
        probability = p[portion.tokens - 1]
        for n, history, here, histories, words, columns in portion.grams(order):
            number, figures = np.zeros(len(words)), np.zeros((len(columns[0]), 4))
            keys = _history(columns)
            for shard, at in _by(_shards(keys[histories], portion.numbers[words], shards, hot)):
                counts, of_histories = _load(replies[n, shard])
                number[at] = _numbers(counts)
                of = histories[at]
                figures[of[np.flatnonzero(np.diff(of, prepend=-1))]] = np.stack([_numbers(f) for f in of_histories], axis=1)
            if len(split[n][0]):
                place = np.minimum(np.searchsorted(split[n][0], keys), len(split[n][0]) - 1)
                there = split[n][0][place] == keys
                figures[there] = split[n][1][place[there]]
            follows = figures[:, 0]
            left = np.where(follows > 0, figures[:, 1:] @ np.array(upper[n]) / np.maximum(follows, 1), 1.0)
            own = (number - cut(number, upper[n])) / np.maximum(follows, 1)[histories]
            probability = own[here] + left[history] * probability
        count = portion.known[portion.tokens - 1]
        base, heads = np.log10((count + 1) / (total + (types + 1))), portion.heads
        columns = (
            list(portion.ids), list(portion.held), portion.counts, np.add.reduceat((count > 0).astype(np.int64), heads),
            np.full(len(heads), total, dtype=np.int64), np.add.reduceat(base, heads), np.add.reduceat(np.log10(probability), heads),
        )
        return pa.table([pa.array(c, k) for c, k in zip(columns, _SCORED.values())], names=list(_SCORED))

    return coded.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(run, _SCORES)


def _scores(docs: DataFrame, order: int) -> DataFrame:
    """Scores of the rows ``(doc_id, held_out, train, asked, text)`` that are asked for, by a model of those to train on."""
    with short_lived_shuffles(docs.sparkSession):
        portions = stage(_portions(docs), "lm-portions")
        total = portions.agg(F.sum("size")).first()[0] or 0
        shards, word_shards = max(32, total // SHARD), max(32, total // WORD_SHARD)
        numbered, sizes = stage_split(_numbered(portions, word_shards), "kind", [ANSWER, TALLY], "lm-words")
        tokens, types = (s or 0 for s in sizes.agg(F.sum(F.col("figures")[0]), F.sum(F.col("figures")[1])).first())
        coded = stage(_coded(portions, numbered, word_shards), "lm-coded")
        for table in (portions, numbered, sizes):
            discard(table)
        hot, answers, tallies, passed = frequent(coded, order), [], {}, None
        for n in range(order, 0, -1):
            sent = _sent(coded, n, order, shards, hot) if n > 1 else _sent_words(coded, word_shards)
            if passed is not None:
                sent = sent.unionByName(passed.select("shard", "g", "blob"))
            given = _counted(sent, n, shards, word_shards, hot) if n > 1 else _counted_words(sent)
            kinds = [ANSWER, TALLY, PASSED] if n > 1 else [ANSWER, TALLY]
            answered, tally, *below = stage_split(given, "kind", kinds, "lm-counts")
            answers.append(answered.select(F.lit(n).alias("n"), "shard", "g", "blob"))
            tallies[n] = _sums(tally, 4 if n > 1 else 6)
            for table in [tally] + ([passed] if passed is not None else []):
                discard(table)
            passed = below[0] if below else None
    whole = answers[0]
    for more in answers[1:]:
        whole = whole.unionByName(more)
    return _scored(coded, whole, order, tokens, types, tallies, shards, word_shards, hot)


def _rows(docs: DataFrame, held_out: Column, trains: Column) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), trains.alias("train"), F.lit(True).alias("asked"),
        text_column().cast("string").alias("text"),
    )


def scores(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score."""
    none = F.lit(None)
    learnt = model.texts.select(
        none.cast("long").alias("doc_id"), none.cast("boolean").alias("held_out"), F.lit(True).alias("train"), F.lit(False).alias("asked"), "text"
    )
    return _scores(_rows(docs, held_out, F.lit(False)).unionByName(learnt), model.order)


def split_scores(docs: DataFrame, held_out: Column, order: int = 2) -> DataFrame:
    """What ``scores`` gives by a model of the rows that are not held out; these are counted and asked for at once."""
    return _scores(_rows(docs, held_out, ~F.coalesce(held_out, F.lit(False))), order)
