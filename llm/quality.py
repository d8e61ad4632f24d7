"""Text quality by a small convolutional network over bytes, in numpy.

Bytes are embedded; filters eight bytes wide slide over the whole text in steps of
four, beside a channel that tells whether the bytes there stood a short distance
before as well. Filter outputs are averaged in chunks of 64 bytes that overlap by
half, a second layer reads each chunk, and its outputs are pooled over all chunks,
by maximum and by mean, and combined into one probability. All weights are learnt.

Training uses a bounded sample of labelled rows; a long training text lends it
evenly spaced pieces. Scoring reads every text whole, in parts of bounded size.

Nulls and odd rows: null and empty texts count as one chunk of padding and get its
score; repeated rows score alike; rows without a label or with a null id are
scored but not learnt from; with labels of one class only, all scores are that
class's; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import stage, text_column
from llm.toxicity import labelled_sample

#: Labelled rows of each class that are learnt from, and bytes of each, at most.
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 8192
EPOCHS = 5
BATCH = 32
RATE = 0.01
SEED = 11
#: A score from which a text counts as good.
THRESHOLD = 0.3

EMBED, FILTERS, HIDDEN = 6, 12, 16
STEP, BLOCK = 4, 32
PER_BLOCK = BLOCK // STEP
#: Distances at which repetition is looked for, and its length.
LAGS = range(2, 41)
RUN = 8
PART_BYTES = 1 << 20


def padded(text: bytes) -> bytes:
    """Zeros up to whole blocks, two at least."""
    blocks = max(2, -(-len(text) // BLOCK))
    return text + bytes(blocks * BLOCK - len(text))


def repetition(data: np.ndarray) -> np.ndarray:
    """At every step: 1 where the ``RUN`` bytes from there on stood at one of the distances before."""
    longest = LAGS[-1]
    wide = np.concatenate([np.zeros(longest, dtype=np.uint8), data, np.zeros(RUN, dtype=np.uint8)])
    grams = np.lib.stride_tricks.as_strided(wide, (len(wide) - RUN + 1, RUN), (1, 1))
    count = len(data) // STEP
    here = np.ascontiguousarray(grams[longest : longest + len(data) : STEP]).view(np.uint64).ravel()
    found = np.zeros(count, dtype=bool)
    words = [np.ascontiguousarray(grams[k : k + len(data) + longest : STEP]).view(np.uint64).ravel() for k in range(STEP)]
    for lag in LAGS:
        at = longest - lag
        found |= here == words[at % STEP][at // STEP : at // STEP + count]
    return (found & (here != 0)).astype(np.float32)


class Network:
    def __init__(self, seed: int = SEED):
        random = np.random.default_rng(seed)
        normal = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
        width = STEP * EMBED
        self.p = {
            "embed": normal(256, EMBED, scale=0.5), "near": normal(width, FILTERS, scale=0.25), "far": normal(width, FILTERS, scale=0.25),
            "again": normal(FILTERS, scale=0.5), "b1": np.zeros(FILTERS, np.float32), "mid": normal(FILTERS, HIDDEN, scale=0.4),
            "b2": np.zeros(HIDDEN, np.float32), "out": normal(2 * HIDDEN, scale=0.2), "b3": np.zeros(1, np.float32),
        }

    def chunks(self, data: np.ndarray, last: np.ndarray) -> tuple:
        """Second-layer outputs of the chunks; ``last``: the last step of every text."""
        p = self.p
        x = p["embed"][data].reshape(-1, STEP * EMBED)
        after = np.empty_like(x)
        after[:-1] = x[1:]
        after[last] = np.tile(p["embed"][0], STEP)
        again = repetition(data)
        first = x @ p["near"] + after @ p["far"] + again[:, None] * p["again"] + p["b1"]
        np.maximum(first, 0, out=first)
        blocks = first.reshape(-1, PER_BLOCK, FILTERS).sum(axis=1)
        pairs = (blocks[:-1] + blocks[1:]) / (2 * PER_BLOCK)
        second = np.maximum(pairs @ p["mid"] + p["b2"], 0)
        return x, after, again, first, pairs, second

    def pool(self, text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """Largest and summed outputs over all chunks of a text, and their number, part by part."""
        high, total, count = np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN), 0
        data = np.frombuffer(padded(text), dtype=np.uint8)
        for start in range(0, len(data) - BLOCK, PART_BYTES):
            # A part sees two blocks before it and one behind its last chunk, so its edges do not show.
            low = max(0, start - 2 * BLOCK)
            part = data[low : start + PART_BYTES + 2 * BLOCK]
            own = min(PART_BYTES, len(data) - BLOCK - start) // BLOCK
            first = (start - low) // BLOCK
            second = self.chunks(part, np.array([len(part) // STEP - 1]))[-1][first : first + own]
            high = np.maximum(high, second.max(axis=0))
            total += second.sum(axis=0)
            count += len(second)
        return high, total, count

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities; short texts are run side by side."""
        pooled = np.zeros((len(texts), 2 * HIDDEN), np.float32)
        held: list[int] = []
        size = 0

        def run() -> None:
            batch = [padded(texts[i]) for i in held]
            ends = np.cumsum([len(b) for b in batch])
            second = self.chunks(np.frombuffer(b"".join(batch), dtype=np.uint8), ends // STEP - 1)[-1]
            heads, counts = self._spans(ends)
            rows = self._within(second, ends)
            pooled[held, :HIDDEN] = np.maximum.reduceat(rows, heads, axis=0)
            pooled[held, HIDDEN:] = np.add.reduceat(rows, heads, axis=0) / counts[:, None]
            held.clear()

        for i, text in enumerate(texts):
            if len(text) > PART_BYTES // 2:
                high, total, count = self.pool(text)
                pooled[i] = np.concatenate([high, (total / count).astype(np.float32)])
                continue
            held.append(i)
            size += len(text) + BLOCK
            if size > PART_BYTES // 2:
                run()
                size = 0
        if held:
            run()
        return 1 / (1 + np.exp(-np.clip(pooled.astype(np.float64) @ self.p["out"] + self.p["b3"], -30, 30)))

    @staticmethod
    def _spans(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First chunk and number of chunks of each text, among the chunks within texts."""
        counts = np.diff(np.concatenate([[0], ends])) // BLOCK - 1
        return np.cumsum(counts) - counts, counts

    @staticmethod
    def _inside(ends: np.ndarray) -> np.ndarray:
        """Chunks that do not reach from one text into the next."""
        inside = np.ones(ends[-1] // BLOCK - 1, dtype=bool)
        inside[ends[:-1] // BLOCK - 1] = False
        return inside

    def _within(self, second: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return second[self._inside(ends)]

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> tuple[dict, float]:
        batch = [padded(t) for t in texts]
        ends = np.cumsum([len(b) for b in batch])
        data, last = np.frombuffer(b"".join(batch), dtype=np.uint8), ends // STEP - 1
        x, after, again, first, pairs, second = self.chunks(data, last)
        p, inside = self.p, self._inside(ends)
        rows, (heads, counts) = second[inside], self._spans(ends)
        owner = np.repeat(np.arange(len(texts)), counts)
        high = np.maximum.reduceat(rows, heads, axis=0)
        pooled = np.hstack([high, np.add.reduceat(rows, heads, axis=0) / counts[:, None]])
        probability = 1 / (1 + np.exp(-np.clip(pooled @ p["out"] + p["b3"], -30, 30)))
        loss = -(weight * np.log(np.where(y == 1, probability, 1 - probability) + 1e-9)).sum()
        error = (weight * (probability - y)).astype(np.float32)
        g = {"out": pooled.T @ error, "b3": error.sum(keepdims=True)}
        to_pool = error[:, None] * p["out"][None, :]
        # The maximum passes its gradient to the first chunk that reached it.
        is_high = rows == high[owner]
        earlier = np.cumsum(is_high, axis=0)
        before = np.concatenate([np.zeros((1, HIDDEN), earlier.dtype), earlier])[heads]
        is_high &= earlier - before[owner] == 1
        d_rows = to_pool[owner, HIDDEN:] / counts[owner, None] + np.where(is_high, to_pool[owner, :HIDDEN], 0)
        d_second = np.zeros_like(second)
        d_second[inside] = d_rows
        d_second *= second > 0
        g["mid"], g["b2"] = pairs.T @ d_second, d_second.sum(axis=0)
        d_pairs = d_second @ p["mid"].T / (2 * PER_BLOCK)
        d_blocks = np.zeros((len(pairs) + 1, FILTERS), np.float32)
        d_blocks[:-1] += d_pairs
        d_blocks[1:] += d_pairs
        d_first = np.repeat(d_blocks, PER_BLOCK, axis=0) * (first > 0)
        g["near"], g["far"], g["again"], g["b1"] = x.T @ d_first, after.T @ d_first, again @ d_first, d_first.sum(axis=0)
        d_x, d_after = d_first @ p["near"].T, d_first @ p["far"].T
        edge = d_after[last].sum(axis=0).reshape(STEP, EMBED).sum(axis=0)
        d_after[last] = 0
        d_x[1:] += d_after[:-1]
        flat = d_x.reshape(-1, EMBED)
        g["embed"] = np.stack([np.bincount(data, flat[:, k], minlength=256) for k in range(EMBED)], axis=1).astype(np.float32)
        g["embed"][0] += edge
        return g, float(loss)

    def train(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        random = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        steps, total = 0, epochs * max(1, len(texts) // BATCH)
        for _ in range(epochs):
            order = random.permutation(len(texts))
            for part in np.array_split(order, max(1, len(order) // BATCH)):
                g, _ = self.gradients([texts[i] for i in part], y[part], weight[part] / weight[part].sum())
                steps += 1
                rate = RATE * min(1.0, 1.2 - steps / total)
                for k, v in g.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    self.p[k] -= rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.99**steps)) + 1e-6)


def piece_of(text: bytes, limit: int = SAMPLE_BYTES) -> bytes:
    """The text, or evenly spaced pieces of it that make up ``limit`` bytes."""
    if len(text) <= limit:
        return text
    size = limit // 8
    return b"".join(text[a : a + size] for a in np.linspace(0, len(text) - size, 8).astype(int))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS) -> Network:
    """A network learnt from at most ``rows`` labelled rows of each class, with the classes weighed as in the labels."""
    sample = labelled_sample(docs, labels, "quality", learn, rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [piece_of((t.as_py() or "").encode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, pa.binary()), batch.column(2)], ["doc_id", "piece", "y"])

    chosen = stage(sample.select("doc_id", "text", F.col("y").cast("int").alias("y")).mapInArrow(cut, "doc_id long, piece binary, y int"), "quality-sample")
    held = sorted(chosen.collect())
    shares = dict(labels.where(learn & F.col("quality").isin(0, 1)).groupBy("quality").count().collect())
    network = Network()
    y = np.array([r.y for r in held], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        network.p["out"][:] = 0
        network.p["b3"][:] = 20.0 * (2 * y[0] - 1) if len(y) else 0.0
        return network
    in_sample = np.array([(y == 0).sum(), (y == 1).sum()])
    weight = np.array([shares.get(0, 0), shares.get(1, 0)]) / in_sample
    network.train([bytes(r.piece) for r in held], y, weight[y.astype(int)].astype(np.float32))
    return network


def scores(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id and score of every row."""
    kept = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = kept.value.score([t.as_py().encode() for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")
