"""Sequential choices over the rows of a key, by composing step functions.

Some rules go through the rows of a key in order with one number as state: a row
raises it to the first of the row's own values that is not below it. That is a
rising step function of the state, and so is the effect of many rows after one
another. ``states_before`` composes the rows of a block into one function, the
blocks' functions into one of the next higher level, and then hands the states
down again, so that a key of any size is spread over its blocks and the number
of jobs only follows the number of levels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.session import stage

#: Rows whose functions one task composes.
WIDTH = 256
_ITEM = "place long, upto array<long>, gives array<long>"


def compose(functions: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One function for several after one another.

    A function (upto, gives) takes a state to ``gives`` at the first place whose ``upto`` is not below the state, and
    leaves a state above all of them as it is.
    """
    functions = [(np.asarray(u, dtype=np.int64), np.asarray(g, dtype=np.int64)) for u, g in functions]
    upto = np.unique(np.concatenate([u for u, _ in functions] or [np.zeros(0, dtype=np.int64)]))
    state = upto.copy()
    for u, g in functions:
        at = np.searchsorted(u, state)
        inside = at < len(u)
        state[inside] = g[at[inside]]
    # Neighbouring steps of equal height are one step.
    ends = np.append(state[1:] != state[:-1], True) if len(state) else np.zeros(0, dtype=bool)
    return upto[ends], state[ends]


def apply(upto: np.ndarray, gives: np.ndarray, state: int) -> int:
    at = int(np.searchsorted(upto, state))
    return int(gives[at]) if at < len(upto) else state


def states_before(items: DataFrame, key: str, start: int, width: int = WIDTH) -> DataFrame:
    """The state before every item of ``items`` (key, place, upto, gives): key, place, before.

    ``place`` orders the items of a key and is not negative; all keys begin with the state ``start``.
    """
    kind = dict(items.dtypes)[key]
    blocks = items.select(key, "place", F.expr(f"place div {width}").alias("block"), "upto", "gives")
    highest = items.agg(F.max("place")).first()[0]

    def handed_down(pdf: pd.DataFrame) -> pd.DataFrame:
        before = []
        for first, state, upto, gives in zip(_opens(pdf, key), pdf["state"], pdf["upto"], pdf["gives"]):
            now = int(state) if first else now
            before.append(now)
            now = apply(upto, gives, now)
        return pd.DataFrame({key: pdf[key], "place": pdf["place"], "before": np.array(before, dtype=np.int64)})

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.flatnonzero(_opens(pdf, key))
        parts = [list(zip(pdf["upto"].iloc[a:b], pdf["gives"].iloc[a:b])) for a, b in zip(at, [*at[1:], len(pdf)])]
        upto, gives = zip(*map(compose, parts))
        return pd.DataFrame({key: pdf[key].to_numpy()[at], "place": pdf["block"].to_numpy()[at], "upto": upto, "gives": gives})

    if highest is None or highest < width:
        blocks = blocks.withColumn("state", F.lit(start).cast("long"))
    else:
        whole = stage(_by_blocks(blocks, key, composed, f"{key} {kind}, {_ITEM}"), "composed")
        above = states_before(whole, key, start, width).select(key, F.col("place").alias("block"), F.col("before").alias("state"))
        blocks = blocks.join(above, [key, "block"])
    return _by_blocks(blocks, key, handed_down, f"{key} {kind}, place long, before long")


def _opens(pdf: pd.DataFrame, key: str) -> np.ndarray:
    """Rows, in order, that begin another block."""
    names, numbers = pdf[key].to_numpy(), pdf["block"].to_numpy()
    return np.append(True, (names[1:] != names[:-1]) | (numbers[1:] != numbers[:-1]))


def _by_blocks(blocks: DataFrame, key: str, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` over whole blocks in order, many at a time: most hold few rows, and a call for each would cost more than its work."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_block = []
        for pdf in frames:
            if not len(pdf):
                continue
            pdf = pd.concat([*open_block, pdf], ignore_index=True)
            # The last block may go on in the next batch.
            cut = int(np.flatnonzero(_opens(pdf, key))[-1])
            if cut:
                yield run(pdf.iloc[:cut].reset_index(drop=True))
            open_block = [pdf.iloc[cut:]]
        if open_block:
            yield run(open_block[0].reset_index(drop=True))

    return blocks.repartition(key, "block").sortWithinPartitions(key, "block", "place").mapInPandas(batches, schema)
