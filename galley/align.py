"""Line alignment of two versions of many documents at once.

The lines of both versions are matched by longest common blocks, as a unified
diff does: the longest block of equal lines first, then the same left and right
of it. A document of up to ``REGION`` lines is one region and aligned in one task.
A longer one is first cut in rounds, over all such documents together: lines that
occur once in either version of a region are paired, pairs next to each other on
a diagonal form runs, and the longest run splits the region, until the regions
are small or hold no such line. Repeated lines make no pairs in these rounds.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.scan import prev, running_sum, scan
from galley.session import stage

#: Lines of either version that one task aligns.
REGION = 4096
_REGION = ["doc_id", "alo", "blo"]
_BLOCK = "doc_id long, i long, j long, size long"


def _placed(lines: DataFrame, regions: DataFrame, name: str, low: str, high: str) -> DataFrame:
    """Lines with their region; regions don't overlap, and the smaller side of the join is the regions."""
    inside = (F.col(name) >= F.col(low)) & (F.col(name) < F.col(high))
    return lines.join(regions, "doc_id").where(inside).select(*[F.col(c).alias(c) for c in (*regions.columns, name, "text")])


def _runs(pairs: DataFrame) -> DataFrame:
    """Runs of pairs (i, j) that follow one another on a diagonal, per region: i, j, size."""
    keyed = pairs.withColumn("diagonal", F.col("j") - F.col("i"))
    order = ["doc_id", "alo", "blo", "diagonal"]
    counted = scan(keyed, order, ["i"], ranged=True, _no=running_sum(F.lit(1)))
    return counted.groupBy(*order, (F.col("i") - F.col("_no")).alias("_run")).agg(
        F.min("i").alias("i"), F.min("j").alias("j"), F.count(F.lit(1)).alias("size")
    )


def _split(large: DataFrame, old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: blocks found, and the regions left and right of them or, where nothing pairs, the region as ended."""
    def single(lines, name, low, high):
        held = _placed(lines, large, name, low, high)
        return held.groupBy(*_REGION, "text").agg(F.min(name).alias(name), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")

    pairs = single(old, "i", "alo", "ahi").join(single(new, "j", "blo", "bhi"), [*_REGION, "text"]).drop("text")
    runs = _runs(stage(pairs, "single-lines"))
    best = runs.groupBy(*_REGION).agg(F.max(F.struct("size", -F.col("i"), -F.col("j"))).alias("b"))
    best = stage(best.select(*_REGION, (-F.col("b.col2")).alias("i"), (-F.col("b.col3")).alias("j"), F.col("b.size").alias("size")), "longest-runs")
    cut = large.join(best, _REGION, "left")
    ends = F.struct(F.col("alo"), F.col("ahi"), F.col("blo"), F.col("bhi"), F.lit(True).alias("ended"))
    left = F.struct(F.col("alo"), F.col("i").alias("ahi"), F.col("blo"), F.col("j").alias("bhi"), F.lit(False).alias("ended"))
    right = F.struct((F.col("i") + F.col("size")).alias("alo"), F.col("ahi"), (F.col("j") + F.col("size")).alias("blo"), F.col("bhi"), F.lit(False).alias("ended"))
    parts = cut.select("doc_id", F.inline(F.when(F.col("size").isNull(), F.array(ends)).otherwise(F.array(left, right))))
    return best.select("doc_id", "i", "j", "size"), parts.where("alo < ahi AND blo < bhi")


def _aligned(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """Blocks of one region that one task holds."""
    if not len(old) or not len(new):
        return pd.DataFrame({"doc_id": [], "i": [], "j": [], "size": []}, dtype="int64")
    old, new = old.sort_values("i"), new.sort_values("j")
    found = SequenceMatcher(None, old["text"].tolist(), new["text"].tolist()).get_matching_blocks()[:-1]
    first, second = int(old["i"].iloc[0]), int(new["j"].iloc[0])
    return pd.DataFrame(
        [(old["doc_id"].iloc[0], first + i, second + j, size) for i, j, size in found], columns=["doc_id", "i", "j", "size"]
    ).astype("int64")


def matching_blocks(old: DataFrame, new: DataFrame, region: int = REGION) -> DataFrame:
    """Blocks of equal lines: doc_id, i, j, size, in order on both sides.

    ``old`` has (doc_id, i, text), ``new`` (doc_id, j, text), lines numbered from 0 without gaps; a null text is empty.
    A region of more than ``region`` lines without a line that occurs once on both sides has no block.
    """
    old = stage(old.select("doc_id", F.col("i").cast("long").alias("i"), F.coalesce("text", F.lit("")).alias("text")), "old-lines")
    new = stage(new.select("doc_id", F.col("j").cast("long").alias("j"), F.coalesce("text", F.lit("")).alias("text")), "new-lines")
    sizes = old.groupBy("doc_id").agg(F.max("i").alias("a")).join(new.groupBy("doc_id").agg(F.max("j").alias("b")), "doc_id")
    zero = F.lit(0).cast("long")
    regions = stage(sizes.select("doc_id", zero.alias("alo"), (F.col("a") + 1).alias("ahi"), zero.alias("blo"), (F.col("b") + 1).alias("bhi")), "regions")
    is_small = (F.col("ahi") - F.col("alo") <= region) & (F.col("bhi") - F.col("blo") <= region)
    small, large, blocks = regions.where(is_small), regions.where(~is_small), None
    while not large.isEmpty():
        found, parts = _split(large, old, new)
        parts = stage(parts, "regions")
        blocks = found if blocks is None else blocks.unionByName(found)
        small = small.unionByName(parts.where(is_small).drop("ended"))
        large = parts.where(~is_small & ~F.col("ended")).drop("ended")
    small = small.select("doc_id", "alo", "ahi", "blo", "bhi")
    held = _placed(old, small, "i", "alo", "ahi").groupBy(*_REGION)
    inside = held.cogroup(_placed(new, small, "j", "blo", "bhi").groupBy(*_REGION)).applyInPandas(_aligned, _BLOCK)
    return inside if blocks is None else blocks.unionByName(inside)


def edit_script(old: DataFrame, new: DataFrame, region: int = REGION) -> DataFrame:
    """Every line of both versions in the order of a diff: doc_id, place, op (' ', '-', '+'), i, j, text.

    ``i`` and ``j`` are the lines that stand next on the two sides; ``place`` is their sum, which rises by line. Removed
    lines stand before the added ones that replace them.
    """
    blocks = stage(matching_blocks(old, new, region), "matching-blocks")
    # An empty block at the end of both sides closes what follows the last one.
    counts = old.select("doc_id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(new.select("doc_id", F.lit(0).alias("a"), F.lit(1).alias("b")))
    ends = counts.groupBy("doc_id").agg(F.sum("a").alias("i"), F.sum("b").alias("j")).withColumn("size", F.lit(0).cast("long"))
    bounds = blocks.unionByName(ends.select("doc_id", "i", "j", "size"))
    gaps = scan(bounds, ["doc_id"], ["i", "j"], ranged=True, done_i=prev(F.col("i") + F.col("size")), done_j=prev(F.col("j") + F.col("size")))
    gaps = stage(gaps.select("doc_id", F.coalesce("done_i", F.lit(0)).alias("alo"), F.coalesce("done_j", F.lit(0)).alias("blo"), "i", "j", "size"), "gaps")
    pieces = gaps.select("doc_id", F.inline(F.array(
        F.struct(F.lit("-").alias("op"), F.col("alo").alias("first"), F.col("i").alias("past"), F.col("blo").alias("other")),
        F.struct(F.lit("+").alias("op"), F.col("blo").alias("first"), F.col("j").alias("past"), F.col("i").alias("other")),
        F.struct(F.lit(" ").alias("op"), F.col("i").alias("first"), (F.col("i") + F.col("size")).alias("past"), F.col("j").alias("other")),
    ))).where("first < past")
    # A long piece is unfolded in portions, so that no row grows into a whole document.
    portion = F.explode(F.sequence(F.expr("first div 4096"), F.expr("(past - 1) div 4096"))).alias("portion")
    unfolded = pieces.select("*", portion).withColumn("n", F.explode(F.sequence(F.greatest("first", F.expr("portion * 4096")), F.least(F.col("past") - 1, F.expr("portion * 4096 + 4095")))))
    other = F.when(F.col("op") == " ", F.col("other") + F.col("n") - F.col("first")).otherwise(F.col("other"))
    is_new = F.col("op") == "+"
    rows = unfolded.select("doc_id", "op", F.when(is_new, other).otherwise(F.col("n")).alias("i"), F.when(is_new, F.col("n")).otherwise(other).alias("j"))
    left = rows.where("op <> '+'").join(old.select("doc_id", F.col("i").cast("long").alias("i"), "text"), ["doc_id", "i"])
    right = rows.where("op = '+'").join(new.select("doc_id", F.col("j").cast("long").alias("j"), "text"), ["doc_id", "j"])
    return left.unionByName(right).withColumn("place", F.col("i") + F.col("j"))
