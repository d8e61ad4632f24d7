"""Mixing sources to target weights by systematic sampling.

Sources take shares of all words by weight, but at most three times their own
size; what they cannot take goes to the others by weight. Each document of a
source then has target / source size expected copies. Walking through a source
in a fixed order, the running sum of expected copies plus one offset per source
gains a copy for every whole number it passes.

Documents are walked by size, so the words taken stay close to the target. The
running sum is a rank times a rate in fixed-point numbers: exact, and free of a
task per source. Ranks come from row numbers within (source, size class, id
residue) and offsets of these blocks, so a source of any size is spread.

Nulls and odd rows: a null text has size 0 and takes 0 words; null is a source
of its own, ordered last; repeated rows count each; an empty table gives an
empty result; further columns are ignored by ``shares`` and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import stage, words_pattern

CAP = 3
WEIGHTS = 3
RESIDUES = 256
SEED = "mix-1"
ONE = 1 << 40


def source_key() -> Column:
    """The source with a leading letter that puts null, a source of its own, last."""
    return F.when(F.col("source").isNull(), "z").otherwise(F.concat(F.lit("a"), F.col("source").cast("string")))


def size_column() -> Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(words_pattern)), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target, rate and offset (both fixed point): one row per source key."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source"))
    ranked = totals.select("source", "source_size", ((F.row_number().over(by_name) - 1) % WEIGHTS + 1).alias("weight"))
    ranked = ranked.withColumn("cap", F.col("source_size") * CAP)
    # Sources by how soon they reach the cap: the level if this source and all after it are not capped.
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    levels = ranked.withColumn("level", left.cast("double") / F.sum("weight").over(after))
    open_level = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    levels = levels.withColumn("open_level", F.max(open_level).over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("open_level") * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.lit(float(ONE)))).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}|"), F.col("source"))), 1, 10), 16, 10)
    return levels.withColumn("target", target).select(
        "source", "source_size", "target", rate.cast("decimal(20,0)").alias("rate"), offset.cast("decimal(20,0)").alias("offset")
    )


def _blocks(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Size class and id residue: the blocks that a source is walked in."""
    return rows.select(
        *keep, "source", "size",
        F.floor(F.sqrt(F.col("size").cast("double"))).alias("size_class"),
        F.pmod(F.coalesce("id", F.lit(0)), F.lit(RESIDUES)).alias("residue"),
    )


def _walked(docs: DataFrame, keep: list[str]) -> DataFrame:
    narrow = stage(
        docs.select(F.col("doc_id").cast("long").alias("id"), source_key().alias("source"), size_column().alias("size")),
        "sizes",
    )
    target = stage(targets(narrow), "targets")
    counts = _blocks(narrow, []).groupBy("source", "size_class", "residue").count()
    up_to = Window.partitionBy("source").orderBy("size_class", "residue").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source", "size_class", "residue", F.coalesce(F.sum("count").over(up_to), F.lit(0)).alias("start"))
    starts = stage(starts.join(target, "source"), "mix-blocks")

    within = Window.partitionBy("source", "size_class", "residue").orderBy(F.col("id").asc_nulls_first(), "size")
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), source_key().alias("source"), size_column().alias("size")
    )
    rows = _blocks(rows, ["id", *keep]).withColumn("local", F.row_number().over(within))
    placed = rows.join(starts, ["source", "size_class", "residue"]).withColumn("rank", (F.col("start") + F.col("local")).cast("decimal(16,0)"))
    passed = [
        F.expr(f"CAST(((rank - {back}) * rate + offset) AS DECIMAL(38,0)) div CAST({ONE} AS DECIMAL(38,0))") for back in (0, 1)
    ]
    return placed.withColumn("copies", (passed[0] - passed[1]).cast("long"))


def shares(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words), copies."""
    return _walked(docs, []).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each row as often as its copies, with all its columns."""
    chosen = _walked(docs, ["row"]).where("copies > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("row.*")


SQL = rf"""
WITH sized AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN source IS NULL THEN 'z' ELSE 'a' || source END AS source,
    COALESCE(len(regexp_extract_all(text, '{words_pattern}')), 0) AS size
  FROM documents),
totals AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, 3 * source_size AS cap,
    (ROW_NUMBER() OVER (ORDER BY source) - 1) % {WEIGHTS} + 1 AS weight FROM totals),
levels AS (
  SELECT *, CAST(SUM(source_size) OVER () - COALESCE(SUM(cap) OVER (ORDER BY cap / weight, source
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / SUM(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
opened AS (SELECT *, MAX(CASE WHEN level <= cap / weight THEN level END) OVER () AS open_level FROM levels),
targeted AS (SELECT *, LEAST(CAST(cap AS DOUBLE), open_level * weight) AS target FROM opened),
rated AS (
  SELECT source, source_size, target,
    CASE WHEN source_size > 0 THEN CAST(ROUND(target / source_size * {float(ONE)}) AS HUGEINT) ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('{SEED}|' || source), 1, 10)) AS HUGEINT) AS start
  FROM targeted),
walked AS (
  SELECT doc_id, s.source, size, CAST(ROW_NUMBER() OVER (PARTITION BY s.source ORDER BY floor(sqrt(CAST(size AS DOUBLE))),
    ((COALESCE(doc_id, 0) % {RESIDUES}) + {RESIDUES}) % {RESIDUES}, doc_id NULLS FIRST, size) AS HUGEINT) AS rank FROM sized AS s),
placed AS (
  SELECT doc_id, size, source_size, target,
    CAST((rank * rate + start) // {ONE} - ((rank - 1) * rate + start) // {ONE} AS BIGINT) AS copies
  FROM walked JOIN rated ON walked.source = rated.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies FROM placed
"""
