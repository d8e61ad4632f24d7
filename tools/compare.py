"""Run registered queries against their SQL in DuckDB and report differences."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from catalog import ENTRIES  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    out = []
    for row in frame.itertuples(index=False):
        out.append(tuple(plain(v) for v in row))
    return sorted(out, key=repr)


def plain(value):
    """Numbers compare by value, whatever type a null turned their column into."""
    if pd.isna(value):
        return None
    if isinstance(value, bool | str):
        return value
    try:
        return round(float(value), 6)
    except (TypeError, ValueError):
        return str(value)


def compare(spark: SparkSession, db, name: str, sf_dir: str) -> str:
    item = ENTRIES[name]
    start = time.time()
    got = rows_of(item.spark(spark, sf_dir).toPandas())
    took = time.time() - start
    sql = item.oracle()
    if sql is None:
        return f"rows  {len(got):7d} {took:6.2f}s"
    start = time.time()
    want = rows_of(db.sql(sql).df())
    took_sql = time.time() - start
    if got == want:
        return f"ok    {len(got):7d} {took:6.2f}s sql {took_sql:.2f}s"
    a, b = set(got), set(want)
    return (f"DIFF  spark {len(got)} sql {len(want)}\n   only spark {len(a - b)}: {sorted(a - b, key=repr)[:3]}"
            f"\n   only sql {len(b - a)}: {sorted(b - a, key=repr)[:3]}")


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, db = session(), duckdb.connect()
    for table in TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    chosen = [n for n in ENTRIES if not names or any(n == w or n.startswith(w) for w in names)]
    bad = 0
    for name in chosen:
        try:
            result = compare(spark, db, name, sf_dir)
        except Exception as error:
            result = "ERROR " + str(error)[:700] if "-v" not in names else traceback.format_exc()
        bad += not result.startswith(("ok", "rows"))
        print(f"{name:34s} {result}", flush=True)
    print(f"{len(chosen)} queries, {bad} wrong")
    return bad


if __name__ == "__main__":
    sys.exit(main())
