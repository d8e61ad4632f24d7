"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog import ENTRIES  # noqa: E402
from catalog.core import Frames  # noqa: E402
from galley import fixtures  # noqa: E402
from galley.plans import reports  # noqa: E402

HEADLINE = [
    "citation_findings_by_severity", "P2_basic_features", "Z9_skip_rows", "H8_gap_fill", "H13_heading_number_conflict",
    "C1_citations", "B4_citation_without_source", "K8_resolve_refs", "K11_rewrite_refs", "V1_estimate_pages",
    "T5_row_page_groups", "X8_revision_diff", "W5_document_listing", "W8_apply_decisions", "D4_violations_by_category",
    "D6_finding_counts", "D9_finding_report_rows", "Q4_prf", "Q9_corpus_timings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - start, 3)

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    paragraphs = fixtures.paragraphs(spark, sf_dir)
    state = {}
    timed("detect_headings", lambda: state.update(found=reports.detect(paragraphs)))
    data = reports.Manuscripts(paragraphs, hidden=fixtures.hidden_texts(spark, sf_dir))
    timed("check_report_after_detection", lambda: drain(reports.check_report(data, found=state["found"])))
    frames = Frames.of(spark, sf_dir)
    # The detection timed above is the input of the other queries.
    frames.adopt(scored=state["found"].scored, headings=state["found"].headings, zoned=state["found"].scored)
    for table in ("cited", "entries", "caps", "rows_of_tables"):
        getattr(frames, table)
    for name in HEADLINE:
        timed(name, lambda name=name: drain(ENTRIES[name].spark(spark, sf_dir)))
    report_seconds = times["detect_headings"] + times["check_report_after_detection"]
    documents, rows = state["found"].docs.count(), state["found"].scored.count()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "documents": documents,
                "paragraphs": rows,
                "check_report_documents_per_second": round(documents / report_seconds, 1),
                "check_report_paragraphs_per_second": round(rows / report_seconds, 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
