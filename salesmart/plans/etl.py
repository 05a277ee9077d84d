"""The load run: judge, enrich, replace the table, audit it."""

from __future__ import annotations

import logging
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from salesmart.config import SalesConfig
from salesmart.functions.dates import load_stamp
from salesmart.operators import quality
from salesmart.operators.audit import audit_formatted, audit_summary
from salesmart.operators.enrich import customer_counts, enrich
from salesmart.sinks.table import CatalogSink, JdbcSink, WriteReport
from salesmart.sources.csv import INGEST_ORDER, CsvFeed
from salesmart.storage import Staged, stage

log = logging.getLogger("salesmart")


@dataclass(frozen=True)
class EtlReport:
    """What a load run read, dropped and wrote."""

    rows_in: int
    columns_in: int
    rows_clean: int
    rows_dropped: int
    issues: list[str]
    lines: list[tuple[int, str, int, str]]
    written: WriteReport
    audit: dict
    audit_text: dict
    elapsed_s: float
    # Seconds by step, in the order they were taken.
    steps: dict[str, float]


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("loaded_at", load_stamp())


def run_etl(
    raw: DataFrame | CsvFeed,
    sink: str | CatalogSink | JdbcSink,
    order: Sequence[str] = INGEST_ORDER,
    config: SalesConfig = SalesConfig(),
    *,
    approximate: bool = False,
) -> EtlReport:
    """Load raw rows into a catalog table, by its name, or another sink and report.

    The raw rows are read and shuffled once. What the rules made of them is
    staged, and the malformed records that a scan of files met meanwhile are an
    error before anything else is done; the report, the customer counts, the outlier limit and the enriched
    rows are then read from that columnar copy, each with its own columns only.
    The totals are taken from the new rows before anybody sees them; with
    ``approximate`` their customers are counted by a sketch. Errors are logged and
    raised again.
    """
    start = time.monotonic()
    sink = CatalogSink(sink, config) if isinstance(sink, str) else sink
    feed, raw = (raw, raw.rows) if isinstance(raw, CsvFeed) else (None, raw)
    log.info("Load of %s started", sink.table)
    audited: list[DataFrame] = []
    staged: list[Staged] = []
    steps: dict[str, float] = {}

    def keep(df: DataFrame, name: str) -> DataFrame:
        staged.append(stage(df, name))
        return staged[-1].rows

    def done(step: str) -> None:
        steps[step] = time.monotonic() - start - sum(steps.values())
        log.info("Load of %s: %s in %.2fs", sink.table, step, steps[step])

    try:
        judged = keep(quality.without_rejected(quality.judge(raw, order, config)), "judged")
        if feed is not None:
            feed.verify()
        done("read and judge")
        tallied = keep(quality.tally(judged, config), "tally")
        totals = quality.row_totals(tallied).first()
        # At most one line per rule.
        lines = quality.issues(tallied, config).orderBy("seq").collect()
        for line in lines:
            log.warning(line.message)
        done("report")
        clean = quality.clean_rows(judged, config)
        counts = keep(customer_counts(clean), "customers")
        enriched = enrich(clean, counts=counts, total=totals.rows_clean)
        done("count customers")
        written = sink.write(
            stamped(enriched),
            lambda rows: audited.append(keep(audit_summary(rows, config, approximate), "audit")),
        )
        done("enrich, write and audit")
        summary = audited[0]
        report = EtlReport(
            rows_in=totals.rows_in,
            columns_in=len([name for name in raw.columns if name not in INGEST_ORDER]),
            rows_clean=totals.rows_clean,
            rows_dropped=totals.rows_dropped,
            issues=[line.message for line in lines],
            lines=[(line.seq, line.rule, line.n, line.message) for line in lines],
            written=written,
            audit=summary.first().asDict(),
            audit_text=audit_formatted(summary).first().asDict(),
            elapsed_s=time.monotonic() - start,
            steps=steps,
        )
    except Exception:
        log.exception("Load of %s failed", sink.table)
        raise
    finally:
        for copy in staged:
            copy.release()
    log.info("Load of %s done in %.2fs: %s", sink.table, report.elapsed_s, report.audit_text)
    return report
