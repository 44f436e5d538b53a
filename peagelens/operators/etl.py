"""Raw text rows to the typed fact table."""

import logging
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from peagelens.functions.scalars import (
    clip_low,
    known_text,
    to_number_or_null,
    to_timestamp_or_null,
    to_whole_or_null,
)
from peagelens.schema import FACT
from peagelens.sources.fact import write_fact
from peagelens.sources.raw import BAD_RECORD, read_raw

log = logging.getLogger(__name__)


def normalise_headers(df: DataFrame) -> DataFrame:
    """Header names trimmed, in lower case, words joined by ``_``."""
    return df.toDF(*["_".join(name.strip().lower().split(" ")) for name in df.columns])


_GIVEN = [f.name for f in FACT if f.name not in ("montant_net", "load_timestamp")]


def _parsed(formats: Sequence[str] = ()) -> dict[str, Column]:
    """The typed columns of a normalised export."""
    return {
        "id_transaction": to_whole_or_null(F.col("id_transaction"), "bigint"),
        "date_heure": to_timestamp_or_null(F.col("date_heure"), formats),
        "voie": to_whole_or_null(F.col("voie"), "int"),
        "montant_paye": to_number_or_null(F.col("montant_paye")),
    }


def _normalised(raw: DataFrame) -> DataFrame:
    df = normalise_headers(raw)
    absent = [c for c in _GIVEN if c not in df.columns]
    if absent:
        raise ValueError(f"the export lacks {', '.join(absent)}")
    return df


def transform(
    raw: DataFrame, run_ts: datetime | None = None, formats: Sequence[str] = ()
) -> DataFrame:
    """Typed fact rows from text rows: one projection, no shuffle.

    Unreadable times, amounts and numbers become null, see :func:`losses`; an absent
    column is an error, and further columns are left out. ``formats`` are patterns
    for times that are not ISO. ``run_ts`` stamps every row; pass it to get the same
    result again.
    """
    stamp = (run_ts or datetime.now()).isoformat(sep=" ")
    parsed = _parsed(formats)
    typed = _normalised(raw).withColumns(
        {
            **parsed,
            "montant_net": clip_low(parsed["montant_paye"]),
            "load_timestamp": F.lit(stamp).cast("timestamp_ntz"),
        }
    )
    return typed.to(FACT)


def losses(raw: DataFrame, formats: Sequence[str] = ()) -> dict[str, Column]:
    """Aggregates over a normalised export: rows, malformed rows, and known texts that
    :func:`transform` cannot read, by column."""
    lost = {
        f"lost_{name}": F.count_if(known_text(F.col(name)).isNotNull() & value.isNull())
        for name, value in _parsed(formats).items()
    }
    bad = F.count_if(F.col(BAD_RECORD).isNotNull()) if BAD_RECORD in raw.columns else F.lit(0).cast("bigint")
    return {"rows": F.count(F.lit(1)), "malformed": bad, **lost}


def load_report(raw: DataFrame, formats: Sequence[str] = ()) -> DataFrame:
    """(measure, n): what loading this export would count, from one pass."""
    counts = losses(raw, formats)
    row = _normalised(raw).agg(*[c.alias(n) for n, c in counts.items()])
    return row.unpivot([], list(counts), "measure", "n")


@dataclass(frozen=True)
class EtlReport:
    """``lost`` counts, by column, the known texts that became null."""

    rows: int
    seconds: float
    malformed: int = 0
    lost: dict[str, int] = field(default_factory=dict)


def run_etl(
    spark: SparkSession,
    csv_path: str,
    fact_path: str,
    run_ts: datetime | None = None,
    rebalance: bool = True,
    multiline: bool = False,
    formats: Sequence[str] = (),
) -> EtlReport:
    """CSV to fact table, full refresh. Rows and losses are counted while they are written."""
    started = time.monotonic()
    seen = Observation("etl")
    raw = _normalised(read_raw(spark, csv_path, multiline))
    counted = raw.observe(seen, *[c.alias(n) for n, c in losses(raw, formats).items()])
    write_fact(transform(counted, run_ts, formats), fact_path, rebalance)
    counts = dict(seen.get)
    report = EtlReport(
        counts["rows"],
        time.monotonic() - started,
        counts["malformed"],
        {n.removeprefix("lost_"): v for n, v in counts.items() if n.startswith("lost_")},
    )
    log.info("loaded %d rows in %.2f s, lost %s", report.rows, report.seconds, report.lost)
    return report
