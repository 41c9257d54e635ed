"""Marts in order of dependence: a failed one leaves its dependants out, and the others go on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from marketlens import catalogue
from marketlens.sources.files import publish

#: Marts in their fixed order, with what each needs.
MARTS: dict[str, tuple[str, ...]] = {
    "market_value_metrics": (), "supplier_market_share": ("market_value_metrics",), "market_hhi": ("supplier_market_share",), "buyer_concentration": (), "supplier_dependency": (),
    "incumbent_signals": (), "contract_modification_stats": (), "cycle_time": (), "payment_execution": (), "renewal_signals": ("cycle_time",), "process_360_nested": (),
}


@dataclass(frozen=True)
class State:
    mart: str
    status: str
    detail: str = ""


def refresh(spark: SparkSession, sf_dir: str, top: str, marts: dict[str, tuple[str, ...]] | None = None, queries: dict | None = None) -> list[State]:
    """Refreshes marts into versioned folders under ``top``; REFRESHED, FAILED or SKIPPED for each."""
    queries = catalogue.queries() if queries is None else queries
    out: dict[str, State] = {}
    for mart, needs in (marts or MARTS).items():
        bad = [n for n in needs if out.get(n, State(n, "MISSING")).status != "REFRESHED"]
        if bad:
            out[mart] = State(mart, "SKIPPED", ",".join(bad))
            continue
        try:
            out[mart] = State(mart, "REFRESHED", publish(queries[mart](spark, sf_dir), top, mart))
        except Exception as e:  # a mart's failure is its state
            out[mart] = State(mart, "FAILED", str(e)[:300])
    return list(out.values())
