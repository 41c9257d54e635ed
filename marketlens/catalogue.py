"""All registered queries: importing the modules below fills the registry."""

from __future__ import annotations

import importlib

from marketlens import registry

#: Modules that register queries.
MODULES: tuple[str, ...] = (
    "operators.market", "operators.lifecycle", "operators.risk", "operators.quality", "operators.scoring", "operators.linkage", "operators.search", "streaming.events", "operators.profiles",
    "operators.extractors", "operators.normalisers", "operators.resolution", "operators.onboarding", "operators.enrichment", "operators.reports",
    "operators.ingest", "operators.dossier", "operators.places", "operators.decisions", "operators.retrieval", "operators.chain", "operators.bundle", "operators.entities", "streaming.changes",
)


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"marketlens.{name}")


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
