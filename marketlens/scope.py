"""The filters that parameterised queries share, as plan-time choices: a filter that isn't set leaves no trace in the plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.lens import Lens


def trim_codes(codes: Sequence[str]) -> list[str]:
    """Code prefixes without check digits (all from '-' on), without repeats, in order."""
    return list(dict.fromkeys(c.split("-")[0].strip() for c in codes if c and c.split("-")[0].strip()))


@dataclass(frozen=True)
class Scope:
    date_from: str | None = None
    date_to: str | None = None
    code_prefixes: Sequence[str] = field(default_factory=tuple)
    keywords: Sequence[str] = field(default_factory=tuple)
    taxonomy_match: str = "ANY"
    nuts_prefix: str | None = None
    region: str | None = None
    amount_min: Decimal | float | None = None
    amount_max: Decimal | float | None = None

    def taxonomy(self) -> tuple[list[str], list[str], bool]:
        """(codes, keywords, both wanted). KEYWORD_REQUIRED drops the codes when there is a keyword; ALL and CPV_AND_KEYWORD want both."""
        codes, words = trim_codes(self.code_prefixes), [w.lower() for w in self.keywords if w.strip()]
        if self.taxonomy_match == "KEYWORD_REQUIRED" and words:
            codes = []
        return codes, words, self.taxonomy_match in ("ALL", "CPV_AND_KEYWORD")

    def apply(self, acts: DataFrame, lens: Lens) -> DataFrame:
        """Acts within the scope. Amounts that are missing count as 0."""
        if self.date_from:
            acts = acts.where(F.col("event_date") >= F.lit(self.date_from).cast("date"))
        if self.date_to:
            acts = acts.where(F.col("event_date") <= F.lit(self.date_to).cast("date"))
        if self.amount_min is not None:
            acts = acts.where(F.coalesce("amount_net", F.lit(0)) >= F.lit(self.amount_min))
        if self.amount_max is not None:
            acts = acts.where(F.coalesce("amount_net", F.lit(0)) <= F.lit(self.amount_max))
        if self.nuts_prefix:
            acts = acts.join(lens.locations.where(F.upper("nuts_code").startswith(self.nuts_prefix.upper())).select("act_id"), "act_id", "left_semi")
        if self.region:
            acts = acts.join(lens.locations.where(F.lower("region").contains(self.region.lower())).select("act_id"), "act_id", "left_semi")
        codes, words, both = self.taxonomy()
        by_code = lens.codes.where(any_of([F.col("cpv_code").startswith(c) for c in codes])).select("act_id") if codes else None
        by_word = lens.primary.where(any_of([F.lower("title").contains(w) for w in words])).select("act_id") if words else None
        if by_code is not None and by_word is not None and not both:
            return acts.join(by_code.unionByName(by_word).distinct(), "act_id", "left_semi")
        for hits in (by_code, by_word):
            acts = acts if hits is None else acts.join(hits.distinct(), "act_id", "left_semi")
        return acts


def any_of(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
