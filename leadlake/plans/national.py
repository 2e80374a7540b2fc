"""Compositions that run several load and geography steps in a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.fixed_values import MUNICIPALITIES
from leadlake.functions.capital import needs_repair, repair_decision
from leadlake.operators.divisions import backfill_streets, geocode
from leadlake.plans.load import keyed_registry, registry_companies
from leadlake.schemas import COMPANIES, conform


def repair_municipalities(companies: DataFrame, divisions: DataFrame) -> DataFrame:
    """Municipalities: locate by district, fill streets, then locate by street.

    The first pass places companies whose street is unknown; the last one uses
    the streets found in between for those still without a point.
    """
    located = geocode(companies, divisions, provinces=MUNICIPALITIES)
    filled = backfill_streets(located, divisions, provinces=MUNICIPALITIES, only_empty=True)
    return geocode(filled, divisions, provinces=MUNICIPALITIES)


def load_national(rows: DataFrame, divisions: DataFrame, as_of: Column, arrival: list[str], limits: bool = False) -> DataFrame:
    """Registry rows to located companies: clean, keep best, streets, points."""
    cleaned = registry_companies(keyed_registry(rows, limits), as_of, arrival, limits)
    companies = conform(cleaned, COMPANIES)
    return geocode(backfill_streets(companies, divisions), divisions)


def repaired_capital(companies: DataFrame) -> DataFrame:
    """Companies whose capital changes: key, new value, currency, reason, score."""
    raw, wan = F.col("capital_raw"), F.col("capital_wan")
    due = companies.filter(needs_repair(raw, wan))
    decided = due.withColumn(
        "change", repair_decision(raw, wan, F.col("company_name"), F.col("scale"))
    ).filter(F.col("change").isNotNull())
    return decided.select(
        "credit_code", F.col("change.capital_wan").alias("capital_wan"),
        F.coalesce(F.col("change.capital_currency"), F.col("capital_currency")).alias("capital_currency"),
        F.col("change.reason").alias("reason"), (F.coalesce("fill_score", F.lit(0)) + 1).alias("fill_score"),
    )
