"""Score formulas as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsloom.functions.columns import stable_round

# Points per severity; unknown severities count as MEDIUM.
SEVERITY_POINTS = {"CRITICAL": 40.0, "HIGH": 30.0, "WARNING": 25.0, "MEDIUM": 20.0, "LOW": 10.0, "INFO": 5.0}
DEFAULT_SEVERITY_POINTS = 20.0

# Weights of the five quality components.
HEALTH_WEIGHTS = {"completeness": 0.25, "uniqueness": 0.20, "validity": 0.20, "consistency": 0.15,
                  "referential_integrity": 0.20}


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def priority_score(severity: Column, impact: Column, age_days: Column, sla_at_risk: Column) -> Column:
    """Severity up to 40, impact up to 25 at 10,000, age up to 20 at 60 days, SLA 15; 0 to 100."""
    points = F.coalesce(*[F.when(F.upper(severity) == s, F.lit(p)) for s, p in SEVERITY_POINTS.items()],
                        F.lit(DEFAULT_SEVERITY_POINTS))
    money_points = F.least(F.lit(25.0), impact.cast("double") / 10000.0 * 25.0)
    age_points = F.least(F.lit(20.0), age_days.cast("double") / 60.0 * 20.0)
    sla_points = F.when(sla_at_risk, 15.0).otherwise(0.0)
    return clamp(stable_round(points + money_points + age_points + sla_points, 1))


def customer_health(overdue: Column, late: Column, open_tickets: Column, breached: Column, balance: Column) -> Column:
    penalty = overdue * 20.0 + late * 15.0 + open_tickets * 10.0 + breached * 25.0 + F.when(balance > 1000.0, 15.0) \
        .otherwise(0.0)
    return clamp(F.round(100.0 - penalty, 1))


def risk_tier(health: Column) -> Column:
    return F.when(health >= 80, "LOW_RISK").when(health >= 50, "MEDIUM_RISK").otherwise("HIGH_RISK")


def overall_health(components: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, weight in HEALTH_WEIGHTS.items():
        total = total + components[name] * weight
    return stable_round(total, 1)
