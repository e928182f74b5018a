"""Settings of an analysis; thresholds and weights are fixed values of the method."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class AnalyticsConfig:
    grain: str = "week"
    lookback: int = 12
    rolling: int = 4
    # anomalies
    baseline: int = 8
    min_points: int = 4
    min_pct: float = 0.08
    alert_pct: float = 0.15
    alert_z: float = 2.0
    high_pct: float = 0.30
    high_z: float = 3.0
    # profit and quality
    cogs_complete: float = 0.999
    reliable: float = 0.95
    low_margin: float = 0.20
    concentration: float = 0.40
    concentration_penalty: float = 15.0
    product_coverage: float = 0.80
    money_tolerance: float = 0.02
    refund_gap: float = 0.01
    # health score
    weights: dict[str, float] = field(
        default_factory=lambda: {
            "revenue_growth": 0.20,
            "profitability": 0.25,
            "marketing_efficiency": 0.20,
            "customer_health": 0.15,
            "product_health": 0.10,
            "data_quality": 0.10,
        }
    )
    growth_points: tuple = ((-0.25, 0), (-0.10, 40), (0.0, 70), (0.10, 100))
    margin_points: tuple = ((-0.05, 0), (0.0, 20), (0.05, 45), (0.15, 75), (0.25, 100))
    roas_points: tuple = ((0.5, 0), (1.0, 25), (2.0, 55), (3.0, 80), (4.0, 100))
    repeat_points: tuple = ((0.0, 10), (0.10, 45), (0.20, 75), (0.30, 100))
    gross_margin_points: tuple = ((0.10, 0), (0.25, 45), (0.40, 75), (0.55, 100))


# Which way a metric should move.
DIRECTIONS = {
    "revenue": "up",
    "orders": "up",
    "aov": "up",
    "ad_spend": "neutral",
    "paid_clicks": "neutral",
    "paid_conversion_rate": "up",
    "roas": "up",
    "refunds": "down",
}
SERIES = list(DIRECTIONS)
