"""Parameters of the panel operators."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Slots of a day, and minutes of a slot.
SLOTS, SLOT_MINUTES = 96, 15


@dataclass(frozen=True)
class FeatureConfig:
    # The lag, neighbour and peak settings that results must equal.
    lags: tuple[int, ...] = (94, 95, 96, 97, 98)
    regional_lags: tuple[int, ...] = (95, 96, 97)
    neighbours: int = 5
    clusters: int = 6
    today_slots: int = 9
    half_window: int = 4
    morning_hours: tuple[int, int] = (7, 10)
    evening_hours: tuple[int, int] = (17, 20)
    morning_slots: tuple[int, int] = (28, 40)
    evening_slots: tuple[int, int] = (68, 80)
    folds: int = 2
    seed: int = 42
    #: Those of them that a panel has are encoded.
    categories: tuple[str, ...] = ("road_type", "weather", "vehicles", "landmarks")
    #: "reference" fills train nulls with 0 and test nulls with the global mean; "consistent" uses the mean for both.
    fill_policy: str = "reference"


@dataclass(frozen=True)
class PostConfig:
    # Fixed values of the correction rules.
    fit_day: int = 48
    val_day: int = 49
    cap_scale: float = 2.5
    shrink: float = 0.95
    shrink_below: float = 0.5
    lag_weight: float = 0.30
    trend_weight: float = 0.05
    trend_low: float = 0.3
    trend_high: float = 3.0
    bias: float = 0.008
    surge: tuple[str, ...] = field(default=("qp03xw", "qp03w9", "qp03wz", "qp03xp", "qp03xx", "qp03wd"))
