"""Parameters of the two pipelines; defaults are the published example settings."""

from __future__ import annotations

from dataclasses import dataclass, field

SPLIT_ORDER = ("train", "val", "test")


@dataclass(frozen=True)
class PrepConfig:
    """Settings of the candlestick feature pipeline."""

    price_type_name: str = "mid"
    instrument_name: str | None = None
    interval_name: str = "Minute"
    tz: str = "US/Eastern"
    seconds_divisor: int = 60
    n_back: int = 120
    n_forward: int = 15
    # The published window rule leaves n_back slots unused at the end of a day; 0 emits every window.
    tail_guard: int | None = None
    slot_rule: str = "next"
    shuffle_it: bool = True
    seed: int = 54
    reduce_vector_sizes: bool = True
    modulus_integer: int = 30
    train_val_test_split: dict[str, float] = field(
        default_factory=lambda: {"train": 0.75, "val": 0.125, "test": 0.125}
    )

    @property
    def guard(self) -> int:
        return self.n_back if self.tail_guard is None else self.tail_guard


@dataclass(frozen=True)
class SpotConfig:
    """Settings of the spot-price forecasting pipeline."""

    bin_seconds: int = 1440 * 60
    train_fraction: float = 0.9
    n_grid: int = 6
    max_difference: int = 5
    max_lag: int = 10
