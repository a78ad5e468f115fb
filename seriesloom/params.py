"""Parameters of all stages, with the defaults of the analytics that this library re-expresses."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    min_price: float = 90.0
    max_price: float = 140.0
    outlier_z: float = 4.0
    spike_pct: float = 2.0
    fill_limit: int = 5
    gap_factor: float = 2.0
    flat_run: int = 10
    ma_windows: tuple[int, ...] = (5, 20, 50)
    vol_windows: tuple[int, ...] = (10, 20, 30)
    momentum_periods: tuple[int, ...] = (3, 5, 10, 20)
    range_windows: tuple[int, ...] = (10, 20, 50)
    rsi_period: int = 14
    band_window: int = 20
    band_width: float = 2.0
    lookback: int = 20
    entry_z: float = 1.5
    exit_z: float = 0.5
    regime_window: int = 100
    regime_quantile: float = 0.75
    regime_cuts: tuple[float, float] = (0.33, 0.67)
    horizon: int = 20
    ensemble_threshold: float = 0.5
    ensemble_weights: dict[str, float] = field(default_factory=lambda: {"mean_reversion": 0.5, "momentum": 0.5})
    cost_bps: float = 1.0
    slippage_bps: float = 0.5
    annual_factor: int = 252
    metric_window: int = 252
    train_share: float = 0.6
    train_years: int = 6
    rebalance_months: int = 1
    ridge_alpha: float = 1.0
    #: A series may be longer than one task should hold: exact quantiles go by ranges of values, and sums
    #: of rows by blocks, in an order that chunks do not change.
    long_series: bool = False
    #: Rows of a chunk of a long series, and the length of the time buckets in which rows are numbered.
    chunk_rows: int = 1_000_000
    bucket_seconds: int = 30 * 86_400

    @property
    def total_cost_bps(self) -> float:
        return self.cost_bps + self.slippage_bps


DEFAULTS = Params()
