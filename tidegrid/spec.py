"""What a table's series are, and the default thresholds."""

from __future__ import annotations

from dataclasses import dataclass

#: Expected season length and, in seconds, the expected gap of each named grid.
SEASON = {"hourly": 24, "daily": 7, "weekly": 52, "monthly": 12, "quarterly": 4, "yearly": 1}
GAP_SECONDS = {"hourly": 3600, "daily": 86400, "weekly": 7 * 86400, "monthly": 30 * 86400, "quarterly": 90 * 86400, "yearly": 365 * 86400}


@dataclass(frozen=True)
class SeriesSpec:
    """ts orders a series, ties make the order unique; series are columns that tell series apart."""

    ts: str
    ties: tuple[str, ...] = ()
    series: tuple[str, ...] = ()

    @property
    def order(self) -> list[str]:
        return [self.ts, *self.ties]


@dataclass(frozen=True)
class Thresholds:
    iqr: float = 1.5
    z: float = 3.0
    mad: float = 3.0
    near_constant: float = 0.001
    residual: float = 3.5 * 1.4826
    winsor: tuple[float, float] = (0.015, 0.985)
    gap: float = 1.5
    parse: float = 0.8
    drop_null_pct: float = 95.0
    identifier_pct: float = 99.0
    zero_pct: float = 50.0
    max_row_loss_pct: float = 15.0
    min_rows: int = 30
    break_rows: int = 50
    top: int = 5


DEFAULT = Thresholds()
