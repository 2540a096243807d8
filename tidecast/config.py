"""Parameters of a forecasting study. Operators take them as arguments; nothing is hard-wired."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta


@dataclass(frozen=True)
class Study:
    """Calendar anchors, horizon and validation windows of one study."""

    first_date: date
    week_anchor: date
    calendar_days: int
    train_last: int
    windows: tuple[tuple[int, int], ...]
    states: tuple[str, ...]
    horizon: int = 28
    lead_days: int = 3
    max_lag: int = 57
    weight_days: int = 29
    var_lags: int = 28

    def date_of(self, day_num: int) -> date:
        return self.first_date + timedelta(days=day_num - 1)

    @property
    def forecast_first(self) -> int:
        return self.train_last + 1

    @property
    def forecast_last(self) -> int:
        return self.train_last + self.horizon

    @property
    def weight_first(self) -> int:
        return self.train_last - self.weight_days + 1

    @property
    def calendar_last_week(self) -> int:
        last = self.date_of(self.calendar_days)
        return (last - self.week_anchor).days // 7 + 1


# The published competition setting (days, windows and states of its data set).
# Windows are listed newest first, so position 1 is the most recent one.
RETAIL_2016 = Study(
    first_date=date(2011, 1, 29),
    week_anchor=date(2011, 1, 29),
    calendar_days=1969,
    train_last=1913,
    windows=((1886, 1913), (1832, 1859), (1778, 1805), (1724, 1751), (1670, 1697)),
    states=("CA", "TX", "WI"),
)

# The same layout shifted onto the test tables, whose ship dates span 2,499 days.
TESTBED = Study(
    first_date=date(1995, 1, 2),
    week_anchor=date(1994, 12, 31),
    calendar_days=2499,
    train_last=2468,
    windows=((2441, 2468), (2387, 2414), (2333, 2360), (2279, 2306), (2225, 2252)),
    states=("AF", "AM", "AS", "EU", "MI"),
)
