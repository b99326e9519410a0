"""Run parameters of the customer-summary job.

The original script reads the clock twice (the load date and
``current_date()``); here one ``as_of`` date drives both so that a run can
be repeated and gives the same answer in every time zone.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class RunParams:
    # snapshot date: load_date of staging rows, report_date of credit scores
    as_of: dt.date = dt.date(2001, 8, 1)
    # trailing window of recent transactions, inclusive lower bound
    lookback_days: int = 180
    # archived transactions strictly after this date join the archive branch
    archive_after: dt.date = dt.date(1997, 1, 1)
    # date of the risk snapshot that is averaged per customer
    risk_as_of: dt.date = dt.date(2024, 1, 3)
    # fixture only: orders from this date on are live accounts, older ones archived
    live_from: dt.date = dt.date(2000, 1, 1)
    # fixture only: load date of rows that missed the snapshot
    stale: dt.date = field(default=dt.date(2001, 7, 31))

    @property
    def window_start(self) -> dt.date:
        return self.as_of - dt.timedelta(days=self.lookback_days)


DEFAULT = RunParams()
