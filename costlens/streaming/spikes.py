"""Day-over-day changes of streamed series, with the days that matter as keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from costlens.schemas import DIMENSIONS

#: Days behind the newest one that are kept, for rows that come late.
LATENESS = 8
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = T.StructType([
    *[T.StructField(d, T.StringType()) for d in DIMENSIONS],
    T.StructField("feature_date", T.DateType()), T.StructField("total_cost_usd", T.DoubleType()),
    T.StructField("previous_cost", T.DoubleType())])


class DayChanges(StatefulProcessor):
    """Each new day of a series with the cost of the day before it, and the day after a
    late one again.

    State is a map from day to cost: the days up to LATENESS behind the newest one, and
    the last one before them. A day that is older still is compared with what is left,
    and not kept.
    """

    def __init__(self, days_apart: int | None):
        self.days_apart = days_apart

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.costs = handle.getMapState("costs", "day int", "cost double")

    def _keep(self, known: dict[int, float]) -> None:
        edge = max(known) - LATENESS
        last = max((d for d in known if d < edge), default=None)
        for (day,) in list(self.costs.keys()):
            if day < edge and day != last:
                self.costs.removeKey((day,))

    def _known(self) -> dict[int, float]:
        return {day: cost for (day,), (cost,) in self.costs.iterator()}

    def _add(self, rows: pd.DataFrame) -> list[int]:
        days = [int(d.toordinal()) for d in pd.to_datetime(rows["agg_date"])]
        for day, cost in zip(days, rows["total_cost_usd"]):
            self.costs.updateValue((day,), (float(cost),))
        return days

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._add(initialState)
        self._keep(self._known())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        new = sorted({day for part in rows for day in self._add(part)})
        known = self._known()
        order = sorted(known)
        place = {day: i for i, day in enumerate(order)}
        judged = {i for day in new for i in (place[day], place[day] + 1) if 0 < i < len(order)}
        out = [(*key, date.fromordinal(order[i]), known[order[i]], known[order[i - 1]])
               for i in sorted(judged)
               if self.days_apart is None or order[i] - order[i - 1] <= self.days_apart]
        self._keep(known)
        yield pd.DataFrame(out, columns=CHANGES.names)

    def close(self) -> None:
        pass


def day_changes(daily: DataFrame, baseline: DataFrame | None = None,
                days_apart: int | None = None) -> DataFrame:
    """(five dimensions, feature_date, total_cost_usd, previous_cost) of a daily stream."""
    daily.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    columns = [*DIMENSIONS, "agg_date", "total_cost_usd"]
    first = None if baseline is None else baseline.select(*columns).groupBy(*DIMENSIONS)
    return daily.select(*columns).where(F.col("agg_date").isNotNull()).groupBy(
        *DIMENSIONS).transformWithStateInPandas(
        DayChanges(days_apart), CHANGES, "Append", "None", first)
