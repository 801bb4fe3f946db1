"""Counters and events of runs and streams, taken from the passes that write the rows."""

from __future__ import annotations

import logging
import threading
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming.listener import StreamingQueryListener

_log = logging.getLogger(__name__)


class Events:
    """A sink of named events for a callback; what it raises is logged and stops nothing."""

    def __init__(self, send: Callable[[str, dict], None] | None = None):
        self.send = send

    def emit(self, name: str, /, **payload) -> None:
        if self.send is not None:
            try:
                self.send(name, payload)
            except Exception:
                _log.exception("an event of %s was lost", name)


class Counters(StreamingQueryListener):
    """Sums, by query, of the numbers that streams observe (see observed) and of late rows that were dropped; also
    sends started, progress and terminated.

    A batch that is run again after a restart counts once for each time that this listener hears of it with new rows;
    one listener is to be added for each query's life.
    """

    def __init__(self, events: Events | None = None):
        self.events, self.totals = events or Events(), defaultdict(lambda: defaultdict(int))
        self._seen: set[tuple[str, int]] = set()
        self.late: dict[str, int] = defaultdict(int)
        self._ended, self._lock = set(), threading.Condition()

    def onQueryStarted(self, event) -> None:
        self.events.emit("started", query=str(event.id), name=event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        told = {n: r.asDict() for n, r in (p.observedMetrics or {}).items()}
        with self._lock:
            if (str(p.id), p.batchId) not in self._seen:
                self._seen.add((str(p.id), p.batchId))
                self.late[str(p.id)] += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
                for row in told.values():
                    for k, v in row.items():
                        self.totals[str(p.id)][k] += v or 0
        self.events.emit("progress", query=str(p.id), batch=p.batchId, rows=p.numInputRows, observed=told)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._ended.add(str(event.id))
            self._lock.notify_all()
        self.events.emit("terminated", query=str(event.id), error=event.exception)

    def of(self, query, timeout: float = 60.0) -> dict[str, int]:
        """The sums of a query that has ended, once its last event has come."""
        with self._lock:
            if not self._lock.wait_for(lambda: str(query.id) in self._ended, timeout):
                raise TimeoutError("the query hasn't ended")
            return dict(self.totals[str(query.id)])


def observed(rows: DataFrame, name: str, counts: dict[str, Column]) -> DataFrame:
    """rows, with aggregates that come from any pass over them."""
    return rows.observe(name, *[c.alias(n) for n, c in counts.items()])
