"""Counters of running streams."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Batches, rows and the state of each stream by name; `report`, where given, is called with them at every batch."""

    def __init__(self, report=None):
        self.counters: dict[str, dict] = {}
        self._names: dict[str, str] = {}
        self._report = report

    def _of(self, run: str, name: str | None) -> dict:
        key = self._names.setdefault(str(run), name or str(run))
        return self.counters.setdefault(key, {"batches": 0, "rows": 0, "state": "running"})

    def onQueryStarted(self, event):
        self._of(event.runId, event.name)["state"] = "running"

    def onQueryProgress(self, event):
        own = self._of(event.progress.runId, event.progress.name)
        own["batches"] += 1
        own["rows"] += event.progress.numInputRows
        if self._report:
            self._report(dict(own))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self._of(event.runId, None)["state"] = "failed" if event.exception else "ended"
