"""Progress of running jobs (W05, W06): a bounded buffer that a page drains, fed by streams and steps, and a stop that jobs obey."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

#: Messages beyond which the buffer is cut, and how many of the last ones stay.
MOST, STAY = 500, 300
# How messages of new documents and of failures begin; fixed values.
NEW = ("OK", "ok", "Nuevo", "✔", "✅")
FAILED = ("WARN", "Error", "ERROR", "⚠")


class Progress:
    """Messages and counters of one job; every method may be called from any thread."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self.reset()

    def reset(self, total: int = 0) -> None:
        with self._lock:
            self._messages: list[dict] = []
            self.new = self.failed = self.done = 0
            self.total = total

    def push(self, text: str, ok: bool = True, total: int = 0) -> None:
        with self._lock:
            self._messages.append({"msg": text, "ok": ok})
            self.total = total or self.total
            self.new += text.startswith(NEW)
            self.failed += text.startswith(FAILED)
            self.done += 1
            if len(self._messages) > MOST:
                self._messages = self._messages[-STAY:]

    def drained(self) -> dict:
        """The messages since the last drain, and the counters, which stay."""
        with self._lock:
            told, self._messages = self._messages, []
            return {"nuevos": self.new, "errores": self.failed, "procesados": self.done, "total": self.total, "messages": told}


class ProgressListener(StreamingQueryListener):
    """Tells a buffer what streams do: a start, each batch with its rows, an end with its error. Only those with one of the names, if any are given."""

    def __init__(self, progress: Progress, *names: str):
        self.progress, self.names, self._ids = progress, names, {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        if not self.names or event.name in self.names:
            self._ids[str(event.runId)] = event.name or "stream"
            self.progress.push(f"Inicio {event.name}")

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        if str(p.runId) in self._ids:
            late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
            self.progress.push(f"OK lote {p.batchId}: {p.numInputRows} filas" + f", {late} tardias" * (late > 0))

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        if (name := self._ids.pop(str(event.runId), None)) is not None:
            self.progress.push(f"Error {name}: {event.exception.splitlines()[0]}" if event.exception else f"Fin {name}", ok=not event.exception)


class Job:
    """One job at a time in the background: steps that look at ``stopping``, and streams that are stopped with it."""

    def __init__(self, spark: SparkSession, progress: Progress | None = None):
        self.spark, self.progress, self._stop, self._thread = spark, progress or Progress(), threading.Event(), None
        self._lock = threading.Lock()
        self.queries: list[StreamingQuery] = []

    @property
    def running(self) -> bool:
        return self._thread is not None and self._thread.is_alive()

    @property
    def stopping(self) -> bool:
        return self._stop.is_set()

    def start(self, work: Callable[[Job], None], total: int = 0) -> bool:
        """Runs work(job) in a thread; False while another runs. What it raises becomes a message."""
        with self._lock:
            if self.running:
                return False
            self._stop.clear()
            self.progress.reset(total)
            self.queries = []

            def run() -> None:
                try:
                    work(self)
                except Exception as e:
                    self.progress.push(f"Error: {e}".splitlines()[0], False)

            self._thread = threading.Thread(target=run, daemon=True)
            self._thread.start()
            return True

    def follow(self, query: StreamingQuery) -> bool:
        """Waits for a stream; True if it ended by itself, False if it was stopped. Raises what the stream raised."""
        self.queries.append(query)
        while not self.stopping:
            if query.awaitTermination(1):
                return True
        query.stop()
        return False

    def stop(self) -> None:
        """Asks the job to end: its steps see ``stopping``, its streams are stopped and their batch is run again by the next start."""
        if self.running:
            self._stop.set()
            for query in self.queries:
                query.stop()
            self.progress.push("Detenido por el usuario", False)

    def wait(self, seconds: float) -> bool:
        if self._thread:
            self._thread.join(seconds)
        return not self.running

    def status(self) -> dict:
        return {"running": self.running and not self.stopping, **self.progress.drained()}
