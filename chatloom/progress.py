"""How far a stream has come."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql.streaming import StreamingQueryListener


@dataclass(frozen=True)
class Progress:
    bytes_processed: int = 0
    total_bytes: int | None = None
    items_processed: int = 0
    total_items: int | None = None

    def with_items(self, total: int) -> Progress:
        return replace(self, total_items=total)

    @staticmethod
    def _share(done: int, total: int | None) -> float | None:
        if total is None:
            return None
        return 100.0 if total == 0 else done / total * 100.0

    def percentage(self) -> float | None:
        return self._share(self.bytes_processed, self.total_bytes)

    def items_percentage(self) -> float | None:
        return self._share(self.items_processed, self.total_items)

    def is_complete(self) -> bool:
        return self.total_bytes is not None and self.bytes_processed >= self.total_bytes

    def remaining_bytes(self) -> int | None:
        return None if self.total_bytes is None else max(0, self.total_bytes - self.bytes_processed)


ProgressCallback = Callable[[Progress], None]


def no_progress() -> ProgressCallback:
    return lambda progress: None


def stderr_progress() -> ProgressCallback:
    def show(progress: Progress) -> None:
        if (share := progress.percentage()) is not None:
            print(f"Progress: {share:.1f}%", file=sys.stderr)
        else:
            print(f"Progress: {progress.items_processed} items", file=sys.stderr)

    return show


class ProgressListener(StreamingQueryListener):
    """Calls back after each micro-batch with the rows read so far and, of streams that observe their files' sizes (those of
    ``stream_raw`` and what is made of them), the bytes; and with their numbers in all, where known."""

    def __init__(self, callback: ProgressCallback, total_items: int | None = None, total_bytes: int | None = None):
        super().__init__()
        self.callback, self.seen, self.total, self.bytes, self.total_bytes = callback, 0, total_items, 0, total_bytes

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.seen += event.progress.numInputRows
        for row in event.progress.observedMetrics.values():
            self.bytes += row.asDict().get("chatloom_bytes") or 0
        self.callback(Progress(self.bytes, self.total_bytes, self.seen, self.total))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
