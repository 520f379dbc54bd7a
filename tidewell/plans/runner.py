"""Named steps in order with a status that can be polled."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Sequence

LOG_LINES, SHOWN_LINES = 200, 20


class Runner:
    """idle, running, done or error; starting is atomic, so a run never starts twice."""

    def __init__(self, steps: Sequence[tuple[str, Callable[[Callable[[str], None]], None]]], count: Callable[[], int] = lambda: 0):
        self.steps, self.count = steps, count
        self.lock = threading.Lock()
        self.log: deque[str] = deque(maxlen=LOG_LINES)
        self.state = {"status": "idle", "stage": None, "started_at": None, "finished_at": None, "new_documents": None, "error": None}

    def start(self) -> bool:
        with self.lock:
            if self.state["status"] == "running":
                return False
            self.log.clear()
            self.state = {"status": "running", "stage": None, "started_at": time.time(), "finished_at": None, "new_documents": None, "error": None}
        threading.Thread(target=self._run, daemon=True).start()
        return True

    def _set(self, **values) -> None:
        with self.lock:
            self.state |= values

    def _run(self) -> None:
        try:
            before = self.count()
            for name, step in self.steps:
                self._set(stage=name)
                step(self.log.append)
            self._set(status="done", stage=None, finished_at=time.time(), new_documents=self.count() - before)
        except Exception as error:  # noqa: BLE001
            self._set(status="error", finished_at=time.time(), error=str(error))

    def status(self) -> dict:
        with self.lock:
            return self.state | {"log_tail": list(self.log)[-SHOWN_LINES:]}
