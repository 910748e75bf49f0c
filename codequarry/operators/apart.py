"""Work that leaves something behind in its process, done in a helper process that is replaced in time."""

from __future__ import annotations

import gc
import multiprocessing
import traceback
from collections.abc import Callable

# Input after which a helper is replaced.
HELPER_BYTES = 32 << 20


class Apart:
    """Calls `work(argument)` in a forked helper process, a new one after every `limit` bytes of input.

    Python's parser keeps every identifier it meets for the life of its process, so a worker that parses file
    after file would grow with the distinct names of the corpus.
    """

    def __init__(self, work: Callable, limit: int = HELPER_BYTES):
        self.work, self.limit = work, limit
        self.helper = self.line = None
        self.taken = 0

    def __enter__(self) -> Apart:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __call__(self, argument, size: int):
        if self.helper is not None and self.taken >= self.limit:
            self.close()
        if self.helper is None:
            self._start()
        self.taken += size
        self.line.send(argument)
        try:
            fine, answer = self.line.recv()
        except EOFError:
            self.helper.join()
            raise RuntimeError(f"the helper process ended with code {self.helper.exitcode}") from None
        if not fine:
            raise RuntimeError(answer)
        return answer

    def _start(self) -> None:
        fork = multiprocessing.get_context("fork")
        self.line, far = fork.Pipe()
        self.helper = fork.Process(target=self._serve, args=(far, self.line), daemon=True)
        self.helper.start()
        far.close()
        self.taken = 0

    def _serve(self, line, near) -> None:
        # Without the caller's end of its own, the helper ends with its caller.
        near.close()
        # Syntax trees are freed by reference counting; cycle collection would only rescan them.
        gc.disable()
        while True:
            try:
                argument = line.recv()
            except EOFError:
                return
            try:
                answer = (True, self.work(argument))
            except Exception:
                answer = (False, traceback.format_exc())
            line.send(answer)

    def close(self) -> None:
        if self.helper is not None:
            self.line.close()
            self.helper.join()
            self.helper = self.line = None
