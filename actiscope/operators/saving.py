"""Writer calls for models that Spark's own writers don't know."""

from __future__ import annotations

from collections.abc import Callable


class Saver:
    """Gives models made of several parts the writer calls of Spark's own models."""

    def __init__(self, save: Callable[[str, str], None], mode: str = "error"):
        self._save, self._mode = save, mode

    def overwrite(self) -> Saver:
        return Saver(self._save, "overwrite")

    def save(self, path: str) -> None:
        self._save(path, self._mode)
