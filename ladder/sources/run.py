"""What one refresh of the results shares, as an explicit argument instead of process-wide state."""

from __future__ import annotations

import threading
from collections.abc import Callable, Hashable, Mapping
from typing import Any

from pyspark.sql import DataFrame


class InputChanged(RuntimeError):
    """An input file was replaced or removed while results were computed from it."""


class Run(str):
    """An input folder (usable wherever its path is) that remembers the scans, derived tables and plans built over
    it, for as long as the caller keeps it. ``given`` names statements whose results replace their plans.

    ``relations`` are the caller's own relations in place of those derived from the folder (``sources.relations``).

    Each input table's file list is fixed when the Run first reads it: scans, the names of derived tables and ``verify``
    all go by that list. A query called with a plain path gets a Run of its own, so it always sees the input as it is at
    the call.
    """

    given: Mapping[str, DataFrame]
    relations: Mapping[str, DataFrame] | None
    city: Any

    def __new__(cls, sf_dir: str, given: Mapping[str, DataFrame] | None = None,
                relations: Mapping[str, DataFrame] | None = None, city: Any = None) -> Run:
        self = super().__new__(cls, sf_dir)
        self.given = dict(given or {})
        self.relations, self.city = relations, city
        self._pinned: dict[str, tuple[DataFrame, list]] = {}
        self._built: dict[Hashable, Any] = {}
        self._locks: dict[Hashable, threading.RLock] = {}
        self._guard = threading.Lock()
        return self

    def own(self, name: str) -> DataFrame | None:
        """The caller's relation ``name``; None if the Run derives its relations from the folder."""
        if self.relations is None:
            return None
        if name not in self.relations:
            raise ValueError(f"relation {name!r} was not given; there are {sorted(self.relations)}")
        return self.relations[name]

    def pin(self, path: str, df: DataFrame) -> DataFrame:
        """Remember the files that the scan ``df`` of ``path`` will read."""
        from ladder.sources.store import pinned_files

        self._pinned[path] = (df, pinned_files(df))
        return df

    def files(self, *paths: str) -> list[tuple[str, int, int]]:
        return sorted(f for p in paths for f in self._pinned[p][1])

    def verify(self) -> None:
        """Raise ``InputChanged`` if a file that this Run reads was replaced or removed since; files added don't matter,
        as they aren't read."""
        from ladder.sources.store import pinned_files

        for path, (df, files) in self._pinned.items():
            now = set(pinned_files(df.sparkSession.read.schema(df.schema).parquet(path)))
            if gone := [f for f in files if f not in now]:
                raise InputChanged(f"{len(gone)} of the files under {path} changed during the run, first {gone[0][0]}")

    def once(self, key: Hashable, build: Callable[[], Any]) -> Any:
        """``build()``, called once per key; one lock per key, so independent builds run side by side."""
        with self._guard:
            lock = self._locks.setdefault(key, threading.RLock())
        with lock:
            if key not in self._built:
                self._built[key] = build()
            return self._built[key]


def run_of(sf_dir: str) -> Run:
    """``sf_dir`` itself if it is a Run, else a Run over it."""
    return sf_dir if isinstance(sf_dir, Run) else Run(sf_dir)


def once(sf_dir: str, key: Hashable, build: Callable[[], Any]) -> Any:
    """``Run.once`` for a Run; a plain path remembers nothing."""
    return sf_dir.once(key, build) if isinstance(sf_dir, Run) else build()
