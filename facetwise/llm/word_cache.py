"""A bounded word table that lives as long as a Python worker."""
from __future__ import annotations

import sys
import types


class WordCache:
    """Two generations of at most ``limit`` entries: when the young one is full it becomes
    the old one, and words that are met again move back, so frequent words stay."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, words) -> list:
        """Those of the distinct words that are in no generation; others become young."""
        out = []
        for w in words:
            if w not in self.young:
                if w in self.old:
                    self.young[w] = self.old[w]
                else:
                    out.append(w)
        return out

    def settle(self) -> None:
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}


def worker_cache(key, limit: int) -> WordCache:
    """The cache of this worker process for a key; tasks of a reused worker share it."""
    state = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    caches = state.__dict__.setdefault("caches", {})
    if key not in caches:
        caches[key] = WordCache(limit)
    return caches[key]


def worker_value(key, make):
    """A value made once in this worker process."""
    state = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    values = state.__dict__.setdefault("values", {})
    if key not in values:
        values[key] = make()
    return values[key]


def release() -> None:
    """Lets go of all caches and values of this worker process, for operators that use none:
    Spark hands a worker on to the tasks of later stages, which share its memory."""
    state = sys.modules.get("_llm_worker_state")
    if state is not None:
        state.__dict__.update(caches={}, values={})
