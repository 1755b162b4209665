"""A bounded cache of collected pages on the driver."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable

from .search import QueryResult

TTL_SECONDS, ENTRIES = 30.0, 256


class PageCache:
    """Least-recently-used pages with a time to live. Keys are tuples, so no two queries share one; a table's
    version belongs in its key, so that ingest outdates what was cached. Partial results aren't kept."""

    def __init__(self, entries: int = ENTRIES, ttl: float = TTL_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.entries, self.ttl, self.clock = entries, ttl, clock
        self._pages: OrderedDict[Hashable, tuple[float, QueryResult]] = OrderedDict()

    def __len__(self) -> int:
        return len(self._pages)

    def get(self, key: Hashable) -> QueryResult | None:
        found = self._pages.get(key)
        if found is None:
            return None
        if self.clock() >= found[0]:
            del self._pages[key]
            return None
        self._pages.move_to_end(key)
        return found[1]

    def put(self, key: Hashable, result: QueryResult) -> None:
        if result.partial:
            return
        self._pages[key] = (self.clock() + self.ttl, result)
        self._pages.move_to_end(key)
        while len(self._pages) > self.entries:
            self._pages.popitem(last=False)

    def clear(self) -> None:
        self._pages.clear()
