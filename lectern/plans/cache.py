"""A small cache of results on the driver: entries expire, and the least recently used goes when it is full."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any


class ExpiringCache:
    def __init__(self, most: int, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.most, self.seconds, self.clock = most, seconds, clock
        self._held: OrderedDict[Hashable, tuple[float, Any]] = OrderedDict()

    def get(self, key: Hashable, make: Callable[[], Any]) -> Any:
        """The value of a key, made anew if there is none or it has expired."""
        now = self.clock()
        if key in self._held and now - self._held[key][0] < self.seconds:
            self._held.move_to_end(key)
            return self._held[key][1]
        value = make()
        self._held[key] = (now, value)
        self._held.move_to_end(key)
        while len(self._held) > self.most:
            self._held.popitem(last=False)
        return value

    def __len__(self) -> int:
        return len(self._held)
