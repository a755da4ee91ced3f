"""What a Python worker remembers of spellings it has turned into token ids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LONGEST = 64  # bytes; longer spellings are not remembered
AT_ONCE = 4096


class Spellings:
    """Ids of spellings, each worked out once while it is met often.

    Two generations of at most `limit` spellings each: when the young one is full it becomes the old one,
    whose spellings are taken over as they are met again. So rich text costs the rare half, not all.
    """

    def __init__(self, make: Callable[[list[bytes]], list[np.ndarray]], limit: int = 250_000):
        self.make, self.limit = make, limit
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _keep(self, spelling: bytes, ids: bytes) -> None:
        if len(spelling) <= LONGEST:
            if len(self.young) >= self.limit:
                self.young, self.old = {}, self.young
            self.young[spelling] = ids

    def __call__(self, spellings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all spellings in a row (unsigned 32-bit), and how many each has."""
        found = list(map(self.young.get, spellings))
        new = []
        for at in [i for i, ids in enumerate(found) if ids is None]:
            spelling = spellings[at]
            ids = self.old.get(spelling)
            if ids is None:
                new.append(at)
            else:
                found[at] = ids
                self._keep(spelling, ids)
        for start in range(0, len(new), AT_ONCE):
            part = new[start : start + AT_ONCE]
            for at, ids in zip(part, self.make([spellings[i] for i in part]), strict=True):
                found[at] = ids.tobytes()
                self._keep(spellings[at], found[at])
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        return np.frombuffer(b"".join(found), dtype=np.uint32), sizes
