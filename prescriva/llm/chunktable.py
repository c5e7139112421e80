"""A bounded table of what each distinct chunk of text becomes, kept by a Python worker between batches."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable


class ChunkTable:
    """Distinct chunk -> value; each chunk is worked out once while it stays in the table.

    Two generations of at most ``limit`` entries bound the memory: when the younger is
    full it becomes the older, and what is asked for again moves up. A chunk that has
    left the table is worked out anew, so results never depend on ``limit``.
    """

    def __init__(self, work_out: Callable[[list], Iterable], limit: int = 400_000):
        self.work_out, self.limit = work_out, limit
        self.young: dict[Hashable, object] = {}
        self.old: dict[Hashable, object] = {}

    def lookup(self, chunks: list) -> list:
        """The value of each of the given chunks."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = [young.get(chunk) for chunk in chunks]
        missing = []
        for chunk in dict.fromkeys(c for c, value in zip(chunks, out, strict=True) if value is None):
            if (value := old.get(chunk)) is not None:
                young[chunk] = value
            else:
                missing.append(chunk)
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            young.update(zip(part, self.work_out(part), strict=True))
        return [young[c] if value is None else value for c, value in zip(chunks, out, strict=True)]
