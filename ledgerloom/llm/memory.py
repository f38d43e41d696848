"""What a worker remembers between texts, bounded, in two generations."""

from __future__ import annotations


class Memory:
    """Values by key. What is asked for stays; of the rest, the older half goes when ``limit`` keys are reached.

    New keys and keys found in the old generation are put into the young one. When that holds half of ``limit``, it
    becomes the old one and the old one is dropped, so at most ``limit`` keys are held.
    """

    def __init__(self, limit: int):
        self.half = max(1, limit // 2)
        self.young: dict = {}
        self.old: dict = {}

    def find(self, keys: list) -> tuple[list, list[int]]:
        """The values of the keys, None where unknown, and the places of the unknown ones. A value is never None."""
        if len(self.young) >= self.half:
            self.young, self.old = {}, self.young
        values = list(map(self.young.get, keys))
        if None not in values:
            return values, []
        missing = []
        for i in [i for i, value in enumerate(values) if value is None]:
            value = self.old.get(keys[i])
            if value is None:
                missing.append(i)
            else:
                self.young[keys[i]] = values[i] = value
        return values, missing

    def keep(self, key, value) -> None:
        self.young[key] = value
