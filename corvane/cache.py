"""In-process cache whose entries carry visibility expressions."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterable

import numpy as np

from corvane.functions.hashing import murmur3_128
from corvane.functions.security import evaluate


class AuthAwareCache:
    """(namespace, key) to values, each behind an expression; readers get what they may see."""

    def __init__(self):
        self._entries: dict[tuple[str, str], dict[str, object]] = {}
        self.hits = self.misses = 0

    def put(self, namespace: str, key: str, visibility: str, value) -> None:
        self._entries.setdefault((namespace, key), {})[visibility] = value

    def get_if_present(self, namespace: str, key: str, auths: set[str]):
        """The first value that may be seen, or None."""
        for visibility, value in self._entries.get((namespace, key), {}).items():
            if evaluate(visibility, auths):
                self.hits += 1
                return value
        self.misses += 1
        return None

    def get_all_present(self, namespace: str, keys: Iterable[str], auths: set[str]) -> dict[str, object]:
        found = {k: self.get_if_present(namespace, k, auths) for k in keys}
        return {k: v for k, v in found.items() if v is not None}

    def get(self, namespace: str, key: str, auths: set[str], loader: Callable[[], tuple[str, object]]):
        """The value, loaded with its expression if there is none that may be seen."""
        value = self.get_if_present(namespace, key, auths)
        if value is None:
            visibility, loaded = loader()
            self.put(namespace, key, visibility, loaded)
            value = loaded if evaluate(visibility, auths) else None
        return value

    def invalidate_all(self, namespace: str | None = None) -> None:
        self._entries = {} if namespace is None else {k: v for k, v in self._entries.items() if k[0] != namespace}

    def stats(self) -> dict[str, int]:
        return {"hits": self.hits, "misses": self.misses, "size": sum(map(len, self._entries.values()))}


class BloomFilters:
    """A stack of Bloom filters on the driver: a new one is begun when the last is too full to be right often enough.
    Queries don't need it, their semi joins are exact."""

    def __init__(self, elements: int = 1_000_000, rate: float = 0.1, limit: float = 0.3):
        self.elements, self.rate, self.limit = elements, rate, limit
        self.bits = max(64, int(np.ceil(-elements * np.log(rate) / np.log(2) ** 2 / 64)) * 64)
        self.hashes = max(1, round(self.bits / elements * np.log(2)))
        self.filters: list[np.ndarray] = [np.zeros(self.bits // 8, np.uint8)]

    def _places(self, values: list[str]) -> np.ndarray:
        both = murmur3_128([v.encode() for v in values]).view(np.uint64)
        step = np.arange(self.hashes, dtype=np.uint64)
        return ((both[:, :1] + step * both[:, 1:]) % np.uint64(self.bits)).astype(np.int64)

    def expected_rate(self) -> float:
        """Of false positives, of the last filter."""
        return float(np.bitwise_count(self.filters[-1]).sum() / self.bits) ** self.hashes

    def put_all(self, values: Iterable[str]) -> None:
        values = list(values)
        step = max(1, self.elements // 10)
        for i in range(0, len(values), step):
            if self.expected_rate() >= self.limit:
                self.filters.append(np.zeros(self.bits // 8, np.uint8))
            at = self._places(values[i : i + step]).reshape(-1)
            np.bitwise_or.at(self.filters[-1], at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def put(self, value: str) -> None:
        self.put_all([value])

    def might_contain(self, value: str) -> bool:
        at = self._places([value])[0]
        return any(bool((f[at >> 3] >> (at & 7).astype(np.uint8) & 1).all()) for f in self.filters)

    def dumps(self) -> str:
        return json.dumps({"elements": self.elements, "rate": self.rate, "limit": self.limit, "filters": [base64.b64encode(f).decode() for f in self.filters]})

    @classmethod
    def loads(cls, text: str) -> BloomFilters:
        own = json.loads(text)
        out = cls(own["elements"], own["rate"], own["limit"])
        out.filters = [np.frombuffer(base64.b64decode(f), np.uint8).copy() for f in own["filters"]]
        return out

    def copy(self) -> BloomFilters:
        return self.loads(self.dumps())
