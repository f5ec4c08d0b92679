"""Sequence numbers of a node's own writes: 1, 2, 3 ... Numbers are leased in blocks that a file remembers, so none is given twice, not
even after a crash; what a lease had left is skipped then."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..operators import vector
from ..sources.storage import Files

LEASE = 1000


class Sequencer:
    def __init__(self, spark: SparkSession, path: str, origin: int, lease: int = LEASE):
        self.files, self.path, self.origin, self.lease = Files(spark), path, origin, lease
        self.last = self.leased = json.loads(self.files.read(path))["leased"] if self.files.has_text(path) else 0
        self.open: list[int] = []

    def assign(self, n: int) -> range:
        """The next n numbers; they are open until they are published or released."""
        if self.last + n > self.leased:
            self.leased = self.last + max(n, self.lease)
            self.files.write(self.path, json.dumps({"leased": self.leased}))
        out = range(self.last + 1, self.last + n + 1)
        self.last += n
        self.open += out
        return out

    def published(self, numbers) -> None:
        done = set(numbers)
        self.open = [k for k in self.open if k not in done]

    #: A number whose write came to nothing is done with as well.
    released = published

    def confirmed_through(self) -> int:
        """The highest number with no open one at or below it."""
        return min(self.open) - 1 if self.open else self.last

    def stamp(self, batch: DataFrame, order_by: str = "nth") -> DataFrame:
        """A batch with this node's stamps in order."""
        numbers = self.assign(batch.count())
        return vector.stamp(batch, self.origin, numbers.start - 1, order_by)
