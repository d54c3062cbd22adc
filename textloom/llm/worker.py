"""Models that a Python worker builds once, however many tasks it runs."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from typing import Any
from uuid import uuid4

from pyspark.sql import SparkSession

#: Models that a worker keeps; the oldest is dropped first.
KEPT = 6

_models: OrderedDict[str, Any] = OrderedDict()


class Shared:
    """A broadcast value and what a worker builds from it, both by one name."""

    def __init__(self, spark: SparkSession, value: object, build: Callable[[Any], Any]) -> None:
        self.name, self.value, self.build = uuid4().hex, spark.sparkContext.broadcast(value), build

    def get(self) -> Any:  # noqa: ANN401
        """The built model of this worker."""
        if self.name not in _models:
            while len(_models) >= KEPT:
                _models.popitem(last=False)
            _models[self.name] = self.build(self.value.value)
        return _models[self.name]


def only(*shared: Shared) -> list[Any]:
    """The built models of this worker, which forgets all others: those of earlier stages would only take memory."""
    for name in set(_models) - {x.name for x in shared}:
        del _models[name]
    return [x.get() for x in shared]
