"""Registry of table sources and their pipelines."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

KINDS = ("commune_table", "polygon", "point", "line")


@dataclass(frozen=True)
class Source:
    """A named pipeline: what it is, what it reads, which columns it promises."""

    id: str
    kind: str
    transform: Callable[..., DataFrame]
    inputs: tuple[str, ...] = ()
    fields: Mapping[str, str] = field(default_factory=dict)
    order: int = 100
    enabled: bool = True


class Registry:
    """Sources by id; building one builds its declared inputs first, each once."""

    def __init__(self):
        self._sources: dict[str, Source] = {}

    def source(self, id: str, kind: str, inputs: tuple[str, ...] = (), fields: Mapping[str, str] | None = None, order: int = 100, enabled: bool = True):
        if kind not in KINDS:
            raise ValueError(f"{id}: unknown kind {kind}")
        if id in self._sources:
            raise ValueError(f"{id} is registered twice")

        def add(fn):
            self._sources[id] = Source(id, kind, fn, inputs, fields or {}, order, enabled)
            return fn

        return add

    def all(self) -> list[Source]:
        return sorted((s for s in self._sources.values() if s.enabled), key=lambda s: (s.order, s.id))

    def build(self, id: str, given: Mapping[str, DataFrame], _made: dict | None = None) -> DataFrame:
        """The source's table; ``given`` are raw tables and outputs already at hand.

        A transform sees its declared inputs and nothing else. A promised field that is missing is an error.
        """
        made = {} if _made is None else _made
        if id in given:
            return given[id]
        if id in made:
            return made[id]
        s = self._sources.get(id)
        if s is None:
            raise KeyError(f"no source or table {id}")
        df = s.transform(**{i: self.build(i, given, made) for i in s.inputs})
        lacking = [f for f in s.fields if f not in df.columns]
        if lacking:
            raise ValueError(f"{id} lacks {lacking}")
        made[id] = df
        return df


def processed(spark: SparkSession, root: str, id: str, inputs: tuple[str, ...]) -> DataFrame:
    """Another source's written output, if it is declared."""
    if id not in inputs:
        raise ValueError(f"{id} is not a declared input")
    return spark.read.parquet(f"{root}/{id}")
