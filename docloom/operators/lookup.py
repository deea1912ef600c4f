"""Lookup: entities enriched with a dimension that changes, re-emitted as it changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from ..errors import ConfigurationError
from ..names import checked_name
from ..options import LookupOptions
from ..plans.replay import lookup_replay
from ..plans.snapshot import lookup_snapshot
from .changes import Key

Enricher = Callable[[Column, Column], Column]


class Lookup:
    """``Lookup.of(name, entities, key).from_(dimensions).enrich(enricher)``.

    ``key`` gives an entity's dimension id. ``enricher`` gets the entity and its dimension, null without
    one, as columns and returns the new value. It is evaluated for unmatched entities too, where
    ``require_match`` then drops the result.
    """

    def __init__(self, name: str, entities: DataFrame, key: Key):
        self.name, self.entities, self.key = checked_name(name, "lookup name"), entities, key
        self.options, self._done = LookupOptions(), False

    @classmethod
    def of(cls, name: str, entities: DataFrame, key: Key) -> Lookup:
        return cls(name, entities, key)

    def with_options(self, options: LookupOptions) -> Lookup:
        self._open()
        self.options = options
        return self

    def from_(self, dimensions: DataFrame) -> WithDimension:
        self._open()
        return WithDimension(self, dimensions)

    def _open(self) -> None:
        if self._done:
            raise ConfigurationError(f"lookup {self.name!r} has been enriched already")


class WithDimension:
    def __init__(self, lookup: Lookup, dimensions: DataFrame):
        self.lookup, self.dimensions = lookup, dimensions

    def enrich(self, enricher: Enricher, mode: str | None = None) -> DataFrame:
        """The enriched changes.

        ``mode`` is 'snapshot' (last change of live entities; the default for batch input), 'replay' (all
        changes) or 'stream' (the default for streaming input).
        """
        up = self.lookup
        up._open()
        streaming = up.entities.isStreaming or self.dimensions.isStreaming
        mode = mode or ("stream" if streaming else "snapshot")
        if streaming != (mode == "stream"):
            raise ConfigurationError(f"mode {mode!r} does not fit the input")
        up._done = True
        if mode == "snapshot":
            return lookup_snapshot(up.entities, self.dimensions, up.key, enricher, up.options.require_match, f"lookup {up.name}")
        if mode == "replay":
            return lookup_replay(up.entities, self.dimensions, up.key, enricher, up.options.require_match, f"lookup {up.name}")
        from ..streaming.pipeline import lookup_stream

        return lookup_stream(up.name, up.entities, self.dimensions, up.key, enricher, up.options)
