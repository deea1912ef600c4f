"""Options of the operators. Durations are positive; unset means never."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from .errors import ConfigurationError

UNSET = None


def millis(duration: timedelta | None) -> int | None:
    """Whole milliseconds, at least 1; None for an unset duration."""
    return None if duration is None else max(1, int(duration / timedelta(milliseconds=1)))


def _positive(what: str, value: object) -> timedelta:
    if not isinstance(value, timedelta) or value <= timedelta(0):
        raise ConfigurationError(f"{what} must be a positive duration, not {value!r}")
    return value


class _Durations:
    """Checks durations that are given by name; an explicit None is refused, leaving one out is not."""

    _durations: tuple[str, ...] = ()

    @classmethod
    def of(cls, **given: object):
        for name in cls._durations:
            if name in given:
                _positive(name, given[name])
        return cls(**given)

    def __post_init__(self):
        for name in self._durations:
            if getattr(self, name) is not None:
                _positive(name, getattr(self, name))


@dataclass(frozen=True)
class NestOptions(_Durations):
    """``parent_state_ttl``: parents and last documents are forgotten; ``orphan_timeout``: children without parent are.

    ``coalesce``: of a stream's micro-batch only a parent's last document, and its last delete before that, are emitted.
    """

    parent_state_ttl: timedelta | None = UNSET
    orphan_timeout: timedelta | None = UNSET
    coalesce: bool = False
    _durations = ("parent_state_ttl", "orphan_timeout")


@dataclass(frozen=True)
class ChildOptions(_Durations):
    """``state_ttl``: a slot's children and their last parents are forgotten."""

    state_ttl: timedelta | None = UNSET
    _durations = ("state_ttl",)


@dataclass(frozen=True)
class LookupOptions(_Durations):
    """``state_ttl``: entities, dimension and last keys are forgotten; ``require_match``: entities without dimension are not emitted."""

    state_ttl: timedelta | None = UNSET
    require_match: bool = False
    _durations = ("state_ttl",)
