"""Names, and the ids of sinks and states that derive from them.

Ids depend on the user's names alone. States and sinks' checkpoints are found by them; Spark finds a
stateful operator by its place in the query.
"""

from __future__ import annotations

import re

from .errors import ConfigurationError

_NAME = re.compile(r"[a-z][a-z0-9-]*")


def checked_name(name: str, what: str = "name") -> str:
    """``name`` if it is lower-case letters, digits and hyphens and starts with a letter."""
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise ConfigurationError(f"{what} {name!r} must match {_NAME.pattern}")
    return name


# Patterns of the sinks' ids.
UIDS = {
    "kafka_sink": "kafka_sink_{name}",
    "search_sink": "elasticsearch_sink_{name}",
}

# Patterns of state ids.
STATES = {
    "parent": "{name}.parent",
    "child": "{name}.child.{slot}",
    "last_doc": "{name}.last-doc",
    "child_route": "{name}.route.{slot}.last",
    "entities": "{name}.entities",
    "dimension": "{name}.dimension",
    "route": "{name}.route.last",
}


def uid(kind: str, name: str) -> str:
    return UIDS[kind].format(name=checked_name(name))


def state_id(kind: str, name: str, slot: str = "") -> str:
    return STATES[kind].format(name=checked_name(name), slot=checked_name(slot) if slot else "")
