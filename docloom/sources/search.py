"""Writing changes to a search index: the newest operation per id, in bulk, with retries.

Within a micro-batch the newest operation of an id replaces earlier ones, in Spark. Rows are then dealt
by id, and each task sends its operations in bounded bulks, one at a time, so operations of an id keep
their order. The end of the micro-batch is the flush. Writes are idempotent per id: delivering a batch
again gives the same index. Do not combine with speculative execution.
"""

from __future__ import annotations

import base64
import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..errors import ConfigurationError, SearchWriteError
from ..names import uid
from ..operators.changes import DELETE
from .kafka import Encoder, json_encoder

# Accounting per operation, server-side timeout and statuses worth another try.
OVERHEAD = 64
SERVER_TIMEOUT_S = 20
SOCKET_TIMEOUT_S = 30
TRANSIENT = frozenset({429, 502, 503, 504})


class Auth:
    """How requests are authorised; secrets do not show in ``repr``."""

    def header(self) -> str | None:
        return None

    def __repr__(self) -> str:
        return f"{type(self).__name__}()"


@dataclass(frozen=True, repr=False)
class BasicAuth(Auth):
    user: str
    password: str

    def __post_init__(self):
        if not self.user.strip() or not self.password.strip():
            raise ConfigurationError("user and password must not be blank")

    def header(self) -> str:
        return "Basic " + base64.b64encode(f"{self.user}:{self.password}".encode()).decode()

    def __repr__(self) -> str:
        return f"BasicAuth(user={self.user!r}, password=***)"


@dataclass(frozen=True, repr=False)
class ApiKeyAuth(Auth):
    key: str

    def __post_init__(self):
        if not self.key.strip():
            raise ConfigurationError("the API key must not be blank")

    def header(self) -> str:
        return f"ApiKey {self.key}"

    def __repr__(self) -> str:
        return "ApiKeyAuth(key=***)"


def checked_host(host: str) -> str:
    """An http or https address without path, query or credentials."""
    try:
        url = urlsplit(host)
        port = url.port
    except ValueError as e:
        raise ConfigurationError(f"host {host!r}: {e}") from e
    if url.scheme not in ("http", "https") or not url.hostname:
        raise ConfigurationError(f"host {host!r} must start with http:// or https:// and name a host")
    if url.username is not None or url.password is not None:
        raise ConfigurationError("hosts must not hold credentials; set auth")
    if url.path.strip("/") or url.query or url.fragment:
        raise ConfigurationError(f"host {host!r} must not have a path or query")
    return f"{url.scheme}://{url.hostname if ':' not in url.hostname else f'[{url.hostname}]'}" + (f":{port}" if port else "")


@dataclass(frozen=True)
class SearchSinkOptions:
    hosts: tuple[str, ...]
    index: str
    auth: Auth = field(default_factory=Auth)
    max_actions: int = 1000
    max_bytes: int = 5 * 1024 * 1024
    max_retries: int = 8
    first_backoff_ms: int = 100
    last_backoff_ms: int = 10_000

    def __post_init__(self):
        if not self.hosts:
            raise ConfigurationError("at least one host is needed")
        object.__setattr__(self, "hosts", tuple(map(checked_host, self.hosts)))
        if not self.index.strip():
            raise ConfigurationError("index must not be blank")
        for name in ("max_actions", "max_bytes", "first_backoff_ms", "last_backoff_ms"):
            if getattr(self, name) < 1:
                raise ConfigurationError(f"{name} must be positive")
        if self.max_retries < 0:
            raise ConfigurationError("max_retries must not be negative")
        if self.last_backoff_ms < self.first_backoff_ms:
            raise ConfigurationError("last_backoff_ms must not be below first_backoff_ms")

    def backoff_ms(self, attempt: int) -> int:
        """The wait before try ``attempt`` + 1: doubled each time, up to the longest."""
        return min(self.last_backoff_ms, self.first_backoff_ms << min(attempt - 1, 40))


@dataclass(frozen=True)
class Operation:
    """Index the document, or delete without one."""

    id: str
    document: str | None = None

    @property
    def bytes(self) -> int:
        return OVERHEAD + len((self.document or "").encode())

    def lines(self, index: str) -> str:
        action = {"delete" if self.document is None else "index": {"_index": index, "_id": self.id}}
        return json.dumps(action, ensure_ascii=False) + "\n" + ("" if self.document is None else self.document + "\n")


class OperationBuffer:
    """Newest operation per id, at the place where the id came first."""

    def __init__(self, max_actions: int, max_bytes: int):
        self.max_actions, self.max_bytes, self.bytes = max_actions, max_bytes, 0
        self._by_id: dict[str, Operation] = {}

    def add(self, operation: Operation) -> None:
        if old := self._by_id.get(operation.id):
            self.bytes -= old.bytes
        self._by_id[operation.id] = operation
        self.bytes += operation.bytes

    @property
    def full(self) -> bool:
        return len(self._by_id) >= self.max_actions or self.bytes >= self.max_bytes

    def drain(self) -> list[Operation]:
        out, self._by_id, self.bytes = list(self._by_id.values()), {}, 0
        return out

    def __len__(self) -> int:
        return len(self._by_id)


@dataclass(frozen=True)
class ItemResult:
    id: str
    status: int
    error: str = ""
    reason: str = ""


class Unreachable(Exception):
    """No usable answer from any host."""


class RequestRefused(Exception):
    """The whole request was answered with a status."""

    def __init__(self, status: int, body: str):
        super().__init__(f"HTTP {status}: {body[:300]}")
        self.status = status


class BulkClient:
    """Bulk requests over HTTP, to one of the hosts at a time."""

    def __init__(self, options: SearchSinkOptions):
        self.options, self.at = options, random.randrange(len(options.hosts))

    def send(self, operations: list[Operation]) -> list[ItemResult]:
        body = "".join(o.lines(self.options.index) for o in operations).encode()
        url = f"{self.options.hosts[self.at]}/_bulk?timeout={SERVER_TIMEOUT_S}s"
        headers = {"Content-Type": "application/x-ndjson"}
        if value := self.options.auth.header():
            headers["Authorization"] = value
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, headers, method="POST"), timeout=SOCKET_TIMEOUT_S) as answer:
                parsed = json.loads(answer.read())
        except urllib.error.HTTPError as e:
            raise RequestRefused(e.code, e.read().decode("utf-8", "replace")) from e
        except (OSError, ValueError) as e:
            self.at = (self.at + 1) % len(self.options.hosts)
            raise Unreachable(str(e)) from e
        out = []
        for item in parsed["items"]:
            (result,) = item.values()
            error = result.get("error") or {}
            out.append(ItemResult(result["_id"], result["status"], error.get("type", ""), error.get("reason", "")))
        return out


def hint(status: int, error: str) -> str:
    """What to look at for a failure."""
    if error in ("mapper_parsing_exception", "document_parsing_exception", "strict_dynamic_mapping_exception"):
        return "the document does not fit the index mapping"
    if status in (401, 403):
        return "check auth and the index privileges"
    if status == 413:
        return "lower max_bytes"
    if error == "index_not_found_exception":
        return "create the index or allow it to be created"
    return ""


def _failure(what: str, status: int, error: str, reason: str) -> SearchWriteError:
    told = hint(status, error)
    return SearchWriteError(f"{what}: status {status} {error} {reason}".strip() + (f" ({told})" if told else ""))


class BulkDispatcher:
    """Sends operations and tries again what failed for passing reasons, and only that."""

    def __init__(self, client: BulkClient, options: SearchSinkOptions, sleep: Callable[[float], None] = time.sleep):
        self.client, self.options, self.sleep = client, options, sleep

    def dispatch(self, operations: list[Operation]) -> None:
        attempt, left = 0, operations
        while left:
            try:
                left, why = self._retryable(left, self.client.send(left))
            except Unreachable as e:
                why = f"no answer: {e}"
            except RequestRefused as e:
                if e.status not in TRANSIENT:
                    raise _failure("bulk request", e.status, "", str(e)) from e
                why = str(e)
            if not left:
                return
            attempt += 1
            if attempt > self.options.max_retries:
                raise SearchWriteError(f"{len(left)} operations failed after {self.options.max_retries} retries: {why}")
            self.sleep(self.options.backoff_ms(attempt) / 1000)

    @staticmethod
    def _retryable(sent: list[Operation], results: list[ItemResult]) -> tuple[list[Operation], str]:
        by_id = {o.id: o for o in sent}
        again, why = [], ""
        for r in results:
            if r.id not in by_id:
                raise SearchWriteError(f"the answer names {r.id!r}, which was not sent")
            operation = by_id.pop(r.id)
            missing = operation.document is None and (r.status == 404 or r.error == "index_not_found_exception")
            if 200 <= r.status < 300 or missing:
                continue
            if r.status not in TRANSIENT:
                raise _failure(f"document {r.id!r}", r.status, r.error, r.reason)
            again.append(operation)
            why = f"document {r.id!r}: status {r.status} {r.error} {r.reason}"
        if by_id:
            raise SearchWriteError(f"the answer does not name {sorted(by_id)[:3]}")
        return again, why


def write_operations(rows: Iterable, options: SearchSinkOptions, client: BulkClient | None = None) -> None:
    """Sends rows (``id, document``) of one task in bulks, and what is left at the end."""
    buffer, sender = OperationBuffer(options.max_actions, options.max_bytes), BulkDispatcher(client or BulkClient(options), options)
    for row in rows:
        buffer.add(Operation(row["id"], row["document"]))
        if buffer.full:
            sender.dispatch(buffer.drain())
    sender.dispatch(buffer.drain())


def newest_operations(changes: DataFrame, encode: Encoder = json_encoder) -> DataFrame:
    """``id, action, document, bytes, seq, sub``: the newest change of each id as an operation."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("kind", "value", "seq", "sub"), F.struct("seq", "sub")).alias("c")).select("id", "c.*")
    delete = F.col("kind") == DELETE
    document = F.when(~delete, F.decode(encode(F.col("value")), "UTF-8"))
    out = last.withColumns({"action": F.when(delete, "delete").otherwise("index"), "document": document})
    size = F.coalesce(F.octet_length("document"), F.lit(0)) + OVERHEAD
    return out.select("id", "action", "document", size.alias("bytes"), "seq", "sub")


def write_changes(changes: DataFrame, options: SearchSinkOptions, encode: Encoder = json_encoder) -> None:
    """Writes a batch of changes."""
    rows = newest_operations(changes, encode).select("id", "document")  # already dealt by id
    rows.foreachPartition(lambda part: write_operations(part, options))


def stream_changes(name: str, changes: DataFrame, options: SearchSinkOptions, checkpoint: str, encode: Encoder = json_encoder) -> DataStreamWriter:
    """A writer of a stream of changes to the index, to be started."""
    writer = changes.writeStream.foreachBatch(lambda batch, _: write_changes(batch, options, encode)).outputMode("update")
    return writer.queryName(uid("search_sink", name)).option("checkpointLocation", f"{checkpoint}/{uid('search_sink', name)}")
