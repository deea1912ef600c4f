"""Kafka codecs without a broker, and the search sink against a scripted client and a local HTTP server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import ConfigurationError, SearchWriteError
from docloom.examples.resume import DOCUMENT_AVRO, Config, avro_schema, schema
from docloom.operators.changes import change_schema
from docloom.sources import kafka, search

VALUE = T.StructType([T.StructField("name", T.StringType()), T.StructField("age", T.LongType())])


def changes(spark, *rows):
    return spark.createDataFrame([(k, i, v, n, 0) for n, (k, i, v) in enumerate(rows)], change_schema(VALUE))


def records(spark, *values):
    fields = "value binary, topic string, partition int, offset long"
    return spark.createDataFrame([(bytearray(v.encode()) if v is not None else None, "rows", 2, 7 + n) for n, v in enumerate(values)], fields)


def test_encode(spark):
    rows = kafka.encode_changes(changes(spark, ("U", "kandidat-ü", ("Zoë", None)), ("D", "c3", ("日本", 1)))).collect()
    assert bytes(rows[0].key) == "kandidat-ü".encode() and json.loads(bytes(rows[0].value)) == {"name": "Zoë", "age": None}
    assert bytes(rows[1].key) == b"c3" and rows[1].value is None


def test_decode(spark):
    flag, decode = kafka.DeleteFlag(lambda r: F.coalesce(r["deleted"], F.lit(False))), kafka.json_decoder(schema("experiences"))
    frame = records(spark, '{"id":"e1","candidateId":"c1","title":"dev","companyId":"k1","deleted":false}', '{"id":"e1","deleted":true}')
    got = kafka.changes_from_records("rows", frame, decode, lambda r: r["id"], flag).collect()
    assert [(r.kind, r.id, r.seq) for r in got] == [("U", "e1", 7), ("D", "e1", 8)] and got[0].value.companyName is None
    with pytest.raises(Exception, match="rows-2@7"):
        kafka.changes_from_records("rows", records(spark, None), decode, lambda r: r["id"], flag).collect()
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        kafka.changes_from_records("rows", records(spark, "no json"), decode, lambda r: r["id"], flag).collect()
    dropping = lambda v: F.when(F.length(v) > 3, F.struct(F.decode(v, "UTF-8").alias("id")))
    assert kafka.decode_records(records(spark, "abc", "abcd"), dropping).count() == 1


def test_order_of_records(spark):
    """By offset, or for batches of several topics by time, with the offset after it."""
    flag, decode = kafka.DeleteFlag(lambda r: F.lit(False)), kafka.json_decoder(T.StructType([T.StructField("id", T.StringType())]))
    frame = records(spark, '{"id":"a"}', '{"id":"b"}').withColumn("timestamp", F.timestamp_millis(F.lit(1_700_000_000_123)))
    by_offset = kafka.changes_from_records("rows", frame, decode, lambda r: r["id"], flag).collect()
    assert [(r.seq, r.sub) for r in by_offset] == [(7, 0), (8, 0)]
    by_time = kafka.changes_from_records("rows", frame, decode, lambda r: r["id"], flag, "timestamp").collect()
    assert [(r.seq, r.sub) for r in by_time] == [(1_700_000_000_123, 7), (1_700_000_000_123, 8)]
    with pytest.raises(ConfigurationError):
        kafka.changes_from_records("rows", frame, decode, lambda r: r["id"], flag, "arrival")


def test_registry_frame(spark):
    frame = spark.createDataFrame([(bytearray(b"abc"),)], "v binary").select(kafka.framed(F.col("v"), 258).alias("v"))
    assert bytes(frame.first().v) == b"\x00\x00\x00\x01\x02abc"
    assert bytes(frame.select(kafka.unframed(F.col("v")).alias("v")).first().v) == b"abc"
    for bad in (b"", b"\x01\x00\x00\x00\x01x"):
        with pytest.raises(Exception, match="frame"):
            spark.createDataFrame([(bytearray(bad),)], "v binary").select(kafka.unframed(F.col("v"))).collect()
    assert [f["name"] for f in json.loads(DOCUMENT_AVRO)["fields"]] == ["id", "name", "experiences", "skills"]


def test_kafka_options():
    o = kafka.KafkaSourceOptions("b:9092", "t", "g", properties={"max.poll.records": "5"}).reader()
    assert o["kafka.max.poll.records"] == "5" and o["startingOffsets"] == "earliest" and o["kafka.group.id"] == "g"
    assert kafka.KafkaSinkOptions("b", "t").writer() == {"kafka.bootstrap.servers": "b", "topic": "t"}
    bad = [
        lambda: kafka.KafkaSourceOptions("", "t", "g"), lambda: kafka.KafkaSourceOptions("b", " ", "g"), lambda: kafka.KafkaSourceOptions("b", "t", ""),
        lambda: kafka.KafkaSourceOptions("b", "t", "g", properties={"group.id": "x"}), lambda: kafka.KafkaSinkOptions("b", "t", properties={"bootstrap.servers": "x"}),
        lambda: kafka.KafkaSinkOptions("b", "t", "exactly-once"), lambda: kafka.KafkaSinkOptions("b", "t", "exactly-once", "p"), lambda: kafka.KafkaSinkOptions("b", "t", transactional_id_prefix="p"),
        lambda: kafka.KafkaSinkOptions("b", "t", "twice"),
    ]
    for make in bad:
        with pytest.raises(ConfigurationError):
            make()


def options(**given):
    return search.SearchSinkOptions(("http://localhost:9200",), "docs", **given)


def test_search_options():
    bad = [
        lambda: search.SearchSinkOptions((), "docs"), lambda: search.SearchSinkOptions(("http://h",), " "), lambda: options(max_actions=0), lambda: options(max_retries=-1),
        lambda: options(first_backoff_ms=500, last_backoff_ms=100), *[lambda h=h: search.checked_host(h) for h in ("localhost:9200", "ftp://h", "http://", "http://h/path", "http://h?q", "http://u:p@h", "http://h:x")],
        lambda: search.BasicAuth("", "p"), lambda: search.ApiKeyAuth(" "),
    ]
    for make in bad:
        with pytest.raises(ConfigurationError):
            make()
    o = options(first_backoff_ms=100, last_backoff_ms=500)
    assert [o.backoff_ms(n) for n in (1, 3, 4, 10_000)] == [100, 400, 500, 500]
    assert "secret" not in repr(options(auth=search.BasicAuth("me", "secret"))) + repr(search.ApiKeyAuth("secret"))
    assert search.BasicAuth("a", "b").header() == "Basic YTpi" and search.ApiKeyAuth("k").header() == "ApiKey k"


def test_buffer():
    b = search.OperationBuffer(2, 1000)
    b.add(search.Operation("a", "x" * 10))
    b.add(search.Operation("a", "x"))
    assert b.bytes == 65 and not b.full
    b.add(search.Operation("b"))
    b.add(search.Operation("a"))
    assert b.full and [o.id for o in b.drain()] == ["a", "b"] and b.bytes == 0 and len(b) == 0
    b = search.OperationBuffer(100, 100)
    b.add(search.Operation("a", "é" * 18))
    assert b.full


class Scripted:
    def __init__(self, *answers):
        self.answers, self.sent = list(answers), []

    def send(self, operations):
        self.sent.append([o.id for o in operations])
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return [search.ItemResult(o.id, answer.get(o.id, 200), "e") for o in operations]


def dispatch(client, retries=3, ids=("a", "b")):
    slept = []
    search.BulkDispatcher(client, options(max_retries=retries, first_backoff_ms=100, last_backoff_ms=300), slept.append).dispatch([search.Operation(i, "{}") for i in ids])
    return slept


def test_dispatcher():
    c = Scripted({"b": 429}, {"b": 503}, {})
    assert dispatch(c) == [0.1, 0.2] and c.sent == [["a", "b"], ["b"], ["b"]]
    c = Scripted(search.Unreachable("down"), search.RequestRefused(502, "bad"), {"a": 504}, {})
    assert dispatch(c) == [0.1, 0.2, 0.3]
    for failing in (Scripted({"a": 429, "b": 400}), Scripted(search.RequestRefused(401, "who")), Scripted(*[{"a": 429}] * 4)):
        with pytest.raises(SearchWriteError):
            dispatch(failing)
    for status in (429, 502, 503, 504):
        assert status in search.TRANSIENT
    for status in (400, 401, 403, 404, 409, 500):
        with pytest.raises(SearchWriteError, match="'a'"):
            dispatch(Scripted({"a": status}))
    strange = Scripted({})
    strange.send = lambda ops: [search.ItemResult("zz", 200)]
    with pytest.raises(SearchWriteError, match="not sent"):
        dispatch(strange)


class Index(BaseHTTPRequestHandler):
    docs: dict = {}
    requests: list = []

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"])).decode().split("\n")[:-1]
        self.requests.append((self.path, self.headers["Authorization"], len(body)))
        items, lines = [], iter(body)
        for line in lines:
            ((action, meta),) = json.loads(line).items()
            if action == "index":
                doc = next(lines)
                try:
                    parsed = json.loads(doc)
                    if not isinstance(parsed.get("age") or 0, int):
                        raise ValueError
                    self.docs[meta["_id"]] = doc
                    result = {"_id": meta["_id"], "status": 200}
                except ValueError:
                    result = {"_id": meta["_id"], "status": 400, "error": {"type": "document_parsing_exception", "reason": "bad"}}
            else:
                found = self.docs.pop(meta["_id"], None)
                result = {"_id": meta["_id"], "status": 200 if found else 404}
            items.append({action: result})
        out = json.dumps({"items": items}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(out)))
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *_):
        pass


@pytest.fixture
def index():
    Index.docs, Index.requests = {}, []
    server = ThreadingHTTPServer(("127.0.0.1", 0), Index)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield search.SearchSinkOptions((f"http://127.0.0.1:{server.server_port}",), "docs", auth=search.ApiKeyAuth("k"), max_actions=2)
    server.shutdown()


def test_search_sink(spark, index):
    batch = changes(spark, ("U", "a", ("Zoë", 30)), ("U", "gone", ("x", 1)), ("D", "gone", ("x", 1)), ("U", "tenant/1 ä?#", ("t", None)), ("D", "never", ("n", 1)), ("U", "c", ("1", 1)), ("D", "c", ("1", 1)), ("U", "c", ("2", 2)))
    for _ in range(2):  # replayed
        search.write_changes(batch, index)
        assert {i: json.loads(d) for i, d in Index.docs.items()} == {"a": {"name": "Zoë", "age": 30}, "tenant/1 ä?#": {"name": "t", "age": None}, "c": {"name": "2", "age": 2}}
    assert all(p == "/_bulk?timeout=20s" and a == "ApiKey k" and n <= 4 for p, a, n in Index.requests)
    search.write_changes(changes(spark, ("U", "a", ("alicia", None))), index)
    assert json.loads(Index.docs["a"]) == {"name": "alicia", "age": None}


@pytest.mark.parametrize("text", ['{"age":"thirty"}', "not json"])
def test_search_sink_fails_for_good(spark, index, text):
    with pytest.raises(Exception, match="'bad'.*mapping"):
        search.write_changes(changes(spark, ("U", "bad", ("x", 1))), index, lambda v: F.encode(F.lit(text), "UTF-8"))


def test_example_config():
    base = ["--bootstrap-servers", "b", "--checkpoint", "/c"]
    assert Config.parse(base).output == "kafka"
    c = Config.parse([*base, "--output", "elasticsearch", "--elasticsearch-hosts", "http://a,http://b", "--elasticsearch-index", "i"])
    assert c.search_hosts == ("http://a", "http://b")
    for bad in (["--checkpoint", "/c"], [*base, "--format", "xml"], [*base, "--output", "file"], [*base, "--format", "avro"], [*base, "--output", "elasticsearch"], ["--bootstrap-servers", "b"]):
        with pytest.raises(ConfigurationError):
            Config.parse(bad)
    assert json.loads(avro_schema("companies"))["fields"][-1] == {"name": "deleted", "type": "boolean", "default": False}
