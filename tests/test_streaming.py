"""The operators on streams: the example end to end, a restart from the checkpoint, timers."""

import json
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from docloom.examples import resume
from docloom.operators.changes import changes_from
from docloom.operators.lookup import Lookup
from docloom.operators.nest import Nest
from docloom.options import LookupOptions, NestOptions

EVENTS = {
    "projects": [("p1", "e1", "search", False), ("p2", "e1", "index", False), ("p2", "e1", "index", True)],
    "experiences": [("e1", "c1", "dev", "k1", None, False), ("e2", "c1", "qa", "k2", None, False), ("e2", "c2", "qa", "k2", None, False)],
    "companies": [("k1", "Acme", False), ("k2", "Globex", False), ("k1", "Acme Corp", False)],
    "skills": [("s1", "c1", "java", False), ("s2", "c3", "go", False)],
    "candidates": [("c1", "alice", False), ("c2", "bob", False), ("c3", "carol", False), ("c3", "carol", True)],
}
EXPECTED = {
    "c1": ("U", {"id": "c1", "name": "alice", "experiences": [{"id": "e1", "candidateId": "c1", "title": "dev", "companyName": "Acme Corp", "projects": ["search"]}], "skills": ["java"]}),
    "c2": ("U", {"id": "c2", "name": "bob", "experiences": [{"id": "e2", "candidateId": "c2", "title": "qa", "companyName": "Globex", "projects": []}], "skills": []}),
    "c3": ("D", None),
}


def changes(name, frame):
    return changes_from(name, frame, lambda r: r["id"], lambda r: r["deleted"], lambda r: r["seq"])


def numbered(spark, name, start=0):
    fields = resume.schema(name).add("seq", "long")
    return spark.createDataFrame([(*row, start + i) for i, row in enumerate(EVENTS[name])], fields)


def last(rows):
    """The last change per id of rows in the order of emission."""
    out = {r.id: r for r in rows}
    return {i: (r.kind, r.value.asDict(recursive=True) if r.kind == "U" else None) for i, r in out.items()}


def test_resume_in_batch(spark):
    inputs = {n: changes(n, numbered(spark, n, 100 * k)) for k, n in enumerate(EVENTS)}
    assert last(resume.candidate_documents(inputs, "replay").orderBy("seq", "sub").collect()) == EXPECTED
    snapshot = {i: v for i, v in EXPECTED.items() if v[0] == "U"}
    assert last(resume.candidate_documents(inputs, "snapshot").collect()) == snapshot


def source(spark, path, fields):
    path.mkdir(exist_ok=True)
    return spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).json(str(path))


def put(path, rows, n):
    temporary = path.parent / f"{path.name}-{n}.tmp"
    temporary.write_text("".join(json.dumps(r) + "\n" for r in rows))
    temporary.rename(path / f"{n}.json")


def run(frame, sink, checkpoint, until, seconds=240):
    """Runs until the sink's rows meet ``until``, then stops."""
    rows = []
    query = frame.writeStream.outputMode("update").foreachBatch(lambda b, _: rows.extend(b.orderBy("seq", "sub").collect())).option("checkpointLocation", str(checkpoint)).start()
    try:
        deadline = time.time() + seconds
        while not until(rows) and time.time() < deadline:
            if query.exception():
                raise query.exception()
            time.sleep(0.3)
    finally:
        query.stop()
    sink.extend(rows)
    return rows


def test_resume_stream(spark, tmp_path):
    inputs = {}
    for k, name in enumerate(EVENTS):
        fields = resume.schema(name).add("seq", "long")
        inputs[name] = changes(name, source(spark, tmp_path / name, fields))
        rows = [dict(zip(fields.names, (*row, 100 * k + i), strict=True)) for i, row in enumerate(EVENTS[name])]
        put(tmp_path / name, rows, 0)
    seen = []
    run(resume.candidate_documents(inputs), seen, tmp_path / "checkpoint", lambda rows: last(rows) == EXPECTED)
    assert last(seen) == EXPECTED


def people(spark, tmp_path, options=None):
    parents = changes("parents", source(spark, tmp_path / "parents", "id string, deleted boolean, seq long"))
    kids = changes("kids", source(spark, tmp_path / "kids", "id string, top string, deleted boolean, seq long"))
    level = Nest.parent("family", parents)
    if options:
        level = level.with_options(options)
    slot = level.child("kids", kids, lambda v: v["top"])
    return level.assemble(lambda p, c: F.struct(F.array_join(F.transform(c[slot], lambda x: x["id"]), ",").alias("kids")))


def test_restart_keeps_state(spark, tmp_path):
    frame = people(spark, tmp_path)
    put(tmp_path / "parents", [{"id": "a", "deleted": False, "seq": 1}], 0)
    put(tmp_path / "kids", [{"id": "x", "top": "a", "deleted": False, "seq": 2}], 0)
    first = run(frame, [], tmp_path / "checkpoint", lambda rows: last(rows).get("a") == ("U", {"kids": "x"}))
    assert last(first)["a"] == ("U", {"kids": "x"})
    put(tmp_path / "kids", [{"id": "y", "top": "a", "deleted": False, "seq": 3}, {"id": "x", "top": "b", "deleted": False, "seq": 4}], 1)
    again = run(people(spark, tmp_path), [], tmp_path / "checkpoint", lambda rows: last(rows).get("a") == ("U", {"kids": "y"}))
    assert last(again)["a"] == ("U", {"kids": "y"})


@pytest.mark.parametrize("wait", [True, False])
def test_orphans_are_forgotten(spark, tmp_path, wait):
    frame = people(spark, tmp_path, NestOptions(orphan_timeout=timedelta(seconds=1 if wait else 1000)))
    put(tmp_path / "kids", [{"id": "x", "top": "a", "deleted": False, "seq": 1}], 0)
    put(tmp_path / "parents", [{"id": "z", "deleted": False, "seq": 1}], 0)
    run(frame, [], tmp_path / "checkpoint", lambda rows: "z" in last(rows))
    time.sleep(3)
    put(tmp_path / "parents", [{"id": "z2", "deleted": False, "seq": 2}], 1)
    started = time.time()
    run(people(spark, tmp_path, NestOptions(orphan_timeout=timedelta(seconds=1 if wait else 1000))), [], tmp_path / "checkpoint", lambda rows: "z2" in last(rows) and time.time() > started + 4)
    put(tmp_path / "parents", [{"id": "a", "deleted": False, "seq": 3}], 2)
    rows = run(people(spark, tmp_path, NestOptions(orphan_timeout=timedelta(seconds=1 if wait else 1000))), [], tmp_path / "checkpoint", lambda rows: "a" in last(rows))
    assert last(rows)["a"] == ("U", {"kids": "" if wait else "x"})


def test_forgotten_entities_are_not_emitted_again(spark, tmp_path):
    """With a TTL a dimension change no longer finds an entity that was not written for that long."""

    def frame():
        fields = "id string, top string, deleted boolean, seq long"
        entities, dims = (changes(n, source(spark, tmp_path / n, fields)) for n in ("entities", "dims"))
        look = Lookup.of("l", entities, lambda v: v["top"]).with_options(LookupOptions(state_ttl=timedelta(seconds=3)))
        return look.from_(dims).enrich(lambda e, d: F.struct(e["id"].alias("e"), d["top"].alias("d")))

    def step(n, entity, dim, until):
        rows = [{"id": entity, "top": "k", "deleted": False, "seq": n}] if entity else []
        put(tmp_path / "entities", rows, n)
        put(tmp_path / "dims", [{"id": "k", "top": dim, "deleted": False, "seq": n}] if dim else [], n)
        return last(run(frame(), [], tmp_path / "checkpoint", until))

    frame()
    assert step(1, "x", None, lambda rows: "x" in last(rows))["x"] == ("U", {"e": "x", "d": None})
    time.sleep(5)
    got = step(2, "y", "acme", lambda rows: last(rows).get("y") == ("U", {"e": "y", "d": "acme"}))
    assert set(got) == {"y"}


def looked_up(spark, tmp_path, require=False):
    entities = changes("entities", source(spark, tmp_path / "entities", "id string, top string, deleted boolean, seq long"))
    dims = changes("dims", source(spark, tmp_path / "dims", "id string, name string, deleted boolean, seq long"))
    look = Lookup.of("l", entities, lambda v: v["top"]).with_options(LookupOptions(require_match=require))
    return look.from_(dims).enrich(lambda e, d: F.struct(e["top"].alias("top"), d["name"].alias("name")))


@pytest.mark.parametrize("nested", [False, True])
def test_sources_with_orders_of_their_own(spark, tmp_path, nested):
    """Offsets of two topics do not compare: a dimension's high offset must not beat an entity's later move, in one micro-batch or two."""

    def frame():
        out = looked_up(spark, tmp_path)
        if not nested:
            return out
        level = Nest.parent("n", changes("parents", source(spark, tmp_path / "parents", "id string, deleted boolean, seq long")))
        slot = level.child("s", out, lambda v: F.lit("p"))
        return level.assemble(lambda p, c: F.struct(F.array_join(F.transform(c[slot], lambda x: F.concat_ws("/", x["top"], x["name"])), ",").alias("all")))

    def seen(rows, top, name):
        return last(rows).get("p" if nested else "e") == ("U", {"all": f"{top}/{name}"} if nested else {"top": top, "name": name})

    frame()
    if nested:
        put(tmp_path / "parents", [{"id": "p", "deleted": False, "seq": 7}], 0)
    put(tmp_path / "dims", [{"id": "k1", "name": "old", "deleted": False, "seq": 500}, {"id": "k2", "name": "new", "deleted": False, "seq": 2}, {"id": "k1", "name": "older", "deleted": False, "seq": 501}], 0)
    put(tmp_path / "entities", [{"id": "e", "top": "k1", "deleted": False, "seq": 9}, {"id": "e", "top": "k2", "deleted": False, "seq": 10}], 0)
    rows = run(frame(), [], tmp_path / "checkpoint", lambda rows: seen(rows, "k2", "new"), 120)
    assert seen(rows, "k2", "new")
    put(tmp_path / "dims", [{"id": "k2", "name": "newer", "deleted": False, "seq": 3}, {"id": "k1", "name": "oldest", "deleted": False, "seq": 900}], 1)
    put(tmp_path / "entities", [{"id": "f", "top": "k3", "deleted": False, "seq": 1}] if not nested else [], 1)
    rows = run(frame(), [], tmp_path / "checkpoint", lambda rows: seen(rows, "k2", "newer"), 120)
    assert seen(rows, "k2", "newer")


def test_coalesced_documents(spark, tmp_path):
    frame = people(spark, tmp_path, NestOptions(coalesce=True))
    put(tmp_path / "parents", [{"id": "a", "deleted": False, "seq": 1}], 0)
    put(tmp_path / "kids", [{"id": f"k{i}", "top": "a", "deleted": False, "seq": 2 + i} for i in range(9)], 0)
    rows = run(frame, [], tmp_path / "checkpoint", lambda rows: last(rows).get("a") == ("U", {"kids": ",".join(f"k{i}" for i in range(9))}))
    assert len(rows) <= 2 and last(rows)["a"][1]["kids"].startswith("k0,k1")


def test_example_needs_the_state_store_it_sets(monkeypatch):
    """The command line's session has the state store that its operators need."""
    given = {}

    class Builder:
        def appName(self, _):
            return self

        def config(self, name, value):
            given[name] = value
            return self

        def getOrCreate(self):
            raise InterruptedError

    monkeypatch.setattr(resume.SparkSession, "builder", Builder())
    with pytest.raises(InterruptedError):
        resume.main(["--bootstrap-servers", "b", "--checkpoint", "/c"])
    assert given["spark.sql.streaming.stateStore.providerClass"].endswith("RocksDBStateStoreProvider")
