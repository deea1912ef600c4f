"""The rules without an engine, and the replay in SQL against them."""

import random
from datetime import timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom import queries
from docloom.errors import ConfigurationError
from docloom.names import checked_name, state_id, uid
from docloom.operators.changes import change_schema, changes_from
from docloom.operators.lookup import Lookup
from docloom.operators.nest import Nest
from docloom.options import ChildOptions, LookupOptions, NestOptions
from docloom.plans import replay
from docloom.streaming.rules import LookupRules, NestRules, OrphanDeadline, java_hash, route
from docloom.streaming.state import MemoryCell, MemoryTable

U, D = "U", "D"


def at(value):
    return value.split("@")[1] if "@" in value else None


def steps(*changes):
    last = MemoryCell()
    return [list(route(last, k, v, at, "test")) for k, v in changes]


def test_route():
    assert steps((U, "e@a")) == [[(U, "e@a", "a", False)]]
    assert steps((D, "e@a")) == [[(D, "e@a", "a", False)]]
    assert steps((U, "e@a"), (U, "f@a"))[1] == [(U, "f@a", "a", False)]
    assert steps((U, "e@a"), (U, "e@b"))[1] == [(D, "e@a", "a", True), (U, "e@b", "b", False)]
    assert steps((U, "e@a"), (D, "e@b"), (U, "e@c"))[1:] == [[(D, "e@a", "a", False)], [(U, "e@c", "c", False)]]
    assert steps((U, "e@a"), (D, "e"))[1] == [(D, "e@a", "a", False)]
    for change in ((U, "e"), (D, "e")):
        with pytest.raises(RuntimeError):
            steps(change)


def lookup(require=False):
    return LookupRules(MemoryTable(), MemoryCell(), require)


def test_lookup_left():
    r = lookup()
    assert list(r.entity(U, "e1", "dev", False)) == [(U, "e1", "dev", None)]
    assert list(r.entity(U, "e0", "qa", False)) == [(U, "e0", "qa", None)]
    assert list(r.dimension_change(U, "acme")) == [(U, "e0", "qa", "acme"), (U, "e1", "dev", "acme")]
    assert list(r.dimension_change(U, "acme"))  # no suppression
    assert list(r.entity(D, "e1", "other", False)) == [(D, "e1", "dev", "acme")]
    assert list(r.entity(D, "e1", "other", False)) == []
    assert list(r.entity(D, "e0", "qa", True)) == []
    assert list(r.dimension_change(D, "acme")) == []


def test_lookup_dimension_deletes():
    r = lookup()
    list(r.entity(U, "e", "dev", False))
    assert list(r.dimension_change(D, "x")) == [(U, "e", "dev", None)]
    r = lookup(True)
    assert list(r.entity(U, "e", "dev", False)) == []
    assert list(r.dimension_change(D, "x")) == []
    assert list(r.dimension_change(U, "acme")) == [(U, "e", "dev", "acme")]
    assert list(r.dimension_change(D, "x")) == [(D, "e", "dev", "acme")]
    assert list(r.dimension_change(U, "new")) == [(U, "e", "dev", "new")]
    assert list(r.dimension_change(D, "x")) and list(r.entity(D, "e", "dev", False)) == []


def nest():
    return NestRules(MemoryCell(), [MemoryTable(), MemoryTable()], MemoryCell())


def test_nest():
    r = nest()
    assert list(r.child_change(0, U, "s2", "java")) == []
    assert list(r.parent_change(U, "alice")) == [(U, ("alice", [["java"], []]))]
    assert list(r.child_change(0, U, "s1", "go")) == [(U, ("alice", [["go", "java"], []]))]
    assert list(r.child_change(1, U, "j", "dev")) == [(U, ("alice", [["go", "java"], ["dev"]]))]
    assert list(r.child_change(0, D, "s9", "x")) == []
    assert list(r.child_change(0, D, "s1", "x")) == [(U, ("alice", [["java"], ["dev"]]))]
    assert list(r.parent_change(D, "other")) == [(D, ("alice", [["java"], ["dev"]]))]
    assert list(r.parent_change(D, "other")) == []
    assert list(r.parent_change(U, "alice")) == [(U, ("alice", [[], []]))]
    assert list(r.parent_change(U, "alice")) == [(U, ("alice", [[], []]))]


def test_absent_parent_delete_clears_children():
    r = nest()
    list(r.child_change(0, U, "s", "java"))
    assert list(r.parent_change(D, "x")) == []
    assert list(r.parent_change(U, "alice")) == [(U, ("alice", [[], []]))]


def test_orphan_deadline():
    d = OrphanDeadline(100)
    assert java_hash("c1") % 100 == 18 and d.at("c1", 140) == 318 and d.at("c2", 119) == 319
    assert d.superseded(318) == (118, 218)
    assert OrphanDeadline(0).at("c2", 5) == 7
    assert OrphanDeadline(1 << 80).at("c2", 5) > 5
    assert all(100 < d.at(k, now) - now <= 200 for k in ("a", "", "日本") for now in range(0, 400, 7))


def test_names_and_options():
    assert uid("kafka_sink", "cand") == "kafka_sink_cand" and uid("search_sink", "a") == "elasticsearch_sink_a"
    assert state_id("child_route", "cand", "skills") == "cand.route.skills.last" and state_id("last_doc", "cand") == "cand.last-doc"
    for bad in ("Candidate", "company_name", "", "1a", "a b"):
        with pytest.raises(ConfigurationError):
            checked_name(bad)
    for bad in (timedelta(0), timedelta(-1)):
        with pytest.raises(ConfigurationError):
            NestOptions(orphan_timeout=bad)
    for make in (lambda: ChildOptions.of(state_ttl=None), lambda: LookupOptions.of(state_ttl=None), lambda: NestOptions.of(parent_state_ttl=None)):
        with pytest.raises(ConfigurationError):
            make()
    assert not LookupOptions().require_match


def stream(spark, rows):
    """(kind, id, text, seq) rows as changes of struct values."""
    data = [(k, i, (v,), s, 0) for k, i, v, s in rows]
    return spark.createDataFrame(data, change_schema(change_value()))


def change_value():
    from pyspark.sql import types as T

    return T.StructType([T.StructField("v", T.StringType())])


def key(v):
    return F.try_element_at(F.split(v["v"], "@"), F.lit(2))


def test_builders(spark):
    c = stream(spark, [(U, "a", "x@k", 1)])
    level = Nest.parent("n", c)
    with pytest.raises(ConfigurationError):
        level.assemble(lambda p, ch: p)
    slot = level.child("s", c, key)
    with pytest.raises(ConfigurationError):
        level.child("s", c, key)
    with pytest.raises(ConfigurationError):
        level.child("Bad", c, key)
    other = Nest.parent("m", c)
    other.child("s", c, key)
    with pytest.raises(ConfigurationError):
        other.assemble(lambda p, ch: F.struct(ch[slot].alias("x")))
    level.assemble(lambda p, ch: F.struct(p["v"].alias("p"), ch[slot].alias("x")))
    for late in (lambda: level.assemble(lambda p, ch: p), lambda: level.child("t", c, key), lambda: level.with_options(NestOptions())):
        with pytest.raises(ConfigurationError):
            late()
    look = Lookup.of("l", c, key)
    first, second = look.from_(c), look.from_(c)
    first.enrich(lambda e, d: e)
    for late in (lambda: second.enrich(lambda e, d: e), lambda: look.from_(c), lambda: look.with_options(LookupOptions())):
        with pytest.raises(ConfigurationError):
            late()


def test_changes_guards(spark):
    rows = spark.createDataFrame([("a", "live", 1), ("b", "gone", 2)], "id string, state string, n long")
    got = changes_from("rows", rows, lambda r: r["id"], lambda r: r["state"] == "gone", lambda r: r["n"]).collect()
    assert [(r.kind, r.id, r.value.state) for r in got] == [(U, "a", "live"), (D, "b", "gone")]
    for bad in (None, " ", "\t "):
        rows = spark.createDataFrame([(bad,)], "id string")
        with pytest.raises(Exception, match="blank"):
            changes_from("rows", rows, lambda r: r["id"], lambda r: F.lit(False), lambda r: F.lit(0)).collect()


KEYS = ["a", "b"]
change = st.tuples(st.sampled_from([U, U, D]), st.sampled_from(["1", "2", "3"]), st.sampled_from(KEYS))


def numbered(parts, together=1):
    """Rows per source with a common order, that so many share; each is (source, kind, id, key, seq). An id changes once at a time."""
    out, seen = [], set()
    for i, (src, (kind, id_, key_)) in enumerate(parts):
        seq = i // together + 1
        name = (src, key_ if src == 0 else id_, seq)
        if name not in seen:
            seen.add(name)
            out.append((src, kind, id_, key_, seq))
    return out


def steps_by_place(rows):
    """What each parent or lookup key sees, in order: (key, seq, source, kind, id, value, relocation)."""
    last, out = {}, []
    for src, kind, id_, key_, seq in rows:
        if src == 0:
            out.append((key_, (seq, 0, 0, key_), kind, key_, f"d{seq}", False))
            continue
        for n, (k, v, target, moved) in enumerate(list(route(last.setdefault((src, id_), MemoryCell()), kind, f"{id_}{seq}@{key_}", at, "t"))):
            out.append((target, (seq, src, n, id_), k, id_, v, moved))
    return sorted(out, key=lambda s: s[:2])


def by_rules_lookup(rows, require):
    places, out = {}, []
    for place, (seq, src, *_), kind, id_, value, moved in steps_by_place(rows):
        rules = places.setdefault(place, lookup(require))
        got = rules.entity(kind, id_, value, moved) if src else rules.dimension_change(kind, value)
        out += [(k, i, e, d, seq) for k, i, e, d in got]
    return sorted(out, key=str)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(parts=st.lists(st.tuples(st.sampled_from([0, 1, 1]), change), min_size=1, max_size=14), require=st.booleans(), together=st.sampled_from([1, 4]))
def test_lookup_replay_agrees_with_rules(spark, parts, require, together):
    rows = numbered(parts, together)
    entities = stream(spark, [(k, i, f"{i}{s}@{key_}", s) for src, k, i, key_, s in rows if src])
    dims = stream(spark, [(k, key_, f"d{s}", s) for src, k, _, key_, s in rows if not src])
    look = Lookup.of("l", entities, key).with_options(LookupOptions(require_match=require))
    got = look.from_(dims).enrich(lambda e, d: F.struct(e["v"].alias("e"), d["v"].alias("d")), mode="replay").collect()
    assert sorted([(r.kind, r.id, r.value.e, r.value.d, r.seq) for r in got], key=str) == by_rules_lookup(rows, require)
    assert len({(r.id, r.sub) for r in got}) == len(got)


def by_rules_nest(rows):
    places, out = {}, []
    for place, (seq, src, *_), kind, id_, value, _ in steps_by_place(rows):
        rules = places.setdefault(place, nest())
        got = rules.child_change(src - 1, kind, id_, value) if src else rules.parent_change(kind, value)
        out += [(k, place, p, c, seq) for k, (p, c) in got]
    numbers = {}
    return [(*row, numbers.setdefault(row[1], iter(range(1000))).__next__()) for row in out]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(parts=st.lists(st.tuples(st.sampled_from([0, 1, 1, 2]), change), min_size=1, max_size=14), together=st.sampled_from([1, 3, 14]))
def test_nest_replay_agrees_with_rules(spark, parts, together):
    rows = numbered(parts, together)
    level = Nest.parent("n", stream(spark, [(k, key_, f"d{s}", s) for src, k, _, key_, s in rows if src == 0]))
    slots = [level.child(n, stream(spark, [(k, i, f"{i}{s}@{key_}", s) for src, k, i, key_, s in rows if src == j]), key) for j, n in ((1, "x"), (2, "y"))]
    doc = level.assemble(lambda p, c: F.struct(p["v"].alias("p"), *[F.transform(c[s], lambda x: x["v"]).alias(s.name) for s in slots]), mode="replay")
    got = sorted([(r.kind, r.id, r.value.p, [list(r.value.x), list(r.value.y)], r.seq, r.sub) for r in doc.collect()], key=str)
    assert got == sorted(by_rules_nest(rows), key=str)


def test_nest_replay_in_many_blocks(spark, monkeypatch):
    """Blocks of few emissions give what the rules give; emissions are not joined with the stays that hold, whose pairs are all documents' children."""
    monkeypatch.setattr(replay, "BLOCK", 1)
    draw = random.Random(5)
    parts = [(draw.choice([0] + [1, 2] * 6), (draw.choice([U, U, D]), str(draw.randrange(9)), draw.choice(KEYS))) for _ in range(300)]
    rows = numbered(parts, 2)
    level = Nest.parent("n", stream(spark, [(k, key_, f"d{s}", s) for src, k, _, key_, s in rows if src == 0]))
    slots = [level.child(n, stream(spark, [(k, i, f"{i}{s}@{key_}", s) for src, k, i, key_, s in rows if src == j]), key) for j, n in ((1, "x"), (2, "y"))]
    doc = level.assemble(lambda p, c: F.struct(p["v"].alias("p"), *[F.transform(c[s], lambda x: x["v"]).alias(s.name) for s in slots]), mode="replay")
    got = sorted([(r.kind, r.id, r.value.p, [list(r.value.x), list(r.value.y)], r.seq, r.sub) for r in doc.collect()], key=str)
    assert got == sorted(by_rules_nest(rows), key=str) and len(got) > 100
    assert "Join" not in doc._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("part, most", [(1, 1 << 16), (3, 1 << 16), (32, 8), (32, 1 << 16)])
def test_nest_replay_in_parts_of_blocks(spark, monkeypatch, part, most):
    monkeypatch.setattr(replay, "PART", part)
    monkeypatch.setattr(replay, "PART_CHILDREN", most)
    draw = random.Random(part + most)
    parts = [(draw.choice([0] + [1, 2] * 6), (draw.choice([U, U, D]), str(draw.randrange(9)), draw.choice(KEYS))) for _ in range(300)]
    rows = numbered(parts, 2)
    level = Nest.parent("n", stream(spark, [(k, key_, f"d{s}", s) for src, k, _, key_, s in rows if src == 0]))
    slots = [level.child(n, stream(spark, [(k, i, f"{i}{s}@{key_}", s) for src, k, i, key_, s in rows if src == j]), key) for j, n in ((1, "x"), (2, "y"))]
    doc = level.assemble(lambda p, c: F.struct(p["v"].alias("p"), *[F.transform(c[s], lambda x: x["v"]).alias(s.name) for s in slots]), mode="replay")
    got = sorted([(r.kind, r.id, r.value.p, [list(r.value.x), list(r.value.y)], r.seq, r.sub) for r in doc.collect()], key=str)
    assert got == sorted(by_rules_nest(rows), key=str) and len(got) > 100


def test_nest_replay_shuffles_little(spark):
    """Disk follows what is shuffled: one shuffle by user, one by key, one of blocks, of 110 bytes an event together."""

    def shuffled() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    out, before = queries.nest_replay_equal_seq(spark, "/root/testdata/sf0.01"), shuffled()
    out.write.format("noop").mode("overwrite").save()
    assert 0 < shuffled() - before < 110 * 10_000
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3


def test_children_of_one_parent_at_equal_seq(spark):
    parents, kids = stream(spark, [(U, "p", "P", 1)]), stream(spark, [(U, "x", "X@p", 5), (U, "y", "Y@p", 5)])
    for mode, want in (("replay", [("", 0), ("X@p", 1), ("X@p,Y@p", 2)]), ("snapshot", [("X@p,Y@p", 0)])):
        level = Nest.parent("n", parents)
        slot = level.child("x", kids, key)
        doc = level.assemble(lambda p, c, slot=slot: F.struct(F.array_join(F.transform(c[slot], lambda x: x["v"]), ",").alias("x")), mode=mode)
        assert sorted((r.value.x, r.sub) for r in doc.collect()) == want


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(parts=st.lists(st.tuples(st.sampled_from([0, 1, 1]), change), min_size=1, max_size=14), together=st.sampled_from([1, 3, 14]))
def test_snapshot_is_the_last_replayed_change(spark, parts, together):
    rows = numbered(parts, together)

    def documents(mode):
        level = Nest.parent("n", stream(spark, [(k, key_, f"d{s}", s) for src, k, _, key_, s in rows if src == 0]))
        slot = level.child("x", stream(spark, [(k, i, f"{i}{s}@{key_}", s) for src, k, i, key_, s in rows if src]), key)
        return level.assemble(lambda p, c: F.struct(p["v"].alias("p"), F.transform(c[slot], lambda x: x["v"]).alias("x")), mode=mode).collect()

    last = {}
    for r in sorted(documents("replay"), key=lambda r: (r.seq, r.sub)):
        last[r.id] = r
    assert {r.id: r.value for r in documents("snapshot")} == {i: r.value for i, r in last.items() if r.kind == U}


@pytest.mark.parametrize("mode", ["snapshot", "replay"])
def test_null_keys_and_results_fail(spark, mode):
    parents, kids, lost = stream(spark, [(U, "p", "P", 1)]), stream(spark, [(U, "x", "X@p", 5)]), stream(spark, [(U, "x", "X", 5)])

    def nested(children, assemble):
        level = Nest.parent("n", parents)
        slot = level.child("x", children, key)
        return level.assemble(lambda p, c: assemble(F.struct(p["v"].alias("p"), F.size(c[slot]).alias("n")), c), mode=mode).collect()

    null = lambda v: F.when(F.lit(False), v)
    with pytest.raises(Exception, match="no key for x"):
        nested(lost, lambda p, c: p)
    with pytest.raises(Exception, match="value is null"):
        nested(kids, lambda p, c: null(p))
    with pytest.raises(Exception, match="no key for x"):
        Lookup.of("l", lost, key).from_(parents).enrich(lambda e, d: e, mode).collect()
    with pytest.raises(Exception, match="value is null"):
        Lookup.of("l", kids, key).from_(parents).enrich(lambda e, d: null(e), mode).collect()


@given(parts=st.lists(st.lists(st.tuples(st.sampled_from([0, 1, 1, 2]), change), max_size=6), max_size=6))
def test_coalesced_documents_end_like_all_documents(parts):
    """Of each batch the last emission, and the last delete before it."""
    every, last = nest(), NestRules(MemoryCell(), [MemoryTable(), MemoryTable()], MemoryCell(), coalesce=True)
    for batch in parts:
        out, kept = [], []
        for src, (kind, id_, _) in batch:
            for rules, rows in ((every, out), (last, kept)):
                rows += list(rules.child_change(src - 1, kind, id_, id_) if src else rules.parent_change(kind, id_))
        kept += [row[1:] for row in last.end()]
        deletes = [i for i, (k, _) in enumerate(out) if k == D]
        want = [out[deletes[-1]]] if deletes else []
        if out and out[-1][0] == U:
            want.append(out[-1])
        assert kept == want
