"""Queries over the driver's tables, one or more per operator, with the same queries as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.changes import changes_from, union_changes
from .operators.lookup import Lookup
from .operators.nest import Nest
from .options import LookupOptions, NestOptions
from .plans.replay import route
from .plans.snapshot import latest
from .scratch import scratch_path
from .sources.kafka import encode_changes
from .sources.search import newest_operations
from .streaming import ROCKSDB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _never(_: Column) -> Column:
    return F.lit(False)


def _shown_sub() -> Column:
    return F.col("sub").cast("int").alias("sub")


def rows_of(spark: SparkSession, sf_dir: str, name: str, id_: str, *columns: str) -> DataFrame:
    """A table's rows as upserts."""
    rows = table(spark, sf_dir, name).select(id_, *columns)
    return changes_from(name, rows, lambda r: r[id_], _never, lambda r: F.lit(0))


#: The id of a lineitem: order and line number alone are not unique.
LINE_ID = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*LINE_ID, "l_quantity")

    def id_(r: Column) -> Column:
        return F.concat_ws("-", *[r[c].cast("string") for c in LINE_ID[:4]], F.date_format(r["l_shipdate"], "yyyyMMdd"))

    rows = rows.withColumn("line", id_(F.struct(*LINE_ID)))
    return changes_from("lineitem", rows.select("l_orderkey", "line", "l_quantity"), lambda r: r["line"], _never, lambda r: F.lit(0))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of users: errors delete, ``props.k`` is the key, event ids are the order."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    return changes_from("events", rows, lambda r: r["user_id"], lambda r: r["event_type"] == "error", lambda r: r["event_id"])


def nation_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a dimension that comes, is renamed and in part goes, spread over the events' order."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    first = rows.select("n_nationkey", "n_name", (F.col("n_nationkey") * 300 + 100).cast("long").alias("at"), F.lit(False).alias("gone"))
    again = rows.select("n_nationkey", F.concat("n_name", F.lit("*")).alias("n_name"), (F.col("n_nationkey") * 300 + 2000).cast("long").alias("at"), F.lit(False).alias("gone"))
    gone = rows.where("n_nationkey % 2 = 0").select("n_nationkey", "n_name", (F.col("n_nationkey") * 300 + 4000).cast("long").alias("at"), F.lit(True).alias("gone"))
    all_rows = first.unionByName(again).unionByName(gone)
    return changes_from("nation", all_rows, lambda r: r["n_nationkey"], lambda r: r["gone"], lambda r: r["at"])


NATION_SQL = """
dim as (
  select n_nationkey::varchar as key, n_name, n_nationkey::bigint * 300 + 100 as seq, false as gone from nation
  union all select n_nationkey::varchar, n_name || '*', n_nationkey::bigint * 300 + 2000, false from nation
  union all select n_nationkey::varchar, n_name, n_nationkey::bigint * 300 + 4000, true from nation where n_nationkey % 2 = 0
)"""

EVENTS_SQL = """
ev as (
  select user_id::varchar as id, event_id as seq, case when event_type = 'error' then 'D' else 'U' end as kind,
         json_extract_string(props, '$.k') as k from events
), lagged as (
  select *, lag(case when kind = 'U' then k end) over (partition by id order by seq) as last_k from ev
), routed as (
  select id, seq, kind, 0 as part, case when kind = 'D' and last_k is not null then last_k else k end as key, false as relocation
  from lagged where not (kind = 'U' and last_k is not null and last_k <> k)
  union all select id, seq, 'D', 0, last_k, true from lagged where kind = 'U' and last_k is not null and last_k <> k
  union all select id, seq, 'U', 1, k, false from lagged where kind = 'U' and last_k is not null and last_k <> k
)"""


def changes_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_events(spark, sf_dir).select("kind", "id", "seq", F.col("value.k").alias("k"))


def latest_change_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(user_events(spark, sf_dir)).select("kind", "id", "seq", F.col("value.k").alias("k"))


def route_relocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = route(user_events(spark, sf_dir), lambda v: v["k"], "events")
    return routed.select("kind", "id", "seq", _shown_sub(), "key", "relocation")


def lookup_left_customer_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = rows_of(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    nations = rows_of(spark, sf_dir, "nation", "n_nationkey", "n_name")
    out = Lookup.of("customer", customers, lambda v: v["c_nationkey"]).from_(nations)
    out = out.enrich(lambda e, d: F.struct(e["c_name"].alias("name"), d["n_name"].alias("nation")))
    return out.select("id", "value.*")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, sf_dir, "documents", "doc_id", "source", "lang")


def _label(require: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        labels = rows_of(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
        lookup = Lookup.of("label", _documents(spark, sf_dir), lambda v: v["doc_id"]).with_options(LookupOptions(require_match=require))
        out = lookup.from_(labels).enrich(lambda e, d: F.struct(e["source"].alias("source"), d["quality"].alias("quality"), d["toxic"].alias("toxic")))
        return out.select("id", "value.*")

    return query


def _lookup_replay(require: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lookup = Lookup.of("user", user_events(spark, sf_dir), lambda v: v["k"]).with_options(LookupOptions(require_match=require))
        out = lookup.from_(nation_dimension(spark, sf_dir)).enrich(lambda e, d: F.struct(e["k"].alias("k"), d["n_name"].alias("nation")), mode="replay")
        return out.select("kind", "id", "seq", _shown_sub(), "value.*")

    return query


def _lookup_replay_sql(require: bool) -> str:
    match = "where dim_name is not null" if require else ""
    other_kind = "case when x.gone then 'D' else 'U' end" if require else "'U'"
    other_name = "case when x.gone then x.previous else x.n_name end" if require else "case when not x.gone then x.n_name end"
    other_where = "and (not x.gone or x.previous is not null)" if require else ""
    return f"""
with {NATION_SQL}, {EVENTS_SQL}, dims as (
  select *, lag(case when not gone then n_name end) over (partition by key order by seq) as previous from dim
), stays as (
  select *, seq * 4 + 2 + part as pos,
         lag(case when kind = 'U' then key end) over (partition by key, id order by seq, part) as was,
         lead(seq * 4 + 2 + part) over (partition by key, id order by seq, part) as until_pos
  from routed
), own as (
  select kind, id, seq, 1 as src, part, key as k,
         (select case when not d.gone then d.n_name end from dims d where d.key = s.key and d.seq <= s.seq order by d.seq desc limit 1) as dim_name
  from stays s where not relocation and (kind = 'U' or was is not null)
), other as (
  select {other_kind} as kind, s.id, x.seq, 0 as src, 0 as part, s.key as k, {other_name} as dim_name
  from dims x join stays s on s.key = x.key and s.kind = 'U' and x.seq * 4 > s.pos and (s.until_pos is null or x.seq * 4 < s.until_pos) {other_where}
)
select kind, id, seq, (row_number() over (partition by id order by seq, src, part) - 1)::int as sub, k, dim_name as nation
from (select * from own {match} union all select * from other)
"""


def _joined(children: Column, field: str) -> Column:
    return F.array_join(children[field].cast("array<string>"), ",")


def nest_orders_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = rows_of(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    level = Nest.parent("order", orders)
    lines = level.child("lines", lineitems(spark, sf_dir), lambda v: v["l_orderkey"])
    out = level.assemble(lambda p, c: F.struct(p["o_orderstatus"].alias("status"), F.size(c[lines]).alias("n"), _joined(c[lines], "line").alias("lines")))
    return out.select("id", "value.*")


def nest_customers_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = Nest.parent("customer", rows_of(spark, sf_dir, "customer", "c_custkey", "c_name"))
    orders = level.child("orders", rows_of(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), lambda v: v["o_custkey"])
    out = level.assemble(lambda p, c: F.struct(p["c_name"].alias("name"), F.size(c[orders]).alias("n"), _joined(c[orders], "o_orderkey").alias("orders")))
    return out.select("id", "value.*")


def customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation and their orders, and these with their lineitems, as change stream of nested values."""
    orders = Nest.parent("order", rows_of(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus"))
    lines = orders.child("lines", lineitems(spark, sf_dir), lambda v: v["l_orderkey"])
    order_docs = orders.assemble(
        lambda p, c: F.struct(
            p["o_orderkey"].alias("orderkey"), p["o_custkey"].alias("custkey"), p["o_orderstatus"].alias("status"),
            F.transform(c[lines], lambda x: F.struct(x["line"].alias("line"), x["l_quantity"].cast("long").alias("quantity"))).alias("lines"),
        )
    )
    customers = rows_of(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    nations = rows_of(spark, sf_dir, "nation", "n_nationkey", "n_name")
    named = Lookup.of("customer-nation", customers, lambda v: v["c_nationkey"]).from_(nations)
    named = named.enrich(lambda e, d: F.struct(e["c_name"].alias("name"), d["n_name"].alias("nation")))
    level = Nest.parent("customer-doc", named)
    slot = level.child("orders", order_docs, lambda v: v["custkey"])
    return level.assemble(lambda p, c: F.struct(p["name"].alias("name"), p["nation"].alias("nation"), c[slot].alias("orders")))


def nest_two_level_customer_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = F.col("value.orders")

    def quantity(o: Column) -> Column:
        return F.aggregate(o["lines"], F.lit(0).cast("long"), lambda a, x: a + x["quantity"])

    return customer_documents(spark, sf_dir).select(
        "id", "value.name", "value.nation", F.size(orders).alias("n_orders"), _joined(orders, "orderkey").alias("orders"),
        F.aggregate(orders, F.lit(0).cast("long"), lambda a, o: a + F.size(o["lines"])).alias("n_lines"),
        F.aggregate(orders, F.lit(0).cast("long"), lambda a, o: a + quantity(o)).alias("quantity"),
        F.array_join(F.transform(orders, lambda o: F.array_join(F.transform(o["lines"], lambda x: x["line"]), ",")), ";").alias("lines"),
    )


def nest_two_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = Nest.parent("nation", rows_of(spark, sf_dir, "nation", "n_nationkey", "n_name"))
    customers = level.child("customers", rows_of(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), lambda v: v["c_nationkey"])
    suppliers = level.child("suppliers", rows_of(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), lambda v: v["s_nationkey"])
    out = level.assemble(
        lambda p, c: F.struct(p["n_name"].alias("name"), _joined(c[customers], "c_custkey").alias("customers"), _joined(c[suppliers], "s_suppkey").alias("suppliers"))
    )
    return out.select("id", "value.*")


def _parents_with_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys 0 to 99 as parents; every third one is deleted at 5000, and of these every other one comes back at 8000."""
    base = spark.range(100).select(F.col("id").alias("p"))
    rows = base.select("p", F.lit(0).alias("at"), F.lit(False).alias("gone"))
    rows = rows.unionByName(base.where("p % 3 = 0").select("p", F.lit(5000).alias("at"), F.lit(True).alias("gone")))
    rows = rows.unionByName(base.where("p % 6 = 0").select("p", F.lit(8000).alias("at"), F.lit(False).alias("gone")))
    return changes_from("keys", rows, lambda r: r["p"], lambda r: r["gone"], lambda r: r["at"])


PARENTS_SQL = """
parents as (
  select p::varchar as id, seq, gone from (
    select range as p, 0 as seq, false as gone from range(100)
    union all select range, 5000, true from range(100) where range % 3 = 0
    union all select range, 8000, false from range(100) where range % 6 = 0
  )
)"""


def _nest_users(spark: SparkSession, sf_dir: str, parents: DataFrame, mode: str) -> DataFrame:
    level = Nest.parent("key", parents)
    users = level.child("users", user_events(spark, sf_dir), lambda v: v["k"])
    return level.assemble(lambda p, c: F.struct(F.size(c[users]).alias("n"), _joined(c[users], "user_id").alias("users")), mode=mode)


def nest_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live parents at the end; those that were deleted and came back have only the children that changed since."""
    return _nest_users(spark, sf_dir, _parents_with_deletes(spark, sf_dir), "snapshot").select("id", "value.*")


def nest_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children whose parent never comes are in no document."""
    parents = _parents_with_deletes(spark, sf_dir).where("value.p % 2 = 1 and value.gone = false")
    return _nest_users(spark, sf_dir, parents, "snapshot").select("id", "value.*")


def nest_replay_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is emitted while events move users between keys and parents go and come."""
    return _nest_users(spark, sf_dir, _parents_with_deletes(spark, sf_dir), "replay").select("kind", "id", "seq", _shown_sub(), "value.*")


def _twins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parents and users of which many changes share their order: events in hundreds, a user's last of each counts."""
    tens = (F.col("seq") / 100).cast("long")
    users = user_events(spark, sf_dir).withColumn("value", F.struct("value.user_id", "value.k"))
    # A window by id, which the routing by id needs too: one shuffle, where a group by id and order would take another.
    users = users.withColumn("__next", F.lead(tens).over(Window.partitionBy("id").orderBy("seq")))
    last = users.where(F.col("__next").isNull() | (F.col("__next") != tens)).select("kind", "id", "value", tens.alias("seq"), "sub")
    return _parents_with_deletes(spark, sf_dir).withColumn("seq", tens), last


def nest_replay_equal_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``nest_replay_emissions`` where the children's changes share their order with each other and with the parents'."""
    parents, users = _twins(spark, sf_dir)
    level = Nest.parent("key", parents)
    slot = level.child("users", users, lambda v: v["k"])
    out = level.assemble(lambda p, c: F.struct(F.size(c[slot]).alias("n"), _joined(c[slot], "user_id").alias("users")), mode="replay")
    return out.select("kind", "id", "seq", _shown_sub(), "value.*")


def nest_snapshot_equal_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are left of ``nest_replay_equal_seq``, by the snapshot."""
    parents, users = _twins(spark, sf_dir)
    level = Nest.parent("key", parents)
    slot = level.child("users", users, lambda v: v["k"])
    return level.assemble(lambda p, c: F.struct(F.size(c[slot]).alias("n"), _joined(c[slot], "user_id").alias("users"))).select("id", "value.*")


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def streamed(spark: SparkSession, tag: str, inputs: dict[str, DataFrame], build, seconds: int = 1800) -> DataFrame:
    """All changes of ``build(streams)``, run over files of the inputs to their end, with ``batch``, the micro-batch of each.

    State is in RocksDB, which the session is set to while the stream runs.
    """
    home, streams = scratch_path(spark, tag), {}
    for name, part in inputs.items():
        part.write.parquet(f"{home}/{name}")
        streams[name] = spark.readStream.schema(part.schema).parquet(f"{home}/{name}")
    out = build(streams)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/out/batch={number}")

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        query = out.writeStream.outputMode("update").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
        if not query.awaitTermination(seconds):
            query.stop()
            raise TimeoutError(f"{tag}: the stream did not end within {seconds} s")
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(T.StructType([*out.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{home}/out")


def last_streamed(changes: DataFrame) -> DataFrame:
    """The last change per id of a stream's changes: later micro-batches are later, within one ``(seq, sub)`` orders."""
    last = F.max_by(F.struct("kind", "value", "seq", "sub"), F.struct("batch", "seq", "sub")).alias("c")
    return changes.groupBy("id").agg(last).select("c.kind", "id", "c.value", "c.seq", "c.sub")


def stream_nest_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last change per key of the same level run as a stream that emits a parent's last document of a micro-batch."""

    def build(streams: dict[str, DataFrame]) -> DataFrame:
        level = Nest.parent("key", streams["parents"]).with_options(NestOptions(coalesce=True))
        users = level.child("users", streams["users"], lambda v: v["k"])
        return level.assemble(lambda p, c: F.struct(F.size(c[users]).alias("n"), _joined(c[users], "user_id").alias("users")))

    inputs = {"parents": _parents_with_deletes(spark, sf_dir), "users": user_events(spark, sf_dir)}
    return last_streamed(streamed(spark, "stream-nest", inputs, build)).select("kind", "id", "seq", "value.*")


def _users_with_nation(streams: dict[str, DataFrame]) -> DataFrame:
    lookup = Lookup.of("user", streams["users"], lambda v: v["k"]).from_(streams["nations"])
    return lookup.enrich(lambda e, d: F.struct(e["k"].alias("k"), d["n_name"].alias("nation")))


def stream_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last change per user of the lookup of ``lookup_replay_left`` run as a stream."""
    inputs = {"users": user_events(spark, sf_dir), "nations": nation_dimension(spark, sf_dir)}
    return last_streamed(streamed(spark, "stream-lookup", inputs, _users_with_nation)).select("kind", "id", "value.*")


def search_bulk_ops_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of a streamed lookup whose two sources number their records independently.

    The dimension's numbers lie far above the entities', so an old dimension's number must not beat a later move.
    """
    nations = nation_dimension(spark, sf_dir).withColumn("seq", F.col("seq") + 1_000_000_000)
    inputs = {"users": user_events(spark, sf_dir), "nations": nations}
    last = last_streamed(streamed(spark, "stream-search", inputs, _users_with_nation))
    return newest_operations(last).select("id", "action", "document", "bytes")


def stream_two_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nest_two_slots`` as a stream."""

    def build(streams: dict[str, DataFrame]) -> DataFrame:
        level = Nest.parent("nation", streams["nations"]).with_options(NestOptions(coalesce=True))
        customers = level.child("customers", streams["customers"], lambda v: v["c_nationkey"])
        suppliers = level.child("suppliers", streams["suppliers"], lambda v: v["s_nationkey"])
        return level.assemble(
            lambda p, c: F.struct(p["n_name"].alias("name"), _joined(c[customers], "c_custkey").alias("customers"), _joined(c[suppliers], "s_suppkey").alias("suppliers"))
        )

    inputs = {
        "nations": rows_of(spark, sf_dir, "nation", "n_nationkey", "n_name"), "customers": rows_of(spark, sf_dir, "customer", "c_custkey", "c_nationkey"),
        "suppliers": rows_of(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"),
    }
    return last_streamed(streamed(spark, "stream-slots", inputs, build)).where(F.col("kind") == "U").select("id", "value.*")


def stream_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with their nations, and these with their suppliers, as a stream of two levels."""

    def build(streams: dict[str, DataFrame]) -> DataFrame:
        nations = Nest.parent("nation", streams["nations"])
        suppliers = nations.child("suppliers", streams["suppliers"], lambda v: v["s_nationkey"])
        docs = nations.assemble(lambda p, c: F.struct(p["n_name"].alias("name"), p["n_regionkey"].alias("region"), _joined(c[suppliers], "s_suppkey").alias("suppliers")))
        regions = Nest.parent("region", streams["regions"])
        slot = regions.child("nations", docs, lambda v: v["region"])
        return regions.assemble(lambda p, c: F.struct(p["r_name"].alias("name"), _joined(c[slot], "name").alias("nations"), F.array_join(F.transform(c[slot], lambda x: x["suppliers"]), ";").alias("suppliers")))

    inputs = {
        "regions": rows_of(spark, sf_dir, "region", "r_regionkey", "r_name"), "nations": rows_of(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey"),
        "suppliers": rows_of(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"),
    }
    return last_streamed(streamed(spark, "stream-levels", inputs, build)).select("kind", "id", "value.*")


#: The same tables with orders in hundreds, of which an id's last change counts.
_TWIN_PARENTS_SQL = PARENTS_SQL.replace("select p::varchar as id, seq, gone", "select p::varchar as id, seq // 100 as seq, gone")
_TWIN_EVENTS_SQL = EVENTS_SQL.replace(
    "from events\n)",
    "from (select *, event_id // 100 as h from events qualify row_number() over (partition by user_id, event_id // 100 order by event_id desc) = 1)\n)",
).replace("event_id as seq", "h as seq")


def _nest_replay_sql(parents: str, events: str) -> str:
    """Places order a parent's log: by seq, the parent first, then what leaves or comes (part), then ids."""
    return f"""
with {parents}, {events}, unplaced as (
  select id as parent, '' as child, case when gone then 'D' else 'U' end as kind, 0 as src, 0 as part, seq from parents
  union all select key, id, kind, 1, part, seq from routed
), log as (
  select *, row_number() over (partition by parent order by seq, src, part, child) as pos from unplaced
), eras as (
  select *, sum((child = '' and kind = 'D')::int) over (partition by parent order by pos) as era,
         last_value(case when child = '' then kind end ignore nulls) over (partition by parent order by pos rows between unbounded preceding and current row) as now_kind,
         last_value(case when child = '' then kind end ignore nulls) over (partition by parent order by pos rows between unbounded preceding and 1 preceding) as before_kind
  from log
), stays as (
  select *, lag(kind) over (partition by parent, child, era order by pos) as was, lead(pos) over (partition by parent, child, era order by pos) as until_pos from eras
), emitted as (
  select parent, kind, pos, seq, era from stays where child = '' and kind = 'U'
  union all select parent, 'D', pos, seq, era - 1 from stays where child = '' and kind = 'D' and before_kind = 'U'
  union all select parent, 'U', pos, seq, era from stays where child <> '' and now_kind = 'U' and (kind = 'U' or was = 'U')
), held as (
  select e.parent, e.pos, count(s.child) as n, string_agg(s.child, ',' order by s.child) as users
  from emitted e left join stays s on s.parent = e.parent and s.child <> '' and s.kind = 'U' and s.era = e.era and s.pos <= e.pos and (s.until_pos is null or s.until_pos > e.pos)
  group by e.parent, e.pos
)
select e.kind, e.parent as id, e.seq, (row_number() over (partition by e.parent order by e.pos) - 1)::int as sub, h.n::int as n, coalesce(h.users, '') as users from emitted e join held h on h.parent = e.parent and h.pos = e.pos
"""


NEST_REPLAY_SQL = _nest_replay_sql(PARENTS_SQL, EVENTS_SQL)
TWIN_REPLAY_SQL = _nest_replay_sql(_TWIN_PARENTS_SQL, _TWIN_EVENTS_SQL)


def kafka_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_changes(user_events(spark, sf_dir).withColumn("value", F.struct(F.col("value.k").alias("k"))))
    return out.select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


def search_bulk_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = newest_operations(user_events(spark, sf_dir).withColumn("value", F.struct(F.col("value.k").alias("k"))))
    return ops.select("id", "action", "document", "bytes")


def union_customers_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two change streams of one type as one."""

    def named(name: str, id_: str, text: str, nation: str) -> DataFrame:
        rows = table(spark, sf_dir, name).select(F.concat(F.lit(name[0]), F.col(id_)).alias("who"), F.col(text).alias("name"), F.col(nation).alias("nation"))
        return changes_from(name, rows, lambda r: r["who"], _never, lambda r: F.lit(0))

    both = union_changes(named("customer", "c_custkey", "c_name", "c_nationkey"), named("supplier", "s_suppkey", "s_name", "s_nationkey"))
    return both.select("kind", "id", "value.name", "value.nation")


def conversations_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns nested under their conversation; turn numbers are padded so that text order is their order."""
    rows = table(spark, sf_dir, "conversations")
    turns = rows.select("conv_id", "turn", "role").withColumn("name", F.concat_ws("-", "conv_id", F.lpad(F.col("turn").cast("string"), 6, "0"), "role"))
    heads = changes_from("conversation", rows.select("conv_id").distinct(), lambda r: r["conv_id"], _never, lambda r: F.lit(0))
    level = Nest.parent("conversation", heads)
    slot = level.child("turns", changes_from("turn", turns, lambda r: r["name"], _never, lambda r: F.lit(0)), lambda v: v["conv_id"])
    out = level.assemble(lambda p, c: F.struct(F.size(c[slot]).alias("n_turns"), _joined(c[slot], "role").alias("roles")))
    return out.select("id", "value.*")


LINES_SQL = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'))"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "changes_from_events": changes_from_events,
    "latest_change_per_id": latest_change_per_id,
    "route_relocations": route_relocations,
    "lookup_left_customer_nation": lookup_left_customer_nation,
    "lookup_left_document_label": _label(False),
    "lookup_inner_document_label": _label(True),
    "lookup_replay_left": _lookup_replay(False),
    "lookup_replay_inner": _lookup_replay(True),
    "nest_orders_lineitems": nest_orders_lineitems,
    "nest_customers_orders": nest_customers_orders,
    "nest_two_level_customer_doc": nest_two_level_customer_doc,
    "nest_two_slots": nest_two_slots,
    "nest_cascade_delete": nest_cascade_delete,
    "nest_orphans": nest_orphans,
    "nest_replay_emissions": nest_replay_emissions,
    "nest_replay_equal_seq": nest_replay_equal_seq,
    "nest_snapshot_equal_seq": nest_snapshot_equal_seq,
    "stream_nest_users": stream_nest_users,
    "stream_lookup": stream_lookup,
    "stream_two_slots": stream_two_slots,
    "stream_two_levels": stream_two_levels,
    "search_bulk_ops_two_sources": search_bulk_ops_two_sources,
    "kafka_encode": kafka_encode,
    "search_bulk_ops": search_bulk_ops,
    "union_customers_suppliers": union_customers_suppliers,
    "conversations_doc": conversations_doc,
}

TWO_SLOTS_SQL = """
    select n_nationkey::varchar as id, n_name as name,
           coalesce((select string_agg(c_custkey::varchar, ',' order by c_custkey::varchar) from customer where c_nationkey = n_nationkey), '') as customers,
           coalesce((select string_agg(s_suppkey::varchar, ',' order by s_suppkey::varchar) from supplier where s_nationkey = n_nationkey), '') as suppliers
    from nation"""
#: Queries that run a stream to the end of its input.
STREAMS = ("stream_nest_users", "stream_lookup", "stream_two_slots", "stream_two_levels", "search_bulk_ops_two_sources")

_LAST_EVENTS = f"with {EVENTS_SQL}, ended as (select id, arg_max(kind, seq) as kind, max(seq) as seq, arg_max(k, seq) as k from ev group by id)"
_CLEARED = "cleared as (select id, max(seq) as cut from parents where gone group by id)"

ORACLE: dict[str, str] = {
    "changes_from_events": f"with {EVENTS_SQL} select kind, id, seq, k from ev",
    "latest_change_per_id": f"{_LAST_EVENTS} select kind, id, seq, k from ended",
    "route_relocations": f"with {EVENTS_SQL} select kind, id, seq, part as sub, key, relocation from routed",
    "lookup_left_customer_nation": "select c_custkey::varchar as id, c_name as name, n_name as nation from customer left join nation on c_nationkey = n_nationkey",
    "lookup_left_document_label": "select d.doc_id::varchar as id, source, quality, toxic from documents d left join labels l on d.doc_id = l.doc_id",
    "lookup_inner_document_label": "select d.doc_id::varchar as id, source, quality, toxic from documents d join labels l on d.doc_id = l.doc_id",
    "lookup_replay_left": _lookup_replay_sql(False),
    "lookup_replay_inner": _lookup_replay_sql(True),
    "nest_orders_lineitems": f"""
        select o_orderkey::varchar as id, any_value(o_orderstatus) as status, count(l_orderkey)::int as n,
               coalesce(string_agg(line, ',' order by line), '') as lines
        from orders left join (select l_orderkey, {LINES_SQL} as line from lineitem) on o_orderkey = l_orderkey group by o_orderkey""",
    "nest_customers_orders": """
        select c_custkey::varchar as id, any_value(c_name) as name, count(o_orderkey)::int as n,
               coalesce(string_agg(o_orderkey::varchar, ',' order by o_orderkey::varchar), '') as orders
        from customer left join orders on c_custkey = o_custkey group by c_custkey""",
    "nest_two_level_customer_doc": f"""
        with l as (
          select l_orderkey, count(*) as n, sum(l_quantity::bigint) as q, string_agg(line, ',' order by line) as lines
          from (select l_orderkey, l_quantity, {LINES_SQL} as line from lineitem) group by l_orderkey
        )
        select c_custkey::varchar as id, any_value(c_name) as name, any_value(n_name) as nation, count(o_orderkey)::int as n_orders,
               coalesce(string_agg(o_orderkey::varchar, ',' order by o_orderkey::varchar), '') as orders,
               coalesce(sum(n), 0)::bigint as n_lines, coalesce(sum(q), 0)::bigint as quantity,
               coalesce(string_agg(coalesce(lines, ''), ';' order by o_orderkey::varchar) filter (o_orderkey is not null), '') as lines
        from customer left join nation on c_nationkey = n_nationkey left join orders on c_custkey = o_custkey left join l on o_orderkey = l_orderkey
        group by c_custkey""",
    "nest_two_slots": TWO_SLOTS_SQL,
    "stream_two_slots": TWO_SLOTS_SQL,
    "nest_cascade_delete": f"""
        {_LAST_EVENTS}, {PARENTS_SQL}, {_CLEARED}, top as (select id from parents group by id having not arg_max(gone, seq))
        select t.id, count(e.id)::int as n, coalesce(string_agg(e.id, ',' order by e.id), '') as users
        from top t left join cleared c on c.id = t.id left join ended e on e.k = t.id and e.kind = 'U' and e.seq >= coalesce(c.cut, -1) group by t.id""",
    "nest_orphans": f"""
        {_LAST_EVENTS} select p::varchar as id, count(e.id)::int as n, coalesce(string_agg(e.id, ',' order by e.id), '') as users
        from (select range as p from range(100) where range % 2 = 1) left join ended e on e.k = p::varchar and e.kind = 'U' group by p""",
    "nest_replay_emissions": NEST_REPLAY_SQL,
    "nest_replay_equal_seq": TWIN_REPLAY_SQL,
    "nest_snapshot_equal_seq": f"select id, arg_max(n, sub) as n, arg_max(users, sub) as users from ({TWIN_REPLAY_SQL}) group by id having arg_max(kind, sub) = 'U'",
    "stream_lookup": f"""
        select c.kind as kind, id, c.k as k, c.nation as nation from (
          select id, arg_max({{'kind': kind, 'k': k, 'nation': nation}}, (seq, sub)) as c from ({_lookup_replay_sql(False)}) group by id
        )""",
    "stream_two_levels": """
        with n as (
          select n_nationkey::varchar as id, n_name, n_regionkey,
                 coalesce((select string_agg(s_suppkey::varchar, ',' order by s_suppkey::varchar) from supplier where s_nationkey = n_nationkey), '') as suppliers from nation
        )
        select 'U' as kind, r_regionkey::varchar as id, r_name as name, coalesce(string_agg(n_name, ',' order by id), '') as nations,
               coalesce(string_agg(suppliers, ';' order by id), '') as suppliers
        from region left join n on n_regionkey = r_regionkey group by r_regionkey, r_name""",
    "search_bulk_ops_two_sources": f"""
        {_LAST_EVENTS}, {NATION_SQL}, last_dim as (select key, case when not arg_max(gone, seq) then arg_max(n_name, seq) end as nation from dim group by key),
        written as (
          select id, kind, '{{"k":"' || k || '","nation":' || coalesce('"' || nation || '"', 'null') || '}}' as body from ended left join last_dim on k = key
        )
        select id, case kind when 'U' then 'index' else 'delete' end as action, case when kind = 'U' then body end as document,
               case when kind = 'U' then strlen(body) + 64 else 64 end as bytes from written""",
    "stream_nest_users": f"select arg_max(kind, (seq, sub)) as kind, id, max(seq) as seq, arg_max(n, (seq, sub)) as n, arg_max(users, (seq, sub)) as users from ({NEST_REPLAY_SQL}) group by id",
    "kafka_encode": f"""with {EVENTS_SQL} select id as key, case when kind = 'U' then '{{"k":"' || k || '"}}' end as value from ev""",
    "search_bulk_ops": f"""
        {_LAST_EVENTS} select id, case kind when 'U' then 'index' else 'delete' end as action, case when kind = 'U' then '{{"k":"' || k || '"}}' end as document,
        case when kind = 'U' then strlen('{{"k":"' || k || '"}}') + 64 else 64 end as bytes from ended""",
    "union_customers_suppliers": """
        select 'U' as kind, 'c' || c_custkey as id, c_name as name, c_nationkey as nation from customer
        union all select 'U', 's' || s_suppkey, s_name, s_nationkey from supplier""",
    "conversations_doc": """
        select conv_id::varchar as id, count(distinct (turn, role))::int as n_turns, string_agg(role, ',' order by lpad(turn::varchar, 6, '0'), role) as roles
        from (select distinct conv_id, turn, role from conversations) group by conv_id""",
}
