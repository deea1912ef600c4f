"""The full changelog that the operators emit, from complete change logs, in SQL windows and joins.

Changes are ordered by ``seq``; at equal ``seq`` a dimension or parent comes before entities and
children, slots follow their declaration, then come ``sub`` and the id. What a stage emits for an id is
numbered in ``sub``, so a later stage that orders by ``(seq, sub)`` keeps the order of emission.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import checked_key, checked_value
from ..operators.changes import DELETE, UPSERT, Key

#: Emissions of a block of a nest's log, beyond the number of children that are there.
BLOCK = 64
#: Emissions of a part of a block, for which its children are found once, and children of all a part's documents at most.
PART, PART_CHILDREN = 32, 1 << 16


def _order(source: int) -> Column:
    return F.struct(F.col("seq"), F.lit(source).alias("source"), F.col("sub"), F.col("id"))


def _numbered(id_: str) -> Column:
    """The place of an emission among those of its id."""
    return (F.row_number().over(Window.partitionBy(id_).orderBy("ord")) - 1).cast("long").alias("sub")


def route(changes: DataFrame, key: Key, what: str) -> DataFrame:
    """Changes with their target ``key`` and ``relocation``: a moved entity leaves its old key before it comes to its new one.

    A delete is routed, and valued, by the last known value. Without one an upsert or delete needs a key of its own.
    """
    before = Window.partitionBy("id").orderBy("seq", "sub")
    last = F.when(F.lag("kind").over(before) == UPSERT, F.lag("value").over(before))  # not a lag of the case: that would be shuffled beside the value
    rows = changes.withColumn("__last", last)
    rows = rows.withColumn("__own", key(F.col("value")).cast("string")).withColumn("__old", key(F.col("__last")).cast("string"))
    own = checked_key(F.col("__own"), F.col("id"), what)
    known, delete = F.col("__last").isNotNull(), F.col("kind") == DELETE

    def out(kind: Column, value: Column, target: Column, moved: bool) -> Column:
        return F.struct(kind.alias("kind"), value.alias("value"), target.alias("key"), F.lit(moved).alias("relocation"))

    leave = out(F.lit(DELETE), F.col("__last"), F.col("__old"), True)
    plain = out(F.col("kind"), F.col("value"), own, False)
    gone = out(F.lit(DELETE), F.col("__last"), F.col("__old"), False)
    steps = F.when(known & delete, F.array(gone)).when(known & ~F.col("__own").eqNullSafe(F.col("__old")), F.array(leave, plain)).otherwise(F.array(plain))
    rows = rows.select("id", "seq", "sub", F.posexplode(steps).alias("__at", "__step"))
    return rows.select("__step.kind", "id", "__step.value", "seq", (F.col("sub") * 2 + F.col("__at")).cast("long").alias("sub"), "__step.key", "__step.relocation")


def lookup_replay(entities: DataFrame, dimensions: DataFrame, key: Key, enrich, require_match: bool, what: str) -> DataFrame:
    """All changes that a lookup emits.

    Entity changes take the dimension as of their place in the key's order; a dimension change is joined
    with the entities whose stay at the key it falls into.
    """
    routed = route(entities, key, what).withColumn("ord", _order(1))
    stay = Window.partitionBy("key", "id").orderBy("ord")
    routed = routed.withColumn("__was", F.lag(F.when(F.col("kind") == UPSERT, F.col("value"))).over(stay))
    routed = routed.withColumn("__until", F.lead("ord").over(stay))
    dims = dimensions.select(F.col("id").alias("key"), "kind", "value", "seq", "sub", _order(0).alias("ord"))
    dims = dims.withColumn("__previous", F.lag(F.when(F.col("kind") == UPSERT, F.col("value"))).over(Window.partitionBy("key").orderBy("ord")))

    # As-of: the last dimension state before each entity change, carried along the key's order.
    marks = dims.select(
        "key", "ord", F.struct(F.when(F.col("kind") == UPSERT, F.col("value")).alias("v")).alias("__dim"), F.lit(None).cast(routed.schema["value"].dataType).alias("__entity"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("kind")
    )
    stored = F.when(F.col("kind") == UPSERT, F.col("value")).otherwise(F.col("__was"))
    events = routed.where(~F.col("relocation")).select(
        "key", "ord", F.lit(None).cast(marks.schema["__dim"].dataType).alias("__dim"), stored.alias("__entity"), "id", "kind"
    )
    along = Window.partitionBy("key").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.unionByName(events).withColumn("__now", F.last("__dim", ignorenulls=True).over(along)["v"])
    own = seen.where(F.col("__entity").isNotNull())
    if require_match:
        own = own.where(F.col("__now").isNotNull())
    own = own.select("kind", "id", "__entity", F.col("__now").alias("__with"), "ord")

    present = routed.where(F.col("kind") == UPSERT).select(F.col("key").alias("__key"), "id", F.col("value").alias("__entity"), F.col("ord").alias("__from"), "__until")
    inside = (F.col("key") == F.col("__key")) & (F.col("ord") > F.col("__from")) & (F.col("__until").isNull() | (F.col("ord") < F.col("__until")))
    hit = dims.join(present, inside)
    upsert = F.col("kind") == UPSERT
    if require_match:
        hit = hit.where(upsert | F.col("__previous").isNotNull())
        kind, with_ = F.col("kind"), F.when(upsert, F.col("value")).otherwise(F.col("__previous"))
    else:
        kind, with_ = F.lit(UPSERT), F.when(upsert, F.col("value"))
    other = hit.select(kind.alias("kind"), "id", "__entity", with_.alias("__with"), "ord")
    both = own.unionByName(other)
    value = checked_value(enrich(F.col("__entity"), F.col("__with")), what)
    return both.select("kind", "id", value.alias("value"), F.col("ord.seq").alias("seq"), _numbered("id"))


def nest_replay(parents: DataFrame, slots: dict[str, tuple[DataFrame, Key]], assemble, what: str) -> DataFrame:
    """All changes that a nest level emits.

    A child's stay under a parent ends with its next change there or the parent's next delete. Each
    change that finds its parent present emits a document of the stays that hold at its place; a
    parent's delete emits the document as it was just before.

    A parent's emissions are cut into blocks, and a stay, of a child or of a parent's value, goes to the blocks that
    it spans. Blocks grow with the children that are there, so all blocks together hold about twice the log, whatever
    the documents' sizes; documents are made row by row from their block. Deletes carry no value, the log a value
    once, and blocks are columns of numbers and values, so little is shuffled.
    """
    # One ordered log per parent: whether the parent is there and the number of its deletes are carried along it.
    values = {"__parent": parents.schema["value"].dataType} | {f"__child_{i}": c.schema["value"].dataType for i, (c, _) in enumerate(slots.values())}

    def shaped(rows: DataFrame, parent: str, filled: str, source: int) -> DataFrame:
        cells = [(F.when(F.col("kind") == UPSERT, F.col("value")) if c == filled else F.lit(None).cast(kind)).alias(c) for c, kind in values.items()]
        return rows.select(F.col(parent).alias("parent"), _order(source).alias("ord"), "kind", *cells)

    log = shaped(parents, "id", "__parent", 0)
    for i, (n, (c, k)) in enumerate(slots.items()):
        log = log.unionByName(shaped(route(c, k, f"{what} {n}"), "key", f"__child_{i}", i + 1))
    is_top, upsert = F.col("ord.source") == 0, F.col("kind") == UPSERT
    delete, comes = is_top & ~upsert, is_top & upsert & F.col("__parent").isNotNull()
    state = F.when(is_top, comes)
    along = Window.partitionBy("parent").orderBy("ord")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    log = log.withColumns(
        {
            "__pos": F.row_number().over(along),
            "__era": F.coalesce(F.sum(delete.cast("int")).over(earlier), F.lit(0)),  # a delete ends its era
            "__turn": F.sum(comes.cast("int")).over(upto),  # which of the parent's values holds
            "__now": F.last(state, ignorenulls=True).over(upto),
            "__before": F.last(state, ignorenulls=True).over(earlier),
        }
    )
    top = F.coalesce(F.when(delete, F.col("__before")).otherwise(F.col("__now")), F.lit(False))
    log = log.select("parent", F.col("ord.seq").alias("seq"), F.col("ord.source").alias("source"), F.col("ord.id").alias("child"), "kind", *values, top.alias("__there"), "__pos", "__era", "__turn")
    is_top = F.col("source") == 0
    delete, comes = is_top & ~upsert, is_top & upsert & F.col("__parent").isNotNull()
    stay = Window.partitionBy("parent", "source", "child", "__era").orderBy("__pos")
    log = log.withColumn("__held", ~is_top & F.coalesce(F.lag("kind").over(stay) == UPSERT, F.lit(False)))
    log = log.withColumn("__emits", F.col("__there") & (is_top | upsert | F.col("__held")))

    # Emissions are numbered, a stay is a range of their numbers, and a block takes about as many of them as children are there.
    era, whole = Window.partitionBy("parent", "__era").orderBy("__pos"), Window.partitionBy("parent").orderBy("__era", "__pos")
    come = F.when(~is_top, upsert.cast("long") - F.col("__held").cast("long")).otherwise(0)
    log = log.withColumn("__live", F.sum(come).over(era.rowsBetween(Window.unboundedPreceding, 0)))
    counted = whole.rowsBetween(Window.unboundedPreceding, 0)
    share = F.when(F.col("__emits"), F.expr(f"{1 << 32} div ({BLOCK} + __live)")).otherwise(0)
    log = log.withColumns({"__n": F.sum(F.col("__emits").cast("long")).over(counted), "__block": F.shiftright(F.sum(share).over(counted), 32)})
    ends = era.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    log = log.withColumns({"__first": F.col("__n") - F.col("__emits").cast("long"), "__era_n": F.last("__n").over(ends), "__era_block": F.last("__block").over(ends)})
    log = log.withColumns({"__end": F.coalesce(F.lead("__first").over(stay), "__era_n"), "__last": F.coalesce(F.lead("__block").over(stay), "__era_block")})
    seen = ~is_top & upsert & (F.col("__first") < F.col("__end"))
    log = log.where(F.col("__emits") | seen).withColumn("__at", F.explode(F.sequence("__block", F.when(seen | comes, F.col("__last")).otherwise(F.col("__block")))))

    emission = F.struct(F.col("__first").alias("sub"), "seq", delete.alias("delete"), F.col("__turn").alias("turn"))
    lists = [F.array_sort(F.collect_list(F.when(F.col("__emits") & (F.col("__at") == F.col("__block")), emission))).alias("__emissions")]
    lists.append(F.array_sort(F.collect_list(F.when(comes, F.struct(F.col("__turn").alias("turn"), F.col("__parent").alias("value")))), _by_turn).alias("__tops"))
    for i in range(len(slots)):
        child = F.struct(F.col("child").alias("id"), F.col("__first").alias("first"), F.col("__end").alias("end"), F.col(f"__child_{i}").alias("value"))
        lists.append(F.array_sort(F.collect_list(F.when(seen & (F.col("source") == i + 1), child))).alias(f"__children_{i}"))
    blocks = log.groupBy("parent", "__at").agg(*lists).where(F.size("__emissions") > 0)
    return _documents(_packed(blocks, len(slots)), slots, assemble, what)


def _by_turn(a: Column, b: Column) -> Column:
    return F.signum(a["turn"] - b["turn"]).cast("int")


def _packed(blocks: DataFrame, slots: int) -> DataFrame:
    """Blocks dealt out with their lists as columns and numbers from the block's first emission; one parent's blocks go to many tasks."""
    base, size, first = F.col("__emissions")[0]["sub"], F.size("__emissions"), F.col("__tops")[0]["turn"]
    columns = [base.alias("__base"), F.col("__emissions")["seq"].alias("__seq"), F.col("__emissions")["delete"].alias("__delete"), F.col("__tops")["value"].alias("__top")]
    columns.append(F.transform(F.col("__emissions")["turn"], lambda t: (t - first).cast("int")).alias("__top_at"))
    for i in range(slots):
        children = F.col(f"__children_{i}")
        columns.append(F.transform(children["first"], lambda n: F.greatest(n - base, F.lit(0)).cast("int")).alias(f"__first_{i}"))
        columns.append(F.transform(children["end"], lambda n: F.least(n - base, size).cast("int")).alias(f"__end_{i}"))
        columns.append(children["value"].alias(f"__value_{i}"))
    return blocks.select("parent", "__at", *columns).repartition("parent", "__at")


def _let(value: Column, of) -> Column:
    """``of(value)`` with the value found once, wherever ``of`` uses it."""
    return F.transform(F.array(value), of)[0]


def _segments(rows: Column, start: Column, stop: Column) -> Column:
    """The children of a part of a block, ``start`` to before ``stop``, as segments: one that comes or goes within the part, then those after it that stay.

    ``held`` has the values with the first one, ``gone`` without it; the first segment has none that comes or goes.
    """

    def cut(c: Column) -> Column:
        numbered = F.transform(c, lambda x, at: F.struct(x["first"].alias("first"), x["end"].alias("end"), at.alias("at")))
        return _let(c["value"], lambda all_: _let(F.filter(numbered, lambda x: (x["first"] > start) | (x["end"] < stop)), lambda moving: segments(all_, moving)))

    def segments(all_: Column, moving: Column) -> Column:
        def segment(j: Column) -> Column:
            one, at = F.get(moving, j - 1), F.coalesce(F.get(moving, j - 1)["at"], F.lit(-1))
            next_ = F.coalesce(F.get(moving, j)["at"], F.size(all_))
            held, gone = F.slice(all_, F.greatest(at + 1, F.lit(1)), next_ - at), F.slice(all_, at + 2, next_ - at - 1)
            return F.struct(one["first"].alias("first"), one["end"].alias("end"), held.alias("held"), gone.alias("gone"))

        return F.transform(F.sequence(F.lit(0), F.size(moving)), segment)

    return _let(F.filter(rows, lambda c: (c["first"] < stop) & (c["end"] > start)), cut)


def _documents(blocks: DataFrame, slots: dict, assemble, what: str) -> DataFrame:
    """A block's documents, made in parts: a part's children are found once and an emission's put together from its segments."""
    places = range(len(slots))
    children = sum([F.size(f"__value_{i}").cast("long") for i in places], F.lit(1))
    blocks = blocks.withColumn("__step", F.greatest(F.lit(1), F.least(F.lit(PART), F.floor(PART_CHILDREN / children))).cast("int"))
    blocks = blocks.select("*", F.explode(F.sequence(F.lit(0), F.size("__seq") - 1, F.col("__step"))).alias("__from"))

    def there(segments: Column, at: Column) -> Column:
        return F.flatten(F.transform(segments, lambda s: F.when((s["first"] <= at) & (s["end"] > at), s["held"]).otherwise(s["gone"])))

    def document(part: Column, at: Column) -> Column:
        kind = F.when(F.get("__delete", at), DELETE).otherwise(UPSERT)
        found = [there(part[f"children_{i}"], at).alias(f"children_{i}") for i in places]
        return F.struct((F.col("__base") + at).alias("sub"), kind.alias("kind"), F.get("__seq", at).alias("seq"), F.get("__top", F.get("__top_at", at)).alias("top"), *found)

    def rows(i: int) -> Column:
        zipped = F.arrays_zip(f"__first_{i}", f"__end_{i}", f"__value_{i}")
        return F.transform(zipped, lambda c: F.struct(c[f"__first_{i}"].alias("first"), c[f"__end_{i}"].alias("end"), c[f"__value_{i}"].alias("value")))

    start, stop = F.col("__from"), F.least(F.col("__from") + F.col("__step"), F.size("__seq"))
    part = F.struct(F.sequence(start, stop - 1).alias("at"), *[_segments(rows(i), start, stop).alias(f"children_{i}") for i in places])
    out = blocks.select("parent", F.explode(_let(part, lambda p: F.transform(p["at"], lambda at: document(p, at)))).alias("__e"))
    value = checked_value(assemble(F.col("__e.top"), {n: F.col(f"__e.children_{i}") for i, n in enumerate(slots)}), what)
    return out.select("__e.kind", F.col("parent").alias("id"), value.alias("value"), "__e.seq", "__e.sub")
