"""Further queries: sources, drains, failures, hooks, bytes and the forms of operators that catalogue.py leaves out."""

from __future__ import annotations

from concurrent.futures import Future
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import sinks
from millrace.frame import OrderedFrame
from millrace.functions import bytes_ as b
from millrace.functions import text as text_functions
from millrace.operators.timed import DROP_BUFFER, DROP_HEAD, DROP_NEW, DROP_TAIL, FAIL, micros
from millrace.plans.catalogue import CENTS, DAY, HOUR, O_CENTS, POSITIONED, _two, big, cents, events, listed, orders, query
from millrace.positions import numbered
from millrace.sources import values
from millrace.sources.files import table


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _fails(frame: OrderedFrame | DataFrame) -> bool:
    """Whether the frame's job fails."""
    try:
        (frame.df if isinstance(frame, OrderedFrame) else frame).write.format("noop").mode("overwrite").save()
    except PySparkException:
        return True
    return False


def _done(value) -> Future:
    f: Future = Future()
    f.set_result(value)
    return f


# sources


@query("select i - 1 as pos, i * 10 as value from range(1, 6) t(i)")
def source_of_values(spark, sf):
    return values.of(spark, "long", 10, 20, 30, 40, 50).df


@query("select i as pos, ['a', 'b', 'c'][i + 1] as value from range(3) t(i)")
def source_from_iterator(spark, sf):
    return values.from_iterator(spark, iter("abc"), "string").df


@query("select 1::bigint as n_one, 0::bigint as n_empty, 0::bigint as n_empty_from, 3::bigint as n_iterable, 1::bigint as n_function, 0::bigint as n_none")
def source_kinds(spark, sf):
    made = {"one": values.one(spark, 7, "long"), "empty": values.empty(spark, "long"), "empty_from": values.empty_from(spark, _done(1), "long"), "iterable": values.source(spark, [1, 2, 3], "long"), "function": values.source(spark, lambda: 5, "long"), "none": values.source(spark, None, "long")}
    return reduce(DataFrame.crossJoin, [f.fold("count", F.lit(1), 0, f"n_{k}").select(big(f"n_{k}").alias(f"n_{k}")) for k, f in made.items()])  # a row each


@query("select * from (values (0::bigint, 0::bigint, 3::bigint), (2, 0, 4), (3, 0, 5)) t(src, pos, value)")
def source_option_future_try(spark, sf):
    parts = [values.from_option(spark, 3, "long"), values.from_option(spark, None, "long"), values.from_future(spark, _done(4), "long"), values.from_try(spark, 5, "long")]
    return parts[0].concat(*parts[1:]).df.select(big("src").alias("src"), "pos", "value")


@query("select true as eager_fails, true as lazy_fails")
def source_failing(spark, sf):
    try:
        values.failing(spark, ValueError("no"), "long")
        eager = False
    except ValueError:
        eager = True
    return _rows(spark, [(eager, _fails(values.failing(spark, ValueError("no"), "long", eager=False)))], "eager_fails boolean, lazy_fails boolean")


@query("select i as pos, 7::bigint as value from range(500) t(i)")
def source_repeat(spark, sf):
    return values.repeat(spark, 7, count=500).map(value=big("value")).df


@query("select i as pos, i * i as value from range(500) t(i)")
def source_continually(spark, sf):
    return values.continually(spark, F.col("id") * F.col("id"), count=500).df


@query("select i as pos, (10 - 3 * i)::bigint as value from range(1000) t(i)")
def source_ints(spark, sf):
    return values.ints(spark, 10, -3, count=1000).map(value=big("value")).df


@query("select i as pos, 0.5 + i * 0.25::double as value from range(1000) t(i)")
def source_doubles(spark, sf):
    return values.doubles(spark, 0.5, 0.25, count=1000).df


@query("select i as pos, 'x' as value, (946684800000000 + i // 3 * 3600000000)::bigint as came from range(100) t(i)")
def source_tick(spark, sf):
    f = values.tick(spark, "x", "2000-01-01 00:00:00", "1 hour", count=100, elements=3)
    return f.map(value=F.col("value"), came=micros("at")).df


@query("select i as pos, (2 ** i)::bigint as value from range(30) t(i)")
def source_iterate(spark, sf):
    return values.iterate(spark, 1, lambda x: 2 * x, "long", count=30).df


@query("select i as pos, i * i as value from range(20) t(i)")
def source_unfold_async(spark, sf):
    return values.unfold_async(spark, 0, lambda i: _done(None if i == 20 else (i * i, i + 1)), "long").df


@query("select i as pos, i as value from range(10) t(i)")
def source_lazy_start(spark, sf):
    return values.lazy_start(lambda: values.longs(spark, 0, count=10))().df


@query("select pos, value, true as was_taken, 5::bigint as n_taken, false as later_taken from (values (0::bigint, 1::bigint), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6)) t(pos, value)")
def source_push(spark, sf):
    push = values.Push(spark, "long", most=6)
    taken, n = push.offer(1), push.offer_many(range(2, 100))
    push.complete()
    return push.frame().df.withColumns({"was_taken": F.lit(taken), "n_taken": F.lit(n).cast("long"), "later_taken": F.lit(push.offer(9))})


@query()
def source_file_chunks(spark, sf):
    """A file's bytes in chunks of 512."""
    from millrace.sources.files import from_file

    f = from_file(spark, f"{sf}/region.parquet", 512)
    return f.df.select(big("pos").alias("pos"), big(F.octet_length("value")).alias("n"), F.md5("value").alias("md5"))


# drains


@query("select min(event_id) as first_id, max(event_id) as last_id, true as has_head, false as empty_has_head, count(*) as n from events")
def drain_head_last(spark, sf):
    f = events(spark, sf).map()
    none = f.drop_all()
    return _rows(spark, [(f.head().event_id, f.last_row().event_id, f.head_option() is not None, none.head_option() is not None, f.folding("count", F.lit(1), 0))], "first_id long, last_id long, has_head boolean, empty_has_head boolean, n long")


@query("select event_id from events order by event_id limit 7")
def drain_first_7(spark, sf):
    return _rows(spark, [(r.event_id,) for r in events(spark, sf).map().first_rows(7)], "event_id long")


@query("select '<' || string_agg(o_orderkey::varchar, '-' order by o_orderkey) || '>' as text, true as too_many_fails from (select o_orderkey from orders order by o_orderkey limit 12)")
def drain_mk_string(spark, sf):
    f = orders(spark, sf).map(x=F.col("o_orderkey"))
    first = f.take(12)
    try:
        f.seq(3)
        failed = False
    except sinks.StreamLimitExceeded:
        failed = True
    return _rows(spark, [(first.to_mk_string(F.col("x"), 20, "-", "<", ">"), failed)], "text string, too_many_fails boolean")


@query("select count(*) as n, sum(event_id)::bigint as total from events")
def drain_parallel_foreach(spark, sf):
    n, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def add(row):
        n.add(1)
        total.add(row["event_id"])

    events(spark, sf).map().parallel_foreach(4, add)
    return _rows(spark, [(n.value, total.value)], "n long, total long")


@query(f"select (sum({O_CENTS}) * 2)::bigint as doubled, sum({O_CENTS})::bigint as kept, true as dropped from orders")
def drain_results(spark, sf):
    kept: list[int] = []
    total = lambda f: f.folding("sum", F.col("x"), 0)
    pipe = lambda f: f.map(x=cents("o_totalprice"))
    drain = sinks.contramap(sinks.map_result(sinks.capture_result(total, kept.append), lambda x: 2 * x), pipe)
    f = orders(spark, sf)
    doubled = sinks.lazy_drain(lambda: drain)(f)
    dropped = sinks.drop_result(lambda g: g.ignore())(f.map())
    return _rows(spark, [(doubled, kept[0], dropped is None)], "doubled long, kept long, dropped boolean")


# elements and slices


def _doubled(row: dict) -> dict:
    return {"event_id": row["event_id"], "v": row["value"] * 2}


@query("select event_id, value * 2 as v from events where value is not null")
def map_async(spark, sf):
    return events(spark, sf).map(value=F.col("value")).filter(F.col("value").isNotNull()).map_async(4, _doubled, "event_id long, v double").df


@query("select event_id, value * 2 as v from events where value is not null")
def map_async_unordered(spark, sf):
    return events(spark, sf).map(value=F.col("value")).filter(F.col("value").isNotNull()).map_async_unordered(4, _doubled, "event_id long, v double").df


@query("select event_id, i as idx from events, range(2) t(i)")
def duplicate(spark, sf):
    return events(spark, sf).map().duplicate().df.select("event_id", big("idx").alias("idx"))


@query("select o_orderkey from orders")
def identity_buffer_async(spark, sf):
    f = orders(spark, sf).map().identity().nop().buffer(16).async_("workers").async_boundary(4).named("orders")
    return f.via(lambda g: g).df


@query("select (select count(*) from events) as n_all, 1::bigint as n_first, 0::bigint as n_none, (select count(*) from events) as n_within_limit")
def first_drop_all_with_limit(spark, sf):
    f = events(spark, sf).map()
    counted = {"all": f, "first": f.first(), "none": f.drop_all(), "within_limit": f.with_limit(10**9)}
    return reduce(DataFrame.crossJoin, [g.fold("count", F.lit(1), 0, f"n_{k}").select(big(f"n_{k}").alias(f"n_{k}")) for k, g in counted.items()])  # a row each


@query(f"select most, (select count(*) from orders) > most as by_number, (select sum({O_CENTS}) from orders) > 1000 * most as by_weight from (values (10::bigint), (1000000000000)) t(most)")
def limits_that_fail(spark, sf):
    f = orders(spark, sf)
    return _rows(spark, [(n, _fails(f.with_limit(n)), _fails(f.with_limit_weighted(1000 * n, cents("o_totalprice")))) for n in (10, 10**12)], "most long, by_number boolean, by_weight boolean")


@query(f"select row_number() over (order by amount, o_orderkey) - 1 as pos, o_orderkey, amount from (select o_orderkey, {O_CENTS} as amount from orders)")
def sort_by_price(spark, sf):
    f = orders(spark, sf).map(amount=cents("o_totalprice"))
    return numbered(OrderedFrame.of(f.df, ("amount", "o_orderkey")))


# groups


@query("select (select event_id from events order by event_id limit 1) as head, (select count(*) - 1 from events) as n_tail, true as empty_fails")
def head_and_tail(spark, sf):
    f = events(spark, sf).map()
    head, tail = f.head_and_tail(F.col("event_id"))
    fails = _fails(f.drop_all().head_and_tail(F.col("event_id"))[0])
    return head.select("head", tail.df.agg(F.count("*")).scalar().alias("n_tail"), F.lit(fails).alias("empty_fails"))


@query("select count(*) as n, count(distinct event_id) as n_ids, true as in_range from events")
def inject_to_any_3(spark, sf):
    return events(spark, sf).map().inject_to_any(3).df.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"), F.bool_and(F.col("group_id").between(0, 2)).alias("in_range"))


@query("select event_id, i as group_id from events, range(3) t(i)")
def inject_broadcast_3(spark, sf):
    return events(spark, sf).map().inject_broadcast(3).df.select("event_id", "group_id")


@query("select row_number() over (order by event_id, user_id) - 1 as pos, user_id, event_id from events")
def flatten_merge_users(spark, sf):
    return numbered(events(spark, sf, ("user_id",)).map().flatten_merge()).select("pos", "user_id", "event_id")


@query(f"select row_number() over (order by amount, user_id, event_id) - 1 as pos, user_id, event_id, amount from (select user_id, event_id, {CENTS} as amount from events)")
def flatten_sorted_users(spark, sf):
    return numbered(events(spark, sf, ("user_id",)).map(amount=cents("value")).flatten_sorted("amount")).select("pos", "user_id", "event_id", "amount")


@query("""
with p as (select event_type, event_id, row_number() over (partition by event_type order by event_id) - 1 as pos from events)
select pos, string_agg(event_id::varchar, ',' order by event_type) as ids from p group by pos having count(*) = (select count(distinct event_type) from events)""")
def flatten_to_seq_types(spark, sf):
    return events(spark, sf).group_by(100, "event_type").map().flatten_to_seq(F.col("event_id")).df.select("pos", listed("row").alias("ids"))


@query("select (select count(distinct user_id) from events) > 2 as too_many_fails, false as enough_fails, true as null_fails")
def group_by_limits(spark, sf):
    f = events(spark, sf).map(user_id=F.col("user_id"))
    nulls = f.with_columns(user_id=F.lit(None).cast("long"))
    return _rows(spark, [(_fails(f.group_by(2, "user_id")), _fails(f.group_by(10**6, "user_id")), _fails(nulls.group_by(10, "user_id")))], "too_many_fails boolean, enough_fails boolean, null_fails boolean")


# folds


#: A fold whose steps can't change places: (31 * so far + event_id) % 1000003.
FOLDED = """
with recursive e as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as r from events),
f as (select distinct user_id, 0::bigint as r, 7::bigint as acc from events
union all select e.user_id, e.r, (31 * f.acc + e.event_id) % 1000003 from f join e on e.user_id = f.user_id and e.r = f.r + 1)
"""


def _step(acc: int, row: tuple) -> int:
    return (31 * acc + row[0]) % 1000003


@query(FOLDED + "select user_id, arg_max(acc, r) as folded from f group by 1")
def fold_with_function(spark, sf):
    return events(spark, sf, ("user_id",)).fold_with(_step, 7, ["event_id"], "long")


@query(FOLDED + "select user_id, r - 1 as pos, acc as scanned from f")
def scan_with_function(spark, sf):
    return events(spark, sf, ("user_id",)).scan_with(_step, 7, ["event_id"], "long").df


@query(FOLDED + "select user_id, arg_max(acc, r) as folded from f group by 1")
def fold_async(spark, sf):
    return events(spark, sf, ("user_id",)).fold_async(_step, 7, ["event_id"], "long")


@query(FOLDED + "select user_id, r - 1 as pos, acc as scanned from f")
def scan_async(spark, sf):
    return events(spark, sf, ("user_id",)).scan_async(_step, 7, ["event_id"], "long").df


@query(f"select min({O_CENTS}) as least, max({O_CENTS}) as most, count(*) as n, true as empty_fails from orders")
def reduce_min_max_count(spark, sf):
    f = orders(spark, sf)
    x = cents("o_totalprice")
    fails = _fails(f.drop_all().reduce("max", x))
    return f.reduce("min", x, "least").crossJoin(f.reduce("max", x, "most")).crossJoin(f.reduce("count", x, "n")).withColumn("empty_fails", F.lit(fails))  # a row each


@query(f"select pos, cents from (select row_number() over (order by event_id) - 1 as pos, max({CENTS}) over (order by event_id) as cents from events) union all select -1, 0")
def scan_max_cents(spark, sf):
    return events(spark, sf).scan("max", cents("value"), 0, "cents").df.select("pos", big("cents").alias("cents"))


# fan-in and fan-out


@query("select pos, event_id, o_orderkey from (select event_id, row_number() over (order by event_id) - 1 as pos from events) join (select o_orderkey, row_number() over (order by o_orderkey) - 1 as pos from orders) using (pos)")
def fan_in_product_attached(spark, sf):
    first, *others = events(spark, sf).map().attach(orders(spark, sf).map())
    return first.fan_in_to_product(*others, names=("event", "order_")).df.select("pos", "event.event_id", "order_.o_orderkey")


@query("""
with p as (select 0::bigint as src, o_orderkey as k, row_number() over (order by o_orderkey) - 1 as pos, count(*) over () as n from orders union all select 1, event_id, row_number() over (order by event_id) - 1, count(*) over () from events),
c as (select *, pos // 3 as turn from p),
n as (select max(n) filter (src = 0) as n0, max(n) filter (src = 1) as n1 from p)
select src, k from c, n where (turn < n0 // 3 or (turn = n0 // 3 and src <= 0)) and (turn < n1 // 3 or (turn = n1 // 3 and src <= 1))""")
def interleave_eager(spark, sf):
    a, other = _two(spark, sf)
    return a.interleave(other, segment=3, eager_complete=True).df.select(big("src").alias("src"), "k")


@query("select case when pos < 100 then 0 when pos < 350 then 1 else 2 end::bigint as branch, count(*) as n, min(event_id) as first_id from " + POSITIONED + " group by 1")
def fan_out_sequential(spark, sf):
    parts = events(spark, sf).map().fan_out_sequential([100, 250])
    return _union([f.df.agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).select(F.lit(i).cast("long").alias("branch"), "n", "first_id") for i, f in enumerate(parts)]).where("n > 0")


@query("select event_id from events")
def fan_out_to_any(spark, sf):
    return _union([f.df for f in events(spark, sf).map().fan_out_to_any(3)])


@query(f"select event_id, event_type, {CENTS} as amount from events")
def unzip_fields(spark, sf):
    pair = events(spark, sf).map(both=F.struct("event_type", cents("value").alias("amount")))
    kinds, amounts = pair.unzip("both")
    return kinds.df.join(amounts.df, "event_id")


@query("select (select count(*) from events) as n_seen, (select count(*) from events where value > 100) as n")
def tee_counts(spark, sf):
    seen: list[int] = []
    f = events(spark, sf).tee(lambda g: seen.append(g.folding("count", F.lit(1), 0))).filter(F.col("value") > 100)
    return f.fold("count", F.lit(1), 0, "n").select(F.lit(seen[0]).cast("long").alias("n_seen"), big("n").alias("n"))


@query("select src, k from (select 0::bigint as src, o_orderkey as k from orders where o_orderstatus = 'F' union all select 1, o_orderkey from orders where o_orderstatus <> 'F')")
def broadcast_sub_branches(spark, sf):
    filled, rest = orders(spark, sf).map(s=F.col("o_orderstatus")).broadcast(lambda f: f.filter(F.col("s") == "F").map(), lambda f: f.filter_not(F.col("s") == "F").map(), keep=True)
    return filled.concat(rest).df.select(big("src").alias("src"), F.col("o_orderkey").alias("k"))


# time


@query(f"select event_id from events where epoch_us(ts) - (select min(epoch_us(ts)) from events) <= {10**6} * {DAY}")
def timeouts_that_hold(spark, sf):
    f = events(spark, sf)
    return f.with_idle_timeout(10**6 * DAY, "ts").with_initial_timeout(10**6 * DAY, "ts", 0).with_completion_timeout(10**6 * DAY, "ts").map().df


@query(f"select (select max(g) from (select epoch_us(ts) - lag(epoch_us(ts)) over (order by event_id) as g from events)) > {HOUR} as idle, (select min(epoch_us(ts)) from events) > {HOUR} as initial, (select max(epoch_us(ts)) - min(epoch_us(ts)) from events) > {HOUR} as completion")
def timeouts_that_fail(spark, sf):
    f = events(spark, sf)
    return _rows(spark, [(_fails(f.with_idle_timeout(HOUR, "ts")), _fails(f.with_initial_timeout(HOUR, "ts", 0)), _fails(f.with_completion_timeout(HOUR, "ts")))], "idle boolean, initial boolean, completion boolean")


@query(f"select epoch_us(ts) // {DAY} * {DAY} as started, string_agg(event_id::varchar, ',' order by event_id) as ids from events group by 1")
def conflate_lists(spark, sf):
    return events(spark, sf).conflate(DAY, "ts", F.col("event_id")).df.select("started", listed("values").alias("ids"))


@query(f"select user_id, max(event_id) as event_id from events group by user_id, epoch_us(ts) // {DAY}")
def conflate_to_last_per_user(spark, sf):
    return events(spark, sf, ("user_id",)).map(ts=F.col("ts")).conflate_to_last(DAY, "ts").df.select("user_id", "event_id")


@query(f"""
with e as (select user_id, event_id, {CENTS} as c, epoch_us(ts) as t, lead(epoch_us(ts)) over (partition by user_id order by event_id) as next from events),
x as (select *, unnest(range(t, greatest(t, coalesce(next - 1, t)) + 1, {DAY})) as "at" from e)
select user_id, event_id, "at", c + (("at" - t) // {DAY})::bigint as extrapolated from x""")
def expand_extrapolated(spark, sf):
    f = events(spark, sf, ("user_id",)).map(ts=F.col("ts"), c=cents("value"))
    return f.expand_with(DAY, "ts", lambda n: F.col("c") + n.cast("long")).df.select("user_id", "event_id", "at", "extrapolated")


_BUFFERED = f"(select event_id, row_number() over (partition by epoch_us(ts) // {DAY} order by event_id) as i, count(*) over (partition by epoch_us(ts) // {DAY}) as n from events)"


@query(f"""
select 'DropHead' as strategy, event_id from {_BUFFERED} where i > n - 5
union all select 'DropNew', event_id from {_BUFFERED} where i <= 5
union all select 'DropTail', event_id from {_BUFFERED} where i < 5 or i = n
union all select 'DropBuffer', event_id from {_BUFFERED} where i > (n - 1) // 5 * 5""")
def buffer_dropping(spark, sf):
    f = events(spark, sf)
    return _union([f.buffer_dropping(5, "ts", DAY, s).map().df.select(F.lit(s).alias("strategy"), "event_id") for s in (DROP_HEAD, DROP_NEW, DROP_TAIL, DROP_BUFFER)])


@query(f"select max(n) > 5 as fails from (select count(*) as n from events group by epoch_us(ts) // {DAY})")
def buffer_overflow(spark, sf):
    return _rows(spark, [(_fails(events(spark, sf).buffer_dropping(5, "ts", DAY, FAIL)),)], "fails boolean")


# errors, hooks


@query(f"""
with bad as (select min(event_id) as b from events where not value < 300),
worse as (select min(o_orderkey) as b from orders where not round(o_totalprice * 100) < 30000)
select 0::bigint as src, event_id as k, {CENTS} as amount from events, bad where b is null or event_id < b
union all select 1, o_orderkey, {O_CENTS} from orders, bad, worse where bad.b is not null and (worse.b is null or o_orderkey < worse.b)
union all select 2, 9000000000 + i, i from range(3) t(i), bad, worse where bad.b is not null and worse.b is not null""")
def recover_with_chain(spark, sf):
    """Events until one fails, then orders until one fails, then three values that can't."""
    a, second = _two(spark, sf)
    last = OrderedFrame.of(spark.range(3).select((F.col("id") + 9_000_000_000).alias("k"), F.col("id").alias("amount")), "k")
    return second.recover_with(F.col("amount") < 30000, a, last).df.select(big("src").alias("src"), "k", "amount")


@query("select true as fails from (select count(*) from events where not value < 300) t(n) where n > 0 union all select false from (select count(*) from events where not value < 300) t(n) where n = 0")
def recovery_that_is_used_up(spark, sf):
    return _rows(spark, [(_fails(events(spark, sf).recover_with(F.col("value") < 300)),)], "fails boolean")


@query("select count(*) as elements, max(event_id) as most, count(*) as tapped from events")
def hooks_on_signal_and_element(spark, sf):
    tapped = spark.sparkContext.accumulator(0)
    f, seen = events(spark, sf).map().on_element(lambda row: tapped.add(1)).log_signal("events").on_signal("seen", F.max("event_id").alias("most"))
    f.ignore()
    return _rows(spark, [(seen.get["elements"], seen.get["most"], tapped.value)], "elements long, most long, tapped long")


@query("select 'start,complete,terminate' as of_success, 'start,error,terminate' as of_failure, (select count(*) from events) as n, 2::bigint as attempts")
def hooks_of_runs(spark, sf):
    f = events(spark, sf).map()

    def hooks() -> tuple[list[str], dict]:
        log: list[str] = []
        return log, {"on_start": lambda: log.append("start"), "on_complete": lambda: log.append("complete"), "on_error": lambda _: log.append("error"), "on_terminate": lambda _: log.append("terminate")}

    good, on = hooks()
    n = f.run(lambda df: df.count(), **on)
    bad, on = hooks()
    try:
        f.run(lambda df: 1 // 0, **on)
    except ZeroDivisionError:
        pass
    tries: list[int] = []

    def unsteady(df: DataFrame) -> int:
        tries.append(1)
        if len(tries) == 1:
            raise ValueError("once")
        return df.count()

    f.take(5).protect(unsteady)
    return _rows(spark, [(",".join(good), ",".join(bad), n, len(tries))], "of_success string, of_failure string, n long, attempts long")


@query("select pos, value from (values (0::bigint, 96::bigint), (1, 48), (2, 24), (3, 12), (4, 6), (5, 3)) t(pos, value)")
def feedback_halves(spark, sf):
    from millrace.operators.cycles import feedback

    f = feedback(values.of(spark, "long", 96), lambda g: g.filter(F.col("value") % 2 == 0).map(value=F.floor(F.col("value") / 2)), 10)
    return numbered(OrderedFrame.of(f.df.select("round", "value"), "round")).select("pos", "value")


# text and bytes


@query("select doc_id, text, (2 * length(text))::bigint as n_bytes from documents where text is not null and length(text) = octet_length(encode(text))")
def charset_round_trip(spark, sf):
    ascii_ = F.col("text").isNotNull() & (F.length("text") == F.octet_length("text"))
    f = table(spark, sf, "documents", "doc_id").filter(ascii_).map(data=text_functions.encode(F.col("text"), "UTF-16BE"))
    return f.map(text=text_functions.decode(F.col("data"), "UTF-16BE"), n_bytes=big(F.octet_length("data"))).df


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _x(sql: str) -> str:
    return f"lower(hex(encode({sql})))"


_T = "c_name"
_Z = "repeat(chr(0), 30 - length(c_name))"


@query(f"""
select c_custkey, {_x("left(c_name, 4)")} as taken, {_x("substr(c_name, 5)")} as dropped, {_x("right(c_name, 3)")} as right_, {_x("left(c_name, length(c_name) - 3)")} as not_right, {_x("substr(c_name, 3, 4)")} as sliced,
{_x("substr(c_name, 2)")} as tail, {_x("left(c_name, length(c_name) - 1)")} as init, {_x("left(c_name, 2) || 'xyz' || substr(c_name, 4)")} as patched, {_x("'Q' || substr(c_name, 2)")} as updated, {_x("left(c_name, 2) || 'xyz' || substr(c_name, 3)")} as inserted, {_x("left(c_name, 2) || 'xyz' || substr(c_name, 6)")} as spliced,
{_x("reverse(c_name)")} as reversed_, {_x("c_name || c_mktsegment || '!'")} as joined, {_x("'#' || c_name")} as prepended, repeat('00', 30 - length(c_name)) || {_x("c_name")} as padded_left, {_x("c_name")} || repeat('00', 30 - length(c_name)) as padded_right
from customer""")
def bytes_edits(spark, sf):
    x, y = F.encode("c_name", "UTF-8"), F.encode("c_mktsegment", "UTF-8")
    part = b.of(*b"xyz")
    made = {
        "taken": b.take(x, 4), "dropped": b.drop(x, 4), "right_": b.take_right(x, 3), "not_right": b.drop_right(x, 3), "sliced": b.slice_(x, 2, 6), "tail": b.tail(x), "init": b.init(x),
        "patched": b.patch(x, 2, part, 1), "updated": b.update(x, 0, ord("Q")), "inserted": b.insert(x, 2, part), "spliced": b.splice(x, 2, part), "reversed_": b.reverse(x),
        "joined": b.append(b.concat(x, y), ord("!")), "prepended": b.prepend(ord("#"), x), "padded_left": b.pad_left(x, 30), "padded_right": b.pad_right(x, 30),
    }
    return table(spark, sf, "customer", "c_custkey").map(**{k: _hex(v) for k, v in made.items()}).df


@query("""
select c_custkey, length(c_name) as n, ascii(c_name)::integer as head, ascii(right(c_name, 1))::integer as last, ascii(substr(c_name, 3, 1))::integer as third, null::integer as beyond, (instr(c_name, '00') - 1)::bigint as found, contains(c_name, '9') as has_nine, starts_with(c_name, 'Cust') as starts, ends_with(c_name, '7') as ends_,
list_sum(list_transform(string_split(c_name, ''), lambda c: ascii(c)))::bigint as total, ascii(c_name) + 1 as first_up, c_name as decoded, upper(c_name) as upper_
from customer""")
def bytes_reads(spark, sf):
    x = F.encode("c_name", "UTF-8")
    upper = b.map_(x, lambda c: F.when((c >= 97) & (c <= 122), c - 32).otherwise(c))
    return table(spark, sf, "customer", "c_custkey").map(
        n=big(b.size(x)), head=b.head(x).cast("int"), last=b.last(x).cast("int"), third=b.byte_at(x, 2).cast("int"), beyond=b.lift(x, 100).cast("int"), found=b.index_of_slice(x, b.of(48, 48)), has_nine=b.contains_slice(x, b.of(57)), starts=b.starts_with(x, b.of(*b"Cust")), ends_=b.ends_with(x, b.of(55)),
        total=b.fold_left(x, F.lit(0).cast("long"), lambda acc, c: acc + c), first_up=F.get(b.map_i(x, lambda c: c + 1), F.lit(0)), decoded=b.decode_string(x, "UTF-8"), upper_=b.decode_ascii(upper),
    ).df


@query("select conv_id, turn, octet_length(encode(text))::bigint as n, md5(text) as md5 from conversations where text is not null")
def bytes_of_arrays(spark, sf):
    """Bytes taken apart as numbers, and put together again."""
    x = b.of_array(b.to_array(F.encode("text", "UTF-8")))
    return table(spark, sf, "conversations", ("conv_id", "turn")).filter(F.col("text").isNotNull()).map(n=big(b.size(x)), md5=F.md5(x)).df


#: The generator's states, step by step, with halves as unsigned numbers; a shift to the right keeps the sign.
_SIGNED = "({v} // {two} + case when {v} >= 9223372036854775808 then 18446744073709551616 - {high} else 0 end)"
_STATES = f"""
with recursive n as (select count(*) as n from events),
x as (select 0::bigint as i, 20161224::hugeint as a, 9021::hugeint as b, 0::hugeint as before
union all select i + 1, b, xor(xor(t, b), xor({_SIGNED.format(v="t", two=1 << 17, high=1 << 47)}, {_SIGNED.format(v="b", two=1 << 26, high=1 << 38)})), b from (select i, b, xor(a, (a * 8388608) % 18446744073709551616) as t from x, n where i < n.n)),
v as (select i - 1 as pos, (b + before) % 18446744073709551616 as u from x where i > 0),
r as (select pos, (case when u >= 9223372036854775808 then u - 18446744073709551616 else u end)::bigint as l from v)"""


@query(f"""{_STATES}
select event_id, l, (u % 9007199254740992)::double / 9007199254740992 as d, ((u // 2) % 1000)::bigint as below_1000, (u % 64)::bigint as below_64, u % 2 = 1 as yes
from (select event_id, row_number() over (order by event_id) - 1 as pos from events) join r using (pos) join v using (pos)""")
def random_values(spark, sf):
    """The n-th value of one generator beside the n-th event, and what else is made of it."""
    from millrace.functions import randoms

    f = randoms.drawn(events(spark, sf).map(), 20161224, 9021, "r")
    x = F.col("r")[0]
    return f.df.select("event_id", x.alias("l"), randoms.next_double(x).alias("d"), randoms.next_long(x, 1000).alias("below_1000"), randoms.next_long(x, 64).alias("below_64"), randoms.next_boolean(x).alias("yes"))


@query(f"""{_STATES}
select row_number() over (order by l, event_id) - 1 as pos, event_id from (select event_id, row_number() over (order by event_id) - 1 as pos from events) join r using (pos)""")
def random_order(spark, sf):
    """Events in the order of the generator's values: a permutation."""
    from millrace.functions import randoms

    return numbered(randoms.in_random_order(events(spark, sf).map(), 20161224, 9021)).select("pos", "event_id")
