"""Queries of streams of streams, chains of positional operators, folds by functions, and errors of functions."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import functions as F

from millrace.operators.timed import micros
from millrace.plans.catalogue import CENTS, HOUR, POSITIONED, big, cents, events, listed, orders, query

#: Events with the paths of three levels of sub-streams of 1,000, 100 and 10 elements.
PATHS = f"(select event_id, pos, {CENTS} as cents, pos // 1000 as group_id, pos % 1000 // 100 as group_id_2, pos % 100 // 10 as group_id_3 from {POSITIONED})"


def _three_levels(spark, sf):
    return events(spark, sf).map(cents=cents("value")).inject_sequential(1000).inject_sequential(100).inject_sequential(10)


@query(f"select group_id, group_id_2, group_id_3, count(*) as n, sum(cents)::bigint as cents from {PATHS} group by all")
def substreams_three_levels(spark, sf):
    return _three_levels(spark, sf).df.groupBy("group_id", "group_id_2", "group_id_3").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query(f"""
with a as (select group_id, group_id_2, group_id_3, sum(cents) as s from {PATHS} group by all),
b as (select group_id, group_id_2, max(s) as m from a group by all)
select group_id, sum(m)::bigint as total from b group by all""")
def substreams_fold_of_folds(spark, sf):
    """Of each sub-stream of a sub-stream its sum, of those the greatest, of those the sum: three folds, a level each."""
    f = _three_levels(spark, sf).fold_streams("sum", F.col("cents"), 0, "s").fold_streams("max", F.col("s"), -(10**15), "m")
    return f.fold("sum", F.col("m"), 0, "total").select("group_id", big("total").alias("total"))


@query(f"""
with p as (select *, row_number() over (order by event_id) - 1 as again from {PATHS} where pos % 10 >= 2)
select event_id, cents from p where again % 3 = 2""")
def substreams_flattened(spark, sf):
    """Each sub-stream of the third level without its first two, flattened level by level to the input's order, and every third of that."""
    f = _three_levels(spark, sf).drop(2).flatten_concat().flatten_concat().flatten_concat()
    return f.take_every_nth(3).df.select("event_id", "cents")


@query("""
with s as (select user_id, event_id, event_type, case when event_type = 'signup' and row_number() over w > 1 then 1 else 0 end as s from events window w as (partition by user_id order by event_id)),
g as (select *, sum(s) over (partition by user_id order by event_id) as group_id from s),
a as (select *, coalesce(lag((event_type = 'purchase')::int) over (partition by user_id, group_id order by event_id), 0) as after from g),
h as (select *, sum(after) over (partition by user_id, group_id order by event_id) as group_id_2 from a)
select user_id, group_id::bigint as group_id, group_id_2::bigint as group_id_2, min(event_id) as first_event, count(*) as n from h group by all""")
def splits_within_splits(spark, sf):
    """Each user's events, cut where a signup begins a visit, and each visit cut after its purchases."""
    f = events(spark, sf, ("user_id",)).map(event_type=F.col("event_type")).split_when(F.col("event_type") == "signup").split_after(F.col("event_type") == "purchase")
    return f.df.groupBy("user_id", "group_id", "group_id_2").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


@query(f"""
with r as (select event_id, pos % 3 as group_id, pos // 3 as own from {POSITIONED}),
b as (select *, i as group_id_2 from r, range(2) t(i))
select group_id, group_id_2, event_id from b where own % 5 = 4""")
def broadcast_within_round_robin(spark, sf):
    f = events(spark, sf).map().inject_round_robin(3).inject_broadcast(2).take_every_nth(5)
    return f.df.select("group_id", "group_id_2", "event_id")


@query("""
with e as (select event_id, event_type, pos // 500 as group_id, row_number() over (partition by pos // 500, event_type order by event_id) - 1 as own from (select *, row_number() over (order by event_id) - 1 as pos from events))
select row_number() over (order by group_id, own, event_type) - 1 as pos, group_id, event_type, event_id from e""")
def group_by_within_substreams(spark, sf):
    """In each 500 events a sub-stream for each type; types take turns, then the 500s follow each other."""
    from millrace.positions import numbered

    f = events(spark, sf).map(event_type=F.col("event_type")).inject_sequential(500).group_by(100, "event_type").flatten_round_robin().flatten_concat()
    return numbered(f).select("pos", "group_id", "event_type", "event_id")


@query("""
with z as (select e.event_id, o.o_orderkey, e.pos from (select event_id, row_number() over (order by event_id) - 1 as pos from events) e join (select o_orderkey, row_number() over (order by o_orderkey) - 1 as pos from orders) o using (pos)),
d as (select *, row_number() over (order by pos) - 1 as again, count(*) over () as n from z where pos >= 10)
select pos, event_id, o_orderkey from d where again < n - 5 and again % 3 = 2""")
def zip_drop_take(spark, sf):
    """A zip, without its first ten and its last five, every third."""
    f = events(spark, sf).zip(orders(spark, sf)).drop(10).drop_last(5).take_every_nth(3)
    return f.df.select("pos", "_1.event_id", "_2.o_orderkey")


@query(f"""
with s as (select row_number() over (order by event_id) as own, sum({CENTS}) over (order by event_id) as c from events),
w as (select own, lag(c, 2) over (order by own) as a, lag(c) over (order by own) as b, c from s)
select own - 3 as pos, concat_ws(',', a::bigint, b::bigint, c::bigint) as sums from w where own >= 3""")
def scan_drop_sliding(spark, sf):
    """Windows of three of the sums so far."""
    f = events(spark, sf).scan("sum", cents("value"), 0, "cents").drop(1).sliding(3, F.col("cents").cast("long"))
    return f.df.select("pos", listed("window").alias("sums"))


@query("""
with e as (select event_id, event_type, (1000000 - event_id)::bigint as pos, lag(event_type) over (order by event_id) as before, row_number() over (order by event_id) as r from events),
d as (select *, row_number() over (order by event_id) - 1 as own from e where r = 1 or event_type is distinct from before)
select event_id, event_type, pos from d where own >= 7 and (own - 7) % 4 >= 1""")
def own_pos_through_a_chain(spark, sf):
    """A table's own column pos stays what it is."""
    f = events(spark, sf).map(event_type=F.col("event_type"), pos=(F.lit(1_000_000) - F.col("event_id")).cast("long"))
    return f.deduplicate("event_type").drop(7).slice_every(1, 3).df.select("event_id", "event_type", "pos")


M = 1_000_003


def _affine(row):
    event_id, c = row
    return [c % 7 + 1, event_id % M]


def _then(f, g):
    return [f[0] * g[0] % M, (f[1] * g[0] + g[1]) % M]


#: Affine maps x -> a x + b of events, put together in order.
AFFINE = f"list_reduce(list([{CENTS} % 7 + 1, event_id % {M}] order by event_id), lambda f, g: [f[1] * g[1] % {M}, (f[2] * g[1] + g[2]) % {M}])"


@query(f"select m[1]::bigint as a, m[2]::bigint as b from (select {AFFINE} as m from events)")
def fold_affine_maps(spark, sf):
    """A fold by a function that is associative, and not commutative: of one stream, by many tasks."""
    f = events(spark, sf).map(cents=cents("value"))
    return f.fold_by(_affine, _then, [1, 0], ["event_id", "cents"], "array<long>", "m").select(F.col("m")[0].alias("a"), F.col("m")[1].alias("b"))


@query(f"select user_id, m[1]::bigint as a, m[2]::bigint as b from (select user_id, {AFFINE} as m from events group by user_id)")
def fold_affine_maps_users(spark, sf):
    f = events(spark, sf, ("user_id",)).map(cents=cents("value"))
    return f.fold_by(_affine, _then, [1, 0], ["event_id", "cents"], "array<long>", "m").select("user_id", F.col("m")[0].alias("a"), F.col("m")[1].alias("b"))


def _since(row):
    kind, c = row
    return [1, 0] if kind == "signup" else [0, c]


def _later(a, b):
    return [1, b[1]] if b[0] else [a[0], a[1] + b[1]]


@query(f"""
with g as (select row_number() over (order by event_id) - 1 as pos, event_type, {CENTS} as c, count(*) filter (event_type = 'signup') over (order by event_id) as g from events)
select pos, (sum(case when event_type = 'signup' then 0 else c end) over (partition by g order by pos))::bigint as cents from g union all select -1, 0""")
def scan_since_signup(spark, sf):
    """The sum since the last signup, after each event: a scan by a function, of one stream, by many tasks."""
    f = events(spark, sf).map(event_type=F.col("event_type"), cents=cents("value"))
    return f.scan_by(_since, _later, [0, 0], ["event_type", "cents"], "array<long>", "s").df.select("pos", F.col("s")[1].alias("cents"))


@query(f"""
with recursive e as materialized (select row_number() over (order by event_id) - 1 as pos, event_id, epoch_us(ts) as t from events),
n as materialized (select a.pos, coalesce(min(case when b.t >= a.t + 6 * {HOUR} then b.pos end), a.pos + 40) as later from e a left join e b on b.pos between a.pos + 1 and a.pos + 40 group by a.pos),
s as (select 0::bigint as pos union all select n.later from s join n using (pos) where n.later <= (select max(pos) from e)),
g as (select pos as first, lead(pos, 1, (select max(pos) + 1 from e)) over (order by pos) as upto, row_number() over (order by pos) - 1 as group_id from s)
select group_id, min(case when e.pos = first then t end)::bigint as started, string_agg(event_id::varchar, ',' order by e.pos) as ids from g join e on e.pos >= first and e.pos < upto group by group_id""")
def grouped_within_all(spark, sf):
    """Events in groups of 40, or of what comes within six hours of a group's first: of one stream, by many tasks."""
    f = events(spark, sf).map(ts=F.col("ts"), id=F.col("event_id")).grouped_within(40, 6 * HOUR, "ts", "id")
    return f.df.select("group_id", "started", listed("group").alias("ids"))


def _risky(row):
    """Fails where a division does, and for a kind of event: no condition says so to the library."""
    c, kind, event_id = row
    if kind == "purchase" and event_id % 251 == 250:
        raise KeyError(f"no price for {event_id}")
    return 1_000_000 // (c - 17_500)


#: Where _risky fails, and with what.
FAILS = f"case when event_type = 'purchase' and event_id % 251 = 250 then 'KeyError' when {CENTS} = 17500 then 'ZeroDivisionError' end"
_SHARE = f"floor(1000000 / ({CENTS} - 17500)::double)::bigint"


def _tried(spark, sf):
    f = events(spark, sf).map(c=cents("value"), kind=F.col("event_type"), id=F.col("event_id")).with_columns(key=F.col("event_id"))
    return f.map(c=F.col("c"), kind=F.col("kind"), id=F.col("id")).try_map(_risky, ["c", "kind", "id"], "long", "share")


@query(f"""
with e as (select event_id, {FAILS} as fails, case when {FAILS} is null then {_SHARE} end as share from events),
f as (select min(event_id) as first from e where fails is not null)
select 0::bigint as src, event_id as key, share from e, f where first is null or event_id < first
union all select 1, o_orderkey, {CENTS.replace('value', 'o_totalprice')} from orders, f where first is not null""")
def recover_function_error(spark, sf):
    """What a function makes of events until it raises, then all orders."""
    tried = _tried(spark, sf)
    tried = tried.within(tried.df.withColumnRenamed("event_id", "key"), ("key",))
    other = orders(spark, sf).map(share=cents("o_totalprice"))
    other = other.within(other.df.withColumnRenamed("o_orderkey", "key"), ("key",))
    return tried.recover_raised(other).df.select(big("src").alias("src"), "key", "share")


@query(f"""
with e as (select event_id, {FAILS} as fails, case when {FAILS} is null then {_SHARE} end as share from events)
select event_id, fails is null as ok, share, fails as error_type from e where event_id <= coalesce((select min(event_id) from e where fails is not null), event_id)""")
def function_error_to_try(spark, sf):
    f = _tried(spark, sf).raised_to_try()
    return f.df.select("event_id", "result.ok", "result.share", "result.error_type")


@query(f"select event_id, {FAILS} as error_type, case when {FAILS} is null then {_SHARE} end as share from events")
def function_errors_of_all(spark, sf):
    """Each event, with what the function gives or raises."""
    return _tried(spark, sf).df.select("event_id", "error_type", "share")


_LINE = "concat(event_id, '|', event_type, '|', {cents}, ' é', case when event_id % 40 = 3 then chr(10) || chr(10) else '' end)"


@query(f"""
with t as (select unnest(string_split(string_agg({_LINE.format(cents=CENTS)} || chr(10), '' order by event_id), chr(10))) as line, generate_subscripts(string_split(string_agg({_LINE.format(cents=CENTS)} || chr(10), '' order by event_id), chr(10)), 1) as i from events),
n as (select max(i) as n from t)
select i - 1 as pos, line from t, n where i < n.n""")
def file_lines_in_ranges(spark, sf):
    """Events written to one file by all tasks, and its lines read as ranges of 16 KB."""
    from millrace import session
    from millrace.positions import numbered
    from millrace.sources.files import from_file_lines

    line = F.concat(F.col("event_id"), F.lit("|"), F.col("event_type"), F.lit("|"), cents("value"), F.lit(" é"), F.when(F.col("event_id") % 40 == 3, "\n\n").otherwise(""), F.lit("\n"))
    path = urlparse(session.shared_path(spark, "events")).path
    events(spark, sf).to_file(path, line)
    return numbered(from_file_lines(spark, path, range_bytes=16384)).select("pos", F.col("value").alias("line"))


@query(f"select octet_length(encode(string_agg({_LINE.format(cents=CENTS)}, '' order by event_id)))::bigint as n_bytes, md5(string_agg({_LINE.format(cents=CENTS)}, '' order by event_id)) as md5 from events")
def file_text_in_ranges(spark, sf):
    """Events written to one file by all tasks, and its text read as ranges of 16 KB, in chunks of whole characters."""
    from millrace import session
    from millrace.sources.files import from_file_text

    line = F.concat(F.col("event_id"), F.lit("|"), F.col("event_type"), F.lit("|"), cents("value"), F.lit(" é"), F.when(F.col("event_id") % 40 == 3, "\n\n").otherwise(""))
    path = urlparse(session.shared_path(spark, "events")).path
    n = events(spark, sf).to_file(path, line)
    text = from_file_text(spark, path, 100, range_bytes=16384)
    return text.digest(F.col("value"), "md5", "md5").select(F.lit(n).cast("long").alias("n_bytes"), "md5")


@query("""
with e as (select row_number() over (order by event_id) - 1 as pos, event_id from events), o as (select row_number() over (order by o_orderkey) - 1 as pos, o_orderkey from orders), r as (select row_number() over (order by event_id desc) - 1 as pos, event_id as back from events)
select pos, event_id, o_orderkey, back from e join o using (pos) join r using (pos)""")
def zip_of_placed(spark, sf):
    """Events, orders and events from the last to the first side by side, of frames kept with their positions."""
    e, o = events(spark, sf).map().placed(), orders(spark, sf).map().placed()
    last = events(spark, sf).map(back=F.col("event_id"))
    r = last.within(last.df.select((-F.col("event_id")).alias("k"), "back"), ("k",)).placed()
    return e.zip(o, r).df.select("pos", "_1.event_id", "_2.o_orderkey", "_3.back")


_FIRST = 1_704_067_200_000_000 - 30 * HOUR


@query(f"""
with e as (select epoch_us(ts) as t, {CENTS} as cents, lead(epoch_us(ts)) over (order by event_id) as later from events),
z as (select {_FIRST} as t, -500 as cents, (select min(t) from e) as later),
a as (select * from e union all select * from z)
select (t + i * {HOUR})::bigint as at, (cents + 10 * i)::bigint as extrapolated from a, lateral (select unnest(range(0, greatest(1, (coalesce(later, t + 1) - t + {HOUR - 1}) // {HOUR}))) as i)""")
def expand_from_zero(spark, sf):
    """Hour by hour until the next event each event's value and ten cents more, and from thirty hours before the month on what is made of a zero."""
    f = events(spark, sf).map(ts=F.col("ts"), cents=cents("value"))
    found = f.expand_from(-500, HOUR, "ts", _FIRST, F.col("cents"), lambda v, n: v + 10 * n)
    return found.df.select("at", F.col("extrapolated").cast("long").alias("extrapolated"))


# replayed in micro-batches


def _replayed(spark, sf, batches: int = 3, marker: bool = True):
    """Events as a stream of micro-batches in the order of time; last comes a row of a user -1, years later, for timers that are still open."""
    from millrace import session, streaming

    e = events(spark, sf).df.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    if marker:
        e = e.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast(e.schema["user_id"].dataType).alias("user_id"), F.lit("end").alias("event_type"), F.lit("2100-01-01 00:00:00").cast("timestamp").alias("ts")))
    return streaming.replayed(e, "ts", batches, session.shared_path(spark, "replayed"))


_IN_TIME = "e as (select user_id, event_id, event_type, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as r from events)"


@query(f"""
with recursive {_IN_TIME},
g as (select user_id, r, t as began, 1 as n, 0::bigint as group_id, event_id from e where r = 1
union all select e.user_id, e.r, case when g.n >= 3 or e.t - g.began >= {20 * HOUR} then e.t else g.began end, case when g.n >= 3 or e.t - g.began >= {20 * HOUR} then 1 else g.n + 1 end, g.group_id + case when g.n >= 3 or e.t - g.began >= {20 * HOUR} then 1 else 0 end, e.event_id
from g join e on e.user_id = g.user_id and e.r = g.r + 1)
select user_id, group_id, min(began)::bigint as started, string_agg(cast(event_id as varchar), ',' order by r) as ids from g group by 1, 2""")
def stream_grouped_within(spark, sf):
    """Groups of three events of a user, or of what comes within 20 hours, closed by timers."""
    from millrace import streaming

    found = streaming.grouped_within(_replayed(spark, sf), ["user_id"], ["ts", "event_id"], "ts", "1 second", "event_id", 3, 20 * HOUR)
    return streaming.played(found, "grouped").where("user_id >= 0").select("user_id", "group_id", "started", listed("group").alias("ids"))


@query(f"""
with {_IN_TIME},
s as (select *, case when r = 1 or t - lag(t) over (partition by user_id order by r) >= {48 * HOUR} then 1 else 0 end as s from e),
g as (select *, sum(s) over (partition by user_id order by r) as g from s)
select user_id, max(t)::bigint as since, count(*) as n from g group by user_id, g""")
def stream_idle(spark, sf):
    """Silences of users of two days or more, found when the watermark has passed them."""
    from millrace import streaming

    found = streaming.idle(_replayed(spark, sf), ["user_id"], ["ts", "event_id"], "ts", "1 second", 48 * HOUR)
    return streaming.played(found, "idle").where("user_id >= 0").select("user_id", "since", "n")


@query(f"""
with recursive {_IN_TIME},
d as (select user_id, r, event_id, t + {5 * HOUR} as sent from e where r = 1
union all select e.user_id, e.r, e.event_id, greatest(e.t, d.sent) + {5 * HOUR} from d join e on e.user_id = d.user_id and e.r = d.r + 1)
select user_id, event_id, sent::bigint as sent from d""")
def stream_delay(spark, sf):
    """Each event five hours after it came, or after the user's event before it left, let go by timers."""
    from millrace import streaming

    found = streaming.delay(_replayed(spark, sf), ["user_id"], ["ts", "event_id"], "ts", "1 second", 5 * HOUR, ["event_id"])
    return streaming.played(found, "delayed").where("user_id >= 0").select("user_id", "event_id", F.col("left").alias("sent"))


def _two_streams(spark, sf):
    """Events by user and orders by customer, each in three micro-batches."""
    from millrace import session, streaming

    e = events(spark, sf).df.select(big("user_id").alias("k"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    o = orders(spark, sf).df.select(big("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    return [streaming.replayed(x, "id", 3, session.shared_path(spark, "replayed")) for x in (e, o)]


_SIDES = "e as (select user_id as k, event_id as id, row_number() over (partition by user_id order by event_id) - 1 as p from events), o as (select o_custkey as k, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as p from orders)"


@query(f"with {_SIDES} select k::bigint as k, p as pos, e.id as event_id, o.id as o_orderkey from e join o using (k, p)")
def stream_zip(spark, sf):
    """The n-th event of a user beside the n-th order of the customer of that number, of two streams."""
    from millrace import streaming

    found = streaming.zipped(*_two_streams(spark, sf), ["k"], "id", "ts", "id")
    return streaming.played(found, "zipped").select("k", "pos", F.col("left").alias("event_id"), F.col("right").alias("o_orderkey"))


@query(f"""
with {_SIDES}, both_ as (select k, id, p, 0 as src from e union all select k, id, p, 1 from o),
t as (select *, 2 * 2 * (p // 2) + 2 * src + p % 2 as turn from both_),
c as (select *, row_number() over (partition by k order by turn) - 1 as pos from t)
select k::bigint as k, pos, src::bigint as src, id from c where pos = turn""")
def stream_interleave(spark, sf):
    """Two events of a user, two orders of the customer of that number, and so on, of two streams."""
    from millrace import streaming

    found = streaming.interleaved(*_two_streams(spark, sf), ["k"], "id", "ts", "id", 2)
    return streaming.played(found, "interleaved").select("k", "pos", big("src").alias("src"), "id")


@query(f"""
with {_IN_TIME}
select user_id, row_number() over (partition by user_id order by t, case when event_type = 'purchase' then 0 else 1 end, event_id) - 1 as pos, case when event_type = 'purchase' then 0 else 1 end::bigint as src, event_id from e""")
def stream_merge_sorted(spark, sf):
    """Purchases and all other events, two streams, as one in the order of time, let go by the watermark."""
    from millrace import streaming

    whole = _replayed(spark, sf)
    found = streaming.merged_sorted(whole.where("event_type = 'purchase'"), whole.where("event_type <> 'purchase'"), ["user_id"], "event_id", "ts", "1 second", "event_id")
    return streaming.played(found, "merged").where("user_id >= 0").select("user_id", "pos", big("src").alias("src"), "event_id")
