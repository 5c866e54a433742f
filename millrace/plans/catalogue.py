"""Queries of the ordered-stream operators over the test tables, with their SQL where SQL can say it.

Amounts are in cents (whole numbers), so sums don't depend on their order; lists are shown
as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.frame import OrderedFrame
from millrace.functions import text as text_functions
from millrace.functions.digest import digest
from millrace.operators import groups
from millrace.operators.timed import micros
from millrace.sources import values
from millrace.sources.files import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DAY, HOUR = 86_400_000_000, 3_600_000_000


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from millrace.plans import further, streams  # noqa: F401  (they add their own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from millrace.plans import further, streams  # noqa: F401

    return dict(SQL)


def events(spark: SparkSession, sf: str, by: tuple[str, ...] = ()) -> OrderedFrame:
    return table(spark, sf, "events", "event_id", by)


def orders(spark: SparkSession, sf: str) -> OrderedFrame:
    return table(spark, sf, "orders", "o_orderkey")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def listed(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def big(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


CENTS = "cast(round(value * 100) as bigint)"
O_CENTS = "cast(round(o_totalprice * 100) as bigint)"
#: Events with their position.
POSITIONED = "(select *, row_number() over (order by event_id) - 1 as pos, count(*) over () as n from events)"


@query("select event_id, value * 2 as v from events where value * 2 > 100 order by event_id limit 50")
def map_filter_take(spark, sf):
    return events(spark, sf).map(v=F.col("value") * 2).filter(F.col("v") > 100).take(50).df


@query(f"select event_id, {CENTS} as cents from events where event_type = 'purchase'")
def collect_partial(spark, sf):
    return events(spark, sf).collect_where(F.col("event_type") == "purchase", cents=cents("value")).df


@query("select o_orderkey from orders where not (o_orderstatus = 'O')")
def filter_not(spark, sf):
    return orders(spark, sf).filter_not(F.col("o_orderstatus") == "O").map().df


@query("select event_id, try_cast(regexp_extract(props, '[0-9]+') as bigint) as number from events where try_cast(regexp_extract(props, '[0-9]+') as bigint) is not null")
def filter_type_numbers(spark, sf):
    return events(spark, sf).map(number=F.regexp_extract("props", "[0-9]+", 0)).filter_type("number", "bigint").df


@query("select doc_id, cast(i - 1 as bigint) as idx, w as word from (select doc_id, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as i from documents where text is not null)")
def flat_map_words(spark, sf):
    f = table(spark, sf, "documents", "doc_id").flat_map(F.split("text", " ", -1), "word")
    return f.df.select("doc_id", big("idx").alias("idx"), "word")


@query("select o_orderkey, cast(i as bigint) as idx from orders, range(3) t(i)")
def multiply_3(spark, sf):
    return orders(spark, sf).multiply(3).df.select("o_orderkey", big("idx").alias("idx"))


@query("select event_id, event_type from (select event_id, event_type, lag(event_type) over (order by event_id) as before, row_number() over (order by event_id) as r from events) where r = 1 or event_type is distinct from before")
def deduplicate_type(spark, sf):
    return events(spark, sf).map(event_type=F.col("event_type")).deduplicate().df


@query("""
with p as (select row_number() over (order by event_id) - 1 as pos, event_type as x from events)
select pos as place, cast(case when pos = 0 then 0 else 1 end as bigint) as part, x as event_type from p
union all select pos, 0, ',' from p where pos > 0
union all select -1, 0, '[' union all select 4611686018427387904, 0, ']'""")
def intersperse_sep(spark, sf):
    f = events(spark, sf).intersperse("event_type", F.lit(","), F.lit("["), F.lit("]"))
    return f.df.select("place", big("part").alias("part"), "event_type")


@query(f"select event_id from {POSITIONED} where pos >= 100")
def drop_n(spark, sf):
    return events(spark, sf).map().drop(100).df


@query(f"select event_id from {POSITIONED} where pos < n - 5")
def drop_last_5(spark, sf):
    return events(spark, sf).map().drop_last(5).df


@query(f"select event_id from {POSITIONED} where pos >= n - 5")
def take_last_5(spark, sf):
    return events(spark, sf).map().take_last(5).df


@query(f"select event_id, event_type from {POSITIONED} where pos = 42")
def element_at(spark, sf):
    return events(spark, sf).map(event_type=F.col("event_type")).element_at(42).df


@query(f"select event_id from {POSITIONED} where pos >= 10 and pos < 30")
def slice_10_20(spark, sf):
    return events(spark, sf).map().slice(10, 20).df


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as r from events) where r <= 3")
def take_3_per_user(spark, sf):
    return events(spark, sf, ("user_id",)).map().take(3).df


@query(f"select event_id, {CENTS} as cents from events where event_id < coalesce((select min(event_id) from events where not (value < 300)), 9223372036854775807)")
def take_while(spark, sf):
    return events(spark, sf).map(cents=cents("value"), value=F.col("value")).take_while(F.col("value") < 300).map(cents=F.col("cents")).df


@query(f"select event_id, {CENTS} as cents from events where event_id >= (select min(event_id) from events where not (value < 300))")
def drop_while(spark, sf):
    return events(spark, sf).map(cents=cents("value"), value=F.col("value")).drop_while(F.col("value") < 300).map(cents=F.col("cents")).df


@query(f"select event_id from {POSITIONED} where pos % 10 = 9")
def take_every_10(spark, sf):
    return events(spark, sf).map().take_every_nth(10).df


@query(f"select event_id from {POSITIONED} where pos % 7 >= 3")
def slice_every_3_4(spark, sf):
    return events(spark, sf).map().slice_every(3, 4).df


@query("select o_orderkey from orders")
def with_limit_weighted(spark, sf):
    return orders(spark, sf).with_limit_weighted(10**15, cents("o_totalprice")).map().df


@query("select pos // 7 as group_id, string_agg(cast(event_id as varchar), ',' order by pos) as ids from (select event_id, row_number() over (order by event_id) - 1 as pos from events) group by 1")
def grouped_7(spark, sf):
    return events(spark, sf).grouped(7, F.col("event_id")).df.select("group_id", listed("group").alias("ids"))


@query("select pos - 3 as pos, concat_ws(',', a, b, c, d) as ids from (select row_number() over w - 1 as pos, lag(event_id, 3) over w as a, lag(event_id, 2) over w as b, lag(event_id) over w as c, event_id as d from events window w as (order by event_id)) where pos >= 3")
def sliding_4(spark, sf):
    return events(spark, sf).sliding(4, F.col("event_id")).df.select("pos", listed("window").alias("ids"))


@query("""
with k as (select user_id, event_id, case when row_number() over w = 1 or event_type = 'signup' then 1 else 0 end as s from events window w as (partition by user_id order by event_id))
select user_id, event_id, cast(sum(s) over (partition by user_id order by event_id) - 1 as bigint) as group_id from k""")
def split_when_signup(spark, sf):
    f = events(spark, sf, ("user_id",)).map(event_type=F.col("event_type")).split_when(F.col("event_type") == "signup")
    return f.df.select("user_id", "event_id", "group_id")


@query("""
with k as (select user_id, event_id, lag(event_type) over (partition by user_id order by event_id) as before from events)
select user_id, event_id, cast(sum(case when before = 'signup' then 1 else 0 end) over (partition by user_id order by event_id) as bigint) as group_id from k""")
def split_after_signup(spark, sf):
    f = events(spark, sf, ("user_id",)).map(event_type=F.col("event_type")).split_after(F.col("event_type") == "signup")
    return f.df.select("user_id", "event_id", "group_id")


@query("""
with e as (select event_id, ['Emit', 'Drop', 'EmitComplete', 'CompleteEmit', 'DropComplete'][cast(event_id * 7919 % 5 as integer) + 1] as cmd from events),
c as (select *, coalesce(sum(case when cmd in ('EmitComplete', 'DropComplete') then 1 else 0 end) over (order by event_id rows between unbounded preceding and 1 preceding), 0) as closed from e),
k as (select event_id, cmd, closed, lag(closed) over (order by event_id) as before from c where cmd not in ('Drop', 'DropComplete'))
select event_id, cmd, cast(sum(case when before is null or closed > before or cmd = 'CompleteEmit' then 1 else 0 end) over (order by event_id) - 1 as bigint) as group_id from k""")
def split_commands(spark, sf):
    command = F.get(F.array(*map(F.lit, groups.COMMANDS)), (F.col("event_id") * 7919 % 5).cast("int"))
    f = events(spark, sf).map(cmd=command).split(F.col("cmd"))
    return f.df.select("event_id", "cmd", "group_id")


@query(f"select event_type, sum({CENTS})::bigint as cents, count(*) as n from events group by 1")
def group_by_fold(spark, sf):
    f = events(spark, sf).group_by(100, "event_type")
    return f.fold("sum", cents("value"), 0, "cents").join(f.fold("count", F.lit(1), 0, "n"), "event_type").select("event_type", big("cents").alias("cents"), big("n").alias("n"))


@query("select l_returnflag, l_linestatus, sum(cast(l_quantity as bigint))::bigint as quantity from lineitem group by 1, 2")
def group_by_fold_lineitem(spark, sf):
    f = table(spark, sf, "lineitem", "l_orderkey").group_by(100, "l_returnflag", "l_linestatus")
    return f.fold("sum", F.col("l_quantity").cast("long"), 0, "quantity").select("l_returnflag", "l_linestatus", big("quantity").alias("quantity"))


@query(f"select pos, cents from (select row_number() over (order by event_id) - 1 as pos, sum({CENTS}) over (order by event_id)::bigint as cents from events) union all select -1, 0")
def scan_sum_cents(spark, sf):
    return events(spark, sf).scan("sum", cents("value"), 0, "cents").df.select("pos", big("cents").alias("cents"))


@query(f"select user_id, event_id, max({CENTS}) over (partition by user_id order by event_id) as most from events")
def running_max_per_user(spark, sf):
    from millrace.positions import running

    return running(events(spark, sf, ("user_id",)), most=("max", cents("value"))).select("user_id", "event_id", "most")


@query(f"select max({O_CENTS}) as most from orders")
def reduce_max(spark, sf):
    return orders(spark, sf).reduce("max", cents("o_totalprice"), "most")


@query(f"select sum({O_CENTS})::bigint as cents from orders")
def fold_sum(spark, sf):
    return orders(spark, sf).fold("sum", cents("o_totalprice"), 0, "cents").select(big("cents").alias("cents"))


@query("""
with p as (select event_id, row_number() over (order by event_id) - 1 as pos from events)
select string_agg(cast(event_id as varchar), ',' order by pos) as prefix, (select count(*) from p where pos >= 10) as n_tail, (select min(event_id) from p where pos >= 10) as first_tail from p where pos < 10""")
def prefix_and_tail(spark, sf):
    prefix, tail = events(spark, sf).prefix_and_tail(10, F.col("event_id"))
    rest = tail.df.agg(F.count("*").alias("n_tail"), F.min("event_id").alias("first_tail"))
    return prefix.select(listed("prefix").alias("prefix"), rest.select("n_tail").scalar().alias("n_tail"), rest.select("first_tail").scalar().alias("first_tail"))


def _two(spark, sf):
    a = orders(spark, sf).map(k=F.col("o_orderkey"), amount=cents("o_totalprice"))
    b = events(spark, sf).map(k=F.col("event_id"), amount=cents("value"))
    return [OrderedFrame.of(f.df.select("k", "amount"), "k") for f in (a, b)]


@query(f"select 0::bigint as src, o_orderkey as k, {O_CENTS} as amount from orders union all select 1, event_id, {CENTS} from events")
def concat_two(spark, sf):
    a, b = _two(spark, sf)
    return a.concat(b).df.select(big("src").alias("src"), "k", "amount")


@query(f"select pos, src, k from (select row_number() over (order by k, src) - 1 as pos, src, k from (select 0::bigint as src, o_orderkey as k from orders union all select 1, event_id from events))")
def merge_two(spark, sf):
    from millrace.positions import numbered

    a, b = _two(spark, sf)
    return numbered(a.merge(b)).select("pos", big("src").alias("src"), "k")


@query(f"select 1::bigint as src, event_id as k, {CENTS} as amount from events")
def or_else(spark, sf):
    a, b = _two(spark, sf)
    return a.filter(F.col("amount") < -1).or_else(b).df.select(big("src").alias("src"), "k", "amount")


@query("select a.pos, event_id, o_orderkey from (select event_id, row_number() over (order by event_id) - 1 as pos from events) a join (select o_orderkey, row_number() over (order by o_orderkey) - 1 as pos from orders) b using (pos)")
def zip_events_orders(spark, sf):
    return events(spark, sf).zip(orders(spark, sf)).df.select("pos", "_1.event_id", "_2.o_orderkey")


@query("select a.pos, event_id, o_orderkey, doc_id from (select event_id, row_number() over (order by event_id) - 1 as pos from events) a join (select o_orderkey, row_number() over (order by o_orderkey) - 1 as pos from orders) b using (pos) join (select doc_id, row_number() over (order by doc_id) - 1 as pos from documents) c using (pos)")
def fan_in_tuple3(spark, sf):
    f = events(spark, sf).fan_in_to_tuple(orders(spark, sf), table(spark, sf, "documents", "doc_id"), names=("e", "o", "d"))
    return f.df.select("pos", "e.event_id", "o.o_orderkey", "d.doc_id")


@query(f"select pos, event_id, event_type, {CENTS} as cents from {POSITIONED}")
def broadcast_diamond(spark, sf):
    kinds, amounts = events(spark, sf).broadcast(lambda f: f.map(event_type=F.col("event_type")), lambda f: f.map(cents=cents("value")))
    return kinds.zip(amounts).df.select("pos", "_1.event_id", "_1.event_type", "_2.cents")


@query("select case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end::bigint as branch, count(*) as n from orders group by 1")
def switch_by_status(spark, sf):
    index = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    parts = [f.df.agg(F.count("*").alias("n")).select(F.lit(i).cast("long").alias("branch"), "n") for i, f in enumerate(orders(spark, sf).switch(3, index))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("n > 0")


@query("""
with p as (select 0::bigint as src, o_orderkey as k, row_number() over (order by o_orderkey) - 1 as pos from orders union all select 1, event_id, row_number() over (order by event_id) - 1 from events)
select row_number() over (order by pos // 3, src, pos) - 1 as place, src, k from p""")
def interleave_3(spark, sf):
    from millrace.positions import numbered

    a, b = _two(spark, sf)
    f = a.interleave(b, segment=3)
    renamed = OrderedFrame.of(f.df.withColumnRenamed("pos", "own"), ("turn", "src", "own"))
    return numbered(renamed).select(F.col("pos").alias("place"), big("src").alias("src"), "k")


@query(f"""
with p as (select 0::bigint as src, o_orderkey as k, {O_CENTS} as amount from orders union all select 1, event_id, {CENTS} from events)
select row_number() over (order by amount, src, k) - 1 as pos, src, k, amount from p""")
def merge_sorted(spark, sf):
    from millrace.positions import numbered

    a, b = _two(spark, sf)
    return numbered(a.merge_sorted(b, values=("amount",))).select("pos", big("src").alias("src"), "k", "amount")


@query(f"select o_orderkey as k, 'left' as tag, {O_CENTS} as l, null::bigint as r from orders union all select event_id, 'right', null, {CENTS} from events")
def merge_to_either(spark, sf):
    a, b = _two(spark, sf)
    return a.merge_to_either(b, F.col("amount"), F.col("amount")).df.select("k", "either.tag", F.col("either.left").alias("l"), F.col("either.right").alias("r"))


@query("""
with p as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as turn from events)
select row_number() over (order by turn, user_id) - 1 as pos, user_id, event_id from p""")
def flatten_round_robin(spark, sf):
    from millrace.positions import numbered

    f = events(spark, sf, ("user_id",)).map().flatten_round_robin()
    return numbered(f).select("pos", "user_id", "event_id")


@query("select row_number() over (order by user_id, event_id) - 1 as pos, user_id, event_id from events")
def flatten_concat_users(spark, sf):
    from millrace.positions import numbered

    return numbered(events(spark, sf, ("user_id",)).map().flatten_concat()).select("pos", "user_id", "event_id")


@query("select pos % 4 as branch, count(*) as n, min(event_id) as first_id, max(event_id) as last_id from " + POSITIONED + " group by 1")
def fan_out_round_robin_4(spark, sf):
    from functools import reduce

    parts = [f.df.agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")).select(F.lit(i).cast("long").alias("branch"), "n", "first_id", "last_id") for i, f in enumerate(events(spark, sf).map().fan_out_round_robin(4))]
    return reduce(DataFrame.unionByName, parts)


@query("select doc_id, cast(case when text = '' then 0 when ends_with(text, chr(10)) then len(string_split(text, chr(10))) - 1 else len(string_split(text, chr(10))) end as bigint) as n_lines from documents where text is not null")
def lines_per_doc(spark, sf):
    return table(spark, sf, "documents", "doc_id").filter(F.col("text").isNotNull()).map(n_lines=big(F.size(text_functions.lines(F.col("text"))))).df


@query("select conv_id, '<' || string_agg(role, '|' order by turn) || '>' as text from conversations group by 1")
def mk_string_per_conv(spark, sf):
    return table(spark, sf, "conversations", "turn", "conv_id").mk_string(F.col("role"), "|", "<", ">")


@query("select doc_id, text, cast(octet_length(encode(text)) as bigint) as n_bytes from documents where text is not null")
def utf8_roundtrip(spark, sf):
    f = table(spark, sf, "documents", "doc_id").filter(F.col("text").isNotNull()).map(data=text_functions.utf8_encode(F.col("text")))
    return f.map(text=text_functions.utf8_decode(F.col("data")), n_bytes=big(F.octet_length("data"))).df


@query("select doc_id, md5(text) as md5, sha1(text) as sha1, sha256(text) as sha256 from documents")
def doc_md5_sha1_sha256(spark, sf):
    return table(spark, sf, "documents", "doc_id").map(**{a: digest(F.col("text"), a) for a in ("md5", "sha1", "sha256")}).df


@query()
def doc_sha384_sha512(spark, sf):
    return table(spark, sf, "documents", "doc_id").map(**{a: digest(F.col("text"), a) for a in ("sha384", "sha512")}).df


@query()
def turn_md2(spark, sf):
    return table(spark, sf, "conversations", ("conv_id", "turn")).map(md2=digest(F.col("text"), "md2")).df


@query("select conv_id, md5(string_agg(text, '' order by turn)) as digest from conversations group by 1")
def conversation_digest(spark, sf):
    return table(spark, sf, "conversations", "turn", "conv_id").digest(F.col("text"), "md5")


@query(f"select event_id from events where epoch_us(ts) - (select min(epoch_us(ts)) from events) < {DAY}")
def take_within_1d(spark, sf):
    return events(spark, sf).take_within(DAY, "ts").map().df


@query(f"select event_id from events where epoch_us(ts) - (select min(epoch_us(ts)) from events) >= {DAY}")
def drop_within_1d(spark, sf):
    return events(spark, sf).drop_within(DAY, "ts").map().df


@query(f"""
with d as (select event_id, epoch_us(ts) as a, {CENTS} * 10000 as d from events),
s as (select *, sum(d) over (order by event_id)::bigint as whole from d)
select event_id, (whole + max(a - (whole - d)) over (order by event_id))::bigint as emitted from s""")
def delay_values(spark, sf):
    return events(spark, sf).delay(cents("value") * 10_000, "ts").map(emitted=F.col("emitted")).df


@query(f"""
with recursive e as (select user_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by event_id) as r from events),
s as (select user_id, event_id, r, t::hugeint as sent, ({HOUR} * 2 - {HOUR})::hugeint as tokens from e where r = 1
union all select user_id, event_id, r, began + wait, have + 2 * wait - {HOUR}
from (select *, greatest(0, ({HOUR} - have + 1) // 2) as wait
from (select *, least({HOUR}::hugeint * 2, tokens + (began - sent) * 2) as have
from (select e.user_id, e.event_id, e.r, s.sent, s.tokens, greatest(s.sent, e.t) as began from s join e on e.user_id = s.user_id and e.r = s.r + 1))))
select user_id, event_id, sent::bigint as emitted from s""")
def throttle_emit(spark, sf):
    return events(spark, sf, ("user_id",)).map(ts=F.col("ts")).throttle(2, HOUR, "ts", burst=2).df.select("user_id", "event_id", "emitted")


@query(f"""
with recursive e as (select user_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by event_id) as r from events),
g as (select user_id, r, t as began, 1 as n, 0::bigint as group_id, event_id from e where r = 1
union all select e.user_id, e.r, case when g.n >= 5 or e.t - g.began >= {DAY} then e.t else g.began end, case when g.n >= 5 or e.t - g.began >= {DAY} then 1 else g.n + 1 end, g.group_id + case when g.n >= 5 or e.t - g.began >= {DAY} then 1 else 0 end, e.event_id
from g join e on e.user_id = g.user_id and e.r = g.r + 1)
select user_id, group_id, min(began)::bigint as started, string_agg(cast(event_id as varchar), ',' order by event_id) as ids from g group by 1, 2""")
def grouped_within_user(spark, sf):
    f = events(spark, sf, ("user_id",)).grouped_within(5, DAY, "ts", "event_id")
    return f.df.select("user_id", "group_id", "started", listed("group").alias("ids"))


@query("select event_id, (epoch_us(ts) - lag(epoch_us(ts)) over (order by event_id))::bigint as gap from events")
def idle_gaps(spark, sf):
    return events(spark, sf).gaps("ts").map(gap=F.col("gap")).df


@query(f"""
with e as (select user_id, event_id, epoch_us(ts) as t, lead(epoch_us(ts)) over (partition by user_id order by event_id) as next from events)
select user_id, event_id, unnest(range(t, greatest(t, coalesce(next - 1, t)) + 1, {DAY})) as "at" from e""")
def expand_daily_per_user(spark, sf):
    return events(spark, sf, ("user_id",)).map(ts=F.col("ts")).expand(DAY, "ts").df.select("user_id", "event_id", "at")


@query(f"select epoch_us(ts) // {HOUR} * {HOUR} as started, count(*) as n, sum({CENTS})::bigint as cents from events group by 1")
def conflate_hourly(spark, sf):
    return events(spark, sf).conflate_with_seed(HOUR, "ts", n=F.count("*"), cents=F.sum(cents("value"))).df


@query(f"select max(event_id) as event_id from events group by epoch_us(ts) // {HOUR}")
def sample_hourly(spark, sf):
    return events(spark, sf).sample(HOUR, "ts").map().df


@query(f"select event_id, cast(value < 300 as boolean) as ok, case when value < 300 then {CENTS} end as cents, case when not value < 300 then 'too large' end as error from events where event_id <= coalesce((select min(event_id) from events where not value < 300), 9223372036854775807)")
def recover_to_try(spark, sf):
    f = events(spark, sf).recover_to_try(cents("value"), F.col("value") < 300, F.lit("too large"))
    return f.df.select("event_id", "result.ok", F.col("result.value").alias("cents"), "result.error")


@query(f"""
with bad as (select min(event_id) as b from events where not value < 300)
select 0::bigint as src, event_id as k, {CENTS} as amount from events, bad where b is null or event_id < b
union all select 1, o_orderkey, {O_CENTS} from orders, bad where b is not null""")
def recover(spark, sf):
    """Events until one fails, then all orders."""
    second, a = _two(spark, sf)
    return a.recover(F.col("amount") < 30000, second).df.select(big("src").alias("src"), "k", "amount")


@query("with recursive f(pos, a, b) as (select 0::bigint, 0::bigint, 1::bigint union all select pos + 1, b, a + b from f where pos < 49) select pos, a as value from f")
def unfold_fibonacci(spark, sf):
    return values.unfold(spark, (0, 1, 0), lambda s: (s[0], (s[1], s[0] + s[1], s[2] + 1) if s[2] < 49 else None), "long").df


@query("select i as pos, 5 + 3 * i as value from range(1000) t(i)")
def longs_1000(spark, sf):
    return values.longs(spark, 5, 3, count=1000).df


@query("select pos, pos % 3 as group_id, event_id from " + POSITIONED)
def inject_round_robin_3(spark, sf):
    from millrace.positions import numbered

    f = events(spark, sf).map().inject_round_robin(3)
    whole = OrderedFrame.of(f.df, "event_id")
    return numbered(whole).select("pos", "group_id", "event_id")


@query("select event_id, pos // 100 as group_id from " + POSITIONED)
def inject_sequential_100(spark, sf):
    return events(spark, sf).map().inject_sequential(100).df.select("event_id", "group_id")


@query(f"""
with s as (select user_id, event_id, epoch_us(ts) as t, {CENTS} as c, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by event_id) as g from events)
select user_id, cast(dense_rank() over (partition by user_id order by g) - 1 as bigint) as group_id, min(t)::bigint as started, max(t)::bigint as ended, count(*) as n, sum(c)::bigint as cents from s group by user_id, g""")
def flagship(spark, sf):
    """Sub-streams of each user's events that begin with a signup, each reduced to a row."""
    f = events(spark, sf, ("user_id",)).map(event_type=F.col("event_type"), ts=F.col("ts"), cents=cents("value")).split_when(F.col("event_type") == "signup")
    t = micros("ts")
    return f.df.groupBy("user_id", "group_id").agg(F.min(t).alias("started"), F.max(t).alias("ended"), F.count("*").alias("n"), F.sum("cents").alias("cents"))
