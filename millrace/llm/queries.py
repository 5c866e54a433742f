"""The corpus operators' queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, codes, language, neardup, negatives, packing, quality, repeats, rules, sharding, superkmers, token_files, topk
from millrace.llm.shared import table

#: Bytes of a shard, and the shards of a smaller corpus.
SHARD_BYTES, LEAST_SHARDS = 64 << 20, 16


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def _remainder(of: int) -> Column:
    """crc32 of doc_id as text, modulo of."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


def learned_languages(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries of the rows of docs that aren't held out."""
    return language.learn(docs.where(_remainder(4) != 2))


def learned_quality(docs: DataFrame, labels: DataFrame) -> quality.Ranking:
    """The ranking by the labels that aren't held out."""
    return quality.learn(docs, labels.where(_remainder(3) != 1))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, learned_languages(docs)).withColumn("held_out", _remainder(4) == 2).select("doc_id", "held_out", "lang_pred", "score", "lang_margin", "rejected")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(docs, learned_quality(docs, labels)).withColumn("held_out", _remainder(3) == 1).select("doc_id", "held_out", "score", "predicted")


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return sharding.shard(docs, max(1, min(SHARD_BYTES, size // LEAST_SHARDS)))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encoding_digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = superkmers.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.codes(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_minhash, op3_language, op4_repeats, op5_topk, op6_quality, op7_token_files, op8_sharding, op9_bpe, op10_rules, op11_substrings, op12_negatives, op13_codes)}


#: All windows of 50 words, those found twice or more, and the spans that they cover; cut: those that all
#: occurrences but the first (by row and place) cover. For tables without repeated doc_ids whose rows are in
#: one block or in the order in which blocks are numbered, as a file's are.
REPEATS_SQL = r"""
with d as (select row_number() over () as rn, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from documents),
s as (select rn, doc_id, w, len(w) as n_words, unnest(range(0, len(w) - 49)) as start from d where len(w) >= 50),
h as (select rn, doc_id, n_words, start, md5(array_to_string(w[start + 1 : start + 50], ' ')) as h from s),
r as (select doc_id, n_words, start, row_number() over (partition by h order by rn, start) > 1 as later from h where h in (select h from h group by h having count(*) > 1)),
b as (select doc_id, n_words, start, false as cut from r union all select doc_id, n_words, start, true from r where later),
i as (select *, case when start > lag(start) over (partition by doc_id, cut order by start) + 50 then 1 else 0 end as starts from b),
g as (select *, sum(starts) over (partition by doc_id, cut order by start) as g from i)
select doc_id, n_words::bigint as n_words, min(start)::bigint as start, max(start)::bigint + 50 as "end", cut from g group by doc_id, n_words, cut, g"""

#: All windows of 13 words and the smallest doc_id of each. For tables without repeated doc_ids.
SUBSTRINGS_SQL = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
s as (select doc_id, w, unnest(range(0, len(w) - 12)) as start from d where len(w) >= 13),
h as (select doc_id, start, array_to_string(w[start + 1 : start + 13], ' ') as h from s),
f as (select h, min(doc_id) as first from h group by h),
r as (select doc_id, start from h join f using (h) where first < doc_id),
c as (select distinct doc_id, unnest(range(start, start + 13)) as place from r),
p as (select doc_id, unnest(w) as word, unnest(range(len(w))) as place from d),
k as (select doc_id, string_agg(word, ' ' order by place) as kept, count(*) as n from p anti join c using (doc_id, place) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)"""

#: Vectors of one length without duplicate ids, as in the test tables.
TOP_K_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10"""

#: Every prefix of every hash is summed; a row's shard is the shortest one that fits. For tables
#: in which no doc_id alone exceeds the limit, as in the test tables.
SHARDS_SQL = f"""
with d as (select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as n_bytes, coalesce(('0x' || substr(md5(doc_id::varchar), 1, 16))::ubigint, 0::ubigint) as h from documents),
m as (select greatest(1, least({SHARD_BYTES}, sum(n_bytes) // {LEAST_SHARDS})) as most from d),
p as (select *, unnest(range(1, 65)) as depth from d union all select *, 0 from d),
b as (select *, case when depth = 0 then 0::ubigint else h >> (64 - depth)::ubigint end as bucket from p),
s as (select *, sum(n_bytes) over (partition by depth, bucket) as shard_bytes from b),
r as (select *, row_number() over (partition by doc_id, n_bytes, depth order by h) as copy from s, m where shard_bytes <= most),
f as (select *, row_number() over (partition by doc_id, n_bytes, copy order by depth) as place from r)
select doc_id, n_bytes, lpad(printf('%x', bucket), 16, '0') || '/' || depth as shard, depth::integer as depth, shard_bytes::bigint as shard_bytes from f where place = 1"""


#: Vectors of one length without duplicate ids, as in the test tables.
NEGATIVES_SQL = """
with v as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.e, c.e)::bigint as score from v a join v c on c.vec_id <> a.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::integer as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 3"""


def _codes_sql(rounds: int = codes.ROUNDS) -> str:
    """All distances of all rounds; for vectors of one length without duplicate ids, as in the test tables."""
    steps = [
        """v as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        """p as materialized (select vec_id, label, part, e[part * (len(e) // 4) + 1 : (part + 1) * (len(e) // 4)] as x from v, range(4) r(part))""",
        """c0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as k, x as c from p qualify k < 256)""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} as materialized (select vec_id, part, any_value(label) as label, any_value(x) as x, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::bigint * 256 + k) as best from p join c{i} using (part) group by vec_id, part)""")
        if i < rounds:
            steps.append(f"""m{i} as (select part, best % 256 as k, j, floor(sum(x[j]) / count(*)) as m from a{i}, range(1, (select any_value(len(c)) from c0) + 1) s(j) group by all)""")
            steps.append(f"""c{i + 1} as materialized (select o.part, o.k, coalesce(n.c, o.c) as c from c{i} o left join (select part, k, list(m order by j) as c from m{i} group by part, k) n using (part, k))""")
    steps.append(f"""h as (select sha256(string_agg(m::bigint::varchar, ',' order by part, k, j)) as codebooks_sha256 from (select part, k, unnest(c) as m, unnest(range(len(c))) as j from c{rounds}))""")
    steps.append(f"""f as (select vec_id, any_value(label) as label, string_agg(printf('%02x', best % 256), '' order by part) as code, sum(best // 256)::bigint as error from a{rounds} group by vec_id)""")
    return "with " + ",\n".join(steps) + "\nselect vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from f, h"


def oracle_sql() -> dict[str, str]:
    """The other operators' results are beyond SQL; tests hold them against brute force."""
    return {"op4_repeats": REPEATS_SQL, "op5_topk": TOP_K_SQL, "op8_sharding": SHARDS_SQL, "op11_substrings": SUBSTRINGS_SQL, "op12_negatives": NEGATIVES_SQL, "op13_codes": _codes_sql()}
