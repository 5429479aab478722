"""One registered query per operator, over its whole table, and the SQL that must give the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Lower-case A-Z only, as SQL.
SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op7_exact_dedup", f"""
    with h as (select doc_id, sha256({SQL_LOWER}) as text_sha256 from documents),
    g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from h group by 1)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from h join g using (text_sha256)""")
def op7_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from . import exact_dedup

    return exact_dedup.dedup(table(spark, sf, "documents")).drop("copy")


@query("op5_source_mix")
def op5_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    from . import mixing

    return mixing.mix(table(spark, sf, "documents"))


@query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    from . import fingerprints

    return fingerprints.compare_neighbours(table(spark, sf, "documents"))


@query("op6_pii")
def op6_pii(spark: SparkSession, sf: str) -> DataFrame:
    from . import pii

    return pii.report(table(spark, sf, "documents"))


@query("op1_chat_rotation", r"""
    with t as (
      select conv_id, turn, case when trim(coalesce(role, '')) = '' then 'unknown' else trim(role) end as speaker,
             coalesce(text, '') as text from conversations),
    p as (select distinct conv_id, speaker as perspective from t where speaker <> 'system'),
    m as (
      select t.*, p.perspective,
        case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user' end as role,
        '<|im_start|>' || case when speaker = 'system' then 'system' when speaker = perspective then 'assistant'
          else 'user name=' || replace(replace(speaker, '<|', '< |'), '|>', '| >') end || chr(10) as head,
        replace(replace(text, '<|', '< |'), '|>', '| >') || '<|im_end|>' || chr(10) as tail
      from t join p on t.conv_id is not distinct from p.conv_id),
    r as (
      select *, head || tail as message,
        cast(coalesce(sum(length(head || tail)) over (partition by conv_id, perspective order by turn, speaker, text
             rows between unbounded preceding and 1 preceding), 0) as bigint) as start from m)
    select conv_id, perspective, turn, speaker, role, message, start,
      start + case when speaker = perspective then length(head) else length(message) end as train_start,
      start + length(message) as train_end from r""")
def op1_chat_rotation(spark: SparkSession, sf: str) -> DataFrame:
    from . import chat

    return chat.rotate(table(spark, sf, "conversations"))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    from . import language

    return language.identify(table(spark, sf, "documents"))


@query("op4_quality")
def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    from . import quality

    return quality.rate(table(spark, sf, "documents"), table(spark, sf, "labels"))


#: The model file of op3; the path is a parameter.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def piece_model() -> bytes:
    """Read on the driver; executors get the bytes."""
    with open(PIECE_MODEL, "rb") as f:
        return f.read()


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    from . import pieces

    return pieces.tokenise(table(spark, sf, "documents"), piece_model())


@query("op8_near_join", rf"""
    with recursive w as (
      select doc_id, list_filter(regexp_split_to_array({SQL_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
      from documents),
    s as (
      select doc_id, list_distinct(case when len(ws) = 0 then []
        when len(ws) < 3 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as sh
      from w),
    e as (select doc_id, len(sh) as n, unnest(sh) as g from s),
    p as (
      select a.doc_id as x, b.doc_id as y, any_value(a.n) as nx, any_value(b.n) as ny, count(*) as common
      from e a join e b on a.g = b.g and a.doc_id <> b.doc_id and 100 * a.n >= 90 * b.n and 100 * b.n >= 90 * a.n
      group by 1, 2),
    l as (select x, y from p where 100 * common >= 90 * (nx + ny - common)),
    r as (select doc_id as x, doc_id as y from s union select r.x, l.y from r join l on r.y = l.x)
    select s.doc_id, cast(len(sh) as bigint) as n_shingles, min(r.y) as component_id
    from s join r on r.x = s.doc_id group by 1, 2""")
def op8_near_join(spark: SparkSession, sf: str) -> DataFrame:
    from . import near_join

    return near_join.link(table(spark, sf, "documents"), words=3, percent=90)


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    from . import licenses

    return licenses.scan(table(spark, sf, "documents"))


@query("op12_substring_dedup", r"""
    with w as (
      select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
      from documents),
    s as (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w),
    g as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as window13 from s),
    o as (select window13, min(doc_id) as owner from g group by 1),
    x as (select distinct doc_id, i + unnest(range(0, 13)) as place from g join o using (window13) where owner < doc_id),
    p as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as place from w),
    k as (select doc_id, string_agg(word, ' ' order by place) as kept, count(*) as n_kept
          from p anti join x using (doc_id, place) group by 1)
    select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n_kept, 0) as bigint) as n_removed,
      sha256(coalesce(kept, '')) as kept_sha256
    from w left join k using (doc_id)""")
def op12_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import substrings

    return substrings.cleaned(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op11_phrases", rf"""
    with p as (
      select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({SQL_LOWER}, '[.,;:!?\x0A-\x0D]')) as piece
      from documents),
    w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
    n as (select lang, cast(sum(len(ws)) as bigint) as n from w group by 1),
    g as (select lang, 1 as k, unnest(ws) as phrase from w
      union all select lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) from w
      union all select lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) from w
      union all select lang, 4, unnest(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) from w),
    f as (select lang, k, phrase, count(*) as f from g group by all having count(*) >= 30),
    c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from f where k > 1),
    j as (select lang, k, phrase, a, ws, unnest(range(1, k)) as j from c),
    h as (select lang, phrase, a, j, array_to_string(ws[1:j], ' ') as head, array_to_string(ws[j + 1:], ' ') as tail from j),
    cut as (
      select h.lang, h.phrase, h.a, j, x.f as l, y.f as r, (2000000::hugeint * h.a) // (x.f + y.f) as score
      from h join f x on x.lang = h.lang and x.phrase = h.head join f y on y.lang = h.lang and y.phrase = h.tail),
    best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, j) = 1),
    z as (select lang, a, ws, k, unnest(range(2, k)) as size from c),
    s as (select lang, a, ws, size, unnest(range(1, k - size + 2)) as i from z),
    m as (select lang, array_to_string(ws[i:i + size - 1], ' ') as phrase, max(a) as longest from s group by 1, 2),
    kept as (select best.* from best left join m using (lang, phrase) where longest is null or 100 * longest < 80 * a)
    select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n,
      cast(score as bigint) as score
    from kept join n using (lang) qualify rank <= 2000""")
def op11_phrases(spark: SparkSession, sf: str) -> DataFrame:
    from . import phrases

    return phrases.mine(table(spark, sf, "documents"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    from . import whitening

    return whitening.whiten(table(spark, sf, "embeddings"))
