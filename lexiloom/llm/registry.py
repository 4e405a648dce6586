"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiloom.llm import secret_scan, toxicity
from lexiloom.llm.chat_format import branches, format_preferences
from lexiloom.llm.common import new_folder, table
from lexiloom.llm.decontaminate import contaminated
from lexiloom.llm.embedding_join import near_vectors
from lexiloom.llm.exact_dedup import exact_duplicates
from lexiloom.llm.ranked_search import ranked
from lexiloom.llm.sentencepiece_dropout import Pieces, digest, encode_texts
from lexiloom.llm.simhash import near_duplicates
from lexiloom.llm.suffix_dedup import repeated_passages
from lexiloom.llm.token_counts import count_tokens
from lexiloom.llm.vocabulary import vocabulary_path
from lexiloom.llm.vector_codes import encode_vectors
from lexiloom.llm.warc import archive_round_trip


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_round_trip(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = format_preferences(branches(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["begin"].cast("string"), s["stop"].cast("string"))), ",")
    return found.withColumns({c: spans(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(vocabulary_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return count_tokens(table(spark, sf_dir, "documents"), f.read())


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("kept")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode_texts(table(spark, sf_dir, "documents"), Pieces(vocabulary_path("piece_bpe_32k.model"))))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).drop("offending")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.find_secrets(docs, secret_scan.train(docs))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_vectors(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {
        "op1_warc": op1_warc,
        "op2_simhash": op2_simhash,
        "op3_chat_format": op3_chat_format,
        "op4_token_counts": op4_token_counts,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_decontamination": op7_decontamination,
        "op8_toxicity": op8_toxicity,
        "op9_secrets": op9_secrets,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_embedding_dedup": op11_embedding_dedup,
        "op12_vector_codes": op12_vector_codes,
        "op13_ranked_search": op13_ranked_search,
    }


_EXACT = r"""
with n as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
)
select doc_id, min(doc_id) over (partition by norm) as keep_id,
       count(*) over (partition by norm) as group_size,
       doc_id = min(doc_id) over (partition by norm) as kept,
       sha256(norm) as text_sha256
from n
"""


_WARC = """
with p as (
  select page_id, coalesce(html, '') as html from pages
), q as (
  select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest from p
), r as (
  select *, min(page_id) over (partition by payload_digest) as first from q
)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from r
"""


_CHAT = """
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as raw,
         row_number() over (partition by conv_id order by turn, coalesce(role, ''), coalesce(text, '')) as k
  from conversations where conv_id is not null
), last as (
  select conv_id, max(k) as n, (conv_id * 7 + 3) % max(k) as part from t where role = 'assistant' group by 1
), pairs as (
  select t.conv_id, 'chosen' as side, k, role, raw from t join last using (conv_id) where k <= n
  union all
  select t.conv_id, 'rejected', k, role, raw from t join last using (conv_id) where k <= part
  union all
  select l.conv_id, 'rejected', k, role, raw
  from last l join last o on o.conv_id = xor(l.conv_id, 1) join t on t.conv_id = o.conv_id where k > l.part and k <= o.n
), differ as (
  select conv_id, min(k) as k
  from (select conv_id, k, count(*) = 2 and count(distinct role) = 1 and count(distinct raw) = 1 as same from pairs group by 1, 2) where not same group by 1
), r as (
  select b.*, coalesce(d.k, 1000000000) - 1 as shared, replace(role, '<|', '< |') as who, replace(raw, '<|', '< |') || '<|im_end|>' as said
  from pairs b left join differ d using (conv_id)
), w as (
  select *, '<|im_start|>' || who || chr(10) as head, k <= shared as common,
         coalesce(sum(length('<|im_start|>' || who || chr(10) || said || chr(10))) over (partition by conv_id, side, k <= shared order by k rows between unbounded preceding and 1 preceding), 0) as before
  from r
)
select conv_id, (count(*) filter (side = 'chosen' and common))::int as n_prompt_turns,
       coalesce(string_agg(head || said || chr(10), '' order by k) filter (side = 'chosen' and common), '') as prompt,
       coalesce(string_agg(head || said || chr(10), '' order by k) filter (side = 'chosen' and not common), '') as chosen,
       coalesce(string_agg(head || said || chr(10), '' order by k) filter (side = 'rejected' and not common), '') as rejected,
       coalesce(string_agg((before + length(head)) || '-' || (before + length(head) + length(said)), ',' order by k) filter (side = 'chosen' and not common and role = 'assistant'), '') as chosen_mask,
       coalesce(string_agg((before + length(head)) || '-' || (before + length(head) + length(said)), ',' order by k) filter (side = 'rejected' and not common and role = 'assistant'), '') as rejected_mask
from w group by 1
"""

_LEAKS = r"""
with d as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from documents
), b as (
  select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from benchmark
), m as (
  select distinct least(len(w), 5) as m from b where len(w) > 0
), ds as (
  select distinct doc_id, array_to_string(w[i + 1:i + m], ' ') as s
  from (select doc_id, w, m, unnest(range(len(w) - m + 1)) as i from d, m where len(w) >= m)
), bs as (
  select distinct item_id, array_to_string(w[i + 1:i + 5], ' ') as s
  from (select item_id, w, unnest(range(greatest(len(w) - 4, 1))) as i from b where len(w) > 0)
), n as (
  select item_id, count(*) as n_item from bs group by 1
), met as (
  select doc_id, item_id, count(*) as n_shared from ds join bs using (s) group by 1, 2
)
select doc_id, item_id, n_shared, n_item, n_shared / n_item as containment
from met join n using (item_id) where n_shared >= 0.8 * n_item
"""


_NEAR_VECTORS = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
), ok as (
  select vec_id, e from v
  where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.9
), reach as (
  select distinct a, a as b from links
  union
  select r.a, l.b from reach r join links l on r.b = l.a
), c as (
  select a as vec_id, min(b) as component_id from reach group by 1
), n as (
  select a as vec_id, count(*) as n_links from links group by 1
)
select vec_id, coalesce(n_links, 0) as n_links, coalesce(component_id, vec_id) as component_id,
       coalesce(component_id, vec_id) = vec_id as kept
from v left join n using (vec_id) left join c using (vec_id)
"""


def _vector_codes(rounds: int = 6) -> str:
    """Parts of eight components; the least of far * 16 + k is the nearest entry, ties to the lower."""
    near = "select vec_id, p, min(far * 16 + k) as m from (select vec_id, p, k, sum((x - c) * (x - c)) as far from x join b{0} using (p, d) group by 1, 2, 3) group by 1, 2"
    books = ", ".join(
        f"a{r} as materialized ({near.format(r)}), b{r + 1} as materialized ("
        f"select p, k, d, coalesce(s, c) as c from b{r} left join "
        f"(select p, m % 16 as k, d, floor(sum(x) / count(*))::bigint as s from x join a{r} using (vec_id, p) group by 1, 2, 3) using (p, k, d))"
        for r in range(rounds)
    )
    return f"""
with v as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), x as materialized (
  select vec_id, p.range as p, d.range as d, e[p.range * 8 + d.range + 1] as x from v, range(8) p, range(8) d
), b0 as materialized (
  select p, k, d, x as c from x join (select vec_id, row_number() over (order by vec_id) - 1 as k from v) using (vec_id) where k < 16
), {books}, a as ({near.format(rounds)}), coded as (
  select vec_id, string_agg(printf('%02x', (m % 16)::int), '' order by p) as code, sum(m // 16)::bigint as error from a group by 1
)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
       (select sha256(string_agg(c::varchar, ',' order by p, k, d)) from b{rounds}) as codebooks_sha256
from coded join v using (vec_id)
"""


_RANKED = r"""
with d as materialized (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
), q as materialized (
  select item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as t
  from benchmark
), s as materialized (
  select count(*)::bigint as n_docs, sum(len(w))::bigint as length from d where len(w) > 0
), p as materialized (
  select r, t, count(*)::bigint as tf from (select r, unnest(w) as t from d) where t in (select t from q) group by 1, 2
), f as (
  select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from p, s group by t, n_docs
), scored as (
  select item_id, d.doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(w) * n_docs) // length))))::bigint as score
  from q join p using (t) join f using (t) join d using (r), s group by item_id, d.doc_id, r
)
select item_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": _WARC,
        "op3_chat_format": _CHAT,
        "op7_decontamination": _LEAKS,
        "op10_exact_dedup": _EXACT,
        "op11_embedding_dedup": _NEAR_VECTORS,
        "op12_vector_codes": _vector_codes(),
        "op13_ranked_search": _RANKED,
    }
