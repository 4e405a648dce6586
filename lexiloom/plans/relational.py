"""Filters, joins and set operations over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from lexiloom.functions import tokenize as T
from lexiloom.operators import relational as R
from lexiloom.operators.requests import answered
from lexiloom.plans.registry import query, table
from lexiloom.streaming.jobs import work_folder

_BLANK = R.BLANK


@query("select doc_id, n_chars from documents where n_chars between 100 and 3000")
def duration_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duration_range(table(spark, sf_dir, "documents"), "n_chars", 100, 3000).select("doc_id", "n_chars")


@query(rf"select doc_id, length(c) as n_clean, md5(c) as clean_md5 from (select doc_id, trim(regexp_replace(replace(text, '_', ' '), '{_BLANK}+', ' ', 'g'), ' ') as c from documents)")
def text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", R.clean_text(F.col("text")).alias("c"))
    return docs.select("doc_id", F.char_length("c").cast("long").alias("n_clean"), F.md5("c").alias("clean_md5"))


@query("select doc_id, quality, toxic, n_chars from labels join documents using (doc_id)")
def supervision_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = R.matched_and_rejected(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return kept.select("doc_id", "quality", "toxic", "n_chars")


@query("select doc_id, n_chars from documents anti join labels using (doc_id)")
def supervision_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = R.matched_and_rejected(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels"), "doc_id")
    return rejected


@query("select doc_id, n_chars, 2000 as recording, n_chars > 2000 as quarantined from documents")
def length_check_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.lit(2000).alias("recording"))
    return R.flag_too_long(docs, "n_chars", "recording")


@query("select l_orderkey, l_linenumber, case when l_returnflag <> 'N' then l_quantity - l_linenumber else l_extendedprice end as duration from lineitem")
def open_end_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    end = F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))
    return rows.select("l_orderkey", "l_linenumber", R.segment_duration(F.col("l_linenumber"), end, F.col("l_extendedprice")).alias("duration"))


@query(
    """
    with c as (select doc_id, unnest(string_split(text, '')) as token from documents where length(text) > 0),
    v as (select token, row_number() over (order by count(*) desc, token) - 1 as id from c group by token having count(*) >= 50),
    n as (select doc_id, count(*) as n_tokens, count(id) as n_ids, coalesce(sum(id), 0)::bigint as id_sum from c left join v using (token) group by 1)
    select doc_id, coalesce(n_tokens, 0) as n_tokens, coalesce(n_ids, 0) as n_ids, coalesce(id_sum, 0) as id_sum from documents left join n using (doc_id)
    """
)
def vocab_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters as tokens, counted inside each row first; the inventory holds those that occur at least 50 times, so its size is bounded by Unicode."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = R.spread(docs).select("doc_id", F.explode(T.character_counts(F.col("text"))).alias("t")).select("doc_id", "t.token", "t.n")
    kept = counts.groupBy("token").agg(F.sum("n").alias("n")).where("n >= 50")
    vocab = kept.select("token", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) - 1).cast("long").alias("id"))
    met = counts.join(F.broadcast(vocab), "token", "left").groupBy("doc_id").agg(
        F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("id").isNotNull(), F.col("n"))).alias("n_ids"), F.sum(F.col("n") * F.col("id")).alias("id_sum")
    )
    return docs.select("doc_id").join(met, "doc_id", "left").fillna(0, ["n_tokens", "n_ids", "id_sum"])


@query(
    """
    select doc_id, lang, w::double as weight, round(-ln((('0x' || substr(md5(doc_id::varchar), 1, 8))::ubigint + 1) / 4294967297.0) / w, 6) as mix_key
    from documents join (values ('en', 0.4), ('de', 0.3), ('fr', 0.2), ('es', 0.1)) as v(lang, w) using (lang)
    """
)
def mux_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    parts = [(docs.where(F.col("lang") == k).withColumn("weight", F.lit(w)), w) for k, w in (("en", 0.4), ("de", 0.3), ("fr", 0.2), ("es", 0.1))]
    return R.weighted_mix(parts, "doc_id").withColumn("mix_key", F.round("mix_key", 6))


@query("select doc_id, copy from labels, (values (0), (1)) as c(copy)")
def repeat_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.repeat(table(spark, sf_dir, "labels").select("doc_id"), 2)


@query("select source as key, arg_min(doc_id, doc_id) as value from documents group by 1")
def first_wins_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("value"))
    none = docs.limit(0)
    return R.insert_if_absent(none, docs, "key", "value")


@query("select source as key, arg_max(lang, doc_id) as value from documents group by 1")
def last_wins_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.last_wins(table(spark, sf_dir, "documents"), F.col("source"), F.col("lang"), F.col("doc_id"))


@query("select o_orderkey, o_custkey, c_name, case when c_custkey is null then 'error' when o_orderstatus = 'F' then 'done' else 'queued' end as status from orders left join customer on o_custkey = c_custkey and c_mktsegment <> 'MACHINERY'")
def job_voice_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    voices = table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").select("c_custkey", "c_name")
    jobs = table(spark, sf_dir, "orders")
    joined = jobs.join(voices, jobs.o_custkey == voices.c_custkey, "left")
    status = F.when(F.col("c_custkey").isNull(), "error").when(F.col("o_orderstatus") == "F", "done").otherwise("queued")
    return joined.select("o_orderkey", "o_custkey", "c_name", status.alias("status"))


@query("select a.vec_id // 2 as place, a.label as prompt_label, b.label as eval_label from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 2).alias("place"))
    side = lambda k, name: vecs.where(F.col("vec_id") % 2 == k).select("place", F.col("label").alias(name))
    return R.positional_zip(side(0, "prompt_label"), side(1, "eval_label"), "place")


@query("select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_quantity >= 45)")
def skip_if_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(done, "p_partkey", "left_anti")


@query("select event_id, case when json_exists(props, '$.k') then props ->> '$.k' else 'none' end as k, case when json_exists(props, '$.region') then props ->> '$.region' else 'North' end as region from events")
def metadata_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", R.json_or_default(F.col("props"), "k", "none").alias("k"), R.json_or_default(F.col("props"), "region", "North").alias("region"))


@query("select event_id, round(case when value <= 5 then 1.0 when value <= 50 then 1 + (value - 5) * (-0.5 / 45) when value <= 200 then 0.5 + (value - 50) * (-0.4 / 150) else 0.1 end, 6) as y from events")
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = [(5.0, 1.0), (50.0, 0.5), (200.0, 0.1)]
    return table(spark, sf_dir, "events").select("event_id", F.round(R.interpolate(F.col("value"), points), 6).alias("y"))


@query("select distinct lang as tag from documents union select distinct role from conversations")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("tag")).union(table(spark, sf_dir, "conversations").select("role")).distinct()


@query("select event_id, md5(event_id::varchar || ':7:2') as shuffle_key from events")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", R.seeded_order(F.col("event_id"), 7, 2).alias("shuffle_key"))


@query("select distinct source, lang from documents")
def distinct_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source", "lang").distinct()


@query(
    """
    select coalesce(a.label, b.label) as label, d - 1 as dim, round(avg_a * 0.75 + avg_b * 0.25, 6) as value
    from (select label, d, avg(embedding[d]::double) as avg_a from embeddings, range(1, 65) t(d) where vec_id % 2 = 0 group by 1, 2) a
    join (select label, d, avg(embedding[d]::double) as avg_b from embeddings, range(1, 65) t(d) where vec_id % 2 = 1 group by 1, 2) b using (label, d)
    """
)
def parameter_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of named parameters (even and odd vectors), averaged by name with weights 0.75 and 0.25."""
    cells = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    side = lambda k, name: cells.where(F.col("vec_id") % 2 == k).groupBy("label", "dim").agg(F.avg("x").alias(name))
    both = side(0, "a").join(side(1, "b"), ["label", "dim"])
    return both.select("label", F.col("dim").cast("long").alias("dim"), F.round(F.col("a") * 0.75 + F.col("b") * 0.25, 6).alias("value"))


_UNSPOKEN = f"[{R.BLANK[1:-1]}{R.UNSPOKEN}]".replace("'", "''")


@query(f"with s as (select doc_id, regexp_split_to_array(text, '[a-z]+') as s from documents) select doc_id, len(s) as n_segments, len(list_filter(s, lambda x: regexp_replace(x, '{_UNSPOKEN}', '', 'g') <> '')) as n_kept from s")
def speakable_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands between runs of small letters as segments: most hold blanks and marks only."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "[a-z]+").alias("s"))
    return parts.select("doc_id", F.size("s").cast("long").alias("n_segments"), F.size(F.filter("s", R.speakable_segment)).cast("long").alias("n_kept"))


@query(
    "with w as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as k from (select doc_id, string_split(text, ' ') as w from documents)) "
    "select doc_id, (k // 30)::int as batch, count(*) as n_words, md5(string_agg(word, ' ' order by k)) as words_md5 from w group by 1, 2"
)
def batches_of_thirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(R.fixed_batches(F.split("text", " "))).alias("batch", "w"))
    return batches.select("doc_id", "batch", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5"))


_TOKENS = (
    "w as (select doc_id, unnest(string_split_regex(trim(regexp_replace(text, '[^a-z]+', ' ', 'g')), ' ')) as token, generate_subscripts(string_split_regex(trim(regexp_replace(text, '[^a-z]+', ' ', 'g')), ' '), 1) as pos from documents), "
    "v as (select token, row_number() over (order by count(*) desc, token) - 1 as id from w where token <> '' group by 1 having count(*) >= 20)"
)


@query(f"with {_TOKENS}, i as (select doc_id, count(*) as n, md5(string_agg(id::varchar, ',' order by pos)) as h from w join v using (token) group by 1) select doc_id, coalesce(n, 0) as n_ids, coalesce(h, md5('')) as ids_md5 from documents left join i using (doc_id)")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words as ids in their order; the inventory holds words that occur at least 20 times."""
    bare = F.trim(F.regexp_replace("text", "[^a-z]+", " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split(bare, " ").alias("tokens"))
    counts = docs.select(F.explode("tokens").alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n")).where("n >= 20")
    vocab = counts.select("token", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) - 1).cast("int").alias("id"))
    made = R.lookup_ids(docs, "tokens", vocab)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


def shouting(prompt: str) -> str:
    """A stand-in for a model: each token in upper case; nothing for those of five letters, far too much for those of seven."""
    said = lambda t: "" if len(t) == 5 else t * 11 if len(t) == 7 else t.upper()
    return "\n".join(f"[{k}] {said(line.split('] ', 1)[1])}" for k, line in enumerate(prompt.split("\n")))


@query(
    """
    with w as (select doc_id, unnest(regexp_extract_all(substr(text, 1, length(text)), '[a-z]+')) as token from documents),
    n as (select doc_id, token, count(*) as n from w group by 1, 2)
    select doc_id, token, n, case when length(token) in (5, 7) then token else upper(token) end as said from n
    """
)
def request_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, asked for once each, in two batches that share a cache.

    Words are counted inside each row; only if ids repeat must counts of several rows be added up.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    repeats = docs.select("doc_id").distinct().count() < docs.count()
    folder, halves = work_folder(spark, "answers"), []
    for k in (0, 1):
        half = docs.where(F.coalesce(F.pmod("doc_id", F.lit(2)), F.lit(0)) == k)
        each = half.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("token"))
        words = half.select("doc_id", F.explode(T.word_counts(F.col("text"), "[a-z]+")).alias("t")).select("doc_id", "t.token", "t.n")
        words = words.groupBy("doc_id", "token").agg(F.sum("n").alias("n")) if repeats else words
        halves.append(answered(words, folder, k, shouting, tokens=each, batch=200))
    return halves[0].unionByName(halves[1]).select("doc_id", "token", "n", "said")
