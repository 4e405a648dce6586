"""Order-dependent operators over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from lexiloom.operators.aggregates import quantiles
from lexiloom.operators import intervals as I, sequences as S
from lexiloom.plans.registry import query, table


@query("select conv_id, turn, (sum((role = 'user')::int) over (partition by conv_id order by turn) % 2)::bigint as parity from conversations")
def speaker_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return S.turn_parity(turns, "conv_id", "turn", F.col("role") == "user").drop("role")


_RUNS = S.runs_pattern("À-ɏ", "A-Za-z").replace("'", "''")


@query(f"select conv_id, turn, len(r) as n_runs, md5(array_to_string(r, '|')) as runs_md5 from (select conv_id, turn, regexp_extract_all(replace(text, chr(10), ''), '{_RUNS}') as r from conversations)")
def lang_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no Chinese; accented letters stand in for the first language."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", S.language_runs(F.col("text"), "À-ɏ", "A-Za-z").alias("r"))
    return turns.select("conv_id", "turn", F.size("r").cast("long").alias("n_runs"), F.md5(F.array_join("r", "|")).alias("runs_md5"))


@query(
    """
    with w as (select conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from conversations),
    a as (select conv_id, turn, w, list_filter(w, lambda x, i: not (i > 1 and x = 'the' and w[i - 1] = 'the')) as v from w),
    b as (select conv_id, turn, w, list_filter(v, lambda x, i: not (i > 1 and x = 'of' and v[i - 1] = 'the')) as v from a)
    select conv_id, turn, len(w) - len(v) as n_dropped, md5(array_to_string(v, ' ')) as kept_md5 from b
    """
)
def adjacent_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.words(F.col("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", w.alias("w"))
    turns = turns.withColumn("v", S.drop_second(F.col("w"), "the", "the")).withColumn("v", S.drop_second(F.col("v"), "the", "of"))
    return turns.select("conv_id", "turn", (F.size("w") - F.size("v")).cast("long").alias("n_dropped"), F.md5(F.array_join("v", " ")).alias("kept_md5"))


@query(
    """
    with s as (select user_id, epoch_us(ts) as a, epoch_us(ts) + 3600000000 as b from events),
    m as (select *, max(b) over (partition by user_id order by a, b desc rows between unbounded preceding and 1 preceding) as reach from s),
    g as (select *, sum((reach is null or a > reach)::int) over (partition by user_id order by a, b desc rows unbounded preceding) as island from m)
    select user_id, min(a) as a, max(b) as b, count(*) as n from g group by user_id, island
    """
)
def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("a"))
    return S.merge_spans(spans.withColumn("b", F.col("a") + 3_600_000_000), "user_id", "a", "b")


@query("select user_id, round(sum(value * pow(0.995, n - k)), 5) as total from (select *, row_number() over (partition by user_id order by ts, event_id) as k, count(*) over (partition by user_id) as n from events) group by 1")
def decayed_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.numbered(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id")
    return rows.groupBy("user_id").agg(F.round(S.decayed_total(F.col("value"), F.col("k"), F.col("n"), 0.995), 5).alias("total"))


@query("select user_id, round(sum(value * pow(0.9, n - k) * case when k = 1 then 1 else 0.1 end), 5) as ema from (select *, row_number() over (partition by user_id order by ts, event_id) as k, count(*) over (partition by user_id) as n from events) group by 1")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.numbered(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id")
    return rows.groupBy("user_id").agg(F.round(S.moving_average(F.col("value"), F.col("k"), F.col("n"), 0.9), 5).alias("ema"))


@query("select user_id, round(avg(value) filter (k > n // 2), 5) as mean from (select *, row_number() over (partition by user_id order by ts, event_id) as k, count(*) over (partition by user_id) as n from events) group by 1")
def range_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each user's later half from two means that begin at the first event."""
    rows = S.numbered(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id")
    half = F.floor(F.col("n") / 2)
    means = rows.groupBy("user_id").agg(F.coalesce(F.avg(F.when(F.col("k") <= half, F.col("value"))), F.lit(0.0)).alias("a"), F.avg("value").alias("b"), F.max(half).alias("s"), F.max("n").alias("e"))
    return means.select("user_id", F.round(S.range_average(F.col("a"), F.col("b"), F.col("s"), F.col("e")), 5).alias("mean"))


@query("select event_id, l[len(l) // 2 + 1] as threshold from (select event_id, list_sort(list(value) over (partition by user_id order by ts, event_id rows between 15 preceding and current row)) as l from events)")
def rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.rolling_rank("value", "user_id", ["ts", "event_id"], 16).alias("threshold"))


@query(
    """
    with recursive s as (
      select conv_id, turn, regexp_extract_all(text, '[^.!?]*[.!?]+\\s*|[^.!?]+$') as p from conversations
    ), z as (
      select conv_id, turn, list_transform(p, lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> ''))) as n from s where len(p) > 0
    ), f as (
      select conv_id, turn, n, 1 as k, 0 as g, n[1] as filled from z
      union all
      select conv_id, turn, n, k + 1, case when filled + n[k + 1] > 20 then g + 1 else g end, case when filled + n[k + 1] > 20 then n[k + 1] else filled + n[k + 1] end from f where k < len(n)
    )
    select conv_id, turn, g as chunk, count(*) as n_sentences, sum(n[k])::bigint as n_words from f group by conv_id, turn, g
    """
)
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", S.sentences(F.col("text")).alias("p")).where(F.size("p") > 0)
    sized = turns.withColumn("n", F.transform("p", lambda x: F.size(S.words(x))))
    each = sized.select("conv_id", "turn", F.explode(F.arrays_zip(S.next_fit(F.col("n"), 20).alias("chunk"), F.col("n").alias("n"))).alias("s"))
    return each.groupBy("conv_id", "turn", F.col("s.chunk").alias("chunk")).agg(F.count("*").alias("n_sentences"), F.sum("s.n").alias("n_words"))


@query("select conv_id, g as part, count(*) as n_turns, sum(length(text))::bigint as n_chars from (select *, (sum((role = 'user')::int) over (partition by conv_id order by turn))::bigint as g from conversations) group by 1, 2")
def dialog_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.sum((F.col("role") == "user").cast("int")).over(over).alias("part"), F.char_length("text").alias("c"))
    return turns.groupBy("conv_id", "part").agg(F.count("*").alias("n_turns"), F.sum("c").alias("n_chars"))


@query(
    """
    with recursive s as (
      select doc_id // 128 as shard, list(n_chars order by n_chars, doc_id) as n, list(doc_id order by n_chars, doc_id) as d from documents group by 1
    ), f as (
      select shard, n, d, 1 as k, 0 as batch, n[1] as filled from s
      union all
      select shard, n, d, k + 1, case when filled + n[k + 1] > 20000 then batch + 1 else batch end, case when filled + n[k + 1] > 20000 then n[k + 1] else filled + n[k + 1] end from f where k < len(n)
    )
    select d[k] as doc_id, shard, batch, k - 1 as place from f
    """
)
def next_fit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length-sorted batches of at most 20,000 characters inside shards of 128 documents; ``place`` restores the order."""
    shards = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 128).alias("shard")).agg(F.array_sort(F.collect_list(F.struct("n_chars", "doc_id"))).alias("d"))
    zipped = F.arrays_zip(F.transform("d", lambda s: s["doc_id"]).alias("doc_id"), S.next_fit(F.transform("d", lambda s: s["n_chars"]), 20000).alias("batch"))
    return shards.select("shard", F.posexplode(zipped).alias("place", "s")).select("s.doc_id", "shard", "s.batch", "place")


@query(
    """
    with recursive s as (
      select doc_id // 128 as shard, list(n_chars order by n_chars, doc_id) as n, list(doc_id order by n_chars, doc_id) as d from documents group by 1
    ), f as (
      select shard, n, d, 1 as k, 0 as batch, n[1] as filled, 1 as rows_in from s
      union all
      select shard, n, d, k + 1, case when full_ then batch + 1 else batch end, case when full_ then n[k + 1] else filled + n[k + 1] end, case when full_ then 1 else rows_in + 1 end
      from (select *, filled * 0.25 + rows_in * 50.0 + n[k + 1] * 0.25 > 4000 as full_ from f where k < len(n))
    )
    select d[k] as doc_id, shard, batch, k - 1 as place from f
    """
)
def prompt_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``next_fit_batches``, where each row of a batch also costs its prompt."""
    shards = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 128).alias("shard")).agg(F.array_sort(F.collect_list(F.struct("n_chars", "doc_id"))).alias("d"))
    zipped = F.arrays_zip(F.transform("d", lambda s: s["doc_id"]).alias("doc_id"), S.batchify(F.transform("d", lambda s: s["n_chars"]), 4000.0, 0.25, 50.0).alias("batch"))
    return shards.select("shard", F.posexplode(zipped).alias("place", "s")).select("s.doc_id", "shard", "s.batch", "place")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows unbounded preceding) / sum(l_quantity) over (partition by l_orderkey), 6) as done from lineitem")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("l_orderkey")
    running = F.sum("l_quantity").over(by.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(running / F.sum("l_quantity").over(by), 6).alias("done"))


@query()
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 500 characters, by paragraph, sentence and word; a blank chunk stays open. A plain twin is in the tests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", S.chunk_pieces(F.col("text"), 500).alias("p"))
    sized = docs.withColumns({"n": F.transform("p", F.char_length), "blank": F.transform("p", lambda p: ~p.rlike(r"(?U)\S"))})
    each = sized.select("doc_id", F.posexplode(F.arrays_zip(F.col("p").alias("p"), S.next_fit(F.col("n"), 500, F.col("blank")).alias("chunk"))).alias("pos", "s"))
    joined = each.groupBy("doc_id", F.col("s.chunk").alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s.p"))), lambda x: x["p"]), "").alias("text"))
    # only a text that fits whole may be blank
    whole = (F.col("chunk") == 0) & (F.char_length("text") <= 500)
    return joined.where(whole | F.col("text").rlike(r"(?U)\S")).select("doc_id", "chunk", F.char_length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("select user_id, event_id, rank from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from events) where rank <= 3")
def topk_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf_dir, "events").select("user_id", "event_id", rank.cast("long").alias("rank")).where("rank <= 3")


@query("select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 10")
def top10_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return rows.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(10)


@query("select p_brand, p_partkey, row_number() over (partition by p_brand order by length(p_name) desc, p_partkey) as rank from part")
def longest_key_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc(F.char_length("p_name")), "p_partkey"))
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", rank.cast("long").alias("rank"))


@query("select conv_id, batch, n from (select conv_id, (row_number() over (partition by conv_id order by turn) - 1) // 2 as batch, count(*) over (partition by conv_id) as m from conversations) join (select 1) on true, lateral (select 2 as n) where (batch + 1) * 2 <= m group by all")
def drop_last_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of two turns; the last one of a conversation goes where it is not full."""
    rows = S.numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")
    batch = F.floor((F.col("k") - 1) / 2)
    return rows.groupBy("conv_id", batch.alias("batch")).agg(F.count("*").cast("int").alias("n")).where("n = 2")


@query("with q as (select quantile_cont(n_chars, [0.2, 0.4, 0.6, 0.8]) as b from documents) select doc_id, n_chars, len(list_filter(b, lambda x: x < n_chars))::int as bucket from documents, q")
def duration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    bounds = quantiles(docs, "n_chars", [k / 5 for k in range(1, 5)])
    return docs.select("doc_id", "n_chars", S.buckets(F.col("n_chars"), bounds).alias("bucket"))


@query("select a.vec_id, round(list_sum(list_transform(range(1, 65), lambda d: 3 * a.embedding[d]::double - 2 * b.embedding[d]::double)), 5) as total from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0")
def guidance_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditioned and unconditioned outputs of a doubled batch, (1 + g) * c - g * u with g = 2."""
    vecs = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - F.col("vec_id") % 2).alias("vec_id"), (F.col("vec_id") % 2).alias("half"), F.col("embedding").cast("array<double>").alias("x"))
    both = vecs.groupBy("vec_id").agg(F.max_by("x", F.col("half") == 0).alias("c"), F.max_by("x", F.col("half") == 1).alias("u"), F.count("*").alias("n")).where("n = 2")
    mixed = F.zip_with("c", "u", lambda c, u: 3 * c - 2 * u)
    return both.select("vec_id", F.round(F.aggregate(mixed, F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query(
    """
    with p as (select a.vec_id, list_transform(a.embedding, lambda x: x::double) as x, list_transform(b.embedding, lambda x: x::double) as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0)
    select vec_id, 120 as n, round(list_sum(list_transform(range(1, 9), lambda i: i * (x[56 + i] * (1 - (i - 1) / 7.0) + y[i] * ((i - 1) / 7.0)))), 5) as weighted from p
    """
)
def cross_fade(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    even, odd = vecs.where("vec_id % 2 = 0"), vecs.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    faded = even.join(odd, "vec_id").select("vec_id", S.cross_fade(F.col("x"), F.col("y"), 8).alias("f"))
    middle = F.transform(F.slice("f", F.lit(57), F.lit(8)), lambda v, i: v * (i + 1))
    return faded.select("vec_id", F.size("f").alias("n"), F.round(F.aggregate(middle, F.lit(0.0), lambda a, v: a + v), 5).alias("weighted"))


@query(
    """
    with e as (select user_id as audio, event_id % 5 as speaker, floor(epoch(ts))::bigint - 1704067200 as start, value from events where user_id % 7 <> 3 or event_id % 5 <> 1),
    t as (select audio, speaker, start, start + value * 30 as stop from e where speaker in (0, 1)),
    c as (select audio, k.range as chunk, k.range * 100000 as o, 100000 - 5000 * (k.range % 2) as n from (select distinct user_id as audio from events), range(27) k),
    b as (select audio from t group by 1 having count(distinct speaker) = 2),
    s as (select audio, speaker, start as a, floor(stop)::bigint as z from t join b using (audio)),
    m as (
      select s.audio, s.speaker, a, z, chunk, o, greatest(a, o) as lo, least(z, o + n) as hi from s join c on s.audio = c.audio and a < o + n and o < z
      union all select audio, speaker, 0, o + n, chunk, o, o, o + n from c anti join b using (audio), (values (0), (1)) v(speaker)
    )
    select audio, speaker::int as speaker, row_number() over (partition by audio, speaker order by a, z, lo, chunk)::int as place, chunk, lo - o as first, hi - o as last from m where lo < hi
    """
)
def diarization_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events are turns of an audio of a month, one sample a second, that is stored in chunks with gaps."""
    events = table(spark, sf_dir, "events").where("user_id % 7 <> 3 or event_id % 5 <> 1")
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) - 1_704_067_200
    turns = events.select(F.col("user_id").alias("audio"), (F.col("event_id") % 5).alias("speaker"), start.alias("start"), (start + F.col("value") * 30).alias("end"))
    audios = table(spark, sf_dir, "events").select(F.col("user_id").alias("audio")).distinct()
    k = F.col("chunk")
    chunks = audios.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(26).cast("long")))).select("audio", "chunk", (k * 100_000).alias("offset"), (100_000 - 5000 * (k % 2)).alias("samples"))
    return I.speaker_slices(turns, chunks, width=50_000)
