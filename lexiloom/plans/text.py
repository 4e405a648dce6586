"""Text rewriting over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexiloom.functions import lexicon, normalizer, spell as N, text as X
from lexiloom.functions.special_tokens import special_tokens as tokens_of
from lexiloom.functions.tokenize import add_tokens
from lexiloom.operators import sequences as S, vietnamese
from lexiloom.operators.jobs import voice_gender, voice_region
from lexiloom.operators.relational import spread
from lexiloom.plans.registry import query, table


def _docs(spark: SparkSession, sf_dir: str, made: Column, kept: str = "out") -> DataFrame:
    """Length and digest of a rewriting, for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", made.alias(kept))
    return docs.select("doc_id", F.char_length(kept).cast("long").alias("n_out"), F.md5(kept).alias("out_md5"))


def _digest(made: DataFrame) -> DataFrame:
    return made.select("doc_id", F.char_length("out").cast("long").alias("n_out"), F.md5("out").alias("out_md5"))


def _sql(made: str) -> str:
    return f"select doc_id, length(o) as n_out, md5(o) as out_md5 from (select doc_id, {made} as o from documents)"




@query("select page_id, length(o) as n_out, md5(o) as out_md5 from (select page_id, regexp_replace(html, '<.*?>', '', 'g') as o from pages)")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("o"))
    return pages.select("page_id", F.char_length("o").cast("long").alias("n_out"), F.md5("o").alias("out_md5"))


@query(_sql(f"regexp_replace(text, '{X.EMOJI}', '', 'g')"))
def remove_emoji(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, X.remove_emoji(F.col("text")))


@query(_sql("regexp_replace(text, ':+', '. ', 'g')"))
def colon_to_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, X.colons_to_points(F.col("text")))


@query(_sql(r"regexp_replace(text, '(\d)\s?[-–—]\s?(\d)', '\1 đến \2', 'g')"))
def dash_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, X.dash_ranges(F.col("text")))


@query(_sql(r"trim(regexp_replace(lower(replace(replace(text, '‘', ''''), '’', '''')), '[^a-z0-9'']+', ' ', 'g'))"))
def clean_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, X.clean_for_letters(F.col("text")))


@query(_sql(r"lower(replace(regexp_replace(text, '[\x21-\x26\x28-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', '', 'g'), '  ', ' '))"))
def clean_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, X.clean_for_list(F.col("text")))


@query(_sql(r"lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '\[.*?\]|<.*?>|\(.*?\)', '', 'g'), '[\x21-\x26\x28-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', '', 'g'), '\s+', ' ', 'g')))"))
def clean_dialog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, X.clean_for_dialog(F.col("text")))


def _nested(made: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        made = f"replace({made}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    return made


@query(_sql(_nested("text", X.WIDE + [(d, "…") for d in X.DOTS])))
def map_punctuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, X.map_wide_marks(F.col("text")))


@query(_sql(r"regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '\.{2,}\s*', '. ', 'g')"))
def post_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, X.collapse(F.col("text")))


@query(_sql("case when trim(text, chr(9) || chr(10) || chr(13) || ' ') = '' or right(trim(text, chr(9) || chr(10) || chr(13) || ' '), 1) in (';', ':', ',', '.', '!', '?') then trim(text, chr(9) || chr(10) || chr(13) || ' ') else trim(text, chr(9) || chr(10) || chr(13) || ' ') || '.' end"))
def add_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, X.final_point(F.col("text")))


def _abbreviation_sql() -> str:
    made = "text"
    for short, long in X.ABBREVIATIONS:
        made = rf"regexp_replace({made}, '(?i)\b{short}\b', '{long}', 'g')"
    return _sql(made) + " where lang = 'en'"


@query(_abbreviation_sql().replace("from documents) where lang = 'en'", "from documents where lang = 'en')"))
def expand_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The abbreviations are English, and so are the documents."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", X.expand_abbreviations(F.col("text")).alias("o"))
    return docs.select("doc_id", F.char_length("o").cast("long").alias("n_out"), F.md5("o").alias("out_md5"))


@query(_sql(r"regexp_replace(regexp_replace(text, '([0-9]+)\.([0-9]+)', '\1 point \2', 'g'), '([0-9.,]*[0-9]+)%', '\1 percent ', 'g')"))
def spoken_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, X.spoken_percents(X.spoken_points(F.col("text"))))


@query("select conv_id, turn, case when right(rtrim(text, chr(9) || chr(10) || chr(13) || ' '), 1) in ('.', '!', '?') then 500 when right(rtrim(text, chr(9) || chr(10) || chr(13) || ' '), 1) in (',', ';', ':') then 300 else 150 end as gap from conversations")
def trailing_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.pause_after(F.regexp_replace("text", r"\s+$", "")).alias("gap"))


@query(
    """
    with d as (select conv_id, string_agg('[S' || (1 + turn % 2) || '] ' || text, ' ' order by turn) as t from conversations group by 1),
    p as (select conv_id, regexp_split_to_array(t, '\\[S[1-9]\\]') as p from d)
    select conv_id, md5(array_to_string(list_filter(p, lambda x, i: i % 2 = 0), '')) as a_md5, md5(array_to_string(list_filter(p, lambda x, i: i % 2 = 1), '')) as b_md5 from p
    """
)
def split_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = F.concat(F.lit("[S"), (1 + F.col("turn") % 2).cast("string"), F.lit("] "), "text")
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", tagged.alias("t")))), lambda s: s["t"]), " ").alias("t"))
    sides = talks.select("conv_id", X.split_dialogue(F.col("t")).alias("s"))
    return sides.select("conv_id", F.md5(F.col("s")[0]).alias("a_md5"), F.md5(F.col("s")[1]).alias("b_md5"))


@query("select s_suppkey, case when contains(lower(s_name), 'nu') or s_suppkey % 3 = 0 then 'female' when s_suppkey % 3 = 1 then 'male' end as gender, case s_suppkey % 4 when 0 then 'North' when 1 then 'Central' when 2 then 'South' end as region from supplier")
def voice_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gender and region by what a voice's id holds; ids are made of the supplier's number."""
    gender = F.element_at(F.array(F.lit("nu"), F.lit("nam"), F.lit("x")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    region = F.element_at(F.array(F.lit("bac"), F.lit("trung"), F.lit("nam"), F.lit("y")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", gender.alias("g"), region.alias("r"))
    return rows.select("s_suppkey", voice_gender(F.col("g")).alias("gender"), voice_region(F.col("r")).alias("region"))


@query()
def native_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps without callbacks; their patterns look around, which DuckDB's do not. A plain twin is in the tests."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _digest(docs.select("doc_id", X.native_normalize(F.col("text")).alias("out")))


#: Abbreviations of the query; users bring their own table.
ABBREVIATED = {"HTX": "hợp tác xã", "BS": "bác sĩ", "BXH": "bảng xếp hạng", "KT-XH": "kinh tế xã hội"}


@query()
def normalize_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps in their order: what is spoken is claimed span by span, then signs and blanks. A plain twin is in the tests."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _digest(normalizer.normalized(docs, "text", "out", ABBREVIATED).select("doc_id", "out"))


@query()
def spoken_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of rule speaks in each document, and over how many characters. A plain twin is in the tests."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = docs.select("doc_id", F.explode(normalizer.claim_spans(F.col("text"), normalizer.steps(ABBREVIATED))).alias("s"))
    return spans.groupBy("doc_id", F.col("s.kind").alias("kind")).agg(F.count("*").alias("n_claims"), F.sum(F.col("s.end") - F.col("s.start")).alias("n_chars"))


@query()
def normalize_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", N.speak(X.expand_abbreviations(F.col("text")), "en").alias("o"))
    return docs.select("doc_id", F.char_length("o").cast("long").alias("n_out"), F.md5("o").alias("out_md5"))


@query()
def sentence_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, X.sentence_case(X.punctuation_spacing(F.lower(F.col("text")))))


@query()
def double_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, X.double_marks(F.col("text")))


_RUN = f"{X.MARKED}(?:{X.PARTING}{X.MARKED})*"
_SEGMENTS = (
    "m as (select doc_id, regexp_replace(regexp_replace(text, ' ([a-z]{2,3})([ ,.])', ' 【\\1】\\2', 'g'), ' ([a-z]{2,3})([ ,.])', ' 【\\1】\\2', 'g') as t from documents), "
    f"p as (select doc_id, regexp_extract_all(t, '{_RUN}', 0) as runs, regexp_split_to_array(t, '{_RUN}') as plain from m), "
    "u as (select doc_id, unnest(plain) as plain, unnest(runs) as run, generate_subscripts(plain, 1) as k from p), "
    "e as (select doc_id, 2 * k as k, regexp_replace(regexp_replace(plain, '[【】]', '', 'g'), '^\\s+|\\s+$', '', 'g') as s, false as b from u union all "
    f"select doc_id, 2 * k + 1, array_to_string(regexp_extract_all(run, '{X.MARKED}', 1), ' ') || coalesce(regexp_extract(list_filter(regexp_split_to_array(run, '{X.MARKED}'), lambda x: regexp_matches(x, '{X.PARTING_MARKS}'))[-1], '{X.PARTING_MARKS}'), ''), true from u where run is not null), "
    "g as (select *, row_number() over w as place, lag(b) over w as before, lead(b) over w as after from e where s <> '' window w as (partition by doc_id order by k))"
)


@query(f"with {_SEGMENTS} select doc_id, place::int - 1 as place, s as segment, b as is_bracket from g")
def bracket_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short words stand for marked ones."""
    return _segments(spark, sf_dir, X.marked_segments(F.col("t")))


@query(
    f"with {_SEGMENTS}, h as (select *, not b and before and after and len(regexp_split_to_array(s, '\\s+')) <= 2 as short from g), "
    "i as (select *, coalesce(short, false) or coalesce(b and lag(short) over w, false) or coalesce(not b and not before, false) as joined from h window w as (partition by doc_id order by place)), "
    "j as (select *, sum(case when joined then 0 else 1 end) over (partition by doc_id order by place rows unbounded preceding) as n from i) "
    "select doc_id, n::int - 1 as place, string_agg(s, ' ' order by place) as segment, arg_min(b, place) as is_bracket from j group by doc_id, n"
)
def segment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each segment, and windows within a document."""
    return S.merged_rows(_segments(spark, sf_dir, F.col("s")), "doc_id", "place", "segment", "is_bracket", X.TAKEN_IN)


def _segments(spark: SparkSession, sf_dir: str, made: Column) -> DataFrame:
    """Twice, as neighbouring words share a blank."""
    mark = lambda c: F.regexp_replace(c, " ([a-z]{2,3})([ ,.])", " 【$1】$2")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("t", mark(mark("text")))
    parts = docs.withColumn("s", X.marked_segments(F.col("t"))).select("doc_id", F.posexplode(made).alias("place", "p"))
    return parts.select("doc_id", "place", F.col("p.text").alias("segment"), F.col("p.is_bracket").alias("is_bracket"))


@query()
def special_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that need a reading of their own, with their places. A plain twin is in the tests."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.explode(tokens_of(F.col("text"))).alias("t")).select("doc_id", "t.token", "t.kind", "t.start", "t.end")


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, said, cased): the words and word pairs of the benchmark; capitalised ones only as they stand."""
    words = table(spark, sf_dir, "benchmark").select(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)).alias("w"))
    pairs = F.transform(F.slice("w", 1, F.size("w") - 1), lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1)))
    keys = words.where(F.size("w") > 1).select(F.explode(F.concat("w", pairs)).alias("key")).where("char_length(key) > 4").distinct()
    return keys.select("key", F.substring(F.md5("key"), 1, 6).alias("said"), F.col("key").rlike("^[A-Z]").alias("cased"))


@query()
def longest_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of words and word pairs replaced in every text, leftmost and longest. A plain twin is in the tests."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _digest(lexicon.replaced(docs, phrases(spark, sf_dir), "text", "out").select("doc_id", "out"))


@query()
def vietnamese_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the written text to the one read aloud; acronyms and pairs stand in for a model's findings. A plain twin is in the tests."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    first = F.regexp_extract("text", "[a-z]{4,}", 0)
    found = docs.withColumns({"acronyms": F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Z]{2,4}\b"), F.lit(0))), "pairs": F.array(F.struct(first.alias("word"), F.upper(first).alias("said")))})
    words = phrases(spark, sf_dir).where("not cased")
    spelled = spark.createDataFrame([("AI",), ("TTS",), ("URL",)], "key string")
    learned = words.select("said", F.concat("said", F.lit(" x")).alias("again")).toDF("key", "said")
    return _digest(vietnamese.spoken(found, words, learned, spelled, "text", "out", "pairs", "acronyms", ABBREVIATED).select("doc_id", "out"))


@query()
def dispatched_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by segments of several languages; some words stand for other scripts, syllables and tags. A plain twin is in the tests."""
    stand_ins = [(" the ", " 我们，"), (" of ", "<zhong1>"), (" und ", " [laugh] "), (" der ", "<ai4>是"), (" de ", " [S1] "), (" la ", " <x "), (" y ", "<a]")]
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", X.replaced(F.col("text"), stand_ins).alias("t")))
    made = add_tokens(docs, "dialog", "t")
    return made.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", "|")).alias("tokens_md5"))
