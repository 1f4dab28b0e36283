"""Queries over prose: the funnel, splits, statistics, vocabulary, samples, layers, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ALLOWED, JUNK, PAIRS, assign_split, normalise, same_compound, tokenize, tokens
from ..operators import clean, vocabulary
from ..operators.leniency import folded


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.sentences(_read(spark, sf_dir, "documents"))


def _funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.funnel(_sentences(spark, sf_dir), _read(spark, sf_dir, "benchmark"))


def clean_funnel(spark, sf_dir):
    return _funnel(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


def clean_kept(spark, sf_dir):
    return _funnel(spark, sf_dir).where("reason = 'kept'").select("doc_id", "pos", "sentence")


def dedup_first_wins(spark, sf_dir):
    rows = clean.first_of_key(_sentences(spark, sf_dir), normalise(F.col("sentence")), "doc_id", "pos")
    return rows.where("is_first").select("doc_id", "pos", F.col("k").alias("key"))


def held_out_leaks(spark, sf_dir):
    held = _read(spark, sf_dir, "benchmark").select(normalise(F.col("text")).alias("k")).distinct()
    return _sentences(spark, sf_dir).join(held, normalise(F.col("sentence")) == F.col("k"), "left_semi").select("doc_id", "pos", "sentence")


def assign_split_sha256(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", assign_split(F.col("doc_id"), "corpus").alias("split"))


def split_counts(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").withColumn("split", assign_split(F.col("doc_id"), "corpus"))
    return docs.groupBy("split", "lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


def corpus_stats_by_lang(spark, sf_dir):
    return vocabulary.statistics(_sentences(spark, sf_dir))


def split_word_rate(spark, sf_dir):
    return vocabulary.split_rate(_sentences(spark, sf_dir))


def token_histogram(spark, sf_dir):
    return vocabulary.histogram(_sentences(spark, sf_dir))


def coverage_vocab(spark, sf_dir):
    return vocabulary.coverage(vocabulary.histogram(_sentences(spark, sf_dir)), (0.5, 0.9, 0.99))


def vocab_remap(spark, sf_dir):
    return vocabulary.remap(vocabulary.histogram(_sentences(spark, sf_dir)), 0.99)


def trim_projection(spark, sf_dir):
    kept = vocabulary.coverage(vocabulary.histogram(_sentences(spark, sf_dir)), (0.5, 0.9, 0.99))
    return vocabulary.projection(kept, vocab_size=100_000, hidden=1_000, params=1_000_000_000, tied=False, bytes_per_param=2)


def fallback_tokens(spark, sf_dir):
    rows = _sentences(spark, sf_dir).select("doc_id", "pos", F.size(tokens(tokenize(F.col("sentence")))).alias("n_tokens"))
    return rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"))


def typographic_fold(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.sha2(folded(F.col("text")), 256).alias("folded_sha256"))


def compound_pairs(spark, sf_dir):
    """Names with an en dash or a hyphen against closed ones."""
    dash = F.when(F.col("p_partkey") % 2 == 0, "–").otherwise("-")
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.replace("p_type", F.lit(" "), dash).alias("a"), F.replace("p_type", F.lit(" "), F.lit("")).alias("b"))
    return rows.select("p_partkey", same_compound(F.col("a"), F.lower("b")).alias("same"))


def stratified_screen(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang")
    return clean.stratified(docs, F.col("lang"), 60, "screen", "doc_id").select("doc_id", "lang")


def holdout_split(spark, sf_dir):
    return clean.held_out_share(_read(spark, sf_dir, "documents").select("doc_id"), "holdout", "doc_id", 10).select("doc_id", "side")


def layer_similarity(spark, sf_dir):
    return vocabulary.layer_similarity(_read(spark, sf_dir, "embeddings"))


def best_window(spark, sf_dir):
    return vocabulary.best_window(vocabulary.layer_similarity(_read(spark, sf_dir, "embeddings")), 3)


def sentence_split_pages(spark, sf_dir):
    text = F.regexp_replace(F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    text = F.trim(F.regexp_replace(text, "\\s+", " "))
    rows = _read(spark, sf_dir, "pages").select("page_id", F.explode(F.split(text, "(?<=[.!?]) ")).alias("sentence"))
    return rows.where("sentence <> ''").groupBy("page_id").agg(F.count("*").alias("sentences"), F.sum(F.char_length("sentence")).alias("chars"))


def label_agreement(spark, sf_dir):
    """The prose filter's verdict on whole documents against the quality labels."""
    rows = _funnel(spark, sf_dir).groupBy("doc_id").agg(F.count_if(F.col("reason") == "unclean").alias("bad"), F.count("*").alias("n"))
    rows = rows.join(_read(spark, sf_dir, "labels"), "doc_id").withColumn("flagged", F.col("bad") * 2 > F.col("n"))
    return rows.groupBy("quality", "flagged").agg(F.count("*").alias("n"))


QUERIES = (
    clean_funnel, clean_kept, dedup_first_wins, held_out_leaks, assign_split_sha256, split_counts, corpus_stats_by_lang, split_word_rate, token_histogram,
    coverage_vocab, vocab_remap, trim_projection, fallback_tokens, typographic_fold, compound_pairs, stratified_screen, holdout_split, layer_similarity,
    best_window, sentence_split_pages, label_agreement,
)

_LINES = """lines as (select doc_id, lang, unnest(range(len(l))) as pos, l from (select doc_id, lang, string_split(text, chr(10)) as l from documents)),
sents as (select doc_id, lang, pos::int as pos, trim(l[pos + 1], ' ') as sentence from lines where trim(l[pos + 1], ' ') <> '')"""
_WORDS = lambda s: f"list_filter(string_split_regex({s}, '\\s+'), lambda w: w <> '')"
_KEY = lambda s: f"lower(regexp_replace({s}, '\\s+', '', 'g'))"


def _clean_sql() -> str:
    quote = lambda x: x.replace("'", "''")
    letters = ALLOWED["de"].replace("\\w", "\\pL\\pN\\pM_")
    tests = ["substr(sentence, 1, 1) = upper(substr(sentence, 1, 1)) or substr(sentence, 1, 1) <> lower(substr(sentence, 1, 1))", "right(sentence, 1) in ('.', '!', '?')"]
    tests += [f"not contains(sentence, '{quote(j)}')" for j in JUNK]
    tests += [f"regexp_matches(sentence, '^[{quote(letters)}]+$')", "not (sentence = upper(sentence) and sentence <> lower(sentence))"]
    count = lambda c: f"(length(sentence) - length(replace(sentence, '{quote(c)}', '')))"
    tests += [f"{count(a)} % 2 = 0" if a == b else f"{count(a)} = {count(b)}" for a, b in PAIRS["de"]]
    return " and ".join(f"({t})" for t in tests)


_FUNNEL = f"""{_LINES},
keyed as (select *, {_KEY("sentence")} as key from sents),
ranked as (select *, row_number() over (partition by key order by doc_id, pos) as rn from keyed),
judged as (select doc_id, pos, lang, sentence, case when rn > 1 then 'duplicate' when key in (select {_KEY("text")} from benchmark) then 'held out'
  when not ({_clean_sql()}) then 'unclean' when len({_WORDS("sentence")}) not between 8 and 60 then 'length' else 'kept' end as reason from ranked)"""
_SHARE = "cast('0x' || substr(sha256('{0}:' || doc_id), 1, {1}) as bigint)"
_SPLIT = f"case when {_SHARE.format('corpus', 13)} / 4503599627370496.0::double < 0.8 then 'train' when {_SHARE.format('corpus', 13)} / 4503599627370496.0::double < 0.8::double + 0.1::double then 'dev' else 'test' end"
_HIST = f"""{_LINES},
words as (select lang, unnest({_WORDS("sentence")}) as w from sents),
parts as (select substr(w, 1 + 3 * unnest(range((length(w) + 2) // 3)), 3) as token from words),
hist as (select token, count(*) as n from parts group by 1),
run as (select token, n, coalesce(sum(n) over (order by n desc, token rows between unbounded preceding and 1 preceding), 0) as before, sum(n) over () as total from hist)"""
_COVER = f"{_HIST}, cov as (select t.threshold::double as threshold, count(*) as kept from run, (values (0.5), (0.9), (0.99)) t(threshold) where before < t.threshold::double * total group by 1)"
_LAYERS = """pairs as (select vec_id as layer, label, embedding as a, lead(embedding) over (order by vec_id) as b from embeddings),
sims as (select layer % 24 as layer, round(avg(list_cosine_similarity(a::double[], b::double[])), 6) as similarity from pairs where b is not null group by 1)"""

SQL = {
    "clean_funnel": f"with {_FUNNEL} select reason, count(*) as n from judged group by 1",
    "clean_kept": f"with {_FUNNEL} select doc_id, pos, sentence from judged where reason = 'kept'",
    "dedup_first_wins": f"with {_FUNNEL} select doc_id, pos, key from ranked where rn = 1",
    "held_out_leaks": f"with {_FUNNEL} select doc_id, pos, sentence from keyed where key in (select {_KEY('text')} from benchmark)",
    "assign_split_sha256": f"select doc_id, {_SPLIT} as split from documents",
    "split_counts": f"select {_SPLIT} as split, lang, count(*) as documents, sum(n_chars)::bigint as chars from documents group by 1, 2",
    "corpus_stats_by_lang": f"""with {_LINES}, w as (select lang, sentence, {_WORDS("sentence")} as words from sents)
select lang, count(*) as sentences, sum(len(words))::bigint as words, sum(length(sentence))::bigint as chars, sum(strlen(sentence))::bigint as bytes,
  sum(list_sum(list_transform(words, lambda x: (length(x) + 2) // 3)))::bigint as tokens,
  round(sum(list_sum(list_transform(words, lambda x: (length(x) + 2) // 3))) / sum(len(words)), 6) as fertility from w group by 1""",
    "split_word_rate": f"""with {_LINES}, w as (select lang, unnest({_WORDS("sentence")}) as w from sents)
select lang, count_if(length(w) > 3)::bigint as split_words, count(*) as words, round(count_if(length(w) > 3) / count(*), 6) as rate from w group by 1""",
    "token_histogram": f"with {_HIST} select token, n from hist",
    "coverage_vocab": f"with {_COVER} select threshold, kept from cov",
    "vocab_remap": f"with {_HIST} select token, (row_number() over (order by token) - 1)::int as new_id from run where before < 0.99::double * total",
    "trim_projection": f"""with {_COVER} select threshold, kept, 100000 - kept as removed, (100000 - kept) * 2000 as params_saved,
  round((100000 - kept) * 2000 / 1000000000.0, 9)::double as fraction_saved, (100000 - kept) * 4000 as bytes_saved from cov""",
    "fallback_tokens": f"""with {_LINES} select doc_id, sum(len({_WORDS("regexp_replace(sentence, '([.,;:!?…])(\\s|$)', ' \\1\\2', 'g')")}))::bigint as n_tokens from sents group by 1""",
    "typographic_fold": "select doc_id, sha256(trim(regexp_replace(translate(nfc_normalize(text), '„“”‘’–—' || chr(160), '\"\"\"''''-- '), '\\s+', ' ', 'g'), ' ')) as folded_sha256 from documents",
    "compound_pairs": "select p_partkey, contains(replace(p_type, ' ', '-'), '-') <> contains(replace(p_type, ' ', ''), '-') and lower(replace(replace(p_type, ' ', '-'), '-', '')) = lower(replace(replace(p_type, ' ', ''), '-', '')) as same from part",
    "stratified_screen": """with c as (select lang, count(*) as n, sum(count(*)) over () as total from documents group by 1),
r as (select doc_id, lang, row_number() over (partition by lang order by sha256('screen:' || doc_id)) as rn from documents)
select doc_id, r.lang from r join c using (lang) where rn <= round_even(n * 60 / total, 0)""",
    "holdout_split": f"select doc_id, case when {_SHARE.format('holdout', 8)} % 100 < 10 then 'held' else 'train' end as side from documents",
    "layer_similarity": f"with {_LAYERS} select layer, similarity from sims",
    "best_window": f"""with {_LAYERS}, w as (select layer as start, round(avg(similarity) over (order by layer rows between current row and 2 following), 6) as mean, count(*) over (order by layer rows between current row and 2 following) as k,
  min(layer) over () as lo, max(layer) over () as hi from sims)
select start, mean from w where k = 3 and start > lo and start + 2 < hi order by mean desc, start limit 1""",
    "sentence_split_pages": """with t as (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), ' ') as t from pages),
s as (select page_id, unnest(string_split(regexp_replace(t, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1))) as sentence from t)
select page_id, count(*) as sentences, sum(length(sentence))::bigint as chars from s where sentence <> '' group by 1""",
    "label_agreement": f"with {_FUNNEL}, d as (select doc_id, count_if(reason = 'unclean') as bad, count(*) as n from judged group by 1) select quality, bad * 2 > n as flagged, count(*) as n from d join labels using (doc_id) group by 1, 2",
}
