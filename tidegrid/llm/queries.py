"""Registered queries of the numbered operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from tidegrid.llm.bpe import encode_decode
from tidegrid.llm.chat import maximal_turns, render
from tidegrid.llm.chroma import search, vector_recordings
from tidegrid.llm.exact_dedup import exact_dedup
from tidegrid.llm.html_extraction import extract_main_text, learn_weights
from tidegrid.llm.impact_search import rank_documents
from tidegrid.llm.jaccard_join import jaccard_components
from tidegrid.llm.lexical_packing import pack
from tidegrid.llm.pseudo_likelihood import count_words, token_likelihood, train
from tidegrid.llm.ranking import fit_quality, with_quality
from tidegrid.llm.store import table
from tidegrid.llm.supervised import remainder
from tidegrid.llm.token_alignment import align_tokenizers
from tidegrid.llm.toxicity import fit_toxicity, with_toxicity
from tidegrid.llm.vantage_trees import nearest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


@query()
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 of 100 distinct 4-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a fifth of the labels is never learned."""
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    scores = with_toxicity(docs.select("doc_id", "text"), model)
    return scores.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


_DEDUP_SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents),
g as (select low, max(doc_id) as keep_id, count(*) as group_size from t group by low)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.low) as text_sha256 from t join g using (low)"""


@query(_DEDUP_SQL)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts by block naming."""
    return exact_dedup(table(spark, sf_dir, "documents"))


@query()
def op4_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of every hundredth recording, aligned with all recordings; the vectors are the scores that are played."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vector_recordings(vectors), vector_recordings(vectors.filter("vec_id % 100 = 0"), excerpts=True))


@query()
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    found = extract_main_text(pages, learn_weights(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with a checksum of their ids."""
    return pack(docs, VOCABULARY).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query()
def op6_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return packed(table(spark, sf_dir, "documents"))


@query()
def op7_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    done = encode_decode(table(spark, sf_dir, "documents"), VOCABULARY)
    size = (F.octet_length("ids") / 4).cast("long")
    return done.select("doc_id", size.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


_CHAT_SQL = """
with t as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null),
p as (select *, turn - min(turn) over (partition by conv_id) as pos, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) as segment from t),
s as (select conv_id, pos, string_agg(segment, chr(0) order by role, text) as part from p group by conv_id, pos),
x as (select conv_id, pos, max(pos) over (partition by conv_id) as last,
      list((pos, part)) over (partition by conv_id order by pos rows between unbounded preceding and current row) as prefix from s),
ends as (select prefix, min(conv_id) as conv_id from x where pos = last group by prefix),
kept as (select conv_id from ends where not exists (select 1 from x where x.pos < x.last and x.prefix = ends.prefix))
select p.conv_id, p.turn, p.role, p.segment, coalesce(sum(length(segment)) over (partition by p.conv_id order by p.turn, p.role, p.text rows between unbounded preceding and 1 preceding), 0)::bigint as start,
       p.role = 'assistant' as trainable
from p join kept using (conv_id)"""


@query(_CHAT_SQL)
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered turns of the conversations that are no snapshot of a longer one."""
    return render(maximal_turns(table(spark, sf_dir, "conversations")))


@query()
def op9_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a quarter of the labels is never learned."""
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    scores = with_quality(docs.select("doc_id", "text"), model)
    return scores.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every document under a window network trained on the same corpus."""
    docs = table(spark, sf_dir, "documents")
    vocabulary, frequency = count_words(docs)
    return token_likelihood(docs, train(docs, vocabulary, frequency), vocabulary, frequency)


_RANK_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
q as (select item_id, term, count(*) as times
      from (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
c as (select count(*) filter (len(terms) > 0) as n_docs, sum(len(terms))::bigint as n_terms from d),
p as (select r, doc_id, n, term, count(*) as tf from (select r, doc_id, len(terms) as n, unnest(terms) as term from d) group by all),
f as (select term, count(*) as df from p where term in (select term from q) group by term),
w as (select item_id, term, times * floor(1000 * ln((2.0::double * n_docs + 2) / (2 * df + 1)))::bigint as weight from q join f using (term), c),
s as (select item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::bigint as score
      from p join w using (term), c group by all having sum(weight) > 0)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from s where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10"""


@query(_RANK_SQL)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op12_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors of every twentieth one."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query()
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level and sentence pieces of every document, aligned."""
    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
