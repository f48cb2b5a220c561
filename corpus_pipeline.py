"""From raw documents to token ids in five stages.

STAGES lists them; each takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again
as the next stage's docs. All but the last return the columns of documents.

1. Quality classifier: documents that it rejects go. Learns from the table labels.
2. Toxicity: documents that it rejects go. Learns from the table labels.
3. N-gram Jaccard join (five words, similarity 0.8): the document with the least id of each group stays.
4. Mixing: documents are repeated or left out so that each source's words meet its target; the one at a
   source's cut ends with the last word that is taken. What is left out is what the budget leaves no room for.
5. SentencePiece: the ids of each document, and whether they decode to its text.

Defined results: a null text counts as an empty one everywhere; empty texts are scored like any others, link with
nothing and take no place in the mix (they have no words); of rows that repeat an id, and of equal texts whether they
have an id or not, one stays; a null source is a source of its own; an empty table gives an empty result; further columns are
carried along up to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import jaccard_join, mixing, quality_cnn, sentencepiece_fst, toxicity_crf
from corpusloom.llm.common import cleared, scratch_mark, stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_cnn.kept(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity_crf.kept(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.distinct_documents(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_copies(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_fst.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mixing", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: The classifiers are trained models; no stage after them can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", "zstd")
        cleared(mark, docs)  # a stage's own tables, and its predecessor's result
    return STAGES[-1][1](spark, docs, sf_dir)
