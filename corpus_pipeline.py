"""From raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of its docs; what it
returns is stored and is the next one's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from itinera.llm import decontaminate, language_id, simhash, source_mix, token_files
from itinera.llm.common import discard, materialise, table
from itinera.llm.queries import byte_bpe_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    return language_id.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of op9's fingerprints one document stays, that of the least doc_id."""
    return simhash.drop_near_copies(docs)


def drop_near_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stage: as drop_near_copies, but texts of shingle similarity 0.8 or more are linked too."""
    return simhash.drop_near_copies(docs, by_shingles=True)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts; documents of nothing else go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken up to their targets; a document taken twice is two rows."""
    return source_mix.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix: doc_id, start, n_tokens, ids_crc32 as read back from them."""
    return token_files.token_output(docs, byte_bpe_path)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_texts),
    ("benchmark decontamination", decontaminate_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_tokens),
]

#: Models, fingerprints and tokens are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
        discard(*before)  # nothing reads the stage before any more
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
