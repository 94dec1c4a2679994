"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next one's docs; all but the last return the columns of documents.

Every stage reads whole texts of any length; null texts count as empty, null ids and sources are values of their own, rows that
repeat an id are rows of their own, an empty table gives an empty one, and other columns of docs pass through to the last stage
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovelake.llm.bpe import bpe_encode
from grovelake.llm.common import stored, table
from grovelake.llm.exact_dedup import without_copies
from grovelake.llm.mixing import mixed
from grovelake.llm.near_dedup import without_near_copies
from grovelake.llm.quality_crf import good_documents, held_out, train
from grovelake.llm.queries import ranks

QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go. It learns from the labelled rows that aren't held out.

    An empty text has the score of a document with one empty line; without labels to learn from every document stays.
    """
    known = ~held_out(F.col("doc_id"))
    model = train(docs.where(known), table(spark, sf_dir, "labels").where(known))
    return good_documents(docs, model, QUALITY)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the smallest id stays, null ids last; of rows equal in both, one."""
    return without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 over five-word shingles, the smallest id stays; texts without words all do."""
    return without_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document stands as many times as the mix takes it. Rows without a source are a source."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of each text, and digests of the ids and of what they decode to.

    One row for each row of docs, repeated ones too; a null or empty text has no ids. Other columns end here.
    """
    coded = bpe_encode(docs.select("doc_id", "lang", "source", "text"), *ranks(), decoded="decoded")
    digests = F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", *digests)


STAGES = [("quality", quality), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mixing", mixture), ("bpe", tokens)]

#: A trained classifier and a tokenizer have no SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
