"""From raw documents to packed training sequences, a stage after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

Every stage takes an empty table, and gives one; columns besides doc_id, text, source, lang and n_chars are passed on by
all but the last, whatever their names. What else is defined is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from termweave.llm import _shared, language, mixing, nearcopies, packing, queries, suffixes


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (9): documents without a letter, or unlike every language, go.

    A null or blank text has no letter; every row is judged for itself, whether others repeat it or not; no id is needed.
    Where no row has a language nothing can be learned, and only texts without a letter go.
    """
    _shared.ship(spark)
    return language.identified_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (5): of each group of texts whose five-word shingles are 0.8 alike the document with the smallest id stays.

    Texts without a word, null ones too, are a group. Of several rows with the smallest id the one of the least text hash
    stays, and so it is in a group without any id.
    """
    _shared.ship(spark)
    return nearcopies.representatives(docs)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup (7): passages of 200 bytes or more that come again anywhere are cut out of their documents.

    A null text stays null; a document of which nothing is left stays, with an empty text; n_chars counts what is left;
    rows that repeat a text of 200 bytes or more all lose it.
    """
    return suffixes.stripped_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights (3): each source's documents are taken up to its budget, some of them twice.

    Documents without a word are never taken; a null source is a source; where the budget cuts a document its first
    words are taken, and n_chars counts these; rows that repeat an id and size share what is taken.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (6): a row a piece, with its token ids and its place in a sequence of at most 2048.

    A null or empty text is its end token alone; rows that repeat an id are packed each for itself.
    """
    _shared.ship(spark)
    pieces = packing.pack(docs, queries.tokenizer_path())
    return pieces.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", identify),
    ("simhash_dedup", near_dedup),
    ("suffix_dedup", strip_repeats),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fingerprints, suffix order and tokens are not SQL's to express; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _shared.spilled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
