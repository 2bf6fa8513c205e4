"""A training-corpus pipeline over ``documents``: five stages, each on all that the one before kept.

1. language ID: documents that the identifier rejects go (without a single labelled
   document there is no identifier, and all stay);
2. near duplicates: of each group of documents that link by five-word shingles at a
   Jaccard similarity of 0.8 or more, the one with the smallest doc_id stays;
3. repeated passages of 50 words stay in the first document that has them; a
   document that keeps no word goes;
4. documents that hold a benchmark item within its edit budget go;
5. sources are mixed to their target weights: a document comes with the words that
   the mix takes of it, and as often as it's repeated.

Rows with equal doc_id are told apart by their text; of rows equal in both one stays.
Null and letterless texts go in the first stage.  Columns other than those of
``documents`` are dropped, so their names can't clash.  Texts are whole at any length.  A stage's result is written as
Parquet and read again as the next one's documents.  SQL can't express stages 1 and
3 to 5 with their models and fingerprints, so ``ORACLE_SQL`` is None and the tests hold
``run`` against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import _common as c
from parlance.llm import decontamination, jaccard_join, language_id, source_mixing, suffix_tree_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    if not model.languages:
        return docs.select(*COLUMNS)
    return language_id.identified(docs.select(*COLUMNS), model).filter(~F.col("rejected")).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The key of a row stands for its id, as rows with equal doc_id and other text are documents of their own.
    docs = docs.select(*COLUMNS).withColumn("row", c.row_key())
    found = jaccard_join.similar_sets(docs.select(F.col("row").alias("doc_id"), "text"), shingle=5, num=80, den=100)
    # A document without words has nothing that it could be a copy of.
    copies = found.filter(F.col("n_shingles") > 0).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")).distinct()
    copies = copies.join(docs.select("row", "doc_id"), "row")
    spoken = copies.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    gone = copies.select("row").distinct().join(spoken.select("row"), "row", "left_anti")
    return docs.join(gone, "row", "left_anti").dropDuplicates(["row"]).select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.withColumn("no_text", F.col("text").isNull())
    cut = suffix_tree_dedup.repeated_passages(docs, carry=("lang", "source", "n_chars", "no_text"), verbatim=True)
    whole = F.size("removed") == 0
    text = F.when(~F.col("no_text"), F.decode("kept", "utf-8"))
    left = cut.withColumn("text", text).filter(whole | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    n_chars = F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = c.read_table(spark, sf_dir, "benchmark")
    return decontamination.clean(docs.select(*COLUMNS), benchmark)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized = source_mixing.sized(docs, c.read_table(spark, sf_dir, "labels"), c.row_key().alias("row"))
    mix = source_mixing.mixed(sized).filter("taken > 0").select("row", "size", "source_size", "target", "taken").dropDuplicates(["row"])
    return docs.select(*COLUMNS).withColumn("row", c.row_key()).join(mix, "row").drop("row")


STAGES = [
    ("language_id", keep_known_language),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        made = c.written()
        docs = c.stored(stage(spark, docs, sf_dir))
        c.clear_stored(spark, made, but_last=1)  # what the stage has written on its way
    return docs
