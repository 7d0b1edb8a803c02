"""Documents of a training corpus, from language identification to the mixed sample.

Each stage takes all that its predecessor kept, as a table read back from Parquet, and returns what it keeps.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from navgrid.llm import line_dedup, lsh_forest, raking, string_kernel, winnowing
from navgrid.llm.common import table
from navgrid.session import materialise, ship

ORACLE_SQL = None  # trained models, components and raking are no SQL; tests hold run() against a brute-force version


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a language that is known from the labelled ones among them; null and letterless texts go.

    The score does not decide: it falls with the number of languages and for short texts, however clean they are."""
    ship(spark)
    model = string_kernel.fit(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 0)
    return string_kernel.languages(docs, model).where(F.col("lang_pred") != string_kernel.UNKNOWN).select(*docs.columns)


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of runs of lines; a text that keeps no word after losing lines goes."""
    cut = line_dedup.without_repeated_runs(docs)
    return cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each class of near duplicates, whole."""
    ship(spark)
    return lsh_forest.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without any window of the benchmark."""
    ship(spark)
    return winnowing.clean_texts(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample at the target weights, with each text's tokens, topic, probability and how often to use it (copies)."""
    return raking.sampled(docs).where("sampled").drop("sampled").withColumn("probability", F.round("probability", 6))


STAGES = [("language", language), ("line_runs", line_runs), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
