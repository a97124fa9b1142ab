"""A training corpus from raw documents: five stages, each of them one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the documents of the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.bpe import encode_documents
from palimpsest.llm.common import materialise, read_table
from palimpsest.llm.mixing import longer, mix, repeat
from palimpsest.llm.quality import LANGUAGES, quality_rules
from palimpsest.llm.queries import BYTE_BPE, PIECES
from palimpsest.llm.simhash import near_duplicates
from palimpsest.llm.suffix_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; so do null texts."""
    whole = docs.select(F.struct("*").alias("document"), "text", "lang")
    return quality_rules(whole, PIECES, ["document"], lang="lang", bands=LANGUAGES).where("kept").select("document.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the document with the smallest id stays.

    Groups are those of texts, whatever their ids, null and repeated ones included, and one row of each
    stays: the one with the smallest id (null last), of rows that share it the one whose text has the
    smallest hash, and of rows alike in both any one.
    """
    marked = docs.select(F.struct("*").alias("document"), "doc_id", "text", F.xxhash64("text").alias("mark"))
    rows = near_duplicates(marked, keep=["mark"]).groupBy("group", "doc_id", "mark").agg(F.count("*").alias("n"))
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("mark"), F.col("n"))).alias("at"))
    stay = materialise(first.select(F.col("at.doc_id").alias("of_id"), F.col("at.mark").alias("of_mark"), F.col("at.n").alias("n")), "stay")

    def of(some: DataFrame) -> DataFrame:
        return marked.join(some, F.col("doc_id").cast("long").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark")))

    once = of(stay.where("n = 1")).select("document")
    # repeated rows are combined before their shuffle
    again = of(stay.where("n > 1")).groupBy("of_id", "of_mark").agg(F.first("document").alias("document")).select("document")
    return once.unionAll(again).select("document.*")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 200 bytes are cut out of the texts; ``n_chars`` follows."""
    rest = remove_repeats(docs, keep=[c for c in docs.columns if c != "text"], kept_text="text")
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rest.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a mix of their sources takes them; within a source longer ones are preferred."""
    return repeat(mix(docs, prefer=longer(F.col("text"))), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with digests of ids and decoded text."""
    return encode_documents(docs, BYTE_BPE, keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_copies),
    ("repeated passages", passages),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the fertility measures, fingerprints and ranks; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None
