"""Training data from documents: five stages, each an operator whose decisions take effect on what the last one kept.

Each stage takes (spark, docs, sf_dir). All but the last return rows of ``docs``, unchanged; the last returns
doc_id and the ids of its text. Models are learned from the documents that reach their stage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.llm import decontamination, languages, near_duplicates, quality, sentence_pieces
from cohortspan.llm.common import ship_code
from cohortspan.sources.staging import stage

#: Rows judged at a time: fewer than a batch has, so that a task holds few texts as objects.
AT_ONCE = 500


def _rows_where(docs: DataFrame, judge: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """Rows whose text is judged true, where they lie. ``judge`` is called in each task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = judge()
        for batch in batches:
            for rows in (batch.slice(a, AT_ONCE) for a in range(0, batch.num_rows, AT_ONCE)):
                texts = rows.column("text").to_pylist()
                yield rows.filter(pa.array([x for part in languages.batched(texts, languages.AT_ONCE) for x in decide(part)], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known: likelier in it than in the others, and about as likely as its own texts.

    Texts in other languages, of random letters or without letters go, null ones too. Without a labelled document all go.
    """
    ship_code(spark)
    model = languages.learn(docs)
    if model is None:
        return docs.limit(0)
    sent = spark.sparkContext.broadcast(model)

    def judge():
        scorer = languages.Scorer(sent.value)
        return lambda texts: languages.fits(scorer, texts)

    return _rows_where(docs, judge)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as good; all of them if no label says what is good.

    A null text is scored as an empty one. Repeated rows are scored each.
    """
    ship_code(spark)
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs if model is None else _rows_where(docs, lambda: lambda texts: quality.is_good(model, texts))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id, one without an id last.

    Rows are told apart, not ids: of two rows with one doc_id each is judged by its own text, and of equal rows
    one stays. Null texts and texts without words are in no group and stay.
    """
    ship_code(spark)
    row = "row"
    while row in docs.columns:
        row += "_"
    # Staged, so that a row has the same number wherever it is read.
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates.cluster(numbered.select(F.col(row).alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias(row), F.col("component_id").alias("group_"))
    members = stage(found.join(numbered.select(row, F.col("doc_id").cast("long").alias("id_")), row), "near-duplicates")
    first = members.groupBy("group_").agg(F.min(F.struct(F.col("id_").isNull(), "id_", row)).alias("first_"))
    gone = stage(members.join(first, "group_").where(F.col(row) != F.col(f"first_.{row}")).select(row), "repeated")
    # One number each, so that texts stay where they lie; beyond the bound they are shuffled to the numbers instead.
    chosen = F.broadcast(gone) if gone.count() <= near_duplicates.SENT else gone
    return numbered.join(chosen, row, "left_anti").select(docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no larger part is benchmark items; rows with one doc_id are judged each by their text.

    Null texts have no words and stay, and so do all documents if no item has words.
    """
    ship_code(spark)
    judged = decontamination.judged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = stage(judged.where("contaminated").select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct(), "contaminated")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("k")), "left_anti")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and piece ids of each document; a null or empty text has no ids. Repeated rows are encoded each."""
    ship_code(spark)
    return sentence_pieces.encode(docs)


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", unlike),
    ("decontamination", uncontaminated),
    ("sentence_pieces", pieces),
]

# Learned models and byte strings are beyond SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
