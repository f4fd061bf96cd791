"""The corpus pipeline: toxicity, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written before the next
stage starts: a stage may then drop the tables that the one before worked with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.llm import common
from repolith.llm.jaccard import jaccard_join
from repolith.llm.mixing import WORD, measured, mix_sources
from repolith.llm.packing import pack_documents
from repolith.llm.substrings import substring_dedup
from repolith.llm.tokens import vocabulary
from repolith.llm.toxicity import drop_toxic, train

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_used: list[str] = []


def _stage(work: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.drop(spark, _used)
        before = set(common.written)
        out = work(common.ship(spark), docs, sf_dir)
        _used[:] = [x for x in common.written if x not in before]
        return out

    return run_stage


NAMED = ("doc_id", "text", "source")


def _parted(docs: DataFrame) -> DataFrame:
    """doc_id, text, source, and the other columns as one, ``rest``, whatever their names."""
    rest = [F.col(c) for c in docs.columns if c not in NAMED]
    return docs.select(*NAMED, F.struct(*rest).alias("rest") if rest else F.lit(None).cast("int").alias("rest"))


def _numbered(docs: DataFrame, more: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """_parted rows, written with a number for each, so that rows that share an id, or have none, are told apart, and what ``more`` adds."""
    return common.saved(more(_parted(docs).withColumn("row", F.monotonically_increasing_id())), "numbered")


def _as_documents(rows: DataFrame, docs: DataFrame, named: tuple[str, ...] = (*NAMED, "n_chars")) -> DataFrame:
    """The columns of ``docs`` from _parted rows; n_chars, if named, follows the text."""
    rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows
    return rows.select(*(F.col(c) if c in named else F.col("rest")[c].alias(c) for c in docs.columns))


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, scores below 0.5.

    Rows stay as they are, all columns. Null and empty texts get the score of an empty window;
    repeated rows go or stay together; an empty table, or no labels, leaves all rows.
    """
    return drop_toxic(docs, train(docs, common.table(spark, sf_dir, "labels")))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a 5-gram Jaccard similarity of 0.8: the first in the table, as it is.

    Ids play no part, so null or repeated ones change nothing. Rows without words, null texts
    among them, belong to no group and stay. An empty table gives no rows.
    """
    rows = _numbered(docs)
    kept = jaccard_join(rows, id_col="row").where("kept").select("row")
    return _as_documents(rows.join(kept, "row", "left_semi"), docs, ("doc_id", "text", "source"))


def _substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeated windows of 35 words cover; a text that loses none stays as it is.

    Null texts become empty; every row stays, repeated ones with what is left; an empty table gives no rows.
    """
    cut = substring_dedup(_parted(docs), more=("source", "rest"))
    return _as_documents(cut.withColumn("text", F.coalesce("kept", F.lit(""))), docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes words of them, twice at most; where it takes a part, the first words.

    The plan is by row: texts that share an id, or have none, are taken each by its own size. Null
    and empty texts have nothing to take and go; a null source is a source; an empty table gives no rows.
    """
    rows = _numbered(docs, measured)
    plan = mix_sources(rows, row_col="row", is_measured=True).select("row", "size", F.explode(F.filter(F.array("taken_first", "taken_again"), lambda n: n > 0)).alias("taken"))
    words = F.regexp_extract_all("text", F.lit(WORD), 0)
    part = F.array_join(F.slice(words, F.lit(1), F.col("taken").cast("int")), " ")
    return _as_documents(rows.drop("size").join(plan, "row").withColumn("text", F.when(F.col("taken") >= F.col("size"), F.col("text")).otherwise(part)), docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each text stands, in sequences of 2048 tokens at most, as op4_packing returns it.

    Null and empty texts are one piece, the end id; repeated rows are packed each; an empty table gives no rows.
    """
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _stage(_toxicity)),
    ("near_duplicates", _stage(_near_duplicates)),
    ("substring_dedup", _stage(_substrings)),
    ("mixing", _stage(_mixing)),
    ("packing", _stage(_packing)),
]

#: SQL can't express a trained network or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    out = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = common.saved(stage(spark, out, sf_dir), name)
    return STAGES[-1][1](spark, out, sf_dir)
