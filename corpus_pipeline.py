"""A training-data pipeline over documents: five stages, each written and read again.

Every stage takes null in any column, empty and very long texts, repeated rows, empty tables and further columns of any name; all
but the last return the columns of their input. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, language, line_dedup, ngram_join
from tessera.llm.base import scratch, stored, table


def apart(docs: DataFrame, stage: Callable[[DataFrame, Callable[[str], str]], DataFrame]) -> DataFrame:
    """stage(renamed docs, new name by old) under the old names: the columns that it adds never clash with those of docs."""
    new = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    out = stage(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in new.items())), new.__getitem__)
    return out.select(*(F.col(n).alias(c) for c, n in new.items()))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models reject go; lang takes the predicted language.

    Null and letterless texts are rejected. Repeated rows fare alike. Without any training row all are rejected.
    """
    model = language.fit(docs.where(~language.held_out()).select("doc_id", "text", "lang"))

    def stage(rows: DataFrame, new: Callable[[str], str]) -> DataFrame:
        found = language.predict(rows, model, new("text")).where("NOT rejected")
        return found.withColumn(new("lang"), F.col("lang_pred"))

    return apart(docs, stage)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs of ten words or 20 characters go; a document of which nothing is left goes.

    n_chars becomes the length of what is left. Null texts stay null. Rows equal in id and text are one document and get the same text;
    copies under other ids lose what the first id has.
    """

    def stage(rows: DataFrame, new: Callable[[str], str]) -> DataFrame:
        text = new("text")
        left = line_dedup.dedup_lines(rows, new("doc_id"), text, min_chars=20).where(F.expr(f"n_removed_lines = 0 OR trim({text}) <> ''"))
        return left.withColumn(new("n_chars"), F.length(text).cast("long")) if "n_chars" in docs.columns else left

    return apart(docs, stage)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by n-gram similarity the one with the smallest id stays (null last, then by hash of the text).

    Of rows equal in id and text one stays. Documents without words link with nothing and stay.
    """
    return ngram_join.one_of_each_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go, repeated rows together. Null and wordless texts stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token counts and the digests of their ids and of what these decode to. Null counts as the empty text.

    Columns of docs named n_tokens, ids_sha256 or decoded_sha256 are replaced.
    """
    return bpe.encode_decode(docs, "word_bpe_49k.json")


STAGES = [
    ("language ID", keep_known_languages),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_class),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: Character models, whole-set joins and BPE have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch() as keep:
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        keep(docs)
    return docs
