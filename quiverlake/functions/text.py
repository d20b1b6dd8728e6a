"""Text columns: content ids and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shortest paragraph that is kept, in characters.
MIN_PARAGRAPH = 40
MAX_TEXTS = 256
MAX_TEXT_BYTES = 12 << 10


def text_id(text: Column | str) -> Column:
    """The first 60 bits of the text's SHA-256 as a number; null for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per different text: its text_id, the text, and the number of its rows. Null, empty
    and blank texts are left out."""
    own = docs.where(F.length(F.trim(text)) > 0).select(F.col(text).alias("text"), text_id(text).alias("text_id"))
    return own.groupBy("text_id").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("n_rows"))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = MIN_PARAGRAPH) -> DataFrame:
    """(key, position, paragraph): parts between blank lines of at least ``shortest`` characters
    without outer blanks. position counts all parts from 0. Null texts have none."""
    parts = docs.select(key, F.posexplode(F.split(text, "\n\n")).alias("position", "p"))
    return parts.select(key, "position", F.trim(F.col("p")).alias("paragraph")).where(F.length("paragraph") >= shortest)


def text_problems(docs: DataFrame, text: str = "text", metadata: str | None = None) -> DataFrame:
    """Rows that can't be added as texts, with the ``problem``: blank, too long, or a metadata key
    named text."""
    c = F.col(text)
    problem = F.when(c.isNull() | (F.length(F.trim(c)) == 0), "empty").when(F.octet_length(c) > MAX_TEXT_BYTES, "too long")
    if metadata:
        problem = problem.when(F.map_contains_key(metadata, F.lit("text")), "reserved key")
    return docs.withColumn("problem", problem).where("problem IS NOT NULL")
