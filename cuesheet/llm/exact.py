"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

A normalised text is cut where its content says so: at the first end of a sentence after CHUNK_MIN characters, without one up to
CHUNK_MAX at the first blank, and only in texts without blanks after CHUNK_MAX. Equal texts are cut alike, and a change moves only the cuts near it. Each distinct chunk is moved once, to
verify that no other chunk has its identifier; from then on a document is its list of identifiers, and only those lists
are shuffled and compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import numbered, only, settled, table, written

CHUNK_MIN, CHUNK_MAX = 1024, 8192
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, " ")


def chunks(text: Column) -> Column:
    """The text cut up; joined again, the parts are the text."""
    some = rf".{{{CHUNK_MIN},{CHUNK_MAX}}}?"
    return F.regexp_extract_all(text, F.lit(rf"(?s){some}(?:[.!?] |[。！？।؟]|\z)|{some} |.{{1,{CHUNK_MAX}}}"), F.lit(0))


def recipes(docs: DataFrame, identifier: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Adds `recipe`, the ordered verified identifiers of the chunks of column `text` (normalised already).

    Where two different chunks have one identifier, each is numbered among them and the number becomes part of it.
    """
    cut = docs.select("row", F.posexplode(chunks(F.col("text"))).alias("at", "chunk")).withColumn("id", identifier(F.col("chunk")))
    distinct = cut.select("id", "chunk").distinct()
    shared = settled(distinct.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"))
    plain = F.transform(chunks(F.col("text")), lambda x: identifier(x))
    if shared.isEmpty():
        return docs.withColumn("recipe", plain)
    docs = written(docs)
    cut = docs.select("row", F.posexplode(chunks(F.col("text"))).alias("at", "chunk")).withColumn("id", identifier(F.col("chunk")))
    clash = distinct.join(shared.select("id"), "id", "left_semi")
    smaller = clash.alias("a").join(clash.select("id", F.col("chunk").alias("other")).alias("b"), "id").groupBy("id", "chunk").agg(F.sum((F.col("other") < F.col("chunk")).cast("int")).cast("int").alias("nr"))
    renamed = cut.join(smaller, ["id", "chunk"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "nr"))).alias("nrs"))
    named = F.transform(plain, lambda x, i: F.struct(x.alias("id"), F.coalesce(F.try_element_at("nrs", i), F.lit(0)).alias("nr")))
    return docs.join(renamed, "row", "left").withColumn("recipe", named).drop("nrs")


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", identifier: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of `docs`.

    Texts are equal when identical after each run of blanks became one space; null counts as empty, so null and empty
    texts are one group (a text of blanks only is another). The smallest doc_id stays. Of repeated rows with that
    doc_id one is kept. A null doc_id comes after all others, and is kept only in a group that has none. Other columns
    are ignored; an empty table gives no rows.
    """
    rows = only(docs, doc_id, text).withColumn("text", normalised(F.col("text"))).withColumn("row", F.monotonically_increasing_id())
    made = written(recipes(rows, identifier).select("doc_id", "row", "recipe", F.sha2(F.col("text"), 256).alias("text_sha256")))
    groups = shared_recipes(made)
    kept = F.coalesce(F.col("row") == F.col("first.row"), F.lit(True)).alias("kept")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id")
    return made.join(groups, "recipe", "left").select("doc_id", keep_id, F.coalesce("group_size", F.lit(1)).alias("group_size"), kept, "text_sha256")


def shared_recipes(made: DataFrame) -> DataFrame:
    """(recipe, first, group_size) of the recipes that more than one row has, as a table.

    The join of rows and this table then begins with plain shuffles of both sides, so that Spark can split the part of a recipe that very many
    rows share (its adaptive skew join), as it can't where the groups are made in the same stage.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    return written(made.groupBy("recipe").agg(first.alias("first"), F.count("*").alias("group_size")).where("group_size > 1"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS nr, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents),
     w AS (SELECT *, first_value(doc_id) OVER g AS keep_id, row_number() OVER g AS rn, count(*) OVER (PARTITION BY text) AS group_size
           FROM t WINDOW g AS (PARTITION BY text ORDER BY doc_id NULLS LAST, nr))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(text) AS text_sha256 FROM w
"""


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts (blanks as one space) the row with the smallest doc_id stays, once.

    A null text counts as empty; a null doc_id comes after all others. Whole texts of any length are compared. Repeated rows are copies of each other.
    Rows are told apart by a number of their own, so other columns, whatever their names, go with the row unchanged. An empty table stays empty.
    """
    out, row = numbered(docs)
    made = written(recipes(out.select(F.col(row).alias("row"), "doc_id", normalised(F.coalesce("text", F.lit(""))).alias("text"))).select("doc_id", "row", "recipe"))
    # what goes is less than what stays, so where it is small enough no text moves for the last join
    dropped = made.join(shared_recipes(made), "recipe").where(F.col("row") != F.col("first.row")).select(F.col("row").alias(row))
    return out.join(written(dropped), row, "left_anti").select(docs.columns)
