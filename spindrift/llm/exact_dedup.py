"""Exact deduplication by skew-safe combining.

Equal texts are first combined within each partition, then within salted digest groups, then across
salts. The full text is part of the grouping key at every stage, so that a digest alone never decides
which texts are one group. Where every row is told its group, the rows of repeated texts find it by two
SHA-256 digests of their text, as the text would have to be shuffled once more; drop_copies() has no such
step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, free

#: A digest's rows are first combined in so many groups.
SALTS = 16


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each distinct text: sha, text, keep_id (the largest id), group_size.

    Spark's partial aggregate is the local stage: a map task sends one row for each text it holds,
    however often the text occurs there. A text that occurs in all of a million tasks then meets in
    `salts` groups before one, of `salts` rows, is left.
    """
    base = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).select("id", "text", F.sha2("text", 256).alias("sha"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    salted = base.groupBy("sha", "salt", "text").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("sha", "text").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Every row's group: id_col, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of equal texts the row with the largest id stays. A row repeated with
    its id and text counts as often as it occurs, in group_size too, and each of its copies is returned.
    A null id stays only in a group that has no other; its keep_id is null. Other columns are ignored. An empty table gives no rows.
    """
    winners = exact_groups(docs, id_col=id_col, text_col=text_col, salts=salts)
    # Only groups of more than one row have to be matched with the rows, by two digests of the text, so
    # that texts of one digest, which the stages above have told apart, are told apart here too. A hot
    # group is spread over the salts.
    repeated = durable(
        winners.withColumn("variant", F.sha2(F.concat(F.lit("+"), "text"), 256)).drop("text").filter("group_size > 1")
    )
    spread = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_sha"),
        F.sha2(F.concat(F.lit("+"), F.coalesce(F.col(text_col), F.lit(""))), 256).alias("_variant"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit("row")), F.lit(salts)).cast("int").alias("_salt"),
    )
    found = rows.join(spread, (F.col("_sha") == F.col("sha")) & (F.col("_variant") == F.col("variant")) & (F.col("_salt") == F.col("salt")), "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("_id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row of docs for each distinct text, that with the largest id, with all its columns.

    Combined in the same three stages, the rest of the row beside its text: no join, so the texts are
    shuffled no more often than for the groups. A null text equals an empty one, and stays null if its
    row is the one that stays. Of rows that share id and text that with the
    largest hash of its other columns stays.
    """
    no_text = free("no_text", docs.columns)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.col(text_col).isNull().alias(no_text))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        text.alias("text"),
        F.sha2(text, 256).alias("sha"),
        F.pmod(F.xxhash64(id_col), F.lit(salts)).alias("salt"),
        F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("tie")).alias("rank"),
        whole.alias("row"),
    )
    salted = base.groupBy("sha", "salt", "text").agg(F.max_by("row", "rank").alias("row"), F.max("rank").alias("rank"))
    kept = salted.groupBy("sha", "text").agg(F.max_by("row", "rank").alias("row"))
    back = [
        F.when(F.col(f"row.`{no_text}`"), F.lit(None).cast("string")).otherwise(F.col("text")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ]
    return kept.select(*back)
