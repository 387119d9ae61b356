"""Exact copies of a text, with the frequent texts found first and taken out of the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

SUPPORT = 1 / 1024


def normal_text(text: Column) -> Column:
    """Runs of ASCII white space as one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[ \x09-\x0D]+", " ")


def digests_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``(id, digest, size, mark)``: SHA-256 of the normal text, and its length and a second hash to check it by."""
    text = F.col("normal")
    base = docs.select(F.col(id_col).cast("long").alias("id"), normal_text(F.col(text_col)).alias("normal"))
    return base.select("id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).alias("size"), F.xxhash64(text).alias("mark"))


def frequent_candidates(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Digests that may hold over ``support`` of all rows: at most ``1 / support`` of them, and all that do.

    Spark's ``freqItems`` is the Misra-Gries summary, made in every task and merged; its counters are bounded by
    ``1 / support`` at any size of the table.
    """
    summary = digests.select(F.hex("digest").alias("digest")).stat.freqItems(["digest"], support)
    return summary.select(F.explode(summary.columns[0]).alias("digest")).select(F.unhex("digest").alias("digest"))


def _groups(rows: DataFrame) -> DataFrame:
    """One row per digest, from a partial aggregation in each task; null ids are larger than all."""
    return rows.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"), (F.min("mark") == F.max("mark")).alias("one_mark"), (F.min("size") == F.max("size")).alias("one_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical after each run of ``[\\x20\\x09-\\x0D]`` became one space; null is the empty
    text.  ``keep_id`` is the smallest id of a group, ``group_size`` its rows, and ``kept`` says that the row has that id.
    Rows that repeat an id and text are all kept and all counted; null ids are kept only where a group has no other, and
    its ``keep_id`` is null.  An empty table gives an empty one, and other columns, clashing or not, are not looked at.

    The digests go to a table once.  A Misra-Gries summary names at most ``1 / support`` digests that may be frequent;
    the groups of these candidates are counted exactly, and those that are over ``support`` win.  Winners are at most
    ``1 / support`` rows, so they are broadcast, and their rows are answered where they are read.  All other digests hold
    at most ``support`` of the rows each and meet by an ordinary shuffle.  Equality of digests is verified:
    a group whose members differ in length or in a second hash raises an error.
    """
    table = stored(digests_of(docs, id_col, text_col), "digests")
    total = table.count()
    counted = stored(_groups(table.join(F.broadcast(frequent_candidates(table, support)), "digest")).where(F.col("group_size") > support * total), "winners")
    frequent = F.broadcast(counted)
    rest = table.join(F.broadcast(counted.select("digest")), "digest", "left_anti")
    # Few rows share a digest here: their groups go back to them by a join on it, whose sides are dealt alike.
    groups = _groups(rest)
    checked = F.when(F.col("one_mark") & F.col("one_size"), F.col("keep_id")).otherwise(F.raise_error(F.lit("texts of one digest differ")).cast("long")).alias("keep_id")
    shape = [F.col("id").alias(id_col), checked, "group_size", F.coalesce(F.col("id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    return table.join(frequent, "digest").select(*shape).unionAll(rest.join(groups.hint("shuffle_hash"), "digest").select(*shape))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` whose text has no copy of smaller id; all columns as they are.

    Of rows that repeat both id and text one stays.  A null id stays only where its text has no other.
    """
    names = {c.lower() for c in docs.columns}
    group, turn = (next(n for n in (x, *(f"{x}_{i}" for i in range(99))) if n.lower() not in names) for x in ("keep_id", "turn"))
    kept = exact_groups(docs, id_col, text_col, support).where("kept").select(F.col(id_col).alias(group), "text_sha256").distinct()
    keyed = docs.withColumn(turn, F.sha2(normal_text(F.col(text_col)), 256))
    joined = keyed.join(kept.select(F.col(group), F.col("text_sha256").alias(turn)), turn)
    same = joined.where(F.col(id_col).cast("long").eqNullSafe(F.col(group)))
    return same.dropDuplicates([id_col, turn]).select(*docs.columns)
