"""Lines that several documents share, removed but for one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

BLANKS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased (and no other letter)."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(docs: DataFrame, min_length: int) -> DataFrame:
    exploded = docs.select("id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = exploded.select("id", "th", "pos", line_key(F.col("line")).alias("k")).where(F.char_length("k") >= min_length)
    return keyed.select("id", "th", "pos", F.xxhash64(F.lit(1), "k").alias("h1"), F.xxhash64(F.lit(2), "k").alias("h2"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 10, min_documents: int = 2) -> DataFrame:
    """``docs`` with shared lines removed from ``text_col``, and ``n_lines`` and ``n_dropped``.

    A line whose key has at least ``min_length`` code points and is found in
    at least ``min_documents`` different documents stays only in the document of smallest id
    that holds it, there as often as it comes.  Other lines stay, joined by
    ``\\n`` in their order.  A null or empty text is one empty line and
    becomes the empty text.  Rows that repeat an id are one document;
    rows with a null id are returned unchanged and count for no other row.
    Other columns are passed on as they are; columns of ``docs`` named ``n_lines`` or ``n_dropped`` give way to the new ones.

    Keys are compared by 128 bits of hash.  Per key, distinct documents are
    counted after a partial aggregation, so a line in a third of all
    documents is one row per task.
    """
    taken = {c.lower() for c in docs.columns}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).where("id IS NOT NULL")
    lines = _lines(base.withColumn("th", F.xxhash64("text")), min_length)
    if min_documents == 2:  # two different documents: the smallest and the largest id differ
        seen = lines.groupBy("h1", "h2").agg(F.min("id").alias("keeper"), F.max("id").alias("last")).where("keeper < last")
    else:
        seen = lines.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.min("id").alias("keeper"), F.count("*").alias("n")).where(F.col("n") >= min_documents)
    shared = stored(seen.select("h1", "h2", "keeper"), "lines")
    drops = lines.join(shared, ["h1", "h2"]).where("id <> keeper").groupBy("id", "th").agg(F.collect_set("pos").alias("drops"))
    names = {x: next(n for n in (x, *(f"{x}_{i}" for i in range(99))) if n.lower() not in taken) for x in ("row_id", "row_hash", "row_drops")}
    rid, rth, rdrops = names.values()
    rows = docs.withColumns({rid: F.col(id_col).cast("long"), rth: F.xxhash64(text)})
    found = drops.select(F.col("id").alias(rid), F.col("th").alias(rth), F.col("drops").alias(rdrops))
    joined = rows.join(found.hint("shuffle_hash"), [rid, rth], "left")
    split = F.split(text, "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(rdrops)), lambda p: F.element_at(split, p + 1))
    whole = [F.when(F.col(rdrops).isNull(), F.when(F.col(id_col).isNull(), F.col(text_col)).otherwise(text)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return joined.select(*whole, (F.size(split)).cast("long").alias("n_lines"), F.coalesce(F.size(rdrops), F.lit(0)).cast("long").alias("n_dropped"))
