"""The best documents for each item of a query set, by integer BM25 scores and a join that thresholds seed."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import arrow_batches, discard, stored

#: Bytes that part terms become blanks, A-Z become a-z, and all others stay as they are.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
BAG = "row long, id long, n long, term string, tf int"


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split() if text else []


def _bags(batches):
    for batch in batches:
        rows, ids, texts = (batch.column(k) for k in range(3))
        bags = [Counter(terms_of(t.as_py())) for t in texts]
        sizes = np.fromiter((len(b) + 1 for b in bags), np.int64, len(bags))
        at = pa.array(np.repeat(np.arange(len(bags)), sizes))
        totals = pa.array([sum(b.values()) for b in bags], pa.int64())
        terms = pa.array([t for b in bags for t in (b"", *b)], pa.binary()).cast(pa.string())
        counts = pa.array([c for b in bags for c in (0, *b.values())], pa.int32())
        yield pa.RecordBatch.from_arrays([rows.take(at), ids.take(at), totals.take(at), terms, counts], ["row", "id", "n", "term", "tf"])


def term_rows(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``(row, id, n, term, tf)`` of every text: one per distinct term, and one with the empty term that stands for the text itself."""
    arrow_batches(table.sparkSession)
    numbered = table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return numbered.mapInArrow(_bags, BAG)


def _impact(n_docs: int, n_terms: int) -> Column:
    """The score that a term adds to a document; ``w`` is the weight of the term."""
    return F.expr(f"w * ((1000000000L * tf) div (1000L * tf + 20L * (50L + (50L * n * {n_docs}L) div {max(n_terms, 1)}L)))")


def _weight(n_docs: int) -> Column:
    return F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")


def _kth(scores: DataFrame, k: int, name: str) -> DataFrame:
    """Rows ``(item, name)``: the k-th largest ``score`` of items that have so many; Spark keeps k rows an item in each task before it shuffles them."""
    order = Window.partitionBy("item").orderBy(F.desc("score"))
    return scores.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).groupBy("item").agg(F.max("nth").alias("found"), F.min("score").alias(name)).where(F.col("found") == k).drop("found")


def term_statistics(postings: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """One row per term: ``df``, ``w``, its largest impact ``best`` and its k-th largest ``kth`` (0 with fewer documents).

    Impacts are counted by value first, so a term of a third of all documents is as many rows as it has values.
    """
    values = postings.groupBy("term", "tf", "n").agg(F.count("*").alias("c"))
    sizes = values.groupBy("term").agg(F.sum("c").alias("df"))
    valued = values.join(sizes, "term").withColumn("w", _weight(n_docs)).withColumn("impact", _impact(n_docs, n_terms))
    run = valued.withColumn("above", F.sum("c").over(Window.partitionBy("term").orderBy(F.desc("impact"))))
    return run.groupBy("term").agg(F.first("df").alias("df"), F.first("w").alias("w"), F.max("impact").alias("best"), F.coalesce(F.max(F.when(F.col("above") >= k, F.col("impact"))), F.lit(0)).alias("kth"))


def _scores(wanted: DataFrame, postings: DataFrame, impact: Column) -> DataFrame:
    """Rows ``(item, row, id, score)``: the impacts of the wanted ``(item, term, w)`` rows in every document that holds one of them."""
    return wanted.join(postings, "term").groupBy("item", "row").agg(F.first("id").alias("id"), F.sum(impact).alias("score"))


def _rescored(pairs: DataFrame, wanted: DataFrame, postings: DataFrame, impact: Column) -> DataFrame:
    """The exact scores of pairs ``(item, row)`` over all terms of their items."""
    held = pairs.select("item", "row").join(postings, "row")
    return held.join(wanted, ["item", "term"]).groupBy("item", "row").agg(F.first("id").alias("id"), F.sum(impact).alias("score"))


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows ``(item_col, rank, id_col, score)``: the k best documents of every item with a score above 0, equal scores by ascending id.

    Terms are the maximal runs of ASCII letters and digits and of all other letters outside ASCII, A-Z lower-cased.  Null and empty
    texts have none and are found for nothing.  Each row of ``docs`` is a document: rows that repeat an id are ranked apart, and null
    ids come last among equals.  Rows of ``items`` that repeat an id are one item; a null item id gives no rows.  An empty
    table on either side gives an empty result; other columns, clashing or not, are not looked at.

    Term rows of the documents go to a table once, those of the items' terms only.  For every term its largest
    and its k-th largest impact are stored.  The largest k-th impact of an item's terms is a bound that its k-th score cannot be below.
    It seeds the bound; documents that are best by the rarest terms are scored exactly and lift it (any k exact scores are such a bound).
    Terms are taken by falling largest impact, and the longest suffix whose impacts together stay under half of the bound is left out of
    candidate generation: a document needs more than that from the other terms.  Candidates whose sum and suffix reach the bound
    are scored exactly over all terms, so no document is lost, whatever the bounds are.
    Small sides are broadcast where Spark's size check allows it; else they meet by a shuffle in which adaptive execution splits hot terms.
    """
    wanted = stored(term_rows(items.where(F.col(item_col).isNotNull()), item_col, item_text).select(F.col("id").alias("item"), "term").distinct(), "items")
    vocabulary = stored(wanted.select("term").distinct(), "vocabulary")
    table = stored(term_rows(docs, id_col, text_col).join(vocabulary, "term", "left_semi"), "postings")
    sums = table.where("term = '' AND n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, impact = sums.docs, _impact(sums.docs, sums.terms)
    postings = table.where("term <> ''")
    statistics = stored(term_statistics(postings, n_docs, sums.terms, k), "statistics")
    rare = Window.partitionBy("item").orderBy("df", "term")
    of_item = Window.partitionBy("item")
    terms = wanted.join(statistics, "term").withColumns({"held": F.sum("df").over(rare), "nth": F.row_number().over(rare), "floor": F.max("kth").over(of_item)})
    terms = stored(terms, "terms")
    # Seeds: documents that are best by rare terms, at most a sixteenth of all for an item beside a constant.
    seeding = terms.where((F.col("held") <= n_docs // 16 + 400 * k) | (F.col("nth") == 1)).select("item", "term", "w")
    seeded = _scores(seeding, postings, impact).withColumn("nth", F.row_number().over(of_item.orderBy(F.desc("score"), "row"))).where(F.col("nth") <= 2 * k)
    seeds = stored(seeded.select("item", "row"), "seeds")
    lifted = stored(_kth(_rescored(seeds, terms.select("item", "term", "w"), postings, impact), k, "lifted"), "lifted")
    bound = F.greatest("floor", F.coalesce("lifted", F.lit(0)))
    rising = of_item.orderBy("best", "term")
    bounded = terms.join(lifted, "item", "left").withColumn("bound", bound).withColumn("suffix", F.sum("best").over(rising))
    bounded = stored(bounded.withColumn("needed", F.col("suffix") * 2 >= F.col("bound")).select("item", "term", "w", "best", "bound", "needed"), "bounds")
    rest = stored(bounded.groupBy("item").agg(F.max("bound").alias("bound"), F.coalesce(F.sum(F.when(~F.col("needed"), F.col("best"))), F.lit(0)).alias("rest")), "rest")
    found = _scores(bounded.where("needed").select("item", "term", "w"), postings, impact)
    candidates = stored(found.join(rest, "item").where(F.col("score") + F.col("rest") >= F.col("bound")).select("item", "row"), "candidates")
    exact = _rescored(candidates, terms.select("item", "term", "w"), postings, impact).where("score > 0")
    order = of_item.orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    ranked = exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = stored(ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"), "ranks")
    discard(table, wanted, vocabulary, statistics, terms, seeds, lifted, bounded, rest, candidates)
    return out
