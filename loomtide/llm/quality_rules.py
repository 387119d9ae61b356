"""Quality rules: text statistics and cross-document line frequency per host."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import arrow_batches, stored
from .textkit import LOWER, blocks, mix, span_hashes, utf8, window_hashes, word_bounds

SYMBOLS = b"#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_bounds(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends and rows of the lines of every row; an empty row is one empty line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    count = np.diff(np.searchsorted(breaks, offsets)) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), count)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(words: np.ndarray, where: np.ndarray, width: int = 3) -> np.ndarray:
    """Whether each word lies in a window of ``width`` words found twice or more in its row."""
    inside = np.zeros(len(words), bool)
    windows = window_hashes(words, width)
    if not len(windows):
        return inside
    row = np.repeat(np.arange(len(where) - 1), np.diff(where))
    at = np.flatnonzero(row[: len(windows)] == row[width - 1 :])
    keyed = mix(windows[at] ^ mix(row[at].astype(np.uint64) + np.uint64(1)))
    _, back, count = np.unique(keyed, return_inverse=True, return_counts=True)
    twice = at[count[back] > 1]
    for k in range(width):
        inside[twice + k] = True
    return inside


def text_statistics(data: np.ndarray, offsets: np.ndarray):
    """The five statistics of each row (columns), and per line with a word: row, key, words."""
    starts, ends, where = word_bounds(data, offsets)
    words = span_hashes(data, starts, ends)
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    lead = ((data & 0xC0) != 0x80) & ~blank[data]
    ls, le, row = line_bounds(data, offsets)
    first, last = np.searchsorted(starts, ls), np.searchsorted(starts, le)
    full = last > first
    ls, le, row, first, last = ls[full], le[full], row[full], first[full], last[full]
    raw = mix(span_hashes(data, ls, le) ^ mix(row.astype(np.uint64) + np.uint64(1)))
    _, at = np.unique(raw, return_index=True)
    rows = len(offsets) - 1
    dup = np.bincount(row, minlength=rows) - np.bincount(row[at], minlength=rows)
    stats = np.stack([np.diff(where), _per_row(lead, offsets), _per_row(table[data], offsets), dup, _per_row(repeated_words(words, where), where)])
    keys = span_hashes(LOWER[data], starts[first], ends[last - 1]) if len(first) else np.zeros(0, np.uint64)
    return stats, row, keys, last - first


def _batches(batches):
    names = ["id", "host", "th", *STATISTICS, "lines", "line_words"]
    for batch in batches:
        data, offsets = utf8(batch.column(3))
        stats, lists = [np.zeros((5, 0), np.int64)], []
        for first, last in blocks(offsets):
            s, row, keys, words = text_statistics(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            stats.append(s)
            both, back = np.unique(np.stack([row.astype(np.uint64), keys]), axis=1, return_inverse=True)
            lists.append((np.bincount(both[0].astype(np.int64), minlength=last - first), both[1], np.bincount(back.reshape(-1), weights=words, minlength=both.shape[1]).astype(np.int64)))
        stats = np.concatenate(stats, axis=1)
        counts, keys, words = (np.concatenate([x[k] for x in lists] or [np.zeros(0, np.int64)]) for k in range(3))
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        columns = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x).astype(t).view(np.int64))) for x, t in ((keys, np.uint64), (words, np.int64))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x) for x in stats.astype(np.int64)), *columns], names=names)


def judge_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_share: float = 0.05,
    min_documents: int = 3,
    min_words_left: float = 0.5,
) -> DataFrame:
    """Statistics and verdict of every row.

    Returns the id (long), ``text_hash`` (xxhash64 of the text), the five
    statistics, ``base_failed`` (fewer than 50 words, or over half of the
    words in repeated 3-word windows), ``n_lost_words`` (words on lines that
    are removed) and ``kept``.  A line (A-Z lower-cased, blanks cut at its ends) is removed where
    more than ``max_share`` of its host's documents and more than ``min_documents`` of them
    hold it, so that small hosts lose their templates too; a document that keeps less than ``min_words_left`` of its words
    is depleted and rejected.

    A null text has no words and fails; a null host is a host of its own; rows that repeat an id
    count as one document, and each gets its own verdict.  Lines
    are counted as distinct (host, line, id) rows and then summed with
    partial aggregation, so a hot host or line is spread over all tasks.
    """
    judged, _ = _judge(docs, id_col, text_col, host_col, max_share, min_documents, min_words_left)
    return judged.select(F.col("id").alias(id_col), "text_hash", *STATISTICS, "base_failed", "n_lost_words", "kept")


def _judge(docs: DataFrame, id_col: str, text_col: str, host_col: str, max_share: float = 0.05, min_documents: int = 3, min_words_left: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Verdicts with host and line keys, and the removed (host, line) pairs."""
    spark = docs.sparkSession
    arrow_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), F.xxhash64(text).alias("th"), text.alias("text"))
    schema = "id long, host string, th long, " + ", ".join(f"{x} long" for x in STATISTICS) + ", lines array<long>, line_words array<long>"
    marked = stored(plain.mapInArrow(_batches, schema).withColumns({"host": F.coalesce("host", F.lit("\0")), "row": F.monotonically_increasing_id()}), "quality")
    sizes = marked.select("host", "id").distinct().groupBy("host").agg(F.count("*").alias("documents"))
    held = marked.select("host", "id", F.explode("lines").alias("line")).distinct().groupBy("host", "line").agg(F.count("*").alias("holders")).where(F.col("holders") > min_documents)
    removed = stored(held.join(sizes, "host").where(F.col("holders") > max_share * F.col("documents")).select("host", "line"), "frequent")
    each = marked.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    lost = each.join(removed, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("lost"))
    judged = marked.drop("line_words").join(lost, "row", "left").withColumn("n_lost_words", F.coalesce("lost", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_lost_words") >= min_words_left * F.col("n_words")
    return judged.select("id", "host", "lines", F.col("th").alias("text_hash"), *STATISTICS, failed.alias("base_failed"), "n_lost_words", (~failed & left).alias("kept")), removed


def _without_lines(texts: pd.Series, keys: pd.Series) -> pd.Series:
    out = []
    for text, gone in zip(texts, keys, strict=True):
        if text is not None and gone is not None:
            data, offsets = utf8(pa.array([text]))
            starts, ends, _ = word_bounds(data, offsets)
            ls, le, _ = line_bounds(data, offsets)
            first, last = np.searchsorted(starts, ls), np.searchsorted(starts, le)
            full = np.flatnonzero(last > first)
            found = span_hashes(LOWER[data], starts[first[full]], ends[last[full] - 1]).view(np.int64)
            drop = set(full[np.isin(found, np.asarray(gone, np.int64))].tolist())
            text = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in drop)
        out.append(text)
    return pd.Series(out, dtype=object)


def keep_good_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` that ``judge_documents`` keeps, without the lines that are removed on their host.

    Rows are told apart by id, text and host; repeated rows share a verdict, and null ids and hosts are
    values of their own.  A kept text without removed lines is unchanged, a null text or one that fails
    is no kept text, other columns stay as they are, and an empty table gives no rows.
    """
    judged, removed = _judge(docs, id_col, text_col, host_col, **limits)
    each = judged.where("kept").select("id", "text_hash", "host", F.explode("lines").alias("line")).join(removed, ["host", "line"])
    cut = each.groupBy("id", "text_hash", "host").agg(F.collect_set("line").alias("cut_lines"))
    gone = judged.where("NOT kept").select("id", "text_hash", "host").distinct().withColumn("cut_lines", F.lit(None).cast("array<long>"))
    changes = stored(gone.union(cut), "changes")
    names = {c: _free(docs, c) for c in ("change_id", "change_hash", "change_host", "change_lines")}
    marked = changes.select(*(F.col(a).alias(b) for a, b in zip(("id", "text_hash", "host", "cut_lines"), names.values(), strict=True)), F.lit(True).alias(_free(docs, "changed")))
    cid, chash, chost, clines = names.values()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(cid)) & (F.xxhash64(text) == F.col(chash)) & (F.coalesce(F.col(host_col).cast("string"), F.lit("\0")) == F.col(chost))
    joined = docs.join(marked, same, "left").where(F.col(_free(docs, "changed")).isNull() | F.col(clines).isNotNull())
    rewrite = F.pandas_udf(_without_lines, "string")
    new = rewrite(F.when(F.col(clines).isNotNull(), F.col(text_col)), F.col(clines))
    return joined.select(*(F.when(F.col(clines).isNotNull(), new).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns))


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or it with underscores until no column of ``docs`` has it."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name
