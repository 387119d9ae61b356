"""Benchmark decontamination by SimHash over item-sized windows.

For every item of n words, the windows of n words of a document are compared with it by ``PRINTS`` (3) 64-bit
SimHashes of their weighted 5-word shingles, each with hash values of its own.  Item fingerprints form a multi-index: a table keyed by
the item's size and each of the four 16-bit blocks of each fingerprint, with one row for every value within 2 bits of the
block (1,644 rows an item).  Two fingerprints within ``RADIUS`` (11) have a block within 2 bits, as 4 * 3 > 11, so a join of the
windows' blocks with that table finds every item within the radius of any fingerprint and names the candidates.  They are
then verified by the exact weighted Jaccard similarity of the shingle multisets.

The index selects: a random pair of one size shares a block within 2 bits with probability 0.8 % for one fingerprint and 2.5 % for three.

A window can only reach the threshold if enough of its shingles occur in some item, whichever; windows
that fail this count get no fingerprint.  The count reads a bit table of all item shingles
whose size is bounded; a false positive of it costs time and changes nothing.

At a similarity of 0.8, fingerprints lie 9.7 bits apart on average (sigma 2.9).  All four blocks of one differ by 3 bits or more
in 4 of 100 such pairs, and of all three fingerprints in 1 of 10,000; more similar pairs are missed less often.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import arrow_batches, stored, stored_with
from .textkit import LOWER, blocks, mix, runs, span_hashes, utf8, window_hashes

SHINGLE = 5
#: Fingerprints of an item or window.
PRINTS = 3
SEEDS = mix(np.arange(PRINTS, dtype=np.uint64))
#: Distance within which each fingerprint finds all others.
RADIUS = 11
#: Candidates further apart (4.6 sigma at a similarity of 0.8) in the fingerprint by which they met are not verified.
FAR = 23
BLOCK_BITS = 16
#: Bits in which a block of the multi-index may differ.
BLOCK_RADIUS = RADIUS // (64 // BLOCK_BITS)
#: Bits of the largest table of item shingles (32 MB); what one bit table can't tell apart only costs time.
MAX_TABLE_BITS = 1 << 28
#: Rows of the largest index that is sent to all tasks (about 50 MB); a larger one and the windows' blocks are shuffled by block.
BROADCAST_ROWS = 1 << 19
#: Windows whose votes are summed at a time.
STRETCH = 8192

REGIONS = "id long, doc_row long, first long, shingles binary, windows array<struct<size:int,words:int,start:long,prints:array<long>>>"


def _word_table() -> np.ndarray:
    """Bytes of words: ASCII letters and digits, and all bytes of other characters."""
    inside = np.arange(256) >= 128
    for lo, hi in ((48, 58), (65, 91), (97, 123)):
        inside[lo:hi] = True
    return inside


def plain_words(data: np.ndarray, offsets: np.ndarray):
    """Hashes of lower-cased words without ASCII punctuation, and each row's first word."""
    data = LOWER[data]
    starts, ends = runs(_word_table()[data], offsets)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def item_shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words, different for each width."""
    return mix(window_hashes(words, width) ^ np.uint64(width))


def fingerprints(shingles: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """SimHashes, one column each, of the ``span`` shingles from each of the ascending ``starts``; memory is bounded by ``STRETCH`` and the span."""
    out = np.zeros((len(starts), PRINTS), np.uint64)
    bits = np.arange(64, dtype=np.uint64)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + STRETCH)))
        lo, hi = int(starts[at]), int(starts[end - 1]) + span
        rows = starts[at:end] - lo
        sums = np.zeros((hi - lo + 1, 64), np.int32)
        for seed in range(PRINTS):
            sums[0] = 0
            for k in range(lo, hi, STRETCH):
                part = mix(shingles[k : min(k + STRETCH, hi)] ^ SEEDS[seed])
                sums[k - lo + 1 : k - lo + 1 + len(part)] = ((part[:, None] >> bits) & np.uint64(1)).astype(np.int32) * 2 - 1
            np.cumsum(sums, axis=0, out=sums)
            out[at:end, seed] = ((sums[rows + span] > sums[rows]).astype(np.uint64) << bits).sum(axis=1, dtype=np.uint64)
        at = end
    return out


def least_common(size: np.ndarray, span: np.ndarray, threshold: float) -> np.ndarray:
    """Shingles that items of ``size`` shingles and windows of ``span`` must share."""
    return np.ceil(threshold * (size + span) / (1 + threshold) - 1e-6).astype(np.int64)


def _item_batches(batches):
    names = ["item_id", "size", "prints", "total", "keys", "counts"]
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        out = []
        for first, last in blocks(offsets):
            words, where = plain_words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            for k in range(last - first):
                own = words[where[k] : where[k + 1]]
                if len(own):
                    found = item_shingles(own, min(SHINGLE, len(own)))
                    mark = fingerprints(found, np.zeros(1, np.int64), len(found))
                    keys, counts = np.unique(found, return_counts=True)
                    out.append((batch.column(0)[first + k].as_py(), len(own), mark.view(np.int64)[0].tolist(), len(found), keys.tobytes(), counts.astype(np.int32).tobytes()))
        columns = list(zip(*out, strict=True)) or [()] * 6
        types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _table_bits(batches):
    """(word, bits) of the bit table, from rows of item keys and the table's size."""
    for batch in batches:
        for keys, size in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            at = np.frombuffer(keys.as_buffer(), np.uint64) & np.uint64(size - 1)
            word, back = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, back, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])


def shingle_table(items: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each shingle of any item, by its hash, and the number of bits: ``MAX_TABLE_BITS`` at most, whatever the number of items.

    Where few bits are set, their places are returned in place of the table.
    """
    n = items.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    size = 1 << 16
    while size < 64 * n and size < MAX_TABLE_BITS:
        size *= 2
    words = items.select("keys", F.lit(size).alias("size")).mapInArrow(_table_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size // 64, np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    places = np.flatnonzero(np.unpackbits(table.view(np.uint8), bitorder="little"))
    return (places if len(places) < len(table) else table), size


def _known(table: np.ndarray, size: int):
    mask = np.uint64(size - 1)
    if table.dtype != np.uint64:  # few set bits travel as places
        bits = np.zeros(size // 64, np.uint64)
        np.bitwise_or.at(bits, table >> 6, np.uint64(1) << (table & 63).astype(np.uint64))
        table = bits
    return lambda h: (table[((h & mask) >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) > 0


def windows_of(words: np.ndarray, hits: dict[int, np.ndarray], sizes: np.ndarray, threshold: float):
    """(width, item size, window words, starts) of the windows of one text that hold enough known shingles; hits are running counts."""
    width, n = np.minimum(SHINGLE, sizes), np.minimum(sizes, len(words))
    span = n - width + 1
    need = least_common(sizes - width + 1, span, threshold)
    most = np.zeros(SHINGLE + 1, np.int64)
    for w, total in hits.items():
        most[w] = total[-1]
    # Only sizes for which the text holds enough known shingles at all are tried.
    for k in np.flatnonzero((span > 0) & (span >= need) & (most[width] >= need)):
        total = hits[int(width[k])]
        starts = np.flatnonzero(total[span[k] :] - total[: len(total) - span[k]] >= need[k])
        if len(starts):
            yield int(width[k]), int(sizes[k]), int(n[k]), starts


def _region_batches(table: np.ndarray, table_size: int, sizes: np.ndarray, threshold: float):
    def run(batches):
        known = _known(table, table_size)
        widths = sorted({min(SHINGLE, s) for s in sizes.tolist()})
        names = ["id", "doc_row", "first", "shingles", "windows"]
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for lo, hi in blocks(offsets):
                words, where = plain_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                marked = {}
                for w in widths:
                    found = item_shingles(words, w)
                    total = np.zeros(len(words) + 1, np.int64)
                    np.cumsum(known(found), out=total[1 : len(found) + 1])
                    total[len(found) + 1 :] = total[len(found)]
                    marked[w] = found, total
                some = np.zeros(hi - lo, bool)
                for _, total in marked.values():
                    some |= total[where[1:]] > total[where[:-1]]
                out = []
                for k in np.flatnonzero(some):
                    own = words[where[k] : where[k + 1]]
                    hits = {w: total[where[k] : max(where[k], where[k + 1] - w + 1) + 1] for w, (_, total) in marked.items()}
                    hits = {w: t - t[0] for w, t in hits.items()}
                    by_width: dict[int, list] = {}
                    for width, size, n, starts in windows_of(own, hits, sizes, threshold):
                        by_width.setdefault(width, []).append((size, n, starts))
                    for width, found in by_width.items():
                        first = min(int(s[0]) for _, _, s in found)
                        last = max(int(s[-1]) + n - width + 1 for _, n, s in found)
                        shingles = marked[width][0][where[k] + first : where[k] + last]
                        windows = []
                        for size, n, starts in found:
                            marks = fingerprints(shingles, starts - first, n - width + 1).view(np.int64)
                            windows += [(size, n, s, m) for s, m in zip(starts.tolist(), marks.tolist(), strict=True)]
                        out.append((batch.column(0)[lo + k].as_py(), batch.column(1)[lo + k].as_py(), first, shingles.tobytes(), windows))
                if out:
                    kind = pa.list_(pa.struct([("size", pa.int32()), ("words", pa.int32()), ("start", pa.int64()), ("prints", pa.list_(pa.int64()))]))
                    columns = list(zip(*out, strict=True))
                    lists = pa.array([[dict(zip(("size", "words", "start", "prints"), w, strict=True)) for w in ws] for ws in columns[4]], kind)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=False)), lists], names=names)

    return run


def _verify_batches(batches):
    names = ["id", "doc_row", "item_id", "similarity", "word_start", "n_window_words", "distance"]
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        value = np.zeros(batch.num_rows)
        for i in range(batch.num_rows):
            own, own_counts = np.unique(np.frombuffer(columns["window"][i].as_buffer(), np.uint64), return_counts=True)
            keys, counts = (np.frombuffer(columns[c][i].as_buffer(), t) for c, t in (("keys", np.uint64), ("counts", np.int32)))
            _, a, b = np.intersect1d(keys, own, assume_unique=True, return_indices=True)
            common = int(np.minimum(counts[a], own_counts[b]).sum())
            value[i] = common / (int(counts.sum()) + int(own_counts.sum()) - common)
        yield pa.RecordBatch.from_arrays([pa.array(value) if n == "similarity" else columns[n] for n in names], names=names)


def blocks_of(rows: DataFrame) -> DataFrame:
    """One row for each block of each of the ``prints`` of a row, with its number, the fingerprint (``print``) and its bits (``value``)."""
    n = 64 // BLOCK_BITS
    each = rows.select("*", F.posexplode("prints").alias("seed", "print")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"))
    value = F.expr(f"shiftright(print, part * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1}")
    return each.select("*", (F.col("seed") * n + F.col("part")).alias("block"), value.alias("value")).drop("prints", "seed", "part")


def multi_index(items: DataFrame) -> DataFrame:
    """Rows (size, block, value, item_row, item_print): every value within ``BLOCK_RADIUS`` bits of every block of every item."""
    near = [0] + [sum(1 << b for b in bits) for k in range(1, BLOCK_RADIUS + 1) for bits in combinations(range(BLOCK_BITS), k)]
    each = blocks_of(items.select("size", "prints", "item_row")).withColumn("apart", F.explode(F.lit(near)))
    return each.select("size", "block", F.col("value").bitwiseXOR(F.col("apart")).alias("value"), "item_row", F.col("print").alias("item_print"))


def met(windows: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs of a window (with ``size`` and ``prints``) and an item that share a block within ``BLOCK_RADIUS`` bits, a row for each block, with the ``distance`` of the fingerprints it is from."""
    pairs = blocks_of(windows).join(index, ["size", "block", "value"])
    return pairs.withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))).drop("block", "value", "print", "item_print")


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, each with its best window.

    Returns the id (as ``doc_id`` where its own name is that of another result column), ``item_id`` (long), ``similarity`` (weighted Jaccard of the 5-word
    shingles, at least ``threshold``), ``word_start`` and ``n_window_words`` (the first of the best windows),
    and the SimHash ``distance`` (the least of the fingerprints by which both met); one row per row of ``docs`` and item row.  Words are runs of
    letters, digits and non-ASCII characters, A-Z lower-cased.  Items of fewer than
    five words match as one shingle; a document shorter than the item is one
    window.  Null or empty texts and items, and items without an id, match nothing; extra columns are ignored; empty tables give no rows.

    Items, windows and candidates are tables; only the bit table of item shingles (at most 32 MB), an index of at most
    ``BROADCAST_ROWS`` rows and the distinct item sizes reach the driver.  Item rows of one id are items of their own.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    named = items.where(F.col(item_id_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    known = stored(named.mapInArrow(_item_batches, "item_id long, size int, prints array<long>, total int, keys binary, counts binary").withColumn("item_row", F.monotonically_increasing_id()), "items")
    sizes = np.array(sorted(r[0] for r in known.select("size").distinct().collect()), np.int64)
    table, table_size = shingle_table(known)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("doc_row"), F.col(text_col).cast("string").alias("text"))
    regions = stored(plain.mapInArrow(_region_batches(table, table_size, sizes, threshold), REGIONS).withColumn("region", F.monotonically_increasing_id()), "regions")
    windows = regions.select("region", F.explode("windows").alias("w")).select("region", "w.*")
    index, seen = stored_with(multi_index(known), "index", F.count("*").alias("n"))
    if seen["n"] <= BROADCAST_ROWS:
        index = F.broadcast(index)
    near = met(windows, index).where(F.col("distance") <= FAR)
    candidates = stored(near.groupBy("region", "size", "words", "start", "item_row").agg(F.min("distance").alias("distance")), "candidates")
    span = F.col("words") - F.least(F.lit(SHINGLE), F.col("size")) + 1
    window = F.substring(F.col("shingles"), ((F.col("start") - F.col("first")) * 8 + 1).cast("int"), (span * 8).cast("int"))
    cut = candidates.join(regions.select("region", "id", "doc_row", "first", "shingles"), "region").select("id", "doc_row", F.col("start").alias("word_start"), F.col("words").alias("n_window_words"), "distance", "item_row", window.alias("window"))
    pairs = cut.join(known.select("item_row", "keys", "counts"), "item_row").select("id", "doc_row", F.col("item_row").alias("item_id"), "word_start", F.col("n_window_words").cast("long").alias("n_window_words"), "distance", "window", "keys", "counts")
    verified = pairs.mapInArrow(_verify_batches, "id long, doc_row long, item_id long, similarity double, word_start long, n_window_words long, distance int").where(F.col("similarity") >= threshold)
    best = verified.groupBy("id", "doc_row", F.col("item_id").alias("item_row")).agg(F.max(F.struct("similarity", (-F.col("word_start")).alias("before"), "word_start", "n_window_words", "distance")).alias("b"))
    out = "doc_id" if id_col.lower() in ("item_id", "similarity", "word_start", "n_window_words", "distance") else id_col
    return best.join(known.select("item_row", "item_id"), "item_row").select(F.col("id").alias(out), "item_id", "b.similarity", "b.word_start", "b.n_window_words", "b.distance")


def drop_leaking_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id has no leak; rows with a null id stay, and all columns as they are."""
    found = find_leaks(docs, items, id_col, text_col, **options)
    leaks = stored(found.select(F.col(found.columns[0]).alias("leaking_id")).where("leaking_id IS NOT NULL").distinct(), "leaking")
    return docs.join(leaks, docs[id_col].cast("long") == leaks["leaking_id"], "left_anti")
