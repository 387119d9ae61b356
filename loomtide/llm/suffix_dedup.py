"""Long strings that repeat across documents, by a distributed suffix sort over sampled positions.

Every window of ``length`` bytes has one sampled position, the leftmost least hash of its
K-byte grams, which only the window's bytes decide; so equal windows share their sample and its
offset, which is what a difference cover guarantees.  Sampled suffixes are
dealt out by the hash of their gram.  In a task they are sorted by triples of 8-byte blocks, whose names are
sorted as triples again; adjacent suffixes are compared for their common
prefix.  The suffixes in between are merged from the names of the bytes on the left of their sample and the
rank of the sample at the length that remains.

Only samples whose gram several documents hold are sorted: any other window
is found in one document alone.  A gram with more than ``CROWDED_GRAM`` rows is salted over
as many tasks as its rows need: in each, rows that see the same bytes around their sample
collapse to the first of them, and the rows that are left of all its tasks are sorted
together.  Where these are too many still, their windows are counted by digest with partial aggregation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import arrow_batches, discard, stored
from .textkit import blocks, mix, powers, utf8

GRAM = 18
#: Rows of one gram that a task sorts at most.
CROWDED_GRAM = 8192
#: Rows of all grams that a task sorts, about.
TASK_ROWS = 65_536
#: A wanted sample is its place and, above these bits, the number of its gram's salts.
PLACE_BITS = 32

CONTEXT = "gram long, id long, th long, place long, near int, far int, context binary"


def samples(data: np.ndarray, offsets: np.ndarray, length: int):
    """Sampled positions, their gram hashes, and the first and last window start of each."""
    n, reach = len(data), length - GRAM + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty.astype(np.uint64), empty, empty
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    value = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    del sums
    grams, place, size = value, np.arange(len(value)), 1
    while size < reach:
        step = min(size, reach - size)
        right = value[step:] < value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = np.where(right, value[step:], value[:-step])
        size += step
    row_end = np.repeat(offsets[1:], np.diff(offsets))[: len(place)]
    starts = np.flatnonzero(np.arange(len(place)) + length <= row_end)
    if not len(starts):
        return empty, empty.astype(np.uint64), empty, empty
    place = place[starts]
    new = np.concatenate([[True], np.diff(place) != 0])
    at = np.flatnonzero(new)
    return place[at], grams[place[at]], starts[at], starts[np.append(at[1:], len(starts)) - 1]


def _sample_batches(length: int):
    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            out = []
            for first, last in blocks(offsets):
                at = offsets[first : last + 1] - offsets[first]
                place, gram, _, _ = samples(raw[offsets[first] : offsets[last]], at, length)
                row = np.searchsorted(at, place, "right") - 1
                out.append((gram.view(np.int64), row + first, place - at[row]))
            gram, row, place = (np.concatenate([x[k] for x in out] or [np.zeros(0, np.int64)]) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(gram), batch.column(0).take(pa.array(row)), pa.array(place)], names=["gram", "id", "place"])

    return run


def _context_batches(length: int):
    left = length - GRAM

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            wanted = batch.column(3)
            for first, last in blocks(offsets):
                at = offsets[first : last + 1] - offsets[first]
                data = raw[offsets[first] : offsets[last]]
                place, gram, lo, hi = samples(data, at, length)
                row = np.searchsorted(at, place, "right") - 1
                lists = wanted.slice(first, last - first)
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                codes = lists.flatten().to_numpy(zero_copy_only=False)
                want = (codes & ((1 << PLACE_BITS) - 1)) + at[np.repeat(np.arange(last - first), np.diff(ends))]
                # Texts of one id share a list: what is no sample of this text is passed over.
                which = np.searchsorted(place, want)
                keep = np.append(place, -1)[which] == want
                which, salts = which[keep], (codes[keep] >> PLACE_BITS).astype(np.int32)
                place, gram, lo, hi, row = place[which], gram[which], lo[which], hi[which], row[which]
                padded = np.concatenate([np.zeros(left, np.uint8), data, np.zeros(length, np.uint8)])
                for k in range(0, len(place), 4096):
                    s = slice(k, k + 4096)
                    context = padded[place[s, None] + np.arange(left + length)]
                    rows = pa.array(row[s] + first)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram[s].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place[s] - at[row[s]]), pa.array((place[s] - hi[s]).astype(np.int32)), pa.array((place[s] - lo[s]).astype(np.int32)), pa.array([x.tobytes() for x in context], pa.binary()), pa.array(salts[s])],
                        names=["gram", "id", "th", "place", "near", "far", "context", "salts"],
                    )

    return run


def _names(columns: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows of keys, equal for equal rows."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _collapse(table: pa.Table, length: int) -> tuple[pa.Table, pa.Table]:
    """Spans of the rows that repeat one of smaller id in all their windows, and the other rows."""
    ids, th, place, near, far = (table.column(c).to_numpy() for c in ("id", "th", "place", "near", "far"))
    reach = np.stack([near, far], axis=1).astype(np.int32).tobytes()
    keys = np.array([c + reach[8 * i : 8 * i + 8] for i, c in enumerate(table.column("context").to_pylist())], f"V{2 * length - GRAM + 8}")
    _, group = np.unique(keys, return_inverse=True)
    least = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    hit = ids > least[group]
    spans = pa.table({"id": ids[hit], "th": th[hit], "lo": place[hit] - far[hit], "hi": place[hit] - near[hit] + length})
    return spans, table.filter(pa.array(~hit))


def _deal_groups(length: int):
    """Spans of the grams that are whole here; of salted ones, the spans and rows of ``_collapse``."""
    sort = _repeat_groups(length)
    names = ["id", "th", "lo", "hi", "gram", "place", "near", "far", "context"]

    def full(table: pa.Table) -> pa.Table:
        types = {"near": pa.int32(), "far": pa.int32(), "context": pa.binary()}
        return pa.table({c: table.column(c) if c in table.column_names else pa.nulls(table.num_rows, types.get(c, pa.int64())) for c in names})

    def run(table: pa.Table) -> pa.Table:
        salted = table.column("salts").to_numpy() > 1
        whole = table.filter(pa.array(~salted))
        out = [full(sort(whole))] if whole.num_rows else []
        if salted.any():
            out += map(full, _collapse(table.filter(pa.array(salted)), length))
        return pa.concat_tables(out)

    return run


def _repeat_groups(length: int):
    left = length - GRAM
    words = -(-length // 8)

    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        gram, ids, th, place, near, far = (table.column(c).to_numpy() for c in ("gram", "id", "th", "place", "near", "far"))
        context = np.frombuffer(b"".join(table.column("context").to_pylist()), np.uint8).reshape(n, left + length)
        right = np.zeros((n, words * 8), np.uint8)
        right[:, :length] = context[:, left:]
        keys = list(right.view(">u8").astype(np.uint64).T)
        # Triples of blocks get names, triples of names get names, until one is left.
        while len(keys) > 1:
            keys = [_names(keys[k : k + 3]) for k in range(0, len(keys), 3)]
        order = np.lexsort([keys[0], gram])
        gram, ids, th, place, near, far, context, right = (x[order] for x in (gram, ids, th, place, near, far, context, right))
        same = right[1:, :length] == right[:-1, :length]
        prefix = np.concatenate([[-1], np.where(same.all(axis=1), length, same.argmin(axis=1))])
        prefix[1:][gram[1:] != gram[:-1]] = -1
        before = np.zeros(n, np.int64)  # names of the bytes between a window's start and its sample
        found = []
        for back in range(left + 1):
            here = (near <= back) & (back <= far)
            if here.any():
                rank = np.cumsum(prefix < length - back)
                _, group = np.unique(before[here] * (n + 2) + rank[here], return_inverse=True)
                least = np.full(group.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, group, ids[here])
                hit = ids[here] > least[group]
                found.append(np.stack([ids[here][hit], th[here][hit], place[here][hit] - back]))
            if back < left:
                _, before = np.unique(before * 256 + context[:, left - 1 - back], return_inverse=True)
        ids, th, start = np.concatenate(found or [np.zeros((3, 0), np.int64)], axis=1)
        order = np.lexsort([start, th, ids])
        ids, th, start = ids[order], th[order], start[order]
        if not len(ids):
            return pa.table({k: pa.array([], pa.int64()) for k in ("id", "th", "lo", "hi")})
        new = np.concatenate([[True], (np.diff(ids) != 0) | (np.diff(th) != 0) | (np.diff(start) > length)])
        at = np.flatnonzero(new)
        return pa.table({"id": ids[at], "th": th[at], "lo": start[at], "hi": start[np.append(at[1:], len(ids)) - 1] + length})

    return run


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside the union of the spans, and the number of maximal spans."""
    kept, at, count = [], 0, 0
    for lo, hi in sorted(spans):
        if count == 0 or lo > at:
            kept.append(raw[at:lo])
            count += 1
        at = max(at, hi)
    kept.append(raw[at:])
    return b"".join(kept), count


def _cut_batches(with_bytes: bool):
    def run(batches):
        for batch in batches:
            out = []
            for text, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("text", "lo", "hi")), strict=True):
                raw = text.encode()
                kept, count = _cut(raw, list(zip(lo, hi, strict=True)))
                out.append((len(raw), len(raw) - len(kept), count, hashlib.sha256(kept).hexdigest(), kept))
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 4 + with_bytes]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t, _ in zip(columns, types, names, strict=False))], names=["id", "th", *names])

    return run


def _crowded_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Spans (id, th, lo, hi) that repeat, of samples whose grams stay crowded.

    A row with the bytes, and the reach, of a row of smaller id repeats in all its windows.
    The windows of the others are compared by digest; every table that a hot
    key is joined with is stored first, so that skewed partitions are split.
    """
    left = length - GRAM
    crowd = stored(contexts.drop("gram").withColumn("around", F.unhex(F.md5("context"))), "crowd")
    same = ["around", "near", "far"]
    heads = stored(crowd.groupBy(*same).agg(F.min("id").alias("head")), "heads")
    marked = stored(crowd.join(heads, same).drop("around"), "marked")
    whole = marked.where("id > head").select("id", "th", (F.col("place") - F.col("far")).alias("lo"), (F.col("place") - F.col("near") + length).alias("hi"))
    rows = marked.where("id = head").select("id", "th", "place", "context", F.explode(F.sequence("near", "far")).alias("back"))
    window = F.col("context").substr(F.lit(left + 1) - F.col("back"), F.lit(length))
    windows = rows.select("id", "th", (F.col("place") - F.col("back")).alias("lo"), F.unhex(F.md5(window)).alias("key"))
    least = stored(windows.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("key", "least"), "least")
    hits = windows.join(least, "key").where("id > least").select("id", "th", "lo", (F.col("lo") + length).alias("hi"))
    return whole.union(hits)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, with_bytes: bool = True) -> DataFrame:
    """Cut every byte covered by a ``length``-byte string that also starts in a document of smaller id.

    Returns one row per row: the id (long), ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs), ``kept_sha256`` and, with ``with_bytes``, ``kept``
    (the remaining bytes, which may not be whole code points).  Strings are
    judged on the input, may overlap, and never cross documents.  A null text is empty; rows of one
    id are one document and lose nothing to each other; rows with a null id
    stay whole and count for no other row.

    Exact copies of a text are found by digest and partial aggregation and lose all their bytes (texts of
    ``length`` bytes or more); they don't take part in the sort.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    keyed = base.where(F.col("id").isNotNull() & (F.octet_length("text") >= length))
    digests = keyed.select("id", "th", F.xxhash64(F.lit(1), "text").alias("t2"), F.octet_length("text").alias("n"))
    firsts = digests.groupBy("th", "t2", "n").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    firsts = stored(firsts, "firsts")
    copies = stored(digests.join(firsts, ["th", "t2", "n"]).where("id > first").select("id", "th", F.col("n").cast("long").alias("n")).distinct(), "copies")
    found = stored(keyed.select("id", "text").mapInArrow(_sample_batches(length), "gram long, id long, place long"), "samples")
    held = found.groupBy("gram").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("holders")).where("lo < hi")
    held = stored(held.select("gram", F.ceil(F.col("holders") / CROWDED_GRAM).alias("salts"), "holders"), "held")
    code = F.shiftleft("salts", PLACE_BITS).bitwiseOR(F.col("place"))
    wanted = found.join(held.select("gram", "salts"), "gram").groupBy("id").agg(F.collect_set(code).alias("places"))
    copied = copies.groupBy("id").agg(F.collect_set("th").alias("copied"))
    wanted = stored(wanted.join(copied, "id", "left"), "wanted")
    discard(found)
    texts = keyed.select("id", "th", "text").join(wanted.hint("shuffle_hash"), "id").where(~F.coalesce(F.array_contains("copied", F.col("th")), F.lit(False)))
    texts = stored(texts.select("id", "th", "text", "places"), "texts")
    discard(wanted)
    rows, most = held.agg(F.coalesce(F.sum("holders"), F.lit(0)), F.coalesce(F.max("salts"), F.lit(1))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, -(-rows // TASK_ROWS))
    salt = F.pmod(F.xxhash64("id", "place"), F.col("salts"))
    around = texts.mapInArrow(_context_batches(length), f"{CONTEXT}, salts int").withColumn("part", F.pmod(F.xxhash64("gram", salt), F.lit(parts)))
    span = "id long, th long, lo long, hi long"
    spans = around.groupBy("part").applyInArrow(_deal_groups(length), f"{span}, gram long, place long, near int, far int, context binary")
    if most > 1:
        dealt = stored(spans, "dealt")
        spans, left = dealt.where("context IS NULL"), dealt.where("context IS NOT NULL").select("gram", "id", "th", "place", "near", "far", "context")
        crowded = stored(left.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED_GRAM).select("gram"), "crowded")
        few = left.join(crowded, "gram", "left_anti").withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(parts)))
        spans = spans.select("id", "th", "lo", "hi").union(few.groupBy("part").applyInArrow(lambda t: _repeat_groups(length)(t.drop(["part"])), span))
        if not crowded.isEmpty():
            spans = spans.union(_crowded_spans(left.join(crowded, "gram", "left_semi"), length))
    cuts = stored(spans.groupBy("id", "th").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")), "cuts")
    # Only texts with a shared sample can lose a part; whole rows keep or lose all.
    schema = "id long, th long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    parted = texts.select("id", "th", "text").join(cuts, ["id", "th"]).select("id", "th", "text", "lo", "hi").dropDuplicates(["id", "th"]).mapInArrow(_cut_batches(with_bytes), schema)
    gone = copies.select("id", "th", F.col("n").alias("n_bytes"), F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"), *([F.lit(b"").alias("kept")] if with_bytes else []))
    changed = stored(parted.union(gone), "changed").select("id", "th", *(F.col(c).alias(f"c_{c}") for c in ("n_removed", "n_spans", "kept_sha256", *(["kept"] * with_bytes))))
    raw = F.col("text").cast("binary")
    rows = base.select("id", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha"), *([raw.alias("raw")] if with_bytes else []))
    joined = rows.join(changed, ["id", "th"], "left")
    zero = lambda c: F.coalesce(f"c_{c}", F.lit(0)).cast("long").alias(c)
    return joined.select(F.col("id").alias(id_col), "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("c_kept_sha256", "sha").alias("kept_sha256"), *([F.coalesce("c_kept", "raw").alias("kept")] if with_bytes else []))
