"""Near-duplicate groups by min-max hashing and exact verification.

Every permutation is evaluated once and both its minimum and its maximum are
kept, so 64 evaluations give 128 slots.  Bands of four slots (minima with
minima, maxima with maxima) name the candidates; a pair at the threshold 0.8
shares no band with probability (1 - 0.8**4)**32, about 5e-8.  Every link is
confirmed on the full shingle sets.

Texts with one and the same shingle set form a class, found by a 128-bit digest
and its size with partial aggregation; only one representative of a class goes
on, so copies cost nothing further.  In a bucket, each member is first compared
with one leader, the member that shares most buckets.  What these stars leave in different components is
then compared across components: pair by pair in small buckets, and in
large ones by blocks of rows against blocks, which send back links only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import arrow_batches, discard, stored
from .textkit import mix, shingle_sets

PERMUTATIONS = 64
BAND_ROWS = 4
#: Of 128 one-bit samples of the slots, a pair at 0.8 differs in 12.8 (sigma 3.4).
MAX_BIT_DISTANCE = 32
#: Sets below this size are not screened by bits: their slots depend on each other.
SCREENED_SIZE = 24

#: Buckets of the table that counts shingles of crowds (2 MB).
COUNT_BUCKETS = 1 << 18
#: Open buckets up to this size are compared pair by pair; the members of larger ones by their rarest shingles.
SMALL_BUCKET = 32

SIGNATURE = "n_shingles long, d1 long, d2 long, s1 long, s2 long, bands array<long>"


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return (seeds[:PERMUTATIONS] | np.uint64(1))[:, None], seeds[PERMUTATIONS:][:, None]


def min_max(shingles: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 minima and then 64 maxima of one non-empty set."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(PERMUTATIONS, dtype=np.uint64)
    for k in range(0, len(shingles), 2048):
        drawn = shingles[None, k : k + 2048] * multipliers + offsets
        np.minimum(low, drawn.min(axis=1), out=low)
        np.maximum(high, drawn.max(axis=1), out=high)
    return np.concatenate([low, high])


def _signature_batches(width: int):
    def run(batches):
        multipliers, offsets = _permutations()
        weights = mix(np.arange(1, BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
        n_bands = 2 * PERMUTATIONS // BAND_ROWS
        for batch in batches:
            rows = batch.num_rows
            sizes = np.zeros(rows, np.int64)
            out = np.zeros((rows, 4), np.uint64)
            bands = np.zeros((rows, n_bands), np.uint64)
            for i, found in shingle_sets(batch.column(1), width):
                sizes[i] = len(found)
                if not len(found):
                    continue
                slots = min_max(found, multipliers, offsets)
                out[i, :2] = _digest(found)
                low = (mix(slots) & np.uint64(1)) * np.tile(bits, 2)
                out[i, 2:] = low.reshape(2, 64).sum(axis=1, dtype=np.uint64)
                bands[i] = mix((slots.reshape(n_bands, BAND_ROWS) * weights).sum(axis=1, dtype=np.uint64))
            count = np.where(sizes > 0, n_bands, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(bands[sizes > 0].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), *(pa.array(np.ascontiguousarray(out[:, k]).view(np.int64)) for k in range(4)), lists],
                names=["id", "n_shingles", "d1", "d2", "s1", "s2", "bands"],
            )

    return run


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Set size, set digest, sampled slot bits and band keys of each row."""
    arrow_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(_signature_batches(width), f"id long, {SIGNATURE}")


def _digest(found: np.ndarray) -> tuple[int, int]:
    return mix(found).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)))


def _set_batches(width: int):
    """Rows (rep, text, d1, d2) to the sets of the texts that have the digest."""

    def run(batches):
        for batch in batches:
            reps, d1, d2 = (batch.column(k).to_numpy() for k in (0, 2, 3))
            keep, sets = [], []
            for i, found in shingle_sets(batch.column(1), width):
                if len(found) and tuple(x.view(np.int64) for x in _digest(found)) == (d1[i], d2[i]):
                    keep.append(i)
                    sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(reps[keep], pa.int64()), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return run


def _bucket_counts(batches):
    """(bucket, n) of the shingles of sets, added up over a batch."""
    for batch in batches:
        found = [np.frombuffer(x.as_buffer(), np.uint64) & np.uint64(COUNT_BUCKETS - 1) for x in batch.column(0)]
        bucket, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(n.astype(np.int64))], names=["bucket", "n"])


def _prefix_batches(counts: np.ndarray, percent: int):
    """Rows (rep, component, away, n, shingles) to the shingles that come first, from the rarest, with their places.

    ``short`` marks those that count where this is the smaller set of a pair.
    """

    def run(batches):
        for batch in batches:
            out = []
            for i, blob in enumerate(batch.column(4)):
                h = np.frombuffer(blob.as_buffer(), np.uint64)
                held = counts[(h & np.uint64(COUNT_BUCKETS - 1)).astype(np.int64)]
                n = len(h)
                first = np.lexsort([h, held])[: n + (-n * percent // 100) + 1]
                short = n + (-n * 2 * percent // (100 + percent)) + 1
                at = np.flatnonzero(held[first] > 1)  # what one set alone holds meets nothing
                out.append((np.full(len(at), i), at + 1, at < short, h[first[at]]))
            row, pos, short, h = (np.concatenate([x[k] for x in out] or [np.zeros(0, np.int64)]) for k in range(4))
            named = batch.select(["rep", "component", "away", "n"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*named.columns, pa.array(pos.astype(np.int64)), pa.array(short.astype(bool)), pa.array(h.astype(np.uint64).view(np.int64))], names=["rep", "component", "away", "n", "pos", "short", "h"])

    return run


def _confirm_batches(percent: int):
    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(a) + len(b) - common)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(keep))

    return run


def _screen(percent: int):
    """Lossless test of sizes and the test of sampled bits, for sides a and b."""
    apart = F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1"))) + F.bit_count(F.col("a.s2").bitwiseXOR(F.col("b.s2")))
    sizes = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    return sizes & ((F.least("a.n", "b.n") < SCREENED_SIZE) | (apart <= MAX_BIT_DISTANCE))


def _sets(reps: DataFrame, classes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The shingle sets of representatives, from a row with the class's id whose text has the class's digest."""
    need = reps.distinct().join(classes.select("rep", F.col("class_id").alias("id"), "d1", "d2"), "rep")
    found = texts.join(need, "id").select("rep", "text", "d1", "d2").mapInArrow(_set_batches(width), "rep long, shingles binary")
    return stored(found.dropDuplicates(["rep"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold."""
    both = pairs.join(sets.select(F.col("rep").alias("u"), F.col("shingles").alias("su")), "u")
    both = both.join(sets.select(F.col("rep").alias("v"), F.col("shingles").alias("sv")), "v").select("u", "v", "su", "sv")
    return both.mapInArrow(_confirm_batches(percent), "u long, v long")


def _across_crowds(crowds: DataFrame, first: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) across components, among the members of large buckets, that may reach the threshold; none that does is missing.

    Shingles are ordered from the rarest.  Sets of a <= b shingles at the threshold t share at least
    t / (1 + t) * (a + b) of them, at least 2t / (1 + t) * a and t * b; so a shingle among the first
    a - 2t / (1 + t) * a + 1 of the one and the first b - t * b + 1 of the other is common, and what follows the first common one bounds the rest.
    Members of the component of their leader are not compared with each other.
    """
    home = first.select(F.col("node").alias("lead"), F.col("component").alias("home"))
    away = F.max(F.col("component") != F.coalesce("home", "lead"))
    members = stored(crowds.join(home, "lead", "left").groupBy("rep", "component", "n").agg(away.alias("away")), "members")
    # Any order that depends on shingles alone loses no pair; counts by bucket, of a fixed number, put common ones last.
    counts = np.zeros(COUNT_BUCKETS, np.int64)
    found = sets.select("shingles").mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    whole = members.join(sets, "rep").select("rep", "component", "away", "n", "shingles")
    entries = stored(whole.mapInArrow(_prefix_batches(counts, percent), "rep long, component long, away boolean, n long, pos long, short boolean, h long"), "entries")
    a, b = entries.where("short").alias("a"), entries.alias("b")
    ordered = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.rep") < F.col("b.rep")))
    sizes = 100 * F.col("a.n") >= percent * F.col("b.n")
    rest = (100 + percent) * (1 + F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))) >= percent * (F.col("a.n") + F.col("b.n"))
    apart = (F.col("a.component") != F.col("b.component")) & (F.col("a.away") | F.col("b.away"))
    met = a.join(b, (F.col("a.h") == F.col("b.h")) & ordered & sizes & rest & apart)
    return met.select(F.greatest("a.rep", "b.rep").alias("u"), F.least("a.rep", "b.rep").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """Groups of texts linked by ``100 * |A & B| >= percent * |A | B|`` over their shingle sets.

    Returns one row per input row: the id (long), ``n_shingles``, ``class_id`` (the smallest id
    with the same set), ``n_links`` (confirmed links of the class representative to
    other classes' representatives that were needed to join the groups), ``component_id``
    (smallest id reachable) and ``kept`` (id = component_id).

    Null and empty texts, and texts without words, have an empty set and link
    with nothing.  Repeated rows of one id and text are returned as often as
    they come; rows of one id with different texts are one document whose
    links are those of any of them.  Rows with a null id are returned with
    null ``component_id`` and ``kept`` true.  Extra columns of the input are ignored.
    """
    marked = stored(signatures(docs, id_col, text_col, width), "signatures")
    keyed = marked.where("id IS NOT NULL AND n_shingles > 0")
    classes = keyed.groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("class_id"), F.min(F.struct("id", "s1", "s2", "bands")).alias("r"))
    # Two classes may have one id as their least: a number of its own names each representative.
    classes = stored(classes.select(F.monotonically_increasing_id().alias("rep"), "d1", "d2", "n_shingles", "class_id", "r.s1", "r.s2", "r.bands"), "classes")
    reps = classes.select("rep", F.col("n_shingles").alias("n"), "s1", "s2", F.posexplode("bands").alias("band", "key"))
    # Buckets of one member name no pair.
    sizes = reps.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1")
    shared = stored(reps.join(sizes, ["band", "key"]), "shared")
    # The member with most company leads: the original of a group shares more buckets than its copies do with each other.
    company = shared.groupBy("rep").agg(F.sum("m").alias("company"))
    leads = shared.join(company, "rep").groupBy("band", "key").agg(F.max(F.struct("company", (-F.col("rep")).alias("order"), "rep", "n", "s1", "s2")).alias("lead")).select("band", "key", "lead.*")
    members = stored(shared.drop("m").join(leads.select("band", "key", F.col("rep").alias("lead"), F.col("n").alias("lead_n"), F.col("s1").alias("lead_s1"), F.col("s2").alias("lead_s2")), ["band", "key"]), "members")
    discard(shared)
    a = members.where("rep <> lead").select(F.struct("rep", "n", "s1", "s2").alias("a"), F.struct(F.col("lead").alias("rep"), F.col("lead_n").alias("n"), F.col("lead_s1").alias("s1"), F.col("lead_s2").alias("s2")).alias("b"))
    ordered = [F.greatest("a.rep", "b.rep").alias("u"), F.least("a.rep", "b.rep").alias("v")]
    stars = stored(a.where(_screen(percent)).select(*ordered).distinct(), "stars")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ends = lambda pairs: pairs.select(F.explode(F.array("u", "v")).alias("rep"))
    links = stored(_confirmed(stars, _sets(ends(stars), classes, texts, width), percent), "links")
    first = stored(connected_components(links), "first")
    # Buckets that still hold two components: what lies across components is compared.
    placed = members.select("band", "key", "lead", "rep", "n", "s1", "s2").join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    split = placed.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")).where("low < high").select("band", "key", "m")
    open_ = stored(placed.join(split, ["band", "key"]), "open")
    discard(members)
    small = open_.where(F.col("m") <= SMALL_BUCKET)
    across = small.alias("a").join(small.alias("b"), (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") > F.col("b.rep")) & (F.col("a.component") != F.col("b.component")) & _screen(percent))
    rest = across.select(*ordered)
    crowds = stored(open_.where(F.col("m") > SMALL_BUCKET).select("lead", "rep", "component", "n").distinct(), "crowds")
    if not crowds.isEmpty():
        rest = rest.union(_across_crowds(crowds, first, _sets(crowds.select("rep"), classes, texts, width), percent))
    rest = stored(rest.distinct().join(stars, ["u", "v"], "left_anti"), "rest")
    more = links
    if not rest.isEmpty():
        more = stored(links.union(_confirmed(rest, _sets(ends(rest), classes, texts, width), percent)), "links")
    # Ids that several texts share are one document: tie the classes they are in.
    several = keyed.select("id", "d1", "d2", "n_shingles").distinct()
    multi = several.groupBy("id").count().where("count > 1").select("id")
    tied = several.join(multi, "id", "left_semi").join(classes.select("rep", "d1", "d2", "n_shingles"), ["d1", "d2", "n_shingles"]).select("id", "rep")
    tied = tied.join(tied.groupBy("id").agg(F.min("rep").alias("v")), "id").select(F.col("rep").alias("u"), "v")
    groups = stored(connected_components(more.union(tied)), "groups")
    n_links = more.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    grouped = stored(groups.select(F.col("node").alias("rep"), F.col("component").alias("root")).join(classes.select("rep", "class_id"), "rep"), "grouped")
    least = grouped.groupBy("root").agg(F.min("class_id").alias("component"))
    named = grouped.join(least, "root").select("rep", "component")
    heads = classes.select("rep", "d1", "d2", "n_shingles", "class_id").join(named, "rep", "left").join(n_links, "rep", "left")
    heads = stored(heads.select("d1", "d2", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "heads")
    joined = marked.select("id", "n_shingles", "d1", "d2").join(heads, ["d1", "d2", "n_shingles"], "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), own).alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"), F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its group; all columns stay.

    Rows with a null id and rows without words are kept.  Repeated rows of a
    kept document collapse to one.
    """
    gone = stored(near_duplicates(docs, id_col, text_col, width, percent).where(~F.col("kept")).select(id_col).distinct(), "gone")
    kept = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    repeated = stored(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col), "repeated")
    if repeated.isEmpty():
        return kept
    first = kept.join(repeated, id_col, "left_semi").select(id_col, F.struct(F.xxhash64(text_col), F.struct(*docs.columns)).alias("row")).groupBy(id_col).agg(F.min("row").alias("row"))
    return kept.join(repeated, id_col, "left_anti").select(*docs.columns).union(first.select("row.col2.*"))
