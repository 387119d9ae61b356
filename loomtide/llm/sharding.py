"""Hierarchical weighted hash tree.

A key descends from the root to a region, a rack and a shard.  At each level
every child draws ``-ln(u) / weight`` from a hash of the key and the child's
own name, and the smallest draw wins.  A draw depends on no other child, so a
changed weight moves keys only into or out of the subtree that changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

#: A tree is {region: {rack: {shard: weight}}}; names are strings, shards ints.
Tree = dict[str, dict[str, dict[int, float]]]
#: Shards of the tree that other counts grow from or shrink from.
BASE = 8


def standard_tree(shards: int, fanout: int = 2) -> Tree:
    """``shards`` shards of weight 1, in regions of ``fanout`` racks of ``fanout`` shards."""
    tree: Tree = {}
    for s in range(shards):
        tree.setdefault(f"region{s // fanout**2}", {}).setdefault(f"rack{s // fanout % fanout}", {})[s] = 1.0
    return tree


def draw(key: Column, node: str) -> Column:
    """A number in (0, 1) from 52 bits of a hash of the key and the node's name."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{node}"))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def _choice(key: Column, options: list[tuple[str, float, Column]]) -> Column:
    """The value of the option with the smallest weighted draw; ties go to the first."""
    if len(options) == 1:
        return options[0][2]
    scores = [F.struct((-F.log(draw(key, name)) / F.lit(weight)).alias("score"), F.lit(i).alias("i")) for i, (name, weight, _) in enumerate(options)]
    won = F.least(*scores).getField("i")
    out = F.when(won == 0, options[0][2])
    for i, (_, _, value) in enumerate(options[1:], 1):
        out = out.when(won == i, value)
    return out


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key.  A null key is the key "" ; subtrees without weight take nothing."""
    key = F.coalesce(key.cast("string"), F.lit(""))

    def level(name: str, node) -> Column | None:
        options = []
        for child, below in node.items():
            weight = _weight(below)
            if weight > 0:
                path = f"{name}/{child}"
                value = level(path, below) if isinstance(below, dict) else F.lit(int(child)).cast("int")
                options.append((path, float(weight), value))
        if not options:
            raise ValueError("the tree has no weight")
        return _choice(key, options)

    return level("", tree)


def place_among(key: Column, shards: int, base: int = BASE) -> Column:
    """The shard of a key among ``shards`` of weight 1; one more shard only takes keys into itself, at every count.

    The standard tree of ``base`` shards decides first.  Each shard beyond it draws against the
    whole tree that was there before, and takes the keys that it wins.  Of fewer shards, the keys of
    those that are missing descend anew, from the last shard to the first missing one, through the tree of the shards before it.
    The cost grows with the distance of ``shards`` from ``base``.
    """
    if shards < 1:
        raise ValueError("no shards")
    key = F.coalesce(key.cast("string"), F.lit(""))
    out = place(key, standard_tree(base))
    for s in range(base, shards):
        out = _choice(key, [(f"/tree{s}", float(s), out), (f"/added/rack0/{s}", 1.0, F.lit(s).cast("int"))])
    for s in range(base - 1, shards - 1, -1):
        out = F.when(out == s, place(F.concat(key, F.lit(f"|without{s}")), standard_tree(s))).otherwise(out)
    return out


def _weight(node) -> float:
    return sum(_weight(x) for x in node.values()) if isinstance(node, dict) else float(node)


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tree: Tree | None = None, grown: Tree | None = None, base: int = BASE) -> DataFrame:
    """Place every row; number the rows of each shard from 0 without gaps, in order of id.

    Returns id (long), ``size`` (UTF-8 bytes plus 1; a null text has none),
    ``text_crc32`` (a null text as the empty one), ``law`` ("key"), ``shard``,
    ``slot`` and ``grown_shard`` (the place after one more shard).  The id and
    the tree alone decide the shard, so rows of one id share one; a null id
    is a key of its own.  Ties of id are numbered by size, checksum and row.
    Extra columns are ignored; an empty table gives no rows.  Trees of the caller's own replace the
    standard one; a changed weight there moves keys only into or out of its subtree.

    Slots come from a range repartition by (shard, id, ..., row), which
    splits even a repeated id, and from offsets of one row per partition and shard.
    """
    text = F.col(text_col).cast("string")
    key = F.col(id_col).cast("long")
    rows = docs.select(
        key.alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        (place(key, tree) if tree else place_among(key, shards, base)).alias("shard"),
        (place(key, grown) if grown else place_among(key, shards + 1, base)).alias("grown"),
        F.monotonically_increasing_id().alias("row"),
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["shard", "id", "size", "crc", "row"]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = stored(placed.select("id", "size", "crc", "shard", "grown", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("nth")), "shards")
    runs = placed.groupBy("part", "shard").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("part", "shard", (earlier - F.col("first")).alias("shift"))
    return placed.join(starts, ["part", "shard"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", (F.col("nth") + F.col("shift")).alias("slot"), F.col("grown").alias("grown_shard")
    )
