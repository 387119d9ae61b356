"""Periodic runs of words, by the linear method for tandem repeats of Gusfield and Stoye.

The suffix tree of a block of documents is kept as arrays: suffixes in order, and the names of all windows of 1, 2, 4, ... words,
which answer how far two places agree forwards and backwards.  A node of the tree is an interval of the order.  The method then goes in its three steps.

1. Lempel-Ziv blocks.  The leftmost copy of every square (a word string twice in a row) touches two blocks, so comparing
   each block's border with the places before and behind it finds squares that cover all leftmost ones.
2. From each of them the walk along suffix links, one word on at a time while a square remains, completes the
   vocabulary: all distinct squares, those with a primitive root.
3. The interval of a square holds all places where it stands; places in a row with one period merge into a run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import arrow_batches

#: Documents are worked on together up to so many words; a longer one is worked on alone.
BLOCK_WORDS = 150_000
#: Pairs that are compared at once.
CHUNK_PAIRS = 2_000_000
RUN = "struct<start: long, length: long, period: long>"


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Suffixes:
    """Sorted suffixes of sequences of symbols that share no symbol, laid end to end.

    ``names[k]`` gives equal numbers to places whose next ``2**k`` symbols are equal; windows that meet an end equal no other.
    In the last of them all differ: it is the rank of each suffix, and ``order`` its inverse.  A name is the first rank of its bearers.
    """

    def __init__(self, symbols: np.ndarray):
        n = self.size = len(symbols)
        order = np.argsort(symbols)
        name, tied = self._named(order, symbols[order], np.zeros(n, np.int64))
        self.names, width = [name], 1
        while len(tied):
            name = name.copy()
            then = np.minimum(tied + width, n)
            key = name[tied].astype(np.int64) * (n + 2) + name[then] + 1
            by = np.argsort(key)
            key, tied = key[by], tied[by]
            base = name[tied].astype(np.int64)
            opens = np.ones(len(base), bool)
            opens[1:] = base[1:] != base[:-1]
            at = np.arange(len(base))
            name, tied = self._named(tied, key, base - np.maximum.accumulate(np.where(opens, at, 0)), name)
            self.names.append(name)
            width *= 2
        self.rank = name[:n]
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)

    @staticmethod
    def _named(places, keys, shift, name=None):
        """Names of places that are sorted by keys, and the places that share theirs."""
        n = len(places)
        if name is None:
            name = np.full(n + 1, -1, np.int32)  # the place behind the end equals none
        opens = np.ones(n + 1, bool)
        opens[1:n] = keys[1:] != keys[:-1]
        first = np.maximum.accumulate(np.where(opens[:n], np.arange(n), 0))
        name[places] = first + shift
        return name, places[~(opens[:n] & opens[1:])]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on are equal; i and j differ and may be the end."""
        top, live = np.full(len(i), -1, np.int64), np.arange(len(i))
        for k, name in enumerate(self.names):
            live = live[name[i[live]] == name[j[live]]]
            if not len(live):
                break
            top[live] = k
        out = np.where(top >= 0, np.int64(1) << np.maximum(top, 0), 0)
        for k in range(int(top.max(initial=-1)) - 1, -1, -1):
            live = np.flatnonzero(top > k)
            name, n = self.names[k], out[live]
            same = name[np.minimum(i[live] + n, self.size)] == name[np.minimum(j[live] + n, self.size)]
            out[live[same]] += 1 << k
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to i and up to j, both included, are equal; i and j differ and may be -1."""
        top, live = np.full(len(i), -1, np.int64), np.arange(len(i))
        for k, name in enumerate(self.names):
            back = (1 << k) - 1
            live = live[np.minimum(i[live], j[live]) >= back]
            live = live[name[i[live] - back] == name[j[live] - back]]
            if not len(live):
                break
            top[live] = k
        out = np.where(top >= 0, np.int64(1) << np.maximum(top, 0), 0)
        for k in range(int(top.max(initial=-1)) - 1, -1, -1):
            live = np.flatnonzero(top > k)
            name, back = self.names[k], out[live] + (1 << k) - 1
            a, b = i[live] - back, j[live] - back
            same = (a >= 0) & (b >= 0)
            same &= name[a] == name[b]
            out[live[same]] += 1 << k
        return out


class Least:
    """Least values of stretches of an array, by stretches of 1, 2, 4, ... up to ``longest``."""

    def __init__(self, values: np.ndarray, longest: int):
        self.tables = [values]
        while 1 << len(self.tables) <= min(longest, len(values)):
            half, last = 1 << (len(self.tables) - 1), self.tables[-1]
            self.tables.append(np.minimum(last[:-half], last[half:]))

    def reach_down(self, at: np.ndarray, low: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The least p >= low so that values p to at - 1 are all over the limit."""
        at = at.copy()
        for k in range(len(self.tables) - 1, -1, -1):
            live = np.flatnonzero(at - (1 << k) >= low)
            good = live[self.tables[k][at[live] - (1 << k)] > limit[live]]
            at[good] -= 1 << k
        return at

    def reach_up(self, at: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The largest p <= high so that values at to p - 1 are all over the limit."""
        at = at.copy()
        for k in range(len(self.tables) - 1, -1, -1):
            live = np.flatnonzero(at + (1 << k) <= high)
            good = live[self.tables[k][at[live]] > limit[live]]
            at[good] += 1 << k
        return at


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its index ``count`` times, and the numbers ``first``, ``first + 1``, ... ."""
    at = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    return at, first[at] + nth


def lempel_ziv(tree: Suffixes) -> np.ndarray:
    """Borders of the blocks: each is the longest prefix of what is left that begins earlier too, or one new symbol."""
    n, order = tree.size, tree.order
    longest = np.ones(n, np.int64)
    low = tree.names[0][:n][order].astype(np.int64)  # by rank: the first rank with the same symbol
    size = np.bincount(low, minlength=n)
    rank = np.flatnonzero(size[low] > 1)
    if len(rank):
        least = Least(order, int(size.max()))
        place, low = order[rank], low[rank]
        high = low + size[low]
        # Of the suffixes that begin earlier, the one sorted nearest on either side agrees longest.
        down, up = least.reach_down(rank, low, place) - 1, least.reach_up(rank + 1, high, place)
        for near, there in ((down, down >= low), (up, up < high)):
            mine = place[there]
            longest[mine] = np.maximum(longest[mine], tree.ahead(order[near[there]], mine))
    step, at, borders = longest.tolist(), 0, []
    while at < n:
        borders.append(at)
        at += step[at]
    return np.array([*borders, n], np.int64)


def covering_repetitions(tree: Suffixes, borders: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of repetitions, as far as they go, that hold the leftmost copy of every square."""
    n, names = tree.size, tree.names[0]
    starts, sizes = borders[:-1], np.diff(borders)
    after = np.append(sizes[1:], 0)
    found = []

    def compare(here: np.ndarray, there: np.ndarray, with_left: bool) -> None:
        """Repetitions of period ``there - here`` across the two places; the left one is at the border or before it."""
        same = names[here] == names[there]
        if with_left:
            same &= names[here - 1] == names[there - 1]
        here, there = here[same], there[same]
        right, left = tree.ahead(here, there), tree.behind(here - 1, there - 1)
        good = right + left >= there - here
        here, there, right, left = here[good], there[good], right[good], left[good]
        found.append(np.stack([here - left, there + right, there - here], 1))

    reach = 2 * sizes + after
    cuts = np.searchsorted(np.cumsum(reach), np.arange(0, int(reach.sum()), CHUNK_PAIRS)[1:])
    for part in np.split(np.arange(len(starts)), np.unique(cuts)):
        # Squares that begin in the block and end behind it: the next border against places in the block.
        at, period = spread(np.ones(len(part), np.int64), sizes[part])
        border = borders[part + 1][at]
        compare(border - period, np.minimum(border, n), False)
        # Squares that begin before the block and have their middle in it: its border against what follows, up to the end of the next block.
        at, period = spread(np.ones(len(part), np.int64), sizes[part] + after[part])
        border = starts[part][at]
        compare(border, np.minimum(border + period, n), True)
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def primitive(tree: Suffixes, found: np.ndarray) -> np.ndarray:
    """The repetitions whose period is no multiple of a smaller one: for each prime divisor of it, the root is compared with itself."""
    if not len(found):
        return found
    left, good = found[:, 2].copy(), np.ones(len(found), bool)
    factor = least_factors(int(left.max()))
    while True:
        live = np.flatnonzero((left > 1) & good)
        if not len(live):
            return found[good]
        prime = factor[left[live]]
        start, period = found[live, 0], found[live, 2]
        part = period // prime
        good[live[tree.ahead(start, start + part) >= period - part]] = False
        left[live] //= prime


def least_factors(n: int) -> np.ndarray:
    """The least prime factor of every number to n."""
    out = np.arange(n + 1)
    for p in range(2, int(n**0.5) + 1):
        if out[p] == p:
            multiples = out[p * p :: p]
            multiples[multiples == np.arange(p * p, n + 1, p)] = p
    return out


def vocabulary(tree: Suffixes, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First rank, end rank and period of every distinct square: the suffix-link walk from the repetitions, and the interval of each place."""
    start, end, period = found.T
    at, place = spread(start, np.minimum(end - 2 * period - start + 1, period))
    period = period[at]
    shared = np.zeros(tree.size, np.int64)  # by rank: symbols shared with the suffix before
    same = np.flatnonzero(tree.names[0][tree.order[1:]] == tree.names[0][tree.order[:-1]]) + 1
    shared[same] = tree.ahead(tree.order[same - 1], tree.order[same])
    least = Least(shared, tree.size)
    rank, limit = tree.rank[place].astype(np.int64), 2 * period - 1
    low = least.reach_down(rank + 1, np.zeros(len(rank), np.int64), limit) - 1
    high = least.reach_up(rank + 1, np.full(len(rank), tree.size), limit)
    _, one = np.unique(low * (tree.size + 1) + period, return_index=True)
    return low[one], high[one], period[one]


def runs_of(symbols: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all maximal runs of at least two periods, by start and period."""
    none = np.zeros((0, 3), np.int64)
    if not len(symbols):
        return none
    tree = Suffixes(symbols)
    if len(tree.names) == 1:
        return none
    found = primitive(tree, covering_repetitions(tree, lempel_ziv(tree)))
    if not len(found):
        return none
    low, high, period = vocabulary(tree, found)
    at, rank = spread(low, high - low)
    place, period = tree.order[rank], period[at]
    by = np.lexsort((place, period))
    place, period = place[by], period[by]
    opens = np.ones(len(place), bool)
    opens[1:] = (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(place)) - 1
    out = np.stack([place[first], place[last] - place[first] + 2 * period[first], period[first]], 1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def block_runs(texts: list[list[bytes]], min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of documents given as words, with starts counted over all of them, and where each document begins."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    if not bounds[-1]:
        return np.zeros((0, 3), np.int64), bounds
    words = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode()
    # A word of another document is another symbol, so no run and no repeat crosses documents.
    symbols = np.repeat(np.arange(len(texts)), sizes) * len(words.dictionary) + words.indices.to_numpy()
    runs = runs_of(symbols)
    return runs[runs[:, 1] >= np.maximum(min_length, 2 * runs[:, 2])], bounds


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by blanks, without those that follow the first period of a run that holds them."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(w for w, c in zip(words, np.cumsum(change).tolist()) if c == 0)


def _row_blocks(texts: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    block, size = [], 0
    for words in texts:
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append(words)
        size += len(words)
    if block:
        yield block


def _found(batches, words: Callable, min_length: int):
    for batch in batches:
        rows = [[] if t is None else words(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        starts, lengths, periods, sizes, texts = [], [], [], [], []
        for block in _row_blocks(rows):
            runs, bounds = block_runs(block, min_length)
            cuts = np.searchsorted(runs[:, 0], bounds)
            sizes.append(np.diff(cuts))
            starts.append(runs[:, 0] - bounds[np.searchsorted(bounds, runs[:, 0], side="right") - 1])
            lengths.append(runs[:, 1])
            periods.append(runs[:, 2])
            for k, words_k in enumerate(block):
                mine = runs[cuts[k] : cuts[k + 1]] - [bounds[k], 0, 0]
                texts.append(collapse(words_k, mine))
        fields = [pa.array(np.concatenate(x), pa.int64()) for x in (starts, lengths, periods)]
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), pa.int32())
        runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in rows], pa.int64()), runs, pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])


def _plain(_: int | None, text: str) -> list[bytes]:
    return words_of(text)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 12, words: Callable[[int | None, str], list[bytes]] = _plain) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_words``, ``runs`` (array of start, length, period) and ``collapsed``.

    A run is a stretch of consecutive words with smallest period q and a length of at least ``min_length`` and 2 q that no
    neighbouring word extends; runs are sorted by start and period, and words are numbered from 0.  ``collapsed`` joins by one blank the words that no run holds
    after its first period.  ``words`` makes the words of an id and a text; the default splits at ASCII white space.

    A null or empty text has no word and no run, and an empty ``collapsed``.  Rows that repeat an id, and null ids, are rows like any other; a
    document of any length is one row and is worked on whole, in memory of some 60 bytes a word for each doubling of its longest
    repeat.  An empty table gives an empty one; other columns, clashing or not, are not looked at.  Nothing is shuffled.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(partial(_found, words=words, min_length=min_length), f"id long, n_words long, runs array<{RUN}>, collapsed string")
    return out.withColumnRenamed("id", id_col)
