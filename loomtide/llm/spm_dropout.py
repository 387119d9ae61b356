"""SentencePiece merges with seeded dropout, and lossless decoding.

The agenda of a chunk (blanks and the word after them) holds every adjacent pair whose
union is a piece.  The best candidate, by score and then from the left, is merged, unless the keyed hash
of (seed, document, number of the chunk in it, chunk, place, piece) skips it; a skipped candidate never comes back.
Each distinct chunk of a block is merged once without skips; every occurrence draws for the merges made
there, and one that skips any of them is merged on its own.  The chunks are processed together,
one merge of each chunk at a time; very long chunks use a heap, with the same result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import arrow_batches
from .textkit import blocks, mix, span_hashes, utf8

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
ESCAPED = 0x110000  # stands for a U+2581 of the text itself, which only bytes can carry
LONG_CHUNK = 48
BLOCK = 2 << 20
OWN_CHUNKS = 1 << 16  # chunks merged on their own at a time, so that their arrays stay in the cache
_M64 = (1 << 64) - 1


@dataclass
class Pieces:
    """Tables of a vocabulary; small arrays that travel with the tasks."""

    n: int
    chars: np.ndarray  # code points that are pieces
    char_ids: np.ndarray
    pairs: np.ndarray  # left * n + right, sorted
    merged: np.ndarray
    ranks: np.ndarray
    byte_ids: np.ndarray
    surface: bytes  # bytes of all pieces, U+2581 as a space
    ends: np.ndarray


def load_pieces(path: str = DEFAULT_MODEL) -> Pieces:
    """Read a SentencePiece merge model with byte fallback.

    Raises ValueError where the model has no byte pieces, normalises text, or has a piece in
    which a blank follows another character, as such pieces would cross chunks.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain, byte_ids, surface = {}, np.full(256, -1, np.int32), []
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            surface.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            surface.append(b"")
        else:
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"piece {i} has a blank after another character")
            plain[piece] = i
            surface.append(piece.replace("▁", " ").encode())
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback")
    order = sorted({sp.get_score(i) for i in plain.values()}, reverse=True)
    rank = {score: k for k, score in enumerate(order)}
    found = sorted((plain[p[:k]] * n + plain[p[k:]], i, rank[sp.get_score(i)]) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain)
    single = [(ord(p), i) for p, i in plain.items() if len(p) == 1]
    pairs, merged, ranks = (np.array(x, t) for x, t in zip(zip(*found, strict=True), (np.int64, np.int32, np.int64), strict=True))
    return Pieces(n, *(np.array(x, np.int32) for x in zip(*single, strict=True)), pairs, merged, ranks, byte_ids, b"".join(surface), np.cumsum([0, *map(len, surface)]))


class Coder:
    """Encodes and decodes blocks of rows."""

    def __init__(self, pieces: Pieces, dropout: float, seed: int, variants: int = 0):
        """With ``variants`` over 0, draws tell only so many classes of document and chunk number apart; no query asks for that."""
        self.p, self.limit = pieces, int(dropout * 2**64)
        self.seed, self.variants = np.uint64(seed & _M64), np.uint64(max(0, variants))
        self.char_table = np.full(ESCAPED + 1, -1, np.int32)
        self.char_table[pieces.chars] = pieces.char_ids
        self._index()
        self.bytes = np.frombuffer(pieces.surface, np.uint8)

    def _index(self) -> None:
        bits = max(16, int(np.ceil(np.log2(len(self.p.pairs) * 8))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        self.slot_keys = np.full(1 << bits, -1, np.int64)
        left, place = np.arange(len(self.p.pairs)), self._slot(self.p.pairs)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slots[place] < 0
            at, first = np.unique(place[free], return_index=True)
            won = left[free][first]
            self.slots[at], self.slot_keys[at] = won, self.p.pairs[won]
            rest = self.slots[place] != left
            left, place = left[rest], (place[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        place = self._slot(keys)
        found = np.where(self.slot_keys[place] == keys, self.slots[place], -1)
        open_ = np.flatnonzero((found < 0) & (self.slot_keys[place] >= 0))
        for k in range(1, self.probes):
            if not len(open_):
                break
            at = (place[open_] + k) & self.mask
            held = self.slot_keys[at]
            hit = held == keys[open_]
            found[open_[hit]] = self.slots[at[hit]]
            open_ = open_[~hit & (held >= 0)]
        return found

    def _place(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> np.ndarray:
        return mix((left.astype(np.uint64) * np.uint64(0x1F123BB5)) + (right.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)) + (merged.astype(np.uint64) << np.uint64(40)))

    def _skipped(self, key: np.ndarray, place: np.ndarray) -> np.ndarray:
        return mix(key ^ place) < np.uint64(min(self.limit, _M64))

    def _merge_all(self, sym: np.ndarray, owner: np.ndarray, pos: np.ndarray, count: int, keys: np.ndarray | None = None):
        """Merge each of ``count`` chunks to its end; symbols and owners in order, and owners and places of all merges.  No keys, no skips."""
        done, made = [], []
        while len(sym):
            i = np.flatnonzero(owner[:-1] == owner[1:])
            pairs = sym[i].astype(np.int64) * self.p.n + sym[i + 1]
            pairs[(sym[i] < 0) | (sym[i + 1] < 0)] = -2
            k = self._lookup(pairs)
            i, k = i[k >= 0], k[k >= 0]
            if keys is not None and len(i):
                stay = ~self._skipped(keys[owner[i]], self._place(pos[i], pos[i + 1], self.p.merged[k]))
                i, k = i[stay], k[stay]
            going = np.zeros(count, bool)
            going[owner[i]] = True
            ended = ~going[owner]
            if ended.any():
                done.append((owner[ended], pos[ended], sym[ended]))
            if not len(i):
                break
            worth = self.p.ranks[k] * (LONG_CHUNK + 1) + pos[i]
            first = np.concatenate([[0], np.flatnonzero(np.diff(owner[i])) + 1])
            best = np.minimum.reduceat(worth, first)
            chosen = worth == np.repeat(best, np.diff(np.concatenate([first, [len(i)]])))
            if keys is None and self.limit:
                at = i[chosen]
                made.append((owner[at], self._place(pos[at], pos[at + 1], self.p.merged[k[chosen]])))
            sym[i[chosen]] = self.p.merged[k[chosen]]
            stay = ~ended
            stay[i[chosen] + 1] = False
            sym, owner, pos = sym[stay], owner[stay], pos[stay]
        owner, pos, sym = (np.concatenate([d[j] for d in done] or [np.zeros(0, np.int64)]) for j in range(3))
        order = np.argsort(owner.astype(np.int64) * (LONG_CHUNK + 1) + pos, kind="stable")
        owners = np.concatenate([m[0] for m in made] or [np.zeros(0, np.int64)])
        places = np.concatenate([m[1] for m in made] or [np.zeros(0, np.uint64)])
        return sym[order], owner[order], owners, places

    def _merge_long(self, sym: np.ndarray, key: np.uint64) -> np.ndarray:
        sym, n = sym.tolist(), len(sym)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        known: dict[int, int] = {}
        agenda: list[tuple] = []

        def propose(lefts: list[int]) -> None:
            lefts = [a for a in lefts if a >= 0 and after[a] >= 0 and sym[a] >= 0 and sym[after[a]] >= 0]
            if not lefts:
                return
            a = np.array(lefts)
            b = np.array([after[x] for x in lefts])
            pairs = np.array([sym[x] * self.p.n + sym[after[x]] for x in lefts], np.int64)
            k = self._lookup(pairs)
            ok = k >= 0
            if self.limit and ok.any():
                ok[ok] = ~self._skipped(np.full(ok.sum(), key), self._place(a[ok], b[ok], self.p.merged[k[ok]]))
            for x, y, c in zip(a[ok].tolist(), b[ok].tolist(), k[ok].tolist(), strict=True):
                heapq.heappush(agenda, (int(self.p.ranks[c]), x, y, sym[x], sym[y], int(self.p.merged[c])))

        propose(list(range(n)))
        while agenda:
            _, a, b, sa, sb, merged = heapq.heappop(agenda)
            if after[a] != b or sym[a] != sa or sym[b] != sb or known.get(a) or known.get(b):
                continue
            sym[a], known[b] = merged, 1
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            propose([before[a], a])
        return np.array([s for i, s in enumerate(sym) if i not in known], np.int32)

    def encode(self, points: np.ndarray, offsets: np.ndarray, row_keys: np.ndarray):
        """Ids of all rows, one after another, and their row offsets."""
        rows = len(offsets) - 1
        sizes = np.diff(offsets)
        lead = (sizes > 0).astype(np.int64)
        at = offsets + np.concatenate([[0], np.cumsum(lead)])
        text = np.full(at[-1], SPACE, np.uint32)
        body = np.ones(at[-1], bool)
        body[at[:-1][lead > 0]] = False
        text[body] = np.where(points == 0x20, SPACE, np.where(points == SPACE, ESCAPED, points))
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        ids = self.char_table[text]
        blank, alone = text == SPACE, ids < 0
        begins = np.zeros(len(text), bool)
        begins[at[:-1][lead > 0]] = True
        begins[1:] |= (blank[1:] & ~blank[:-1]) | alone[1:] | alone[:-1]
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(text))
        row = np.searchsorted(at, starts, "right") - 1
        nth = (np.arange(len(starts)) - np.searchsorted(starts, at[:-1])[row]).astype(np.uint64)
        draw = mix(row_keys[row] + nth * np.uint64(0x9E3779B97F4A7C15))
        if self.variants:
            draw %= self.variants
        chunk = span_hashes(text, starts, ends)
        key = mix(chunk ^ mix(self.seed + draw * np.uint64(0xD1342543DE82EF95)))
        uniq, first, back = np.unique(chunk, return_index=True, return_inverse=True)
        short = ends[first] - starts[first] <= LONG_CHUNK
        chosen = np.flatnonzero(short)
        sym, owner, merges, places = self._merge_all(*self._symbols(ids, starts, ends, first[chosen], chosen), len(uniq))
        own = np.zeros(len(starts), bool)
        if self.limit:
            own = self._touched(key, back, merges, places, len(uniq)) | ~short[back]
        parts, owners = [sym], [owner]
        number = np.where(own, len(uniq) + np.cumsum(own) - 1, back)  # of the result that each occurrence takes
        alone_chunks = np.flatnonzero(alone[starts[first]])
        if len(alone_chunks):  # characters without a piece become bytes
            for c in alone_chunks:
                point = int(text[starts[first[c]]])
                raw = np.frombuffer(chr(SPACE if point == ESCAPED else point).encode(), np.uint8)
                parts.append(self.p.byte_ids[raw])
                owners.append(np.full(len(raw), c))
            known = parts[0] >= 0
            parts[0], owners[0] = parts[0][known], owners[0][known]
        again = np.flatnonzero(own & short[back])
        for k in range(0, len(again), OWN_CHUNKS):
            some = again[k : k + OWN_CHUNKS]
            sym, owner, _, _ = self._merge_all(*self._symbols(ids, starts, ends, some, np.arange(len(some))), len(some), key[some])
            parts.append(sym)
            owners.append(number[some][owner])
        for c in np.flatnonzero(own & ~short[back]) if self.limit else first[~short]:
            out = self._merge_long(ids[starts[c] : ends[c]], key[c])
            parts.append(out)
            owners.append(np.full(len(out), number[c]))
        sym, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        sym, count = sym[order].astype(np.int32), np.bincount(owner, minlength=len(uniq) + int(own.sum()))
        begin = np.cumsum(count) - count
        each = count[number]
        flat = np.repeat(begin[number] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        total = np.concatenate([[0], np.cumsum(each)])
        return sym[flat], total[np.searchsorted(starts, at)]

    @staticmethod
    def _symbols(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray, names: np.ndarray):
        """Symbols of the chunks ``which``, the name of the chunk of each, and its place there."""
        size = (ends - starts)[which]
        owner = np.repeat(names, size)
        pos = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        return ids[np.repeat(starts[which], size) + pos], owner, pos

    def _touched(self, key: np.ndarray, back: np.ndarray, merges: np.ndarray, places: np.ndarray, count: int) -> np.ndarray:
        """Whether each occurrence skips any of the merges that its chunk makes without skips."""
        order = np.argsort(merges, kind="stable")
        places, size = places[order], np.bincount(merges, minlength=count)
        begin = np.cumsum(size) - size
        out = np.zeros(len(back), bool)
        for k in range(int(size.max(initial=0))):
            at = np.flatnonzero((size[back] > k) & ~out)
            out[at] = self._skipped(key[at], places[begin[back[at]] + k])
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all rows and their offsets, from ids alone; the blank that encoding puts first is cut."""
        size = np.diff(self.p.ends)[ids]
        flat = np.repeat(self.p.ends[:-1][ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        raw = self.bytes[flat] if len(flat) else np.zeros(0, np.uint8)
        at = np.concatenate([[0], np.cumsum(size)])[offsets]
        keep = np.ones(len(raw), bool)
        full = np.diff(at) > 0
        keep[at[:-1][full]] = False
        return raw[keep], at - np.concatenate([[0], np.cumsum(full)])


def _points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    return points, lead[offsets]


def _row_keys(column) -> np.ndarray:
    return mix(column.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _encode_batches(pieces: Pieces, dropout: float, seed: int):
    def run(batches):
        coder = Coder(pieces, dropout, seed)
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            keys = _row_keys(batch.column(0))
            for first, last in blocks(offsets, BLOCK):
                part, at = raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                ids, ends = coder.encode(*_points(part, at), keys[first:last])
                back, back_at = coder.decode(ids, ends)
                same = (back_at == at).all() and (back == part).all()
                if not same:
                    raise ValueError("encoding is not lossless")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], names=["id", "text", "ids"])

    return run


def _digest_batches(pieces: Pieces, dropout: float, seed: int):
    import zlib

    def run(batches):
        coder = Coder(pieces, dropout, seed)
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            keys = _row_keys(batch.column(0))
            for first, last in blocks(offsets, BLOCK):
                part, at = raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                ids, ends = coder.encode(*_points(part, at), keys[first:last])
                back, back_at = coder.decode(ids, ends)
                spans = range(last - first)
                crc = [zlib.crc32(np.ascontiguousarray(ids[ends[i] : ends[i + 1]]).astype("<i4").tobytes()) for i in spans]
                text = [zlib.crc32(back[back_at[i] : back_at[i + 1]].tobytes()) for i in spans]
                lossless = [bool(np.array_equal(back[back_at[i] : back_at[i + 1]], part[at[i] : at[i + 1]])) for i in spans]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(np.diff(at)), pa.array(np.diff(ends)), pa.array(crc, pa.int64()), pa.array(text, pa.int64()), pa.array(lossless, pa.bool_())],
                    names=["id", "n_bytes", "n_tokens", "ids_crc32", "decoded_crc32", "lossless"],
                )

    return run


def _decode_batches(pieces: Pieces):
    def run(batches):
        coder = Coder(pieces, 0.0, 0)
        for batch in batches:
            lists = batch.column(1)
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            raw, at = coder.decode(lists.flatten().to_numpy(zero_copy_only=False), ends)
            texts = pa.array([raw[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace") for i in range(len(at) - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["id", "text"])

    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """The id (long), the text (null as empty) and ``ids`` (array of int) of every row.

    Draws depend on the seed, the id, the chunk and its number in the text; with ``dropout`` 0 the segmentation is the model's own, but for a
    U+2581 in the text, which becomes bytes.  Whole texts are encoded; an empty text has no ids.
    Rows that repeat an id and text get equal ids.  Each block is decoded
    again and compared, and a difference raises an error.
    """
    arrow_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = plain.mapInArrow(_encode_batches(load_pieces(model), dropout, seed), "id long, text string, ids array<int>")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "ids")


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """The id and the text of every row of ids; null and empty ids give the empty text."""
    arrow_batches(encoded.sparkSession)
    plain = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return plain.mapInArrow(_decode_batches(load_pieces(model)), "id long, text string").withColumnRenamed("id", id_col)


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """Encode and decode every text; digests of both, and whether the text came back.

    Returns the id, ``n_bytes`` and ``n_tokens`` (long), ``ids_crc32`` (of the ids as
    little-endian 32-bit integers), ``decoded_crc32`` and ``lossless``.
    """
    arrow_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "id long, n_bytes long, n_tokens long, ids_crc32 long, decoded_crc32 long, lossless boolean"
    return plain.mapInArrow(_digest_batches(load_pieces(model), dropout, seed), schema).withColumnRenamed("id", id_col)
