"""Encoding into vocabulary pieces by merges with seeded dropout, and decoding."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearcite.llm.common import row_key
from nearcite.llm.tokens import SLICE_BYTES, mixed, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
DROPOUT = 0.1
SHORT = 32
#: Draws that are held at once.
MERGES = 1 << 22
NEVER = np.int32(2**31 - 1)
UNIT = re.compile(" *[^ ]+| +")


@dataclass
class Vocabulary:
    """char_id: piece of a code point, -1 for none. slots and ranks: pairs of pieces that merge, by open addressing.

    by_rank: the piece of a rank. texts: bytes of a piece. byte_id: piece of a byte.
    """

    char_id: np.ndarray
    slots: np.ndarray
    ranks: np.ndarray
    by_rank: np.ndarray
    texts: list[bytes]
    byte_id: np.ndarray

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merges of pairs of pieces; NEVER where they make none."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = _slot(key, len(self.slots))
        there = self.slots[at]
        rank = np.where(there == key, self.ranks[at], NEVER)
        open_ = np.flatnonzero((there != key) & (there != -1))
        at = at[open_]
        while len(open_):
            at = (at + 1) % len(self.slots)
            there, own = self.slots[at], key[open_]
            rank[open_] = np.where(there == own, self.ranks[at], NEVER)
            more = (there != own) & (there != -1)
            open_, at = open_[more], at[more]
        rank[(left < 0) | (right < 0)] = NEVER
        return rank


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - (size - 1).bit_length())).astype(np.int64)


def vocabulary(model: str) -> Vocabulary:
    """The vocabulary of a model file, read once a worker: kept on a library module that every worker has."""
    known = sentencepiece.__dict__.setdefault("_nearcite_vocabularies", {})
    if model not in known:
        known[model] = read_vocabulary(model)
    return known[model]


def read_vocabulary(model: str) -> Vocabulary:
    """From a piece model with merge ranks as scores and byte pieces. Units end where no piece can go on: before a blank."""
    reader = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = range(reader.get_piece_size())
    plain = {reader.id_to_piece(i): i for i in ids if not (reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i))}
    inner = [p for p in plain if SPACE_MARK in p.lstrip(SPACE_MARK)]
    if inner:
        raise ValueError(f"pieces with inner blanks: {inner[:3]}")
    byte_id = np.full(256, -1, np.int32)
    texts = [b""] * len(ids)
    for i in ids:
        piece = reader.id_to_piece(i)
        if reader.is_byte(i):
            byte_id[int(piece[3:5], 16)] = i
            texts[i] = bytes([int(piece[3:5], 16)])
        elif piece in plain:
            texts[i] = piece.replace(SPACE_MARK, " ").encode()
    char_id = np.full(0x110000, -1, np.int32)
    for piece, i in plain.items():
        if len(piece) == 1 and piece != SPACE_MARK:
            char_id[ord(piece)] = i
    char_id[32] = plain[SPACE_MARK]
    pairs = {}
    for piece, i in plain.items():
        for cut in range(1, len(piece)):
            if piece[:cut] in plain and piece[cut:] in plain:
                pairs[plain[piece[:cut]] << 32 | plain[piece[cut:]]] = i
    order = np.array(sorted(plain.values(), key=lambda i: -reader.get_score(i)), np.int32)
    rank = np.full(len(ids), NEVER, np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    size = 1 << (4 * len(pairs) - 1).bit_length()
    slots, ranks = np.full(size, -1, np.int64), np.full(size, NEVER, np.int32)
    keys = np.array(list(pairs), np.int64)
    for key, at, piece in zip(keys.tolist(), _slot(keys, size).tolist(), pairs.values(), strict=True):
        while slots[at] != -1:
            at = (at + 1) % size
        slots[at], ranks[at] = key, rank[piece]
    return Vocabulary(char_id, slots, ranks, order, texts, byte_id)


def _merge_key(seed: int, left, right, begin, end) -> np.ndarray:
    """Hash of a merge: of seed, pieces and places within a unit."""
    key = np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)) + (np.asarray(left).astype(np.uint64) << np.uint64(32) | np.asarray(right).astype(np.uint64))
    return mixed(mixed(key) + (np.asarray(begin).astype(np.uint64) << np.uint64(32) | np.asarray(end).astype(np.uint64)))


def _skips(occurrence: np.ndarray, merge: np.ndarray, dropout: float) -> np.ndarray:
    """True where the hash of an occurrence of a unit and of a merge skips that merge there."""
    return mixed(np.asarray(occurrence).astype(np.uint64) ^ merge) < np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))


def _pair_rank(v: Vocabulary, left: np.ndarray, right: np.ndarray, variant, begin, end, seed: int, dropout: float) -> np.ndarray:
    """Rank of merging neighbours; NEVER where no piece is made of them, or where the merge is skipped."""
    rank = v.rank_of(left, right)
    if dropout > 0:
        where = np.flatnonzero(rank != NEVER)
        merge = _merge_key(seed, left[where], right[where], begin[where], end[where])
        rank[where[_skips(variant[where], merge, dropout)]] = NEVER
    return rank


class Trace:
    """Merges that units made when they were cut without dropout: unit, and hash of the merge.

    An occurrence that skips none of them is cut the same way: other merges that it may skip were never chosen.
    """

    def __init__(self, seed: int):
        self.seed, self.units, self.merges = seed, [np.empty(0, np.int64)], [np.empty(0, np.uint64)]

    def add(self, unit: np.ndarray, left, right, begin, end) -> None:
        self.units.append(unit)
        self.merges.append(_merge_key(self.seed, left, right, begin, end))

    def by_unit(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Merges in the order of their units, and where those of each unit begin."""
        units, merges = np.concatenate(self.units), np.concatenate(self.merges)
        order = np.argsort(units, kind="stable")
        return merges[order], np.searchsorted(units[order], np.arange(n + 1))


def _short_units(
    v: Vocabulary, symbols: np.ndarray, variant: np.ndarray, seed: int, dropout: float, trace: Trace | None = None, units: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols and their begins of units of one length, as matrices padded with -2, all units in step.

    In every step each unit makes its best allowed merge, the leftmost of equals: what its agenda would give.
    A matrix is held by columns; a merge moves the columns behind it forward by one.
    """
    rows, width = symbols.shape
    final_s, final_b = np.full((width, rows), -2, np.int32), np.zeros((width, rows), np.int32)
    own = np.arange(rows)
    s = [np.ascontiguousarray(symbols[:, c]) for c in range(width)]
    b = [np.full(rows, c, np.int32) for c in range(width + 1)]  # the last begin is the end
    r = [_pair_rank(v, s[c], s[c + 1], variant, b[c], b[c + 2], seed, dropout) for c in range(width - 1)]
    while True:
        key = np.full(len(own), np.int64(NEVER) << 8)
        for c, rank in enumerate(r):
            np.minimum(key, rank.astype(np.int64) << 8 | c, out=key)
        going = (key >> 8) != NEVER
        if not going.all():
            done = np.flatnonzero(~going)
            for c, column in enumerate(s):
                final_s[c, own[done]], final_b[c, own[done]] = column[done], b[c][done]
            keep = np.flatnonzero(going)
            own, variant, key = own[keep], variant[keep], key[keep]
            s, b, r = [x[keep] for x in s], [x[keep] for x in b], [x[keep] for x in r]
        if not len(own):
            return final_s.T, final_b.T
        best = (key & 0xFF).astype(np.int32)
        made = v.by_rank[key >> 8]
        n = len(s)
        left = np.full(len(own), -1, np.int32), np.zeros(len(own), np.int32)
        right = np.full(len(own), -1, np.int32), np.zeros(len(own), np.int32)
        for c in range(n):  # the neighbours of the new symbol, before columns move
            before, behind = best == c + 1, best == c - 2
            np.copyto(left[0], s[c], where=before)
            np.copyto(left[1], b[c], where=before)
            np.copyto(right[0], s[c], where=behind)
            np.copyto(right[1], b[c + 1], where=behind)
        begin, end = np.empty(len(own), np.int32), np.empty(len(own), np.int32)
        for c in range(n - 1):
            np.copyto(begin, b[c], where=best == c)
            np.copyto(end, b[c + 2], where=best == c)
        one = _pair_rank(v, left[0], made, variant, left[1], end, seed, dropout)
        two = _pair_rank(v, made, right[0], variant, begin, right[1], seed, dropout)
        if trace is not None:
            first, second = np.empty(len(own), np.int32), np.empty(len(own), np.int32)
            for c in range(n - 1):
                np.copyto(first, s[c], where=best == c)
                np.copyto(second, s[c + 1], where=best == c)
            trace.add(units[own], first, second, begin, end)
        s = [np.where(best == c, made, np.where(best < c, s[c + 1], s[c])) for c in range(n - 1)]
        b = [np.where(best < c, b[c + 1], b[c]) for c in range(n)]
        moved = [np.where(best <= c, r[c + 1], r[c]) for c in range(n - 2)]
        r = [np.where(best == c + 1, one, np.where(best == c, two, x)) for c, x in enumerate(moved)]


def _long_unit(
    v: Vocabulary, symbols: np.ndarray, variant: int, seed: int, dropout: float, trace: Trace | None = None, unit: int = 0
) -> tuple[list[int], list[int]]:
    """The same by an agenda, for a unit of any length."""
    n = len(symbols)
    s, begin, end = symbols.tolist(), list(range(n)), list(range(1, n + 1))
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    agenda: list[tuple[int, int, int, int, int]] = []

    def push(a: list[int]) -> None:
        i = np.array([x for x in a if x >= 0 and right[x] >= 0], np.int64)
        if not len(i):
            return
        j = np.array([right[x] for x in i.tolist()], np.int64)
        one, two = np.array([s[x] for x in i.tolist()], np.int32), np.array([s[x] for x in j.tolist()], np.int32)
        begins, ends = np.array([begin[x] for x in i.tolist()]), np.array([end[x] for x in j.tolist()])
        ranks = _pair_rank(v, one, two, np.full(len(i), variant, np.uint64), begins, ends, seed, dropout)
        for x, r, e in zip(i.tolist(), ranks.tolist(), ends.tolist(), strict=True):
            if r != NEVER:
                heapq.heappush(agenda, (r, begin[x], e, x, int(v.by_rank[r])))

    push(list(range(n)))
    while agenda:
        _, _, e, i, piece = heapq.heappop(agenda)
        j = right[i] if s[i] is not None else -1
        if j < 0 or end[j] != e or v.texts[s[i]] + v.texts[s[j]] != v.texts[piece]:
            continue
        if trace is not None:
            trace.add(np.array([unit]), np.array([s[i]]), np.array([s[j]]), np.array([begin[i]]), np.array([end[j]]))
        s[i], end[i], s[j] = piece, end[j], None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        push([left[i], i])
    alive = [i for i in range(n) if s[i] is not None]
    return [s[i] for i in alive], [begin[i] for i in alive]


def _encode_units(
    v: Vocabulary, units: list[str], variants: np.ndarray, seed: int, dropout: float, trace: Trace | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all units, flat, and their offsets. variants: what tells the occurrences of a unit apart."""
    lengths = np.fromiter((len(u) for u in units), np.int64, len(units))
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    chars = v.char_id[points]
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # units, their counts, pieces, places
    for length in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == length)
        if length <= SHORT:
            for part in np.array_split(own, max(1, len(own) * length // 1_000_000)):
                s, b = _short_units(v, chars[starts[part][:, None] + np.arange(length)], variants[part], seed, dropout, trace, part)
                full = s != -2
                done.append((part, full.sum(axis=1), s[full], b[full]))
        else:
            for unit in own.tolist():
                s, b = _long_unit(v, chars[starts[unit] : ends[unit]], int(variants[unit]), seed, dropout, trace, unit)
                done.append((np.array([unit]), np.array([len(s)]), np.array(s, np.int32), np.array(b, np.int32)))
    # characters without a piece go as bytes: a piece that is none counts as many as its bytes
    offsets = np.zeros(len(units) + 1, np.int64)
    widths = []
    for part, counts, piece, place in done:
        width = np.ones(len(piece), np.int64)
        unknown = np.flatnonzero(piece < 0)
        if len(unknown):
            point = points[np.repeat(starts[part], counts)[unknown] + place[unknown]]
            width[unknown] = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
            extra = np.bincount(np.repeat(np.arange(len(part)), counts)[unknown], width[unknown] - 1, len(part)).astype(np.int64)
            counts = counts + extra
        offsets[part + 1] = counts
        widths.append(width)
    offsets = np.cumsum(offsets)
    flat = np.empty(offsets[-1], np.int32)
    for (part, counts, piece, place), width in zip(done, widths, strict=True):
        total = offsets[part + 1] - offsets[part]
        at = np.repeat(offsets[part], total) + _within(total)
        unknown = np.flatnonzero(piece < 0)
        if len(unknown):
            point = points[np.repeat(starts[part], counts)[unknown] + place[unknown]].tolist()
            data = np.frombuffer(b"".join(chr(c).encode("utf-8", "surrogatepass") for c in point), np.uint8)
            first = (np.cumsum(width) - width)[unknown]
            piece = np.repeat(piece, width)
            piece[np.repeat(first, width[unknown]) + _within(width[unknown])] = v.byte_id[data]
        flat[at] = piece
    return flat, offsets


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for every size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _skipping(which: np.ndarray, occurrence: np.ndarray, merges: np.ndarray, starts: np.ndarray, dropout: float) -> np.ndarray:
    """True for occurrences (of the units ``which``) that skip a merge which their unit made without dropout."""
    many = starts[which + 1] - starts[which]
    out = np.zeros(len(which), bool)
    ends = np.cumsum(many)
    at = 0
    while at < len(which):  # so many merges at a time
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + MERGES, side="right")))
        part = many[at:stop]
        own = np.repeat(np.arange(at, stop), part)
        hit = _skips(occurrence[own], merges[np.repeat(starts[which[at:stop]], part) + _within(part)], dropout)
        out[own[hit]] = True
        at = stop
    return out


def encode_texts(texts: pa.Array, keys: np.ndarray, model: str, seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the texts (null: none), flat, and offsets. keys: values that, with a unit's number, make its own draws.

    Each different unit is cut once without dropout. Occurrences that skip none of the merges made then are cut
    alike; all others are cut for themselves. Units are held without their first blank. Texts of words between
    single blanks are cut by Arrow.
    """
    v = vocabulary(model)
    texts = pc.fill_null(texts, "")
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    odd = pc.match_substring_regex(texts, "^ |  | $").to_numpy(zero_copy_only=False)
    plain, rest = np.flatnonzero(~empty & ~odd), np.flatnonzero(~empty & odd)
    parts = pc.split_pattern(texts.take(pa.array(plain)), " ")
    rest_units = [[u[1:] for u in UNIT.findall(" " + t)] for t in texts.take(pa.array(rest)).to_pylist()]
    units = pa.concat_arrays([parts.flatten(), pa.array([u for own in rest_units for u in own], texts.type)])
    if not len(units):
        return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    order = np.concatenate([plain, rest])  # texts in the order of their units
    sizes = np.concatenate([np.diff(parts.offsets.to_numpy()), np.array([len(u) for u in rest_units], np.int64)]).astype(np.int64)
    coded = pc.dictionary_encode(units)
    codes, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    trace = Trace(seed) if dropout > 0 else None
    pieces, offsets = _encode_units(v, [" " + name for name in names], np.zeros(len(names), np.uint64), seed, 0.0, trace)
    which = codes
    if dropout > 0:
        occurrence = mixed(np.repeat(keys[order], sizes) + _within(sizes).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        own = np.flatnonzero(_skipping(codes, occurrence, *trace.by_unit(len(names)), dropout))
        more, ends = _encode_units(v, [" " + names[c] for c in codes[own].tolist()], occurrence[own], seed, dropout)
        which = codes.copy()
        which[own] = len(names) + np.arange(len(own))
        pieces, offsets = np.concatenate([pieces, more]), np.concatenate([offsets, offsets[-1] + ends[1:]])
    lengths = np.diff(offsets)[which]
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
    in_order = np.zeros(len(texts), np.int64)
    in_order[order] = np.diff(ends)
    bounds = np.concatenate([[0], np.cumsum(in_order)])
    source = np.repeat(offsets[:-1][which], lengths)
    source += _within(lengths)
    if not len(rest):
        return pieces[source], bounds
    target = np.repeat(bounds[order], np.diff(ends)) + _within(np.diff(ends))
    flat = np.empty(len(source), np.int32)
    flat[target] = pieces[source]
    return flat, bounds


def decode_ids(ids: list[int], model: str) -> str:
    """The text: bytes of all pieces, less the blank that encoding puts before a text."""
    texts = vocabulary(model).texts
    return b"".join(map(texts.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def _coder(model: str, seed: int, dropout: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(model).texts
        for batch in batches:
            for part in slices(batch, "_text", SLICE_BYTES // 2):
                texts = part["_text"].to_pylist()
                keys = part["_k"].to_numpy().view(np.uint64)
                flat, bounds = encode_texts(part["_text"], keys, model, seed, dropout)
                same = [
                    b"".join(map(table.__getitem__, flat[a:b].tolist()))[1:] == (t or "").encode("utf-8", "surrogatepass")
                    for t, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
                ]
                ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part["_id"], ids, pa.array(np.diff(bounds)), pa.array(same, pa.bool_())], ["_id", "ids", "n_ids", "lossless"]
                )

    return run


def encode(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL,
    seed: int = 1, dropout: float = DROPOUT,
) -> DataFrame:
    """_id, ids, n_ids and lossless (the ids decode to the text) of every row; no shuffle.

    A merge is skipped when the hash of seed, row, the unit's number in its text (a unit is a word with the blanks
    before it), both pieces and their place falls below the dropout: every occurrence of a word has draws of its
    own. What is skipped stays skipped, so the agenda needs no random state and every run gives the same ids. With
    no dropout the ids are those of the model itself.

    Null and empty texts have no ids; characters without a piece go as bytes; very long words take the agenda
    rather than the steps; equal rows get equal ids; other columns are not read.
    """
    identity, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = df.select(identity.alias("_id"), text.alias("_text"), F.xxhash64(row_key(identity, text)).alias("_k"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_coder(model, seed, dropout), f"_id {kind}, ids array<int>, n_ids long, lossless boolean")


def decode(df: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """The rows with a column decoded; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else decode_ids(ids, model) for ids in batch[ids_col].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())]))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return encode(df, id_col, text_col).withColumnRenamed("_id", "doc_id")
