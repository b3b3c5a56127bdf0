"""Interpolated modified Kneser-Ney bigrams: counted by Spark, kept as sorted arrays that tasks map into memory."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearcite.llm.common import scratch_path
from nearcite.llm.tokens import hashed_words, mixed, slices

#: Hash of the token that ends a text; no word has a blank.
END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))
#: Pairs or words that a task holds before it hands them on, and those that a shard has about.
HELD = 4_000_000
PER_SHARD = 2_000_000
KINDS = {"key": np.uint64, "count": np.uint64, "total": np.uint64, "weight": np.float64}


# --- arrays in the shared folder -------------------------------------------------------------------------


def _put(folder: str, name: str, values: np.ndarray) -> None:
    """Writes an array under its name; a repeated task writes the same bytes, and only whole files get the name."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{os.getpid()}-{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
    with system.open_output_stream(part) as out:
        out.write(memoryview(np.ascontiguousarray(values)).cast("B") if len(values) else b"")
    system.move(part, f"{path}/{name}")


def _mapped(folder: str, name: str) -> np.ndarray:
    """The array, mapped from the shared folder where it is mounted, else from a copy in this worker's own folder."""
    system, path = fs.FileSystem.from_uri(f"{folder}/{name}")
    if not isinstance(system, fs.LocalFileSystem):
        own = os.path.join(tempfile.gettempdir(), f"kn-{xxhash.xxh3_64_hexdigest(f'{folder}/{name}')}")
        if not os.path.exists(own):
            with system.open_input_stream(path) as source, open(f"{own}.{os.getpid()}", "wb") as out:
                while data := source.read(1 << 22):
                    out.write(data)
            os.replace(f"{own}.{os.getpid()}", own)
        path = own
    kind = KINDS[name.split(".")[-1]]
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)


# --- packed runs of sorted keys --------------------------------------------------------------------------


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences by byte planes, and counts, compressed: a third of the bytes of rows."""
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() if len(keys) else b""
    raw = steps + counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpacked(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob, 16 * n, asbytes=True), np.uint8)
    keys = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)
    return keys, np.ascontiguousarray(raw[8 * n :].reshape(8, n).T).view(np.uint64).ravel().astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


RUNS = "shard int, n long, run binary"


class _Runs:
    """Collects keys with counts and hands them on as packed runs by shard, in bounded memory."""

    def __init__(self, shard_of, shards: int):
        self.shard_of, self.shards, self.held, self.size = shard_of, shards, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, counts))
        self.size += len(keys)
        if self.size > HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys, counts = _summed(np.concatenate([k for k, _ in self.held]), np.concatenate([c for _, c in self.held]))
        self.held, self.size = [], 0
        shard = self.shard_of(keys)
        order = np.argsort(shard, kind="stable")
        keys, counts = keys[order], counts[order]
        bounds = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            a, b = bounds[s], bounds[s + 1]
            columns = [pa.array([s], pa.int32()), pa.array([b - a], pa.int64()), pa.array([_packed(keys[a:b], counts[a:b])], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "n", "run"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Every shard of a partition with its distinct keys and summed counts."""
    runs: dict[int, list] = {}
    for batch in batches:
        for shard, n, run in zip(*(batch[c].to_pylist() for c in ("shard", "n", "run")), strict=True):
            own = runs.setdefault(shard, [])
            own.append(_unpacked(run, n))
            if sum(len(k) for k, _ in own) > 4 * HELD:  # many runs of the same keys are summed as they come
                runs[shard] = [_summed(np.concatenate([k for k, _ in own]), np.concatenate([c for _, c in own]))]
    for shard in sorted(runs):
        own = runs.pop(shard)
        yield (shard, *_summed(np.concatenate([k for k, _ in own]), np.concatenate([c for _, c in own])))


def _to_shards(df: DataFrame, shards: int) -> DataFrame:
    return df.repartitionById(shards, F.col("shard"))


# --- model -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers that all tasks need."""

    folder: str
    word_shards: int
    pair_shards: int
    starts: tuple[int, ...]  # number of the first word of every word shard, and their end
    heavy: tuple[int, ...]  # words whose pairs are spread over all pair shards
    per: int  # word numbers in a shard of contexts
    tokens: int
    continuations: int
    discounts: tuple[float, float, float]  # of pairs
    lower: tuple[float, float, float]  # of words
    floor: float  # what the lower order leaves for all words alike

    @property
    def words(self) -> int:
        return self.starts[-1]

    @property
    def start(self) -> int:
        """The number that stands before a text; the one below it stands for every unknown word."""
        return self.starts[-1] + 1


def _hash_shard(shards: int):
    """By the top bits of hashes, which are even: shards are in the order of hashes."""
    return lambda keys: ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _pair_shard(shards: int, heavy: tuple[int, ...]):
    """Pairs by their first word, save those of heavy words, which are spread by both."""
    often = np.array(sorted(heavy), np.uint64)

    def of(keys: np.ndarray) -> np.ndarray:
        first = keys >> np.uint64(32)
        spread = np.isin(first, often)
        return (mixed(np.where(spread, keys, first)) % np.uint64(shards)).astype(np.int64)

    return of


class _Words:
    """Numbers of words, by search in the mapped sorted hashes."""

    def __init__(self, folder: str, shards: int, starts: tuple[int, ...]):
        self.keys = [_mapped(folder, f"words-{s}.key") for s in range(shards)]
        self.counts = [_mapped(folder, f"words-{s}.total") for s in range(shards)]
        self.shard, self.starts = _hash_shard(shards), starts

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of each hash; the number of words, and 0, for unknown ones."""
        distinct, back = np.unique(hashes, return_inverse=True)
        number, count = np.full(len(distinct), self.starts[-1], np.int64), np.zeros(len(distinct), np.int64)
        bounds = np.searchsorted(self.shard(distinct), np.arange(len(self.keys) + 1))
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            own = distinct[bounds[s] : bounds[s + 1]]
            at = np.minimum(np.searchsorted(self.keys[s], own), max(len(self.keys[s]) - 1, 0))
            hit = self.keys[s][at] == own if len(self.keys[s]) else np.zeros(len(own), bool)
            number[bounds[s] : bounds[s + 1]][hit] = self.starts[s] + at[hit]
            count[bounds[s] : bounds[s + 1]][hit] = self.counts[s][at[hit]]
        return number[back], count[back]


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each followed by the end, and row offsets."""
    words, offsets = hashed_words(texts)
    rows = len(offsets) - 1
    out = np.empty(len(words) + rows, np.uint64)
    ends = offsets[1:] + np.arange(rows)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[ends], out[inner] = END, words
    return out, np.concatenate([[0], ends + 1])


def _pairs(number: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    """Keys of (word before, word); ``start`` stands before the first word of a text."""
    before = np.empty(len(number), np.int64)
    before[1:] = number[:-1]
    before[bounds[:-1]] = start
    return before.astype(np.uint64) << np.uint64(32) | number.astype(np.uint64)


def _word_runs(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(_hash_shard(shards), shards)
        for batch in batches:
            for part in slices(batch, "_text"):
                keys, counts = np.unique(_tokens(part["_text"])[0], return_counts=True)
                yield from runs.add(keys, counts)
        yield from runs.flush()

    return run


def _word_shards(folder: str, heavy_from: int):
    """Writes hashes and counts of each shard; tells its size, its tokens, and its words of at least ``heavy_from``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in _merged(batches):
            _put(folder, f"words-{shard}.key", keys)
            _put(folder, f"words-{shard}.total", counts.astype(np.uint64))
            heavy = np.flatnonzero(counts >= heavy_from)
            columns = [pa.array([shard], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([heavy.tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "n", "tokens", "heavy"])

    return run


def _pair_runs(folder: str, word_shards: int, starts: tuple[int, ...], shards: int, heavy: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, runs = _Words(folder, word_shards, starts), _Runs(_pair_shard(shards, heavy), shards)
        for batch in batches:
            for part in slices(batch, "_text"):
                hashes, bounds = _tokens(part["_text"])
                if len(hashes):
                    keys, counts = np.unique(_pairs(words.find(hashes)[0], bounds, starts[-1] + 1), return_counts=True)
                    yield from runs.add(keys, counts)
        yield from runs.flush()

    return run


def _split(numbers: np.ndarray, per: int, shards: int) -> np.ndarray:
    return np.minimum(numbers // per, shards - 1)


def _pair_shards(folder: str, per: int, shards: int):
    """Writes pairs and counts of each shard; hands on what contexts and words gather from it, and counts of counts.

    kind 0: of a context its total; 1 to 3: how many pairs it has of count 1, 2 and more; 4: of a word, the
    different words before it. kind 5: of a shard, how many pairs have count 1 to 4.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "kind", "n", "run"]
        for shard, keys, counts in _merged(batches):
            _put(folder, f"pairs-{shard}.key", keys)
            _put(folder, f"pairs-{shard}.count", counts.astype(np.uint64))
            context, word = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
            own, first = np.unique(context, return_index=True)
            classes = np.minimum(counts, 3)
            facts = [(0, own, np.add.reduceat(counts, first))] + [(k, own, np.add.reduceat((classes == k).astype(np.int64), first)) for k in (1, 2, 3)]
            facts.append((4, *np.unique(word, return_counts=True)))
            for kind, which, value in facts:
                part = _split(which.astype(np.int64), per, shards)
                bounds = np.searchsorted(part, np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(bounds)).tolist():
                    a, b = bounds[s], bounds[s + 1]
                    full = np.flatnonzero(value[a:b]) + a
                    if len(full):
                        columns = [pa.array([s], pa.int32()), pa.array([kind], pa.int32()), pa.array([len(full)], pa.int64()), pa.array([_packed(which[full], value[full])], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names)
            seen = np.bincount(np.minimum(counts, 5), minlength=6)[1:5]
            columns = [pa.array([shard], pa.int32()), pa.array([5], pa.int32()), pa.array([4], pa.int64()), pa.array([seen.astype(np.int64).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _facts(batches: Iterator[pa.RecordBatch], per: int) -> Iterator[tuple[int, np.ndarray]]:
    """For every shard of word numbers, the sums of kinds 0 to 4 by number."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for shard, kind, n, run in zip(*(batch[c].to_pylist() for c in ("shard", "kind", "n", "run")), strict=True):
            which, value = _unpacked(run, n)
            own = sums.setdefault(shard, np.zeros((5, per), np.int64))
            np.add.at(own[kind], which.astype(np.int64) - shard * per, value)
    yield from sorted(sums.items())


def _context_shards(folder: str, per: int, discounts: tuple[float, float, float]):
    """Writes of each word number what scoring needs: total as context and backed-off weight, and its own continuations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, own in _facts(batches, per):
            weight = (discounts[0] * own[1] + discounts[1] * own[2] + discounts[2] * own[3]) / np.maximum(own[0], 1)
            _put(folder, f"contexts-{shard}.total", own[0].astype(np.uint64))
            _put(folder, f"contexts-{shard}.weight", np.where(own[0] > 0, weight, 1.0))
            _put(folder, f"contexts-{shard}.count", own[4].astype(np.uint64))
            seen = np.bincount(np.minimum(own[4], 5), minlength=6)[1:5]
            columns = [pa.array([shard], pa.int32()), pa.array([int(own[4].sum())], pa.int64()), pa.array([seen.tolist()], pa.list_(pa.int64())), pa.array([int((own[4] > 2).sum())], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "total", "seen", "more"])

    return run


def discounts_of(seen: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of counts 1 to 4 (Chen and Goodman); 0.5, 1 and 1.5 where too few are seen."""
    n1, n2, n3, n4 = seen
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


def fit(texts: DataFrame, text_col: str = "text") -> Model:
    """Counts, arrays and numbers of the model of these texts.

    First words: counted in tasks, packed by shard, summed there and written as sorted hashes; a word's number is its
    place. Then pairs of numbers alike. Shards are as many as the counts ask for, so none grows with the
    input; words that alone would fill one have their pairs spread. The driver sees a few numbers a shard.
    """
    spark = texts.sparkSession
    folder = scratch_path(spark, "kneser-ney")
    rows = texts.select(F.col(f"`{text_col}`").alias("_text"))
    size = rows.agg(F.sum(F.length("_text")).alias("n")).collect()[0]["n"] or 0
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    word_shards = max(min(shuffled, 16), -(-size // (16 * PER_SHARD)))
    pair_shards = max(shuffled, -(-size // (4 * PER_SHARD)))
    heavy_from = max(size // 6 // pair_shards, 1000)
    counted = _to_shards(rows.mapInArrow(_word_runs(word_shards), RUNS), word_shards)
    words = counted.mapInArrow(_word_shards(folder, heavy_from), "shard int, n long, tokens long, heavy array<long>").collect()
    _put_empty(folder, "words", set(range(word_shards)) - {r["shard"] for r in words}, ("key", "total"))
    sizes = {r["shard"]: r["n"] for r in words}
    starts = tuple(np.concatenate([[0], np.cumsum([sizes.get(s, 0) for s in range(word_shards)])]).astype(int).tolist())
    heavy = tuple(sorted([starts[r["shard"]] + i for r in words for i in r["heavy"]] + [starts[-1] + 1]))

    pairs = _to_shards(rows.mapInArrow(_pair_runs(folder, word_shards, starts, pair_shards, heavy), RUNS), pair_shards)
    per = -(-(starts[-1] + 2) // word_shards)
    path = scratch_path(spark, "kneser-ney-facts")
    pairs.mapInArrow(_pair_shards(folder, per, word_shards), "shard int, kind int, n long, run binary").write.parquet(path)
    facts = spark.read.parquet(path)
    seen = facts.where("kind = 5").select("shard", "run").collect()
    _put_empty(folder, "pairs", set(range(pair_shards)) - {r["shard"] for r in seen}, ("key", "count"))
    discounts = discounts_of(np.sum([np.frombuffer(bytes(r["run"]), np.int64) for r in seen] or [np.zeros(4, np.int64)], axis=0).tolist())

    contexts = _to_shards(facts.where("kind < 5"), word_shards).mapInArrow(
        _context_shards(folder, per, discounts), "shard int, total long, seen array<long>, more long"
    ).collect()
    for shard in set(range(word_shards)) - {r["shard"] for r in contexts}:
        for name, fill in (("total", 0), ("weight", 1.0), ("count", 0)):
            _put(folder, f"contexts-{shard}.{name}", np.full(per, fill, KINDS[name]))
    continuations = sum(r["total"] for r in contexts)
    kinds = np.sum([r["seen"] for r in contexts] or [[0] * 4], axis=0).tolist()
    lower = discounts_of(kinds)
    left = lower[0] * kinds[0] + lower[1] * kinds[1] + lower[2] * sum(r["more"] for r in contexts)
    floor = left / continuations if continuations else 1.0
    return Model(
        folder, word_shards, pair_shards, starts, heavy, per, sum(r["tokens"] for r in words), continuations, discounts, lower, floor
    )


def _put_empty(folder: str, what: str, shards: set[int], names: tuple[str, ...]) -> None:
    for shard in shards:
        for name in names:
            _put(folder, f"{what}-{shard}.{name}", np.empty(0, KINDS[name]))


class Scorer:
    """Scores texts in a task from the mapped arrays."""

    def __init__(self, model: Model):
        self.m = model
        self.words = _Words(model.folder, model.word_shards, model.starts)
        self.keys = [_mapped(model.folder, f"pairs-{s}.key") for s in range(model.pair_shards)]
        self.counts = [_mapped(model.folder, f"pairs-{s}.count") for s in range(model.pair_shards)]
        self.shard = _pair_shard(model.pair_shards, model.heavy)
        self.context = {n: [_mapped(model.folder, f"contexts-{s}.{n}") for s in range(model.word_shards)] for n in ("total", "weight", "count")}
    def _of(self, name: str, numbers: np.ndarray) -> np.ndarray:
        """Values by sorted word number."""
        shard = _split(numbers, self.m.per, self.m.word_shards)
        out = np.empty(len(numbers), KINDS[name])
        bounds = np.searchsorted(shard, np.arange(self.m.word_shards + 1))
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            a, b = bounds[s], bounds[s + 1]
            out[a:b] = self.context[name][s][numbers[a:b] - s * self.m.per]
        return out

    def _pair_counts(self, keys: np.ndarray) -> np.ndarray:
        shard = self.shard(keys)
        order = np.argsort(shard, kind="stable")  # keys are sorted, and stay so in a shard
        bounds = np.searchsorted(shard[order], np.arange(self.m.pair_shards + 1))
        out = np.zeros(len(keys), np.int64)
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            which = order[bounds[s] : bounds[s + 1]]
            if len(self.keys[s]):
                own = keys[which]
                at = np.minimum(np.searchsorted(self.keys[s], own), len(self.keys[s]) - 1)
                out[which] = np.where(self.keys[s][at] == own, self.counts[s][at], 0)
        return out

    def word_probability(self, numbers: np.ndarray) -> np.ndarray:
        """The lower order: words by what they follow, with the rest spread over all words and one unknown. Sorted numbers."""
        d = np.array([0.0, *self.m.lower])
        seen = self._of("count", numbers).astype(np.int64)
        seen[numbers >= self.m.words] = 0
        own = np.maximum(seen - d[np.minimum(seen, 3)], 0.0) / max(self.m.continuations, 1)
        return own + self.m.floor / (self.m.words + 1)

    def probability(self, keys: np.ndarray) -> np.ndarray:
        """Of the second word of each distinct sorted pair key after its first."""
        context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        count = self._pair_counts(keys)
        d = np.array([0.0, *self.m.discounts])
        total = self._of("total", context).astype(np.float64)
        weight = self._of("weight", context)
        distinct, back = np.unique(word, return_inverse=True)
        lower = self.word_probability(distinct)[back]
        return np.maximum(count - d[np.minimum(count, 3)], 0.0) / np.maximum(total, 1.0) + weight * lower

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, base score, model score) of each text."""
        hashes, bounds = _tokens(texts)
        if not len(hashes):
            none = np.zeros(0)
            return none.astype(np.int64), none.astype(np.int64), none, none
        number, count = self.words.find(hashes)
        keys, back = np.unique(_pairs(number, bounds, self.m.start), return_inverse=True)
        log = np.log10(self.probability(keys))[back]
        base = np.log10((count + 1) / (self.m.tokens + self.m.words + 1))
        at = bounds[:-1]
        return np.diff(bounds), np.add.reduceat((count > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(log, at)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, n_tokens, n_known, base_score, score and perplexity of every row, with no shuffle.

    Null and empty texts are the end alone; unknown words share one place beside the known; a text of any
    length is scored whole; repeated rows are scored each; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch, "_text"):
                tokens, known, base, own = scorer.score(part["_text"])
                columns = [part["_id"], pa.array(tokens), pa.array(known), pa.array(base), pa.array(own), pa.array(10.0 ** (-own / tokens))]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double")


def report(df: DataFrame) -> DataFrame:
    """All rows scored by the model of those whose crc32 of the id leaves a remainder other than 2 by 7 (a null id: of '')."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    model = fit(df.where(~held_out))
    out = score(df.select("doc_id", "text"), model)
    again = F.crc32(F.coalesce(F.col("_id").cast("string"), F.lit(""))) % 7 == 2
    return out.select(
        F.col("_id").alias("doc_id"), again.alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "perplexity",
    )
