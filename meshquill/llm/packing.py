"""Best-fit packing by a configuration linear program.

1. Tasks cut each document into token pieces of at most CAPACITY (a longer document's first piece is the short one) and write
   id, piece, start, length and checksum of each piece; no tokens are kept.
2. The length histogram (at most CAPACITY counts, however many documents) goes to the driver. There the covering program over
   bin configurations is solved by multiplicative weights: a length's weight is its size times exp(-rate) to the share of it that is
   covered, and a knapsack dynamic program over the capacity (in units of GRID tokens) prices the configurations and finds the
   heaviest. Each is used for half of what its scarcest length lacks, a covering step that keeps the number of steps small; steps
   end when all is covered, after ROUNDS at most. The uses found are rounded down; configurations that leave more than two tokens free
   (the price of the grid) are not used. What is left is filled by subset sums, the longest piece first. The README says how much that is.
3. The rounded solution gives each length consecutive ranges of ranks. Pieces are ranked within their length by bucket counts
   and ranks within buckets, and a rank is looked up in the ranges (bounded by lengths times configurations, not by documents).

A null text is an empty one: one piece, the end token. Repeated rows are packed each on its own. Extra columns are ignored.
The checksum is of the ids as little-endian unsigned 32-bit numbers. The ids are those of the JSON vocabulary; the ranks file of
the same vocabulary gives equal ids (tests compare them) in a quarter of the time, and a text with a special token's string
goes through the JSON file, which alone says how such strings are read.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, slices, table

CAPACITY, END = 2048, 0
ROUNDS, GRID = 4000, 8
ROWS_PER_BUCKET = 65_536
SPECIAL = "<|endoftext|>"
_tokenizers: dict = {}


def encoder(json_path: str, ranks_path: str):
    """texts -> lists of ids, loaded once in each worker."""
    if (json_path, ranks_path) not in _tokenizers:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        full = Tokenizer.from_file(json_path)
        _tokenizers[json_path, ranks_path] = lambda text: full.encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_ordinary(text)
    return _tokenizers[json_path, ranks_path]


def cut(ids: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces."""
    first = len(ids) % capacity or capacity
    first = min(first, len(ids))
    return [(0, first)] + [(s, capacity) for s in range(first, len(ids), capacity)]


def pieces(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    import public_tokenizers

    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def work(batches):
        encode = encoder(json_path, ranks_path)
        for batch in slices(batches):
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = [*encode(text or ""), END]
                raw = np.array(ids, "<u4")
                rows += [(i, k, s, n, zlib.crc32(raw[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(ids))]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def knapsack(values: np.ndarray, capacity: int, grid: int = GRID) -> dict[int, int]:
    """The configuration (length -> copies) of the largest total value, lengths rounded up to whole grid units.

    values[n] belongs to length n; at or below 0 it is unused. Each unit is priced by its best length.
    """
    units = capacity // grid
    by_unit = values[1 : units * grid + 1].reshape(units, grid)
    chosen = by_unit.argmax(axis=1)
    price = by_unit[np.arange(units), chosen]
    best = np.zeros(units + 1)
    taken = np.zeros(units + 1, dtype=np.int64)
    for w in range(1, units + 1):
        options = price[:w] + best[w - 1 :: -1]
        k = int(options.argmax())
        best[w], taken[w] = (options[k], k + 1) if options[k] > best[w - 1] else (best[w - 1], 0)
    out: dict[int, int] = {}
    w = units
    while w > 0:
        if taken[w]:
            n = int((taken[w] - 1) * grid + chosen[taken[w] - 1] + 1)
            out[n] = out.get(n, 0) + 1
        w -= int(taken[w]) or 1
    return out


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, rate: float = 4.0) -> list[tuple[dict[int, int], float]]:
    """Configurations and how often each is used: a fractional packing of the histogram near the least number of bins.

    The weight of a length is its size times exp(-rate * the share of it that is covered); covered lengths have none. The
    room that grid units leave goes to the configuration's shortest piece: it is exchanged for the longest that still fits.
    A configuration is used for half of what its scarcest length still lacks.
    """
    need = np.zeros(capacity + 1)
    for n, c in histogram.items():
        need[n] = c
    size = np.arange(capacity + 1) / capacity
    left = need.copy()
    found: dict[tuple, float] = {}
    for _ in range(rounds):
        open_ = left >= 1
        if not open_.any():
            break
        weight = np.where(open_, size * np.exp(-rate * (1 - left / np.maximum(need, 1))), -1.0)
        pattern = knapsack(weight, capacity)
        if not pattern:
            break
        shortest = min(pattern)
        room = capacity - sum(n * c for n, c in pattern.items())
        longer = np.flatnonzero(open_[shortest + 1 : shortest + room + 1])
        if len(longer):
            pattern[shortest] -= 1
            pattern = {n: c for n, c in pattern.items() if c}
            longer = shortest + 1 + int(longer[-1])
            pattern[longer] = pattern.get(longer, 0) + 1
        step = min(left[n] / c for n, c in pattern.items())
        step = step if step < 2 else step / 2
        key = tuple(sorted(pattern.items(), reverse=True))
        found[key] = found.get(key, 0.0) + step
        for n, c in pattern.items():
            left[n] -= c * step
    return sorted(((dict(k), v) for k, v in found.items()), key=lambda x: (-x[1], sorted(x[0].items())))


def fill(longest: int, left: dict[int, int], capacity: int) -> dict[int, int]:
    """The longest piece and the lengths (each once) that best fill the rest of its bin, by subset sums."""
    room = capacity - longest
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for n in sorted((n for n in left if n <= room and (n != longest or left[n] > 1)), reverse=True):
        steps.append((n, reach))
        reach |= (reach << n) & mask
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    out = {longest: 1}
    for n, before in reversed(steps):
        if not before >> total & 1:
            out[n] = out.get(n, 0) + 1
            total -= n
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Configurations (length -> copies, at most capacity in all) and whole numbers of bins that hold the histogram exactly."""
    left = {n: c for n, c in histogram.items() if c}
    out: list[tuple[dict[int, int], int]] = []

    def use(pattern: dict[int, int], times: int) -> None:
        out.append((pattern, times))
        for n, c in pattern.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]

    for pattern, times in solve(left, capacity):
        times = min(int(times), *(left.get(n, 0) // c for n, c in pattern.items()))
        if times and sum(n * c for n, c in pattern.items()) >= capacity - 2:  # looser ones are left to the exact fill
            use(pattern, times)
    while left:
        pattern = fill(max(left), left, capacity)
        use(pattern, min(left[n] // c for n, c in pattern.items()))
    return out


def ranges(configurations: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> first rank, copies in a bin, first bin, offset in the bin of each configuration that has it."""
    out: dict[int, list] = {}
    rank: dict[int, int] = {}
    base = 0
    for pattern, times in configurations:
        offset = 0
        for n in sorted(pattern, reverse=True):
            out.setdefault(n, []).append((rank.get(n, 0), pattern[n], base, offset))
            rank[n] = rank.get(n, 0) + pattern[n] * times
            offset += n * pattern[n]
        base += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows)) for n, rows in out.items()}


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset. cut_pieces: as from pieces(), materialized."""
    spark = cut_pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in cut_pieces.groupBy("length").count().collect()}  # at most capacity rows
    total = sum(histogram.values())
    looked_up = spark.sparkContext.broadcast(ranges(plan(histogram, capacity)))
    buckets = max(1, total // ROWS_PER_BUCKET)
    keyed = cut_pieces.withColumn("mq_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    key = ["length", "mq_bucket"]
    before = Window.partitionBy("length").orderBy("mq_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(*key).count().select(*key, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("mq_before"))
    inside = Window.partitionBy(*key).orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = keyed.join(starts, key).withColumn("mq_rank", F.col("mq_before") + F.row_number().over(inside) - 1)

    def place(batches):
        table_of = looked_up.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("length", "mq_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                first, copies, base, begin = table_of[int(n)]
                at = np.flatnonzero(length == n)
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at] = base[k] + (rank[at] - first[k]) // copies[k]
                offset[at] = begin[k] + (rank[at] - first[k]) % copies[k] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    chosen = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "mq_rank")
    return chosen.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, **options) -> DataFrame:
    return pack(materialize(pieces(docs, **options), "pieces"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return packed(table(spark, sf_dir, "documents"))
