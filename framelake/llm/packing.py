"""Best-fit packing of tokenized documents by exact-complement hashing.

Documents are tokenized where they lie; only lengths leave the executors. There are at most ``capacity`` different
lengths, so the histogram of lengths is a bounded table (2048 rows) that the driver may hold at any input size. On it:

1. Longest first, a length looks up its gap among the single, pair and triple sums of the lengths still available and
   consumes as many such combinations at once as the scarcest member allows: these sequences have no waste.
2. What finds no exact complement goes to the open sequence with the smallest sufficient gap (best fit, longest first).

The result is a bounded list of patterns with copy counts. Each piece then gets its rank among the pieces of its
length - by a window over hash buckets of bounded size plus the buckets' running counts, so a length that a third of
all pieces share is spread - and rank and length decide pattern, copy and offset.

Only documents longer than the capacity are cut: the first piece takes the remainder, all others are full.

Defined cases: null text counts as empty and is the single id 0; null ids and repeated rows are packed like any others;
extra columns are ignored; an empty table gives an empty result.

Ids come from the ``tokenizers`` vocabulary file. Texts of plain Latin characters take the ``tiktoken`` form of the
same vocabulary, which gives the same ids several times faster; all others, and those with very long runs or the
special token's string, take ``tokenizers`` itself (tests hold both against each other). The look-ahead of the
vocabulary's own pattern makes its regex engine backtrack; texts are cut where it would decide, before the last white
space of a run that a word follows, and the rest of the pattern splits the parts the same way.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

CAPACITY = 2048
BUCKET_ROWS = 50_000
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]")
_WIDE, _CUT = re.compile(r"\s\s"), re.compile(r"(?<=\s)(?=\s\S)")
#: The pattern that texts may be cut for, and its look-ahead.
_PATTERN, _AHEAD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", r"|\s+(?!\S)"
#: Runs from this length on are for ``tokenizers``. Every _STEP-th character of one shows a run of white space.
_RUN, _STEP = 400, 40
_SPACE, _SPACES = re.compile(r"\s{%d}" % (_RUN // _STEP)), re.compile(r"\s{%d}" % _RUN)
_LOADED: dict = {}


def plain(text: str) -> bool:
    """Latin characters only, no special token's string, fewer than _RUN characters from one space or line end to the next,
    and less white space than that at a stretch."""
    if _OTHER.search(text) or "<|endoftext|>" in text or (_SPACE.search(text[::_STEP]) and _SPACES.search(text)):
        return False
    at = 0
    while at + _RUN <= len(text):
        last = max(text.rfind(" ", at, at + _RUN), text.rfind("\n", at, at + _RUN))
        if last < 0:
            return False
        at = last + 1
    return True


def encoder(tokenizer_file: str, ranks_file: str | None, pattern: str | None):
    """text -> uint32 ids; loaded once per process."""
    key = (tokenizer_file, ranks_file)
    if key not in _LOADED:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(tokenizer_file)
        fast = None
        if ranks_file is not None:
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            cut = pattern == _PATTERN
            fast = tiktoken.Encoding("own", pat_str=pattern.replace(_AHEAD, "") if cut else pattern, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if fast is None or not plain(text):
                ids = whole.encode(text, add_special_tokens=False).ids
            elif cut and _WIDE.search(text):
                ids = [i for part in _CUT.split(text) for i in fast.encode_ordinary(part)]
            else:
                ids = fast.encode_ordinary(text)
            return np.frombuffer(array("I", ids), np.uint32).astype("<u4", copy=False)

        _LOADED[key] = encode
    return _LOADED[key]


def _pieces(capacity: int, files: tuple, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files)
        for batch in batches:
            rows: list[list] = [[] for _ in schema.names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
                start, number = 0, 0
                while start < len(ids):
                    left = len(ids) - start
                    length = left % capacity or capacity
                    raw = ids[start : start + length].tobytes()
                    for col, v in zip(rows, (doc, number, start, length, zlib.crc32(raw), raw), strict=False):
                        col.append(v)
                    start, number = start + length, number + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, schema.types, strict=True)], schema=schema)

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (copies, [(length, times), ...]) that place every counted length, each pattern within the capacity."""
    c = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        c[length] += n
    patterns: list[tuple[int, list[tuple[int, int]]]] = []

    def take(items: list[int]) -> bool:
        need: dict[int, int] = {}
        for x in items:
            need[x] = need.get(x, 0) + 1
        n = min(int(c[x]) // m for x, m in need.items())
        if n:
            for x, m in need.items():
                c[x] -= n * m
            patterns.append((n, sorted(need.items(), reverse=True)))
        return n > 0

    def pair(gap: int) -> list[tuple[int, int]]:
        """Available pairs with this sum, the larger first."""
        if gap < 2:
            return []
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        ok = (c[a] > 0) & (c[gap - a] > 0) & ((2 * a != gap) | (c[a] > 1))
        return [(int(x), gap - int(x)) for x in a[ok]]

    def complete(x: int) -> None:
        gap = capacity - x
        if gap == 0:
            take([x])
            return
        take([x, gap])
        for a, b in pair(gap) if c[x] else []:
            take([x, a, b])
            if not c[x]:
                return
        for a in range(gap - 2, (gap + 2) // 3 - 1, -1) if c[x] else ():
            if c[a]:
                for b, d in pair(gap - a):
                    if b <= a and take([x, a, b, d]) and not (c[x] and c[a]):
                        break
                if not c[x]:
                    return

    for x in range(capacity, 0, -1):
        if c[x]:
            complete(x)

    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for x in range(capacity, 0, -1):
        left = int(c[x])
        while left:
            gap = min((g for g in open_ if g >= x), default=None)
            if gap is None:
                times = min(left, capacity // x)
                n = left // times
                open_.setdefault(capacity - times * x, []).append((n, [(x, times)]))
                left -= n * times
            else:
                n, items = open_[gap].pop()
                each = min(left, gap // x) if n == 1 else 1
                used = min(n, left // each)
                if n > used:
                    open_[gap].append((n - used, items))
                if not open_[gap]:
                    del open_[gap]
                open_.setdefault(gap - each * x, []).append((used, [*items, (x, each)]))
                left -= used * each
    return patterns + [(n, items) for group in open_.values() for n, items in group]


def _slots(patterns: list) -> tuple[np.ndarray, ...]:
    """Per length, ranges of ranks in order: (length, first rank, copies, first sequence, offset)."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for n, items in patterns:
        offset = 0
        for length, times in items:
            rows.append((length, used.get(length, 0), n, first, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * times
        first += n
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(a[:, k].copy() for k in range(5))


def _placed(slots: tuple[np.ndarray, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, low, copies, first, offset = slots
        key = (length << 40) | low
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, (x << 40) | rank, "right") - 1
            k = rank - low[at]
            named = {n: batch.column(n) for n in batch.schema.names if n != "rank"}
            named |= {"sequence_id": pa.array(first[at] + k % copies[at]), "offset": pa.array(offset[at] + k // copies[at] * x)}
            yield pa.RecordBatch.from_pydict(named)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer_file: str | None = None, ranks_file: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids: little-endian uint32,) sequence_id, offset."""
    bounded_batches(docs.sparkSession)
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file, ranks_file, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    pieces = materialize(text.mapInArrow(_pieces(capacity, (tokenizer_file, ranks_file, pattern), with_ids), schema), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = rows.withColumn("within", within).join(before, ["length", "bucket"])
    names = [n.split()[0] for n in schema.split(", ")]
    ranked = ranked.select(*names, (F.col("before") + F.col("within") - 1).cast("long").alias("rank"))
    return ranked.mapInArrow(_placed(_slots(plan(counts, capacity))), f"{schema}, sequence_id long, offset long")
