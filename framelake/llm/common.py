"""Helpers shared by the corpus operators: tables, shared storage, bounded key filters, text hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.sources.storage import Scratch, bounded_batches, shared_dir, stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


materialize = stored


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it (column names differ by more than case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class KeyFilter:
    """A one-hash Bloom filter of fixed size over a key set, as an array<bigint> scalar subquery.

    It stays on the JVM and holds ``bits`` bits whatever the number of keys, so it may travel to every task. A hit
    may be false; a miss never is. Operators use it only to skip work or shuffles, or rely on misses; a hit never decides a result. With a label
    it is written once, for plans that use it more than once.
    """

    def __init__(self, keys: DataFrame, columns: list[str], bits: int = 1 << 20, label: str | None = None):
        self.bits = bits
        slot = F.pmod(F.xxhash64(*columns), F.lit(bits).cast("long"))
        used = keys.select(F.shiftright(slot, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64).cast("long")).cast("int")).alias("b"))
        zero = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
        words = used.union(zero).groupBy("w").agg(F.bit_or("b").alias("b"))
        one = words.agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("a")).select(F.transform("a", lambda x: x["b"]).alias("a"))
        self.words = (one if label is None else materialize(one, label)).scalar()

    def hit(self, *columns: Column | str) -> Column:
        slot = F.pmod(F.xxhash64(*columns), F.lit(self.bits).cast("long"))
        word = F.element_at(self.words, (F.shiftright(slot, 6) + 1).cast("int"))
        return F.call_function("shiftright", word, F.pmod(slot, F.lit(64).cast("long")).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. For pure ASCII text lower() does just that and is far cheaper than translate()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


# ---- vectorised word and shingle hashing (numpy, on UTF-8 bytes) ----

CHUNK = 1 << 18
_U = np.uint64
_M1, _M2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
_B = 0x9E3779B97F4A7C15
_TABLES: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _M1
    x ^= x >> _U(33)
    x *= _M2
    x ^= x >> _U(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, kept per process and grown by doubling."""
    if len(_TABLES.get("p", ())) < n:
        size, inverse = 1 << max(19, (n - 1).bit_length()), pow(_B, -1, 1 << 64)
        for key, base in (("p", _B), ("q", inverse)):
            a = np.ones(size, np.uint64)
            step, have = base, 1
            while have < size:
                a[have : 2 * have] = a[:have] * _U(step)
                step, have = step * step % (1 << 64), 2 * have
            _TABLES[key] = a
    return _TABLES["p"], _TABLES["q"]


def word_table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], bool)


#: Words are runs without \x20 and \x09-\x0D.
SPACED = word_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words are runs of ASCII letters and digits and of everything beyond ASCII.
ALNUM = word_table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A)
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))


def chunks(texts: list, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about limit bytes together; a longer text is alone."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t)
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def words_of(texts: list[bytes], letters: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word, in order: a 64-bit hash of its bytes with A-Z folded, the text's number, and the byte offset in it."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.zeros(len(texts), np.int64)
    np.cumsum(lengths[:-1], out=starts[1:])
    inside = letters[joined]
    inside[starts + lengths - 1] = False  # a separator that may itself be no separator byte of this alphabet
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    first, last = edge[0::2], edge[1::2]
    p, q = _powers(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTE[_FOLD[joined]] * p[: len(joined)], out=sums[1:])
    h = mix((sums[last] - sums[first]) * q[first] + (last - first).astype(np.uint64))
    doc = np.searchsorted(starts, first, "right") - 1
    return h, doc, first - starts[doc]


def shingles_of(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes of ``size`` words; with fewer words, the whole sequence as one."""
    h, doc, _ = words_of(texts)
    n = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    mult = mix(np.arange(11, 11 + size, dtype=np.uint64))
    full = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        full += h[k : k + len(full)] * mult[k]
    full = mix(full)
    at, out = 0, []
    for m in n.tolist():
        if m >= size:
            out.append(np.unique(full[at : at + m - size + 1]))
        elif m:
            out.append(mix((h[at : at + m] * mult[:m]).sum(keepdims=True, dtype=np.uint64) + _U(m)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += m
    return out


def without_ids(docs: DataFrame, id_col: str, ids: DataFrame, bits: int = 1 << 20) -> DataFrame:
    """docs without the rows whose id is in ids (one column, distinct or not). Only rows that hit a bit filter are shuffled."""
    (name,) = unused(docs.columns, "gone")
    gone = ids.select(F.col(f"`{ids.columns[0]}`").alias(name))
    may = KeyFilter(gone, [name], bits)
    suspect = F.coalesce(may.hit(F.col(f"`{id_col}`")), F.lit(False))
    found = docs.filter(suspect)
    left = found.join(gone, F.col(f"`{id_col}`") == F.col(name), "left_anti")
    return docs.filter(~suspect).unionByName(left)
