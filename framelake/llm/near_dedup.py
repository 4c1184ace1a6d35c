"""Near duplicates by an LSH forest over MinHash signatures, links confirmed on full shingle sets.

1. Each text becomes its set of word shingles, a fingerprint of that set and MinHash values. Rows with one set are
   one node, so exact copies cost nothing further.
2. The forest: every tree takes its own values in its own order as a sort key. The nodes of a tree are range
   partitioned and sorted by key; candidates are neighbours with the longest common prefixes. A pair needs a prefix of
   MIN_DEPTH values, and a region of up to CROWD nodes with such a prefix pairs all its nodes. A crowded region goes
   deeper: of the NEAR nodes next to it in sorted order a node takes in each tree the one with the longest common prefix
   (of several the most similar), and the region's hub, the node on its heaviest path; these join most of a crowd, and
   step 5 decides the rest. Range partitions split any crowd; the rows beside a partition's border are compared in a
   second, small pass.
3. Pairs whose sets differ too much in size are dropped before any text moves, which loses nothing. A packed sketch that
   travels with the keys gives the similarity of candidates and drops those far below the threshold (a pair of
   similarity 0.8 fails it less than once in a million).
4. Confirmation works like Boruvka's algorithm: each component picks its most similar open candidate, the picked pairs
   are compared on full sets, components merge; after two such rounds every candidate still open between two
   components is compared. A pair inside one component needs no comparison: it can't change the result.
5. Crowded regions are then finished exactly: every pair of their nodes that still lies in two components is compared on
   full sets, without sketch or window. A region's nodes are dealt to blocks by size of set (sets whose sizes differ by
   more than the threshold allows can't link) and by hash; a task compares two blocks and emits only a spanning forest of
   the links it finds. Pairs within the region's largest component are not formed.

Nothing is collected to the driver. Intermediate tables are written to the cluster's shared folder and removed when the
result, which is written too, is there.

Defined cases: a text without words (or null) has an empty set and links with nothing; texts with fewer words than a
shingle are one shingle; ids are expected unique, rows that share an id are one node and linked as soon as one of their
texts is; a row with a null id links with nothing and is kept; other columns are ignored, an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, Scratch, bounded_batches, chunks, materialize, mix, shingles_of

TREES, DEPTH = 20, 5
MIN_DEPTH, NEAR, CROWD, BEST = 2, 48, 32, 1
ROUNDS = 2
SKETCH_SLACK = 0.22
BLOCK_ROWS, BLOCK_ITEMS = 512, 1 << 19
FILTER_BITS = 1 << 22
_U = np.uint64


def _values() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64) * _U(0xA24BAED4963EE407))
    return seeds[0::2] | _U(1), seeds[1::2]


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """One row of TREES * DEPTH uint32 values per set; sets must not be empty."""
    out = np.empty((len(sets), TREES * DEPTH), np.uint32)
    mult, add = _values()
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= 1 << 16):
            total += len(sets[end])
            end += 1
        part = sets[at:end]
        flat = np.concatenate(part)
        starts = np.zeros(len(part), np.int64)
        np.cumsum([len(x) for x in part[:-1]], out=starts[1:])
        for k in range(len(mult)):
            out[at:end, k] = np.minimum.reduceat(flat * mult[k] + add[k], starts) >> _U(32)
        at = end
    return out


def _batch(table: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(table, schema=schema)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("sig", pa.binary())])


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            raw = [x or b"" for x in texts.to_pylist()]
            for i, j in chunks(raw):
                sets = shingles_of(raw[i:j], size)
                full = [k for k, s in enumerate(sets) if len(s)]
                fp, sig = [None] * (j - i), [None] * (j - i)
                if full:
                    values = minhash([sets[k] for k in full]).astype(">u4")
                    for row, k in enumerate(full):
                        fp[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                        sig[k] = values[row].tobytes()
                yield _batch({"doc_id": ids.slice(i, j - i), "n_shingles": [len(s) for s in sets], "fp": fp, "sig": sig}, _SKETCH)

    return run


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal 4-bit sketch values of rows of packed bytes."""
    x = a ^ b
    return (((x & 0xF0) == 0).sum(1) + ((x & 0x0F) == 0).sum(1)) / (2.0 * x.shape[1])


def _least_agreement(threshold: float) -> float:
    return threshold + (1 - threshold) / 16 - SKETCH_SLACK


def _size_fits(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m values can reach the threshold at all: no two sets further apart in size do."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


_FOREST = "t int, key binary, id long, sk binary, n long, w long"


def _forest(size_t: int):
    schema = pa.schema([("t", pa.int32()), ("key", pa.binary()), ("id", pa.int64()), ("sk", pa.binary()), ("n", pa.int64()), ("w", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(n, TREES * DEPTH)
            low = (mix(sig.astype(np.uint64)) & _U(15)).astype(np.uint8)
            packed = (low[:, 0::2] << 4) | low[:, 1::2]
            sk = [r.tobytes() for r in packed]
            for t in range(size_t):
                keys = np.ascontiguousarray(sig[:, t * DEPTH : (t + 1) * DEPTH]).view(f"S{4 * DEPTH}")
                raw = keys.tobytes()
                yield _batch({"t": np.full(n, t, np.int32), "key": [raw[k : k + 4 * DEPTH] for k in range(0, len(raw), 4 * DEPTH)], "id": batch.column(0), "sk": sk, "n": batch.column(2), "w": batch.column(3)}, schema)

    return run


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("est", pa.float32()), ("t", pa.int32()), ("key", pa.binary()), ("id", pa.int64()), ("sk", pa.binary()), ("n", pa.int64())])


def _neighbours(least: float, percent: int, borders: bool):
    """Over rows sorted by (t, key, id): pairs of neighbours; with borders, also the first and last rows themselves.

    A row is handled once the NEAR rows after it are there and with CROWD rows before it still at hand, so what is paired
    does not depend on how the rows come in batches.
    """

    def arrays(batch: pa.RecordBatch):
        n = batch.num_rows
        key = np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u4").reshape(n, DEPTH)
        sk = np.frombuffer(b"".join(batch.column("sk").to_pylist()), np.uint8).reshape(n, -1)
        return batch.column("t").to_numpy(), key, batch.column("id").to_numpy(), sk, batch.column("n").to_numpy()

    def edge(rows: tuple) -> pa.RecordBatch:
        t, key, ident, sk, size = rows
        none = [None] * len(t)
        return _batch({"a": none, "b": none, "est": none, "t": t.astype(np.int32), "key": [k.tobytes() for k in key], "id": ident, "sk": [s.tobytes() for s in sk], "n": size}, _PAIRS)

    def pairs(ident: np.ndarray, i: np.ndarray, j: np.ndarray, est: np.ndarray) -> pa.RecordBatch:
        none = [None] * len(i)
        return _batch({"a": np.minimum(ident[i], ident[j]), "b": np.maximum(ident[i], ident[j]), "est": est.astype(np.float32), "t": none, "key": none, "id": none, "sk": none, "n": none}, _PAIRS)

    def handled(held: tuple, begin: int, end: int) -> Iterator[pa.RecordBatch]:
        """Pairs whose first row lies in begin..end of the held rows."""
        t, key, ident, sk, size = held
        rows = len(t)
        same = (t[1:] == t[:-1]) & (key[1:, :MIN_DEPTH] == key[:-1, :MIN_DEPTH]).all(1)
        region = np.concatenate([[0], np.cumsum(~same)])
        crowded = np.bincount(region)[region] > CROWD
        dense = np.flatnonzero(crowded[begin:end]) + begin
        place = np.full(rows, -1)
        place[dense] = np.arange(len(dense))
        likely, rank = np.zeros((len(dense), NEAR), np.float32), np.zeros((len(dense), NEAR), np.float32)
        for o in range(1, min(NEAR, rows - begin - 1) + 1):
            i = np.arange(begin, min(end, rows - o))
            i = i[region[i] == region[i + o]]
            if not len(i):
                break  # no region is this long
            i = i[(ident[i] != ident[i + o]) & _size_fits(size[i], size[i + o], percent)]
            est = _agree(sk[i], sk[i + o])
            i, est = i[est >= least], est[est >= least]
            far = crowded[i]
            common = np.cumprod(key[i[far]] == key[i[far] + o], axis=1).sum(1)
            likely[place[i[far]], o - 1] = est[far]
            rank[place[i[far]], o - 1] = common + est[far]
            if not far.all():
                yield pairs(ident, i[~far], i[~far] + o, est[~far])
        if len(dense):
            top = np.argsort(-rank, axis=1, kind="stable")[:, :BEST]
            row, col = np.nonzero(np.take_along_axis(rank, top, 1))
            o = top[row, col]
            if len(row):
                yield pairs(ident, dense[row], dense[row] + o + 1, likely[row, o])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begin, seen = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            now = arrays(batch)
            if borders and seen < NEAR:
                yield edge(tuple(x[: NEAR - seen] for x in now))
            seen += batch.num_rows
            held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            end = len(held[0]) - NEAR
            if end > begin:
                yield from handled(held, begin, end)
                cut = max(0, end - CROWD)
                held, begin = tuple(x[cut:] for x in held), end - cut
        if held is not None:
            yield from handled(held, begin, len(held[0]))
            if borders and seen > NEAR:
                yield edge(tuple(x[-min(NEAR, seen - NEAR) :] for x in held))

    return run


def _to_hub(least: float, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("est", pa.float32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, h, n, m = (batch.column(c).to_numpy() for c in ("id", "hub", "n", "hub_n"))
            sk, hsk = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(x), -1) for c in ("sk", "hub_sk"))
            est = _agree(sk, hsk)
            ok = (est >= least) & (x != h) & _size_fits(n, m, percent)
            yield _batch({"a": np.minimum(x, h)[ok], "b": np.maximum(x, h)[ok], "est": est[ok].astype(np.float32)}, schema)

    return run


def _confirmed(size: int, percent: int):
    """Over rows (a, b, la, lb, text) sorted by (a, b): the pairs of which some two texts reach the threshold."""
    schema = pa.schema([("la", pa.int64()), ("lb", pa.int64())])

    def linked(groups: list) -> list[bool]:
        flat = [t for g in groups for side in g for t in side]
        sets, at, out = [], 0, []
        for i, j in chunks(flat):
            sets += shingles_of(flat[i:j], size)
        for left, right in groups:
            ls, rs = sets[at : at + len(left)], sets[at + len(left) : at + len(left) + len(right)]
            at += len(left) + len(right)
            ok = False
            for x in ls:
                for y in rs:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok = ok or (both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            out.append(ok)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(keys: list, groups: list) -> pa.RecordBatch:
            good = [k for k, ok in zip(keys, linked(groups), strict=True) if ok]
            return _batch({"la": [k[2] for k in good], "lb": [k[3] for k in good]}, schema)

        keys, groups, held = [], [], 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("a", "b", "la", "lb", "id")]
            texts = [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
            for a, b, la, lb, ident, text in zip(*cols, texts, strict=True):
                if not keys or keys[-1][:2] != (a, b):
                    if held > 1 << 22:
                        yield flush(keys, groups)
                        keys, groups, held = [], [], 0
                    keys.append((a, b, la, lb))
                    groups.append(([], []))
                groups[-1][ident != a].append(text)
                held += len(text)
        if keys:
            yield flush(keys, groups)

    return run


def connected(links: DataFrame, materialize=materialize) -> DataFrame:
    """Connected components of links (u, v) by alternating large-star and small-star steps: rows (node, root), root the smallest."""
    both = lambda e: e.union(e.select("v", "u"))
    e = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    last = None
    while True:
        sym = both(e)
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = materialize(small.filter("u <> v").distinct(), "star")
        state = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state


def _sets(size: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
            for i, j in chunks(raw):
                sets = shingles_of(raw[i:j], size)
                yield _batch({"id": batch.column("doc_id").slice(i, j - i), "n": [len(s) for s in sets], "set": [s.tobytes() for s in sets]}, schema)

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of the intersections of every left set with every right set: frequent values by matrix product, others one by one."""
    out = np.zeros(len(left) * len(right), np.int64)
    flat = [np.concatenate(x) for x in (left, right)]
    both = np.intersect1d(*flat)
    if not len(both):
        return out.reshape(len(left), len(right))
    side = []
    for sets, values in zip((left, right), flat, strict=True):
        col = np.minimum(np.searchsorted(both, values), len(both) - 1)
        kept = both[col] == values
        side.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[kept], col[kept]))
    (lrow, lcol), (rrow, rcol) = side
    ln, rn = (np.bincount(c, minlength=len(both)) for c in (lcol, rcol))
    dense = ln * rn * 50 > len(left) * len(right)
    place = np.cumsum(dense) - 1
    width = 2048
    parts = [(r[dense[c]], place[c[dense[c]]]) for r, c in side]
    for at in range(0, int(dense.sum()), width):
        m = []
        for sets, (r, c) in zip((left, right), parts, strict=True):
            a = np.zeros((len(sets), width), np.float32)
            now = (c >= at) & (c < at + width)
            a[r[now], c[now] - at] = 1
            m.append(a)
        out += np.rint(m[0] @ m[1].T).astype(np.int64).ravel()
    by_col = np.argsort(rcol, kind="stable")
    rrow, first = rrow[by_col], np.cumsum(rn) - rn
    lrow, lcol = lrow[~dense[lcol]], lcol[~dense[lcol]]
    done = np.concatenate([[0], np.cumsum(rn[lcol])])
    i = 0
    while i < len(lcol):
        j = max(i + 1, int(np.searchsorted(done, done[i] + (1 << 20), "right")) - 1)
        times = rn[lcol[i:j]]
        at = np.arange(times.sum()) + np.repeat(first[lcol[i:j]] - (np.cumsum(times) - times), times)
        out += np.bincount(np.repeat(lrow[i:j], times) * len(right) + rrow[at], minlength=len(out))
        i = j
    return out.reshape(len(left), len(right))


def spanning(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (u, v), those that a spanning forest needs."""
    root, out = {}, []

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0).tolist():
        x, y = find(a), find(b)
        if x != y:
            root[y] = x
            out.append((a, b))
    return out


def _block_links(percent: int):
    """Over rows (pair, side, root, set) sorted by pair: links between the roots of two blocks, or within one that has no other side."""
    schema = pa.schema([("la", pa.int64()), ("lb", pa.int64())])

    def linked(rows: list) -> pa.RecordBatch:
        halves = [[r for r in rows if r[1] == side] for side in (0, 1)]
        left, right = halves if halves[1] else (halves[0], halves[0])
        ends = []
        if left:
            sets = [[np.frombuffer(r[3], np.uint64) for r in x] for x in (left, right)]
            a, b = (np.array([r[2] for r in x], np.int64) for x in (left, right))
            n, m = (np.array([len(s) for s in x], np.int64) for x in sets)
            both = overlaps(*sets)
            i, j = np.nonzero((both > 0) & (100 * both >= percent * (n[:, None] + m[None, :] - both)) & (a[:, None] != b[None, :]))
            ends = spanning(a[i], b[j]) if len(i) else []
        return _batch({"la": [x for x, _ in ends], "lb": [y for _, y in ends]}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("pair", "side", "root", "set")), strict=True):
                if rows and rows[-1][0] != row[0]:
                    yield linked(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield linked(rows)

    return run


def _crowd_links(nodes: DataFrame, text: DataFrame, size: int, percent: int, materialize) -> DataFrame:
    """Over (p, id, root), the nodes of crowded regions: links (la, lb) of roots by every pair of a region's nodes that differ in root."""
    tally = nodes.groupBy("p", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("p").agg(F.sum("n").alias("m"), F.max(F.struct("n", "root")).alias("top"))
    split = materialize(tally.filter("m > top.n").select("p", F.col("top.root").alias("top")), "split")
    open_ = materialize(nodes.join(split, "p").select("p", "id", "root", (F.col("root") != F.col("top")).alias("out")), "split-nodes")
    ids = open_.select("id").distinct()
    texts = text.filter(KeyFilter(ids, ["id"]).hit("doc_id")).join(ids, F.col("doc_id") == F.col("id"), "left_semi").dropDuplicates()
    sets = materialize(texts.mapInArrow(_sets(size), "id long, n long, set binary").filter("n > 0"), "sets")
    ratio = 1.0001 * 100 / max(percent, 1)  # linked sets are at most this far apart in size: in the same class or in the next
    cls = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(ratio)))
    rows = open_.join(sets.select("id", "n"), "id").withColumn("c", cls)
    room = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK_ROWS)), F.floor(BLOCK_ITEMS / F.pow(F.lit(ratio), F.col("c") + 1)).cast("double")))
    blocks = materialize(rows.groupBy("p", "c", "out").agg(F.count(F.lit(1)).alias("k")).withColumn("blocks", F.ceil(F.col("k") / room).cast("long")), "blocks")
    each = blocks.select("p", "c", "out", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    one, two = (each.select("p", F.struct("c", "out", "block").alias(x)) for x in "ab")
    same = (F.col("a.c") == F.col("b.c")) & F.when(F.col("b.out"), F.col("a.out") & (F.col("a.block") <= F.col("b.block"))).otherwise(F.col("a.out"))
    near = (F.col("a.c") + 1 == F.col("b.c")) & (F.col("a.out") | F.col("b.out"))
    pairs = one.join(two, "p").filter(same | near).withColumn("pair", F.xxhash64("p", "a", "b"))
    sides = pairs.select("p", "pair", F.posexplode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("side", "x")).select("p", "pair", "side", "x.*")
    placed = rows.join(blocks.select("p", "c", "out", "blocks"), ["p", "c", "out"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = placed.join(sides, ["p", "c", "out", "block"]).select("pair", "side", "id", "n", "root")
    full = dealt.join(sets, ["id", "n"]).select("pair", "side", "root", "set")
    return full.repartition("pair").sortWithinPartitions("pair").mapInArrow(_block_links(percent), "la long, lb long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable over links), kept."""
    scratch = Scratch()
    try:
        return materialize(_components(docs, id_col, text_col, shingle_words, percent, scratch.stored), "components")
    finally:
        scratch.clear()


def _components(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, percent: int, materialize) -> DataFrame:
    bounded_batches(docs.sparkSession)
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    least = _least_agreement(percent / 100)
    sketch = materialize(text.mapInArrow(_sketches(shingle_words), "doc_id long, n_shingles long, fp binary, sig binary"), "sketch")
    nodes = sketch.filter("doc_id is not null and fp is not null")
    reps = materialize(nodes.groupBy("fp", "sig").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("w")), "nodes")

    grown = reps.select("rep", "sig", "n", "w").mapInArrow(_forest(TREES), _FOREST).withColumn("p", F.xxhash64("t", F.substring("key", 1, 4 * MIN_DEPTH)))
    regions = materialize(grown.groupBy("p").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "regions")
    shared = grown.filter(KeyFilter(regions, ["p"], FILTER_BITS).hit("p"))
    row = ["t", "key", "id", "sk", "n"]
    spread = shared.select(*row).repartitionByRange("t", "key", "id").sortWithinPartitions("t", "key", "id")
    pair_schema = "a long, b long, est float, t int, key binary, id long, sk binary, n long"
    found = materialize(spread.mapInArrow(_neighbours(least, percent, True), pair_schema), "pairs")
    # a region that lies in several partitions meets again among their border rows
    border = found.filter("t is not null").select(*row).distinct().repartition("t", F.substring("key", 1, 4 * MIN_DEPTH)).sortWithinPartitions("t", "key", "id")
    crossing = border.mapInArrow(_neighbours(least, percent, False), pair_schema)

    crowd = regions.filter(F.col("m") > CROWD)
    # written, so that no task holds the Python workers of two steps
    members = materialize(grown.filter(KeyFilter(crowd, ["p"], FILTER_BITS).hit("p")), "crowd")
    paths = members.groupBy("p", "key").agg(F.sum("w").alias("w"), F.min(F.struct(F.col("id").alias("hub"), F.col("sk").alias("hub_sk"), F.col("n").alias("hub_n"))).alias("h"))
    hubs = paths.groupBy("p").agg(F.max(F.struct("w", F.negative("h.hub").alias("o"), "h")).alias("x")).select("p", "x.h.*").join(crowd, "p", "left_semi")
    to_hub = members.select("p", "id", "sk", "n").join(hubs, "p").mapInArrow(_to_hub(least, percent), "a long, b long, est float")

    candidates = found.filter("t is null").select("a", "b", "est").union(crossing.select("a", "b", "est")).union(to_hub)
    edges = materialize(candidates.groupBy("a", "b").agg(F.max("est").alias("est")), "edges")
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    suspect = KeyFilter(ends, ["id"]).hit("doc_id")
    near = materialize(text.filter(suspect).join(ends, F.col("doc_id") == F.col("id"), "left_semi").dropDuplicates(), "near")

    labels = ends.select("id", F.col("id").alias("root"))
    still = edges.withColumns({"la": F.col("a"), "lb": F.col("b")})
    for step in range(ROUNDS + 1):
        if step < ROUNDS:
            both = still.select(F.explode(F.array("la", "lb")).alias("label"), F.struct("est", "a", "b", "la", "lb").alias("e"))
            picked = both.groupBy("label").agg(F.max("e").alias("e")).select("e.a", "e.b", "e.la", "e.lb").distinct()
        else:
            picked = still.select("a", "b", "la", "lb")
        picked = materialize(picked, "picked")
        sides = picked.select("a", "b", "la", "lb", F.explode(F.array("a", "b")).alias("id"))
        with_text = sides.join(near, F.col("id") == F.col("doc_id")).select("a", "b", "la", "lb", "id", "text")
        links = materialize(with_text.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_confirmed(shingle_words, percent), "la long, lb long"), "links")
        merged = connected(links.select(F.col("la").alias("u"), F.col("lb").alias("v")), materialize)
        merged = merged.select("node", F.col("root").alias("new"))
        moved = labels.join(merged, F.col("root") == F.col("node"), "left").select("id", F.coalesce("new", "root").alias("root"))
        labels = materialize(moved, "labels")
        if step == ROUNDS:
            break
        a_of, b_of = (labels.select(F.col("id").alias(x), F.col("root").alias(f"l{x}")) for x in "ab")
        open_ = still.select("a", "b", "est").join(picked.select("a", "b"), ["a", "b"], "left_anti").join(a_of, "a").join(b_of, "b").filter("la <> lb")
        still = materialize(open_.select("a", "b", "est", "la", "lb"), "open")
        if still.isEmpty():
            break

    crowded = members.join(crowd, "p", "left_semi").select("p", "id").distinct()
    if not crowded.isEmpty():
        inside = materialize(crowded.join(labels, "id", "left").select("p", "id", F.coalesce("root", "id").alias("root")), "inside")
        links = materialize(_crowd_links(inside, text, shingle_words, percent, materialize).distinct(), "crowd-links")
        if not links.isEmpty():
            merged = connected(links.select(F.col("la").alias("u"), F.col("lb").alias("v")), materialize).select("node", F.col("root").alias("new"))
            known = labels.union(inside.select("id", F.col("id").alias("root")).distinct().join(labels, "id", "left_anti"))
            moved = known.join(merged, F.col("root") == F.col("node"), "left").select("id", F.coalesce("new", "root").alias("root"))
            labels = materialize(moved, "labels")

    # rows alone with their set get a key of their own, so that they spread over the join's tasks
    copies = reps.filter("w > 1").select(F.col("fp").alias("k"), "rep")
    rows = sketch.select("doc_id", "n_shingles", F.coalesce("fp", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("k"))
    placed = rows.join(copies, "k", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    out = placed.join(labels, F.col("rep") == F.col("id"), "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("root", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
