"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only.

Each step shuffles a few integers per row and keeps the keys that still hold more than one row. The keys that
survive travel to the next scan as a bit filter of fixed size (KeyFilter), so a full text is hashed only where its
length and prefix already agree with another row's. False filter hits cost a hash, never a result. Groups are
formed by partial aggregation, so a group with a third of all rows leaves each task as one row. Filters are written
once, as several steps read them.

``drop_exact_duplicates`` decides on ids and hashes alone. The next scan has two filters: ids of rows that go, ids of
rows that stay. A row that misses either is decided where it lies; only rows that hit both (false hits, ids that repeat)
are joined with their texts.

Defined cases: null text counts as empty, and all empty texts are equal; a null id never becomes a group's keep_id
unless all its ids are null; of rows that repeat one id and one text exactly one is kept, the first by its other columns in
``exact_duplicates``, any one in ``drop_exact_duplicates``; further columns pass through the latter unchanged, whatever
their names, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KeyFilter, ascii_lower, materialize, unused

PREFIX_CHARS = 256
FILTER_BITS = 1 << 20
#: Filters of ids have sixteen bits an id, up to this size (a MB).
MOST_BITS = 1 << 23


def normalized(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


class _Refined:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, filter_bits: int):
        raw = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
        self.size, self.prefix = F.octet_length(raw), F.xxhash64(ascii_lower(F.substring(raw, 1, prefix_chars)))
        self.full = F.sha2(normalized(raw).cast("binary"), 256)
        ident = F.col(f"`{id_col}`")
        lengths = docs.select(self.size.alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        self.by_length = KeyFilter(lengths, ["n"], filter_bits, "lengths")
        at = docs.filter(self.by_length.hit(self.size))
        prefixes = at.select(self.size.alias("n"), self.prefix.alias("p")).groupBy("n", "p").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        self.by_prefix = KeyFilter(prefixes, ["n", "p"], filter_bits, "prefixes")
        #: True where length and prefix agree with another row's; only these rows have their full text hashed.
        self.suspect = self.by_length.hit(self.size) & self.by_prefix.hit(self.size, self.prefix)
        #: Id and full hash of the suspects.
        self.rows = materialize(docs.filter(self.suspect).select(ident.alias("doc_id"), self.full.alias("full")), "suspects")
        by_id = self.rows.groupBy("full", "doc_id").agg(F.count(F.lit(1)).alias("c"))
        groups = by_id.groupBy("full").agg(F.max(F.struct("doc_id", "c")).alias("m"), F.sum("c").alias("members")).filter("members > 1")
        #: Hash, id that stays, rows with that id (one, unless ids repeat), rows in all. Written once, as several steps read it.
        self.groups = materialize(groups.select("full", F.col("m.doc_id").alias("keep"), F.col("m.c").alias("twins"), "members"), "groups")
        self.repeated = not self.groups.filter("twins > 1").isEmpty()

    def joined(self, rows: DataFrame, full: str, spread: Column, names: list[str]) -> DataFrame:
        """rows with their group's keep, twins and members under these names, or nulls.

        Groups with a thousandth of all grouped rows or more - a thousand at most - are broadcast; the others are joined
        by shuffle, where the rows of broadcast groups lie under ``spread``.
        """
        keep, twins, members, key = names
        left, right = ({n: f for n, f in zip(("full", "keep", "twins", "members"), part)} for part in (unused([*rows.columns, *names], *"abcd"), unused([*rows.columns, *names], *"efgh")))
        total = self.groups.agg(F.sum("members").alias("n")).scalar()
        large = F.col("members") * HOT_GROUPS >= total
        named = lambda g, to: g.select(*(F.col(c).alias(n) for c, n in to.items()))
        a = rows.join(F.broadcast(named(self.groups.filter(large), left)), F.col(full) == F.col(left["full"]), "left")
        a = a.withColumn(key, F.when(F.col(left["full"]).isNotNull(), spread).otherwise(F.col(full)))
        b = a.join(named(self.groups.filter(~large), right), F.col(key) == F.col(right["full"]), "left")
        both = [F.coalesce(left[c], right[c]).alias(n) for c, n in (("keep", keep), ("twins", twins), ("members", members))]
        return b.select(*(f"`{c}`" for c in rows.columns), *both)


#: As many groups may have a share of one in so many of all grouped rows; they are broadcast.
HOT_GROUPS = 1000


#: Rows that one row of counts stands for at most, when it is spread out again.
SPREAD = 1 << 16


def _one_kept(twins: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that repeat id and text, one of them kept. Equal rows meet as counts and are spread out again in parts."""
    first = Window.partitionBy("full").orderBy(*columns)
    counted = twins.groupBy("full", *columns).agg(F.count(F.lit(1)).alias("c")).withColumn("at", F.row_number().over(first))
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / SPREAD)))).repartition("full", "part")
    rows = F.least(F.lit(SPREAD).cast("long"), F.col("c") - F.col("part") * SPREAD)
    each = parts.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), rows)))
    return each.select("full", *columns, ((F.col("at") == 1) & (F.col("part") == 0) & (F.col("k") == 1)).alias("kept"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, filter_bits: int = FILTER_BITS, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id (largest id of its equal texts), group_size, kept; ``extra`` adds columns of docs."""
    r = _Refined(docs, id_col, text_col, prefix_chars, filter_bits)
    ident = F.col(f"`{id_col}`")
    named = [c.alias(n) for n, c in (extra or {}).items()]
    # rows without a suspect hash get a key of their own, so that they spread over the join's tasks
    own = F.concat(F.lit("#"), F.coalesce(ident.cast("string"), F.lit("")))
    keyed = docs.select(ident.alias("doc_id"), F.when(r.suspect, r.full).otherwise(own).alias("full"), *named)
    spread = F.concat(F.lit("#"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    joined = r.joined(keyed, "full", spread, ["keep", "twins", "members", "key"])
    twin = F.coalesce((F.col("twins") > 1) & F.col("doc_id").eqNullSafe(F.col("keep")), F.lit(False))
    keep = F.when(F.col("members").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    columns = ["doc_id", "keep_id", "group_size", *(extra or {})]
    shaped = lambda df: df.select("full", "doc_id", keep.alias("keep_id"), F.coalesce("members", F.lit(1).cast("long")).alias("group_size"), *(extra or {}))
    out = shaped(joined.filter(~twin) if r.repeated else joined).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if r.repeated:
        out = out.unionByName(_one_kept(shaped(joined.filter(twin)), columns))
    return out.select("doc_id", "keep_id", "group_size", "kept", *(extra or {}))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """docs without the rows whose text another row stands for. Texts are shuffled only where the filters of ids leave a row open."""
    r = _Refined(docs, id_col, text_col, prefix_chars, filter_bits)
    full, keep, twins, *more = unused(docs.columns, "full", "keep", "twins", "members", "key")
    ident = F.col(f"`{id_col}`")
    spread = lambda c: F.concat(F.lit("#"), F.coalesce(c.cast("string"), F.lit("")))
    judged = r.joined(r.rows, "full", spread(F.col("doc_id")), ["keep", "twins", "members", "key"])
    stays = F.col("twins").isNull() | F.col("doc_id").eqNullSafe(F.col("keep"))
    # of rows that repeat id and text one stays: their id is on both sides
    judged = materialize(judged.select("doc_id", stays.alias("stays"), (~stays | F.coalesce(F.col("twins") > 1, F.lit(False))).alias("goes")), "judged")
    bits = max(filter_bits, min(1 << (16 * judged.count()).bit_length(), MOST_BITS))
    goes, stay = (KeyFilter(judged.filter(c).select("doc_id"), ["doc_id"], bits, c).hit(ident) for c in ("goes", "stays"))
    clear = docs.filter(~r.suspect | ~goes)
    found = docs.filter(r.suspect & goes & stay).withColumn(full, r.full)
    left = r.joined(found, full, spread(ident), [keep, twins, *more])
    stays = left.filter(F.col(twins).isNull() | ident.eqNullSafe(F.col(keep)))
    columns = [f"`{c}`" for c in docs.columns]
    if not r.repeated:
        return clear.unionByName(stays.select(*columns))
    again = F.coalesce(F.col(twins) > 1, F.lit(False))
    once = stays.filter(again).dropDuplicates([full])
    return clear.unionByName(stays.filter(~again).select(*columns)).unionByName(once.select(*columns))
