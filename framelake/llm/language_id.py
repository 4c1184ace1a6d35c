"""Language identification by Bayesian evidence fusion.

Evidence for a row's language l, all multiplied: the likelihood of its text (smoothed byte-trigram model), the
language its markup declares, the language its address names (country suffix or first path segment), and a prior from
its host. How far declarations and addresses can be trusted is estimated, not assumed: P(said | l) is counted over all
rows. Host priors are hierarchical: grouped sums of the rows' text posteriors per host, domain and suffix, each level
smoothed by the next (leaving the row itself out), the suffix by the whole table.

"und" competes as a language of its own, with evenly spread trigrams. A row is rejected if it has no letters or "und"
wins; nothing else is rejected.

The model is fitted on a bounded sample of labelled rows (``sample_rows`` in expectation, chosen by hash); all counts
and priors cover every row. Only per-language tables of fixed size reach the driver. The host table is broadcast when it has
at most ``broadcast_hosts`` rows and joined by shuffle beyond.

Defined cases: null or empty text has no likelihood and is rejected; null url, html language or host give no evidence;
null ids and repeated rows give a row each; ties go to the first language by name; without labelled rows everything is
"und"; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _FOLD, bounded_batches, chunks, materialize

GRAMS = 1 << 13
SAMPLE_ROWS = 4000
BROADCAST_HOSTS = 50_000
#: Weight of one trigram's log likelihood: neighbouring trigrams are not independent.
TEMPER = 1 / 3
STRENGTH = 20.0
_CLEAN = np.array([_FOLD[b] if b >= 0x80 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bucket per byte position, the start of each text among them, and each text's number of letter bytes.

    The two positions whose trigram would reach into the next text get bucket GRAMS, which says nothing.
    """
    joined = _CLEAN[np.frombuffer(b"".join(t + b"\n\n\n" for t in texts), np.uint8)]
    x = joined.astype(np.uint32)
    g = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(19)
    lengths = np.array([len(t) + 3 for t in texts], np.int64)
    starts = np.zeros(len(texts), np.int64)
    np.cumsum(lengths[:-1], out=starts[1:])
    g[starts[1:] - 2] = g[starts[1:] - 1] = GRAMS
    letters = np.add.reduceat((joined != 32).astype(np.int64), starts)
    return g, starts, letters


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, raw = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()
        for i, j in chunks([x or b"" for x in raw]):
            g, starts, _ = trigrams([x or b"" for x in raw[i:j]])
            for lang, part in zip(langs[i:j], np.split(g, starts[1:]), strict=True):
                counts.setdefault(lang, np.zeros(GRAMS, np.int64))
                counts[lang] += np.bincount(part, minlength=GRAMS + 1)[:GRAMS]
    for lang, c in counts.items():
        k = np.flatnonzero(c)
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(k), "gram": k, "n": c[k]})


class Model:
    """languages, and log probabilities [GRAMS, languages + 1]; the last column is "und"."""

    def __init__(self, languages: list[str], logp: np.ndarray):
        self.languages, self.logp = languages, logp


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.lower(F.trim(F.col(f"`{lang_col}`"))).alias("lang"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("id")).filter("lang is not null and lang <> '' and text is not null")
    n = labelled.select(lang_col).filter(F.col(f"`{lang_col}`").isNotNull()).count()
    share = min(1.0, sample_rows / max(n, 1))
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    counted = chosen.select("lang", "text").mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in counted})
    c = np.full((GRAMS, len(languages)), 0.5)
    for r in counted:
        c[r["gram"], languages.index(r["lang"])] += r["n"]
    even = np.full((GRAMS, 1), 1 / GRAMS)
    return Model(languages, np.log(np.concatenate([c / c.sum(0), even], 1)))


def _score(logp: np.ndarray):
    schema = pa.schema([("ll", pa.list_(pa.float64())), ("letters", pa.int64())])
    columns = [np.append(logp[:, k], 0.0) for k in range(logp.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
            named = {n: batch.column(n) for n in batch.schema.names if n != "text"}
            for i, j in chunks(raw):
                g, starts, letters = trigrams(raw[i:j])
                ll = np.stack([np.add.reduceat(c[g], starts) for c in columns], 1) * TEMPER
                ll -= ll.max(1, keepdims=True)
                yield pa.RecordBatch.from_pydict({n: c.slice(i, j - i) for n, c in named.items()} | {"ll": pa.array(ll.tolist(), schema.field(0).type), "letters": letters})

    return run


def identify(rows: DataFrame, model: Model, keys: list[str], broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """rows: key columns, text, host, declared and named (language codes or null). Adds language, confidence, kept and the evidence."""
    bounded_batches(rows.sparkSession)
    langs = model.languages
    spots = [*langs, "und"]
    norm = lambda c: F.regexp_extract(F.lower(c), "^ *([a-z]+)", 1)
    known = lambda c: F.when(norm(c).isin(langs) if langs else F.lit(False), norm(c)).when(c.isNull() | (norm(c) == ""), F.lit("")).otherwise(F.lit("?"))
    host = F.lower(F.coalesce("host", F.lit("")))
    prepared = rows.select(*keys, "text", host.alias("host"), F.substring_index(host, ".", -2).alias("domain"), F.substring_index(host, ".", -1).alias("suffix"), known(F.col("declared")).alias("declared"), known(F.col("named")).alias("named"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prepared.schema if f.name != "text")
    scored = prepared.mapInArrow(_score(model.logp), f"{schema}, ll array<double>, letters long")
    total = F.aggregate("ll", F.lit(0.0), lambda a, x: a + F.exp(x))
    scored = materialize(scored.withColumn("post", F.when(F.col("letters") > 0, F.transform("ll", lambda x: F.exp(x) / total))), "scored")

    at = lambda c, k: F.element_at(c, k + 1)
    sums = [F.sum(F.coalesce(at(F.col("post"), k), F.lit(0.0))).alias(f"s{k}") for k in range(len(spots))]
    # grouped sums, from the finest level up: the coarser levels add up the finer ones
    by_host = materialize(scored.groupBy("host", "domain", "suffix", "declared", "named").agg(*sums), "evidence")
    again = [F.sum(f"s{k}").alias(f"s{k}") for k in range(len(spots))]
    said = {c: {r[0]: [r[k + 1] for k in range(len(spots))] for r in by_host.groupBy(c).agg(*again).collect()} for c in ("declared", "named")}
    whole = by_host.agg(*again).first()
    whole = [(x or 0.0) + 1 for x in whole]
    prior_all = [x / sum(whole) for x in whole]

    hosts, domains, suffixes = (by_host.groupBy(*g).agg(*again) for g in (["host", "domain", "suffix"], ["domain"], ["suffix"]))
    array = lambda p: F.array(*[F.col(f"s{k}") for k in range(len(spots))]).alias(p)
    table = hosts.select("host", "domain", "suffix", array("h")).join(domains.select("domain", array("d")), "domain").join(suffixes.select("suffix", array("x")), "suffix")
    table = materialize(table.select(F.col("host").alias("th"), "h", "d", "x"), "hosts")
    if table.count() <= broadcast_hosts:
        table = F.broadcast(table)
    joined = scored.join(table, F.col("host") == F.col("th"))

    def level(counts: str, k: int, parent: Column) -> Column:
        """Smoothed share of language k at one level, without the row itself."""
        own = F.coalesce(at(F.col("post"), k), F.lit(0.0))
        n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) - F.when(F.col("letters") > 0, 1.0).otherwise(0.0)
        return (F.greatest(at(F.col(counts), k) - own, F.lit(0.0)) + STRENGTH * parent) / (F.greatest(n, F.lit(0.0)) + STRENGTH)

    def trust(c: str, k: int) -> Column:
        """log P(said | language k), smoothed; nothing said is no evidence."""
        out = F.lit(0.0)
        column = sum(v[k] for v in said[c].values()) + 1
        for value, v in sorted(said[c].items()):
            if value:
                out = F.when(F.col(c) == value, F.lit(math.log((v[k] + 1 / (len(said[c]) + 1)) / column))).otherwise(out)
        return out

    priors = [level("h", k, level("d", k, level("x", k, F.lit(prior_all[k])))) for k in range(len(spots))]
    fused = [F.struct((at(F.col("ll"), k) + F.log(priors[k]) + trust("declared", k) + trust("named", k)).alias("s"), F.lit(-k).alias("o"), F.lit(name).alias("l")) for k, name in enumerate(spots)]
    out = joined.withColumn("all", F.array(*fused)).withColumn("best", F.array_max("all"))
    mass = F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x["s"] - F.col("best.s")))
    kept = (F.col("letters") > 0) & (F.col("best.l") != "und")
    return out.select(*keys, F.when(F.col("letters") > 0, F.col("best.l")).otherwise(F.lit("und")).alias("language"), F.when(F.col("letters") > 0, F.round(1 / mass, 6)).otherwise(F.lit(0.0)).alias("confidence"), "declared", "named", "letters", kept.alias("kept"))
