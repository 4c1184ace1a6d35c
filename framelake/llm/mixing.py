"""Mixing to target weights by soft membership.

A classifier fitted on the labelled table gives every document posteriors over the domains. Document rates
r >= 0 are then fitted so that the expected tokens of every domain, sum(rate * tokens * posterior), match the targets
in least squares. The fit is projected gradient descent from r = 1 in the metric that weighs documents by tokens, with
the domains' Gram matrix over documents whose rate is not 0 as scaling:

    r <- max(0, r - P g),   g = (G + eps)^-1 (A r - t)

A step that does not bring the totals closer is taken back and made shorter, at last with the matrix of all documents,
which always helps if anything does.
The descent ends when the targets are met, or when it comes no closer: then the rates are the least squares' own best, and
a warning tells by how much the targets are missed.

A step needs one vector g for the whole table, so a document's rate follows from its posteriors and the short list of
vectors so far. Each iteration is one pass that sums one vector of domains per task; nothing of a document is stored or
sent anywhere, and a lost task is simply run again.

A document is then taken floor(rate + u) times, u uniform by a hash of its id.

The classifier is a naive Bayes on hashed words and byte trigrams, counted on one half of a bounded sample of labelled
rows (``sample_rows`` in expectation, by hash) and calibrated by logistic regression on the other half. All totals,
gradients and rates cover every document.

Defined cases: null and empty texts have no tokens, posteriors equal to the domains' shares and rate 1; without labelled
rows posteriors are even; labels for ids that are not in the table are ignored; with several labels for an id the worst
counts; null ids and repeated rows are documents like any others; extra columns pass through ``take``; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import ALNUM, bounded_batches, chunks, materialize, unused, words_of

DOMAINS = ("good", "low", "toxic")
#: Target shares of tokens by domain. The total is such that the first domain keeps all its tokens.
TARGETS = (0.86, 0.08, 0.06)
SAMPLE_ROWS = 6000
WORDS, GRAMS = 1 << 15, 1 << 13
MAX_STEPS, TOLERANCE = 30, 1e-4
#: Word evidence below this is noise.
STRONG = 2.0
_U = np.uint64


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and their text numbers, trigram buckets and the texts' starts among them; what reaches into the next text is GRAMS."""
    h, doc, _ = words_of(texts, ALNUM)
    x = np.frombuffer(b"".join(t + b"\n\n\n" for t in texts), np.uint8).astype(np.uint32)
    g = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(19)
    starts = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 3 for t in texts[:-1]], out=starts[1:])
    g[starts[1:] - 2] = g[starts[1:] - 1] = GRAMS
    return (h >> _U(49)).astype(np.int64), doc, g, starts


def _bytes(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((len(DOMAINS), WORDS + GRAMS + 1), np.int64)
    for batch in batches:
        raw, domain = _bytes(batch.column("text")), batch.column("domain").to_pylist()
        for i, j in chunks(raw):
            w, doc, g, starts = features(raw[i:j])
            cut = np.searchsorted(doc, np.arange(j - i + 1))
            for k in range(j - i):
                # a word counts once per text, so that one repetitive text can't shape a class
                total[domain[i + k], np.unique(w[cut[k] : cut[k + 1]])] += 1
                part = g[starts[k] : starts[k + 1] if k + 1 < j - i else None]
                total[domain[i + k], WORDS:-1] += np.bincount(part, minlength=GRAMS + 1)[:GRAMS]
                total[domain[i + k], -1] += 1
    d, f = np.nonzero(total)
    yield pa.RecordBatch.from_pydict({"domain": d, "feature": f, "n": total[d, f]})


class Classifier:
    def __init__(self, word: np.ndarray, gram: np.ndarray, weights: np.ndarray, shares: np.ndarray):
        self.word, self.weights, self.shares = word, weights, shares
        self.gram = np.concatenate([gram, np.zeros((len(gram), 1))], 1)

    def inputs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per text, for each domain but the first: mean trigram evidence, strong and strongest word evidence; and 1; its words."""
        w, doc, g, starts = features(texts)
        n = np.bincount(doc, minlength=len(texts))
        cut = np.concatenate([[0], np.cumsum(n)])
        sizes = np.diff(np.append(starts, len(g) + 2)) - 2
        out = np.zeros((len(texts), 3 * (len(DOMAINS) - 1) + 1))
        out[:, -1] = 1
        for d in range(1, len(DOMAINS)):
            out[:, 3 * d - 3] = np.add.reduceat(self.gram[d - 1][g], starts) / np.maximum(sizes, 1)
            e = self.word[d - 1][w]
            for k in range(len(texts)):
                part = e[cut[k] : cut[k + 1]]
                if len(part):
                    out[k, 3 * d - 2], out[k, 3 * d - 1] = math.log1p(np.maximum(part - STRONG, 0).sum()), part.max()
        return out, n

    def posteriors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        x, n = self.inputs(texts)
        z = np.concatenate([np.zeros((len(texts), 1)), x @ self.weights], 1)
        z = np.exp(z - z.max(1, keepdims=True))
        p = z / z.sum(1, keepdims=True)
        p[n == 0] = self.shares
        return p, n


def _inputs(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _bytes(batch.column("text"))
            for i, j in chunks(raw):
                x, _ = model.inputs(raw[i:j])
                yield pa.RecordBatch.from_pydict({"domain": batch.column("domain").slice(i, j - i), "x": pa.array(x.tolist(), pa.list_(pa.float64()))})

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """labels: doc_id, quality, toxic."""
    bounded_batches(docs.sparkSession)
    ident = F.col("doc_id")
    domain = F.when(F.max("toxic") == 1, 2).when(F.min("quality") == 0, 1).otherwise(0)
    said = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(domain.alias("domain"))
    n = labels.count()
    chosen = said.filter(F.pmod(F.xxhash64(F.lit(9), ident), F.lit(1_000_000)) < math.ceil(min(1.0, sample_rows / max(n, 1)) * 1_000_000))
    ids = chosen.select(ident.alias("__id"), "domain", F.pmod(F.xxhash64(F.lit(10), ident), F.lit(2)).alias("half"))
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null").join(F.broadcast(ids), "__id").select("text", "domain", "half")
    rows = materialize(rows, "labelled")
    counted = rows.filter("half = 0").select("text", "domain").mapInArrow(_counts, "domain long, feature long, n long").groupBy("domain", "feature").agg(F.sum("n").alias("n")).toPandas()
    c = np.zeros((len(DOMAINS), WORDS + GRAMS + 1))
    c[counted["domain"].astype(int), counted["feature"].astype(int)] = counted["n"].astype(float)
    model = Classifier(*_evidence(c), np.zeros((3 * (len(DOMAINS) - 1) + 1, len(DOMAINS) - 1)), np.full(len(DOMAINS), 1 / len(DOMAINS)))
    held = rows.filter("half = 1").select("text", "domain").mapInArrow(_inputs(model), "domain int, x array<double>").toPandas()
    if len(held):
        x, y = np.array(held["x"].tolist()), held["domain"].to_numpy()
        model.weights = _logistic(x, y)
        model.shares = np.bincount(y, minlength=len(DOMAINS)) / len(y)
    return model


def _evidence(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios of words and trigrams, each domain against the first. A word seen in few texts weighs less."""
    size = c[:, -1:] + 1e-9
    word, gram = c[:, :WORDS], c[:, WORDS:-1] + 0.5
    smooth = 0.5 * size / size.sum()
    rate = np.log((word + smooth) / (size + smooth))
    support = word.sum(0) / (word.sum(0) + 3)
    gram = np.log(gram / gram.sum(1, keepdims=True))
    return (rate[1:] - rate[0]) * support, gram[1:] - gram[0]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Multinomial logistic regression with the first class as reference, by Newton steps on standardised inputs."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    x = x / scale
    k, d = len(DOMAINS) - 1, x.shape[1]
    w = np.zeros((d, k))
    hot = np.stack([y == c + 1 for c in range(k)], 1).astype(float)
    for _ in range(60):
        z = np.concatenate([np.zeros((len(x), 1)), x @ w], 1)
        p = np.exp(z - z.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True))[:, 1:]
        grad = x.T @ (p - hot) / len(x) + ridge * w
        h = np.zeros((d * k, d * k))
        for a in range(k):
            for b in range(k):
                q = p[:, a] * ((a == b) - p[:, b])
                h[a * d : (a + 1) * d, b * d : (b + 1) * d] = (x * q[:, None]).T @ x / len(x)
        step = np.linalg.solve(h + ridge * np.eye(d * k), grad.T.ravel()).reshape(k, d).T
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w / scale[:, None]


def _posterior_rows(model: Classifier):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *[(f"p_{d}", pa.float64()) for d in DOMAINS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _bytes(batch.column("text"))
            for i, j in chunks(raw):
                p, n = model.posteriors(raw[i:j])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(i, j - i), "n_tokens": n, **{f"p_{d}": p[:, k] for k, d in enumerate(DOMAINS)}}, schema=schema)

    return run


def rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates of documents with posteriors p after these steps."""
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(0.0, r - p @ g)
    return r


def _sums(steps: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(DOMAINS)
        total, gram = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            p = np.stack([batch.column(f"p_{d}").to_numpy() for d in DOMAINS], 1)
            n = batch.column("n_tokens").to_numpy().astype(float)
            r = rates(p, steps)
            total += (r * n) @ p
            gram += (p * (n * (r > 0))[:, None]).T @ p
        v = [*total, *gram.ravel()]
        yield pa.RecordBatch.from_pydict({"k": np.arange(len(v), dtype=np.int32), "v": np.array(v)})

    return run


def posteriors(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens (words) and a posterior per domain; written once, read by every step."""
    schema = "doc_id long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return materialize(rows.mapInArrow(_posterior_rows(model), schema), "posteriors")


def fit_rates(table: DataFrame, targets: tuple[float, ...] = TARGETS, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """The steps of the descent; a document's rate follows from them and its posteriors."""
    k = len(DOMAINS)
    columns = [f"p_{d}" for d in DOMAINS]

    def totals(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sums = table.select("n_tokens", *columns).mapInArrow(_sums(steps), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().set_index("k")["v"]
        v = sums.reindex(range(k + k * k), fill_value=0.0).to_numpy()
        return v[:k], v[k:].reshape(k, k)

    return descend(totals, targets, max_steps, tolerance)


def descend(totals, targets: tuple[float, ...], max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """totals(steps) gives the domains' expected tokens and the Gram matrix of documents that keep a rate."""
    steps: list[np.ndarray] = []
    have, gram = totals(steps)
    goal = have[0] / targets[0] * np.array(targets)
    whole = max(goal.sum(), 1.0)
    ridge = 1e-6 * np.eye(len(goal))
    safe = np.linalg.inv(gram / whole + ridge)
    miss, scale, tries = (have - goal) / whole, safe, 0
    for _ in range(max_steps):
        if np.abs(miss).max() <= tolerance:
            return steps
        trial = [*steps, scale @ miss]
        have, gram = totals(trial)
        now = (have - goal) / whole
        gain = miss @ safe @ miss - now @ safe @ now
        if gain <= 1e-12 * (miss @ safe @ miss):
            if scale is safe:
                break
            tries += 1
            scale = scale / 4 if tries < 4 else safe
            continue
        steps, miss, tries = trial, now, 0
        scale = np.linalg.inv(gram / whole + ridge)
    if np.abs(miss).max() > tolerance:
        warnings.warn(f"target shares are missed by {np.round(np.abs(miss), 5).tolist()} of all tokens", stacklevel=2)
    return steps


UNIFORM = float(1 << 40)


def _uniform(id_col: str):
    return F.pmod(F.xxhash64(F.lit(77), F.col(f"`{id_col}`")), F.lit(1 << 40))


def _scored(model: Classifier, text_at: int):
    """Rows with their words and posteriors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _bytes(batch.column(text_at))
            for i, j in chunks(raw):
                p, n = model.posteriors(raw[i:j])
                part = batch.slice(i, j - i)
                more = [pa.array(n, pa.int64()), *(pa.array(p[:, k]) for k in range(len(DOMAINS)))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[f"c{k}" for k in range(part.num_columns + len(more))])

    return run


def _rate(steps: list[np.ndarray], n: str, p: list[str]) -> Column:
    """The rate of a document with n words and posteriors p after these steps; 1 without words."""
    rate = F.lit(1.0)
    for g in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((F.col(c) * F.lit(float(g[k])) for k, c in enumerate(p)), F.lit(0.0)))
    return F.when(F.col(n) == 0, F.lit(1.0)).otherwise(rate)


def _copies(rate: Column, id_col: str) -> Column:
    return F.floor(rate + _uniform(id_col) / F.lit(UNIFORM)).cast("int")


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """One row per document: doc_id, n_tokens, posteriors, rate, copies (how often the mix takes it)."""
    model = fit(docs, labels, id_col, text_col)
    table = posteriors(docs, model, id_col, text_col)
    rate = _rate(fit_rates(table, targets), "n_tokens", [f"p_{d}" for d in DOMAINS])
    return table.withColumn("rate", rate).withColumn("copies", _copies(F.col("rate"), "doc_id"))


def take(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """docs as the mix takes them: rows dropped or repeated, columns unchanged. Texts are scored once, where they lie, and never shuffled."""
    model = fit(docs, labels, id_col, text_col)
    text_at = next(k for k, c in enumerate(docs.columns) if c.lower() == text_col.lower())
    n, *p, copy = unused(docs.columns, "n_tokens", *(f"p_{d}" for d in DOMAINS), "copy")
    schema = StructType([*docs.schema.fields, StructField(n, LongType()), *(StructField(c, DoubleType()) for c in p)])
    scored = materialize(docs.mapInArrow(_scored(model, text_at), schema), "scored")
    steps = fit_rates(scored.select(F.col(n).alias("n_tokens"), *(F.col(c).alias(f"p_{d}") for c, d in zip(p, DOMAINS, strict=True))), targets)
    each = F.explode(F.array_repeat(F.lit(0), _copies(_rate(steps, n, p), id_col)))
    out = scored.withColumn(copy, each).select(*(f"`{c}`" for c in docs.columns))
    # a written table may hold nulls anywhere; where docs may not, its own schema is put back
    return out if out.schema == docs.schema else out.mapInArrow(lambda batches: batches, docs.schema)
