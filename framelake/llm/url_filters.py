"""URL filter: longest-match rules, then host word segmentation and multinomial naive Bayes.

1. Host and path are cut from the url; the longest rule that fits decides.
2. Words come from the pages' visible text, counted over all pages. Pages print their own hosts, so a name that stands
   between the dots of a host is counted apart: it does not vouch for itself when that label is split, though it does as
   a part of others, and words set off by hyphens count as words. A label is split by a unigram Viterbi pass; a word
   that was never counted costs ten over the total for its first, and ten times less for each letter. A label needs only
   the counts of its own substrings, so labels' substrings are joined to the word counts and each label is solved alone:
   no vocabulary is broadcast or cut.
3. Host and path tokens train a multinomial naive Bayes model on the urls that rules decided (distant labels), and the
   others get the class with the larger posterior. Token weights are joined by token; distinct hosts and paths are
   scored once, and a hot token's rows are split by adaptive execution. Rows of one token leave each task pre-summed.

Numbers in paths become one token per digit count, so page numbers carry no weight of their own.

Defined cases: labels of more than 63 letters, which no host has, stay whole; null urls and urls without ``://`` have empty host and path, fit no rule and are scored by the prior
alone; without urls that rules decided the verdict is allow; ties are allowed; null ids and repeated rows give a row
each; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_batches, materialize
from .html_text import render

#: Fixed value: letters of a host label at most, by the rules of host names.
LONGEST_LABEL = 63
_WORD = re.compile(r"[a-z]+")
#: Names joined by dots, as a host is printed; what stands between dots without a hyphen or digit is a whole label.
_HOST = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+")


def host_of(url: Column) -> Column:
    after = F.substring(url, F.call_function("instr", url, F.lit("://")) + 3, F.char_length(url))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    return F.when(F.call_function("instr", url, F.lit("://")) > 0, ascii_lower(host)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    after = F.substring(url, F.call_function("instr", url, F.lit("://")) + 3, F.char_length(url))
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(F.call_function("instr", url, F.lit("://")) > 0, path).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. rules: (verdict, host + path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def count_words(text: str, counts: Counter, named: Counter) -> None:
    """Add a text's words; those that are a whole label of a printed host are added to ``named`` as well."""
    text = text.lower()
    counts.update(_WORD.findall(text))
    if "." in text:
        named.update(label for host in _HOST.findall(text) for label in host.split(".") if label.isascii() and label.isalpha())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of lower-case words of pages' visible text; flushed before they grow large."""
    counts, named = Counter(), Counter()

    def out() -> pa.RecordBatch:
        n, m = list(counts.values()), [named[w] for w in counts]
        return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(n, pa.int64()), "named": pa.array(m, pa.int64())})

    for batch in batches:
        for page in batch.column(0).to_pylist():
            count_words(render(page or ""), counts, named)
            if len(counts) > 200_000:
                yield out()
                counts.clear()
                named.clear()
    if counts:
        yield out()


def segment(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable split of a label by unigram word probabilities; of equal ones that with the longest last word."""
    n = len(label)
    if n > LONGEST_LABEL:
        return [label]
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(end):
            s = best[start] + log_probability(label[start:end], counts, total)
            if s > best[end]:
                best[end], back[end] = s, start
    words, at = [], n
    while at:
        words.append(label[back[at] : at])
        at = back[at]
    return words[::-1]


def log_probability(word: str, counts: dict[str, int], total: int) -> float:
    c = counts.get(word, 0)
    return math.log(c / (total + 10)) if c else math.log(10 / (total + 10)) - len(word) * math.log(10)


def _segment_batches(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            known = [dict(x or ()) for x in batch.column("known").to_pylist()]
            yield pa.RecordBatch.from_pydict({"label": pa.array(labels, pa.string()), "words": pa.array([segment(w, k, total) for w, k in zip(labels, known, strict=True)], pa.list_(pa.string()))})

    return run


def segmented_labels(hosts: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct labels (runs of a-z) of hosts (column host) and their words, by counts over texts (one column of HTML)."""
    counted = texts.mapInArrow(_count_words, "word string, n long, named long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("named").alias("named"))
    counts = materialize(counted.filter(F.length("word") <= LONGEST_LABEL), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    labels = hosts.select(F.explode(F.regexp_extract_all("host", F.lit("([a-z]+)"), 1)).alias("label")).distinct()
    piece = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.char_length("label")), lambda k: F.transform(F.sequence(F.lit(1), F.char_length("label") - k + 1), lambda s: F.substring(F.col("label"), s, k)))))
    parts = labels.filter(F.char_length("label") <= LONGEST_LABEL).select("label", piece.alias("word")).distinct()
    free = F.col("n") - F.when(F.col("word") == F.col("label"), F.col("named")).otherwise(0)
    known = parts.join(counts, "word").select("label", "word", free.alias("n")).filter("n > 0").groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))
    return labels.join(known, "label", "left").select("label", "known").mapInArrow(_segment_batches(total), "label string, words array<string>")


def _tokens(host: Column, path: Column, words_of_host: Column) -> Column:
    paths = F.transform(F.regexp_extract_all(F.lower(path), F.lit("([a-z]+|[0-9]+)"), 1), lambda w: F.when(w.rlike("^[0-9]"), F.concat(F.lit("#"), F.char_length(w).cast("string"))).otherwise(w))
    return F.concat(F.transform(words_of_host, lambda w: F.concat(F.lit("h:"), w)), F.transform(paths, lambda w: F.concat(F.lit("p:"), w)))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, log_odds (of block; null where a rule decides)."""
    bounded_batches(pages.sparkSession)
    url = F.col(f"`{url_col}`")
    cut = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(F.coalesce(url, F.lit(""))).alias("host"), path_of(F.coalesce(url, F.lit(""))).alias("path"))
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    urls = cut.withColumns({"rule": rule, "ruled": ruled})
    shape = urls.withColumn("shape", F.regexp_replace(F.lower("path"), "[0-9]", "0"))
    kinds = materialize(shape.groupBy("host", "shape", "ruled").agg(F.count(F.lit(1)).alias("n")), "urls")

    words = segmented_labels(kinds.select("host").distinct(), pages.select(F.col(f"`{text_col}`")))
    labels = kinds.select("host").distinct().select("host", F.posexplode(F.regexp_extract_all("host", F.lit("([a-z]+)"), 1)).alias("k", "label"))
    hosts = labels.join(words, "label").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "words"))), lambda x: x["words"])).alias("words"))
    seen = kinds.join(hosts, "host", "left").select("host", "shape", "ruled", "n", _tokens(F.col("host"), F.col("shape"), F.coalesce("words", F.array().cast("array<string>"))).alias("tokens"))
    seen = materialize(seen, "tokens")

    block = F.when(F.col("ruled") == "block", F.col("n")).otherwise(0)
    allow = F.when(F.col("ruled") == "allow", F.col("n")).otherwise(0)
    taught = seen.filter("ruled is not null")
    docs = taught.agg(F.sum(block), F.sum(allow)).first()
    used = materialize(taught.select(F.explode("tokens").alias("token"), block.alias("b"), allow.alias("a")).groupBy("token").agg(F.sum("b").alias("b"), F.sum("a").alias("a")), "weights")
    size = used.agg(F.count(F.lit(1)), F.sum("b"), F.sum("a")).first()
    nb, na, v = (size[1] or 0), (size[2] or 0), size[0] + 1
    prior = math.log(((docs[0] or 0) + 1) / ((docs[1] or 0) + 1)) if docs[0] or docs[1] else 0.0
    weight = F.log((F.col("b") + 1) / F.lit(float(nb + v))) - F.log((F.col("a") + 1) / F.lit(float(na + v)))
    weights = used.select("token", weight.alias("w"))
    open_ = seen.filter("ruled is null")
    scores = open_.select("host", "shape", F.explode("tokens").alias("token")).join(weights, "token").groupBy("host", "shape").agg(F.sum("w").alias("w"))
    back = shape.join(scores.select(F.col("host").alias("sh"), F.col("shape").alias("ss"), "w"), (F.col("host") == F.col("sh")) & (F.col("shape") == F.col("ss")) & F.col("ruled").isNull(), "left")
    odds = F.when(F.col("ruled").isNull(), F.round(F.coalesce("w", F.lit(0.0)) + F.lit(prior), 9))
    return back.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(odds > 0, "block").otherwise("allow")).alias("verdict"), odds.alias("log_odds"))
