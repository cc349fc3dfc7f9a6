"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior:

- text: naive Bayes over hashed byte trigrams of the visible text, learnt from
  at most TRAIN labelled documents (those whose doc_id hashes lowest, one row each); long
  texts are tempered to TEMPER trigrams' worth, as trigrams aren't independent
- the declared markup language (html lang), by how often each declaration goes
  with each language over all pages
- the address suffix and the host, as one prior smoothed hierarchically: host
  towards suffix towards all pages, without the page's own share

Counts are expected counts under the text posterior, from grouped aggregation
over all pages. Pages of a host are salted, so a host may hold a third of them.

Defined results: null html is an empty page, null or odd addresses have an
empty host and suffix; pages without text get the prior with their
declaration; without labelled documents lang is null; ties go to the language
first by code point; repeated rows count as often as they occur; other columns
are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import stage

BUCKETS, TRAIN, TEMPER, SMOOTH, HOST_WEIGHT, SUFFIX_WEIGHT, SALTS = 1 << 15, 8192, 60.0, 0.5, 8.0, 50.0, 16
#: Evidence is not believed beyond this share of another language.
LEAST = 0.002

_OPENED = re.compile(r"<(?:(script|style|nav|footer|aside)\b|!--)", re.I)
_CLOSED = {k: re.compile(rf"</{k}\s*+>", re.I) for k in ("script", "style")} | {"!": re.compile("-->")}
_CLOSED |= dict.fromkeys(("nav", "footer", "aside"), re.compile(r"</(?:nav|footer|aside)\s*+>", re.I))
_TAG = re.compile(r"<[^>]*+>")
_HTML = re.compile(r"<html\b[^>]*+", re.I)
_LANG = re.compile(r"\slang\s*+=\s*+[\"']?([A-Za-z]+)", re.I)


def without_hidden(page: str) -> str:
    """The page without what lies between tags of hidden elements. Every search starts where the last one ended, so time is in proportion to the page."""
    out, at, shown, unclosed = [], 0, 0, set()
    while m := _OPENED.search(page, at):
        kind = (m[1] or "!").lower()
        end = None if kind in unclosed else _CLOSED[kind].search(page, m.end())
        if end is None:
            unclosed.add(kind)
            at = m.end()
            continue
        out += [page[shown : m.start()], " "]
        at = shown = end.end()
    return "".join(out) + page[shown:]


def visible_text(page: str) -> str:
    page = without_hidden(page)
    last = page.rfind(">") + 1  # no tag ends after it
    return html_lib.unescape(_TAG.sub(" ", page[:last]) + page[last:])


def declared_language(page: str) -> str:
    """The primary subtag of the first html tag's lang, or nothing."""
    tag = _HTML.search(page)
    m = _LANG.search(tag[0]) if tag else None
    return m[1].lower() if m else ""


def host_of(url: str | None) -> tuple[str, str]:
    """(host, suffix); the suffix is the last label, none for numbers."""
    try:
        host = (urlsplit(url or "").hostname or "").lower().removeprefix("www.")
    except ValueError:
        host = ""
    last = host.rpartition(".")[2]
    return host, "" if last.isdigit() or last == host else last


_LOWER = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def trigrams(text: bytes) -> np.ndarray:
    """Hashed byte trigrams of the letters, one space between words."""
    u = np.frombuffer(b" " + b" ".join(text.translate(_LOWER).split()) + b" ", np.uint8).astype(np.uint32)
    h = (u[:-2] * np.uint32(0x9E3779B1)) ^ (u[1:-1] * np.uint32(0x85EBCA77)) ^ (u[2:] * np.uint32(0xC2B2AE3D))
    return (h >> np.uint32(17)).astype(np.int64)


def _learn(batches):
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        for t, lang in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("lang").to_pylist(), strict=True):
            c = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            c += np.bincount(trigrams(t or b""), minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c.tobytes() for c in counts.values()], pa.binary())], ["lang", "counts"])


def fit(docs: DataFrame, most: int = TRAIN) -> tuple[list[str], np.ndarray]:
    """Languages by code point, and their log probabilities by bucket. What the driver gets is bounded by `most`."""
    flat = docs.select("doc_id", F.col("lang").cast("string"), F.col("text").cast("string")).filter("lang is not null and text is not null")
    chosen = flat.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # one row for each doc_id, and few tasks for these rows alone
    rows = flat.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x"))
    rows = rows.select("x.text", "x.lang").repartition(8).mapInArrow(_learn, "lang string, counts binary").collect()
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        counts[r["lang"]] = counts.get(r["lang"], 0) + np.frombuffer(r["counts"], np.int64)
    langs = sorted(counts)
    table = np.array([counts[x] + SMOOTH for x in langs], float).reshape(len(langs), BUCKETS)
    return langs, np.log(table / table.sum(1, keepdims=True)) if langs else table


def text_posterior(text: bytes, table: np.ndarray) -> np.ndarray:
    """Normalised likelihoods; even for a text without letters."""
    h = trigrams(text)
    if not text.translate(_LOWER).split():
        return np.full(len(table), 1 / len(table))
    s = table[:, h].sum(1) * min(1.0, TEMPER / len(h))
    e = np.exp(s - s.max())
    p = np.maximum(e / e.sum(), LEAST)
    return p / p.sum()


def _evidence(model):
    def run(batches):
        _, table = model.value
        for b in batches:
            pages = [p or "" for p in b.column("html").to_pylist()]
            hosts = [host_of(u) for u in b.column("url").to_pylist()]
            like = [text_posterior(visible_text(p).encode("utf-8", "replace"), table).tolist() for p in pages]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), pa.array([h for h, _ in hosts]), pa.array([s for _, s in hosts]), pa.array([declared_language(p) for p in pages]), pa.array(like, pa.list_(pa.float64()))],
                ["page_id", "host", "suffix", "declared", "like"],
            )

    return run


def _sums(df: DataFrame, keys: list[str], column: str, n: int, to: str) -> DataFrame:
    """Arrays of `column` summed by keys, with partial sums before the shuffle."""
    parts = df.groupBy(*keys).agg(*(F.sum(F.col(column)[i]).alias(f"_{i}") for i in range(n)))
    return parts.select(*keys, F.array(*(F.col(f"_{i}") for i in range(n))).alias(to))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, suffix, declared, text_lang, lang, confidence."""
    spark = pages.sparkSession
    langs, table = fit(docs)
    flat = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    none = F.lit(None).cast("string")
    if not langs:
        return flat.select("page_id", *(none.alias(c) for c in ("host", "suffix", "declared", "text_lang", "lang")), F.lit(None).cast("double").alias("confidence"))
    model = spark.sparkContext.broadcast((langs, table))
    n = len(langs)
    kind = flat.schema["page_id"].dataType.simpleString()
    rows = stage(flat.mapInArrow(_evidence(model), f"page_id {kind}, host string, suffix string, declared string, like array<double>"), "pages")
    hosts = _sums(rows, ["host", "suffix"], "like", n, "host_sum")
    suffixes = _sums(hosts, ["suffix"], "host_sum", n, "suffix_sum")
    declared = _sums(rows, ["declared"], "like", n, "declared_sum")
    every = _sums(suffixes, [], "suffix_sum", n, "all_sum")
    by_lang = _sums(declared, [], "declared_sum", n, "lang_sum")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    # the page's own share is taken out of its host, as its text is counted by itself
    less = lambda a: F.zip_with(a, "like", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    prior_all = F.transform("all_sum", lambda x: (x + 1.0) / (total("all_sum") + float(n)))
    prior_suffix = F.zip_with("suffix_sum", "prior_all", lambda x, p: (x + SUFFIX_WEIGHT * p) / (total("suffix_sum") + SUFFIX_WEIGHT))
    prior_host = F.zip_with("own", "prior_suffix", lambda x, p: (x + HOST_WEIGHT * p) / (total("own") + HOST_WEIGHT))
    said = F.zip_with("declared_sum", "lang_sum", lambda x, y: (x + SMOOTH) / (y + SMOOTH * 20))
    hosts = hosts.join(suffixes.withColumn("all_sum", every.scalar()), "suffix").withColumn("prior_all", prior_all).withColumn("prior_suffix", prior_suffix)
    hosts = hosts.select(F.col("host").alias("h"), F.col("suffix").alias("s"), "host_sum", "prior_suffix", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("z"))
    declared = declared.withColumn("lang_sum", by_lang.scalar()).select(F.col("declared").alias("d"), said.alias("said"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("y"))
    salt = F.pmod(F.xxhash64("page_id", "like"), F.lit(SALTS)).cast("int")
    joined = rows.withColumn("salt", salt).join(hosts, (F.col("host") == F.col("h")) & (F.col("suffix") == F.col("s")) & (F.col("salt") == F.col("z")))
    joined = joined.join(declared, (F.col("declared") == F.col("d")) & (F.col("salt") == F.col("y")))
    joined = joined.withColumn("own", less(F.col("host_sum"))).withColumn("prior", prior_host)
    post = F.zip_with(F.zip_with("like", "prior", lambda a, b: a * b), "said", lambda a, b: a * b)
    joined = joined.withColumn("post", post).withColumn("sum", total("post"))
    names = F.array(*(F.lit(x) for x in langs))
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    return joined.select(
        "page_id", "host", "suffix", "declared", best(F.col("like")).alias("text_lang"), best(F.col("post")).alias("lang"),
        F.round(F.array_max("post") / F.col("sum"), 6).alias("confidence"),
    )


def op3(pages: DataFrame, docs: DataFrame) -> DataFrame:
    return identify(pages, docs)
