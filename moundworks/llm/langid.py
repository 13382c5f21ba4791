"""Language of web pages by Bayesian fusion of what the text, the markup and the address say.

The text's likelihood comes from character trigrams of texts of known language. The declared language
enters as P(declared | language) and the address through a prior by host, smoothed towards that of
the address's suffix, which is smoothed towards that of all pages. These tables are counts of what the
texts of all other pages say: they are summed by grouped aggregation over all pages, and a page's own
count is taken out again before its tables are used.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundworks.llm import shared

BITS = 16
DROP = re.compile(r"<!--.*?-->|<(script|style|nav|title)\b.*?</\1\s*>|<[^<>]*>", re.I | re.S)


def plain(page: str) -> str:
    return html.unescape(DROP.sub(" ", page))


def trigrams(text: str) -> np.ndarray:
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4").copy()
    c[c < 65] = 32
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    h = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1]) * np.uint32(0x85EBCA6B) + c[2:]
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)


def train(docs: DataFrame, train_rows: int = 20_000, most_langs: int = 256) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each trigram slot in each. Trained on at most
    ``train_rows`` distinct rows (doc_id and text) of known language, those of the smallest hash; a
    bound on the hash picks them where they are, and only sums come to the driver: a row of slots for each
    language. More than ``most_langs`` languages among all rows are an error."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2).alias("h"))
    n, n_langs = known.agg(F.count("*"), F.count_distinct("lang")).first()
    if n_langs > most_langs:
        raise ValueError(f"{n_langs} languages, more than most_langs={most_langs}")
    share = int(min(1.0, 1.2 * train_rows / max(n, 1)) * (1 << 62)) - 1  # about a fifth more than wanted
    first = known.where(F.col("h") <= share).select("h").distinct().orderBy("h").limit(train_rows + 1).agg(F.max("h").alias("h"), F.count("*").alias("n")).first()
    bound = first["h"] if first["n"] > train_rows else share + 1
    some = known.where(F.col("h") < bound).dropDuplicates(["h"]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault(lang, np.zeros(1 << BITS, np.int64))[:] += np.bincount(trigrams(text), minlength=1 << BITS)
        for lang, n in total.items():
            slot = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot)), pa.array(slot), pa.array(n[slot])], names=["lang", "slot", "n"])

    sums = some.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    n = np.full((len(langs), 1 << BITS), 0.5)
    for k, lang in enumerate(langs):
        own = sums[sums["lang"] == lang]
        n[k, own["slot"].to_numpy()] += own["n"].to_numpy()
    return langs, np.log(n / n.sum(axis=1, keepdims=True))


def identify(pages: DataFrame, docs: DataFrame, trust: float = 50.0, most_trigrams: float = 200.0, train_rows: int = 20_000, most_langs: int = 256) -> DataFrame:
    """Per row of ``pages``: page_id, lang, probability, text_lang, declared, host, suffix.

    Trigrams overlap, so a text speaks as loudly as ``most_trigrams`` of them at most. ``trust`` is
    how many pages the coarser prior counts as. The tables of host, suffix, declaration and all pages are
    those of the other pages, so a page's text is heard once. A page without text, declaration or host gets what
    the rest says, in the end the prior of all other pages; with no row of known language lang is null. A
    null page_id stays null, repeated rows are each a row and count as often, an empty table gives no
    rows, and other columns, whatever their names, are not looked at.
    """
    spark = pages.sparkSession
    shared.ship(spark)
    langs, table = train(docs, train_rows, most_langs)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]+)", 1))
    rows = pages.select("page_id", host.alias("host"), F.element_at(F.split(host, r"\."), -1).alias("suffix"), declared.alias("declared"), F.coalesce("html", F.lit("")).alias("html"))
    if not langs:
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), "declared", "host", "suffix")
    n_langs = len(langs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = []
            for page in batch.column(4).to_pylist():
                t = trigrams(plain(page))
                log = table[:, t].sum(axis=1) if len(t) > 1 else np.zeros(n_langs)
                said.append((log - log.max()) * min(1.0, most_trigrams / max(len(t), 1)))
            said = np.array(said).reshape(-1, n_langs)
            best = pa.array([langs[k] if row.any() else None for k, row in zip(said.argmax(axis=1), said, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(list(said), pa.list_(pa.float64())), best], names=["page_id", "host", "suffix", "declared", "said", "text_lang"])

    kind = dict(pages.dtypes)["page_id"]
    seen = shared.staged(rows.mapInArrow(read, f"page_id {kind}, host string, suffix string, declared string, said array<double>, text_lang string"), "pages-read")

    def counts(x: DataFrame, by: str) -> DataFrame:
        return x.where("text_lang IS NOT NULL").groupBy(by).agg(*[F.count_if(F.col("text_lang") == lang).alias(f"{by}_{k}") for k, lang in enumerate(langs)])

    total = seen.agg(*[F.count_if(F.col("text_lang") == lang).alias(f"all_{k}") for k, lang in enumerate(langs)])
    by_host = counts(seen, "host")
    by_suffix = counts(seen, "suffix")
    by_declared = counts(seen, "declared")

    own = [F.coalesce(F.col("text_lang") == lang, F.lit(False)).cast("long") for lang in langs]

    def others(p: str, k: int) -> Column:
        return F.coalesce(F.col(f"{p}_{k}"), F.lit(0)) - own[k]

    def row_sum(p: str) -> Column:
        return sum((others(p, k) for k in range(n_langs)), F.lit(0))

    x = seen.join(by_host, "host", "left").join(by_suffix, "suffix", "left").join(by_declared, "declared", "left").crossJoin(F.broadcast(total))  # one row
    logs = []
    for k in range(n_langs):
        every = (others("all", k) + 1.0) / (row_sum("all") + float(n_langs))
        suffix = (others("suffix", k) + trust * every) / (row_sum("suffix") + trust)
        prior = (others("host", k) + trust * suffix) / (row_sum("host") + trust)
        # P(declared | language) up to a factor that all languages share
        told = F.when(F.col("declared") == "", 1.0).otherwise((others("declared", k) + 1.0) / (others("all", k) + 2.0 * n_langs))
        logs.append(F.col("said")[k] + F.ln(prior) + F.ln(told))
    x = x.withColumn("logs", F.array(*logs)).withColumn("top", F.array_max("logs"))
    best = F.array_position("logs", F.col("top"))
    share = 1.0 / F.aggregate("logs", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top")))
    return x.select("page_id", F.element_at(F.array(*map(F.lit, langs)), best.cast("int")).alias("lang"), share.alias("probability"), "text_lang", "declared", "host", "suffix")
