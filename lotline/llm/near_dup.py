"""Near-duplicate documents by ProbMinHash.

A document is its five-word shingles (words: runs without blanks, A-Z lowered), weighted by how often they occur. Each
shingle sends arrivals of a Poisson process whose rate is its weight to random registers; a register keeps the shingle that
arrives first. A shingle stops once it is later than every register of its document. Two documents agree in a register with
a probability that is their probability Jaccard similarity. Registers in bands give buckets, buckets give candidate groups, and
within a group similarities are computed exactly. Documents linked by similar pairs are one class.

Texts that are equal are one text from the start. A text of one to four words has one shingle; empty and null texts have none and
are classes by their doc_id alone. Repeated rows get the same class each. A class is named by its smallest doc_id (null if it has none).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import keep, mix, portions, shingles, texts, word_hashes
from lotline.llm.graph import bucket_links, components, verified_links

WIDTH, THRESHOLD = 5, 0.8
#: 24 bands of 4 registers find a pair of similarity 0.8 with probability 1 - 3e-6.
BANDS, ROWS = 24, 4


def lowered(values: list[str]) -> list[bytes]:
    """UTF-8 with A-Z lowered."""
    return [v.encode().lower() for v in values]


def weighted_shingles(values: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle and how often it occurs there, by text."""
    value, offsets = shingles(*word_hashes(lowered(values)), width)
    doc = np.repeat(np.arange(len(values)), np.diff(offsets))
    _, one, count = np.unique(mix(value ^ mix(doc.astype(np.uint64), 7)), return_index=True, return_counts=True)
    order = np.argsort(one, kind="stable")
    one, count = one[order], count[order]
    return doc[one], value[one], count.astype(np.float64)


def prob_minhash(doc: np.ndarray, feature: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """The feature that arrives first in each register of each of n texts (n x registers)."""
    first = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    clock = np.zeros(len(doc))
    for turn in range(1_000_000):
        if not len(doc):
            break
        noise = mix(feature, 2 * turn + 11)
        clock = clock - np.log(((noise >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        place = doc * registers + (mix(noise, 3) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, place, clock)
        best = first[place] == clock
        winner[place[best]] = feature[best]
        latest = first.reshape(n, registers).max(axis=1)
        live = clock < latest[doc]
        doc, feature, weight, clock = doc[live], feature[live], weight[live], clock[live]
    return winner.reshape(n, registers)


def bands_of(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One value for each band; values of different bands differ."""
    value = np.tile(np.arange(bands, dtype=np.uint64), (len(registers), 1))
    for k in range(rows):
        value = mix(value * np.uint64(0xD6E8FEB86659FD93) + registers[:, k::rows][:, :bands], k)
    return value


def signatures(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, key (MD5 of the text), size (distinct shingles), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                values = part.column(1).to_pylist()
                doc, feature, weight = weighted_shingles(values, width)
                size = np.bincount(doc, minlength=len(values))
                value = bands_of(prob_minhash(doc, feature, weight, len(values), bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum((size > 0) * bands)), pa.int32()), pa.array(value[size > 0].ravel().view(np.int64)))
                keys = [hashlib.md5(v.encode()).digest() for v in values]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(size, pa.int64()), lists], ["doc_id", "key", "size", "bands"])

    return texts(docs).mapInArrow(run, "doc_id long, key binary, size long, bands array<long>")


def classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """doc_id, class_id, key (MD5 of the text) and stays (the first of its class) for every row of ``docs``."""
    rows = keep(signatures(docs, width))
    single = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    single = keep(single.where("size > 0").withColumn("id", F.monotonically_increasing_id()))
    groups = keep(components(bucket_links(single.select(F.array("id").alias("ids"), "bands"), single.count() * BANDS, BANDS)))
    found = single.join(groups, single.id == groups.node).select("id", "key", "size", "root", F.col("doc_id").alias("one"))
    text = texts(docs).withColumn("key", F.unhex(F.md5("text")))
    members = found.join(text, "key").where(F.col("one").eqNullSafe(F.col("doc_id"))).select("id", "root", "size", "text")
    links = verified_links(members, lambda values: weighted_shingles(values, width), threshold)
    joined = components(links)
    named = single.join(joined, single.id == joined.node, "left").select("key", "doc_id", F.coalesce("root", "id").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")
    names = named.groupBy("root").agg(F.min(order).alias("best"))
    by_key = named.join(names, "root").select(F.col("key").alias("k"), "best")
    met = rows.join(by_key, rows.key == by_key.k, "left")
    own = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & F.col("best.key").eqNullSafe(F.col("key"))
    return met.select("doc_id", F.when(F.col("size") > 0, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("class_id"), "key", (own | (F.col("size") == 0)).alias("stays"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without all but the first (by doc_id, null last, then text) of each class; repeated rows go too."""
    found = classes(docs, threshold).where("stays").groupBy(F.col("doc_id").alias("__d"), F.col("key").alias("__k")).agg(F.count("*").alias("__n"))
    found = keep(found)
    keyed = docs.withColumn("__key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    met = keyed.join(found, F.col("__key").eqNullSafe(F.col("__k")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__d")))
    if not found.where("__n > 1").isEmpty():
        met = met.dropDuplicates(["doc_id", "__key"])
    return met.select(*docs.columns)
