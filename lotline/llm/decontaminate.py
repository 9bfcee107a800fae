"""Benchmark passages in documents, by SimHash of item-sized windows. DataFrame functions only.

Words are runs without blanks in lower case, features are shingles of five words (all words of a shorter item), weighted by how
often they occur. A window has as many words as the item and begins where some shingle of the item does, or is the document's last
one. Every such window is taken that has enough places with a shingle of the item to reach the threshold, in any order: the
others can't, and a window that begins elsewhere is no better than the next one that begins so. Windows and items get 64-bit
SimHash fingerprints; fingerprints are cut into RADIUS + 1 blocks, and any two within RADIUS bits agree in a block whole, so a join on
blocks finds all items of a window's length near it. Those are compared exactly: weighted Jaccard of the shingles.

Two texts at the threshold differ in 9.7 bits of 64 on average (deviation 2.9); RADIUS loses one in a hundred thousand.
Null and empty texts hold no item; items without words are found nowhere. Rows that repeat doc_id and text give one row for each
item. A document shorter than the item is one window. Of equally similar windows the first is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import BLANKS, keep, texts

WIDTH, THRESHOLD, BITS, RADIUS = 5, 0.8, 64, 22


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(text), f"[{BLANKS}]+"), "")


def _shingles(words: str, width: Column | int) -> Column:
    """Hashes of the shingles of an array column; none if there are fewer words than the width."""
    width = F.lit(width) if isinstance(width, int) else width
    last = F.size(words) - width
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, width), " ")))
    return F.when((last >= 0) & (width > 0), runs).otherwise(F.array().cast("array<long>"))


def _fast_shingles(words: str, width: int) -> Column:
    last = F.size(words) - width
    run = lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(words, i + k) for k in range(width))))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), run)).otherwise(F.array().cast("array<long>"))


def _simhash(shingles: str) -> Column:
    """Bit b is set if the sum over shingles of +1 where their bit b is set and -1 where not is above zero."""
    ones = lambda b: F.aggregate(shingles, F.lit(0), lambda a, h: a + F.shiftrightunsigned(h, b).bitwiseAND(1).cast("int") * 2 - 1)
    bits = [F.when(ones(b) > 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")) for b in range(BITS)]
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return out


def _blocks(fingerprint: str) -> Column:
    """RADIUS + 1 pieces of a fingerprint."""
    cuts = [BITS * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    piece = lambda k: F.shiftrightunsigned(fingerprint, cuts[k]).bitwiseAND((1 << (cuts[k + 1] - cuts[k])) - 1)
    return F.array(*(F.struct(F.lit(k).alias("block"), piece(k).alias("piece")) for k in range(RADIUS + 1)))


def _overlap(a: Column, b: Column) -> Column:
    """Common elements of two arrays, each as often as in the array that has it less often. Unless both repeat elements these are
    the distinct common ones."""
    times = lambda array, h: F.size(F.filter(array, lambda x: x == h))
    single = lambda array: F.size(F.array_distinct(array)) == F.size(array)
    both = F.array_intersect(a, b)
    return F.when(single(a) | single(b), F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda s, h: s + F.least(times(a, h), times(b, h))))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """doc_id, key (MD5 of the text), item_id, start and n_words of the window (in words), similarity."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), _words("text").alias("words")).where(F.size("words") > 0)
    items = items.withColumn("width", F.least(F.lit(width), F.size("words"))).withColumn("length", F.size("words"))
    items = items.withColumn("item", _shingles("words", F.col("width"))).withColumn("item_key", F.xxhash64("item_id", "words"))
    items = keep(items.drop("words").dropDuplicates(["item_key"]).withColumn("print", _simhash("item")))
    index = keep(items.select("item_key", "width", "length", F.size("item").alias("total"), F.posexplode("item").alias("place", "h")))

    whole = texts(docs).select("doc_id", F.unhex(F.md5("text")).alias("key"), "text")
    words = whole.select("doc_id", "key", _words("text").alias("words"))
    found, widths = None, sorted(w for (w,) in items.select("width").distinct().collect())
    for own in widths:
        parts = words.select("doc_id", "key", F.size("words").alias("n"), F.posexplode(_fast_shingles("words", own)).alias("at", "h"))
        met = parts.join(index.where(F.col("width") == own), "h")
        met = met.select("doc_id", "key", "item_key", "place", "at", "n", "total", "length")
        found = met if found is None else found.union(met)
    if found is None:
        empty = F.lit(None)
        return docs.limit(0).select(F.col("doc_id").cast("long").alias("doc_id"), empty.cast("binary").alias("key"), empty.cast("long").alias("item_id"), empty.cast("int").alias("start"), empty.cast("int").alias("n_words"), empty.cast("double").alias("similarity"))
    group = found.groupBy("doc_id", "key", "item_key").agg(
        F.count_distinct("place").alias("met"), F.array_sort(F.collect_set("at")).alias("places"), *[F.first(c).alias(c) for c in ("n", "total", "length")])
    group = keep(group.where(F.col("met") >= threshold * F.col("total")))
    final = F.greatest(F.col("n") - F.col("length"), F.lit(0))
    size = F.least(F.col("total"), F.col("n") - F.col("length") + F.col("total"))
    need = F.greatest(F.lit(1), F.ceil((F.col("total") + size) * (threshold / (1 + threshold)) - 1e-9).cast("int"))
    group = group.withColumns({"final": final, "need": need})
    full = lambda p, i: (p < F.col("final")) & (F.get("places", i + F.col("need") - 1) < p + F.col("total"))
    at_end = F.when(F.get("places", F.size("places") - F.col("need")) >= F.col("final"), F.array("final")).otherwise(F.array().cast("array<int>"))
    group = group.withColumn("starts", F.concat(F.filter("places", full), at_end)).where(F.size("starts") > 0)
    group = keep(group.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "item_key", "starts"))

    # texts meet their windows as they are: a row of words is several times larger, and with many windows all texts are moved here
    sizes = items.select(F.col("item_key").alias("ik"), "width", "length")
    near = group.join(sizes, F.col("item_key") == F.col("ik")).groupBy("d", "k", "width", "length").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    near = keep(near.groupBy("d", "k", "width").agg(F.collect_list(F.struct("length", "starts")).alias("near")))
    rows = whole.join(near, whole.key.eqNullSafe(near.k) & whole.doc_id.eqNullSafe(near.d)).dropDuplicates(["doc_id", "key", "width"])
    rows = rows.select("doc_id", "key", "width", "near", _words("text").alias("words"))
    of_width = [F.when(F.col("width") == own, _fast_shingles("words", own)) for own in widths]
    rows = rows.select("doc_id", "key", "width", F.coalesce(*of_width).alias("h"), "near").select("doc_id", "key", "width", "h", F.explode("near").alias("near"))
    window = lambda s: F.slice("h", s + 1, F.col("near.length") - F.col("width") + 1)
    ending = lambda s: s >= F.size("h") + F.col("width") - 1 - F.col("near.length")
    every = F.transform("near.starts", lambda s: F.struct(s.alias("start"), ending(s).alias("last"), window(s).alias("window")))
    rows = rows.select("doc_id", "key", "width", "near.length", F.explode(every).alias("one")).select("doc_id", "key", "width", "length", "one.*").where(F.size("window") > 0)
    rows = keep(rows.withColumn("print", _simhash("window")))

    cut = rows.select("doc_id", "key", "start", "width", "length", "print", F.inline(_blocks("print")))
    other = items.select("item_key", F.col("width").alias("w"), F.col("length").alias("l"), F.col("print").alias("item_print"), F.inline(_blocks("print"))).withColumnsRenamed({"block": "b", "piece": "p"})
    hit = cut.join(other, (F.col("length") == F.col("l")) & (F.col("width") == F.col("w")) & (F.col("block") == F.col("b")) & (F.col("piece") == F.col("p")))
    hit = hit.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    hit = hit.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("start").alias("s"), "w", "l", "item_key").distinct()
    same = rows.doc_id.eqNullSafe(hit.d) & (rows.key == hit.k) & (rows.start == hit.s) & (rows.width == hit.w) & (rows.length == hit.l)
    scored = rows.join(hit, same).join(items.select(F.col("item_key").alias("ik"), "item_id", "item"), F.col("item_key") == F.col("ik"))
    own = F.col("last") | F.array_contains("item", F.get("window", F.lit(0)))
    scored = scored.where(own).withColumn("common", _overlap(F.col("window"), F.col("item")))
    scored = scored.withColumn("similarity", F.col("common") / (F.size("window") + F.size("item") - F.col("common"))).where(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"), F.least("length", F.size("window") + F.col("width") - 1).alias("n_words")))
    out = scored.groupBy("doc_id", "key", "item_id").agg(best.alias("best"))
    return out.select("doc_id", "key", "item_id", (-F.col("best.before")).alias("start"), "best.n_words", "best.similarity")


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item."""
    found = contaminated(docs, items, threshold).select(F.col("doc_id").alias("__d"), F.col("key").alias("__k")).distinct()
    key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    return docs.join(found, key.eqNullSafe(F.col("__k")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__d")), "left_anti")


#: Every window that begins with a shingle of the item, or is the last one, compared exactly; items of five words or more.
SQL = f"""
WITH i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM benchmark),
d AS (
  SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
ip AS (
  SELECT item_id, len(words) AS n, array_to_string(words[p:p + {WIDTH - 1}], ' ') AS s, p
  FROM (SELECT item_id, words, unnest(range(1, len(words) - {WIDTH - 2})) AS p FROM i)),
dp AS (
  SELECT doc_id, len(words) AS n, array_to_string(words[p:p + {WIDTH - 1}], ' ') AS s, p
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WIDTH - 2})) AS p FROM d)),
starts AS (
  SELECT DISTINCT doc_id, item_id, ip.n AS size, least(dp.p - 1, greatest(dp.n - ip.n, 0)) AS start FROM dp JOIN ip USING (s)),
win AS (
  SELECT doc_id, item_id, start, s, count(*) AS c
  FROM starts JOIN dp USING (doc_id) WHERE dp.p > start AND dp.p <= start + size - {WIDTH - 1} GROUP BY ALL),
it AS (SELECT item_id, s, count(*) AS c FROM ip GROUP BY ALL),
tot AS (SELECT item_id, count(*) AS n FROM ip GROUP BY ALL),
sc AS (
  SELECT doc_id, win.item_id, start, sum(win.c) AS a, any_value(tot.n) AS b, sum(least(win.c, coalesce(it.c, 0))) AS common
  FROM win JOIN tot USING (item_id) LEFT JOIN it ON it.item_id = win.item_id AND it.s = win.s GROUP BY ALL),
r AS (
  SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, CAST(a + {WIDTH - 1} AS BIGINT) AS n_words, CAST(common AS DOUBLE) / CAST(a + b - common AS DOUBLE) AS similarity
  FROM sc)
SELECT doc_id, item_id, start, n_words, similarity FROM r WHERE similarity >= {THRESHOLD}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
