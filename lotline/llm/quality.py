"""Quality rules: counts of each text, and lines that too many documents of a host share. DataFrame functions only.

A line is normalised (lower case, runs of blanks one space) and hashed; for each host (``source``) the distinct documents that
hold it are counted; documents are distinct if their texts are, so copies count once. A line in more than LINE_SHARE of a host's
documents, and in more than LINE_DOCUMENTS, is removed; a document left with too few of its words is depleted and rejected.

Null texts have no words and no lines (and fail by their length). A null host is a host of its own. Rows that repeat
doc_id and text each give a row. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import BLANKS, keep

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
LINE_DOCUMENTS, LINE_SHARE = 20, 0.01
#: A document is depleted with fewer words left than this number, or than this share of its words.
LEFT_WORDS, LEFT_SHARE = 25, 0.3
SYMBOLS = "#*$%&|<>"


def _counted(text: Column, symbols: str) -> Column:
    return sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in symbols), F.lit(0)).cast("long")


def _with_repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words, the words in three-word windows that occur twice or more: windows are sorted by hash, equal
    neighbours marked, and the places of marked windows, in order, cover up to three words each. Each array is a column of
    its own, so that no lambda computes it anew."""
    last = F.size("words") - 3
    df = df.withColumn("windows", F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))))
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    order = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("order", F.when(some, order)).drop("windows")
    same = lambda x, k: F.get("order", k)["h"].eqNullSafe(x["h"])
    df = df.withColumn("marked", F.filter("order", lambda x, k: same(x, k - 1) | same(x, k + 1))).drop("order")
    df = df.withColumn("places", F.array_sort(F.col("marked.i"))).drop("marked")
    steps = F.transform("places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - p, F.lit(3))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("places")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, key (MD5 of the text), host, the base counts, base_failed, and lines (hash and words of each line)."""
    words = F.array_remove(F.split("text", f"[{BLANKS}]+"), "")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumns({"words": words, "raw": F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))})
    df = df.select(
        "doc_id", "host", F.unhex(F.md5("text")).alias("key"), F.size("words").cast("long").alias("n_words"), "words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), _counted(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        F.transform("raw", lambda x: F.trim(F.lower(F.regexp_replace(x, f"[{BLANKS}]+", " ")))).alias("lines"),
    )
    df = _with_repeated_words(df)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    lines = F.transform("lines", lambda x: F.struct(F.unhex(F.md5(x)).alias("hash"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("long").alias("n")))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return df.select("doc_id", "key", "host", *counts, failed.alias("base_failed"), lines.alias("lines"))


def frequent_lines(rows: DataFrame, documents: int = LINE_DOCUMENTS, share: float = LINE_SHARE) -> DataFrame:
    """host, hash, n_documents of the lines above the limits. Each text of a host is taken once; counts are summed over tasks before they
    are shuffled."""
    texts = rows.select("host", "key", F.array_distinct("lines.hash").alias("hashes")).dropDuplicates(["host", "key"])
    seen = texts.select("host", F.explode("hashes").alias("hash"))
    often = seen.groupBy("host", "hash").agg(F.count("*").alias("n_documents")).where(F.col("n_documents") > documents)
    hosts = rows.select("host", "key").distinct().groupBy(F.col("host").alias("h")).agg(F.count("*").alias("all"))
    met = often.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    return met.where(F.col("n_documents") > share * F.col("all")).select("host", "hash", "n_documents")


def _judged(rows: DataFrame, often: DataFrame) -> DataFrame:
    """``rows`` with the hashes and the number of words of removed lines, and the verdict."""
    lines = rows.select("doc_id", "key", "host", F.explode("lines").alias("line")).where("line is not null")
    often = often.select(F.col("host").alias("h"), "hash")
    hit = lines.join(often, (F.col("line.hash") == F.col("hash")) & F.col("host").eqNullSafe(F.col("h")))
    # rows that repeat doc_id, text and host would add up: one of them counts
    hit = hit.groupBy("doc_id", "key", "host", "hash").agg(F.first("line.n").alias("n"))
    hit = hit.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("host").alias("o")).agg(F.map_from_entries(F.collect_list(F.struct("hash", "n"))).alias("gone"))
    met = rows.join(hit, rows.key.eqNullSafe(hit.k) & rows.doc_id.eqNullSafe(hit.d) & rows.host.eqNullSafe(hit.o), "left")
    removed = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.element_at("gone", x["hash"]), F.lit(0)))
    met = met.withColumn("n_removed_words", F.when(F.col("gone").isNull(), F.lit(0)).otherwise(removed).cast("long"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < LEFT_WORDS) | (left < LEFT_SHARE * F.col("n_words"))
    return met.withColumn("kept", ~F.col("base_failed") & ~depleted)


def quality(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, base counts, base_failed, n_removed_words, kept."""
    rows = keep(measured(docs))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept"]
    return _judged(rows, frequent_lines(rows)).select(*out)


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without their removed lines (n_chars counted anew where there is such a column)."""
    rows = keep(measured(docs))
    good = _judged(rows, frequent_lines(rows)).where("kept").dropDuplicates(["doc_id", "key", "host"])
    good = good.select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), F.col("host").alias("__h"), F.map_keys("gone").alias("__gone"))
    text = F.coalesce(F.col("text"), F.lit(""))
    same = F.unhex(F.md5(text)).eqNullSafe(F.col("__k")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__h"))
    met = docs.join(good, same)
    name = lambda x: F.unhex(F.md5(F.trim(F.lower(F.regexp_replace(x, f"[{BLANKS}]+", " ")))))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("__gone", name(x))), "\n")
    out = met.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left)).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


#: What ``quality`` returns, over a table ``documents``.
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
tri AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM tri) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
b AS (
  SELECT w.r, doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, text,
         list_transform(lines, lambda x: trim(lower(regexp_replace(x, '[\\x20\\x09-\\x0D]+', ' ', 'g')))) AS normal
  FROM w LEFT JOIN rep USING (r)),
l AS (SELECT r, host, text, unnest(normal) AS line FROM b),
hosts AS (SELECT host, count(DISTINCT text) AS docs FROM b GROUP BY host),
often AS (
  SELECT l.host, line FROM l JOIN hosts ON hosts.host IS NOT DISTINCT FROM l.host
  GROUP BY l.host, line, docs HAVING count(DISTINCT text) > {LINE_DOCUMENTS} AND count(DISTINCT text) > {LINE_SHARE} * docs),
gone AS (
  SELECT r, sum(length(l.line) - length(replace(l.line, ' ', '')) + 1) AS n
  FROM l JOIN often ON often.line = l.line AND often.host IS NOT DISTINCT FROM l.host GROUP BY r),
f AS (
  SELECT b.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
         CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words FROM b LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words,
       NOT base_failed AND n_words - n_removed_words >= {LEFT_WORDS} AND n_words - n_removed_words >= {LEFT_SHARE} * n_words AS kept
FROM f
"""
