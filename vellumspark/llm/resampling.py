"""Importance resampling towards a target distribution: hashed n-grams, log gains per bucket, Gumbel-perturbed draws.

A position table holds the words of every text, one row each. For each order above one, ``lead`` over the text's
positions brings the following words to a word's row, and both are joined to the n-gram that begins there. N-grams are
hashed to buckets and counted over all documents and over all target texts; a bucket's gain is the logarithm of the
smoothed ratio of both frequencies. The gains are joined back and averaged over a document's n-grams: its weight. A draw
without replacement follows the weights: to each is added Gumbel noise from a hash of the document's id, and the highest
sums are drawn.

With order one no word follows another, so nothing is shuffled by document before its words are summed up; higher orders
shuffle words by the row that they stand in. Sums by bucket and by row are taken before their shuffles, so neither a
common word nor a long text lands in one task whole. The table of gains has as many rows as there are buckets, a
parameter, and is broadcast. Ranks come from a global sort by ranges and the counts of its partitions.

Defined results: null and empty texts have no words, no n-grams and weight 0. A null id is hashed as the empty string
and is the last among equals. Rows that repeat are documents of their own, whose ranks follow each other. Texts with
fewer words than an order have no n-grams of it. Without any n-gram in the target all gains compare smoothing alone. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, discard, in_order, named, table, written

#: Orders, buckets, seed of the noise, least number of words of a drawn document, percent of these to draw.
ORDERS, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def positions(texts: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The position table: row, the columns to keep, place (from 0) and word; texts without words have one row of nulls.

    ``row`` numbers the rows of the table as it is read; it tells equal rows apart.
    """
    words = F.regexp_extract_all(F.translate(named(text_col), _UPPER, _LOWER), F.lit(WORD_PATTERN), F.lit(0))
    kept = [named(c).alias(c) for c in keep]
    return texts.select(F.monotonically_increasing_id().alias("row"), *kept, words.alias("words")).select("row", *keep, F.posexplode_outer("words").alias("place", "word"))


def buckets(words: DataFrame, orders: int = ORDERS, n: int = BUCKETS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Of a position table: row, the columns to keep, place, word, and bucket, once for each n-gram that begins there.

    Rows whose n-gram would pass the end of the text are left out, except that the row of a text without words stays.
    """
    grams, columns = [F.col("word")], [F.col("word")]
    if orders > 1:
        by = Window.partitionBy("row").orderBy("place")
        for k in range(1, orders):
            words = words.withColumn(f"next{k}", F.lead("word", k).over(by))
            columns.append(F.col(f"next{k}"))
            # A null among the words makes the n-gram null: it would pass the end.
            grams.append(F.concat_ws(" ", *columns))
        grams = [F.when(c.isNotNull(), g) for c, g in zip(columns, grams, strict=True)]
        words = words.withColumn("gram", F.explode(F.when(F.col("word").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.filter(F.array(*grams), lambda g: g.isNotNull()))))
    else:
        words = words.withColumn("gram", grams[0])
    return words.select("row", *keep, "place", "word", (F.crc32(F.encode("gram", "UTF-8")) % n).cast("int").alias("bucket"))


def counts(texts: DataFrame, orders: int = ORDERS, n: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """bucket and how many n-grams of all texts fall into it."""
    return buckets(positions(texts, text_col), orders, n).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(raw: DataFrame, target: DataFrame, n: int = BUCKETS) -> DataFrame:
    """bucket and gain, for each bucket that ``raw`` or ``target`` (tables of ``counts``) has."""
    total = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).first()[0]
    s_all, t_all = total(raw), total(target)
    both = raw.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    ratio = (count("t") + 1) * F.lit(s_all + n) / ((count("s") + 1) * F.lit(t_all + n))
    return both.select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain"))


def floored_mean(total: Column, number: Column) -> Column:
    """The mean of whole numbers, rounded down, without a quotient of doubles."""
    some = F.nullif(number, F.lit(0))
    return F.coalesce(((total - F.pmod(total, some)) / some).cast("long"), F.lit(0))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")


def weights(docs: DataFrame, gain: DataFrame, orders: int = ORDERS, n: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row, doc_id, n_words, n_features, weight."""
    found = buckets(positions(docs.withColumn("__id", named(id_col)), text_col, ("__id",)), orders, n, ("__id",))
    # A row of gains for each bucket at most.
    found = found.join(F.broadcast(gain), "bucket", "left")
    begins = F.max(F.col("place") + F.when(F.col("word").isNotNull(), 1))
    sums = found.groupBy("row", "__id").agg(F.coalesce(begins, F.lit(0)).cast("long").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    return sums.select("row", F.col("__id").alias("doc_id"), "n_words", "n_features", floored_mean(F.col("total"), F.col("n_features")).alias("weight"))


def draw(weighed: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null if not drawn); for a table of ``weights``.

    Sorted by ranges: the number of a row within its partition and the rows of the partitions before make its rank. The
    last key is the row's own number, so rows that are equal can lie in several ranges.
    """
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("out", F.col("n_words") < least_words)
    order = [F.col("out").asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    scored = written(scored, "resampling-scored")
    placed = in_order(scored, order, "resampling-sorted")
    discard(scored)
    drawn = placed.filter("not out").count() * percent // 100
    rank = F.col("nth") + 1
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(~F.col("out") & (rank <= drawn), rank).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, orders: int = ORDERS, n: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its weight, score and rank among the drawn; ``target`` has texts in the same column."""
    raw, aim = (written(counts(x, orders, n, text_col), "resampling-counts") for x in (docs, target))
    return draw(weights(docs, gains(raw, aim, n), orders, n, id_col, text_col), least_words, percent, seed)


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


#: crc32 is worked out byte by byte, once for each distinct word.
ORACLE = r"""
WITH RECURSIVE tbl AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS word FROM d),
bw AS (SELECT unnest(w) AS word FROM b),
words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
hashed AS (SELECT word, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, CAST(i AS INTEGER), 2) AS BIGINT))), lambda c, x: xor(c >> 8, crc[CAST(xor(c & 255, x) AS INTEGER) + 1])), 4294967295) % 10000 AS bucket FROM words, tbl),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST((SELECT count(*) FROM dw) AS DOUBLE) + 10000) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (CAST((SELECT count(*) FROM bw) AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
m AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM dw JOIN hashed USING (word) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight FROM d LEFT JOIN m USING (r)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k FROM y)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN n_features >= 20 AND k <= 10 * (SELECT count(*) FROM y WHERE n_features >= 20) // 100 THEN CAST(k AS BIGINT) END AS rank FROM z
"""
