"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source with target T and size S gets floor(T / S) certain whole copies of every document. What
is left, fewer than S words, is a sample of unequal probabilities: a document's inclusion
probability grows with the square root of its size, scaled so that the expected words are
those left; documents that would reach 1 are certain and taken out, and the rest is scaled anew.
The others are ranked by the odds of a random number over the odds of their inclusion,
(u / (1 - u)) / (p / (1 - p)), and the head of that order as large as what is left is taken. Two
places stay for the words still missing: the largest document that fits, and then the one that
comes nearest.

A hot source is never ordered in one task: rows are dealt by ranges of the order, words are
summed by range, and only the range where a head ends is ordered. Ranges do not change results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.llm.common import free_name, running, stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
LIMIT = 2


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(id_col: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id alone (without one, on the text); 52 bits of an MD5."""
    name = F.coalesce(id_col.cast("string"), F.concat(F.lit("null:"), F.coalesce(text, F.lit(""))))
    digest = F.md5(F.concat(F.lit(seed), name).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, docs, source_size, target): water-filling over one row per source.

    Sources in code-point order, null last, weigh `weights` in turn and share `share` of all
    sizes. A source that would get more than `limit` times its size stops there; sorted by
    the level at which they stop, the first prefix of stopped sources whose common level for
    the rest stops none of them is the answer, so one running sum replaces rounds of resharing.
    Sources may be many (hosts): running sums go by ranges.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    by = running(by, [F.col("source").asc_nulls_last()], {"turn": "one"}, "sources")
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("turn") - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", (F.col("source_size") * limit).cast("double")).withColumn("stop", F.col("cap") / F.col("weight"))
    by = running(by, [F.col("stop"), F.col("source").asc_nulls_last()], {"place": "one", "caps": "cap", "weights": "weight"}, "sources")
    every = by.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, free = float(every.size or 0), float(every.weight or 0)
    level = (F.lit(total) * share - (F.col("caps") - F.col("cap"))) / (F.lit(free) - (F.col("weights") - F.col("weight")))
    by = stored(by.withColumn("level", level), "levels")
    found = by.where("level <= stop").agg(F.min(F.struct("place", "level")).alias("f")).first().f
    target = F.col("cap") if found is None else F.when(F.col("place") < found.place, F.col("cap")).otherwise(F.col("weight") * F.lit(found.level))
    return by.select("source", "docs", "source_size", target.alias("target"))


def _same(docs: DataFrame, by: DataFrame) -> DataFrame:
    """Each document with the figures of its source."""
    return docs.join(by.withColumnRenamed("source", "of_source"), docs.source.eqNullSafe(F.col("of_source")), "left").drop("of_source")


def _root(size: Column) -> Column:
    """The whole part of the root of a size: documents with one root have one inclusion probability."""
    return F.floor(F.sqrt(size.cast("double"))).cast("long")


def inclusion(sizes: DataFrame, by: DataFrame) -> DataFrame:
    """`by` (source, left, ...) with scale, certain and need.

    A document with root x has the inclusion probability scale * x, and 1 from x = certain on;
    need is what certain documents leave of `left`. A source has a row for each root here, and
    those are few: roots of sizes, not sizes or documents.
    """
    roots = sizes.groupBy("source", _root(F.col("size")).alias("x")).agg(F.sum("size").alias("words")).where("x > 0")
    rows = _same(roots, by.select("source", "left")).where("left > 0")
    down = Window.partitionBy("source").orderBy(F.col("x").desc())
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    below = F.sum(F.col("x") * F.col("words")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast("double")
    rows = rows.withColumn("need", F.col("left") - above).withColumn("scale", F.col("need") / below)
    first = F.max(F.when(F.col("scale") * F.col("x") < 1, F.struct("x", "scale", "need"))).alias("f")
    found = rows.groupBy("source").agg(first)
    return _same(by, found).select(*by.columns, F.col("f.scale").alias("scale"), (F.col("f.x") + 1).alias("certain"), F.col("f.need").alias("need"))


def _key() -> Column:
    """Place in the order of a source: by odds ratio, then id, size and row."""
    return F.struct("q", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "size", "row")


def _ends(open_: DataFrame) -> DataFrame:
    """(source, end, gain): the last place of the head of each source's order whose words fit into `need`, and those words."""
    order = [F.col("source"), F.col("key")]
    dealt = stored(open_.select("source", "key", "size", "need").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")
    parts = dealt.groupBy("source", "part").agg(F.sum("size").alias("words"), F.max("key").alias("last"), F.first("need").alias("need"))
    along = Window.partitionBy("source").orderBy("part")
    parts = parts.withColumn("upto", F.sum("words").over(along)).withColumn("before", F.lag("last").over(along))
    cut = F.min(F.when(F.col("upto") > F.col("need"), F.struct("part", (F.col("upto") - F.col("words")).alias("words"), "before"))).alias("cut")
    ends = stored(parts.groupBy("source").agg(cut, F.sum("words").alias("words"), F.max("last").alias("last")), "cuts")
    inside = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _same(dealt, ends.select("source", "cut")).where("part = cut.part")
    rows = rows.withColumn("sum", F.col("cut.words") + F.sum("size").over(inside)).where("sum <= need")
    rows = rows.groupBy("source").agg(F.max("key").alias("end"), F.max("sum").alias("gain"))
    whole = F.col("cut").isNull()
    end = F.coalesce("end", F.when(whole, F.col("last")).otherwise(F.col("cut.before")))
    gain = F.coalesce("gain", F.when(whole, F.col("words")).otherwise(F.col("cut.words")))
    return _same(ends, rows).select("source", end.alias("end"), gain.alias("gain"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    limit: int = LIMIT,
    seed: str = "mix:",
) -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, size, source_size, target, copies, taken.

    Size is the number of words of the whole text, however long (null or empty: 0). copies is
    the certain copies and one more for sampled documents; taken = copies * size. A source misses its target by
    less than the document after its head, mostly by less than a word in a hundred. Ties in the odds ratio are
    ordered by id and size; rows without an id draw by their text; a null source is a source of
    its own, last in order. An empty table gives no rows; other columns are not read.
    """
    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text_col).alias("text_hash"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        draw(F.col(id_col).cast("long"), F.col(text_col), seed).alias("u"),
    )
    sizes = stored(own.withColumn("row", F.monotonically_increasing_id()), "sizes")
    by = targets(sizes, weights, share, limit)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    by = by.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    by = stored(inclusion(sizes, stored(by, "targets")), "inclusion")

    p = F.col("scale") * _root(F.col("size"))
    ranked = (F.col("left") > 0) & (F.col("scale") > 0) & (F.col("size") > 0) & (_root(F.col("size")) < F.col("certain"))
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    placed = _same(sizes, by).withColumn("ranked", F.coalesce(ranked, F.lit(False))).withColumn("q", F.when(F.col("ranked"), odds))
    placed = placed.withColumn("key", F.when(F.col("ranked"), _key()))
    by = stored(_same(by, _ends(placed.where("ranked"))), "ends")
    placed = _same(placed.drop(*[c for c in by.columns if c != "source"]), by)
    head = F.coalesce(F.col("key") <= F.col("end"), F.lit(False))
    missing = F.col("need") - F.coalesce("gain", F.lit(0))
    open_ = placed.where(F.col("ranked") & ~head).withColumn("missing", missing)
    fit = stored(open_.where("size <= missing").groupBy("source").agg(F.min(F.struct((F.col("missing") - F.col("size")).alias("missing"), "key")).alias("fit")), "fit")
    open_ = _same(open_, fit).withColumn("missing", F.coalesce("fit.missing", "missing")).where(~F.coalesce(F.col("key") == F.col("fit.key"), F.lit(False)))
    rest = F.abs(F.col("size") - F.col("missing"))
    near = stored(open_.where(rest < F.col("missing")).groupBy("source").agg(F.min(F.struct(rest.alias("rest"), "key")).alias("near")), "near")
    both = _same(_same(placed, fit), near)
    certain = F.coalesce((F.col("left") > 0) & (F.col("size") > 0) & ~F.col("ranked") & (_root(F.col("size")) >= F.col("certain")), F.lit(False))
    extra = certain | head | F.coalesce((F.col("key") == F.col("fit.key")), F.lit(False)) | F.coalesce(F.col("key") == F.col("near.key"), F.lit(False))
    copies = (F.col("whole") + extra.cast("int")).cast("int")
    return both.select("doc_id", "text_hash", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """`docs` as the mix takes them: a row for each copy, none for documents left out; columns as they came.

    Rows with equal id and text share the largest number of copies among them.
    """
    names = {x: free_name(docs.columns, f"__{x}") for x in ("id", "hash", "copies", "copy")}
    plan = mix(docs, id_col, text_col, source_col, **options).where("copies > 0")
    plan = plan.groupBy(F.col("doc_id").alias(names["id"]), F.col("text_hash").alias(names["hash"])).agg(F.max("copies").alias(names["copies"]))
    same = docs[id_col].cast("long").eqNullSafe(F.col(names["id"])) & (F.xxhash64(docs[text_col]) == F.col(names["hash"]))
    rows = docs.join(plan, same).withColumn(names["copy"], F.explode(F.sequence(F.lit(1), F.col(names["copies"]))))
    return rows.drop(*names.values())


def oracle(weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: str = "mix:") -> str:
    """The same in DuckDB SQL over `documents`, for sources of any size."""
    order = "PARTITION BY source ORDER BY q, doc_id NULLS LAST, size"
    return f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  (CAST('0x' || substr(md5('{seed}' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([{", ".join(map(str, weights))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)}] AS DOUBLE) AS weight,
  CAST({limit} * source_size AS DOUBLE) AS cap FROM s),
p AS (SELECT *, row_number() OVER o AS place, (CAST(sum(source_size) OVER () AS DOUBLE) * {share}::DOUBLE
  - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
k AS (SELECT min(place) AS place, arg_min(level, place) AS level FROM p WHERE level <= cap / weight),
t AS (SELECT p.source, source_size, CASE WHEN k.place IS NULL OR p.place < k.place THEN cap ELSE weight * k.level END AS target FROM p, k),
c AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS rest, CAST(floor(sqrt(size)) AS BIGINT) AS x
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
h AS (SELECT source, x, rest, CAST(sum(size) AS BIGINT) AS words FROM r WHERE x > 0 AND rest > 0 GROUP BY ALL),
i AS (SELECT *, rest - CAST(coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS need,
  CAST(sum(x * words) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS below FROM h WINDOW o AS (PARTITION BY source ORDER BY x DESC)),
j AS (SELECT source, max(x) + 1 AS certain, arg_max(need / below, x) AS scale, arg_max(need, x) AS need FROM i WHERE need / below * x < 1 GROUP BY source),
a AS (SELECT r.*, certain, need, scale * x AS p, coalesce(x >= certain AND rest > 0, false) AS sure, coalesce(rest > 0 AND scale > 0 AND x > 0 AND x < certain, false) AS ranked
  FROM r LEFT JOIN j ON r.source IS NOT DISTINCT FROM j.source),
q AS (SELECT *, CASE WHEN ranked THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM a),
e AS (SELECT *, coalesce(ranked AND sum(size) OVER ({order} ROWS UNBOUNDED PRECEDING) <= need, false) AS head FROM (SELECT * FROM q WHERE ranked)
  UNION ALL SELECT *, false FROM q WHERE NOT ranked),
m AS (SELECT *, need - coalesce(sum(size) FILTER (WHERE head) OVER (PARTITION BY source), 0) AS missing FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN ranked AND NOT head AND size <= missing THEN missing - size END NULLS LAST, q NULLS LAST, doc_id NULLS LAST, size) = 1
  AND ranked AND NOT head AND size <= missing AS fit FROM m),
g AS (SELECT *, missing - coalesce(max(size) FILTER (WHERE fit) OVER (PARTITION BY source), 0) AS gap FROM f),
n AS (SELECT *, CASE WHEN ranked AND NOT head AND NOT fit AND abs(size - gap) < gap THEN abs(size - gap) END AS near FROM g),
z AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY near NULLS LAST, q NULLS LAST, doc_id NULLS LAST, size) AS first FROM n)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN sure OR head OR coalesce(fit, false) OR (near IS NOT NULL AND first = 1) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM z"""
