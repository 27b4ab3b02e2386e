"""Mixing sources to target weights by Poisson replication.

Each source gets the rate at which its documents should repeat, so that its expected
share of the text is its weight.  A document's count is the inverse of the Poisson
distribution with that rate at a uniform number made from its id and a seed: no state,
no counter, the same on every run and in every partition.  Documents are exploded by
their counts and shuffled globally by a hash of id and copy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_SHARE, Scratch, col, join_hot, own

#: Weights are the sources' sizes to this power, each size a source's characters.
TEMPERATURE = 0.5
SEED = 20_240_601
#: Up to so many bytes the table of distributions is broadcast; beyond, it is joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: A distribution is summed from rate - s to rate + s, s = REACH * sqrt(rate) + MARGIN; what
#: lies outside is less than a double tells from nothing.
REACH, MARGIN = 12, 20
#: 13 hexadecimal digits: 52 bits, exact in a double.
_SCALE = float(1 << 52)
#: Logarithms of factorials below this come from a table, beyond from Stirling's series.
_TABLE = 20


def uniform(key, seed: int):
    """In [0, 1): the first 13 hexadecimal digits of the md5 of ``seed:key``."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(_SCALE)


def source_sizes(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, size, n): each source's characters and rows."""
    size = F.char_length(F.coalesce(col(text).cast("string"), F.lit(""))).cast("bigint")
    return docs.groupBy(col(source).cast("string").alias("source")).agg(F.sum(size).alias("size"), F.count("*").alias("n"))


def source_rates(sizes: DataFrame, weights: dict | None = None, total: float | None = None) -> DataFrame:
    """``sizes`` (see ``source_sizes``) with ``rate``: the mean number of copies of a source's
    documents.

    weights: source -> weight; sources without one get none.  By default a source's
    weight is its size ** TEMPERATURE.  total: characters wanted (default: as many as
    there are).  A source without text has rate 1.
    """
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(TEMPERATURE))
    else:
        known = sizes.sparkSession.createDataFrame(sorted(weights.items()), "w_source string, w double")
        sizes = sizes.join(known, sizes["source"] == known["w_source"], "left")
        weight = F.coalesce("w", F.lit(0.0))
    sizes = sizes.select("source", "size", "n", weight.alias("weight"))
    sums = sizes.agg(F.sum("size").alias("all"), F.sum("weight").alias("weights")).first()
    wanted = F.lit(float(total if total is not None else sums["all"] or 0))
    weights_ = F.lit(float(sums["weights"] or 0))
    rate = F.when((F.col("size") > 0) & (weights_ > 0), F.col("weight") / F.nullif(weights_, F.lit(0.0)) * wanted / F.nullif(F.col("size"), F.lit(0))).when(F.col("size") > 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return sizes.select("source", "size", "n", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def log_factorial(k: Column) -> Column:
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(_TABLE)])
    x = k.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(k < _TABLE, F.get(small, k.cast("int"))).otherwise(series)


def poisson_steps(rates: DataFrame) -> DataFrame:
    """``rates`` with the distribution of each source: ``low`` (count below which nothing
    lies) and ``steps``, the distribution function at low, low + 1, ...

    Each probability stands for itself and running sums add them up, so the work is
    linear in the steps, of which there are about 2 * REACH * sqrt(rate)."""
    rate = F.col("rate")
    reach = REACH * F.sqrt(rate) + MARGIN
    spans = rates.filter(rate > 0).withColumn("low", F.greatest(F.lit(0), F.floor(rate - reach)).cast("bigint"))
    each = spans.select("source", "rate", "low", F.explode(F.sequence(F.col("low"), F.ceil(rate + reach).cast("bigint"))).alias("k"))
    p = F.exp(F.col("k") * F.log(rate) - rate - log_factorial(F.col("k")))
    up_to = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    summed = each.withColumn("cdf", F.sum(p).over(up_to))
    found = summed.groupBy(F.col("source").alias("s_source")).agg(F.first("low").alias("low"), F.sort_array(F.collect_list("cdf")).alias("steps"))
    made = rates.join(found, F.col("source").eqNullSafe(F.col("s_source")), "left")
    return made.select(*rates.columns, F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("steps", F.array(F.lit(1.0))).alias("steps"))


def steps_below(steps: Column, u: Column) -> Column:
    """How many of the ascending ``steps`` are ``u`` or less, by halving."""
    halves = F.transform(F.sequence(F.ceil(F.log2(F.size(steps) + 1)).cast("int"), F.lit(0)), lambda b: F.pow(F.lit(2.0), b).cast("int"))
    return F.aggregate(halves, F.lit(0), lambda at, p: F.when((at + p <= F.size(steps)) & (F.get(steps, at + p - 1) <= u), at + p).otherwise(at))


def mix(docs: DataFrame, weights: dict | None = None, total: float | None = None, seed: int = SEED, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` with ``copy`` (long, from 0) and ``shuffle_key`` (string);
    rows repeated by their Poisson counts, in a random global order.

    A null source is a source of its own.  A null id counts as the empty text; repeated
    rows with one id get the same count.  Null texts count as empty.  An empty table gives
    an empty result.  Columns named copy or shuffle_key are replaced; others stay, whatever
    their names.  The documents are read twice: for the sources' sizes, and for the result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.save(source_sizes(docs, source, text), "sizes")
    name, low, cdf, u, n = (own(x, docs) for x in ("__source__", "__low__", "__steps__", "__u__", "__n__"))
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))  # noqa: E731  null apart from all others
    steps = poisson_steps(source_rates(sizes, weights, total))
    steps = scratch.save(steps.select(named(F.col("source")).alias(name), F.col("low").alias(low), F.col("steps").alias(cdf), F.col("n").alias(n)), "steps")
    held = steps.agg(F.sum(F.size(cdf) * 8 + F.octet_length(name) + 64).alias("bytes"), F.sum(n).alias("n")).first()
    keep = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    rows = docs.select(*[col(c) for c in keep], named(col(source)).alias(name))
    table = steps.drop(n)
    if (held["bytes"] or 0) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(table), name)
    else:
        joined = join_hot(rows, table, name, steps.filter(F.col(n) >= max(2, held["n"] / HOT_SHARE)).drop(n))
    ident = F.coalesce(col(key).cast("string"), F.lit(""))
    # the inverse of the distribution: how many of its steps lie at or below the uniform number
    counted = joined.withColumn(u, uniform(ident, seed)).withColumn(n, F.col(low) + steps_below(F.col(cdf), F.col(u)))
    out = counted.filter(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)))
    order = F.md5(F.concat(F.lit(f"{seed}/"), ident, F.lit("/"), F.col("copy").cast("string")).cast("binary"))
    out = out.select(*[col(c) for c in keep], "copy", order.alias("shuffle_key"))
    # hashing the random key deals rows to partitions at random; sorting by it orders each at random
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op9(docs: DataFrame) -> DataFrame:
    """doc_id, source, copy, shuffle_key and text_md5 of each copy; cases as in ``mix``."""
    rows = docs.select(col("doc_id"), col("source"), col("text"))
    return mix(rows).select("doc_id", "source", F.col("copy").cast("int").alias("copy"), "shuffle_key", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_md5"))


OP9_SQL = f"""
WITH sizes AS (
  SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN size > 0 THEN
           pow(size::DOUBLE, {TEMPERATURE}) / sum(pow(size::DOUBLE, {TEMPERATURE})) OVER () * (sum(size) OVER ())::DOUBLE / size
         ELSE 1.0 END AS rate
  FROM sizes),
spans AS (
  SELECT *, greatest(0, floor(rate - {REACH} * sqrt(rate) - {MARGIN}))::BIGINT AS low, ceil(rate + {REACH} * sqrt(rate) + {MARGIN})::BIGINT AS high
  FROM rates),
steps AS (
  SELECT source, low, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM spans, range(low, high + 1) AS r(k)),
counted AS (
  SELECT d.doc_id, d.source, d.text,
         (SELECT any_value(low) + count(*) FILTER (WHERE s.cdf <= d.u) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source) AS n
  FROM (SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {_SCALE!r} AS u FROM documents) d)
SELECT doc_id, source, c::INTEGER AS copy,
       md5('{SEED}/' || coalesce(doc_id::VARCHAR, '') || '/' || c) AS shuffle_key,
       md5(coalesce(text, '')) AS text_md5
FROM counted, range(0, n) AS x(c)
"""


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents repeated to the target weights, with the columns that they have; copies
    keep their doc_id.  Cases as in ``mix``."""
    own_names = {c: own(f"__{c}__", docs) for c in docs.columns if c.lower() in ("copy", "shuffle_key")}  # mix has its own
    rows = docs.select(*[col(c).alias(own_names.get(c, c)) for c in docs.columns])
    return mix(rows).select(*[col(own_names.get(c, c)).alias(c) for c in docs.columns])
