"""Joins of many rows to a dictionary with one row per key."""

from pyspark.sql import Column, DataFrame, functions as F

#: Parts that a key is split into if it has just one task's share of the rows; more of them even out the tasks more.
COPIES = 32


def heavy_keys(rows: DataFrame, keys: list[list[str]], tasks: int) -> Column:
    """For each list of keys, a map from the hash of a key to the parts its rows need, for all keys with half a task's share or more.

    A scalar subquery: frequent-items sketches, merged map-side, from one scan; nothing is shuffled but sketches. Null
    keys count as keys, as an outer join keeps their rows. There are at most two such keys per task.
    """
    hashes = rows.select(*[F.xxhash64(*k).alias(f"h{i}") for i, k in enumerate(keys)])
    top = [f"approx_top_k(h{i}, {2 * tasks + 1}, {max(10_000, 32 * tasks)}) AS t{i}" for i in range(len(keys))]
    parts = f"cast(ceil({COPIES}.0D * {tasks} * x.count / n) AS int)"
    maps = [f"""map_from_entries(transform(filter(t{i}, x -> x.count * {2 * tasks} >= n AND x.count > 1),
      x -> named_struct('key', x.item, 'value', {parts}))) AS m{i}""" for i in range(len(keys))]
    return hashes.selectExpr(*top, "count(1) AS n").selectExpr(f"struct({', '.join(m for m in maps)}) AS m").scalar()


def exploded(dictionary: DataFrame) -> DataFrame:
    """A dictionary that is not to be broadcast, as its size is only known once it is made.

    Spark estimates from the files: an exploded row counts once, whatever it gives, and in the size it has compressed. So
    tables many times the limit went to the driver and to each executor, and adaptive planning does not take that back.
    """
    return dictionary.hint("merge")


def lookup(rows: DataFrame, dictionary: DataFrame, keys: list[str], spread_by: list[str], how: str = "left") -> DataFrame:
    """Equi-join where one key may own a large share of ``rows``.

    Heavy keys are measured, and split by a hash of ``spread_by`` into as many parts as their weight asks for; the
    dictionary repeats the rows of these keys alone. All copies together are ``COPIES`` rows per task at most, whatever
    the size of the dictionary. Spark still broadcasts the dictionary by itself if it is small, unless it is :func:`exploded`.

    ``rows`` are read twice. Where several lookups follow each other, :func:`lookups` measures all their keys at once.
    """
    return lookups(rows, [(dictionary, keys)], spread_by, how)


def lookups(rows: DataFrame, dictionaries: list[tuple[DataFrame, list[str]]], spread_by: list[str], how: str = "left") -> DataFrame:
    """:func:`lookup` in one dictionary after the other; all keys are columns of ``rows``."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(rows, [keys for _, keys in dictionaries], tasks)
    for i, (dictionary, keys) in enumerate(dictionaries):
        parts = F.coalesce(F.try_element_at(heavy.getField(f"m{i}"), F.xxhash64(*keys)), F.lit(1))
        salted = dictionary.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        keyed = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), parts).cast("int"))
        rows = keyed.join(salted, keys + ["_salt"], how).drop("_salt")
    return rows
