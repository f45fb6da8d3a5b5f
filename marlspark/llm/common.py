"""What the text operators share: tables, Arrow plumbing, shared storage, components."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import delete, scope, scratch, size, written


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns only, so that further columns of any name do no harm."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


#: A table of fewer bytes for each core than Spark gives a split is dealt out to all cores before work on its texts.
SPREAD_BYTES = 4 << 20


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """``table``, dealt out by its first column if it is so small that its file is one task otherwise.

    The work on a text is far dearer than moving it; of a table that has a split
    for each core nothing is moved.
    """
    df, cores = table(spark, sf_dir, name, *columns), spark.sparkContext.defaultParallelism
    return df.repartition(cores, columns[0]) if size(spark, f"{sf_dir}/{name}.parquet") < cores * SPREAD_BYTES else df


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object]], schema: str) -> DataFrame:
    """``fn`` maps each Arrow batch to the output columns (lists or arrays of one length)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = fn(batch)
            yield pa.RecordBatch.from_arrays([x if isinstance(x := got[f.name], pa.Array) and x.type == f.type else pa.array(x, f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def scoped(fn: Callable) -> Callable:
    """For a function of a DataFrame that is done when it returns: the tables it has written go then."""

    @functools.wraps(fn)
    def run(df: DataFrame, *args: object, **kwargs: object) -> object:
        with scope(df.sparkSession):
            return fn(df, *args, **kwargs)

    return run


def utf8(column: str) -> Column:
    """The column's UTF-8 bytes, null as empty, for workers that need no text."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias(column)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of a sieve: as a table of words at most 2**19 small rows are broadcast, as an array 4 MB, whatever the input's size.
SIEVE_BITS = 25


def sieve(hashes: DataFrame, bits: int = SIEVE_BITS) -> DataFrame:
    """The column ``hash`` (long) as a bitmap of its leading bits, one row for each word of 64 bits that is not empty: word, mask."""
    place = F.call_function("shiftrightunsigned", F.col("hash"), F.lit(64 - bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    return hashes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("mask"))


def sifted(df: DataFrame, key: Column, words: DataFrame, how: str = "left_semi", bits: int = SIEVE_BITS) -> DataFrame:
    """The rows of ``df`` whose ``key`` (long) may be in the sieve, or with ``left_anti`` the others.

    A table of bounded size is broadcast, so no row of ``df`` is shuffled to find
    out that it has no partner; what passes by chance a later join sorts out.
    """
    word, mask = fresh(df, "sieve_word"), fresh(df, "sieve_mask")
    place = F.call_function("shiftrightunsigned", key, F.lit(64 - bits))
    hit = F.call_function("shiftrightunsigned", F.col(mask), place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(words.select(F.col("word").alias(word), F.col("mask").alias(mask))), (F.shiftright(place, 6) == F.col(word)) & hit, how)


#: A key is hot if it has more than one in so many rows, so there are no more hot keys than that.
HOT_SHARE = 10_000


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of ``big`` with ``small``, a written table that has one row for a key and in ``count`` how many rows of ``big`` have it.

    Hot keys, of which there are at most ``HOT_SHARE``, are broadcast, so that their
    rows stay where they are; only the rows of the others are shuffled. ``count`` is
    not in the result.
    """
    bound = small.agg(F.sum(count).alias("n")).first()["n"] or 0
    hot, cold = (small.filter(F.col(count) > bound // HOT_SHARE), small.filter(F.col(count) <= bound // HOT_SHARE))
    often = big.join(F.broadcast(hot.drop(count)), keys)
    rest = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.drop(count), keys)
    return often.unionByName(rest)


def text_hash() -> Column:
    """A hash of the column ``text``, null as empty."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def row_key() -> Column:
    """A hash of ``doc_id`` and ``text`` in one."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_hash())


def id_crc(doc_id: int | None) -> int:
    """crc32 of the identifier as text; a null identifier counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def id_crc_column(column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def components(links: DataFrame, label: str, rounds: int = 60) -> DataFrame:
    """Connected components of ``links(a long, b long)``: rows ``(node, root)``, root the smallest node.

    Large-star and small-star rounds: each round links every node's larger (then
    smaller) neighbours to the smallest node it knows, so hubs shrink and no
    group is ever gathered. The rounds stop when the links are a set of stars.
    Each round is written to the shared folder. Raises if ``rounds`` do not do.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    path = scratch(spark, label)
    edges.write.mode("overwrite").parquet(path)
    old, done = path, False
    for _ in range(rounds):
        edges = spark.read.schema("a long, b long").parquet(old)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours go to the least one known
        large = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least.withColumnRenamed("a", "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        new = scratch(spark, label)
        small.write.mode("overwrite").parquet(new)
        now = spark.read.schema("a long, b long").parquet(new)
        # a set of stars: no root is a leaf, and each leaf has one root
        done = now.groupBy("a").count().filter("count > 1").limit(1).count() == 0 and now.join(now.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() == 0
        delete(spark, old)
        old = new
        if done:
            break
    if not done:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return spark.read.schema("a long, b long").parquet(old).select(F.col("a").alias("node"), F.col("b").alias("root"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, trains: Column, most: int, name: str) -> DataFrame:
    """A bounded sample to learn from: doc_id, text, y of at most ``most`` labelled documents of each class.

    ``trains`` says, over doc_id, which rows of ``labels`` may be learned from. The
    sample is the first by a hash of doc_id, so it does not hang on the order of
    rows. Null labels and identifiers are left out; of several labels of a
    document the largest counts. The identifiers, at most 2 * ``most``, are broadcast.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & trains).groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = [rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id"), name)
