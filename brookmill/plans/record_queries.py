"""Sort-benchmark records keyed by a digest of each ``lineitem`` row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import binary
from ..operators import records as ops
from ..session import cut_lineage, scratch_path, shuffle_partitions
from ..sources import fixedwidth, records_gen
from .registry import query, table

PARTITIONS = 64  # of the prefix-partitioned sort, in query and SQL alike
ID_SQL = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
KEYS = f"k AS (SELECT substr(md5({ID_SQL}), 1, 20) AS key, l_orderkey FROM lineitem)"
# CRC-32 bit by bit, the polynomial in reflected form; keys are 10 bytes
CRC_SQL = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(range(0, 80), lambda i: (CAST(('0x' || substr(key, CAST(i // 8 AS INTEGER) * 2 + 1, 2)) AS BIGINT) >> CAST(i % 8 AS INTEGER)) & 1)),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)))"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key`` (10 bytes of an md5) and a 90-byte ``value`` per line."""
    digest = F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").cast("binary"))
    text = F.rpad(F.concat_ws("|", "l_orderkey", "l_shipdate", "l_extendedprice"), 90, ".")
    return table(spark, sf_dir, "lineitem").select(F.unhex(F.substring(digest, 1, 20)).alias("key"), text.cast("binary").alias("value"))


@query(
    "record_prefix_partitions",
    f"""WITH {KEYS}, p AS (
  SELECT key, least({PARTITIONS - 1}, CAST(('0x' || substr(key, 1, 14)) AS BIGINT) // {ops.PREFIX_SPACE // PARTITIONS}) AS pid FROM k)
SELECT CAST(pid AS INTEGER) AS pid, CAST(count(*) AS BIGINT) AS n, min(key) AS first_key, max(key) AS last_key, CAST(0 AS BIGINT) AS disorders
FROM p GROUP BY pid""",
)
def record_prefix_partitions(spark, sf_dir):
    """Sort with partitions from the key prefix; ends and order of each partition."""
    placed = ops.sort_records(records(spark, sf_dir), PARTITIONS, sampled=False).withColumn("_mid", F.monotonically_increasing_id())
    placed = cut_lineage(placed).select("key", F.shiftright("_mid", 33).cast("int").alias("pid"), (F.col("_mid") % (1 << 33)).alias("pos"))
    ends = ops.partition_ends(placed, "pid", "pos")
    wrong = ops.adjacent_violations(placed, "pid", "pos").groupBy("pid").agg(F.count(F.lit(1)).alias("d"))
    return ends.join(wrong, "pid", "left").select(
        "pid", "n", binary.key_hex(F.col("first_key")).alias("first_key"), binary.key_hex(F.col("last_key")).alias("last_key"),
        F.coalesce("d", F.lit(0)).alias("disorders"),
    )


@query(
    "record_sort_validate",
    f"""WITH {KEYS} SELECT CAST(count(*) AS BIGINT) AS records,
  lower(to_hex(CAST(sum(xor({CRC_SQL}, 4294967295)) AS BIGINT))) AS checksum,
  CAST(0 AS BIGINT) AS inside_disorders, CAST(0 AS BIGINT) AS border_disorders FROM k""",
)
def record_sort_validate(spark, sf_dir):
    """Write unsorted records, scan, sort, write, scan again and validate."""
    raw, ordered = scratch_path(spark, "records"), scratch_path(spark, "sorted")
    fixedwidth.write_records(records(spark, sf_dir), raw)
    fixedwidth.write_records(ops.sort_records(fixedwidth.read_records(spark, raw), shuffle_partitions(spark)), ordered)
    return ops.validate_records(fixedwidth.read_records(spark, ordered))


@query(
    "record_checksum",
    f"WITH {KEYS} SELECT lower(to_hex(CAST(sum(xor({CRC_SQL}, 4294967295)) AS BIGINT))) AS checksum FROM k",
)
def record_checksum(spark, sf_dir):
    return ops.checksum(records(spark, sf_dir))


@query(
    "record_file_scan",
    f"""WITH v AS (SELECT substr(md5({ID_SQL}), 1, 20) AS key, rpad(concat_ws('|', l_orderkey, l_shipdate, l_extendedprice), 90, '.') AS value FROM lineitem)
SELECT key, CAST(count(*) AS BIGINT) AS n, CAST(sum(strlen(value)) AS BIGINT) AS value_bytes, min(md5(value)) AS first_digest, max(md5(value)) AS last_digest
FROM v GROUP BY key""",
)
def record_file_scan(spark, sf_dir):
    path = scratch_path(spark, "records")
    fixedwidth.write_records(records(spark, sf_dir), path)
    back = fixedwidth.read_records(spark, path, splitBytes=1_000_000)
    return back.groupBy(binary.key_hex(F.col("key")).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).cast("bigint").alias("value_bytes"),
        F.min(F.md5("value")).alias("first_digest"), F.max(F.md5("value")).alias("last_digest"),
    )


BLOCK = 128


def _limb_step(a: int, c: int) -> str:
    """``a * x + c`` modulo 2^128 over four 32-bit limbs ``x0 .. x3``, carry by carry."""
    part = lambda n, k: (n >> (32 * k)) & 0xFFFFFFFF
    columns, total = [], ""
    for k in range(4):
        carry = f" + ({total}) // 4294967296" if total else ""
        products = " + ".join(f"CAST({part(a, j)} AS HUGEINT) * x{k - j}" for j in range(k + 1))
        total = f"{products} + {part(c, k)}{carry}"
        columns.append(f"({total}) % 4294967296")
    return ", ".join(columns)


# block starts by long steps, then all blocks advance together
SEQUENCE = f"""blocks AS (
  SELECT CAST(0 AS BIGINT) AS b, {', '.join(f'CAST({(records_gen.SHIFT >> (32 * k)) & 0xFFFFFFFF} AS HUGEINT) AS x{k}' for k in range(4))}
  UNION ALL SELECT b + 1, {_limb_step(*records_gen.jump(BLOCK))} FROM blocks WHERE b < (SELECT max(o_orderkey) // {BLOCK} FROM orders)),
states AS (
  SELECT b, CAST(0 AS BIGINT) AS i, x0, x1, x2, x3 FROM blocks
  UNION ALL SELECT b, i + 1, {_limb_step(records_gen.STEP, records_gen.SHIFT)} FROM states WHERE i < {BLOCK - 1}),
made AS (SELECT b * {BLOCK} + i AS number, lower(concat(lpad(to_hex(CAST(x3 AS BIGINT)), 8, '0'), lpad(to_hex(CAST(x2 AS BIGINT)), 8, '0'),
  substr(lpad(to_hex(CAST(x1 AS BIGINT)), 8, '0'), 1, 4))) AS key FROM states),
k AS (SELECT number, key FROM made JOIN orders ON number = o_orderkey)"""


@query(
    "record_generate_validate",
    f"""WITH RECURSIVE {SEQUENCE} SELECT CAST(count(*) AS BIGINT) AS records,
  lower(to_hex(CAST(sum(xor({CRC_SQL}, 4294967295)) AS BIGINT))) AS checksum,
  CAST(0 AS BIGINT) AS inside_disorders, CAST(0 AS BIGINT) AS border_disorders FROM k""",
)
def record_generate_validate(spark, sf_dir):
    """One generated record per order, numbered by its key, sorted and validated."""
    numbers = table(spark, sf_dir, "orders").select("o_orderkey")
    path = scratch_path(spark, "generated")
    fixedwidth.write_records(ops.sort_records(records_gen.records_for(numbers), shuffle_partitions(spark)), path)
    return ops.validate_records(fixedwidth.read_records(spark, path))


@query(
    "record_disorder",
    """WITH k AS (SELECT o_orderpriority AS part, o_orderkey AS position, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 20) AS key FROM orders),
l AS (SELECT *, lag(key) OVER (PARTITION BY part ORDER BY position) AS previous_key FROM k)
SELECT part, position, key, previous_key FROM l WHERE previous_key > key""",
)
def record_disorder(spark, sf_dir):
    """Adjacent rows out of order, in five groups numbered with gaps."""
    key = F.unhex(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 20))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("part"), F.col("o_orderkey").alias("position"), key.alias("key"))
    wrong = ops.adjacent_violations(rows, "part", "position")
    return wrong.select("part", "position", *[binary.key_hex(F.col(c)).alias(c) for c in ("key", "previous_key")])


@query(
    "record_bytes",
    f"""WITH {KEYS} SELECT CAST(('0x' || substr(key, 1, 14)) AS BIGINT) AS prefix,
  concat_ws(' ', CAST(('0x' || substr(key, 1, 2)) AS INTEGER), CAST(('0x' || substr(key, 3, 2)) AS INTEGER)) AS first_bytes,
  substr(key, 5, 16) AS rest, key > '7fffffffffffffffffff' AS upper_half, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY ALL""",
)
def record_bytes(spark, sf_dir):
    """Byte slices, prefix number, unsigned rendering and unsigned comparison of keys."""
    key = F.col("key")
    return records(spark, sf_dir).groupBy(
        binary.prefix_number(key).alias("prefix"), binary.unsigned_bytes(key, 2).alias("first_bytes"),
        binary.key_hex(F.substring(key, 3, 8)).alias("rest"), (key > F.unhex(F.lit("7f" + "ff" * 9))).alias("upper_half"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "record_generate",
    f"""WITH RECURSIVE {SEQUENCE} SELECT number, key, lpad(to_hex(number), 32, '0') AS number_text FROM k""",
)
def record_generate(spark, sf_dir):
    """Key and printed record number of one generated record per order."""
    made = records_gen.records_for(table(spark, sf_dir, "orders").select("o_orderkey"))
    return made.select("number", binary.key_hex(F.col("key")).alias("key"), F.substring("value", 3, 32).cast("string").alias("number_text"))
