"""Sharding by best-fit-decreasing bin packing.

Rows of equal text are a group that stays together. Groups, largest first, enter the bin
whose remaining capacity is the tightest that holds them, found in a balanced tree over
the remaining capacities; capacity is the mean load of a shard, so the fewest fixed-capacity
bins fill evenly. What fits no bin any more goes to the emptiest one.

Groups of one size class are interchangeable, so the packing works on classes (size class,
number of groups) and fills a bin with as many of a class as fit: the same result as one
by one. Sizes up to 2^15 bytes are classes of their own; above, sizes are rounded up to 15
significant bits. Classes with many groups are split by a salt so that ranking the groups
of a class never gathers more than about SALT_GROUPS of them, or one MOST_SALTS-th of all
where that is more. The driver sees the classes only: at most some 2^15 plus 2^14 for each
doubling of size, plus MOST_SALTS.

Only a group larger than a whole shard can't be indivisible in shards of near equal size; it
is cut by a hash of the row into pieces of about PIECE of a shard, and each piece stays
together. Every other group is in one shard.

Rows of one text are spread over SPREAD tasks wherever they meet a table by their text.

Edge cases: null text has no bytes and the checksum of the empty text; null texts are equal
to the empty text; very long texts are read once, for their size and hashes; repeated rows and
null ids are rows like others; groups of equal size are ranked by their hashes; an empty table
gives no rows; fewer rows than shards leave shards empty; the result has its own columns and
the id only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.llm.common import materialize, with_columns

OVERHEAD = 16
SALT_GROUPS = 20_000
MOST_SALTS = 50_000
SPREAD = 64
PIECE = 0.25
SLOT_ROWS = 20_000


@dataclass
class _Node:
    key: tuple[int, int]  # remaining capacity, bin
    left: _Node | None = None
    right: _Node | None = None
    height: int = 1


class Capacities:
    """A balanced (AVL) tree of (remaining capacity, bin)."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    def add(self, key: tuple[int, int]) -> None:
        self.root = _insert(self.root, key)

    def remove(self, key: tuple[int, int]) -> None:
        self.root = _delete(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The smallest remaining capacity of at least size."""
        node, best = self.root, None
        while node:
            if node.key >= (size, -1):
                node, best = node.left, node.key
            else:
                node = node.right
        return best

    def largest(self) -> tuple[int, int] | None:
        node = self.root
        while node and node.right:
            node = node.right
        return node.key if node else None


def _height(node: _Node | None) -> int:
    return node.height if node else 0


def _rotate(node: _Node, left: bool) -> _Node:
    child = node.right if left else node.left
    if left:
        node.right, child.left = child.left, node
    else:
        node.left, child.right = child.right, node
    for x in (node, child):
        x.height = 1 + max(_height(x.left), _height(x.right))
    return child


def _balance(node: _Node) -> _Node:
    node.height = 1 + max(_height(node.left), _height(node.right))
    lean = _height(node.left) - _height(node.right)
    if lean > 1:
        if _height(node.left.left) < _height(node.left.right):
            node.left = _rotate(node.left, True)
        return _rotate(node, False)
    if lean < -1:
        if _height(node.right.right) < _height(node.right.left):
            node.right = _rotate(node.right, False)
        return _rotate(node, True)
    return node


def _insert(node: _Node | None, key: tuple[int, int]) -> _Node:
    if node is None:
        return _Node(key)
    if key < node.key:
        node.left = _insert(node.left, key)
    else:
        node.right = _insert(node.right, key)
    return _balance(node)


def _delete(node: _Node | None, key: tuple[int, int]) -> _Node | None:
    if node is None:
        return None
    if key < node.key:
        node.left = _delete(node.left, key)
    elif key > node.key:
        node.right = _delete(node.right, key)
    elif not node.left or not node.right:
        return node.left or node.right
    else:
        after = node.right
        while after.left:
            after = after.left
        node.key = after.key
        node.right = _delete(node.right, after.key)
    return _balance(node)


def pack(classes: list[tuple[int, int]], n_bins: int, capacity: int) -> list[list[tuple[int, int]]]:
    """Best-fit-decreasing over (size, count), sizes falling. For each class, its groups in
    order as (bin, how many)."""
    tree = Capacities()
    for b in range(n_bins):
        tree.add((capacity, b))
    out = []
    for size, count in classes:
        placed: list[tuple[int, int]] = []
        while count:
            fit = tree.tightest(size)
            room, b = fit or tree.largest()
            n = min(count, max(room // max(size, 1), 1)) if fit else 1
            tree.remove((room, b))
            tree.add((room - n * size, b))
            if placed and placed[-1][0] == b:
                placed[-1] = (b, placed[-1][1] + n)
            else:
                placed.append((b, n))
            count -= n
        out.append(placed)
    return out


def size_class(size: Column) -> Column:
    """Sizes up to 2^15 exactly, larger ones rounded up to 15 significant bits."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))) - 14, F.lit(0))).cast("long")
    return (F.ceil(size.cast("double") / step) * step).cast("long")


def shard(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) for each row; slots of a shard have no gaps."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "shard-rows")  # ids and hashes only; texts are read once
    total = rows.agg(F.sum("size")).first()[0] or 0
    capacity = max(1, -(-total // n_shards))
    piece = max(1, int(capacity * PIECE))

    key = ["h1", "h2", "size"]
    groups = rows.groupBy(*key).agg(F.count("*").alias("n"))
    cut = groups.where((F.col("n") > 1) & (F.col("n") * F.col("size") > capacity)).select(*key, F.ceil(F.col("n") * F.col("size") / piece).cast("long").alias("pieces"))
    rows = rows.join(F.broadcast(cut), key, "left")  # groups larger than a shard are fewer than shards
    rows = rows.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("id", "row", F.lit(5)), F.col("pieces")), F.lit(0).cast("long"))).drop("pieces")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "row", F.lit(7)), F.lit(SPREAD)).cast("int"))

    key = [*key, "piece"]
    groups = rows.groupBy(*key, "part").agg(F.count("*").alias("n")).groupBy(*key).agg(F.sum("n").alias("n"), F.collect_list("part").alias("parts"))
    groups = materialize(groups.select(*key, size_class(F.col("n") * F.col("size")).alias("class"), "parts"), "shard-groups")
    most = max(SALT_GROUPS, groups.count() // MOST_SALTS)
    many = groups.groupBy("class").agg(F.count("*").alias("n")).where(F.col("n") > most).select("class", F.ceil(F.col("n") / most).cast("long").alias("salts"))
    groups = groups.join(F.broadcast(many), "class", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*key), F.col("salts")), F.lit(0).cast("long"))).drop("salts")
    classes = sorted(((c, s, n) for c, s, n in groups.groupBy("class", "salt").agg(F.count("*").alias("n")).collect()), reverse=True)

    placed = pack([(c, n) for c, _, n in classes], n_shards, capacity)
    table = []
    for (c, s, _), bins in zip(classes, placed, strict=True):
        at = 0
        for b, n in bins:
            table.append((c, s, at, b))
            at += n
    starts = spark.createDataFrame(table, "class long, salt long, first long, shard int").groupBy("class", "salt").agg(F.sort_array(F.collect_list(F.struct("first", "shard"))).alias("bins"))

    rank = F.row_number().over(Window.partitionBy("class", "salt").orderBy(*key)) - 1
    own = groups.withColumn("rank", rank).join(starts, ["class", "salt"])
    own = own.select(*key, F.element_at(F.filter("bins", lambda b: b["first"] <= F.col("rank")), -1)["shard"].alias("shard"), F.explode("parts").alias("part"))
    return _slots(rows.join(own, [*key, "part"]).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", F.col("row").alias("_row")), id_col).select(id_col, "size", "text_crc32", "shard", "slot")


def _slots(rows: DataFrame, id_col: str) -> DataFrame:
    """Number the rows of each shard: within hash buckets, then shifted by the buckets before."""
    rows = materialize(rows, "shard-placed")
    n = rows.count()
    buckets = max(1, n // SLOT_ROWS)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "size", "text_crc32", "_row"), F.lit(buckets)).cast("int"))
    shift = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = shift.select("shard", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))
    at = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(id_col, "size", "text_crc32", "_row")) - 1
    rows = rows.withColumn("_at", at).join(shift, ["shard", "_bucket"])
    return with_columns(rows, slot=(F.col("_at") + F.col("_shift")).cast("long")).drop("_at", "_shift", "_bucket")


def write_shards(docs: DataFrame, n_shards: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as Parquet, one folder a shard. Ids must be unique."""
    placed = shard(docs, n_shards, id_col, text_col).select(id_col, "shard")
    docs.join(placed, id_col).write.partitionBy("shard").parquet(path)


def near_equal(spark: SparkSession, placed: DataFrame) -> float:
    """The fullest shard's bytes over the mean."""
    load = placed.groupBy("shard").agg(F.sum("size").alias("b"))
    return load.agg(F.max("b") / F.avg("b")).first()[0]
