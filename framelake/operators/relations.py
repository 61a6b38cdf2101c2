"""Relations between rows of pictures, blocks and samples: last writes, flags, descriptions, missing references, completeness, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_writes(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, value): of all rows with the same keys, the value of the last in order. Combined on the map side; a null key is a key like others."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def flagged(rows: DataFrame, key: str, marks: DataFrame, mark: str, name: str) -> DataFrame:
    """rows with a flag: whether their key is among the marks. Marks may repeat; a null key is never marked."""
    listed = marks.select(F.col(mark).alias("__mark")).distinct()
    return rows.join(listed, rows[key] == listed["__mark"], "left").withColumn(name, F.col("__mark").isNotNull()).drop("__mark")


def described(rows: DataFrame, key: str, descriptions: DataFrame, description: str) -> DataFrame:
    """rows with the columns of the description that their key names; rows without one go."""
    return rows.join(descriptions, rows[key] == descriptions[description]).drop(descriptions[description])


def dangling(rows: DataFrame, key: str, targets: DataFrame, target: str) -> DataFrame:
    """rows whose key is not among the targets; a null key is not."""
    return rows.join(targets, rows[key] == targets[target], "left_anti")


def top(rows: DataFrame, keys: list[str], order: list[Column | str], n: int, name: str = "place") -> DataFrame:
    """The first n rows of each group in order, with their place from 1; Spark keeps n a group before it shuffles."""
    numbered = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    return numbered.where(F.col(name) <= n)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) for keys that n rows have, two or more."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def completeness(blocks: DataFrame, picture: str, address: str, expected: Column) -> DataFrame:
    """(picture, decoded, expected, complete): how many distinct addresses each picture has of those that it should; expected is an aggregate."""
    out = blocks.groupBy(picture).agg(F.countDistinct(address).alias("decoded"), expected.cast("bigint").alias("expected"))
    return out.withColumn("complete", F.col("decoded") == F.col("expected"))


def out_of_range(blocks: DataFrame, address: str, total: str) -> DataFrame:
    """Blocks whose address is below 0 or not below the total, or null."""
    return blocks.where(~F.coalesce((F.col(address) >= 0) & (F.col(address) < F.col(total)), F.lit(False)))


def with_neighbours(blocks: DataFrame, picture: str, address: str, value: str, steps: dict[str, int]) -> DataFrame:
    """blocks with the value of the block so many addresses before, for each name of steps; null where there is none. Of neighbours that repeat an address the largest value counts.

    Each block goes to its own address and to those that look at it, so one shuffle brings all directions. A row with a null picture or address has no neighbours; columns of blocks with the new names are replaced.
    """
    kept = [c for c in blocks.columns if c not in steps]
    own = F.struct(*[F.col(f"`{c}`") for c in kept])
    at, v = F.col(f"`{address}`"), F.col(f"`{value}`")
    there = at.isNotNull() & F.col(f"`{picture}`").isNotNull()
    none, nothing = F.lit(None).cast(blocks.select(own.alias("o")).schema["o"].dataType), F.lit(None).cast(dict(blocks.dtypes)[value])
    sent = [F.struct(F.lit(0).alias("k"), at.cast("bigint").alias("a"), own.alias("own"), nothing.alias("v"))]
    sent += [F.when(there, F.struct(F.lit(k).alias("k"), (at + step).cast("bigint").alias("a"), none.alias("own"), v.alias("v"))) for k, step in enumerate(steps.values(), 1)]
    # rows without an address meet nobody, so each is a group of its own
    salt = F.when(there, F.lit(0).cast("bigint")).otherwise(F.monotonically_increasing_id()).alias("s")
    spread = blocks.select(F.col(f"`{picture}`").alias("p"), salt, F.explode(F.filter(F.array(*sent), lambda x: x.isNotNull())).alias("x")).select("p", "s", "x.*")
    met = spread.groupBy("p", "a", "s").agg(F.collect_list(F.when(F.col("k") == 0, F.col("own"))).alias("own"), *[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"v{k}") for k in range(1, len(steps) + 1)])
    each = met.select(F.explode("own").alias("own"), *[f"v{k}" for k in range(1, len(steps) + 1)])
    return each.select(*[F.col(f"own.`{c}`").alias(c) for c in kept], *[F.col(f"v{k}").alias(n) for k, n in enumerate(steps, 1)])


#: Blocks across and down a tile of tiled_neighbours().
TILE = 16


def tiled_neighbours(blocks: DataFrame, picture: str, address: str, value: str, slice_id: str, width: int | Column, tile: int = TILE) -> DataFrame:
    """(picture, address, value, slice, left, top, top_right, top_left): each block with the values of its four neighbours, null where one is not available.

    Addresses run in raster order in a picture of width blocks across. A neighbour is available if it is in the picture, is there, and belongs to the block's slice. Pictures are cut into tiles; a
    block goes to its own tile and, as a border, to those of the blocks that look at it, so that one shuffle by tile brings all four directions, and a tile is at most (tile + 2) ** 2 blocks
    however large a picture is. Of rows that repeat an address the one with the smallest (slice, value) counts. Rows with a null picture, address or slice have no neighbours and are left out, as is an address
    below 0; a null value is a block whose value is null.
    """
    w = F.lit(width) if isinstance(width, int) else width
    rows = blocks.select(F.col(picture).alias("p"), F.col(address).cast("bigint").alias("a"), F.col(value).alias("v"), F.col(slice_id).alias("s"), w.cast("bigint").alias("w")).where("p IS NOT NULL AND a >= 0 AND s IS NOT NULL AND w > 0")
    x, y = F.col("a") % F.col("w"), F.floor(F.col("a") / F.col("w"))
    places = []
    for dx, dy in ((0, 0), (1, 0), (0, 1), (-1, 1), (1, 1)):  # itself, and the blocks whose left, top, top right and top left neighbour it is
        inside = (x + dx >= 0) & (x + dx < F.col("w"))
        places.append(F.when(inside, F.struct(F.floor((x + dx) / tile).alias("tx"), F.floor((y + dy) / tile).alias("ty"))))
    tiles = F.array_distinct(F.filter(F.array(*places), lambda t: t.isNotNull()))
    own = F.struct(F.floor(x / tile).alias("tx"), F.floor(y / tile).alias("ty"))
    spread = rows.withColumn("own", own).withColumn("t", F.explode(tiles))
    gathered = spread.groupBy("p", "t", "w").agg(F.array_sort(F.collect_list(F.struct("a", "s", "v", (F.col("own") == F.col("t")).alias("mine")))).alias("b"))
    # the first of each address, as a map by address
    firsts = F.filter("b", lambda r, i: (i == 0) | (F.get("b", i - 1)["a"] != r["a"]))
    gathered = gathered.withColumn("b", firsts).withColumn("m", F.map_from_entries(F.transform("b", lambda r: F.struct(r["a"], r))))
    each = gathered.select("p", "w", "m", F.explode(F.filter("b", lambda r: r["mine"])).alias("r"))

    def neighbour(step: Column, edge: Column) -> Column:
        there = F.try_element_at("m", F.col("r.a") - step)
        return F.when(edge & (there["s"] == F.col("r.s")), there["v"])

    x, width_ = F.col("r.a") % F.col("w"), F.col("w")
    named = {"left": neighbour(F.lit(1), x > 0), "top": neighbour(width_, F.lit(True)), "top_right": neighbour(width_ - 1, x < width_ - 1), "top_left": neighbour(width_ + 1, x > 0)}
    return each.select(F.col("p").alias(picture), F.col("r.a").alias(address), F.col("r.v").alias(value), F.col("r.s").alias(slice_id), *[c.alias(n) for n, c in named.items()])


def strongest(edges: DataFrame, keys: list[str], strength: str, name: str) -> DataFrame:
    """(keys, name): the largest strength of the edges of each key, as that of two luma segments is a chroma segment's; nulls do not count, and the result is null where all are null."""
    return edges.groupBy(*keys).agg(F.max(strength).alias(name))


def conditional_counts(rows: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    """(keys, a count for each condition): rows for which it holds."""
    return rows.groupBy(*keys).agg(*[F.sum(F.when(c, 1).otherwise(0)).cast("bigint").alias(n) for n, c in conditions.items()])
