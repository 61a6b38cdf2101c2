"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree; DataFrame and SQL functions only.

Each source's documents stand in an order given by a hash, and their words, once or twice over, are
one line that is cut into blocks of equal length. A source's quota is the number of blocks that its target
fills. The tree starts with all quotas at its root and halves the output shards at every node: the
left half gets, source by source, a hypergeometric draw from the node's quotas, so that the shards
differ as a random shuffle would make them differ while sums stay exact. A source's blocks, in
another hashed order, are then dealt to the leaves without overlap, and each shard orders what it got by a hash.

Draws are by inversion: probabilities run from 8 standard deviations below the mean to 8 above. What
is drawn depends on hashes of the seed, the node and the document's key and text alone, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import WORD_PATTERN, materialize, table, unused

#: Weights of the sources in turn, the words of the mix over all words, and times that a source may repeat.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Output shards, and blocks that a shard gets on average: with a row a source they bound the table of blocks.
SHARDS, BLOCKS_A_SHARD = 8, 1024
#: Documents of one stretch of a source's order, on average over all sources.
STRETCH = 4096
SEED = 20240517

_TWO53 = "9007199254740992"


def _uniform(*parts: str) -> str:
    return f"(pmod(xxhash64({', '.join(parts)}), {_TWO53}L) / CAST({_TWO53} AS DOUBLE))"


def hypergeometric(pool: str, marked: str, drawn: str, u: str) -> str:
    """SQL: how many of `marked` items are among `drawn` from `pool`, by inversion at u in [0, 1). All are bigint expressions."""
    mean = f"(CAST({drawn} AS DOUBLE) * {marked} / greatest({pool}, 1L))"
    sd = f"sqrt({mean} * greatest(1 - CAST({marked} AS DOUBLE) / greatest({pool}, 1L), 0D) * (CAST({pool} AS DOUBLE) - {drawn}) / greatest({pool} - 1, 1L))"
    low, high = f"greatest(0L, {drawn} + {marked} - {pool})", f"least({drawn}, {marked})"
    first = f"greatest({low}, CAST(floor({mean} - 8 * {sd} - 8) AS BIGINT))"
    last = f"greatest({first}, least({high}, CAST(ceil({mean} + 8 * {sd} + 8) AS BIGINT)))"
    places = f"sequence({first}, {last})"
    # w: the relative probability of x; the next one follows from it
    step = f"a.w * greatest({marked} - x, 0L) * greatest({drawn} - x, 0L) / (x + 1D) / greatest({pool} - {marked} - {drawn} + x + 1, 1L)"
    total = f"aggregate({places}, named_struct('w', 1D, 'z', 0D), (a, x) -> named_struct('w', CAST({step} AS DOUBLE), 'z', a.z + a.w), a -> a.z)"
    pick = f"aggregate({places}, named_struct('w', 1D, 'z', 0D, 'hit', {last}, 'goal', {u} * {total}), (a, x) -> named_struct('w', CAST({step} AS DOUBLE), 'z', a.z + a.w, 'hit', IF(a.z + a.w > a.goal AND a.hit = {last} AND x < {last} AND a.z <= a.goal, x, a.hit), 'goal', a.goal), a -> a.hit)"
    return pick


def source_targets(sizes: DataFrame, share: float = SHARE, repeats: float = REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(src, rank, source_size, target) for each source; rank from 1 by code point, null last.

    Weighted shares of share * all words; a target stops at repeats * its source's size, and what is
    over goes to the others by weight: the level that all others reach is the first, in the order
    of cap by weight, that the next cap doesn't stop.
    """
    s = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("src"))))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + F.when(F.col("rank") % len(weights) == 0, len(weights)).otherwise(0)))
    s = s.withColumn("cap", F.col("source_size") * float(repeats)).withColumn("ratio", F.col("cap") / F.col("w"))
    every = Window.partitionBy(F.lit(1))
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(every)["level"])
    return s.select("src", "rank", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(shard, rank, n): blocks of each source for each shard, from (rank, quota). Sums over shards are the quotas; shards' sums differ by a block or so."""
    root = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "quota"))), lambda x: x["quota"]).alias("q"))
    nodes = root.select(F.lit(0).alias("lo"), F.lit(shards).alias("width"), "q")
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        total = "aggregate(q, 0L, (s, x) -> s + x)"
        nodes = nodes.withColumn("left", (F.col("width") / 2).cast("int")).withColumn("pool", F.expr(total))
        nodes = nodes.withColumn("need", F.expr("CAST(floor(pool * CAST(left AS DOUBLE) / width) AS BIGINT)"))
        u = _uniform(f"{seed}L", "lo", "width", "i")
        draw = hypergeometric("acc.pool", "q[i]", "acc.need", u)
        drawn = f"""aggregate(sequence(0, size(q) - 1), named_struct('pool', pool, 'need', need, 'got', CAST(array() AS ARRAY<BIGINT>), 'x', 0L),
          (before, i) -> transform(array(before), acc -> transform(array({draw}), y -> named_struct('pool', acc.pool - q[i], 'need', acc.need - y, 'got', array_append(acc.got, y), 'x', y))[0])[0], acc -> acc.got)"""
        nodes = nodes.withColumn("got", F.expr(f"IF(width > 1 AND size(q) > 0, {drawn}, q)"))
        halves = "IF(width > 1, array(named_struct('lo', lo, 'width', left, 'q', got), named_struct('lo', lo + left, 'width', width - left, 'q', zip_with(q, got, (a, b) -> a - b))), array(named_struct('lo', lo, 'width', width, 'q', q)))"
        nodes = nodes.select(F.explode(F.expr(halves)).alias("n")).select("n.*")
    return nodes.select(F.col("lo").alias("shard"), F.posexplode("q").alias("pos", "n")).select("shard", (F.col("pos") + 1).alias("rank"), "n")


def mixing_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, seed: int = SEED, carried: tuple[str, ...] = ()) -> DataFrame:
    """(key, size, source_size, target, taken, pieces) for every row of docs.

    size counts the words of the whole text (null: 0). pieces has, for each time that the mix takes
    the row: copy (1, 2), words (the size, but fewer where the source's target ends inside the
    document), shard, and place (the order in the shard); taken is the sum of words. The sum over a source is its target
    rounded to whole words. A null source is a source of its own; rows without words are never
    taken; rows that repeat a key are documents of their own. Extra columns are ignored but for the carried ones.
    """
    # the text counts in the hash, so rows that share a key, or have none, are spread as others are
    h = F.xxhash64(F.lit(seed), F.col("k"), F.col("of_text"))
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("of_text"), F.col(source).alias("src"), F.coalesce(F.regexp_count(F.col(text), F.lit(f"({WORD_PATTERN})")), F.lit(0)).cast("bigint").alias("size"), *carried)
    rows = materialize(rows.withColumn("h", h), "sizes").drop("of_text")
    stretches = 1 << max(0, math.ceil(math.log2(max(1, rows.count()) / STRETCH)) + 4)
    sources = materialize(source_targets(rows), "sources").withColumn("goal", F.round("target").cast("bigint"))
    block = F.greatest(F.lit(1), F.ceil(F.sum("goal").over(Window.partitionBy(F.lit(1))) / (shards * BLOCKS_A_SHARD))).cast("bigint")
    sources = materialize(sources.withColumn("block", block).withColumn("quota", F.ceil(F.col("goal") / F.col("block")).cast("bigint")), "sources")
    # which shard each block goes to: at most shards * BLOCKS_A_SHARD blocks and one a source
    leaves = split_quotas(sources.select("rank", "quota"), shards, seed)
    dealt = leaves.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    dealt = dealt.where("n > 0").select("rank", "shard", F.explode(F.expr("sequence(first, first + n - 1)")).alias("turn"))
    blocks = sources.where("quota > 0").select("rank", F.explode(F.expr("sequence(0L, quota - 1)")).alias("b"))
    order = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed), F.lit("block"), "rank", "b"), "b")
    blocks = materialize(blocks.withColumn("turn", (F.row_number().over(order) - 1).cast("bigint")).join(dealt, ["rank", "turn"]).select("rank", "b", "shard"), "blocks")
    # where each document begins in its source's line of words
    rows = rows.withColumn("part", F.pmod(F.shiftrightunsigned("h", 40), F.lit(stretches)))
    of_source = sources.select(F.col("src").alias("s2"), "rank", "source_size", "target", "goal", "block")
    rows = rows.join(of_source, F.col("src").eqNullSafe(F.col("s2"))).drop("src", "s2")
    parts = rows.groupBy("rank", "part").agg(F.sum("size").alias("n"))
    parts = parts.select("rank", "part", F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("rank", "part").orderBy("h", "k", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, ["rank", "part"]).withColumn("at", F.col("before") + F.col("inner"))
    for copy in (1, 2):
        begin = F.col("at") + (copy - 1) * F.col("source_size")
        taken = F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - begin))
        own = blocks.select(F.col("rank").alias("r"), F.col("b").alias(f"b{copy}"), F.col("shard").alias(f"shard{copy}"))
        placed = placed.withColumn(f"words{copy}", taken).withColumn(f"at{copy}", F.when(taken > 0, F.floor(begin / F.col("block"))))
        placed = placed.join(own, (F.col("rank") == F.col("r")) & (F.col(f"at{copy}") == F.col(f"b{copy}")), "left").drop("r", f"b{copy}")
    piece = [F.when(F.col(f"words{c}") > 0, F.struct(F.lit(c).alias("copy"), F.col(f"words{c}").alias("words"), F.col(f"shard{c}").alias("shard"), F.xxhash64(F.lit(seed), F.lit("place"), F.lit(c), F.col("h")).alias("place"))) for c in (1, 2)]
    pieces = F.filter(F.array(*piece), lambda x: x.isNotNull())
    placed = placed.withColumn("pieces", pieces)
    return placed.select(F.col("k").alias(key), "size", "source_size", "target", F.aggregate("pieces", F.lit(0).cast("bigint"), lambda a, x: a + x["words"]).alias("taken"), "pieces", *carried)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows that the mix takes, with the columns of docs, a row for each time, in the order of shards and shuffled inside each; a task holds a range of that order.

    A document where its source's target ends keeps the words before that end, joined by spaces;
    all others keep their whole text. Rows that share a key, or have none, are documents of their own.
    """
    free = unused(docs, "size", "row", "turn", "piece")
    c = {name: F.col(f"`{made}`") for name, made in free.items()}
    own = F.col(f"`{text}`")
    size = F.coalesce(F.regexp_count(own, F.lit(f"({WORD_PATTERN})")), F.lit(0)).cast("bigint")
    rows = docs.withColumns({free["size"]: size, free["row"]: F.xxhash64(*[F.col(f"`{x}`") for x in docs.columns])})
    plan = mixing_plan(rows, key, text, source, shards, seed, carried=(free["row"],)).where("taken > 0")
    # one of the rows that are equal in all columns stands for them, found before the shuffle; texts are shuffled once for this and once to their shards
    plan = plan.select(F.col("size").alias(free["size"]), free["row"], F.explode("pieces").alias(free["piece"]))
    rows = rows.withColumn(free["turn"], F.row_number().over(Window.partitionBy(free["size"], free["row"]).orderBy(free["row"]))).where(c["turn"] == 1)
    taken = plan.join(rows, [free["size"], free["row"]])
    cut = F.array_join(F.slice(F.regexp_extract_all(own, F.lit(f"({WORD_PATTERN})")), 1, c["piece"]["words"].cast("int")), " ")
    taken = taken.withColumn(text, F.when(c["piece"]["words"] < c["size"], cut).otherwise(own))
    # as many tasks as the session deals shuffles to, or as few as the bytes ask for: files follow the order of shards
    place = [c["piece"]["shard"], c["piece"]["place"]]
    taken = taken.repartitionByRange(*place).sortWithinPartitions(*place, F.col(f"`{key}`"))
    return taken.select(*[F.col(f"`{x}`") for x in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_plan(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
