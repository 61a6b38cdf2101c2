"""Reference lists of pictures and the filters that read them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.scan import index as row_number
from framelake.operators.scan import prefix, scan


#: Samples of a chunk of six_tap().
TAP_CHUNK = 1 << 16


def list_p(pictures: DataFrame, group: str, tie: str, current: int, largest: int) -> DataFrame:
    """pictures with place from 0: short-term by wrapped picture number from high to low, then long-term by index."""
    wrapped = F.col("frame_num") - F.when(F.col("frame_num") > current, largest).otherwise(0)
    order = Window.partitionBy(group).orderBy("long", F.when(F.col("long"), F.col("long_idx")).otherwise(-wrapped), tie)
    return pictures.withColumn("place", F.row_number().over(order) - 1)


def lists_b(pictures: DataFrame, group: str, tie: str, current: int) -> DataFrame:
    """(group, l0, l1): ids by picture order count. l0: before from the nearest, after, long-term; l1: after, before, long-term.

    Where the two are the same and have two pictures or more, the first two of l1 change places. A
    group is the decoded-picture buffer of one picture, a few dozen at most by its format.
    """
    before = ~F.col("long") & (F.col("poc") < current)
    near = F.when(F.col("long"), F.col("long_idx")).when(before, -F.col("poc")).otherwise(F.col("poc"))
    first = F.when(F.col("long"), 2).when(before, 0).otherwise(1)
    second = F.when(F.col("long"), 2).when(before, 1).otherwise(0)

    def ids(kind):
        return F.transform(F.array_sort(F.collect_list(F.struct(kind.alias("s"), near.alias("n"), F.col(tie).alias("id")))), lambda x: x["id"])

    out = pictures.groupBy(group).agg(ids(first).alias("l0"), ids(second).alias("l1"))
    swapped = F.concat(F.array(F.get("l1", F.lit(1)), F.get("l1", F.lit(0))), F.slice("l1", 3, F.greatest(F.size("l1"), F.lit(1))))
    return out.withColumn("l1", F.when((F.col("l0") == F.col("l1")) & (F.size("l1") > 1), swapped).otherwise(F.col("l1")))


def modified_list(pictures: str, operations: str, frame_num: str, largest: str) -> Column:
    """A reference list after the modifications of a slice header: null where one names a picture that is not there.

    pictures is an array of structs (id, frame_num, long, long_idx), operations one of (idc, value): 0 and 1 step the predicted number down or up by
    value + 1 and take the short-term picture of that number, 2 takes the long-term picture of that index. Each goes to the next place from the front, and the first
    copy of it behind that place goes.
    """
    number = f"CASE o.idc WHEN 0 THEN pmod(a.number - o.value - 1, {largest}) WHEN 1 THEN pmod(a.number + o.value + 1, {largest}) ELSE a.number END"
    hit = "CASE WHEN o.idc = 2 THEN p.long AND p.long_idx = o.value ELSE NOT p.long AND p.frame_num = n END"
    found = f"transform(array({number}), n -> named_struct('n', n, 't', get(filter(a.list, p -> {hit}), 0)))[0]"
    behind = "slice(a.list, a.at + 1, size(a.list))"
    rest = f"transform(array(array_position(transform({behind}, p -> p.id), f.t.id)), k -> filter({behind}, (p, i) -> i + 1 <> k))[0]"
    moved = f"concat(slice(a.list, 1, a.at), array(f.t), {rest})"
    step = f"transform(array({found}), f -> named_struct('list', CASE WHEN f.t IS NULL OR a.list IS NULL THEN NULL ELSE {moved} END, 'number', CAST(f.n AS BIGINT), 'at', a.at + 1))[0]"
    return F.expr(f"aggregate({operations}, named_struct('list', {pictures}, 'number', CAST({frame_num} AS BIGINT), 'at', 0), (a, o) -> {step}, a -> a.list)")


def place_in_list(ids: str, picture: str) -> Column:
    """The place from 0 of a picture in a list, null where it is not there."""
    return F.expr(f"nullif(array_position({ids}, {picture}), 0) - 1")


def marked(held: list[tuple[int, int, bool, int]], picture: int, frame_num: int, idr: bool, long_term: bool, adaptive: bool, operations: list[tuple[int, int, int]], largest: int, max_refs: int) -> tuple[list[tuple[int, int, bool, int]], str | None]:
    """The decoded-picture buffer, (picture, frame_num, long, long_idx) in order of arrival, after a reference picture; and an error, with which the buffer stays as it was.

    An IDR picture empties it; without adaptive marking the oldest short-term pictures go until there is room for one; the operations 1 to 6 of adaptive marking drop short-term (1) or
    long-term (2) pictures, make one long-term (3), bound long-term indexes (4), drop all (5), and make the picture itself long-term (6).
    """
    if idr:
        return [(picture, frame_num, long_term, 0)], None
    out, own = list(held), None

    def drop(test) -> bool:
        place = next((i for i, p in enumerate(out) if test(p)), None)
        if place is not None:
            del out[place]
        return place is not None

    if adaptive:
        for op, first, second in operations:
            number = (frame_num - first - 1) % largest
            if op == 1:
                drop(lambda p, n=number: not p[2] and p[1] == n)
            elif op == 2:
                drop(lambda p, k=first: p[2] and p[3] == k)
            elif op == 3:
                drop(lambda p, k=second: p[2] and p[3] == k)
                place = next((i for i, p in enumerate(out) if not p[2] and p[1] == number), None)
                if place is None:
                    return held, f"no short-term picture {number}"
                out[place] = (*out[place][:2], True, second)
            elif op == 4:
                out = [p for p in out if not p[2] or p[3] < first]
            elif op == 5:
                out = []
            elif op == 6:
                drop(lambda p, k=first: p[2] and p[3] == k)
                own = first
    else:
        while len(out) >= max(1, max_refs):
            if not drop(lambda p: not p[2]):
                return held, "buffer is full of long-term pictures"
    return [*out, (picture, frame_num, own is not None, own or 0)], None


def shown(held: list[tuple[int, int, bool, int]]) -> str:
    """A buffer as text: picture:frame_num, with L and the index for long-term pictures, in order of arrival."""
    return ",".join(f"{p}:{n}" + (f"L{k}" if is_long else "") for p, n, is_long, k in held)


def buffers(pictures: DataFrame, track: str, order: list[str], picture: str, chunk: Column, max_refs: int = 4, largest: int = 16) -> DataFrame:
    """(track, picture, held, error) for each reference picture: the decoded-picture buffer that it is decoded with, and what its marking breaks.

    pictures are rows (track, order columns, picture, frame_num, idr, long_term, adaptive, operations array of structs (operation, first, second)); chunk is a
    column for scan() that never falls along the order. An IDR picture empties the buffer, so what lies from one to the next is a segment that folds alone; an IDR picture closes
    a segment, which says what it is decoded with, and opens the next. Segments of all tracks are dealt out by a hash, and a task folds its own one after another,
    with one buffer in memory however long a segment is. A null flag counts as false, null operations as none; rows of a null track are a track. No rows give none.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    rows = scan(pictures.withColumn("idr", flag("idr")), [track], order, chunk, __segment=prefix(F.col("idr").cast("int")), __at=row_number())
    parts = F.when(F.col("idr"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select(F.col(track).alias("__track"), "__segment", "__at", F.col(picture).cast("bigint").alias("__picture"), F.col("frame_num").cast("bigint").alias("frame_num"), "idr", flag("long_term"), flag("adaptive"), "operations", F.explode(parts).alias("__opens"))
    rows = rows.withColumn("__segment", F.col("__segment") + F.col("__opens"))
    kind = dict(rows.dtypes)["__track"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, held = None, []
        for batch in batches:
            at, seen, errors = [], [], []
            for i, r in enumerate(batch.to_pylist()):
                if segment != (now := (r["__track"], r["__segment"])):
                    segment, held = now, []
                if closes := r["idr"] and not r["__opens"]:
                    error = None
                if not r["__opens"]:
                    at.append(i)
                    seen.append(shown(held))
                if not closes:
                    operations = [(o["operation"], o["first"], o["second"]) for o in r["operations"] or []]
                    held, error = marked(held, r["__picture"], r["frame_num"], r["idr"], r["long_term"], r["adaptive"], operations, largest, max_refs)
                if not r["__opens"]:
                    errors.append(error)
            kept = batch.select(["__track", "__picture"]).take(pa.array(at, pa.int64()))
            yield pa.record_batch({"track": kept.column(0), "picture": kept.column(1), "held": pa.array(seen, pa.string()), "error": pa.array(errors, pa.string())})

    dealt = rows.repartition("__track", "__segment").sortWithinPartitions("__track", "__segment", "__at")
    out = dealt.mapInArrow(run, f"track {kind}, picture bigint, held string, error string")
    return out.select(F.col("track").alias(track), F.col("picture").alias(picture), "held", "error")


def six_tap(samples: DataFrame, track: str, index: str, value: str, taps: tuple[int, ...]) -> DataFrame:
    """samples with sample: the half-way value behind each by a six-tap filter, (sum + 16) >> 5 clipped to a byte.

    Beyond the track's ends the end value is repeated. index counts a track's samples from 0. One exchange: samples are cut into chunks, and the few at a chunk's ends go to
    the neighbouring chunk as well, so that a plain window inside a chunk sees all six and no track needs to be in one task.
    """
    reach = (2, 3)
    chunk = F.floor(F.col(index) / TAP_CHUNK).cast("bigint")
    place = F.col(index) % TAP_CHUNK
    none = F.lit(None).cast("bigint")
    to = F.array(chunk, F.when(place < reach[1], chunk - 1).otherwise(none), F.when(place >= TAP_CHUNK - reach[0], chunk + 1).otherwise(none))
    rows = samples.withColumn("__own", chunk).withColumn("__chunk", F.explode(F.filter(to, lambda c: c.isNotNull() & (c >= 0))))
    w = Window.partitionBy(track, "__chunk").orderBy(index)
    back = [F.lag(value, k).over(w) for k in (2, 1)]
    ahead = [F.lead(value, k).over(w) for k in (1, 2, 3)]
    # beyond an end: the nearest value that is there
    own = F.col(value)
    one_back = F.when(F.lag(index, 1).over(w).isNotNull(), back[1]).otherwise(own)
    two_back = F.when(F.lag(index, 2).over(w).isNotNull(), back[0]).otherwise(one_back)
    one = F.when(F.lead(index, 1).over(w).isNotNull(), ahead[0]).otherwise(own)
    two = F.when(F.lead(index, 2).over(w).isNotNull(), ahead[1]).otherwise(one)
    three = F.when(F.lead(index, 3).over(w).isNotNull(), ahead[2]).otherwise(two)
    total = sum((v * t for v, t in zip((two_back, one_back, own, one, two, three), taps, strict=True)), F.lit(0))
    clipped = F.least(F.greatest(F.shiftright(total.cast("bigint") + 16, 5), F.lit(0)), F.lit(255)).cast("bigint")
    return rows.withColumn("sample", clipped).where(F.col("__own") == F.col("__chunk")).drop("__own", "__chunk")
