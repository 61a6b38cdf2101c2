"""4x4 blocks and rows of samples as array<bigint> columns: transforms, scans, filters. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.arithmetic import ZIGZAG


def _at(a: Column, i: int) -> Column:
    return a[i]


def zigzag(scan: Column) -> Column:
    """Coefficients in scan order to raster order."""
    place = [ZIGZAG.index(i) for i in range(16)]
    return F.array(*[_at(scan, p) for p in place])


def _butterfly(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
    """The one-dimensional 4-point inverse transform."""
    even0, even1 = a + c, a - c
    odd0, odd1 = F.shiftright(b, 1) - d, b + F.shiftright(d, 1)
    return [even0 + odd1, even1 + odd0, even1 - odd0, even0 - odd1]


def _two_passes(block: Column, step) -> Column:
    """step on rows and then on columns; each pass is an array of its own, so that expressions stay small."""
    rows = F.array(*[x for r in range(4) for x in step(*[_at(block, 4 * r + k) for k in range(4)])])

    def columns(a: Column) -> Column:
        made = [step(*[_at(a, 4 * k + c) for k in range(4)]) for c in range(4)]
        return F.array(*[made[c][r] for r in range(4) for c in range(4)])

    return F.transform(F.array(rows), columns)[0]


def inverse_4x4(block: Column) -> Column:
    """Inverse 4x4 transform of scaled coefficients in raster order, (v + 32) >> 6."""
    return F.transform(_two_passes(block, _butterfly), lambda v: F.shiftright(v + 32, 6))


def hadamard_4x4(block: Column) -> Column:
    def step(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
        return [a + b + c + d, a + b - c - d, a - b - c + d, a - b + c - d]

    return _two_passes(block, step)


def strong_edge(p: Column) -> Column:
    """The strongest luma deblocking of eight samples across an edge (p3 p2 p1 p0 | q0 q1 q2 q3), where both sides are smooth."""
    p3, p2, p1, p0, q0, q1, q2, q3 = [_at(p, i) for i in range(8)]
    sh = F.shiftright
    return F.array(p3, sh(2 * p3 + 3 * p2 + p1 + p0 + q0 + 4, 3), sh(p2 + p1 + p0 + q0 + 2, 2), sh(p2 + 2 * p1 + 2 * p0 + 2 * q0 + q1 + 4, 3), sh(p1 + 2 * p0 + 2 * q0 + 2 * q1 + q2 + 4, 3), sh(p0 + q0 + q1 + q2 + 2, 2), sh(2 * q3 + 3 * q2 + q1 + q0 + p0 + 4, 3), q3)


def quantised(vector: Column, scale: int) -> Column:
    """Floats to integers by floor(x * scale)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def joined(a: Column) -> Column:
    return F.array_join(a.cast("array<string>"), ",")


# Scales of coefficients by quantiser modulo 6, for places with both coordinates even, one odd, both odd.
LEVEL_SCALES = [(10, 13, 16), (11, 14, 18), (13, 16, 20), (14, 18, 23), (16, 20, 25), (18, 23, 29)]
# Edge filter thresholds and clipping bounds by index; the indexes before the first are 0.
ALPHA = [4, 4, 5, 6, 7, 8, 9, 10, 12, 13, 15, 17, 20, 22, 25, 28, 32, 36, 40, 45, 50, 56, 63, 71, 80, 90, 101, 113, 127, 144, 162, 182, 203, 226, 255, 255]
BETA = [2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13, 14, 14, 15, 15, 16, 16, 17, 17, 18, 18]
TC0 = [
    [0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4, 4, 5, 6, 6, 7, 8, 9, 10, 11, 13],
    [0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4, 5, 5, 6, 7, 8, 8, 10, 11, 12, 13, 15, 17],
    [0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4, 4, 5, 6, 6, 7, 8, 9, 10, 11, 13, 14, 16, 18, 20, 23, 25],
]
FIRST_INDEX = 16


def _category(place: int) -> int:
    return place // 4 % 2 + place % 2


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def _shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x, F.greatest(by, F.lit(0)).cast("int"))


def dequantised(raster: Column, qp: Column) -> Column:
    """Coefficients in raster order scaled by their place and the quantiser (0 to 87; null beyond)."""
    scales = F.array(*[_longs([s[_category(p)] for p in range(16)]) for s in LEVEL_SCALES])
    scaled = F.zip_with(raster, scales[(qp % 6).cast("int")], lambda c, s: _shift(c * s, F.floor(qp / 6)))
    return F.when(qp.between(0, 87), scaled)


def luma_dc(raster: Column, qp: Column) -> Column:
    """The inverse transform of a macroblock's sixteen DC coefficients, scaled."""
    scale, q = _longs([s[0] for s in LEVEL_SCALES])[(qp % 6).cast("int")], F.floor(qp / 6).cast("int")
    low = lambda v: F.call_function("shiftright", v * scale + F.call_function("shiftleft", F.lit(1).cast("bigint"), 1 - q), 2 - q)
    return F.when(qp.between(0, 87), F.transform(hadamard_4x4(raster), lambda v: F.when(q >= 2, _shift(v * scale, q - 2)).otherwise(low(v))))


def chroma_dc(c: Column, qp: Column) -> Column:
    """The 2x2 inverse transform of four chroma DC coefficients, scaled."""
    scale, q = _longs([s[0] for s in LEVEL_SCALES])[(qp % 6).cast("int")], F.floor(qp / 6)
    c0, c1, c2, c3 = [_at(c, i) for i in range(4)]
    made = F.array(c0 + c1 + c2 + c3, c0 - c1 + c2 - c3, c0 + c1 - c2 - c3, c0 - c1 - c2 + c3)
    return F.when(qp.between(0, 87), F.transform(made, lambda v: F.when(q >= 1, _shift(v * scale, q - 1)).otherwise(F.shiftright(v * scale, 1))))


def intra_dc(top: Column, left: Column, n: int = 4) -> Column:
    """The rounded mean of the n samples of each known side (null: unknown), 128 without any."""
    total = lambda a: F.coalesce(F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x), F.lit(0))
    known = F.when(top.isNotNull(), n).otherwise(0) + F.when(left.isNotNull(), n).otherwise(0)
    return F.when(known == 0, F.lit(128)).otherwise(F.floor((total(top) + total(left) + known / 2) / known)).cast("bigint")


def intra_4x4(mode: int, top: Column, left: Column, corner: Column) -> Column:
    """A predicted 4x4 block in raster order. top has 8 samples, left 4; what a mode needs and lacks gives null.

    The border is one line from left's lower end by the corner to top's right end, e[0] to e[12]; modes are means of two or three neighbours on it.
    """
    e = [*[_at(left, 3 - i) for i in range(4)], corner, *[_at(top, i) for i in range(8)]]
    if mode == 2:
        first = F.when(top.isNotNull(), F.slice(top, 1, 4))
        return F.array_repeat(intra_dc(first, left), 16)
    two = lambda i: F.shiftright(e[i] + e[i + 1] + 1, 1)
    three = lambda i: F.shiftright(e[max(0, i - 1)] + 2 * e[i] + e[min(12, i + 1)] + 2, 2)

    def sample(x: int, y: int) -> Column:
        if mode == 0:
            return e[5 + x]
        if mode == 1:
            return e[3 - y]
        if mode == 3:
            return three(6 + x + y)
        if mode == 4:
            return three(4 + x - y)
        if mode in (5, 6):  # the second is the first mirrored about the corner
            a, b = (x, y) if mode == 5 else (y, x)
            z, at = 2 * a - b, 4 + a - b // 2
            at, pair, turn = (at, at, 1) if mode == 5 else (8 - at, 7 - at, -1)
            if z >= 0:
                return two(pair) if z % 2 == 0 else three(at)
            return three(4) if z == -1 else three(4 + turn * (1 - b))
        if mode == 7:
            z = 5 + x + y // 2
            return two(z) if y % 2 == 0 else three(z + 1)
        z, at = x + 2 * y, 3 - y - x // 2
        if z > 5:
            return e[0]
        return three(0) if z == 5 else two(at - 1) if z % 2 == 0 else three(at - 1)

    made = F.array(*[sample(x, y) for y in range(4) for x in range(4)])
    return F.when(~F.exists(made, lambda v: v.isNull()), made)


def reconstructed(predicted: Column, residual: Column) -> Column:
    """Prediction and residual, clipped to bytes."""
    return F.zip_with(predicted, residual, lambda p, r: F.least(F.greatest(p + r, F.lit(0)), F.lit(255)))


def edge_filtered(p: Column, qp: Column, alpha_offset: Column, beta_offset: Column, strength: Column, chroma: bool = False) -> Column:
    """Eight samples across an edge (p3 p2 p1 p0 | q0 q1 q2 q3) deblocked at a strength of 0 to 4."""
    p3, p2, p1, p0, q0, q1, q2, q3 = [_at(p, i) for i in range(8)]
    index = lambda offset: F.least(F.greatest(qp + offset, F.lit(0)), F.lit(51)).cast("int") - FIRST_INDEX
    look = lambda values, i: F.coalesce(F.get(_longs(values), i), F.lit(0).cast("bigint"))
    alpha, beta = look(ALPHA, index(alpha_offset)), look(BETA, index(beta_offset))
    tc0 = look(TC0[0], index(alpha_offset))
    for k in (1, 2):
        tc0 = F.when(strength == k + 1, look(TC0[k], index(alpha_offset))).otherwise(tc0)
    active = (strength > 0) & (F.abs(p0 - q0) < alpha) & (F.abs(p1 - p0) < beta) & (F.abs(q1 - q0) < beta)
    sh, byte = F.shiftright, lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(255))
    bound = lambda v, c: F.least(F.greatest(v, -c), c)
    near_p, near_q = (F.lit(False), F.lit(False)) if chroma else (F.abs(p2 - p0) < beta, F.abs(q2 - q0) < beta)
    tc = tc0 + 1 if chroma else tc0 + near_p.cast("bigint") + near_q.cast("bigint")
    delta = bound(sh(4 * (q0 - p0) + (p1 - q1) + 4, 3), tc)
    middle = sh(p0 + q0 + 1, 1)
    weak = [p3, p2, F.when(near_p, byte(p1 + bound(sh(p2 + middle - 2 * p1, 1), tc0))).otherwise(p1), byte(p0 + delta), byte(q0 - delta), F.when(near_q, byte(q1 + bound(sh(q2 + middle - 2 * q1, 1), tc0))).otherwise(q1), q2, q3]
    smooth = F.abs(p0 - q0) < sh(alpha, 2) + 2
    strong = [_at(strong_edge(p), i) for i in range(8)]
    plain = [p3, p2, p1, sh(2 * p1 + p0 + q1 + 2, 2), sh(2 * q1 + q0 + p1 + 2, 2), q1, q2, q3]
    full = [F.when(smooth & (near_p if i < 4 else near_q), strong[i]).otherwise(plain[i]) for i in range(8)]
    return F.array(*[F.when(~active, _at(p, i)).when(strength < 4, weak[i]).otherwise(full[i]) for i in range(8)])


def countable(a: Column) -> Column:
    """Whether any value is not 0."""
    return F.exists(a, lambda v: v != 0)


def inverse_map(values: Column) -> Column:
    """The index of each value from 0 to the length less 1 in a permutation."""
    return F.transform(values, lambda _, i: F.array_position(values, i.cast("bigint")) - 1)


# The taps of half-sample interpolation.
TAPS = (1, -5, 20, 20, -5, 1)


def _tapped(values: list[Column]) -> Column:
    out = values[0] * TAPS[0]
    for v, w in zip(values[1:], TAPS[1:], strict=True):
        out = out + v * w
    return out


def _byte(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0)), F.lit(255))


def half_samples(window: Column) -> dict[str, Column]:
    """Samples around the middle of a 6x6 window in raster order: full (the sample itself), right and below (half a sample on), centre (half on in both, from unrounded sums), and quarter between full and right."""
    at = lambda r, c: _at(window, 6 * r + c)
    right = _byte(F.shiftright(_tapped([at(2, c) for c in range(6)]) + 16, 5))
    below = _byte(F.shiftright(_tapped([at(r, 2) for r in range(6)]) + 16, 5))
    rows = F.array(*[_tapped([at(r, c) for c in range(6)]) for r in range(6)])
    centre = F.transform(F.array(rows), lambda x: _byte(F.shiftright(_tapped([x[k] for k in range(6)]) + 512, 10)))[0]
    return {"full": at(2, 2), "right": right, "below": below, "centre": centre, "quarter": F.shiftright(at(2, 2) + right + 1, 1)}


def quarter_samples(window: Column) -> Column:
    """The 16 samples at quarter steps from the middle of a 6x6 window in raster order, as an array: four across for each of four steps down, the first the sample itself.

    Half samples make a grid of two steps; what is between two of its points, across or down, is their rounded mean, and what is between four is the rounded mean of the nearest
    two that are half steps in one direction only.
    """
    at = lambda r, c: _at(window, 6 * r + c)
    rows = F.array(*[_tapped([at(r, c) for c in range(6)]) for r in range(6)])
    fixed = {(x, y): at(2 + y // 4, 2 + x // 4) for x in (0, 4) for y in (0, 4)}
    fixed |= {(x, 2): _byte(F.shiftright(_tapped([at(r, 2 + x // 4) for r in range(6)]) + 16, 5)) for x in (0, 4)}

    def sample(x: int, y: int, point: dict[tuple[int, int], Column]) -> Column:
        if x % 2 == 0 and y % 2 == 0:
            return point[x, y]
        if x % 2 and y % 2:
            a, b = point[2, 0 if y < 2 else 4], point[0 if x < 2 else 4, 2]
        elif x % 2:
            a, b = point[x - 1, y], point[x + 1, y]
        else:
            a, b = point[x, y - 1], point[x, y + 1]
        return F.shiftright(a + b + 1, 1)

    # row sums are used twice, so a lambda names them
    def made(sums: Column) -> Column:
        point = fixed | {(2, y): _byte(F.shiftright(sums[2 + y // 4] + 16, 5)) for y in (0, 4)}
        point[2, 2] = _byte(F.shiftright(_tapped([sums[k] for k in range(6)]) + 512, 10))
        return F.array(*[sample(x, y, point).cast("bigint") for y in range(4) for x in range(4)])

    return F.transform(F.array(rows), made)[0]


def intra_plane(top: Column, left: Column, corner: Column, size: int) -> Column:
    """A predicted square of 16 luma or 8 chroma samples in raster order: the plane that the border's slopes give; null where a side or the corner is missing."""
    half, factor = size // 2, {16: 5, 8: 34}[size]

    def slope(side: Column) -> Column:
        before = lambda i: _at(side, half - 1 - i) if i < half else corner
        total = F.lit(0).cast("bigint")
        for i in range(1, half + 1):
            total = total + i * (_at(side, half - 1 + i) - before(i))
        return F.shiftright(factor * total + 32, 6)

    base = 16 * (_at(top, size - 1) + _at(left, size - 1)) + 16
    terms = F.array(F.struct(base.alias("a"), slope(top).alias("b"), slope(left).alias("c")))
    places = F.sequence(F.lit(0), F.lit(size * size - 1))
    made = F.transform(terms, lambda t: F.transform(places, lambda i: _byte(F.shiftright(t["a"] + t["b"] * (i % size - (half - 1)) + t["c"] * (F.floor(i / size) - (half - 1)), 5)).cast("bigint")))[0]
    return F.when(top.isNotNull() & left.isNotNull() & corner.isNotNull(), made)


def intra_square(mode: int, top: Column, left: Column, corner: Column, size: int = 16) -> Column:
    """A predicted square of luma (16) or chroma (8) in raster order by its mode: down, across, mean or plane; null where what the mode needs is missing.

    Modes count 0 down, 1 across, 2 mean, 3 plane for luma and 0 mean, 1 across, 2 down, 3 plane for chroma, whose mean is taken quarter by quarter.
    """
    places = F.sequence(F.lit(0), F.lit(size * size - 1))
    kind = ("down", "across", "mean", "plane")[mode] if size == 16 else ("mean", "across", "down", "plane")[mode]
    if kind == "down":
        return F.when(top.isNotNull(), F.transform(places, lambda i: F.get(top, i % size)))
    if kind == "across":
        return F.when(left.isNotNull(), F.transform(places, lambda i: F.get(left, F.floor(i / size).cast("int"))))
    if kind == "plane":
        return intra_plane(top, left, corner, size)
    if size == 16:
        return F.array_repeat(intra_dc(top, left, 16), 256)
    part = lambda side, k: F.when(side.isNotNull(), F.slice(side, 1 + 4 * k, 4))
    none = F.lit(None).cast("array<bigint>")
    # a quarter beside one border only takes that one where it is there
    means = [intra_dc(part(top, 0), part(left, 0)), intra_dc(part(top, 1), F.when(top.isNull(), part(left, 0)).otherwise(none)), intra_dc(F.when(left.isNull(), part(top, 0)).otherwise(none), part(left, 1)), intra_dc(part(top, 1), part(left, 1))]
    return F.transform(F.array(F.array(*means)), lambda m: F.transform(places, lambda i: F.get(m, (F.floor(i / 32) * 2 + F.floor(i % 8 / 4)).cast("int"))))[0]


# What the halves of B macroblock types from 4 on use, a pair for two types (16x8 and 8x16): 0 the first list, 1 the second, 2 both;
# and width, height and lists of the parts of their quarters' types, the first of which is direct.
B_HALVES = ((0, 0), (1, 1), (0, 1), (1, 0), (0, 2), (1, 2), (2, 0), (2, 1), (2, 2))
B_QUARTERS = ((8, 8, 3), (8, 8, 0), (8, 8, 1), (8, 8, 2), (8, 4, 0), (4, 8, 0), (8, 4, 1), (4, 8, 1), (8, 4, 2), (4, 8, 2), (4, 4, 0), (4, 4, 1), (4, 4, 2))


def _with_lists(parts: Column, lists: list[int]) -> Column:
    """Partitions with which lists each uses (0, 1, 2 both, 3 direct), taken in turn."""
    kinds = F.array(*[F.lit(k) for k in lists])
    kind = lambda i: F.get(kinds, (i % len(lists)).cast("int"))
    return F.transform(parts, lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["width"].alias("width"), p["height"].alias("height"), kind(i).isin(0, 2).alias("list0"), kind(i).isin(1, 2).alias("list1"), (kind(i) == 3).alias("direct")))


def bi_partitions(raw: Column, sub_types: Column) -> Column:
    """The motion partitions of a B macroblock type (0 direct, 1 to 3 whole, 4 to 21 halves, 22 quarters by their sub_types), with the lists that each uses. Null for others."""

    def quarter(i: int) -> Column:
        made, x, y = F.lit(None), F.lit(i % 2 * 8), F.lit(i // 2 * 8)
        for k, (w, h, lists) in enumerate(B_QUARTERS):
            made = F.when(_at(sub_types, i) == k, _with_lists(partitions(w, h, x, y, 8), [lists])).otherwise(made)
        return made

    out = F.when(raw == 22, F.concat(*[quarter(i) for i in range(4)]))
    for k, lists in enumerate((3, 0, 1, 2)):
        out = F.when(raw == k, _with_lists(partitions(16, 16), [lists])).otherwise(out)
    for k, lists in enumerate(B_HALVES):
        for n, shape in enumerate(((16, 8), (8, 16))):
            out = F.when(raw == 4 + 2 * k + n, _with_lists(partitions(*shape), list(lists))).otherwise(out)
    return out


def partitions(width: int, height: int, x: Column | None = None, y: Column | None = None, size: int = 16) -> Column:
    """The parts of a square of size samples at (x, y), width by height each, in decoding order, as an array of structs (x, y, width, height)."""
    x, y = (F.lit(0) if v is None else v for v in (x, y))
    value = lambda v: F.lit(v).cast("bigint")
    return F.array(*[F.struct((x + i).cast("bigint").alias("x"), (y + j).cast("bigint").alias("y"), value(width).alias("width"), value(height).alias("height")) for j in range(0, size, height) for i in range(0, size, width)])


def inter_partitions(raw: Column, sub_types: Column) -> Column:
    """The motion partitions of a P macroblock type (0 to 4); sub_types has one for each quarter of types 3 and 4. Null for others.

    Types: whole, two halves above each other, two beside each other, quarters; of quarters: whole, two above each other, two beside each other, four.
    """
    halves = [partitions(16, 16), partitions(16, 8), partitions(8, 16)]
    shapes = [(8, 8), (8, 4), (4, 8), (4, 4)]

    def quarter(i: int) -> Column:
        made, x, y = F.lit(None), F.lit(i % 2 * 8), F.lit(i // 2 * 8)
        for k, (w, h) in enumerate(shapes):
            made = F.when(_at(sub_types, i) == k, partitions(w, h, x, y, 8)).otherwise(made)
        return made

    out = F.when(raw.isin(3, 4), F.concat(*[quarter(i) for i in range(4)]))
    for k, made in enumerate(halves):
        out = F.when(raw == k, made).otherwise(out)
    return out


def nonzero(a: Column) -> Column:
    """How many values are not 0."""
    return F.size(F.filter(a, lambda v: v != 0)).cast("bigint")


def checksum(a: Column) -> Column:
    """The sum of all values."""
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, v: s + v)
