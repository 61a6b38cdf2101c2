"""Integer arithmetic of bitstreams and pixels as column expressions. Division truncates unless said otherwise; >> floors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chroma quantiser for luma quantisers 30 to 51 (below, it is the same).
CHROMA_QP = [29, 30, 31, 32, 32, 33, 34, 34, 35, 35, 36, 36, 37, 37, 37, 38, 38, 38, 39, 39, 39, 39]
# The zig-zag order of a 4x4 block.
ZIGZAG = [0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15]


def signed_golomb(code: str) -> Column:
    """Even codes are negative halves, odd ones positive."""
    return F.expr(f"CASE WHEN {code} % 2 = 0 THEN -({code} div 2) ELSE {code} div 2 + 1 END")


def golomb_bits(value: str) -> Column:
    """Length of the unsigned Exp-Golomb code of value."""
    return F.expr(f"CAST(2 * length(bin({value} + 1)) - 1 AS BIGINT)")


def clip(x: str, low: int | str, high: int | str) -> str:
    return f"least(greatest({x}, {low}), {high})"


def bt601(y: str, cb: str, cr: str) -> dict[str, Column]:
    """Limited-range YCbCr to RGB in fixed point."""
    luma = f"298 * greatest({y} - 16, 0)"
    u, v = f"({cb} - 128)", f"({cr} - 128)"
    terms = {"r": f"409 * {v}", "g": f"-100 * {u} - 208 * {v}", "b": f"516 * {u}"}
    return {k: F.expr(f"CAST({clip(f'shiftright({luma} + {t} + 128, 8)', 0, 255)} AS BIGINT)") for k, t in terms.items()}


def median3(a: str, b: str, c: str) -> Column:
    return F.expr(f"greatest(least({a}, {b}), least(greatest({a}, {b}), {c}))")


def weighted(x: str, weight: str, offset: str, denominator: str) -> Column:
    """Explicit weighted prediction from one list, rounded, clipped to a byte."""
    rounded = f"CASE WHEN {denominator} >= 1 THEN shiftright({x} * {weight} + shiftleft(1L, CAST({denominator} - 1 AS INT)), CAST({denominator} AS INT)) ELSE {x} * {weight} END"
    return F.expr(f"CAST({clip(f'({rounded}) + {offset}', 0, 255)} AS BIGINT)")


def weighted_pair(x0: str, x1: str, w0: str, w1: str, offsets: str, denominator: str) -> Column:
    """Explicit weighted prediction from both lists; offsets is the sum of the two."""
    value = f"shiftright({x0} * {w0} + {x1} * {w1} + shiftleft(1L, CAST({denominator} AS INT)), CAST({denominator} + 1 AS INT)) + shiftright({offsets} + 1, 1)"
    return F.expr(f"CAST({clip(value, 0, 255)} AS BIGINT)")


def implicit_weight(poc0: str, poc1: str, current: str) -> Column:
    """Weight of the second list from picture distances: 32 where they are equal or the scale is out of range."""
    tb, td = clip(f"{current} - {poc0}", -128, 127), clip(f"{poc1} - {poc0}", -128, 127)
    tx = f"((16384 + abs(({td}) div 2)) div nullif({td}, 0))"
    scale = clip(f"shiftright(({tb}) * {tx} + 32, 6)", -1024, 1023)
    w = f"shiftright({scale}, 2)"
    return F.expr(f"CAST(CASE WHEN {poc1} = {poc0} OR {w} < -64 OR {w} > 128 THEN 32 ELSE {w} END AS BIGINT)")


def chroma_qp(luma: str, offset: str) -> Column:
    q = clip(f"{luma} + {offset}", 0, 51)
    listed = ", ".join(map(str, CHROMA_QP))
    return F.expr(f"CAST(CASE WHEN {q} < 30 THEN {q} ELSE element_at(array({listed}), CAST({q} - 29 AS INT)) END AS BIGINT)")


def floor_divmod(a: str, b: int) -> tuple[Column, Column]:
    """Floored quotient and remainder from 0 to b - 1."""
    return F.expr(f"({a} - pmod({a}, {b})) div {b}"), F.expr(f"CAST(pmod({a}, {b}) AS BIGINT)")


def mask_scale(value: str, bits: int, shift: int) -> Column:
    """An 8-bit value scaled to a channel of bits bits at shift."""
    return F.expr(f"CAST(shiftleft({value} * {(1 << bits) - 1} div 255, {shift}) AS BIGINT)")


def align(value: str, unit: int) -> Column:
    return F.expr(f"CAST(({value} + {unit - 1}) div {unit} * {unit} AS BIGINT)")


def context_state(m: str, n: str, qp: str) -> tuple[Column, Column]:
    """(probability state, most probable symbol) of an adaptive context at a quantiser."""
    pre = clip(f"shiftright({m} * {clip(qp, 0, 51)}, 4) + {n}", 1, 126)
    return F.expr(f"CAST(CASE WHEN {pre} <= 63 THEN 63 - {pre} ELSE {pre} - 64 END AS BIGINT)"), F.expr(f"CAST(CASE WHEN {pre} <= 63 THEN 0 ELSE 1 END AS BIGINT)")


def neighbour_total(left: str, top: str) -> Column:
    """Both known: their rounded mean; one: it; none: 0."""
    return F.expr(f"CAST(coalesce(({left} + {top} + 1) div 2, {left}, {top}, 0) AS BIGINT)")


def strength(intra: str, edge: str, coded: str, references_differ: str, motion: str) -> Column:
    """Deblocking strength of an edge: intra 4 at a macroblock edge and 3 inside, coefficients 2, references or motion of 4 quarter samples 1."""
    return F.expr(f"CAST(CASE WHEN {intra} AND {edge} THEN 4 WHEN {intra} THEN 3 WHEN {coded} THEN 2 WHEN {references_differ} OR {motion} >= 4 THEN 1 ELSE 0 END AS BIGINT)")


def strength_b(intra: str, edge: str, coded: str, p: tuple[str, ...], q: tuple[str, ...]) -> Column:
    """strength() of an edge between blocks with motion from two lists; p and q are (reference, x, y) from the first list and then from the second, null where unused."""
    same = lambda a, b: f"({p[3 * a]} <=> {q[3 * b]} AND NOT coalesce(abs({p[3 * a + 1]} - {q[3 * b + 1]}) >= 4 OR abs({p[3 * a + 2]} - {q[3 * b + 2]}) >= 4, false))"
    alike = f"({same(0, 0)} AND {same(1, 1)}) OR ({same(0, 1)} AND {same(1, 0)})"
    return F.expr(f"CAST(CASE WHEN {intra} AND {edge} THEN 4 WHEN {intra} THEN 3 WHEN {coded} THEN 2 WHEN {alike} THEN 0 ELSE 1 END AS BIGINT)")


def bilinear(a: str, b: str, c: str, d: str, fx: str, fy: str) -> Column:
    """A chroma sample between four, at eighths of a sample to the right and down."""
    return F.expr(f"CAST(shiftright((8 - {fx}) * (8 - {fy}) * {a} + {fx} * (8 - {fy}) * {b} + (8 - {fx}) * {fy} * {c} + {fx} * {fy} * {d} + 32, 6) AS BIGINT)")


def predicted_vector(reference: str, neighbours: dict[str, tuple[str, str, str]], shape: str = "16x16", part: int = 0) -> tuple[Column, Column]:
    """The motion vector (x, y) that the neighbours a (left), b (top) and c (top right) predict, each (reference, x, y), null where there is none.

    Halves of a macroblock look at one neighbour first; then the only one with the reference, the only one at all, or the median.
    """
    first = {("16x8", 0): "b", ("16x8", 1): "a", ("8x16", 0): "a", ("8x16", 1): "c"}.get((shape, part))
    refs = {k: v[0] for k, v in neighbours.items()}
    matches = " + ".join(f"CAST({r} <=> {reference} AS INT)" for r in refs.values())
    there = " + ".join(f"CAST({r} IS NOT NULL AS INT)" for r in refs.values())
    out = []
    for axis in (1, 2):
        value = {k: f"coalesce({v[axis]}, 0)" for k, v in neighbours.items()}
        a, b, c = value["a"], value["b"], value["c"]
        only_match = " ".join(f"WHEN {refs[k]} <=> {reference} THEN {value[k]}" for k in refs)
        only = " ".join(f"WHEN {refs[k]} IS NOT NULL THEN {value[k]}" for k in refs)
        direct = f"WHEN {refs[first]} = {reference} THEN {value[first]}" if first else ""
        median = f"greatest(least({a}, {b}), least(greatest({a}, {b}), {c}))"
        out.append(F.expr(f"CAST(CASE {direct} WHEN {matches} = 1 THEN CASE {only_match} END WHEN {there} = 0 THEN 0 WHEN {there} = 1 THEN CASE {only} END ELSE {median} END AS BIGINT)"))
    return out[0], out[1]


def skip_vector(neighbours: dict[str, tuple[str, str, str]]) -> tuple[Column, Column]:
    """The vector of a skipped macroblock: 0 at an edge of the picture and beside a neighbour that stands still, else as predicted from the first reference."""
    still = " OR ".join(f"{r} IS NULL OR {r} <> 0 OR ({x} = 0 AND {y} = 0)" for r, x, y in (neighbours["a"], neighbours["b"]))
    made = predicted_vector("0", neighbours)
    return tuple(F.when(F.expr(still), F.lit(0).cast("bigint")).otherwise(v) for v in made)


def intra_type(slice_type: str, raw: str) -> Column:
    """The intra macroblock type of a coded one, null for inter types and beyond the last."""
    first = f"CASE {slice_type} WHEN 'I' THEN 0 WHEN 'SI' THEN 1 WHEN 'B' THEN 23 ELSE 5 END"
    return F.expr(f"CAST(CASE WHEN {raw} >= {first} AND {raw} - {first} <= 25 THEN {raw} - {first} END AS BIGINT)")


def coded(pattern: str, group: str) -> Column:
    """Whether a group's bit is set in a coded-block pattern."""
    return F.expr(f"(CAST(shiftright({pattern}, CAST({group} AS INT)) AS BIGINT) & 1) = 1")


def least_reference(left: str, top: str) -> Column:
    """The smaller reference of the two neighbours that have one (null: none)."""
    return F.expr(f"CAST(least({left}, {top}) AS BIGINT)")


def increments(left: str, top: str) -> Column:
    """How many of two conditions on neighbours hold; an unknown one does not."""
    return F.expr(f"CAST(CAST(coalesce({left}, false) AS INT) + CAST(coalesce({top}, false) AS INT) AS BIGINT)")


def block_place(index: str) -> tuple[Column, Column]:
    """(x, y) of a 4x4 block in its macroblock, blocks in order of quarters and of their quarters."""
    return F.expr(f"{index} % 2 + {index} div 4 % 2 * 2"), F.expr(f"{index} div 2 % 2 + {index} div 8 * 2")


def raster_place(address: str, width: int) -> tuple[Column, Column]:
    """(x, y) of an address in rows of width."""
    return F.expr(f"{address} % {width}"), F.expr(f"{address} div {width}")


def gradient(place: str, steps: int) -> Column:
    """A byte that rises from 0 to 255 over steps places."""
    return F.expr(f"CAST({place} * 255 div {steps - 1} AS BIGINT)")


def wrapped_qp(before: str, delta: str, first: int = 26) -> Column:
    """A quantiser from the sum of the deltas before and its own, from 0 to 51."""
    return F.expr(f"CAST(pmod({first} + {before} + {delta}, 52) AS BIGINT)")


def temporal_direct(x: str, y: str, reference_poc: str, colocated_poc: str, poc: str, long_term: str) -> Column:
    """Motion of a block in temporal direct mode from its colocated block's vector (x, y), as a struct (x0, y0, x1, y1): scaled by picture distances; as it is, with no second vector, for a long-term reference or one at no distance.

    reference_poc is of the picture that the colocated block refers to, null where that is none (an intra block): no motion.
    """
    td, tb = clip(f"{colocated_poc} - {reference_poc}", -128, 127), clip(f"{poc} - {reference_poc}", -128, 127)
    tx = f"((16384 + abs(({td}) div 2)) div nullif({td}, 0))"
    scale = clip(f"shiftright(({tb}) * {tx} + 32, 6)", -1024, 1023)
    plain = f"{long_term} OR {colocated_poc} = {reference_poc}"
    first = lambda v: f"CASE WHEN {reference_poc} IS NULL THEN 0 WHEN {plain} THEN {v} ELSE shiftright(({scale}) * {v} + 128, 8) END"
    second = lambda v: f"CASE WHEN {reference_poc} IS NULL OR {plain} THEN 0 ELSE shiftright(({scale}) * {v} + 128, 8) - {v} END"
    return F.expr("named_struct(" + ", ".join(f"'{n}{k}', CAST({f(v)} AS BIGINT)" for k, f in ((0, first), (1, second)) for n, v in (("x", x), ("y", y))) + ")")
