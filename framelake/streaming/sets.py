"""Parameter sets in force over a stream of units: one decoder a (track, sample description), each with maps of sets by id.

State is two lists, sequence sets and picture sets by their ids, at most 32 and 256 by the format, whatever the track's length; an initial state
seeds them with the sets of each description's configuration. A sample's units come in one batch and samples in decode order from batch to batch; the sets of
a sample apply before its slices.

A key of a stream has its price a batch, several milliseconds of Python and messages, however few its rows are. Where decoders are many, some share a key, a
bucket, whose state holds the sets of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framelake.operators.parameter_sets import IDR_SLICE, PPS_UNIT, SLICE, SPS_UNIT, Malformed, _set_fields, read_slice_start

OUT = "track string, description bigint, sample_idx bigint, unit_idx bigint, first_mb bigint, pps_id bigint, set_sample bigint, sps_id bigint, sps_sample bigint, init_qp bigint, log2_max_frame_num bigint, error string"
_OUT = [f.split()[0] for f in OUT.split(", ")]
#: Samples before the first one, where the sets of a configuration stand.
SEEDED = -1
#: Decoders that share a key, about, and the fewest keys that they are dealt to.
DECODERS_A_BUCKET, LEAST_BUCKETS = 256, 256
#: Rows that leave a key at once.
BATCH_ROWS = 1 << 16
DECODER = ("track", "description")


def buckets_for(decoders: int) -> int:
    """Keys for so many decoders. A stream that starts again keeps its number of them."""
    return max(LEAST_BUCKETS, -(-decoders // DECODERS_A_BUCKET))


def bucket(buckets: int) -> Column:
    """The key that a decoder's units and seeds go to."""
    return F.pmod(F.xxhash64(*[F.col(c).cast(kind) for c, kind in zip(DECODER, ("string", "bigint"), strict=True)]), F.lit(buckets))


class SetsInForce(StatefulProcessor):
    """The sets are read once and written once for all of a batch's units of a key: a call of the state is a message to another process.

    A key is a decoder, or, if shared, several: rows and the sets of the state then say which one each is of.
    """

    def __init__(self, shared: bool = False):
        self.names = DECODER if shared else ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        of = "track:string,description:bigint," if self.names else ""
        self.held = handle.getValueState("held", f"sequence array<struct<{of}id:bigint,sample:bigint,log2_max_frame_num:bigint>>, picture array<struct<{of}id:bigint,sample:bigint,sps_id:bigint,init_qp:bigint>>")

    def _sets(self) -> tuple[dict[tuple, tuple], dict[tuple, tuple]]:
        """What each set of a decoder and id says, by (*names, id)."""
        held, n = self.held.get(), len(self.names) + 1
        return tuple({tuple(r[:n]): tuple(r[n:]) for r in kind} for kind in held) if held is not None else ({}, {})

    def _keep(self, sequence: dict[tuple, tuple], picture: dict[tuple, tuple]) -> None:
        self.held.update(tuple([(*k, *v) for k, v in kind.items()] for kind in (sequence, picture)))

    def _of(self, batch: pd.DataFrame) -> list[tuple]:
        """The decoder of each row, by names."""
        return list(zip(*[batch[c].tolist() for c in self.names], strict=True)) if self.names else [()] * len(batch)

    @staticmethod
    def _take(sequence: dict[tuple, tuple], picture: dict[tuple, tuple], of: tuple, sample: int, unit: bytes) -> None:
        """Keep a set; a malformed one leaves the one in force."""
        try:
            s = _set_fields(unit)
            if unit[0] & 31 == SPS_UNIT:
                sequence[*of, s["sps_id"]] = sample, s["log2_max_frame_num"]
            else:
                picture[*of, s["pps_id"]] = sample, s["sps_id"], s["init_qp"]
        except Malformed:
            pass

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        sequence, picture = self._sets()
        for of, unit in zip(self._of(initialState), initialState["unit"].tolist(), strict=True):
            self._take(sequence, picture, of, SEEDED, bytes(unit))
        self._keep(sequence, picture)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        units = []
        for batch in rows:
            for of, sample, place, unit in zip(self._of(batch), batch["sample_idx"].tolist(), batch["unit_idx"].tolist(), batch["unit"].tolist(), strict=True):
                kind = unit[0] & 31 if unit else 0
                if kind in (SLICE, IDR_SLICE, SPS_UNIT, PPS_UNIT):
                    units.append((sample, kind in (SLICE, IDR_SLICE), place, of, unit))
        units.sort(key=lambda u: u[:3])  # whatever stands between a decoder's units
        sequence, picture = self._sets()
        out, changed = [], False
        for sample, is_slice, place, of, unit in units:
            if is_slice:
                out.append((*(of or key), sample, place, *self._resolved(sequence, picture, of, unit)))
            else:
                self._take(sequence, picture, of, sample, unit)
                changed = True
        del units
        if changed:
            self._keep(sequence, picture)
        for at in range(0, len(out), BATCH_ROWS):
            yield pd.DataFrame(dict(zip(_OUT, (pd.Series(c, dtype=object) for c in zip(*out[at : at + BATCH_ROWS], strict=True)), strict=True)))

    @staticmethod
    def _resolved(sequence: dict[tuple, tuple], picture: dict[tuple, tuple], of: tuple, unit: bytes) -> tuple:
        try:
            first, _, ident = read_slice_start(unit)
        except Malformed as e:
            return (None,) * 7 + (str(e),)
        if (*of, ident) not in picture:
            return first, ident, None, None, None, None, None, "picture set is missing"
        sample, sps, qp = picture[*of, ident]
        if (*of, sps) not in sequence:
            return first, ident, sample, sps, None, qp, None, "sequence set is missing"
        sps_sample, bits = sequence[*of, sps]
        return first, ident, sample, sps, sps_sample, qp, bits, None

    def close(self) -> None:
        pass


def sets_in_force(stream: DataFrame, seeds: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """(track, description, sample_idx, unit_idx, first_mb, pps_id, set_sample, sps_id, sps_sample, init_qp, log2_max_frame_num, error) for each coded slice of a stream of units.

    stream has rows (track, description, sample_idx, unit_idx, unit), seeds rows (track, description, unit), the sets of the descriptions' configurations. A slice whose
    set is not there, and a malformed one, has an error; malformed sets are passed over; other units, and rows with a null, are left out. Decoders are dealt to so many
    buckets (see buckets_for()), each a key of the state; without a number each decoder is a key of its own.
    """
    whole = lambda df, *cs: df.where(" AND ".join(f"{c} IS NOT NULL" for c in ("track", "description", "unit", *cs))).selectExpr("CAST(track AS STRING) AS track", "CAST(description AS BIGINT) AS description", *[f"CAST({c} AS BIGINT) AS {c}" for c in cs], "unit")
    keyed = lambda df: df.groupBy(*DECODER) if buckets is None else df.withColumn("bucket", bucket(buckets)).groupBy("bucket")
    initial = keyed(whole(seeds).where("length(unit) > 0")) if seeds is not None else None
    return keyed(whole(stream, "sample_idx", "unit_idx")).transformWithStateInPandas(SetsInForce(buckets is not None), OUT, "Append", "None", initial)
