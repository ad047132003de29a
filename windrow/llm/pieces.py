"""Problem 3: cut oversized sequences into pieces under a limit, at natural boundaries where possible.

Pointer doubling over successor tables. The boundaries of a record are its ends and the ends of its
scaffold gaps (GAP or more N in a row; within a gap longer than the limit also every limit
bases). Every boundary is joined to its farthest legal successor: the farthest boundary within the
limit, or, where there is none, the farthest one after as few forced cuts as needed, each of
which shares ``overlap`` bases with the piece before. The successor table is then squared again
and again: after k rounds all boundaries within 2**k cuts of the start are known to be cuts. All records of
an Arrow batch are worked on in one table, so the number of rounds is the logarithm of the largest number
of cuts, and nothing is shuffled but the long records themselves, to count repeated rows once.

Defined cases: a base is a letter, everything else is left out and does not count; rows with a null id or a
sequence that is null or within the limit give no pieces; a piece's start and end are the record's
start plus its place in the bases (where start is null, reckoned from end; where both are, null);
rows of one id count once, the one with most bases, then the latest; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.ship import map_arrow

LIMIT, OVERLAP, GAP = 8000, 200, 10
_SCHEMA = "segment_id string, piece int, pieces int, from_base bigint, to_base bigint, start bigint, end bigint, cut string, sequence string"
_ARROW = pa.schema([("segment_id", pa.string()), ("piece", pa.int32()), ("pieces", pa.int32()), ("from_base", pa.int64()), ("to_base", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("cut", pa.string()), ("sequence", pa.string())])


def boundaries(bases: np.ndarray, limit: int = LIMIT, gap: int = GAP) -> np.ndarray:
    """Natural boundaries of one record's bases (upper-case bytes): 0, the edges of gaps, its length."""
    n = np.concatenate([[0], (bases == ord("N")).view(np.int8), [0]])
    edge = np.diff(n)
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    wide = stop - begin >= gap
    begin, stop = begin[wide], stop[wide]
    inner = [np.arange(b, s, limit) for b, s in zip(begin, stop, strict=True) if s - b > limit]
    return np.unique(np.concatenate([[0, len(bases)], begin, stop, *inner]).astype(np.int64))


def greedy_cuts(marks: list[np.ndarray], limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy pieces of many records at once, from the boundaries of each: (record, from, to, forced), in order.

    forced says that the piece ends at a cut that is no boundary.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    if not marks:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    counts = np.array([len(m) for m in marks])
    length = np.array([m[-1] for m in marks])
    far_apart = int(length.max()) + 2 * limit + 2  # places records end to end so that none reaches another
    record = np.repeat(np.arange(len(marks)), counts)
    own = np.concatenate(marks)
    place = own + record * far_apart
    last = np.cumsum(counts) - 1  # index of each record's end
    final = last[record]
    at = np.arange(len(own))
    reach = np.searchsorted(place, place + limit, side="right") - 1
    following = np.minimum(at + 1, final)
    stride = limit - overlap
    short = place[following] - place - limit  # above 0: no boundary within the limit
    forced = np.where(reach > at, 0, np.maximum(0, -(-short // stride)))
    after = place + forced * stride
    successor = np.minimum(np.searchsorted(place, after + limit, side="right") - 1, final)
    successor[last] = last
    # squaring: reached holds the boundaries within 2**k cuts of the start
    reached = np.zeros(len(own), bool)
    reached[np.concatenate([[0], last[:-1] + 1])] = True
    table = successor
    while True:
        more = reached.copy()
        more[table[reached]] = True
        if (more == reached).all():
            break
        reached, table = more, table[table]
    heads = np.flatnonzero(reached & (at != final))
    runs = forced[heads] + 1
    head = np.repeat(heads, runs)
    k = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    begin = own[head] + k * stride
    is_forced = k < np.repeat(forced[heads], runs)
    end = np.where(is_forced, begin + limit, own[successor[head]])
    return record[head], begin, end, is_forced


def split_oversized(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, gap: int = GAP, with_sequence: bool = True) -> DataFrame:
    """The pieces of every record of df(segment_id, start, end, sequence, loaded_at) with more than limit bases.

    cut says how the piece ends: at a gap, forced, or at the record's end.
    """
    bases = F.upper(F.regexp_replace("sequence", r"[^\p{L}]", ""))
    long = df.filter(F.col("segment_id").isNotNull() & (F.length("sequence") > limit))
    long = long.select("segment_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), bases.alias("bases"), "loaded_at")
    long = long.filter(F.length("bases") > limit)
    best = F.max_by(F.struct("start", "end", "bases"), F.struct(F.length("bases"), F.col("loaded_at"), F.col("start"), F.col("end"), F.xxhash64("bases")))
    rows = long.groupBy("segment_id").agg(best.alias("r")).select("segment_id", "r.start", "r.end", "r.bases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = lot.column("bases").to_pylist()
                arrays = [np.frombuffer(t.encode("ascii", "replace"), np.uint8) for t in texts]
                record, begin, end, forced = greedy_cuts([boundaries(a, limit, gap) for a in arrays], limit, overlap)
                pieces = np.bincount(record, minlength=len(texts))
                number = np.arange(len(record)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + 1
                size = np.array([len(a) for a in arrays], np.int64)
                ids, starts, ends = (lot.column(c).to_pylist() for c in ("segment_id", "start", "end"))
                base = [s if s is not None else None if e is None else e - int(n) for s, e, n in zip(starts, ends, size, strict=True)]
                shift = [base[r] for r in record]
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[r] for r in record], pa.string()), pa.array(number, pa.int32()), pa.array(pieces[record], pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()),
                    pa.array([None if s is None else s + int(b) for s, b in zip(shift, begin, strict=True)], pa.int64()), pa.array([None if s is None else s + int(e) for s, e in zip(shift, end, strict=True)], pa.int64()),
                    pa.array(np.where(forced, "forced", np.where(end == size[record], "end", "gap")).tolist(), pa.string()),
                    pa.array([texts[r][b:e] for r, b, e in zip(record, begin, end, strict=True)] if with_sequence else [None] * len(record), pa.string()),
                ], schema=_ARROW)

    return map_arrow(rows, run, _SCHEMA)
