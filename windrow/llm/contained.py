"""Candidates among records of very unlike size: the smaller one's stretches are looked up among those of the larger ones.

A pair in which one record has many times the stretches of the other has so low a Jaccard similarity that few of its
signature values agree, so bands aren't enough. But there are few records that are small beside others. Each of these takes
the sample of its stretches below a threshold of the minwise order, the largest power of two that leaves it SAMPLE of them (all
where it has fewer). A bit map of fixed size with all sampled stretches goes to the tasks, which write those stretches of large
records that it has. Of a pair that shares a given part of the small record, at least m - k + 1 of the m sampled
stretches are shared but with probability UNLIKE, so it is enough to look up the k rarest: stretches that very many records
have aren't looked up unless the record has few others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.llm import stretches as st
from windrow.llm.minwise import UNLIKE, least_matches
from windrow.ship import map_arrow, map_groups
from windrow.storage import materialize

#: Stretches of a small record that are looked up at least, if it has so many.
SAMPLE = 48
#: Bits of the bit map, and of one of its parts, as powers of two: it has 8 MB whatever the data.
MAP, PART = 26, 17

_SAMPLES = "tid bigint, side int, size int, kept int, stretch bigint"
_ROWS = "tid bigint, side int, size int, stretch bigint"


def sampled(distinct: np.ndarray) -> np.ndarray:
    """The sample of sorted distinct stretches."""
    if len(distinct) <= SAMPLE:
        return distinct
    limit = 1 << int(distinct[SAMPLE - 1]).bit_length()
    return distinct[: np.searchsorted(distinct, limit)]


def _bit_map(samples: DataFrame) -> np.ndarray:
    """Bytes of the map: a bit for the first MAP bits of each sampled stretch."""

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << PART, np.uint8)
        bits[pdf["slot"].to_numpy() & ((1 << PART) - 1)] = 1
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    slots = samples.select(F.shiftright("stretch", 32 - MAP).alias("slot")).distinct().withColumn("part", F.shiftright("slot", PART))
    out = np.zeros(1 << MAP - 3, np.uint8)
    for row in map_groups(slots, ["part"], part, "part int, bits binary").collect():  # at most 2 ** (MAP - PART) rows
        at = row["part"] << PART - 3
        out[at : at + (1 << PART - 3)] = np.frombuffer(row["bits"], np.uint8)
    return out


def contained_candidates(feats: DataFrame, share: float, ratio: float) -> DataFrame | None:
    """(a, b), a of side 0 and b of side 1: pairs whose sizes differ by ratio or more that may have share of the smaller in common. None if no sizes differ so much."""
    extent = {r["side"]: (r["least"], r["most"]) for r in feats.filter("tid IS NOT NULL").groupBy("side").agg(F.min("size").alias("least"), F.max("size").alias("most")).collect()}
    if len(extent) < 2:
        return None
    small = {side: extent[1 - side][1] / ratio for side in (0, 1)}  # at most so many stretches
    if all(extent[side][0] > small[side] for side in (0, 1)):
        return None
    texts = feats.filter("tid IS NOT NULL").select("tid", "side", "size", "packed")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [sampled(st.distinct(st.unpack(x))) for x in batch.column("packed").to_pylist()]
            number = np.array([len(x) for x in parts], np.int64)
            kept = np.array([n - least_matches(int(n), share, UNLIKE) + 1 for n in number], np.int32)
            keep = [pa.array(np.repeat(batch.column(c).to_numpy(), number)) for c in ("tid", "side", "size")]
            stretch = np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*keep, pa.array(np.repeat(kept, number)), pa.array(stretch)], names=["tid", "side", "size", "kept", "stretch"])

    is_small = F.col("size") <= F.when(F.col("side") == 0, small[0]).otherwise(small[1])
    samples = materialize(map_arrow(texts.filter(is_small), sample, _SAMPLES).distinct(), "samples")
    bits = _bit_map(samples)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 32):
                some = batch.slice(k, 32)
                codes = [st.unpack(x) for x in some.column("packed").to_pylist()]
                found, number = st.record_stretches(np.concatenate(codes), np.cumsum([0, *map(len, codes)]))
                slot = found >> np.uint32(32 - MAP)
                has = (bits[slot >> np.uint32(3)] >> (slot & np.uint32(7)).astype(np.uint8) & 1).astype(bool)
                owner = np.repeat(np.arange(some.num_rows), number)[has]
                keep = [pa.array(some.column(c).to_numpy()[owner]) for c in ("tid", "side", "size")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(found[has].astype(np.int64))], names=["tid", "side", "size", "stretch"])

    is_large = F.col("size") >= F.when(F.col("side") == 0, extent[1][0] * ratio).otherwise(extent[0][0] * ratio)
    larges = materialize(map_arrow(texts.filter(is_large), look_up, _ROWS).distinct(), "larges")
    common = larges.groupBy("stretch", (1 - F.col("side")).alias("side")).agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("tid", "side").orderBy("df", "stretch")
    mine = samples.join(common, ["stretch", "side"], "left").fillna(0, ["df"]).withColumn("nth", F.row_number().over(rarest))
    mine = mine.filter((F.col("nth") <= F.col("kept")) & (F.col("df") > 0)).select("stretch", F.col("tid").alias("small"), "side", F.col("size").alias("small_size"))
    others = larges.select("stretch", F.col("tid").alias("large"), (1 - F.col("side")).alias("side"), F.col("size").alias("large_size"))
    met = mine.join(others, ["stretch", "side"]).filter(F.col("large_size") >= F.col("small_size") * ratio)
    return met.select(F.when(F.col("side") == 0, F.col("small")).otherwise(F.col("large")).alias("a"), F.when(F.col("side") == 0, F.col("large")).otherwise(F.col("small")).alias("b")).distinct()
