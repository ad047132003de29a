"""Problem 8: mix sources to target weights, repeating a text at most a capped number of times.

Pivotal dependent rounding. Each text of a source is to be used c times, c the source's target tokens over its
tokens, at most its cap. The whole part of c is used in any case; the fraction is a probability. Within
small random groups of a source, in order of size, two fractions at a time meet: mass (tokens) moves from
one to the other at random until one of them is 0 or 1. Each group leaves at most one fraction, and these
meet in groups of FAN up a tree until one is left. That one is 0, and of the texts not used so far the one whose size is nearest to the
tokens still missing is used instead (or none). So the tokens used are those wanted to within about half the distance of two sizes, each text keeps its
probability but for this last one, and no task sees more than a bounded number of rows. The result depends on the rows and the seed alone, not on how they are parted.

Defined cases: sources are compared trimmed and in lower case; texts of sources without a target are not used but
count in the total; null and empty texts have no tokens and are not used; a source without tokens reaches nothing; repeated
rows of targets count once (the greatest weight); a cap that is null is 1; an empty table gives no copies.
"""

from __future__ import annotations

import random
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.tables import tidy
from windrow.llm.tokens import VOCABULARY, token_sizes
from windrow.ship import map_groups
from windrow.storage import materialize

#: Texts per group at the first level, and fractions per group at the others.
LEAF, FAN = 4096, 4096


def pivot(fractions: list[float], sizes: list[float], rng: random.Random) -> tuple[list[float], int | None]:
    """Fractions with all but at most one made 0 or 1; and the place of the one that is not.

    The sum of fraction times size is kept, and so is each fraction's expectation. Sizes are positive.
    """
    out = list(fractions)
    open_at = None

    def settled(i: int) -> bool:
        if out[i] <= 1e-9 or out[i] >= 1 - 1e-9:
            out[i] = float(round(out[i]))
            return True
        return False

    for j in range(len(out)):
        if settled(j):
            continue
        if open_at is None:
            open_at = j
            continue
        i = open_at
        up = min((1 - out[i]) * sizes[i], out[j] * sizes[j])  # mass that can move to i
        down = min((1 - out[j]) * sizes[j], out[i] * sizes[i])  # mass that can move to j
        move = up if rng.random() * (up + down) < down else -down
        out[i] += move / sizes[i]
        out[j] -= move / sizes[j]
        between = [k for k in (i, j) if not settled(k)]  # one of them at most
        open_at = between[0] if between else None
    return out, open_at


_STATE = "id bigint, row bigint, tokens bigint, source string, whole int, fraction double, bucket bigint"


def _meet(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "id", "row"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        rng = random.Random(zlib.crc32(f"{seed}|{pdf['source'].iloc[0]}|{pdf['bucket'].iloc[0]}".encode()))
        pdf["fraction"], _ = pivot(pdf["fraction"].tolist(), pdf["tokens"].tolist(), rng)
        return pdf[["id", "row", "tokens", "source", "whole", "fraction", "bucket"]]

    return run


def mix_sources(df: DataFrame, targets: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, tokens, copies), copies > 0, and the report per row of targets(source, weight, max_repeats)."""
    sizes = materialize(token_sizes(df, id_col, text_col, source_col, vocabulary).withColumn("source", tidy("source")), "tokens")
    own = sizes.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("texts"))
    goal = targets.select(tidy("source").alias("source"), F.col("source").alias("written"), F.col("weight").cast("double").alias("weight"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("max_repeats"))
    goal = goal.filter("source IS NOT NULL AND weight IS NOT NULL").groupBy("source").agg(F.max_by(F.struct("written", "weight", "max_repeats"), "weight").alias("g")).select("source", "g.*")
    total = own.agg(F.coalesce(F.sum("source_tokens"), F.lit(0)).alias("t")).first()[0]
    stats = goal.join(own, "source", "left").fillna(0, ["source_tokens", "texts"]).withColumn("target_tokens", F.col("weight") * F.lit(float(total)))
    stats = stats.withColumn("short", F.col("target_tokens") > F.col("max_repeats") * F.col("source_tokens"))
    copies = F.least(F.col("target_tokens") / F.col("source_tokens"), F.col("max_repeats").cast("double"))
    stats = stats.withColumn("copies_each", F.when(F.col("source_tokens") > 0, copies).otherwise(0.0))
    stats = materialize(stats, "stats")
    largest = stats.agg(F.max("texts")).first()[0] or 0
    groups = max(1, -(-largest // LEAF))
    # rows alike in all that counts are numbered, so that nothing hangs on their place
    rows = sizes.filter("tokens > 0").groupBy("id", "source", "tokens").agg(F.count("*").alias("n")).withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "n"))).drop("n")
    rows = rows.join(stats.select("source", "copies_each"), "source")
    rows = rows.withColumn("whole", F.floor("copies_each").cast("int")).withColumn("fraction", F.col("copies_each") - F.floor("copies_each"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "id", "tokens", "row"), F.lit(groups)))
    state = materialize(map_groups(rows.select("id", "row", "tokens", "source", "whole", "fraction", "bucket"), ["source", "bucket"], _meet(seed), _STATE), "rounded")
    between = (F.col("fraction") > 0) & (F.col("fraction") < 1)
    settled = [state.filter(~between)]
    level = 0
    while groups > 1:
        level += 1
        up = state.filter(between).withColumn("bucket", F.floor(F.col("bucket") / F.lit(FAN)))
        state = materialize(map_groups(up, ["source", "bucket"], _meet(seed + level), _STATE), "rounded")
        settled.append(state.filter(~between))
        groups = -(-groups // FAN)
    last = state.filter(between)  # one a source at most
    done = last.withColumn("fraction", F.lit(0.0))
    for part in settled:
        done = done.unionByName(part)
    missing = last.select("source", (F.col("fraction") * F.col("tokens")).alias("missing"))
    spare = done.filter("fraction = 0").join(missing, "source").withColumn("off", F.abs(F.col("tokens") - F.col("missing")))
    nearest = spare.groupBy("source", "missing").agg(F.min(F.struct("off", "id", "row", "tokens")).alias("x")).filter("x.off < missing")
    nearest = nearest.select("source", "x.id", "x.row", "x.tokens", F.lit(1.0).alias("more"))
    done = done.join(nearest, ["source", "id", "row", "tokens"], "left").withColumn("fraction", F.coalesce("more", "fraction"))
    mix = done.select(F.col("id").alias(id_col), "source", "tokens", (F.col("whole") + F.col("fraction").cast("int")).alias("copies")).filter("copies > 0")
    mix = materialize(mix, "mix")
    got = mix.groupBy("source").agg(F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    report = stats.join(got, "source", "left").fillna(0, ["copies", "mixed_tokens", "most_copies"])
    all_mixed = got.agg(F.coalesce(F.sum("mixed_tokens"), F.lit(0))).first()[0]
    report = report.select(
        F.col("written").alias("source"), "weight", "max_repeats", "texts", "source_tokens", "target_tokens", "short", "copies", "most_copies", "mixed_tokens",
        (F.col("mixed_tokens") / F.lit(float(total or 1))).alias("share_of_total"), (F.col("mixed_tokens") / F.lit(float(all_mixed or 1))).alias("share_reached"),
    )
    return mix, report
