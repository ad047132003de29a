"""Problem 7: place texts in containers of fixed capacity with as little room left as possible.

Pattern packing by non-negative least squares. Texts larger than a container are divided; their
full parts are containers of their own. All other lengths form a histogram, which the capacity
bounds however many texts there are. Patterns of few texts (one or two length classes, up to MAX_TEXTS
texts) that fill a container are enumerated, their repeat counts are fitted to the histogram
by non-negative least squares, rounded down, and what is left is packed best-fit into the room
left and into new containers. The plan is in runs: texts of one length with neighbouring ranks go to
neighbouring containers, so a text finds its container by its length and its rank among
the texts of that length, which is counted in salted groups.

Defined cases: a text is divided only if it is larger than a container; null and empty texts have no tokens and
are placed in no container; each row is an item, also where ids repeat; an empty table gives empty results.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.llm.tokens import VOCABULARY, token_sizes
from windrow.ship import map_groups
from windrow.storage import materialize

CAPACITY = 3072
#: Length classes of the fit, and most texts in a pattern.
CLASSES, MAX_TEXTS = 384, 16
#: Texts up to this part of the capacity are in no pattern: they fill the room that patterns leave.
SHORT = 48
#: Texts per salted group when ranks are counted, and ranks per block when they are looked up.
SALTED, RANKS = 1 << 17, 1 << 12


def patterns(classes: np.ndarray, units: int, most: int = MAX_TEXTS) -> list[tuple[tuple[int, int], ...]]:
    """Multisets of one or two of the classes (lengths in units) that fill units exactly: ((class, times), ...)."""
    there = set(classes.tolist())
    out = set()
    for a in classes.tolist():
        for i in range(1, min(most, units // a) + 1):
            rest = units - i * a
            if rest == 0:
                out.add(((a, i),))
                continue
            for j in range(1, most - i + 1):
                if rest % j == 0 and (b := rest // j) in there and b != a:
                    out.add(tuple(sorted(((a, i), (b, j)))))
    return sorted(out)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    m, n = a.shape
    x, active = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds or 3 * m):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        if not len(w) or w.max() <= 1e-9 * scale:
            break
        active[int(np.argmax(w))] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 1e-12 * scale).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 1e-12 * scale
            gap = x[at][low] - s[low]
            step = np.min(np.where(gap > 0, x[at][low] / np.where(gap > 0, gap, 1), 0))
            x[at] += step * (s - x[at])
            off = at[x[at] <= 1e-12 * scale]
            x[off] = 0
            active[off] = False
            if not active.any():
                break
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Runs (length, first rank, texts, first container): text first+k of that length goes to container first+k."""
    unit = max(1, -(-capacity // CLASSES))
    units = capacity // unit
    left = {n: c for n, c in histogram.items() if c > 0}
    used = dict.fromkeys(left, 0)
    queues: dict[int, list[int]] = {}
    for n in sorted(left, reverse=True):
        queues.setdefault(-(-n // unit), []).append(n)
    have = {k: sum(left[n] for n in ns) for k, ns in queues.items()}
    runs: list[tuple[int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left: [(first container, how many)]
    next_container = 0

    def take(k: int, want: int) -> list[tuple[int, int, int]]:
        """(length, first rank, texts) from a class, want in all."""
        got = []
        for n in queues[k]:
            c = min(want, left[n])
            if c:
                got.append((n, used[n], c))
                left[n] -= c
                used[n] += c
                want -= c
        have[k] -= sum(c for _, _, c in got)
        return got

    classes = np.array(sorted(k for k in have if capacity // SHORT < k * unit <= units * unit), np.int64)
    possible = patterns(classes, units) if len(classes) else []
    if possible:
        row = {k: i for i, k in enumerate(classes.tolist())}
        a = np.zeros((len(classes), len(possible)))
        for p, pattern in enumerate(possible):
            for k, times in pattern:
                a[row[k], p] = times
        # what is left over should be short: long classes weigh more
        weight = classes / units
        x = nnls(a * weight[:, None], np.array([have[k] for k in classes.tolist()]) * weight)
        for p in np.argsort(-x, kind="stable"):
            repeats = min([int(x[p] + 1e-9), *(have[k] // times for k, times in possible[p])])
            if repeats < 1:
                continue
            groups = [(next_container, repeats, capacity)]
            next_container += repeats
            for k, times in possible[p]:
                for _ in range(times):
                    got, parted = take(k, repeats), []
                    for first, count, room in groups:
                        while count:
                            n, rank, c = got[0]
                            m = min(c, count)
                            runs.append((n, rank, m, first))
                            parted.append((first, m, room - n))
                            first, count = first + m, count - m
                            got[0] = (n, rank + m, c - m)
                            if c == m:
                                got.pop(0)
                    groups = parted
            for first, count, room in groups:
                if room:
                    rooms.setdefault(room, []).append((first, count))
    open_rooms = sorted(rooms)

    def put_room(room: int, first: int, count: int) -> None:
        if room <= 0:
            return
        if room not in rooms:
            rooms[room] = []
            insort(open_rooms, room)
        rooms[room].append((first, count))

    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            i = bisect_left(open_rooms, n)
            if i == len(open_rooms):
                count = -(-left[n] // (capacity // n))
                put_room(capacity, next_container, count)
                next_container += count
                continue
            room = open_rooms[i]
            first, count = rooms[room].pop()
            m = min(count, left[n])
            runs.append((n, used[n], m, first))
            if m < count:
                rooms[room].append((first + m, count - m))
            if not rooms[room]:
                del rooms[room]
                open_rooms.pop(i)
            put_room(room - n, first, m)
            used[n] += m
            left[n] -= m
    return runs


def _planned(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = plan(dict(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True)), capacity)
        return pd.DataFrame(runs, columns=["size", "first", "texts", "container"])

    return run


def _ranked(items: DataFrame, total: int) -> DataFrame:
    """items with rank: their number, from 0, among those of their size. Counted in salted groups."""
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("id", "token_from"), F.lit(max(1, -(-total // SALTED)))))
    counts = salted.groupBy("size", "_salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("size", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("size", "_salt").orderBy("id", "token_from"))
    return salted.withColumn("_own", own).join(counts, ["size", "_salt"]).withColumn("rank", F.col("_before") + F.col("_own") - 1).drop("_salt", "_own", "_before")


def pack(df: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, pieces, token_from, token_to, container): where every text's tokens lie.

    container is a string; null for texts without tokens.
    """
    sizes = materialize(token_sizes(df, id_col, text_col, source_col, vocabulary), "tokens")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(capacity)))
    parts = sizes.withColumn("pieces", pieces.cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("pieces"))))
    parts = parts.withColumn("token_from", (F.col("piece") - 1).cast("bigint") * capacity).withColumn("token_to", F.least(F.col("piece").cast("bigint") * capacity, "tokens"))
    parts = parts.select("id", "piece", "pieces", "token_from", "token_to", (F.col("token_to") - F.col("token_from")).alias("size"))
    whole = parts.filter(F.col("size") == capacity).withColumn("container", F.concat_ws("-", F.lit("t"), "id", "piece", F.monotonically_increasing_id()))
    none = parts.filter("size = 0").withColumn("container", F.lit(None).cast("string"))
    items = parts.filter((F.col("size") > 0) & (F.col("size") < capacity))
    histogram = materialize(items.groupBy("size").agg(F.count("*").alias("n")), "histogram")
    total = histogram.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    runs = map_groups(histogram.withColumn("one", F.lit(1)), ["one"], _planned(capacity), "size bigint, first bigint, texts bigint, container bigint")
    runs = materialize(runs, "plan")
    blocks = F.sequence(F.floor(F.col("first") / RANKS), F.floor((F.col("first") + F.col("texts") - 1) / RANKS))
    runs = runs.withColumn("block", F.explode(blocks))
    ranked = _ranked(items, total).withColumn("block", F.floor(F.col("rank") / RANKS))
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("texts"))
    placed = ranked.join(runs, ["size", "block"]).filter(inside)
    placed = placed.withColumn("container", F.concat(F.lit("p"), (F.col("container") + F.col("rank") - F.col("first")).cast("string")))
    columns = ["id", "piece", "pieces", "token_from", "token_to", "container"]
    out = placed.select(columns).unionByName(whole.select(columns)).unionByName(none.select(columns))
    return out.withColumnRenamed("id", id_col)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, unused room and the share of room that is used."""
    per = packed.filter("container IS NOT NULL").groupBy("container").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("used"), F.count("*").alias("texts"))
    tokens, containers = F.coalesce(F.sum("used"), F.lit(0)), F.count("*")
    return per.agg(
        containers.alias("containers"), tokens.alias("tokens"), (containers * capacity - tokens).alias("unused"), F.try_divide(tokens, containers * capacity).alias("fill"),
        F.max("used").alias("fullest"), F.count_if(F.col("used") == capacity).alias("exactly_full"), F.avg("texts").alias("texts_per_container"),
    )
