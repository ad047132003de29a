"""Queries of the training-data operators over the project's tables: pN_... for problem N."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm import checks
from windrow.llm.cross_split import cross_split_pairs, cross_split_report
from windrow.llm.group_split import group_split, split_report
from windrow.llm.mixing import mix_sources
from windrow.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from windrow.llm.packing import pack, packing_report
from windrow.llm.pieces import split_oversized
from windrow.llm.related import assembly_groups, related_pairs, segment_groups
from windrow.llm.sampling import quota_sample
from windrow.llm.severity import score_documents, severity_rates
from windrow.llm.tables import read


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_pairs(read(spark, d, "train"), {"val": read(spark, d, "val"), "test": read(spark, d, "test")})


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _overlaps(spark, d)
    return pairs.select(F.least("train_id", "eval_id").alias("segment_id_a"), F.greatest("train_id", "eval_id").alias("segment_id_b")).distinct()


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d)


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_report(_overlaps(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(read(spark, d, "train")).select("segment_id_a", "segment_id_b")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_groups(read(spark, d, "train"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(read(spark, d, "segments"), with_sequence=False).filter("pieces > 1").select("segment_id").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(read(spark, d, "segments"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return related_pairs(assembly_groups(read(spark, d, "known_prophages")))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return group_split(segment_groups(read(spark, d, "segments"), read(spark, d, "known_prophages"), read(spark, d, "contig_map")))


def p5_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return split_report(_split(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = quota_sample(read(spark, d, "train"), read(spark, d, "label_targets"))
    return report.filter("short").select("label", "source")


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    return quota_sample(read(spark, d, "train"), read(spark, d, "label_targets"))[0]


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return quota_sample(read(spark, d, "train"), read(spark, d, "label_targets"))[1]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pack(read(spark, d, "documents")).filter("pieces > 1").select("doc_id").distinct()


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack(read(spark, d, "documents"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing_report(pack(read(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(read(spark, d, "documents"), read(spark, d, "mix_targets"))[1].filter("short").select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(read(spark, d, "documents"), read(spark, d, "mix_targets"))[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(read(spark, d, "documents"), read(spark, d, "mix_targets"))[1]


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return score_documents(read(spark, d, "documents"), read(spark, d, "doc_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter("flagged").select("doc_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return severity_rates(_scored(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pairs, p1_report, p3_found, p3_pieces, p4_found, p4_groups, p5_found, p5_split, p5_report, p6_found, p6_sample, p6_report, p7_found, p7_packing, p7_report, p8_found, p8_mix, p8_report, p9_found, p9_scores, p9_rates)} | checks.queries()


_STRETCHES = """
WITH rec AS ({records}),
word AS (SELECT segment_id, side, unnest(list_transform(range(1, length(bases) - 14), lambda i: substr(bases, i, 16))) AS w FROM rec WHERE length(bases) >= 16),
str AS (SELECT DISTINCT segment_id, side, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS w FROM word WHERE regexp_full_match(w, '[ACGT]+')),
n AS (SELECT segment_id, count(*) AS n FROM str GROUP BY segment_id),
common AS (SELECT a.segment_id AS a, b.segment_id AS b, count(*) AS c FROM str a JOIN str b ON a.w = b.w AND a.segment_id < b.segment_id AND {sides} GROUP BY a.segment_id, b.segment_id)
SELECT a AS segment_id_a, b AS segment_id_b FROM common JOIN n x ON x.segment_id = a JOIN n y ON y.segment_id = b WHERE {test}
"""
_BASES = "SELECT DISTINCT segment_id, {side} AS side, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) AS bases FROM {table} WHERE segment_id IS NOT NULL AND sequence IS NOT NULL"

_RELATED = r"""
WITH RECURSIVE k AS (SELECT DISTINCT assembly, coalesce('N' || nullif(regexp_extract(assembly, '(?:^|[^0-9])([0-9]{9})(?:[^0-9]|$)', 1), ''), 'A' || assembly) AS unit,
  'C' || nullif(upper(regexp_replace(ncbi_id, '^\s+|\s+$', '', 'g')), '') AS contig FROM known_prophages WHERE assembly <> ''),
e AS (SELECT DISTINCT a.unit AS u, b.unit AS v FROM k a JOIN k b ON a.contig = b.contig UNION SELECT unit, unit FROM k),
r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
g AS (SELECT u, min(v) AS g FROM r GROUP BY u), m AS (SELECT DISTINCT assembly, g FROM k JOIN g ON g.u = k.unit)
SELECT a.assembly AS assembly_a, b.assembly AS assembly_b FROM m a JOIN m b ON a.g = b.g AND a.assembly < b.assembly
"""

_SHORT = """
WITH p AS (SELECT segment_id, latest.label AS label, latest.source AS source FROM (SELECT segment_id, max(struct_pack(label := label, source := lower(trim(source)))) AS latest FROM train WHERE segment_id IS NOT NULL AND label IS NOT NULL AND trim(source) <> '' GROUP BY segment_id)),
c AS (SELECT label, source, count(*) AS n FROM p GROUP BY label, source), s AS (SELECT floor(count(*) * 0.25) AS size FROM p)
SELECT CAST(t.label AS INT) AS label, t.source FROM label_targets t LEFT JOIN c ON c.label = t.label AND c.source = lower(trim(t.source)), s WHERE coalesce(c.n, 0) < greatest(t.min_rows, t.target_share * s.size)
"""


#: Pairs of problem 1 with what is known of both records, from those of _STRETCHES without the order of the ids.
_OVERLAPS = """
WITH z AS ({stretches}),
i AS (SELECT segment_id, max(struct_pack(label := label, source := nullif(lower(trim(source)), ''))) AS at, 'train' AS split FROM train WHERE segment_id IS NOT NULL GROUP BY segment_id
  UNION ALL SELECT segment_id, max(struct_pack(label := label, source := nullif(lower(trim(source)), ''))), 'val' FROM val WHERE segment_id IS NOT NULL GROUP BY segment_id
  UNION ALL SELECT segment_id, max(struct_pack(label := label, source := nullif(lower(trim(source)), ''))), 'test' FROM test WHERE segment_id IS NOT NULL GROUP BY segment_id),
pairs AS (SELECT t.segment_id AS train_id, e.segment_id AS eval_id, e.split, CAST(t.at.label AS INT) AS train_label, CAST(e.at.label AS INT) AS eval_label, t.at.source AS train_source, e.at.source AS eval_source,
  c / least(m, n) AS containment, c / (m + n - c) AS similarity
  FROM z JOIN i t ON t.split = 'train' AND t.segment_id IN (segment_id_a, segment_id_b) JOIN i e ON e.split <> 'train' AND e.segment_id IN (segment_id_a, segment_id_b))
"""

_GROUPS = """
WITH RECURSIVE pairs AS ({stretches}), ids AS (SELECT DISTINCT segment_id FROM train WHERE segment_id IS NOT NULL),
e AS (SELECT segment_id_a AS u, segment_id_b AS v FROM pairs UNION SELECT segment_id_b, segment_id_a FROM pairs UNION SELECT segment_id, segment_id FROM ids),
r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
g AS (SELECT u, min(v) AS g FROM r GROUP BY u),
b AS (SELECT DISTINCT segment_id, regexp_replace(upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')), '[^ACGT]', 'N', 'g') AS bases FROM train WHERE segment_id IS NOT NULL),
l AS (SELECT x.segment_id, count(DISTINCT y.bases) AS links FROM e JOIN b x ON x.segment_id = e.u JOIN b y ON y.segment_id = e.v AND y.bases <> x.bases GROUP BY x.segment_id)
SELECT g.u AS segment_id, g.g AS group_id, count(*) OVER (PARTITION BY g.g) AS group_size, coalesce(l.links, 0) AS links FROM g LEFT JOIN l ON l.segment_id = g.u
"""


def oracle_sql() -> dict[str, str]:
    """SQL twins; the others (texts in tokens, samples, splits, scores) are tested in tests/llm."""
    three = " UNION ".join(_BASES.format(side=i, table=t) for i, t in enumerate(("train", "val", "test")))
    across = {"records": three, "sides": "(a.side = 0) <> (b.side = 0)", "test": "c >= 0.6 * least(x.n, y.n)"}
    overlaps = _OVERLAPS.format(stretches=_STRETCHES.replace("AS segment_id_b FROM", "AS segment_id_b, c, x.n AS m, y.n AS n FROM").format(**across))
    within = _STRETCHES.format(records=_BASES.format(side=0, table="train"), sides="TRUE", test="c >= 0.5 * (x.n + y.n - c)")
    return {
        "p1_found": _STRETCHES.format(**across),
        "p1_pairs": f"{overlaps} SELECT * FROM pairs",
        "p1_report": f"""{overlaps} SELECT split, eval_source AS source, count(*) AS pairs, count(*) FILTER (train_label = eval_label) AS agreeing, count(*) FILTER (train_label <> eval_label) AS conflicting,
            count(DISTINCT eval_id) AS eval_records, count(*) FILTER (similarity = 1) AS identical FROM pairs GROUP BY split, eval_source""",
        "p4_groups": _GROUPS.format(stretches=within),
        "p3_found": "SELECT DISTINCT segment_id FROM segments WHERE segment_id IS NOT NULL AND length(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) > 8000",
        "p4_found": within,
        "p5_found": _RELATED,
        "p6_found": _SHORT,
    } | checks.oracle_sql()
