"""The relations and scalar functions under SQL names, for spark.sql."""

from __future__ import annotations

from pyspark.sql import SparkSession

from meridian.functions.moment import NINF, PINF

_FOUR = "al BIGINT, ah BIGINT, bl BIGINT, bh BIGINT"
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "rel_before": (_FOUR, "BOOLEAN", "ah < bl"),
    "rel_meets": (_FOUR, "BOOLEAN", "ah = bl"),
    "rel_overlaps": (_FOUR, "BOOLEAN", "al < bl AND bl < ah AND ah < bh"),
    "rel_starts": (_FOUR, "BOOLEAN", "al = bl AND ah < bh"),
    "rel_during": (_FOUR, "BOOLEAN", "al > bl AND ah < bh"),
    "rel_finishes": (_FOUR, "BOOLEAN", "al > bl AND ah = bh"),
    "rel_equals": (_FOUR, "BOOLEAN", "al = bl AND ah = bh"),
    "rel_finished_by": (_FOUR, "BOOLEAN", "al < bl AND ah = bh"),
    "rel_contains": (_FOUR, "BOOLEAN", "al < bl AND ah > bh"),
    "rel_started_by": (_FOUR, "BOOLEAN", "al = bl AND ah > bh"),
    "rel_overlapped_by": (_FOUR, "BOOLEAN", "al > bl AND al < bh AND ah > bh"),
    "rel_met_by": (_FOUR, "BOOLEAN", "al = bh"),
    "rel_after": (_FOUR, "BOOLEAN", "al > bh"),
    "rel_distinct": (_FOUR, "BOOLEAN", "ah <= bl OR bh <= al"),
    "rel_intersects": (_FOUR, "BOOLEAN", "al < bh AND bl < ah"),
    "rel_connects": (_FOUR, "BOOLEAN", "al <= bh AND bl <= ah"),
    "rel_adjacent": (_FOUR, "BOOLEAN", "ah = bl OR al = bh"),
    "rel_encloses": (_FOUR, "BOOLEAN", "al <= bl AND ah >= bh"),
    "moment_shift": ("t BIGINT, d BIGINT", "BIGINT", f"CASE WHEN t > {NINF} AND t < {PINF} THEN t + d ELSE t END"),
    "moment_is_finite": ("t BIGINT", "BOOLEAN", f"t > {NINF} AND t < {PINF}"),
    "interval_contains": ("lo BIGINT, hi BIGINT, t BIGINT", "BOOLEAN", f"lo <= t AND (t < hi OR (hi >= {PINF} AND lo > {NINF} AND t >= {PINF}))"),
    "interval_intersect": (_FOUR, "STRUCT<lo: BIGINT, hi: BIGINT>", "CASE WHEN greatest(al, bl) < least(ah, bh) THEN named_struct('lo', greatest(al, bl), 'hi', least(ah, bh)) END"),
    "interval_duration": ("lo BIGINT, hi BIGINT", "BIGINT", f"CASE WHEN lo > {NINF} AND hi < {PINF} THEN hi - lo END"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions temporary ones of the session; returns their names."""
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    return list(FUNCTIONS)
