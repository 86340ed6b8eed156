"""Fixtures in whole hours after a fixed midnight, and frames built from them."""

from meridian.functions.moment import HOUR, NINF, PINF

H0 = 1704067200000000  # 2024-01-01 00:00 UTC
LO, HI = NINF, PINF


def h(x):
    return x if x in (NINF, PINF) else H0 + int(x * HOUR)


def frame(spark, sets, key="key"):
    """sets: {key: [(lo, hi), ...]} in hours."""
    rows = [(k, h(a), h(b)) for k, ivs in sets.items() for a, b in ivs]
    return spark.createDataFrame(rows, f"{key} string, lo long, hi long")


def operands(spark, cases):
    """cases: {key: [set, set, ...]}."""
    rows = [(k, n, h(a), h(b)) for k, ops in cases.items() for n, ivs in enumerate(ops) for a, b in ivs]
    return spark.createDataFrame(rows, "key string, operand int, lo long, hi long")


def back(x):
    return x if x in (NINF, PINF) else (x - H0) / HOUR


def got(df, key="key"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append((back(r["lo"]), back(r["hi"])))
    return {k: sorted(v) for k, v in out.items()}
