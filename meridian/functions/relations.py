"""The thirteen relations of two intervals, and what combines them, as join predicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Bounds = tuple[Column, Column, Column, Column]

#: Name, predicate and text of each basic relation; exactly one holds. Bit n is the n-th of them.
BASIC: list[tuple[str, Callable[..., Column], str]] = [
    ("before", lambda al, ah, bl, bh: ah < bl, "is before"),
    ("meets", lambda al, ah, bl, bh: ah == bl, "meets"),
    ("overlaps", lambda al, ah, bl, bh: (al < bl) & (bl < ah) & (ah < bh), "overlaps"),
    ("starts", lambda al, ah, bl, bh: (al == bl) & (ah < bh), "starts"),
    ("during", lambda al, ah, bl, bh: (al > bl) & (ah < bh), "during"),
    ("finishes", lambda al, ah, bl, bh: (al > bl) & (ah == bh), "finishes"),
    ("equals", lambda al, ah, bl, bh: (al == bl) & (ah == bh), "equals to"),
    ("finished_by", lambda al, ah, bl, bh: (al < bl) & (ah == bh), "is finished by"),
    ("contains", lambda al, ah, bl, bh: (al < bl) & (ah > bh), "contains"),
    ("started_by", lambda al, ah, bl, bh: (al == bl) & (ah > bh), "is started by"),
    ("overlapped_by", lambda al, ah, bl, bh: (al > bl) & (al < bh) & (ah > bh), "is overlapped by"),
    ("met_by", lambda al, ah, bl, bh: al == bh, "is met by"),
    ("after", lambda al, ah, bl, bh: al > bh, "is after"),
]
COMBINED: dict[str, Callable[..., Column]] = {
    "intersects": lambda al, ah, bl, bh: (al < bh) & (bl < ah),
    "distinct": lambda al, ah, bl, bh: (ah <= bl) | (bh <= al),
    "adjacent": lambda al, ah, bl, bh: (ah == bl) | (al == bh),
    "connects": lambda al, ah, bl, bh: (al <= bh) & (bl <= ah),
    "encloses": lambda al, ah, bl, bh: (al <= bl) & (ah >= bh),
}
PREDICATES: dict[str, Callable[..., Column]] = {n: p for n, p, _ in BASIC} | COMBINED


def flags(al: Column, ah: Column, bl: Column, bh: Column) -> Column:
    """1 << n for the n-th basic relation."""
    out = F.lit(None).cast("int")
    for n, (_, holds, _text) in enumerate(BASIC):
        out = F.when(holds(al, ah, bl, bh), F.lit(1 << n)).otherwise(out)
    return out


def name(al: Column, ah: Column, bl: Column, bh: Column) -> Column:
    out = F.lit(None).cast("string")
    for _, holds, text in BASIC:
        out = F.when(holds(al, ah, bl, bh), F.lit(text)).otherwise(out)
    return out
