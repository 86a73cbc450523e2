"""Behaviour labels and their codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Behaviour codes and their names.
UNKNOWN, MOVE, SLEEP, SCRATCH, NOT_WORN = 0, 1, 2, 3, 4
NAMES = {UNKNOWN: "未知", MOVE: "活动", SLEEP: "睡觉", SCRATCH: "抓挠", NOT_WORN: "未佩戴"}
#: Class names of models; a shake of the body is written as movement.
CODES = {"scratch": SCRATCH, "抓挠": SCRATCH, "active": MOVE, "movement": MOVE, "活动": MOVE, "sleep": SLEEP, "睡觉": SLEEP, "not_worn": NOT_WORN, "未佩戴": NOT_WORN, "shake": MOVE, "甩身体": MOVE}
#: The classes that imported files may hold; others are left out.
IMPORT_CODES = {k: v for k, v in CODES.items() if v in (MOVE, SLEEP, SCRATCH) and k not in ("shake", "甩身体")}


def literal_map(values: dict) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))


def code_of(label: Column, codes: dict[str, int] = CODES) -> Column:
    """The code of a class name, UNKNOWN for other names."""
    return F.coalesce(F.try_element_at(literal_map(codes), label), F.lit(UNKNOWN))


def name_of(code: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(NAMES), code.cast("int")), F.lit(NAMES[UNKNOWN]))
