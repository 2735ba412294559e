"""One builder for each scalar function. A builder gets the columns, their kinds and the
syntax trees of the arguments, and returns a column with its kind."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.errors import StrataError
from strata.plans import nodes as n
from strata.plans.types import BOOLEAN, DATE, INTEGER, JSON, NULL, REAL, TEXT, TIMESTAMP, Kind, common, mixed

NOW_FORM = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
# STRFTIME marks, their place in ISO text (1-based start, length) and Spark's pattern.
MARKS = {"%Y": (1, 4, "yyyy"), "%m": (6, 2, "MM"), "%d": (9, 2, "dd"), "%H": (12, 2, "HH"), "%M": (15, 2, "mm"), "%S": (18, 2, "ss")}


def text_of(c: Column, kind: Kind) -> Column:
    """A value as text; a real without fraction shows none."""
    if kind == REAL:
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("decimal(16,0)").cast("string")).otherwise(c.cast("string"))
    if kind == TIMESTAMP:
        return F.date_format(c, NOW_FORM)
    return c if kind.textual else c.cast("string")


def number_of(c: Column, kind: Kind) -> tuple[Column, Kind]:
    """A value for arithmetic; text that is no number becomes NULL."""
    if kind.numeric or kind == NULL:
        return c, kind
    if kind.textual:
        return c.try_cast("double"), REAL
    raise StrataError("TYPE_MISMATCH", f"{kind.name} is no number", "CAST it first")


def trim(c, k, a):
    return F.regexp_replace(text_of(c[0], k[0]), r"^\s+|\s+$", ""), TEXT


def round_(c, k, a):
    x, kind = number_of(c[0], k[0])
    places = 0
    if len(a) == 2:
        if not (isinstance(a[1], n.Lit) and isinstance(a[1].value, int)):
            raise StrataError("TYPE_MISMATCH", "ROUND takes a whole number of places")
        places = a[1].value
    out = F.round(x, places)
    return out, Kind("decimal", max(0, min(kind.scale, places))) if kind.name == "decimal" else kind


def whole(f):
    def build(c, k, a):
        x, _ = number_of(c[0], k[0])
        return f(x).cast("bigint"), INTEGER

    return build


def mod(c, k, a):
    (x, kx), (y, ky) = number_of(c[0], k[0]), number_of(c[1], k[1])
    mixed("MOD", kx, ky)
    return F.try_mod(x, y), common([kx, ky])


def absolute(c, k, a):
    x, kind = number_of(c[0], k[0])
    return F.abs(x), kind


def coalesce(c, k, a):
    kind = common(list(k))
    return F.coalesce(*c), kind


def substr(c, k, a):
    text = text_of(c[0], k[0])
    args = [x.cast("int") for x in c[1:]]
    return F.substr(text, *args), TEXT


def date(c, k, a):
    return (F.date_format(c[0], "yyyy-MM-dd") if k[0] in (TIMESTAMP, DATE) else F.substring(text_of(c[0], k[0]), 1, 10)), TEXT


def strftime(c, k, a):
    if not (isinstance(a[0], n.Lit) and isinstance(a[0].value, str)):
        raise StrataError("TYPE_MISMATCH", "STRFTIME takes its format as literal text")
    parts = re.findall(r"%.|[^%]+", a[0].value)
    for p in parts:
        if p[0] == "%" and p not in MARKS:
            raise StrataError("UNSUPPORTED_FEATURE", f"STRFTIME has no mark {p}", " ".join(MARKS))
    native = k[1] in (TIMESTAMP, DATE)
    if native:
        form = "".join(MARKS[p][2] if p in MARKS else "'" + p.replace("'", "''") + "'" for p in parts)
        return F.date_format(c[1], form), TEXT
    text = text_of(c[1], k[1])
    return F.concat(*[F.substring(text, *MARKS[p][:2]) if p in MARKS else F.lit(p) for p in parts]), TEXT


def json_extract(c, k, a):
    if not (isinstance(a[1], n.Lit) and isinstance(a[1].value, str) and a[1].value.startswith("$")):
        raise StrataError("INVALID_JSON_PATH", "a path starts with $", "such as $.a.b[0]")
    if not re.fullmatch(r"\$(\.[^.\[\]]+|\[\d+\])*", a[1].value):
        raise StrataError("INVALID_JSON_PATH", f"{a[1].value} is no path", "such as $.a.b[0]")
    return F.get_json_object(c[0], a[1].value), JSON


def arrow(c: Column, key: n.Expr) -> tuple[Column, Kind]:
    if not isinstance(key, n.Lit) or key.value is None or isinstance(key.value, bool):
        raise StrataError("INVALID_JSON_PATH", "->> takes a literal key")
    if isinstance(key.value, int):
        path = f"$[{key.value}]"
    else:
        path = key.value if str(key.value).startswith("$") else "$." + str(key.value)
    return F.get_json_object(c, path), TEXT


def nullif(c, k, a):
    common([k[0], k[1]])
    return F.when(F.coalesce(c[0] == c[1], F.lit(False)), F.lit(None)).otherwise(c[0]), k[0]


def texts(f, kind=TEXT):
    return lambda c, k, a: (f(*[text_of(x, y) for x, y in zip(c, k)]), kind)


BUILDERS = {
    "UPPER": texts(F.upper),
    "LOWER": texts(F.lower),
    "LENGTH": texts(F.length, INTEGER),
    "TRIM": trim,
    "ABS": absolute,
    "ROUND": round_,
    "SUBSTR": substr,
    "COALESCE": coalesce,
    "IFNULL": coalesce,
    "NULLIF": nullif,
    "REPLACE": texts(F.replace),
    "CEIL": whole(F.ceil),
    "FLOOR": whole(F.floor),
    "MOD": mod,
    "DATE": date,
    "STRFTIME": strftime,
    "NOW": lambda c, k, a: (F.date_format(F.current_timestamp(), NOW_FORM), TEXT),
    "JSON_EXTRACT": json_extract,
}


def cast(c: Column, kind: Kind, to: str) -> tuple[Column, Kind]:
    if to == "text":
        return text_of(c, kind), TEXT
    if to == "integer":
        number = c.cast("int") if kind == BOOLEAN else c.try_cast("double") if kind.textual else c
        return number.try_cast("bigint"), INTEGER
    if to == "real":
        return (c.cast("int") if kind == BOOLEAN else c).try_cast("double"), REAL
    return c.try_cast("boolean"), BOOLEAN


def aggregate(name: str, c: Column | None, kind: Kind, distinct: bool, separator: str) -> tuple[Column, Kind]:
    if c is None:
        return F.count(F.lit(1)), INTEGER
    if name == "COUNT":
        return (F.count_distinct(c) if distinct else F.count(c)), INTEGER
    if name in ("MIN", "MAX"):
        return (F.min(c) if name == "MIN" else F.max(c)), kind
    if name == "GROUP_CONCAT":
        text = text_of(c, kind)
        values = F.collect_set(text) if distinct else F.collect_list(text)
        return F.when(F.size(values) > 0, F.array_join(F.array_sort(values), separator)), TEXT  # in text order, so that reruns agree
    x, kind = number_of(c, kind)
    if name == "SUM":
        return (F.sum_distinct(x) if distinct else F.sum(x)), kind
    avg = F.try_divide(F.sum_distinct(x), F.count_distinct(x)) if distinct else F.avg(x)
    if kind.name == "decimal":
        return F.round(avg, kind.scale + 4), Kind("decimal", kind.scale + 4)
    return avg, REAL
