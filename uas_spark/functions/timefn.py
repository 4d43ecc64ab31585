"""Instant and date text forms, and the public record projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text forms of instants and dates.
API_INSTANT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"   # ISO-8601 UTC with milliseconds
FULL_INSTANT = "yyyy-MM-dd HH:mm:ss.SSSSSS"     # lossless microsecond text
DATE_TEXT = "yyyy-MM-dd"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def iso_text(ts) -> Column:
    return F.date_format(_c(ts), FULL_INSTANT)


def api_instant(ts) -> Column:
    return F.date_format(_c(ts), API_INSTANT)


def date_text(d) -> Column:
    return F.date_format(_c(d), DATE_TEXT)


# An instant with a zone, its seconds optional, its fraction of any length.
_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"


def to_instant(text: Column) -> Column:
    """ISO-8601 instant text to a timestamp (null when it does not parse). Seconds may be left out;
    digits beyond the microsecond are cut off."""
    full = F.regexp_replace(text, r"T(\d{2}:\d{2})(Z|[+-])", "T$1:00$2")
    micro = F.regexp_replace(full, r"(\.\d{6})\d+", "$1")
    return F.when(text.rlike(_INSTANT), micro.try_cast("timestamp"))


def texts_for_instants(df: DataFrame) -> DataFrame:
    """Replace every top-level timestamp column by its microsecond text and every date by
    ``yyyy-MM-dd``, keeping names (used by query outputs so they compare as text)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(iso_text(f.name).alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            out.append(date_text(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p[:1].upper() + p[1:] for p in rest)


def api_projection(df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """Stored row to public record: camelCase names, ISO instants with milliseconds,
    dates as text; ``record_json`` gives the JSON form.
    """
    rename = rename or {}
    out = []
    for f in df.schema.fields:
        name = rename.get(f.name, _camel(f.name))
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(api_instant(f.name).alias(name))
        elif isinstance(f.dataType, T.DateType):
            out.append(date_text(f.name).alias(name))
        else:
            out.append(F.col(f.name).alias(name))
    return df.select(*out)


# Record fields the public API leaves out when absent; every other nullable
# field is written as an explicit null.
OPTIONAL_FIELDS = ("companyName", "addressLine2", "ceilingFt")


def record_json(df: DataFrame, optional: tuple[str, ...] = OPTIONAL_FIELDS) -> Column:
    """JSON text of a projected record. Fields in ``optional`` are omitted when null;
    all other fields are always present (``null`` when null)."""
    req = [F.col(c) for c in df.columns if c not in optional]
    opt = [F.col(c) for c in df.columns if c in optional]
    extra = F.to_json(F.struct(*opt)) if opt else None            # null fields dropped
    if not req:
        return extra if extra is not None else F.lit("{}")
    body = F.to_json(F.struct(*req), {"ignoreNullFields": "false"})
    if extra is None:
        return body
    inner = F.regexp_extract(extra, r"^\{(.*)\}$", 1)
    return F.when(inner == "", body).otherwise(
        F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(","), inner, F.lit("}")))
