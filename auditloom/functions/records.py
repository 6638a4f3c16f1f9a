"""Fields of raw records as columns, by regular expression or JSON path; no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timeutil import iso_to_ns

#: Patterns over the raw line; key order matters to them.
CDM_TS = r'"timestampNanos":(\d*)'
ECAR_TS = r'"timestamp":"([^"]*)"'
CDM_EVENT = r'(?d)"com\.bbn\.tc\.schema\.avro\.cdm\d+\.Event".*?"type":"([^"]+)".*?"hostId":"([^"]+)"'
ECAR_EVENT = r'(?d)"action":"([^"]+)".*?"hostname":"([^"]+)".*?"object":"([^"]+)"'
HOST_ID, HOST_NAME = r'"hostId":"([^"]+)"', r'"hostname":"([^"]+)"'
CMD_WRAPPED, CMD_DIRECT = r'"cmdLine":\{"string":"([^"]+)"\}', r'"cmdLine":"([^"]+)"'
CMD_ECAR = r'"command_line":"([^"]+)"'

#: Data sets by model, and their parts.
SUBSETS = {
    "e3": ("cadets", "clearscope", "fivedirections", "theia", "trace"),
    "e5": ("cadets", "clearscope", "fivedirections", "marple", "theia", "trace"),
    "optc": ("aia_51_75", "aia_201_225", "aia_501_525", "aia_951_975"),
}


def truthy(c: Column) -> Column:
    """The value, or null where it is empty text or zero."""
    return F.when((c.cast("string") != "") & (c.cast("string") != "0"), c)


def first_truthy(*columns: Column) -> Column:
    """An or-chain: the first that is not empty, else the last."""
    return F.coalesce(*[truthy(c) for c in columns], columns[-1])


def found(value: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null without one."""
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def is_ecar(dataset: str) -> bool:
    if dataset.lower() not in SUBSETS:
        raise KeyError(dataset)
    return dataset.lower() == "optc"


def own_timestamp(value: Column, dataset: str) -> Column:
    """The line's own time or null (S-14, S-15, S-17); only the first key counts."""
    if is_ecar(dataset):
        return iso_to_ns(found(value, ECAR_TS))
    return F.try_to_number(found(value, CDM_TS), F.lit("9" * 19)).cast("long")


def event_key(value: Column, dataset: str) -> tuple[Column, Column]:
    """Event type and host of a raw line (P-08); eCAR types are ``OBJECT_ACTION``."""
    if is_ecar(dataset):
        action, obj = found(value, ECAR_EVENT, 1), found(value, ECAR_EVENT, 3)
        return F.when(action.isNotNull(), F.concat_ws("_", obj, action)), found(value, ECAR_EVENT, 2)
    return found(value, CDM_EVENT, 1), found(value, CDM_EVENT, 2)


def command_line(value: Column, dataset: str) -> tuple[Column, Column]:
    """Command line and host of a raw line (P-09); JSON escapes stay."""
    if is_ecar(dataset):
        return found(value, CMD_ECAR), found(value, HOST_NAME)
    return F.coalesce(found(value, CMD_WRAPPED), found(value, CMD_DIRECT)), found(value, HOST_ID)


def field(json: Column, path: str) -> Column:
    return F.get_json_object(json, "$." + path)


def unwrap(json: Column, path: str, *prefer: str) -> Column:
    """A value that may sit in a one-key union: preferred keys, else the first key, else the value itself (P-03)."""
    raw = field(json, path)
    key = F.element_at(F.json_object_keys(raw), 1)
    inner = F.coalesce(*[F.get_json_object(raw, f"$.{p}") for p in prefer], F.get(F.map_values(F.from_json(raw, "map<string,string>")), F.lit(0)))
    return F.when(raw.startswith("{"), F.when(key.isNotNull(), inner)).otherwise(raw)


def unwrap_uuid(json: Column, path: str) -> Column:
    """A UUID in or out of a union, upper case."""
    return F.upper(unwrap(json, path))


def is_uuid(c: Column) -> Column:
    """Sixteen bytes of hex once dashes are gone."""
    return F.regexp_replace(c, "-", "").rlike("^[0-9A-Fa-f]{32}$")


def datum(value: Column) -> Column:
    """The line as JSON text, without a trailing comma (S-16)."""
    return F.regexp_replace(F.trim(value), r",\s*$", "")


def record_type(json: Column) -> Column:
    """Last dotted part of the first key of ``datum`` (P-01)."""
    return F.substring_index(F.element_at(F.json_object_keys(field(json, "datum")), 1), ".", -1)


def record_body(json: Column) -> Column:
    """The record inside ``datum``, as JSON text."""
    return F.get(F.map_values(F.from_json(field(json, "datum"), "map<string,string>")), F.lit(0))


def is_cdm(value: Column) -> Column:
    """Whether a raw line has the wrapper of the CDM models."""
    return value.rlike(r'^\s*\{?\s*"?datum"?|"datum":')
