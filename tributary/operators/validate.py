"""From JSON text to typed events, with a failure code for everything that does not pass.

``check_events`` parses each text once and adds the typed envelope, the typed payload
(``attributes``, one nested struct per event type, only the event's own filled) and ``failure``
(null for a valid event). It is one projection without a shuffle, so it runs unchanged on a stream.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.columns import built_once, seconds_between, settled, stable_id
from tributary.schema import (
    EVENT_COLUMNS,
    ID_LENGTHS,
    MAX_ENTITY_ID,
    NEEDS_DEVICE,
    NEEDS_PATIENT,
    PAYLOADS,
    SCHEMA_VERSIONS,
    STAGES,
    WIRE_SCHEMA,
    Field,
)
from tributary.settings import DEFAULTS, Settings

# Failure codes, texts of the fixed failures, and the longest text kept.
INVALID, SKEW, PERMANENT = "INVALID_SCHEMA", "CLOCK_SKEW", "PERMANENT_FAILURE"
NOT_ISO = "timestamp is not ISO-8601"
NO_ZONE = "timestamp must be timezone-aware"
IN_FUTURE = "event timestamp is too far in the future"
TOO_OLD = "event timestamp is too old"
MAX_ERROR = 2000

# Words and digits accepted where a boolean is expected.
TRUE_WORDS = ("1", "on", "t", "true", "y", "yes")
FALSE_WORDS = ("0", "off", "f", "false", "n", "no")

_OBJECT_TEXT = r"(?s)^\s*\{.*\}\s*$"
_FLOAT_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"
_INT_TEXT = r"^\s*[+-]?\d+(\.0*)?\s*$"
_CLOCK = r"(?:\d{2}(?::\d{2}(?::\d{2})?)?|\d{4}(?:\d{2})?)(?:[.,]\d+)?"  # the fraction is always one of a second
_DATE = r"\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-\d)?|\d{4}W\d{2}\d?"
_ISO = rf"^({_DATE})(?:(?s:.)({_CLOCK})(?:([+-])({_CLOCK}))?)?$"  # date, clock, sign and clock of the offset
_PLAIN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def _raw_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _text(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", _raw_text(v))


def _is_null(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def _number(v: Column, pattern: str = _FLOAT_TEXT) -> Column:
    """Numbers, booleans and numeric strings as a double; null for anything else."""
    refused = (F.schema_of_variant(v) == "STRING") & ~_raw_text(v).rlike(pattern)
    return F.when(~refused, F.try_variant_get(v, "$", "double"))


def _whole(v: Column) -> Column:
    """Whole numbers, also written as 3.0 or "3"."""
    number = _number(v, _INT_TEXT)
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def _flag(v: Column) -> Column:
    """Booleans, 0 and 1, and the usual words."""
    word = F.lower(_raw_text(v))
    return F.when(word.isin(*TRUE_WORDS, "1.0"), True).when(word.isin(*FALSE_WORDS, "0.0"), False)


def _field_converted(field: Field) -> Column:
    raw = F.col("_wire.payload")[field.name]
    return {"float": _number, "int": _whole, "bool": _flag}.get(field.kind, _text)(raw)


def _field_inside(value: Column, field: Field) -> Column:
    """The converted value, null out of bounds."""
    inside = []
    if field.choices:
        inside.append(value.isin(*field.choices))
    if field.low is not None:
        inside.append(value >= field.low)
    if field.high is not None:
        inside.append(value <= field.high)
    return F.when(reduce(and_, inside), value) if inside else value


def _field_bad(event_type: str, field: Field) -> Column:
    """Absent though required, null though not nullable, or present but not convertible."""
    raw = F.col("_wire.payload")[field.name]
    value = F.col(f"_{event_type}")[field.name]
    if field.required:
        return value.isNull()
    if field.nullable:
        return value.isNull() & raw.isNotNull() & ~F.is_variant_null(raw)
    return value.isNull() & raw.isNotNull()


def _day_number(date: Column) -> Column:
    """Days since 1970 of a calendar or week date in extended or basic form; null for a day that does not exist."""
    digits = F.replace(date, F.lit("-"))
    year = F.substr(digits, F.lit(1), F.lit(4))
    calendar = F.concat_ws("-", year, F.substr(digits, F.lit(5), F.lit(2)), F.substr(digits, F.lit(7), F.lit(2)))
    week = F.substr(digits, F.lit(6), F.lit(2)).try_cast("int")
    weekday = F.coalesce(F.nullif(F.substr(digits, F.lit(8), F.lit(1)), F.lit("")), F.lit("1")).try_cast("int")
    fourth = F.concat(year, F.lit("-01-04")).try_cast("date")  # lies in week 1
    in_week = F.date_add(fourth, 7 * (week - 1) + weekday - 1 - F.weekday(fourth))
    exists = week.between(1, 53) & weekday.between(1, 7) & (F.extract(F.lit("YEAROFWEEK"), in_week) == year.try_cast("int"))
    found = F.when(date.contains("W"), F.when(exists, in_week)).otherwise(calendar.try_cast("date"))
    return F.when(year != "0000", F.unix_date(found))


def _clock_micros(clock: Column) -> Column:
    """Microseconds of a clock text in extended or basic form; null out of range, digits past the sixth are cut."""
    digits, fraction = F.regexp_replace(clock, r"[.,]\d+$|:", ""), F.regexp_extract(clock, r"[.,](\d+)$", 1)
    part = lambda at: F.coalesce(F.nullif(F.substr(digits, F.lit(at), F.lit(2)), F.lit("")), F.lit("0")).try_cast("int")
    h, m, s = part(1), part(3), part(5)
    micros = F.rpad(F.substr(fraction, F.lit(1), F.lit(6)), 6, "0").try_cast("int")
    whole = ((h * 60 + m) * 60 + s).cast("bigint") * 1_000_000 + micros
    return F.when(clock == "", F.lit(0).cast("bigint")).when((h < 24) & (m < 60) & (s < 60), whole)


def _instant(text: Column) -> Column:
    """ISO-8601 text to a timestamp, taken as UTC without a zone; null when it does not parse or does not exist."""
    utc = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    names = ("date", "clock", "sign", "offset")
    parts = F.struct(*[F.regexp_extract(utc, _ISO, i).alias(name) for i, name in enumerate(names, 1)])

    def micros(p: Column) -> Column:
        offset = F.when(p["sign"] == "-", -1).otherwise(1) * _clock_micros(p["offset"])
        return _day_number(p["date"]).cast("bigint") * 86_400_000_000 + _clock_micros(p["clock"]) - offset

    # Through a lambda, so that the long expression stands in the plan once and runs for these rows only.
    return F.when(utc.rlike(_ISO), F.timestamp_micros(F.transform(F.array(parts), micros)[0]))


def parse_time(text: Column) -> Column:
    """ISO-8601 text with a zone to a timestamp; null without a zone or when the instant does not exist.

    Calendar and week dates, clocks from the hour on, any one character between them, offsets up to fractions of a
    second. The usual form is cast as it is.
    """
    return F.when(text.rlike(_PLAIN), F.coalesce(text.try_cast("timestamp"), _instant(text))).when(_has_zone(text), _instant(text))


def _has_zone(text: Column) -> Column:
    return F.regexp_extract(F.replace(text, F.lit("Z"), F.lit("+00:00")), _ISO, 3) != ""


def _fail(code: str, error: Column | str) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(error) if isinstance(error, str) else error).alias("error"))


@built_once
def _envelope_problem() -> Column:
    """Name of the first envelope field that is missing, mistyped or out of bounds."""
    w = lambda name: F.col(f"_wire.{name}")
    problem = F.when(F.col("_wire").isNull(), "document")
    for name, (low, high) in ID_LENGTHS.items():
        length = F.length(f"_{name}")
        problem = problem.when(length.isNull() | ~length.between(low, high) | (F.col(name) == ""), name)
    problem = problem.when(F.col("event_type").isNull() | ~F.col("event_type").isin(*PAYLOADS), "event_type")
    for name in ("patient_id", "device_id", "resource_id"):
        problem = problem.when(~_is_null(w(name)) & F.col(name).isNull(), name)
    problem = problem.when(F.col("timestamp").isNull(), "timestamp")
    version = F.col("schema_version")
    problem = problem.when(version.isNull() | ~version.between(*SCHEMA_VERSIONS), "schema_version")
    return problem.when(w("payload").isNull(), "payload")


@built_once
def _timestamp_failure(settings: Settings) -> Column:
    ahead = seconds_between(F.col("event_time"), F.col("arrival_time"))
    unreadable = F.when(_has_zone(F.col("timestamp")) | _instant(F.col("timestamp")).isNull(), _fail(INVALID, NOT_ISO)).otherwise(
        _fail(INVALID, NO_ZONE)
    )
    return (
        F.when(F.col("event_time").isNull(), unreadable)
        .when(ahead > settings.allowed_skew_s, _fail(SKEW, IN_FUTURE))
        .when(-ahead > settings.max_age_s, _fail(INVALID, TOO_OLD))
    )


@built_once
def _ids_failure() -> Column:
    blank = lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    return F.when(
        F.col("event_type").isin(*NEEDS_PATIENT) & blank("patient_id"),
        _fail(INVALID, F.concat(F.col("event_type"), F.lit(" requires patient_id"))),
    ).when(
        F.col("event_type").isin(*NEEDS_DEVICE) & blank("device_id"),
        _fail(INVALID, F.concat(F.col("event_type"), F.lit(" requires device_id"))),
    )


@built_once
def _payload_problem() -> Column:
    """First bad payload field of the event's own type."""
    problem = None
    for event_type, fields in PAYLOADS.items():
        first = F.coalesce(*[F.when(_field_bad(event_type, f), f.name) for f in fields])
        mine = F.col("event_type") == event_type
        problem = F.when(mine, first) if problem is None else problem.when(mine, first)
    return problem


@built_once
def _unknown_key() -> Column:
    """A payload key the event's type does not have."""
    keys, unknown = F.map_keys("_wire.payload"), None
    for event_type, fields in PAYLOADS.items():
        others = F.size(F.array_except(keys, F.array(*[F.lit(f.name) for f in fields]))) > 0
        mine = F.col("event_type") == event_type
        unknown = F.when(mine, others) if unknown is None else unknown.when(mine, others)
    return unknown


@built_once
def _storage_failure() -> Column:
    """Entity ids longer than the stored column: accepted by the schema, refused by the store."""
    too_long = F.lit(False)
    for name in ("patient_id", "device_id", "resource_id"):
        too_long = too_long | (F.coalesce(F.length(name), F.lit(0)) > MAX_ENTITY_ID)
    return F.when(too_long, _fail(PERMANENT, "entity id is longer than the stored column"))


@built_once
def _converted(event_type: str) -> Column:
    """Converted payload of one event type, bounds not yet looked at; null for the others."""
    struct = F.struct(*[_field_converted(f).alias(f.name) for f in PAYLOADS[event_type]])
    return F.when(F.col("event_type") == event_type, struct)


@built_once
def _typed(event_type: str) -> Column:
    """Converted payload of one event type, null out of bounds; null for the others."""
    values = F.col(f"_all_{event_type}")
    struct = F.struct(*[_field_inside(values[f.name], f).alias(f.name) for f in PAYLOADS[event_type]])
    return F.when(F.col("event_type") == event_type, struct)


@built_once
def _with_defaults() -> Column:
    """One nested struct per event type, with declared defaults in place of absent fields."""
    views = []
    for event_type, fields in PAYLOADS.items():
        source = F.col(f"_{event_type}")
        if any(f.default is not None for f in fields):
            for f in fields:
                if f.default is not None:
                    source = source.withField(f.name, F.coalesce(source[f.name], F.lit(f.default).cast(f.spark_type)))
        views.append(source.alias(event_type))
    return F.struct(*views)


@built_once
def _wire() -> Column:
    return F.when(F.col("value").rlike(_OBJECT_TEXT), F.from_json("value", WIRE_SCHEMA))


@built_once
def _wire_text(name: str) -> Column:
    return _text(F.col(f"_wire.{name}"))


@built_once
def _wire_version() -> Column:
    return _whole(F.col("_wire.schema_version")).cast("int")


@built_once
def _wire_event_id() -> Column:
    return _raw_text(F.col("_wire.event_id"))


@built_once
def _stripped(name: str) -> Column:
    return _strip(F.col(f"_{name}"))


@built_once
def _event_time() -> Column:
    return parse_time(F.col("timestamp"))


def _envelope_columns() -> dict[str, Column]:
    return {
        **{f"_{name}": _wire_text(name) for name in ID_LENGTHS},
        **{name: _wire_text(name) for name in ("event_type", "patient_id", "device_id", "resource_id", "timestamp")},
        "schema_version": _wire_version(),
        "wire_event_id": _wire_event_id(),
    }


def parse_wire(raw: DataFrame) -> DataFrame:
    """JSON text -> envelope columns; one JSON parse per row, unknown envelope keys ignored."""
    parsed = raw.withColumn("_wire", _wire())
    parsed = parsed.withColumns(_envelope_columns())
    return parsed.withColumns(
        {**{name: _stripped(name) for name in ID_LENGTHS}, "event_time": _event_time()}
    )


@built_once
def _failure(settings: Settings) -> Column:
    """The first failing check in the fixed order."""
    return F.coalesce(
        F.when(
            F.col("_envelope").isNotNull(), _fail(INVALID, F.concat(F.lit("invalid event: "), F.col("_envelope")))
        ),
        _timestamp_failure(settings),
        _ids_failure(),
        F.when(
            F.col("_payload").isNotNull(), _fail(INVALID, F.concat(F.lit("invalid payload: "), F.col("_payload")))
        ),
        F.when(F.col("_unknown"), _fail(INVALID, "invalid payload: unexpected field")),
        _storage_failure(),
    )


def check_events(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Typed events with ``failure`` (code and text of the first failing check, null when valid).

    Needs ``value`` (JSON text) and ``arrival_time``. Checks run in a fixed order: envelope, timestamp,
    zone, skew, age, required ids, payload, storage limits.
    """
    # Values are converted in a projection of their own: bounds ask for them several times.
    parsed = parse_wire(raw).withColumns({f"_all_{event_type}": _converted(event_type) for event_type in PAYLOADS})
    parsed = parsed.withColumns(
        {**{f"_{event_type}": _typed(event_type) for event_type in PAYLOADS}, "_unknown": _unknown_key()}
    )
    judged = parsed.withColumns({"_envelope": _envelope_problem(), "_payload": _payload_problem()})
    judged = judged.withColumns({"failure": _failure(settings), "attributes": _with_defaults()})
    return settled(judged.select(*EVENT_COLUMNS, "wire_event_id", "failure"))


def valid_events(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("failure").isNull()).select(*EVENT_COLUMNS)


def quarantine_rows(checked: DataFrame) -> DataFrame:
    """Invalid rows as quarantine records; the whole original text is kept for a replay."""
    bad = checked.filter(F.col("failure").isNotNull())
    return bad.select(
        stable_id("quarantine", F.col("value"), F.unix_micros("arrival_time").cast("string")).alias("id"),
        F.lit(STAGES["raw"]).alias("original_topic"),
        F.col("wire_event_id").alias("event_id"),
        F.col("failure.code").alias("failure_code"),
        F.substring("failure.error", 1, MAX_ERROR).alias("error"),
        F.col("value").alias("payload"),
        F.lit(False).alias("replayed"),
        F.col("arrival_time").alias("created_at"),
    )


def split_valid_quarantine(raw: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    checked = check_events(raw, settings)
    return valid_events(checked), quarantine_rows(checked)


def canonicalize(events: DataFrame) -> DataFrame:
    """Internal event form: source and event_time by their internal names, defaults filled."""
    return events.select(
        "event_id",
        "patient_id",
        "device_id",
        "resource_id",
        "event_type",
        "event_time",
        F.col("source_id").alias("source"),
        "schema_version",
        "attributes",
        "trace_id",
    )


def typed_payload(events: DataFrame, event_type: str) -> DataFrame:
    """Flat typed view of one event type."""
    return events.filter(F.col("event_type") == event_type).select(
        "event_id", *[F.col(f"attributes.{event_type}.{f.name}").alias(f.name) for f in PAYLOADS[event_type]]
    )
