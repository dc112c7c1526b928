"""Typed access to schemaless JSON payloads held as VARIANT."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import non_blank

# texts of the values, other than strings and booleans, that a dynamic language takes as false
FALSY = ("0", "0.0", "-0.0", "[]", "{}")
# the form of nearly all timestamps, which a plain cast can read
COMMON_ISO = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d{1,6})?(Z|[+-]\d\d:\d\d)?$"

# calendar date, then an optional time of day, then an optional offset
ISO_PATTERN = (
    r"^(?:(\d{4})-(\d{2})-(\d{2})|(\d{4})(\d{2})(\d{2}))"
    r"(?:[^0-9](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?([+-]\d{2}(?::?\d{2})?)?)?$"
)

# year, week, perhaps a day of the week, then the rest as in ISO_PATTERN; dashes in both places or in none
WEEK_DATE = r"^(\d{4})(-?)W(\d{2})((?:\2([1-7]))?)([^0-9-].*)?$"


class Payload:
    """Reads keys of one payload column made by `unpack`.

    Each key that is asked for gets a place in `keys`, so that only those are unpacked. A key with a dot
    names a field of an inner object.
    """

    def __init__(self, column: str):
        self.column = column
        self.keys: list[str] = []
        self._columns: dict[str, Column] = {}

    def get(self, key: str) -> Column:
        """The unpacked value; null where the key is absent."""
        if key not in self._columns:
            self._columns[key] = F.get(self.column, F.lit(len(self.keys)))
            self.keys.append(key)
        return self._columns[key]

    def kind(self, key: str) -> Column:
        return self.get(key)["kind"]

    def is_text(self, key: str) -> Column:
        """Absent, null or a string."""
        kind = self.kind(key)
        return kind.isNull() | kind.isin("STRING", "VOID")

    def text(self, key: str) -> Column:
        """The value as text; true and false are capitalized, objects and lists stay JSON."""
        return self.get(key)["text"]

    def truthy(self, key: str) -> Column:
        """The text of the value, null where the value counts as false."""
        return self.get(key)["truthy"]

    def first_truthy(self, *keys: str) -> Column:
        """The first value that counts as true; the last key's value is taken as it is."""
        return F.coalesce(*[self.truthy(k) for k in keys[:-1]], self.text(keys[-1]))

    def any_truthy(self, *keys: str) -> Column:
        """The first value that counts as true, else null."""
        return F.coalesce(*[self.truthy(k) for k in keys])

    def first_non_blank(self, *keys: str) -> Column:
        """The first value with something besides white space, stripped; 0 and false are kept."""
        return F.coalesce(*[non_blank(self.text(k)) for k in keys])

    def first_value(self, *keys: str) -> Column:
        """The first unpacked value that counts as true."""
        return F.coalesce(*[F.when(self.truthy(k).isNotNull(), self.get(k)) for k in keys])


def text_value(text: Column) -> Column:
    """A text in the shape of an unpacked value."""
    return F.struct(
        F.lit("STRING").alias("kind"), text.alias("text"), F.nullif(text, F.lit("")).alias("truthy"),
        F.lit(None).cast("double").alias("number"),
    )


def timestamp_of(value: Column) -> Column:
    """The timestamp an unpacked value stands for: ISO text, or an epoch number."""
    text = value["text"]
    return F.when(
        value["truthy"].isNotNull(),
        F.when(value["kind"] == "STRING", iso_timestamp(text)).otherwise(epoch_timestamp(value["number"])),
    )


def parse_object(raw: str) -> Column:
    """The raw text as VARIANT, null where it is no JSON object."""
    return F.when(F.col(raw).rlike(r"^\s*\{"), F.try_parse_json(raw))


def unpack(variant: str, keys: Sequence[str]) -> Column:
    """VARIANT object -> array with, per key, a struct (kind, text, truthy, number), null for an absent key.

    `truthy` is the text where the value counts as true, else null.
    """
    values = [F.try_variant_get(variant, _path(k), "variant") for k in keys]

    # a value's kind and text are looked at once here; `describe` asks for them several times
    def seen(value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(
            value.alias("value"), F.schema_of_variant(value).alias("kind"), F.try_variant_get(value, "$", "string").alias("text"),
        ))

    def describe(one: Column) -> Column:
        kind, plain = one["kind"], one["text"]
        boolean = F.when(plain == "true", F.lit("True"))
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        described = F.struct(
            kind.alias("kind"),
            F.when(kind == "BOOLEAN", F.initcap(plain)).otherwise(plain).alias("text"),
            F.when(kind == "STRING", F.nullif(plain, F.lit("")))
            .when(kind == "BOOLEAN", boolean)
            .when(~plain.isin(*FALSY), plain)
            .alias("truthy"),
            F.when(numeric, F.try_variant_get(one["value"], "$", "double")).alias("number"),
        )
        return F.when(one.isNotNull(), described)

    return F.transform(F.transform(F.array(*values), seen), describe)


def _path(key: str) -> str:
    return "$" + "".join(f"['{part}']" for part in key.split("."))


def epoch_timestamp(number: Column) -> Column:
    """Epoch milliseconds above 1e10, else seconds; null outside years 1 to 9999."""
    micros = F.when(number > 1e10, number * 1000).otherwise(number * 1000000)
    return F.when(
        micros.between(-62135596800000000.0, 253402300799999999.0), F.timestamp_micros(F.round(micros).cast("bigint"))
    )


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text with at least a full date, of the calendar or of a week; no offset means UTC; null where it is not a date."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text.rlike(COMMON_ISO), zoned.try_cast("timestamp")).otherwise(
        # a lambda keeps the rare forms out of the generated code of the common one
        F.get(F.transform(F.array(text), lambda t: _any_iso_timestamp(F.when(t.rlike(WEEK_DATE), _from_week(t)).otherwise(t))), 0)
    )


def _from_week(text: Column) -> Column:
    """A date by week, such as 2024-W03-2 or 2024W032, as the date it is; null for a week that its year does not have."""
    year, week, day = (F.regexp_extract(text, WEEK_DATE, k) for k in (1, 3, 5))
    first = F.date_trunc("week", F.make_date(year.try_cast("int"), F.lit(1), F.lit(4))).cast("date")
    monday = F.date_add(first, 7 * (week.try_cast("int") - 1))
    date = F.date_add(monday, F.when(day == "", 0).otherwise(day.try_cast("int") - 1))
    fits = (F.extract(F.lit("YEAROFWEEK"), monday) == year.try_cast("int")) & week.try_cast("int").between(1, 53)
    written = F.when(F.regexp_extract(text, WEEK_DATE, 2) == "-", F.date_format(date, "yyyy-MM-dd")).otherwise(F.date_format(date, "yyyyMMdd"))
    return F.when(fits & (year.try_cast("int") > 0), F.concat(written, F.regexp_extract(text, WEEK_DATE, 6)))


def _any_iso_timestamp(text: Column) -> Column:
    """All other forms: basic dates, dates alone, short times, long fractions, short offsets."""
    clean = F.regexp_replace(text, "Z", "+00:00")
    date, hour, minute, second, zone = "$1$4-$2$5-$3$6", "$7", "$8", "$9", "$11"
    parts = F.split(F.regexp_replace(clean, ISO_PATTERN, f"{date}/{hour}/{minute}/{second}/$10/{zone}"), "/")

    def part(i: int, default: str) -> Column:
        return F.when(parts[i] == "", F.lit(default)).otherwise(parts[i])

    offset = F.regexp_replace(F.rpad(F.regexp_replace(part(5, "+00"), ":", ""), 5, "0"), "(..)$", ":$1")
    fraction = F.rpad(F.substring(parts[4], 1, 6), 6, "0")
    canonical = F.concat(
        parts[0], F.lit("T"), part(1, "00"), F.lit(":"), part(2, "00"), F.lit(":"), part(3, "00"), F.lit("."), fraction, offset
    )
    return F.when(clean.rlike(ISO_PATTERN), canonical.try_cast("timestamp"))


def computed_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Adds a costly column so that it is evaluated once per row.

    A filter on a plain column is pushed below its definition with the definition copied into it, here
    the whole payload parsing for each use. A one-element explode stops that.
    """
    return df.select("*", F.explode(F.array(column)).alias(name))
