"""Record cleaning as column expressions (N1-N8, N13, N16, F8). No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfmark.constants import EMPTY_WORDS, FALSE_WORDS, PRICE_PATTERN, TRUE_WORDS
from shelfmark.functions.text import is_json, strip

_MIN_EPOCH, _MAX_EPOCH = -62135596800, 253402300799   # years 1 to 9999
_NUMBER = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:nan|inf|infinity))$"
_DATE_TIME = (r"^\d{4}-\d{1,2}-\d{1,2}"
              r"([ T]\d{1,2}(:\d{1,2}(:\d{1,2}([.,]\d{1,9})?)?)?"
              r"(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$")
_WHOLE_SECONDS = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}(:\d{1,2}(:\d{1,2})?)?)?"
_COMPACT_DATE = r"^\d{8}$"


def to_float(text: Column) -> Column:
    """A double, or NULL."""
    s = strip(text)
    return F.when(s.rlike(_NUMBER), s.try_cast("double"))


def to_int(text: Column) -> Column:
    """A whole number; a fraction is cut off; else NULL."""
    s = strip(text)
    whole = F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint"))
    return F.coalesce(whole, to_float(text).try_cast("bigint"))


def parse_price(text: Column, is_number: Column | None = None) -> Column:
    """The first number of a price text, without thousands separators.

    ``is_number`` marks values that were numbers in the source; they pass unchanged.
    """
    first = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), f"({PRICE_PATTERN})", 0)
    parsed = F.nullif(first, F.lit("")).try_cast("double")
    return parsed if is_number is None else F.when(is_number, to_float(text)).otherwise(parsed)


def to_bool01(text: Column) -> Column:
    """1, 0 or NULL for unknown words."""
    word = F.lower(strip(text))
    return F.when(word.isin(TRUE_WORDS), F.lit(1)).when(word.isin(FALSE_WORDS), F.lit(0))


def epoch_to_timestamp(seconds: Column) -> Column:
    """Epoch seconds to a time stamp without zone; outside the years 1 to 9999 it is NULL."""
    inside = (seconds >= _MIN_EPOCH) & (seconds < _MAX_EPOCH + 1)
    whole = F.when(inside, F.floor(F.round(seconds, 6)).cast("bigint"))
    return F.timestamp_add("SECOND", whole, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def clean_timestamp(text: Column, is_number: Column | None = None, epoch_unit: str = "s") -> Column:
    """A time stamp in whole seconds, or NULL.

    Numbers are epoch seconds (``epoch_unit`` "ms" reads milliseconds, "auto" decides by size).
    Texts may be a date, a date with time, or ISO with an offset; the offset is dropped and the
    wall clock kept.
    """
    s = strip(text)
    # Fraction and offset are cut off in the text, so no step depends on the session time zone.
    plain = F.when(s.rlike(_DATE_TIME),
                   F.regexp_extract(s, _WHOLE_SECONDS, 0).try_cast("timestamp_ntz"))
    compact = F.when(s.rlike(_COMPACT_DATE),
                     F.try_to_date(s, "yyyyMMdd").cast("timestamp_ntz"))
    from_text = F.coalesce(plain, compact)
    if is_number is None:
        return from_text
    number = to_float(text)
    if epoch_unit == "ms":
        number = number / 1000
    elif epoch_unit == "auto":
        number = F.when(F.abs(number) > _MAX_EPOCH, number / 1000).otherwise(number)
    return F.when(is_number, epoch_to_timestamp(number)).otherwise(from_text)


def timestamp_text(ts: Column) -> Column:
    """The text form used in CSV files."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def is_empty(value: Column, numeric: bool = False) -> Column:
    """F8: NULL, NaN, blank, empty JSON container or the words null and nan."""
    text = strip(value.cast("string"))
    empty = value.isNull() | F.lower(text).isin(EMPTY_WORDS)
    return empty | F.isnan(value.cast("double")) if numeric else empty


def blank_to_empty(value: Column) -> Column:
    """NULL becomes the empty string."""
    return F.coalesce(value, F.lit(""))


def to_number(value: Column) -> Column:
    """Numeric value, NULL for anything that is not a number, NaN included."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def repair_json_text(text: Column) -> Column:
    """Best-effort repair of a container written with single quotes; the text itself otherwise."""
    s = strip(text)
    container = s.rlike(r"^\{[\s\S]*\}$|^\[[\s\S]*\]$")
    repaired = F.replace(s, F.lit("'"), F.lit('"'))
    return F.when(container & ~is_json(s) & is_json(repaired), repaired).otherwise(s)


# --- fields of one JSON record ----------------------------------------------------------------


def _both(cheap: Column, costly: Column) -> Column:
    """``cheap & costly`` where ``costly`` runs only behind ``cheap``.

    The operands of ``&`` may be computed up front when they share a part with other columns.
    """
    return F.when(cheap, costly).otherwise(F.lit(False))


class Record:
    """Access to the keys of one JSON object whose values were read as text.

    Text alone does not tell a string from other JSON types. Where that matters and the text is
    doubtful (it looks like a container, a boolean or a zero), the line is looked at again; most
    rows never need it. Keys in ``typed`` were read as variants and know their type.
    """

    def __init__(self, line: Column, values: dict[str, Column], typed: tuple[str, ...] = ()):
        self.line = line
        self.values = values
        self.typed = typed

    def _variant(self, key: str) -> Column:
        if key in self.typed:
            return self.values[key]
        return F.try_variant_get(F.try_parse_json(self.line), f"$.{key}", "variant")

    def text(self, key: str) -> Column:
        """The value as text; objects and arrays as JSON."""
        if key in self.typed:
            return F.try_variant_get(self.values[key], "$", "string")
        return self.values[key]

    def is_string(self, key: str) -> Column:
        """Whether the value was a JSON string. Ask only behind a cheaper test."""
        return F.schema_of_variant(self._variant(key)) == "STRING"

    def is_container(self, key: str) -> Column:
        """Whether the value was an object or array.

        A string that looks like one starts right behind its quote, so a line without such a start
        holds no such string.
        """
        looks = self.text(key).startswith("[") | self.text(key).startswith("{")
        string_start = (F.contains(self.line, F.lit('"[')) | F.contains(self.line, F.lit('"{'))
                        | F.contains(self.line, F.lit('"\\u')))
        return _both(looks, F.when(string_start, ~self.is_string(key)).otherwise(F.lit(True)))

    def number_text(self, key: str) -> Column:
        """Like ``text``, with JSON booleans as 1 and 0."""
        text = self.text(key)
        flag = _both(text.isin("true", "false"), ~self.is_string(key))
        return F.when(flag, F.when(text == "true", "1").otherwise("0")).otherwise(text)

    def is_number(self, key: str) -> Column:
        """Whether the value was a number or a boolean."""
        text = self.text(key)
        return _both(text.rlike(r"^-?\d[0-9.eE+\-]*$|^true$|^false$"), ~self.is_string(key))

    def price(self, key: str) -> Column:
        """Numbers pass; only an exponent tells a number from a price text."""
        text = self.number_text(key)
        number = _both(text.rlike(r"^-?\d[0-9.]*[eE][0-9+\-]+$"), ~self.is_string(key))
        return parse_price(text, number)

    def truthy(self, key: str, read=None, keep_falsy: bool = False) -> Column:
        """The value, or NULL where it is an empty string or container, zero or false.

        ``keep_falsy`` drops the empty string alone.
        """
        text, value = self.text(key), (read or self.text)(key)
        if keep_falsy:
            return F.when(text != "", value)
        doubtful = text.rlike(r"^(-?0(\.0+)?([eE][+-]?\d+)?|false|\[\]|\{\})$")
        return F.when(_both(text != "", F.when(doubtful, self.is_string(key))
                            .otherwise(F.lit(True))), value)

    def first_of(self, *keys: str, read=None, keep_falsy: bool = False) -> Column:
        """The first key that holds a value; the last key counts even when its value is falsy.

        ``keep_falsy`` skips missing and empty values only, so that a count of 0 or a flag false
        survives.
        """
        read = read or self.text
        head = [self.truthy(k, read, keep_falsy) for k in keys[:-1]]
        return F.coalesce(*head, read(keys[-1]))

    def json(self, key: str) -> Column:
        """The value as JSON text; a plain string gets quotes; null stays NULL."""
        text = self.text(key)
        return F.when(self.is_container(key), text).when(
            text.isNotNull(), F.to_json(self._variant(key)))

    def joined(self, key: str) -> Column:
        """A list joined by line breaks without its nulls, an object as JSON, else the text."""
        text = self.text(key)
        is_list = text.startswith("[") & self.is_container(key)
        return F.when(is_list, F.array_join(F.from_json(text, "array<string>"), "\n")) \
            .otherwise(text)
