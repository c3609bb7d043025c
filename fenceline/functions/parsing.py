"""Untidy text to dates, numbers and identifiers, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number syntax, stripped signs, and the two readings of a bare number as a date.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
CURRENCY_AND_SEPARATORS = r"[£$€,\s]"
UNIX_SECONDS_ABOVE = 50_000
SPREADSHEET_EPOCH = "1899-12-30"
SECONDS_PER_DAY = 86_400
DAY_FIRST = (
    "[d/M/yyyy][d-M-yyyy][d.M.yyyy][yyyy/M/d][yyyy.M.d]"
    "[MMMM d, yyyy][MMMM d yyyy][MMM d, yyyy][MMM d yyyy][d MMMM yyyy][d MMM yyyy][d-MMM-yyyy][MMM-d-yyyy]"
)
NUMERIC_DATE = r"^\d{1,2}([/.-])\d{1,2}\1\d{4}$"
SHORT_YEAR = "[d/M/yy][d-M-yy][d.M.yy][d-MMM-yy][d MMM yy]"
# Two-digit years from this one on belong to the century before.
PIVOT = 69
WEEKDAY = r"(?i)^(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?\.?,? +"
ORDINAL = r"(?i)\b(\d{1,2})(st|nd|rd|th)\b"
COMPACT = r"^(19|20)\d{6}$"
MONTH_FIRST = "[M/d/yyyy][M-d-yyyy][M.d.yyyy]"
HAS_YEAR = r"\d{4}"
# All forms below have two separators with something between them, and no letters but whole names of months.
SEPARATED = r"[/. -][^/. -]+[/. -]"
FOREIGN_WORD = (
    r"(?i)(?<![a-z])(?!(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sep(t(ember)?)?"
    r"|oct(ober)?|nov(ember)?|dec(ember)?)(?![a-z]))[a-z]"
)
BEYOND_ASCII = r"[^\x00-\x7F]"
TIME_OF_DAY = r"[T ]+\d{1,2}:\d{2}.*$"


def to_number(text: Column) -> Column:
    """Double for text in plain number syntax, else NULL."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def parse_number(text: Column) -> Column:
    """Number in text, ignoring currency signs, thousands separators and blanks."""
    return to_number(F.regexp_replace(text, CURRENCY_AND_SEPARATORS, ""))


def date_from_number(number: Column) -> Column:
    """Large numbers are Unix seconds (UTC), others days in the spreadsheet calendar."""
    return F.when(
        number > UNIX_SECONDS_ABOVE,
        F.date_add(F.lit("1970-01-01").cast("date"), F.floor(number / SECONDS_PER_DAY).try_cast("int")),
    ).otherwise(F.date_add(F.lit(SPREADSHEET_EPOCH).cast("date"), number.try_cast("int")))


def date_from_text(text: Column) -> Column:
    """ISO first, then day-first numeric forms, then month names; a time of day, a weekday's name and the
    ending of an ordinal are ignored.

    The shape is tested first: the common numeric form takes one formatter, and text without a digit, without two
    separators or with other words than months none, as a formatter that fails costs far more than these tests.
    One formatter with optional parts reads all other forms but ISO; a month above 12 and a two-digit year
    need another.
    """
    trimmed = F.trim(text)
    slashes = F.translate(trimmed, ".-", "//")
    numeric = F.coalesce(F.try_to_date(slashes, "d/M/yyyy"), F.try_to_date(slashes, "M/d/yyyy"))
    day = F.when(trimmed.contains(":"), F.regexp_replace(trimmed, TIME_OF_DAY, "")).otherwise(trimmed)
    day = F.regexp_replace(F.regexp_replace(day, WEEKDAY, ""), ORDINAL, "$1")
    iso = (F.substring(trimmed, 5, 1) == "-") & (F.length(trimmed) >= 8)

    def other(day: Column) -> Column:
        short = F.try_to_date(day, SHORT_YEAR)
        short = F.when(F.year(short) % 100 >= PIVOT, F.add_months(short, -1200)).otherwise(short)
        known = ~day.rlike(FOREIGN_WORD) | day.rlike(BEYOND_ASCII)
        return F.when(
            known & day.rlike(HAS_YEAR), F.coalesce(F.try_to_date(day, DAY_FIRST), F.try_to_date(day, MONTH_FIRST))
        ).when(known & day.rlike(r"[A-Za-z/.-]+ ?\d{2}$"), short)

    # By way of an array, the text without its trimmings is made once and not for each test of it.
    return (
        F.when(iso, trimmed.try_cast("date"))
        .when(trimmed.rlike(NUMERIC_DATE), numeric)
        .when(trimmed.rlike(r"\d\d") & trimmed.rlike(SEPARATED), F.get(F.transform(F.array(day), other), 0))
    )


def parse_date(text: Column) -> Column:
    """Date in text; NULL when blank or not a date. Eight digits that are a calendar date are one."""
    number = to_number(F.trim(text))
    compact = F.when(F.trim(text).rlike(COMPACT), F.try_to_date(F.trim(text), "yyyyMMdd"))
    by_number = F.coalesce(compact, date_from_number(number))
    return F.when(number.isNotNull(), by_number).otherwise(date_from_text(text))


def parse_typed_date(column: Column, dtype: str) -> Column:
    if dtype == "date" or dtype.startswith("timestamp"):
        return column.cast("date")
    if dtype == "string":
        return parse_date(column)
    return date_from_number(column.cast("double"))


def parse_typed_number(column: Column, dtype: str) -> Column:
    """Double (booleans become 0 or 1, NaN becomes NULL)."""
    if dtype == "string":
        return parse_number(column)
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


def clean_identifier(column: Column) -> Column:
    return F.trim(column.cast("string"))
