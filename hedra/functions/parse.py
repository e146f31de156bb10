"""Conservative reading of numbers, missing marks, dates and categories from text columns, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spaces that spreadsheets use, marks of missing values at ingest and in the encoder, infinities.
SPACES = "       ﻿"
MISSING = ["", "-", "--", "na", "n/a", "nan", "null", "none", "nil", "#n/d", "#nd", "#n/a", "s/n", "...", "sem valor", "ausente"]
ENCODER_MISSING = ["", "na", "nan", "none", "null", "nat", "-", "--", "n/a", "n.d.", "nd"]
INFINITE = ["inf", "+inf", "infinity", "-inf", "-infinity"]
CURRENCY = r"(?:R\$|US\$|USD|BRL|EUR|GBP|€|£|\$)"
DATE = r"^(\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})$"
POSTCODE = r"^\d{5}-?\d{3}$"
# Names of observation kinds.
KINDS = {
    "oferta": "offer", "offer": "offer", "listing": "offer", "asking": "offer",
    "transacao": "transaction", "transação": "transaction", "transaction": "transaction", "sale": "transaction", "sold": "transaction", "closed": "transaction",
}

#: What Unicode takes for white space.
WHITE = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# What most cells are. Texts with nothing to fold or trim, numbers without a sign by locale, after a currency or nothing, and words without a currency.
TIDY = r"^[!-~](?:[ -~]*[!-~])?\z"
USUAL = {"auto": r"\d+(?:[.,](?:\d{1,2}|\d{4,}))?", "pt-BR": r"\d+(?:\.\d{3})*(?:,\d+)?", "en-US": r"\d+(?:,\d{3})*(?:\.\d+)?"}
WORD = r"(?i)^(?!USD|BRL|EUR|GBP)[a-z]+(?<!USD|BRL|EUR|GBP)\z"
LOCALES = {"pt-BR": (",", "."), "en-US": (".", ",")}


def fold_spaces(c: Column) -> Column:
    return F.translate(c, SPACES, " " * len(SPACES))


def trim(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(c, F.lit(WHITE))


def tidy(c: Column) -> Column:
    """With plain spaces, and none at the ends."""
    return F.when(c.rlike(TIDY), c).otherwise(trim(fold_spaces(c)))


def is_missing(c: Column) -> Column:
    """Null, or a mark of a missing value, at ingest. No mark begins with a digit, so that numbers are told by a comparison."""
    return c.isNull() | (((c < "0") | (c >= ":")) & F.lower(tidy(c)).isin(MISSING))


def is_missing_category(c: Column) -> Column:
    """Null, or a mark of a missing value, in the encoder (another set of marks)."""
    return c.isNull() | F.lower(trim(c)).isin(ENCODER_MISSING)


def category(c: Column) -> Column:
    return F.when(~is_missing_category(c), trim(c))


def finite(c: Column) -> Column:
    """The number, or null if it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def is_observation(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def _result(status: str, value: Column | None = None, locale: str | None = None, reason: str | None = None) -> Column:
    number = F.lit(None).cast("double") if value is None else value
    return F.struct(F.lit(status).alias("status"), number.alias("value"), F.lit(locale).cast("string").alias("locale"), F.lit(reason).cast("string").alias("reason"))


def _parsed(text: Column, sign: Column, locale: str) -> Column:
    return _result("parsed", sign * text.try_cast("double"), locale)


def _by_locale(body: Column, sign: Column, locale: str) -> Column:
    """Of digits and separators. Thousands in groups of three; a lone thousands sign before one or two digits is a decimal sign."""
    decimal, thousands = LOCALES[locale]
    d, t = f"\\{decimal}", f"\\{thousands}"
    plain = F.replace(F.replace(body, F.lit(thousands)), F.lit(decimal), F.lit("."))
    return (
        F.when(body.rlike(rf"^\d+({t}\d{{3}})*({d}\d+)?$"), _parsed(plain, sign, locale))
        .when(body.rlike(rf"^\d+{t}\d{{1,2}}$"), _parsed(F.replace(body, F.lit(thousands), F.lit(".")), sign, locale))
        .otherwise(_result("malformed", reason="separators"))
    )


def _by_shape(body: Column, sign: Column) -> Column:
    """Of digits and separators, without a locale: two kinds of separators, the last is the decimal one; one separator before exactly three digits is ambiguous."""
    one = F.replace(body, F.lit(","), F.lit("."))
    both = body.contains(",") & body.contains(".")
    return (
        F.when(both & body.rlike(r",[^.]*$"), _by_locale(body, sign, "pt-BR"))
        .when(both, _by_locale(body, sign, "en-US"))
        .when(body.rlike(r"^\d+$"), _parsed(body, sign, "auto"))
        .when(one.rlike(r"^\.|\.\.|\.$"), _result("malformed", reason="empty_group"))
        .when(one.rlike(r"^\d+\.(\d{1,2}|\d{4,})$"), _parsed(one, sign, "auto"))
        .when(one.rlike(r"^\d+\.\d{3}$"), _result("ambiguous", reason="thousands_or_decimal"))
        .when(one.rlike(r"^\d+(\.\d{3}){2,}$"), _parsed(F.replace(one, F.lit(".")), sign, "auto"))
        .otherwise(_result("malformed", reason="incoherent_groups"))
    )


def _bound(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), with x evaluated once however often it is named."""
    return F.element_at(F.transform(F.array(x), then), 1)


def parse_number(c: Column, locale: str = "auto") -> Column:
    """struct(status, value, locale, reason) of a text; status is missing, parsed, ambiguous, malformed, non_finite or non_numeric.

    The value is null unless parsed: an ambiguous text is never guessed. Each step looks only at what the one before it leaves open.
    """
    read = lambda t: _bound(_signed(t), lambda s: _judge(s["body"], s["sign"], locale))
    any_ = _bound(tidy(c), lambda t: F.when(is_missing(t), _result("missing")).otherwise(read(t)))
    if locale not in USUAL:
        return any_
    # plain expressions for what most cells are; the steps above would say the same of them
    digits, (decimal, thousands) = F.regexp_extract(c, r"[0-9.,]+\z", 0), LOCALES.get(locale, (",", ""))
    number = F.replace(F.replace(digits, F.lit(thousands)) if thousands else digits, F.lit(decimal), F.lit("."))
    usual = F.when(c.rlike(rf"(?i)^(?:{CURRENCY}\s*)?{USUAL[locale]}\z"), _parsed(number, F.lit(1.0), locale))
    return usual.when(c.rlike(WORD) & ~F.lower(c).isin(*MISSING, *INFINITE), _result("non_numeric")).otherwise(any_)


def _signed(text: Column) -> Column:
    """sign and body of a tidy text, without a currency before or after and without blanks between digits."""
    bare = trim(F.regexp_replace(F.regexp_replace(text, rf"(?i)^{CURRENCY}\s*", ""), rf"(?i)\s*{CURRENCY}$", ""))
    return _bound(F.regexp_replace(bare, r"(?<=\d) (?=\d)", ""), lambda b: F.struct(F.when(b.startswith("-"), -1.0).otherwise(1.0).alias("sign"), trim(F.regexp_replace(b, r"^[+-]", "")).alias("body")))


def _judge(body: Column, sign: Column, locale: str) -> Column:
    scientific = sign * body.try_cast("double")
    odd = lambda other: (
        F.when(body == "", _result("malformed", reason="sign_only"))
        .when(F.lower(body).isin(INFINITE), _result("non_finite"))
        .when(body.rlike(r"(?i)^[+-]?\d+(\.\d+)?e[+-]?\d+$") & (F.abs(scientific) < float("inf")), _result("parsed", scientific, "scientific"))
        .when(body.rlike(r"(?i)^[+-]?\d+(\.\d+)?e[+-]?\d+$"), _result("non_finite"))
        .otherwise(other)
    )
    if locale != "auto" and locale not in LOCALES:
        return odd(_result("malformed", reason="unsupported_locale"))
    return F.when(body.rlike(r"^[0-9.,]+$"), _by_shape(body, sign) if locale == "auto" else _by_locale(body, sign, locale)).otherwise(odd(_result("non_numeric")))


def already_number(c: Column) -> Column:
    """The same struct for a numeric column."""
    return F.when(c.isNull() | F.isnan(c), _result("missing")).when(F.abs(c) == float("inf"), _result("non_finite")).otherwise(_result("already_numeric", c.cast("double")))


def to_number(c: Column, locale: str = "auto") -> Column:
    return parse_number(c, locale)["value"]


def number(df: DataFrame, c: str, locale: str = "auto") -> Column:
    """A column as a double, whatever its type: texts are read under the locale, and what is no number is null."""
    kind = dict(df.dtypes)[c]
    return to_number(F.col(c), locale) if kind == "string" else F.col(c).try_cast("double")


def is_date_shaped(c: Column) -> Column:
    return c.rlike(DATE)


def iso_date(c: Column) -> Column:
    """The date of a YYYY-MM-DD text, null for any other text or an impossible date."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"))


def to_timestamp(c: Column) -> Column:
    """First of several formats that fits."""
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy"]
    return F.coalesce(*[F.try_to_timestamp(F.replace(c, F.lit("T"), F.lit(" ")), F.lit(f)) for f in forms])


def is_phone(c: Column) -> Column:
    """Eight digits or more, with brackets, dashes or blanks among them."""
    return c.rlike(r"[()\-\s]") & (F.length(F.regexp_replace(c, r"\D", "")) >= 8)


def observation_kind(c: Column) -> Column:
    """offer or transaction; null for any other name."""
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return known[F.lower(trim(c))]


def is_formula(c: Column) -> Column:
    """A spreadsheet would run it: it begins with = + - @, a tab or a carriage return, or a full-width form, zero-width characters aside."""
    bare = F.ltrim(c, F.lit("\ufeff\u200b\u200c\u200d"))
    return F.coalesce(F.substring(bare, 1, 1).isin(list("=+-@\t\r＝＋－＠")), F.lit(False))


def neutral_cell(c: Column) -> Column:
    """Text that a spreadsheet shows and doesn't run; null becomes empty."""
    return F.when(c.isNull(), "").when(is_formula(c), F.concat(F.lit("'"), c)).otherwise(c)


def redact(c: Column) -> Column:
    """Without tax numbers, mail addresses and long hexadecimal tokens."""
    out = F.regexp_replace(c, r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", "[cpf]")
    out = F.regexp_replace(out, r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "[mail]")
    return F.regexp_replace(out, r"\b[0-9a-fA-F]{32,}\b", "[token]")


def brl(c: Column) -> Column:
    """R$ 1.234,56."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(c, 2), ",.", ".,"))


def valid_point(latitude: Column, longitude: Column) -> Column:
    return F.coalesce(latitude.between(-90, 90) & longitude.between(-180, 180), F.lit(False))
