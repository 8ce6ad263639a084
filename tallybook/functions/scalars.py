"""Text, number, date and address normalisers as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.fiscal import previous_month_end, previous_month_start

# Text patterns of the domain.
FOOTER = r"(?i)https?://\S+|request\s+to\s+our\s+customers.*$|registered\s+office.*$|this\s+is\s+system\s+generated.*$"
NEXT_ENTRY = r"\b(NEFT|IMPS|RTGS|ACH|POS|ATM|BIL|SMS\s+CHRG|CASH\s+HAND|UPI)\b"
OWN_ENTRY = r"(?i)^((?:TO\s+SELF|BY\s+CASH)\b(?:\s*[-–—]?\s*\d{3,})?)"
OWN_UPI = rf"(?is)^(UPI/[DC]R\b.*?)(?=\s+(?:{NEXT_ENTRY}))"
REFERENCE_LIKE = r"^[\d/\-\s]+$"
REFERENCE_WORD = r"(?i)\b(chq|cheque|ref|utr|upi|imps|neft)\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PAN = "^[A-Z]{5}[0-9]{4}[A-Z]$"
MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
PDF_TYPES = ["application/pdf"]
SHEET_TYPES = ["application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"]
CASH_WORDS = ["cash", "atm", "self"]
NOT_CASH_WORDS = ["chrgs", "chrg", "charge", "charges", "chg", "upi", "transfer"]


def strip(column: Column) -> Column:
    """All white space at both ends, not only blanks."""
    return F.btrim(column, F.lit(" \t\n\x0b\f\r"))


def collapse(column: Column) -> Column:
    return strip(F.regexp_replace(column, r"\s+", " "))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*(F.nullif(strip(c), F.lit("")) for c in columns))


def digits(column: Column) -> Column:
    return F.regexp_replace(column, r"\D+", "")


def safe_name(column: Column, default: str = "unknown") -> Column:
    """Letters, digits, dot, dash and underscore; runs of others become one underscore."""
    cleaned = F.regexp_replace(F.regexp_replace(column, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(default))


def normalize_code(column: Column) -> Column:
    """1282.0 becomes 1282; what is no number is trimmed only."""
    number = F.trim(column).try_cast("double")
    return F.coalesce(F.when(number == F.floor(number), number.try_cast("bigint").cast("string")), F.trim(column))


def normalize_pan(column: Column) -> Column:
    cleaned = F.upper(F.regexp_replace(column, r"\s+", ""))
    return F.when(cleaned.rlike(PAN), cleaned)


def clean_ack(column: Column) -> Column:
    """Digits, 20 at most; nan and none are empty."""
    lowered = F.lower(F.trim(F.coalesce(column, F.lit(""))))
    return F.when(lowered.isin("nan", "none"), "").otherwise(F.substring(digits(lowered), 1, 20))


def emails_in(column: Column) -> Column:
    """Sorted distinct lower-cased addresses of a text."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(column, F.lit(EMAIL), F.lit(0)), F.lower)))


def normalize_emails(array: Column, most: int = 10) -> Column:
    """Trimmed, lower-cased, without repeats or blanks, in order, `most` at most."""
    cleaned = F.filter(F.transform(array, lambda e: F.lower(F.trim(e))), lambda e: e != "")
    return F.slice(F.array_distinct(cleaned), 1, most)


def account_numbers(column: Column) -> Column:
    """Distinct runs of 9 to 18 digits, in order."""
    runs = F.regexp_extract_all(column, F.lit(r"\d+"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda r: F.length(r).between(9, 18)))


def masked_tails(column: Column) -> Column:
    """The last four digits after a mask of x or *, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(column, F.lit(r"(?i)[x*]{2,}\s*-?\s*(\d{4})(?!\d)"), F.lit(1)))


def leading_digits(names: Column) -> Column:
    """First four digits of file names that begin with them, years 20xx left out."""
    heads = F.transform(names, lambda n: F.regexp_extract(F.element_at(F.split(n, r"[/\\]"), -1), r"^(\d{4})", 1))
    return F.array_distinct(F.filter(heads, lambda h: (h != "") & ~F.startswith(h, F.lit("20"))))


def strip_html(column: Column) -> Column:
    """Tags out, &nbsp; and &amp; back, white space collapsed."""
    text = F.regexp_replace(column, "<[^>]*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, "&nbsp;", " "), "&amp;", "&")
    return collapse(text)


def first_link(column: Column, patterns: list[str]) -> Column:
    """The first match of the first pattern that matches at all."""
    return F.coalesce(*(F.nullif(F.regexp_extract(column, p, 0), F.lit("")) for p in patterns))


def message_id(column: Column) -> Column:
    """Lower case, without brackets and white space; empty is null."""
    return F.nullif(F.lower(F.regexp_replace(column, r"[<>\s]+", "")), F.lit(""))


def partition_path(*parts: Column) -> Column:
    return F.concat_ws("/", *(safe_name(p) for p in parts))


def sheet_name(bank: Column, account: Column) -> Column:
    """{bank}-{last four digits} without characters that sheets forbid, 31 characters at most."""
    return F.substring(F.regexp_replace(F.concat(bank, F.lit("-"), F.right(digits(account), F.lit(4))), r"[\[\]:*?/\\]", ""), 1, 31)


def is_cash(narration: Column) -> Column:
    text = F.lower(F.coalesce(narration, F.lit("")))
    has = lambda words: [F.contains(text, F.lit(w)) for w in words]
    yes, no = F.lit(False), F.lit(False)
    for c in has(CASH_WORDS):
        yes = yes | c
    for c in has(NOT_CASH_WORDS):
        no = no | c
    return yes & ~no


def split_narration(column: Column, width: int = 90) -> Column:
    """Struct (first, rest): up to `width` characters, cut at the last blank where there is one."""
    head = F.regexp_extract(column, rf"(?s)^(.{{1,{width}}})(?:\s|$)", 1)
    first = F.when(F.length(column) <= width, column).otherwise(F.coalesce(F.nullif(head, F.lit("")), F.substring(column, 1, width)))
    return F.struct(first.alias("first"), F.ltrim(F.substr(column, F.length(first) + 1)).alias("rest"))


def heal_numbers(column: Column) -> Column:
    """Join digits that white space split inside an amount: '1 234 . 50' becomes '1234.50'."""
    once = F.regexp_replace(column, r"(?<=[\d,])\s+(?=[\d.,])", "")
    return F.regexp_replace(once, r"(?<=\.)\s+(?=\d)", "")


def alias_key(column: Column) -> Column:
    """Lower case letters, digits and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(column), "[^a-z0-9]+", " "), " +", " "))


def squeezed(column: Column) -> Column:
    return F.regexp_replace(F.lower(column), "[^a-z0-9]+", "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def computed_once(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """df with fields behind a generator: filters are not pushed below it and their uses are not replaced by what they are made of."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in fields]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in fields.items())))))


def parse_money(column: Column, scale: int = 2) -> Column:
    """Amounts with thousands in any grouping, currency words, (x) and a Dr mark negative, '-' zero; else null.

    Texts without a digit are never cast, as each would cost an exception; plain numbers need one pattern only.
    """
    kind = f"decimal(18,{scale})"

    def amount(text: Column) -> Column:
        core = F.regexp_replace(text, r"(?i)(inr|rs\.?|₹|cr\.?$|dr\.?$|[,()\s+-])", "").try_cast(kind)
        negative = text.rlike(r"(?i)^\(.*\)$|dr\.?$|^-\s*[\d.]")
        plain = F.translate(text, ",", "").try_cast(kind)
        return F.when(text.rlike(r"^-?[0-9][0-9,]*(?:\.[0-9]+)?\z"), plain).when(text.rlike(r"\p{Nd}"), (core * F.when(negative, -1).otherwise(1)).cast(kind)).when(text.isin("-", "--") | text.rlike(r"(?i)^nil\z"), F.lit(0).cast(kind))

    return bound(strip(column), amount)


# Shapes of dates: day, month and year between equal marks; year first; month name first.
_DAY_FIRST = r"(?iu)^(\d{1,2})([-/. ])(\d{1,2}|[A-Z]{3}),?\2(\d{4}|\d{2})$"
_YEAR_FIRST = r"^\d{4}-\d{1,2}-\d{1,2}$"
_MONTH_FIRST = r"(?iu)^([A-Z]{3}) ?(\d{1,2}), ?(\d{4})$"
_MONTH_NUMBERS = {f"0{i}": i for i in range(1, 10)} | {f"{i}": i for i in range(1, 13)} | {form(MONTHS[3 * i : 3 * i + 3]): i + 1 for form in (str.title, str.upper) for i in range(12)}


def parse_date(column: Column) -> Column:
    """Dates as y-m-d, d-m-y (or / or . or blanks between), d-Mon-y and Mon d, y; day first, two-digit years are 20yy.

    Impossible dates and other shapes are null. One pattern tells the shape, its parts are read only where it fits, only a month's name in
    other letters is put in capitals, and no branch costs an exception; all of it is generated code.
    """
    text = strip(column)
    months = F.create_map(*(F.lit(x) for pair in _MONTH_NUMBERS.items() for x in (pair[0], str(pair[1]))))
    number = lambda m: F.coalesce(F.try_element_at(months, m), F.try_element_at(months, F.upper(m)))

    def date(pattern: str, day: int, month: int, year: int) -> Column:
        part = lambda i: F.regexp_extract(text, pattern, i)
        return F.concat(F.right(F.concat(F.lit("20"), part(year)), F.lit(4)), F.lit("-"), number(part(month)), F.lit("-"), part(day)).try_cast("date")

    return F.when(text.rlike(_DAY_FIRST), date(_DAY_FIRST, 1, 3, 4)).when(text.rlike(_YEAR_FIRST), text.try_cast("date")).when(text.rlike(_MONTH_FIRST), date(_MONTH_FIRST, 2, 1, 3))


def with_period(df: DataFrame, text: str, received: str) -> DataFrame:
    """start and end of 'period A to B' or 'from A to B' in a text column, in order; else the month before `received`."""
    day = r"(\d{1,4}[-/.](?:\d{1,2}|[A-Za-z]{3})[-/.]\d{2,4})"
    pattern = rf"(?i)(?:period|from)\s*:?\s*(?:from\s+)?{day}\s*(?:to|-)\s*{day}"
    found = df.withColumns({f"_{i}": parse_date(F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))) for i in (1, 2)})
    both = F.col("_1").isNotNull() & F.col("_2").isNotNull()
    start = F.when(both, F.least("_1", "_2")).otherwise(previous_month_start(F.col(received)))
    end = F.when(both, F.greatest("_1", "_2")).otherwise(previous_month_end(F.col(received)))
    return found.withColumns({"start": start, "end": end}).drop("_1", "_2")


def drcr(amount: Column) -> Column:
    """1,234.50 Dr or Cr by sign."""
    return F.concat(F.format_number(F.abs(amount), 2), F.when(amount < 0, " Dr").otherwise(" Cr"))


def best_attachment(attachments: Column) -> Column:
    """The first PDF, else the first spreadsheet, else the first, of an array of structs with content_type."""
    first = lambda kinds: F.get(F.filter(attachments, lambda a: a["content_type"].isin(kinds)), 0)
    return F.coalesce(first(PDF_TYPES), first(SHEET_TYPES), F.get(attachments, 0))


def promote_email(emails: Column, email: str) -> Column:
    """The list with one address moved or added to the front."""
    return F.array_prepend(F.array_remove(emails, email.lower()), F.lit(email.lower()))


def virtual_account(account: Column, virtual_type: Column) -> Column:
    """The account's own text, else Sales for type 1 and Purchase for type 2."""
    return F.coalesce(account, F.when(virtual_type == "1", "Sales").when(virtual_type == "2", "Purchase"), F.lit("-"))


def channel_of(mailbox: Column, channels: dict[str, str], default: str = "Mail") -> Column:
    out = F.lit(default)
    for part, label in reversed(list(channels.items())):
        out = F.when(F.contains(F.lower(mailbox), F.lit(part)), label).otherwise(out)
    return out


def split_long_narration(column: Column, whole: int = 400, width: int = 380) -> Column:
    """Struct (first, rest): texts of `whole` characters or fewer stay whole, others are cut at the last blank within `width`."""
    text = collapse(column)
    parts = split_narration(text, width)
    return F.when(F.length(text) <= whole, F.struct(text.alias("first"), F.lit("").alias("rest"))).otherwise(parts)


def pack_narration(lead: Column, tail: Column) -> Column:
    """Struct (first, second): a tail that is a reference, or has a word for one, stays apart, any other is joined to the lead."""
    def pack(parts: Column) -> Column:
        a, b = parts["a"], parts["b"]
        apart = b.rlike(REFERENCE_LIKE) | b.rlike(REFERENCE_WORD)
        both = F.struct(F.trim(F.concat_ws(" ", a, b)).alias("first"), F.lit("").alias("second"))
        return F.when(a == "", F.struct(b.alias("first"), F.lit("").alias("second"))).when(apart, F.struct(a.alias("first"), b.alias("second"))).otherwise(both)

    return bound(F.struct(collapse(F.coalesce(lead, F.lit(""))).alias("a"), collapse(F.coalesce(tail, F.lit(""))).alias("b")), pack)


def without_footer(column: Column) -> Column:
    """Links, disclaimers and what follows them out, white space collapsed."""
    return collapse(F.regexp_replace(column, FOOTER, ""))


def own_narration(column: Column) -> Column:
    """A narration without the next entry that ran into it: after TO SELF or BY CASH only a number stays, after UPI/DR or UPI/CR what comes before
    the next entry's first word."""
    text = F.trim(column)
    head, upi = F.regexp_extract(text, OWN_ENTRY, 1), F.regexp_extract(text, OWN_UPI, 1)
    return F.when(head != "", F.trim(head)).when(upi != "", F.trim(upi)).otherwise(text)


def rightmost_amount(column: Column) -> Column:
    """The last number with decimals, else the last with separators, else the last short whole number; long ones are references."""
    last = lambda pattern: F.try_element_at(F.regexp_extract_all(column, F.lit(pattern), F.lit(1)), F.lit(-1))
    return parse_money(F.coalesce(last(r"(?<![\d.,])(\d[\d,]*\.\d{2})(?!\d)"), last(r"(?<![\d.,])(\d{1,3}(?:,\d{2,3})+)(?![\d.])"), last(r"(?<![\d.,])(\d{1,6})(?![\d.,])")))


def attachments_text(attachments: Column) -> Column:
    """Names and paths of an array of structs with filename and path, in order, joined by blanks."""
    return F.array_join(F.flatten(F.transform(attachments, lambda a: F.array(a["filename"], a["path"]))), " ")


def webmail_link(mailbox: Column, msg_id: Column, subject: Column, sender: Column) -> Column:
    """Search link of the provider for a mail: by its message id, else by subject and sender; null if there is nothing to search for."""
    quoted = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    words = F.nullif(F.trim(F.concat_ws(" ", F.nullif(subject, F.lit("")), F.nullif(sender, F.lit("")))), F.lit(""))
    own = F.nullif(F.regexp_replace(F.trim(msg_id), r"^<(.*)>$", "$1"), F.lit(""))
    yahoo = F.concat(F.lit("https://mail.yahoo.com/d/search/?q="), quoted(F.coalesce(own, words)))
    base = F.lit("https://mail.google.com/mail/u/0/#search/")
    return F.when(F.contains(F.lower(mailbox), F.lit("yahoo")), yahoo).otherwise(F.coalesce(F.concat(base, F.lit("rfc822msgid%3A"), quoted(own)), F.concat(base, quoted(words))))


def virtual_type(account: Column) -> Column:
    """1 for an account text of Sales, 2 for Purchase; null for numbers and others."""
    text = F.lower(F.trim(account))
    return F.when(text.try_cast("double").isNotNull(), None).when(F.startswith(text, F.lit("sale")), "1").when(F.startswith(text, F.lit("purchase")), "2")


def local_date(timestamp: Column, zone: str = "Asia/Kolkata") -> Column:
    """The day of a UTC time in the office's zone."""
    return F.to_date(F.from_utc_timestamp(timestamp, zone))
