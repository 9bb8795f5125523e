"""Format-preserving pseudonyms of personal data, in DataFrame functions only.

A text is cut at every candidate (e-mail address, IPv4 address, telephone, card or social
security number, date, secret after a keyword). Candidates are validated: card numbers by their
check digit, addresses and numbers by their ranges, dates by the calendar. Valid numbers and
dates go through a keyed Feistel network over their own format: the pseudonym is a valid value of
the same format, equal values get equal pseudonyms in every document, different values different
ones, and ``invert=True`` with the same key gives the text back. E-mail addresses and secrets,
which have no small format, get a keyed digest of the same shape (not invertible).

The key never enters a plan: each kind of value has a key of its own, the HMAC of the kind under
the key, and digests are HMACs under that. What a plan or an event log shows are these derived
keys, padded; whoever reads them can undo pseudonyms, so plans are as secret as the key's use, but
the key itself and its other uses stay unknown.

Defined results: a null text stays null and counts no values; texts without candidates stay as
they are, byte for byte; texts of any length are searched whole; invalid candidates are left
alone; equal and repeated texts get equal results; extra columns are dropped unless named in
``keep``, where one with the name of a result is replaced by it; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.payload import hmac_hex
from .common import name_beside, text_rows

ROUNDS = 8
#: Days of the calendar's 400-year cycle, which are 189 x 773; cycles are counted from 1800.
CYCLE, CYCLE_A, CYCLE_B, EPOCH = 146_097, 189, 773, "1800-01-01"

EMAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,12})"
PHONE = r"(?<![\w+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![\w(.-])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
#: Ten digits with dashes or dots, and international numbers of 8 to 15 digits.
PLAIN_PHONE = r"(?<![\w(.+-])(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![\w]|[.-][0-9])"
ABROAD = r"(?<![\w+])\+[2-9](?:[ .-]?[0-9]){7,14}(?![0-9])"
ISO_DATE = r"(?<![\w./-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?=T[0-9]{2})|(?![\w/]|-[0-9]|\.[0-9]))"
TURNED_DATE = r"(?<![\w./-])(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\w/]|-[0-9]|\.[0-9])"
ADDRESS = r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])"
SOCIAL = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w]|-[0-9])"
CARD = r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w]|[.-][0-9])"
#: Hexadecimal of 12 digits or more, or eight characters or more with a digit among them.
SECRET = r"(?i:password|passwd|token|secret|api_key|apikey) {0,3}[=:] {0,3}[\"']?(?:[A-Fa-f0-9]{12,}+(?!\w)|(?=[^\s\"'<>,;]*[0-9])[^\s\"'<>,;]{7,}[^\s\"'<>,;.:!?)])"
#: Nothing begins inside a word, so most places of a text are left at once.
ANY = r"(?<!\w)(?:" + "|".join((EMAIL, PHONE, PLAIN_PHONE, ABROAD, ISO_DATE, TURNED_DATE, ADDRESS, SOCIAL, SECRET, CARD)) + ")"


def _keyed(key: str, kind: str, *parts: Column) -> Column:
    """HMAC of the parts, in hex, under a key that was derived for the kind."""
    own = hmac.new(key.encode(), kind.encode(), hashlib.sha256).hexdigest()
    return hmac_hex(own, F.concat_ws("|", *[p.cast("string") for p in parts]))


def feistel(a: Column, b: Column, size_a: int | Column, size_b: int | Column, key: str, kind: str, invert: bool = False) -> Column:
    """A keyed permutation of pairs (a, b) with 0 <= a < size_a and 0 <= b < size_b: the halves
    take turns, each being moved by a digest of the other. Struct of the new a and b."""
    sizes = [s if isinstance(s, Column) else F.lit(s).cast("bigint") for s in (size_a, size_b)]

    def move(value: Column, other: Column, size: Column, turn: Column) -> Column:
        by = F.conv(F.substring(_keyed(key, kind, turn, other), 1, 14), 16, 10).cast("bigint") % size
        return F.pmod(value - by if invert else value + by, size)

    def turn(now: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, move(now["a"], now["b"], sizes[0], i)).otherwise(now["a"]).alias("a"),
            F.when(even, now["b"]).otherwise(move(now["b"], now["a"], sizes[1], i)).alias("b"),
        )

    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if invert else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(turns, F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), turn)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _number(text: Column, at: int | Column, size: int | Column) -> Column:
    part = F.substring(text, at, size) if isinstance(at, int) and isinstance(size, int) else text.substr(at if isinstance(at, Column) else F.lit(at), size if isinstance(size, Column) else F.lit(size))
    return part.cast("bigint")


def _padded(value: Column, size: int | Column) -> Column:
    digits = value.cast("string")
    return F.lpad(digits, size, "0") if isinstance(size, int) else F.concat(F.repeat(F.lit("0"), size - F.length(digits)), digits)


def _into(shape: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``shape``."""

    def put(now: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(now["out"], F.when(is_digit, digits.substr(now["i"], F.lit(1))).otherwise(c)).alias("out"), (now["i"] + is_digit.cast("int")).alias("i"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), put)["out"]


def luhn_sum(digits: Column) -> Column:
    """Sum of a number with the check digit's weights: the last digit has weight one."""

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _card(m: Column, digits: Column, key: str, invert: bool) -> Column:
    """First digit kept, middle digits permuted, check digit made to fit."""
    middle = F.length(digits) - 2
    left = (middle / 2).cast("int")
    right = middle - left
    power = lambda n: F.pow(F.lit(10.0), n).cast("bigint")
    new = feistel(_number(digits, F.lit(2), left), _number(digits, F.lit(2) + left, right), power(left), power(right), key, "card", invert)
    body = _let(new, lambda n: F.concat(F.substring(digits, 1, 1), _padded(n["a"], left), _padded(n["b"], right)))
    check = lambda x: F.pmod(-luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")
    return _into(m, _let(body, lambda x: F.concat(x, check(x))))


def _phone(m: Column, digits: Column, key: str, invert: bool) -> Column:
    """Area and exchange codes stay in 200..999."""
    last = F.substring(digits, -10, 10)
    area, exchange = _number(last, 1, 3) - 200, _number(last, 4, 3) - 200
    new = feistel(area * 100 + _number(last, 7, 2), exchange * 100 + _number(last, 9, 2), 80_000, 80_000, key, "phone", invert)
    codes = lambda x: _padded((x / 100).cast("bigint") + 200, 3)
    moved = _let(new, lambda n: F.concat(codes(n["a"]), codes(n["b"]), _padded(n["a"] % 100, 2), _padded(n["b"] % 100, 2)))
    return _into(m, F.concat(F.when(F.length(digits) > 10, "1").otherwise(""), moved))


def _abroad(m: Column, digits: Column, key: str, invert: bool) -> Column:
    """The first three digits, which hold the country code, are kept."""
    many = F.length(digits) - 3
    left = (many / 2).cast("int")
    right = many - left
    power = lambda n: F.pow(F.lit(10.0), n).cast("bigint")
    new = feistel(_number(digits, F.lit(4), left), _number(digits, F.lit(4) + left, right), power(left), power(right), key, "abroad", invert)
    return _into(m, _let(new, lambda n: F.concat(F.substring(digits, 1, 3), _padded(n["a"], left), _padded(n["b"], right))))


def _address(m: Column, key: str, invert: bool) -> Column:
    octet = [F.split(m, r"\.")[i].cast("bigint") for i in range(4)]
    new = feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], 65_536, 65_536, key, "ip", invert)
    return _let(new, lambda n: F.concat_ws(".", (n["a"] / 256).cast("bigint"), n["a"] % 256, (n["b"] / 256).cast("bigint"), n["b"] % 256))


def _social(m: Column, digits: Column, key: str, invert: bool) -> Column:
    """Area 001..899 but 666, group 01..99, serial 0001..9999 stay in their ranges."""
    area = _number(digits, 1, 3)
    area = F.when(area > 666, area - 2).otherwise(area - 1)
    new = feistel(area * 99 + _number(digits, 4, 2) - 1, _number(digits, 6, 4) - 1, 898 * 99, 9999, key, "ssn", invert)
    code = lambda n: (n["a"] / 99).cast("bigint")
    return _let(new, lambda n: F.concat_ws("-", _padded(F.when(code(n) > 664, code(n) + 2).otherwise(code(n) + 1), 3), _padded(n["a"] % 99 + 1, 2), _padded(n["b"] + 1, 4)))


def _date(day: Column, key: str, invert: bool) -> Column:
    """Another day of the same 400-year cycle."""
    number = F.date_diff(day, F.lit(EPOCH).cast("date")).cast("bigint")
    place = F.pmod(number, F.lit(CYCLE))
    new = feistel((place / CYCLE_B).cast("bigint"), place % CYCLE_B, CYCLE_A, CYCLE_B, key, "date", invert)
    return F.date_add(F.lit(EPOCH).cast("date"), (number - place + _let(new, lambda n: n["a"] * CYCLE_B + n["b"])).cast("int"))


def _email(m: Column, key: str) -> Column:
    """A digest for the name and one for the domain, so that both stay linked."""
    name, domain = F.substring_index(m, "@", 1), F.lower(F.substring_index(m, "@", -1))
    return F.concat(F.lit("u"), F.substring(_keyed(key, "name", F.lower(m)), 1, 12), F.lit("@d"), F.substring(_keyed(key, "domain", domain), 1, 8), F.lit(".invalid"))


def pseudonym(m: Column, key: str, invert: bool = False) -> Column:
    """Struct of the kind of a candidate, null if it isn't valid, and what stands for it."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    iso, dotted, slashed = (F.try_to_date(m, f) for f in ("yyyy-MM-dd", "d.M.yyyy", "M/d/yyyy"))
    year = F.regexp_extract(m, "[0-9]{4}", 0)
    in_cycles = year.between("1000", "9399")
    moved = lambda d, two, one: F.when(F.length(m) == 10, F.date_format(_date(d, key, invert), two)).otherwise(F.date_format(_date(d, key, invert), one))
    octets = F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)
    area = F.substring(digits, -10, 3)
    found = lambda kind, new: F.struct(F.lit(kind).alias("kind"), new.alias("new"))
    hexed = F.regexp_extract(m, "[=:] {0,3}[\"']?(.*)$", 1)
    digest = F.concat(*[_keyed(key, f"secret{i}", hexed) for i in range(2)]).substr(F.lit(1), F.length(hexed))
    secret = F.concat(m.substr(F.lit(1), F.length(m) - F.length(hexed)), digest)
    whole = lambda pattern: m.rlike(rf"^(?:{pattern})$")
    return (
        F.when(m.rlike("[=:]"), found("secret", F.lit(None).cast("string") if invert else secret))
        .when(m.contains("@"), found("email", F.lit(None).cast("string") if invert else _email(m, key)))
        .when(whole(r"\+[2-9].*"), found("phone", _abroad(m, digits, key, invert)))
        .when(whole(r"\+1.*|\([0-9]{3}\).*|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"), F.when((area >= "200") & (F.substring(digits, -7, 3) >= "200"), found("phone", _phone(m, digits, key, invert))))
        .when(whole("[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.when(iso.isNotNull() & in_cycles, found("date", F.date_format(_date(iso, key, invert), "yyyy-MM-dd"))))
        .when(m.contains("/"), F.when(slashed.isNotNull() & in_cycles, found("date", moved(slashed, "MM/dd/yyyy", "M/d/yyyy"))))
        .when(whole(r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"), F.when(dotted.isNotNull() & in_cycles, found("date", moved(dotted, "dd.MM.yyyy", "d.M.yyyy"))))
        .when(m.contains("."), F.when(octets, found("ip", _address(m, key, invert))))
        .when(whole("[0-9]{3}-[0-9]{2}-[0-9]{4}"), F.when(~F.substring(digits, 1, 3).isin("000", "666") & (F.substring(digits, 1, 1) < "9") & (F.substring(digits, 4, 2) > "00") & (F.substring(digits, 6, 4) > "0000"), found("ssn", _social(m, digits, key, invert))))
        .otherwise(F.when(luhn_sum(digits) % 10 == 0, found("card", _card(m, digits, key, invert))))
    )


def pseudonymise(df: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), invert: bool = False) -> DataFrame:
    """``keep`` columns, ``text`` with pseudonyms, ``n_private`` and ``kinds`` (of the values)."""
    keep, source, rows = text_rows(df, keep, text, "text string, n_private bigint, kinds string")
    found_, new_ = name_beside((*keep, source), "_found"), name_beside((*keep, source), "_new")
    may = F.col(source).rlike("[0-9@]|(?i:password|passwd|token|secret|api_?key) {0,3}[=:]")
    kept = [F.col(f"`{c}`") for c in keep]
    found = rows.select(*kept, source, F.when(may, F.regexp_extract_all(source, F.lit(ANY), F.lit(0))).alias(found_))
    named = found.select(*kept, source, found_, F.when(F.size(found_) > 0, F.transform(found_, lambda m: pseudonym(m, key, invert))).alias(new_))
    pieces = F.zip_with(F.split(source, ANY, -1), F.zip_with(found_, new_, lambda m, n: F.coalesce(n["new"], m)), lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))))
    kinds = F.filter(F.transform(new_, lambda n: n["kind"]), lambda k: k.isNotNull())
    return named.select(
        *kept,
        F.when(F.col(new_).isNull(), F.col(source)).otherwise(F.array_join(pieces, "")).alias("text"),
        F.when(F.col(new_).isNull(), 0).otherwise(F.size(kinds)).cast("bigint").alias("n_private"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(kinds)), ","), F.lit("")).alias("kinds"),
    )
