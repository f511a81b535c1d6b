"""PII pseudonyms by format-preserving Feistel permutations, DataFrame expressions only.

Numbers and dates that pass their check are permuted under a key within their format: card
numbers stay Luhn-valid with their issuer digits, IBANs keep country and valid check digits,
phone numbers stay dialable (those that are not so permute among themselves), addresses stay
addresses, dates stay dates in the same notation.
The permutation is a bijection per format, so equal values stay equal and different ones
different, in every document. A Feistel round adds a keyed hash of one half to the other; the
halves live in rings whose sizes multiply to the size of the format, so no value falls outside.

E-mail addresses and secrets have no such ring; they become a keyed hash in their own alphabet.

A text is cut at its finds by one pass of one pattern, only the finds are rewritten, and the
pieces are joined again, so the rest of a text stays byte for byte as it is.

Defined cases: null stays null, an empty text stays empty; numbers that fail their check stay;
repeated rows are treated alike; columns other than the text stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KEY = "local test key"

# A character that cannot be part of a find; doubled where a text holds it.
_CUT = "\ufdd0"

_PIECES = "__pieces"

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}"
_NAMED = r"(?i:passw(?:or)?d|pwd|secret|api[_\-]?key|token)[\"']?[ ]{0,2}[=:][ ]{0,2}[\"']?"
SECRET = (r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])|(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_\-]{20,}|xox[abp]-[A-Za-z0-9\-]{10,})"
          "|" + _NAMED + r"[A-Za-z0-9+/_\-]{8,}")
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}"
DATE = rf"(?<![0-9./\-])(?:{_DATE})(?![0-9]|[./\-][0-9])"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
CARD = r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])"
_PHONE = r"(?:\+1[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}"
PHONE = rf"(?<![0-9]){_PHONE}(?![0-9])"
ABROAD = r"(?<![0-9+])\+(?!1[ .\-(])[0-9](?:[ .\-]?[0-9]){7,14}(?![0-9])"
FIND = "|".join((EMAIL, SECRET, IBAN, DATE, ADDRESS, SSN, PHONE, ABROAD, CARD))
#: A text without any of these holds no find.
MAYBE = r"[0-9@=:]|AKIA|ASIA"


def _hash(key: str, kind: str, *parts: Column) -> Column:
    """60 bits of a keyed hash, as a number."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def permute(left: Column, right: Column, n_left: Column | int, n_right: Column | int, key: str, kind: str) -> Column:
    """A keyed bijection of pairs (left below n_left, right below n_right), as a struct."""
    n_left, n_right = (n if isinstance(n, Column) else F.lit(n) for n in (n_left, n_right))
    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        a = F.pmod(s["a"] + F.pmod(_hash(key, kind, i, s["b"]), n_left), n_left)
        b = F.pmod(s["b"] + F.pmod(_hash(key, kind, i, F.lit("r"), a), n_right), n_right)
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, turn)


def _padded(number: Column, width: Column) -> Column:
    return F.lpad(number.cast("string"), width, F.lit("0"))


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A keyed bijection of the digit strings of a length (up to 36)."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    b = n - a
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    # the length takes part in the hash: each length has a permutation of its own
    p = permute(F.coalesce(F.substring(digits, F.lit(1), a).cast("long"), F.lit(0)), F.substring(digits, a + 1, b).cast("long"),
                ten(a), ten(b), key, kind)
    return F.concat(F.when(a > 0, _padded(p["a"], a)).otherwise(""), _padded(p["b"], b))


def refill(shape: Column, characters: Column) -> Column:
    """The digits of ``shape`` replaced in turn by ``characters``."""
    step = F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
                       lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substring(characters, s["i"], F.lit(1))).alias("out"), (s["i"] + 1).alias("i")))
                       .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i"))))
    return step["out"]


def luhn_digit(payload: Column) -> Column:
    """The check digit that makes payload + digit pass Luhn's test."""
    chars = F.split(F.reverse(payload), "")
    total = F.aggregate(F.transform(chars, lambda c, i: F.when(
        i % 2 == 0, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int"))),
        F.lit(0), lambda s, x: s + x)
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def _mod97(text: Column) -> Column:
    """An IBAN's rest modulo 97, letters as 10 to 35, country and check digits at the end."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0).cast("long"), lambda s, c: F.when(
        c.rlike("^[0-9]$"), (s * 10 + c.cast("long")) % 97).otherwise((s * 100 + F.ascii(c).cast("long") - 55) % 97))


def _alike(text: Column, key: str, kind: str) -> Column:
    """A keyed hash with a character of the same class for each of ``text``; separators stay."""
    spun = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(i), text), 512) for i in range(2)])

    def at(c: Column, i: Column) -> Column:
        v = F.conv(F.substring(spun, (i * 2) % 254 + 1, F.lit(2)), 16, 10).cast("int")
        pick = lambda letters: F.substring(F.lit(letters), v % len(letters) + 1, F.lit(1))
        return (F.when(c.rlike("^[0-9]$"), pick("0123456789")).when(c.rlike("^[a-f]$"), pick("abcdef"))
                .when(c.rlike("^[a-z]$"), pick("ghijklmnopqrstuvwxyz")).when(c.rlike("^[A-F]$"), pick("ABCDEF"))
                .when(c.rlike("^[A-Z]$"), pick("GHIJKLMNOPQRSTUVWXYZ")).otherwise(c))

    return F.array_join(F.transform(F.split(text, ""), at), "")


# Days of 400 years, after which the calendar repeats: 189 * 773.
_CYCLE, _LEFT, _RIGHT = 146097, 189, 773


def _moved_day(day: Column, key: str) -> Column:
    """A keyed bijection of the days of each 400 years."""
    n = F.datediff(day, F.lit("1600-01-01").cast("date"))
    era, rest = F.floor(n / _CYCLE), F.pmod(n, F.lit(_CYCLE))
    p = permute(F.floor(rest / _RIGHT), rest % _RIGHT, _LEFT, _RIGHT, key, "date")
    return F.date_add(F.lit("1600-01-01").cast("date"), (era * _CYCLE + p["a"] * _RIGHT + p["b"]).cast("int"))


def _date(find: Column, key: str) -> Column:
    """A date moved; day first if that is a date, else month first; other notations stay."""
    mark = F.regexp_extract(find, "[./]", 0)
    parts = F.split(find, "[./]")
    two = lambda c: F.lpad(c, 2, "0")
    day_first = F.try_to_date(F.concat_ws("-", parts[2], two(parts[1]), two(parts[0])), "yyyy-MM-dd")
    month_first = F.try_to_date(F.concat_ws("-", parts[2], two(parts[0]), two(parts[1])), "yyyy-MM-dd")
    iso = F.try_to_date(F.when(mark == "", find).when(F.length(parts[0]) == 4, F.concat_ws("-", parts[0], two(parts[1]), two(parts[2]))), "yyyy-MM-dd")
    slash = F.when(day_first.isNotNull(), F.concat(F.date_format(_moved_day(day_first, key), "dd"), mark, F.date_format(_moved_day(day_first, key), "MM"), mark, F.date_format(_moved_day(day_first, key), "yyyy"))) \
        .when(month_first.isNotNull(), F.concat(F.date_format(_moved_day(month_first, key), "MM"), mark, F.date_format(_moved_day(month_first, key), "dd"), mark, F.date_format(_moved_day(month_first, key), "yyyy")))
    return F.coalesce(F.when((mark == "") | (F.length(parts[0]) == 4), F.replace(F.date_format(_moved_day(iso, key), "yyyy-MM-dd"), F.lit("-"), F.when(mark == "", "-").otherwise(mark))).otherwise(slash), find)


def _dialable(find: Column, key: str) -> Column:
    """A North American number: area and exchange start with 2 to 9, so 800 * 800 * 10000. Those
    of the same form that do not have two rings of their own: by area codes below 200, and by
    exchanges below 200 after other area codes."""
    country = F.regexp_extract(find, r"^\+1[ .\-]?", 0)
    local = F.substring(find, F.length(country) + 1, F.length(find))
    d = F.regexp_replace(local, "[^0-9]", "")
    area, office, line = (F.substring(d, a, n).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))

    def within(least_area: int, least_office: int, offices: int, left: int, right: int) -> Column:
        value = ((area - least_area) * offices + office - least_office) * 10000 + line
        p = permute(F.floor(value / right), value % right, left, right, key, "phone")
        moved = p["a"] * right + p["b"]
        return refill(local, F.concat(_padded(F.floor(moved / (offices * 10000)) + least_area, F.lit(3)),
                                      _padded(F.floor(moved / 10000) % offices + least_office, F.lit(3)), _padded(moved % 10000, F.lit(4))))

    return F.concat(country, F.when(area < 200, within(0, 0, 1000, 40_000, 50_000)).when(office < 200, within(200, 0, 200, 40_000, 40_000))
                    .otherwise(within(200, 200, 800, 80_000, 80_000)))


def _address(find: Column, key: str) -> Column:
    p4 = F.transform(F.split(find, r"\."), lambda x: x.cast("long"))
    p = permute(p4[0] * 256 + p4[1], p4[2] * 256 + p4[3], 65536, 65536, key, "address")
    return F.when(F.array_max(p4) < 256, F.concat_ws(
        ".", *[f.cast("string") for f in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)])).otherwise(find)


def _card(find: Column, key: str) -> Column:
    d = F.regexp_replace(find, "[^0-9]", "")
    n = F.length(d)
    body = F.substring(d, F.lit(1), n - 1)
    valid = (luhn_digit(body) == F.substring(d, n, F.lit(1))) & ~d.rlike("^0+$")
    moved = F.concat(F.substring(body, 1, 6), permute_digits(F.substring(body, F.lit(7), n - 7), key, "card"))
    return F.when(valid, refill(find, F.concat(moved, luhn_digit(moved)))).otherwise(find)


def _iban(find: Column, key: str) -> Column:
    s = F.regexp_replace(find, " ", "")
    account = F.substring(s, F.lit(5), F.length(s))
    digits = F.regexp_replace(account, "[^0-9]", "")
    moved = refill(account, permute_digits(digits, key, "iban"))
    check = _padded(98 - _mod97(F.concat(F.substring(s, 1, 2), F.lit("00"), moved)), F.lit(2))
    body = F.concat(check, F.regexp_replace(moved, "[^0-9]", ""))
    keep = F.concat(F.substring(find, 1, 2), refill(F.substring(find, F.lit(3), F.length(find)), body))
    return F.when((_mod97(s) == 1) & (F.length(digits) >= 4), keep).otherwise(find)


def pseudonym(find: Column, key: str = KEY) -> Column:
    """What stands for a find of :data:`FIND`. The kinds are told apart by their form alone."""
    is_a = lambda p: find.rlike(f"^(?:{p})$")
    digits = F.regexp_replace(find, "[^0-9]", "")
    secret_name = F.regexp_extract(find, f"^(?:{_NAMED}|AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-)", 0)
    return (F.when(find.contains("@"), F.concat(_alike(F.substring_index(find, "@", 1), key, "mail"), F.lit("@"),
                                                _alike(F.substring_index(find, "@", -1), key, "host")))
            .when(is_a(_DATE), _date(find, key))
            .when(is_a(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"), _address(find, key))
            .when(is_a(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), refill(find, permute_digits(digits, key, "ssn")))
            .when(is_a(_PHONE), _dialable(find, key))
            .when(is_a(r"\+[0-9](?:[ .\-]?[0-9]){7,14}"), F.concat(F.substring(find, 1, 3), refill(
                F.substring(find, F.lit(4), F.length(find)), permute_digits(F.regexp_replace(F.substring(find, F.lit(4), F.length(find)), "[^0-9]", ""), key, "abroad"))))
            .when(is_a(r"[0-9](?:[ \-]?[0-9]){12,18}"), _card(find, key))
            .when(is_a(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"), _iban(find, key))
            .otherwise(F.concat(secret_name, _alike(F.substring(find, F.length(secret_name) + 1, F.length(find)), key, "secret"))))


def pieces(text: Column) -> Column:
    """The text cut at its finds: those stand at the odd places."""
    safe = F.when(text.contains(_CUT), F.replace(text, F.lit(_CUT), F.lit(_CUT * 2))).otherwise(text)
    return F.split(F.regexp_replace(safe, f"({FIND})", f"{_CUT}$1{_CUT}"), _CUT, -1)


def _with_pieces(docs: DataFrame, column: str) -> DataFrame:
    text = F.col(column)
    return docs.withColumn(_PIECES, F.when(text.rlike(MAYBE), pieces(text)).otherwise(F.array(text)))


def _joined(key: str) -> Column:
    return F.array_join(F.transform(_PIECES, lambda p, i: F.when(i % 2 == 0, p).when(p == "", F.lit(_CUT)).otherwise(pseudonym(p, key))), "")


def pseudonymise(docs: DataFrame, key: str = KEY, column: str = "text") -> DataFrame:
    """``docs`` with the finds in ``column`` replaced, all else as it is."""
    return (_with_pieces(docs, column)
            .withColumn(column, F.when(F.size(_PIECES) == 1, F.col(column)).otherwise(_joined(key)))
            .select(*docs.columns))


def report(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Per document: doc_id, text as rewritten and n_found, the finds of the pattern in it."""
    odd = F.filter(_PIECES, lambda p, i: (i % 2 == 1) & (p != ""))
    return (_with_pieces(docs.select("doc_id", "text"), "text")
            .select("doc_id", F.when(F.size(_PIECES) == 1, F.col("text")).otherwise(_joined(key)).alias("text"),
                    F.size(odd).alias("n_found")))
