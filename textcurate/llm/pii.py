"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Validated numbers (payment cards, phone numbers, IPv4 addresses, US social security numbers), dates and e-mail names are
replaced by other valid ones of the same format. The replacement is a keyed permutation, a Feistel network over
the values the format allows, so equal values get equal pseudonyms in all documents and different values different ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KINDS = ("email", "ip", "date", "ssn", "phone", "card")

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
_IP = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])"
_ISO, _SLASH, _DOT = r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{2}/[0-9]{2}/[0-9]{4}", r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}"
_DATE = rf"(?<![0-9./-])(?:{_ISO}|{_SLASH}|{_DOT})(?![0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
# Written with +1 or an area in brackets a number is taken for one whatever its digits; bare, its area and exchange must
# be ones that North America gives out.
_WRITTEN = r"(?:\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])|\([0-9]{3}\) ?)[0-9]{3}[ .-][0-9]{4}"
_NANP = rf"(?:{_WRITTEN}|[2-9][0-9]{{2}}[ .-][2-9][0-9]{{2}}[ .-][0-9]{{4}})"
_PHONE = rf"(?<![0-9A-Za-z+])(?:{_NANP}|\+[1-9][0-9]{{7,14}})(?![0-9])"
_GROUPS = r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"
_CARD = rf"(?<![0-9A-Za-z-])(?:[0-9]{{13,19}}|{_GROUPS})(?![0-9A-Za-z]|-[0-9])"
_ANY = "|".join((_EMAIL, _IP, _DATE, _SSN, _PHONE, _CARD))

# Dates of these years are taken for dates; their number of days is 17 times 4297.
_FIRST_DAY, _DAYS = "1900-01-01", (17, 4297)
_FORMATS = ((_ISO, "yyyy-MM-dd"), (_SLASH, "MM/dd/yyyy"), (_DOT, "dd.MM.yyyy"))


def _noise(key: str, kind: str, i: Column, value: Column) -> Column:
    """Hexadecimal digits that depend on the key, the kind, the round and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), value), 256)


def _number(hexadecimal: Column, first: int | Column, digits: int) -> Column:
    return F.conv(F.substr(hexadecimal, F.lit(first) if isinstance(first, int) else first, F.lit(digits)), 16, 10).cast("long")


def _network(left: Column, right: Column, add: Callable[[Column, Column, Column, bool], Column]) -> Column:
    """Rounds change the halves in turn; ``add(half, other, round, is_left)`` is invertible in ``half``."""

    def step(halves: Column, i: Column) -> Column:
        l, r = halves["l"], halves["r"]
        changed_left = F.struct(add(l, r, i, True).alias("l"), r.alias("r"))
        changed_right = F.struct(l.alias("l"), add(r, l, i, False).alias("r"))
        return F.when(i % 2 == 1, changed_left).otherwise(changed_right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.alias("l"), right.alias("r")), step)


def permute_pair(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the pairs below ``a`` and ``b``: struct ``(l, r)`` of longs."""

    def add(half: Column, other: Column, i: Column, is_left: bool) -> Column:
        return (half + _number(_noise(key, kind, i, other.cast("string")), 1, 13)) % (a if is_left else b)

    return _network(left.cast("long"), right.cast("long"), add)


def permute_characters(text: Column, key: str, kind: str) -> Column:
    """A keyed permutation of strings of up to 64 characters; letters stay letters of their case, digits digits."""
    half = F.floor(F.length(text) / 2).cast("int")

    def shifted(c: Column, by: Column) -> Column:
        out = c
        for alphabet in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"):
            place = F.instr(F.lit(alphabet), c)
            moved = F.substr(F.lit(alphabet), ((place - 1 + by) % len(alphabet) + 1).cast("int"), F.lit(1))
            out = F.when(place > 0, moved).otherwise(out)
        return out

    def add(part: Column, other: Column, i: Column, is_left: bool) -> Column:
        noise = _noise(key, kind, i, other)
        places = F.filter(F.sequence(F.lit(0), F.length(part)), lambda j: j < F.length(part))
        moved = F.transform(
            places, lambda j: shifted(F.substr(part, j + 1, F.lit(1)), _number(noise, (j * 2 + 1).cast("int"), 2))
        )
        return F.array_join(moved, "")

    out = _network(F.substr(text, F.lit(1), half), F.substr(text, half + 1), add)
    return F.concat(out["l"], out["r"])


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _refill(hit: Column, digits: Column) -> Column:
    """``hit`` with its digits replaced, in order."""

    def step(state: Column, place: Column) -> Column:
        c = F.substr(hit, place, F.lit(1))
        is_digit = c.between("0", "9")
        put = F.when(is_digit, F.substr(digits, state["k"], F.lit(1))).otherwise(c)
        return F.struct(F.concat(state["out"], put).alias("out"), (state["k"] + is_digit.cast("int")).alias("k"))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    return F.aggregate(F.sequence(F.lit(1), F.length(hit)), start, step, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    """Sum of the digits from the right, every second doubled; a multiple of ten for a valid card."""

    def step(total: Column, place: Column) -> Column:
        d = F.substr(digits, F.length(digits) - place + 1, F.lit(1)).cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(place % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)


def _power(exponent: Column) -> Column:
    return F.rpad(F.lit("1"), exponent + 1, F.lit("0")).cast("long")


def _permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings of 2 to 18 digits of one length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    left, right = F.substr(digits, F.lit(1), half), F.substr(digits, half + 1)
    tag = F.concat(F.lit(kind), n.cast("string"))
    halves = _network(
        left.cast("long"),
        right.cast("long"),
        lambda h, o, i, is_left: (h + _number(_noise(key, kind, i, F.concat(tag, F.lit("|"), o.cast("string"))), 1, 13))
        % _power(half if is_left else n - half),
    )
    pad = lambda x, size: F.lpad(x.cast("string"), size, F.lit("0"))
    return F.transform(F.array(halves), lambda h: F.concat(pad(h["l"], half), pad(h["r"], n - half)))[0]


def _octets(hit: Column) -> Column:
    return F.transform(F.split(hit, r"\."), lambda o: o.cast("int"))


def _date(hit: Column) -> Column:
    found = F.lit(None).cast("date")
    for pattern, form in _FORMATS:
        found = F.when(hit.rlike(f"^{pattern}$"), F.try_to_timestamp(hit, F.lit(form)).cast("date")).otherwise(found)
    return found


def _written(hit: Column, day: Column) -> Column:
    out = hit
    for pattern, form in _FORMATS:
        out = F.when(hit.rlike(f"^{pattern}$"), F.date_format(day, form)).otherwise(out)
    return out


def kind_of(hit: Column) -> Column:
    """Name of the kind of a hit, or null where it is not valid."""

    def whole(pattern: str) -> Column:
        return hit.rlike(f"^(?:{pattern})$")

    d = _digits(hit)
    area, group, serial = F.substr(d, F.lit(1), F.lit(3)), F.substr(d, F.lit(4), F.lit(2)), F.substr(d, F.lit(6), F.lit(4))
    is_ssn = ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")
    year = F.year(_date(hit))
    return (
        F.when(F.contains(hit, F.lit("@")), "email")
        .when(whole(_IP), F.when(F.forall(_octets(hit), lambda o: o <= 255), "ip"))
        .when(whole(_DATE), F.when((year >= 1900) & (year <= 2099), "date"))
        .when(whole(_SSN), F.when(is_ssn, "ssn"))
        .when(whole(_PHONE), "phone")
        .when(whole(_CARD), F.when(_luhn(d) % 10 == 0, "card"))
    )


def pseudonym(hit: Column, kind: Column, key: str) -> Column:
    """The other valid value of the same format."""
    d = _digits(hit)
    name = F.substring_index(hit, "@", 1)
    email = F.concat(permute_characters(name, key, "email"), F.substr(hit, F.length(name) + 1))

    o = _octets(hit)
    address = permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")
    halves = [F.floor(address["l"] / 256), address["l"] % 256, F.floor(address["r"] / 256), address["r"] % 256]
    ip = F.concat_ws(".", *[h.cast("string") for h in halves])

    place = F.date_diff(_date(hit), F.lit(_FIRST_DAY).cast("date"))
    a, b = _DAYS
    day = permute_pair(F.floor(place / b), place % b, F.lit(a), F.lit(b), key, "date")
    date = _written(hit, F.date_add(F.lit(_FIRST_DAY).cast("date"), (day["l"] * b + day["r"]).cast("int")))

    part = lambda first, size: F.substr(d, F.lit(first), F.lit(size)).cast("int")
    # 898 areas (1 to 899 without 666), 99 groups, 9999 serials.
    area = part(1, 3) - 1 - F.when(part(1, 3) > 666, 1).otherwise(0)
    numbers = permute_pair(area, (part(4, 2) - 1) * 9999 + part(6, 4) - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    new_area = numbers["l"] + 1 + F.when(numbers["l"] >= 665, 1).otherwise(0)
    ssn = F.format_string(
        "%03d-%02d-%04d", new_area, F.floor(numbers["r"] / 9999) + 1, numbers["r"] % 9999 + 1
    )

    # North American numbers: area and exchange run from 200 to 999. Those below, written as numbers all the same, are
    # permuted among themselves: areas below 200, then exchanges below 200. Others keep two digits, the country's.
    national = F.substr(d, F.length(d) - 9)
    three = lambda first: F.substr(national, F.lit(first), F.lit(3)).cast("int")
    line = F.substr(national, F.lit(7), F.lit(4)).cast("int")
    low_area, low_exchange = three(1) < 200, three(4) < 200
    first_area, areas = F.when(low_area, 0).otherwise(200), F.when(low_area, 200).otherwise(800)
    first_exchange = F.when(low_area | low_exchange, 0).otherwise(200)
    exchanges = F.when(low_area, 1000).when(low_exchange, 200).otherwise(800)
    tail = (three(4) - first_exchange) * 10000 + line
    local = permute_pair(three(1) - first_area, tail, areas, exchanges * 10000, key, "phone")
    new_national = F.format_string(
        "%03d%03d%04d", local["l"] + first_area, F.floor(local["r"] / 10000) + first_exchange, local["r"] % 10000
    )
    nanp = _refill(hit, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), new_national))
    abroad = _refill(hit, F.concat(F.substr(d, F.lit(1), F.lit(2)), _permute_digits(F.substr(d, F.lit(3)), key, "abroad")))
    phone = F.when(hit.rlike(f"^(?:{_NANP})$"), nanp).otherwise(abroad)

    # The first digit (the network) stays, the last makes the sum right.
    inner = _permute_digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card")
    payload = F.concat(F.substr(d, F.lit(1), F.lit(1)), inner)
    with_check = lambda p: F.concat(p, ((10 - _luhn(F.concat(p, F.lit("0"))) % 10) % 10).cast("string"))
    card = _refill(hit, F.transform(F.array(payload), with_check)[0])

    made = {"email": email, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card}
    out = hit
    for name_of, value in made.items():
        out = F.when(kind == name_of, value).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, text, n_<kind>...)``: each whole text with its personal data replaced, and how many values of each kind.

    What looks like a number or date but is not valid stays as it is. A null text stays null with counts of 0. Repeated
    rows and ids each get their row, equal values equal pseudonyms; other columns are not read. Rows stay where they
    are, and there is no state. Who has the key can undo the permutation: keep it out of query texts that are logged.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_column), F.col(text_column).cast("string").alias("text"))
    # Most texts have neither a digit nor an at sign, and no further work.
    rows = rows.withColumn(
        "_hits",
        F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>")),
    )
    rows = rows.withColumn("_found", F.transform("_hits", lambda h: F.struct(kind_of(h).alias("kind"), h.alias("hit"))))
    new = F.transform("_found", lambda f: pseudonym(f["hit"], f["kind"], key))
    joined = F.array_join(
        F.zip_with(F.split(text, _ANY), F.concat(new, F.array(F.lit(""))), lambda gap, put: F.concat(gap, put)), ""
    )

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("_found", lambda f: f["kind"] == kind)), F.lit(0)).alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return rows.select(id_column, F.when(F.size("_hits") > 0, joined).otherwise(text).alias("text"), *counts)
