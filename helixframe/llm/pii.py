"""Personal data: format-preserving pseudonyms by keyed Feistel networks, in DataFrame expressions only.

What is found, and what must hold for it to be replaced:

    email   an address; letters and digits of the local part are permuted, the domain stays
    card    13 to 19 digits, plain or in the usual groups, with a right Luhn digit; the last digit is computed anew
    phone   numbers with an area code in brackets, with a + and a country code, or as 3-3-4; the country code stays
    ssn     3-2-4 with possible area, group and serial; the pseudonym is possible too
    iban    right modulo 97; letters and digits of the account are permuted, check digits are computed anew
    ip      four numbers to 255
    date    real days of the years 1900 to 2099 as Y-M-D, Y/M/D, M/D/Y, D/M/Y (day over 12) or D.M.Y
    secret  access key ids of the form AKIA + 16, and 40 hex digits of either case: letters and digits are permuted

A network has ROUNDS rounds on a pair (l, r) in Z_a x Z_b: l += F(r) mod a and r += F(l) mod b in turn, with F from
SHA-256 of the key, the kind and its size, and the round. That is a permutation of Z_ab, so equal values stay equal in all
documents, different ones stay different, and ``reveal`` with the key takes everything back. Where a format allows part
of the domain only, the walk goes on until it meets an allowed value again.

Defined results: null text stays null with 0 found; empty text stays empty; what does not validate stays as it is; equal
values have equal pseudonyms whatever their separators and case (dates: within one notation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import bound

ROUNDS = 10
LOWER = "abcdefghijklmnopqrstuvwxyz"
_DAYS = 17 * 4297  # 1900-01-01 to 2099-12-31
_AREAS, _GROUPS, _SERIALS = 898, 99, 9999  # areas 1 to 899 but 666

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|[0-9A-Fa-f]{40})(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = r"(?<![0-9A-Za-z+])(?:(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,5}|\+[0-9]{9,14}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4})(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\3[0-9]{5})(?![0-9])"
ANY = "|".join((EMAIL, SECRET, IBAN, DATE, IP, SSN, PHONE, CARD))
_PLAIN_CARD = CARD.replace(r"\2", r"\1").replace(r"\3", r"\2")

_num = lambda c: c.cast("long")


def _noise(key: str, tag: Column, i: Column, x: Column) -> Column:
    """60 bits of SHA-256."""
    return _num(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), tag, i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10))


def feistel(left: Column, right: Column, a: Column, b: Column, tag: Column, key: str, back: bool = False) -> Column:
    """struct(l, r): the permutation of Z_a x Z_b, or with ``back`` its inverse."""
    sign = -1 if back else 1

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(s["l"] + sign * F.pmod(_noise(key, tag, i, s["r"]), a), a)).otherwise(s["l"]).alias("l"),
            F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + sign * F.pmod(_noise(key, tag, i, s["l"]), b), b)).alias("r"),
        )

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, F.struct(_num(left).alias("l"), _num(right).alias("r")), step)


def _power(base: int, n: Column) -> Column:
    return F.get(F.array(*(F.lit(base**k) for k in range(10))), n)


def _number(s: Column, alphabet: str) -> Column:
    if alphabet == "0123456789":
        return F.when(s == "", F.lit(0)).otherwise(_num(s))
    return F.aggregate(F.sequence(F.lit(0), F.length(s)), F.lit(0).cast("long"), lambda acc, i: F.when(i == 0, acc).otherwise(acc * len(alphabet) + F.instr(F.lit(alphabet), F.substring(s, i, F.lit(1))) - 1))


def _digits_of(x: Column, n: Column, alphabet: str) -> Column:
    if alphabet == "0123456789":
        return F.when(n == 0, F.lit("")).otherwise(F.lpad(x.cast("string"), n, F.lit("0")))
    letters = F.transform(F.sequence(n, F.lit(0), F.lit(-1)), lambda i: F.when(i == 0, F.lit("")).otherwise(F.substring(F.lit(alphabet), F.pmod(F.call_function("div", x, _power(len(alphabet), i - 1)), F.lit(len(alphabet))) + 1, F.lit(1))))
    return F.array_join(letters, "")


def permute_text(s: Column, alphabet: str, tag: Column, key: str, back: bool = False) -> Column:
    """A text over ``alphabet``, of any length, permuted among the texts of its length (by stretches of at most 18)."""

    def stretch(k: Column) -> Column:
        return bound(F.substring(s, k * 18 + 1, F.lit(18)), lambda part: bound(
            F.struct(part.alias("p"), F.ceil(F.length(part) / 2).cast("int").alias("nl")), lambda q: bound(
                F.struct(q["nl"].alias("nl"), (F.length(q["p"]) - q["nl"]).alias("nr"), feistel(
                    _number(F.substring(q["p"], F.lit(1), q["nl"]), alphabet), _number(F.substring(q["p"], q["nl"] + 1, F.lit(18)), alphabet),
                    _power(len(alphabet), q["nl"]), _power(len(alphabet), F.length(q["p"]) - q["nl"]),
                    F.concat_ws("/", tag, F.length(s).cast("string"), k.cast("string")), key, back).alias("x")),
                lambda y: F.concat(_digits_of(y["x"]["l"], y["nl"], alphabet), _digits_of(y["x"]["r"], y["nr"], alphabet)))))

    return F.when(s == "", s).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.call_function("div", F.length(s) - 1, F.lit(18)).cast("int")), stretch), ""))


def _only(s: Column, pattern: str) -> Column:
    return F.regexp_replace(s, pattern, "")


def refill(shape: Column, digits: Column, letters: Column | None = None) -> Column:
    """``shape`` with its digits, and its letters in their case, replaced in order by those given; the rest stays."""

    def put(i: Column) -> Column:
        c, before = F.substring(shape, i, F.lit(1)), F.substring(shape, F.lit(1), i - 1)
        out = F.when(c.rlike("[0-9]"), F.substring(digits, F.length(_only(before, "[^0-9]")) + 1, F.lit(1)))
        if letters is not None:
            new = F.substring(letters, F.length(_only(before, "[^A-Za-z]")) + 1, F.lit(1))
            out = out.when(c.rlike("[a-z]"), new).when(c.rlike("[A-Z]"), F.upper(new))
        return out.otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), put), "")


def _both(s: Column, kind: str, key: str, back: bool, alphabet: str = LOWER) -> Column:
    """Letters and digits of ``s`` permuted, each among themselves."""
    return bound(F.struct(s.alias("s"), permute_text(_only(s, "[^0-9]"), "0123456789", F.lit(kind), key, back).alias("d"), permute_text(F.lower(_only(s, "[^A-Za-z]")), alphabet, F.lit(kind), key, back).alias("c")), lambda x: refill(x["s"], x["d"], x["c"]))


def luhn_sum(digits: Column) -> Column:
    """Sum for the Luhn test; the last digit counts once."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return acc + F.when((n - i) % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(m: Column, key: str, back: bool) -> Column:
    def new(digits: Column) -> Column:
        return bound(permute_text(F.substring(digits, F.lit(1), F.length(digits) - 1), "0123456789", F.lit("card"), key, back), lambda p: F.concat(p, F.pmod(10 - luhn_sum(F.concat(p, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    return bound(_only(m, "[^0-9]"), lambda d: F.when(luhn_sum(d) % 10 == 0, bound(new(d), lambda n: refill(m, n))).otherwise(m))


def _phone(m: Column, key: str, back: bool) -> Column:
    code = F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[ .(-])|\+[0-9]|[0-9]{1,3}(?=[ .-]?\())?", 0)
    return bound(code, lambda c: F.concat(c, bound(F.substring(m, F.length(c) + 1, F.lit(64)), lambda r: bound(permute_text(_only(r, "[^0-9]"), "0123456789", F.lit("phone"), key, back), lambda d: refill(r, d)))))


def _ssn(m: Column, key: str, back: bool) -> Column:
    part = lambda k: F.split_part(m, F.lit("-"), F.lit(k)).cast("long")
    fits = (part(1) > 0) & (part(1) < 900) & (part(1) != 666) & (part(2) > 0) & (part(3) > 0)
    area = F.when(part(1) > 666, part(1) - 2).otherwise(part(1) - 1)

    def write(x: Column) -> Column:
        a = F.call_function("div", x["l"], F.lit(_GROUPS)) + 1
        return F.format_string("%03d-%02d-%04d", F.when(a >= 666, a + 1).otherwise(a), x["l"] % _GROUPS + 1, x["r"] + 1)

    return F.when(fits, bound(feistel(area * _GROUPS + part(2) - 1, part(3) - 1, _num(F.lit(_AREAS * _GROUPS)), _num(F.lit(_SERIALS)), F.lit("ssn"), key, back), write)).otherwise(m)


def _ip(m: Column, key: str, back: bool) -> Column:
    part = lambda k: F.split_part(m, F.lit("."), F.lit(k)).cast("long")
    fits = (part(1) < 256) & (part(2) < 256) & (part(3) < 256) & (part(4) < 256) & ~m.rlike(r"(^|\.)0[0-9]")
    byte = lambda v, k: F.call_function("div", v, F.lit(256)) % 256 if k else v % 256
    size = _num(F.lit(65536))
    return F.when(fits, bound(feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), size, size, F.lit("ip"), key, back), lambda x: F.concat_ws(".", byte(x["l"], 1), byte(x["l"], 0), byte(x["r"], 1), byte(x["r"], 0)))).otherwise(m)


def iban_rest(text: Column) -> Column:
    """Remainder modulo 97 of an IBAN without spaces, first four characters moved to the end."""

    def add(acc: Column, c: Column) -> Column:
        d = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (F.when(d > 9, acc * 100 + d).otherwise(acc * 10 + d) % 97).cast("int")

    turned = F.concat(F.substring(text, F.lit(5), F.lit(40)), F.substring(text, F.lit(1), F.lit(4)))
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add)


def _iban(m: Column, key: str, back: bool) -> Column:
    def new(t: Column) -> Column:
        account = _both(F.substring(t, F.lit(5), F.lit(40)), "iban", key, back)
        return bound(account, lambda a: F.concat(F.substring(t, F.lit(1), F.lit(2)), F.lpad((98 - iban_rest(F.concat(F.substring(t, F.lit(1), F.lit(2)), F.lit("00"), a))).cast("string"), 2, "0"), a))

    def spaced(n: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(F.substring(m, i, F.lit(1)) == " ", F.lit(" ")).otherwise(F.substring(n, F.length(_only(F.substring(m, F.lit(1), i - 1), " ")) + 1, F.lit(1)))), "")

    return bound(_only(m, " "), lambda t: F.when((F.length(t) >= 15) & (F.length(t) <= 34) & (iban_rest(t) == 1) & F.substring(t, F.lit(3), F.lit(2)).between("02", "98"), bound(new(t), spaced)).otherwise(m))


def _date(m: Column, key: str, back: bool) -> Column:
    sep = F.when(m.contains("-"), F.lit("-")).when(m.contains("/"), F.lit("/")).otherwise(F.lit("."))
    part = lambda k: F.split_part(m, sep, F.lit(k)).cast("int")
    year_first = F.substring(m, F.lit(5), F.lit(1)).isin("-", "/")
    day_first = ~year_first & ((sep == ".") | (part(1) > 12))
    narrow = ~year_first & (sep == "/") & (part(1) > 12)  # D/M/Y, which is one only while the day is over 12
    y, mo, d = F.when(year_first, part(1)).otherwise(part(3)), F.when(day_first | year_first, part(2)).otherwise(part(1)), F.when(year_first, part(3)).when(day_first, part(1)).otherwise(part(2))
    day = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, mo, d), F.lit("yyyy-MM-dd")).cast("date")
    start = F.lit("1900-01-01").cast("date")
    facts = F.struct(F.datediff(day, start).alias("n"), year_first.alias("yf"), day_first.alias("df"), narrow.alias("nw"), sep.alias("sep"))

    def walked(f: Column) -> Column:
        def once(n: Column) -> Column:
            return bound(feistel(F.call_function("div", n, F.lit(4297)), n % 4297, _num(F.lit(17)), _num(F.lit(4297)), F.when(f["nw"], F.lit("date-d")).otherwise(F.lit("date")), key, back), lambda x: x["l"] * 4297 + x["r"])

        def go(acc: Column, i: Column) -> Column:
            more = (i == 1) | (f["nw"] & (F.dayofmonth(F.date_add(start, acc.cast("int"))) <= 12))
            return F.when(more, once(acc)).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(1), F.when(f["nw"], F.lit(128)).otherwise(F.lit(1))), _num(f["n"]), go)

    def write(f: Column, n: Column) -> Column:
        t = F.date_add(start, n.cast("int"))
        y, mo, d = F.date_format(t, "yyyy"), F.date_format(t, "MM"), F.date_format(t, "dd")
        return F.when(f["yf"], F.concat_ws("-", y, mo, d)).when(f["df"], F.concat_ws("-", d, mo, y)).otherwise(F.concat_ws("-", mo, d, y))

    return bound(facts, lambda f: F.when(f["n"].isNotNull() & (f["n"] >= 0) & (f["n"] < _DAYS), bound(walked(f), lambda n: F.replace(write(f, n), F.lit("-"), f["sep"]))).otherwise(m))


def _email(m: Column, key: str, back: bool) -> Column:
    return F.concat(_both(F.split_part(m, F.lit("@"), F.lit(1)), "email", key, back), F.lit("@"), F.split_part(m, F.lit("@"), F.lit(2)))


def _secret(m: Column, key: str, back: bool) -> Column:
    hexed = _both(m, "hex", key, back, "abcdef")
    return F.when(m.startswith("AKIA") & (F.length(m) == 20), F.concat(F.lit("AKIA"), _both(F.substring(m, F.lit(5), F.lit(16)), "akia", key, back))).when(m.rlike("[A-Fa-f]") & m.rlike("[0-9]"), hexed).otherwise(m)


def kind_of(m: Column) -> Column:
    """The first kind whose whole pattern the match has."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return F.when(m.contains("@"), "email").when(whole(SECRET), "secret").when(whole(IBAN), "iban").when(whole(DATE), "date").when(whole(IP), "ip").when(whole(SSN), "ssn").when(whole(PHONE), "phone").otherwise("card")


def replacement(m: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one match of ANY; the match itself if it does not validate."""
    make = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}

    def choose(kind: Column) -> Column:
        out = None
        for name, f in make.items():
            out = F.when(kind == name, f(m, key, back)) if out is None else out.when(kind == name, f(m, key, back))
        return out

    return bound(kind_of(m), choose)


def spans(docs: DataFrame, key: str, *, text_col: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with ``pieces`` (text between matches), ``found`` (matches) and ``put`` (what replaces each)."""
    found = F.when(F.col(text_col).rlike("[0-9@]"), F.regexp_extract_all(F.col(text_col), F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    with_found = docs.withColumn("found", found)
    with_pieces = with_found.withColumn("pieces", F.when(F.size("found") > 0, F.split(F.col(text_col), ANY, -1)))
    return with_pieces.withColumn("put", F.transform("found", lambda m: replacement(m, key, back)))


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text", count_col: str | None = None, back: bool = False) -> DataFrame:
    """``docs`` with its text rewritten; ``count_col`` adds the number of values that changed. ``back`` reverses it."""
    names = [c for c in docs.columns if c != count_col]
    own = docs.select(F.col(text_col).alias("text"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    s = spans(own, key, back=back)
    text = F.when(F.size("found") > 0, F.array_join(F.flatten(F.zip_with("pieces", F.concat("put", F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")).otherwise(F.col("text"))
    out = [(text if c == text_col else F.col("row").getField(c)).alias(c) for c in names]
    if count_col:
        out.append(F.coalesce(F.size(F.filter(F.zip_with("found", "put", lambda a, b: a != b), lambda x: x)), F.lit(0)).cast("long").alias(count_col))
    return s.select(*out)


def reveal(docs: DataFrame, key: str, *, text_col: str = "text") -> DataFrame:
    """The inverse of ``pseudonymise`` with the same key."""
    return pseudonymise(docs, key, text_col=text_col, back=True)
