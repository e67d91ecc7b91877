"""Format-preserving pseudonyms by keyed Feistel networks, in DataFrame functions only.

Validated values are permuted within their format: Luhn-valid card numbers stay Luhn-valid, IBANs keep valid
check digits, calendar dates stay dates, NANP telephone numbers, social security numbers and IPv4 addresses
stay valid; separators stay where they are. Runs of digits that fail validation keep their length and fail it
afterwards too; strings in the form of an IBAN whose check digits fail keep those. Each kind has a domain of a * b values; a value is split as (left, right) and each round adds a
keyed SHA-256 of one side to the other, modulo a or b. That is a permutation; where a kind's values are part of
its domain only, it is applied again until it leads back to one of them (cycle walking), which is a
permutation of that part. So equal values get equal pseudonyms in all documents, and different ones of a kind
differ. Addresses of mail, which have no numeric format, get 128 bits of a keyed digest.

The caller names the key. No shuffle: each text is split at the matches of one pattern and put together again.
Texts without a digit or an @ skip that. No pattern repeats a group without a bound, so that a text of any
length needs little of a thread's stack.

Defined results: null texts stay null, with counts 0; dates outside 1900-2099, which the domain lacks, runs of
more than 36 digits, and strings that fail validation and fit no other kind stay as they are; a date that can't be
day first but can be month first is read so, and its pseudonym too; very long texts are done whole; repeated
rows get equal results; an empty table gives an empty one; columns of the input stay, whatever their names, but those named text or
n_<kind> are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import nested, unnested

PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9])",
    "phone": r"(?:\+1[ -]?)?(?:\([0-9]{3}\) ?|(?<![0-9])[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "number": r"(?<![0-9])(?:[0-9]{20,36}(?![0-9])|[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))",
}
KINDS = ("card", "iban", "number", "phone", "ssn", "ip", "date", "email")
ANY = "(" + "|".join(PATTERNS.values()) + ")"
ROUNDS = 16
#: A walk that doesn't lead back to the kind in so many steps fails the job; of a cycle's values a tenth at least is of the kind.
WALK = 512
#: Days from 1900-01-01 to 2099-12-31 are 17 * 4297.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)


def keyed(key: str, *parts: Column) -> Column:
    """60 bits of a keyed digest as a long."""
    h = F.sha2(F.concat_ws("|", F.lit(key), *parts, F.lit(key)), 256)
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, kind: Column, key: str) -> Column:
    """struct<l, r>: the permuted halves; left below a, right below b."""

    def one(acc: Column, i: Column) -> Column:
        tag = F.concat_ws(":", kind, a.cast("string"), b.cast("string"), i.cast("string"))
        odd = i % 2 == 1
        other = F.when(odd, acc["r"]).otherwise(acc["l"]).cast("string")
        f = keyed(key, tag, other)
        return F.struct(
            F.when(odd, F.pmod(acc["l"] + f % a, a)).otherwise(acc["l"]).alias("l"),
            F.when(odd, acc["r"]).otherwise(F.pmod(acc["r"] + f % b, b)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), one)


def check_digit(body: Column) -> Column:
    """The Luhn digit for a string of digits."""
    n = F.length(body)
    at = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substring(body, i, F.lit(1)).cast("int").alias("d"), ((n - i) % 2 == 0).alias("twice")))
    total = F.aggregate(at, F.lit(0), lambda s, x: s + F.when(x["twice"], F.when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2)).otherwise(x["d"]))
    return ((10 - total % 10) % 10).cast("string")


def _sound_iban(m: Column) -> Column:
    """Whether the check digits hold: the letters of a country and 97 decide."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    return (F.length(plain) <= 34) & (_mod_97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))) == 1)


def _mod_97(text: Column) -> Column:
    at = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))))
    return F.aggregate(at, F.lit(0), lambda acc, c: F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _classify(m: Column) -> Column:
    """struct<m, tail, kind, shape, d, day>: the match, what follows it, its kind or null, its shape, the digits that are permuted, its day."""
    shape = lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")
    digits = _digits(m)
    n = F.length(digits)
    mail = F.regexp_replace(m, "[.-]++$", "")
    octets = F.transform(F.split(m, "\\."), lambda x: F.try_to_number(x, F.lit("999")).cast("int"))
    point = F.replace(m, F.lit("/"), F.lit("."))
    by_day = F.coalesce(F.try_to_date(m, "yyyy-MM-dd"), F.try_to_date(point, "dd.MM.yyyy"))
    by_month = F.try_to_date(point, "MM.dd.yyyy")
    known = lambda d: d.between(F.lit(FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date"))
    ten = F.substring(digits, n - 9, F.lit(10))
    found = (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(shape("iban"), "iban")
        .when(shape("ip"), "ip")
        .when(shape("date"), F.when(by_day.isNotNull(), "date").otherwise("month"))
        .when(shape("phone"), "phone")
        .when(shape("ssn"), "ssn")
        .otherwise("card")
    )
    kind = (
        F.when(found == "email", F.when(mail.rlike("@[A-Za-z0-9-]++\\.[A-Za-z0-9]"), "email"))
        .when(found == "iban", F.when(_sound_iban(m), "iban").otherwise("number"))
        .when(found == "ip", F.when(F.forall(octets, lambda x: x <= 255), "ip"))
        .when(found == "date", F.when(known(by_day), "date"))
        .when(found == "month", F.when(known(by_month), "date"))
        .when(found == "phone", F.when(_sound("phone", ten), "phone").otherwise("number"))
        .when(found == "ssn", F.when(_sound("ssn", digits), "ssn").otherwise("number"))
        .otherwise(F.when(_sound("card", digits), "card").otherwise("number"))
    )
    # Only the digits after an IBAN's check digits are permuted.
    d = F.when(found == "phone", ten).when(found == "iban", F.substring(digits, F.lit(3), n)).otherwise(digits)
    keep = F.when(kind == "email", mail).otherwise(m)
    return F.struct(keep.alias("m"), F.substring(m, F.length(keep) + 1, F.length(m)).alias("tail"), kind.alias("kind"), found.alias("shape"), d.alias("d"), F.when(found == "date", by_day).otherwise(by_month).alias("day"))


def _sound(shape: str, d: Column) -> Column:
    """Whether the digits of a shape are valid."""
    if shape == "phone":
        return d.rlike("^[2-9][0-9]{2}[2-9]")
    if shape == "ssn":
        return d.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)")
    return (F.length(d) <= 19) & (F.substring(d, F.length(d), F.lit(1)) == check_digit(F.substring(d, F.lit(1), F.length(d) - 1)))


def _halves(x: Column) -> Column:
    """struct of x with l, r, a, b: the value within its domain."""
    d, kind = x["d"], x["kind"]
    body = F.when(kind == "card", F.substring(d, F.lit(1), F.length(d) - 1)).otherwise(d)
    n = F.length(body)
    h = F.ceil(n / 2).cast("int")
    long_ = lambda s: F.coalesce(F.nullif(s, F.lit("")), F.lit("0")).cast("long")
    cut = lambda a, k: F.substring(d, a, k).cast("long")
    phone = (cut(1, 3) - 200) * 8000000 + (cut(4, 3) - 200) * 10000 + cut(7, 4)
    area = cut(1, 3)
    ssn = (F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + cut(4, 2) - 1
    octet = lambda i: F.element_at(F.split(x["m"], "\\."), i).cast("long")
    days = F.datediff(x["day"], F.lit(FIRST_DAY).cast("date")).cast("long")
    pick = lambda phone_, ssn_, ip_, date_, other: F.when(kind == "phone", phone_).when(kind == "ssn", ssn_).when(kind == "ip", ip_).when(kind == "date", date_).when(kind.isin("card", "iban", "number"), other)
    ten = lambda k: F.element_at(F.array(*[F.lit(10**i) for i in range(19)]), k + 1)
    return F.struct(
        *[x[f].alias(f) for f in ("m", "tail", "kind", "shape")],
        n.alias("n"),
        h.alias("h"),
        pick(F.floor(phone / 80000), ssn, octet(1) * 256 + octet(2), F.floor(days / DAYS[1]), long_(F.substring(body, F.lit(1), h))).cast("long").alias("l"),
        pick(phone % 80000, cut(6, 4) - 1, octet(3) * 256 + octet(4), days % DAYS[1], long_(F.substring(body, h + 1, n - h))).cast("long").alias("r"),
        pick(F.lit(80000), F.lit(898 * 99), F.lit(65536), F.lit(DAYS[0]), ten(h)).cast("long").alias("a"),
        pick(F.lit(80000), F.lit(9999), F.lit(65536), F.lit(DAYS[1]), ten(n - h)).cast("long").alias("b"),
    )


def _day(p: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS[1] + p["r"]).cast("int"))


def _body(x: Column, p: Column) -> Column:
    """The digits of a permuted number."""
    pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
    return F.concat(F.when(x["h"] > 0, pad(p["l"], x["h"])).otherwise(""), F.when(x["n"] > x["h"], pad(p["r"], x["n"] - x["h"])).otherwise(""))


def _home(x: Column, p: Column) -> Column:
    """Whether a value of the domain is one of the kind."""
    body = _body(x, p)
    stray = F.when(x["shape"] == "phone", _sound("phone", body)).when(x["shape"] == "ssn", _sound("ssn", body)).otherwise(_sound("card", body))
    return F.when((x["kind"] == "number") & (x["shape"] != "iban"), ~stray).when(x["shape"] == "month", F.dayofmonth(_day(p)) > 12).otherwise(F.lit(True))


def _permuted(x: Column, key: str) -> Column:
    """struct<l, r, home>: the Feistel network applied until its value is of the kind."""
    tag = F.concat_ws(":", x["kind"], F.when(x["kind"] == "number", x["shape"]).when(x["shape"] == "month", x["shape"]))
    once = lambda p: feistel(p["l"], p["r"], x["a"], x["b"], tag, key)
    start = F.struct(x["l"].alias("l"), x["r"].alias("r"), F.lit(False).alias("home"))

    def step(p: Column, i: Column) -> Column:
        then = F.aggregate(F.array(once(p)), p, lambda _, q: F.struct(q["l"].alias("l"), q["r"].alias("r"), _home(x, q).alias("home")))
        return F.when(p["home"], p).otherwise(then)

    walks = (x["kind"] == "number") | (x["shape"] == "month")
    steps = F.sequence(F.lit(1), F.when(walks, F.lit(WALK)).otherwise(F.lit(1)))
    return F.when(x["kind"] != "email", F.aggregate(steps, start, step))


def _written(x: Column, key: str) -> Column:
    """The pseudonym of a match, in its format; the match itself where it has no kind."""
    m, kind, p = x["m"], x["kind"], x["p"]
    l, r = p["l"], p["r"]  # noqa: E741
    pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
    phone = l * 80000 + r
    area = F.floor(l / 99) + 1
    body = _body(x, p)
    digits = (
        F.when(kind == "phone", F.concat((F.floor(phone / 8000000) + 200).cast("string"), (F.floor(phone % 8000000 / 10000) + 200).cast("string"), pad(phone % 10000, 4)))
        .when(kind == "ssn", F.concat(pad(F.when(area >= 666, area + 1).otherwise(area), 3), pad(l % 99 + 1, 2), pad(r + 1, 4)))
        .when(kind == "card", F.concat(body, check_digit(body)))
        .otherwise(body)
    )
    # Digits before those that were permuted stay: a telephone number's country, an IBAN's check digits.
    skip = F.length(_digits(m)) - F.length(digits)
    seen = lambda i: F.length(_digits(F.substring(m, F.lit(1), i)))
    put = F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(m)),
            lambda i: F.when(F.substring(m, i, F.lit(1)).rlike("[0-9]") & (seen(i) > skip), F.substring(digits, seen(i) - skip, F.lit(1))).otherwise(F.substring(m, i, F.lit(1))),
        ),
        "",
    )
    plain = F.replace(put, F.lit(" "), F.lit(""))
    check = pad(F.lit(98) - _mod_97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 2), F.lit("00"))), 2)
    iban = F.concat(F.substring(put, 1, 2), check, F.substring(put, F.lit(5), F.length(put)))
    day = _day(p)
    order = F.when(x["shape"] == "month", F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    date = F.when(m.rlike("^[0-9]{4}-"), F.date_format(day, "yyyy-MM-dd")).when(F.contains(m, F.lit("/")), order).otherwise(F.replace(order, F.lit("/"), F.lit(".")))
    octet = lambda v: v.cast("string")
    ip = F.concat_ws(".", octet(F.floor(l / 256)), octet(l % 256), octet(F.floor(r / 256)), octet(r % 256))
    mail = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lower(m), F.lit(key)), 256), 1, 32), F.lit("@example.invalid"))
    new = F.when(kind.isNull(), m).when(kind == "email", mail).when(kind == "date", date).when(kind == "ip", ip).when(kind == "iban", iban).otherwise(put)
    lost = (kind.isNotNull() & (kind != "email")) & ~p["home"]
    return F.when(F.coalesce(lost, F.lit(False)), F.raise_error(F.lit("a walk didn't lead back"))).otherwise(F.concat(new, x["tail"]))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the private values of text replaced, and n_<kind>, the number of each kind's values."""
    if not key:
        raise ValueError("a key is needed")
    t = F.col("t")
    none = F.array().cast("array<string>")
    df = nested(docs, t=F.col("row").getField(text))
    df = df.withColumn("m", F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(none))
    df = df.withColumn("x", F.transform("m", _classify)).withColumn("x", F.transform("x", _halves))
    fields = ("m", "tail", "kind", "shape", "n", "h")
    df = df.withColumn("x", F.transform("x", lambda x: F.struct(*[x[f].alias(f) for f in fields], _permuted(x, key).alias("p"))))
    df = df.withColumn("y", F.transform("x", lambda x: _written(x, key)))
    pieces = F.split(t, ANY, -1)
    clean = F.when(F.size("y") > 0, F.array_join(F.zip_with(pieces, F.col("y"), lambda p, y: F.concat(p, F.coalesce(y, F.lit("")))), "")).otherwise(t)
    count = lambda k: F.coalesce(F.size(F.filter("x", lambda x: x["kind"] == k)), F.lit(0)).cast("long")
    counts = {f"n_{k}": count(k) for k in KINDS}
    return unnested(df, docs.columns, **{text: clean}, **counts)
