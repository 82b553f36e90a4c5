"""4. Personal data under format-preserving pseudonyms, with built-in functions only.

Numbers and dates that pass their check are permuted within their format by a keyed
Feistel network: the value is two residues (a, b), and in turn each takes the other's
keyed hash modulo its own size. So a card number becomes a card number with a right
check digit, a date a date, and equal values stay equal in every document.

=======  ====================================  ==============================
kind     check                                 kept
=======  ====================================  ==============================
card     13 to 19 digits, Luhn                 separators, check digit right
phone    +, (ddd) or ddd-ddd-dddd form         country code, separators
ssn      no area 000, 666, 9xx; no zero parts  separators, the same checks
iban     remainder 1 modulo 97                 country, letters, spacing
ipv4     four numbers up to 255                form
date     a day of 1700 to 2099                 order and separators
email    local part, @, domain with a dot      domain, lengths, letters/digits
=======  ====================================  ==============================

The local part of an address has no such domain; its letters and digits are replaced
by a keyed hash of the whole address. Matches that fail their check stay as they
are, and so does all other text.

Numbers stand next to other numbers: a card before its expiry, an IBAN before a
currency. So groups of digits and capitals with one space or hyphen between them are
taken as one run, however long, and every part of it from one group to another is
tested; of those that pass, the one that starts first counts, then the kind that
comes first in FORMS, then the longest.

Cases: a null text stays null and has no finds; texts without a digit or @ are passed
through; of overlapping matches the one that starts first counts; rows that repeat
an id and further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE, END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
DOTTED_DATE = EDGE + r"\d{1,2}[./]\d{1,2}[./]\d{4}(?![\p{L}\p{N}]|\.\d)"
DOTTED_PHONE = r"\d{3}\.\d{3}\.\d{4}" + END
IPV4 = r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}]|\.\d)"
#: What a phone number doesn't run on into.
OTHER = r"\d{4}-\d\d-\d\d\b|\d{3}-\d\d-\d{4}\b|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d|\d{4}[ -]\d{6}[ -]\d{4}|" + f"{DOTTED_DATE}|{IPV4}"
FORMS = {
    # From the first character that can belong to it, and never given back, or a long text without @ takes square time.
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "iban": EDGE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + END,
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}" + END
    + r"|(?<![\p{L}\p{N}+])\+\d(?:(?:[ .-](?!" + OTHER + r"))?\d){7,14}" + END
    + r"|(?<![\p{L}\p{N}+])(?:\d{3}-\d{3}-\d{4}" + END + r"|\d{3} \d{3} \d{4}" + END + "|" + DOTTED_PHONE + ")",
    "date": EDGE + r"\d{4}-\d{2}-\d{2}" + END + "|" + DOTTED_DATE,
    "ssn": EDGE + r"\d{3}-\d{2}-\d{4}" + END,
    "ipv4": IPV4,
    "card": EDGE + r"\d(?:[ -]?\d){12,18}" + END,
}
KINDS = {name: n for n, name in enumerate(FORMS)}
#: A group of a run: not the start of a dotted form or of an address.
GROUP = rf"(?!{DOTTED_DATE}|{DOTTED_PHONE}|{IPV4})[A-Z0-9]++(?![\p{{L}}\p{{N}}]|[\p{{L}}\p{{N}}._%+-]{{0,64}}@)"
#: Possessive, so Java's stack doesn't grow with the run.
RUN = EDGE + r"(?=\d(?:[ -]?\d){12}|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2})" + f"{GROUP}(?:[ -]{GROUP})*+"
#: Groups of the longest card, with one digit in each.
GROUPS = 19
ANY = "|".join([FORMS["email"], RUN, *(FORMS[x] for x in ("phone", "date", "ssn", "ipv4"))])
#: Country codes of one or two digits; the rest have three.
CODES = r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ROUNDS = 8
#: Days of 400 Gregorian years, as a product for the two residues.
FIRST_DAY, DAYS = "1700-01-01", (189, 773)
AREAS, REST = 898, 99 * 9999


def _keyed(key: str, tag: str, r: Column, x: Column) -> Column:
    """60 bits."""
    whole = F.concat_ws(":", F.lit(key), F.lit(tag), r.cast("string"), x.cast("string"))
    return F.conv(F.substring(F.sha2(whole.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, tag: str) -> Column:
    """struct(a, b): a keyed permutation of the pairs 0 <= a < size_a, 0 <= b < size_b."""

    def turn(s: Column, r: Column) -> Column:
        odd = F.struct(((s["a"] + _keyed(key, tag, r, s["b"])) % size_a).alias("a"), s["b"].alias("b"))
        even = F.struct(s["a"].alias("a"), ((s["b"] + _keyed(key, tag, r, s["a"])) % size_b).alias("b"))
        return F.when(r % 2 == 1, odd).otherwise(even)

    first = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, turn)


def permuted_digits(digits: Column, key: str, tag: str) -> Column:
    """A keyed permutation of the digit strings of a length of 2 to 34."""
    n = F.char_length(digits)
    half = (n / 2).cast("int")

    def size(k: Column) -> Column:
        return F.rpad(F.lit("1"), k + 1, "0").cast("long")

    s = feistel(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n), size(half), size(n - half), key, tag)
    return F.aggregate(
        F.array(s), F.lit(""),
        lambda _, x: F.concat(F.lpad(x["a"].cast("string"), half, "0"), F.lpad(x["b"].cast("string"), n - half, "0")),
    )


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def placed(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order."""
    chars = F.split(shape, "")
    return F.array_join(
        F.transform(
            chars,
            lambda c, i: F.when(
                c.rlike(r"\d"), F.substring(digits, F.char_length(digits_of(F.substring(shape, F.lit(1), i + 1))), F.lit(1))
            ).otherwise(c),
        ),
        "",
    )


def luhn_sum(digits: Column, doubled: int) -> Column:
    """``doubled``: 1 where the last digit counts once, 0 where it is doubled."""
    values = F.transform(
        F.reverse(F.split(digits, "")),
        lambda c, i: F.when(i % 2 == doubled, (c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10).otherwise(c.cast("int")),
    )
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def mod97(text: Column) -> Column:
    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.rlike(r"\d"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _is_card(m: Column) -> Column:
    return luhn_sum(digits_of(m), 1) % 10 == 0


def _is_iban(m: Column) -> Column:
    bare = F.replace(m, F.lit(" "), F.lit(""))
    return mod97(F.concat(F.substring(bare, F.lit(5), F.char_length(bare)), F.substring(bare, 1, 4))) == 1


def _is_day(day: Column) -> Column:
    at = F.datediff(day, F.to_date(F.lit(FIRST_DAY)))
    return day.isNotNull() & (at >= 0) & (at < DAYS[0] * DAYS[1])


def _card(m: Column, key: str) -> Column:
    d = digits_of(m)
    payload = permuted_digits(F.substring(d, F.lit(1), F.char_length(d) - 1), key, "card")
    whole = F.aggregate(
        F.array(payload), F.lit(""), lambda _, p: F.concat(p, ((10 - luhn_sum(p, 0) % 10) % 10).cast("string"))
    )
    return F.when(_is_card(m), placed(m, whole))


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, rf"^\+(?:\d{{1,3}}(?=[ .(-])|{CODES}|\d{{3}})", 0)
    rest = F.substring(m, F.char_length(code) + 1, F.char_length(m))
    return F.concat(code, placed(rest, permuted_digits(digits_of(rest), key, "phone")))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(i)).cast("int") for i in (1, 2, 3))
    a = area - 1 - F.when(area > 666, 1).otherwise(0)
    s = feistel(a, (group - 1) * 9999 + serial - 1, F.lit(AREAS), F.lit(REST), key, "ssn")
    text = F.aggregate(F.array(s), F.lit(""), lambda _, x: F.format_string(
        "%03d-%02d-%04d", x["a"] + 1 + F.when(x["a"] + 1 >= 666, 1).otherwise(0),
        (x["b"] / 9999).cast("long") + 1, x["b"] % 9999 + 1,
    ))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, text)


def _iban(m: Column, key: str) -> Column:
    bare = F.replace(m, F.lit(" "), F.lit(""))
    country, account = F.substring(bare, 1, 2), F.substring(m, F.lit(5), F.char_length(m))
    digits = digits_of(account)
    new = F.when(F.char_length(digits) > 1, placed(account, permuted_digits(digits, key, "iban"))).otherwise(account)
    checked = F.aggregate(
        F.array(new), F.lit(""),
        lambda _, x: F.concat(
            country, F.lpad((98 - mod97(F.concat(F.replace(x, F.lit(" "), F.lit("")), country, F.lit("00")))).cast("string"), 2, "0"), x
        ),
    )
    return F.when(_is_iban(m), checked)


def _ipv4(m: Column, key: str) -> Column:
    o = [F.split_part(m, F.lit("."), F.lit(i)).cast("int") for i in (1, 2, 3, 4)]
    s = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ipv4")
    text = F.aggregate(F.array(s), F.lit(""), lambda _, x: F.concat_ws(
        ".", (x["a"] / 256).cast("int").cast("string"), (x["a"] % 256).cast("string"),
        (x["b"] / 256).cast("int").cast("string"), (x["b"] % 256).cast("string"),
    ))
    return F.when(F.greatest(*o) < 256, text)


def _date(m: Column, key: str) -> Column:
    sep = F.regexp_extract(m, r"[-./]", 0)
    part = F.split(m, "[-./]")
    iso, us = sep == "-", sep == "/"
    y = F.when(iso, part[0]).otherwise(part[2])
    mo = F.when(iso, part[1]).when(us, part[0]).otherwise(part[1])
    d = F.when(iso, part[2]).when(us, part[1]).otherwise(part[0])
    day = F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    at = F.datediff(day, F.to_date(F.lit(FIRST_DAY)))
    p, q = DAYS
    s = feistel((at / q).cast("int"), at % q, F.lit(p), F.lit(q), key, "date")
    new = F.date_add(F.to_date(F.lit(FIRST_DAY)), (s["a"] * q + s["b"]).cast("int"))
    shapes = F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(us, F.date_format(new, "MM/dd/yyyy")).otherwise(
        F.date_format(new, "dd.MM.yyyy")
    )
    return F.when(_is_day(day), shapes)


def _email(m: Column, key: str) -> Column:
    local = F.regexp_extract(m, "^[^@]+", 0)
    mixed = F.sha2(F.concat(F.lit(f"{key}:email:"), m).cast("binary"), 256)

    def other(c: Column, i: Column) -> Column:
        x = F.substring(mixed, i % 64 + 1, F.lit(1))
        number = F.translate(x, "abcdef", "012345")
        letter = F.translate(x, "0123456789abcdef", "bcdfghjklmnprstv")
        return F.when(c.rlike(r"\p{N}"), number).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.concat(F.array_join(F.transform(F.split(local, ""), other), ""), F.substring(m, F.char_length(local) + 1, F.char_length(m)))


MASKS = {"email": _email, "iban": _iban, "phone": _phone, "date": _date, "ssn": _ssn, "ipv4": _ipv4, "card": _card}


def _kind_in_run(s: Column) -> Column:
    """The place in KINDS of a part of a run that passes, else null."""

    def fits(name: str) -> Column:
        return s.rlike(f"^(?:{FORMS[name]})$")

    ssn = s.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")
    return (
        F.when(fits("iban") & _is_iban(s), KINDS["iban"]).when(fits("phone"), KINDS["phone"])
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$") & _is_day(F.try_to_date(s, "yyyy-MM-dd")), KINDS["date"])
        .when(ssn, KINDS["ssn"]).when(fits("card") & _is_card(s), KINDS["card"])
    )


def _cut(m: Column) -> Column:
    """A match as the parts to judge: of a run those that pass and what lies between."""

    def of_run(pieces: Column) -> Column:
        # Groups and the signs between them take turns.
        n = (F.size(pieces) / 2).cast("int")

        def part(i: Column, groups: Column) -> Column:
            return F.array_join(F.slice(pieces, 2 * i + 1, 2 * groups - 1), "")

        def best(i: Column) -> Column:
            lengths = F.sequence(F.lit(1), F.least(F.lit(GROUPS), n + 1 - i))
            found = F.transform(lengths, lambda k: F.struct(_kind_in_run(part(i, k)).alias("kind"), (-k).alias("k")))
            return F.coalesce(-F.array_min(F.filter(found, lambda x: x["kind"].isNotNull()))["k"], F.lit(0))

        def step(s: Column, k: Column) -> Column:
            sign = F.when(s["at"] > 0, F.slice(pieces, F.greatest(2 * s["at"], F.lit(1)), 1)).otherwise(F.array().cast("array<string>"))
            more = F.concat(s["out"], sign, F.array(part(s["at"], F.greatest(k, F.lit(1)))))
            skipped = s["at"] < s["next"]
            return F.struct(
                (s["at"] + 1).alias("at"),
                F.when(skipped, s["next"]).otherwise(s["at"] + F.greatest(k, F.lit(1))).alias("next"),
                F.when(skipped, s["out"]).otherwise(more).alias("out"),
            )

        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("next"), F.array().cast("array<string>").alias("out"))
        best_of = F.transform(F.sequence(F.lit(0), n), best)
        # As an array of one, so that the lengths are found once.
        return F.flatten(F.transform(
            F.array(best_of),
            lambda ks: F.when(F.exists(ks, lambda k: k > 0), F.aggregate(ks, start, step)["out"]).otherwise(F.array(m)),
        ))

    run = F.flatten(F.transform(F.array(F.split(m, "(?<=[ -])|(?=[ -])")), of_run))
    return F.when(m.rlike("^[A-Z0-9]+(?:[ -][A-Z0-9]+)*+$"), run).otherwise(F.array(m))


def _judged(m: Column, key: str) -> Column:
    """struct(kind, found, instead); kind is null where the check fails."""
    kind, instead = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in reversed(FORMS):
        fits = m.rlike(f"^(?:{FORMS[name]})$")
        kind, instead = F.when(fits, name).otherwise(kind), F.when(fits, MASKS[name](m, key)).otherwise(instead)
    return F.struct(F.when(instead.isNotNull(), kind).alias("kind"), m.alias("found"), F.coalesce(instead, m).alias("instead"))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with the text masked, and ``out``: array of (kind, found, instead) in text order.

    A column ``out`` is replaced.
    """
    t = F.col(text)
    none = F.array().cast("array<struct<kind:string,found:string,instead:string>>")
    nothing = F.array().cast("array<array<struct<kind:string,found:string,instead:string>>>")
    matches = F.regexp_extract_all(t, F.lit(ANY), F.lit(0))
    judged = F.transform(matches, lambda m: F.transform(_cut(m), lambda x: _judged(x, key)))
    found = docs.withColumn("__all", F.when(t.rlike("[0-9@]"), judged).otherwise(nothing))
    glued = F.zip_with(
        F.split(t, ANY), F.col("__all"),
        lambda gap, xs: F.concat(gap, F.coalesce(F.array_join(F.transform(xs, lambda x: x["instead"]), ""), F.lit(""))),
    )
    real = F.filter(F.flatten("__all"), lambda x: x["kind"].isNotNull())
    masked = F.when(F.size(real) > 0, F.array_join(glued, "")).otherwise(t)
    return found.withColumn(text, masked).withColumn(out, F.coalesce(real, none)).drop("__all")
