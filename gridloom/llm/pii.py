"""Personal data replaced by format-preserving Feistel pseudonyms, with DataFrame functions only.

A value is recognised by its shape, checked, and permuted within its format by a keyed Feistel network: its digits (or
its day number) are split in two halves, and each round adds to one half a keyed hash of the other, modulo the half's
size. A permutation has no collisions, so equal values get equal pseudonyms in all documents and different ones
different pseudonyms, and a pseudonym has the shape of the value and passes the same check. Values that fail their
check are left as they are.

Kinds, in the order in which they are tried at a place of a text:

- e-mail addresses with a local part of up to 64 characters and up to 8 labels of up to 63 before the last: the letters
  and digits of the local part, each within its class;
- IPv4 addresses with parts up to 255: all 32 bits;
- US social security numbers NNN-NN-NNNN that can have been given out: within these;
- IBANs that pass their check: the digits of the account part; the check digits are computed anew;
- dates YYYY-MM-DD, YYYY/MM/DD, DD.MM.YYYY and MM/DD/YYYY (DD/MM/YYYY, if there is no such month) of the calendar, from
  1900-01-01 on: within five blocks of 270 * 270 days, up to 2897;
- telephone numbers with a + and 8 to 15 digits: the digits after the country code, a (0) apart, so that the layout does
  not matter. Where a country's numbers have one length, they end there. North American ones without a country code,
  as (NNN) NNN-NNNN or NNN-NNN-NNNN, are those of code 1;
- payment card numbers of 13 to 19 digits, bare or in groups, that pass the Luhn check: all but the check digit, which is
  computed anew. In a usual grouping they are found beside other numbers too.

Patterns have no unbounded groups, so that no text exhausts the stack of the expression engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
_IP = r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}(?![0-9]|\.[0-9])"
_SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
_YEAR = "(?:19|2[0-8])[0-9]{2}"
_DATE = rf"(?<![0-9])(?:{_YEAR}-[0-9]{{2}}-[0-9]{{2}}|{_YEAR}/[0-9]{{2}}/[0-9]{{2}}|[0-9]{{2}}\.[0-9]{{2}}\.{_YEAR}|[0-9]{{2}}/[0-9]{{2}}/{_YEAR})(?![0-9])"
_OTHER = rf"(?!{_IP}|{_SSN}|{_DATE}|{_EMAIL})"
_DIGIT = r"(?:[ .-]?\(?[0-9]\)?)"
#: Numbers end at the length of their country's plan, where that is fixed and a group ends there.
_PLANS = ((10, "1|7|44|52|90|91|92"), (9, "27|31|33|34|41|48|61|351|420"), (8, "45|47|65"), (11, "86"))
_PLANNED = "|".join(rf"\+(?:{codes})(?:[ .-]?\(0\))?{_DIGIT}{{{n}}}(?![0-9])" for n, codes in _PLANS)
_FREE = rf"\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9](?:(?:[ .-]{_OTHER})?[0-9]){{5,12}}(?![0-9])"
_NATIONAL = r"(?<![0-9-])(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![0-9-])"
_PHONE = rf"(?:{_PLANNED}|{_FREE}|{_NATIONAL})"
#: Country codes (fixed values); those not named have three digits.
_COUNTRY = "^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Groups of digits, 13 digits at least, up to a value of another kind.
_RUN = rf"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:[ -]{_OTHER}[0-9]++)*+"
#: A part of a run of any grouping, as long as may be.
_PART = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
#: Lengths of the groups of cards as they are usually written, with how many groups these are, best first: of groups
#: 4-4-4-4-3 the last is a card's own with issuers that have such cards, and a number beside the card with others.
_LONG_ISSUER = r"^(?:6|5[06-9])"
_USUAL = ((1, "1[3-9]"), (5, "4-4-4-4-3"), (4, "4-4-4-[1-4]"), (3, "4-(?:6-5|6-4|4-5|5-6)"), (2, "6-13|8-8|6-10"), (5, "4-4-4-4-3"))
_MARK = "\u0001"
PATTERN = "|".join((_EMAIL, _IP, _SSN, _IBAN, _DATE, _PHONE, _RUN))


def _hash(key: str, tweak: str, turn: int, half: Column) -> Column:
    """60 keyed bits of a half."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|{tweak}|{turn}|"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(high: Column, low: Column, size_high: Column, size_low: Column, key: str, tweak: str) -> tuple[Column, Column]:
    """A keyed permutation of the pairs with 0 <= high < size_high and 0 <= low < size_low. Sizes may depend on the
    format but not on the value."""
    state = F.struct(high.cast("long").alias("h"), low.cast("long").alias("l"))

    def step(turn: int):
        # of one parameter: a second one would be the element's number
        def moved(s: Column) -> Column:
            if turn % 2 == 0:
                return F.struct(F.pmod(s["h"] + F.pmod(_hash(key, tweak, turn, s["l"]), size_high), size_high).alias("h"), s["l"].alias("l"))
            return F.struct(s["h"].alias("h"), F.pmod(s["l"] + F.pmod(_hash(key, tweak, turn, s["h"]), size_low), size_low).alias("l"))

        return moved

    for turn in range(ROUNDS):
        # the struct is bound in a lambda, so that a round's result is computed once
        state = _bound(state, step(turn))
    return state["h"], state["l"]


def _bound(value: Column, make) -> Column:
    return F.transform(F.array(value), make)[0]


def _permuted_digits(digits: Column, key: str, tweak: str) -> Column:
    """Digits of any number from 2 to 30 to as many digits."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    size_h, size_l = F.pow(F.lit(10.0), left).cast("long"), F.pow(F.lit(10.0), n - left).cast("long")
    high, low = F.substring(digits, F.lit(1), left).cast("long"), F.substring(digits, left + 1, n).cast("long")

    def join(s: Column) -> Column:
        return F.concat(F.lpad(s["h"].cast("string"), left, "0"), F.lpad(s["l"].cast("string"), n - left, "0"))

    # the length is part of the tweak by way of the sizes; halves are hashed with it
    h, low_ = feistel(high, low, size_h, size_l, key, tweak)
    return _bound(F.struct(h.alias("h"), low_.alias("l")), join)


def _luhn_sum(digits: Column) -> Column:
    """Sum of digits, each second one from the right end (the first with it) doubled: for digits without check digit."""
    n = F.length(digits)
    at = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    return F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, at(i) * 2 - F.when(at(i) >= 5, 9).otherwise(0)).otherwise(at(i))
    )


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _laid_out(value: Column, digits: Column) -> Column:
    """The value with its digits replaced, in order, by those given."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a["s"], F.substring(digits, a["i"], F.lit(1))).alias("s"), (a["i"] + 1).alias("i"))).otherwise(
        F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i"))
    )
    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), step, lambda a: a["s"])


def _valid(digits: Column) -> Column:
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return F.length(digits).between(13, 19) & (F.pmod(_luhn_sum(body) + F.substring(digits, -1, 1).cast("int"), F.lit(10)) == 0)


def _card(value: Column, key: str) -> Column:
    digits = _only_digits(value)

    def new(b: Column) -> Column:
        return F.concat(b, F.pmod(-_luhn_sum(b), F.lit(10)).cast("string"))

    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return F.when(_valid(digits), _laid_out(value, _bound(_permuted_digits(body, key, "card"), new))).otherwise(value)


def _parts(value: Column) -> Column:
    """A run in pieces, of which each second one may be a card: first valid ones in a usual grouping, from the left, so
    that numbers beside a card do not hide it; then, between these, the longest parts of 13 to 19 digits."""

    def marked(run: Column) -> Column:
        groups, gaps = run["groups"], run["gaps"]

        def step(s: Column, i: Column) -> Column:
            # i from 1; the first of the usual groupings that begin here and are valid
            lengths = F.concat_ws("-", F.transform(F.slice(groups, i, 5), lambda g: F.length(g).cast("string")))
            shaped = []
            for at, (n, shape) in enumerate(_USUAL):
                fits = lengths.rlike(f"^(?:{shape})(?:-|$)")
                shaped.append(F.when(fits & F.element_at(groups, i).rlike(_LONG_ISSUER) if at == 1 else fits, F.lit(n)))
            valid = F.filter(F.array(*shaped), lambda n: n.isNotNull() & _valid(F.concat_ws("", F.slice(groups, i, n))))
            n = F.when(i >= s["next"], F.get(valid, F.lit(0)))
            taken = lambda m: F.struct((i + m).alias("next"), F.concat(s["first"], F.array(i)).alias("first"), F.concat(s["last"], F.array(i + m - 1)).alias("last"))
            return _bound(n, lambda m: F.when(m.isNotNull(), taken(m)).otherwise(s))

        none = F.array().cast("array<int>")
        start = F.struct(F.lit(1).alias("next"), none.alias("first"), none.alias("last"))
        picked = F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, step)

        def laid(found: Column) -> Column:
            mark = lambda ends, i: F.when(F.array_contains(ends, i + 1), F.lit(_MARK)).otherwise(F.lit(""))
            return F.array_join(F.transform(groups, lambda g, i: F.concat(F.when(i > 0, F.get(gaps, i - 1)).otherwise(F.lit("")), mark(found["first"], i), g, mark(found["last"], i))), "")

        return _bound(picked, laid)

    run = F.struct(F.split(value, "[ -]").alias("groups"), F.regexp_extract_all(value, F.lit("([ -])"), 1).alias("gaps"))
    pieces = F.split(_bound(run, marked), _MARK, -1)
    rest = F.transform(pieces, lambda p, i: F.when(i % 2 == 0, F.regexp_replace(p, f"({_PART})", f"{_MARK}$1{_MARK}")).otherwise(p))
    return F.split(F.array_join(rest, _MARK), _MARK, -1)


def _phone(value: Column, key: str) -> Column:
    trunk = "\u0002"
    bare = F.replace(value, F.lit("(0)"), F.lit(trunk))
    digits = _only_digits(bare)
    sound = F.length(digits).between(8, 15)

    def new(p: Column) -> Column:
        return F.replace(_laid_out(bare, F.concat(p["code"], _permuted_digits(p["rest"], key, "phone"))), F.lit(trunk), F.lit("(0)"))

    code = F.when(value.startswith("+"), F.regexp_extract(digits, _COUNTRY, 0)).otherwise(F.lit(""))
    return F.when(sound, _bound(F.struct(code.alias("code"), F.substring(digits, F.length(code) + 1, F.length(digits)).alias("rest")), new)).otherwise(value)


def _ssn(value: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99 and serials 0001 to 9999."""
    area, group, serial = (F.substring(value, *at).cast("long") for at in ((1, 3), (5, 2), (8, 4)))
    h, low = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    show = lambda s: F.concat_ws("-", pad(s["h"] + F.when(s["h"] >= 665, 2).otherwise(1), 3), pad(F.floor(s["l"] / 9999) + 1, 2), pad(s["l"] % 9999 + 1, 4))
    return _bound(F.struct(h.alias("h"), low.alias("l")), show)


def _mod97(text: Column) -> Column:
    """Of digits and capital letters, which count as 10 to 35."""
    number = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + number(c)) % 97))


def _iban(value: Column, key: str) -> Column:
    """The longest run of groups from the first that passes the check, so that words after it do not hide it."""
    groups = F.split(value, " ")
    joined = lambda k: F.concat_ws("", F.slice(groups, F.lit(1), k))
    turned = lambda t: F.concat(F.substring(t, F.lit(5), F.length(t)), F.substring(t, F.lit(1), F.lit(4)))
    sound = F.filter(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: (F.length(joined(k)) >= 15) & (_mod97(turned(joined(k))) == 1))

    def new(k: Column) -> Column:
        own = F.concat_ws(" ", F.slice(groups, F.lit(1), k))
        rest = F.substring(value, F.length(own) + 1, F.length(value))
        account = F.substring(own, F.lit(5), F.length(own))
        digits = _only_digits(account)
        laid = F.when(F.length(digits) >= 2, _laid_out(account, _permuted_digits(digits, key, "iban"))).otherwise(account)
        country = F.substring(own, 1, 2)
        check = lambda a: F.concat(country, F.lpad((98 - _mod97(F.concat(F.replace(a, F.lit(" "), F.lit("")), country, F.lit("00")))).cast("string"), 2, "0"), a, rest)
        return _bound(laid, check)

    return F.coalesce(F.get(F.transform(F.slice(sound, 1, 1), new), F.lit(0)), value)


def _ip(value: Column, key: str) -> Column:
    p = F.split(value, r"\.")
    h, low = feistel(p[0].cast("long") * 256 + p[1].cast("long"), p[2].cast("long") * 256 + p[3].cast("long"), F.lit(65536), F.lit(65536), key, "ip")
    show = lambda s: F.concat_ws(".", *((F.floor(x / 256) if up else x % 256).cast("int").cast("string") for x in (s["h"], s["l"]) for up in (True, False)))
    return _bound(F.struct(h.alias("h"), low.alias("l")), show)


_DAYS, _ERAS = 270, 5


def _date(value: Column, key: str) -> Column:
    part = lambda *at: F.concat_ws("-", *(F.substring(value, *x) for x in at))
    year_last, american = (7, 4), value.rlike("^[0-9]{2}/") & part((7, 4), (1, 2), (4, 2)).try_cast("date").isNotNull()
    european = value.rlike("^[0-9]{2}[./]")
    iso = F.when(american, part(year_last, (1, 2), (4, 2))).when(european, part(year_last, (4, 2), (1, 2))).otherwise(F.replace(value, F.lit("/"), F.lit("-")))
    day = F.datediff(iso.try_cast("date"), F.lit("1900-01-01").cast("date")).cast("long")
    era, inside = F.floor(day / _DAYS**2), F.pmod(day, F.lit(_DAYS**2))
    h, low = feistel(F.floor(inside / _DAYS), inside % _DAYS, F.lit(_DAYS), F.lit(_DAYS), key, "date")
    new = F.date_add(F.lit("1900-01-01").cast("date"), (era * _DAYS**2 + h * _DAYS + low).cast("int"))
    slashed = value.contains("/")
    shapes = ((american, "MM/dd/yyyy"), (european & slashed, "dd/MM/yyyy"), (european, "dd.MM.yyyy"), (slashed, "yyyy/MM/dd"), (F.lit(True), "yyyy-MM-dd"))

    def form(d: Column) -> Column:
        out = F.lit(None).cast("string")
        for which, shape in reversed(shapes):
            out = F.when(which, F.date_format(d, shape)).otherwise(out)
        return out

    return F.when(day.isNull() | (era >= _ERAS), value).otherwise(_bound(new, form))


def _email(value: Column, key: str) -> Column:
    """Each letter and digit of the local part in turn moves within its class by a keyed hash of all the others, twice:
    an unbalanced network whose one half is a single character."""
    name, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    lower = "abcdefghijklmnopqrstuvwxyz"

    def shift(c: Column, by: Column) -> Column:
        out = c
        for alphabet in ("0123456789", lower, lower.upper()):
            at = F.position(c, F.lit(alphabet))
            out = F.when(at > 0, F.substring(F.lit(alphabet * 2), F.pmod(at - 1 + F.pmod(by, F.lit(len(alphabet))), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))).otherwise(out)
        return out

    def turn(number: int):
        def step(s: Column, i: Column) -> Column:
            rest = F.concat(F.substring(s, F.lit(1), i - 1), F.lit("\u0000"), F.substring(s, i + 1, F.length(s)))
            moved = shift(F.substring(s, i, F.lit(1)), _hash(key, f"mail{number}", number, F.concat(i.cast("string"), F.lit("|"), rest)))
            return F.concat(F.substring(s, F.lit(1), i - 1), moved, F.substring(s, i + 1, F.length(s)))

        return step

    places = F.sequence(F.lit(1), F.length(name))
    for number in range(2):
        name = F.aggregate(places, name, turn(number))
    return F.concat(name, F.lit("@"), host)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one recognised value; of a card, not of a run of numbers."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    return (
        F.when(value.contains("@"), _email(value, key)).when(whole(_IP), _ip(value, key)).when(whole(_SSN), _ssn(value, key))
        .when(value.rlike("^[A-Z]"), _iban(value, key)).when(whole(_DATE), _date(value, key))
        .when(value.startswith("+") | whole(_NATIONAL), _phone(value, key)).otherwise(_card(value, key))
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """The rows of docs with text replaced, and n_found (recognised values) and n_changed. A null text stays null, with
    0 of both; an empty text stays empty. Texts of any length are read whole. Columns n_found and n_changed of docs are
    replaced; others, and repeated rows, are kept; __found and __new are refused. Equal keys give equal pseudonyms; the
    key is a secret of the caller."""
    if taken := {"__found", "__new"} & set(docs.columns):
        raise ValueError(f"docs has columns of reserved names: {sorted(taken)}")
    rest = [c for c in docs.columns if c not in ("n_found", "n_changed")]
    text = F.col("text").cast("string")
    found = F.regexp_extract_all(text, F.lit(f"({PATTERN})"), 1)
    # each match in pieces, of which each second one is a value
    pieces = F.transform(found, lambda v: F.when(v.rlike(f"^(?:{_RUN})$") & ~v.rlike(f"^(?:{_IP}|{_SSN}|{_DATE}|{_NATIONAL})$"), _parts(v)).otherwise(F.array(F.lit(""), v, F.lit(""))))
    out = docs.select(*(F.col(f"`{c}`") for c in rest), pieces.alias("__found"))
    new = F.transform("__found", lambda m: F.transform(m, lambda v, i: F.when(i % 2 == 1, pseudonym(v, key)).otherwise(v)))
    out = out.withColumn("__new", F.when(F.size("__found") > 0, new))
    parts = F.split(text, f"(?:{PATTERN})", -1)
    # a part and the pseudonym after it, in turn; the last part has none
    joined = F.array_join(F.transform(F.arrays_zip(parts.alias("p"), F.col("__new").alias("n")), lambda z: F.concat(z["p"], F.coalesce(F.array_join(z["n"], ""), F.lit("")))), "")
    changed = F.size(F.filter(F.arrays_zip(F.flatten("__found").alias("a"), F.flatten("__new").alias("b")), lambda z: z["a"] != z["b"]))
    values = F.aggregate("__found", F.lit(0), lambda a, m: a + F.floor(F.size(m) / 2).cast("int"))
    some = F.size("__found") > 0
    cols = [F.when(some, joined).otherwise(text).alias(c) if c == "text" else F.col(f"`{c}`") for c in rest]
    n = lambda x: F.when(some, x).otherwise(F.lit(0)).cast("long")
    return out.select(*cols, n(values).alias("n_found"), n(changed).alias("n_changed"))
