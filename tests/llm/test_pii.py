"""Pseudonyms: a plain Feistel network to compare with, hostile texts, and links between layouts."""

import datetime
import hashlib

import pytest

from gridloom.llm import pii


def run(spark, texts, key="k"):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(pii.pseudonymise(rows, key).collect(), key=lambda r: r.doc_id)]


def hashed(key, tweak, turn, half):
    return int(hashlib.sha256(f"{key}|{tweak}|{turn}|{half}".encode()).hexdigest()[:15], 16)


def feistel(h, low, size_h, size_l, key, tweak):
    for turn in range(pii.ROUNDS):
        if turn % 2 == 0:
            h = (h + hashed(key, tweak, turn, low)) % size_h
        else:
            low = (low + hashed(key, tweak, turn, h)) % size_l
    return h, low


def digits(d, key, tweak):
    left = len(d) // 2
    h, low = feistel(int(d[:left]), int(d[left:]), 10**left, 10 ** (len(d) - left), key, tweak)
    return f"{h:0{left}d}{low:0{len(d) - left}d}"


def luhn_check(body):
    d = [int(c) for c in reversed(body)]
    return str(-(sum(sum(divmod(2 * x, 10)) for x in d[::2]) + sum(d[1::2])) % 10)


def test_equals_plain_feistel(spark):
    got = run(spark, ["4111111111111111", "+442079460000", "10.20.30.40", "1999-12-31", "123-45-6789", "(425) 555-9684"])
    body = digits("411111111111111", "k", "card")
    assert got[0] == body + luhn_check(body)
    assert got[1] == "+44" + digits("2079460000", "k", "phone")
    h, low = feistel(10 * 256 + 20, 30 * 256 + 40, 65536, 65536, "k", "ip")
    assert got[2] == f"{h >> 8}.{h & 255}.{low >> 8}.{low & 255}"
    day = (datetime.date(1999, 12, 31) - datetime.date(1900, 1, 1)).days
    h, low = feistel(day % 72900 // 270, day % 270, 270, 270, "k", "date")
    assert got[3] == str(datetime.date(1900, 1, 1) + datetime.timedelta(days=day // 72900 * 72900 + h * 270 + low))
    h, low = feistel(122, 44 * 9999 + 6788, 898, 99 * 9999, "k", "ssn")
    assert got[4] == f"{h + (2 if h >= 665 else 1):03d}-{low // 9999 + 1:02d}-{low % 9999 + 1:04d}"
    assert got[5].replace("(", "").replace(") ", "").replace("-", "") == digits("4255559684", "k", "phone")


def test_layouts_of_a_value_stay_linked(spark):
    a, b, c, d, e, f = run(spark, ["+44 2079460000", "+442079460000", "+44 (0)20 7946 0000", "+1 425 555 9684", "425-555-9684", "(425) 555-9684"])
    plain = lambda t: "".join(ch for ch in t.replace("(0)", "") if ch.isdigit())
    assert plain(a) == plain(b) == plain(c) and plain(a).startswith("44") and "(0)" in c
    assert plain(d)[1:] == plain(e) == plain(f) and plain(d)[0] == "1" and plain(f) != "4255559684"
    x, y, z = run(spark, ["2021-02-28", "02/28/2021", "28/02/2021"])
    assert datetime.datetime.strptime(y, "%m/%d/%Y") == datetime.datetime.strptime(z, "%d/%m/%Y") == datetime.datetime.strptime(x, "%Y-%m-%d")


def test_iban(spark):
    def sound(t):
        t = t.replace(" ", "")
        return int("".join(str(int(ch, 36)) for ch in t[4:] + t[:4])) % 97 == 1

    bare, grouped, british = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819"
    got = run(spark, [bare, f"to {grouped} THEN", british, "DE88370400440532013000"])
    assert got[0] != bare and sound(got[0]) and got[1] == "to " + " ".join([*(got[0][k : k + 4] for k in range(0, 20, 4)), got[0][20:]]) + " THEN"
    assert got[2] != british and sound(got[2]) and got[2][4:8] == "NWBK" and got[3] == "DE88370400440532013000"


def test_hostile_texts_end(spark):
    parts = ["a.", "a-", "1.", "12 ", "+1 ", "x@", "a@b.", "AB12 ", "1/", "(0)", "4111 "]
    texts = [t for p in parts for long in [p * (200_000 // len(p))] for t in (long, "x@" + long + "1", "+" + long)]
    texts += ["9" * 1_000_000, "a." * 500_000]
    got = run(spark, texts)
    assert all(len(g) >= 0.5 * len(t) for g, t in zip(got, texts, strict=True))


def test_refused_names(spark):
    with pytest.raises(ValueError):
        pii.pseudonymise(spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, __new int"), "k")
