"""Base spans against Python's own regular expressions; added spans on small cases."""

import hashlib
import re

from pyspark.sql import Row

from orderlens.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SCHEMA = "doc_id bigint, text string, kind string"


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits)), 1):
        total += d if i % 2 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text):
    found = []
    for no, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else None,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                found.append((m.start(), no, m.end(), kind))
    return sorted(found)


TEXTS = [
    None, "", "no data at all", "a@b.c_d@e.fg x@y", "mail é😀 jo.doe+x@mail1.example.com, 10.0.0.1 and 999.1.1.1",
    "1.2.3.4.5.6.7.8 1.2.3.x4.5.6.7 00001.2.3.255", "4041894974608795 4041 8949 7460 8795 4041894974608796",
    "card 4041-8949-7460-8795-1 5 - 3 12", "+1 (988) 555-2485 and +12 3 +49 30 1234567890 +1",
    "@@ a@b a@b.c.d.e@f.g", "9" * 3000 + " " + "a" * 3000 + "@x.yy " + "1 " * 800,
    "call (415) 555-2671 or 415-555-2671 now", "order 415-555-2671", "jo (at) mail.example.com",
    "ip 2001:0db8:85a3:0000:0000:8a2e:0370:7334",
]


def test_base_spans_equal_brute_force(spark):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, kind="x") for i, t in enumerate(TEXTS)], SCHEMA)
    rows = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want = base_spans(text)
        listing = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert rows[i]["base_sha256"] == hashlib.sha256(listing.encode()).hexdigest(), (text, rows[i]["spans"])
        for kind in BASE:
            assert rows[i][f"n_{kind}"] == sum(k == kind for *_, k in want)
        assert set(filter(None, listing.split(","))) <= set(rows[i]["spans"].split(","))


def test_unlikely_places_add_nothing_and_likely_ones_do(spark):
    many = [(i, f"call me, phone +1 (988) 555-{1000 + i}") for i in range(60)]
    many += [(100 + i, f"tel: 415-555-{2000 + i} thanks") for i in range(60)]
    many += [(200 + i, "version 1.2.3.4 of order=12") for i in range(20)]
    docs = spark.createDataFrame([(*r, "") for r in many], SCHEMA)
    rows = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert rows[100]["spans"] == "phone:5:17" and rows[100]["n_phone"] == 0
    assert rows[200]["spans"].count(",") == 0


def test_empty_table_and_repeated_rows(spark):
    assert pii.personal_data(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(1, "a@b.cc", ""), (1, "a@b.cc", ""), (None, "a@b.cc", "")], SCHEMA)
    assert {tuple(r) for r in pii.personal_data(twice).collect()} == {
        (i, 1, 0, 0, 0, hashlib.sha256(b"email:0:6").hexdigest(), "email:0:6") for i in (1, None)}
    assert pii.personal_data(twice).count() == 3
