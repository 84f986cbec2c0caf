"""A small set of the nine raw tables: three plain orders, then one per null rule."""

from orderlens.schemas import RAW_SCHEMAS

ROWS = {
    "orders": [
        ("o1", "c1", "delivered", "2018-01-02 10:00:00", "2018-01-02 12:00:00",
         "2018-01-03 09:00:00", "2018-01-08 10:00:00", "2018-01-20 00:00:00"),
        ("o2", "c2", "delivered", "2018-02-03 22:00:00", "2018-02-04 01:00:00",
         "2018-02-05 09:00:00", "2018-03-05 10:00:00", "2018-02-20 00:00:00"),
        ("o3", "c3", "canceled", "2018-03-01 08:00:00", None, None, None, "2018-03-20 00:00:00"),
        # no items at all
        ("o4", "c1", "delivered", "2018-03-02 08:00:00", "garbage", None,
         "2018-03-09 08:00:00", None),  # delivered without an estimate
        # purchase time unknown, states unknown
        ("o5", "c4", "shipped", "not a time", None, None, None, "2018-04-20 00:00:00"),
        # tied category, price and freight of zero
        ("o6", "c5", "delivered", "2018-04-07 08:00:00", None, None,
         "2018-04-10 08:00:00", "2018-04-20 00:00:00"),
        ("o7", "missing", "unavailable", "2018-04-08 08:00:00", None, None, None, None),
    ],
    "customers": [
        ("c1", "u1", 1000, "sao paulo", "SP"), ("c2", "u2", 2000, "rio", "RJ"),
        ("c3", "u3", 1000, "sao paulo", "SP"), ("c4", "u4", None, None, None),
        ("c5", "u1", 9999, "nowhere", "AM"),
    ],
    "items": [
        ("o1", 1, "p1", "s2", None, 100.0, 10.0),
        ("o2", 1, "p1", "s1", None, 50.0, 5.0), ("o2", 2, "p2", "s1", None, 30.0, 3.0),
        ("o3", 1, "p2", "s1", None, 20.0, 20.0),
        ("o5", 1, "p3", "s3", None, 5.0, 1.0),
        ("o6", 1, "p2", "s1", None, 0.0, 0.0), ("o6", 2, "p1", "s2", None, 0.0, 0.0),
        (None, 1, "p1", "s1", None, 7.0, 7.0),
    ],
    "payments": [
        ("o1", 1, "credit_card", 3, 110.0),
        ("o2", 1, "voucher", 1, 44.0), ("o2", 2, "boleto", 2, 44.0),  # equal payments
        ("o3", 1, "boleto", 1, 40.0),
        ("o5", 1, "boleto", 1, None),
    ],
    "reviews": [
        ("r1", "o1", 5, None, 'said "good", \nthen left', "2018-01-09", "2018-01-10 00:00:00"),
        # an unanswered review counts as the latest
        ("r2", "o2", 1, None, None, "2018-03-06", None),
        ("r3", "o2", 4, None, None, "2018-03-07", "2018-03-08 00:00:00"),
        ("r4", "o3", 3, None, None, "2018-03-10", "2018-03-11 00:00:00"),
    ],
    "products": [
        ("p1", "brinquedos", 1.0, 1.0, 1.0, 500.0, 10.0, 10.0, 10.0),
        ("p2", "moveis", 1.0, 1.0, 1.0, 1500.0, 20.0, 10.0, 10.0),
        ("p3", None, None, None, None, None, None, None, None),
    ],
    "sellers": [
        ("s1", 1000, "sao paulo", "SP"), ("s2", 2000, "rio", "RJ"), ("s3", None, None, None),
    ],
    "geolocation": [
        (1000, -23.54, -46.62, "sao paulo", "SP"), (1000, -23.56, -46.64, "sao paulo", "SP"),
        (2000, -22.90, -43.17, "rio", "RJ"), (None, 0.0, 0.0, None, None),
    ],
    "category_translation": [("brinquedos", "toys"), ("moveis", "furniture")],
}


def tables(spark):
    return {name: spark.createDataFrame(rows, RAW_SCHEMAS[name]) for name, rows in ROWS.items()}
