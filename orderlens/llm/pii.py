"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Spans of four kinds are found by strict patterns (the base spans, which always stay) and by
broader ones.  Three labelers vote for, against or not at all on every span: the pattern
itself with its checks, gazetteers of domains, number prefixes and address ranges, and the
words before the span.  Expectation-maximisation over the counts of vote patterns estimates
how reliable each labeler is per kind, and so the chance that a span is real.  With these
chances as soft labels a naive Bayes classifier on votes and shape is trained, and broader
spans that it finds likely enough, and that touch no base span, are added.

Only DataFrame and SQL functions are used.  Texts are read once, by map-only stages; what is
counted has at most a few hundred rows.

Defined results: positions are code points, ends exclusive; null and empty texts have no
span, and the hash of the empty string; repeated rows give one row each; rows without doc_id
are treated alike; an empty table gives no row; other columns are ignored.  Matches of one
kind follow each other without overlap, those that fail their check are dropped for good.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import stored, whole_text

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
CONTEXT = 40
ROUNDS = 25
AGAINST, SILENT, IN_FAVOUR = 0, 1, 2

# What a span of each kind looks like.  Possessive repeats and the look-behind
# change no match; they keep long runs of digits or letters from being read over and over.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9]++(?:(?<=[0-9][0-9])|[ -][0-9])(?:[ -]?[0-9])*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
BROAD = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++"
             r"(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z._])[0-9]{4}([._])[0-9]{4}\3[0-9]{4}\3[0-9]{4}(?![0-9A-Za-z._])",  # its group follows two
    "phone": r"(?<![0-9A-Za-z.+-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
}
#: Texts without a match of these hold no span of the kind.
GUARD = {
    "email": {False: "@", True: r"[\[(]at[\])]"},
    "ip": {False: r"[0-9]\.[0-9]", True: r":[0-9A-Fa-f]{1,4}:"},
    "card": {False: r"[0-9](?:[ -]?[0-9]){13}", True: r"[0-9][._][0-9]{4}[._][0-9]"},
    "phone": {False: r"\+[0-9]", True: r"[0-9][ .-][0-9]{4}"},
}
# Gazetteers.
TOP_DOMAINS = "com org net edu gov mil int info biz io co de fr es it nl uk eu ch at us ca au jp cn in br ru pl se"
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
COUNTRY_PREFIX = r"^\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CONTEXT_WORDS = {
    "email": r"mail|contact|contacto|courriel|correo|write|kontakt",
    "ip": r"\bip\b|host|server|address|adresse|client|login",
    "card": r"card|visa|master|amex|credit|karte|carte|tarjeta|pay",
    "phone": r"phone|tel\b|tel[.:]|telef|call|mobile|handy|fax|cell",
}
NOT_PERSONAL = r"version|isbn|issn|order|invoice|sku|build|revision|part no|serial|hash|commit|="


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, text) of the pattern's matches, leftmost and without overlap."""
    # tied to the end of the match before, or the search after the last one would start over
    # at every character
    whole = F.lit(rf"(?s)\G(.*?)({pattern})")
    gaps, hits = F.regexp_extract_all(text, whole, F.lit(1)), F.regexp_extract_all(text, whole, F.lit(2))
    found = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    none = F.array().cast("array<struct<start:int,hit:string>>")
    placed = F.aggregate(
        found, F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, m: F.struct(
            (a["at"] + F.length(m["gap"]) + F.length(m["hit"])).alias("at"),
            F.array_append(a["out"], F.struct(
                (a["at"] + F.length(m["gap"])).alias("start"), m["hit"].alias("hit"))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return placed


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def value(i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    """The check that a strict match of the kind has to pass."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda x: x.cast("double") <= 255)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _spans(text: Column, kind: str, broad: bool) -> Column:
    pattern = (BROAD if broad else STRICT)[kind]
    found = F.transform(matches(text, pattern), lambda m: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), F.lit(broad).alias("broad"), m["start"].alias("start"),
        (m["start"] + F.length(m["hit"])).alias("end"), m["hit"].alias("hit"),
        F.lower(F.substring(text, F.greatest(m["start"] - CONTEXT + 1, F.lit(1)),
                            F.least(m["start"], F.lit(CONTEXT)))).alias("before"),
        F.substring(text, m["start"] + F.length(m["hit"]) + 1, F.lit(1)).alias("after"),
    ))
    none = F.array().cast(
        "array<struct<kind:int,broad:boolean,start:int,end:int,hit:string,before:string,after:string>>"
    )
    return F.when(F.rlike(text, F.lit(GUARD[kind][broad])), found).otherwise(none)


def _by_kind(span: Column, choices: list[Column]) -> Column:
    out = F.when(span["kind"] == 0, choices[0])
    for k in range(1, len(KINDS)):
        out = out.when(span["kind"] == k, choices[k])
    return out


def _votes(span: Column) -> list[Column]:
    """Votes of pattern, gazetteer and context on one span."""
    hit, before = span["hit"], span["before"]
    checked = _by_kind(span, [passes(k, hit) for k in KINDS])
    pattern = F.when(span["broad"], SILENT).when(checked, IN_FAVOUR).otherwise(AGAINST)
    digits = F.regexp_replace(hit, "[^0-9]", "")
    domain = F.lower(F.regexp_extract(hit, r"([A-Za-z0-9-]+)$", 1))
    first = F.regexp_extract(hit, r"^([0-9]+)\.", 1)
    known = _by_kind(span, [
        domain.isin(TOP_DOMAINS.split()),
        F.when(span["broad"], F.lit(True)).otherwise(
            (F.length(first) <= 3) & ~first.isin("", "0", "127", "255")),
        F.rlike(digits, F.lit(CARD_PREFIX)),
        F.when(span["broad"], F.rlike(digits, F.lit("^[2-9][0-8]"))).otherwise(
            F.rlike(hit, F.lit(COUNTRY_PREFIX))),
    ])
    gazetteer = F.when(known, IN_FAVOUR).otherwise(AGAINST)
    near = _by_kind(span, [F.rlike(before, F.lit(CONTEXT_WORDS[k])) for k in KINDS])
    context = F.when(near, IN_FAVOUR).when(F.rlike(before, F.lit(NOT_PERSONAL)), AGAINST).otherwise(SILENT)
    return [pattern, gazetteer, context]


def _shape(span: Column) -> list[Column]:
    """What the final classifier sees besides the votes, each as one word."""
    hit = span["hit"]

    def char_class(c: Column) -> Column:
        return F.when(c == "", "edge").when(F.rlike(c, F.lit(r"\s")), "space").when(
            F.rlike(c, F.lit(r"[\p{L}\p{N}]")), "word").otherwise("sign")

    digits = F.length(F.regexp_replace(hit, "[^0-9]", "")) / F.length(hit)
    return [
        F.concat(F.lit("len:"), F.least(F.floor(F.length(hit) / 4), F.lit(12)).cast("string")),
        F.concat(F.lit("digits:"), F.round(digits * 4).cast("int").cast("string")),
        F.concat(F.lit("left:"), char_class(F.substring(span["before"], -1, 1))),
        F.concat(F.lit("right:"), char_class(span["after"])),
    ]


def reliabilities(counts: DataFrame) -> DataFrame:
    """Per kind the labelers' outcome chances for real (t) and other spans (f), and the prior p.

    ``counts`` has the rows of every vote pattern: kind, votes (array of outcomes) and n.  A
    kind has 27 patterns at most, so its whole EM is one expression over an array of them.
    """
    step = """
      transform(array(transform(patterns, x -> named_struct('v', x.votes, 'n', x.n,
          'a', s.p * s.t[0][x.votes[0]] * s.t[1][x.votes[1]] * s.t[2][x.votes[2]],
          'b', (1 - s.p) * s.f[0][x.votes[0]] * s.f[1][x.votes[1]] * s.f[2][x.votes[2]]))),
        post -> named_struct(
          'p', (aggregate(post, 1D, (c, x) -> c + x.n * x.a / (x.a + x.b)))
               / (aggregate(post, 2D, (c, x) -> c + x.n)),
          't', transform(sequence(0, 2), l -> transform(sequence(0, 2), o ->
               aggregate(post, 0.5D, (c, x) -> c + if(x.v[l] = o, x.n * x.a / (x.a + x.b), 0D))
               / aggregate(post, 1.5D, (c, x) -> c + x.n * x.a / (x.a + x.b)))),
          'f', transform(sequence(0, 2), l -> transform(sequence(0, 2), o ->
               aggregate(post, 0.5D, (c, x) -> c + if(x.v[l] = o, x.n * x.b / (x.a + x.b), 0D))
               / aggregate(post, 1.5D, (c, x) -> c + x.n * x.b / (x.a + x.b))))))[0]
    """
    start = """named_struct('p', 0.5D, 't', transform(sequence(0, 2), l -> array(0.1D, 0.3D, 0.6D)),
                            'f', transform(sequence(0, 2), l -> array(0.6D, 0.3D, 0.1D)))"""
    return counts.groupBy("kind").agg(
        F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"))).alias("patterns")
    ).select("kind", F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> {step})").alias("m"))


def classifier(spans: DataFrame) -> DataFrame:
    """(kind, feature, weight): naive Bayes log odds, feature '' being the prior.

    Trained on all spans with the chances that EM gives their votes.
    """
    counts = stored(
        spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")), "vote-patterns"
    )
    rates = reliabilities(counts)

    def chance(side: str) -> Column:
        out = F.lit(1.0)
        for k in range(3):
            out = out * F.col(f"m.{side}")[k][F.col("votes")[k]]
        return out

    judged = counts.join(rates, "kind").select(
        "kind", "votes", (F.col("m.p") * chance("t")).alias("a"), ((1 - F.col("m.p")) * chance("f")).alias("b")
    ).select("kind", "votes", (F.col("a") / (F.col("a") + F.col("b"))).alias("q"))
    soft = spans.join(F.broadcast(judged), ["kind", "votes"])  # 27 patterns per kind at most
    per = soft.select("kind", "q", F.explode(F.concat(F.array(F.lit("")), "features")).alias("feature")).groupBy(
        "kind", "feature").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no"))
    per = stored(per, "feature-counts")  # a few dozen features per kind
    prior = per.where("feature = ''").select("kind", F.col("yes").alias("all_yes"), F.col("no").alias("all_no"))
    return per.join(F.broadcast(prior), "kind").select(
        "kind", "feature",
        F.when(F.col("feature") == "", F.log((F.col("yes") + 1) / (F.col("no") + 1))).otherwise(
            F.log((F.col("yes") + 1) / (F.col("all_yes") + 2)) - F.log((F.col("no") + 1) / (F.col("all_no") + 2))
        ).alias("weight"),
    )


def _listing(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat(
        names[s["kind"]], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of base spans) and added (array of further spans) of every row."""
    text = whole_text()
    every = [_spans(F.col("text"), k, broad) for broad in (False, True) for k in KINDS]
    read = docs.select("doc_id", text.alias("text")).select("doc_id", F.concat(*every).alias("hits"))
    read = stored(read, "pii-hits")
    judged = read.select("doc_id", F.transform("hits", lambda s: F.struct(
        s["kind"].alias("kind"), s["broad"].alias("broad"), s["start"].alias("start"), s["end"].alias("end"),
        F.array(*_votes(s)).alias("votes"), F.array(*_shape(s)).alias("shape"))).alias("hits"))
    judged = stored(judged, "pii-votes")
    full = F.transform("hits", lambda s: F.struct(
        s["kind"].alias("kind"), s["votes"].alias("votes"), F.concat(
            F.transform(s["votes"], lambda v, i: F.concat(
                F.lit("vote"), i.cast("string"), F.lit(":"), v.cast("string"))), s["shape"],
        ).alias("features")))
    spans = judged.select(F.explode(full).alias("s")).select("s.*")
    # a few dozen features per kind
    weights = {f"{r['kind']}/{r['feature']}": r["weight"] for r in classifier(spans).collect()}
    table = F.create_map(*[F.lit(x) for pair in (weights or {"": 0.0}).items() for x in pair])

    def weight(kind: Column, feature: Column) -> Column:
        return F.coalesce(table[F.concat(kind.cast("string"), F.lit("/"), feature)], F.lit(0.0))

    def odds(s: Column) -> Column:
        features = F.concat(
            F.array(F.lit("")), F.transform(s["votes"], lambda v, i: F.concat(
                F.lit("vote"), i.cast("string"), F.lit(":"), v.cast("string"))), s["shape"])
        return F.aggregate(features, F.lit(0.0), lambda a, f: a + weight(s["kind"], f))

    base = F.filter("hits", lambda s: ~s["broad"] & (s["votes"][0] == IN_FAVOUR))
    likely = _log_odds(ACCEPT)
    more = F.filter("hits", lambda s: s["broad"] & (odds(s) >= likely) & ~F.exists(
        F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return judged.withColumn("base", base).withColumn("added", more).drop("hits")


def _log_odds(p: float) -> float:
    return log(p / (1 - p))


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts and digest of base spans, and the listing of all spans, for every row."""
    found = find_spans(docs)
    counts = [
        F.size(F.filter("base", _of_kind(k))).cast("bigint").alias(f"n_{name}")
        for k, name in enumerate(KINDS)
    ]
    return found.select(
        "doc_id", *counts, F.sha2(_listing(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listing(F.concat("base", "added")).alias("spans"),
    )
