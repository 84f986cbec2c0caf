"""Toxicity of documents, read through disguises by a noisy-channel decoder.

Disguised stretches are found by their look: letters mixed with digits or signs, letters
repeated, single letters or signs spaced out.  Each is a lattice of readings (a sign stands
for itself or for letters, a repeated letter may drop out, a separator may drop out or end a
word); Viterbi search picks the most likely reading, of one or several words, under a
character trigram model and the channel's costs.  Stretches of every length are read.  Words of
the restored text are then scored by a logistic regression.

The character model is counted over the words of all given documents.  The classifier sees
words and word starts that toxic training rows use significantly more often; it is fitted
on at most ``FIT_ROWS`` labelled rows of each label, clean ones weighted back to their
number, and never on held-out rows.  Scores depend on the text alone.

Defined results: null and empty texts get the score of a text without evidence; repeated
rows get one result each; rows without doc_id are scored and are not held out; labels that
are null or conflict for an id are no training rows; without any toxic or clean training row
the score is the share of toxic ones, or 0; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import stored

FOLDS = 5
#: Labelled rows of each label that the classifier is fitted on, at most; smallest id hashes.
FIT_ROWS = 20_000
#: Word features that are looked at, and kept, at most.
CANDIDATES, FEATURES = 20_000, 2_000
LEAST_TOXIC_ROWS, LEAST_Z = 3, 3.0
#: Letters of the character model, the most frequent ones.
LETTERS = 64
#: Tokens counted before they are folded, and remembered, per task; longer ones are read anew.
TOKENS_AT_ONCE, TOKENS_KEPT, LONGEST_KEPT = 400_000, 200_000, 64

# What signs and digits stand for in leetspeak.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "¡": "i", "£": "l",
}
SEPARATORS = ".-_*~'`^"
#: Log costs of the channel: reading a sign as a letter, dropping a repeat, passing a separator.
READ_SIGN, DROP_REPEAT, DROP_SEPARATOR = -1.0, -0.7, -0.3

WORD = re.compile(r"[^\W\d_]+")
_LEET = re.escape("".join(LEET))
_SIGNS = re.escape("".join(LEET) + SEPARATORS)
#: Signs that are no digits: without one of them or a letter, digits are a number.
_MARKS = re.escape("".join(c for c in LEET if not c.isdigit()))
#: A letter, or a sign for one.
_ONE = rf"(?:[^\W\d_]|[{_LEET}])"
#: What may stand around a word without being a part of it; some of it is leetspeak too.
AROUND = ".,;:?\"'"
BRACKETS = AROUND + "()[]{}<>"
SPACED = re.compile(
    rf"(?<![^\s\"'(\[]){_ONE}(?:[\s.*_~'`^-]{{1,3}}{_ONE}){{2,}}(?=[.,:;?!\"')\]]*(?!\S))"
)
#: Digits alone are numbers.
MEANT = re.compile(rf"[^\W\d_]|[{_MARKS}]")
DISGUISED = re.compile(
    rf"[^\W\d_][{_SIGNS}]+[^\W_]"  # m1xed
    rf"|^[{_LEET}][{_SIGNS}]*[^\W\d_]"  # $ign or digit first
    rf"|[^\W\d_][{_SIGNS}]*[{_LEET}]$"  # sign la$t
    rf"|^(?=.*[{_MARKS}])[{_SIGNS}]*[{_LEET}][{_SIGNS}]*[{_LEET}][{_SIGNS}]*$"  # $!9n$ throughout
    r"|([^\W\d_])\1\1"  # repeeeated
)
REPEATED = re.compile(r"([^\W\d_])\1\1")
#: Separators, where a word may end.
PARTS = re.compile(rf"[^\w{_LEET}]|_")
#: Letters at least of a feature that is looked for inside a spaced stretch.
LEAST_INSIDE = 4
DOUBLED = re.compile(r"(\S)\1")


class CharModel:
    """Character trigrams with back-off to bigrams and single letters."""

    def __init__(self, trigrams: dict[str, int]):
        self.tri = trigrams
        self.two, self.pairs, self.one = Counter(), Counter(), Counter()
        for t, n in trigrams.items():
            self.two[t[:2]] += n
            self.pairs[t[1:]] += n
            self.one[t[2]] += n
        self.ends = Counter()
        for p, n in self.pairs.items():
            self.ends[p[0]] += n
        self.total = sum(self.one.values()) or 1
        self.memory: dict[str, float] = {}

    def score(self, before: str, letter: str) -> float:
        key = before + letter
        found = self.memory.get(key)
        if found is None:
            one = (self.one[letter] + 0.1) / (self.total + 0.1 * LETTERS)
            two = (self.pairs[key[1:]] + 5 * one) / (self.ends[key[1]] + 5)
            found = log((self.tri.get(key, 0) + 5 * two) / (self.two[before] + 5))
            if len(self.memory) < TOKENS_KEPT:
                self.memory[key] = found
        return found

    def readings(self, token: str) -> set[str]:
        """Readings of one stretch: repeats dropped or doubled letters kept, as one word or as several."""
        parted = (False, True) if PARTS.search(token) else (False,)
        kept = (1, 2) if DOUBLED.search(token) else (1,)
        return {self.decode(token, k, p) for k in kept for p in parted}

    def decode(self, token: str, kept: int = 1, parted: bool = True) -> str:
        """The most likely reading of one disguised stretch (Viterbi over its lattice).

        Of a letter or sign repeated, the first ``kept`` are never dropped.  If ``parted``,
        a separator may end a word, which is a space in the reading.
        """
        # last two letters: (total, (letter, what comes before it)), so that a step costs the same anywhere
        states: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
        previous, run = "", 0
        for c in token:
            run = run + 1 if c == previous else 1
            options: list[tuple[str, float]] = []
            if c.isalpha():
                options.append((c, 0.0))
                if run > kept:
                    options.append(("", DROP_REPEAT))
            if c in LEET:
                options += [(x, READ_SIGN) for x in LEET[c]]
                if run > kept:
                    options.append(("", DROP_REPEAT))
            if not c.isalnum() and c not in LEET:
                options.append(("", DROP_SEPARATOR))
                if parted:
                    options.append((" ", DROP_SEPARATOR))
            if not options:
                options.append(("", READ_SIGN))
            following: dict[str, tuple[float, tuple | None]] = {}
            for state, (total, out) in states.items():
                for letter, cost in options:
                    if letter == " ":
                        if state == "  ":
                            continue
                        # the end of a word stands for the separator
                        value, now, text = total + cost - 2.0 + self.score(state, " "), "  ", (" ", out)
                    elif letter:
                        value, now, text = total + cost + self.score(state, letter), state[1] + letter, (letter, out)
                    else:
                        # a dropped sign is one letter less to explain
                        value, now, text = total + cost - 2.0, state, out
                    best = following.get(now)
                    if best is None or value > best[0]:
                        following[now] = (value, text)
            states, previous = following, c
        best = max(states, key=lambda state: (states[state][0] + self.score(state, " "), state))
        letters, link = [], states[best][1]
        while link is not None:
            letters.append(link[0])
            link = link[1]
        return "".join(reversed(letters))


class Reader:
    """Features of texts after restoring disguised stretches; what a token gives is remembered.

    ``only`` limits the features to those of interest.
    """

    def __init__(self, trigrams: dict[str, int], only=None):
        self.model = CharModel(trigrams)
        self.only = only
        self.known: dict[str, set[str]] = {}
        #: Lengths of words of interest: where one of them starts in a spaced stretch nothing tells.
        self.sizes = sorted({len(f) - 1 for f in only or () if f[0] == "=" and len(f) > LEAST_INSIDE})
        #: Tokens without any feature of interest: most of them.
        self.plain: set[str] = set()

    def _words(self, stretch: str) -> list[str]:
        return [word for reading in self.model.readings(stretch) for word in reading.split()]

    def _inside(self, stretch: str) -> set[str]:
        """Words of interest anywhere in a stretch of single letters: trigrams may run words together."""
        found = set()
        for reading in self.model.readings(stretch) if self.sizes else ():
            run = reading.replace(" ", "")
            for size in self.sizes:
                found.update("=" + run[at:at + size] for at in range(len(run) - size + 1))
        return found & self.only if found else found

    def _of_token(self, token: str) -> set[str]:
        letters = token.isalpha()
        words = [token] if letters else WORD.findall(token)
        if letters:
            stretches = {token} if REPEATED.search(token) else ()
        else:
            # a bracket may be a letter or stand around the word: both are read
            inside = token.rstrip("!")
            core = inside.strip(BRACKETS).rstrip("!")
            stretches = {x for x in (inside.strip(AROUND), core, *PARTS.split(core)) if DISGUISED.search(x)}
        for x in stretches:
            words += self._words(x)
        found = features(words, self.only)
        for x in stretches:
            if SPACED.fullmatch(x):
                found |= self._inside(x)
        if len(token) <= LONGEST_KEPT and len(self.known) + len(self.plain) < TOKENS_KEPT:
            if found:
                self.known[token] = found
            else:
                self.plain.add(token)
        return found

    def features(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        tokens = set(low.split())
        found: set[str] = set()
        for token in tokens - self.plain:
            got = self.known.get(token)
            if got is None:
                got = self._of_token(token)
            found |= got
        for m in SPACED.finditer(low):
            if MEANT.search(m.group()):
                found |= features(self._words(m.group()), self.only) | self._inside(m.group())
        return found


def features(words: list[str], only=None) -> set[str]:
    """Words and the starts of words, or those of them in ``only``."""
    found = set()
    for w in words:
        size = len(w)
        found.add("=" + w)
        if size >= 4:
            found.add("^" + w[:4])
            if size >= 5:
                found.add("^" + w[:5])
    return found if only is None else found & only


def reader(shared) -> Reader:
    """The reader for a broadcast of trigrams and features; worker processes keep both."""
    held = shared.value
    if "reader" not in held:
        held["reader"] = Reader(held["trigrams"], held["only"])
    return held["reader"]


def letter_trigrams(docs: DataFrame) -> dict[str, int]:
    """Trigram counts of all words of all documents, over the ``LETTERS`` commonest letters."""

    def run(batches):
        tokens: Counter = Counter()
        counts: Counter = Counter()

        def fold():
            for token, n in tokens.items():
                for word in WORD.findall(token):
                    padded = f"  {word} "
                    for at in range(len(padded) - 2):
                        counts[padded[at:at + 3]] += n
            tokens.clear()

        for batch in batches:
            for text in batch["text"]:
                if text:
                    tokens.update(text.lower().split())
            if len(tokens) > TOKENS_AT_ONCE:
                fold()
        fold()
        yield pd.DataFrame({"t": list(counts), "n": list(counts.values())})

    parts = docs.select("text").mapInPandas(run, "t string, n bigint").where(F.length("t") == 3)
    counts = stored(parts.groupBy("t").agg(F.sum("n").alias("n")), "trigrams")
    common = [r["c"] for r in counts.groupBy(F.substring("t", 3, 1).alias("c")).agg(
        F.sum("n").alias("n")).where(F.col("c") != " ").orderBy(F.desc("n"), "c").limit(LETTERS).collect()]
    # at most (LETTERS + 1) ** 3 rows
    inside = [F.substring("t", at, 1).isin([*common, " "]) for at in (1, 2, 3)]
    return {r["t"]: r["n"] for r in counts.where(inside[0] & inside[1] & inside[2]).collect()}


def held_out() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % FOLDS == 0, F.lit(False))


def training_rows(labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic) of at most ``FIT_ROWS`` rows of each label, and all rows of each."""
    known = stored(
        labels.where(~held_out() & F.col("doc_id").isNotNull()).groupBy("doc_id")
        .agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("other"))
        .where((F.col("toxic") == F.col("other")) & F.col("toxic").isin(0, 1)).drop("other"), "labels",
    )
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [
        known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
        for y in (0, 1)
    ]
    return stored(chosen[0].union(chosen[1]), "training-rows"), totals


def fit_logistic(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, width: int,
                 ridge: float = 0.1, rounds: int = 600) -> np.ndarray:
    """Weights and, last, the intercept, by accelerated gradient steps."""
    index = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, ahead, b, b_ahead = np.zeros(width), np.zeros(width), 0.0, 0.0
    load = np.bincount(index, weights=weight[row], minlength=width) if width else np.zeros(0)
    most = max((len(r) for r in rows), default=0) + 1
    step_w = 4.0 / (most * (load + ridge))
    step_b = 4.0 / (most * weight.sum())
    for t in range(rounds):
        z = np.bincount(row, weights=ahead[index], minlength=len(rows)) + b_ahead
        gap = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        slope = np.bincount(index, weights=gap[row], minlength=width) + ridge * ahead if width else ahead
        new, new_b = ahead - step_w * slope, b_ahead - step_b * gap.sum()
        keep = t / (t + 3)
        ahead, b_ahead = new + keep * (new - w), new_b + keep * (new_b - b)
        w, b = new, new_b
    return np.append(w, b)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, int], dict[str, float], float]:
    """(trigrams, weight of each feature, intercept)."""
    trigrams = letter_trigrams(docs)
    chosen, totals = training_rows(labels)
    # two times FIT_ROWS ids at most
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    if not totals.get(0) or not totals.get(1):
        share = 1.0 if totals.get(1) else 0.0
        return trigrams, {}, 30.0 * (2 * share - 1)

    context = docs.sparkSession.sparkContext
    # the broadcasts are bounded by LETTERS, CANDIDATES and FEATURES
    plain = context.broadcast({"trigrams": trigrams, "only": None})

    def count(batches):
        read, found = reader(plain), Counter()
        for batch in batches:
            for text in batch["text"]:
                found.update(read.features(text))
        yield pd.DataFrame({"f": list(found), "n": list(found.values())})

    toxic = texts.where("toxic = 1").select("text").mapInPandas(count, "f string, n bigint").groupBy("f").agg(
        F.sum("n").alias("n")).where(F.col("n") >= LEAST_TOXIC_ROWS)
    candidates = [r["f"] for r in toxic.orderBy(F.desc("n"), "f").limit(CANDIDATES).collect()]
    place = {f: i for i, f in enumerate(candidates)}
    limited = context.broadcast({"trigrams": trigrams, "only": frozenset(candidates)})

    def look(batches):
        read = reader(limited)
        for batch in batches:
            found = [sorted(place[f] for f in read.features(t)) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "at": found})

    # numbers of candidate features, so that the texts are read once for counts and fit
    looked = stored(texts.mapInPandas(look, "toxic int, at array<int>"), "training-features")
    rows_of = {r["toxic"]: r["n"] for r in looked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows_of = [rows_of.get(y, 0) for y in (0, 1)]
    number = {(r["f"], r["toxic"]): r["n"] for r in looked.select("toxic", F.explode("at").alias("f"))
              .groupBy("f", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # CANDIDATES features
    rated = []
    for f, i in place.items():
        n0, n1 = number.get((i, 0), 0), number.get((i, 1), 0)
        odds = log((n1 + 0.5) / (rows_of[1] - n1 + 0.5)) - log((n0 + 0.5) / (rows_of[0] - n0 + 0.5))
        z = odds / (1 / (n1 + 0.5) + 1 / (n0 + 0.5)) ** 0.5
        if z >= LEAST_Z:
            rated.append((-z, f))
    names = [f for _, f in sorted(rated)[:FEATURES]]
    column = np.full(len(candidates) + 1, -1)
    column[[place[f] for f in names]] = np.arange(len(names))

    def keep(batches):
        for batch in batches:
            at = [column[np.asarray(a, dtype=np.int64)] for a in batch["at"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "at": [np.sort(a[a >= 0]) for a in at]})

    # two times FIT_ROWS short index lists
    seen = looked.mapInPandas(keep, "toxic int, at array<int>").collect()
    y = np.array([r["toxic"] for r in seen])
    weight = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    weight = weight * len(y) / weight.sum()
    fitted = fit_logistic([np.array(r["at"], dtype=np.int64) for r in seen], y, weight, len(names))
    return trigrams, dict(zip(names, fitted[:-1].tolist())), float(fitted[-1])


def share_model(docs: DataFrame, model: tuple[dict[str, int], dict[str, float], float]):
    """The model as a broadcast for ``evidence``; bounded by LETTERS and FEATURES."""
    trigrams, weights, intercept = model
    return docs.sparkSession.sparkContext.broadcast(
        {"trigrams": trigrams, "only": frozenset(weights), "weights": weights, "intercept": intercept})


def evidence(shared, texts) -> np.ndarray:
    """Log odds of being toxic of each text."""
    read, weights, intercept = reader(shared), shared.value["weights"], shared.value["intercept"]
    return np.array([intercept + sum(weights[f] for f in sorted(read.features(t))) for t in texts], dtype=float)


def score(docs: DataFrame, model: tuple[dict[str, int], dict[str, float], float]) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    shared = share_model(docs, model)

    def run(batches):
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(evidence(shared, batch["text"]), -40, 40)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": p, "predicted": (p >= 0.5).astype("int32")})

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id bigint, score double, predicted int"
    ).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows scored 0.5 or more; a text's score does not depend on its id."""
    shared = share_model(docs, fit(docs, labels))
    columns = docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = evidence(shared, batch.column("text").to_pylist()) < 0
            yield batch.filter(pa.array(keep, pa.bool_())).select(columns)

    return docs.mapInArrow(run, docs.schema)
