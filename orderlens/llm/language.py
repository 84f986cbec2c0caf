"""Language identification by a convolutional network over bytes.

A text's UTF-8 bytes are cut into windows of fixed length, all of them, the last one padded.
Filters of several widths slide over a window; because a byte is one of 256, a filter is a
table of 256 numbers for each of its places, and its answer a sum of table rows.  The largest
answer of each filter in a window goes through a softmax layer.  A text is judged by the mean
of its windows' scores, weighted by their length, so no text is too long and none is cut.

The network is trained in numpy on a bounded sample of labelled rows: ``FIT_ROWS`` of each
language, those with the smallest id hashes, and of each ``FIT_WINDOWS`` windows spread evenly
over the whole text (of a long one, as many stretches of a window's length).  Some of these are shortened, so that short texts are judged as well.

Defined results: a null or empty text, or one without a letter, is ``und`` with score 0; if
there is no labelled row to learn from, every text is; a missing doc_id counts as the empty
text for the fold; repeated rows are judged alike; an empty table gives no row; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import stored

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Rows of each language that are fitted on, windows of each row, and passes over them.
FIT_ROWS, FIT_WINDOWS, EPOCHS = 400, 6, 6
BATCH, RATE, DECAY = 64, 0.01, 1e-4
#: Windows that are scored at once: their answers stay in the processor's cache.
CHUNK = 16
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2


def reach() -> np.ndarray:
    """places x filters: whether a place belongs to a filter of that width."""
    widths = np.repeat(WIDTHS, FILTERS)
    return (np.arange(max(WIDTHS))[:, None] < widths[None, :]).astype(np.float32)


def padded(windows: np.ndarray) -> np.ndarray:
    """Windows with zeros behind them, so that every filter has an answer at each of their bytes."""
    return np.pad(windows, ((0, 0), (0, max(WIDTHS) - 1))).astype(np.intp)


@dataclass
class Network:
    """``table[j]`` (256 x filters): what place j of each filter adds for each byte, zero beyond its width."""

    names: list[str]
    table: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: np.ndarray

    def answers(self, windows: np.ndarray) -> np.ndarray:
        """The filters' answers, windows x bytes x filters."""
        x = padded(windows)
        out = self.table[0][x[:, :WINDOW]]
        for j in range(1, len(self.table)):
            out += self.table[j][x[:, j:j + WINDOW]]
        return out + self.bias


class Scorer:
    """A network with its tables joined for neighbouring bytes: half as many look-ups."""

    def __init__(self, net: Network):
        self.net = net
        filters = net.table.shape[2]
        self.pairs = []
        for j in range(0, len(net.table), 2):
            first = FILTERS * sum(w <= j for w in WIDTHS)  # narrower filters do not reach place j
            one = net.table[j][:, None, first:]
            two = net.table[j + 1][None, :, first:] if j + 1 < len(net.table) else np.zeros_like(one)
            self.pairs.append((j, first, np.ascontiguousarray((one + two).reshape(65536, filters - first))))

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """The largest answer of each filter in each window, at least zero."""
        x = np.pad(padded(windows), ((0, 0), (0, 1)))
        pair = x[:, :-1] * 256 + x[:, 1:]
        answer = None
        for j, first, table in self.pairs:
            part = np.take(table, pair[:, j:j + WINDOW], axis=0, mode="clip")
            if answer is None:
                answer = part
            else:
                answer[:, :, first:] += part
        return np.maximum(answer.max(axis=1) + self.net.bias, 0)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        parts = [self.pooled(windows[i:i + CHUNK]) for i in range(0, len(windows), CHUNK)]
        return np.concatenate(parts) @ self.net.weight + self.net.offset


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def data_of(text: str) -> bytes:
    """Bytes of a text, A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").lower()


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text, the last one padded with zeros."""
    rows = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(rows * WINDOW, b"\0"), dtype=np.uint8).reshape(rows, WINDOW)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Network:
    """A network fitted by Adam on windows of the given texts."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    number = {n: i for i, n in enumerate(names)}
    rows, labels = [], []
    for text, lang in zip(texts, langs):
        found = windows_of(data_of(text))
        at = np.unique(np.linspace(0, len(found) - 1, FIT_WINDOWS).astype(int))
        rows.append(found[at])
        labels += [number[lang]] * len(at)
    x, y = np.concatenate(rows), np.array(labels)
    # the loss weighs all languages alike
    share = len(y) / (len(names) * np.bincount(y, minlength=len(names)))
    mask = reach()[:, None, :]
    filters = FILTERS * len(WIDTHS)
    net = Network(
        names, rng.normal(0, 0.3, (max(WIDTHS), 256, filters)).astype(np.float32) * mask,
        np.zeros(filters, dtype=np.float32), rng.normal(0, 0.1, (filters, len(names))).astype(np.float32),
        np.zeros(len(names), dtype=np.float32),
    )
    params = [net.table, net.bias, net.weight, net.offset]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at:at + BATCH]
            cut = x[pick].copy()
            # half of the windows are shortened
            length = np.where(rng.random(len(pick)) < 0.5, WINDOW, rng.integers(8, WINDOW, len(pick)))
            cut[np.arange(WINDOW)[None, :] >= length[:, None]] = 0
            grads = _gradients(net, cut, y[pick], share[y[pick]].astype(np.float32))
            grads[0] *= mask
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                g += DECAY * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: Network, windows: np.ndarray, labels: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
    """Gradients in the order of the parameters; only the pooled bytes pass anything back."""
    answer = net.answers(windows)
    place = answer.argmax(axis=1)
    top = np.take_along_axis(answer, place[:, None, :], axis=1)[:, 0, :]
    pooled = np.maximum(top, 0)
    error = softmax(pooled @ net.weight + net.offset)
    error[np.arange(len(labels)), labels] -= 1
    error *= (share / len(labels))[:, None]
    back = (error @ net.weight.T) * (top > 0)
    x, rows = padded(windows), np.arange(len(windows))[:, None]
    filters = np.broadcast_to(np.arange(top.shape[1]), place.shape)
    table = np.zeros_like(net.table)
    for j in range(len(table)):
        np.add.at(table[j], (x[rows, place + j], filters), back)
    return [table, back.sum(axis=0), pooled.T @ error, error.sum(axis=0)]


def judge(scorer: Scorer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the language, its probability) of each text."""
    if not texts:
        return np.empty(0, dtype=np.int64), np.empty(0)
    data = [data_of(t) for t in texts]
    sizes = np.array([max(1, -(-len(d) // WINDOW)) for d in data])
    logits = scorer.logits(np.concatenate([windows_of(d) for d in data]))
    # every window weighs as much as it has bytes
    ends = np.cumsum(sizes)
    share = np.full(len(logits), float(WINDOW))
    share[ends - 1] = [max(1, len(d) - (n - 1) * WINDOW) for d, n in zip(data, sizes)]
    total = np.add.reduceat(logits * share[:, None], ends - sizes, axis=0)
    chance = softmax(total / np.add.reduceat(share, ends - sizes)[:, None])
    best = chance.argmax(axis=1)
    return best, chance[np.arange(len(best)), best].astype(float)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label may not be learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Network | None:
    """A network from at most ``fit_rows`` rows of each language, none of them held out.

    Rows are thinned by their id's hash to a few times that number in their own tasks, so the
    ranking that follows sees a bounded number of rows of each language.
    """
    learnable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out())
    sizes = stored(learnable.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "languages")
    thin = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / (1 << 40) < 4.0 * fit_rows / F.col("rows")
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    chosen = (
        learnable.join(sizes, "lang").where(thin & (F.col("text") != ""))
        # of a long text only what the fit uses leaves its task
        .select("lang", "doc_id", _spread(F.col("text")).alias("text"))
        .withColumn("place", F.row_number().over(by)).where(F.col("place") <= fit_rows)
    )
    rows = sorted(map(tuple, chosen.select("lang", "place", "text").collect()))
    if not rows:
        return None
    return train([r[2] for r in rows], [r[0] for r in rows])


def _spread(text: Column, parts: int = FIT_WINDOWS, chars: int = WINDOW) -> Column:
    """At most ``parts`` stretches of ``chars`` characters, spread evenly over a long text."""
    long = F.length(text) > parts * chars
    starts = [F.floor((F.length(text) - chars) * i / (parts - 1)).cast("int") + 1 for i in range(parts)]
    return F.when(long, F.concat(*[F.substring(text, s, F.lit(chars)) for s in starts])).otherwise(text)


def languages(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang)."""
    net = fit(docs, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        scorer = Scorer(net) if net else None
        for batch in batches:
            lang, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            texts = batch.pop("text").tolist()
            known = [i for i, t in enumerate(texts) if net and t and any(map(str.isalpha, t))]
            if known:
                best, chance = judge(scorer, [texts[i] for i in known])
                for i, b, c in zip(known, best.tolist(), chance.tolist()):
                    lang[i], score[i] = net.names[b], c
            yield batch.assign(lang_pred=lang, score=score).astype({"doc_id": "Int64"})

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInPandas(
        run, "doc_id bigint, held_out boolean, lang_pred string, score double"
    )
