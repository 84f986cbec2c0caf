"""The operators against brute force on small tables with nulls, ties, repeats and extra columns."""

import random
import re
import time
import tracemalloc
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orderlens.llm import (
    chunks, decontaminate, graph, html_text, line_dedup, nearest, packing, sharding, simhash, token_files, toxicity,
)
from orderlens.session import scratch_path

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, part int, place string"
LONG = "\n".join(" ".join(f"w{i}x{j}" for j in range(30)) for i in range(12))
TEXTS = [
    (1, "Alpha beta, gamma. DELTA\nepsilon  zeta eta theta"), (2, None), (3, ""), (4, " \t\n "), (5, LONG),
    (6, LONG + "\ntail of the copy"), (7, "head of the copy\n" + LONG), (7, "head of the copy\n" + LONG),
    (8, "one two"), (9, "one two"), (None, "Alpha beta gamma"), (10, "É日本 x" * 700), (11, "<|endoftext|> it's"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{k % 3}" if k % 4 else None, len(t or ""), k, "p") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def whole_ids(path, text, end):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("path, spaces", [(BYTES, True), (WORDS, False)])
def test_chunks_give_the_tokenizers_ids(path, spaces):
    texts = [t for _, t in TEXTS] + ["a  b.\n\n c,", "x.\x1cy", "don't I'll,", "3. 4,5.", " lead", "trail  ", ". ,"]
    for text, got in zip(texts, chunks.ChunkEncoder(path, spaces).encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == whole_ids(path, text, 0)[:-1], text


@pytest.mark.parametrize("path, spaces", [(BYTES, True), (WORDS, False)])
def test_every_code_point_before_a_stop(path, spaces):
    encoder, tokenizer = chunks.ChunkEncoder(path, spaces), Tokenizer.from_file(path)
    # letters, marks, numbers and signs; of the large uniform blocks every 50th
    points = [chr(c) for c in range(0x20000) if unicodedata.category(chr(c))[0] in "LMNSP"
              and (c % 50 == 0 or not 0x3400 <= c < 0xD7A4 and c < 0x12000)]
    texts = [f"San{c}, {c}. a" for c in points]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, encoder.encode(texts), want) if a != b] == []


@pytest.mark.parametrize("path, spaces", [(BYTES, True), (WORDS, False)])
def test_random_texts_through_a_small_table(path, spaces, monkeypatch):
    monkeypatch.setattr(chunks, "KEPT_CHUNKS", 50)
    draw = random.Random(8)
    parts = ["a", "Ab", "İ", "é", "e\u0301", "ß.", "x,", "don't", "42", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\xa0", ".", ",",
             "日本", "<|", "\x1f", "\0", "\u0958.", "Σ", "'s."]
    texts = ["".join(draw.choices(parts, k=draw.randrange(12))) for _ in range(20_000)] + [None]
    encoder, tokenizer = chunks.ChunkEncoder(path, spaces), Tokenizer.from_file(path)
    got = [ids for at in range(0, len(texts), 500) for ids in encoder.encode(texts[at:at + 500])]
    want = tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    assert [t for t, a, b in zip(texts, got, want) if a != np.array(b.ids, dtype="<u4").tobytes()] == []
    assert len(encoder.young) <= 2000  # a batch beyond the bound is the most it holds


def test_a_word_is_encoded_once_whatever_signs_follow(monkeypatch):
    encoder, asked = chunks.ChunkEncoder(BYTES, True), []
    encode = encoder._encode_apart
    monkeypatch.setattr(encoder, "_encode_apart", lambda keys: asked.extend(keys) or encode(keys))
    for text in ("one alpha, beta.", "one beta, alpha. beta alpha"):
        asked.clear()
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == whole_ids(BYTES, text, 0)[:-1]
    assert asked == []


def test_a_word_is_encoded_once_in_capital_or_small_letters_and_whatever_signs_follow(monkeypatch):
    encoder, asked = chunks.ChunkEncoder(WORDS, False), []
    encode = encoder._encode_apart
    monkeypatch.setattr(encoder, "_encode_apart", lambda keys: asked.extend(keys) or encode(keys))
    for text in ("One alpha, beta.", "one BETA, Alpha. beta alpha"):
        asked.clear()
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == whole_ids(WORDS, text, 0)[:-1]
    assert asked == []


def test_capitals_before_marks_keep_their_ids():
    # a small j and a caron are one character, a capital one and a caron are two
    texts = ["J\u030c", "j\u030c", "J\u030c.", "TH\u0331, Y\u030a W\u030a. T\u0308", "I\u0307. \u0130. i\u0307) \u0130)", "\u212a K k."]
    got = chunks.ChunkEncoder(WORDS, False).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole_ids(WORDS, t, 0)[:-1] for t in texts]


def test_texts_with_white_space_at_their_ends_among_regular_ones():
    texts = ["a b,\nc", " a", "\u3000\tb c", "a \n b", "a\tb c", "a \tb", "c\n", "\nc", "a  b", "a\n\nb", "x\xa0 y", "a b,\nc"]
    got = chunks.ChunkEncoder(BYTES, True).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole_ids(BYTES, t, 0)[:-1] for t in texts]


def test_small_batches_are_encoded_together(monkeypatch):
    monkeypatch.setattr(chunks, "GROUP_CHARACTERS", 10)
    texts = [["abc", None], ["defg"], [None], ["hijk", "l"], ["m" * 30], ["n"]]
    frames = [pd.DataFrame({"doc_id": range(len(t)), "text": pd.Series(t, dtype=object)}) for t in texts]
    got = [list(f["text"]) for f in chunks.grouped(frames)]
    assert [[t or None for t in g] for g in got] == [["abc", None, "defg", None, "hijk", "l"], ["m" * 30], ["n"]]


def test_packing(docs, empty):
    rows = packing.pack(docs, BYTES, capacity=64).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(i for i, _ in TEXTS)
    want = Counter()
    for i, t in TEXTS:
        ids = whole_ids(BYTES, t, 0)
        for no, (start, n) in enumerate(packing.cut_pieces(len(ids), 64)):
            want[(i, no, start, n, crc(ids[start:start + n]))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= 64
    assert packing.pack(empty, BYTES).count() == 0


def test_plan_fills_exactly_where_it_can():
    slots = packing.plan({2048: 3, 1500: 10, 548: 4, 500: 6, 48: 6})
    assert max(s[3] + s[2] - s[1] for s in slots) == 13
    assert packing._complement(np.bincount([5, 6, 7], minlength=40), 6, 12) == (7, 5)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(nodes, links):
    least = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_simhash(spark, docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    prints = {(i, brute_fingerprint(t)) for i, t in TEXTS}
    assert {(r["doc_id"], int(r["fingerprint"], 16)) for r in got} == prints
    ids = [i for i, _ in prints if i is not None]
    links = [(a, b) for a, x in prints for b, y in prints
             if None not in (a, b) and (x ^ y).bit_count() <= simhash.RADIUS]
    least = components_of(ids, links)
    assert all(r["component_id"] == least[r["doc_id"]] for r in got if r["doc_id"] is not None)
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    kept_want = Counter(set(least.values()))
    assert Counter(i for i in kept if i is not None) == kept_want
    assert simhash.near_duplicates(empty).count() == 0


def test_one_row_of_each_near_duplicate_group_stays(spark):
    same, other = words_of(30), words_of(30, 100)
    rows = [(1, same), (1, same), (2, same), (2, other), (None, other), (None, words_of(9, 500))]
    table = spark.createDataFrame(
        [(*r, "g", "n", "k", 1, 2) for r in rows],
        "doc_id bigint, text string, gone string, row_key string, own_key string, fp int, copies int")
    got = simhash.keep_one(table)
    assert got.columns == table.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [
        (0, words_of(9, 500)), (1, same), (2, other)]


def test_the_stages_take_columns_of_any_name(spark):
    item = words_of(30)
    rows = [(1, item), (1, "clean words of another text"), (2, LONG), (3, LONG)]
    names = "gone, doc, key, own_doc, own_key, cut, leaking, row_key, _doc, _key, _gone, _leaking, part, place".split(", ")
    table = spark.createDataFrame([(*r, *names) for r in rows],
                                  "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    bench = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    left = decontaminate.drop_leaking(table, bench)
    assert left.columns == table.columns
    # the other text under the same id stays
    assert sorted((r["doc_id"], r["text"][:5]) for r in left.collect()) == [(1, "clean"), (2, LONG[:5]), (3, LONG[:5])]
    cut = line_dedup.drop_repeated_lines(table)
    assert cut.columns == table.columns
    assert {r["doc_id"]: r["text"] for r in cut.where("doc_id > 1").collect()} == {2: LONG, 3: ""}


def test_links_of_large_nodes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 8)
    draw = np.random.default_rng(3)
    fps = {int(x) for x in draw.integers(0, 1 << 62, 60)}
    base = list(fps)[0]
    fps |= {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in draw.integers(0, 62, (80, 2))}
    fps = sorted(fps)
    found = simhash.links_between(spark.createDataFrame([(f,) for f in fps], "fp bigint")).collect()
    links = [(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 4]
    assert components_of(fps, [(r["a"], r["b"]) for r in found]) == components_of(fps, links)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 90), (90, 90)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    assert got == {**{i: 0 for i in range(21)}, 90: 90, 100: 90}


def test_sharding(docs, empty):
    rows = sharding.interleaved_shards(docs, shards=4).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == len(TEXTS) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    assert Counter(tuple(r)[:3] for r in rows) == want
    assert sharding.interleaved_shards(empty).count() == 0


def brute_line_dedup(texts, min_words):
    """Every run of every document against every earlier position."""
    rows = sorted({(i if i is not None else -1 << 63, t) for i, t in texts if t is not None}, key=lambda r: r[0])
    lines = {r: r[1].split("\n") for r in rows}
    out = {}
    for d, row in enumerate(rows):
        gone, own = set(), lines[row]
        for a in range(len(own)):
            for e in range(d + 1):
                other = lines[rows[e]]
                for b in range(len(other) if e < d else a):
                    n = 0
                    while a + n < len(own) and b + n < len(other) and own[a + n] == other[b + n]:
                        n += 1
                    if sum(len(x.split()) for x in own[a:a + n]) >= min_words:
                        gone |= set(range(a, a + n))
        out[row] = "\n".join(x for i, x in enumerate(own) if i not in gone)
    return out


def test_line_dedup(spark, docs, empty):
    draw = np.random.default_rng(1)
    extra = [(20 + d, "\n".join("abc"[k] * 2 + " q" * int(k) for k in draw.integers(0, 3, 9))) for d in range(8)]
    texts = TEXTS + extra
    table = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    for least in (6, 50):
        want = brute_line_dedup(texts, least)
        got = line_dedup.drop_repeated_lines(table, min_words=least).collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(
            (i, t if t is None else want[(i if i is not None else -1 << 63, t)]) for i, t in texts)
    assert line_dedup.drop_repeated_lines(docs).columns == docs.columns
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_token_files_round_trip(spark, docs, empty):
    path = scratch_path(spark, "test-files")
    token_files.write_token_files(docs, path, WORDS)
    rows = token_files.read_token_files(spark, path, with_ids=True).orderBy("start").collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == Counter(
        (i, tuple(whole_ids(WORDS, t, 1))) for i, t in TEXTS)
    ids, starts = [r["doc_id"] for r in rows], [r["start"] for r in rows]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    assert starts == np.cumsum([0, *[r["n_tokens"] for r in rows[:-1]]]).tolist()
    assert all(crc(r["ids"]) == r["ids_crc32"] for r in rows)
    assert [r["doc_id"] for r in token_files.read_token_files(spark, path, only=[5]).collect()] == [5]
    other = scratch_path(spark, "test-files")
    token_files.write_token_files(empty, other, WORDS)
    assert token_files.read_token_files(spark, other).count() == 0


def test_nearest(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.standard_normal(8).tolist()) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(120)] + [rows[3], (None, rows[1][1]), (600, None), (601, [0.0] * 8)]
    rows += [(602, [float("nan")] * 8), (603, [1.0]), (604, [None] * 8)]
    got = defaultdict(list)
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for r in nearest.nearest(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in rows[:520]}
    assert set(got) == {i for i in x if i % 50 == 0}
    hit = 0
    for q, found in got.items():
        want = sorted((i for i in x if i != q), key=lambda i: (-round(float(x[i] @ x[q]), 12), i))[:5]
        hit += len(set(want) & set(found))
        assert len(found) == 5 and q not in found
    assert hit >= 0.9 * 5 * len(got)
    assert got[400][:1] == [7] and nearest.nearest(table.where("vec_id < 0")).count() == 0


def test_html():
    page = ("<html><head><title>no</title><style>p{}</style></head><body><nav><a>menu</a></nav><div class='ad'>buy"
            "</div><article><h1>Head &amp; line</h1><p>Some  <b>long</b> text\n of the article<br>goes on.<p>Ok.</p>"
            "<aside>side</aside><div class='comments'><p>me too</p></div></article><footer>foot</footer>")
    assert html_text.main_text(page) == "Head & line\nSome long text of the article goes on.\nOk."
    assert html_text.main_text(None) == html_text.main_text("") == ""
    assert html_text.main_text("plain text only") == "plain text only"


@pytest.mark.parametrize("page, text", [
    ("<p>a</p><![foo[x]]><p>b</p>", "a\nb"), ("<p>a</p><![ foo", "a"), ("<![if IE]><p>z</p><![endif]>", "z"), ("<![", ""),
    ("<p>a<![CDATA[x]]></p><p>c", "a\nc"), ("</p></div><p>a", "a"),
])
def test_html_that_is_broken(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("part", ["<div>x ", "<p>x<ul><li>", "<article>y ", "<form>z ", "<div class=nav>q ", "</i>x "])
def test_html_takes_linear_time(part):
    start = time.process_time()
    html_text.main_text(part * 60_000)
    assert time.process_time() - start < 15  # with square time it takes minutes


def test_html_keeps_articles_side_by_side():
    long, short = words_of(60), words_of(45, 200)
    page = f"<body><nav>menu</nav><article><p>{long}</p></article><article><p>{short}</p></article><footer>f</footer>"
    assert html_text.main_text(page) == f"{long}\n{short}"


def words_of(n, start=0):
    return " ".join(f"word{i}" for i in range(start, start + n))


@pytest.mark.parametrize("inner", [
    "<h1>T</h1><div>{0}</div><div>{1}</div>", "<h1>T</h1><p>Hm.</p><p>No.</p><p>So.</p><blockquote>{0}</blockquote><p>{1}</p>",
    "<h1>T</h1><p>{1}</p><p>a</p><p>b</p><p>c</p><p>d</p><pre>{0}</pre><p>e</p><p>f</p><p>g</p><p>h</p><p>End.</p>",
    "<h1>T</h1><ul><li>{0}</li><li>a</li><li>b</li><li>c</li><li>d</li></ul><p>{1}</p>",
    "<h1>T</h1><table><tr><td>{0}</td></tr></table><p>a</p><p>b</p><p>c</p><p>d</p><p>e</p>",
])
def test_html_without_landmarks_keeps_all_but_menus(inner):
    inner = inner.format(words_of(400), words_of(70, 1000))
    got = html_text.main_text(f"<html><body><nav>menu</nav>{inner}<footer>foot</footer></body></html>")
    want = [x for x in re.split(r"(?:<[^>]*>)+", inner) if x]
    assert got == "\n".join(want)


@pytest.mark.parametrize("start, end", [
    ("<div class='layout has-sidebar'><article>", "</article></div>"), ("<div id='page-with-nav'>", "</div>"),
    ("<section class='related-work'>", "</section>"), ("<div class='social-science'>", "</div>"),
    ("<form action='/'>", "</form>"), ("<div class='header'><main>", "</main></div>"),
])
def test_html_wrappers_named_like_parts(start, end):
    inner = f"<h1>Title</h1><p>{words_of(90)}</p><div class='my-comments'><article>me too</article></div><p>Ok.</p>"
    page = f"<body><div class='ad'>buy</div>{start}{inner}{end}<form>name <input></form><div class='site-footer'>f</div>"
    assert html_text.main_text(page) == f"Title\n{words_of(90)}\nOk."


def test_toxicity_learns_and_reads_disguises(spark):
    draw = np.random.default_rng(4)
    usual = ["the", "river", "stone", "window", "garden", "letter", "morning", "paper"]
    rows, labels = [], []
    for i in range(300):
        words, bad = draw.choice(usual, 12).tolist(), i % 3 == 0
        rows.append((i, " ".join([*words, "stupid"] if bad else words)))
        labels.append((i, int(bad)))
    rows += [(900, "the river stup1d stone"), (901, "s t u p i d paper"), (902, None), (902, None), (None, "stupid")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs, table)
    out = {r["doc_id"]: r for r in got.collect()}
    assert all(out[i]["predicted"] == y for i, y in labels)
    assert [out[i]["predicted"] for i in (900, 901, 902, None)] == [1, 1, 0, 1]
    assert out[7]["held_out"] == (zlib.crc32(b"7") % 5 == 0) and got.count() == len(rows)
    assert toxicity.drop_toxic(docs, table).count() == 200 + 2
    assert toxicity.score(docs, toxicity.fit(docs, table.where("false"))).where("score > 0.5").count() == 0


def letter_counts(words):
    padded = [f"  {w} " for w in words]
    return dict(Counter(p[i:i + 3] for p in padded for i in range(len(p) - 2)))


USUAL = "the river as stone window garden letter morning paper what a man well trash evil".split() * 20
READER = toxicity.Reader(letter_counts([*USUAL, *["stupid", "idiot", "ass", "dumbass"] * 5]))
CHOSEN = toxicity.Reader(READER.model.tri, frozenset(["=stupid", "=idiot", "=ass", "=what", "=man", "=river"]))


@pytest.mark.parametrize("token, word", [
    ("5tupid", "stupid"), ("1diot", "idiot"), ("7rash", "trash"), ("3vil", "evil"), ("a$$", "ass"), ("@55", "ass"),
    ("@ss", "ass"), ("4ss", "ass"), ("dumba$$", "dumbass"), ("(5tupid)", "stupid"), ("\"1d10t\"!!", "idiot"),
])
def test_leetspeak_anywhere_in_a_token(token, word):
    assert "=" + word in READER.features(f"the {token} paper")


@pytest.mark.parametrize("stretch, words", [
    ("st" + 30 * "u" + "pid", ["stupid"]), ("st" + 5000 * "u" + "pid", ["stupid"]), ("a s t u p i d", ["stupid"]),
    ("s t u p i d i d i o t", ["stupid", "idiot"]), ("1 d 1 0 t", ["idiot"]), ("5 t u p 1 d!", ["stupid"]),
    ("wh4t.a.stup1d.m4n.window.garden.letter.paper", ["what", "stupid", "man"]), ("@ 5 5", ["ass"]),
    ("s\nt u  p.i_d,", ["stupid"]), ('"i d i o t"', ["idiot"]), ("r i v e r 1 d i o t s t 0 n e", ["idiot", "river"]),
])
def test_disguised_stretches_of_any_length_and_number_of_words(stretch, words):
    assert {"=" + w for w in words} <= CHOSEN.features(f"the {stretch} paper")


def test_long_words_are_features():
    assert "=" + 20 * "ab" in READER.features("the " + 20 * "ab")


def test_numbers_are_no_leetspeak():
    assert not READER.features("455 2024 1,000 (455) 455!")
    assert not READER.features("4 5 5 2 0 2 4")


def test_the_search_for_leaks_starts_no_python_workers_for_rows_of_the_driver(spark, monkeypatch):
    item = " ".join(f"b{i}" for i in range(24))
    spark.createDataFrame([(1, item), (2, "x")], "doc_id bigint, text string").write.parquet(path := scratch_path(spark, "t"))
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    plans, keep = {}, decontaminate.stored
    monkeypatch.setattr(decontaminate, "stored", lambda df, label: plans.update(
        {label: df._jdf.queryExecution().toString()}) or keep(df, label))
    assert decontaminate.leaks(spark.read.parquet(path), bench).count() == 1
    assert "MapInPandas" in plans["leak-passages"] and "ExistingRDD" not in plans["leak-passages"]


def test_decontamination(spark):
    draw = np.random.default_rng(6)
    words = [f"wort{i}" for i in range(400)]
    text = lambda n: draw.choice(words, n).tolist()
    items = [(i, text(30)) for i in range(20)] + [(20, text(300))]
    rows = [(i, " ".join(text(300))) for i in range(60)]
    rows += [(100 + i, " ".join([*text(50), *ws, *text(50)])) for i, ws in items]
    some = [w for k, w in enumerate(items[5][1]) if k % 5]  # a paraphrase that keeps four words of five
    rows += [(200, " ".join([*text(40), *some, *text(40)])), (201, None), (202, ""), (None, " ".join(text(20)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items] + [(77, None)], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert found == {(100 + i, i) for i in range(21)} | {(200, 5)}
    assert decontaminate.drop_leaking(docs, bench).count() == 60 + 3
    assert decontaminate.leaks(docs, bench.where("false")).count() == 0


def test_word_numbers_of_texts():
    class Asked(dict):
        times = 0

        def get(self, *a):
            Asked.times += 1
            return super().get(*a)

    draw = random.Random(4)
    parts = ["a", "Ab", "B", "ΑΣ", "Σ", "İ", "x,", "(b)", "'", "--", "é", " ", " ", " ", "\n", "\x1f", "\x85", "\u3000", "«a»"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(20))) for _ in range(3_000)] + [None, "", " "]
    numbers = {w: i for i, w in enumerate(["a", "ab", "b", "ας", "i\u0307", "é"])}
    got = decontaminate.word_numbers(texts, numbers)
    assert [g.tolist() for g in got] == [[numbers.get(w, 6) for w in decontaminate.words_of(t)] for t in texts]
    decontaminate.word_numbers(["a (b) A", None, "a b"] * 100, asked := Asked(numbers))
    assert asked.times == 4


def test_block_sums_hold_no_row_for_each_word():
    rows, ids = np.random.default_rng(1).random((50, 64), dtype=np.float32), np.arange(1 << 15, dtype=np.int32) % 50
    tracemalloc.start()
    got = decontaminate._block_sums(rows, ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, rows[ids].reshape(-1, decontaminate.BLOCK, 64).sum(axis=1))
    assert peak < 4 * got.nbytes


@pytest.mark.parametrize("a, b", [("abcbdab", "bdcaba"), ("", "a"), ("aaa", "aa"), ("xyz", "abc")])
def test_longest_common_subsequence(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    assert decontaminate.lcs_length(decontaminate.places_of(a), len(a), b) == table[-1, -1]


def test_spaced_keys_are_cut_once():
    """A word is cut out of a regular text once, and the keys name the chunks of the text."""

    class Counted(str):
        words = 0

        def split(self, *a):
            parts = super().split(*a)
            Counted.words += len(parts) if a != ("\n",) else 0
            return [Counted(p) for p in parts]

    assert chunks.spaced_keys(Counted("a b\nc d e")) == ["\0a", "b", "\nc", "d", "e"]
    assert Counted.words == 5
    for text in ("a", "a  b", "a\n\nb", " a", "a ", "a\n", "\n", "a\tb\nc", "a b\nc d"):
        assert "".join(map(chunks.spaced_chunk, chunks.spaced_keys(text))) == text
