"""Token ids of whole texts, encoding each distinct stretch of text once per worker.

A text is cut where white space follows something else; no token of the public vocabularies
crosses such a cut, so the ids of a text are the ids of its chunks in a row.  Chunks seen
before come from a table of bounded size, the others of a batch are encoded in one call.
The table has two generations: when the younger is full it becomes the older one, and chunks
that are met again move over, so that frequent chunks stay and rare ones go.

Texts are cut and their distinct chunks are found in Arrow, so that the table is asked once for
each distinct chunk of a group of texts, and ids are gathered at once.

Signs at the end of a word are looked up apart from it, and words of ASCII in small letters where
the tokenizer makes them small, so that a word is encoded once however it is written.

A chunk is kept under a key: where white space is part of the tokens, the key of a word behind
a single space is the word alone, so that texts are cut at their spaces and line breaks.
"""

from __future__ import annotations

import os
import re
import sys
import types
from collections.abc import Iterable, Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks of one generation of the table, about 70 MB.
KEPT_CHUNKS = 400_000
#: Signs that may be cut off the end of a chunk, and how many; where they stand apart is asked of
#: the tokenizer once for each letter and signs, and kept for a bounded number of them.
SIGNS, LONGEST_TAIL, KEPT_TAILS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", 4, 200_000
#: Stands between words that are encoded as one text.
BETWEEN = "|"
#: Characters of texts whose words are looked up together; one text may hold more.
GROUP_CHARACTERS = 4_000_000
#: Texts with one of these go to the tokenizer whole: the two kinds of white space differ
#: there, a special token may be named, or a key's mark stands in the text.
WHOLE = ("\0", "\x1c", "\x1d", "\x1e", "\x1f", "<|")
WHOLE_BEYOND_ASCII = ("\x85", "\u180e")
#: Starts the key of a chunk that has no white space in front.
BARE = "\0"
SPACED_CHUNKS = re.compile(r"\s*\S+|\s+$")


def grouped(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches, those with few characters of text together: a group asks once for each chunk."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += int(batch["text"].str.len().sum())
        if size >= GROUP_CHARACTERS:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def stays_whole(text: str) -> bool:
    return any(c in text for c in WHOLE) or not text.isascii() and any(c in text for c in WHOLE_BEYOND_ASCII)


def spaced_keys(text: str) -> list[str]:
    """The keys of a text's chunks where white space is part of the tokens."""
    keys: list[str] = []
    for line in text.split("\n"):
        words = line.split()
        if not words or " ".join(words) != line:  # not one space or line break between any two words
            break
        words[0] = "\n" + words[0]
        keys += words
    else:
        keys[0] = BARE + keys[0][1:]
        return keys
    return [
        c[1:] if c[0] == " " and len(c) > 1 and not c[1].isspace() else c if c[0].isspace() else BARE + c
        for c in SPACED_CHUNKS.findall(text)
    ]


def _strings(array: pa.LargeStringArray) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


def _used(codes: np.ndarray, n: int) -> tuple[list[int], np.ndarray]:
    """Which of ``n`` codes occur, and the codes as places among those."""
    occurs = np.zeros(n, dtype=bool)
    occurs[codes] = True
    return np.flatnonzero(occurs).tolist(), (np.cumsum(occurs) - 1)[codes]


def _pooled(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of chunks end to end, and how many each has."""
    return np.frombuffer(b"".join(ids), dtype="<u4"), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4


def _gathered(pool: np.ndarray, size: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The ids of words in a row, which are given by their places in the pool's order."""
    width = size[word]
    end = np.cumsum(width)
    # the i-th id of a word lies i places behind the word's first one in the pool
    first = (np.cumsum(size) - size)[word] - (end - width)
    at = np.repeat(first, width)
    at += np.arange(len(at))
    return pool[at]


def _texts(pool: np.ndarray, size: np.ndarray, word: np.ndarray, words: np.ndarray) -> list[bytes]:
    """The ids of texts of so many words each."""
    flat = _gathered(pool, size, word)
    # a text's ids end where those of its last word do
    at = np.append(0, np.cumsum(size[word]))[np.append(0, np.cumsum(words))].tolist()
    return [flat[a:b].tobytes() for a, b in zip(at, at[1:])]


def _cut_before(keys: pa.LargeStringArray, last: np.ndarray) -> pa.LargeStringArray:
    """Each string in two, the second one of so many of its last bytes."""
    start = np.frombuffer(keys.buffers()[1], dtype=np.int64)[keys.offset:keys.offset + len(keys) + 1]
    ends = np.append(np.stack([start[:-1], start[1:] - last], axis=1).ravel(), start[-1])
    return pa.LargeStringArray.from_buffers(2 * len(keys), pa.py_buffer(ends), keys.buffers()[2])


def spaced_chunk(key: str) -> str:
    return key[1:] if key[0] == BARE else key if key[0].isspace() else " " + key


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``spaces`` tells whether white space is part of the tokens (byte-level vocabularies) or
    dropped (word vocabularies).
    """

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bool] = {}
        # the last id: a vocabulary may put a mark for the start of a text before it
        self.between = np.frombuffer(self.whole(BETWEEN), dtype="<u4")[-1]
        # the line break that regular texts are given in front
        self.line = self.whole("\n")
        self.spaces = spaces
        # whether the tokenizer makes the letters of ASCII small
        normal = self.tokenizer.normalizer
        self.folds = bool(normal) and normal.normalize_str(ascii_uppercase) == normal.normalize_str(ascii_lowercase)
        self.chunk = spaced_chunk if spaces else str

    @classmethod
    def shared(cls, path: str, spaces: bool) -> ChunkEncoder:
        """One encoder per worker process, whichever task asks for it."""
        place = sys.modules.setdefault("_orderlens_encoders", types.ModuleType("_orderlens_encoders"))
        found = place.__dict__.get((path, spaces))
        if found is None:
            found = place.__dict__[(path, spaces)] = cls(path, spaces)
        return found

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _encode_apart(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of some chunks in one call.

        Chunks go as one text in which a sign or a line break that none of them holds stands between
        any two: its id, which no other text has, tells them apart.  Others are told apart by the
        tokenizer, which takes twice the time.
        """
        if not self.spaces:
            plain = [k for k in keys if BETWEEN not in k]
            got = self._encode_between(plain, f" {BETWEEN} ".join(plain), self.between)
        elif len(self.line) == 4:
            # no white space but the one in front
            plain = [k for k in keys if (word := k.removeprefix("\n")).split() == [word]]
            text = "\n".join([k[1:] if k[0] in "\n" + BARE else " " + k for k in plain])
            got = self._encode_between(plain, text, np.frombuffer(self.line, dtype="<u4")[0])
            for k in got:
                if k[0] == "\n":
                    got[k] = self.line + got[k]
        else:
            got = {}
        return got | self._encode_named([k for k in keys if k not in got])

    def _encode_between(self, keys: list[str], text: str, between: int) -> dict[str, bytes]:
        """The ids of the text between the ids of its separator; nothing if they don't fit the keys."""
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(ids == between)
        if not keys or len(cuts) != len(keys) - 1:
            return {}
        low, high = np.append(0, cuts + 1).tolist(), np.append(cuts, len(ids)).tolist()
        return {k: ids[a:b].tobytes() for k, a, b in zip(keys, low, high)}

    def _encode_named(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of some chunks in one call, which names the chunk of each id."""
        if not keys:
            return {}
        chunks = list(map(self.chunk, keys))
        got = self.tokenizer.encode_batch([chunks], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.array(got.ids, dtype="<u4").tobytes()
        word = np.array(got.word_ids, dtype=np.int64)  # none is missing: no special tokens are added
        at = (4 * np.searchsorted(word, np.arange(len(keys) + 1))).tolist()
        return {k: ids[a:b] for k, a, b in zip(keys, at, at[1:])}

    def encode(self, texts) -> list[bytes]:
        """The ids of each text; a null text has none."""
        texts = [t or "" for t in texts]
        out = [self.whole(t) if t and stays_whole(t) else b"" for t in texts]
        rest = [i for i, t in enumerate(texts) if t and not stays_whole(t)]
        low = size = 0
        for n, i in enumerate(rest, 1):
            size += len(texts[i])
            if size >= GROUP_CHARACTERS or n == len(rest):
                for j, ids in zip(rest[low:n], self._group([texts[j] for j in rest[low:n]])):
                    out[j] = ids
                low, size = n, 0
        return out

    def _turn(self) -> None:
        """Let the younger generation become the older one when it is full."""
        if len(self.young) >= KEPT_CHUNKS:
            self.old, self.young = self.young, {}

    def _group(self, texts: list[str]) -> list[bytes]:
        """The ids of texts, gathered from those of their distinct chunks."""
        whole = pa.array(texts, pa.large_string())
        if not self.spaces:
            cut = pc.utf8_split_whitespace(whole)
            coded = cut.flatten().dictionary_encode()
            keys = coded.dictionary
            if self.folds:  # beyond ASCII a mark may join a small letter that does not join the capital
                keys = pc.if_else(pc.string_is_ascii(keys), pc.ascii_lower(keys), keys)
            pool, size = self._word_ids(keys)
            return _texts(pool, size, coded.indices.to_numpy(), pc.list_value_length(cut).to_numpy())
        # a line break stands before every text and begins a word, as other ones do
        front, nothing = pa.scalar("\n", whole.type), pa.scalar("", whole.type)
        lines = pc.binary_join_element_wise(front, pc.replace_substring(whole, "\n", " \n"), nothing)
        cut = pc.split_pattern(lines, " ")
        coded = cut.flatten().dictionary_encode()
        word, words = coded.indices.to_numpy(), pc.list_value_length(cut).to_numpy()
        # texts are cut right where words have no white space at their ends but the line break in front
        size = pc.binary_length(pc.utf8_trim_whitespace(coded.dictionary)).to_numpy()
        breaks = pc.starts_with(coded.dictionary, "\n").to_numpy(zero_copy_only=False)
        torn = (size == 0) | (size + breaks != pc.binary_length(coded.dictionary).to_numpy())
        other = np.add.reduceat(torn[word], np.cumsum(words) - words, dtype=np.int64) > 0
        if not other.any():
            pool, size = self._word_ids(coded.dictionary)
            return [ids[len(self.line):] for ids in _texts(pool, size, word, words)]
        regular, irregular = np.flatnonzero(~other).tolist(), np.flatnonzero(other).tolist()
        out = dict(zip(regular, self._group([texts[i] for i in regular]))) if regular else {}
        keys = [spaced_keys(texts[i]) for i in irregular]
        coded = pa.array([k for own in keys for k in own], whole.type).dictionary_encode()
        pool, size = self._word_ids(coded.dictionary)
        out |= zip(irregular, _texts(pool, size, coded.indices.to_numpy(), np.array(list(map(len, keys)))))
        return [out[i] for i in range(len(texts))]

    def _word_ids(self, keys: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks end to end, and how many each has; signs at the end of a word are
        looked up apart from the word."""
        stem = pc.utf8_rtrim(keys, SIGNS)
        last = pc.utf8_slice_codeunits(stem, -1)
        signs = pc.binary_length(keys).to_numpy() - pc.binary_length(stem).to_numpy()
        if not self.spaces:  # the signs matter too
            behind = _cut_before(keys, signs).take(pa.array(np.arange(1, 2 * len(keys), 2)))
            last = pc.binary_join_element_wise(last, behind, pa.scalar("", keys.type))
        last = last.dictionary_encode()
        apart = np.array([self._stands_apart(c) for c in _strings(last.dictionary)], dtype=bool)[last.indices.to_numpy()]
        coded = _cut_before(keys, np.where(apart, signs, 0)).dictionary_encode()
        part, names = coded.indices.to_numpy().copy(), _strings(coded.dictionary)
        stems, part[::2] = _used(part[::2], len(names))
        tails, part[1::2] = _used(part[1::2], len(names))
        part[1::2] += len(stems)
        front = BARE if self.spaces else ""
        ids = self._ids_of([names[i] for i in stems] + [front + names[i] for i in tails if names[i]])
        for at, i in enumerate(tails):
            if not names[i]:  # no signs
                ids.insert(len(stems) + at, b"")
        pool, size = _pooled(ids)
        return _gathered(pool, size, part), size[part].reshape(-1, 2).sum(axis=1)

    def _stands_apart(self, end: str) -> bool:
        """Whether signs behind this letter never share a token with it; where white space is dropped, whether
        those given with it don't.  They do where lower-casing or normalisation leaves a mark behind the letter."""
        apart = self.tails.get(end)
        if apart is None:
            if self.spaces:
                cut = self.tokenizer.pre_tokenizer
                apart = bool(end and not end.isspace() and cut and len(cut.pre_tokenize_str(end + ".")) == 2)
            elif 1 < len(end) <= LONGEST_TAIL + 1 and end[0].isalnum():
                apart = self.whole(end) == self.whole(end[0]) + self.whole(end[1:])
            else:
                return False
            if len(self.tails) >= KEPT_TAILS:
                self.tails.clear()
            self.tails[end] = apart
        return apart

    def _ids_of(self, keys: list[str]) -> list[bytes]:
        """The ids of words, in their order."""
        found = list(map(self.young.get, keys))
        gaps = [j for j, ids in enumerate(found) if ids is None]
        older = list(map(self.old.get, [keys[j] for j in gaps]))
        self.young.update({keys[j]: ids for j, ids in zip(gaps, older) if ids is not None})
        new = {keys[j] for j, ids in zip(gaps, older) if ids is None}
        if new:
            self.young.update(self._encode_apart(list(new)))
        for j in gaps:
            found[j] = self.young[keys[j]]
        self._turn()
        return found
