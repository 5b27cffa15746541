"""BPE encoding and decoding with the vocabulary of a public tokenizer file, by merge rounds in numpy.

The words that a block of texts brings for the first time become one flat array of symbols. In each
round the rank of every adjacent pair is found by binary search over the sorted pair keys, each word
merges all occurrences of its lowest-ranked pair, and the array is compacted; words without a
mergeable pair leave. Encoded words are remembered in the task, so a text costs one lookup per word.

The file must be a BPE model with an end-of-word suffix and byte-level symbols, and its normalizer
must be NFC, runs of white space to one blank, lower case; ``load`` checks that.

Nulls and empties: a null or empty text has no tokens and decodes to the empty text. Texts of any
length are encoded whole; repeated rows and ids stay; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.blocks import as_texts, map_blocks, texts_of

REMEMBERED = 400_000  # words a task remembers before it starts anew
PLAIN = 0x557  # texts up to this character use a small character class
MARK = "A "  # no word holds a blank or a capital letter
#: Letters (ranges of code points) that the tokenizer library knows and ``unicodedata`` does not yet.
NEWER_LETTERS = (
    "1c89-1c8a a7cb-a7ce a7d2 a7d4 a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e "
    "11390-113b5 113b7 113d1 113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 16ea0-16eb8 18cff 1e5d0-1e5ed 1e5f0"
)
#: Capital letters (code points) that the tokenizer library lower-cases and Python does not yet, with their lower case.
NEWER_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
NEWER_CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Fixed value: how the tokenizer file splits text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    """The vocabulary file used where the caller names none; the package lies on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class Vocabulary:
    """Sorted pair keys with ranks and merged ids, ids of single symbols, and the strings of ids."""

    def __init__(self, spec: dict):
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if model["type"] != "BPE" or not suffix or kinds != ["NFC", "Replace", "Lowercase"] or split != SPLIT or spec["decoder"] is not None:
            raise ValueError("not a tokenizer file of the kind this encoder reads")
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max(chain(ids.values(), self.special.values()))
        self.strings = [""] * self.size
        for content, i in chain(ids.items(), self.special.items()):
            self.strings[i] = content
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols])
        self.last = np.array([ids[s + suffix] for s in symbols])
        left = np.array([ids[a] for a, _ in model["merges"]], dtype=np.int64)
        right = np.array([ids[b] for _, b in model["merges"]], dtype=np.int64)
        merged = np.array([ids[a + b] for a, b in model["merges"]], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order, merged[order]
        # All occurrences of a pair may be merged in one round only if no merge makes a symbol that an earlier merge needs.
        first = np.full(self.size, -1)
        last = np.full(self.size, -1)
        ranks = np.arange(len(merged))
        last[merged] = ranks
        first[merged[::-1]] = ranks[::-1]
        self.ordered = bool((last[left] < ranks).all() and (last[right] < ranks).all())

    def symbols_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat symbols of all words, and the word of each symbol."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        flat = np.frombuffer(b"".join(data), dtype=np.uint8)
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        out = self.inner[flat]
        ends = np.cumsum(sizes) - 1
        out[ends] = self.last[flat[ends]]
        return out, np.repeat(np.arange(len(words)), sizes)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all (non-empty) words, and where each word's ids begin (with the end)."""
        symbols, word = self.symbols_of(words)
        done_symbols, done_word = [], []
        none = len(self.keys)
        while len(symbols):
            pair = symbols[:-1] * self.size + symbols[1:]
            at = np.searchsorted(self.keys, pair)
            at[at == none] = 0
            known = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank = np.append(np.where(known, self.ranks[at], none), none)
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(word)))
            least = np.repeat(lowest, size)
            live = least < none
            done_symbols.append(symbols[~live])
            done_word.append(word[~live])
            hit = live & (rank == least)
            spots = np.flatnonzero(hit)
            if not len(spots):
                break
            if self.ordered:
                # In a run of overlapping occurrences (a pair of equal symbols) every second one merges, from the left.
                opens = np.append(True, (np.diff(spots) != 1) | (word[spots[1:]] != word[spots[:-1]]))
                starts = np.flatnonzero(opens)
                within = np.arange(len(spots)) - np.repeat(starts, np.diff(np.append(starts, len(spots))))
                spots = spots[within % 2 == 0]
            else:
                spots = spots[np.append(True, word[spots[1:]] != word[spots[:-1]])]  # the leftmost of each word
            symbols = symbols.copy()
            symbols[spots] = self.merged[at[spots]]
            live[spots + 1] = False
            symbols, word = symbols[live], word[live]
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(words)))))

    def decode(self, ids) -> str:
        """Strings of the ids, a blank between them: the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, ids))


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(json.load(f))


has_newer_capital = re.compile(f"[{''.join(map(chr, NEWER_CAPITALS))}]").search


def lowered(text: str) -> str:
    """Lower case of each character by itself, so without the rule for a final sigma."""
    low = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
    return low if text.isascii() or has_newer_capital(low) is None else low.translate(NEWER_CAPITALS)


def splitter(low: int = 0, high: int = PLAIN) -> Callable[[str], list[str]]:
    """``findall`` of the split pattern for characters from ``low`` to ``high``.

    Classes come from ``unicodedata`` (whose Unicode version agrees with the tokenizer library): words and
    contractions cannot begin alike, so the order of these two alternatives does not matter.
    """
    kinds = [unicodedata.category(chr(c))[0] for c in range(low, high + 1)]
    blank = {*map(chr, range(9, 14)), "\x85"}
    for span in NEWER_LETTERS.split() if high > PLAIN else []:
        first, _, last = span.partition("-")
        for c in range(int(first, 16), int(last or first, 16) + 1):
            kinds[c - low] = "L"

    def ranges(kind: str, more: set[str] = frozenset()) -> str:
        hits = np.array([k == kind or chr(low + i) in more for i, k in enumerate(kinds)] + [False])
        edges = np.flatnonzero(np.diff(np.concatenate(([False], hits)).astype(np.int8)))
        return "".join(f"\\U{low + a:08x}-\\U{low + b - 1:08x}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()))

    letter, number, space = ranges("L"), ranges("N"), ranges("Z", blank)
    return re.compile(f"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{number}]|[^{letter}{number}{space}]+").findall


class Encoder:
    """Encodes texts; remembers ids (as bytes) and the joined token strings of the words it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.ids: dict[str, bytes] = {}
        self.strings: dict[str, str] = {}
        self.plain = splitter()
        self.full = None
        self.beyond = re.compile(f"[^\0-\\U{PLAIN:08x}]").search
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens; runs of blanks only separate, so they need no replacing."""
        if text.isascii():
            return self.plain(text.lower())
        text = lowered(unicodedata.normalize("NFC", text))
        if self.beyond(text) is None:
            return self.plain(text)
        if self.full is None:
            self.full = splitter(high=0x10FFFF)
        return self.full(text)

    def pieces(self, text: str) -> list[str]:
        """Words in order; a special token stands as it is written, in a form that no word can have (upper case mark)."""
        if self.specials is None or self.specials.search(text) is None:
            return self.split(text)
        out: list[str] = []
        for part in self.specials.split(text):
            out.extend([MARK + part] if part in self.v.special else self.split(part))
        return out

    def learn(self, words: list[str]) -> None:
        ids, begin = self.v.encode_words(words)
        data = ids.astype("<u4").tobytes()
        strings = list(map(self.v.strings.__getitem__, ids.tolist()))
        begin = begin.tolist()
        for word, a, b in zip(words, begin, begin[1:]):
            self.ids[word] = data[4 * a:4 * b]
            self.strings[word] = " ".join(strings[a:b])

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of every text."""
        split = [self.pieces(t) for t in texts]
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
            self.strings.clear()
        if not self.ids:
            for name, i in self.v.special.items():
                self.ids[MARK + name] = np.array([i], dtype="<u4").tobytes()
                self.strings[MARK + name] = name
        new = list(set(chain.from_iterable(split)).difference(self.ids))
        if new:
            self.learn(new)
        ids, strings = self.ids.__getitem__, self.strings.__getitem__
        return [(b"".join(map(ids, words)), " ".join(map(strings, words))) for words in split]


def encode_documents(docs: DataFrame, path: str | None = None, texts: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row; with ``texts`` also ids and the decoded text."""
    path = path or default_path()

    def make():
        encoder = Encoder(load(path))

        def work(block: pa.RecordBatch) -> pa.RecordBatch:
            found = encoder.encode(as_texts(block.column("text")))
            columns = {
                "doc_id": block.column("doc_id"),
                "n_tokens": pa.array([len(i) // 4 for i, _ in found], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i, _ in found]),
                "decoded_sha256": pa.array([hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for _, d in found]),
            }
            if texts:
                columns["ids"] = pa.array([np.frombuffer(i, dtype="<u4").astype(np.int64) for i, _ in found], pa.list_(pa.int64()))
                columns["decoded"] = pa.array([d for _, d in found])
            return pa.RecordBatch.from_pydict(columns)

        return work

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>, decoded string" * texts
    return map_blocks(texts_of(docs, "doc_id"), make, schema)


def decode_ids(rows: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``rows`` (doc_id, ids) with the decoded text; null ids decode to null, ids outside the vocabulary raise."""
    path = path or default_path()

    def run(batches):
        v = load(path)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([None if x is None else v.decode(x) for x in lists], pa.string())], ["doc_id", "decoded"])

    return rows.select("doc_id", F.col(ids).alias("ids")).mapInArrow(run, "doc_id bigint, decoded string")
