"""Language ID by segmentation-marginalised unigrams over the pieces of a public vocabulary.

Each language has a probability for every piece. The probability of a word is the sum over all ways
to cut it into pieces, found by a forward pass over its characters; a text is the product over its
words. Words are runs of letters in lower case with the vocabulary's mark of a word start in front;
runs of more than LONGEST letters are cut into parts of that length. A character that is no piece
has a small probability of its own, so every word can be cut.

Piece probabilities are learned by expectation maximisation: each round, tasks add up the expected
uses of every piece in the training words (forward-backward) and only sums per language and piece
reach the driver. Training reads whole texts of a sample whose size is bounded per language
(``sample``); the bound is a parameter and the sample follows from hashes of the ids.

Nulls and empties: a text that is null or has no letter is ``und`` with score 0. Training ignores
rows without text or lang; with no training rows at all every text is ``und``. Ties go to the first
language in alphabetical order. Repeated rows and ids give a row each; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.blocks import as_texts, cut, keep_rows, map_blocks, texts_of
from tabloom.session import cut_lineage

START = "▁"  # the vocabulary's mark of a word start
LONGEST = 40  # letters of a word; longer runs are cut
UNKNOWN = 1e-7  # probability of a character that is no piece
SMOOTH = 0.1  # added to the expected uses of each piece
REMEMBERED = 300_000  # words a task remembers before it starts anew
SAMPLE = 2_000  # training documents per language
LETTERS = re.compile(r"[^\W\d_]+")
UND = "und"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> dict[str, int]:
    """Lower-case pieces of letters (with or without the mark of a word start), numbered in the vocabulary's order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    letters = (n for n in names if n.removeprefix(START).isalpha())
    return {n: i for i, n in enumerate(dict.fromkeys(letters))}


def words_of(token: str) -> list[str]:
    """Words of a blank-separated token."""
    runs = [token] if token.isalpha() and len(token) <= LONGEST else LETTERS.findall(token)
    out = []
    for run in runs:
        letters = run if run.isalpha() else "".join(filter(str.isalpha, run))  # the class above also has numerals that are no letters
        out.extend(START * (i == 0) + letters[i:i + LONGEST] for i in range(0, len(letters), LONGEST))
    return out


BASE = np.uint64(0x9E3779B97F4A7C15)


def characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(position, word) matrix of code points plus one, 0 behind a word's end, and the words' lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((int(sizes.max(initial=0)), len(words)), dtype=np.uint64)
    starts = np.cumsum(sizes) - sizes
    column = np.repeat(np.arange(len(words)), sizes)
    out[np.arange(len(column)) - np.repeat(starts, sizes), column] = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    return out, sizes


class Tables:
    """Pieces by length: sorted 64-bit polynomial hashes and the pieces' numbers. No two pieces share a hash."""

    def __init__(self, pieces: dict[str, int]):
        self.size = len(pieces)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths: dict[int, list[str]] = {}
        for name in pieces:
            lengths.setdefault(len(name), []).append(name)
        self.longest = max(lengths, default=0)
        for n, names in lengths.items():
            matrix, _ = characters(names)
            key = np.zeros(len(names), dtype=np.uint64)
            for row in matrix:
                key = key * BASE + row
            order = np.argsort(key)
            if len(np.unique(key)) < len(key):
                raise ValueError("two pieces share a hash")
            self.by_length[n] = key[order], np.array([pieces[x] for x in names])[order]


class Lattice:
    """All pieces in many words: for every end position and piece length, the piece or the unknown one.

    The hash of every part of a word follows from that of the part one shorter; parts of one length
    are looked up at once by binary search.
    """

    def __init__(self, words: list[str], tables: Tables):
        matrix, self.sizes = characters(words)
        width, longest = len(matrix), min(tables.longest, len(matrix))
        none, unknown = tables.size + 1, tables.size
        self.ids = np.full((width + 1, max(longest, 1) + 1, len(words)), none, dtype=np.int32)
        inside = np.arange(1, width + 1)[:, None] <= self.sizes
        key = np.zeros((width + 1, len(words)), dtype=np.uint64)
        for n in range(1, max(longest, 1) + 1):
            key[n:] = key[n - 1:-1] * BASE + matrix[n - 1:]
            ends = inside[n - 1:]
            if n == 1:
                self.ids[1:, 1][ends] = unknown
            keys, values = tables.by_length.get(n, (None, None))
            if keys is None:
                continue
            part = key[n:][ends]
            at = np.searchsorted(keys, part)
            at[at == len(keys)] = 0
            found = self.ids[n:, n][ends]
            self.ids[n:, n][ends] = np.where(keys[at] == part, values[at], found)

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """(position, word, language): summed probability of all cuts of the first characters."""
        width, longest, n = self.ids.shape[0] - 1, self.ids.shape[1] - 1, self.ids.shape[2]
        alpha = np.zeros((width + 1, n, prob.shape[1]))
        alpha[0] = 1
        for j in range(1, width + 1):
            for size in range(1, min(j, longest) + 1):
                ids = self.ids[j, size]
                live = np.flatnonzero(ids < len(prob) - 1)
                if len(live):
                    alpha[j, live] += alpha[j - size, live] * prob[ids[live]]
        return alpha

    def totals(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[self.sizes, np.arange(len(self.sizes))]

    def expected(self, prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(piece, language): expected uses of each piece in words that occur ``counts`` (word, language) times."""
        width, longest, n = self.ids.shape[0] - 1, self.ids.shape[1] - 1, self.ids.shape[2]
        alpha = self.forward(prob)
        beta = np.zeros_like(alpha)
        beta[self.sizes, np.arange(n)] = 1
        total = self.totals(alpha)
        scale = counts / total
        out = np.zeros_like(prob)
        for j in range(width, 0, -1):
            for size in range(1, min(j, longest) + 1):
                ids = self.ids[j, size]
                live = np.flatnonzero(ids < len(prob) - 1)
                if len(live):
                    through = prob[ids[live]] * beta[j, live]
                    np.add.at(out, ids[live], alpha[j - size, live] * through * scale[live])
                    beta[j - size, live] += through
        return out


def lattices(words: list[str], tables: Tables, size: int = 4_000):
    """(indices, lattice) over words of similar length, so that little is padded."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    for at in range(0, len(order), size):
        chosen = order[at:at + size]
        yield chosen, Lattice([words[k] for k in chosen], tables)


class Model:
    """Languages and piece probabilities; the last two rows are the unknown character and nothing."""

    def __init__(self, languages: list[str], prob: np.ndarray, path: str):
        self.languages, self.prob, self.path = languages, prob, path


def with_unknown(uses: np.ndarray) -> np.ndarray:
    smooth = uses + SMOOTH
    prob = smooth / smooth.sum(axis=0) * (1 - UNKNOWN)
    width = uses.shape[1]
    return np.vstack([prob, np.full((1, width), UNKNOWN), np.zeros((1, width))])


def fit(train: DataFrame, path: str | None = None, sample: int = SAMPLE, rounds: int = 3) -> Model:
    """Learn from ``train`` (doc_id, text, lang): at most about ``sample`` documents of each language, whole."""
    path = path or default_path()
    pieces = load_pieces(path)
    rows = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 0)), path)
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000.0  # null and repeated ids spread by their texts
    share = F.lit(None).cast("double")
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(sample / sizes[lang])).otherwise(share)
    chosen = rows.where(place < share).select("lang", "text")

    def count(batches):
        index = {lang: i for i, lang in enumerate(languages)}
        for batch in batches:
            for part in cut(batch):
                seen = Counter()
                for lang, text in zip(part.column("lang").to_pylist(), as_texts(part.column("text"))):
                    for token, n in Counter(text.lower().split()).items():
                        for word in words_of(token):
                            seen[index[lang], word] += n
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.string()),
                                                  pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    words = chosen.mapInArrow(count, "lang int, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = cut_lineage(words)
    prob = with_unknown(np.zeros((len(pieces), len(languages))))

    def step(prob):
        def run(batches):
            uses, tables = np.zeros_like(prob), Tables(pieces)
            for batch in batches:
                lang, word, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "word", "n"))
                for chosen, lattice in lattices(list(word), tables):
                    counts = np.zeros((len(chosen), len(languages)))
                    counts[np.arange(len(chosen)), lang[chosen]] = n[chosen]
                    uses += lattice.expected(prob, counts)
            piece, lang = np.nonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(uses[piece, lang])], ["piece", "lang", "uses"])

        return run

    for _ in range(rounds):
        # At most one row per piece and language, whatever the input.
        sums = words.mapInArrow(step(prob), "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.zeros_like(prob)
        uses[sums["piece"].to_numpy(), sums["lang"].to_numpy()] = sums["uses"].to_numpy()
        prob = with_unknown(uses[: len(pieces)])
    return Model(languages, prob, path)


class Scorer:
    """Log probabilities of texts; remembers the vector of every token it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.tables = Tables(load_pieces(model.path))
        self.index: dict[str, int] = {}
        self.values = np.zeros((0, len(model.languages)))

    def learn(self, tokens: list[str]) -> None:
        parts = [words_of(t) for t in tokens]
        words = list(dict.fromkeys(chain.from_iterable(parts)))
        logs = np.zeros((len(words), len(self.model.languages)))
        for chosen, lattice in lattices(words, self.tables):
            logs[chosen] = np.log(lattice.totals(lattice.forward(self.model.prob)))
        at = {w: i for i, w in enumerate(words)}
        flat = np.fromiter((at[w] for p in parts for w in p), np.int64)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        values = np.zeros((len(tokens), logs.shape[1]))
        np.add.at(values, owner, logs[flat])
        begin = len(self.index)
        self.index.update((t, begin + i) for i, t in enumerate(tokens))
        self.values = np.vstack([self.values[:begin], values])

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability per text and language, whether the text has a letter)."""
        split = [t.lower().split() for t in texts]
        if len(self.index) > REMEMBERED:
            self.index, self.values = {}, self.values[:0]
        new = list(set(chain.from_iterable(split)).difference(self.index))
        if new:
            self.learn(new)
        sizes = np.array([len(s) for s in split])
        sums = np.zeros((len(texts), self.values.shape[1]))
        if sizes.sum():
            flat = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
            full = np.flatnonzero(sizes)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))[full]
            sums[full] = np.add.reduceat(self.values[flat], starts, axis=0)
        return sums, (sums < 0).any(axis=1)  # any word of letters has a probability below 1


def judged(model: Model):
    """A function from texts to (position of the language, score); the position after the last language is ``und``."""
    scorer = Scorer(model) if model.languages else None

    def work(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        best, score = np.full(len(texts), len(model.languages)), np.zeros(len(texts))
        if scorer is not None and texts:
            logs, has = scorer.score(texts)
            weight = np.exp(logs - logs.max(axis=1, keepdims=True))
            best = np.where(has, logs.argmax(axis=1), best)
            score = np.where(has, weight.max(axis=1) / weight.sum(axis=1), 0.0)
        return best, score

    return work


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score); the score is the probability of the language given that all are equally likely."""
    languages = np.array([*model.languages, UND], dtype=object)

    def make():
        judge = judged(model)

        def work(block: pa.RecordBatch) -> pa.RecordBatch:
            best, score = judge(as_texts(block.column("text")))
            return pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(languages[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

        return work

    return map_blocks(texts_of(docs, "doc_id"), make, "doc_id bigint, lang_pred string, score double")


def held_out() -> Column:
    """A fifth of the documents, by a checksum of their id; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, path: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the rows that are not held out."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"), path, sample)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose language is recognised with a score of at least ``least``."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))

    def make():
        judge = judged(model)

        def keep(block: pa.RecordBatch) -> np.ndarray:
            best, score = judge(as_texts(block.column("text")))
            return (best < len(model.languages)) & (score >= least)

        return keep

    return keep_rows(docs, make)
