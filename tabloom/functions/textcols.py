"""Text cleaning and token expressions; each is one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.scalars import _c, collapse_whitespace, words

# Contraction endings and their expansions, applied in this order.
CONTRACTIONS = (
    ("n't", " not"), ("'re", " are"), ("'s", " is"), ("'ll", " will"), ("'ve", " have"),
    ("'d", " would"), ("'m", " am"), ("won't", "will not"), ("can't", "cannot"), ("cannot't", "cannot"),
)
# The same pairs with whole words ahead of endings, so that "won't" is reached.
CONTRACTIONS_WHOLE_FIRST = tuple(sorted(CONTRACTIONS, key=lambda kv: kv[0] not in ("won't", "can't", "cannot't")))

WORD = r"[\p{L}\p{N}_]"
TOKEN = WORD + "{2,}"
SPACE = r"[\s\p{Z}]"


def lowercase(x) -> Column:
    return F.lower(_c(x))


def expand_contractions(x, corrected: bool = False) -> Column:
    out = _c(x)
    for old, new in CONTRACTIONS_WHOLE_FIRST if corrected else CONTRACTIONS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def remove_urls(x) -> Column:
    return F.regexp_replace(_c(x), r"https?://\S+|www\.\S+|(?:\S+@\S+\.\S+)", " ")


def remove_markup(x) -> Column:
    """Tags and @mentions become blanks; the word of a #hashtag stays."""
    no_tags = F.regexp_replace(_c(x), r"<[^>]+>", " ")
    no_mentions = F.regexp_replace(no_tags, "@" + WORD + "+", " ")
    return F.regexp_replace(no_mentions, "#(" + WORD + "+)", "$1")


def remove_punctuation(x) -> Column:
    return F.regexp_replace(_c(x), r"[^\p{L}\p{N}\p{M}_\s]", " ")


def remove_digits(x) -> Column:
    return F.regexp_replace(_c(x), r"\p{Nd}+", " ")


def remove_stopwords(x, stopwords: list[str]) -> Column:
    """Drop words found in the supplied list, whatever their case."""
    stop = sorted(set(stopwords))  # becomes one hash set of the plan
    return F.array_join(F.filter(words(x), lambda w: ~F.lower(w).isin(stop)), " ")


def drop_short_tokens(x, min_length: int = 3) -> Column:
    return collapse_whitespace(F.array_join(F.filter(words(x), lambda w: F.length(w) >= min_length), " "))


STEPS = {
    "lowercase": lowercase,
    "contractions": expand_contractions,
    "urls": remove_urls,
    "markup": remove_markup,
    "punctuation": remove_punctuation,
    "digits": remove_digits,
    "stopwords": remove_stopwords,
    "short_tokens": drop_short_tokens,
}


def ngrams(tokens: Column, n: int) -> Column:
    """Sliding window over a token array; no shuffle.

    Shifted slices are zipped, so the token array is evaluated n times per row, not once per gram.
    """
    out = tokens
    length = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    if n > 1:
        out = F.slice(tokens, F.lit(1), length)
    for shift in range(1, n):
        out = F.zip_with(out, F.slice(tokens, F.lit(shift + 1), length), lambda a, b: F.concat_ws(" ", a, b))
    return out


def ngram_range(tokens: Column, low: int, high: int) -> Column:
    if low == high:
        return ngrams(tokens, low)
    return F.concat(*[ngrams(tokens, n) for n in range(low, high + 1)])


def word_tokens(x) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit("(" + TOKEN + ")"), F.lit(1))
