"""Small tables with the awkward cases, and a seeded corpus."""

import random

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that the operators use themselves or that clash with what they add.
EXTRA = ["key", "size", "rank", "slice", "place", "score", "fp", "component", "hashes", "failed", "node", "mix_key", "words"]

AWKWARD = [
    (1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \t\n\x0b\x0c\r ", "en", "a", 7), (None, "no id at all here", "fr", "b", 17), (4, "one", "en", None, 3),
    (5, "the same text twice in the table", "en", "a", 32), (5, "the same text twice in the table", "en", "a", 32), (6, "the same text twice in the table", "de", "b", 32),
    (7, "été été ÇA ñ 日本語 \U0001f600 á", "fr", "b", 20), (8, "x" * 5000, "en", "a", 5000), (9, "long word list " * 3000, "en", "a", 45000),
    (10, "### $$$ &&& 12 34 | <|endoftext|> | END", "en", "c", 20), (11, "a b c", "de", "c", 5), (12, "A  B\nC", "de", "c", 6),
]


def table(spark, rows=AWKWARD, extra=False):
    df = spark.createDataFrame(rows, COLUMNS)
    if extra:
        for name in EXTRA:
            df = df.selectExpr("*", f"'x' as {name}")
    return df


def corpus(n=120, seed=7):
    """Invented prose in two languages with exact and near copies."""
    r = random.Random(seed)
    words = {"en": ["the", "of", "and", "ing", "tion", "ther", "with", "hand", "thing", "water", "onder"], "de": ["der", "und", "ung", "schein", "über", "keit", "ß", "nicht", "lich", "größe", "wenn"]}
    out = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        if i % 10 == 9:
            old = out[r.randrange(len(out))]
            body = old[1].split(" ")
            if i % 20 == 9:
                body[r.randrange(len(body))] = "changed"
            out.append((i, " ".join(body), old[2], f"s{i % 4}", 0))
            continue
        body = ["".join(r.choice(words[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 120))]
        out.append((i, " ".join(body) + r.choice([".", "", "\n" + body[0]]), lang, f"s{i % 4}", 0))
    return out


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))
