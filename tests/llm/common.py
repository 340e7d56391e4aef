"""Small tables with the awkward cases that every operator must take."""

import random
import re

LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns under names that the operators use inside.
CLASHING = {"i": "0", "t": "'t'", "tk": "1L", "u": "2L", "q": "3L", "x": "4L", "s": "'s'", "z": "5L", "n": "6L", "block": "7", "row": "'r'", "place": "1.5D", "h1": "8L", "accepted": "false", "_c0": "9"}
WORDS = {"en": "the of and to in is that for it was on are with as his they at be this from", "fr": "le la les des une est que dans pour qui sur avec plus par être cette ses leur été", "de": "der die und das nicht sich mit auf für eine dem des auch als werden über wird noch einer"}


def sentence(rng, lang="en", n=60):
    base = WORDS[lang].split()
    return " ".join(rng.choice(base) if rng.random() < 0.5 else rng.choice(base)[:2] + rng.choice(base) + rng.choice(base)[:3] for _ in range(n))


def awkward():
    rng = random.Random(3)
    same = sentence(rng)
    rows = [(1, same), (1, same), (2, same), (3, None), (None, same), (None, None), (4, ""), (5, " \n\t "), (6, "!!! 123 ???"), (7, LONG), (8, "one"), (9, "one"), (10, "a\x00b ퟿")]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None) for k, (i, t) in enumerate(rows)]


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    return df.selectExpr("*", *[f"{v} AS {k}" for k, v in CLASHING.items()])


def tokens(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)
