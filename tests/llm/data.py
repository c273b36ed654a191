"""Small documents with every awkward case."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

#: Besides the columns of documents, names that the operators might use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, size string, comp string, rep string, norm string, block string, __id string, __y string, hits string, i string, s string, k string, part string, ids string"
WORDS = [a + b for a in "ba ko lu mi ne po ri su ta ve".split() for b in "na rel dor mit s tan gus len pir wos".split()]
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts(seed: int = 1) -> list[tuple]:
    """(doc_id, text, source): plain texts, exact and near copies, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(8, 90)) for _ in range(24)]
    out = [(i * 3, t, "abc"[i % 3]) for i, t in enumerate(base)]
    out += [(100, base[0], "a"), (101, base[0].replace(" ", " \n\t", 2), "b"), (102, base[1].upper(), "c")]
    for k in range(6):  # one word of a long text changed
        w = (prose(random.Random(99), 120)).split()
        w[10 * k + 5] = "changed"
        out.append((110 + k, " ".join(w), "a"))
    out += [(120, None, None), (121, "", "a"), (122, " \n ", "b"), (123, "one two", "c"), (124, "one two", None), (125, "é ü 你好 😀 naïve", "c")]
    out += [(130, prose(rng, 30_000), "a"), (131, "x" * 300_000, "b"), (132, "same row twice here now again", "a"), (132, "same row twice here now again", "a")]
    out += [(None, "a row without an id but with words", "a"), (140, "Write to ann.lee@mail.example.org or +1 415 555 2671 now", "b")]
    return out


def frame(spark: SparkSession, rows: list[tuple] | None = None, extra: bool = True) -> DataFrame:
    rows = texts() if rows is None else rows
    full = [(i, t, "en" if i != 121 else None, s, None if t is None else len(t), *["clash"] * 15) for i, t, s in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def words(t: str | None) -> list[str]:
    return [w for w in SPACE.split(lower(t or "")) if w]
