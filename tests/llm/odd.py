"""A small table with every odd case: nulls, empty, blank and very long texts, copies, repeated
rows, text with special names, and extra columns whose names clash with those of the operators."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])
CLASHES = ("size", "score", "class_id", "part", "rank", "known", "hash", "weight", "kept",
           "n_words", "_m", "_row", "_id", "copies", "shard", "block", "extra", "band", "bin")


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    parts = "an be co du el fi ga ho in ju ko la mi no op pe qu ri so ta".split()
    words = ["".join(rng.choices(parts, k=1 + i % 4)) for i in range(vocabulary)]
    out = []
    for i in range(n):
        w = rng.choice(words if rng.random() < 0.6 else words[:30])
        out.append(w.capitalize() + "." if i % 11 == 10 else w)
    text = " ".join(out)
    return re.sub(r"\. ", lambda m: ".\n" if rng.random() < 0.3 else ". ", text)


def rows(seed: int = 5, n: int = 40, long_words: int = 350_000) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append((100 + i, prose(rng, rng.randint(1, 300)), rng.choice(["en", "de", None]),
                    rng.choice(["a", "a", "b", "ü", None]), 7))
    body = prose(rng, 200)
    words = body.split(" ")
    words[100] = "changed"
    out += [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t ", "en", "b", 4),
        (4, "one two three", "de", "a", 13), (5, "one two three", None, "a", 13),
        (6, body, "en", "b", 1), (7, body, "en", "b", 1), (7, body, "en", "b", 1),
        (8, " ".join(words), "en", "a", 2), (9, body + "\n" + prose(rng, 12), "en", "ü", 3),
        (10, out[0][1] + " " + body + " " + out[1][1], "de", "a", 4),
        (11, "<|endoftext|> names  of specials \U0001F600 é́ it's 12 ½ x²\x1c", "en", "a", 5),
        (12, "### $$$ %%% 12 345 &&&", None, "b", 6), (13, (body + " ") * 3, "en", "a", 7),
        (None, "a text without an id " * 6, "en", "a", 8), (None, None, None, None, None),
        (14, "AGAIN!! " * 30, "en", "b", 9),
    ]
    if long_words:
        out.append((15, prose(rng, long_words, 5000), "en", "a", 10))
    return out


def frame(spark, data: list[tuple], clashes: bool = False):
    df = spark.createDataFrame(data, SCHEMA).repartition(3, "n_chars")
    if clashes:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit("mine") for c in CLASHES})
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
