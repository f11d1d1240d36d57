"""Small tables with the cases that every operator has to stand."""

from __future__ import annotations

import random

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, __row string, "
        "__id string, score string, size string, kept string, epoch string, words string, "
        "text_id string, n string, anchor string")
CLASH = ("x",) * 10

_rng = random.Random(4)
VOCABULARY = ["".join(_rng.choices("abcdefghijklmnopqrstuvwxyzé", k=_rng.randint(2, 8)))
              for _ in range(400)]


def prose(n: int, seed: int) -> str:
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


def edited(text: str, changes: int, seed: int) -> str:
    words, rng = text.split(" "), random.Random(seed)
    for i in rng.sample(range(len(words)), changes):
        words[i] = rng.choice(VOCABULARY)
    return " ".join(words)


def texts() -> list[str | None]:
    long_one = prose(20_000, 1)
    passage = prose(70, 2)
    out = [None, "", None, " ", "\n\t", "one", "one", "One", "two words", "ünï", "日本語 テキスト",
           "=" * 700, "na " * 300, long_one, long_one, long_one + " end"]
    out += [prose(80, 100 + i) for i in range(20)]
    out += [prose(30, 200 + i) + " " + passage + " " + prose(30, 300 + i) for i in range(6)]
    base = prose(300, 3)
    out += [base] * 5 + [edited(base, k, 400 + k) for k in (1, 2, 3, 4, 5, 6, 8, 10, 20)]
    out += ["Released under the MIT License.", "CC BY-NC 4.0 or the apache\nlicense",
            "gnu general public license, permit license\r\n\r\n"]
    return out


def rows(extra: list[tuple] | None = None) -> list[tuple]:
    sources = ["a", "b", None, "a", "a", "é", "", "Z"]
    out = []
    for i, text in enumerate(texts()):
        out.append((None if i == 4 else 10 * i, text, None if i % 7 == 0 else "en",
                    sources[i % len(sources)], None, *CLASH))
    out += [out[20], out[20], out[7]]  # rows that occur more than once
    return out


def documents(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3, "doc_id").sortWithinPartitions(
        "doc_id", "text")


def on_disk(spark, df, path) -> str:
    """The table in a folder as the queries expect it."""
    df.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


def empty(df):
    return df.where("1 = 0")
