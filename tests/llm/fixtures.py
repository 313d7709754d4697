"""Small tables with every odd case: nulls, empty and long texts, ties, repeated
rows, extra columns with clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, rep long, sig string, rank int"


def texts() -> list[str | None]:
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 9)))
    base = " ".join(word() for _ in range(300))
    near = base.split()
    near[150] = "CHANGED"
    passage = " ".join(word() for _ in range(40))
    return [
        base,
        base,
        " ".join(near),
        base.upper(),
        None,
        "",
        "   \n\t ",
        "one",
        "One",
        "two words",
        "x " * 400,
        "x " * 500,
        "naïve Ünïcode é́ ﬁ 日本語テキスト 🙂 " * 5,
        " ".join(word() for _ in range(20)) + " " + passage,
        passage + " " + " ".join(word() for _ in range(25)),
        " ".join(word() for _ in range(9000)),
        "a<|endoftext|>b don't STOP",
        base,
    ]


def documents(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    if rows is None:
        rows = [(i * 3 + 1, t, ["en", "fr", None][i % 3], f"src{i % 4}" if i % 5 else None) for i, t in enumerate(texts())]
        rows += [rows[0], (None, "no id here at all", "en", "src1")]
    return spark.createDataFrame([(d, t, g, s, len(t or ""), 1, 2, "s", 3) for d, t, g, s in rows], SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
