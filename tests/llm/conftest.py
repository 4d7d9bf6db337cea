import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, key int, _sha string, rejected string"


def words(r: random.Random, n: int, of: str = "abcdefghij") -> str:
    return " ".join("".join(r.choice(of) for _ in range(r.randint(2, 6))) for _ in range(n))


def rows():
    """Null ids, texts and languages, empty and very long texts, ties, repeated rows, near copies, and columns named like those of results."""
    r = random.Random(5)
    base = [words(r, 60) for _ in range(12)]
    texts = [*base, base[0], base[0] + " ", base[0].replace(" ", "  "), base[1].upper(), base[2] + " zz", base[2] + " yy", None, "", " \n\t", "...", words(r, 40_000), "a" * 70_000, "x\0y", "日本語テキスト。" * 20]
    out = [(k, t, ["en", "fr", None][k % 3], f"s{k % 2}", None, "clash", k, "clash", None) for k, t in enumerate(texts)]
    return out + [out[3], out[3], (None, base[4], "en", None, None, None, None, None, None), (None, "alone " + base[5][::-1], None, None, None, None, None, None, None)]


@pytest.fixture
def odd(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
