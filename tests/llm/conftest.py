import random

import pytest

VOICES = {
    "en": "the of and to in is that was for with house river letter winter garden morning".split(),
    "de": "der die und das ist nicht mit von haus fluss schreiben winterzeit garten morgen übung größe".split(),
    "fr": "le la les et des une est dans maison rivière lettre hiver jardin matin élève forêt".split(),
}


def prose(lang: str, n: int, seed: int) -> str:
    rnd = random.Random(f"{lang}{seed}")
    return " ".join(rnd.choice(VOICES[lang]) for _ in range(n))


def fixture_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, fp, size): nulls, empties, repeats, ties, near copies, a long text."""
    rows = []
    for k in range(60):
        lang = "en de fr".split()[k % 3]
        text = prose(lang, 20 + k, k)
        rows.append((k, text + (".\nReleased under the MIT License." if k % 10 == 0 else ""), lang, f"s{k % 4}" if k % 7 else None))
    base = prose("en", 300, 999)
    rows += [(100 + k, base.replace("river", "River", k), "en", "s0") for k in range(4)]  # equal but for A-Z
    rows += [(110 + k, base + f" ending number{k}", "en", "s0") for k in range(40)]  # near copies
    rows += [(200, None, None, "s1"), (201, "", "en", None), (202, " \t\n", "de", "s2"), (203, "1234 !!", "fr", "s2")]
    rows += [(204, "x" * 30_000 + " " + prose("fr", 4000, 5), "fr", "s3")]
    rows += [(205, "mail Ann.Lee@Site.org or ann.lee@site.org, +1 (017) 555-7713, 10.2.3.4, 4111111111111111 <|endoftext|> Mrs Anna Fox", "en", "s3")]
    rows += [(None, "row without a number", "en", "s1"), (None, None, None, None), (7, "a second row seven", "en", "s3"), (7, "a second row seven", "en", "s3")]
    return [(i, t, lang, s, len(t or ""), "clash", 5) for i, t, lang, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size int"


@pytest.fixture(scope="session")
def rows():
    return fixture_rows()


@pytest.fixture(scope="session")
def folder(spark, rows, tmp_path_factory):
    """The rows as a documents table."""
    path = tmp_path_factory.mktemp("text")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="session")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    """The same table without rows."""
    path = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")
