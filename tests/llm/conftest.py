from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, taken long, spans string, kept boolean, row string, node string"


def doc(i, text, source="s1", lang="en"):
    return (i, text, lang, source, None if text is None else len(text), 7, 8, "x", True, "r", "n")


@pytest.fixture(scope="session")
def edges(spark):
    """Null ids, texts and sources, empty and blank texts, repeated rows, shared ids, a very long text, clashing columns."""
    long = " ".join(f"word{k % 997}" for k in range(30_000))
    rows = [
        doc(1, None), doc(2, ""), doc(3, " \t\n"), doc(4, "one two"), doc(5, "a b c d e f g h i j k l m n o p"), doc(5, "a b c d e f g h i j k l m n o p"), doc(6, "A B c d e f g h i j k l m n o p"),
        doc(None, "a b c d e f g h i j k l m n o p"), doc(7, "x" * 50_000), doc(8, long), doc(8, "same id, other text entirely here now"), doc(9, "ünï cödé 🎉 text ▁ with marks", None), doc(None, None, None),
        doc(10, "one two", "s2"), doc(11, "mail me at joe@example.com 🎉 or token = 'abcdef123456'", "s3"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
