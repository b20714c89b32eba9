from __future__ import annotations

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


@pytest.fixture(scope="session")
def made_docs(spark):
    """Documents from ``(doc_id, text)``; ``extra`` adds columns with names that operators use inside."""

    def build(rows, extra=False):
        schema = DOCUMENT
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        if extra:
            names = ["key", "fp", "part", "row", "kept", "score", "features", "count", "cell", "piece"]
            schema += "".join(f", `{n}` string" for n in names)
            full = [(*r, *(None,) * len(names)) for r in full]
        return spark.createDataFrame(full, schema)

    return build


def in_order(frame, *keys):
    pdf = frame.toPandas()
    return pdf.sort_values(list(keys) or list(pdf.columns)).reset_index(drop=True)


LONG = "lorem ipsum dolor sit amet " * 4000

ODD_ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (None, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (None, "a text that only a row without an id has, with quite a few words in it to match windows of words"),
    (6, LONG),
    (7, "x" + LONG),
    (8, "ünïcödé 汉字 🙂 " * 30),
    (9, "ünïcödé 汉字 🙂 " * 30),
    (10, "y" * 5000),
]
