import pytest

LONG = " ".join(f"word{i} other{i % 97}." for i in range(12_000))
ROWS = [
    (1, "The first text stands here, alone and long enough to have words.", "en", "s", 10),
    (1, "The first text stands here, alone and long enough to have words.", "en", "s", 10),
    (2, None, "en", None, None), (3, "", None, "s", 0), (4, "   \n\t ", "de", "s", 6), (None, "no id here", "en", "s", 10),
    (5, LONG, "en", "s", len(LONG)), (6, "tie", "de", "s", 3), (6, "another with the same id", "fr", "s", 24), (7, "ünïcödé — 漢字 😀 \x00 end", None, None, 20),
]
# extra columns that share names with the operators' results and helpers
EXTRA = "kept boolean, spans string, fp long, root string, ids string, task int, key long, score double, stays boolean, lang_pred string, bucket int"


@pytest.fixture(scope="session")
def edge(spark):
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
    return spark.createDataFrame([(*r, *[None] * (EXTRA.count(",") + 1)) for r in ROWS], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(small):
    return {r.doc_id: r.text for r in small.select("doc_id", "text").collect()}
