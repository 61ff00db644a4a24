import pytest

TEXT = "The quick brown fox jumps over the lazy dog near the river bank while it rains\nand a second line stands here, long enough to count\nthird"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, h string, row long, key long, w string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, copies, repeated rows, and columns that clash with inner names."""
    long = " ".join(f"word{i % 977} a{i}" for i in range(30_000))
    rows = [(1, TEXT), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, TEXT), (6, TEXT), (7, TEXT.replace("fox", "cat")), (None, TEXT), (8, "é😀 ñ"), (9, "x" * 50_000), (10, "one two")]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None, None if t is None else len(t), 5, 0.5, "h", 1, 2, "w") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
