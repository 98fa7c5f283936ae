import pytest


@pytest.fixture()
def odd_docs(spark):
    """NULLs in every column, empty and blank texts, repeated rows and ids, ties, and extra columns with clashing names."""
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, row string, rank int, "
        "size string, shard string, copies string, _id string, label string, kept string, score string, spans string, "
        "first_id string, first_fp string, own_fp string, _first_id string, _fp string"
    )
    long_text = "word and more text goes on here " * 2000
    rows = [
        (1, "some plain words stand here in a row for once today yes", "en", "a", 5),
        (1, "some plain words stand here in a row for once today yes", "en", "a", 5),
        (2, "other words entirely fill this second text of the little table now", None, "a", None),
        (3, "other words entirely fill this second text of the little table now", "en", None, 7),
        (None, "a text without any id but with enough words to pass the rules", "en", "b", 7),
        (None, None, None, None, None),
        (4, None, "en", "a", 0),
        (5, "", "en", "a", 0),
        (6, " \t\n\r\x0b\x0c ", "en", "b", 6),
        (7, long_text, "en", "b", 9),
        (7, "the same id again with quite another text that has ten words", "en", "b", 9),
        (8, "café 中文 \U0001f600 mail a@b.co ring +1 (555) 010-4477 now or 10.0.0.1 please thank you", "fr", "c", 9),
    ]
    return spark.createDataFrame([r + (None,) * 17 for r in rows], schema)


@pytest.fixture()
def no_docs(odd_docs):
    return odd_docs.where("false")
