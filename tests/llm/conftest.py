import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    passage = " ".join(f"word{i}" for i in range(40))
    line = "A line that several documents share, long enough."
    rows = [
        (1, f"{passage}\n{line}\nshort\nonly here in one document", "en", 1),
        (2, f"intro {passage} outro\n  {line.upper()}\t\nshort", None, None),
        (3, f"{line}\n{line}", "en", 3),
        (3, f"{line}\n{line}", "en", 3),
        (4, "", "en", 4),
        (5, None, None, None),
        (None, f"{passage}\n{line}", "en", 6),
        (7, "a a a a a a a a a a a a a a a a a a a a", "en", 7),
        (8, "b a a a a a a a a a a a a a a a a a c", "en", 8),
        (9, "x y x y x y x y x y x y x y x y x y x y", "en", 9),
        (10, "y x y x y x y x y x y x y x y x y x y x z", "en", 10),
        (11, " \n\t\n", "en", 11),
        (12, "one two", "en", 12),
        (13, "ONE  two", "en", 13),
        (14, " ".join(f"L{i % 977}" for i in range(30000)), "de", 14),
        (15, "é ü  x \x0b\x0c\r y <|endoftext|> don't!! €5", "de", 15),
        (16, "\u09b9\u09df, \u092a\u0939\u093e\u095c, \u0917\u095d. EV\u0130, \u0a5b! \ufb1d\ufb2a.", "de", 16),
    ]
    tags = [(r[0], r[1], r[2], "src", r[3], f"extra{k}", k, 0.5, k % 2 == 0) for k, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, tag long, size double, `__text` boolean"
    return spark.createDataFrame(tags, schema).repartition(3)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
