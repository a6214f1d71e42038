import pytest

#: Names that operators use themselves, or did.
CLASHING = ["c0", "c1", "host", "doc", "drops", "n_lines", "size", "copies", "turn", "fp", "h", "N_WORDS2", "__n_words", "__doc", "__text", "__drops", "__id", "__n", "__rows", "__size", "__gone"]
SCHEMA = "doc_id long, text string, source string, n_words int, kept string, " + ", ".join(f"{c} int" for c in CLASHING)
WORDS = "the of and stone river light paper green walk under seven mirror".split()


@pytest.fixture(scope="session")
def small_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and columns with clashing names."""
    import random

    rng = random.Random(5)
    rows = []
    shared = "This very line is shared by a good many documents"
    for k in range(60):
        body = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 80))) for _ in range(rng.randint(1, 6))]
        if k % 4 == 0:
            body.insert(1, "  " + shared.upper() + "\t")
        rows.append((k, "\n".join(body), f"src{k % 4}", 7, "x"))
    rows += [(60, None, "src1", 1, None), (61, "", "src1", 2, "y"), (62, "one", None, 3, "z"), (63, "one two", None, None, None)]
    rows += [(None, shared, "src0", 1, "n"), (64, rows[3][1], "src2", 0, ""), (65, rows[3][1] + " more", "src2", 0, "")]
    rows += [(65, rows[3][1] + " more", "src2", 0, ""), (66, "Émile " * 40_000, "src3", 5, "long"), (67, " \t\n\n", "src3", 5, "blank")]
    return spark.createDataFrame([(*r, *range(len(CLASHING))) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
