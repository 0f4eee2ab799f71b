import pytest


@pytest.fixture(scope="session")
def fixture_docs(spark):
    """Small documents with nulls, empty and repeated rows, copies and extra columns with clashing names."""
    import random
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    base = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (1, 2, 60, 80, 120, 300, 90, 70)]
    for i, t in enumerate(base):
        rows.append((i, t))
    for i in range(100, 112):  # near copies at several distances of document 4
        words = base[4].split()
        for _ in range(i - 100):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(200, base[5]), (201, base[5].upper()), (202, base[5].replace(" ", "\n\t")), (203, None), (204, ""), (205, " \n "),
             (206, "w1"), (207, "W1"), (5, base[5]), (5, base[5]), (None, base[5]), (None, None), (300, "w1 w2 " * 4000)]
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", True, -1) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, kept string, label boolean, component_id int")
