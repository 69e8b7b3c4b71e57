import random

import pytest

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "ri", "sa", "to") for b in ("ner", "dal", "vis", "pol", "", "gem", "tur")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def tricky_rows() -> list[tuple]:
    """(doc_id, text, lang): nulls, empties, long texts, copies, near copies, shared passages, repeated rows."""
    passage = prose(1, 60)
    base = prose(2, 140).split()
    near = [" ".join([*base[:k * 9], "zz%d" % k, *base[k * 9 + 1:]]) for k in range(9)]
    rows = [(0, None, "en"), (1, "", None), (2, " \n\t ", "en"), (3, "one", "en"), (4, "one two three", "en"), (5, "12 34 !!", "en"),
            (6, prose(3, 49), "en"), (7, prose(3, 50), "en"), (8, prose(3, 50), "en"), (9, prose(4, 9000), "en"),
            (10, prose(5, 30) + "\n" + passage + "\n" + prose(6, 30), "en"), (11, passage, "en"), (12, prose(7, 10) + " " + passage, "de"),
            (13, passage + " " + passage, None), (14, " ".join(["same"] * 300), "en"), (15, " ".join(["same"] * 300), "en"),
            (16, "é ü ñ 漢字 " + prose(8, 80), "fr"), (17, prose(2, 140), "en"), (17, prose(2, 140), "en"), (17, prose(9, 70), "en"),
            (None, prose(2, 140), "en"), (None, prose(10, 20), None), (40, "one", "en")]
    return rows + [(20 + k, t, "en") for k, t in enumerate(near)] + [(30 + k, prose(50 + k, 60 + k), "en") for k in range(8)]


@pytest.fixture(scope="session")
def tricky(spark):
    """The rows as documents, with extra columns named as the operators name theirs."""
    rows = [(*r, "src", len(r[1] or ""), i, "x", 1) for i, r in enumerate(tricky_rows())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, row string, kind int").repartition(3)


@pytest.fixture(scope="session")
def no_rows(tricky):
    return tricky.where("1 = 0")
