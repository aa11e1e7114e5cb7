import random

import pytest

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ironwood juniper kauri larch maple nutmeg oak pine quince rowan spruce teak ulmo viburnum willow yew zelkova".split()


@pytest.fixture(scope="session")
def make():
    """Texts of random words, by seed and length."""

    def text(seed: int, n: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", ".", "s"]) for _ in range(n))

    return text


@pytest.fixture(scope="session")
def texts(make):
    """Ids and texts with nulls, empty and blank texts, ties, copies, near copies, a long text and odd characters."""
    base = make(1, 400)
    words = base.split()
    near = " ".join([*words[:200], "changed", *words[201:]])
    shared = make(7, 40)
    return [
        (0, base), (1, None), (2, ""), (3, " \n\t "), (4, base), (5, near), (6, make(2, 300) + " " + shared), (7, shared + "\n" + make(3, 250)), (8, "naïve café 日本語 𝔘𝔫𝔦   x\x1c\x85y"), (9, "one two"),
        (10, "one  two"), (11, make(4, 30000)), (12, "a" * 5000), (13, "don't we'll I'M 12 ½\r\n\r\n  end <|endoftext|> x"), (14, base.replace(" ", "\n")), (15, "ab" * 300 + "x" + "ab" * 300), (None, "no id"), (17, "!!! ???"),
    ]


@pytest.fixture
def docs(spark, texts):
    """The texts as documents with columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "src", 0, "x", 5, 1.5, "g") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n int, score double, node string")


@pytest.fixture
def no_docs(docs):
    return docs.where("1 = 0")
