import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, k_id string, row string, name long"


def make_rows():
    """Texts with copies, near copies, nulls, blanks, a repeated row, null ids and a very long text."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = [text(n) for n in (30, 60, 120, 200, 9, 3, 1)]
    out = list(base)
    for b in base[:4]:
        w = b.split()
        for edits in (1, 1, 2, 3, 6, 12):
            v = list(w)
            for _ in range(edits):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            out.append(" ".join(v))
        out += [b, b.upper(), b + " " + text(4), b[:-1]]
    out += [None, "", " \n\t ", "Éa É ünicode ", "éa É ünicode ", "x", "X", text(30_000)]
    out[-1:] = [out[-1], out[-1], out[-1] + " tail"]
    rows = [(i * 3 + 1, t, "en", "s", 0, "clash", "clash", 7) for i, t in enumerate(out)]
    rows += [rows[0], rows[0], (None, base[1], "en", "s", 0, "c", "c", 7), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
