import random

import pytest

ALPHABET = ["the", "of", "and", "stone", "river", "glass", "cloud", "märz", "señor", "tree", "light", "house", "door", "paper", "train"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append(r.choice(ALPHABET) + r.choice(["", str(r.randrange(400)), str(r.randrange(400))]))
        if i % 12 == 11:
            out[-1] += ".\n"
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, copies, near copies, repeated rows, shared passages, clashing extra columns."""
    passage = prose(999, 80)
    out = [(i, prose(i, 60 + 7 * i), "en", f"s{i % 3}", 1, "k") for i in range(30)]
    out += [(100 + i, out[3][1], "en", "s1", 1, "k") for i in range(4)]
    near = out[20][1].split(" ")
    for i in range(4):
        w = list(near)
        w[10 * i + 5] = f"changed{i}"
        out.append((200 + i, " ".join(w), "en", None, 1, "k"))
    out += [(300 + i, prose(50 + i, 40) + " " + passage + " " + prose(70 + i, 30), "de", "s2", 1, "k") for i in range(3)]
    out += [(400, None, None, None, None, None), (401, "", "en", "s0", 0, "k"), (402, " \n\t ", "en", "s0", 4, "k"), (403, "one two three", "en", "s0", 13, "k"), (404, "ONE two  three", "en", "s0", 13, "k"), (405, "abc " * 3000, "en", "s0", 1, "k")]
    out += [(406, "x" * 500, "en", "s0", 1, "k"), (407, "tie " * 30, "en", "s0", 1, "k"), (407, "tie " * 30, "en", "s0", 1, "k"), (408, "SHOUT!! " * 50, "en", "s0", 1, "k"), (409, "a## b%% c$$ " * 20, "en", "s0", 1, "k")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    # _row, kept and node clash with names that the operators use themselves.
    return spark.createDataFrame([(*r[:5], r[5], r[5], 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _row string, kept string, node int")


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], int(r[0] < 400), 0) for r in rows if r[0] % 5] + [(9999, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
