import random

import pytest

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


class Writer:
    def __init__(self, seed):
        self.r = random.Random(seed)

    def words(self, n):
        return ["".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4))) for _ in range(n)]

    def edited(self, words, share):
        out = [w if self.r.random() > share else self.words(1)[0] for w in words]
        return out if out != words else out[:-1]


@pytest.fixture
def writer():
    return Writer(11)


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text): copies, chains of near copies, shared passages, short, empty, null and long texts."""
    w, rows = Writer(3), []
    put = lambda t: rows.append((len(rows) * 3 + 1, t))
    shared, line = w.words(60), w.words(8)
    for _ in range(60):
        put(" ".join(w.words(w.r.randint(5, 90))))
    for _ in range(6):
        base = w.words(80)
        for share in (0.0, 0.0, 0.01, 0.02, 0.03, 0.05, 0.08):
            put(" ".join(w.edited(base, share) if share else base))
    chain = w.words(120)
    for _ in range(10):
        put(" ".join(chain))
        chain = w.edited(chain, 0.02)
    for i in range(25):
        put(" ".join(w.words(i)) + "\n" + " ".join(shared[: 34 + i]) + "\t" + " ".join(w.words(30 - i)))
        put(" ".join(line) + "\n" + " ".join(w.words(12)))
    put("Aé Bü " * 50)
    put(" ".join(["same"] * 90))
    for t in (None, "", " \t\n", "one", "one", "ONE", "two words", "a b c", "A B C", "\x0b\x0c", "é\u00a0è x"):
        put(t)
    put(" ".join(w.words(9000)))
    return rows


@pytest.fixture
def frame(spark):
    def make(rows, schema=SCHEMA):
        width = len(schema.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return make
