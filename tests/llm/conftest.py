import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows."""
    def make(rows, lang="en", source="s"):
        full = [(*r, *(lang, source)[len(r) - 2:], len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


def words(n, seed=0, vocab=2000):
    """n pseudo-random words."""
    import random
    r = random.Random(seed)
    return [f"w{r.randrange(vocab):x}" for _ in range(n)]


@pytest.fixture(scope="session")
def text_cases():
    """Null, empty, blank, short, odd separators, non-ASCII, repeated rows, a long text."""
    base = words(60, 1)
    long = words(30_000, 2)
    return [
        (1, " ".join(base)), (2, " ".join(base)), (3, None), (4, ""), (5, " \t\n "),
        (6, "Ünï cödé ẞ " + " ".join(base[5:30]) + "\r\nend"), (7, "one two"),
        (8, " ".join(long)), (9, " ".join(words(40, 3)) + " " + " ".join(long[500:700])),
        (9, " ".join(words(40, 3)) + " " + " ".join(long[500:700])),
        (10, "ab" * 700), (11, "x" * 399), (12, "a a a a a a a a a a a a a a a a a a a a"),
        (None, " ".join(base)), (13, "\x00" + "\x1f ".join(base[:20])),
    ]
