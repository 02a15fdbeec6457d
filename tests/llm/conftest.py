import pytest

ROWS = "doc_id long, text string, lang string, source string, n_chars long, score double, _other string, _bad int, _rank int"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text, lang, source), with columns whose names clash with those used inside."""

    def build(rows):
        full = [(r + (None,) * 4)[:4] for r in rows]
        return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), 0.5, "x", 1, 2) for i, t, g, s in full], ROWS)

    return build


@pytest.fixture(scope="session")
def words():
    """Deterministic prose: word(i) differ for different i."""

    def text(first, n):
        return " ".join(f"w{(first + i) * 7919 % 100003:x}q" for i in range(n))

    return text


@pytest.fixture(scope="session")
def alike():
    """Two words of 1024 letters (Thue-Morse and its complement) that hashes of sums of powers take for one."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))
