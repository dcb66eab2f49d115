from __future__ import annotations

import pytest

LONG = " ".join(f"w{i % 977}x{i}" for i in range(12_000))
PROSE = "The quiet river runs past the old mill, and nobody in the village remembers who built it or why it stopped turning so long ago."
EXTRA = "node string, size int, score string, b int, label string, rk string, n long, host string, bands int, target int, source_size int, w int, s int, t int, list int, v int, _rk int, _node string, _id int, _size int, _key string, _source int, _bucket int, _position int, _positions int, lang_pred int, removed int, salt int, salts int, head int, copy int, held_out int, content int, taken int"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 5), (None, PROSE, "en", "b", 10), (None, None, None, None, None),
        (5, LONG, "de", "a", 1), (6, PROSE, "en", "b", 1), (6, PROSE, "en", "b", 1), (7, PROSE + " More.", "fr", "b", 2), (8, "***", "en", "c", 3), (9, "ab cd", "en", "c", 5),
        (10, PROSE.upper() + "\x00 é🙂", "es", "a", 5),
    ]
    names = [c.split()[0] for c in EXTRA.split(", ")]
    full = [r + tuple("x" if "string" in c else 1 for c in EXTRA.split(", ")) for r in rows]
    assert len(full[0]) == 5 + len(names)
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="session")
def empty(spark, messy):
    return spark.createDataFrame([], messy.schema)
