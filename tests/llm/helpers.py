"""Small corpora with the cases that every operator has to take."""

from __future__ import annotations

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, fp int"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("aeioubcdfgäé", k=rng.randint(1, 7))) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def corpus() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows, copies, and columns whose names might clash."""
    passage, long = prose(1, 80), prose(2, 4000)
    texts = [prose(10, 120), None, "", "   \n\t ", "one", "Two words", "a b c", long, long[:9000] + prose(3, 50) + long[9000:]]
    texts += [prose(20 + k, 60) + " " + passage + " " + prose(40 + k, 60) for k in range(4)]
    texts += [prose(10, 120), "x " * 700, "x " * 700, "é" * 500, "AbC def " * 3 + "end\nend\nend", prose(10, 119) + " zz"]
    rows = [(k, t, "en", f"src{k % 3}" if k % 7 else None, len(t) if t is not None else None, "row", 1) for k, t in enumerate(texts)]
    rows += [rows[0], rows[4], (None, prose(10, 120), None, None, 0, None, None), (None, None, None, None, None, None, None), (3, prose(70, 90), "de", "src0", 1, "r", 2)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(3)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")
