"""Counts over whole texts, used by the quality operators.

One Arrow pass; each text is counted on its own, so nothing but the batch is held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagfold.ship import ship

#: All counts of a text, in the order in which count() returns them.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_shouts", "n_unique", "n_bytes")

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = b".,;:?!-\"'()"
SHOUTS = b"!"


def repeated(words: list[bytes]) -> tuple[int, int]:
    """Number of words inside 3-word windows that occur twice or more; number of different words."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(words) < 4:
        return 0, len(seen)
    if len(seen) < 2_000_000:
        key = (ids[:-2] * len(seen) + ids[1:-1]) * len(seen) + ids[2:]
    else:
        key = np.unique(ids[:-2] * len(seen) + ids[1:-1], return_inverse=True)[1] * len(seen) + ids[2:]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0, len(seen)
    again = np.isin(key, twice)
    inside = np.zeros(len(words), bool)
    for i in range(3):
        inside[i : len(key) + i] |= again
    return int(inside.sum()), len(seen)


def count(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text; a null text counts as empty."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    n_repeat, n_unique = repeated(words)
    lines, earlier, dup = b.split(b"\n"), set(), 0
    if len(lines) > 1:
        for x in lines:
            if x in earlier:
                dup += bool(x.strip())
            else:
                earlier.add(x)
    return (len(words), sum(len(w) for w in words) if b.isascii() else sum(len(w.decode("utf-8", "surrogatepass")) for w in [b"".join(words)]), *(
        len(b) - len(b.translate(None, SYMBOLS)), dup, n_repeat, len(lines), len(b) - len(b.translate(None, UPPER)), len(b) - len(b.translate(None, DIGITS)),
        len(b) - len(b.translate(None, MARKS)), b.count(SHOUTS), n_unique, len(b)))


def with_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep of docs, then COUNTS of the column text. Other columns are dropped.

    Columns of keep must not be named like COUNTS; rows stay as they are, repeated ones too.
    """
    ship(docs.sparkSession)
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(c) for c in counted(b.column(len(keep))).T)], names=schema.names)

    return docs.select(*keep, F.col(text)).mapInArrow(run, schema)


def counted(batch: pa.Array) -> np.ndarray:
    """COUNTS of each text of an Arrow array, a row each."""
    return np.array([count(x.as_py()) for x in batch], np.int64).reshape(len(batch), len(COUNTS))


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def counts_of(text: pa.Array) -> pa.Array:
    """COUNTS as a struct column; only the text goes to Python, a row's other columns stay where they are."""
    return pa.StructArray.from_arrays([pa.array(c) for c in counted(text).T], names=list(COUNTS))


#: Each feature: Spark SQL over COUNTS. All are 0 for an empty text.
FEATURES = {
    "log_words": "log(1 + n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(word_chars, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "digit_rate": "n_digits / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(word_chars, 1)",
    "shout_rate": "n_shouts / greatest(n_words, 1)",
    "unique_rate": "n_unique / greatest(n_words, 1)",
}


def features(x: np.ndarray) -> np.ndarray:
    """FEATURES of rows of COUNTS, in numpy, for fitting and scoring inside tasks."""
    c = {k: x[:, i].astype(float) for i, k in enumerate(COUNTS)}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.stack([
        np.log(1 + c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words,
        c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / chars, c["n_shouts"] / words, c["n_unique"] / words,
    ], axis=1)
