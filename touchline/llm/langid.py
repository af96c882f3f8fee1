"""Language identification by rank-order n-gram profiles.

A text's most frequent character n-grams (one to three, over lower-cased UTF-8 bytes, with every
run of non-letters as one separator, and separators at the end) are ranked, and each language's profile is ranked likewise
from the counts of all its training texts.  The language with the least sum of rank differences
("out of place" distance) wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.kernels import slices, text_bytes

#: Ranks in a profile, of a language and of a text.
RANKS = 400
UNKNOWN = "und"
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True
#: Rows of a slice; a row's number and an n-gram share one 64-bit sort key.
_ROWS = 4096


def _row_slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    for i, j in slices(column):
        for k in range(i, j, _ROWS):
            yield k, min(j, k + _ROWS)


def gram_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count) of the rows of one slice, ordered by row and gram.

    A gram is its bytes as a number, left-aligned in three bytes, and its length above them.
    The trigrams are sorted; bigrams and unigrams are sums over the trigrams they begin.
    """
    raw, offsets = text_bytes(pc.utf8_lower(column))
    rows = np.repeat(np.arange(len(column)), np.diff(offsets))
    letter = _LETTER[raw]
    code = np.where(letter, raw, 0).astype(np.int64)
    first = np.ones(len(raw), dtype=bool)
    first[1:] = letter[1:] | letter[:-1] | (rows[1:] != rows[:-1])  # one separator of a run stays
    code, rows = code[first], rows[first]
    if not len(code):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    same1 = np.zeros(len(code), dtype=bool)
    same1[:-1] = rows[1:] == rows[:-1]
    same2 = np.zeros(len(code), dtype=bool)
    same2[:-2] = rows[2:] == rows[:-2]
    key = (rows << 24) | (code << 16)
    key[:-1] |= np.where(same1[:-1], code[1:], 0) << 8
    key[:-2] |= np.where(same2[:-2], code[2:], 0)
    key.sort()
    out = []
    counts = None
    for shift, size in ((0, 3), (8, 2), (16, 1)):
        grams = key >> shift << shift
        start = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        total = np.add.reduceat(counts, start) if counts is not None else np.diff(np.append(start, len(grams)))
        key, counts = grams[start], total
        gram = key & 0xFFFFFF
        use = (gram >> 16 != 0) | ((gram >> 8) & 0xFF != 0) if size > 1 else gram != 0
        out.append((key[use] >> 24, gram[use] | (size << 24), counts[use]))
    row, gram, count = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], gram[order], count[order]


def ranked(row: np.ndarray, gram: np.ndarray, count: np.ndarray, ranks: int = RANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, rank): each row's most frequent grams; ties by the gram's number."""
    key = (row << 50) | ((0xFFFFFF - np.minimum(count, 0xFFFFFF)) << 26) | gram
    key.sort()
    row = key >> 50
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    use = rank < ranks
    return row[use], (key & 0x3FFFFFF)[use], rank[use]


def _language_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        text, lang = batch.column(0), np.array(batch.column(1).to_pylist(), dtype=object)
        for i, j in _row_slices(text):
            row, gram, count = gram_counts(text.slice(i, j - i))
            of = lang[i:j][row] if len(row) else np.zeros(0, object)
            for name in set(lang[i:j]):
                mine = of == name
                grams, counts = held.get(name, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                grams, place = np.unique(np.concatenate([grams, gram[mine]]), return_inverse=True)
                held[name] = grams, np.bincount(place, weights=np.concatenate([counts, count[mine]]), minlength=len(grams)).astype(np.int64)
    for name, (grams, counts) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])


def fit_profiles(train: DataFrame, text_col: str = "text", lang_col: str = "lang", ranks: int = RANKS) -> dict[str, np.ndarray]:
    """Language -> its grams in rank order, from the counts of all rows of ``train``.

    Rows without text or language are left out.  The driver gets ``ranks`` numbers a language.
    """
    counts = (
        train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
        .filter("text is not null and lang is not null")
        .mapInArrow(_language_counts, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counts.withColumn("place", place).filter(F.col("place") <= ranks).select("lang", "gram", "place").collect()
    profiles: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, dtype=np.int64) for k, v in profiles.items()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", ranks: int = RANKS) -> DataFrame:
    """doc_id, lang_pred, score of every row; ``und`` and 0 for a text that is null or has no letter.

    Whole texts are read, of any length; repeated rows are predicted each; a null id stays null;
    other columns are ignored, and an empty table gives an empty result.

    The score is how much nearer the winner is than the runner-up, from 0 (a tie, which the
    smaller name wins) to 1.  Without any profile everything is ``und``.
    """
    names = sorted(profiles)
    every = np.unique(np.concatenate([profiles[n] for n in names])) if names else np.zeros(0, np.int64)
    place = np.full((len(names), len(every) + 1), -1, dtype=np.int64)
    for i, name in enumerate(names):
        place[i, np.searchsorted(every, profiles[name])] = np.arange(len(profiles[name]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            best, score = [UNKNOWN] * len(text), np.zeros(len(text))
            for i, j in _row_slices(text):
                part = text.slice(i, j - i)
                row, gram, rank = ranked(*gram_counts(part), ranks)
                if not len(row) or not names:
                    continue
                at = np.searchsorted(every, gram)
                at[at == len(every)] = len(every)
                at[(at < len(every)) & (np.append(every, -1)[at] != gram)] = len(every)
                start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                away = np.empty((len(names), len(start)))
                for k in range(len(names)):
                    known = place[k][at]
                    away[k] = np.add.reduceat(np.where(known < 0, ranks, np.abs(known - rank)), start)
                order = np.argsort(away, axis=0, kind="stable")
                nearest = np.take_along_axis(away, order[:1], 0)[0]
                second = np.take_along_axis(away, order[1:2], 0)[0] if len(names) > 1 else np.add.reduceat(np.full(len(row), ranks), start).astype(float)
                sure = np.where(second > 0, (second - nearest) / np.maximum(second, 1), 0.0)
                for d, who, s in zip(row[start].tolist(), order[0].tolist(), np.clip(sure, 0, 1).tolist(), strict=True):
                    best[i + d], score[i + d] = names[who], s
            plain = pc.match_substring_regex(pc.fill_null(text, ""), "[A-Za-z]").to_numpy(zero_copy_only=False)
            for d in np.flatnonzero(~plain).tolist():
                if not any(c.isalpha() for c in text[d].as_py() or ""):
                    best[d], score[d] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
