"""Quality rule on repeated passages, found with a suffix array over the words of each text.

Suffixes are ranked by doubling the compared length; of neighbours in the suffix array the longest common prefix is read
off the ranks kept for each length.  The deepest prefix interval that holds a suffix gives the longest repeat that starts
there; left-maximal ones are the maximal repeated substrings.  Their spans are united.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbytes as tb


@dataclass(frozen=True)
class Limits:
    """``min_words``: shortest repeat that counts.  A text fails if repeats cover more than ``max_covered`` percent of its
    words, or one repeat is longer than ``max_longest`` words and than ``max_longest_share`` percent of the text."""

    min_words: int = 5
    max_covered: int = 20
    max_longest: int = 50
    max_longest_share: int = 10
    least_words: int = 10


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "longest_repeat long, n_maximal long, spans array<struct<start:long,n:long>>, kept boolean"
)


def longest_repeats(row: np.ndarray, ids: np.ndarray, least: int) -> np.ndarray:
    """For each position, the length of the longest run of words from there that also starts elsewhere in its row
    (0 where shorter than ``least``)."""
    n = len(ids)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    key = np.unique(ids, return_inverse=True)[1].astype(np.int64) | (row.astype(np.int64) << 32)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, k = [rank.copy()], 1
    alone = new & np.r_[new[1:], True]
    active = order[~alone]
    ends = np.searchsorted(row, row, side="right")
    while len(active):
        ahead = active + k
        second = np.where(ahead < ends[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        sort = np.lexsort((second, rank[active]))
        active, second = active[sort], second[sort]
        old = rank[active]
        group = np.r_[True, old[1:] != old[:-1]]
        sub = group | np.r_[True, second[1:] != second[:-1]]
        at = np.arange(len(active))
        rank[active] = old + np.maximum.accumulate(np.where(sub, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(rank.copy())
        k *= 2
        active = active[~(sub & np.r_[sub[1:], True])]
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    deep = max(0, int(np.log2(max(1, least))))  # levels up to here must agree, or the prefix is too short to count
    if deep >= len(levels):
        return out
    i, j = suffixes[:-1], suffixes[1:]
    near = np.flatnonzero(levels[deep][i] == levels[deep][j])
    i, j = i[near].copy(), j[near].copy()
    a, b = i.copy(), j.copy()
    common = np.zeros(len(near), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ranks = levels[level]
        same = (a < n) & (b < n)
        same[same] = ranks[a[same]] == ranks[b[same]]
        step = np.where(same, 1 << level, 0)
        common += step
        a += step
        b += step
    common[common < least] = 0
    np.maximum.at(out, i, common)
    np.maximum.at(out, j, common)
    return out


def _measured(data: np.ndarray, offsets: np.ndarray, limits: Limits) -> dict[str, list]:
    rows = len(offsets) - 1
    w = tb.words(data, offsets, ~tb.SPACE)
    n_words = np.diff(w.first)
    inside = ~tb.SPACE[data]
    row_of_byte = np.repeat(np.arange(rows), np.diff(offsets))
    word_chars = tb.counted(row_of_byte[inside & ((data & 0xC0) != 0x80)], rows)
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    n_symbols = tb.counted(row_of_byte[symbol[data]], rows)

    line = tb.words(data, offsets, np.arange(256) != 0x0A)
    solid = np.r_[0, np.cumsum(inside)]
    has_word = solid[line.end] > solid[line.start]
    line_row, line_hash = line.row[has_word], tb.hashes(data, line.start, line.end, seed=7)[has_word]
    order = np.lexsort((line_hash, line_row))
    again = (line_row[order][1:] == line_row[order][:-1]) & (line_hash[order][1:] == line_hash[order][:-1])
    n_dup = tb.counted(line_row[order][1:][again], rows)

    longest_here = longest_repeats(w.row, tb.hashes(data, w.start, w.end), limits.min_words)
    at = np.flatnonzero(longest_here)
    length = longest_here[at]
    edge = np.zeros(len(w.row) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    covered = tb.counted(w.row[np.cumsum(edge)[:-1] > 0], rows) if len(w.row) else np.zeros(rows, np.int64)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, w.row[at], length)
    # a start is left-maximal unless the position before it starts a repeat one word longer
    before = np.where(at > 0, longest_here[np.maximum(at - 1, 0)], 0) * (at > w.first[w.row[at]])
    whole = before != length + 1
    at, length = at[whole], length[whole]
    cut = np.searchsorted(w.row[at], np.arange(rows + 1))
    local = at - w.first[w.row[at]]
    spans = [[{"start": int(s), "n": int(m)} for s, m in zip(local[a:b], length[a:b])] for a, b in zip(cut, cut[1:])]

    if limits.min_words != 5:
        five = np.flatnonzero(longest_repeats(w.row, tb.hashes(data, w.start, w.end), 5))
        edge = np.zeros(len(w.row) + 1, np.int64)
        np.add.at(edge, five, 1)
        np.add.at(edge, five + 5, -1)
        repeat_words = tb.counted(w.row[np.cumsum(edge)[:-1] > 0], rows) if len(w.row) else covered
    else:
        repeat_words = covered
    failed = (n_words < limits.least_words) | (100 * repeat_words > 20 * n_words)
    bad = (100 * covered > limits.max_covered * n_words) | (
        (longest > limits.max_longest) & (100 * longest > limits.max_longest_share * n_words)
    )
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup,
        "n_repeat_words": repeat_words, "base_failed": failed, "longest_repeat": longest,
        "n_maximal": np.diff(cut), "spans": spans, "kept": ~(failed | bad),
    }


def judge_repetition(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limits: Limits = Limits(), spans: bool = True) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, base measures, repeats and verdict (see ``SCHEMA``).

    Null and empty texts have no words: they count 0 everywhere and fail the base rule.  Equal rows give equal results; an
    empty table gives an empty one; other columns of ``docs`` are not read.  Work is per text: no shuffle.
    """
    fields = [f for f in SCHEMA.split(", ") if spans or not f.startswith("spans")]
    names = [f.split()[0] for f in fields]
    source = docs.select(*keep, docs[text].alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(keep)]] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tb.column(batch, "__text")
            for lo, hi, data, offsets in tb.chunks(texts):
                got = _measured(data, offsets, limits)
                kinds = {"spans": pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))}
                cols = [batch.column(c)[lo:hi] for c in keep] + [pa.array(got[c], kinds.get(c)) for c in names]
                yield pa.RecordBatch.from_arrays(cols, [*keep, *names])

    return source.mapInArrow(tb.released(run), schema)
