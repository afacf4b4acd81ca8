"""Evaluation texts leaking into training text, found with suffix arrays of the corpus.

Every Arrow batch of documents is a shard. Its texts become one array of word numbers
(words that occur in no test item end a run, for no match can span them), the shard's
suffix array is built by prefix doubling, and every suffix of every test item is binary
searched in it. Matches are then followed to their full length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

MIN_WORDS = 12
#: Bytes of test material that are sent to all tasks at a time (about 100 MB as arrays).
BLOCK_BYTES = 20_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    word = np.zeros(256, dtype=bool)
    code = np.zeros(256, dtype=np.uint64)
    draw = np.random.default_rng(12).integers(1, 2**63, 256, dtype=np.uint64)
    for lo, hi in ((48, 58), (65, 91), (97, 123)):
        word[lo:hi] = True
    code[:] = draw
    code[65:91] = code[97:123]  # without regard to case
    return word, code


IS_WORD, CODE = _tables()


def word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every maximal run of ASCII letters and digits; none spans a break."""
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    b = breaks[breaks < n]
    first[b] = inside[b]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    # every byte weighs by its place in the word, so the sums of a word don't depend on the rest
    at = np.flatnonzero(inside[:n])
    owner = np.searchsorted(starts, at, "right") - 1 if len(b) > n else np.cumsum(first[:n])[at] - 1
    place = (at - starts[owner]).astype(np.uint64)
    mixed = CODE[data[at]] + place * _STEP
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return starts, np.add.reduceat(mixed, edges)


def _column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset at which each row starts."""
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(values, dtype=np.uint8)[bounds[0]:bounds[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes of seq by their first ``depth`` numbers or more, by prefix doubling."""
    rank = seq.astype(np.int64)
    span = 1
    while True:
        later = np.zeros(len(seq), dtype=np.int64)
        if span < len(seq):
            later[:-span] = rank[span:]
        key = rank * (later.max(initial=0) + 1) + later
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        span *= 2
        if span >= depth:
            return order
        rank = np.empty(len(seq), dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (ordered[1:] != ordered[:-1])]))


def _bound(seq: np.ndarray, order: np.ndarray, tests: np.ndarray, at: np.ndarray, words: int, upper: bool) -> np.ndarray:
    """Binary search of all test suffixes at once, comparing ``words`` numbers of each."""
    lo, hi = np.zeros(len(at), dtype=np.int64), np.full(len(at), len(order), dtype=np.int64)
    padded = np.concatenate([seq, np.zeros(words, dtype=seq.dtype)])
    while (active := np.flatnonzero(lo < hi)).size:
        mid = (lo[active] + hi[active]) // 2
        suffix = order[mid]
        less, undecided = np.zeros(len(active), dtype=bool), np.ones(len(active), dtype=bool)
        for k in range(words):
            a, b = padded[suffix + k], tests[at[active] + k]
            less |= undecided & (a < b)
            undecided &= a == b
            if not undecided.any():
                break
        go = less | undecided if upper else less
        lo[active[go]] = mid[go] + 1
        hi[active[~go]] = mid[~go]
    return lo


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, words (length of the longest common passage), doc_word, item_word
    (where it starts, counted in words from 0) for every document and item that share at
    least ``min_words`` consecutive words.

    A word is a maximal run of ASCII letters and digits, compared without regard to case.
    Null and empty texts and items of fewer words match nothing. Items that are repeated
    or overlap are each reported. No shuffle; the corpus never leaves its partitions. The items go
    to all tasks in blocks of about ``block_bytes``, as many blocks as they need, one pass over the
    corpus for each.
    """
    rows = items.select("item_id", "prompt").filter("item_id is not null and prompt is not null")
    size = rows.agg(F.sum(F.octet_length("prompt"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = None
    for n in range(blocks):
        block = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n)
        part = _find_leaks(docs, block, min_words)
        found = part if found is None else found.unionByName(part)
    return found


def _find_leaks(docs: DataFrame, rows: DataFrame, min_words: int) -> DataFrame:
    """The leaks of one block of items."""
    local = rows.toPandas()
    data, bounds = _column_bytes(pa.array(local["prompt"], type=pa.large_string()))
    starts, hashes = word_hashes(data, bounds)
    known = np.unique(hashes)
    number = np.searchsorted(known, hashes) + 1 if len(hashes) else np.zeros(0, np.int64)
    item_of_word = np.searchsorted(bounds, starts, "right") - 1
    # a 0 after each item keeps its suffixes from running into the next
    gap = item_of_word + np.arange(len(starts))
    tests = np.zeros(len(starts) + len(local) + min_words, dtype=np.int64)
    tests[gap] = number
    item_at, word_at = np.full(len(tests), -1), np.zeros(len(tests), dtype=np.int64)
    first_word = np.searchsorted(item_of_word, np.arange(len(local)))
    item_at[gap], word_at[gap] = item_of_word, np.arange(len(starts)) - first_word[item_of_word]
    enough = np.bincount(item_of_word, minlength=len(local))
    at = gap[(word_at[gap] + min_words) <= enough[item_of_word]]
    shared = docs.sparkSession.sparkContext.broadcast(
        (known, tests, at, item_at, word_at, local["item_id"].to_numpy(dtype=np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tests, at, item_at, word_at, item_id = shared.value
        for batch in batches:
            data, bounds = _column_bytes(batch.column(1))
            starts, hashes = word_hashes(data, bounds)
            if not len(starts) or not len(at):
                continue
            spot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            seq = np.where(known[spot] == hashes, spot + 1, 0)
            doc = np.searchsorted(bounds, starts, "right") - 1
            # runs of known words within a document, long enough to hold a match
            new_run = np.concatenate([[True], (doc[1:] != doc[:-1]) | (seq[1:] == 0) | (seq[:-1] == 0)])
            run_no = np.cumsum(new_run) - 1
            long = np.bincount(run_no)[run_no] >= min_words
            if not long.any():
                continue
            keep = np.flatnonzero(long & (seq > 0))
            kept_run = run_no[keep]
            shift = np.cumsum(np.concatenate([[0], kept_run[1:] != kept_run[:-1]]))
            place = np.arange(len(keep)) + shift
            s = np.zeros(place[-1] + 2, dtype=np.int64)
            s[place] = seq[keep]
            source = np.full(len(s), -1)
            source[place] = keep
            order = suffix_array(s, min_words)
            low = _bound(s, order, tests, at, min_words, False)
            high = _bound(s, order, tests, at, min_words, True)
            hits = np.flatnonzero(high > low)
            if not len(hits):
                continue
            count = high[hits] - low[hits]
            which = np.repeat(hits, count)
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            pos, test = order[low[which] + inner], at[which]
            length = np.full(len(pos), min_words, dtype=np.int64)
            live = np.arange(len(pos))
            while len(live):
                a, b = pos[live] + length[live], test[live] + length[live]
                ok = (a < len(s)) & (b < len(tests))
                live, a, b = live[ok], a[ok], b[ok]
                same = (s[a] == tests[b]) & (s[a] > 0)
                live = live[same]
                length[live] += 1
            word = source[pos]
            d = doc[word]
            first = np.searchsorted(doc, d)
            best = np.lexsort((word, -length, item_at[test], d))
            lead = np.concatenate([[True], (d[best][1:] != d[best][:-1]) | (item_at[test][best][1:] != item_at[test][best][:-1])])
            best = best[lead]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(d[best])).cast(pa.int64()), pa.array(item_id[item_at[test[best]]]),
                pa.array(length[best]), pa.array((word - first)[best]), pa.array(word_at[test[best]])],
                names=["doc_id", "item_id", "words", "doc_word", "item_word"])

    found = docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, item_id long, words long, doc_word long, item_word long")
    return found


def clean_documents(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents without those that hold a leaked passage."""
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
