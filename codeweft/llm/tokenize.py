"""Encoding of a corpus with a public byte-level BPE vocabulary by merge replay.

The distinct words of the corpus are counted in Spark. Over the table of words, not over the
texts, an index from token pair to positions applies the merges in rank order; a merge touches only the
positions of its pair and their neighbours. A merge makes only pairs of later rank, so one
ascending sweep equals encoding each word. The ids of the words then go to the texts.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import json
import os
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Most frequent words of the corpus whose ids are sent to all tasks (some 10 MB); the rest, each of
#: them rare, is replayed where it is met.
FREQUENT_WORDS = 500_000
#: Rare words of the cache of a task; beyond it the cache starts anew (words are encoded again).
CACHE_WORDS = 400_000
#: Where the vocabulary files lie, and how a byte-level BPE splits a text before its merges
#: (fixed value of the public tokenizer).
VOCABULARIES = os.environ.get("CODEWEFT_TOKENIZERS", "/opt/tokenizers")
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_chars() -> dict[str, int]:
    """How a JSON vocabulary writes bytes: printable ones as themselves, the rest from 256 on."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """ids of the 256 single bytes; merges as rows (left id, right id, new id) in rank order."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, chars = model["vocab"], _byte_chars()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        single = {b: ids[c] for c, b in chars.items()}
    else:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        single = {b: ranks[bytes([b])] for b in range(256)}
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:  # the two parts into which the earlier merges leave it
                left, right = _last_parts(token, ranks, rank)
                merges.append((ranks[left], ranks[right], rank))
    return np.array([single[b] for b in range(256)], dtype=np.int32), np.array(merges, dtype=np.int32)


def _last_parts(token: bytes, ranks: dict[bytes, int], below: int) -> tuple[bytes, bytes]:
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], below + len(ranks)))
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


class MergeReplay:
    """Encodes sets of distinct words."""

    def __init__(self, single: np.ndarray, merges: np.ndarray):
        self.single = single.tolist()
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(merges.tolist())}
        self.merges = merges.tolist()

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        words = list(words)
        single, rank_of = self.single, self.rank
        token: list[int] = []
        starts = []
        for w in words:
            starts.append(len(token))
            token.extend([single[b] for b in w.encode("utf-8", "surrogatepass")])
            token.append(-1)  # ends the word
        n = len(token)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[int, list[int]] = {}
        get = rank_of.get
        for p, pair in enumerate(itertools.pairwise(token)):
            r = get(pair)
            if r is not None:
                where.setdefault(r, []).append(p)
        queue = list(where)
        heapq.heapify(queue)
        while queue:
            r = heapq.heappop(queue)
            a, b, new = self.merges[r]
            positions = where.pop(r)
            if a == b:
                positions.sort()
            for p in positions:
                q = following[p]
                if token[p] != a or token[q] != b:
                    continue  # an earlier merge took a part
                token[p], token[q] = new, -2
                after = following[q]
                following[p], previous[after] = after, p
                x = get((new, token[after]))
                if x is not None:
                    if x not in where:
                        where[x] = []
                        heapq.heappush(queue, x)
                    where[x].append(p)
                before = previous[p]
                if before >= 0:
                    x = get((token[before], new))
                    if x is not None:
                        if x not in where:
                            where[x] = []
                            heapq.heappush(queue, x)
                        where[x].append(before)
        out = {}
        for w, p in zip(words, starts):
            ids = []
            while (t := token[p]) != -1:
                ids.append(t)
                p = following[p]
            out[w] = ids
        return out


def corpus_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: how often every word occurs in the corpus. Each task counts its own words first,
    so that what is shuffled are the distinct words of tasks, not the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = regex.compile(WORD_PATTERN).findall, Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(split(t))
            if len(counts) > CACHE_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def replayed(words: DataFrame, vocabulary) -> DataFrame:
    """word, ids of distinct words: every partition is a shard of the table with an index of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = MergeReplay(*vocabulary.value)
        for batch in batches:
            ids = replay.encode(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.string()), pa.array(list(ids.values()), pa.list_(pa.int32()))], names=["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids array<int>")


def encode_corpus(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT_WORDS) -> DataFrame:
    """key and ids (array<int>) of every row; other columns are not read.

    Null and empty texts give an empty list. The strings of special tokens are ordinary
    text. The texts are never shuffled: the words of the corpus are (combined by task), the ids of the
    ``frequent`` most frequent go to all tasks, and rarer words are replayed in the tasks that meet them.
    The vocabulary (a fixed size) is read once on the driver and broadcast.
    """
    loaded = load_vocabulary(path or f"{VOCABULARIES}/byte_bpe_50k.json")
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(loaded)
    words = corpus_words(docs, text).orderBy(F.desc("n"), "word").limit(frequent)
    table = replayed(words.repartition("word"), shared).toArrow()  # at most ``frequent`` words
    known = context.broadcast((table.column(0).combine_chunks(), table.column(1).combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = MergeReplay(*shared.value)
        split = regex.compile(WORD_PATTERN).findall
        names, lists = known.value
        flat, bounds = lists.values.to_numpy().tolist(), lists.offsets.to_numpy().tolist()
        cache: dict[str, list[int]] = {w: flat[a:b] for w, a, b in zip(names.to_pylist(), bounds, bounds[1:])}
        rare: dict[str, list[int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [split(t) if t else [] for t in part.column(1).to_pylist()]
                new = set(itertools.chain.from_iterable(texts)).difference(cache)
                if new:
                    for w in rare if len(rare) + len(new) > CACHE_WORDS else ():
                        cache.pop(w)
                    rare = rare if len(rare) + len(new) <= CACHE_WORDS else {}
                    new = set(itertools.chain.from_iterable(texts)).difference(cache)
                    more = replay.encode(new)
                    rare.update(more)
                    cache.update(more)
                look = cache.__getitem__
                ids = [list(itertools.chain.from_iterable(map(look, words))) for words in texts]
                lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
                flat_ids = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int32, count=int(lengths.sum()))
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat_ids))
                yield pa.RecordBatch.from_arrays([part.column(0), column], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
