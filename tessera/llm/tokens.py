"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

1. All texts are split into words by the tokenizer's pattern and counted over the whole corpus.
2. The most frequent words are encoded once and compiled into a minimal acyclic transducer (:mod:`.lexicon`), a file that
   every executor fetches from the shared folder and every task memory-maps.
3. Each text is split again; its words are looked up in the transducer, and words it lacks are merged exactly, by the
   tokenizer's own ranks. So the result never depends on which words were frequent.

Both passes cut a text before each space that something visible follows, where the pattern cannot but begin a word, and
split a repeated piece only once.

Defined results: a null or empty text has an empty list; every row has one, repeated rows too; strings of special tokens
are ordinary text; very long texts and words are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.lexicon import Builder, Lexicon
from tessera.plans.shared import share, store

#: Where the vocabulary files are, and which one is used.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Pre-tokenisation of byte_bpe_50k (fixed value, published with the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words in the lexicon at most, and the longest word it takes, in bytes. Neither changes any result.
LEXICON_WORDS, WORD_BYTES = 50_000, 48
#: Buckets of word counts for each doubling.
BUCKETS = 16
#: Characters of text worked on at a time, and pieces or words a task remembers at most, of which length.
CHARACTERS, REMEMBERED, PIECE = 4_000_000, 200_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: merges the adjacent pair of lowest rank, the leftmost first, until none is left."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    pairs = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(pairs)
    while pairs:
        _, i, stop = heapq.heappop(pairs)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        end[i], after[i], alive[j] = stop, after[j], False
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n and (r := ranks.get(word[a : end[after[a]]])) is not None:
                heapq.heappush(pairs, (r, a, end[after[a]]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def merger(ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    """Exact ids of a word; by tiktoken's compiled merge where it is installed."""
    try:
        import tiktoken
    except ImportError:
        return lambda word: merge(word.encode(), ranks)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def splitter() -> Callable[[str], list[str]]:
    import regex

    return regex.compile(PATTERN).findall


def cutter() -> Callable[[str], list[str]]:
    """Cuts a text into pieces whose words, one piece after the other, are the text's words.

    Cuts are the spaces before anything visible: there the pattern takes the space with what follows, and white space
    before it ends a word either way. A piece stands for itself with that space; the first has none, and is marked by one.
    """
    import regex

    careful, odd = regex.compile(r" (?=\S)").split, regex.compile(r" (?:\s|$)").search

    def cut(text: str) -> list[str]:
        pieces = careful(text) if odd(text) else text.split(" ")
        pieces[0] = " " + pieces[0]
        return pieces

    return cut


def said(piece: str) -> str:
    return piece[1:] if piece.startswith(" ") else " " + piece


def _slices(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts, null as empty, in runs of a bounded size."""
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= CHARACTERS:
            yield run
            run, size = [], 0
    if run:
        yield run


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, cut, pieces, counts, size = splitter(), cutter(), Counter(), Counter(), 0

    def resolve():
        for piece, n in pieces.items():
            for w in split(said(piece)):
                counts[w] += n
        pieces.clear()

    def out():
        words = [(w, n) for w, n in counts.items() if len(w.encode()) <= WORD_BYTES]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())], names=["word", "n"])

    for batch in batches:
        for texts in _slices(batch.column(0).to_pylist()):
            for t in texts:
                pieces.update(cut(t))
                size += len(t)
            if size >= 4 * CHARACTERS:  # no more than that is held in pieces
                resolve()
                size = 0
                if len(counts) > 500_000:
                    yield out()
    resolve()
    yield out()


def frequent_words(texts: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """The words that occur most often in all texts, ``most`` at most.

    A histogram of counts (a few hundred buckets) gives the count from which on few enough words are left, so that the
    driver gets those and no partition has to send it a ranking of its own.
    """
    words = texts.where(F.col("text").isNotNull()).select("text").mapInArrow(_count_words, "word string, n long")
    counts = store(words.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").withColumn("bucket", F.floor(F.log2("n") * BUCKETS).cast("int")))
    left, least = most, None
    for bucket, n in counts.groupBy("bucket").count().orderBy(F.desc("bucket")).collect():
        left -= n
        if left < 0:
            break
        least = bucket
    return [] if least is None else [r[0] for r in counts.where(F.col("bucket") >= least).select("word").collect()]


def compile_lexicon(words: Iterable[str], encode: Callable[[str], list[int]]) -> bytes:
    builder = Builder()
    for word in sorted({w.encode(): w for w in words if w}.items()):
        builder.add(word[0], encode(word[1]))
    return builder.buffer()


def _assemble(words: list[list[str]], ids: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids in one array, and where each text's begin and end, from each text's words and each word's ids."""
    number = {w: i for i, w in enumerate(ids)}
    flat = np.fromiter(chain.from_iterable(ids.values()), np.int32)
    ends = np.cumsum(np.fromiter(map(len, ids.values()), np.int64, len(ids)))
    sizes = np.diff(ends, prepend=0)
    said = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64)
    n = sizes[said]
    upto = np.concatenate([[0], np.cumsum(n)])
    # Within the run of a word, its ids follow one another.
    at = np.arange(upto[-1]) + np.repeat((ends - sizes)[said] - upto[:-1], n)
    bounds = upto[np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])]
    return flat[at], bounds


class _Pieces:
    """The ids of pieces, by the words within; short ones are remembered."""

    def __init__(self, lexicon: Lexicon, unseen: Callable[[str], list[int]]) -> None:
        self.lexicon, self.unseen, self.split = lexicon, unseen, splitter()
        self.pieces: dict[str, list[int]] = {}
        self.words: dict[str, list[int]] = {}

    def word(self, w: str) -> list[int]:
        ids = self.words.get(w)
        if ids is None:
            ids = self.lexicon.find(w.encode())
            if ids is None:
                ids = self.unseen(w)
            if len(w) <= PIECE:
                self.words[w] = ids
        return ids

    def ids(self, wanted: Iterable[str]) -> dict[str, list[int]]:
        found = {}
        for piece in wanted:
            ids = self.pieces.get(piece)
            if ids is None:
                ids = [i for w in self.split(said(piece)) for i in self.word(w)]
                if len(piece) <= PIECE:
                    self.pieces[piece] = ids
            found[piece] = ids
        for held in (self.pieces, self.words):
            if len(held) > REMEMBERED:
                held.clear()
        return found


def _encode(name: str, ranks, columns: int, only_counts: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cut = _Pieces(Lexicon.map(SparkFiles.get(name)), merger(ranks.value)), cutter()
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(columns).to_pylist()):
                pieces = [cut(t) for t in texts]
                flat, bounds = _assemble(pieces, known.ids(set(chain.from_iterable(pieces))))
                values = pa.array(np.diff(bounds)) if only_counts else pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
                kept = [batch.column(i).slice(at, len(texts)) for i in range(columns)]
                yield pa.RecordBatch.from_arrays([*kept, values], names=[*batch.schema.names[:columns], "out"])
                at += len(texts)

    return run


def encode(df: DataFrame, keep: list[str], text: str, *, only_counts: bool = False, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``ids`` (list of int), or ``n_tokens`` with ``only_counts``, of every row."""
    spark, ranks = df.sparkSession, read_ranks(f"{folder}/{vocabulary}")
    rows = df.select(*keep, F.col(text).alias("text"))
    lexicon = compile_lexicon(frequent_words(rows), merger(ranks))
    name = share(spark, f"lexicon-{blake2b(lexicon, digest_size=12).hexdigest()}.bin", lexicon)
    # The ranks are the vocabulary file, 50,256 entries.
    run = _encode(name, spark.sparkContext.broadcast(ranks), len(keep), only_counts)
    kept = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, f"{kept}, out {'long' if only_counts else 'array<int>'}").withColumnRenamed("out", "n_tokens" if only_counts else "ids")
