"""Visually identical text with different characters: one form for all texts that look the same.

The skeleton of a text: decompose it, replace every character by its prototype (the character it is drawn like), and
decompose again. Width forms, composed and separate accents, invisible characters, kinds of spaces, and letters and
signs of other blocks drawn alike vanish; case, digits, punctuation, accents, raised and circled digits stay. Documents
are grouped by equal skeletons.

The look-alike letters come from the public confusables data that Spark's own libraries hold, by the rules of
:func:`letters`; every entry that is not followed has its reason there.

Only digests of skeletons and texts are shuffled. Copies of a text are one class; pairs are made between the classes of
a skeleton, in blocks, and then expanded, so a group of plain copies, however large, is never paired with itself. The
documents of a text with very many copies are spread over parts before they meet its pairs.

Defined results: a null text has a null form; texts that show nothing (null, empty, only spaces or invisible characters)
look like no other; the number of spaces counts, their kind does not; repeated rows pair like other copies; very long
texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import struct
import unicodedata
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.shared import hot_keys, pairs_within, store

#: Where the look-alike data are on the class path.
DATA = "com/ibm/icu/impl/data/icudata/confusables.cfu"
# Letters drawn alike that the data lack or draw otherwise, and signs, each with what they are drawn like.
LETTERS = "ϲϹԚӏԼ", "cCQlL"
SIGNS = "‐‑‒−˗⁄∕∶ː։∣∗‚․µΩ∆∑∏", "-----//:::|*,.μΩΔΣΠ"
#: Letters whose prototype can be told apart from them: the dot counts like an accent.
TOLD_APART = "ı"
#: Ranges whose characters are drawn like what they decompose to: radicals, Roman numerals, small and width forms.
DRAWN_ALIKE = ((0x2E80, 0x2FD5), (0x2160, 0x217F), (0xFE50, 0xFE6F), (0xFF01, 0xFFEE))
#: Invisible besides the format characters: joiners, fillers and variation selectors.
INVISIBLE = (0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF)
#: Format characters that can be seen: Arabic and Kaithi number signs, and the tags within flags.
SEEN = (0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x08E2, 0x08E2), (0x110BD, 0x110CD), (0xE0020, 0xE007F)
#: Copies of a text from which, and pairs of a look by which, the work is split.
COPIES, VARIANTS, MOST_HOT = 10_000, 512, 1_000

_read: dict[int, str] = {}
_made: dict[int, str | None] = {}


def confusables(spark: SparkSession) -> dict[int, str]:
    """The public look-alike data: code points and what they are drawn like. They are read once."""
    if not _read:
        stream = spark.sparkContext._jvm.Thread.currentThread().getContextClassLoader().getResourceAsStream(DATA)
        if stream is None:
            raise RuntimeError(f"{DATA} is not on Spark's class path")
        _read.update(parse(bytes(stream.readAllBytes())))
        stream.close()
    return _read


def parse(data: bytes) -> dict[int, str]:
    """The published binary form: keys (code point, length - 1 in the top byte) beside a character or a place in a pool."""
    body = data[int.from_bytes(data[:2], "big") :]
    if body[:4] != bytes.fromhex("3845fdef"):
        raise ValueError("these are no look-alike data")
    _, keys_at, n, values_at, _, pool_at, units = struct.unpack(">7i", body[8:36])
    keys, values = struct.unpack_from(f">{n}I", body, keys_at), struct.unpack_from(f">{n}H", body, values_at)
    pool = body[pool_at : pool_at + 2 * units]
    return {k & 0xFFFFFF: pool[2 * v : 2 * (v + (k >> 24) + 1)].decode("utf-16-be") if k >> 24 else chr(v) for k, v in zip(keys, values)}


def _script(c: str) -> str:
    return unicodedata.name(c, "?").partition(" ")[0]


def letters(drawn_like: dict[int, str]) -> tuple[dict[int, str], dict[int, str]]:
    """Prototypes of letters by the look-alike data, and the letters left as they are, each with its reason.

    A letter becomes the ASCII letter of its own case that the data draw alike, else a single letter of another script.
    """
    ascii_letters: dict[str, list[str]] = {}
    for c in map(chr, range(0x80)):
        if c.isalpha():
            ascii_letters.setdefault(drawn_like.get(ord(c), c), []).append(c)
    table, left = {}, {}
    for c, look in drawn_like.items():
        own = unicodedata.category(chr(c))
        if c < 0x80 or own[0] != "L":
            continue
        alike = ascii_letters.get(look, [])
        fit = [a for a in alike if own in ("Lo", "Lm") or unicodedata.category(a) == own]
        if chr(c) in TOLD_APART:
            left[c] = "can be told apart"
        elif decomposition := unicodedata.decomposition(chr(c)):
            left[c] = "its style can be seen" if decomposition[0] == "<" else "is decomposed"
        elif fit:
            table[c] = fit[0] if len(fit) == 1 else look if look in fit else fit[0]
        elif alike:
            left[c] = "drawn like a letter of the other case"
        elif len(look) > 1:
            left[c] = "drawn like several characters"
        elif unicodedata.category(look) != own:
            left[c] = "drawn like a digit, a sign or a letter of another kind"
        elif _script(look) == _script(chr(c)):
            left[c] = "drawn like a letter of its own script"
        else:
            table[c] = look
    return table, left


def prototypes(drawn_like: dict[int, str]) -> dict[int, str | None]:
    """The whole look-alike table, for ``str.translate``."""
    table: dict[int, str | None] = dict(letters(drawn_like)[0])
    for theirs, ours in (LETTERS, SIGNS):
        table |= {ord(a): b for a, b in zip(theirs, ours, strict=True)}
    for lo, hi in DRAWN_ALIKE:
        for c in range(lo, hi + 1):
            kind, _, points = unicodedata.decomposition(chr(c)).partition("> ")
            if kind in ("<compat", "<wide", "<narrow", "<small"):
                table[c] = "".join(table.get(int(p, 16)) or chr(int(p, 16)) for p in points.split())
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        if category == "Zs" and c != 0x1680:
            table[c] = " "
        elif category == "Cf" and not any(lo <= c <= hi for lo, hi in SEEN):
            table[c] = None
    for lo, hi in INVISIBLE:
        table |= dict.fromkeys(range(lo, hi + 1))
    del table[0x20]
    # Prototypes of prototypes.
    while moved := {c: to for c, t in table.items() if t and (to := t.translate(table)) != t}:
        table |= moved
    return table


def skeleton(text: str, table: dict[int, str | None]) -> str:
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table))


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _forms(table):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [None if t is None else unicodedata.normalize("NFC", skeleton(t, table.value)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], names=["doc_id", "form"])

    return run


def _digests(table):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, looks, owns = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                look = skeleton(text, table.value)
                if look.strip():
                    own = _digest(text)
                    ids.append(doc_id)
                    looks.append(own if look is text else _digest(look))
                    owns.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(looks, pa.binary()), pa.array(owns, pa.binary())], names=["doc_id", "look", "own"])

    return run


def _table(spark: SparkSession):
    """The table for every task: some thousand entries, whatever the documents are. It is made once."""
    if not _made:
        _made.update(prototypes(confusables(spark)))
    return spark.sparkContext.broadcast(_made)


def consistent_forms(documents: DataFrame) -> DataFrame:
    """doc_id, form: the skeleton of each text, composed."""
    return documents.select("doc_id", "text").mapInArrow(_forms(_table(documents.sparkSession)), "doc_id long, form string")


def look_classes(documents: DataFrame) -> DataFrame:
    """doc_id, look, own: digests of the skeleton and of the text of each document that shows anything."""
    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    return rows.mapInArrow(_digests(_table(documents.sparkSession)), "doc_id long, look binary, own binary")


def lookalikes(documents: DataFrame, *, copies: int = COPIES) -> DataFrame:
    """doc_id_a < doc_id_b of all pairs of documents that look the same but differ in their characters."""
    rows = store(look_classes(documents))
    texts = rows.groupBy("look", "own").agg(F.count(F.lit(1)).alias("n"))
    texts = store(texts)
    several = texts.groupBy("look").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("look")
    texts = store(texts.join(several, "look", "left_semi"))
    pairs = pairs_within(texts.select("look", "own"), ["look"], "own", VARIANTS)
    # Texts with a thousandth of all copies or more are a thousand at most; their documents are spread over parts.
    total = texts.agg(F.sum("n")).first()[0] or 0
    hot = hot_keys(texts, "own", "n", max(copies, -(-total // MOST_HOT)), MOST_HOT)
    parts = {own: -(-n // copies) for own, n in hot}
    spread = documents.sparkSession.createDataFrame([(bytes(own), min(p, 10_000)) for own, p in parts.items()], "own binary, parts int")

    def side(letter: str) -> DataFrame:
        df = rows.select("look", F.col("own").alias(f"own_{letter}"), F.col("doc_id").alias(letter))
        return df if not parts else df.join(F.broadcast(spread.withColumnRenamed("own", f"own_{letter}")), f"own_{letter}", "left").withColumn("part", F.pmod(F.xxhash64(letter), F.coalesce("parts", F.lit(1)))).drop("parts")

    def parted(df: DataFrame, letter: str) -> DataFrame:
        if not parts:
            return df
        df = df.join(F.broadcast(spread.withColumnRenamed("own", f"own_{letter}")), f"own_{letter}", "left")
        return df.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts").cast("long"), F.lit(1)) - 1))).drop("parts")

    found = pairs
    for letter in "ab":
        on = ["look", f"own_{letter}"] + ["part"] * bool(parts)
        found = parted(found, letter).join(side(letter), on).drop("part")
    return found.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
