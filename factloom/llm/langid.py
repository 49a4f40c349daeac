"""Operator 3: language identification with language-bitmask n-gram filters.

The filter is bit-sliced: a slot of its table holds one bit for each language, so the AND of a
few slots gives all languages that contain an n-gram at once. A text's n-grams are looked up,
the bits are counted for each language, the counts are corrected for the filter's false
positives, and the largest corrected count decides.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, pieces, read_table

ORDERS = (3, 4)
#: Hashes an n-gram, and the least and greatest log2 of a filter's slots; 2 ** 22 slots take 32 MB for 64 languages.
HASHES, SLOT_BITS = 3, (16, 22)
#: Bound of the fit: labelled documents a language (about; chosen by hash). All their n-grams count.
FIT_DOCS = 4000
UNKNOWN = "und"
#: Least share of a document's n-grams that its language must hold for the pipeline to keep it.
MIN_RATE = 0.2

_SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: The bits of every byte, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_folded: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """Lower-case code point of every letter; the space for anything else."""
    if not _folded:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] in "LM":
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _folded.append(table)
    return _folded[0]


def letters(text: str | None) -> np.ndarray:
    """Folded code points with one space around and between words; empty if there is no letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.concatenate([[32], _fold_table()[points], [32]]).astype(np.uint64)
    x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]
    return x if len(x) > 1 else np.empty(0, np.uint64)


def grams(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of all n-grams of the folded text, repeats included."""
    out = []
    for n in ORDERS:
        if len(x) >= n:
            h = np.full(len(x) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h ^ x[i : len(x) - n + 1 + i]) * _SEEDS[0]
                h ^= h >> np.uint64(29)
            out.append(h)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


class LanguageFilter:
    """Bit-sliced Bloom filters of up to 64 languages a word, with as many words as needed."""

    def __init__(self, langs: list[str], common: str | None, bits: int = SLOT_BITS[0]):
        self.langs, self.common, self.bits = langs, common, bits
        self.words = max(1, -(-len(langs) // 64))
        width = next(w for w in (8, 16, 32, 64) if w >= min(len(langs), 64))
        self.slots = np.zeros((self.words, 1 << bits), f"u{width // 8}")
        self.false = np.zeros(len(langs))

    def places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        """The slots of n-grams, one array for each hash."""
        for seed in _SEEDS[1 : 1 + HASHES]:
            yield ((h * seed) >> np.uint64(64 - self.bits)).astype(np.int64)

    def finish(self) -> LanguageFilter:
        for lang in range(len(self.langs)):
            share = (self.slots[lang // 64] >> self.slots.dtype.type(lang % 64) & self.slots.dtype.type(1)).mean()
            self.false[lang] = share**HASHES
        return self

    def counts(self, h: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language's filter holds."""
        out = np.zeros(self.words * 64, np.int64)
        places, width = list(self.places(h)), self.slots.dtype.itemsize
        for w in range(self.words):
            mask = self.slots[w][places[0]]
            for at in places[1:]:
                mask &= self.slots[w][at]
            for byte in range(width):  # how often each pattern of eight languages, and so each of its bits
                found = np.bincount(mask.view(np.uint8)[byte::width], minlength=256)
                out[w * 64 + byte * 8 : w * 64 + byte * 8 + 8] = found @ _BITS
        return out[: len(self.langs)]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """The language, its share of all corrected counts, and the corrected share of the n-grams that it holds."""
        x = letters(text)
        if not len(x) or not self.langs:
            return UNKNOWN, 0.0, 0.0
        h = grams(x)
        corrected = np.maximum((self.counts(h) - len(h) * self.false) / (1 - np.minimum(self.false, 0.999)), 0)
        total = corrected.sum()
        if total <= 0:
            return self.common, 0.0, 0.0
        best = int(corrected.argmax())
        return self.langs[best], float(corrected[best] / total), float(corrected[best] / len(h))


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, share: float = 0.5) -> LanguageFilter:
    """The filter from rows with text and language.

    Rows are sampled by a hash of id and text to about `fit_docs` a language. A language holds an
    n-gram that occurs in it at `share` or more of the highest rate of any language. The filter
    is put together by Spark, so the driver gets its slots and never the n-grams.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}  # a row a language
    langs = sorted(sizes, key=lambda x: x.encode())
    if not langs:
        return LanguageFilter([], None)
    part = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, fit_docs / sizes[lang])))])
    draw = (F.xxhash64(F.lit("fit"), id_col, text_col).bitwiseAND((1 << 53) - 1)).cast("double") / float(1 << 53)
    rows = rows.where(draw < F.element_at(part, F.col(lang_col)))
    number = {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, hs in held.items():
                gram, n = np.unique(np.concatenate(hs), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), lang, np.int32)), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = grams(letters(text.as_py()))
                held.setdefault(number[lang], []).append(h)
                size += len(h)
                if size > 1_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    counts = rows.select(lang_col, text_col).mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "langid-grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row a language
    per = F.create_map(*[x for i, n in totals.items() for x in (F.lit(i), F.lit(float(n)))]) if totals else F.create_map(F.lit(0), F.lit(1.0))
    rates = counts.withColumn("rate", F.col("n") / F.element_at(per, F.col("lang")))
    top = rates.groupBy("gram").agg(F.max("rate").alias("top"))
    chosen = materialize(rates.join(top, "gram").where(F.col("rate") >= share * F.col("top")).select("lang", "gram"), "langid-chosen")
    most = chosen.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    bits = min(SLOT_BITS[1], max(SLOT_BITS[0], int(most * HASHES * 4).bit_length()))
    found = LanguageFilter(langs, max(langs, key=lambda x: (sizes[x], [-c for c in x.encode()])), bits)
    empty = LanguageFilter([], None, bits)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).to_numpy()
            masks = pa.array((np.uint64(1) << (lang % 64).astype(np.uint64)).view(np.int64))
            for at in empty.places(batch.column(1).to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(lang // 64), pa.array(at), masks], ["word", "slot", "mask"])

    masks = chosen.mapInArrow(slots, "word int, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()  # bounded by the slots
    found.slots[masks.column("word").to_numpy(), masks.column("slot").to_numpy()] = masks.column("mask").to_numpy().view(np.uint64).astype(found.slots.dtype)
    return found.finish()


def predict(docs: DataFrame, model: LanguageFilter, text_col: str = "text", without: tuple[str, ...] = ()) -> DataFrame:
    """`docs`, without some columns, with lang_pred and score added; columns of these names are replaced.

    A text without a letter, or null, is `und` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 32 MB at most for each 64 languages
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    at, keep = names.index(text_col), [i for i, c in enumerate(names) if c not in without]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at):
                found = [shared.value.predict(t.as_py()) for t in part.column(at)]
                told = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *told], [*(names[i] for i in keep), "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*(docs.schema.fields[i] for i in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", without: tuple[str, ...] = (), **how) -> DataFrame:
    """`docs` with held_out, lang_pred and score added, learned from the rows not held out.

    Columns of these three names are replaced; those in `without`, such as the text, are not
    returned. Rows that repeat an id are predicted each by its own text. Without any labelled text every
    row is `und`.
    """
    model = learn(docs.where(~held_out(id_col)), id_col, text_col, lang_col, **how)
    return predict(docs.withColumn("held_out", held_out(id_col)), model, text_col, without)


def keep_identified(docs: DataFrame, min_rate: float = MIN_RATE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """The rows of `docs` as they are, but for those whose language can't be told.

    Those have no letter, or the best language's filter holds less than `min_rate` of their
    n-grams, whatever other languages there are. Where nothing was learned no row is told.
    """
    model = learn(docs.where(~held_out(id_col)), id_col, text_col, lang_col, **how)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at):
                found = [shared.value.predict(t.as_py()) for t in part.column(at)]
                yield part.filter(pa.array([lang != UNKNOWN and rate >= min_rate for lang, _, rate in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_languages(docs, without=("text",)).select("doc_id", "held_out", "lang_pred", "score")
