"""Language identification by words first, then shorter and shorter character n-grams.

A word seen in training is scored by its log frequency in each language; an unseen word by the longest order of
character n-grams of which training has seen at least one. Counts come from a Spark aggregation over a bounded
sample of labelled documents; all words and n-grams from a floor of occurrences up are kept. Scores are fixed-point
integers, so a text's sums do not depend on their order or on what a worker remembers. The model is arrays alone: sorted
64-bit hashes of words and n-grams, and a row of scores for each; its size is checked before it goes to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..staging import stage
from .textbatch import give_back

_LETTERS = regex.compile(r"\p{L}+")

#: Tokens beyond which a worker forgets those it has scored; rows scored at a time; steps of a unit of log frequency.
MEMORY_TOKENS, ROWS, SCALE = 100_000, 100, 1 << 16
#: Bytes that a model may have.
MODEL_BYTES = 256 << 20


def one_of_each(rows: DataFrame, key: str) -> DataFrame:
    """One row for each value of ``key``: the least by its other columns."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("least")).select(key, "least.*")


def bounded_sample(rows: DataFrame, key: str, max_rows: int) -> DataFrame:
    """The rows of the ``max_rows`` smallest hashes of ``key``, one for each value (the least by its other columns)."""
    h = F.xxhash64(F.col(key), F.lit("sample"))
    edge = rows.select(h.alias("h")).orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    return one_of_each(rows.where(h <= F.lit(edge).cast("long")), key)


def within_bytes(rows: DataFrame, key: str, text_col: str, max_bytes: int) -> DataFrame:
    """Of a bounded sample with one row for each ``key``, those of the smallest hashes whose texts have ``max_bytes`` together; one row at least."""
    sizes = rows.select(F.xxhash64(F.col(key), F.lit("sample")).alias("h"), F.octet_length(text_col).alias("n")).toArrow().sort_by("h")
    ends = np.cumsum(sizes.column("n").to_numpy(zero_copy_only=False).astype(np.int64))
    last = int(np.searchsorted(ends, max_bytes, side="right"))
    if last >= len(ends):
        return rows
    return rows.where(F.xxhash64(F.col(key), F.lit("sample")) <= F.lit(sizes.column("h")[max(0, last - 1)].as_py()).cast("long"))


def hash_of(gram: str) -> int:
    """What Spark's xxhash64 gives for a string, as an unsigned number."""
    return xxhash.xxh64_intdigest(gram.encode(), 42)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of some texts in lower case, each token's number among them, and the texts' bounds."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    coded = lists.flatten().dictionary_encode()
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), bounds


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word stands in the texts of each language: lang, word, n."""
    for b in batches:
        tokens, code, bounds = split(b.column("text"))
        langs = b.column("lang").dictionary_encode()
        its = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(bounds)).astype(np.int64)
        pair, n = np.unique(its * max(1, len(tokens)) + code, return_counts=True)
        names, found = langs.dictionary.to_pylist(), tokens.to_pylist()
        rows = [
            (names[p // len(found)], w, k) for p, k in zip(pair.tolist(), n.tolist(), strict=True) for w in _LETTERS.findall(found[p % len(found)])
        ]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "gram", "n"],
        )


def _grams(orders: tuple[int, ...]):
    """The n-grams of words and how often: lang, kind (the order), gram, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[tuple, int] = {}
            for lang, word, k in zip(*(b.column(c).to_pylist() for c in ("lang", "gram", "n")), strict=True):
                framed = f" {word} "
                for n in orders:
                    for i in range(len(framed) - n + 1):
                        key = (lang, n, framed[i : i + n])
                        out[key] = out.get(key, 0) + k
            keys = list(zip(*out, strict=True)) or [(), (), ()]
            kinds = (pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(keys, kinds, strict=True)), pa.array(out.values(), pa.int64())],
                names=["lang", "kind", "gram", "n"],
            )
            out.clear()
            give_back()

    return run


def fit_languages(
    labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", max_docs: int = 12_000, max_bytes: int = 128 << 20,
    least_words: int = 2, least_grams: int = 5, orders: tuple[int, ...] = (5, 4, 3, 2, 1),
) -> dict:
    """Per-language log frequencies of words and character n-grams.

    Fits on ``max_docs`` documents and ``max_bytes`` of text at most (those of the smallest hashes of the id; an id counts once). All words that
    stand there ``least_words`` times or more, and all n-grams of ``least_grams`` times or more, are kept; they are told apart by 64-bit hashes.
    Rows with a null text or language are left out. A model of more than MODEL_BYTES raises ValueError.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
    )
    sample = within_bytes(stage(bounded_sample(rows, "id", max_docs), "sample"), "id", "text", max_bytes).select("lang", "text")
    words = stage(sample.mapInArrow(_words, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "words")
    grams = words.mapInArrow(_grams(orders), "lang string, kind int, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    every = words.select("lang", F.lit(0).alias("kind"), "gram", "n").unionByName(grams)
    least = F.when(F.col("kind") == 0, least_words).otherwise(least_grams)
    table = stage(
        every.groupBy("kind", F.xxhash64("gram").alias("h")).agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
        .where(F.col("total") >= least),
        "grams",
    )
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    if (size := table.count() * (8 + 4 * len(langs))) > MODEL_BYTES:
        raise ValueError(f"a model of {size} bytes: fewer documents, or higher floors")
    model: dict = {"langs": langs, "orders": orders, "keys": {}, "logs": {}}
    for k in (0, *orders):
        part = table.where(F.col("kind") == k).select("h", *[F.coalesce(F.col("by")[x], F.lit(0)).alias(f"n{i}") for i, x in enumerate(langs)]).toArrow()
        keys = part.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
        order = np.argsort(keys)
        seen = np.stack([part.column(f"n{i}").to_numpy(zero_copy_only=False) for i in range(len(langs))], axis=1)[order].astype(np.float64) if langs else np.zeros((len(keys), 0))
        model["keys"][k] = keys[order]
        model["logs"][k] = np.round(np.log((seen + 0.5) / (seen.sum(axis=0) + 0.5 * max(1, len(keys)))) * SCALE).astype(np.int32)
    return model


class Scorer:
    """Scores tokens once and sums them over texts; a score is a fixed-point integer for each language, and the number of words."""

    def __init__(self, model: dict) -> None:
        self.model, self.width, self.keys = model, len(model["langs"]), model["keys"]
        self.places: dict[str, int] = {}
        self.table = np.zeros((0, self.width + 1), np.int64)

    def find(self, kind: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known words (kind 0) or n-grams of an order, and their rows."""
        keys = self.keys[kind]
        at = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
        return (keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)), at

    def words(self, words: list[str]) -> np.ndarray:
        """Scores of words: a word's own when known, else the mean over its n-grams of the longest known order; 0 without any."""
        out = np.zeros((len(words), self.width), np.int64)
        known, at = self.find(0, np.fromiter(map(hash_of, words), np.uint64, len(words)))
        out[known] = self.model["logs"][0][at[known]] if len(self.keys[0]) else 0
        left = np.flatnonzero(~known)
        for n in self.model["orders"]:
            framed = [f" {words[i]} " for i in left.tolist()]
            counts = np.array([max(0, len(w) - n + 1) for w in framed], np.int64)
            hashes = np.fromiter((hash_of(w[k : k + n]) for w in framed for k in range(len(w) - n + 1)), np.uint64, int(counts.sum()))
            hit, at = self.find(n, hashes)
            its, found = np.repeat(np.arange(len(left)), counts)[hit], np.zeros((len(left), self.width), np.int64)
            if len(its):
                begin = np.flatnonzero(np.diff(its, prepend=-1))
                sums = np.add.reduceat(self.model["logs"][n][at[hit]].astype(np.int64), begin, axis=0)
                found = sums // np.diff(begin, append=len(its))[:, None]
                out[left[its[begin]]] = found
                left = np.delete(left, its[begin])
            if not len(left):
                break
        return out

    def tokens(self, tokens: list[str]) -> np.ndarray:
        """Sums over the words of each token, and how many words it has."""
        words = [_LETTERS.findall(t) for t in tokens]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros((len(tokens), self.width + 1), np.int64)
        full = np.flatnonzero(counts)
        if len(full):
            scores = self.words([w for its in words for w in its])
            out[full, :-1] = np.add.reduceat(scores, (np.cumsum(counts) - counts)[full], axis=0)
            out[:, -1] = counts
        return out

    def texts(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """The best language of each text and its share of the likelihood; ("und", 0) for a text without a letter."""
        said, share = ["und"] * len(column), np.zeros(len(column))
        for first in range(0, len(column) if self.width else 0, ROWS):
            tokens, code, bounds = split(column.slice(first, ROWS))
            if len(self.places) > MEMORY_TOKENS:
                self.places, self.table = {}, self.table[:0]
            tokens = tokens.to_pylist()
            new = [t for t in tokens if t not in self.places]
            if new:
                self.table = np.concatenate([self.table, self.tokens(new)])
                self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
            held = self.table[np.fromiter(map(self.places.__getitem__, tokens), np.int64, len(tokens))]
            full = np.flatnonzero(np.diff(bounds))
            if not len(full):
                continue
            sums = np.add.reduceat(held[code], bounds[full], axis=0)
            best = sums[:, :-1].argmax(axis=1)
            top = np.take_along_axis(sums, best[:, None], axis=1)
            likely = 1.0 / np.exp(np.maximum((sums[:, :-1] - top) / SCALE, -700.0)).sum(axis=1)
            for i, lang, p, n in zip(full.tolist(), best.tolist(), likely.tolist(), sums[:, -1].tolist(), strict=True):
                if n:
                    said[first + i], share[first + i] = self.model["langs"][lang], min(1.0, p)
        return said, share


def identify_languages(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Add lang_pred (a learned language, or ``und``) and score (0 to 1) to every row.

    Whole texts are read. A null text, or one without a letter, is ``und`` with score 0; so is every text when the
    model has learned no language. All columns stay; columns named lang_pred or score are replaced.
    """
    kept = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for b in batches:
            scorer = scorer or Scorer(shared.value)
            said, share = scorer.texts(b.column(at))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(said, pa.string()), pa.array(share)], names=[*b.schema.names, "lang_pred", "score"],
            )
            give_back()
        del scorer
        give_back()

    kind = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return kept.mapInArrow(run, kind)


def fold(id_col: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts
