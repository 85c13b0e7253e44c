"""Language identification by multilingual mixtures.

A word is a run of letters; each letter with its two neighbours is an n-gram. Counts of
n-grams per language, over all labelled documents, give the likelihood of a word in each
language. A document mixes languages: expectation maximisation estimates the share of each
from its words. Languages enter in order of their shares for as long as the penalised
likelihood, ``log L - PENALTY * (languages - 1) * log(words)``, grows; the set with the
highest value is the document's, and its largest share names it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tokens import slices

#: Cells of the n-gram table of a language.
BINS = 1 << 16
SMOOTHING = 0.5
PENALTY, ROUNDS = 2.0, 10
UNDETERMINED = "und"
#: Letters times languages that are worked on together.
CELLS = 1 << 22

SHARES = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
TOLD = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("langs", SHARES)])
TOLD_SQL = "lang_pred string, score double, langs array<struct<lang: string, share: double>>"
FIELDS = pa.schema([("doc_id", pa.int64()), *((f.name, f.type) for f in TOLD)])
COUNTS = pa.schema([("lang", pa.string()), ("bin", pa.int32()), ("n", pa.int64())])


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell of each letter's n-gram, where each word starts among them, the words of each text."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = _letters()[codes]
    code = np.where(is_letter, codes, 0).astype(np.uint32)
    at = np.flatnonzero(is_letter)
    cell = code[at - 1] * np.uint32(0x9E3779B1) + code[at] * np.uint32(0x85EBCA77) + code[at + 1] * np.uint32(0xC2B2AE3D)
    cell = ((cell ^ (cell >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    starts = np.flatnonzero(~is_letter[at - 1])
    edges = np.cumsum([1] + [len(t) + 1 for t in lowered])
    return cell.astype(np.int64), starts, np.diff(np.searchsorted(at[starts], edges))


def count_ngrams(labelled: DataFrame) -> DataFrame:
    """(lang, bin, n) over all rows of (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch["text"].to_pylist(), batch["lang"].to_pylist()
            for a, b in slices(texts):
                by: dict[str, list] = {}
                for text, lang in zip(texts[a:b], langs[a:b]):
                    by.setdefault(lang, []).append(text)
                for lang, some in by.items():
                    found = np.bincount(ngrams(some)[0], minlength=BINS)
                    total[lang] = total[lang] + found if lang in total else found
        for lang, counts in total.items():
            bins = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(bins), pa.string()), pa.array(bins, pa.int32()), pa.array(counts[bins], pa.int64())],
                schema=COUNTS,
            )

    counted = labelled.mapInArrow(count, "lang string, bin int, n long")
    return counted.groupBy("lang", "bin").agg(F.sum("n").alias("n"))


class Model:
    """Log-likelihoods of n-grams: one row per cell, one column per language."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    @classmethod
    def of(cls, counts: DataFrame) -> Model:
        """From (lang, bin, n): no more rows than BINS for each language."""
        found = counts.toPandas()
        languages = sorted(found["lang"].unique())
        table = np.full((BINS, len(languages)), SMOOTHING)
        column = {lang: k for k, lang in enumerate(languages)}
        table[found["bin"].to_numpy(), [column[x] for x in found["lang"]]] += found["n"].to_numpy()
        return cls(languages, np.log(table / table.sum(axis=0)).astype(np.float32))

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Which texts have letters, and for these the share of each language (0: not in the set)."""
        cells, starts, words = ngrams(texts)
        some = np.flatnonzero(words)
        if not len(some):
            return some, np.zeros((0, len(self.languages)))
        logs = np.add.reduceat(self.table[cells], starts, axis=0).astype(np.float64)
        top = logs.max(axis=1, keepdims=True)
        return some, mixture(np.exp(logs - top), words[some])


def mixture(likely: np.ndarray, words: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> np.ndarray:
    """Shares by document from the likelihoods of its words (rows, document after document)."""
    n_langs, first = likely.shape[1], np.cumsum(words) - words
    doc = np.repeat(np.arange(len(words)), words)

    def fit(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            weight = likely * share[doc]
            weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-300)
            share = np.add.reduceat(weight, first, axis=0) / words[:, None]
        logs = np.log(np.maximum((likely * share[doc]).sum(axis=1), 1e-300))
        return share, np.add.reduceat(logs, first)

    start, _ = fit(np.full((len(words), n_langs), 1 / n_langs))
    rank = np.argsort(np.argsort(-start, axis=1, kind="stable"), axis=1)
    best, best_value = np.zeros_like(start), np.full(len(words), -np.inf)
    cost = penalty * np.log(words + 1.0)
    going = np.ones(len(words), bool)
    for k in range(1, n_langs + 1):
        share = np.where(rank < k, np.maximum(start, 1e-6), 0)
        share, value = fit(share / share.sum(axis=1, keepdims=True))
        value = value - cost * (k - 1)
        going &= value > best_value
        if not going.any():
            break
        best[going], best_value[going] = share[going], value[going]
    return best


def predict(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, langs.

    ``langs`` are the languages of the selected set with their shares, largest first;
    lang_pred is the first of them and score its share. A text that is null or has no
    letter, and any text if no language was learned, is ``und`` with score 0 and no langs.
    Equal texts have equal results. Other columns are ignored. An empty table gives an
    empty result.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # BINS times the languages

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(list(_told(shared.value, batch["text"].to_pylist())), TOLD)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *found.flatten()], schema=FIELDS)

    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(tell, "doc_id long, " + TOLD_SQL)


def _told(model: Model, texts: list[str | None]) -> Iterator[dict]:
    names = model.languages
    for a, b in slices(texts, max(1, CELLS // max(1, len(names)))):
        langs: list[list] = [[] for _ in range(a, b)]
        if names:
            some, share = model.shares(texts[a:b])
            order = np.argsort(-share, axis=1, kind="stable")
            for i, row, by in zip(some.tolist(), share, order):
                langs[i] = [{"lang": names[k], "share": min(1.0, float(row[k]))} for k in by if row[k] > 0]
        for found in langs:
            first = found[0] if found else {"lang": UNDETERMINED, "share": 0.0}
            yield {"lang_pred": first["lang"], "score": first["share"], "langs": found}


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(documents: DataFrame, hold_out: bool = True) -> Model:
    """A model from the texts and languages of all documents, or all that are not held out;
    rows without a text or a language are left out."""
    labelled = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if hold_out:
        labelled = labelled.filter(~held_out(F.col("doc_id")))
    return Model.of(count_ngrams(labelled.select("text", "lang")))


def with_language(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents with a struct ``__language``: lang_pred, score, langs; see ``predict``.
    All columns pass through the workers, so nothing is joined or shuffled."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(list(_told(shared.value, batch[text_col].to_pylist())), TOLD)
            yield batch.append_column("__language", found)

    schema = StructType([*documents.schema.fields]).add("__language", StructType.fromDDL(TOLD_SQL))
    return documents.mapInArrow(tell, schema)
