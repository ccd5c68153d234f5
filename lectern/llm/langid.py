"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has one probability a vocabulary piece. A text's likelihood is the sum over all segmentations of its words
into pieces of the product of the pieces' probabilities (a forward algorithm); white space begins a new word, as in the
vocabulary, so words are scored once each and their logarithms added. Distinct words of a batch are scored together with
array operations, longest pieces included, and a task remembers a bounded number of them; words of any length are summed
whole, in windows that carry the last sums on. Case is folded. A character that no piece covers costs the same in every language.

The model is fitted on a bounded sample (``sample_per_language`` expected rows a language, by a hash of the id); everything
else sees all rows and whole texts. Only text is scored.

Work arrays have a bounded number of cells whatever the number of labels and the length of a text; the model itself has a number a
piece and label. Null text, empty text and text without a letter give ``und`` and score 0. Ties between languages go to the first in
alphabetical order. With no labelled row every text is ``und``. Very long texts and words are scored whole; an empty table to fit or
to predict gives an empty model or result. Repeated rows get equal results; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are scored together up to about so many characters, and a longer word in windows of so many; nothing is cut. Above
#: FEW languages a group has fewer characters, so that its arrays stay as large.
GROUP_CHARS, FEW = 1 << 17, 4
SAMPLE_PER_LANGUAGE = 1500
#: Texts whose words are scored together, and numbers (words x languages) that a task remembers of the words it has scored.
TEXTS, REMEMBERED = 500, 1 << 20
SMOOTHING = 0.1
MARK = "▁"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def read_pieces(path: str) -> list[str]:
    """The vocabulary's pieces; control, unknown and byte pieces are empty here."""
    sp = _processor(path)
    return ["" if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) else sp.id_to_piece(i) for i in range(sp.get_piece_size())]


@dataclass
class Model:
    """languages; table: probabilities [piece, language]; keys: sorted hashes of the pieces, with their rows in ``rows``."""

    languages: list[str]
    table: np.ndarray
    keys: np.ndarray
    rows: np.ndarray
    longest: int
    unknown: float


_WEIGHT = np.uint64(0x100000001B3)


def _roll(hashes: np.ndarray, chars: np.ndarray) -> np.ndarray:
    return (hashes ^ (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * _WEIGHT


def _finish(hashes: np.ndarray) -> np.ndarray:
    x = hashes ^ (hashes >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _hash_of(piece: str) -> int:
    h = np.zeros(1, np.uint64)
    for c in piece:
        h = _roll(h, np.array([ord(c)]))
    return int(_finish(h)[0])


def build(pieces: list[str], languages: list[str], counts: np.ndarray) -> Model:
    """A model from counts [piece, language]."""
    real = np.array([bool(p) for p in pieces])
    table = np.where(real[:, None], counts + SMOOTHING, 0.0)
    table = table / table.sum(axis=0, keepdims=True)
    at = np.flatnonzero(real)
    hashes = np.array([_hash_of(pieces[i]) for i in at], np.uint64)
    order = np.argsort(hashes)
    return Model(languages, table, hashes[order], at[order].astype(np.int64), max(map(len, pieces), default=1), 1e-7)


class Scorer:
    """Scores texts with a model; a table of buckets finds a piece by its hash."""

    def __init__(self, model: Model):
        self.model = model
        bits = 18
        self.shift = np.uint64(64 - bits)
        bucket = model.keys >> self.shift
        self.first = np.searchsorted(bucket, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max(initial=0))
        self.index: dict[str, int] = {}
        self.most = max(1, REMEMBERED // max(1, len(model.languages)))
        self.logs = np.zeros((0, len(model.languages)))

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of the model's table, or -1."""
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(hashes), -1, np.int32)
        for k in range(self.deepest):
            live = np.flatnonzero(at + k < end)
            if not len(live):
                break
            slot = at[live] + k
            same = self.model.keys[slot] == hashes[live]
            out[live[same]] = self.model.rows[slot[same]]
        return out

    def _group_chars(self) -> int:
        return max(1, GROUP_CHARS * FEW // max(FEW, len(self.model.languages)))

    def _groups(self, words: list[str]) -> Iterator[list[int]]:
        """Places of words that are scored together, long words first."""
        group, held, most = [], 0, self._group_chars()
        for i in sorted(range(len(words)), key=lambda i: -len(words[i])):
            if group and held + len(words[i]) > most:
                yield group
                group, held = [], 0
            group.append(i)
            held += len(words[i])
        if group:
            yield group

    def words(self, words: list[str]) -> np.ndarray:
        """log P(word | language), [word, language]: forward sums over all segmentations of whole words, however long."""
        out = np.zeros((len(words), len(self.model.languages)))
        for group in self._groups(words):
            out[group] = self._forward([words[i] for i in group])
        return out

    def _pieces(self, parts: list[str], low: int) -> tuple[np.ndarray, ...]:
        """(end, length, word, row) of each piece in ``parts``, by end, then word; ends at or before ``low`` are left out."""
        chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(p) for p in parts], np.int64)
        word = np.repeat(np.arange(len(parts)), sizes)
        place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = sizes[word] - place
        live, rolled, found = np.arange(len(chars)), np.zeros(len(chars), np.uint64), []
        for n in range(1, self.model.longest + 1):
            stay = left[live] >= n
            live, rolled = live[stay], rolled[stay]
            if not len(live):
                break
            rolled = _roll(rolled, chars[live + n - 1])
            rows = self._find(_finish(rolled))
            hit = np.flatnonzero((rows >= 0) & (place[live] + n > low))
            found.append((place[live[hit]] + n, np.full(len(hit), n), word[live[hit]], rows[hit]))
        columns = [np.concatenate([f[k] for f in found]) for k in range(4)] if found else [np.zeros(0, np.int64)] * 4
        order = np.lexsort((columns[2], columns[0]))
        return tuple(c[order] for c in columns)

    def _forward(self, words: list[str]) -> np.ndarray:
        """``words`` from long to short. Only as many rows of the sums are kept as a piece is long; characters come in windows."""
        m, ring, window = self.model, self.model.longest + 1, self._group_chars()
        sizes = np.array([len(w) for w in words])
        alpha = np.zeros((ring, len(words), len(m.languages)))
        alpha[0] = 1.0
        scale, out, active = np.zeros(alpha.shape[1:]), np.zeros(alpha.shape[1:]), len(words)
        for low in range(0, int(sizes[0]), window):
            high = min(int(sizes[0]), low + window)
            back = max(0, low - m.longest + 1)
            ends, lengths, word, rows = self._pieces([w[back:high] for w in words[:active]], low - back)
            bounds = np.searchsorted(ends, np.arange(low - back + 1, high - back + 2))
            firsts = np.flatnonzero(np.append(True, (ends[1:] != ends[:-1]) | (word[1:] != word[:-1]))) if len(ends) else np.zeros(0, np.int64)
            runs = np.searchsorted(firsts, bounds)  # the pieces of one end and word are one run
            for t in range(low + 1, high + 1):
                a, z = bounds[t - low - 1], bounds[t - low]
                new = alpha[(t - 1) % ring, :active] * m.unknown
                if z > a:
                    own = firsts[runs[t - low - 1] : runs[t - low]]
                    new[word[own]] += np.add.reduceat(alpha[(t - lengths[a:z]) % ring, word[a:z]] * m.table[rows[a:z]], own - a, axis=0)
                alpha[t % ring, :active] = new
                if t % 16 == 0:  # keep the numbers in range
                    scale[:active] += np.log(new)
                    alpha[:, :active] /= new
                while active and sizes[active - 1] == t:
                    active -= 1
                    out[active] = np.log(alpha[t % ring, active]) + scale[active]
        return out

    def batch(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text.

        A score is the posterior after the log-likelihoods are divided by the square root of the number of words, so that
        long texts don't all score 1.
        """
        m, index, base = self.model, self.index, len(self.index)
        spans, bounds = [], [0]
        for text in texts:
            words = text.lower().split() if text else []
            spans.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)))
            bounds.append(bounds[-1] + len(words))
        total = np.zeros((len(texts), len(m.languages)))
        if index and m.languages:
            flat, owner = np.concatenate(spans), np.repeat(np.arange(len(texts)), np.diff(bounds))
            cells, counts = np.unique(flat * len(texts) + owner, return_counts=True)  # by word, then text
            word_of, text_of = cells // len(texts), cells % len(texts)

            def add(at: np.ndarray, logs: np.ndarray) -> None:
                for k in range(len(m.languages)):
                    total[:, k] += np.bincount(text_of[at], logs[:, k] * counts[at], len(texts))

            old = np.flatnonzero(word_of < base)
            add(old, self.logs[word_of[old]])
            fresh = [MARK + w for w in islice(index, base, None)]
            keep = len(index) <= self.most
            if keep and len(self.logs) < len(index):
                held, self.logs = self.logs, np.zeros((min(self.most, 2 * len(index)), len(m.languages)))
                self.logs[: len(held)] = held
            for group in self._groups(fresh):  # a group's logarithms are added before the next group's are made
                logs, own = self._forward([fresh[i] for i in group]), np.array(group) + base
                low, high = np.searchsorted(word_of, own), np.searchsorted(word_of, own, "right")
                each = high - low
                add(np.repeat(high - np.cumsum(each), each) + np.arange(each.sum()), np.repeat(logs, each, axis=0))
                if keep:
                    self.logs[own] = logs
            if not keep:
                index.clear()
        names, scores = [], np.zeros(len(texts))
        for i, text in enumerate(texts):
            if not m.languages or not text or not any(map(str.isalpha, text)):
                names.append("und")
                continue
            z = (total[i] - total[i].max()) / max(1, bounds[i + 1] - bounds[i]) ** 0.5
            p = np.exp(z)
            best = int(np.argmax(p))
            names.append(m.languages[best])
            scores[i] = p[best] / p.sum()
        return names, scores


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample_per_language: int = SAMPLE_PER_LANGUAGE, path: str | None = None) -> Model:
    """Piece probabilities from the labelled rows (null labels and texts are left out).

    The sample keeps a row if a hash of its id is below sample_per_language / rows of the language. Pieces of the sample are
    counted on the executors; what comes to the driver is at most languages x pieces numbers.
    """
    path = path or vocabulary_path()
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("string").alias("lang"), F.col(key).cast("string").alias("id")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).withColumnRenamed("lang", "of")
    uniform = F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # a row a label: small beside the model, which has a number a label and piece
    sample = rows.join(F.broadcast(sizes), F.col("lang") == F.col("of")).filter(uniform * F.col("n") < sample_per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(path)
        found: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.asarray(sp.encode(body.lower(), num_threads=1), np.int64)
                own = found.setdefault(lang, np.zeros(sp.get_piece_size(), np.int64))
                np.add.at(own, ids, 1)
        for lang, n in found.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["lang", "piece", "n"])

    counted = sample.mapInArrow(count, "lang string, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    pieces = read_pieces(path)
    languages = sorted(counted["lang"].unique())
    counts = np.zeros((len(pieces), len(languages)))
    counts[counted["piece"].to_numpy(np.int64), np.searchsorted(np.array(languages, object), counted["lang"].to_numpy(object))] = counted["n"].to_numpy()
    return build(pieces, languages, counts)


def predict(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``df`` with the language and its score under ``names`` (columns so called are replaced); no shuffle."""
    df = df.drop(*names)
    schema = T.StructType([*df.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for a in range(0, whole.num_rows, TEXTS):
                b = whole.slice(a, TEXTS)
                found, scores = scorer.batch(b.column(at).to_pylist())
                yield pa.record_batch([*b.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, *names])

    return df.mapInArrow(score, schema)


def held_out(key: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text is 1 modulo 3; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))
