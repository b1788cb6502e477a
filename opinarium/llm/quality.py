"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown in numpy on the driver from a bounded sample of the labelled
rows (``sample_rows``), joined to their texts before anything is computed; all
trees are flattened into arrays, which workers walk for whole batches at once.
Statistics are of whole texts, computed where they are used.

Null texts count as empty and have statistics too; repeated rows get equal
scores; an empty table gives an empty table; without labels of both kinds
every score is the share of label 1 (0.5 without labels), and keep_good() has
nothing to go by and keeps every row. Null or missing
labels are not learnt from, differing labels of a document count by their
mean. Columns of df named like a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns

THRESHOLD = 0.7
SAMPLE_ROWS = 20_000

MARKS = "!?.,;:|#$%&*@<>{}[]()_=/\\~^+\"'-"
(_LOWER, _UPPER, _LETTER, _DIGIT, _SPACE, _LINE, _OTHER), _FIRST_MARK = range(7), 7


def _classes() -> np.ndarray:
    """A class for each code point of the basic plane."""
    out = np.full(1 << 16, _OTHER, np.uint8)
    for c in range(0x3000):
        x = chr(c)
        out[c] = _LOWER if x.islower() else _UPPER if x.isupper() else _LETTER if x.isalpha() else _DIGIT if x.isdigit() else _SPACE if x.isspace() else _OTHER
    out[0x3000:0xD800] = _LETTER
    out[10] = _LINE
    for i, x in enumerate(MARKS):
        out[ord(x)] = _FIRST_MARK + i
    return out


_tables: list[np.ndarray] = []
NAMES = (
    "log_chars", "log_words", "word_mean", "word_sd", "word_long", "distinct_words", "top_word", "upper", "letters", "digits", "spaces", "other",
    *(f"mark_{ord(x)}" for x in MARKS), "marks", "capital_words", "log_lines", "line_mean", "distinct_lines", "line_ends", "entropy", "repeat_chars", "words_with_mark", "half_words",
)


def statistics(text: str) -> list[float]:
    """The numbers of NAMES for a whole text."""
    if not _tables:
        _tables.append(_classes())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _tables[0][np.minimum(points, 0xFFFF)]
    n = max(1, len(points))
    counts = np.bincount(kinds, minlength=_FIRST_MARK + len(MARKS)) / n
    words = text.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct = set(words)
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    few = np.bincount(np.minimum(points, 1023), minlength=1) / n
    few = few[few > 0]
    marked = (kinds >= _FIRST_MARK) & (kinds != _FIRST_MARK + MARKS.index(".")) & (kinds != _FIRST_MARK + MARKS.index(","))
    blank = (kinds == _SPACE) | (kinds == _LINE)
    letter = (kinds == _LOWER) | (kinds == _UPPER) | (kinds == _LETTER)
    after = np.concatenate([[True], blank[:-1]]) if len(points) else np.zeros(0, bool)
    half = words[: len(words) // 2]
    return [
        np.log1p(len(text)), np.log1p(len(words)), sizes.mean(), sizes.std(), (sizes > 15).mean(), len(distinct) / w, max((words.count(x) for x in ("the", "de", "der", "la", "of", "die")), default=0) / w,
        counts[_UPPER], counts[_LOWER] + counts[_UPPER] + counts[_LETTER], counts[_DIGIT], counts[_SPACE], counts[_OTHER], *counts[_FIRST_MARK:], marked.sum() / n,
        (after & (kinds == _UPPER)).sum() / w, np.log1p(len(lines)), len(text) / k, len(set(lines)) / k, sum(x.rstrip()[-1:] in ".!?" for x in lines) / k, float(-(few * np.log2(few)).sum()),
        (points[1:] == points[:-1]).mean() if n > 1 else 0.0, (letter[:-1] & marked[1:]).sum() / w if n > 1 else 0.0, len(distinct.intersection(half)) / max(1, len(set(half))) - len(set(half)) / max(1, len(distinct)),
    ]


class Trees:
    """Complete trees of one depth as arrays: node i has the children 2i+1 and 2i+2."""

    def __init__(self, bias: float, depth: int, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.bias, self.depth, self.feature, self.cut, self.leaf = bias, depth, feature, cut, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - (2**self.depth - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, least: int = 15, ridge: float = 1.0) -> Trees:
    """Boosts trees for the log-loss; splits are sought in histograms of quantile bins."""
    n, width = x.shape if len(y) else (0, len(NAMES))
    inner, leaves = 2**depth - 1, 2**depth
    mean = float(np.clip(y.mean() if n else 0.5, 1e-6, 1 - 1e-6))
    bias = float(np.log(mean / (1 - mean)))
    if not n or y.min() == y.max():
        return Trees(bias if n and y.min() == y.max() else 0.0, depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # x > cut[b]: bin over b
    margin, features, limits, outs = np.full(n, bias), [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            local = at - first
            best = np.zeros(many)
            for j in range(width):
                if not len(cuts[j]):
                    continue
                slot = local * (bins + 1) + code[:, j]
                G, H, C = (np.bincount(slot, v, many * (bins + 1)).reshape(many, -1).cumsum(1) for v in (g, h, None))
                gl, hl, cl = G[:, :-1], H[:, :-1], C[:, :-1]
                gt, ht, ct = G[:, -1:], H[:, -1:], C[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain = np.where((cl >= least) & (ct - cl >= least), gain, 0)[:, : len(cuts[j])]
                where = gain.argmax(1)
                top = gain[np.arange(many), where]
                for node in np.flatnonzero(top > best + 1e-9):
                    best[node], feature[first + node], cut[first + node] = top[node], j, cuts[j][where[node]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        at -= inner
        leaf = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        margin += leaf[at]
        features.append(feature)
        limits.append(cut)
        outs.append(leaf)
    return Trees(bias, depth, np.array(features), np.array(limits), np.array(outs))


def _rows(texts: list) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts]).reshape(len(texts), len(NAMES))


def with_statistics(df: DataFrame, text: str = "text", name: str = "statistics") -> DataFrame:
    """df with an array of the statistics of text."""

    def make(texts):
        return [pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * len(NAMES), _rows(texts).ravel())]

    return add_columns(df, T.StructType([T.StructField(name, T.ArrayType(T.DoubleType()))]), make, [text], sliced=text)


def with_score(df: DataFrame, trees: Trees, text: str = "text", name: str = "score") -> DataFrame:
    """df with a score of text, 0 to 1."""
    return add_columns(df, T.StructType([T.StructField(name, T.DoubleType())]), lambda texts: [pa.array(trees.score(_rows(texts)))], [text], sliced=text)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from the rows of df (doc_id, text) with a label, none of them held out.

    Up to about sample_rows of them are taken, by a hash of doc_id.
    """
    told = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    n = told.count()
    share = min(1.0, sample_rows / max(1, n))
    told = told.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # About sample_rows pairs of numbers are broadcast; other texts go no further than the scan.
    chosen = with_statistics(df.select("doc_id", text).join(F.broadcast(told), "doc_id"), text)
    sample = chosen.groupBy("doc_id").agg(F.min("statistics").alias("statistics"), F.min("y").alias("y")).toArrow()
    order = np.argsort(sample["doc_id"].to_numpy(), kind="stable")
    x = sample["statistics"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)) if len(order) else np.zeros((0, len(NAMES)))
    return grow(x[order], sample["y"].to_numpy()[order])


def score_documents(df: DataFrame, labels: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of df (doc_id, text)."""
    docs = df.select("doc_id", text)
    scored = with_score(docs, fit(docs, labels, text, sample_rows=sample_rows), text)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df whose text scores threshold or more, with df's columns."""
    name, trees = "_score_of_text", fit(df, labels, text)
    if not len(trees.feature):
        return df
    return with_score(df, trees, text, name).where(F.col(name) >= threshold).select(df.columns)
