"""Language identification by a convolutional network over bytes, trained and applied in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import Block, blocks, exact, ragged, small_batches, to_arrow

WINDOW = 128
WIDTHS, FILTERS, EMBEDDED = (2, 3, 4), 16, 8
PER_LABEL, MOST_ROWS, CUTS = 400, 4000, 4
THIN = 8
UNDETERMINED = "und"
_AT_ONCE = 64


def windows(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole texts in windows of fixed length, the last of each text filled up with zeros: bytes, text number, length."""
    size = np.diff(block.off)
    count = -(-size // WINDOW)
    order, first = ragged(np.zeros(block.n, np.int64), count)
    doc = np.repeat(np.arange(block.n), count)
    starts = block.off[doc] + order * WINDOW
    length = np.minimum(block.off[doc + 1] - starts, WINDOW)
    data = np.concatenate([block.data[: block.size], np.zeros(WINDOW, np.uint8)])
    out = data[starts[:, None] + np.arange(WINDOW)] if len(starts) else np.zeros((0, WINDOW), np.uint8)
    out[np.arange(WINDOW) >= length[:, None]] = 0
    return out, doc, length


class Network:
    """Byte embedding, filters of several widths, rectifier, maximum over the window, softmax."""

    def __init__(self, labels: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"embedding": rng.normal(0, 0.5, (256, EMBEDDED)), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))), "out_bias": np.zeros(len(labels))}
        for w in WIDTHS:
            self.p[f"filter{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDED), (w * EMBEDDED, FILTERS))
            self.p[f"bias{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self._tables = None

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n, rows = len(x), np.arange(len(x))
        embedded = self.p["embedding"][x]
        seen, features = {}, []
        for w in WIDTHS:
            places = WINDOW - w + 1
            columns = np.concatenate([embedded[:, j : j + places] for j in range(w)], axis=2)
            z = columns @ self.p[f"filter{w}"]
            at = z.argmax(axis=1)
            top = np.take_along_axis(z, at[:, None], axis=1)[:, 0] + self.p[f"bias{w}"]
            seen[w] = columns[rows[:, None], at], at, top > 0
            features.append(np.maximum(top, 0))
        f = np.concatenate(features, axis=1)
        error = _softmax(f @ self.p["out"] + self.p["out_bias"])
        error[rows, y] -= 1
        error /= n
        g = {"out": f.T @ error, "out_bias": error.sum(axis=0), "embedding": np.zeros_like(self.p["embedding"])}
        back = error @ self.p["out"].T
        for i, w in enumerate(WIDTHS):
            columns, at, on = seen[w]
            d = back[:, i * FILTERS : (i + 1) * FILTERS] * on
            g[f"filter{w}"] = np.einsum("bf,bfk->kf", d, columns)
            g[f"bias{w}"] = d.sum(axis=0)
            into = d[:, :, None] * self.p[f"filter{w}"].T
            for j in range(w):
                np.add.at(g["embedding"], x[rows[:, None], at + j], into[:, :, j * EMBEDDED : (j + 1) * EMBEDDED])
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 2) -> None:
        """Adam on shuffled batches."""
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(order), batch):
                step += 1
                for k, g in self.gradients(x[order[i : i + batch]], y[order[i : i + batch]]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self._tables = None

    def _filter_tables(self):
        """What each byte, or each pair of bytes, adds to the filters: a convolution is then a few table rows added up."""
        if self._tables is None:
            e = self.p["embedding"]
            part = {(w, j): e @ self.p[f"filter{w}"][j * EMBEDDED : (j + 1) * EMBEDDED] for w in WIDTHS for j in range(w)}
            pair = lambda w, j: (part[w, j][:, None] + part[w, j + 1][None]).reshape(-1, FILTERS)
            self._tables = pair(2, 0), pair(3, 0), part[3, 2], pair(4, 0), pair(4, 2)
        return self._tables

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        two, three, third, front, back = self._filter_tables()
        out, bias = [], np.concatenate([self.p[f"bias{w}"] for w in WIDTHS])
        for i in range(0, len(x), _AT_ONCE):
            b = np.ascontiguousarray(x[i : i + _AT_ONCE].T).astype(np.int64)  # positions first: the maximum runs over whole rows
            pair = b[:-1] * 256 + b[1:]
            tops = [two[pair].max(axis=0)]
            z = three[pair[:-1]]
            z += third[b[2:]]
            tops.append(z.max(axis=0))
            z = front[pair[:-2]]
            z += back[pair[2:]]
            tops.append(z.max(axis=0))
            out.append(_softmax(np.maximum(np.concatenate(tops, axis=1) + bias, 0) @ self.p["out"] + self.p["out_bias"]))
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)), np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(df: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Network | None:
    """A network trained on a bounded sample of labelled rows: of each label ``PER_LABEL`` rows of least hash (of id and text)
    among every n-th hash, ``MOST_ROWS`` rows at most, and from each of them ``CUTS`` cuts anywhere in the text. None without any."""
    chars = 2 * WINDOW
    order = F.xxhash64(F.col("id").cast("string"), "text")
    rows = df.select(exact(id_col).alias("id"), exact(label_col).alias("label"), exact(text_col).alias("text")).where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    at = lambda j: F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(j)), F.greatest(F.length("text") - chars, F.lit(1))) + 1
    cuts = [F.substring("text", at(j).cast("int"), F.lit(chars)) for j in range(CUTS)]
    rows = rows.select("label", order.alias("order"), F.array(*cuts).alias("cuts"))  # before the ranking, so that no whole text is shuffled
    # A hash keeps about THIN times the sample of each label, so that what is ranked doesn't grow with the input; the least one always stays.
    size = rows.groupBy("label").agg(F.count("*").alias("size"), F.min("order").alias("least"))
    rows = rows.join(size, "label").where((F.pmod("order", F.greatest(F.floor(F.col("size") / (THIN * PER_LABEL)), F.lit(1))) == 0) | (F.col("order") == F.col("least")))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("order", "cuts"))).where(F.col("r") <= PER_LABEL)
    cuts = rows.orderBy("r", "label").limit(MOST_ROWS).select("label", "r", F.posexplode("cuts").alias("j", "cut"))
    taken = sorted((r.label, r.r, r.j, r.cut) for r in cuts.collect())
    if not taken:
        return None
    labels = sorted({t[0] for t in taken})
    x, doc, _ = windows(Block(pa.array([t[3] for t in taken])))
    network = Network(labels)
    network.train(x, np.array([labels.index(t[0]) for t in taken])[doc])
    return network


def identify(df: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The language of every whole text: the mean of the network's probabilities over all its windows, by their length.

    ``und`` with score 0 for a null text, one without a letter, or if nothing was
    learned; ties go to the first label in the alphabet. One row per input row,
    any id; no rows give no rows. Returns doc_id, lang_pred, score, and the
    columns of ``keep`` before them.
    """
    small_batches(df.sparkSession)
    labels = network.labels if network else []
    added = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])
    columns = [exact(c).alias(f"kept{i}") for i, c in enumerate([id_col, *(keep or [])])]
    names = [f"kept{i}" for i in range(len(columns))]
    rows = df.select(*columns, exact(text_col).alias("text"), F.coalesce(exact(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered"))

    def run(batches):
        for table in blocks(batches):
            block = Block(table["text"])
            lettered = np.asarray(table["lettered"])
            predicted, score = np.full(block.n, UNDETERMINED, dtype=object), np.zeros(block.n)
            if network:
                x, doc, length = windows(block)
                weighted = network.probabilities(x) * length[:, None]
                mean = np.column_stack([np.bincount(doc, weights=weighted[:, i], minlength=block.n) for i in range(len(labels))])
                mean /= np.maximum(np.diff(block.off), 1)[:, None]
                predicted[lettered] = np.array(labels, dtype=object)[mean.argmax(axis=1)][lettered]
                score[lettered] = np.clip(mean.max(axis=1), 0, 1)[lettered]
            kept = [table[c].combine_chunks() for c in names]
            new = to_arrow(added, {"lang_pred": predicted.tolist(), "score": score})
            yield pa.RecordBatch.from_arrays([*kept, *new.columns], names=[*names, "lang_pred", "score"])

    out = rows.mapInArrow(run, StructType([*(rows.schema[c] for c in names), StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
    return out.select(F.col("kept0").alias("doc_id"), *[F.col(f"kept{i + 1}").alias(c) for i, c in enumerate(keep or [])], "lang_pred", "score")
