"""Quality classifier by co-training of two views.

One classifier sees only the text (shares of symbols, capitals, repeats and the
like), the other only metadata (language, source, length). In rounds, each scores
all unlabelled rows, in a distributed pass, and hands those of which it is most
sure, by probabilities calibrated on rows held out of training, to the other as
training rows. Finally both are fitted once more and calibrated, and a combination
of their log-odds, fitted on the held-out rows, scores every document. Equal texts
are on the same side of the hold-out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, byte_class, chunks, keyed, text_buffer, tidy, with_keys, without
from .shingles import mixed, word_hashes

#: Labelled rows that the classifiers are fitted on, at most.
LABELLED = 20_000
ROUNDS = 4
#: A view hands over rows that it is so sure of, and so many of a class a round at most.
SURE = 0.98
HANDED = 1_000
#: Parts in which the best rows of a pick are chosen first.
SALTS = 64
#: Documents of a lower score are rejected.
THRESHOLD = 0.5
#: Buckets of hashed languages and sources.
LANGS, SOURCES = 8, 32

LETTER = byte_class((65, 90), (97, 122), (128, 255))
UPPER = byte_class((65, 90))
LOWER_CASE = byte_class((97, 122))
DIGIT = byte_class((48, 57))
END = byte_class((33, 33), (46, 46), (63, 63))
SYMBOL = byte_class((35, 38), (42, 43), (47, 47), (60, 62), (64, 64), (91, 96), (123, 126))
TEXT_FEATURES = ("letters", "upper", "digits", "ends", "exclamations", "bars", "symbols", "lines", "word_length", "distinct", "top", "twice", "alternate", "pairs", "log_words", "starred", "capital_words", "empty")


def text_features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of TEXT_FEATURES for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    one = np.maximum(size, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return np.diff(total[offsets])

    words, counts = word_hashes(raw, offsets)
    at = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(n), counts)
    some = np.maximum(counts, 1)

    def per_word(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(of[mask], minlength=n) / some

    order = np.lexsort((words, owner))
    w, o = words[order], owner[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(w)))
    top = np.zeros(n)
    np.maximum.at(top, o[starts], runs)
    again = lambda k: per_word((words[k:] == words[:-k]) & (owner[k:] == owner[:-k]), owner[k:]) if len(words) > k else np.zeros(n)
    pair = words[:-1] * np.uint64(3) + words[1:] if len(words) > 1 else words[:0]
    inside = owner[:-1] == owner[1:] if len(words) > 1 else np.zeros(0, bool)
    p, q = pair[inside], owner[:-1][inside] if len(words) > 1 else owner[:0]
    order = np.lexsort((p, q))
    p, q = p[order], q[order]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    pairs = np.bincount(q[fresh], minlength=n) / np.maximum(np.bincount(q, minlength=n), 1)
    letters, upper = share(LETTER[raw]), share(UPPER[raw])
    symbol, space = SYMBOL[raw], raw <= 32
    last = np.append(space[1:], True) if len(raw) else space
    word_end = ~space & last
    starred = share(word_end & (symbol | (raw == 33)))
    first = np.insert(space[:-1], 0, True) if len(raw) else space
    caps = share(~space & first & UPPER[raw])
    columns = [
        letters / one, upper / np.maximum(letters, 1), share(DIGIT[raw]) / one, share(END[raw]) / some, share(raw == 33) / some, share(raw == 124) / some,
        share(symbol) / one, share(raw == 10) / some, size / some, per_word(np.ones(len(starts), bool), o[starts]), top / some, again(1), again(2), pairs,
        np.log1p(counts), starred / some, caps / some, (counts == 0).astype(float),
    ]
    return np.stack(columns, 1).astype(np.float64)


def features(docs: DataFrame, scratch: Scratch, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Per row: key, doc_id, ``side`` (a hash of the text, 0 to 4), ``a`` (text features) and ``b`` (metadata features).

    Metadata columns that the table lacks, and nulls in them, have buckets of their own.
    """
    have = {c.lower() for c in docs.columns}
    bucket = lambda c, n: F.when(F.col(c).isNull(), n).otherwise(F.pmod(F.xxhash64(c), F.lit(n))).cast("int") if c in have else F.lit(n)
    content = F.col(f"`{text}`").cast("string")
    rows = keyed(docs, scratch, {"doc_id": F.col(f"`{ident}`").cast("long"), "side": F.pmod(F.xxhash64(F.coalesce(content, F.lit(""))), F.lit(5)).cast("int"), "text": content, "lang": bucket("lang", LANGS), "source": bucket("source", SOURCES), "size": F.coalesce(F.char_length(content), F.lit(0))})

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(4))
            lang, source, size = (batch.column(k).to_numpy() for k in (5, 6, 7))
            for a, b in chunks(offsets):
                own = offsets[a : b + 1]
                views = [text_features(raw[own[0] : own[-1]], own - own[0]), meta_features(lang[a:b], source[a:b], size[a:b])]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * v.shape[1]), pa.array(v.astype(np.float32).ravel())) for v in views]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(4)), *lists], names=["_f", "_r", "doc_id", "side", "a", "b"])

    return rows.mapInArrow(work, "_f bigint, _r bigint, doc_id bigint, side int, a array<float>, b array<float>")


def meta_features(lang: np.ndarray, source: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lang), LANGS + 1 + SOURCES + 1 + 2))
    rows = np.arange(len(lang))
    out[rows, lang] = 1
    out[rows, LANGS + 1 + source] = 1
    out[:, -2] = np.log1p(size)
    out[:, -1] = out[:, -2] ** 2 / 10
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Logistic:
    """Logistic regression on standardised features, by Newton steps with an L2 penalty."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Logistic:
        mean, scale = x.mean(0), x.std(0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        ridge = np.full(z.shape[1], penalty)
        ridge[-1] = 1e-6
        w = np.zeros(z.shape[1])
        for _ in range(25):
            p = _sigmoid(z @ w)
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
            w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -20, 20) @ self.weights[:-1] + self.weights[-1]


@dataclass
class Model:
    """Both views, their calibrations, the combination, and what was handed over: round, view, label, rows."""

    views: tuple[Logistic, Logistic]
    calibrations: tuple[Logistic, Logistic]
    combination: Logistic
    handed: list[tuple[int, int, int, int]]

    def scores(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the views, and of both together."""
        odds = [c.odds(v.odds(x)[:, None]) for v, c, x in zip(self.views, self.calibrations, (a, b))]
        both = self.combination.odds(np.stack(odds, 1))
        return _sigmoid(odds[0]), _sigmoid(odds[1]), _sigmoid(both)


#: Gives the rows of which the views are sure: from the views, their calibrations and the keys that each view got before,
#: for each view and label the keys and both feature arrays of HANDED rows at most, best first.
Picker = Callable[[tuple, tuple, list], dict[tuple[int, int], tuple[list, np.ndarray, np.ndarray]]]


def sureness(view: Logistic, calibration: Logistic, x: np.ndarray, label: int) -> np.ndarray:
    """How sure a view is of a label."""
    p = _sigmoid(calibration.odds(view.odds(x)[:, None]))
    return p if label else 1 - p


def co_train(labelled: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pick: Picker, rounds: int = ROUNDS) -> Model | None:
    """A model from labelled rows (side, text view, metadata view, label) and a picker among unlabelled ones.

    Rows of side 4 are held out, for calibration only; every fifth row where that (few
    different texts) leaves a part without a class. None if either part lacks one then too.
    """
    side, a, b, y = labelled
    lacks = lambda held: min(len(np.unique(y[held])), len(np.unique(y[~held]))) < 2
    held = side == 4
    if lacks(held):
        held = np.arange(len(y)) % 5 == 4
    if lacks(held):
        return None
    train = [(a[~held], y[~held]), (b[~held], y[~held])]
    apart = (a[held], b[held])
    got: list[set] = [set(), set()]  # keys that a view got before
    handed: list[tuple[int, int, int, int]] = []
    for k in range(rounds + 1):
        views = tuple(Logistic.fit(*t) for t in train)
        calibrations = tuple(Logistic.fit(v.odds(x)[:, None], y[held]) for v, x in zip(views, apart))
        if k == rounds:
            break
        before = len(handed)
        for (view, label), (keys, *found) in pick(views, calibrations, got).items():
            other = 1 - view
            if keys:
                got[other].update(keys)
                x, t = train[other]
                train[other] = np.concatenate([x, found[other]]), np.concatenate([t, np.full(len(keys), label)])
                handed.append((k, view, label, len(keys)))
        if len(handed) == before:
            break
    odds = np.stack([c.odds(v.odds(x)[:, None]) for v, c, x in zip(views, calibrations, apart)], 1)
    return Model(views, calibrations, Logistic.fit(odds, y[held]), handed)


def _key(f: np.ndarray, r: np.ndarray) -> np.ndarray:
    return mixed(f.view(np.uint64)) + r.view(np.uint64)


def _distributed(rest: DataFrame) -> Picker:
    """Picks among all rows of a table of features, in one pass a round: the best of each batch, then of each of SALTS parts, then of all."""

    def pick(views: tuple, calibrations: tuple, got: list) -> dict[tuple[int, int], tuple[list, np.ndarray, np.ndarray]]:
        hashes = [np.sort(_key(*np.array(sorted(g), np.int64).reshape(-1, 2).T.copy())) for g in got]

        @tidy
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                f, r = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for view in (0, 1):
                    x = batch.column(4 + view).flatten().to_numpy().astype(np.float64).reshape(len(batch), -1)
                    new = np.ones(len(batch), bool)
                    for i in np.flatnonzero(np.isin(_key(f, r), hashes[1 - view])).tolist():
                        new[i] = (int(f[i]), int(r[i])) not in got[1 - view]
                    for label in (1, 0):
                        sure = sureness(views[view], calibrations[view], x, label) if len(batch) else np.zeros(0)
                        at = np.flatnonzero(new & (sure >= SURE))
                        at = at[np.lexsort((r[at], f[at], -sure[at]))[:HANDED]]
                        own = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(sure[at]), pa.array(np.full(len(at), 2 * view + label, np.int32))], names=[*batch.schema.names, "sure", "tag"])

        sure = rest.mapInArrow(work, "_f bigint, _r bigint, doc_id bigint, side int, a array<float>, b array<float>, sure double, tag int")
        for salt in ([F.pmod(F.xxhash64("_f", "_r"), F.lit(SALTS))], []):
            best = Window.partitionBy("tag", *salt).orderBy(F.desc("sure"), "_f", "_r")
            sure = sure.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= HANDED).drop("rank")
        tag, sure_, f, r, a, b = _arrays(sure, ("tag", "sure", "_f", "_r", "a", "b"))
        out = {}
        for view, label in ((0, 1), (0, 0), (1, 1), (1, 0)):
            at = np.flatnonzero(tag == 2 * view + label)
            at = at[np.lexsort((r[at], f[at], -sure_[at]))]
            out[view, label] = list(zip(f[at].tolist(), r[at].tolist())), a[at], b[at]
        return out

    return pick


def _arrays(rows: DataFrame, names: tuple[str, ...]) -> list[np.ndarray]:
    table = rows.select(*names).toArrow()
    out = []
    for name in names:
        column = table.column(name).combine_chunks()
        if pa.types.is_list(column.type):
            out.append(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1)))
        else:
            out.append(column.to_numpy(zero_copy_only=False))
    return out


def fit(seen: DataFrame, labels: DataFrame, ident: str = "doc_id", label: str = "quality", labelled: int = LABELLED) -> Model | None:
    """The model from a table of features and labels."""
    known = labels.select(F.col(f"`{ident}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).where("y is not null and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = _arrays(seen.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "_f", "_r").limit(labelled), ("side", "a", "b", "y"))
    return co_train((*sample[:3], (sample[3] > 0).astype(float)), _distributed(seen.join(known, "doc_id", "left_anti").select(*seen.columns)))


def score(docs: DataFrame, labels: DataFrame, scratch: Scratch, text: str = "text", ident: str = "doc_id", label: str = "quality", labelled: int = LABELLED) -> DataFrame:
    """Per row: ``_f``, ``_r``, ``doc_id``, ``text_score``, ``meta_score``, ``score`` and ``kept``.

    Fitted on at most ``labelled`` labelled rows, chosen by a hash of their ids,
    and on unlabelled ones picked among all, HANDED for a class, view and round
    at most; every document is scored. Labels are 0 or 1; of several labels of an
    id the greatest counts, null ones don't. With no rows of one class to learn
    from, all scores are 1 and all documents are kept. Null and empty texts are
    scored like others. Rows are scored apart, so repeats change nothing; an empty
    table gives an empty result.
    """
    seen = scratch.write(features(docs, scratch, text, ident), "features")
    model = fit(seen, labels, ident, label, labelled)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = [batch.column(k).flatten().to_numpy().astype(np.float64).reshape(len(batch), -1) for k in (4, 5)]
            found = held.value.scores(*views) if held.value else [np.ones(len(batch))] * 3
            columns = [pa.array(x, pa.float64()) for x in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *columns, pa.array(found[2] >= THRESHOLD)], names=["_f", "_r", "doc_id", "text_score", "meta_score", "score", "kept"])

    return seen.mapInArrow(work, "_f bigint, _r bigint, doc_id bigint, text_score double, meta_score double, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, scratch: Scratch, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    rejected = scratch.write(score(docs, labels, scratch, text, ident).where("not kept").select("_f", "_r"), "rejected")
    return without(with_keys(docs, scratch), rejected).select("row.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    found = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark, "quality"))
    return found.select("doc_id", "text_score", "meta_score", "score", "kept")
