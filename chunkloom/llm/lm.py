"""Language-model scoring with a log-bilinear model over classes of words, trained by noise-contrastive estimation.

Every word has a class. The end of a text and the most frequent words are classes of their own; all others are classed by
their last letters, the commonest endings each having a class and the rest being spread over a few. The model predicts
a word's class from the classes of the two words before it: score(c | g, h) = (C1 r_g + C2 r_h) . q_c + b_c, with class
vectors r and q, a matrix C for each position and biases b. Within its class a word has its smoothed share of the
training tokens, so P(word | context) = P(class | context) * P(word | class), and both are normalised exactly: a batch of
matrix products gives the log-probabilities of all classes after all pairs of classes.

All tokens of all training texts train the model, as contexts and as targets. Each task runs noise-contrastive
estimation in numpy over its own texts, with noise words drawn from the classes' shares, and the tasks' parameters are
averaged by their numbers of tokens; further rounds, if there are any, start from the average. Counts of all distinct words are a table
that grows with the corpus; texts meet the counts of words that are not frequent in a join (see `rare`).
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm import rare
from chunkloom.llm._common import batches, held_by_worker, held_out, release, settle

#: Classes besides the end: words of their own, endings of their own (bytes in an ending), and classes for other endings.
SINGLES, ENDINGS, LETTERS, SPREAD = 255, 240, 3, 16
#: Size of vectors, noise words a batch, tokens a batch, rounds over the corpus, and step size.
DIMENSIONS, NOISE, BATCH, ROUNDS, RATE = 24, 32, 2048, 1, 0.1
LN10 = float(np.log(10))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split()


def log_softmax(score: np.ndarray) -> np.ndarray:
    score = score - score.max(axis=-1, keepdims=True)
    return score - np.log(np.exp(score).sum(axis=-1, keepdims=True))


def summed_by(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """For each number below n, the sum of the rows whose number it is."""
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    out = np.zeros((n, rows.shape[1]), dtype=rows.dtype)
    out[ordered[begins]] = np.add.reduceat(rows[order], begins, axis=0)
    return out


class LogBilinear:
    """The model's parameters, r, q (classes by dimensions), c (two matrices), b; and how they are trained."""

    def __init__(self, shares: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 7):
        """shares: of each class among the training tokens, which are the noise distribution too."""
        rng = np.random.default_rng(seed)
        k = len(shares)
        self.shares = (shares + 1e-9) / (shares + 1e-9).sum()
        draw = lambda *n: rng.normal(0, 0.1, n).astype(np.float32)
        self.p = {"r": draw(k, dimensions), "q": draw(k, dimensions), "c": np.stack([np.eye(dimensions), np.eye(dimensions) / 2]).astype(np.float32), "b": np.log(self.shares).astype(np.float32)}

    def train(self, classes: np.ndarray, seed: int, state: dict | None = None) -> dict:
        """One pass over a run of class numbers (0 ends a text), in batches; the squared slopes so far, for the next run."""
        p, k = self.p, len(self.shares)
        rng = np.random.default_rng(seed)
        state = state or {n: np.full_like(x, 1e-6) for n, x in p.items()}
        first, second = before(classes)
        against = np.log(NOISE * self.shares).astype(np.float32)
        edges = np.cumsum(self.shares)
        for begin in range(0, len(classes), BATCH):
            w, g, h = (x[begin : begin + BATCH] for x in (classes, first, second))
            noise = np.minimum(np.searchsorted(edges, rng.random(NOISE)), k - 1)
            r1, r2 = p["r"] @ p["c"][0], p["r"] @ p["c"][1]
            x = r1[g] + r2[h]
            q, qn = p["q"][w], p["q"][noise]
            true = np.einsum("ij,ij->i", x, q) + p["b"][w] - against[w]
            false = x @ qn.T + (p["b"][noise] - against[noise])
            up = (1 / (1 + np.exp(np.minimum(true, 50)))).astype(np.float32)  # slopes of log P(from the corpus) and of log P(noise)
            down = (-1 / (1 + np.exp(np.minimum(-false, 50)))).astype(np.float32)
            dx = up[:, None] * q + down @ qn
            slope = {"q": summed_by(w, up[:, None] * x, k), "b": np.bincount(w, weights=up, minlength=k).astype(np.float32)}
            np.add.at(slope["q"], noise, down.T @ x)
            np.add.at(slope["b"], noise, down.sum(axis=0))
            d1, d2 = summed_by(g, dx, k), summed_by(h, dx, k)
            slope["r"] = d1 @ p["c"][0].T + d2 @ p["c"][1].T
            slope["c"] = np.stack([p["r"].T @ d1, p["r"].T @ d2])
            for n, s in slope.items():  # Adagrad
                s /= len(w)
                state[n] += s * s
                p[n] = p[n] + RATE * s / np.sqrt(state[n])
        return state

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in ("r", "q", "c", "b")]).astype(np.float64)

    def take(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for n in ("r", "q", "c", "b"):
            size = self.p[n].size
            self.p[n] = flat[at : at + size].reshape(self.p[n].shape).astype(np.float32)
            at += size
        return self

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """a[h, c] + e[g, c] - z[h, g] is the log-probability of class c after h (next to it) and g (before that); z by batches."""
        p = self.p
        a = p["r"] @ p["c"][0] @ p["q"].T + p["b"]
        e = p["r"] @ p["c"][1] @ p["q"].T
        z = np.empty((len(a), len(a)), dtype=np.float32)
        for h in range(len(a)):
            score = a[h] + e
            top = score.max(axis=1)
            z[h] = top + np.log(np.exp(score - top[:, None]).sum(axis=1))
        return a, e, z

    def log_probabilities(self, h: int, g: int) -> np.ndarray:
        """Natural logs for all classes after h, and g before that; as probabilities they sum to one."""
        p = self.p
        return log_softmax((p["r"][h] @ p["c"][0] + p["r"][g] @ p["c"][1]).astype(np.float64) @ p["q"].T + p["b"])


def before(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class before each token and the one before that, within its text; the end's where there is none."""
    first = np.concatenate([[0], classes[:-1]])
    second = np.concatenate([[0], first[:-1]])
    return first, np.where(first == 0, 0, second)


@dataclass
class Model:
    """All that scoring needs but the table of rarer words' counts: counts (h, c)."""

    singles: list[str]
    endings: list[bytes]
    frequent: dict[str, int]
    tokens: int
    distinct: int
    ends: int
    masses: np.ndarray = field(default_factory=lambda: np.zeros(0))
    kinds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bilinear: LogBilinear | None = None
    counts: DataFrame | None = None

    @property
    def classes(self) -> int:
        return 1 + SINGLES + ENDINGS + SPREAD

    def ending_class(self, ending: bytes) -> int:
        at = self._endings.get(ending)
        return 1 + SINGLES + at if at is not None else 1 + SINGLES + ENDINGS + zlib.crc32(ending) % SPREAD

    def class_of(self, word: bytes) -> int:
        """The class of a word that is not a class of its own."""
        return self.ending_class(word[-LETTERS:])

    def within(self, of_class: int, c: float) -> float:
        """P(a word with so many training tokens | its class, which has more words than one)."""
        return (c + 1) / (self.masses[of_class] + self.kinds[of_class] + 1)

    @property
    def _endings(self) -> dict[bytes, int]:
        found = self.__dict__.get("_known")
        if found is None:
            found = self.__dict__["_known"] = {e: i for i, e in enumerate(self.endings)}
        return found


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, c over all texts (null: empty), with each text's end counted under the empty word."""

    def count(parts):
        import pyarrow as pa

        kept: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.binary()).cast(pa.string()), pa.array(kept.values(), pa.int64())], ["word", "c"])
            kept.clear()

        for part in parts:
            for _, texts in batches(part.column("text")):
                for t in texts:
                    kept.update(words_of(t))
                kept[b""] += len(texts)
                if len(kept) > 500_000:
                    yield from out()
        yield from out()

    slim = docs.select(F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class _Names:
    """What a task needs to number words and to class them: the frequent words, and the model without its tables."""

    def __init__(self, model: Model):
        self.name, self.model = uuid.uuid4().hex, model

    def ready(self) -> _Names:
        m = self.model
        self.order = [w.encode() for w in sorted(m.frequent)]
        own = {w.encode(): i + 1 for i, w in enumerate(m.singles)}
        self.classes = [0, *(own.get(w) or m.class_of(w) for w in self.order)]
        return self


class _Scorer(_Names):
    """Also the costs of frequent words, and the model's parts."""

    def ready(self) -> _Scorer:
        super().ready()
        m = self.model
        every = m.tokens + m.distinct + 1
        c = np.array([m.ends, *(m.frequent[w.decode()] for w in self.order)], dtype=np.float64)
        self.base = np.log10((c + 1) / every)
        at = np.array(self.classes)
        self.inside = np.log10((m.masses + m.kinds + 1).astype(np.float64))
        self.word = np.where(at <= SINGLES, 0.0, np.log10(c + 1) - self.inside[at])
        self.unit = float(np.log10(every))
        self.a, self.e, self.z = m.bilinear.parts()
        return self

    def class_scores(self, classes: np.ndarray) -> np.ndarray:
        """log10 P(class | the two before) of a run of tokens."""
        h, g = before(classes)
        return (self.a[h, classes] + self.e[g, classes] - self.z[h, g]).astype(np.float64) / LN10


def _ready(told):
    return held_by_worker(told.value.name, lambda: told.value.ready())


def _classed(blocks: rare.Blocks, classes: list[int], model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers, classes and sizes of a batch of texts, each with its end; classes grows by the words met first."""
    look, ids, sizes = blocks.numbers.__getitem__, [], []
    for t in texts:
        found = list(map(look, words_of(t)))
        ids += found
        ids.append(0)
        sizes.append(len(found) + 1)
    for w in blocks.numbers.added[len(classes) - blocks.numbers.first :]:
        classes.append(model.class_of(w))
    at = np.array(ids, dtype=np.int64)
    return at, np.array(classes, dtype=np.int16)[at], np.array(sizes)


def one_round(docs: DataFrame, told, seed: int, text_col: str = "text") -> np.ndarray:
    """The mean of the parameters that the tasks arrive at, each from the model told, over its own texts."""

    def work(parts):
        import pyarrow as pa

        s = _ready(told)
        mine = LogBilinear(s.model.bilinear.shares, s.model.bilinear.p["r"].shape[1]).take(s.model.bilinear.flat())
        blocks, classes, state, tokens = rare.Blocks(s.order), list(s.classes), None, 0
        for part in parts:
            for _, texts in batches(part.column("text")):
                _, run, _ = _classed(blocks, classes, s.model, texts)
                state = mine.train(run, seed + tokens + TaskContext.get().partitionId(), state)
                tokens += len(run)
                if len(blocks.numbers.added) > rare.BLOCK_WORDS:
                    blocks.numbers.forget()
                    del classes[blocks.numbers.first :]
        if tokens:
            flat = mine.flat()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * tokens), pa.array(np.full(len(flat), tokens))], ["k", "x", "n"])

    slim = docs.select(F.col(text_col).cast("string").alias("text"))
    found = slim.mapInArrow(work, "k long, x double, n long").groupBy("k").agg((F.sum("x") / F.sum("n")).alias("x")).toPandas()
    out = told.value.model.bilinear.flat()
    out[found["k"].to_numpy()] = found["x"].to_numpy()
    return out


def train(docs: DataFrame, text_col: str = "text", singles: int = SINGLES, rounds: int = ROUNDS) -> Model:
    """Counts and a trained model from all texts of docs (null: empty). The driver gets frequent words, endings and sums only."""
    counts = settle(word_counts(docs, text_col), "words")
    row = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("word") == "", F.col("c")))).first()
    tokens, distinct, ends = (x or 0 for x in row)
    frequent = {r["word"]: r["c"] for r in counts.where((F.col("c") >= tokens * rare.SHARE) & (F.col("word") != "")).collect()}
    own = sorted(frequent, key=lambda w: (-frequent[w], w))[: min(singles, SINGLES)]
    ending = F.substring(F.encode("word", "UTF-8"), -LETTERS, LETTERS)
    spark = docs.sparkSession
    mine = F.broadcast(spark.createDataFrame([(w,) for w in [*own, ""]], "word string"))
    by_ending = settle(counts.join(mine, "word", "left_anti").groupBy(ending.alias("ending")).agg(F.sum("c").alias("c"), F.count("*").alias("n")), "endings")
    top = [bytes(r["ending"]) for r in by_ending.orderBy(F.desc("c"), "ending").limit(ENDINGS).collect()]
    model = Model(own, top, frequent, tokens, distinct, ends, counts=counts.where((F.col("c") < tokens * rare.SHARE) & (F.col("word") != "")).select(rare.hashed("word").alias("h"), "c"))
    place: Column = F.coalesce(F.col("at"), F.lit(1 + SINGLES + ENDINGS) + F.crc32("ending") % SPREAD)
    known = spark.createDataFrame([(bytearray(e), 1 + SINGLES + i) for i, e in enumerate(top)], "ending binary, at long")
    masses, kinds = np.zeros(model.classes), np.zeros(model.classes)
    for r in by_ending.join(F.broadcast(known), "ending", "left").groupBy(place.alias("k")).agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect():
        masses[r["k"]], kinds[r["k"]] = r["c"], r["n"]
    masses[0] = ends
    for i, w in enumerate(own):
        masses[i + 1] = frequent[w]
    model.masses, model.kinds = masses, kinds
    model.bilinear = LogBilinear((masses + 1) / (masses + 1).sum())
    for k in range(rounds if tokens else 0):
        told = spark.sparkContext.broadcast(_Names(_bare(model)))
        model.bilinear.take(one_round(docs, told, 1 + k, text_col))
        told.destroy()
    return model


def _bare(model: Model) -> Model:
    """The model without its table, to travel with tasks."""
    return Model(model.singles, model.endings, model.frequent, model.tokens, model.distinct, model.ends, model.masses, model.kinds, model.bilinear)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of docs; see score_documents."""
    told = docs.sparkSession.sparkContext.broadcast(_Scorer(_bare(model)))
    names = ["doc_id", "uid", "n_tokens", "n_known", "base", "lp", "h", "block", "texts"]

    def scan(parts):
        import pyarrow as pa

        s = _ready(told)
        m = s.model
        blocks, classes = rare.Blocks(s.order), list(s.classes)
        ended = int(m.tokens > 0)

        def out():
            h, block, texts = blocks.rows()
            del classes[blocks.numbers.first :]
            for i in range(0, len(h), 50_000):
                cut = [a.slice(i, 50_000) for a in (h, block, texts)]
                n = len(cut[0])
                blank = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([*blank, *cut], names)

        for part in parts:
            for begin, texts in batches(part.column("text")):
                at, run, sizes = _classed(blocks, classes, m, texts)
                uid = blocks.add(at, sizes, sum(map(len, texts)))
                seen = at < blocks.numbers.first
                word = np.where(seen, at, 0)
                starts = np.cumsum(sizes) - sizes
                add = lambda x, a=starts: np.add.reduceat(x, a)
                lp = s.class_scores(run) + np.where(seen, s.word[word], -s.inside[run])
                base = np.where(seen, s.base[word], -s.unit)
                known = np.where(at == 0, ended, seen.astype(np.int64))
                n = len(texts)
                blank = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int32()))]
                cols = [part.column("doc_id").slice(begin, n), *map(pa.array, (uid, sizes, add(known), add(base), add(lp)))]
                yield pa.RecordBatch.from_arrays([*cols, *blank], names)
                if blocks.full:
                    yield from out()
        if blocks.texts:
            yield from out()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    laid = settle(slim.mapInArrow(scan, f"doc_id long, uid long, n_tokens long, n_known long, base double, lp double, {rare.SCHEMA}"), "scored")
    release(docs.sparkSession)
    table = model.counts.select("h", F.array(F.log10(F.col("c") + 1), F.lit(1.0)).alias("x"))
    more = rare.sums(laid.where("h is not null").select("h", "block", "texts"), table, 2)
    of = lambda k: F.coalesce(F.col("sums")[k], F.lit(0.0))
    return laid.where("uid is not null").drop("h", "block", "texts").join(more, "uid", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + of(1).cast("long")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + of(0)).alias("base_score"), (F.col("lp") + of(0)).alias("score"),
    )


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", singles: int = SINGLES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    The model and counts come from rows that are not held out. Every text ends with a token of its own, so null and empty
    texts have one token. base_score and score are sums of log10 probabilities: of smoothed single words, and of the
    model. Repeated rows are scored separately. Without training rows the counts are zero and the model is as it starts;
    an empty table gives an empty one. Other columns are ignored.
    """
    out = held_out(id_col, 7)
    model = train(docs.where(~out), text_col, singles)
    told = score(docs, model, id_col, text_col)
    return told.select("doc_id", held_out("doc_id", 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
