"""Language identification, words first, with backoff to shorter and shorter character n-grams.

A word that the training texts hold is scored by its log frequency in each language. One they lack is scored by the
longest of its n-grams (4 to 1 letters, with a mark at each end) that they do hold. A text's language is the one with
the best mean score over its words.

The model is two tables of all words and all n-grams that were counted, none left out. What is scored once, by joins, is
each distinct piece of text between white space; texts then add up their pieces' costs (see `rare`).
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm import rare
from chunkloom.llm._common import batches, held_out, let_go, plain, release, settle

LONGEST = 4
#: Cost, in powers of ten, of a word or n-gram that a language lacks but another has; no cost is higher.
ABSENT = 7.0
#: Rows of whole texts that a worker takes at a time.
WIDE = 2_000
#: A word: a run of letters and the marks on them.
WORD = r"\p{L}[\p{L}\p{M}]*"


def grams_of(word: str, n: int) -> list[str]:
    """The word's n-grams, with a space before and after it; single letters without."""
    marked = f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


def _split(text: str) -> list[str]:
    return text.lower().split()


def count_pieces(docs: DataFrame) -> DataFrame:
    """lang, piece, c: how often each piece of text (column text, lower-cased) occurs under each language (null: none)."""

    def count(parts):
        import pyarrow as pa

        let_go()
        kept: defaultdict[str | None, Counter] = defaultdict(Counter)

        def out():
            for lang, pieces in kept.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(pieces), pa.string()), pa.array(pieces.keys(), pa.string()), pa.array(pieces.values(), pa.int64())], ["lang", "piece", "c"])
            kept.clear()

        for part in parts:
            for begin, texts in batches(part.column("text")):
                for lang, text in zip(part.column("lang").slice(begin, len(texts)).to_pylist(), texts, strict=True):
                    kept[lang].update(_split(text))
                if sum(map(len, kept.values())) > 500_000:
                    yield from out()
        yield from out()

    return docs.select("lang", "text").mapInArrow(count, "lang string, piece string, c long").groupBy("lang", "piece").agg(F.sum("c").alias("c"))


def count_grams(words: DataFrame) -> DataFrame:
    """lang, n, gram, c from distinct words with their counts."""

    def count(parts):
        import pyarrow as pa

        kept: defaultdict[tuple[str, int], Counter] = defaultdict(Counter)

        def out():
            for (lang, n), grams in kept.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array([n] * len(grams), pa.int32()), pa.array(grams.keys(), pa.string()), pa.array(grams.values(), pa.int64())], ["lang", "n", "gram", "c"])
            kept.clear()

        for part in parts:
            for lang, word, c in zip(*(part.column(k).to_pylist() for k in ("lang", "word", "c")), strict=True):
                for n in range(1, LONGEST + 1):
                    grams = kept[lang, n]
                    for g in grams_of(word, n):
                        grams[g] += c
            if sum(map(len, kept.values())) > 500_000:
                yield from out()
        yield from out()

    return words.select("lang", "word", "c").mapInArrow(count, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))


def _costs(c: Column, lang: Column, totals: dict[str, int | Column], languages: list[str]) -> Column:
    """An aggregate: by language, the cost of what a group of rows counts."""
    each = [F.sum(F.when(lang == x, c)) for x in languages]
    return F.array(*[F.least(F.lit(ABSENT), F.coalesce(-F.log10(n / totals.get(x, 1)), F.lit(ABSENT))) for x, n in zip(languages, each, strict=True)])


@dataclass
class Model:
    """Languages; costs by language of all words (word, x) and n-grams (n, gram, x) that teach; and, for the texts in
    docs, the costs of pieces (h, x), frequent ones (piece to x) apart. These lie in settled tables until `forget`."""

    languages: list[str]
    words: DataFrame | None = None
    grams: DataFrame | None = None
    docs: DataFrame | None = None
    pieces: DataFrame | None = None
    frequent: dict[str, list[float]] | None = None
    tables: list[DataFrame] = field(default_factory=list)


def forget(model: Model) -> None:
    """Delete the model's tables, which nothing will read again: what `keep_known` returns does not."""
    if model.tables:
        release(model.tables[0].sparkSession, *model.tables)


def word_costs(words: DataFrame, model: Model, used: list[DataFrame]) -> DataFrame:
    """word, x for distinct words: by the word itself, or else the mean over its longest n-grams that are known, or else ABSENT.

    The settled tables that the result reads are put into used.
    """
    wide = len(model.languages)
    rest = settle(words.join(model.words.select("word"), "word", "left_anti"), "unknown")
    used.append(rest)
    out = words.join(model.words, "word")

    def backed_off(rest, lengths):
        """word, n, x: the mean over the n-grams that are known, or else nulls."""

        def spell(parts):
            import pyarrow as pa

            for part in parts:
                for n in lengths:
                    # a word without an n-gram is spelled by itself, which is none that is known
                    grams = [grams_of(w, n) or [w] for w in part.column("word").to_pylist()]
                    at = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
                    yield pa.RecordBatch.from_arrays([part.column("word").take(pa.array(at)), pa.array(np.full(len(at), n, np.int32)), pa.array([g for x in grams for g in x], pa.string())], ["word", "n", "gram"])

        met = rest.mapInArrow(spell, "word string, n int, gram string").join(model.grams.where(F.col("n").isin(lengths)), ["n", "gram"], "left")
        return met.groupBy("word", "n").agg(F.array(*[F.avg(F.col("x")[k]) for k in range(wide)]).alias("x"))

    # nearly all words have a known n-gram of the longest; the few others try all shorter ones at once, with fewer tables
    if not rest.isEmpty():
        longest = settle(backed_off(rest, [LONGEST]), "backed-off")
        used.append(longest)
        out = out.unionByName(longest.where(F.col("x")[0].isNotNull()).select("word", "x"))
        rest = longest.where(F.col("x")[0].isNull()).select("word")
    if not rest.isEmpty():
        shorter = backed_off(rest, list(range(1, LONGEST))).groupBy("word").agg(F.max_by("x", F.when(F.col("x")[0].isNotNull(), F.col("n"))).alias("x"))
        out = out.unionByName(shorter.select("word", F.coalesce("x", F.array(*[F.lit(ABSENT)] * wide)).alias("x")))
    return out


def piece_costs(pieces: DataFrame, model: Model, used: list[DataFrame]) -> DataFrame:
    """piece, x for distinct pieces that tell languages apart: their words' costs by language, added up, less the least.

    The settled tables that the result reads are put into used. Pieces whose costs are the same in all languages change no verdict and no posterior, and are left out.
    """
    parts = pieces.select("piece", F.explode(F.regexp_extract_all("piece", F.lit(WORD), F.lit(0))).alias("word"))
    costs = word_costs(parts.select("word").distinct(), model, used)
    wide = len(model.languages)
    added = parts.join(costs, "word").groupBy("piece").agg(F.array(*[F.sum(F.col("x")[k]) for k in range(wide)]).alias("x"))
    return added.where(F.array_max("x") > F.array_min("x")).select("piece", F.transform("x", lambda v: (v - F.array_min("x")).cast("float")).alias("x"))


def train(docs: DataFrame, teaches: Column | None = None, lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model of the languages of the rows that teach (all by default) and have one; it has the pieces of all rows' texts.

    All counts stay in tables. The driver learns the languages, the totals, and the pieces that are frequent in docs.
    """
    spark = docs.sparkSession
    lang = F.col(f"`{lang_col}`").cast("string")
    slim = docs.select((lang if teaches is None else F.when(teaches, lang)).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = settle(count_pieces(slim), "pieces", WIDE)
    words = counts.where("lang is not null").select("lang", F.explode(F.regexp_extract_all("piece", F.lit(WORD), F.lit(0))).alias("word"), "c")
    words = settle(words.groupBy("lang", "word").agg(F.sum("c").alias("c")), "words")
    grams = settle(count_grams(words), "grams")
    of_words = {r["lang"]: r["c"] for r in words.groupBy("lang").agg(F.sum("c").alias("c")).collect()}
    languages = sorted(of_words)
    if not languages:
        release(spark, counts, words, grams)
        return Model([])
    of_grams = {(r["lang"], r["n"]): r["c"] for r in grams.groupBy("lang", "n").agg(F.sum("c").alias("c")).collect()}
    model = Model(languages, docs=docs)
    model.words = settle(words.groupBy("word").agg(_costs(F.col("c"), F.col("lang"), of_words, languages).alias("x")), "word-costs")
    totals = {x: F.array(*[F.lit(of_grams.get((x, n), 1)) for n in range(1, LONGEST + 1)])[F.col("n") - 1] for x in languages}
    model.grams = settle(grams.groupBy("n", "gram").agg(_costs(F.col("c"), F.col("lang"), totals, languages).alias("x")), "gram-costs")
    release(spark, words, grams)
    model.tables = [model.words, model.grams]
    return _covering(model, docs, counts)


def _covering(model: Model, docs: DataFrame, counts: DataFrame) -> Model:
    """The model with costs for all pieces in counts, which are of docs."""
    total = counts.agg(F.sum("c")).first()[0] or 0
    each = counts.groupBy("piece").agg(F.sum("c").alias("c"))
    used = [settle(each.where(F.col("c") >= total * rare.SHARE).select("piece"), "often")]
    often = {r["piece"] for r in used[0].collect()}
    spark = docs.sparkSession
    mine = F.broadcast(spark.createDataFrame([(p,) for p in often], "piece string").withColumn("often", F.lit(True)))
    costs = piece_costs(each.select("piece"), model, used).join(mine, "piece", "left")
    costs = settle(costs.select(F.when(F.col("often"), F.col("piece")).alias("piece"), rare.hashed("piece").alias("h"), "x"), "piece-costs")
    picked = costs.where("piece is not null").select("piece", "x").collect()
    frequent = dict.fromkeys(often, [0.0] * len(model.languages)) | {r["piece"]: list(r["x"]) for r in picked}
    release(spark, counts, *used)
    return Model(model.languages, model.words, model.grams, docs, costs.where("piece is null").select("h", "x"), frequent, [*model.tables, costs])


class _Frequent:
    """What travels with the scan: the frequent pieces and their costs."""

    def __init__(self, frequent: dict[str, list[float]], wide: int):
        self.order, self.wide = sorted(frequent), wide
        self.costs = np.array([[0.0] * wide, *(frequent[p] for p in self.order)])


def _totals(docs: DataFrame, model: Model, keep: list[tuple[str, Column]], text: Column, used: list[DataFrame]) -> DataFrame:
    """The columns of keep, md5 of the text, whether it has a word, and x: its pieces' costs by language, added up.

    The settled tables that the result reads, and no model's, are put into used.
    """
    told_before = model
    if model.docs is not docs:
        model = _covering(model, docs, settle(count_pieces(docs.select(F.lit(None).cast("string").alias("lang"), text.alias("text"))), "pieces", WIDE))
    wide = len(model.languages)
    told = docs.sparkSession.sparkContext.broadcast(_Frequent(model.frequent, wide))
    kept = [(f"k{i}", c) for i, (_, c) in enumerate(keep)]
    slim = docs.select(*[c.alias(n) for n, c in kept], F.coalesce(text, F.lit("")).alias("text"))
    mine = [n for n, _ in kept]
    fields = [f.name + " " + f.dataType.simpleString() for f in slim.schema.fields[:-1]]

    def scan(parts):
        import pyarrow as pa

        let_go()
        s = told.value
        blocks = rare.Blocks(s.order)
        names = [*mine, "md5", "some", "uid", "x", "h", "block", "texts"]
        word = regex.compile(r"\p{L}")

        def out():
            h, block, texts = blocks.rows()
            for i in range(0, len(h), 50_000):
                cut = [a.slice(i, 50_000) for a in (h, block, texts)]
                n = len(cut[0])
                blank = [pa.nulls(n, t) for t in (*types, pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*blank, *cut], names)

        types = []
        for part in parts:
            types = [part.column(n).type for n in mine]
            for begin, texts in batches(part.column("text")):
                look, ids, sizes = blocks.numbers.__getitem__, [], []
                for t in texts:
                    found = list(map(look, _split(t)))
                    ids += found
                    ids.append(0)
                    sizes.append(len(found) + 1)
                at, sizes = np.array(ids, dtype=np.int64), np.array(sizes)
                uid = blocks.add(at, sizes, sum(map(len, texts)))
                x = np.add.reduceat(s.costs[np.where(at < blocks.numbers.first, at, 0)], np.cumsum(sizes) - sizes, axis=0)
                n = len(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, s.wide * n + 1, s.wide, dtype=np.int32)), pa.array(x.ravel()))
                md5 = pa.array([hashlib.md5(t.encode(), usedforsecurity=False).hexdigest() for t in texts], pa.string())
                some = pa.array([word.search(t) is not None for t in texts], pa.bool_())
                blank = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c).slice(begin, n) for c in mine), md5, some, pa.array(uid), lists, *blank], names)
                if blocks.full:
                    yield from out()
        if blocks.texts:
            yield from out()

    schema = ", ".join([*fields, "md5 string, some boolean, uid long, x array<double>", rare.SCHEMA])
    laid = settle(slim.mapInArrow(scan, schema), "costed", WIDE)
    used.append(laid)
    more = rare.sums(laid.where("h is not null").select("h", "block", "texts"), model.pieces, wide, used)
    release(docs.sparkSession, *[t for t in model.tables if t not in told_before.tables])
    summed = laid.where("uid is not null").drop("h", "block", "texts").join(more, "uid", "left")
    x = F.when(F.col("sums").isNull(), F.col("x")).otherwise(F.zip_with("x", "sums", lambda a, b: a + b))
    return summed.select(*[F.col(c).alias(n) for (c, _), (n, _) in zip(kept, keep, strict=True)], F.col("md5"), F.col("some"), x.alias("x"))


def _judged(languages: list[str]) -> tuple[Column, Column]:
    """The language of the least cost and its posterior probability, taking languages as equally likely and words as independent."""
    least = F.array_min("x")
    share = F.aggregate("x", F.lit(0.0), lambda a, c: a + F.exp(-F.least(F.lit(700.0), (c - least) * math.log(10))))
    best = F.element_at(F.array(*map(F.lit, languages)), F.array_position("x", least).cast("int"))
    return F.when(F.col("some"), best).otherwise("und"), F.when(F.col("some"), 1 / share).otherwise(0.0)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep (of any names but lang_pred and score; all by default), with lang_pred and score.

    A null text, or one without a letter, is `und` with score 0, as is every text for a model without a language. Ties go
    to the language first by name. Repeated rows are answered alike; an empty table gives an empty one.
    """
    keep = docs.columns if keep is None else keep
    if not model.languages:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    told = _totals(docs, model, [(f"_k{i}", F.col(f"`{c}`")) for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string"), [])
    lang, score = _judged(model.languages)
    return told.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], lang.alias("lang_pred"), score.alias("score"))


def keep_known(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """Rows whose text is in one of the model's languages, with at least this posterior probability; all columns as they are.

    Null and empty texts go. Repeated rows stay or go together, since the verdict is on the text: texts that go are told
    by their digest, and rows are not shuffled unless those texts are very many. An empty table stays empty. Columns may
    have any names.
    """
    if not model.languages:
        return docs.where(F.lit(False))
    lang, score = _judged(model.languages)
    used: list[DataFrame] = []
    gone = _totals(docs, model, [], F.col(f"`{text_col}`").cast("string"), used).where((lang == "und") | (score < least)).select(F.col("md5").alias("_md5")).distinct()
    gone = settle(gone, "rejected")
    release(docs.sparkSession, *used)
    laid, name = plain(docs)
    text = F.coalesce(F.col(name(text_col)).cast("string"), F.lit(""))
    return laid.join(gone, F.md5(text) == F.col("_md5"), "left_anti").toDF(*docs.columns)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; the model learns from rows that are not held out.

    Rows without a language teach nothing. Without any that do, every text is `und`. A prediction reads only the text.
    Null and empty texts are `und`; repeated rows are answered alike; an empty table gives an empty one.
    """
    out = held_out(id_col, 4)
    slim = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return predict(slim, train(slim, ~F.col("held_out")), keep=["doc_id", "held_out"])
