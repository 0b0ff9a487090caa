"""Quality rules by weak supervision: rules vote good, bad or abstain, and a latent-class model weighs the votes.

Votes are gathered as counts of vote patterns over the whole corpus, of which there can be at most 3 ** len(RULES), so
expectation-maximisation on the driver works on a table of fixed size. It estimates the share of good documents and how
each rule votes on good and on bad ones. A document's posterior probability of being good, rather than a clean sheet under
every rule, then decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm._common import batches, settle

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Votes -1 (bad) where value is outside `fair`, 1 (good) where it is in `good`, else it abstains.

    slip is how often it is expected beforehand to object to a good document.
    """

    name: str
    value: Column
    fair: tuple[float, float]
    good: tuple[float, float]
    slip: float

    def vote(self) -> Column:
        v = F.coalesce(self.value, F.lit(float("nan")))
        return F.when(F.isnan(v), 0).when(~v.between(*self.fair), -1).when(v.between(*self.good), 1).otherwise(0).cast("int")


def rules() -> list[Rule]:
    """The rules; all are ratios, so that they read alike in any language and at any length, and all can vote both ways."""
    words, lines, letters = F.col("n_words"), F.col("n_lines"), F.col("n_letters")
    share = lambda a, b: F.when(b > 0, F.col(a) / b)
    many = float("inf")
    return [
        Rule("word_length", share("word_chars", words), (2.2, 14.0), (3.5, 7.0), 0.01),
        Rule("variety", F.when(words >= 50, F.col("n_distinct") / F.sqrt(words)), (2.5, many), (5.0, many), 0.02),
        Rule("symbols", share("n_symbols", words), (0.0, 0.1), (0.0, 0.01), 0.005),
        Rule("shouting", share("n_exclaim", words), (0.0, 0.25), (0.0, 0.02), 0.005),
        Rule("capitals", share("n_upper", letters), (0.0, 0.5), (0.0, 0.15), 0.005),
        Rule("repeated_words", share("n_repeat_words", words), (0.0, 0.3), (0.0, 0.05), 0.02),
        Rule("repeated_lines", F.when(lines >= 3, F.col("n_dup_lines") / lines), (0.0, 0.3), (0.0, 0.05), 0.05),
        Rule("letters", share("n_letters", F.col("word_chars")), (0.7, 1.0), (0.9, 1.0), 0.02),
    ]


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_distinct", "n_exclaim")


def _measure(text: str) -> tuple[int, ...]:
    import numpy as np

    words = text.encode().split()
    n = len(words)
    known: dict[bytes, int] = {}
    ids = [known.setdefault(w, len(known)) for w in words]
    repeated = 0
    if n >= 4:
        a = np.array(ids, dtype=np.int64)
        m = len(known)
        pair = np.unique(a[:-1] * m + a[1:], return_inverse=True)[1]  # keeps the triple's number below 2 ** 63
        triple = pair[:-1].astype(np.int64) * m + a[2:]
        _, back, times = np.unique(triple, return_inverse=True, return_counts=True)
        twice = times[back] > 1
        covered = np.zeros(n, dtype=bool)
        covered[:-2] |= twice
        covered[1:-1] |= twice
        covered[2:] |= twice
        repeated = int(covered.sum())
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    joined = "".join(text.split())
    letters, upper = (sum(map(len, p.findall(joined))) for p in _patterns())
    return n, len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), letters, upper, len(known), text.count("!")


@cache
def _patterns():
    import regex

    return regex.compile(r"\p{L}+"), regex.compile(r"\p{Lu}+")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts in FEATURES for every whole text; null counts as empty, and an empty text has zeros."""

    def measure(parts):
        import numpy as np
        import pyarrow as pa

        for part in parts:
            rows = [_measure(t) for _, texts in batches(part.column("text")) for t in texts]
            table = np.array(rows, dtype=np.int64).reshape(len(rows), len(FEATURES))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(table[:, i]) for i in range(len(FEATURES)))], ["doc_id", *FEATURES])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(measure, "doc_id long, " + ", ".join(f"{c} long" for c in FEATURES))


#: What is expected beforehand counts as so many documents of each class, so that it gives way as the corpus grows: a bad
#: document breaks a quarter of the rules and passes most, a good one passes with an abstention now and then.
PRIOR_DOCUMENTS, BAD_VOTES, GOOD_ABSTAINS = 50.0, {-1: 0.25, 0: 0.1, 1: 0.65}, 0.1
#: The same for the share of good documents: good and bad ones seen beforehand.
PRIOR_BALANCE = (4.0, 1.0)


@dataclass(frozen=True)
class Latent:
    """The share of good documents, and for each rule P(vote | good) and P(vote | bad)."""

    balance: float
    good: tuple[dict[int, float], ...]
    bad: tuple[dict[int, float], ...]

    def odds(self) -> float:
        return math.log(self.balance / (1 - self.balance))

    def weights(self) -> list[dict[int, float]]:
        """For each rule and vote, what it adds to the log odds of a good document."""
        return [{v: math.log(g[v] / b[v]) for v in (-1, 0, 1)} for g, b in zip(self.good, self.bad, strict=True)]

    def posterior(self, pattern: tuple[int, ...]) -> float:
        """P(good | votes)."""
        z = self.odds() + sum(w[v] for w, v in zip(self.weights(), pattern, strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fit(patterns: dict[tuple[int, ...], int], slips: list[float], rounds: int = 300) -> Latent:
    """EM for the share of good documents and for how each rule votes on good and on bad ones, with the priors' counts added."""
    prior = [({-1: s, 0: GOOD_ABSTAINS, 1: 1 - GOOD_ABSTAINS - s}, BAD_VOTES) for s in slips]
    now = Latent(PRIOR_BALANCE[0] / sum(PRIOR_BALANCE), tuple(g for g, _ in prior), tuple(b for _, b in prior))
    total = sum(patterns.values())
    for _ in range(rounds):
        post = {p: now.posterior(p) for p in patterns}
        sides = []
        for side in (0, 1):
            mass = {p: n * (post[p] if side == 0 else 1 - post[p]) for p, n in patterns.items()}
            all_ = sum(mass.values()) + PRIOR_DOCUMENTS
            sides.append(tuple({v: (sum(m for p, m in mass.items() if p[j] == v) + PRIOR_DOCUMENTS * prior[j][side][v]) / all_ for v in (-1, 0, 1)} for j in range(len(slips))))
        balance = (sum(n * post[p] for p, n in patterns.items()) + PRIOR_BALANCE[0]) / (total + sum(PRIOR_BALANCE))
        new = Latent(balance, *sides)
        moved = max([abs(new.balance - now.balance), *(abs(x[v] - y[v]) for a, b in ((new.good, now.good), (new.bad, now.bad)) for x, y in zip(a, b, strict=True) for v in x)])
        now = new
        if moved < 1e-9:
            break
    return now


def judge(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, one vote column a rule (vote_<name>), p_good, base_failed and kept for every document.

    Null and empty texts have no words, so they fail the base test. Repeated rows are judged alike. Other columns are
    ignored, and an empty table gives an empty one. The model is fitted to the votes on all documents of the table that
    pass the base test, since the others' verdict needs none.
    """
    judges = rules()
    votes = [f"vote_{r.name}" for r in judges]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    cast = settle(features(docs, id_col, text_col), "features").withColumns({c: r.vote() for c, r in zip(votes, judges, strict=True)})
    counted = {tuple(r[c] for c in votes): r["n"] for r in cast.where(~failed).groupBy(*votes).agg(F.count("*").alias("n")).collect()}
    model = fit(counted, [r.slip for r in judges])
    odds = F.lit(model.odds())
    for c, w in zip(votes, model.weights(), strict=True):
        odds = odds + F.when(F.col(c) == -1, w[-1]).when(F.col(c) == 1, w[1]).otherwise(w[0])
    p = 1 / (1 + F.exp(-odds))
    return cast.withColumn("p_good", p).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
