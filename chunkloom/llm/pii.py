"""Personal data by weak supervision: labelers vote on candidate spans, a latent-class model weighs them, and a
classifier trained on its posteriors decides. SQL functions find, vote and decide; the driver only sees counts.

Four kinds of exact patterns with their checks (email, ip, card, phone) are always taken. Further candidates come from
looser patterns (addresses spelled out, numbers with other separators, plain phone numbers, IPv6, bank accounts, and
credentials such as keys and tokens) and from exact matches that failed their check. Regex, checksum, gazetteer, context
and format labelers vote for, against or abstain. Counts of vote patterns and of features, both of bounded number, are
all that training needs. Finding and masking cost as the text's length and the sort of its matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm._common import settle

#: Kinds with exact patterns, and kinds that only looser patterns find.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret")

#: Exact patterns, written so that a match neither backtracks nor recurses: possessive, and not begun inside a run.
EXACT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts that cannot match are told by these first, which need one pass and no capture.
POSSIBLE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: Looser patterns, tried between exact matches of their kind, with what their text must hold.
LOOSE = {
    "email": (r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[A-Za-z0-9-]{1,63}+){1,4}+", r"(?i)[\[(]\x20?at\x20?[\])]"),
    "ip": (r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])", r"(?i)[0-9a-f]:[0-9a-f]{1,4}:"),
    "card": (r"(?<![0-9.])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9.])", r"[0-9]{4}[./_][0-9]{4}[./_]"),
    "phone": (r"(?<![0-9+.(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", r"[0-9]{3}[)\x20.-]\x20?[0-9]{3}[\x20.-][0-9]{4}"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    "secret": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,200}+(?![A-Za-z0-9+/_-])=*+", r"[A-Za-z0-9+/_-]{20}"),
}
#: Gazetteers, fixed: top-level domains, first digits of card issuers, countries with bank account numbers of this form.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "ca", "us")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
ACCOUNTS = ("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "GR", "HU", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE", "SK", "TR")
#: Names that credentials are given, and shapes that issuers of them use; fixed.
SECRET_NAMES = r"(?i)(?:token|secret|key|passw|pwd|auth|bearer|credential|clave|contrase\u00f1a|schl\u00fcssel|kennwort|jeton|mot de passe)"
SECRET_SHAPES = r"^(?:A[KS]IA[A-Z0-9]{16}|gh[opsu]_.+|[sp]k[-_].+|xox[abps]-.+|eyJ.+|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$"
#: Context words, fixed, looked for in the last characters before a span.
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|reach|write|address)\W*$|(?:contact|kontakt|correo|courriel)",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|from|client)\b",
    "card": r"(?i)\b(?:card|credit|visa|mastercard|amex|karte|tarjeta|carte|pay)\b",
    "phone": r"(?i)\b(?:phone|tel|telefon|tel\u00e9fono|t\u00e9l\u00e9phone|call|mobile|cell|fax|whatsapp)\b",
    "iban": r"(?i)\b(?:iban|account|konto|compte|cuenta|bank|banque|banco)\b",
    "secret": r"(?:[=:]\s?[\x22\x27]?|(?i:bearer|basic)\s)$",
}
AGAINST = r"(?i)\b(?:order|invoice|version|isbn|issn|serial|part|ref|id|build|ticket|sku|section|page|commit|sha-?1|sha-?256|md5|digest|checksum|rev|revision|blob)\b[^0-9A-Za-z]{0,4}$"
BEFORE = 28


@dataclass(frozen=True)
class Model:
    """How labelers vote on spans of each kind that are personal data and on others, and the span classifier's weight for
    each feature value (0 for unseen values)."""

    votes: dict[int, Latent]
    weights: dict[tuple[str, int], float]
    bias: float

    def probability(self, span: Column) -> Column:
        odds = F.lit(self.bias)
        for (name, value), w in sorted(self.weights.items()):
            odds = odds + F.when(span[name] == value, w).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


@dataclass(frozen=True)
class Latent:
    """The share of true spans, and for each labeler P(vote | true) and P(vote | not)."""

    share: float
    true: tuple[dict[int, float], ...]
    false: tuple[dict[int, float], ...]

    def posterior(self, votes: tuple[int, ...]) -> float:
        z = math.log(self.share / (1 - self.share)) + sum(math.log(t[v] / f[v]) for t, f, v in zip(self.true, self.false, votes, strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


#: Votes (1, 0, -1) and features (small integers) of a candidate.
VOTES = ("v_regex", "v_check", "v_gazetteer", "v_context", "v_format")
FEATURES = ("kind", "loose", "f_regex", "f_check", "f_context", "f_against", "f_gazetteer", "f_format", "f_size")
#: What is expected of any labeler on true spans and on others, counted as so many spans of each; the share of true ones,
#: counted as two of each.
ON_TRUE, ON_FALSE, PRIOR_SPANS, PRIOR_SHARE = {-1: 0.05, 0: 0.35, 1: 0.6}, {-1: 0.4, 0: 0.45, 1: 0.15}, 20.0, 2.0

_SPANS = "array<struct<start:bigint,end:bigint,hit:string,before:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _octets(hit: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _remainder_97(hit: Column) -> Column:
    """An account number's check: first four characters to the end, letters as 10 to 35, modulo 97."""
    text = F.regexp_replace(hit, r"\x20", "")
    turned = F.concat(F.substring(text, 5, 100), F.substring(text, 1, 4))
    code = lambda c: F.ascii(c).cast("long")
    return F.aggregate(F.split(turned, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).when(c <= "9", (a * 10 + code(c) - 48) % 97).otherwise((a * 100 + code(c) - 55) % 97))


def valid(kind: str, hit: Column) -> Column:
    """Whether an exact match passes its kind's check."""
    n = F.length(_digits(hit))
    return {"email": F.lit(True), "ip": _octets(hit), "card": n.between(14, 19) & F.call_function("luhn_check", _digits(hit)), "phone": n.between(10, 15)}[kind]


def _votes(kind: str, loose: bool, hit: Column, before: Column) -> dict[str, Column]:
    """Labelers' votes and features for a span of this kind, from its text and the characters before it."""
    n = F.length(_digits(hit))
    cue, against = before.rlike(CUES[kind]), before.rlike(AGAINST)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0).cast("int")
    never = F.lit(False)
    regex = vote(never, never) if loose else vote(valid(kind, hit), ~valid(kind, hit))
    if kind == "email":
        top = F.lower(F.substring_index(F.regexp_replace(hit, r"[\])\x20]", ""), ".", -1))
        check, known, form = vote(never, never), vote(top.isin(*DOMAINS), ~top.rlike("^[a-z]{2,24}$")), vote(hit.rlike(r"^[A-Za-z0-9._%+-]{2,64}[^A-Za-z0-9]"), never)
    elif kind == "ip":
        check, known, form = vote(never, never if loose else ~_octets(hit)), vote(never, hit.rlike("^0+[.:]")), vote(hit.rlike(r"^[^.:]+([.:][^.:]+){3,7}$"), never)
    elif kind == "card":
        issued = F.lit(False)
        for p in ISSUERS:
            issued = issued | _digits(hit).startswith(p)
        good = n.between(14, 19) & F.call_function("luhn_check", _digits(hit))
        check, known, form = vote(good, ~good), vote(issued, ~issued), vote(hit.rlike(r"^[0-9]{14,19}$|^[0-9]{4}(.)[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}$"), never)
    elif kind == "phone":
        check, known, form = vote(never, ~n.between(10, 15)), vote(never, _digits(hit).rlike("^0{3}|^(.)\\1+$")), vote(hit.rlike(r"^\+|^\("), never)
    elif kind == "iban":
        good = _remainder_97(hit) == 1
        regex, check, known, form = vote(F.lit(False), ~good), vote(good, ~good), vote(F.substring(hit, 1, 2).isin(*ACCOUNTS), ~F.substring(hit, 1, 2).isin(*ACCOUNTS)), vote(hit.rlike(r"^[A-Z0-9]{4}(?:\x20[A-Z0-9]{4})+(?:\x20[A-Z0-9]{1,4})?$|^[A-Z0-9]+$"), hit.rlike(r"\x20"))
    else:
        regex = vote(hit.rlike(SECRET_SHAPES), hit.rlike(r"^[a-z]+(?:[-_/][a-z]+)+[-_/]?[0-9]{0,4}$"))
        check = vote(hit.rlike(r"(?:[0-9][^0-9]+){3}"), hit.rlike(r"^[^0-9]+[0-9]+$|^[0-9]+[^0-9]+$"))  # digits among letters
        known, form = vote(before.rlike(SECRET_NAMES), never), vote(hit.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$|[+/=]") & before.rlike(r"[\x22\x27=]$"), hit.rlike(r"[-_/]{2}"))
    votes = {"regex": regex, "check": check, "gazetteer": known, "context": vote(cue & ~against, against), "format": form}
    return {f"v_{k}": c for k, c in votes.items()} | {
        "loose": F.lit(int(loose)), "f_context": cue.cast("int"), "f_against": against.cast("int"), "f_size": F.least(F.ceil(F.length(hit) / 8), F.lit(5)).cast("int"),
    } | {f"f_{k}": votes[k] for k in ("regex", "check", "gazetteer", "format")}


#: Elements of a long array that are taken together: appending one by one costs the square of their number.
TOGETHER = 256


def _cut(array: Column) -> Column:
    """The array in pieces of TOGETHER elements; one empty piece if it is empty."""
    return bound(array, lambda a: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(a) - 1, F.lit(0)) / TOGETHER).cast("int")), lambda j: F.slice(a, j * TOGETHER + 1, TOGETHER)))


def _before(numbers: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each number, what add makes of all before it, from 0."""
    zero = F.lit(0).cast("long")
    return bound(numbers, lambda s: F.transform(s, lambda x, j: F.aggregate(F.slice(s, F.lit(1), j), zero, add)))


def _found(text: Column, pattern: str) -> Column:
    """start, end, hit, before of all matches: from the lengths of the matches and of the pieces between them."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    paired = F.zip_with(gaps, hits, lambda g, h: F.struct(F.char_length(g).cast("long").alias("gap"), h.alias("hit"), F.right(g, F.lit(BEFORE)).alias("before")))
    paired = F.filter(paired, lambda x: x["hit"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["before"].alias("before")))).alias("out"))

    def placed(pieces: Column) -> Column:
        long = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + F.char_length(x["hit"])))
        begin = lambda at: F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out"))
        return F.flatten(F.zip_with(pieces, _before(long, lambda a, x: a + x), lambda p, at: F.aggregate(p, begin(at), step)["out"]))

    return bound(_cut(paired), placed)


def _loose(text: Column, kind: str) -> Column:
    """Matches of the looser pattern."""
    pattern, holds = LOOSE[kind]
    return F.when(text.rlike(holds), _found(text, pattern)).otherwise(F.array().cast(_SPANS))


def _apart(spans: Column) -> Column:
    """The spans without loose ones that meet a base span, of which none holds more than one: in order, those are neighbours."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("at"), s.alias("s"))))

    def kept(o: Column) -> Column:
        row = F.zip_with(F.zip_with(o, F.slice(o, F.lit(2), F.greatest(F.size(o), F.lit(1))), lambda x, y: F.struct(x["s"].alias("s"), y["s"].alias("next"))), F.concat(F.array(F.lit(None)).cast(_as_is(o)), o), lambda x, y: F.struct(x["s"].alias("s"), x["next"].alias("next"), y["s"].alias("last")))
        meets = lambda x: (x["s"]["loose"] == 1) & (F.coalesce(x["next"]["base"] & (x["next"]["start"] < x["s"]["end"]), F.lit(False)) | F.coalesce(x["last"]["base"] & (x["last"]["end"] > x["s"]["start"]), F.lit(False)))
        return F.transform(F.filter(row, lambda x: x["s"].isNotNull() & ~meets(x)), lambda x: x["s"])

    return F.when(F.exists(spans, lambda s: s["loose"] == 1), bound(ordered, kept)).otherwise(spans)


_FIELDS = ("kind", "start", "end", "base", *VOTES, *FEATURES[1:])


def _as_is(_: Column) -> str:
    kinds = {"start": "bigint", "end": "bigint", "base": "boolean"}
    return "array<struct<at:bigint,s:struct<" + ",".join(f"{f}:{kinds.get(f, 'int')}" for f in _FIELDS) + ">>>"


def candidates(text: Column) -> Column:
    """All candidate spans of a text: kind (its number), start, end, base, and the labelers' votes and features."""
    parts = []
    for number, kind in enumerate(KINDS):

        def as_span(loose: bool, kind: str = kind, number: int = number):
            def make(x: Column) -> Column:
                votes = _votes(kind, loose, x["hit"], x["before"])
                base = F.lit(False) if loose else valid(kind, x["hit"])
                made = {"kind": F.lit(number), "start": x["start"], "end": x["end"], "base": base} | votes
                return F.struct(*[made[f].alias(f) for f in _FIELDS])

            return make

        loose = _loose(text, kind)
        if kind == "iban":  # other words in capitals are no candidates at all
            loose = F.filter(loose, lambda x: _remainder_97(x["hit"]) == 1)
        loose = F.transform(loose, as_span(True))
        if kind not in EXACT:
            parts.append(loose)
            continue
        exact = F.when(text.rlike(POSSIBLE[kind]), _found(text, EXACT[kind])).otherwise(F.array().cast(_SPANS))
        if kind == "card":  # short numbers are no candidates at all
            exact = F.filter(exact, lambda x: F.length(_digits(x["hit"])).between(13, 20))
        parts.append(bound(F.concat(F.transform(exact, as_span(False)), loose), _apart))
    return F.concat(*parts)


def estimate(counts: dict[tuple[bool, tuple[int, ...]], int], rounds: int = 100) -> Latent:
    """EM for one kind: from (whether it is a base span, votes) and how many there are. Base spans are known to be true."""
    total = sum(counts.values())
    now = Latent(0.5, tuple(ON_TRUE for _ in VOTES), tuple(ON_FALSE for _ in VOTES))
    for _ in range(rounds):
        post = {k: 1.0 if k[0] else now.posterior(k[1]) for k in counts}
        sides = []
        for prior, mass in ((ON_TRUE, {k: n * post[k] for k, n in counts.items()}), (ON_FALSE, {k: n * (1 - post[k]) for k, n in counts.items()})):
            all_ = sum(mass.values()) + PRIOR_SPANS
            sides.append(tuple({v: (sum(m for k, m in mass.items() if k[1][j] == v) + PRIOR_SPANS * prior[v]) / all_ for v in (-1, 0, 1)} for j in range(len(VOTES))))
        now = Latent((sum(n * post[k] for k, n in counts.items()) + PRIOR_SHARE) / (total + 2 * PRIOR_SHARE), *sides)
    return now


def fit(counts: list[tuple[dict, int]]) -> Model:
    """From (base, votes and features, count): EM for each kind, then a logistic regression on the posteriors.

    The regression's inputs are indicators of feature values; it minimises the expected log loss under the posteriors,
    with a small penalty.
    """
    by_kind: dict[int, dict] = {}
    for x, n in counts:
        mine = by_kind.setdefault(x["kind"], {})
        key = bool(x["base"]), tuple(x[v] for v in VOTES)
        mine[key] = mine.get(key, 0) + n
    votes = {k: estimate(c) for k, c in by_kind.items()}
    post = [1.0 if x["base"] else votes[x["kind"]].posterior(tuple(x[v] for v in VOTES)) for x, _ in counts]
    keys = sorted({(f, x[f]) for x, _ in counts for f in FEATURES})
    w, bias, total = dict.fromkeys(keys, 0.0), 0.0, float(sum(n for _, n in counts)) or 1.0
    for step in range(400):
        slope, off = dict.fromkeys(keys, 0.0), 0.0
        for (x, n), p in zip(counts, post, strict=True):
            z = bias + sum(w[f, x[f]] for f in FEATURES)
            e = (p - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * n / total
            off += e
            for f in FEATURES:
                slope[f, x[f]] += e
        rate = 4.0 / (1 + step / 200)
        bias += rate * off
        for k in keys:
            w[k] += rate * (slope[k] - 1e-4 * w[k])
    return Model(votes, w, bias)


def train(found: DataFrame) -> Model:
    """Fit to all candidates (column spans); only counts of distinct votes and features reach the driver."""
    names = sorted({"base", *VOTES, *FEATURES})
    counted = found.select(F.explode("spans").alias("s")).groupBy(*[F.col(f"s.{c}").alias(c) for c in names]).agg(F.count("*").alias("n"))
    return fit(sorted((({c: r[c] for c in names}, r["n"]) for r in counted.collect()), key=lambda x: sorted(x[0].items())))


def chosen(spans: Column, model: Model, threshold: float) -> Column:
    """Base spans and those the classifier takes, ordered by start and kind."""
    taken = F.filter(spans, lambda s: s["base"] | (model.probability(s) >= threshold))
    return F.array_sort(F.transform(taken, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"))))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(number: int):
    return lambda kind: kind == number


def find(docs: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every document.

    Positions count code points, the end is exclusive. The n_ columns and the digest are of exact matches; spans has
    also what the classifier adds, of which n_added counts. Null texts count as empty, and an empty text has no spans.
    Repeated rows are each answered, and an empty table gives an empty one. Other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = settle(slim.select("doc_id", candidates(F.col("text")).alias("spans")), "candidates")
    picked = found.select("doc_id", chosen(F.col("spans"), train(found), threshold).alias("all"))
    base = F.filter("all", lambda s: s["base"])
    counts = [F.size(F.filter(F.transform(base, lambda s: s["kind"]), _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    return picked.select("doc_id", *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("all")).alias("spans"), F.size(F.filter("all", lambda s: ~s["base"])).alias("n_added"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; spans that overlap become one.

    Spans are taken in pieces, and each piece cuts its own stretch out of the text first, since reaching a place in a
    text costs as much as the text before it.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    to_end = F.lit(2**31 - 1)
    part = lambda of, start, end: F.substring(of, (start + 1).cast("int"), (end - start).cast("int"))

    def within(p: Column, begin: Column, stop: Column) -> Column:
        def written(stretch: Column) -> Column:
            def step(acc: Column, s: Column) -> Column:
                piece = F.concat(acc["out"], part(stretch, acc["at"] - begin, s["start"] - begin), F.element_at(names, s["kind"] + 1))
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"))

            return F.aggregate(p, F.struct(begin.alias("at"), F.lit("").alias("out")), step)["out"]

        return bound(part(text, begin, stop), written)

    def joined(pieces: Column) -> Column:
        most = lambda a, x: F.greatest(a, x)
        ends = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, s: F.greatest(a, s["end"])))
        bounds = F.zip_with(_before(ends, most), ends, lambda b, e: F.struct(b.alias("begin"), F.greatest(b, e).alias("stop")))
        done = F.zip_with(pieces, bounds, lambda p, b: F.struct(within(p, b["begin"], b["stop"]).alias("out"), b["stop"].alias("stop")))
        return bound(done, lambda d: F.concat(F.array_join(F.transform(d, lambda x: x["out"]), ""), F.substring(text, (F.array_max(F.transform(d, lambda x: x["stop"])) + 1).cast("int"), to_end)))

    return bound(_cut(spans), joined)


def redact(docs: DataFrame, threshold: float = 0.9, text_col: str = "text") -> DataFrame:
    """docs with personal data in texts masked, and n_chars, if there is such a column, brought up to date.

    Texts are read twice, to train and to mask; no text is shuffled. Null texts stay null, empty ones empty; repeated rows
    are masked alike, and an empty table stays empty. Other columns stay as they are, whatever their names.
    """
    own, names = F.col(f"`{text_col}`"), docs.columns
    text = F.coalesce(own.cast("string"), F.lit(""))
    found = settle(docs.select(candidates(text).alias("spans")).where(F.size("spans") > 0), "candidates")
    model = train(found)
    new = bound(chosen(candidates(text), model, threshold), lambda s: F.when(F.size(s) > 0, masked(own, s)).otherwise(own))
    done = docs.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in names])
    if "n_chars" not in names or text_col == "n_chars":
        return done
    return done.select(*[F.char_length(f"`{text_col}`").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names])
