"""Each corpus operator against plain Python, and on odd tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.llm import _common, bpe, fingerprints, language, lm, mixing, ngram_join, pii, quality, sharding, token_counts
from chunkloom.llm._common import numbered
from tests.llm.conftest import ODD


def by_row(df):
    return sorted(map(tuple, df.collect()), key=repr)


def held(i, n):
    return i is not None and zlib.crc32(str(i).encode()) % n == 2


# --- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d - 9 * (d > 9) for d in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15
            if good:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


PII = [
    "mail a.b@c-d.example.com or x@y.z_w@v.u", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 010.001.0.255", "4111 1111 1111 1111, 4111-1111-1111-1112, 5 4012888888881881",
    "call +1 (988) 555-2485. or +12 34", "🙂é +1 (988) 555-24854111 1111 1111 1111", "1" * 50_000, "a" * 50_000 + "@", "1.2.3.4 " * 500, "john [at] site [dot] com", "call me on 555-123-4567 today", None, "",
]


def test_exact_personal_data(spark):
    df = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string")
    for r in pii.find(df).collect():
        want = base_spans(PII[r["doc_id"]])
        spelled = ",".join(f"{k}:{a}:{e}" for a, _, e, k in want)
        assert r["base_sha256"] == hashlib.sha256(spelled.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(w[3] == k for w in want) for k in BASE]
        assert set(filter(None, spelled.split(","))) <= set(r["spans"].split(","))


def test_masking(spark):
    df = spark.createDataFrame([(1, "mail a@b.com, card 4111 1111 1111 1111!", 9), (2, None, None), (3, "clean text 12 34", 1)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(df).collect()}
    assert got == {1: ("mail <EMAIL>, card <CARD>!", 26), 2: (None, None), 3: ("clean text 12 34", 16)}


def test_labelers_add_what_they_agree_on(spark):
    """Tokens and account numbers are added where labelers speak for them; look-alikes are not."""
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f"set token = '{key(i)}' here") for i in range(100)] + [(1000 + i, f"fixed in commit {key(i)} today") for i in range(100)]
    rows += [(3000 + i, f"order 555-{i + 100}-{1000 + i}") for i in range(100)]
    rows += [(4000, "iban DE89 3704 0044 0532 0130 00."), (4001, "iban DE88 3704 0044 0532 0130 00."), (5000, "donaudampfschifffahrtsgesellschaft and pre-trained-models-version-2"), (5001, "")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == "secret:13:53" for i in range(100)) and not any(got[1000 + i] for i in range(100))
    assert not any(got[3000 + i] for i in range(100)) and not got[4001] and not got[5000] and not got[5001]
    assert got[4000] == "iban:5:32"


def test_how_labelers_vote_is_estimated():
    """A labeler that votes alike on all spans loses its weight, and base spans are taken as true."""
    counts = {(True, (1, 1, 1, 0, 1)): 200, (False, (1, 1, 1, 0, -1)): 150, (False, (-1, -1, 0, 0, 1)): 300}
    found = pii.estimate(counts)
    assert found.posterior((1, 1, 1, 0, -1)) > 0.9 and found.posterior((-1, -1, 0, 0, 1)) < 0.1 and 0.45 < found.share < 0.65
    assert abs(math.log(found.true[3][0] / found.false[3][0])) < 0.1


def test_very_many_matches(spark):
    """Spans and masked text of 60,000 matches, across the pieces in which they are taken, against plain Python."""
    text = "".join(f"{i % 256}.2.3.4 x{i} a{i}@b.cd, " for i in range(30_000))
    df = spark.createDataFrame([(1, text, 0)], "doc_id long, text string, n_chars long")
    r = pii.find(df).first()
    assert r["n_ip"] == r["n_email"] == 30_000 and r["spans"] == ",".join(f"{k}:{a}:{e}" for a, _, e, k in base_spans(text))
    assert pii.redact(df).first()["text"] == re.sub(r"[0-9]+\.2\.3\.4", "<IP>", re.sub(r"a[0-9]+@b\.cd", "<EMAIL>", text))


def test_masking_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([("keep", "x@y.zz \U0001f642 é", "too")], "_spans string, text string, n_spans string")
    assert [tuple(r) for r in pii.redact(df).collect()] == [("keep", "<EMAIL> \U0001f642 é", "too")]


def test_overlapping_spans_become_one(spark):
    from pyspark.sql.types import ArrayType

    spans = [[(0, 0, 4, True), (2, 1, 6, True), (9, 3, 10, True)], [], [(1, 5, 3, False)]]
    schema = "text string, spans array<struct<start:bigint,kind:int,end:bigint,base:boolean>>"
    df = spark.createDataFrame([("abcdefghijkl", spans[0]), ("abc", spans[1]), ("ab🙂c", spans[2])], schema)
    assert isinstance(df.schema["spans"].dataType, ArrayType)
    assert [r[0] for r in df.select(pii.masked(F.col("text"), F.col("spans"))).collect()] == ["<EMAIL>ghi<PHONE>kl", "abc", "a<SECRET>c"]


# --- language


def test_language_of_held_out_documents(docs):
    found = {r["doc_id"]: r for r in language.identify(docs).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    out = [(r["lang"], found[r["doc_id"]]["lang_pred"]) for r in rows if held(r["doc_id"], 4)]
    assert all(found[r["doc_id"]]["held_out"] == held(r["doc_id"], 4) for r in rows) and all(0 <= f["score"] <= 1 for f in found.values())
    assert sum(a == b for a, b in out) >= 0.97 * len(out)


def plain_language(rows, asked):
    """Language and posterior of texts by plain Python, from (lang, text) rows."""
    import regex

    find = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
    words = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for piece in (text or "").lower().split():
            words[lang].update(find(piece))
    words = {x: c for x, c in words.items() if c}
    grams = {(x, n): collections.Counter() for x in words for n in range(1, 5)}
    for lang, counted in words.items():
        for w, c in counted.items():
            for n in range(1, 5):
                for g in [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)] if n > 1 else w:
                    grams[lang, n][g] += c
    cost = lambda table, x: [min(7.0, -math.log10(t[x] / sum(t.values()))) if t[x] else 7.0 for t in table]
    order = sorted(words)

    def of_word(w):
        if any(words[x][w] for x in order):
            return cost([words[x] for x in order], w)
        for n in (4, 3, 2, 1):
            table = [grams[x, n] for x in order]
            mine = [g for g in ([f" {w} "[i : i + n] for i in range(len(w) + 3 - n)] if n > 1 else w) if any(t[g] for t in table)]
            if mine:
                return np.mean([cost(table, g) for g in mine], axis=0)
        return [7.0] * len(order)

    out = []
    for text in asked:
        found = [w for piece in (text or "").lower().split() for w in find(piece)]
        if not found or not order:
            out.append(("und", 0.0))
            continue
        total = np.sum([of_word(w) for w in found], axis=0)
        out.append((order[int(total.argmin())], 1 / np.exp(-np.minimum(700, (total - total.min()) * math.log(10))).sum()))
    return out


def test_language_equals_plain_python(spark, monkeypatch):
    """With words looked up in the scan and joined, and known and unknown ones."""
    from chunkloom.llm import rare

    monkeypatch.setattr(rare, "SHARE", 1 / 20)
    taught = [("en", "the cat sat, on the mat"), ("en", "the (dog) sat"), ("de", "der hund sa\u00df auf der matte"), ("de", "zug um zug"), ("fr", "le chat dort l'\u00e9t\u00e9"), (None, "the the the")]
    asked = ["the hat", "derhund", "zugig", "chatte", "qqq \u65e5\u672c", "123 !", "", None, "sat zug", "the-cat l'hund", "t"]
    rows = [(1 + i, t, x) for i, (x, t) in enumerate(taught)] + [(100 + i, t, None) for i, t in enumerate(asked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}
    want = plain_language([r for r in taught if r[0]], [t for _, t, _ in rows])
    for (i, _, _), (lang, score) in zip(rows, want, strict=True):
        assert got[i][1] == pytest.approx(score, abs=1e-4)
        assert got[i][0] == lang or score < 0.5
    other = docs.where("doc_id >= 100").repartition(2)
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(other, model).collect()}
    assert again.keys() == {i for i in got if i >= 100} and all(again[i][1] == pytest.approx(got[i][1], abs=1e-6) for i in again)
    kept = {r["doc_id"] for r in language.keep_known(docs, model, 0.9).collect()}
    assert kept == {i for i, (lang, score) in got.items() if lang != "und" and score >= 0.9}


def test_language_backs_off_with_few_tables_and_files(spark, monkeypatch):
    """Words whose longest known n-gram has 4, 3, 2, 1 or no letters, by plain Python; and what is written meanwhile."""
    import glob

    made, sizes = [], {}

    def counted(df, tag, batch=None):
        out = _common.settle(df, tag, batch)
        made.append(tag)
        there = out._settled_at.removeprefix("file://")
        sizes[tag] = len(glob.glob(f"{there}/part-*")), len(glob.glob(f"{there}/.part-*"))
        return out

    monkeypatch.setattr(language, "settle", counted)
    monkeypatch.setattr(language.rare, "settle", counted)
    taught = [("en", "the weather mattered"), ("en", "quiz a"), ("de", "wetter und zeit"), ("fr", "temps a l\u00e9ger")]
    asked = ["weathers", "wet", "zet", "uizz", "qzw", "xzx", "\u00e9w", "t", "j", "\u65e5\u672c", "j zet \u65e5 quizzes", "lz \u00e9", "the j"]
    rows = [(1 + i, t, x) for i, (x, t) in enumerate(taught)] + [(100 + i, t, None) for i, t in enumerate(asked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}
    for (i, _, _), (lang, score) in zip(rows, plain_language(taught, [t for _, t, _ in rows]), strict=True):
        assert got[i][1] == pytest.approx(score, abs=1e-4)
        assert got[i][0] == lang or score < 0.5
    assert len(made) <= 11, made
    assert sizes["gram-costs"][0] <= 4  # shuffle partitions
    assert not any(sums for _, sums in sizes.values())


def test_language_odd(odd, empty):
    found = by_row(language.identify(odd).select("doc_id", "held_out", "lang_pred", "score"))
    assert len(found) == len(ODD) and sum(r[2] == "und" for r in found) == 3
    assert language.identify(empty).count() == 0


# --- tokens


def test_bpe_equals_the_library(spark, tokenizer, odd, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer)
    rows = [t for _, t, *_ in ODD] + ["aaaa", "I'll  go\n\n ", "\x1c a\x85b", "ab" * 4000, " " * 3000, "x<|endoftext|><|endoftext|>y"] + [r["text"] for r in docs.limit(60).collect()]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encode(df, tokenizer).collect()}
    for i, t in enumerate(rows):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids) and got[i]["exact"]
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(odd, tokenizer).count() == len(ODD)
    assert {r["text"] for r in bpe.decode(bpe.encode(df, tokenizer), tokenizer).collect()} == {t or "" for t in rows}


def test_automaton_of_a_small_vocabulary():
    """Against merging step by step, for all words over two letters."""
    import itertools

    labels = [b"a", b"b", b"aa", b"ab", b"aab", b"ba"]
    gadgets = [(0, 0, 2), (0, 1, 3), (2, 1, 4), (1, 0, 5)]
    automaton = bpe.Automaton(labels, gadgets, {})

    def merged(word):
        ids = [b"ab".index(c) for c in word]
        for u, v, new in gadgets:
            i, out = 0, []
            while i < len(ids):
                if ids[i : i + 2] == [u, v]:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    for n in range(1, 10):
        for word in itertools.product("ab", repeat=n):
            w = "".join(word).encode()
            assert automaton.encode_word(w) == merged(w)


def test_parts_met_late_are_remembered_too():
    """What a worker keeps is bounded, and follows the texts instead of holding what came first."""
    encoder = bpe.Encoder(bpe.Automaton([bytes([b]) for b in range(256)], [], {}), most=10)
    texts = [f"w{i}" for i in range(100)]
    assert [list(encoder.encode(t)[::4]) for t in texts] == [list(t.encode()) for t in texts]
    tried, one = [], encoder.automaton.encode_word
    encoder.automaton.encode_word = lambda word: tried.append(word) or one(word)
    assert encoder.encode("late late late") == bpe.packed(list(b"late late late"))
    assert tried == [b"late", b" late"]
    assert len(encoder.known) <= 10 and len(encoder.known.old) <= 10


def test_token_counts_and_their_cache(spark, tokenizer, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    lib, where = Tokenizer.from_file(tokenizer), f"file://{tmp_path}/cache"
    want = sorted(((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ODD), key=repr)
    for _ in range(2):
        got = token_counts.count_tokens(odd, tokenizer, where)
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got.collect()), key=repr) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got.collect())
        stored = spark.read.parquet(where)
        assert stored.count() == len({t or "" for _, t, *_ in ODD})  # one row a content, and none added by the second round
    spark.createDataFrame([(hashlib.sha256(b"x").digest(), 77, token_counts.tokenizer_digest(tokenizer))], token_counts.SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(where)
    assert token_counts.count_tokens(odd.where("doc_id = 8"), tokenizer, where).first()["n_tokens"] == 77  # what is stored is taken
    assert token_counts.count_tokens(empty, tokenizer).count() == 0


# --- language model


def test_scores(odd, docs, empty):
    rows = [(r["doc_id"], lm.words_of(r["text"] or "") + [b""]) for r in docs.collect()]
    c = collections.Counter()
    for i, w in rows:
        if not held(i, 7):
            c.update(w)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    for i, w in rows:
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(c[x] > 0 for x in w), n, held(i, 7))
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # words before help to predict
    assert lm.score_documents(odd).count() == len(ODD) and lm.score_documents(empty).count() == 0


def test_score_equals_plain_python(spark, monkeypatch):
    """From the model's parameters, one token after another, with words looked up in the scan, joined and unseen."""
    from chunkloom.llm import rare

    monkeypatch.setattr(rare, "SHARE", 1 / 30)
    rows = [(i, f"the cat w{i % 17} sat on the mat x{i}") for i in range(60)] + [(100, None), (101, ""), (102, "never met words sat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = lm.train(df.where("doc_id < 50"), singles=2)
    counts = collections.Counter(w for i, t in rows if i < 50 for w in lm.words_of(t))
    assert model.singles == ["the", "cat"] and model.tokens == sum(counts.values()) + 50 and 0 < len(model.frequent) < len(counts)
    assert np.isclose(sum(model.masses), model.tokens)
    got = {r["doc_id"]: r["score"] for r in lm.score(df, model).collect()}
    for i, t in rows:
        h = g = 0
        total = 0.0
        for w in [*lm.words_of(t or ""), b""]:
            single = w.decode() in model.singles
            k = 0 if not w else 1 + model.singles.index(w.decode()) if single else model.class_of(w)
            p = np.exp(model.bilinear.log_probabilities(h, g))
            assert np.isclose(p.sum(), 1)
            total += math.log10(p[k]) + (0 if single or not w else math.log10(model.within(k, counts[w])))
            h, g = k, h
        assert got[i] == pytest.approx(total, abs=1e-3)
    for k in set(map(model.class_of, counts)):  # the words of a class and one that was never met share it
        mine = [c for w, c in counts.items() if w.decode() not in model.singles and model.class_of(w) == k]
        assert sum(model.within(k, c) for c in mine) + model.within(k, 0) == pytest.approx(1)


def test_context_is_learned():
    """Estimated by noise, the model tells what follows from the word before and from the one before that."""
    run = np.array([1, 2, 3, 0, 4, 2, 5, 0] * 4000)
    model = lm.LogBilinear(np.bincount(run, minlength=8) / len(run))
    state = model.train(run, 1)
    model.train(run, 2, state)
    p = np.exp(model.log_probabilities(2, 1)), np.exp(model.log_probabilities(2, 4)), np.exp(model.log_probabilities(1, 0))
    assert p[0][3] > 0.7 and p[1][5] > 0.7 and p[2][2] > 0.7
    a, e, z = model.parts()
    assert np.allclose(a[2] + e[1] - z[2, 1], model.log_probabilities(2, 1), atol=1e-4)


def test_the_second_word_starts_anew_in_each_text():
    assert [x.tolist() for x in lm.before(np.array([3, 4, 0, 5, 6, 0]))] == [[0, 3, 4, 0, 5, 6], [0, 0, 3, 0, 0, 5]]


# --- fingerprints


def test_fingerprints(docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.compare_with_next(docs).collect()}
    marks = collections.defaultdict(set)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        marks[t].add(got[i]["fingerprint"])
        marks[edited].add(got[i]["edited_fingerprint"])
    assert all(len(m) == 1 for m in marks.values()) and len({next(iter(m)) for m in marks.values()}) == len(marks)
    near = [r for r in got.values() if r["n_chars"] > 200]
    assert np.mean([r["near_edited"] > r["near_next"] for r in near]) > 0.99


def test_edits_are_located(spark):
    lines = [f"line number {i} says something of its own.\n" for i in range(30)]
    other = lines[:12] + ["another line instead.\n"] + lines[13:]
    df = spark.createDataFrame([("".join(lines), "".join(other))], "a string, b string")
    a, b = fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))
    r = df.select(fingerprints.differing(a, b).alias("x"), fingerprints.differing(a, a).alias("same"), fingerprints.likeness(a, b).alias("near"), fingerprints.root(a).alias("root")).first()
    assert r["x"] == [12] and r["same"] == [] and 0.9 < r["near"] < 1 and len(r["root"]) == 64


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_next_row_across_ranges(spark, buckets):
    rows = [(i, f"t{i}") for i in [5, 9, 9, 1, 30, 31, 32, 77]] + [(None, "none")]
    got = by_row(fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", buckets)[0].where("own").select("doc_id", "text", "next_text"))
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert got == sorted(((*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order)), key=repr)


def test_fingerprints_odd(odd, empty):
    assert fingerprints.compare_with_next(odd).count() == len(ODD) and fingerprints.compare_with_next(empty).count() == 0


# --- sharding


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_permutation(n):
    rows = np.arange(n)
    places = sharding.permute(rows, n, 5)
    assert sorted(places) == list(rows) and (sharding.unpermute(places, n, 5) == rows).all()
    shard, slot = sharding.locate(rows, n, 4, 5)
    assert (sharding.row_at(shard, slot, n, 4, 5) == rows).all()


def test_shards(odd, docs, empty):
    for df in (odd, docs):
        got = sharding.shard_documents(df).collect()
        assert len(got) == df.count() and sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((r["doc_id"], len((r["text"] or "").encode()) + 1) for r in df.collect() if r["doc_id"] is not None)
        slots = collections.defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        assert max(map(len, slots.values())) - min(len(slots[s]) for s in range(16)) <= 1
    assert by_row(sharding.shard_documents(docs.repartition(7))) == by_row(sharding.shard_documents(docs)) and sharding.shard_documents(empty).count() == 0


def test_numbers_follow_the_order(spark):
    rows, n = numbered(spark.range(500).select((499 - F.col("id")).alias("k")), ["k"], "t")
    assert n == 500 and all(r["k"] == r["row_number"] for r in rows.collect())


# --- near duplicates


def components(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*[w[k:] for k in range(width)], strict=False)) if len(w) >= width else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), top(i)) for i, s in sets.items())


def copies(seed=1):
    """A large group of edited copies of one text, chains of small changes, short texts, a shared passage."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(5000)}"
    base = [word() for _ in range(120)]
    rows = []
    for _ in range(90):
        t = list(base)
        for at in rng.choice(120, rng.integers(0, 12), replace=False):
            t[at] = word()
        rows.append(" ".join(t))
    chain = [word() for _ in range(200)]
    for k in range(12):
        rows.append(" ".join(chain[k * 4 : k * 4 + 150]))
    passage = " ".join(word() for _ in range(60))
    rows += [passage + " " + " ".join(word() for _ in range(rng.integers(1, 60))) for _ in range(60)]
    rows += ["a b", "A B", "b a", "a", "", None, "a b c", "a b c d", "a b c d e f g h i j k l", "a b c d e f g h i j k l m"]
    return list(enumerate(rows))


@pytest.mark.parametrize(("width", "num", "block"), [(3, 90, 8000), (5, 80, 16), (1, 50, 16)])
def test_components_equal_brute_force(spark, monkeypatch, width, num, block):
    """With one block a group, and with many."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rows = copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, ngram_join.near_duplicates(df, width, (num, 100)).collect())) == components(rows, width, num, 100)


def test_links_by_strips(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(ngram_join, "STRIP", 3)
    base = np.arange(50)
    lists = [np.unique(np.where(rng.random(50) < 0.1, rng.integers(100, 200, 50), base)) for _ in range(20)]
    for same in (True, False):
        sides = np.zeros(20, dtype=int) if same else np.arange(20) % 2
        found = ngram_join.linked(np.arange(20), sides, lists, 70, 100, same)
        up = list(range(20))
        for a, b in found:
            assert 100 * len(np.intersect1d(lists[a], lists[b])) >= 70 * len(np.union1d(lists[a], lists[b]))
            up = [up[b] if x == up[a] else x for x in up]
        for a in range(20):
            for b in range(20):
                if (same or sides[a] != sides[b]) and 100 * len(np.intersect1d(lists[a], lists[b])) >= 70 * len(np.union1d(lists[a], lists[b])):
                    assert up[a] == up[b]


def test_links_of_a_like_group_take_little_memory():
    """All pairs of a block may be alike: only links that join something are kept, not every pair that is found."""
    import tracemalloc

    lists = [np.arange(20) for _ in range(400)]
    tracemalloc.start()
    found = ngram_join.linked(np.arange(400), np.zeros(400, dtype=int), lists, 80, 100, True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [b for _, b in found] == list(range(1, 400))
    assert most < 15_000_000


def test_wide_rows_go_to_workers_few_at_a_time(spark, monkeypatch):
    """Texts read again and the sets of a block: a batch of them is held by the JVM and by the worker at once."""
    batch, real = {}, ngram_join.settle
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    monkeypatch.setattr(ngram_join, "settle", lambda df, tag, most=None: batch.update({tag: most}) or real(df, tag, most))
    df = spark.createDataFrame(copies(), "doc_id long, text string").repartition(5)
    ngram_join.near_duplicates(df, 5, (80, 100))
    assert (batch["shingled"], batch["sets"], batch["more-links"]) == (ngram_join.WIDE, ngram_join.WIDE, ngram_join.SETS)


def test_signatures_meet():
    """Any two sets that are similar enough share a signature, however their differences lie."""
    rng = np.random.default_rng(2)
    for num in (80, 90):
        for n in (1, 2, 5, 9, 10, 20, 45, 150, 700):
            for _ in range(12):
                a = rng.integers(0, 2**63, n, dtype=np.uint64)
                drop = int(rng.integers(0, n // 4 + 1))
                b = np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, n // 6 + 1)), dtype=np.uint64)])
                a, b = np.unique(a), np.unique(b)
                both = len(np.intersect1d(a, b))
                if 100 * both >= num * (len(a) + len(b) - both) and both:
                    assert np.intersect1d(ngram_join.signatures(a, num, 100), ngram_join.signatures(b, num, 100)).size


def test_rows_without_ids(spark):
    """Near copies of which none has an id still find each other; one of each group stays, one with an id if it can be."""
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words), " ".join(words[:-1] + ["x"]), " ".join(words[:-1] + ["y"]), "something else here now"]
    df = spark.createDataFrame([(None, t) for t in texts] + [(7, " ".join(words[:-1] + ["z"]))], "doc_id long, text string")
    assert {r["component_id"] for r in ngram_join.near_duplicates(df, 3, (90, 100)).where("n_shingles > 2").collect()} == {7}
    assert [r["component_id"] for r in ngram_join.near_duplicates(df, 3, (90, 100)).collect()].count(7) == 4
    kept = lambda rows: sorted((r["doc_id"] or 0, r["text"]) for r in ngram_join.drop_near_duplicates(rows, 3, (90, 100)).collect())
    assert kept(df) == [(0, texts[3]), (7, " ".join(words[:-1] + ["z"]))]
    assert [t in texts[:3] for _, t in kept(df.where("doc_id is null").unionByName(df.where("doc_id is null")))].count(True) == 1


def test_columns_of_any_name_stay(spark):
    """Names that the operators use inside are the rows' own business."""
    taken = ["_id", "_md5", "_crc", "_turn", "_size", "_pass", "_mine", "_new", "_told", "_h1", "_n", "_stays", "k0", "k1", "row", "a.b"]
    rows = spark.createDataFrame([(i // 2, f"the words of text {i // 4} go on and on here", "en", "s") for i in range(12)], "doc_id long, text string, lang string, source string")
    rows = rows.withColumns({c: F.lit(c) for c in taken})
    mixed = mixing.materialise(rows, mixing.mix(rows))
    for out in (language.keep_known(rows, language.train(rows), 0.0), ngram_join.drop_near_duplicates(rows), mixed):
        got = out.collect()
        assert out.columns == rows.columns and got and all([r[c] for c in taken] == taken for r in got)


def test_joined_odd(odd, empty):
    got = by_row(ngram_join.near_duplicates(odd, 3, (90, 100)))
    assert len(got) == len(ODD) and got.count((1, 12, 1)) == 2 and (2, 0, 2) in got and (7, 1, 7) in got
    kept = ngram_join.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.drop_near_duplicates(empty).count() == 0


# --- quality


def plain_counts(text):
    words = (text or "").encode().split()
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_counts_and_verdict(odd, docs, data, empty):
    for df in (odd, docs):
        got = sorted((tuple(r) for r in quality.judge(df).select("doc_id", *quality.FEATURES[:5], "base_failed").collect()), key=repr)
        want = []
        for r in df.collect():
            p = plain_counts(r["text"])
            want.append((r["doc_id"], *p, p[0] < 50 or 100 * p[4] > 50 * p[0]))
        assert got == sorted(want, key=repr)
    labels = docs.sparkSession.read.parquet(f"{data}/labels.parquet")
    told = quality.judge(docs).where("not base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in told]) > 0.95
    assert quality.judge(empty).count() == 0


def test_verdicts_equal_plain_bayes(docs):
    """p_good and kept, from the votes in the result and an expectation-maximisation of the test's own."""
    got = quality.judge(docs).collect()
    names = [r.name for r in quality.rules()]
    votes = np.array([[r[f"vote_{n}"] for n in names] for r in got])
    use = np.array([not r["base_failed"] for r in got])
    slips = np.array([r.slip for r in quality.rules()])
    start = np.stack([np.stack([slips, 0 * slips + 0.1, 0.9 - slips], axis=1), np.tile([0.25, 0.1, 0.65], (len(slips), 1))])
    th, share = start.copy(), 0.8
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    likely = lambda: np.exp(np.einsum("njv,cjv->nc", hot, np.log(th))) * [share, 1 - share]
    for _ in range(300):
        post = likely()[use]
        post /= post.sum(axis=1, keepdims=True)
        share = (post[:, 0].sum() + 4) / (use.sum() + 5)
        counted = np.einsum("nc,njv->cjv", post, hot[use]) + 50 * start
        th = counted / counted.sum(axis=2, keepdims=True)
    p = likely()
    p = p[:, 0] / p.sum(axis=1)
    assert np.allclose([r["p_good"] for r in got], p, atol=1e-6)
    assert [r["kept"] for r in got] == [bool(u and x >= 0.5) for u, x in zip(use, p, strict=True)]


def test_how_rules_vote_is_estimated():
    """A rule that votes alike on good and bad texts loses its weight; priors give way as documents grow."""
    patterns = {(-1, -1, 1): 300, (1, 1, 1): 600, (1, 1, -1): 60, (-1, -1, -1): 30}
    found = quality.fit(patterns, [0.02, 0.02, 0.02])
    assert abs(found.balance - 2 / 3) < 0.05 and found.posterior((-1, -1, 1)) < 0.1 < 0.9 < found.posterior((1, 1, -1))
    weights = quality.fit({p: 1000 * n for p, n in patterns.items()}, [0.02, 0.02, 0.02]).weights()
    assert weights[0][-1] < -3 and abs(weights[2][-1]) < 0.3


# --- mixing


def test_apportionment_is_by_highest_quotients():
    weights, seats = [53_000.0, 24_000.0, 23_000.0, 1.0], 7
    got, quota = [0] * 4, [0] * 4
    for _ in range(seats):
        i = max(range(4), key=lambda i: weights[i] / (2 * got[i] + 1))
        got[i] += 1
    assert mixing.apportion(weights, seats, [9] * 4) == got != quota
    assert mixing.apportion([5.0, 1.0], 6, [2, 9]) == [2, 4] and mixing.apportion([0.0], 3, [5]) == [0] and mixing.apportion([], 3, []) == []


def test_targets_stop_and_pass_on():
    assert mixing.targets([10, 100, 100], [3.0, 1.0, 2.0]) == pytest.approx([20.0, 295 / 3, 590 / 3])
    assert mixing.targets([0, 0], [1.0, 1.0]) == [0.0, 0.0] and mixing.targets([], []) == []


def test_sources_smaller_than_a_block_get_their_words(spark):
    rows = [(i, " ".join(["w"] * 20), f"s{i:03}") for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sum(r["taken"] for r in got) == 6000 and all(abs(r["taken"] - r["target"]) <= 20 for r in got)


def test_mixture(odd, docs, empty):
    for df in (odd, docs):
        got = mixing.mix(df).collect()
        assert len(got) == df.count() and all(r["taken"] <= 2 * r["size"] for r in got)
        assert by_row(mixing.mix(df.repartition(3)).select("doc_id", "size", "taken")) == sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=repr)
        made = mixing.materialise(df, mixing.mix(df))
        assert made.columns == df.columns and sum(len((r["text"] or "").encode().split()) for r in made.collect()) == sum(r["taken"] for r in got)
    taken, target = collections.Counter(), {}
    for r in mixing.mix(docs).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= max(64, 0.03 * t) for s, t in target.items())
    assert mixing.mix(empty).count() == 0 and mixing.materialise(empty, mixing.mix(empty)).count() == 0


# --- pipeline


def test_pipeline_stages(spark, data, docs, odd, empty):
    import corpus_pipeline as P

    stages = dict(P.STAGES)
    told = {r["doc_id"]: r for r in language.identify(docs).collect()}
    one = stages["identify_language"](spark, docs, data)
    assert {r["doc_id"] for r in one.collect()} == {i for i, r in told.items() if r["lang_pred"] != "und" and r["score"] >= P.LEAST_SCORE} and one.columns == docs.columns
    two = stages["drop_near_duplicates"](spark, docs, data)
    assert sorted(r["doc_id"] for r in two.collect()) == sorted({c for _, _, c in components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80, 100)})
    three = {r["doc_id"]: r["text"] for r in stages["mask_personal_data"](spark, docs, data).collect()}
    for r in docs.collect():
        assert not base_spans(three[r["doc_id"]]) and (base_spans(r["text"]) or three[r["doc_id"]] == r["text"])
    for df in (odd, empty):
        for name, stage in P.STAGES:
            out = stage(spark, df, data)
            assert name == "encode_tokens" or out.columns == df.columns
            out.count()
    assert P.run(spark, data).where("not exact").count() == 0


def test_stages_leave_no_working_tables(spark, data, docs):
    """Of what a stage settles, only what its lazy rows read stays: a later stage has the disk for itself."""
    import corpus_pipeline as P

    stages, few = dict(P.STAGES), docs.limit(60)
    for name, stays in (("identify_language", {"rejected"}), ("drop_near_duplicates", {"dropped", "keepers", "edges", "groups"})):
        before = set(_common._ours)
        out = stages[name](spark, few, data)
        assert {x.rsplit("chunkloom-", 1)[1][:-33] for x in _common._ours - before} <= stays
        assert out.count()


def test_sets_alike_in_half_their_digest_are_compared(spark):
    reps = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 8, 1)], "rep long, h1 long, h2 long")
    assert [tuple(r) for r in ngram_join._twins(reps).collect()] == [(1, 2)]


def test_queries_cover_all_operators():
    from chunkloom.llm import queries

    names = list(queries.queries())
    assert [n.split("_")[0] for n in names if n != "pipeline"] == [f"op{i}" for i in range(1, 11)] and "pipeline" in names


def test_sql_gives_the_same_rows(spark, data):
    import duckdb

    from chunkloom.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        mine, theirs = queries.queries()[name](spark, data).toPandas(), con.sql(sql).df()
        columns = sorted(mine.columns)
        assert sorted(theirs.columns) == columns
        assert sorted(mine[columns].itertuples(index=False, name=None)) == sorted(theirs[columns].itertuples(index=False, name=None))


def _held_by_workers(spark):
    """What Python workers still hold, seen from as many tasks as run at a time, and a few more."""

    def look(parts):
        import time

        import pyarrow as pa

        for _ in parts:
            time.sleep(0.2)
            yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in _common._held], pa.string())], ["key"])

    return {r["key"] for r in spark.range(0, 16, 1, 16).mapInArrow(look, "key string").collect()}


def test_near_duplicates_leave_nothing_in_workers(spark):
    rows = [(i, f"some words that {i // 2} documents share with one another, and more of them", "en", "a", 1) for i in range(40)] + [(None, "no id but words", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert ngram_join.drop_near_duplicates(docs).count() == 21
    assert _held_by_workers(spark) == set()
