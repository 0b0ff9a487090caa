"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens. Its states are named by the last token read, its arcs are labelled with tokens, and a
sequence of tokens is accepted exactly if BPE would produce it. It is built from one state with a loop for every byte
by one gadget for each merge (u, v), in rank order:

* the state after uv gets the arcs that the state after v has at that moment,
* the arc v leaves the state after u, since BPE would have merged the pair,
* every state that still has an arc u gets an arc uv, to the new state.

A gadget changes a whole row and column of the state table, so the table is kept as the list of changes: for each token
when its state was born and from which state and arc it was copied, and for each pair when its arc was cut. `has_arc`
reads one cell by following those copies back. A trie over arc labels turns the bytes of a word into arcs to try. As
every prefix has one encoding only, at most one accepted path reaches any byte, and no byte is tried twice.
"""

from __future__ import annotations

import json
import sys
from array import array
from functools import cache
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm._common import batches, held_by_worker

#: White space of Unicode, fixed; some regex libraries also count U+001C to U+001F.
SPACE = "\\t\\n\\x0b\\x0c\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The byte-level pre-split, fixed: contractions, then words, numbers, signs with one space before, then white space.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: No piece crosses from other characters to white space, so text can be cut there and the parts looked up whole.
PART = rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"

#: Where a node of the trie has its token, beside its children's bytes.
END = 256
#: Pairs of tokens whose arcs a worker remembers; parts of texts that it remembers, up to twice as many, and half as many words.
KEPT_ARCS, KEPT = 100_000, 200_000


@cache
def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The compiled merges: `gadgets` are (left, right, made) tokens in rank order, `labels` each token's bytes."""

    def __init__(self, labels: list[bytes], gadgets: list[tuple[int, int, int]], special: dict[str, int]):
        self.labels, self.special, self.bits = labels, special, len(labels).bit_length()
        n = len(labels)
        self.born = np.full(n, -1, dtype=np.int64).tolist()
        self.left, self.right = list(range(n)), list(range(n))
        self.cut: dict[int, int] = {}
        for rank, (u, v, made) in enumerate(gadgets):
            self.born[made], self.left[made], self.right[made] = rank, u, v
            self.cut[u << self.bits | v] = rank
        #: A node has its children by byte and, at END, the token whose label leads to it, or -1.
        self.trie: dict = {END: -1}
        #: Each token's longest proper prefix that is a label too, or -1.
        self.shorter = [-1] * n
        used = {t for g in gadgets for t in g} | {t for t, x in enumerate(labels) if len(x) == 1}
        for token in sorted(used - set(special.values()), key=lambda t: len(labels[t])):
            node = self.trie
            for b in labels[token]:
                if node[END] >= 0:
                    self.shorter[token] = node[END]
                node = node.setdefault(b, {END: -1})
            node[END] = token
        self.sizes = [len(x) for x in labels]
        self.arcs: dict[int, bool] = {}

    @classmethod
    def compile(cls, file: bytes) -> Automaton:
        """From the contents of a tokenizer file with byte-level BPE; raises ValueError for other kinds."""
        spec = json.loads(file)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE with the usual pre-split, no prefix space and no normaliser")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in spec["added_tokens"]):
            raise ValueError("added tokens must match as they are")
        special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        letters, vocab = byte_letters(), model["vocab"]
        labels = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for piece, token in vocab.items():
            labels[token] = bytes(letters[c] for c in piece) if piece not in special else piece.encode()
        for piece, token in special.items():
            labels[token] = piece.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        return cls(labels, [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs], special)

    def has_arc(self, u: int, v: int) -> bool:
        """Whether the state after token u has an arc v once all gadgets are applied."""
        born, cut, bits, before = self.born, self.cut, self.bits, 1 << 62
        while True:
            if cut.get(u << bits | v, 1 << 62) < before:
                return False
            if born[u] > born[v]:  # the state was copied from that of its right part before its own gadget cut anything
                before, u = born[u], self.right[u]
            elif born[v] >= 0:  # the arc was added beside that of its left part, after its gadget's cut
                before, v = born[v] + 1, self.left[v]
            else:
                return True

    def encode_word(self, word: bytes) -> list[int]:
        """Tokens of one pre-split word: the accepted path, longest arcs tried first.

        The longest label at a byte is found by the trie, the others are its prefixes. Answers of `has_arc` are kept for
        the pairs met first.
        """
        trie, sizes, shorter, arcs, bits, n = self.trie, self.sizes, self.shorter, self.arcs, self.bits, len(word)
        path: list[int] = []
        at, last, seen = 0, -1, set()
        while True:
            node, token = trie, -1
            for b in word[at:]:
                node = node.get(b)
                if node is None:
                    break
                if node[END] >= 0:
                    token = node[END]
            while True:
                while token < 0:  # nothing goes on from here: try a shorter arc before
                    token = path.pop()
                    at -= sizes[token]
                    token, last = shorter[token], path[-1] if path else -1
                stop = at + sizes[token]
                if stop not in seen:
                    if last < 0:
                        break
                    pair = last << bits | token
                    found = arcs.get(pair)
                    if found is None:
                        found = self.has_arc(last, token)
                        if len(arcs) < KEPT_ARCS:
                            arcs[pair] = found
                    if found:
                        break
                token = shorter[token]
            seen.add(stop)
            path.append(token)
            if stop == n:
                return path
            at, last = stop, token

    def decode(self, ids: list[int]) -> str:
        """Arc labels one after another, as text; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Known(dict):
    """What `make` gives for a string, looked up again. When there are `most` they become the old ones, of which those
    that are met again are taken over, and the old ones before them go."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) < 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


class Encoder:
    """Whole texts to tokens. Parts of texts, and the words in them, are kept with their tokens to be looked up again."""

    def __init__(self, automaton: Automaton, most: int = KEPT):
        import re

        import regex

        self.automaton, self.split, self.part = automaton, regex.compile(SPLIT), re.compile(PART)
        names = sorted(automaton.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.names = names
        self.words = _Known(lambda word: packed(automaton.encode_word(word.encode())), max(1, most // 2))
        self.known = _Known(self.encode_part, most)

    def encode_part(self, part: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split.findall(part)))

    def encode(self, text: str) -> bytes:
        """Token ids of a text, as little-endian unsigned 32-bit integers."""
        if self.special is not None and any(n in text for n in self.names):
            special = self.automaton.special
            return b"".join(packed([special[x]]) if x in special else self.plain(x) for x in self.special.split(text) if x)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.part.findall(text)))


def _encoder(file: bytes) -> Encoder:
    return held_by_worker(("bpe", sha256(file).digest()), lambda: Encoder(Automaton.compile(file)))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, ids (array of int), n_tokens, ids_sha256, decoded_sha256, exact for every document.

    `tokenizer` is the path of a tokenizer file on the driver; its contents travel with the tasks, which compile them
    once a worker. exact tells whether decoding gave the text back. Null and empty texts have no tokens. Added tokens'
    strings inside a text become those tokens. With keep_ids False the ids column is left out. Other columns are ignored.
    """
    with open(tokenizer, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, " + ("ids array<int>, " if keep_ids else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean"

    def work(parts):
        import pyarrow as pa

        encoder = _encoder(file.value)
        decode = encoder.automaton.decode
        for part in parts:
            for begin, texts in batches(part.column("text")):
                raw = [encoder.encode(t) for t in texts]
                decoded = [decode(np.frombuffer(x, "<u4").tolist()) for x in raw]
                sizes = [len(x) // 4 for x in raw]
                cols = [part.column("doc_id").slice(begin, len(texts))]
                if keep_ids:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4"))))
                cols += [pa.array(sizes, pa.int64()), pa.array([sha256(x).hexdigest() for x in raw], pa.string()), pa.array([sha256(x.encode()).hexdigest() for x in decoded], pa.string()), pa.array([a == b for a, b in zip(texts, decoded, strict=True)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(["ids"] * keep_ids), "n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    return slim.mapInArrow(work, schema)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text from ids; null ids give null."""
    with open(tokenizer, "rb") as f:
        file = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def text(ids):
        import pandas as pd

        automaton = _encoder(file.value).automaton
        return pd.Series([None if x is None else automaton.decode(list(x)) for x in ids])

    return encoded.select(F.col(id_col).alias("doc_id"), text(ids_col).alias("text"))
