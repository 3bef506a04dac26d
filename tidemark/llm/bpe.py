"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

The automaton reads tokens: its accepted token strings are exactly the canonical encodings. It starts
as one state with an arc for each byte. Each merge (u, v), in order of rank, adds a gadget: every
state with an arc u gets an arc uv to where v led; and the state that u leads to is split, u now
leading to a copy without the arc v. So the state after a token is a label with the cuts made in it,
and a new label starts with the cuts that its right half had by then. Kept like this (cuts by label
and rank, halves by label) the automaton has as many entries as there are merges, while its arcs,
written out, would be billions (``tests/llm`` builds them all for small lists of merges).

Bytes are read by the deterministic automaton of subsets: a state is the set of pairs (label that ended
at an earlier place, trie node of the bytes since then). Every prefix of a word has one canonical
encoding, so that a state has one label that ends just there. States and their 256 transitions go into
a table when they are first met; a word is then one table step for each byte, with no search and no way
back, and its arc labels are read off from its end: the last label, then that of the place where it
began. The table is bounded by ``STATES``, after which it starts anew. Decoding writes the labels.

Edge cases: a null or empty text has no tokens; strings of special tokens in a text become those
tokens, as the tokenizers library does by default; texts of any length are read piecewise; repeated
rows are encoded each; extra columns pass through, except that ``encode`` refuses a table that has a
column _ids; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import sliced

#: Fixed value: the word pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: States kept in the table at most.
STATES = 300_000


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: Latin-1 graphic characters are themselves, the rest follow 255."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary: labels by id, merges, and encoding of texts by pieces that are remembered."""

    #: Encoded text pieces that a worker remembers at most, twice.
    remembered = 150_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        if len(self.labels) > 1 << 16:
            raise ValueError(f"{path} has more ids than 16 bits can tell")
        for token, i in vocab.items():
            if token not in self.special:
                self.labels[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.labels[i] = token.encode()
        plain = set(self.special.values())
        self.ids = {label: i for i, label in enumerate(self.labels) if i not in plain}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs]
        self.splitter = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def joined(self, pieces: list[str]) -> list[bytes]:
        """The pieces' ids as little-endian 16-bit numbers."""
        raise NotImplementedError

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 16-bit numbers."""
        if not text:
            return b""
        if self.splitter is None or not self.splitter.search(text):
            return self._plain(text)
        parts, at = [], 0
        for m in self.splitter.finditer(text):
            parts += [self._plain(text[at : m.start()]), np.uint16(self.special[m[0]]).tobytes()]
            at = m.end()
        return b"".join([*parts, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        # A space before a non-space always begins a word: pieces between such spaces are independent.
        if _ODD_SPACE.search(text):
            pieces = [p for p in _BEFORE_WORD.split(text) if p]
        else:
            first, *rest = text.split(" ")
            pieces = [" " + p for p in rest]
            if first:
                pieces.insert(0, first)
        return b"".join(self.joined(pieces))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


class Automaton(Vocabulary):
    remembered = 400_000

    def __init__(self, path: str):
        super().__init__(path)
        size, never = len(self.labels), len(self.merges)
        self.made = [never] * size  # rank of the merge that makes a label
        self.left, self.right = [-1] * size, [-1] * size
        self.cut: dict[int, int] = {}  # label << 16 | label: rank at which the gadget takes this arc away
        sound = [self.made[i] == never for i in range(size)]  # of the bytes
        for rank, (u, v, uv) in enumerate(self.merges):
            if self.made[uv] != never or self.left[uv] >= 0:
                raise ValueError(f"two merges make {self.labels[uv]!r}")
            # the gadget finds no path to bridge where an earlier one has cut v after u
            sound[uv] = sound[u] and sound[v] and self.arc(u, v, rank)
            self.left[uv], self.right[uv], self.made[uv] = u, v, rank
            self.cut[u << 16 | v] = rank
        self.step: dict[int, int] = {}  # trie of labels: node << 8 | byte: node
        self.ends = [-1]
        for i in self.ids.values():
            if sound[i]:
                self._add(i)
        self.sizes = [len(x) for x in self.labels]
        self._start()

    def _start(self) -> None:
        """An empty table: state 0 is the start, label -1 at trie node 0."""
        self.table: dict[int, int] = {}  # state << 8 | byte: state
        self.subsets = [((-1, 0),)]
        self.named = {self.subsets[0]: 0}
        self.last = [-1]  # label that ends at a state

    def _add(self, token: int) -> None:
        node = 0
        for b in self.labels[token]:
            at = node << 8 | b
            node = self.step.get(at, 0)
            if not node:
                node = self.step[at] = len(self.ends)
                self.ends.append(-1)
        self.ends[node] = token

    def arc(self, state: int, token: int, before: int | None = None) -> bool:
        """Has the state after label ``state`` an arc ``token`` (before the merge of that rank)?"""
        cut, made, left, right, never = self.cut, self.made, self.left, self.right, len(self.merges)
        until, x = never if before is None else before, state
        while x >= 0:  # the label's own cuts, then those it began with
            since, t = never, token
            while t >= 0:  # an arc is there if its left half was when it was made
                rank = cut.get(x << 16 | t)
                if rank is not None and rank < until and rank <= since:
                    return False
                since, t = made[t], left[t]
            until, x = made[x], right[x]
        return True

    def _met(self, state: int, byte: int) -> int:
        """A transition for the table: all pairs step in the trie; the one whose label has an arc for what ends here gives the next label."""
        step, ends = self.step, self.ends
        on, label = [], None
        for before, node in self.subsets[state]:
            node = step.get(node << 8 | byte, 0)
            if node:
                on.append((before, node))
                token = ends[node]
                if token >= 0 and label is None and (before < 0 or self.arc(before, token)):
                    label = token
        subset = (*on, (label, 0))
        to = self.named.get(subset)
        if to is None:
            to = self.named[subset] = len(self.subsets)
            self.subsets.append(subset)
            self.last.append(label)
        self.table[state << 8 | byte] = to
        return to

    def word(self, word: bytes) -> list[int]:
        """The canonical encoding of one pre-split word: a step of the table for each byte, then the labels from the end."""
        if len(self.subsets) > STATES:
            self._start()
        table, state, path = self.table, 0, []
        for byte in word:
            to = table.get(state << 8 | byte)
            state = self._met(state, byte) if to is None else to
            path.append(state)
        out, at, last, sizes = [], len(path), self.last, self.sizes
        while at:
            label = last[path[at - 1]]
            out.append(label)
            at -= sizes[label]
        out.reverse()
        return out

    def _word(self, word: str) -> bytes:
        out = self.words.get(word)
        if out is None:
            out = self.older.get(word)
            if out is None:
                out = np.array(self.word(word.encode()), "<u2").tobytes()
            self._remember(word, out)
        return out

    def _known(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            words = _pattern().findall(piece)
            if len(words) == 1:
                return self._word(piece)
            out = b"".join(map(self._word, words))
        self._remember(piece, out)
        return out

    def _remember(self, piece: str, ids: bytes) -> None:
        """Memory of two generations, so that it stays bounded."""
        if len(piece) <= 64:
            self.words[piece] = ids
            if len(self.words) >= self.remembered:
                self.older, self.words = self.words, {}

    def joined(self, pieces: list[str]) -> list[bytes]:
        get, known = self.words.get, self._known  # at a change of generation, get goes on with what is then the older
        return [get(p) or known(p) for p in pieces]


_ODD_SPACE = re.compile(r" (?:\s|\Z)")
_BEFORE_WORD = re.compile(r"(?= \S)")


@functools.cache
def _pattern():
    return regex.compile(PATTERN)


@functools.cache
def automaton(path: str) -> Automaton:
    """One automaton for each worker and vocabulary."""
    return Automaton(path)


@functools.cache
def _digits() -> list[str]:
    return [str(i) for i in range(1 << 16)]


class _Encode:
    """The ``text`` column of a batch replaced by _ids (binary, little-endian 16-bit numbers)."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches):
        encode = automaton(self.path).encode
        for batch in sliced(batches):
            at = batch.schema.names.index("text")
            ids = pa.array([encode(x.as_py()) for x in batch.column(at)], pa.binary())
            yield batch.set_column(at, "_ids", ids)


class _Decode:
    """_ids replaced by _decoded (binary), with _n_tokens and _ids_sha256."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches):
        decode, digits = automaton(self.path).decode, _digits().__getitem__
        for batch in sliced(batches):
            at = batch.schema.names.index("_ids")
            n, digest, decoded = [], [], []
            for raw in batch.column(at):
                ids = np.frombuffer(raw.as_py(), "<u2").tolist()
                n.append(len(ids))
                digest.append(hashlib.sha256(",".join(map(digits, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(decode(ids).decode("utf-8", "replace").encode()).hexdigest())
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [x for i, x in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())],
                names=[*names, "_n_tokens", "_ids_sha256", "_decoded_sha256"],
            )


class _Both:
    def __init__(self, first, second):
        self.first, self.second = first, second

    def __call__(self, batches):
        return self.second(self.first(batches))


def _replaced(df: DataFrame, name: str, *new: tuple[str, str]):
    from pyspark.sql.types import StructType

    schema = StructType([f for f in df.schema.fields if f.name != name])
    for n, kind in new:
        schema = schema.add(n, kind)
    return schema


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with its text replaced by _ids, little-endian 16-bit numbers (vocabularies here have under 65,536)."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    if "_ids" in docs.columns:
        raise ValueError("the table has a column _ids already")
    schema = StructType([StructField("_ids", BinaryType()) if f.name == "text" else f for f in docs.schema.fields])
    return docs.mapInArrow(_Encode(path), schema)


def decode_digests(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with _ids replaced by _n_tokens, _ids_sha256 and _decoded_sha256."""
    new = ("_n_tokens", "long"), ("_ids_sha256", "string"), ("_decoded_sha256", "string")
    return encoded.mapInArrow(_Decode(path), _replaced(encoded, "_ids", *new))


def op3(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    encode_, decode_ = _Encode(path), _Decode(path)
    own = docs.select("doc_id", "text")
    new = ("_n_tokens", "long"), ("_ids_sha256", "string"), ("_decoded_sha256", "string")
    out = own.mapInArrow(_Both(encode_, decode_), _replaced(own, "text", *new))  # one worker a task, not two
    return out.selectExpr(
        "doc_id", "_n_tokens as n_tokens", "_ids_sha256 as ids_sha256", "_decoded_sha256 as decoded_sha256"
    )
