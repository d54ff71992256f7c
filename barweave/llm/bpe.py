"""Byte-pair encoding and decoding with a token automaton.

The automaton reads tokens and accepts exactly the sequences that the merge list produces. It starts as one state with a
loop per byte. The gadget of a merge (u, v), taken in order of priority, redirects every u-arc to a copy of its target
that lacks the v-arc, and lays an arc uv beside each path u v. All arcs with the same label lead to the same state, so a
state is named by the last token: it is the snapshot of another state (that of the token's right part, at the token's
birth) less the arcs its own gadgets took away. Kept this way the automaton has one record per merge; the rows of the
transition table are filled in as words need them.

Every prefix of a word has exactly one accepted sequence, so each position of a word is reached in at most one state.
Encoding walks the table from the start state, longest label first, and steps back from a position that leads nowhere;
no position is entered twice. Decoding emits the label of each arc.

Defined cases: a null text counts as empty and gives no tokens; the special token's string in a text is that token;
texts of any length are read whole. Repeated rows stay; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from barweave.llm.common import table, whole_texts

# fixed value: the pattern that splits a text into words
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# the same words for texts of ASCII and Latin letters, which the standard library finds faster
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\t-\r {LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
CACHED_WORDS = 500_000  # words a worker remembers; the cache is emptied beyond it
CACHED_LENGTH = 64


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class MergeAutomaton:
    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        """labels: bytes of each token id; merges: (left, right, merged) token ids in order of priority."""
        self.labels = labels
        self.born = [-1] * len(labels)
        self.parts: list[tuple[int, int]] = [(-1, -1)] * len(labels)
        self.cut: dict[tuple[int, int], int] = {}
        for step, (left, right, merged) in enumerate(merges):
            self._gadget(step, left, right, merged)
        # each label's token, and -1 for a string that only begins labels
        self.trie = {label[:n]: -1 for label in labels for n in range(1, len(label))}
        self.trie.update((label, i) for i, label in enumerate(labels) if label)
        self.table: dict[tuple[int, int], bool] = {}

    def _gadget(self, step: int, left: int, right: int, merged: int) -> None:
        self.cut[left, right] = step
        self.born[merged] = step
        self.parts[merged] = (left, right)

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the state after one token has an arc for another: read off the gadgets, last to first."""
        born, now = self.born, len(self.cut)
        while True:
            if self.cut.get((state, token), now) < now:
                return False
            if born[state] > born[token]:  # the state was copied from that of its right part, before this step
                now, state = born[state], self.parts[state][1]
            elif born[token] >= 0:  # the arc was laid where the arc of its left part was, after that step's cut
                now, token = born[token] + 1, self.parts[token][0]
            else:
                return True

    def arc(self, state: int, token: int) -> bool:
        found = self.table.get((state, token))
        if found is None:
            found = self.table[state, token] = state < 0 or self.has_arc(state, token)
        return found

    def encode(self, word: bytes) -> list[int]:
        size, trie, table = len(word), self.trie.get, self.table.get
        state, at, seen = -1, 0, {0}
        path: list[int] = []
        pending: list[list[tuple[int, int]]] = []
        while True:
            choices = []
            end = at + 1
            token = trie(word[at:end])
            while token is not None:
                if token >= 0:
                    choices.append((end, token))
                if end == size:
                    break
                end += 1
                token = trie(word[at:end])
            while True:
                if choices:
                    end, token = choices.pop()
                    if end in seen:
                        continue
                    found = table((state, token))
                    if found or (found is None and self.arc(state, token)):
                        break
                else:  # a dead end: take the last token back
                    choices = pending.pop()
                    path.pop()
                    state = path[-1] if path else -1
            path.append(token)
            if end == size:
                return path
            pending.append(choices)
            seen.add(end)
            state, at = token, end


class Codec:
    """Encodes and decodes whole texts with a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parsed = json.load(file)
        letters, vocab = byte_letters(), parsed["model"]["vocab"]
        labels = [b""] * (max([*vocab.values(), *(t["id"] for t in parsed["added_tokens"])]) + 1)
        for text, i in vocab.items():
            labels[i] = bytes(letters[c] for c in text)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in parsed["model"]["merges"])
        self.automaton = MergeAutomaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.emit = list(labels)
        for text, i in self.special.items():
            self.emit[i] = text.encode()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.find_any = regex.compile(WORD_PATTERN).findall
        self.find_latin = re.compile(LATIN_PATTERN).findall
        self.beyond_latin = re.compile(rf"[^\x00-\x7f{LATIN}]").search
        self.words = _Words(self.automaton)

    def find_words(self, text: str) -> list[str]:
        return self.find_any(text) if self.beyond_latin(text) else self.find_latin(text)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        parts = self.split_special.split(text) if self.split_special else [text]
        packed = []
        for i, part in enumerate(parts):
            if i % 2:
                packed.append(struct.pack("<I", self.special[part]))
            elif part:
                packed.extend(map(self.words.__getitem__, self.find_words(part)))
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        if len(self.automaton.table) > 4 * CACHED_WORDS:
            self.automaton.table.clear()
        return b"".join(packed)

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.emit.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


class _Words(dict):
    """word -> packed ids; long words are not kept."""

    def __init__(self, automaton: MergeAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        ids = self.automaton.encode(word.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= CACHED_LENGTH:
            self[word] = packed
        return packed


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of (doc_id, text); ids are packed as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path).encode
        for batch in batches:
            ids = [encode(text.as_py() or "") for text in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], schema=SCHEMA)

    return whole_texts(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for batch in batches:
            texts = [decode(ids.as_py() or b"") for ids in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of (doc_id, text), in one pass: ids leave no task."""

    def digest(doc_id: int | None, ids: bytes, coder: Codec) -> tuple:
        decoded = coder.decode(ids).encode()
        return doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            texts = (text.as_py() or "" for text in batch.column(1))
            rows = [digest(i, coder.encode(text), coder) for i, text in zip(batch.column(0).to_pylist(), texts, strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, DIGESTS, strict=True)], schema=DIGESTS)

    return whole_texts(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
