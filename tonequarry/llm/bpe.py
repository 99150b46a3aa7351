"""Byte-pair encoding by forced boundaries, and decoding.

Two neighbouring bytes that no vocabulary token holds side by side can never be merged, so a cut between them is
certain. White space is in no token, so the first cuts fall there; the vocabulary's own split pattern gives the next;
within a piece every byte pair that is in no token gives more. The fragments are merged independently, remembered in
bounded caches, and their ids are concatenated. Ids equal those of the tokenizers library for the same file.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.models import BPE

from tonequarry.llm.common import KEPT, narrow_batches, tidy

#: Entries that each cache of a worker may hold; a full cache starts anew.
CACHE_ENTRIES = 400_000
#: Longer pieces are encoded without being remembered.
CACHED_LENGTH = 48


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


#: Finds what the pattern for Latin texts can't judge.
BEYOND_LATIN = re.compile("[^\0-\u024f]")


def latin_pattern() -> re.Pattern:
    """The split pattern over code points up to U+024F, spelt out: the standard library's matcher is twice as fast."""
    of = {k: "".join(map(re.escape, (chr(i) for i in range(0x250) if unicodedata.category(chr(i))[0] == k))) for k in "LN"}
    space = "\t-\r \x85\xa0"
    return re.compile(f"[{of['L']}]+|[{of['N']}]|'(?:s|t|re|ve|m|ll|d)|[^{space}{of['L']}{of['N']}]+")


@functools.cache
def unassigned(letter: str) -> bool:
    """Whether this Python's tables don't know a code point; the library's tables may be of another version."""
    return unicodedata.category(letter) == "Cn"


class _Memo(dict):
    """A cache that computes what it lacks. When half of ``limit`` is full, the entries not used since the last time go."""

    def __init__(self, compute, limit: int, longest: int):
        super().__init__()
        self.compute, self.half, self.longest, self.old = compute, limit // 2, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Bpe:
    """A word-end byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this form of vocabulary isn't supported")
        self.end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(sorted(map(regex.escape, self.special), key=len, reverse=True)))
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if split != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            raise ValueError("this split pattern isn't supported")
        #: The same alternatives, the commonest first: no two of those moved can start at the same letter.
        self.pattern = regex.compile(r"\p{L}+|\p{N}|'(?:s|t|re|ve|m|ll|d)|[^\p{White_Space}\p{L}\p{N}]+")
        self.latin = latin_pattern()
        self.letters = byte_letters()
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        #: The merge loop alone, for fragments that end a word and for those that don't.
        self.closing = BPE(vocab, merges, cache_capacity=0, end_of_word_suffix=self.end)
        self.inner = BPE(vocab, merges, cache_capacity=0)
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        #: The byte pairs that some token holds side by side; any other pair is a certain cut.
        self.pairs = {t[i : i + 2] for t in (v.removesuffix(self.end) for v in vocab) for i in range(len(t) - 1)}
        self.fragments = _Memo(self._fragment, entries // 8, CACHED_LENGTH)
        self.pieces = _Memo(self._piece, entries, CACHED_LENGTH)

    @functools.cached_property
    def library(self) -> Tokenizer:
        """Normalises and splits the texts that hold a code point of ``unassigned``; most workers never load it."""
        return Tokenizer.from_file(self.path)

    @functools.cached_property
    def decimals(self) -> list[str]:
        return [str(i) for i in range(len(self.tokens))]

    def _fragment(self, fragment: str) -> bytes:
        """Ids of what lies between two cuts; a word's last fragment carries the word-end mark."""
        if fragment.endswith(self.end) and len(fragment) > len(self.end):
            return array("I", [t.id for t in self.closing.tokenize(fragment.removesuffix(self.end))]).tobytes()
        return array("I", [t.id for t in self.inner.tokenize(fragment)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            mapped = piece
        else:
            letters = self.letters
            mapped = "".join([letters[b] for b in piece.encode()])
        return self._mapped(mapped)

    def _mapped(self, mapped: str) -> bytes:
        """A piece whose bytes are letters already, cut where no token holds the neighbours."""
        if self.pairs.issuperset(map("".join, zip(mapped, mapped[1:], strict=False))):
            return array("I", [t.id for t in self.closing.tokenize(mapped)]).tobytes()
        cuts = [0, *(i for i in range(1, len(mapped)) if mapped[i - 1 : i + 1] not in self.pairs)]
        fragments = [mapped[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] + [mapped[cuts[-1] :] + self.end]
        return b"".join(map(self.fragments.__getitem__, fragments))

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            if any(map(unassigned, set(BEYOND_LATIN.findall(text)))):
                pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
                return b"".join([self._mapped(p) for p, _ in pieces])
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")  # the library lower-cases letter by letter: no final sigma
        text = text.lower()
        return b"".join(map(self.pieces.__getitem__, (self.pattern if BEYOND_LATIN.search(text) else self.latin).findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers in the machine's order; special tokens' strings in the text give their ids."""
        if "<|" not in text or not self.special_pattern.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [self._plain(text[at : m.start()]), array("I", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by spaces: this vocabulary names no decoder; special tokens are kept."""
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def bpe(path: str, entries: int = CACHE_ENTRIES) -> Bpe:
    """One for each worker process, file and size of its caches."""
    return Bpe(path, entries)


KEPT["bpe"] = bpe.cache_clear


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` of whole texts; a null text is empty, and an empty one has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(bpe(path).encode(t or ""), "u4").astype("i4") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return narrow_batches(narrow).mapInArrow(tidy(run, "bpe"), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` of ``encode_documents``' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [bpe(path).decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run, "bpe"), "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document encoded, and decoded from those ids, in one narrow pass without a shuffle.

    ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``; nulls and empty texts have no tokens and the empty string's
    digests; repeated rows give repeated rows; an empty table gives none; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        decimals = coder.decimals.__getitem__
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for text in batch.column(1):
                ids = np.frombuffer(coder.encode(text.as_py() or ""), "u4").tolist()
                counts.append(len(ids))
                encoded.append(hashlib.sha256(" ".join(map(decimals, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return narrow_batches(narrow).mapInArrow(tidy(run, "bpe"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
