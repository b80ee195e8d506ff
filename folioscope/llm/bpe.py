"""Operator 1: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The encoder's unit is a pre-token. White space behind a character that is none always opens one, so the stretches between such places
are encoded apart without changing the ids; stretches of ASCII and Latin letters are cut into their pre-tokens by the kinds of
their bytes, others stay whole. Each worker keeps the ids of the pieces it has met of late, and the library encodes the others.
"""

from __future__ import annotations

import base64
import functools
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, slices, strings, through


@functools.cache
def byte_to_char() -> dict[int, str]:
    """The byte table of byte-level BPE: printable Latin-1 bytes stand for themselves, the others for code points from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


@functools.cache
def char_to_byte() -> dict[str, int]:
    return {c: b for b, c in byte_to_char().items()}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merge into `token` when only lower ranks apply; None if they don't come down to two."""
    parts, limit = [bytes([b]) for b in token], ranks[token]
    while len(parts) > 2:
        rank, at = min(((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1)))
        if rank >= limit:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def from_ranks(path: str):
    """A tokenizers.Tokenizer that gives the ids of a tiktoken rank file: pieces of the public pattern, merges by rank, whole pieces first."""
    import public_tokenizers
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    text = {token: "".join(byte_to_char()[b] for b in token) for token in ranks}
    merges = [(text[m[0]], text[m[1]]) for token in sorted(ranks, key=ranks.get) if len(token) > 1 and (m := merge_of(token, ranks))]
    tokenizer = Tokenizer(models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer


@functools.lru_cache(maxsize=2)
def load(path: str):
    from tokenizers import Tokenizer

    return from_ranks(path) if path.endswith(".tiktoken") else Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def token_table(path: str) -> list[bytes]:
    """The bytes of each id: the vocabulary's strings through the reversed byte table; added tokens stand for their own text."""
    library = load(path)
    added = {i: t.content.encode() for i, t in library.get_added_tokens_decoder().items()}
    byte = char_to_byte()
    vocab = {i: bytes(map(byte.__getitem__, t)) for t, i in library.get_vocab(with_added_tokens=True).items() if i not in added} | added
    return [vocab.get(i, b"") for i in range(max(vocab, default=-1) + 1)]


#: The pattern of byte-level BPE, by which texts are cut into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Kinds of bytes: ASCII letters and two-byte letters up to U+017F, ASCII digits, ASCII marks but the apostrophe, space, line feed; all others; a text's end.
LETTER, DIGIT, MARK, SPACE, LINE, OTHER, END = range(7)
CALL_CHARS, CALL_BYTES, LONG_CHUNK = 50_000, 4_000_000, 64


@functools.cache
def kinds() -> np.ndarray:
    """The kind of each byte; that of bytes from 128 on depends on the byte before, too."""
    kind = np.full(256, OTHER, np.uint8)
    kind[33:127] = MARK
    kind[[*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5]] = LETTER
    kind[48:58] = DIGIT
    kind[[32, 10, 39]] = SPACE, LINE, OTHER
    return kind


@functools.cache
def edges() -> tuple[np.ndarray, np.ndarray]:
    """By 49 * kind before + 7 * kind + kind behind: whether a pre-token begins at a byte, if no byte of its stretch is of another kind; whether a stretch begins there.
    Stretches begin with white space behind letters, digits or marks: there a pre-token begins, whatever comes before or after.
    """
    prior, own, after = np.unravel_index(np.arange(343), (7, 7, 7))
    white, black = (own == SPACE) | (own == LINE), own < SPACE
    stretch = (prior == END) | (white & (prior < SPACE))
    # of a run of white space the last is a pre-token of its own or, if it is a space, part of the next one
    last = white & ((prior == SPACE) | (prior == LINE)) & (after != SPACE) & (after != LINE) & (after != END)
    return stretch | last | (black & ((prior == LINE) | ((prior < SPACE) & (prior != own)))), stretch


def by_bytes(library) -> bool:
    """Whether the library splits texts as byte-level BPE does, so that stretches may be encoded apart."""
    spec = json.loads(library.to_str())
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [spec["pre_tokenizer"]])
    last = steps[-1] or {}
    if spec["normalizer"] is not None or last.get("type") != "ByteLevel" or last["add_prefix_space"] or any(c.isspace() for t in spec["added_tokens"] for c in t["content"]):
        return False
    if last["use_regex"]:
        return len(steps) == 1
    return len(steps) == 2 and steps[0].get("type") == "Split" and steps[0]["pattern"] == {"Regex": PATTERN} and steps[0]["behavior"] == "Isolated" and not steps[0]["invert"]


class Encoder:
    """Ids of whole texts, as the library gives them. Texts are cut into pre-tokens by arithmetic on the kinds of bytes, stretches with bytes of other kinds or
    added tokens are left whole. Distinct pieces are encoded once: pre-tokens by the library's model, others by the whole library. One worker remembers the ids of
    `kept` pieces of up to LONG_CHUNK characters and of as many that it met before those; a piece that is met again is among the newer ones.
    Tokenizers of another kind get whole texts.
    """

    def __init__(self, path: str, kept: int = 200_000):
        self.library, self.kept, self.seen, self.older = load(path), kept, {}, {}
        self.model = self.library.model
        self.chunked = by_bytes(self.library)
        self.char = {i: "".join(byte_to_char()[b] for b in chr(i).encode()) for i in range(0x180)}
        added = [re.escape(t.content.encode()) for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile(b"|".join(added)) if added else None

    def _by_library(self, texts: list[str]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size < CALL_CHARS or end == at):
                size += len(texts[end]) + 1
                end += 1
            out += [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts[at:end], add_special_tokens=False)]
            at = end
        return out

    def _by_model(self, words: list[str]) -> list[bytes]:
        """The ids of pre-tokens, in the characters of the byte table."""
        tokenize, space, line, char = self.model.tokenize, self.char[32], self.char[10], self.char
        mapped = (w.replace(" ", space).replace("\n", line) if w.isascii() else w.translate(char) for w in words)
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in mapped]

    def _known(self, words: list[str], whole: list[bool]) -> list[bytes]:
        """The ids of distinct pieces; `whole` ones are no pre-tokens and go to the whole library."""
        if len(self.seen) > self.kept:
            self.seen, self.older = {}, self.seen
        found = list(map(self.seen.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        for i in missing:
            found[i] = self.older.get(words[i])
        new = [i for i in missing if found[i] is None]
        for learn, at in ((self._by_model, [i for i in new if not whole[i]]), (self._by_library, [i for i in new if whole[i]])):
            for i, x in zip(at, learn([words[i] for i in at])):
                found[i] = x
        self.seen.update((words[i], found[i]) for i in missing if len(words[i]) <= LONG_CHUNK)
        return found

    def _cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of texts begin, and the numbers of those that are no pre-tokens. `bounds`: where the texts, none of them empty, begin and the last one ends."""
        kind = kinds()[data]
        lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
        kind[lead + 1] = LETTER
        sign = lead[(data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7))]  # times and division signs
        kind[sign] = kind[sign + 1] = OTHER
        if self.added:
            for found in self.added.finditer(data):
                kind[slice(*found.span())] = OTHER
        prior, after = np.full(len(data), END, np.uint16), np.full(len(data), END, np.uint16)
        prior[1:], after[:-1] = kind[:-1], kind[1:]
        prior[bounds[:-1]] = after[bounds[1:] - 1] = END
        code = prior * 49 + kind * np.uint16(7) + after
        piece, stretch = (np.flatnonzero(x[code]) for x in edges())
        odd = np.flatnonzero(kind == OTHER)
        odd = np.unique(np.searchsorted(stretch, odd, "right")) - 1
        first = np.searchsorted(piece, stretch[odd])
        inner = np.zeros(len(piece) + 1, np.int32)
        inner[first + 1] += 1
        inner[np.searchsorted(piece, np.append(stretch, len(data))[odd + 1])] -= 1
        inside = np.cumsum(inner[:-1])
        return piece[inside == 0], first - np.cumsum(inside)[first]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self.chunked or not texts:
            return [np.frombuffer(x, np.uint32) for x in self._by_library(texts)]
        column = pa.array(texts, pa.large_string())
        bounds = np.frombuffer(column.buffers()[1], np.int64)[: len(texts) + 1]
        if bounds[-1] == 0:
            return [np.zeros(0, np.uint32)] * len(texts)
        at, odd = self._cut(np.frombuffer(column.buffers()[2], np.uint8)[: bounds[-1]], np.unique(bounds))
        pieces = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, bounds[-1])), column.buffers()[2])
        coded = pieces.dictionary_encode()
        code = coded.indices.to_numpy()
        whole = pc.greater(pc.binary_length(coded.dictionary), LONG_CHUNK).to_numpy(zero_copy_only=False).copy()
        whole[code[odd]] = True
        parts = self._known(coded.dictionary.to_pylist(), whole.tolist())
        # the ids of distinct pieces are laid one after the other and gathered
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, start = np.frombuffer(b"".join(parts), np.uint32), np.cumsum(size) - size
        each = size[code]
        end = np.cumsum(each)
        out = flat[np.repeat(start[code] - end + each, each) + np.arange(end[-1])]
        ends = np.concatenate([[0], end])[np.searchsorted(at, bounds)]
        return [out[s:e] for s, e in zip(ends, ends[1:])]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def char_offsets(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens from their byte sizes: from the character of a token's first byte to behind that of its last."""
    data = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes[ids])
    return char[ends - sizes[ids]].astype(np.int32), (char[ends - 1] + 1).astype(np.int32)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)).cast(kind))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", offsets: bool = False) -> DataFrame:
    """`df` without its text, with the token ids of each whole text as array<int> and, if asked for, arrays of the
    tokens' start and end characters. A null or empty text has no ids; a text of any length is encoded whole. Other columns
    stay; columns named as the new ones are replaced. Ids come from the file at `path` (.json or .tiktoken).
    """
    added = [ids, *([f"{ids}_start", f"{ids}_end"] if offsets else [])]
    kept = [c for c in df.columns if c != text and c not in added]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        sizes = np.array([len(t) for t in token_table(path)], np.int64)
        for batch in slices(batches, text, CALL_BYTES):
            texts = strings(batch.column(text))
            found = own.ids(texts)
            arrays = [batch.column(c) for c in kept] + [lists(found, pa.int32())]
            if offsets:
                spans = [char_offsets(t, x, sizes) if len(x) else (np.zeros(0, np.int32),) * 2 for t, x in zip(texts, found)]
                arrays += [lists([s[k] for s in spans], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, *added])

    return through(df.select(*map(named, kept), named(text)), run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """`df` with the bytes of each row's ids. Bytes are exact also where a cut of the ids splits a character; use
    `readable` for text. Null or no ids give no bytes; an id outside the table, a negative one too, fails the task. The ids stay.
    """
    kept = [c for c in df.columns if c != data]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(data, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = token_table(path).__getitem__
        for batch in batches:
            column = batch.column(ids)
            flat, bounds = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum([n or 0 for n in pc.list_value_length(column).to_pylist()])])
            if len(flat) and flat.min() < 0:
                raise IndexError(f"negative token id {flat.min()}")
            rows = [b"".join(map(token, flat[s:e].tolist())) for s, e in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(rows, pa.binary())], [*kept, data])

    return through(df.select(*map(named, kept)), run, schema)


def readable(parts: list[bytes]) -> list[str]:
    """Texts of successive byte runs: a character split between runs appears whole in the run that completes it; bytes that are no UTF-8 become U+FFFD."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    return [decoder.decode(p, final=i == len(parts) - 1) for i, p in enumerate(parts)]


def digests(df: DataFrame, path: str) -> DataFrame:
    """The result of op1: encode with offsets, decode, and digests of both; n_split counts the tokens that begin inside a character."""
    coded = decode(encode(df.select("doc_id", "text"), path, offsets=True), path)
    inside = F.size(F.filter("ids_start", lambda s, i: (i > 0) & (F.get("ids_end", i - 1) > s))).cast("long")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), inside.alias("n_split"))
