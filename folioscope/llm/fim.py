"""Operator 12: fill-in-the-middle with cuts between units, found in 64-bit words.

A batch of texts is laid out as UTF-8 in one buffer, each text padded with spaces to whole words, and viewed as uint64.
Arithmetic on the words marks white space, the bytes that end a unit, and the bytes that continue a character, all in the
highest bit of each byte. bitwise_count gives the marks of a word, and their running sum is searched for the word that holds
the k-th end of a text; the mark inside that word is found by clearing the lower ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, slices, strings, through

HIGH, LOW7 = np.uint64(0x8080808080808080), np.uint64(0x7F7F7F7F7F7F7F7F)
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def at_least(words: np.ndarray, value: int) -> np.ndarray:
    """The highest bit of each byte whose other seven bits are `value` or more; no sum leaves its byte."""
    return (words & LOW7) + np.uint64((0x80 - value) * 0x0101010101010101)


def spaces(words: np.ndarray) -> np.ndarray:
    """The highest bit of each byte that is a space or one of the bytes 9 to 13."""
    control = at_least(words, 9) & ~at_least(words, 14)
    blank = at_least(words, 32) & ~at_least(words, 33)
    return (control | blank) & ~words & HIGH


class Units:
    """Where the units of texts end. A unit is white space, perhaps none, with what follows up to the next white space, or the white
    space that ends a text. Takes some forty bytes for each eight of the texts.
    """

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        n_words = self.sizes // 8 + 1  # one byte of padding at least, so that a space is behind every last byte
        self.first = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
        words = np.frombuffer(b"".join(t + b" " * (int(n) * 8 - len(t)) for t, n in zip(texts, n_words)), "<u8")
        blank = spaces(words)
        behind = blank >> np.uint64(8)
        behind[:-1] |= (blank[1:] & np.uint64(0x80)) << np.uint64(56)
        ends = ~blank & behind & HIGH
        last = self.sizes - 1
        at, bit = self.first[:-1] + last // 8, np.uint64(0x80) << (np.uint64(8) * (last % 8).astype(np.uint64))
        np.bitwise_or.at(ends, at[last >= 0], bit[last >= 0])  # white space at the end of a text is a unit too
        self.ends, self.continues = ends, words & ~(words << np.uint64(1)) & HIGH
        self.n_ends = np.concatenate([[0], np.cumsum(np.bitwise_count(ends), dtype=np.int64)])
        self.n_continues = np.concatenate([[0], np.cumsum(np.bitwise_count(self.continues), dtype=np.int64)])
        self.counts = np.diff(self.n_ends[self.first])

    def cut(self, k: np.ndarray) -> np.ndarray:
        """The byte behind the k-th unit of each text, 0 for the 0th."""
        target = self.n_ends[self.first[:-1]] + k
        word = np.maximum(np.searchsorted(self.n_ends, target, side="left") - 1, 0)
        marks, before = self.ends[word].copy(), target - self.n_ends[word]
        for done in range(1, 8):
            marks = np.where(before > done, marks & (marks - np.uint64(1)), marks)
        byte = np.bitwise_count((marks & (~marks + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8
        return np.where(k > 0, (word - self.first[:-1]) * 8 + byte + 1, 0)

    def characters(self, cut: np.ndarray) -> np.ndarray:
        """The characters in the first `cut` bytes of each text."""
        word, byte = self.first[:-1] + cut // 8, (cut % 8).astype(np.uint64)
        below = (np.uint64(1) << (np.uint64(8) * byte)) - np.uint64(1)
        return cut - (self.n_continues[word] - self.n_continues[self.first[:-1]] + np.bitwise_count(self.continues[word] & below).astype(np.int64))


def draws(ids: list, seed: int) -> np.ndarray:
    """Four numbers of 32 bits of each id: the first groups of the SHA-256 of `seed:id`; a null id counts as an empty one."""
    found = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids]
    return np.frombuffer(b"".join(found), ">u4").reshape(-1, 4).astype(np.int64)


def rearranged(ids: list, texts: list[str], seed: int, percent: int, spm_percent: int) -> dict[str, list]:
    data = [t.encode() for t in texts]
    units = Units(data)
    h1, h2, h3, h4 = draws(ids, seed).T
    n = units.counts
    k1, k2 = h1 % (n + 1), h2 % (n + 1)
    a, b = units.cut(np.minimum(k1, k2)), units.cut(np.maximum(k1, k2))
    in_prefix = units.characters(a)
    in_middle = units.characters(b) - in_prefix
    marked = np.array([not t or PREFIX in t or SUFFIX in t or MIDDLE in t for t in texts], bool)
    form = np.where(marked | (h3 % 100 >= percent), "plain", np.where(h4 % 100 < spm_percent, "spm", "psm")).tolist()
    out = []
    for text, raw, kind, i, j in zip(texts, data, form, a.tolist(), b.tolist()):
        if kind == "plain":
            out.append(text)
            continue
        prefix, middle, suffix = raw[:i].decode(), raw[i:j].decode(), raw[j:].decode()
        out.append(f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if kind == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    shown = [kind != "plain" for kind in form]
    return {
        "fim": out, "n": n.tolist(), "form": form,
        "prefix_chars": [x if s else None for x, s in zip(in_prefix.tolist(), shown)], "middle_chars": [x if s else None for x, s in zip(in_middle.tolist(), shown)],
    }


ADDED = [T.StructField(c, T.StringType() if c in ("fim", "form") else T.LongType()) for c in ("fim", "n", "form", "prefix_chars", "middle_chars")]


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """`df` without its text, with `fim` (the text in its form), `n` (units of the text), `form` and the characters of prefix and middle
    (null if plain). `percent` of 100 documents are rearranged, `spm_percent` of 100 of these with the suffix first; where and
    whether depends on the key and `seed` alone, so that equal rows, and runs, agree. A null text counts as empty and an empty
    text, like one that holds one of the three marks, stays plain; a null key counts as an empty one. Texts of any length are cut whole, in one
    task each. Other columns stay, whatever their names; those named like the new ones are replaced. No row is shuffled.
    """
    new = [f.name for f in ADDED]
    kept = [c for c in df.columns if c != text and c not in new]
    id_at = next((i for i, c in enumerate(kept) if c == key), None)
    if id_at is None:
        raise ValueError(f"the key {key} is missing, or one of {new}")
    schema = T.StructType([df.schema[c] for c in kept] + ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        for batch in slices(batches, text):
            found = rearranged(batch.column(id_at).to_pylist(), strings(batch.column(len(kept))), seed, percent, spm_percent)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(found[c], t) for c, t in zip(new, types))], [*kept, *new])

    return through(df.select(*map(named, kept), named(text)), run, schema)


def restored(fim: Column, form: Column) -> Column:
    """The text that a form was made from. No text that was rearranged holds a mark, and none can arise where a mark meets text."""
    body = F.substring(fim, F.lit(len(PREFIX) + 1), F.length(fim))
    psm, spm = F.split(body, f"{SUFFIX}|{MIDDLE}", 3), F.split(body, f"{PREFIX}|{MIDDLE}", 3)
    return F.when(form == "psm", F.concat(F.get(psm, F.lit(0)), F.get(psm, F.lit(2)), F.get(psm, F.lit(1)))).when(form == "spm", F.concat(F.get(spm, F.lit(1)), F.get(spm, F.lit(2)), F.get(spm, F.lit(0)))).otherwise(fim)


def digests(df: DataFrame) -> DataFrame:
    """The result of op12: counts of each document, and digests of its form and of the text restored from it."""
    made = fill_in_middle(df.select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("fim", 256).alias("output_sha256"), F.sha2(restored(F.col("fim"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS k1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS k2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM units
), parts AS (
  SELECT doc_id, text, n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(k1, k2)], '') AS p, array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], '') AS m, array_to_string(u[greatest(k1, k2) + 1:], '') AS s
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
