"""Best-fit packing of tokenized documents into sequences of bounded length.

**Tokens.** A document's ids are those of the given tokenizer file followed by
an end id.  The tokenizer splits at white space before anything else, so a text
is encoded word by word and each task remembers the words, and the parts of
words between the tokenizer's own cuts, that it has seen (a bounded memory that
is emptied when full; it changes no id).  A document longer
than the capacity is cut into pieces of the capacity, the last one shorter.

**Vector best fit.** A piece demands (tokens, one document, tokens squared as
attention cost); a sequence offers a capacity for each.  Pieces are taken by
falling token count; among the open sequences in which all three demands fit,
the chosen one has either the smallest weighted norm of what would stay free
(``rule="norm"``) or the largest weighted dot product of demand and free
capacity (``rule="dot"``); if none fits, a sequence is opened.

**Scale.** Token ids never leave the task: only (length, checksum) rows move.
Pieces are numbered in a checkpoint and dealt evenly into shards of about
``shard_rows`` pieces, each packed in one task, so a shard's size depends on
neither ids nor texts and the number of tasks follows the input.  Packing per
shard wastes less than one sequence per shard (about 1 in 1,000).

Defined results: null or empty text is the end id alone; repeated rows are
packed each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep.llm.common import cut_lineage, texts

CAPACITY = 4096
END_ID = 1
SHARD_ROWS = 8192
REMEMBERED_WORDS = 1_000_000
LONG_WORD = 64

# fixed values: the tokenizer file's splitting pattern, and the same for words of PLAIN_WORD
FILE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_WORD = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PLAIN_SPLIT = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

_state: dict = {}


class WordEncoder:
    """Ids of whole texts, as little-endian 32-bit bytes, word by word."""

    def __init__(self, tokenizer_path: str, remembered: int = REMEMBERED_WORDS):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.bytes_as_chars = ByteLevel(add_prefix_space=False, use_regex=False)
        with open(tokenizer_path, encoding="utf-8") as f:
            head = json.loads(f.read())
        steps = [x.get("pattern", {}).get("Regex") for x in (head.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.splits_plainly = FILE_SPLIT in steps and [
            x["type"] for x in (head.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.remembered = remembered

    def _whole(self, words: list[bytes]) -> list[bytes]:
        """Each word through the whole tokenizer."""
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def _part(self, part: str) -> bytes:
        """A lower-case part as the tokenizer's own splitter yields it, through its model."""
        if not part.isascii():
            part = self.bytes_as_chars.pre_tokenize_str(part)[0][0]
        return np.array([t.id for t in self.tokenizer.model.tokenize(part)], "<u4").tobytes()

    def _plain(self, word: str) -> bytes:
        """A word of ASCII and Latin-1 letters: lower-casing and splitting need no
        more than the file's own pattern, and equal parts are encoded once."""
        out = []
        for part in PLAIN_SPLIT.findall(word.lower()):
            ids = self.parts.get(part)
            if ids is None:
                ids = self._part(part)
                if len(part) <= LONG_WORD:
                    self.parts[part] = ids
            out.append(ids)
        return b"".join(out)

    def ids(self, text: str) -> bytes:
        words = text.encode("utf-8").split()
        known = self.known
        if len(known) + len(self.parts) > self.remembered:
            known.clear()
            self.parts.clear()
        new = [w for w in set(words) if w not in known]
        other = []
        for w in new:
            s = w.decode("utf-8")
            if self.splits_plainly and PLAIN_WORD.fullmatch(s) and "<|" not in s:
                known[w] = self._plain(s)
            else:
                other.append(w)
        for i in range(0, len(other), 4096):
            part = other[i:i + 4096]
            known.update(zip(part, self._whole(part)))
        out = b"".join([known[w] for w in words])
        for w in new:
            if len(w) > LONG_WORD:
                del known[w]
        return out


def _encoder(path: str) -> WordEncoder:
    if path not in _state:
        _state[path] = WordEncoder(path)
    return _state[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(tokenizer_path)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                raw = enc.ids(text) + end
                for no, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at:at + 4 * capacity]
                    rows.append((doc, no, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            if b["doc_id"].isna().any():
                out["doc_id"] = out["doc_id"].astype("Int64")
            yield out
    return texts(docs, id_col, text_col).mapInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_attention: int,
             weights=(1.0, 1e-3, 1e-3), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of each length; deterministic."""
    n = len(lengths)
    limit = np.array([capacity, max_docs, max_attention], float)
    w = np.asarray(weights, float)
    order = np.argsort(-lengths, kind="stable")
    seq, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    free = np.empty((64, 3))
    ids = np.empty(64, np.int64)
    used = opened = 0
    smallest = int(lengths.min()) if n else 0
    for k, i in enumerate(order):
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        here = free[:used]
        fits = np.nonzero((here >= need).all(axis=1))[0]
        if len(fits):
            if rule == "norm":
                rest = (here[fits] - need) / limit
                pick = fits[np.argmin((rest * rest) @ w)]
            else:
                pick = fits[np.argmax((here[fits] / limit * (need / limit)) @ w)]
        else:
            if used == len(ids):
                free, ids = np.concatenate([free, np.empty_like(free)]), np.concatenate([ids, np.empty_like(ids)])
            pick, used = used, used + 1
            free[pick], ids[pick], opened = limit, opened, opened + 1
        seq[i], offset[i] = ids[pick], capacity - free[pick, 0]
        free[pick] -= need
        if free[pick, 0] < smallest or free[pick, 1] < 1:       # nothing fits any more
            used -= 1
            free[pick], ids[pick] = free[used], ids[used]
    return seq, offset


def shard(shards: int) -> Column:
    """A shard for every row of a stored frame, even for any number and size of partitions (row
    numbers themselves start at multiples of a power of two in each partition)."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))


def pack(rows: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None,
         max_attention: int | None = None, shard_rows: int = SHARD_ROWS, rule: str = "norm") -> DataFrame:
    """``rows`` (with ``length`` of at most ``capacity``) plus sequence_id and offset."""
    docs_cap, att_cap = max_docs or capacity, max_attention or capacity * capacity
    if att_cap < capacity * capacity:
        raise ValueError("max_attention must allow one piece of the full capacity")
    rows = cut_lineage(rows)
    shards = max(1, -(-rows.count() // shard_rows))
    numbered = rows.withColumn("_shard", shard(shards))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        seq, offset = best_fit(b["length"].to_numpy(np.int64), capacity, docs_cap, att_cap, rule=rule)
        return (b.drop(columns="_shard")
                .assign(sequence_id=b["_shard"].to_numpy(np.int64) * (1 << 24) + seq, offset=offset))
    return numbered.groupBy("_shard").applyInPandas(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   **limits) -> DataFrame:
    """Pieces of all documents with their place: sequence_id and offset."""
    return pack(pieces(docs, tokenizer_path, capacity, end_id), capacity, **limits)
