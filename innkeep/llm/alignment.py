"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

**Tokens.** A is a byte-level BPE (a ``tokenizers`` file; its merges are in the order of
their ids, which is checked, so ``tiktoken`` can run them), B a ``sentencepiece`` model that puts
a space before the text.  Both are read over space + text, whole texts at a time.

**Alignment.** Token starts are byte offsets.  ``pandas.merge_asof``, keyed by
document, finds for each start of one side the token of the other side that
covers it; a pair of tokens overlaps if the later of the two starts lies in the
other token, so both directions together (equal starts once) are all
overlaps.  A start that both sides share begins a group; groups end where both
sides end.

**Corpus counts.** An id pair's count is the number of links that hold it in all
documents.  Links leave a task summed up by document and pair; pair counts are partial sums
before the shuffle.  To give each link its pair's count, the ``FREQUENT`` pairs
of highest count are broadcast (a bound on rows, so a proven size) and the
links of all other pairs are joined; no pair of those is frequent enough to be a hot key.

Memory in a task is bounded by ``SLICE`` bytes of text, or by one text where
that is longer.

Defined results: texts that are null or empty, or that a tokenizer does not give back byte
for byte (those with U+2581 in B), have no tokens: all numbers 0 and
no groups.  Repeated rows and ids are reported and counted each; a null id
stays null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.llm.common import cut_lineage, ensure_checkpoint_dir, texts

FREQUENT = 500_000
SLICE = 1 << 20

# fixed value: how the byte-level file splits a text before merging
A_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
_state: dict = {}


def byte_characters() -> dict[str, int]:
    """The characters that byte-level BPE files write for bytes: printable bytes stand
    for themselves, the others, in order, for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class TokenizerPair:
    """Ids of both tokenizers over space + text, and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        as_byte = byte_characters()
        self.a_bytes = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in model["vocab"].items():
            self.a_bytes[i] = bytes(as_byte[c] for c in token)
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("merges that are not in the order of their ids")
        self.a = tiktoken.Encoding("a", pat_str=A_SPLIT, special_tokens={},
                                   mergeable_ranks={x: i for i, x in enumerate(self.a_bytes)})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = []
        for piece in map(self.b.id_to_piece, range(len(self.b))):
            byte = _BYTE_PIECE.fullmatch(piece)
            self.b_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        self.a_length = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)

    def ids(self, some: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids of A, ids of B) of each text; none if a tokenizer does not give the text back."""
        out = []
        for text, y in zip(some, self.b.encode(list(some), num_threads=1)):
            x, whole = self.a.encode_ordinary(" " + text) if text else [], (" " + text).encode()
            if b"".join([self.a_bytes[i] for i in x]) != whole or b"".join([self.b_bytes[i] for i in y]) != whole:
                x, y = [], []
            out.append((np.array(x, np.int32), np.array(y, np.int32)))
        return out


def _pair(a_path: str, b_path: str) -> TokenizerPair:
    if (a_path, b_path) not in _state:
        _state[a_path, b_path] = TokenizerPair(a_path, b_path)
    return _state[a_path, b_path]


def overlaps(a_doc: np.ndarray, a_start: np.ndarray, b_doc: np.ndarray, b_start: np.ndarray):
    """Of tokens in order (document numbers, and starts that rise over all documents):
    (index of A, index of B) of every overlapping pair, and for the tokens of each side
    whether a group begins there."""
    a = pd.DataFrame({"doc": a_doc, "at": a_start, "a": np.arange(len(a_start))})
    b = pd.DataFrame({"doc": b_doc, "at": b_start, "b": np.arange(len(b_start))})
    covering_b = pd.merge_asof(a, b, on="at", by="doc")["b"].to_numpy(np.int64)
    covering_a = pd.merge_asof(b, a, on="at", by="doc")["a"].to_numpy(np.int64)
    first_a = b_start[covering_b] == a_start
    first_b = a_start[covering_a] == b_start
    later = ~first_b
    return (np.concatenate([a["a"].to_numpy(), covering_a[later]]),
            np.concatenate([covering_b, b["b"].to_numpy()[later]]), first_a, first_b)


class _Names:
    """Ids as decimal text with the mark that follows them in a group line."""

    def __init__(self, a_size: int, b_size: int):
        self.shift = 2 * a_size
        self.text = [f"{i}{s}" for i in range(a_size) for s in ",|"] + [f"{i}{s}" for i in range(b_size) for s in ",;"]

    def lines(self, a_ids, b_ids, first_a, first_b, cuts: np.ndarray) -> list[str]:
        """The groups of each document; ``cuts``: where its tokens (both sides) begin."""
        begin_a, begin_b = np.append(np.nonzero(first_a)[0], len(a_ids)), np.append(np.nonzero(first_b)[0], len(b_ids))
        group_a, group_b = np.cumsum(first_a) - 1, np.cumsum(first_b) - 1
        i, j = np.arange(len(a_ids)), np.arange(len(b_ids))
        codes = np.empty(len(a_ids) + len(b_ids), np.int64)
        codes[i + begin_b[group_a]] = 2 * a_ids.astype(np.int64) + (i + 1 == begin_a[group_a + 1])
        codes[j + begin_a[group_b + 1]] = self.shift + 2 * b_ids.astype(np.int64) + (j + 1 == begin_b[group_b + 1])
        codes, text = codes.tolist(), self.text
        return ["".join([text[c] for c in codes[x:y]])[:-1] for x, y in zip(cuts, cuts[1:])]


def _align_slice(pair: TokenizerPair, names: _Names, ids: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, list]:
    """The columns of ``align`` for some documents."""
    n_a, n_b = np.array([len(x) for x, _ in ids]), np.array([len(y) for _, y in ids])
    a, b = np.concatenate([x for x, _ in ids]), np.concatenate([y for _, y in ids])
    doc = np.arange(len(ids))
    a_doc, b_doc = np.repeat(doc, n_a), np.repeat(doc, n_b)
    length_a, length_b = pair.a_length[a], pair.b_length[b]
    at_a, at_b, first_a, first_b = overlaps(a_doc, np.cumsum(length_a) - length_a, b_doc, np.cumsum(length_b) - length_b)
    cuts = np.concatenate([[0], np.cumsum(n_a + n_b)])
    key = (a_doc[at_a] << 32) | (a[at_a].astype(np.int64) << 16) | b[at_b]
    key, often = np.unique(key, return_counts=True)
    where = np.searchsorted(key >> 32, doc[1:])
    return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(a_doc[first_a], minlength=len(ids)),
            "n_links": np.bincount(a_doc[at_a], minlength=len(ids)),
            "groups": names.lines(a, b, first_a, first_b, cuts),
            "a": np.split(((key >> 16) & 0xFFFF).astype(np.int32), where),
            "b": np.split((key & 0xFFFF).astype(np.int32), where),
            "n": np.split(often.astype(np.int32), where)}


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
          slice_bytes: int = SLICE) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, ``groups`` (``a1,a2|b1;a3|b2``)
    and its different linked id pairs ``a[i], b[i]`` with their numbers of links ``n[i]``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = _pair(a_path, b_path)
        if max(len(pair.a_bytes), len(pair.b_bytes)) > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        names = _Names(len(pair.a_bytes), len(pair.b_bytes))
        for batch in batches:
            sizes = batch["text"].str.len().cumsum().to_numpy()
            begin = 0
            while begin < len(batch):
                before = sizes[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(sizes, before + slice_bytes, side="right")))
                part = batch.iloc[begin:end]
                out = _align_slice(pair, names, pair.ids(part["text"].tolist()))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "absent": part["absent"].to_numpy(), **out})
                begin = end
    # a null id travels as a flag: pandas would turn a column of longs with nulls into doubles
    given = texts(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("absent"), "text")
    return given.mapInPandas(
        run, "doc_id long, absent boolean, n_a long, n_b long, n_groups long, n_links long, groups string, "
             "a array<int>, b array<int>, n array<int>").withColumn(
        "doc_id", F.when(~F.col("absent"), F.col("doc_id"))).drop("absent")


def pair_counts(links: DataFrame) -> DataFrame:
    """(key, count, best) of every linked id pair: links in the corpus, and whether no
    other pair of the same B id has more."""
    counts = cut_lineage(links.groupBy("key").agg(F.sum("n").alias("count")))
    b = F.col("key").bitwiseAND(F.lit(0xFFFF))
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return cut_lineage(counts.withColumn("b", b).join(most, "b")
                       .select("key", "count", (F.col("count") == F.col("most")).alias("best")))


def count_links(docs: DataFrame, a_path: str, b_path: str, frequent: int = FREQUENT, **columns) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, the digest of its groups, n_best (links
    whose pair is the most frequent one of its B id) and count_sum (of its links' counts)."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/alignment-{uuid.uuid4().hex}"
    (align(docs, a_path, b_path, **columns)
     .withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
     .drop("groups").withColumn("row", F.monotonically_increasing_id()).write.parquet(path))
    aligned = spark.read.parquet(path)
    links = aligned.select("row", F.explode(F.arrays_zip("a", "b", "n")).alias("x")).select(
        "row", (F.col("x.a") * F.lit(1 << 16).cast("long") + F.col("x.b")).alias("key"), F.col("x.n").cast("long").alias("n"))
    pairs = pair_counts(links)
    top = pairs.orderBy(F.desc("count"), "key").limit(frequent)
    marked = links.join(F.broadcast(top), "key", "left")
    rare = marked.where("count is null").select("key", "row", "n").join(pairs, "key")
    scored = marked.where("count is not null").select("row", "n", "count", "best").unionByName(
        rare.select("row", "n", "count", "best"))
    sums = scored.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(F.lit(0))).alias("n_best"),
        F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return (aligned.drop("a", "b", "n").join(sums, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links",
                    F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"),
                    "groups_sha256"))
