"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

A text longer than a chunk is cut up first: overlapping windows are pre-tokenised independently, and a cut is put where both
scans of the overlap resynchronise; from a common boundary on, both scans are the same, as the pattern looks only forward.
The pieces are then encoded on their own and their ids joined in order. Texts are encoded in the Python workers, batch by batch, without
a shuffle; only the pieces of a huge text are spread over tasks. Decoding joins the raw bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.session import ship, shuffle_partitions

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # where every executor finds the vocabulary; a parameter of each operator
# Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PRE_TOKEN = regex.compile(PATTERN)
_CLASS = regex.compile(r"(?P<l>\p{L})|(?P<n>\p{N})|(?P<s>\s)|(?P<p>[^\s\p{L}\p{N}])")
_encoders: dict = {}


def vocabulary_ranks(path: str) -> dict[bytes, int]:
    with Path(path).open("rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encoder(path: str = VOCABULARY):
    """The encoder of a vocabulary file, kept per worker process."""
    if path not in _encoders:
        import tiktoken

        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary_ranks(path), special_tokens={})
    return _encoders[path]


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    """The text of ids: their bytes joined, then read as UTF-8."""
    return encoder(path).decode_bytes(ids).decode()


def _boundaries(text: str, start: int, end: int) -> list[int]:
    return [m.start() for m in _PRE_TOKEN.finditer(text, start) if m.start() <= end] if start < end else []


def _certain(text: str, p: int) -> bool:
    """Whether every scan has a boundary before position ``p``: the class changes there, and neither a space nor an apostrophe can bind across it."""
    left, right = _CLASS.match(text, p - 1).lastgroup, _CLASS.match(text, p).lastgroup
    return left != "s" and left != right and text[p - 1] != "'"


def cut_after(text: str, at: int, overlap: int) -> int | None:
    """First position from ``at`` on where two scans that begin at different places before it both have a boundary that no
    scan can miss; None if the overlap has none (one endless run)."""
    window = text[max(0, at - overlap) : at + overlap]
    base = max(0, at - overlap)
    lead = at - base
    ends = len(window) - 1
    first = set(_boundaries(window, 0, ends))
    for p in _boundaries(window, lead // 2, ends):
        if p >= lead and p > 0 and p in first and _certain(window, p):
            return base + p
    return None


def pieces(text: str, chunk: int, overlap: int) -> list[str]:
    """The text cut at resynchronised boundaries into pieces of about ``chunk`` characters; a run without a boundary stays whole."""
    cuts, at = [0], chunk
    while at < len(text):
        cut = cut_after(text, at, overlap)
        if cut is not None and cut > cuts[-1]:
            cuts.append(cut)
        at += chunk
    cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _arrow_lists(ids: list[list[int]]):
    import numpy as np
    import pyarrow as pa

    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


CHUNK, OVERLAP = 1 << 13, 1 << 9  # characters of a piece, and of the overlap that is scanned twice on either side of a cut
SPREAD = 1 << 20  # a text above so many characters is cut in one task and encoded in several


def _huge_pieces(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """doc_id, copy, piece, text: the pieces of huge texts over all tasks; ``copy`` tells rows of the same doc_id apart."""
    import pyarrow as pa

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, copy, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                parts = pieces(text, chunk, overlap)
                for k in range(0, len(parts), 64):
                    some = parts[k : k + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(some), pa.int64()), pa.array([copy] * len(some), pa.int64()), pa.array(range(k, k + len(some)), pa.int32()), pa.array(some, pa.string())], names=["doc_id", "copy", "piece", "text"])

    parts = rows.select("doc_id", F.monotonically_increasing_id().alias("copy"), "text").mapInArrow(cut, "doc_id long, copy long, piece int, text string")
    return parts.repartition(shuffle_partitions(rows.sparkSession), "copy", "piece")


def _by_length(documents: DataFrame, chunk: int, spread: int) -> tuple[DataFrame, DataFrame]:
    rows = documents.select("doc_id", "text")
    length = F.coalesce(F.length("text"), F.lit(0))
    return rows.where(length <= max(chunk, spread)), rows.where(length > max(chunk, spread))


def encode_corpus(documents: DataFrame, *, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """doc_id, ids: the token ids of each text, without special tokens; text that looks like one is plain text.

    Null and empty texts have an empty list. Rows of the same doc_id are passed through one for one. Extra columns are ignored.
    Ids do not depend on the sizes: texts up to ``chunk`` characters are encoded at once, longer ones in pieces, those above ``spread`` on several tasks.
    """
    import pyarrow as pa

    ship(documents.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary).encode_ordinary
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            ids = _arrow_lists([[] if not t else enc(t) if len(t) <= chunk else [i for p in pieces(t, chunk, overlap) for i in enc(p)] for t in texts])
            keep = [b.column(k) for k, name in enumerate(b.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*keep, ids], names=[n for n in b.schema.names if n != "text"] + ["ids"])

    usual, huge = _by_length(documents, chunk, spread)
    short = usual.mapInArrow(encode, "doc_id long, ids array<int>")
    encoded = _huge_pieces(huge, chunk, overlap).mapInArrow(encode, "doc_id long, copy long, piece int, ids array<int>")
    joined = encoded.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("parts"))
    return short.unionByName(joined.select("doc_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids")))


def count_tokens(documents: DataFrame, *, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """doc_id, n_tokens of each text, by the same pieces; 0 for null and empty texts. Rows of the same doc_id are one row."""
    import pyarrow as pa

    ship(documents.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary).encode_ordinary
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            sizes = [0 if not t else len(enc(t)) if len(t) <= chunk else sum(len(enc(p)) for p in pieces(t, chunk, overlap)) for t in texts]
            keep = [b.column(k) for k, name in enumerate(b.schema.names) if name in ("doc_id", "copy")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sizes, pa.int64())], names=[n for n in b.schema.names if n in ("doc_id", "copy")] + ["n_tokens"])

    usual, huge = _by_length(documents.where("doc_id is not null"), chunk, spread)
    short = usual.mapInArrow(count, "doc_id long, n_tokens long")
    counted = _huge_pieces(huge, chunk, overlap).mapInArrow(count, "doc_id long, copy long, n_tokens long").groupBy("doc_id", "copy").agg(F.sum("n_tokens").alias("n_tokens"))
    return short.unionByName(counted.select("doc_id", "n_tokens")).dropDuplicates(["doc_id"])
