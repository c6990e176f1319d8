"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Only lengths matter to a packing, and there are at most ``CAPACITY`` of them, so the
plan is made on the histogram of all pieces: the longest open piece starts its bins,
each gap takes the longest piece that fits it, and where nothing fits any more a bin's
smallest piece gives way to two unpacked ones that fill its wider gap more tightly.
Equal bins are planned together with their number. Pieces get a rank among those of
their length (counts by task and length, then a running sum), and the rank finds the bin.

Defined cases: a null text counts as empty, an empty text is the closing id alone;
repeated rows are packed each for itself, and so are rows with a null id, which stays null; an empty table gives an empty result; only the
id and text columns are read. The plan does not depend on the order of rows; which of
several pieces of one length takes a place does.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnum as tn
from .bpe import byte_letters
from .store import free_name, named, written

CAPACITY = 2048
CLOSING_ID = 0
#: Fixed value: the byte-level pattern that cuts a text into pieces, each encoded by itself.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A long run of white space; the pattern goes back over it step by step, and fails beyond a million, so it is cut out first.
LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


@lru_cache(maxsize=2)
def text_encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids, of a byte-level tokenizer file in the ``tokenizers`` JSON format.

    Its merges come in the order of the ids they make, so the ids are the ranks that ``tiktoken`` merges
    by, which encodes such vocabularies several times as fast; tests hold both equal.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if made != sorted(made) or spec["normalizer"] or not spec["pre_tokenizer"].get("use_regex"):
        raise ValueError(f"not a plain byte-level vocabulary: {path}")
    to_byte = {c: b for b, c in enumerate(byte_letters())}
    ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    enc = tiktoken.Encoding("file", pat_str=PIECE, mergeable_ranks=ranks, special_tokens=special)
    whole = tiktoken.Encoding("piece", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
    closers = tuple(special)

    def encode(text: str) -> np.ndarray:
        parts, at = [], 0
        for run in LONG_BLANKS.finditer(text):
            # the pattern takes a run as one piece, but for its last blank where a word follows
            end = run.end() if run.end() == len(text) or text.startswith(closers, run.end()) else run.end() - 1
            parts += [enc.encode_to_numpy(text[at : run.start()], allowed_special="all"), whole.encode_to_numpy(text[run.start() : end])]
            at = end
        last = enc.encode_to_numpy(text[at:], allowed_special="all")
        return np.concatenate([*parts, last]) if parts else last

    return encode


def cut_lengths(total: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces: only longer ones are cut, and only the first piece may be shorter."""
    if total <= capacity:
        return [total]
    return [total % capacity] * bool(total % capacity) + [capacity] * (total // capacity)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32, and task and nth: place among the task's pieces of that length."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = text_encoder(path), TaskContext.get().partitionId()
        closing = CLOSING_ID.to_bytes(4, "little")
        seen = np.zeros(capacity + 1, np.int64)
        for batch in it:
            rows: list[tuple] = []
            texts = tn.text_array(batch.column(1)).cast(pa.large_binary())
            for i, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids = encode(t.as_py().decode("utf-8", "replace")).astype("<u4").tobytes() + closing
                at = 0
                for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + n)]
                    rows.append((i, k, at, n, zlib.crc32(part), task, int(seen[n]), *([part] if with_ids else [])))
                    seen[n] += 1
                    at += n
            cols = list(zip(*rows, strict=True)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    names = ["id", "piece", "start", "length", "ids_crc32", "task", "nth"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    schema = "id long, piece int, start long, length long, ids_crc32 long, task long, nth long" + ", ids binary" * with_ids
    return docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def best_two_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(number of bins, lengths in each) from counts[length]."""
    rest = counts.astype(np.int64).copy()
    out: list[tuple[int, list[int]]] = []
    while True:
        open_ = np.flatnonzero(rest)
        if not len(open_):
            return out
        top = int(open_[-1])
        stack = [(int(rest[top]), [top])]
        rest[top] = 0
        while stack:
            m, inside = stack.pop()
            gap = capacity - sum(inside)
            fits = np.flatnonzero(rest[: gap + 1])
            if len(fits):
                best = int(fits[-1])
                k = min(m, int(rest[best]))
                rest[best] -= k
                if k < m:
                    stack.append((m - k, inside))
                stack.append((k, [*inside, best]))
                continue
            swap = _two_for_one(rest, gap, min(inside)) if gap and len(inside) > 1 else None
            if swap is None:
                out.append((m, inside))
                continue
            a, b = swap
            k = min(m, int(rest[a]) // 2 if a == b else min(int(rest[a]), int(rest[b])))
            rest[a] -= k
            rest[b] -= k
            small = min(inside)
            rest[small] += k
            new = inside.copy()
            new.remove(small)
            if k < m:
                stack.append((m - k, inside))
            stack.append((k, [*new, a, b]))


def _two_for_one(rest: np.ndarray, gap: int, small: int) -> tuple[int, int] | None:
    """The two lengths that fill gap + small most tightly, if they take more than small."""
    room = gap + small
    have = np.flatnonzero(rest[: room + 1])
    if not len(have):
        return None
    at = np.searchsorted(have, room - have, "right") - 1
    alone = (at >= 0) & (have[at] == have) & (rest[have] < 2)
    at = np.where(alone, at - 1, at)
    filled = np.where(at >= 0, have + have[at], 0)
    k = int(filled.argmax())
    return (int(have[k]), int(have[at[k]])) if filled[k] > small else None


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (a stored table from pieces) with sequence_id and offset."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in parts.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    used = np.zeros(capacity + 1, np.int64)
    table, sequence = [], 0
    for m, inside in best_two_fit(counts, capacity):
        at = 0
        for n in inside:
            table.append(((n << 40) + used[n], sequence, at))
            used[n] += m
            at += n
        sequence += m
    table.sort()
    key, first, offset = (np.array(c, np.int64) for c in (zip(*table, strict=True) if table else ([], [], [])))
    before = (
        parts.groupBy("length", "task").count()
        .withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("length", "task", "before")
    )
    ranked = parts.join(before, ["length", "task"])
    names = [c for c in parts.columns if c not in ("task", "nth")]

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rank, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = np.searchsorted(key, (n << 40) + rank, "right") - 1
            seq = first[at] + (n << 40) + rank - key[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(seq), pa.array(offset[at])], names=["length", *rest, "sequence_id", "offset"])

    rest = [c for c in names if c != "length"]
    fields = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in ["length", *rest]) + ", sequence_id long, offset long"
    out = ranked.select((F.col("before") + F.col("nth")).alias("__rank"), "length", *rest).mapInArrow(place, schema)
    return out.select(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece with its sequence and its place there."""
    out = packed(written(pieces(docs, path, capacity, id_col, text_col, with_ids), "pieces"), capacity)
    return out.withColumnRenamed("id", free_name(id_col, out.columns[1:]))
