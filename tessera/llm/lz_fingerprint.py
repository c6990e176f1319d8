"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases: the longest known phrase plus one more word (a
word over ``LONG`` bytes counts as several of ``CUT`` bytes, so scripts without spaces parse
too). The set of phrases is hashed, and its minima under ``SIZE`` hash functions are the
fingerprint; the share of equal minima estimates how much of the dictionaries two texts
have in common, as a shared compressor would.

Each document also meets the next one by descending id. Documents are dealt to ranges of
ids, one for each task; the greatest of each range is sent to the range above it as well (the greatest of
all to the lowest), so neighbours meet with one shuffle of the texts. A task reads its
rows in order and holds one text that waits for its next.

Defined cases: a null text counts as empty; empty texts (and texts of white space only)
share one fingerprint, which is unlike that of any other; rows with one id follow
each other by text; rows with a null id come before all others, in the order of a hash of their text, and keep
their null; a single row is its own neighbour; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .store import free_name, id_again, id_and_text, partitions

SIZE = 128
LONG, CUT = 24, 6

_rng = np.random.RandomState(31)
_MUL = _rng.randint(1, 1 << 62, SIZE, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def phrases(data: bytes) -> list[bytes]:
    """Distinct dictionary phrases of a text, each a run of words."""
    words = data.split()
    if words and max(map(len, words)) > LONG:
        words = [p for w in words for p in ([w] if len(w) <= LONG else [w[k : k + CUT] for k in range(0, len(w), CUT)])]
    known: set[bytes] = set()
    add = known.add
    cur = b""
    for w in words:
        cur += w + b" "
        if cur not in known:
            add(cur)
            cur = b""
    return list(known)


def fingerprint(data: bytes) -> np.ndarray:
    """SIZE minima of 16 bits; all ones for a text without words."""
    found = phrases(data)
    if not found:
        return np.full(SIZE, 0xFFFF, np.uint16)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size)
    h = tn.span_hash(tn.prefix_hash(np.frombuffer(b"".join(found), np.uint8)), end - size, end)
    out = np.empty(SIZE, np.uint64)
    step = max(1, (1 << 16) // len(h))
    for k in range(0, SIZE, step):
        out[k : k + step] = (h[None, :] * _MUL[k : k + step, None]).min(1)
    return (tn.mix(out) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited_text(text: str, following: str) -> str:
    """text with its last half replaced by as much of the start of the following."""
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


def _ranges(src: DataFrame, width: int) -> np.ndarray:
    """The greatest id of each of about ``width`` ranges of like size, from Spark's own sampler (as many numbers as there are tasks)."""
    placed = src.select("id").repartitionByRange(width, "id").select(F.spark_partition_id().alias("p"), "id")
    return np.unique(np.array([r["most"] for r in placed.groupBy("p").agg(F.max("id").alias("most")).collect()], np.int64))


def lz_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    src = id_and_text(docs, id_col, text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = _ranges(src, partitions(docs.sparkSession, total))

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "kind", "id", "text"]
        for batch in it:
            ids = batch.column(0).to_numpy()
            r = np.searchsorted(most, ids, "left")
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(np.zeros(len(ids), np.int32)), *batch.columns], names=names)
            ends = np.flatnonzero(most[r] == ids)  # come after the last of the range above
            if len(ends):
                above = (r[ends] + 1) % len(most)
                yield pa.RecordBatch.from_arrays([pa.array(above, pa.int32()), pa.array(np.ones(len(ends), np.int32)), *(c.take(pa.array(ends)) for c in batch.columns)], names=names)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one range, greatest id first, then the next below it: each row waits for its next only."""
        waiting, closed = None, False
        for batch in it:
            rows = []
            for kind, i, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if closed:
                    break
                mine = text.as_py()
                mark = fingerprint(mine.encode())
                if waiting is not None:
                    rows.append(compared(*waiting, mine, mark))
                waiting, closed = (i, mine, mark), kind == 1
            cols = list(zip(*rows, strict=True)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    def compared(i: int, text: str, mark: np.ndarray, following: str, next_mark: np.ndarray) -> tuple:
        edited = edited_text(text, following)
        other = fingerprint(edited.encode()) if edited != text else mark
        return i, len(text), hashlib.sha256(edited.encode()).hexdigest(), mark.byteswap().tobytes().hex(), other.byteswap().tobytes().hex(), likeness(mark, other), likeness(mark, next_mark)

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    dealt = src.mapInArrow(deal, "range int, kind int, id long, text string").repartitionById(max(1, len(most)), "range")
    out = dealt.sortWithinPartitions("kind", F.desc("id"), "text").mapInArrow(work, schema)
    return out.select(id_again("id").alias(free_name(id_col, names[1:])), *names[1:])
