"""Removal of repeated byte strings with a sparse, range-partitioned suffix array.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier (smaller
id, or the same document and an earlier start). Sorting a suffix for every byte of the
corpus would move many times its size, so suffixes that cannot repeat are left out first:

1. Each string of ``LENGTH`` bytes has one minimal ``GRAM``-byte hash, the same wherever the
   string is found. Runs of starts with one minimum form a segment (about 30 starts).
   Segments meet by that minimum: one with the content of an earlier segment is repeated
   as a whole; the first segments of different contents are expanded. One content alone
   with its minimum repeats a string only inside itself, with a period under ``SPAN``; then
   its minimal gram occurs twice in it, and its first segment is expanded too.
2. Each start of an expanded segment is a suffix. Splitters sampled from the corpus
   range-partition the suffixes by their leading bytes (a leading string that spans several
   splitters is split further by what follows), so boundaries never part equal
   strings. Each bucket sorts by multikey quicksort and all but the first suffix of
   a run of equal strings are repeats.

Before each shuffle a task keeps only its first of equal contents, so a passage found
in a third of all documents is sent once for each task.

Documents are dealt to chunks of about ``BUCKET_BYTES`` and suffixes to as many buckets, which is what a task holds
at once; tasks take several of them one by one, so there are no more tasks than the scan's.

Defined cases: null text counts as empty; shorter texts than ``LENGTH`` lose nothing;
rows with one id count as one document (neither makes the other go), which holds one text: if
they hold several, what goes from one goes from the others at the same place; rows with a null id are documents
after all others, one for each text, and come back with a null id; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .store import free_name, id_again, id_and_text, partitions, shuffle_width, written

LENGTH = 100
GRAM = 37
SPAN = 64  # grams in a string of LENGTH bytes
BUCKET_BYTES = 8 << 20
SAMPLE = 20_000
FULL, EXPAND, START = 0, 1, 2
INNER = 128  # added to the size of a segment that may repeat a string inside itself

_Q = 2147483647
PASSAGE = 50  # the same on words: strings of so many words
WORD_GRAM = 19  # 32 of these in a string
_RECORD = "chunk long, kind int, doc binary, start binary, size binary, of binary"


def chunk_column(doc: Column, chunks: int) -> Column:
    low = F.pmod(doc, F.lit(1000003)) * F.lit(1664525001)
    high = F.pmod(F.floor(doc / F.lit(1000003)).cast("long"), F.lit(1000003)) * F.lit(1013904223)
    return F.pmod(F.pmod(low, F.lit(_Q)) + F.pmod(high, F.lit(_Q)), F.lit(_Q)) % F.lit(chunks)


def chunk_of(doc: np.ndarray, chunks: int) -> np.ndarray:
    low = doc % 1000003 * 1664525001 % _Q
    high = np.floor(doc / 1000003).astype(np.int64) % 1000003 * 1013904223 % _Q
    return (low + high) % _Q % chunks


def segments(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimum, content hash, row, start in the row, number of starts with INNER) of each segment."""
    return _segments(tn.prefix_hash(buf), off, LENGTH, GRAM)


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the word hashes before each word as in ``prefix_hash``, index of each row's first word); case is folded."""
    low = tn.LOWER[buf]
    words = tn.Words(low, off)
    h = tn.span_hash(tn.prefix_hash(low), words.start, words.end)
    return np.append(np.uint64(0), np.cumsum(h * tn.powers(len(h) + 1)[0][: len(h)])), words.first


def word_segments(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``segments``, of strings of PASSAGE words; starts count words."""
    return _segments(*word_hashes(buf, off), PASSAGE, WORD_GRAM)


def _segments(pre: np.ndarray, off: np.ndarray, length: int, gram_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(pre) - length
    span = length - gram_length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    _, down = tn.powers(len(pre))
    gram = low = tn.mix((pre[gram_length:] - pre[:-gram_length]) * down[: len(pre) - gram_length])
    step = 1
    while step < span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    last = off[1:] - length  # the last start of each row
    has = last >= off[:-1]
    edge = np.zeros(n + 1, np.int8)
    np.add.at(edge, off[:-1][has], 1)
    np.add.at(edge, last[has] + 1, -1)
    valid = np.cumsum(edge[:n]) > 0
    new = np.ones(n, bool)
    new[1:] = low[1:] != low[:-1]
    new[off[:-1][has]] = True
    at = np.flatnonzero(valid & new)
    stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
    size = stop - at
    pieces = -(-size // span)  # a longer run (of one repeated pattern) is cut
    start = np.repeat(at, pieces) + (tn.ranges(np.zeros(len(at), np.int64), pieces) * span)
    size = np.minimum(np.repeat(stop, pieces) - start, span)
    row = np.searchsorted(off, start, "right") - 1
    # If strings a < b of a segment are equal, the minimum is among the first b - a grams and
    # among the last: it begins a string before the last one and ends one after the first.
    begins, ends = (np.append(0, np.cumsum(x)) for x in (gram[:n] == low, gram[span - 1 :] == low))
    inner = (begins[start + size - 1] > begins[start]) & (ends[start + size] > ends[start + 1])
    return low[start], tn.span_hash(pre, start, start + size - 1 + length), row, start - off[row], size + INNER * inner


def multikey_quicksort(columns: list[np.ndarray], small: int = 1 << 14) -> np.ndarray:
    """The order that sorts by columns[0], then columns[1], ...: three-way partitions by column."""
    n = len(columns[0])
    order = np.arange(n)
    stack = [(0, n, 0)]
    while stack:
        a, b, k = stack.pop()
        part = order[a:b]
        if b - a <= small or k == len(columns):
            if k < len(columns) and b - a > 1:
                order[a:b] = part[np.lexsort([c[part] for c in reversed(columns[k:])])]
            continue
        x = columns[k][part]
        pivot = np.sort(x[:: max(1, len(x) // 9)][:9])[4 if len(x) >= 5 else 0]
        less, same = x < pivot, x == pivot
        more = ~(less | same)
        i, j = int(less.sum()), int(same.sum())
        order[a:b] = np.concatenate([part[less], part[same], part[more]])
        stack += [(a, a + i, k), (a + i, a + i + j, k + 1), (a + i + j, b, k)]
    return order


def _first_of_equal(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices of the first of each content, indices of those that have an earlier one, the first of each of these)."""
    order = multikey_quicksort([*keys, doc, start])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        v = k[order]
        new[1:] |= v[1:] != v[:-1]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = (doc[order] != doc[head]) | (start[order] != start[head])
    return order[new], order[later], head[later]


def _by_group(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(group, kind="stable")
    g = group[order]
    cut = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else []
    for a, b in zip(cut, np.append(cut[1:], len(g)), strict=True) if len(g) else ():
        yield int(g[a]), order[a:b]


def _verdicts(kind: int, doc: np.ndarray, start: np.ndarray, size: np.ndarray, chunks: int, of: np.ndarray | None = None) -> list[tuple]:
    """of: the documents copied, for words."""
    return [(c, kind, doc[i].tobytes(), start[i].astype(np.int32).tobytes(), (size[i] % INNER).astype(np.uint8).tobytes(), b"" if of is None else of[i].tobytes()) for c, i in _by_group(chunk_of(doc, chunks))]


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)


_V = (["chunk", "kind", "doc", "start", "size", "of"], [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()])
_S = (["bucket", "kind", "doc", "start", "size", "key", "content"], [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()])
_SEND = "bucket long, kind int, doc binary, start binary, size binary, key binary, content binary"


def _join(table: pa.Table, column: str, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype)


def _passed_on(table: pa.Table, known: int, chunks: int, words: bool) -> list[tuple]:
    """Verdicts that tasks knew by themselves."""
    mine = table.filter(pc.less(table.column("kind"), 0))
    if not mine.num_rows:
        return []
    return _verdicts(known, _join(mine, "doc", np.int64), _join(mine, "start", np.int32), _join(mine, "size", np.uint8), chunks, _join(mine, "key", np.int64) if words else None)


def _sent(buckets: np.ndarray, firsts: np.ndarray, later: np.ndarray, doc, start, size, key, content, spread: int, of: np.ndarray | None = None) -> list[tuple]:
    rows = [(b, 1, doc[i].tobytes(), start[i].astype(np.int32).tobytes(), size[i].astype(np.uint8).tobytes(), key[i].tobytes(), content[i].tobytes()) for b, x in _by_group(buckets) for i in (firsts[x],)]
    if len(later):
        rows.append((int(doc[later[0]]) % spread, -1, doc[later].tobytes(), start[later].astype(np.int32).tobytes(), size[later].astype(np.uint8).tobytes(), b"" if of is None else of.tobytes(), b""))
    return rows


def _segment_records(docs: DataFrame, buckets: int, words: bool) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in it:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, buf, off in tn.slices(batch.column(1)):
                low, content, row, start, size = (word_segments if words else segments)(buf, off)
                parts.append((low, content, ids[i + row], start.astype(np.int32), size.astype(np.uint8)))
        if not parts:
            return
        low, content, doc, start, size = (np.concatenate(c) for c in zip(*parts, strict=True))
        parts.clear()
        if not len(low):
            return
        firsts, later, of = _first_of_equal([low, content], doc, start)
        bucket = (low[firsts] % np.uint64(buckets)).astype(np.int64)
        key = (low // np.uint64(buckets)).astype(np.uint32)  # with the bucket, over 32 bits of the minimum
        rows = _sent(bucket, firsts, later, doc, start, size, key, content, buckets, doc[of] if words else None)
        for k in range(0, len(rows), 64):
            yield from _table(rows[k : k + 64], *_S).to_batches()

    return docs.mapInArrow(run, _SEND)


def _judge_segments(sent: DataFrame, chunks: int, words: bool) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        out = _passed_on(table, FULL, chunks, words)
        mine = table.filter(pc.greater(table.column("kind"), 0))
        if mine.num_rows:
            key, content = _join(mine, "key", np.uint32), _join(mine, "content", np.uint64)
            doc, start, size = _join(mine, "doc", np.int64), _join(mine, "start", np.int32), _join(mine, "size", np.uint8)
            firsts, later, of = _first_of_equal([key, content], doc, start)
            out += _verdicts(FULL, doc[later], start[later], size[later], chunks, doc[of] if words else None)
            many = firsts[tn.repeated_keys(key[firsts]) | (size[firsts] >= INNER)]
            out += _verdicts(EXPAND, doc[many], start[many], size[many], chunks)
        return _table(out, *_V)

    return sent.groupBy("bucket").applyInArrow(run, _RECORD)


def _texts(left: pa.Table) -> Iterator[tuple[int, bytes]]:
    column = tn.text_array(left.column("text")).cast(pa.large_binary())
    yield from zip(left.column("id").to_pylist(), column.to_pylist(), strict=True)


def _spans(right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, tuple[int, int]]]:
    """kind, doc, start, size sorted by doc, and each doc's slice of them."""
    if not right.num_rows:
        z = np.zeros(0, np.int64)
        return z, z, z, z, {}
    kind = np.repeat(np.array(right.column("kind").to_pylist()), [len(x) // 8 for x in right.column("doc").to_pylist()])
    doc, start, size = _join(right, "doc", np.int64), _join(right, "start", np.int32).astype(np.int64), _join(right, "size", np.uint8).astype(np.int64)
    order = np.argsort(doc, kind="stable")
    kind, doc, start, size = kind[order], doc[order], start[order], size[order]
    cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    return kind, doc, start, size, {int(doc[a]): (int(a), int(b)) for a, b in zip(cut, np.append(cut[1:], len(doc)), strict=True)}


def _suffixes(left: pa.Table, right: pa.Table, words: bool) -> list[np.ndarray] | None:
    """lead, content, doc, start of the suffixes of all expanded segments."""
    kind, _, start, size, where = _spans(right)
    parts, seen = [], set()
    for i, data in _texts(left):
        if i not in where or (i, data) in seen:
            continue
        seen.add((i, data))
        a, b = where[i]
        pick = np.flatnonzero(kind[a:b] == EXPAND) + a
        buf = np.frombuffer(data, np.uint8)
        s = tn.ranges(start[pick], size[pick])
        if words:
            pre, _ = word_hashes(buf, np.array([0, len(buf)]))
            s = s[s + PASSAGE < len(pre)]
            h = tn.span_hash(pre, s, s + PASSAGE)
            parts.append((h, h, np.full(len(s), i, np.int64), s))
            continue
        s = s[s + LENGTH <= len(buf)]
        if not len(s):
            continue
        lead = np.zeros(len(s), np.uint64)
        for k in range(8):
            lead = (lead << np.uint64(8)) | buf[s + k].astype(np.uint64)
        parts.append((lead, tn.span_hash(tn.prefix_hash(buf), s, s + LENGTH), np.full(len(s), i, np.int64), s))
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else None


def range_bucket(splitters: np.ndarray, lead: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Place among the splitters; a lead equal to several of them is spread over these by its content."""
    a, b = np.searchsorted(splitters, lead, "left"), np.searchsorted(splitters, lead, "right")
    return a + ((content >> np.uint64(40)).astype(np.int64) * (b - a + 1) >> 24)


def _sampled_leads(docs: DataFrame, share: float) -> np.ndarray:
    """Leading bytes of suffixes at pseudo-random places, about SAMPLE of them in all."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for _, _, buf, _ in tn.slices(batch.column(1)):
                if len(buf) > 8 and share:
                    rng = np.random.RandomState(len(buf))
                    s = rng.randint(0, len(buf) - 8, rng.poisson(share * len(buf)))
                    lead = np.zeros(len(s), np.uint64)
                    for k in range(8):
                        lead = (lead << np.uint64(8)) | buf[s + k].astype(np.uint64)
                    out.append(lead)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out or [np.zeros(0, np.uint64)]).view(np.int64))], names=["lead"])

    return np.sort(np.array([r[0] for r in docs.mapInArrow(run, "lead long").collect()], np.int64).view(np.uint64))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """(documents dealt to chunks, verdicts on starts by chunk, number of chunks).

    words: of strings of PASSAGE words instead of LENGTH bytes, ordered by their hash, and each verdict names the document copied.
    """
    spark = docs.sparkSession
    src = id_and_text(docs, id_col, text_col)
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(shuffle_width(spark), -(-total // BUCKET_BYTES))
    sample = np.linspace(0, 2.0**64, chunks + 1)[:-1].astype(np.uint64) if words else _sampled_leads(src, SAMPLE / max(total, SAMPLE))
    splitters = sample[np.linspace(0, len(sample), chunks + 1).astype(int)[1:-1]] if len(sample) else np.zeros(0, np.uint64)
    first = written(_judge_segments(_segment_records(src, chunks, words), chunks, words), "suffixes")
    dealt = src.withColumn("chunk", chunk_column(F.col("id"), chunks)).repartition(partitions(spark, total), "chunk")

    def expand(left: pa.Table, right: pa.Table) -> pa.Table:
        got = _suffixes(left, right, words)
        if got is None:
            return _table([], *_S)
        lead, content, doc, start = got
        firsts, later, of = _first_of_equal([lead, content], doc, start)
        ones = np.ones(len(doc), np.uint8)
        return _table(_sent(range_bucket(splitters, lead[firsts], content[firsts]), firsts, later, doc, start, ones, lead, content, chunks, doc[of] if words else None), *_S)

    def judge(table: pa.Table) -> pa.Table:
        out = _passed_on(table, START, chunks, words)
        mine = table.filter(pc.greater(table.column("kind"), 0))
        if mine.num_rows:
            doc, start = _join(mine, "doc", np.int64), _join(mine, "start", np.int32)
            _, later, of = _first_of_equal([_join(mine, "key", np.uint64), _join(mine, "content", np.uint64)], doc, start)
            out += _verdicts(START, doc[later], start[later], np.ones(len(later), np.uint8), chunks, doc[of] if words else None)
        return _table(out, *_V)

    wanted = first.where(F.col("kind") == EXPAND)
    suffixes = dealt.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(expand, _SEND)
    second = suffixes.groupBy("bucket").applyInArrow(judge, _RECORD)
    return dealt, first.where(F.col("kind") == FULL).union(second), chunks


def removed_mask(n: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + size - 1 + LENGTH, n), -1)
    return np.cumsum(edge[:-1]) > 0


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256 of every document; with_text: kept (binary) too."""
    dealt, verdicts, _ = repeated_spans(docs, id_col, text_col)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        _, _, start, size, where = _spans(right)
        rows = []
        for i, data in _texts(left):
            kept, removed, spans = data, 0, 0
            if i in where and len(data) >= LENGTH:
                a, b = where[i]
                inside = start[a:b] + size[a:b] - 1 + LENGTH <= len(data)
                mask = removed_mask(len(data), start[a:b][inside], size[a:b][inside])
                removed = int(mask.sum())
                spans = int((mask & ~np.append(False, mask[:-1])).sum())
                kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
            rows.append((i, len(data), removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
        return _table(rows, names, types)

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    out = dealt.groupBy("chunk").cogroup(verdicts.groupBy("chunk")).applyInArrow(finish, schema)
    return out.select(id_again("id").alias(free_name(id_col, names[1:])), *names[1:])
