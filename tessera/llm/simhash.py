"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Every text gets a 64-bit fingerprint of its word shingles; equal fingerprints are one node from here on.
2. Bits that go together (by their correlation over all distinct fingerprints) are put in one partition. Two
   fingerprints within ``RADIUS`` bits are within t_i bits in some partition i, for any thresholds that add up to
   RADIUS - partitions + 1 (a threshold of -1 leaves a partition out).
3. Each fingerprint chooses its own thresholds: dynamic programming over the partitions, on candidate counts
   estimated from a histogram of each partition (``BINS`` counters, at any size of the input).
4. It probes all values within its thresholds; what it meets is verified on all 64 bits as the rows are joined.
5. Fingerprints whose cheapest plan would still meet over ``LIMIT`` candidates (large groups of near copies) do not probe: two of
   these are within 2 bits exactly if some value is within 1 bit of both, so each sends itself to its 65 values, and
   all that meet at one are linked with the least of them. What is cheap finds its links with these by its own probes.
6. Links make components.

A value that is estimated above LIMIT is probed by nobody, so its rows are not sent either: no key of a join is hot.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; a text of fewer words
than a shingle is one shingle; rows of one id with several texts connect them; rows with a null id come after all
others, their component is null where no id is reachable; an empty table gives an empty result; only the id
and text columns are read, whatever else the table holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .minhash import components
from .store import NO_ID, free_name, id_again, id_and_text, spread_join, written

BITS, WIDTH, SEED, RADIUS = 64, 3, 42, 2
#: Shingles whose bits are spread out at once.
CHUNK = 1 << 15
#: Counters of a partition's histogram.
BIN_BITS = 16
BINS = 1 << BIN_BITS
#: Candidates that a fingerprint may meet by its own plan; the way beyond it sends 65 rows.
LIMIT = 64
_ONE = np.uint64(1)


def shingle_hashes(data: bytes, start: np.ndarray, end: np.ndarray, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of width words (joined by single spaces) of data[start:end]; one of all words where there are fewer."""
    if not len(start):
        return np.zeros(0, np.uint64)
    w = min(width, len(start))
    m = len(start) - w + 1
    plain = np.ones(m, bool)  # as it stands in the text
    for k in range(w - 1):
        gap = end[k : k + m]
        plain &= (start[k + 1 : k + 1 + m] - gap == 1) & (np.frombuffer(data, np.uint8)[np.minimum(gap, len(data) - 1)] == 32)
    digest = xxhash.xxh64_intdigest
    out = np.empty(m, np.uint64)
    at = np.flatnonzero(plain)
    out[at] = np.fromiter((digest(data[a:b], seed) for a, b in zip(start[at].tolist(), end[at + w - 1].tolist(), strict=True)), np.uint64, len(at))
    for i in np.flatnonzero(~plain).tolist():
        out[i] = digest(b" ".join(data[a:b] for a, b in zip(start[i : i + w].tolist(), end[i : i + w].tolist(), strict=True)), seed)
    return out


def majority(data: bytes, start: np.ndarray, end: np.ndarray, width: int) -> int:
    """The bits that are set in over half of a text's shingle hashes."""
    ones, m = np.zeros(BITS, np.int64), max(1, len(start) - width + 1)
    for k in range(0, m if len(start) else 0, CHUNK):
        last = min(k + CHUNK, m) + width - 1
        h = shingle_hashes(data, start[k:last], end[k:last], width)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << j for j in np.flatnonzero(2 * ones > m).tolist())


def fingerprints(src: DataFrame, width: int = WIDTH) -> DataFrame:
    """id and fp (64 bits as a long) of every row of id and text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[int] = []
            for _, _, buf, off in tn.slices(batch.column(1)):
                low = tn.LOWER[buf]
                words, data = tn.Words(low, off), low.tobytes()
                out += [majority(data, words.start[a:b], words.end[a:b], width) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], names=["id", "fp"])

    return src.mapInArrow(run, "id long, fp long")


def _set_bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def joint_counts(nodes: DataFrame) -> np.ndarray:
    """How many fingerprints have both bit i and bit j, for all i and j; one row a task is shuffled for each i."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS), np.int64)
        for batch in it:
            x = _set_bits(batch.column(0).to_numpy().view(np.uint64)).astype(np.float32)  # a batch is far below 2^24 rows
            both += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS, dtype=np.int32)), pa.array(list(both), pa.list_(pa.int64()))], names=["i", "both"])

    rows = nodes.select("fp").mapInArrow(run, "i int, both array<long>")
    added = rows.groupBy("i").agg(*(F.sum(F.col("both")[j]).alias(f"j{j}") for j in range(BITS))).collect()
    out = np.zeros((BITS, BITS))
    for r in added:
        out[r["i"]] = [r[f"j{j}"] for j in range(BITS)]
    return out


def correlated_groups(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of about equal size: each takes the free bit that goes most with what it holds."""
    p = np.diag(both) / n
    cov = both / n - np.outer(p, p)
    scale = np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
    like = np.abs(np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 0))
    np.fill_diagonal(like, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = (BITS + k) // parts
        group = [max(free, key=lambda b: (like[b, sorted(free)].sum(), -b))]
        free.discard(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (like[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(group)
    return groups


def value_of(fp: np.ndarray, group: list[int]) -> np.ndarray:
    """The group's bits of every fingerprint, the group's first bit lowest."""
    out = np.zeros(len(fp), np.uint64)
    for j, bit in enumerate(group):
        out |= (fp >> np.uint64(bit) & _ONE) << np.uint64(j)
    return out


def partitions_for(n: int, radius: int = RADIUS) -> int:
    """The number of partitions that costs least on n even fingerprints: rows sent and candidates met by each."""

    def cost(m: int) -> float:
        width, over = BITS / m, radius - m + 1
        probes = m if over == 0 else (m - 1 + 1 + width if over == 1 else radius + 1)
        return probes * (1 + n / 2**width)

    return min(range(radius, radius + 2), key=cost)


def histograms(nodes: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """Counts of the low BIN_BITS bits of each group's values: BINS rows a group at most are collected."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(groups), BINS), np.int64)
        for batch in it:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for g, group in enumerate(groups):
                total[g] += np.bincount((value_of(fp, group) & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
        g, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[g, b])], names=["part", "bin", "n"])

    out = np.zeros((len(groups), BINS), np.int64)
    added = nodes.select("fp").mapInArrow(run, "part int, bin int, n long").groupBy("part", "bin").agg(F.sum("n").alias("n")).toPandas()
    out[added["part"].to_numpy(), added["bin"].to_numpy()] = added["n"].to_numpy()
    return out


def estimates(counts: np.ndarray, groups: list[list[int]], radius: int = RADIUS) -> np.ndarray:
    """est[partition][t][bin]: candidates within t bits of a value of that bin, the value's own probes counted as one each.

    A bin's typical count is spread over the values that share it; what it has above that is taken for one value's.
    """
    est = np.zeros((len(groups), radius + 1, BINS))
    places = np.arange(BINS)
    for g, group in enumerate(groups):
        own = min(BIN_BITS, len(group))
        rest = len(group) - own
        mean = counts[g].sum() / 2**own
        exact = np.maximum(counts[g] - mean, 0) + mean / 2.0**rest if rest else counts[g].astype(float)
        flipped = [exact[places ^ (1 << j)] for j in range(own)] if own else []
        other = mean / 2.0**rest  # a value whose flipped bit is outside the bin
        est[g, 0] = exact + 1
        if radius > 0:
            est[g, 1] = est[g, 0] + sum(flipped) + rest * other + len(group)
        if radius > 1:
            pairs = sum(exact[places ^ (1 << j) ^ (1 << k)] for j in range(own) for k in range(j))
            far = rest * (rest - 1) / 2 * other + rest * own * other
            est[g, 2] = est[g, 1] + pairs + far + len(group) * (len(group) - 1) / 2
    return est


def thresholds(cost: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(thresholds, their cost) of least total cost for each row of cost[row, partition, t], by dynamic programming.

    The state is the sum of thresholds + 1 so far, which ends at radius + 1: each adds 0 (left out) to radius + 1.
    """
    rows, parts, _ = cost.shape
    steps = radius + 2
    best = np.full((rows, steps), np.inf)
    best[:, 0] = 0
    chosen = np.zeros((rows, parts, steps), np.int8)
    for p in range(parts):
        new = np.full((rows, steps), np.inf)
        for spent in range(steps):
            for take in range(spent + 1):
                c = best[:, spent - take] + (cost[:, p, take - 1] if take else 0)
                better = c < new[:, spent]
                new[better, spent] = c[better]
                chosen[better, p, spent] = take
        best = new
    out, state = np.empty((rows, parts), np.int8), np.full(rows, steps - 1)
    for p in range(parts - 1, -1, -1):
        out[:, p] = chosen[np.arange(rows), p, state] - 1
        state = state - (out[:, p] + 1)
    return out, best[:, -1]


def _flips(width: int, t: int) -> np.ndarray:
    """All masks of exactly t of width bits."""
    bits = [1 << j for j in range(width)]
    masks = [0] if t == 0 else bits if t == 1 else [a | b for i, a in enumerate(bits) for b in bits[:i]]
    return np.array(masks, np.uint64)


def dealt(nodes: DataFrame, groups: list[list[int]], est: np.ndarray, limit: int, kind: str) -> DataFrame:
    """part, value, fp. kind "index": values to be met; "probe": values within the thresholds; "beyond": those within a bit, of what doesn't probe."""
    low = np.uint64(BINS - 1)

    def rows(part: int, value: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cols = [pa.array(np.full(len(fp), part, np.int32)), pa.array(value.view(np.int64)), pa.array(fp.view(np.int64))]
        return pa.RecordBatch.from_arrays(cols, names=["part", "value", "fp"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fp = batch.column(0).to_numpy().view(np.uint64)
            values = [value_of(fp, g) for g in groups]
            bins = [(v & low).astype(np.int64) for v in values]
            if kind == "index":
                for g, (v, b) in enumerate(zip(values, bins, strict=True)):
                    met = est[g, 0][b] <= limit
                    yield rows(g, v[met], fp[met])
                continue
            t, cost = thresholds(np.stack([est[g][:, b].T for g, b in enumerate(bins)], 1))
            if kind == "beyond":
                dear = fp[cost > limit]
                for mask in [np.uint64(0), *_flips(BITS, 1)] if len(dear) else []:
                    yield rows(-1, dear ^ mask, dear)
                continue
            for g, group in enumerate(groups):
                for bits in range(RADIUS + 1):
                    mine = (cost <= limit) & (t[:, g] >= bits)
                    for mask in _flips(len(group), bits) if mine.any() else []:
                        yield rows(g, values[g][mine] ^ mask, fp[mine])

    return nodes.select("fp").mapInArrow(run, "part int, value long, fp long")


def close_pairs(nodes: DataFrame, parts: int | None = None, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) of distinct fingerprints (a stored table of fp): all within RADIUS bits, and enough to connect all that are."""
    n = nodes.count()
    if n < 2:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    groups = correlated_groups(joint_counts(nodes), n, parts or partitions_for(n))
    est = estimates(histograms(nodes, groups), groups)
    probes, index, beyond = (dealt(nodes, groups, est, limit, k) for k in ("probe", "index", "beyond"))
    pairs = probes.withColumnRenamed("fp", "a").join(index.withColumnRenamed("fp", "b"), ["part", "value"])
    found = pairs.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).select("a", "b")
    # a value has at most 65 fingerprints within a bit of it
    met = beyond.groupBy("value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    star = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return found.union(star)


def _same_id(feats: DataFrame) -> DataFrame:
    rows = feats.where(F.col("id") < NO_ID)
    several = rows.groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("id", "a")
    return rows.join(several, "id").where("a < fp").select("a", F.col("fp").alias("b")).distinct()


def simhash_groups(docs: DataFrame, width: int = WIDTH, parts: int | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id (least id reachable), kept (id = component_id) of every document."""
    feats = written(fingerprints(id_and_text(docs, id_col, text_col), width), "simhash")
    nodes = written(feats.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash")
    links = close_pairs(nodes, parts, limit).union(_same_id(feats))
    comp = components(links, "simhash").withColumnsRenamed({"id": "fp"})
    labelled = nodes.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    best = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = written(labelled.join(best, "component").select("fp", "n", "component_id"), "simhash")
    total = by_fp.agg(F.sum("n")).first()[0] or 0
    names = ["fingerprint", "component_id", "kept"]
    out = spread_join(feats, by_fp, "fp", "n", total)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return out.select(id_again("id").alias(free_name(id_col, names)), digits, id_again("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))
