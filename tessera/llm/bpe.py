"""BPE encoding and decoding as streaming transducers with bounded lookahead.

Whether a merge fires depends on what follows only through merges of lower rank that
take its right part, or the last part of that, first. ``lookahead`` follows such chains over the
merge list, which bounds how many symbols after a token can change it. The encoder buffers
a few times that many symbols, merges them, emits the tokens that end before the lookahead
(a token edge that no merge crosses splits the problem) and keeps the rest, so memory
does not grow with a piece. Every piece of a text runs through this encoder, and a text goes through it in
runs of words of about ``BLOCK`` bytes; words seen before come from a cache of bounded size. The
decoder is fed token by token or word by word and gives text back as soon as it is stable: with an incremental
UTF-8 state machine for byte-level files, with a held space for files without a decoder.

Defined cases: a null text counts as empty; an empty text has no tokens and decodes to
an empty text; repeated rows are encoded each for itself, and so are rows with a null id, which stays null; an empty table gives an empty
result; only the id and text columns are read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textnum as tn
from .store import free_name, named

#: Entries of words and of pieces seen; a full cache is kept until the next is full, results do not depend on it.
CACHE = 250_000
#: Bytes of a text whose words are looked up at a time.
BLOCK = 1 << 16
_GAP = re.compile(rb"[\t-\r ]")
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes are themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = [chr(b) if b in plain else "" for b in range(256)]
    spare = 256
    for b in range(256):
        if not out[b]:
            out[b] = chr(spare)
            spare += 1
    return out


def lookahead(merges: list[tuple[str, str]], end: str = "") -> int:
    """Symbols after a token that can still change it, from chains of conflicting merges."""

    def size(t: str) -> int:
        return len(t.removesuffix(end)) if end else len(t)

    reach_from: dict[str, int] = {}  # of merges so far, by their left part
    within: dict[str, int] = {}  # of what may take the last part of a token while it is built
    most = 1
    for a, b in merges:
        spine = max(reach_from.get(b, 0), within.get(b, 0))
        reach = size(b) + spine
        reach_from[a] = max(reach_from.get(a, 0), reach)
        within[a + b] = max(within.get(a + b, 0), spine)
        most = max(most, reach)
    return most + 1


class SpacedDecoder:
    """Text of tokens with a space between: the space after a token is held until another comes."""

    held = b""

    def feed(self, tokens: bytes) -> bytes:
        """tokens: whole tokens, each with a space after it."""
        if not tokens:
            return b""
        out, self.held = self.held + tokens[:-1], b" "
        return out


class Encoder:
    """Encodes pieces of a tokenizer file in the ``tokenizers`` JSON format."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: k for k, m in enumerate(merges)}
        self.end: str = model.get("end_of_word_suffix") or ""
        self.ahead = lookahead(merges, self.end)
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.words = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        kinds = json.dumps(spec["normalizer"] or {})
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        self.byte_decoder = bool(spec.get("decoder"))
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.cache: dict[bytes, tuple[bytes, bytes]] = {}
        self.old, self.old_pieces = {}, {}  # the full caches before these
        #: Contractions, letters, a digit, other signs: the file's pattern with its white space spelled out.
        self.split = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")

    def merge(self, symbols: list[str]) -> list[str]:
        """BPE of a bounded list of symbols."""
        rank = self.rank
        if len(symbols) < 64:
            none, get = 1 << 60, rank.get
            ranks = [get(p, none) for p in zip(symbols, symbols[1:], strict=False)]
            while ranks:
                best = min(ranks)
                if best == none:
                    break
                k = ranks.index(best)
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
                del ranks[k]
                if k:
                    ranks[k - 1] = get((symbols[k - 1], symbols[k]), none)
                if k < len(ranks):
                    ranks[k] = get((symbols[k], symbols[k + 1]), none)
            return symbols
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap = [(rank[p], k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        n = len(symbols)
        gone = [False] * n
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k] if not gone[k] else n
            if j >= n or rank.get((symbols[k], symbols[j])) != r:
                continue
            symbols[k] += symbols[j]
            gone[j] = True
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if (q := rank.get((symbols[k], symbols[after[k]]))) is not None:
                    heapq.heappush(heap, (q, k))
            if before[k] >= 0 and (q := rank.get((symbols[before[k]], symbols[k]))) is not None:
                heapq.heappush(heap, (q, before[k]))
        return [s for s, g in zip(symbols, gone, strict=True) if not g]

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one piece, each as soon as it is stable."""
        held: list[str] = []
        room = 4 * self.ahead + 64
        for s in symbols:
            held.append(s)
            if len(held) > room:
                done, at = [], 0
                for t in self.merge(held[:]):
                    if at + len(t) > len(held) - self.ahead - 1:
                        break
                    done.append(t)
                    at += len(t)
                yield from done
                held = held[at:]
                room = max(room, len(held) + self.ahead)
        if held:
            held[-1] += self.end
            yield from self.merge(held)

    def piece(self, text: str) -> tuple[int, ...]:
        got = self.pieces.get(text) or self.old_pieces.get(text)
        if got is None:
            letters = self.letters
            got = tuple([self.ids[t] for t in self.stream([letters[b] for b in text.encode()])])
            if len(text) < 64:
                if len(self.pieces) >= CACHE:
                    self.old_pieces, self.pieces = self.pieces, {}
                self.pieces[text] = got
        return got

    def _word(self, word: bytes) -> tuple[bytes, bytes]:
        if (got := self.old.get(word)) is not None:
            self.cache[word] = got
            return got
        s = word.decode()
        if not s.isascii():
            if self.nfc:
                s = unicodedata.normalize("NFC", s)
            if self.lower:
                s = "".join(c.lower() for c in s)
        elif self.lower:
            s = s.lower()
        ids = [i for p in self.split.findall(s) for i in self.piece(p)]
        got = struct.pack(f"<{len(ids)}I", *ids), "".join(self.words[i] + " " for i in ids).encode()
        if len(word) < 64:
            if len(self.cache) >= CACHE:
                self.old, self.cache = self.cache, {}
            self.cache[word] = got
        return got

    def digest(self, data: bytes) -> tuple[int, str, str]:
        """(number of ids, sha256 of the ids, sha256 of the decoded text) of a whole text."""
        ids, text = hashlib.sha256(), hashlib.sha256()
        n, decoder = 0, SpacedDecoder()
        for i, t in self.parts(data):
            n += len(i)
            ids.update(i)
            text.update(decoder.feed(t))
        return n // 4, ids.hexdigest(), text.hexdigest()

    def parts(self, data: bytes) -> Iterator[tuple[bytes, bytes]]:
        """(ids, token texts each with a space after it) of runs of words."""
        if b"<|" in data and self.specials is not None:
            s, at = data.decode(), 0
            for m in self.specials.finditer(s):
                yield from self._run(s[at : m.start()].encode())
                yield struct.pack("<I", self.special[m[0]]), (m[0] + " ").encode()
                at = m.end()
            data = s[at:].encode()
        yield from self._run(data)

    def _run(self, data: bytes) -> Iterator[tuple[bytes, bytes]]:
        miss, at = self._word, 0
        while at < len(data):
            gap = _GAP.search(data, at + BLOCK)
            end = gap.start() if gap else len(data)
            cache = self.cache.get  # a full cache is put away meanwhile; then misses look in both
            got = [cache(w) or miss(w) for w in data[at:end].split()]
            yield b"".join([g[0] for g in got]), b"".join([g[1] for g in got])
            at = end

    def encode(self, text: str) -> list[int]:
        return [i for ids, _ in self.parts(text.encode()) for i in struct.unpack(f"<{len(ids) // 4}I", ids)]

    def decode(self, ids: Iterable[int]) -> str:
        """Without a decoder in the file: tokens with spaces between; else bytes through the UTF-8 state machine."""
        if not self.byte_decoder:
            machine = SpacedDecoder()
            return b"".join(machine.feed((self.words[i] + " ").encode()) for i in ids).decode()
        return "".join(self.text_stream(ids))

    def text_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of byte-level tokens, each part as soon as its characters are whole."""
        to_byte = {c: b for b, c in enumerate(self.letters)}
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        special = set(self.special.values())
        for i in ids:
            t = self.words[i]
            yield machine.decode(t.encode() if i in special else bytes(to_byte[c] for c in t))
        yield machine.decode(b"", True)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 of every whole text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in it:
            texts = tn.text_array(batch.column(1)).cast(pa.large_binary())
            rows = [enc.digest(texts[k].as_py()) for k in range(len(texts))]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    key = free_name(id_col, ["n_tokens", "ids_sha256", "decoded_sha256"])
    src = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", key)
