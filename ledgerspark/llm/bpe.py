"""Byte-level BPE encoding and decoding by forced boundaries.

Two neighbouring bytes that occur inside no token of the vocabulary can never
be merged, so the text is certainly cut between them. All such cuts of a block
of texts are found by one table lookup per byte; the fragments (about a word
each) are encoded independently, each distinct one once per cache, and the ids
of a text are the concatenation of its fragments' ids.

A cut must also leave the pre-tokeniser's matches as they are in the whole text.
Its pattern looks at context in two ways only: a run of white space keeps its
last character for the word that follows, and an apostrophe starts a contraction
unless punctuation precedes it. So there is no cut inside a character, after a
run of two or more white space characters, after white space outside ASCII, or
between anything but an ASCII letter or digit and an apostrophe.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_class, chunks, text_buffer, tidy

#: Fixed value: the pre-tokeniser's public pattern.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Fragments whose ids a worker remembers before it starts anew; it also does with each task.
CACHE = 64_000

SLOT_BITS = 19
NEVER = 1 << 60

ASCII_SPACE = byte_class((9, 13), (28, 32))
#: Last bytes of white space characters outside ASCII.
WIDE_SPACE_END = byte_class((0x80, 0x8A), (0x9F, 0xA0), (0xA8, 0xA9), (0xAF, 0xAF))
ALNUM = byte_class((48, 57), (65, 90), (97, 122))


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """An encoder and decoder from the JSON of a byte-level BPE tokeniser."""

    def __init__(self, spec: bytes) -> None:
        said = json.loads(spec)
        model, names = said["model"], byte_names()
        to_bytes = lambda token: bytes(names[c] for c in token)
        vocab = {to_bytes(t): i for t, i in model["vocab"].items()}
        self.special = {a["content"].encode(): a["id"] for a in said["added_tokens"]}
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        merges = (map(to_bytes, p.split(" ") if isinstance(p, str) else p) for p in model["merges"])
        self._hash_merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        seen = np.zeros(65536, bool)
        for token in vocab:
            for a, b in zip(token, token[1:]):
                seen[a * 256 + b] = True
        self.never = ~seen
        self.never.reshape(256, 256)[:, 0x80:0xC0] = False  # not inside a character
        by_id = dict(sorted({i: t for t, i in {**vocab, **self.special}.items()}.items()))
        size = max(by_id) + 1
        self.token_len = np.array([len(by_id.get(i, b"")) for i in range(size)], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)
        self.special_at = self._pattern(self.special)
        self.cache: dict[bytes, bytes] = {}

    def __getstate__(self) -> dict:
        """Without the cache and compiled patterns; what is sent to workers is arrays of a few MB."""
        return {k: v for k, v in self.__dict__.items() if k not in ("cache", "special_at")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, cache={}, special_at=self._pattern(state["special"]))

    @staticmethod
    def _pattern(special: dict[bytes, int]) -> regex.Pattern | None:
        return regex.compile("|".join(regex.escape(s.decode()) for s in special).encode()) if special else None

    def _hash_merges(self, merges: list[tuple[int, int, int]]) -> None:
        """The merges as an open-addressed hash table in arrays, and the new id of each rank."""
        # A pair that is listed again has its last rank.
        last = {a << 32 | b: rank for rank, (a, b, _) in enumerate(merges)}
        self.first_id = np.array(self.byte_id, np.int64)
        self.new_id = np.array([new for _, _, new in merges], np.int64)
        self.table = np.full((1 << SLOT_BITS) + 256, -1, np.int64)
        self.table_rank = np.full(len(self.table), NEVER, np.int64)
        self.probes = 1
        for key, at, rank in zip(last, self._slot(np.array(list(last), np.int64)).tolist(), last.values()):
            first = at
            while self.table[at] >= 0:
                at += 1
            self.table[at], self.table_rank[at] = key, rank
            self.probes = max(self.probes, at - first + 1)

    def _merge(self, a: int, b: int) -> tuple[int, int] | None:
        """The rank and new id of one pair."""
        key = a << 32 | b
        at = ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - SLOT_BITS)
        while self.table[at] >= 0:
            if self.table[at] == key:
                rank = int(self.table_rank[at])
                return rank, int(self.new_id[rank])
            at += 1
        return None

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank at which each pair merges, or NEVER."""
        keys = left << 32 | right
        at = self._slot(keys)
        out = np.where(self.table[at] == keys, self.table_rank[at], NEVER)
        for k in range(1, self.probes):
            out = np.where(self.table[at + k] == keys, self.table_rank[at + k], out)
        return out

    def merged_all(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each pre-token. In every round each one takes its merge of
        lowest rank, at the leftmost place of equals, all pre-tokens at once."""
        flat = self.first_id[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_ids, done_owner = [], []
        while len(flat):
            inside = np.append(owner[1:] == owner[:-1], False)
            rank = np.full(len(flat), NEVER)
            at = np.flatnonzero(inside)
            rank[at] = self.ranks(flat[at], flat[at + 1])
            starts = np.flatnonzero(np.append(True, ~inside[:-1]))
            least = np.minimum.reduceat(rank, starts)
            least = np.repeat(least, np.diff(np.append(starts, len(flat))))
            over = least == NEVER
            done_ids.append(flat[over])
            done_owner.append(owner[over])
            hit = np.flatnonzero((rank == least) & ~over)
            hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])] if len(hit) else hit
            flat[hit] = self.new_id[least[hit]]
            stay = ~over
            stay[hit + 1] = False
            flat, owner = flat[stay], owner[stay]
        ids, owner = np.concatenate([np.zeros(0, np.int64), *done_ids]), np.concatenate([np.zeros(0, np.int64), *done_owner])
        order = np.argsort(owner, kind="stable")
        ids, ends = ids[order].astype(np.int32), np.cumsum(np.bincount(owner, minlength=len(words)))
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _merged_long(self, ids: list[int]) -> list[int]:
        """As merged_all() for one very long pre-token: a heap of possible merges over a linked list."""
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], k, m[1], p) for k, p in enumerate(zip(ids, ids[1:])) if (m := self._merge(*p))]
        heapq.heapify(heap)
        while heap:
            _, k, new, pair = heapq.heappop(heap)
            j = after[k]
            if ids[k] != pair[0] or j < 0 or ids[j] != pair[1]:
                continue
            ids[k], ids[j], after[k] = new, -1, after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] >= 0 and (m := self._merge(*(p := (ids[a], ids[after[a]])))):
                    heapq.heappush(heap, (m[0], a, m[1], p))
        return [i for i in ids if i >= 0]

    def learn(self, fragments: list[bytes]) -> None:
        """Puts the ids of new fragments, as packed int32, in the cache."""
        words, counts = [], []
        for f in fragments:
            body = f[1:] if f[:1] == b" " else f
            own = [f] if body.isalpha() else [w.encode() for w in WORDS.findall(f.decode())]
            words += own
            counts.append(len(own))
        short = [k for k, w in enumerate(words) if len(w) <= 64]
        ids = dict(zip(short, self.merged_all([words[k] for k in short])))
        at = 0
        for f, n in zip(fragments, counts):
            self.cache[f] = b"".join((ids[k] if k in ids else np.array(self._merged_long([self.byte_id[b] for b in words[k]]), np.int32)).tobytes() for k in range(at, at + n))
            at += n

    def cuts(self, raw: np.ndarray) -> np.ndarray:
        """Where fragments certainly start (a text's own start left out)."""
        if len(raw) < 2:
            return np.zeros(0, np.int64)
        pair = raw[:-1].astype(np.uint16) << 8
        pair |= raw[1:]
        cut = self.never[pair]
        at = np.flatnonzero(cut)
        x, y = raw[at], raw[at + 1]
        before = np.where(at > 0, raw[at - 1], 65)
        wide = WIDE_SPACE_END[x] & ~((before >= 0xC3) & (before <= 0xDF))
        run = ASCII_SPACE[x] & (ASCII_SPACE[before] | WIDE_SPACE_END[before])
        odd = (y == 0x27) & ~ALNUM[x]
        return at[~(wide | run | odd)] + 1

    def encode_block(self, raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The packed ids of each text of a block that holds no special token."""
        first = np.zeros(len(raw) + 1, bool)
        first[self.cuts(raw)] = True
        first[offsets] = True
        starts = np.flatnonzero(first[:-1])
        buffer, cache = raw.tobytes(), self.cache
        ends = np.append(starts[1:], len(raw))
        fragments = [buffer[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        if len(cache) > CACHE:
            cache.clear()
        if new := set(fragments).difference(cache):
            self.learn(list(new))
        ids = [cache[f] for f in fragments]
        bounds = np.searchsorted(starts, offsets).tolist()
        return [b"".join(ids[a:b]) for a, b in zip(bounds, bounds[1:])]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The packed int32 ids of each text; the strings of special tokens become their ids."""
        buffer = raw.tobytes()
        if not self.special or not self.special_at.search(buffer):
            return self.encode_block(raw, offsets)
        out = []
        for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
            text, at, ids = buffer[a:b], 0, []
            for m in [*self.special_at.finditer(text), None]:
                part = np.frombuffer(text[at : m.start() if m else len(text)], np.uint8)
                ids += self.encode_block(part, np.array([0, len(part)]))
                if m:
                    ids.append(np.int32(self.special[m[0]]).tobytes())
                    at = m.end()
            out.append(b"".join(ids))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens, one after the other."""
        lengths = self.token_len[ids]
        ends = np.cumsum(lengths)
        if not len(ids) or not ends[-1]:
            return b""
        shift = np.repeat(self.token_at[ids] - (ends - lengths), lengths)
        return self.token_bytes[shift + np.arange(ends[-1])].tobytes()


def default_tokenizer() -> str:
    """The place of the public byte-level vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_and_decode(docs: DataFrame, tokenizer: str | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep``, then ``ids`` (array of int) and ``decoded`` (string), of every row.

    The vocabulary file is read on the driver; its tables are broadcast, whose size
    does not depend on the data. Null texts count as empty: no ids, empty string. Rows
    are independent, so repeated rows and null ids change nothing; an empty
    table gives an empty table; other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    with open(tokenizer or default_tokenizer(), "rb") as f:
        held = spark.sparkContext.broadcast(ForcedBoundaryBPE(f.read()))

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held.value
        try:
            for batch in batches:
                raw, offsets = text_buffer(batch.column(len(keep)))
                for a, b in chunks(offsets, 1 << 18):  # lists of fragments take many times the text
                    own = offsets[a : b + 1]
                    packed = bpe.encode(raw[own[0] : own[-1]], own - own[0])
                    ids = np.frombuffer(b"".join(packed), np.int32)
                    at = np.cumsum([0, *(len(p) // 4 for p in packed)])
                    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                    texts = pa.array([bpe.decode(ids[i:j]).decode("utf-8", "replace") for i, j in zip(at.tolist(), at[1:].tolist())], pa.string())
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(keep))), lists, texts], names=[*keep, "ids", "decoded"])
        finally:
            bpe.cache.clear()

    own = docs.select(*keep, F.col(f"`{text}`").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema[: len(keep)])
    return own.mapInArrow(work, f"{schema + ', ' if schema else ''}ids array<int>, decoded string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of ids and text."""
    out = encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
