"""BPE encoding and decoding by a pair occurrence index.

All distinct words of a batch that the worker has not met yet lie in one symbol array with links
to the next and previous symbol of the word. The index maps each pair of neighbours that has a
merge rank to all its positions. The lowest active rank is taken, all its occurrences are merged
at once, the neighbours' new pairs enter the index, and so on until no rank is active. Ranks that
a merge makes active below the current one are taken next, so each word gets exactly the merges,
in the order, of merging its lowest pair again and again from the left.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import table
from tidewell.llm.units import _LATIN, UnitEncoder, byte_letters, tokenizer_path

WORD_VOCABULARY = "word_bpe_49k.json"

_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class PairIndexBpe:
    """Encoder and decoder of a vocabulary file whose words are cut by one pattern and marked at their end."""

    def __init__(self, name: str):
        with open(tokenizer_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        if not suffix or len(vocab) > 0x10000:
            raise ValueError("a vocabulary with word ends and at most 65,536 ids is needed")
        cuts = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(cuts[0])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.key_of_rank = keys[order], order, keys
        size = max(max(vocab.values()), *self.special.values()) + 1
        self.tokens = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token.encode()

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair key, -1 for pairs that don't merge."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 16-bit) of non-empty words."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        sym[ends - 1] = self.final[raw[ends - 1]]
        n = len(sym)
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[ends - lengths] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Put the pairs that start at these positions into the index."""
            ranks = self.rank(sym[at] << 16 | sym[after[at]])
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            borders = np.flatnonzero(np.diff(ranks)) + 1
            for rank, positions in zip(ranks[np.concatenate([[0], borders])].tolist(), np.split(at, borders), strict=True):
                if rank in index:
                    index[rank].append(positions)
                else:
                    index[rank] = [positions]
                    heapq.heappush(active, rank)

        enter(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            found = index.pop(rank)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            key = int(self.key_of_rank[rank])
            first, second = key >> 16, key & 0xFFFF
            at = at[alive[at] & (sym[at] == first)]
            at = at[after[at] >= 0]
            at = at[sym[after[at]] == second]
            if first == second and len(at) > 1:
                at.sort()
                taken, last = [], -1
                for i in at.tolist():  # of overlapping occurrences the left one counts
                    if i != last:
                        taken.append(i)
                        last = int(after[i])
                at = np.array(taken, np.int64)
            if not len(at):
                continue
            gone = after[at]
            right = after[gone]
            alive[gone] = False
            sym[at] = self.merged[rank]
            after[at] = right
            before[right[right >= 0]] = at[right >= 0]
            left = before[at]
            enter(np.unique(np.concatenate([left[left >= 0], at[right >= 0]])))
        counts = np.add.reduceat(alive.astype(np.int64), ends - lengths)
        flat = sym[alive].astype("<u2").tobytes()
        cuts = (2 * np.cumsum(counts)).tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts)]  # noqa: B905

    def words_of(self, text: str) -> list[bytes | int]:
        """Words of a text as UTF-8, and special tokens as ids."""
        out: list[bytes | int] = []
        for part in self.special_pattern.split(text) if self.special_pattern else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            lower = unicodedata.normalize("NFC", part)
            lower = "".join(map(str.lower, lower)) if "Σ" in lower else lower.lower()
            out += [w.encode() for w in self.pattern.findall(lower)]
        return out

    def encode_units(self, units: list[str]) -> list[bytes]:
        parts = [[u[1:].lower().encode()] if _LATIN(u) else self.words_of(u) for u in units]
        words = list(dict.fromkeys(w for p in parts for w in p if isinstance(w, bytes)))
        ids: dict[bytes | int, bytes] = dict(zip(words, self.encode_words(words), strict=True))
        ids |= {i: i.to_bytes(2, "little") for i in self.special.values()}
        return [ids[p[0]] if len(p) == 1 else b"".join(map(ids.__getitem__, p)) for p in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens with a space between them, as the library decodes where the file names no decoder."""
        return b" ".join(map(self.tokens.__getitem__, ids.tolist()))


_LOADED: dict[str, tuple[PairIndexBpe, UnitEncoder]] = {}


def pair_index_encoder(name: str) -> tuple[PairIndexBpe, UnitEncoder]:
    """One for each Python worker; its cache of words is bounded."""
    if name not in _LOADED:
        bpe = PairIndexBpe(name)
        _LOADED[name] = bpe, UnitEncoder(bpe.encode_units)
    return _LOADED[name]


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = WORD_VOCABULARY) -> DataFrame:
    """doc_id and ``ids`` (array of int) of every row; a null text counts as empty and has no ids.

    Rows stay as they are: repeated ones are encoded each, null ids are kept, an empty table gives
    an empty one, other columns are not read.
    """

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = pair_index_encoder(vocabulary)
        for batch in batches:
            got = [np.frombuffer(b, "<u2").astype(np.int32) for b in encoder.encode(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(ids, "doc_id long, ids array<int>")


def decode_column(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = WORD_VOCABULARY) -> DataFrame:
    """doc_id and ``text`` of every row of ids; null ids count as none."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = pair_index_encoder(vocabulary)
        for batch in batches:
            got = [bpe.decode(np.array(x or [], np.int64)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], ["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(texts, "doc_id long, text string")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = WORD_VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, both ways in one pass."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = pair_index_encoder(vocabulary)
        for batch in batches:
            rows: list[tuple[int, str, str]] = []
            for blob in encoder.encode(batch.column(1)):
                ids = np.frombuffer(blob, "<u2")
                rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            n, of_ids, of_text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], schema=_OUT)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
