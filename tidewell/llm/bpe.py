"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is a product of pattern matches, over which encoding is a homomorphism: no merge crosses a match. Inside a match,
halves are encoded recursively and joined: the tokens around the seam are encoded again in a window that grows until the
pairs at both of its edges are stable. A pair (a, b) is stable if the bytes of a and b together encode to (a, b); a
sequence whose neighbours are all stable is the encoding of its bytes, so nothing outside the window can change.
Decoding looks up the bytes of runs of tokens, the leaves of a tree over a text's ids, and concatenates neighbours up it.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm import common, vector

LEAF = 16
#: Ids whose bytes are looked up at once in decoding.
LEAF_IDS = 4096
SCANNED = 64
CACHED_PIECES = 200_000
NEVER = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """Read a rank file: a base64 token and its rank on each line. The driver reads it; its size is fixed."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Monoid:
    """Encodings of byte strings under concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self._stable: dict[tuple[int, int], bool] = {}

    def leaf(self, data: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until no pair has a rank."""
        if len(data) > SCANNED:
            return self._leaf_by_heap(data)
        get = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [get(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while pairs and (best := min(pairs)) < NEVER:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], NEVER)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        return [self.ranks[p] for p in parts]

    def _leaf_by_heap(self, data: bytes) -> list[int]:
        """The same for long windows, with the pairs in a heap."""
        n, get = len(data), self.ranks.get
        after, before, part = list(range(1, n + 1)), list(range(-1, n - 1)), [data[i : i + 1] for i in range(n)]
        heap = [(rank, i, 2) for i in range(n - 1) if (rank := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has been merged meanwhile
            part[i], part[j], after[i] = part[i] + part[j], None, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (rank := get(part[i] + part[after[i]])) is not None:
                    heapq.heappush(heap, (rank, i, len(part[i]) + len(part[after[i]])))
            if before[i] >= 0 and (rank := get(part[before[i]] + part[i])) is not None:
                heapq.heappush(heap, (rank, before[i], len(part[before[i]]) + len(part[i])))
        return [self.ranks[p] for p in part if p is not None]

    def stable(self, a: int, b: int) -> bool:
        known = self._stable.get((a, b))
        if known is None:
            if len(self._stable) >= CACHED_PIECES:
                self._stable.clear()
            known = self._stable[a, b] = self.leaf(self.token[a] + self.token[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenation, from the encodings of both sides."""
        if not left or not right:
            return left or right
        if self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            middle = self.leaf(b"".join(self.token[t] for t in chain(left[-i:], right[:j])))
            left_ok = i == len(left) or self.stable(left[-i - 1], middle[0])
            right_ok = j == len(right) or self.stable(middle[-1], right[j])
            if left_ok and right_ok:
                return left[:-i] + middle + right[j:]
            i, j = (i if left_ok else 2 * i), (j if right_ok else 2 * j)

    def encode(self, data: bytes) -> list[int]:
        """Encode halves and join them."""
        if len(data) <= LEAF:
            return self.leaf(data)
        half = len(data) // 2
        return self.join(self.encode(data[:half]), self.encode(data[half:]))

    def piece(self, data: bytes) -> list[int]:
        """A pattern match: one token if the vocabulary has it whole."""
        rank = self.ranks.get(data)
        return [rank] if rank is not None else self.encode(data)


class Recent(dict):
    """Results of ``make``: those asked for of late, in two generations of bounded size."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= CACHED_PIECES:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Texts to ids.

    A single space between two characters that aren't spaces always begins a match, so a text without other spaces
    beside a space is also a product of its stretches from space to space, which are looked up first.
    """

    beside_space = re.compile(r"\A | \Z| \s|\s ").search

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # Nothing here refers back to the encoder, so that all it remembers goes with the last reference, at the end of a task.
        self.monoid = monoid = Monoid(ranks)
        find = regex.compile(pattern).findall

        def one(piece: str) -> bytes:
            """Ids are kept as the bytes of 32-bit numbers, which join without a step for each."""
            return array("i", monoid.piece(piece.encode())).tobytes()

        known = Recent(one)

        def pieces(text: str) -> bytes:
            found = find(text)
            # A stretch that is one piece is remembered as such.
            return one(found[0]) if len(found) == 1 else b"".join(map(known.__getitem__, found))

        self.pieces = pieces
        self.stretch = Recent(lambda stretch: pieces(" " + stretch))

    def packed(self, text: str) -> bytes:
        if self.beside_space(text):
            return self.pieces(text)
        first, *rest = text.split(" ")
        return self.pieces(first) + b"".join(map(self.stretch.__getitem__, rest))

    def __call__(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


def encoding(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str, into: str) -> Callable:
    """What encodes a batch of the rows of ``df``, made on the worker."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: its size is fixed by the file

    def make():
        encoder = Encoder(shared.value, pattern)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [encoder.packed(t) for t in common.texts(batch, text_col)]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, into])

        return run

    return make


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", into: str = "token_ids") -> DataFrame:
    """Add ``into``, the array of token ids of the whole text.

    Null and empty texts give an empty array; very long ones need memory in proportion to their length; repeated rows
    are encoded alike; an empty table gives an empty table. ``into`` replaces a column of that name.
    """
    df = df.drop(into)
    return common.arrow_map(df, encoding(df, ranks, pattern, text_col, into), T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))]))


def up(parts: list[bytes]) -> bytes:
    """The product of a row of leaves: neighbours are concatenated until one part is left."""
    while len(parts) > 1:
        parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0] if parts else b""


def decoding(df: DataFrame, ranks: dict[bytes, int], ids_col: str, into: str) -> Callable:
    """What decodes a batch, made on the worker."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def make():
        ranks = shared.value
        sizes, starts = np.zeros(max(ranks.values(), default=-1) + 1, np.int64), np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        order = sorted(ranks, key=ranks.__getitem__)
        pool = np.frombuffer(b"".join(order), np.uint8)
        starts[1:] = np.cumsum(sizes)[:-1]

        def product(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The bytes of all ids, and where those of each end."""
            if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes) or not sizes[ids].all()):
                raise ValueError("an id is not in the vocabulary")
            own = sizes[ids]
            ends = np.cumsum(own)
            at = np.arange(int(ends[-1]) if len(ends) else 0)
            return pool[at + np.repeat(starts[ids] - ends + own, own)], ends

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            counts = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            # Leaves are cut at the same places whatever other texts are in the batch; their bytes are looked up together.
            leaves = np.unique(np.concatenate([counts, *(np.arange(a, b, LEAF_IDS) for a, b in zip(counts[:-1], counts[1:], strict=True) if b - a > LEAF_IDS)]))
            looked: dict[int, bytes] = {}
            for a, b in vector.pieces(leaves, 1 << 18):
                data, ends = product(ids[leaves[a] : leaves[b]])
                cuts = np.concatenate([[0], ends])[leaves[a : b + 1] - leaves[a]].tolist()
                raw = data.tobytes()
                looked |= {k: raw[x:y] for k, x, y in zip(leaves[a:b].tolist(), cuts[:-1], cuts[1:], strict=True)}
            texts = [up([looked[k] for k in range(a, b, LEAF_IDS)]) for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, into])

        return run

    return make


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "token_ids", into: str = "decoded") -> DataFrame:
    """Add ``into``, the bytes of the ids in ``ids_col``. Null and empty arrays give no bytes; an unknown id fails the job."""
    df = df.drop(into)
    return common.arrow_map(df, decoding(df, ranks, ids_col, into), T.StructType([*df.schema.fields, T.StructField(into, T.BinaryType())]))


def round_trip(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Encode and decode again, by one worker for each task instead of two. Both columns replace those of their names."""
    df = df.drop(ids, decoded)
    one, other = encoding(df, ranks, pattern, text_col, ids), decoding(df, ranks, ids, decoded)

    def make():
        there, back = one(), other()
        return lambda batch: back(there(batch))

    return common.arrow_map(df, make, T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.BinaryType())]))


def vocabulary(path: str | None = None) -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return load_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def digests(df: DataFrame) -> DataFrame:
    """Counts and digests of ``token_ids`` and ``decoded``."""
    return df.withColumns(
        {
            "n_tokens": F.size("token_ids").cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256),
            "decoded_sha256": F.sha2(F.col("decoded"), 256),
        }
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text of ``documents`` and decode the ids again."""
    ranks, pattern = vocabulary()
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(round_trip(docs, ranks, pattern)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
