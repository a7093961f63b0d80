"""Byte-level BPE in linear time: Aho-Corasick longest matches and backtracking over compatible neighbours.

The bytes of a pre-token are mapped to Latin-1 so that pyahocorasick, which works on strings, finds every vocabulary
string in them in one pass.  Encoding takes the longest match at each position and steps back to a shorter one whenever
the new token and its left neighbour are not *compatible*: two tokens are compatible if the plain merges of their joined
bytes give just these two.  A sequence whose neighbours are all compatible is the merges' own result, and there is one
such sequence only.  Compatibility is memoised.

Defined results: a null text is empty (no ids, digests of the empty string); special strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import core
from tessera.llm.pretokens import Kinds, Memo, split_bytes_pattern

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Pairs of tokens whose compatibility one worker remembers; when full, it starts again.
PAIRS = 1_000_000


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        reachable = {b for b, i in ranks.items() if self.merge(b) == [i]}
        self.shorter: dict[int, int] = {}
        self.machine = ahocorasick.Automaton()
        for b in reachable:
            self.machine.add_word(b.decode("latin-1"), (len(b), ranks[b]))
            cut = next((b[:k] for k in range(len(b) - 1, 0, -1) if b[:k] in reachable), None)
            if cut:
                self.shorter[ranks[b]] = ranks[cut]
        self.machine.make_automaton()

    @classmethod
    def from_file(cls, path: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, data: bytes) -> list[int]:
        """The definition: join the neighbours with the lowest rank, leftmost first, until none has a rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        if (a, b) not in self.pairs:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return self.pairs[a, b]

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        if not data:
            return []
        if data in self.ranks:
            return [self.ranks[data]]
        longest: list[int] = [-1] * len(data)
        size = [0] * len(data)
        for end, (n, token) in self.machine.iter(data.decode("latin-1")):
            if n > size[end - n + 1]:
                size[end - n + 1], longest[end - n + 1] = n, token
        lengths, open_at = self.bytes_of, [True] * (len(data) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(data):
            while True:
                end = at + len(lengths[token])
                if open_at[end] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < len(data) else -1
                    break
                if token in self.shorter:
                    token = self.shorter[token]
                    continue
                open_at[at] = False  # nothing fits from here after this neighbour: take the neighbour back
                token = out.pop()
                at -= len(lengths[token])
                break
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def joined(pattern: str, pairs: list[str]) -> list[bool]:
    """Whether tiktoken leaves each pair of signs in one piece.  Other libraries' Unicode tables differ from its own, so it is
    asked itself, with each pair as a token: a piece that is a token becomes that token."""
    import tiktoken

    tokens = {p.encode(): 256 + i for i, p in enumerate(pairs)}
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)} | tokens, special_tokens={})
    return [probe.encode_ordinary(p) == [tokens[p.encode()]] for p in pairs]


_CODECS: dict[str, tuple[ByteBpe, Memo]] = {}


def codec(path: str, pattern: str) -> tuple[ByteBpe, Memo]:
    """The codec of this process and its memo of pre-tokens."""
    if path not in _CODECS:
        bpe = ByteBpe.from_file(path)

        def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = [bpe.encode_piece(s.encode()) for s in strings]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((x for y in ids for x in y), np.uint32, int(counts.sum())), counts

        memo = Memo(encode, split_bytes_pattern, Kinds(lambda pairs: joined(pattern, pairs)))
        _CODECS[path] = bpe, memo
    return _CODECS[path]


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every text and returns digests of both, in one narrow pass without a shuffle."""
    core.small_batches(docs.sparkSession)

    def run(batches):
        bpe, memo = codec(path, pattern)
        text_of = [str(i) for i in range(max(bpe.bytes_of) + 1)]
        for batch in batches:
            for doc_ids, texts in core.groups(batch):
                flat, at = memo.tokens(texts)
                rows = []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    ids = flat[a:b].tolist()
                    rows.append((hashlib.sha256(" ".join(map(text_of.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(at[1:] - at[:-1], pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return core.id_text(docs).mapInArrow(run, SCHEMA)
