"""Token counts by the whole-token shortcut.

``whole_tokens`` proves once, on the driver, which strings of a vocabulary encode alone as one token.  A pre-token that is
one of them counts 1 without any merge; only the other distinct pre-tokens are merged by the library, and a memo keeps
their counts.

Defined results: a null text counts as empty (0 tokens); repeated rows give repeated results; an empty table gives an
empty result; other columns are ignored.  A special string in a text is one token, as by the library's default, and what
lies between special strings is counted apart.  Texts of every script take the same path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import core
from tessera.llm.pretokens import Memo, library_encoder, special_ids, split_bytes_pattern, splitter

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def whole_tokens(path: str) -> list[str]:
    """Vocabulary strings that the library, given the string alone, encodes as exactly one token.

    The list is no longer than the vocabulary, whatever the data.
    """
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    t, decoder = Tokenizer.from_file(path), ByteLevel()
    strings = [s for s in (decoder.decode([x]) for x in t.get_vocab(with_added_tokens=False)) if s and "�" not in s]
    return [s for s, e in zip(strings, t.encode_batch_fast(strings, add_special_tokens=False), strict=True) if len(e.ids) == 1]


_MEMO: dict[str, tuple[frozenset, Memo]] = {}


def _counter(path: str, whole: frozenset) -> Memo:
    if path not in _MEMO or _MEMO[path][0] != whole:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        if t.normalizer is not None:
            raise ValueError("the shortcut needs a byte-level vocabulary without a normaliser")
        merge = library_encoder(t)

        def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
            out = np.ones(len(strings), np.uint32)
            rest = [i for i, s in enumerate(strings) if s not in whole]
            out[rest] = merge([strings[i] for i in rest])[1]
            return out, np.ones(len(strings), np.int64)

        memo = Memo(encode, split_bytes_pattern, splitter(t), dict.fromkeys(special_ids(t), 1))
        _MEMO[path] = whole, memo
    return _MEMO[path][1]


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens is over ``limit``, for each row; one narrow pass, no shuffle."""
    core.small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(frozenset(whole_tokens(path)))

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        memo = _counter(path, known.value)
        for batch in batches:
            for ids, texts in core.groups(batch):
                counts, at = memo.tokens(texts)  # each pre-token's entry is its count
                sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                n = sums[at[1:]] - sums[at[:-1]]
                size = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return core.id_text(docs).mapInArrow(run, SCHEMA)
