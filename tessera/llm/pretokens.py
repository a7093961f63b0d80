"""Pre-tokens of the public byte-level vocabularies, found in bulk, and a memo of what each distinct one encodes to.

Byte-pair merges never cross a pre-token, and the same few hundred thousand pre-tokens make up most text.  The kernel
therefore finds pre-token boundaries with array operations, maps each pre-token to a row of a memo (by a 64-bit hash,
confirmed code point by code point), and asks the encoder only for the rows that it has not met.

The kind of a code point from U+0300 on is asked of the library's own splitter when it first occurs, so texts of every
script take this path.  Vocabularies with a normaliser compose such code points, so there these texts go to the encoder
whole.  A text that holds special strings is cut at them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd

from tessera.llm.core import U64, chunks, code_points, hash_slices, spread

#: Code points below this are classified here, others by the library's splitter.
SAFE = 0x300
#: Distinct pre-tokens that the memo of one Python worker holds, and bytes of their code points and tokens; when either is
#: reached, it starts again with the next group of texts.
MEMO_ROWS, MEMO_BYTES = 400_000, 64 << 20

_BLANK, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    import regex

    out = np.full(SAFE, _OTHER, np.uint8)
    for name, kind in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _BLANK)):
        pattern = regex.compile(name)
        for c in range(SAFE):
            if pattern.match(chr(c)):
                out[c] = kind
    out[0x1C:0x20] = _OTHER  # information separators: white space to Python, not to Unicode
    return out


CLASSES = _classes()
_QUOTE = ord("'")


class Kinds:
    """Kinds of code points.  ``joins`` tells which of many pairs of neighbours the library leaves in one piece; without it
    only code points below SAFE have kinds."""

    def __init__(self, joins: Callable[[list[str]], list[bool]] | None):
        self.joins, self.table = joins, np.full(0x110000, 255, np.uint8)
        self.table[:SAFE] = CLASSES

    def of(self, cps: np.ndarray) -> np.ndarray:
        out = self.table[cps]
        if (out == 255).any():
            self._ask(np.unique(cps[out == 255]))
            out = self.table[cps]
        return out

    def _ask(self, new: np.ndarray) -> None:
        """A letter joins a letter before it, a number a number, another sign a sign; white space joins none."""
        kinds = np.full(len(new), _BLANK, np.uint8)
        for first, kind in (("a", _LETTER), ("1", _NUMBER), ("!", _OTHER)):
            kinds[np.array(self.joins([first + chr(c) for c in new.tolist()]), bool)] = kind
        self.table[new] = kinds


def _contractions(cps: np.ndarray, free: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apostrophes in ``free`` that start 's 't 'm 'd 're 've 'll; and the end of each.  ``ends``: end of each one's text."""
    n = len(cps)
    a = np.where(free + 1 < ends, cps[np.minimum(free + 1, n - 1)], 0)
    b = np.where(free + 2 < ends, cps[np.minimum(free + 2, n - 1)], 0)
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    hit = one | two
    return free[hit], free[hit] + np.where(two[hit], 3, 2)


def split_bytes_pattern(cps: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths by public_tokenizers.PATTERN; all of the text is covered."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    last = np.zeros(n, bool)
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    before[first] = 255
    blank, was_blank = kind == _BLANK, before == _BLANK
    after_blank = np.zeros(n, bool)
    after_blank[:-1] = blank[1:]
    was_space = np.zeros(n, bool)
    was_space[1:] = cps[:-1] == 32
    was_space &= ~first
    start = first | (blank & (~was_blank | (~last & ~after_blank))) | (~blank & np.where(was_blank, ~was_space, kind != before))
    free = np.flatnonzero((cps == _QUOTE) & (before != _OTHER) & ~was_space)
    if len(free):
        hits, stops = _contractions(cps, free, offsets[np.searchsorted(offsets, free, "right")])
        start[hits + 1] = False
        start[stops[stops < n]] = True
    starts = np.flatnonzero(start)
    return starts, np.diff(starts, append=n)


def split_words_pattern(cps: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths by the pattern of word_bpe_49k: letters, single numbers, others; white space is dropped."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = cps + ((cps >= 65) & (cps <= 90)).astype(np.uint32) * np.uint32(32)
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    before[first] = 255
    start = (kind != _BLANK) & ((kind != before) | (kind == _NUMBER))
    free = np.flatnonzero((cps == _QUOTE) & (before != _OTHER))
    if len(free):
        hits, stops = _contractions(low, free, offsets[np.searchsorted(offsets, free, "right")])
        start[hits + 1] = False
        stops = stops[stops < n]
        start[stops[kind[stops] != _BLANK]] = True
    cut = start | (kind == _BLANK) | first
    edges = np.flatnonzero(cut)
    lengths = np.diff(edges, append=n)
    keep = start[edges]
    return edges[keep], lengths[keep]


def _slices(cps: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The code points of ascending slices, one after another."""
    if len(starts) and starts[-1] + lengths[-1] - starts[0] == lengths.sum():
        return cps[starts[0] : starts[-1] + lengths[-1]]
    return cps[spread(starts, lengths)]


Encoded = tuple[np.ndarray, np.ndarray]


class Memo:
    """What each distinct pre-token encodes to.  ``encode`` maps a list of strings to their ids in a row and how many each
    has; ``special`` has the ids of the strings that texts are cut at; ``whole``, which only a vocabulary with a normaliser
    needs, maps a text to its ids."""

    def __init__(self, encode: Callable[[list[str]], Encoded], split: Callable, kinds: Kinds, special: dict[str, int] | None = None, whole: Callable[[str], list] | None = None, rows: int = MEMO_ROWS):
        self.encode, self.split, self.kinds, self.special, self.whole, self.rows = encode, split, kinds, special or {}, whole, rows
        self.cutter = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)))
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, U64)  # ascending
        self.order = np.zeros(0, np.int64)  # row of each hash
        self.cps, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.ids, self.ids_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _rows(self, cps: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Row of the memo for each pre-token; unknown ones are added first."""
        hashes = hash_slices(cps, starts, lengths)
        codes, uniques = pd.factorize(hashes)
        uniques = np.asarray(uniques, U64)
        if len(self.hashes) + len(uniques) > self.rows or self.cps.nbytes + self.ids.nbytes > MEMO_BYTES:
            self._clear()
        at = np.searchsorted(self.hashes, uniques)
        known = np.zeros(len(uniques), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == uniques
        if not known.all():
            where = np.empty(len(uniques), np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            self._add(cps, starts[where[~known]], lengths[where[~known]], uniques[~known])
            at = np.searchsorted(self.hashes, uniques)
        return self.order[at][codes]

    def _add(self, cps: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> None:
        chars = cps[spread(starts, lengths)]
        text = chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        ends = np.cumsum(lengths).tolist()
        ids, counts = self.encode([text[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        n = len(self.order)
        self.cps = np.concatenate([self.cps, chars])
        self.at = np.concatenate([self.at, self.at[-1] + np.asarray(ends, np.int64)])
        self.ids = np.concatenate([self.ids, np.asarray(ids, np.uint32)])
        self.ids_at = np.concatenate([self.ids_at, self.ids_at[-1] + np.cumsum(counts)])
        by = np.argsort(hashes, kind="stable")
        where = np.searchsorted(self.hashes, hashes[by])
        self.hashes, self.order = np.insert(self.hashes, where, hashes[by]), np.insert(self.order, where, n + by)

    def _differ(self, cps: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Pre-tokens whose code points are not those of their row: two strings with one hash."""
        same = self.at[rows + 1] - self.at[rows] == lengths
        if same.all():
            bad = _slices(cps, starts, lengths) != self.cps[spread(self.at[rows], lengths)]
            if not bad.any():
                return np.zeros(0, np.int64)
            return np.unique(np.searchsorted(np.cumsum(lengths), np.flatnonzero(bad), "right"))
        out = np.flatnonzero(~same)
        rest = np.flatnonzero(same)
        return np.union1d(out, rest[self._differ(cps, starts[rest], lengths[rest], rows[rest])])

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (uint32) of all texts and offsets (n + 1) of the texts in them."""
        if self.special and any(s in t for t in texts for s in self.special):
            return self._cut(texts)
        cps, offsets = code_points(texts)
        alone = np.zeros(len(texts), bool)
        if self.whole:
            odd = np.flatnonzero((cps >= SAFE) | (cps == 0x130))  # U+0130 has two code points in lower case
            alone[np.searchsorted(offsets, odd, "right") - 1] = True
            if alone.any():
                return self._mixed(texts, alone)
        starts, lengths = self.split(cps, offsets, self.kinds.of(cps))
        flat, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i, j in chunks(starts, lengths):
            a, n = starts[i:j], lengths[i:j]
            rows = self._rows(cps, a, n)
            bad = self._differ(cps, a, n, rows)
            alone[np.searchsorted(offsets, a[bad], "right") - 1] = True
            counts.append(self.ids_at[rows + 1] - self.ids_at[rows])
            flat.append(self.ids[spread(self.ids_at[rows], counts[-1])])
        if alone.any():
            return self._mixed(texts, alone)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(flat), ends[np.searchsorted(starts, offsets)]

    def _mixed(self, texts: list[str], alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, at = self.tokens([t for t, a in zip(texts, alone, strict=True) if not a])
        parts, k = [], 0
        for t, a in zip(texts, alone, strict=True):
            if a:
                parts.append(np.asarray(self.whole(t), np.uint32) if self.whole else self._direct(t))
            else:
                parts.append(flat[at[k] : at[k + 1]])
                k += 1
        return _joined(parts)

    def _direct(self, text: str) -> np.ndarray:
        """Ids of a text without the memo: two of its pre-tokens have one hash."""
        cps, offsets = code_points([text])
        starts, lengths = self.split(cps, offsets, self.kinds.of(cps))
        return self.encode([text[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)])[0]

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Special strings are tokens of their own; what lies between them is encoded apart, as the libraries do."""
        pieces = [self.cutter.split(t) for t in texts]
        found = [self.cutter.findall(t) for t in texts]
        flat, at = self.tokens([p for ps in pieces for p in ps])
        parts, k = [], 0
        for ps, names in zip(pieces, found, strict=True):
            mine = []
            for i in range(len(ps)):
                mine.append(flat[at[k + i] : at[k + i + 1]])
                if i < len(names):
                    mine.append(np.array([self.special[names[i]]], np.uint32))
            k += len(ps)
            parts.append(np.concatenate(mine))
        return _joined(parts)


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


#: Pre-tokens that are encoded as one text.
TOGETHER = 500


def library_encoder(tokenizer) -> Callable[[list[str]], Encoded]:
    """Ids of many pre-tokens, and how many each has.

    Words of letters alone are encoded ``TOGETHER`` in one text, each after a space, where the splitter parts them again; the
    ids are dealt back by the bytes that they stand for, or by the mark that ends a word.  A text whose ids don't end with
    its words, and all other pre-tokens, are encoded one by one.
    """
    marks = tokenizer.normalizer is not None  # a vocabulary of words: spaces are dropped, ids that end words are marked
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    # In a byte-level vocabulary each letter of a token's string stands for one byte.
    width = np.zeros(max(vocab.values()) + 1, np.int64)
    for s, i in vocab.items():
        width[i] = s.endswith("</w>") if marks else len(s)

    def each(strings: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def encode(strings: list[str]) -> Encoded:
        like = [s.isalpha() for s in strings] if marks else [s[0] == " " and s[1:].isalpha() for s in strings]
        words = [i for i, x in enumerate(like) if x]
        alone = [i for i, x in enumerate(like) if not x]
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        flat, counts, places = [np.zeros(0, np.uint32)], np.zeros(len(strings), np.int64), []
        for group, found in zip(groups, each([(" " if marks else "").join([strings[i] for i in g]) for g in groups]), strict=True):
            ids = np.array(found, np.uint32)
            upto = np.cumsum(width[ids])
            ends = np.cumsum([1 if marks else len(s) if s.isascii() else len(s.encode()) for s in [strings[i] for i in group]])
            stops = np.searchsorted(upto, ends)
            if len(upto) and upto[-1] == ends[-1] and (upto[stops] == ends).all():
                flat.append(ids)
                counts[group] = np.diff(stops, prepend=-1)
                places += group
            else:
                alone += group
        for i, ids in zip(alone, each([strings[i] for i in alone]), strict=True):
            flat.append(np.array(ids, np.uint32))
            counts[i] = len(ids)
        ends = np.cumsum(counts[places + alone])
        starts = np.empty(len(strings), np.int64)
        starts[places + alone] = ends - counts[places + alone]
        return np.concatenate(flat)[spread(starts, counts)], counts

    return encode


def splitter(tokenizer) -> Kinds:
    if tokenizer.normalizer is not None:
        return Kinds(None)
    return Kinds(lambda pairs: [len(tokenizer.pre_tokenizer.pre_tokenize_str(p)) == 1 for p in pairs])


def special_ids(tokenizer) -> dict[str, int]:
    added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    if any(t.lstrip or t.rstrip or t.single_word for t in tokenizer.get_added_tokens_decoder().values()):
        raise ValueError("special tokens that take white space with them can't be cut out of a text")
    return added


_MEMOS: dict[str, Memo] = {}


def library_memo(path: str, rows: int = MEMO_ROWS) -> Memo:
    """The memo of this process for a vocabulary file of the tokenizers library; ``rows``: as it holds when it is made."""
    if path not in _MEMOS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        split = split_words_pattern if t.normalizer is not None else split_bytes_pattern
        whole = (lambda text: t.encode(text, add_special_tokens=False).ids) if t.normalizer is not None else None
        _MEMOS[path] = Memo(library_encoder(t), split, splitter(t), special_ids(t), whole, rows)
    return _MEMOS[path]
