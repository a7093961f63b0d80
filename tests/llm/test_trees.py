"""Merkle manifest, prefix trie and decontamination against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import core, decontaminate, line_dedup, merkle, prefix_trie, ranks

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, key int, path string, _at long"  # with clashing names


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def crc(x):
    return zlib.crc32(str(x).encode())


def rows_of(df, columns=None):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# ---------------------------------------------------------------- places

def test_places_and_numbers_of_groups(spark):
    rng = random.Random(2)
    data = [(rng.choice(["hot"] * 5 + [None, "b", "", "z"]), rng.randrange(50) if rng.random() < 0.9 else None) for _ in range(3000)]
    df = spark.createDataFrame(data, "g string, v long").repartition(7)
    out, total, _ = ranks.ranked(df, ["g"], ["v"], "places")
    groups = sorted({g for g, _ in data}, key=lambda g: (g is not None, g or ""))
    assert total == len(groups)
    got = sorted(map(tuple, out.select("_group", "_at", "v").collect()))
    want = []
    for k, g in enumerate(groups):
        values = sorted((v for x, v in data if x == g), key=lambda v: (v is not None, v or 0))
        want += [(k, i, v) for i, v in enumerate(values)]
    assert got == sorted(want, key=lambda r: r[:2])
    assert ranks.ranked(df.limit(0), ["g"], ["v"], "places")[0].count() == 0
    parts = [r[0] for r in spark.read.parquet(_).groupBy("_part").agg(F.count("*").alias("n")).select("n").collect()]
    assert len(parts) > 1 and max(parts) < 2000, "the hot group is spread"


# ---------------------------------------------------------------- manifest

def manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text)."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha(*map(enc, r))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            lo = i - i % 3
            out.append((level[lo:i], level[i + 1 : lo + 3]))
            i //= 3
        return out

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r, leaf(r)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {s: tree([h for _, h in by[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        for i, (r, h) in enumerate(by[s]):
            steps = path(trees[s], i) + path(top, j)
            t = leaf((*r[:4], r[4].replace("\n", ""))) if r[0] is not None and crc(r[0]) % 2 == 0 and r[4] is not None else h
            for before, after in steps:
                t = sha(*before, t, *after)
            out.append((r[0], h, trees[s][-1][0], top[-1][0], sha(*(x for b, a in steps for x in b + a)), t, t == top[-1][0]))
    return out


def even():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))


@pytest.fixture(scope="module")
def leaves():
    rng = random.Random(1)
    pick = lambda *x: rng.choice(x)
    rows = [(i, pick("a", "a", "a", "b", None, "é", "", f"host {i % 40}"), pick("en", None, ""), pick(1, None), pick(None, "", "x\ny", "q|1:")) for i in range(1500)]
    return rows + [(None, "a", "x", 1, "t")] * 2 + [(5, "a", "x", 1, "t"), (7, "solo", "x", 1, "t\n"), (8, "long", "x", 1, "line\n" * 400_000)]


def test_manifest(spark, leaves):
    df = spark.createDataFrame([(*r, "leaf", 1, "p", 2) for r in leaves], DOCS).repartition(5)
    got = rows_of(merkle.audit(df, even()))
    assert got == sorted(manifest(leaves), key=str)
    assert {r[-1] for r in got} == {True, False}
    assert sum(r[1] == "a" for r in leaves) > merkle.BLOCK, "more than one round"


def test_manifest_of_few_rows(spark, leaves):
    for n in (0, 1, 2, 3, 4):
        df = spark.createDataFrame([(*r, None, None, None, None) for r in leaves[:n]], DOCS)
        assert rows_of(merkle.audit(df, even())) == sorted(manifest(leaves[:n]), key=str)
    for n in (merkle.BLOCK, merkle.BLOCK + 1, 3 * merkle.BLOCK + 1):
        rows = [(i, "s", None, None, f"{i}\n") for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
        assert rows_of(merkle.audit(df, even())) == sorted(manifest(rows), key=str)


# ---------------------------------------------------------------- trie

def conversations(rows):
    """Rebuilt conversations of (conv_id, turn, role, text)."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    return {c: own.get(c - c % 100, [])[: crc(c) % 6] + own[c][crc(c) % 6 :] for c in own}


def nodes(found):
    by = {}
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            by.setdefault(tuple(turns[:d]), []).append(c)
    children, out = {}, {}
    for key in by:
        if key:
            children[key[:-1]] = children.get(key[:-1], 0) + 1
    for key in sorted(by, key=len, reverse=True):
        leaves, saved = out.get(key, (0, 0))
        leaves += key not in children
        saved += (len(by[key]) - 1) * (len(key[-1][1]) if key else 0)
        out[key] = leaves, saved
        if key:
            a, b = out.get(key[:-1], (0, 0))
            out[key[:-1]] = a + leaves, b + saved
    ends = lambda key: hashlib.sha256(",".join(str(c) for c in sorted(by[key]) if len(found[c]) == len(key)).encode()).hexdigest()
    return [(min(by[k]), len(k), min(by[k[:-1]]) if k else None, len(by[k]), children.get(k, 0), *out[k], ends(k)) for k in by]


def built(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int, node string").repartition(3)
    own, _ = prefix_trie.placed_turns(df)
    c = F.col("conv")
    return prefix_trie.rebuilt(own, c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6)


def test_trie(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 60), *range(205, 240), 300]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "ok", None, "", "été 😀"]), 1, ""))
    rows += [(7, None, "system", "first", 1, ""), (7, 0, "user", "again", 1, ""), (7, 0, "user", "again", 1, ""), (None, 1, "user", "of no one", 1, "")]
    rows += [(301, t, "user", "same", 1, "") for t in range(150)] + [(302, t, "user", "same", 1, "") for t in range(149)]  # long ones
    rows += [(303, 0, "user", "x" * 300_000, 1, "")]
    turns = built(spark, rows)
    kept = {}
    for r in turns.where("pos IS NOT NULL").collect():
        kept.setdefault(r["conv"], []).append((r["pos"], r["len"]))
    found = conversations([r[:4] for r in rows])
    assert {c: [n for _, n in sorted(v)] for c, v in kept.items()} == {c: [len(x) for _, x in t] for c, t in found.items() if t}
    assert any(not t for t in found.values()), "a conversation without turns"
    assert rows_of(prefix_trie.trie(turns)) == sorted(nodes(found), key=str)


def test_trie_of_many_copies(spark):
    """One conversation is that of all but a few, so its node ends with very many ids."""
    rows = [(c, t, "user", f"turn {t}", 1, "") for c in range(900) for t in range(3)] + [(900, 0, "user", "else", 1, "")]
    turns = built(spark, rows)
    got = rows_of(prefix_trie.trie(turns))
    assert got == sorted(nodes(conversations([r[:4] for r in rows])), key=str)
    ends = turns.where("pos = 2").select(F.lit(5).cast("long").alias("node"), "conv")
    want = hashlib.sha256(",".join(str(r["conv"]) for r in sorted(ends.collect(), key=lambda r: r["conv"])).encode()).hexdigest()
    assert [tuple(r) for r in prefix_trie.end_digests(ends, chunk=16).collect()] == [(5, want)]


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(built(spark, [])).collect() == []
    assert prefix_trie.trie(built(spark, [(None, 0, "user", "x", 1, "")])).collect() == []
    only = rows_of(prefix_trie.trie(built(spark, [(4, 0, None, None, 1, "")])))
    assert only == sorted(nodes(conversations([(4, 0, None, None)])), key=str)


# ---------------------------------------------------------------- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def hits(docs, items, window=10):
    table = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1) if m else ():
            table.setdefault(tuple(w[i : i + m]), set()).add(item)
    lengths = sorted({len(k) for k in table})
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if (k := tuple(w[i : i + m])) in table:
                    hit.update(range(i, i + m))
                    found |= table[k]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return out


@pytest.fixture(scope="module")
def tests_and_texts():
    rng = random.Random(9)
    draw = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))  # noqa: E731  few words, so matches are many
    items = [(i, draw(rng.randint(3, 40))) for i in range(40)]
    items += [(100, "one-word"), (101, "Ünique"), (102, None), (103, "  !?"), (None, "a b c d e f g a b c d e f g"), (0, "a second row of item zero is here with more words"), (7, draw(500)), (11, "a a a a a a a a a a a a a")]
    docs = [(i, draw(rng.randint(0, 120))) for i in range(60)]
    docs += [(60 + i, f"New text. {items[i][1].upper()}! And {draw(5)} more x{i}") for i in range(20)]
    docs += [(90, None), (91, ""), (92, "ÜNIQUE ünique Ünique"), (93, "one word"), (94, "x\ta\x00b"), (None, items[1][1]), (60, items[2][1]), (60, items[2][1])]
    docs += [(95, " ".join(f"w{i % 977}" for i in range(60_000)) + " " + items[46][1])]
    return items, docs


def test_decontamination(spark, tests_and_texts):
    items, docs = tests_and_texts
    benchmark = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, words int").repartition(3)
    df = spark.createDataFrame([(*r, "x", "y") for r in docs], "doc_id long, text string, _spans string, item string").repartition(4)
    want = sorted(hits(docs, items), key=str)
    assert rows_of(decontaminate.rate(df, benchmark)) == want
    assert rows_of(decontaminate.rate(df, benchmark, piece=15, part=50, most=1)) == want, "long items in pieces, a pass for each part"
    assert rows_of(decontaminate.rate(df, benchmark, window=3)) == sorted(hits(docs, items, 3), key=str)
    assert rows_of(decontaminate.rate(df, benchmark.limit(0))) == sorted(hits(docs, []), key=str)
    assert decontaminate.rate(df.limit(0), benchmark).collect() == []


def test_spans_are_cut(spark):
    item = "what is the capital of the old kingdom of long ago"  # eleven words
    benchmark = spark.createDataFrame([(1, item), (2, "short one")], "item_id long, text string")
    filler = " ".join(f"w{i}" for i in range(30))
    docs = [(1, f"{filler} 😀 What is the Capital of the old kingdom of long ago? {filler}"), (2, item + " yes"), (3, f"{filler} short ONE, {filler}"), (4, None), (5, filler)]
    df = spark.createDataFrame([(*r, "kept") for r in docs], "doc_id long, text string, `a.b` string")
    got = decontaminate.clean(df, benchmark)
    assert got.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: f"{filler} 😀 ? {filler}", 3: f"{filler} , {filler}", 4: None, 5: filler}
    longer = {r["doc_id"]: r["text"] for r in decontaminate.clean(df, benchmark, longest=5, coverage=1.0).collect()}
    assert longer == {1: f"{filler} 😀 ? {filler}", 2: " yes", 3: docs[2][1], 4: None, 5: filler}


def test_automaton_knows_all_substrings():
    rng = np.random.default_rng(4)
    for _ in range(20):
        pieces = [(str(i), rng.integers(0, 4, rng.integers(1, 25)).astype(core.U64)) for i in range(5)]
        found = decontaminate.Automaton(pieces, 4)
        text = rng.integers(0, 5, 60).astype(core.U64)
        number, a, b = found.stretches(text, np.array([0, 30, 60]))
        spans = set()
        for lo, hi in zip(a.tolist(), b.tolist()):
            spans |= {(lo + x, lo + y) for x, y in found.walk(number[lo:hi].tolist())[0]}
        windows = {tuple(h[i : i + min(4, len(h))].tolist()) for _, h in pieces for i in range(len(h) - min(4, len(h)) + 1)}
        want = {(s + i, s + i + m) for s in (0, 30) for m in range(1, 5) for i in range(30 - m + 1) if tuple(text[s + i : s + i + m].tolist()) in windows}
        assert spans == want


def test_long_runs_leave_the_memo(monkeypatch):
    """Runs without blanks, of one kind each, are long pre-tokens; the memo starts again once they fill it."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from tessera.llm import pretokens

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    memo = pretokens.Memo(pretokens.library_encoder(library), pretokens.split_bytes_pattern, pretokens.splitter(library), pretokens.special_ids(library))
    monkeypatch.setattr(pretokens, "MEMO_BYTES", 50_000)
    rng, held = random.Random(5), []
    for k in range(12):
        texts = ["".join(rng.choice("abcdefgh") for _ in range(5_000)) + f" word {k}", "a word"]
        flat, at = memo.tokens(texts)
        for i, t in enumerate(texts):
            assert flat[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids
        held.append(memo.cps.nbytes + memo.ids.nbytes)
    assert max(held) < 50_000 + 2 * 5_000 * 8 and min(held[4:]) < max(held)


def test_a_line_at_exactly_the_ratio_stays(spark):
    """On three of thirty pages it is at a tenth; on four it is above."""
    rows = [(i, "h", "\n".join([f"own {i}", *(["at the ratio"] if i < 3 else []), *(["above it"] if i < 4 else [])])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, host string, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(df, F.col("host")).collect()}
    assert got == {i: t.replace("\nabove it", "") for i, _, t in rows}
