"""The operators of the training-data pipeline against brute force, exact round trips and SQL."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import byte_bpe, chat, core, fingerprints, jaccard_join, katz, line_dedup, packing, pretokens, quality, queries, repair, token_counts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, ids string, start long, class string, source string, n_chars long"  # with clashing names


def make(n=60, seed=4):
    rng = random.Random(seed)
    vocab = ["the", "of", "Ünited", "don't", "x's", "12", "3.5", "naïve", "word", "graph", "#", "|", "tree", "leaf", "node", "edge", "path", "root", "branch", "cycle"]
    base = " ".join(rng.choice(vocab) + str(rng.randint(0, 30)) for _ in range(120))
    texts = [None, "", " ", "\n\n", "one", "two words", "a b c", "<|endoftext|> x", "日本語 text é", "x" * 5000, "w " * 3000, base, base, base]
    for _ in range(n - len(texts)):
        words = base.split() if rng.random() < 0.4 else [rng.choice(vocab) + str(rng.randint(0, 60)) for _ in range(rng.randint(1, 200))]
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    return [(i * 3, t, "ids", 0, "class", f"s{i % 3}", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Null ids, repeated rows, and ids with two texts."""
    return spark.createDataFrame(rows[:20] + [(None, *r[1:]) for r in rows[10:16]] + [(0, "another text of this id", "", 0, "", "s", 1), (0, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def encoded(name, text, end=None):
    t = Tokenizer.from_file(P.path(name))
    return t.encode(text or "", add_special_tokens=False).ids + ([end] if end is not None else [])


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pretokens_equal_the_libraries():
    rng = random.Random(1)
    alphabet = "ab C'sstmdrevléß 12²\n\t\r  \u0085\x1c.,#\"ª¼İ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a" + chr(c) + "b " + chr(c) + " 1" + chr(c) + "'s" for c in range(0x320)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = Tokenizer.from_file(P.path(name))
        flat, at = pretokens.library_memo(P.path(name)).tokens(texts)
        for i, text in enumerate(texts):
            assert flat[at[i] : at[i + 1]].tolist() == t.encode(text, add_special_tokens=False).ids, text


WIDE = "Привет, мир’s “цитата” — 日本語テキスト 한국어 नमस्ते é́ e\u0301 ½ ٣٤ \u2003\u3000x\u2028 😀👍🏽 ①Ⅷ ﬁ \ufeff\u200d ǅ"


def wide_texts(n=400):
    rng = random.Random(8)
    out = ["".join(rng.choice(WIDE) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    planes = [c for c in range(0x300, 0x110000, 97) if not 0xD800 <= c < 0xE000]
    return out + ["a" + chr(c) + "b " + chr(c) + chr(c) + " 1" + chr(c) + "'s" for c in planes] + [WIDE * 20, "<|endoftext|>é’s<|endoftext|><|endoftext|> ж"]


def test_wide_scripts_take_the_same_path(spark, monkeypatch):
    import tiktoken

    texts = wide_texts()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    memo = pretokens.library_memo(P.path("byte_bpe_50k.json"))
    counter = token_counts._counter(P.path("byte_bpe_50k.json"), frozenset(token_counts.whole_tokens(P.path("byte_bpe_50k.json"))))
    bpe, own = byte_bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for m in (memo, counter, own):
        monkeypatch.setattr(m, "_mixed", None)  # no text may need it
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    flat, at = memo.tokens(texts)
    counts, places = counter.tokens(texts)
    mine, ends = own.tokens(texts)
    for i, text in enumerate(texts):
        ids = t.encode(text, add_special_tokens=False).ids
        assert flat[at[i] : at[i + 1]].tolist() == ids and counts[places[i] : places[i + 1]].sum() == len(ids), text
        assert mine[ends[i] : ends[i + 1]].tolist() == e.encode_ordinary(text), text


def test_a_full_memo_starts_again_and_collisions_are_seen(monkeypatch):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    one = lambda s: t.encode(s, add_special_tokens=False).ids
    encode, kinds = pretokens.library_encoder(t), pretokens.splitter(t)
    memo = pretokens.Memo(encode, pretokens.split_bytes_pattern, kinds, rows=3)
    texts = ["abc def", "ghi", "jkl mno pqr stu", "abc"]
    for _ in range(2):
        for x in texts:
            assert memo.tokens([x])[0].tolist() == one(x)
    monkeypatch.setattr(pretokens, "hash_slices", lambda c, s, n: (n % 2).astype(np.uint64))
    memo = pretokens.Memo(encode, pretokens.split_bytes_pattern, kinds)
    flat, at = memo.tokens(texts)
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [one(x) for x in texts]


def test_slices_longer_than_a_run_hash_alike(monkeypatch):
    text = "".join(random.Random(2).choice("abcß日") for _ in range(5000))
    texts = [f"{text} {text[:3000]} ab {text}", text[:3000], "ab"]
    whole, _ = core.word_hashes(texts)
    for size in (7, 1000):
        monkeypatch.setattr(core, "HASH_CHARS", size)
        core._powers.cache_clear()
        monkeypatch.setattr(core.chunks, "__defaults__", (size,))
        assert (core.word_hashes(texts)[0] == whole).all()
    core._powers.cache_clear()
    assert whole[0] == whole[3] and whole[1] == whole[4] and whole[2] == whole[5] and len(set(whole.tolist())) == 3


def test_op1_round_trip(spark, docs, odd, empty, rows, tmp_path):
    repair.write_ids(docs, P.path("byte_bpe_50k.json"), str(tmp_path / "a"), partitions=3)
    got = {r["doc_id"]: r for r in repair.read_ids(spark, str(tmp_path / "a")).collect()}
    at = 0
    for r in sorted(rows):
        ids = encoded("byte_bpe_50k.json", r[1], 2)
        assert (got[r[0]]["start"], got[r[0]]["n_tokens"], got[r[0]]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    repair.write_ids(odd, P.path("byte_bpe_50k.json"), str(tmp_path / "b"))
    assert repair.read_ids(spark, str(tmp_path / "b")).count() == odd.count()
    repair.write_ids(empty, P.path("byte_bpe_50k.json"), str(tmp_path / "c"))
    assert repair.read_ids(spark, str(tmp_path / "c")).count() == 0


def frequent(seq):
    """How often the most frequent pair occurs, overlaps in a run of one symbol not counted."""
    found, last = Counter(), None
    for i, p in enumerate(zip(seq, seq[1:])):
        if p[0] == p[1] and last == (p, i - 1):
            last = None
        else:
            found[p] += 1
            last = p, i
    return max(found.values(), default=0)


def test_op1_grammar_and_random_access():
    rng = np.random.default_rng(0)
    for ids in ([], [5], [7] * 1001, [1, 1, 2] * 500, rng.integers(0, 30, 20_000), np.tile(rng.integers(0, 50_000, 300), 40)):
        ids = np.array(ids, np.uint32)
        block = repair.Block(repair.write_block([1, None], np.array([len(ids), 0]), ids))
        assert (block.ids() == ids).all() and block.doc_ids == [1, None]
        assert int(block.lengths.sum()) >= 0 and all(len(repair.expand(np.array([block.first + i]), block.rules, block.first)) == n for i, n in enumerate(block.lengths))
        for _ in range(30):
            a = int(rng.integers(0, len(ids) + 1))
            b = int(rng.integers(a, len(ids) + 1))
            assert (block.decode(a, b) == ids[a:b]).all()
    assert len(block.low) < len(ids) / 4
    for t in range(200):
        ids = rng.integers(0, int(rng.integers(1, 12)), int(rng.integers(0, 400))).astype(np.uint32)
        ids = np.repeat(ids, rng.integers(1, 9, len(ids)))[:600] if t % 3 == 0 else ids
        for least in (0, 2, 3, 6):
            seq, rules, first = repair.grammar(ids, least)
            assert (repair.expand(seq, rules, first) == ids).all() and frequent(seq.tolist()) < max(least, 2)
    with pytest.raises(ValueError):
        repair.Block(b"none")


def test_op2_lines(spark, empty, monkeypatch):
    data = [(i, "h1" if i < 8 else None, f"menu\nown {i}\n\n menu\t\nfoot{i % 4}") for i in range(12)] + [(99, "h1", None)]
    df = spark.createDataFrame(data, "page_id long, source string, text string")
    got = {r["page_id"]: r for r in line_dedup.drop_lines(df, F.col("source"), ratio=0.5).collect()}
    assert got[0]["text"] == "own 0\n\nfoot0" and got[0]["_n_dropped"] == 2 and got[9]["text"] == "own 9\n\nfoot1"
    assert got[99]["text"] is None and got[99]["_n_dropped"] == 0
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)  # salted
    again = line_dedup.drop_lines(df, F.col("source"), ratio=0.5)
    assert {r["page_id"]: r for r in again.collect()} == got
    twice = line_dedup.drop_lines(df.union(df), F.col("source"), ratio=0.5).collect()  # rows count as pages
    assert sorted(map(str, twice)) == sorted(map(str, [*got.values(), *got.values()]))
    assert line_dedup.drop_lines(empty, F.col("source")).count() == 0
    urls = ["http://u:p@A.Example.com:80/x", "https://b.org", "nothing", None]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(line_dedup.page_host(F.col("u"))).collect()] == ["a.example.com", "b.org", None, None]


def test_rows_pass_through_with_names_that_clash(spark):
    names = ["_host", "_HOST_x", "_common", "_common_host", "__common", "_kept", "_n_lines", "gone_id", "slot", "score", "a.b", "class"]
    long = " ".join(f"w{i}" for i in range(80))
    data = [(i, f"menu\n{long if i < 2 else long.replace('w', f'v{i}x')}", "s", *[f"{n} {i}" for n in names]) for i in range(6)]
    data.append((None, None, None, *[None] * len(names)))
    df = spark.createDataFrame(data, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    rest = [df.columns.index(n) for n in names]
    own = {r[0]: [r[k] for k in rest] for r in data}

    lines = line_dedup.drop_lines(df, F.col("source"), counts=False)
    assert lines.columns == df.columns
    assert {r[0]: [r[k] for k in rest] for r in lines.collect()} == own and not lines.where("text LIKE 'menu%'").count()
    counted = line_dedup.drop_lines(df, F.col("source"))
    assert counted.columns == [c for c in df.columns if c != "_n_lines"] + ["_n_lines", "_n_dropped"]
    assert {r["doc_id"]: (r["_n_lines"], r["_n_dropped"]) for r in counted.collect()} == {i: (2, 1) for i in range(6)} | {None: (0, 0)}
    one = jaccard_join.keep_one(df)
    assert one.columns == df.columns
    assert {r[0]: [r[k] for k in rest] for r in one.collect()} == {i: v for i, v in own.items() if i != 1}
    good = quality.filter_documents(df, df.select("doc_id"))
    assert good.columns == df.columns
    assert {r[0]: [r[k] for k in rest] for r in good.collect()} == {i: v for i, v in own.items() if i is not None}


def test_op3_packing(docs, odd, empty, rows):
    got = packing.pack_documents(docs, P.path("word_bpe_49k.json"), capacity=256).collect()
    want = {r[0]: encoded("word_bpe_49k.json", r[1], 2) for r in rows}
    seen, sequences = {k: 0 for k in want}, {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        ids = want[r["doc_id"]]
        assert r["start"] == seen[r["doc_id"]] and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
        seen[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_length"]))
    assert seen == {k: len(v) for k, v in want.items()}
    for parts in sequences.values():
        at = 0
        for offset, length, size in sorted(parts):
            assert offset == at
            at += length
        assert at == size <= 256 and (size == 256 or size & (size - 1) == 0)
    assert packing.pack_documents(odd, P.path("word_bpe_49k.json")).selectExpr("sum(length)").first()[0] > 0
    assert packing.pack_documents(empty, P.path("word_bpe_49k.json")).count() == 0


def test_op3_balances_cost():
    rng = random.Random(2)
    lengths = [rng.randint(1, 900) for _ in range(1500)]
    pieces, sizes, spent = packing.pack(lengths, 1024)
    assert sum(sizes) == sum(lengths) and len(pieces) < 1.5 * len(lengths)
    full = [c for c, s in zip(spent, sizes) if s == 1024]
    assert np.std(full) < 0.15 * np.mean(full)


def packed_by_definition(lengths, capacity):
    """Descending documents, each to the sequence of lowest cost that has room, by looking at all sequences every time."""
    sizes = packing.sequence_sizes(sum(lengths), capacity)
    used, spent, pieces, full = [0] * len(sizes), [0.0] * len(sizes), [], 0
    todo = []

    def place(doc, start, n, s):
        pieces.append((doc, start, n, s, used[s]))
        used[s] += n
        spent[s] += packing.cost(n)

    for doc, n in enumerate(lengths):
        for k in range(n // capacity):
            place(doc, k * capacity, capacity, full)
            full += 1
        if n % capacity:
            todo.append((n % capacity, doc, n // capacity * capacity))
    while todo:
        todo.sort(key=lambda x: (-x[0], x[1], x[2]))
        n, doc, start = todo.pop(0)
        open_ones = [s for s in range(full, len(sizes)) if used[s] < sizes[s]]
        fit = [s for s in open_ones if sizes[s] - used[s] >= n]
        if fit:
            place(doc, start, n, min(fit, key=lambda s: (spent[s], s)))
        else:
            s = min(open_ones, key=lambda s: (used[s] - sizes[s], s))
            room = sizes[s] - used[s]
            todo.append((n - room, doc, start + room))
            place(doc, start, room, s)
    return pieces, sizes


def test_op3_each_document_goes_to_the_cheapest_sequence_with_room():
    rng = random.Random(11)
    for t in range(150):
        capacity = rng.choice([8, 64, 256])
        lengths = [rng.randint(1, rng.choice([4, capacity, 3 * capacity])) for _ in range(rng.randint(0, 60))]
        lengths += [7] * rng.randint(0, 9)  # ties
        pieces, sizes, _ = packing.pack(lengths, capacity)
        assert (sorted(pieces), sizes) == (lambda p, s: (sorted(p), s))(*packed_by_definition(lengths, capacity))


def test_op4_equals_tiktoken(docs, odd, empty, rows):
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in byte_bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for r in rows:
        ids = e.encode_ordinary(r[1] or "")
        assert got[r[0]]["n_tokens"] == len(ids) and got[r[0]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r[0]]["decoded_sha256"] == hashlib.sha256((r[1] or "").encode()).hexdigest()
    bpe, _ = byte_bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(3)
    for _ in range(800):
        s = bytes(rng.choice(b"abcdeinrst\xc3\xa9 ") for _ in range(rng.randint(0, 40)))
        assert bpe.encode_piece(s) == ([ranks[s]] if s in ranks else bpe.merge(s))
    assert byte_bpe.encode_decode(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == odd.count()
    assert byte_bpe.encode_decode(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


BLANK = " \t\n\v\f\r"


def split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rated(spark, rows, trusted, quantile=quality.QUANTILE):
    """Base figures, score and verdict of (id, text) rows by the definition; buckets and folds come from the operator's hash."""
    raw, good, found, part = Counter(), Counter(), [], [Counter() for _ in range(quality.FOLDS)]
    texts = spark.createDataFrame([(k, text or "") for k, (_, text) in enumerate(rows)], "k long, text string")
    folds = {r[0]: r[1] for r in texts.select("k", F.pmod(F.xxhash64("text"), F.lit(quality.FOLDS))).collect()}
    for k, (i, text) in enumerate(rows):
        ws = [w.translate({i: i + 32 for i in range(65, 91)}) for w in split(text)]
        mine = quality.buckets_of([text or ""])[0].tolist()
        assert len(mine) == len(ws) + max(len(ws) - 1, 0)
        found.append(mine)
        raw.update(mine)
        if i in trusted:
            good.update(mine)
            part[folds[k]].update(mine)
    n_raw, B = sum(raw.values()), quality.BUCKETS
    p = lambda b: (raw[b] + 1) / (n_raw + B)

    def mean(mine, good):
        n = sum(good.values())
        m = max(quality.PRIOR * n, 1.0)
        return sum(math.log((good[b] + m * p(b)) / (n + m)) - math.log(p(b)) for b in mine) / max(len(mine), 1)

    out, held = [], []
    for k, ((i, text), mine) in enumerate(zip(rows, found)):
        ws, text = split(text), text or ""
        windows = Counter(zip(ws, ws[1:], ws[2:]))
        covered = {i + k for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.strip(BLANK)]
        failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
        if i in trusted and not failed:
            held.append(mean(mine, good - part[folds[k]]))
        base = len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed
        out.append((base, mean(mine, good)))
    threshold = sorted(held)[int(quantile * len(held))] if held else -math.inf
    assert all(abs(score - threshold) > 1e-8 for base, score in out if not base[-1])
    return [(base, score, not base[-1] and score >= threshold) for base, score in out]


def test_op5_base_scores_and_verdicts(spark, docs, odd, empty, rows):
    trusted = spark.createDataFrame([(i,) for i in range(90, 180, 6)], "doc_id long")
    found = quality.rate(docs, trusted, quantile=0.6).collect()
    got = {r["doc_id"]: r for r in found}
    verdicts = Counter()
    for (key, *_), (base, score, kept) in zip(rows, rated(spark, [r[:2] for r in rows], set(range(90, 180, 6)), 0.6)):
        r = got[key]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base
        assert math.isclose(r["score"], score, abs_tol=1e-9) and r["kept"] == kept
        verdicts[base[-1], kept] += 1
    assert len(verdicts) == 3  # rejected by the base rules, by the score, and kept
    assert {r["doc_id"]: r for r in quality.rate(docs.repartition(7, "text"), trusted, quantile=0.6).collect()} == got  # to the last bit
    pairs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    mine = sorted((str(i), *base, kept) for (i, _), (base, _, kept) in zip(pairs, rated(spark, pairs, {30, 36})))
    rate = quality.rate(odd, spark.createDataFrame([(30,), (36,), (36,), (None,)], "doc_id long")).collect()
    assert sorted((str(r[0]), *tuple(r)[1:7], r["kept"]) for r in rate) == mine
    assert not any(r["kept"] == r["base_failed"] for r in quality.rate(odd, trusted.limit(0)).collect())  # all ratios are one
    assert quality.rate(empty, trusted).count() == 0
    kept = quality.filter_documents(docs, trusted, quantile=0.6)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if r["kept"])
    assert quality.filter_documents(odd, trusted.limit(0)).columns == odd.columns
    assert quality.filter_documents(empty, trusted).count() == 0
    labels = spark.createDataFrame([(5,), (5,), (None,), (10**12,)], "doc_id long")  # repeated, null and unknown ids
    assert quality.trusted_texts(docs.select("doc_id", "text"), labels).count() == docs.where("doc_id = 5").count()


def katz_brute(rows, order=2, scored=None):
    """The model by its definition, with dictionaries; scores of ``scored`` or of the rows themselves."""
    token = lambda t: [w.translate({i: i + 32 for i in range(65, 91)}) for w in split(t)] + ["</s>"]
    is_held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    grams = [Counter() for _ in range(order + 1)]
    contexts = [Counter() for _ in range(order + 1)]
    for r in rows:
        if not is_held(r[0]):
            ws = ["<s>", *token(r[1])]
            for k in range(1, order + 1):
                for i in range(1, len(ws)):
                    if i - k + 1 >= 0:
                        grams[k][tuple(ws[i - k + 1 : i + 1])] += 1
                        contexts[k][tuple(ws[i - k + 1 : i])] += 1
    stats = lambda c: ([sum(1 for v in c.values() if v == k) for k in range(1, katz.K + 2)], dict(Counter(c.values())))
    d = [None, *(katz.discounts(*stats(grams[k])) for k in range(1, order + 1))]
    N, V = sum(grams[1].values()), len(grams[1])
    taken = lambda k, c: d[k][min(c, katz.K + 1)] * c
    unknown = 1 - sum(taken(1, c) for c in grams[1].values()) / N
    after = [{} for _ in range(order + 1)]
    for k in range(2, order + 1):
        for g, c in grams[k].items():
            after[k].setdefault(g[:-1], []).append((g[-1], c))
    weight = {}

    def p(h, w):
        if not h:
            c = grams[1][(w,)]
            return taken(1, c) / N if c else unknown
        k = len(h) + 1
        if h not in after[k]:
            return p(h[1:], w)
        c = grams[k][(*h, w)]
        if c:
            return taken(k, c) / contexts[k][h]
        if h not in weight:
            left = 1 - sum(taken(k, c) for _, c in after[k][h]) / contexts[k][h]
            weight[h] = left / (1 - sum(p(h[1:], x) for x, _ in after[k][h]))
        return weight[h] * p(h[1:], w)

    out = {}
    for r in rows if scored is None else scored:
        ws = ["<s>", *token(r[1])]
        total = sum(math.log10(p(tuple(ws[max(0, i - order + 1) : i]), ws[i])) for i in range(1, len(ws)))
        base = sum(math.log10((grams[1][(w,)] + 0.1) / (N + 0.1 * (V + 1))) for w in ws[1:])
        out[r[0]] = is_held(r[0]), len(ws) - 1, sum(grams[1][(w,)] > 0 for w in ws[1:]), N, base, total
    words = [g[0] for g in grams[1]]
    for k in range(2, order + 1):
        for h in list(after[k])[:12]:
            assert math.isclose(sum(p(h, w) for w in words) + p(h, object()), 1, rel_tol=1e-9)
    return out


@pytest.mark.parametrize("order,tokens", [(2, 3_000_000), (3, 3_000_000), (3, 700), (4, 1500)])
def test_op6_katz(docs, odd, empty, rows, monkeypatch, order, tokens):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", tokens)
    want = katz_brute(rows, order)
    got = {r["doc_id"]: tuple(r)[1:] for r in katz.score_documents(docs, order).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][:4] == w[:4]
        assert np.allclose(got[k][4:], w[4:], rtol=1e-9, atol=1e-6), k
    if order == 2:
        assert katz.score_documents(odd).count() == odd.count()
        assert katz.score_documents(empty).count() == 0
        assert np.allclose(katz.discounts([10, 0, 0, 0, 0, 0, 10, 10])[1], 0.5)


def test_op6_stored_models_score_other_documents(spark, docs, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 900)
    katz.train(docs, str(tmp_path / "lm"), 3)
    other = [(i * 7 + 1, t, "", 0, "", "s", 1) for i, (_, t, *_) in enumerate(make(40, seed=9))]
    df = spark.createDataFrame(other, SCHEMA)
    got = {r["doc_id"]: tuple(r)[1:] for r in katz.score(df, str(tmp_path / "lm")).collect()}
    for k, w in katz_brute(rows, 3, other).items():
        assert got[k][:4] == w[:4] and np.allclose(got[k][4:], w[4:], rtol=1e-9, atol=1e-6), k


def test_op6_good_turing_runs_on_the_given_documents(spark, monkeypatch, caplog):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(400)
    used, real = [], katz.discounts
    monkeypatch.setattr(katz, "discounts", lambda *a: used.append((a, real(*a))) or used[-1][1])
    with caplog.at_level("INFO", "tessera.llm.katz"):
        got = {r["doc_id"]: tuple(r)[1:] for r in katz.score_documents(given).collect()}
    assert sum("Good-Turing discounts" in r.message for r in caplog.records) == 2
    for (n, table), d in used:
        c = np.arange(1, katz.K + 1)
        assert ((d[1:-1] > 0) & (d[1:-1] < 1)).all() and (np.diff(d[1:-1]) > 0).all()
        assert not np.allclose(d[1:-1], 1 - n[0] / (n[0] + 2 * n[1]) / c)  # the absolute discount
        r = np.array(sorted(table))
        gap = [(r[i + 1] if i + 1 < len(r) else 2 * r[i] - r[i - 1]) - (r[i - 1] if i else 0) for i in range(len(r))]
        x, y = np.log(r), np.log([2 * table[k] / g for k, g in zip(r.tolist(), gap)])
        slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
        star, cut = (1 + 1 / c) ** (slope + 1), (katz.K + 1) ** (slope + 1)
        assert np.allclose(d[1:-1], (star - cut) / (1 - cut))
    mine = iter([d for _, d in used])
    tables = []
    monkeypatch.setattr(katz, "discounts", lambda *a: tables.append(a) or next(mine))
    want = katz_brute([tuple(r) for r in given.collect()])
    assert [a[0] for a in tables] == [a[0] for a, _ in used] and [dict(a[1]) for a in tables] == [a[1] for a, _ in used]
    for k, w in want.items():
        assert got[k][:4] == w[:4] and np.allclose(got[k][4:], w[4:], rtol=1e-9, atol=1e-6), k


def shingles(text, n):
    ws = split((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def test_op7_fingerprints(spark, docs, odd, empty, rows):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        m = len(text) // 3
        edit = text[: len(text) - m] + after[:m]
        g = got[r[0]]
        assert g["n_chars"] == len(text) and g["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        for near, other in (("near_edited", edit), ("near_next", after)):
            a, b = shingles(text, 5), shingles(other, 5)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(g[near] - true) < (1e-9 if len(a | b) <= fingerprints.K else 0.2), (r[0], near)
    assert got[33]["fingerprint"] == got[36]["fingerprint"]
    assert fingerprints.fingerprint_documents(odd).count() == odd.count()
    assert fingerprints.fingerprint_documents(empty).count() == 0
    whole = docs.select("doc_id", fingerprints.sketch(F.col("text")).alias("s"))
    merged = fingerprints.merge_all(whole.withColumn("k", F.lit(1)), ["k"], "s").first()["s"]
    assert merged == sorted({h for r in whole.collect() for h in r["s"]})[: fingerprints.K]
    c = spark.createDataFrame([([1, 2, 3, 4], [3, 4, 5])], "a array<bigint>, b array<bigint>").select(fingerprints.containment(F.col("a"), F.col("b")), fingerprints.distinct_shingles(F.col("a")), fingerprints.resemblance(F.col("a"), F.col("b"))).first()
    assert tuple(c) == (0.5, 4.0, 0.4)


def test_op8_chat(spark):
    rng = random.Random(5)
    for _ in range(3000):
        s = "".join(rng.choice("<|>turnexd:0 image") for _ in range(rng.randint(0, 12)))
        parts = [chat.Part("text", s[:4]), chat.Part("text", s[4:]), chat.Part("image", ref="r", width=30, height=15)]
        got = chat.flatten(parts, 3)
        role, back = chat.parse(chat.format_turn(s, got.content)[0])[0]
        assert role == s and "".join(p.text for p in back) == s and [p.ref for p in back if p.kind == "image"] == ["3"]
        assert got.expanded_tokens == 3 * 2 and got.attachments == [{"number": 3, "kind": "image", "ref": "r", "tokens": 6}]
    sizes = chat.flatten([chat.Part("audio", seconds=1.01), chat.Part("document", pages=2)])
    assert [a["tokens"] for a in sizes.attachments] == [26, 1024]
    with pytest.raises(ValueError):
        chat.flatten([chat.Part("video")])
    with pytest.raises(ValueError):
        chat.parse("<|turn|>x")
    data = [(1, 1, "assistant", "<|end|> hi"), (1, 0, "user", None), (None, 0, None, "x"), (1, 1, "assistant", "<|end|> hi")]
    df = chat.format_messages(chat.text_messages(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")))
    got = {r["conv_id"]: r for r in chat.read_back(df).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 20 and got[1]["loss_sha256"] == hashlib.sha256(b"<|end|> hi<|end|> hi").hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\n<|end|> hi\nassistant\n<|end|> hi\n").hexdigest() and got[None]["loss_chars"] == 0


def test_op8_stored_turns_read_back_in_any_order(spark, tmp_path):
    parts = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    image = lambda ref: ("image", None, ref, 28, 14, None, None)
    text = lambda t: ("text", t, None, None, None, None, None)
    data = [(c, t, "assistant" if t % 2 else "user", [text(f"<|end|> {c} {t}"), image(f"r{t}"), text("tail")], "extra") for c in range(6) for t in range(8)]
    data += [(None, None, None, None, None), (7, 0, "user", [], "x"), (8, 0, "assistant", [text("é" * 3_000_000)], "x")]
    df = spark.createDataFrame(data, f"conv_id long, turn long, role string, parts {parts}, place string").repartition(5)
    turns = chat.format_messages(df)
    live = sorted(chat.read_back(turns).collect(), key=str)
    turns.repartition(7, "formatted").write.parquet(str(tmp_path / "turns"))
    stored = spark.read.parquet(str(tmp_path / "turns"))
    assert sorted(chat.read_back(stored.repartition(3, "turn")).collect(), key=str) == live and len(live) == 9
    got = {r["conv_id"]: r for r in live}
    said = "".join(f"<|end|> 2 {t}tail" for t in range(1, 8, 2))
    assert got[2]["n_turns"] == 8 and got[2]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[8]["loss_chars"] == 3_000_000
    refs = [(a["number"], a["ref"]) for r in sorted(turns.where("conv_id = 3").collect(), key=lambda r: r["place"]) for a in r["attachments"]]
    assert refs == [(i, f"r{i}") for i in range(8)]
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_messages(chat.text_messages(none))).count() == 0


def components(rows, n, percent):
    sets = {r[0]: shingles(r[1], n) for r in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize("n,percent,part,few", [(4, 85, 4_000_000, 64), (5, 80, 4_000_000, 1), (2, 60, 300, 64)])
def test_op9_join(docs, rows, n, percent, part, few, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", part)
    monkeypatch.setattr(jaccard_join, "PART_SETS", few)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 500)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs, n, percent).collect()}
    assert got == components(rows, n, percent)


def near_chain():
    """Texts each near the next; of ids 1, none, none, 4: the ends are linked through rows without ids."""
    words = [f"w{i}é" for i in range(100)]
    out = []
    for i, key in enumerate((1, None, None, 4)):
        out.append((key, " ".join(words[3 * i : 3 * i + 85])))
    return out


def test_op9_rows_without_ids_link_like_others(spark, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 50)
    data = [*near_chain(), (None, "alone " * 9), (7, None), (None, None), (9, near_chain()[3][1]), (9, "another text of nine words or more than that")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = jaccard_join.join(df, 4, 85).collect()
    numbered = components([(i, t) for i, (_, t) in enumerate(data)], 4, 85)
    smallest = {}
    for i, (key, _) in enumerate(data):
        smallest.setdefault(numbered[i][1], []).append(key)
    want = [(key, numbered[i][0], min((k for k in smallest[numbered[i][1]] if k is not None), default=None)) for i, (key, _) in enumerate(data)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and (None, 82, 1) in want and (4, 82, 1) in want
    kept = jaccard_join.keep_one(df, 4, 85).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [data[0], data[4], data[5], data[6], data[8]]))


def test_op9_words_that_a_polynomial_confuses(spark):
    """Thue-Morse words and their complements have one polynomial modulo 2**64, whatever its base."""
    morse = ["".join("ab"[i.bit_count() & 1] for i in range(1 << k)) for k in (4, 8, 9, 10, 11, 12)]
    data = list(enumerate([t for x in morse for t in (x, x.translate({97: 98, 98: 97}))]))
    data += [(20, " ".join([morse[3], data[7][1]] * 9)), (21, "one two three " + morse[4]), (22, "One two three " + data[9][1]), (23, morse[5].upper())]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(spark.createDataFrame(data, "doc_id long, text string"), 4, 85).collect()}
    assert got == components(data, 4, 85) and got[23] == (1, 10) and got[7] == (1, 7) and got[20] == (2, 20)


def test_op9_edges(odd, empty):
    got = jaccard_join.join(odd, 4, 85).collect()
    assert len(got) == odd.count() and all(r["component_id"] is not None for r in got if r["doc_id"] is not None)
    assert jaccard_join.join(empty, 4, 85).count() == 0
    assert jaccard_join.keep_one(empty).count() == 0


def test_op9_tree_equals_brute_force():
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 2**63, 200).astype(np.uint64) for _ in range(5)]
    sets = []
    for i in range(150):
        s = base[i % 5].copy()
        s[rng.integers(0, 200, rng.integers(0, 40))] = rng.integers(0, 2**63)
        sets.append(np.unique(s))
    links = {(i, j) for i in range(150) for j in range(i) if 185 * len(np.intersect1d(sets[i], sets[j])) >= 85 * (len(sets[i]) + len(sets[j]))}

    def labels(pairs):
        out = list(range(150))
        for _ in range(10):
            for a, b in pairs:
                out[a] = out[b] = min(out[a], out[b])
        return out

    tree = jaccard_join.Tree(sets, jaccard_join.bitmap_bits(sets))
    mine = np.arange(150)
    found = jaccard_join.dual_links(tree, tree, 85, mine, mine)
    assert {tuple(sorted(x, reverse=True)) for x in found} <= links and len(found) < 150
    assert labels(found) == labels(links)
    a, b = jaccard_join.Tree(sets[:70], 512), jaccard_join.Tree(sets[70:], 512)
    across = jaccard_join.dual_links(a, b, 85, np.arange(70), np.arange(70, 150))
    assert {(y + 70, x) for x, y in across} <= links


def test_op10_counts(docs, odd, empty, rows):
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, P.path("byte_bpe_50k.json"), 100).collect()}
    for r in rows:
        n = len(encoded("byte_bpe_50k.json", r[1]))
        assert (got[r[0]]["n_bytes"], got[r[0]]["n_tokens"], got[r[0]]["over_limit"]) == (len((r[1] or "").encode()), n, n > 100)
    assert token_counts.count_tokens(odd, P.path("byte_bpe_50k.json")).count() == odd.count()
    assert token_counts.count_tokens(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_queries_equal_their_sql(spark):
    from tests.test_engine import compare

    compare(spark, queries.queries(), queries.oracle_sql(), queries.oracle_sql())


def kept_lines(rows):
    """(id, text) of (id, text, source) without the boilerplate of their source; texts with the same lines count once."""
    trimmed = lambda x: x.strip(" \t\r")
    pages = {}
    for _, text, source in rows:
        pages.setdefault(source, set()).add(frozenset(trimmed(x) for x in (text or "").split("\n")) - {""})
    often = {s: {x for p in found for x in p if (n := sum(x in q for q in found)) >= 3 and n > 0.1 * len(found)} for s, found in pages.items()}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if trimmed(x) not in often[s])) for i, t, s in rows]


def test_pipeline_equals_plain_python(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    stages = {"quality_rules": [], "line_dedup": [], "ngram_jaccard_join": []}
    given = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, SF)
        assert out.columns == docs.columns
        stages[name] = {r["doc_id"]: r["text"] for r in out.collect()}
        given = spark.createDataFrame(out.toPandas(), docs.schema)

    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    verdicts = rated(spark, [r[:2] for r in rows], {r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0})
    rows = [r for r, (_, _, kept) in zip(rows, verdicts) if kept]
    assert stages["quality_rules"] == {r[0]: r[1] for r in rows} and 0 < len(rows) < docs.count()
    lines = kept_lines(rows)
    assert stages["line_dedup"] == dict(lines)
    found = components(lines, 5, 80)
    left = {i: t for i, t in lines if found[i][1] == i}
    assert stages["ngram_jaccard_join"] == left and len(left) < len(lines)

    got = corpus_pipeline.run(spark, SF).collect()
    want, seen, sequences = {i: encoded("word_bpe_49k.json", t, 2) for i, t in left.items()}, dict.fromkeys(left, 0), {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        ids = want[r["doc_id"]]
        assert r["start"] == seen[r["doc_id"]] and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
        seen[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == {i: len(x) for i, x in want.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0


def test_stages_take_odd_and_empty_tables(spark, odd, empty, rows):
    import corpus_pipeline

    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            assert name == "packing" or out.columns == docs.columns
            assert n == 0 if docs is empty else name == "quality_rules" or n > 0, name


def test_a_text_of_many_megabytes(spark):
    """Fifty million code points in one row, among short ones; the words are few, so the expected numbers are known."""
    big = "lorem ipsum dolor sit amet " * 1_900_000 + "x" * 400_000
    df = spark.createDataFrame([(1, big), (2, "short text"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(df, P.path("byte_bpe_50k.json")).collect()}
    once = len(encoded("byte_bpe_50k.json", " lorem ipsum dolor sit amet"))
    first = len(encoded("byte_bpe_50k.json", "lorem ipsum dolor sit amet"))
    assert got[1]["n_bytes"] == len(big) and got[2]["n_tokens"] == 2
    assert got[1]["n_tokens"] == first + once * 1_899_999 + len(encoded("byte_bpe_50k.json", " " + "x" * 400_000))
    rate = {r["doc_id"]: r for r in quality.rate(df, df.where("doc_id = 2").select("doc_id")).collect()}
    assert rate[1]["n_words"] == 9_500_001 and rate[1]["base_failed"]
    joined = {r["doc_id"]: r for r in jaccard_join.join(df, 4, 85).collect()}
    assert joined[1]["n_shingles"] == 6 and joined[3]["n_shingles"] == 0
    pieces = packing.pack_documents(df, P.path("word_bpe_49k.json")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all")).collect()
    assert all(r["n"] == r["all"] for r in pieces) and len(pieces) == 3


def test_pipeline_keeps_one_of_many_copies(spark):
    """Copies are a third of source a and all of source c; every page of a source has its menu."""
    import corpus_pipeline

    rng = random.Random(6)
    text = lambda: "\n".join(" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(2))
    shared = {s: text() for s in "abc"}
    data = [(i, f"menu of a\n{shared['a'] if i % 3 == 0 else text()}", "a") for i in range(30)]
    data += [(i, f"menu of b\n{text()}", "b") for i in range(30, 60)] + [(i, shared["c"], "c") for i in range(60, 64)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)

    pages = {s: {tuple(t.split("\n")) for _, t, x in data if x == s} for s in "abc"}
    often = {s: {x for p in pages[s] for x in p if (n := sum(x in q for q in pages[s])) >= 3 and 10 * n > len(pages[s])} for s in "abc"}
    assert often == {"a": {"menu of a"}, "b": {"menu of b"}, "c": set()}
    lines = corpus_pipeline.site_lines(spark, docs, SF)
    left = {i: "\n".join(x for x in t.split("\n") if x not in often[s]) for i, t, s in data}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == left
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_duplicates(spark, lines, SF).collect()}
    first = {}
    for i in sorted(left):
        first.setdefault(left[i], i)
    assert kept == {i: t for t, i in first.items()} and kept[0] == shared["a"] and kept[60] == shared["c"]
