"""Exact copies, tokenizer alignment and whitening against brute force, with odd rows and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from selvedge.llm import align, exactdup, fuse, whiten
from selvedge.llm.queries import llm_queries

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASHES = "id key row size digest bare batch best rows sha256 keep_id chunk links pairs n_a count x index y component".split()
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a b c"), (5, "abc"), (6, "a  b  c"), (7, "a  b  c"), (None, "abc"), (None, "zz z"),
    (None, "zzz"), (8, "x▁y"), (9, "q  r \t\n\n  s "), (10, "<|endoftext|> <s> <0x41> 'sx ..'s"), (11, "é 漢字 🎉🎉   x" * 50), (12, "a\0b\r\n"),
    (13, "w" * 5000), (13, "w" * 5000), (14, "word, " * 200_000), (15, "\xa0a b"), (16, "ab c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit(f"x-{c}") for c in CLASHES})


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def kept_copies(rows):
    groups = defaultdict(list)
    for place, (key, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), key is None, key or 0, place, key))
    found = []
    for bare, members in groups.items():
        best, digest = min(members), hashlib.sha256(bare.encode()).hexdigest()
        found += [(m[4], best[4], len(members), m == best, digest) for m in members]
    return found


@pytest.mark.parametrize("chars,batches", [(64, 4), (64, 1), (1, 3)])
def test_exact_copies_of_odd_rows(odd, chars, batches):
    got = exactdup.exact_duplicates(odd, batches=batches, digest_chars=chars)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert ordered(got.collect()) == ordered(kept_copies(ODD))


def test_exact_copies_of_nothing_and_of_other_keys(spark, odd):
    assert exactdup.exact_duplicates(odd.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "x y"), ("a", "xy "), ("c", None)], "doc_id string, text string")
    got = exactdup.exact_duplicates(named).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == {"a": ("a", 2, True), "b": ("a", 2, False), "c": ("c", 1, True)}


def test_one_group_of_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(exactdup, "SHARD", 300)  # several filters a snapshot
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text").otherwise(F.concat(F.lit("own "), F.col("id") % 3500)).alias("text")
    )
    rows = [tuple(r) for r in docs.collect()]
    assert ordered(exactdup.exact_duplicates(docs).collect()) == ordered(kept_copies(rows))


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 60_000])
def test_fuse_filters_know_their_keys(size):
    pick = np.random.default_rng(size)
    keys = np.unique(pick.integers(0, 1 << 63, size, dtype=np.uint64))
    made = fuse.build(keys)
    assert fuse.holds(made, keys).all()
    assert fuse.holds(made, pick.integers(1 << 63, (1 << 64) - 1, 50_000, dtype=np.uint64)).mean() < 0.006
    assert size < 1000 or len(made.table) < 1.5 * size


def test_equal_keys_cannot_be_built():
    with pytest.raises(RuntimeError):
        fuse.build(np.array([5, 5], dtype=np.uint64))


def aligned(rows):
    """The contract's rows from whole texts, by the libraries and loops over cuts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    left, right = Tokenizer.from_file(A_FILE), SentencePieceProcessor(model_file=B_FILE)
    left.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}

    def bytes_of(piece, k):
        return bytes([int(piece[3:5], 16)]) if right.is_byte(k) else piece.replace("▁", " ").encode()

    texts, times = [], Counter()
    for key, text in rows:
        a = left.encode(" " + (text or ""), add_special_tokens=False).ids
        b = right.encode(text or "")
        cut_a = [bytes(letters[x] for x in left.id_to_token(k)) for k in a]
        cut_b = [bytes_of(right.id_to_piece(k), k) for k in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(cut_a) != whole or b"".join(cut_b) != whole:
            texts.append((key, 0, 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in cut_a]).tolist(), np.cumsum([len(x) for x in cut_b]).tolist()
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            u, v = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(map(str, a[i:u])) + "|" + ",".join(map(str, b[j:v])))
            links.append((a[u - 1], b[v - 1]))
            i, j = u, v
        times.update(links)
        texts.append((key, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, b), n in times.items():
        most[b] = max(most[b], n)
    return [
        (key, n_a, n_b, len(links), len(links), sum(times[p] == most[p[1]] for p in links), sum(times[p] for p in links), digest)
        for key, n_a, n_b, links, digest in texts
    ]


def test_alignment_of_odd_rows(odd):
    got = align.align_tokenizers(odd, A_FILE, B_FILE)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ordered(got.collect()) == ordered(aligned(ODD))
    assert align.align_tokenizers(odd.limit(0), A_FILE, B_FILE).count() == 0
    empty = align.align_tokenizers(odd.filter("doc_id < 3 OR doc_id = 8"), A_FILE, B_FILE).collect()
    assert {tuple(r)[1:] for r in empty} == {(0, 0, 0, 0, 0, 0, "")}


def test_alignment_query_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(align, "CHUNK", 20_000)  # many chunks
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert ordered(llm_queries()["op13_align_tokenizers"](spark, SMALL).collect()) == ordered(aligned(docs))


def test_pointer_jumping_on_random_cuts():
    pick = random.Random(3)
    for _ in range(200):
        size = pick.randrange(1, 60)
        a, b = (sorted({size, *(k for k in range(1, size) if pick.random() < p)}) for p in (0.5, 0.3))
        both = sorted(set(a) & set(b))
        group_a, group_b = align.join_groups(np.array(a), np.array(b))
        for ends, group in ((a, group_a), (b, group_b)):
            assert group.tolist() == [sum(e < end for e in both) for end in ends]


def test_spelling_of_groups():
    shown = align.decimals(70_000)
    spelt, at = align.spell_groups(np.array([0, 12, 65535]), np.array([7, 10, 9, 1]), np.array([0, 0, 1]), np.array([0, 1, 1, 1]), shown)
    assert spelt == b"0,12|7;65535|10,9,1;" and at.tolist() == [7, 20]


def brute_whitening(rows, width, most=8):
    used = [(k, [float(c) for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100_000 for c in v + [0.0] * (width - len(v))] for _, v in used]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array(x, dtype=float) - np.array(sums) / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:most]
    return [k for k, _ in used], n, deviation, centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / np.trace(covariance)


def check_whitening(got, rows, width):
    keys, n, deviation, whitened, explained = brute_whitening(rows, width)
    count = len(explained)
    assert len(got) == len(keys) * count
    for k in range(count):
        own = {r.vec_id: r for r in got if r.component == k + 1}
        mine = np.array([own[key].whitened for key in keys])
        assert np.allclose(mine * np.sign(mine @ whitened[:, k]), whitened[:, k], atol=1e-8)
        assert all(abs(own[key].explained / explained[k] - 1) < 1e-8 and own[key].n == n for key in keys)
        assert [int(own[key].deviation) for key in keys] == deviation
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


def test_whitening_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(llm_queries()["op11_whiten_embeddings"](spark, SMALL).collect(), rows, 64)


def test_whitening_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(whiten, "BLOCK_ROWS", 16)  # many blocks
    monkeypatch.setattr(whiten, "BLOCKS", 4)
    pick = np.random.default_rng(1)
    rows = [(k, pick.normal(size=5).tolist()) for k in range(200)] + [(300, [1.0] * 5), (301, [1.0] * 5), (None, [0.5, -3.0, 1.0, 2.0, 9.0])]
    odd = [(400, None), (401, [1.0, None]), (402, [float("nan")] * 5), (403, [float("inf")] * 5), (404, [0.25, 0.5]), (405, [])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in CLASHES})
    check_whitening(whiten.whiten(frame).collect(), rows + odd, 5)
    assert whiten.whiten(frame.limit(0)).count() == 0
    assert whiten.whiten(frame.filter("vec_id = 405")).count() == 0
    flat = whiten.whiten(frame.filter("vec_id IN (300, 301)")).collect()
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in flat} == {(0, None, 0.0, 0.0)}
    huge = spark.createDataFrame([(k, [1e30 * (-1) ** k, 1.0]) for k in range(9)], "vec_id long, embedding array<float>")
    assert {r.deviation for r in whiten.whiten(huge).collect()} == {None}
