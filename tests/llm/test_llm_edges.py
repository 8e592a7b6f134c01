"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import base64
import gzip
import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from llm_brute import near_groups
from pyspark.sql import functions as F

from selvedge.llm import chat, classifier, components, decontaminate, licenses, mixing, neardup, quality_rules, secrets, stages, tokens, warc, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside, given to columns of the input.
CLASHES = ["key", "id", "spans", "kinds", "kept", "n", "row", "block", "_key", "salt", "u", "v", "component_id", "n_tokens", "pass"]
WORDS = "the quick brown fox jumps over a lazy dog while seven wise owls sing of rain and of the sea at night".split()


def prose(n, seed):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + (str(pick.randrange(40)) if pick.random() < 0.8 else "") for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    long_text = prose(60_000, 1)
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, prose(120, 2)), (5, prose(120, 2)), (5, prose(120, 2)), (6, prose(121, 3)),
        (None, prose(90, 4)), (None, None), (7, long_text), (8, long_text + " end"), (9, "one two"), (10, "one two"), (11, "é " * 70),
        (12, 'password: "hunter22abc" and ' + "0123456789abcdef" * 2), (None, "secret=abcdefgh"),
    ]
    docs = spark.createDataFrame([(i, t, "en", None if k % 3 == 0 else f"s{k % 2}", 0) for k, (i, t) in enumerate(rows)], SCHEMA)
    return docs.withColumns({c: F.lit(f"x-{c}") for c in CLASHES})


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("doc_id = -1")


def test_word_hashes_do_not_depend_on_where_blocks_end():
    long_word = "x" * (words.BLOCK + 7)
    import pyarrow as pa

    column = pa.array([f"tail {long_word}", None, "", "tail", f"{'word ' * 150_000}{long_word} tail"])
    found = {}
    for low, high, data, at in words.chunks(column):
        hashes, offsets = words.hash_words(data, at)
        for k in range(low, high):
            found[k] = hashes[offsets[k - low] : offsets[k - low + 1]].tolist()
    assert [len(found[k]) for k in range(5)] == [2, 0, 0, 1, 150_002]
    assert found[0][0] == found[3][0] == found[4][-1] and found[0][1] == found[4][-2]
    assert len(set(found[4])) == 3


def test_shingles_of_short_texts():
    import pyarrow as pa

    _, _, data, at = next(words.chunks(pa.array(["A b", "a  b", "a b c d e f", "", "b c d e f"])))
    values, offsets = words.shingles(*words.hash_words(data, at))
    assert offsets.tolist() == [0, 1, 2, 4, 4, 5]
    assert values[0] == values[1] and values[3] == values[4] and len(set(values.tolist())) == 3


def test_components_of_paths_stars_and_rings(spark):
    pick = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(200 + k, 200 + (k + 1) % 9) for k in range(9)]
    edges += [(300, 300), (7, 6), (7, 6)]
    pick.shuffle(edges)
    found = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert dict(found.collect()) == {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 160)} | {k: 200 for k in range(201, 209)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bands_miss_hardly_any_pair():
    for similarity in (0.5, 0.8, 0.85, 0.95):
        bands, rows = neardup.bands_for(similarity)
        assert bands * rows <= neardup.HASHES and (1 - similarity**rows) ** bands <= neardup.MISS


def test_near_duplicates_on_odd_rows(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[k].n_shingles for k in (1, 2, 3, 9)] == [0, 0, 0, 1]
    assert [by[k].component_id for k in (1, 2, 3)] == [1, 2, 3]
    assert by[5].component_id == 4 and not by[5].kept and by[4].kept
    assert by[8].component_id == 7 and by[10].component_id == 9 and by[6].component_id == 6
    assert all(r.kept for r in got if r.doc_id is None)
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    """A chain of edits longer than a block, worked as a whole and bucket by bucket."""
    text, pick, docs = prose(150, 6).split(), random.Random(6), {}
    for k in range(90):
        text[pick.randrange(len(text))] = f"edit{k}"
        docs[k * 3] = " ".join(text)
    exact = near_groups(docs, 85)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    monkeypatch.setattr(neardup, "BLOCK_CLASSES", 16)
    whole = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame, similarity=0.85).collect()}
    monkeypatch.setattr(neardup, "GROUP_CLASSES", 20)
    split = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame, similarity=0.85).collect()}
    assert whole == exact == split


def test_pipeline_dedup_keeps_one_row_of_each_group(spark, odd):
    kept = stages.near_dedup(spark, odd, "")
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 7, 9, 11, 12] and ids.count(None) == 3


def test_pipeline_judges_rows_without_an_id(spark, tmp_path):
    item, text = " ".join(f"leak{k}" for k in range(30)), prose(120, 31)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"{prose(50, 32)} {item}"), (None, text), (None, text), (None, text + " end"), (7, prose(120, 33)), (None, prose(120, 33)), (8, item), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = stages.decontaminate(spark, docs, str(tmp_path)).collect()
    assert sorted(map(tuple, clean), key=str) == sorted((r for r in rows if item not in (r[1] or "")), key=str)
    single = [tuple(r) for r in stages.near_dedup(spark, docs, "").collect()]
    assert len(single) == 5 and {rows[0], rows[4], rows[6], rows[7]} < set(single) and len({(None, text), (None, text + " end")} & set(single)) == 1


def test_leaks_of_copies_and_paraphrases(spark, odd):
    item = "Which owl sings when the rain falls over the wide grey harbour at dusk and nobody listens? The seventh owl by the northern pier."
    other = "Name a stone that floats on warm water in the month of june while children look on. Pumice of the western islands."
    paraphrase = item.replace("wide grey harbour", "broad dark port").replace("nobody listens", "people sleep").replace("Which", "What")
    texts = [(1, f"{prose(200, 7)} {item.upper()} {prose(100, 8)}"), (2, f"{prose(50, 9)}\n{paraphrase}"), (3, prose(400, 10)), (3, prose(400, 10)), (4, None), (None, item)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"item": F.lit(1), "places": F.lit(2), "sums": F.lit(3)})
    benchmark = spark.createDataFrame([(10, item), (11, other), (12, None), (13, ""), (14, item)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert set(found) == {(d, i) for d in (1, 2, None) for i in (10, 14)}
    assert found[1, 10].kind == "copy" and found[1, 10].first_word == 200 and found[1, 10].share == 1
    assert decontaminate.find_leaks(docs.limit(0), benchmark).count() == 0
    assert decontaminate.find_leaks(odd, benchmark.limit(0)).count() == 0


def test_long_items_are_judged_whole(spark):
    """Passages only find an item: neither a last word nor a part of it is a leak, all parts together are."""
    tail, long = [f"question{k}" for k in range(65)], [f"item{k}" for k in range(94)]
    answer = "six words that close the case".split()
    kept = [w if k % 3 else f"other{k}" for k, w in enumerate(long[:64])] + [w if k % 4 == 0 else f"other{k}" for k, w in enumerate(long[64:])]
    many = [f"page{k}" for k in range(700)]
    texts = [
        (1, f"{prose(100, 21)} {tail[-1]} {prose(100, 22)}"), (2, f"{prose(40, 23)} {' '.join(kept + answer)}"), (3, " ".join(kept)),
        (4, f"{prose(90, 24)} {' '.join(w for k, w in enumerate(many) if k % 6)} {prose(90, 25)}"), (5, " ".join(many[320:480])),
    ]
    benchmark = spark.createDataFrame([(1, " ".join(tail)), (2, f"{' '.join(long)}. {' '.join(answer)}."), (3, " ".join(many))], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), benchmark).collect()}
    assert set(found) == {(2, 2), (4, 3)}
    assert found[2, 2].kind == "paraphrase" and found[2, 2].share == 0.56
    assert found[4, 3].kind == "copy" and found[4, 3].share == 583 / 700 and (found[4, 3].first_word, found[4, 3].last_word) == (90, 672)


def test_paraphrases_with_answers_of_any_length(spark):
    """Two thirds of the question and an answer of one word, of two, in quotes or none are leaks; a wrong answer is not."""
    closings = [" Paris.", " 42.", " Grey pumice!", ' "Basalt."', "", " Lisbon.", " Grey chalk."]
    said = ["Paris", "42", "grey pumice", "basalt", "", "Vienna", "chalk grey"]
    questions = [[f"ask{k}word{n}" for n in range(24)] for k in range(len(closings))]
    benchmark = spark.createDataFrame([(k, f"{' '.join(q)}?{c}") for k, (q, c) in enumerate(zip(questions, closings, strict=True))], "item_id long, text string")
    texts = [f"{prose(80, 40 + k)} {' '.join(w if n % 3 else 'instead' for n, w in enumerate(q))} {s} {prose(60, 60 + k)}" for k, (q, s) in enumerate(zip(questions, said, strict=True))]
    found = decontaminate.find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(k, k) for k in range(5)}
    assert {r.kind for r in found} == {"paraphrase"} and all(0.6 < r.share < 0.75 for r in found)


def test_common_subsequence_is_that_of_the_table():
    pick = random.Random(3)
    for _ in range(200):
        a, b = ([pick.randrange(5) for _ in range(pick.randrange(1, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row, old = [0], row
            for k, y in enumerate(b):
                row.append(old[k] + 1 if x == y else max(old[k + 1], row[k]))
        assert decontaminate.common_length(decontaminate._masks(a), len(a), b)[0] == row[-1]


def test_trigram_queries_follow_the_pattern():
    query = secrets.trigram_query
    assert query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert query("[0-9a-f]+") is None and query("(abc)?x") is None and query("ab|abcd") is None
    assert set(query("(abc|xyz)[0-9]+end")) == {frozenset({"abc", "end"}), frozenset({"xyz", "end"})}
    assert query("(abc)+") == [frozenset({"abc"})]


def test_secrets_in_odd_rows(spark, odd, none):
    got = [(r._row.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in secrets.scan_secrets(odd).collect()]
    assert len(got) == odd.count()
    found = {(i, s) for i, spans in got for s in map(tuple, spans)}
    assert found == {(12, ("assign", 0, 22)), (12, ("hex", 28, 60)), (None, ("assign", 0, 15))}
    assert secrets.scan_secrets(none).count() == 0
    cleaned = {r.doc_id: r for r in stages.secret_scan(spark, odd, "").filter("doc_id = 12").collect()}
    assert cleaned[12].text == '[assign]" and [hex]' and cleaned[12].n_chars == 19


def test_overlapping_secrets_are_redacted_once(spark):
    docs = spark.createDataFrame([(1, "é token = " + "ab12" * 8 + " end AKIA" + "Z" * 16)], "doc_id long, text string")
    row = secrets.scan_secrets(docs).select(secrets.span_text(F.col("spans")).alias("s"), secrets.redact(F.col("_row.text"), F.col("spans")).alias("t")).first()
    assert (row.s, row.t) == ("assign:2:42,hex:10:42,access:47:67", "é [assign] end [access]")


def test_quality_of_odd_rows(odd, none):
    got = quality_rules.assess(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [(by[k].n_words, by[k].kept) for k in (1, 2, 3)] == [(0, False)] * 3
    assert by[11].n_repeat_words == 70 and by[11].base_failed and by[4].kept and by[7].n_words == 60_000
    assert quality_rules.assess(none).count() == 0
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and kept.filter("kept <> 'x-kept'").count() == 0 and kept.count() == sum(r.kept for r in got)


def test_layouts_become_the_same_turns(spark):
    records = [
        '{"prompt":"a <b>","response":"c"}', '{"question":"a <b>","answer":"c"}', '{"instruction":"a <b>","output":"c"}',
        '{"messages":[{"role":"user","content":"a <b>"},{"content":"c","role":"assistant"}]}',
        '{"conversations":[{"from":"human","value":"a <b>"},{"from":"gpt","value":"c"}]}',
        '{"chat":{"turns":[{"role":"user","text":"a <b>"},{"role":"assistant","text":"c"}]}}',
        '{"instruction":"s","input":"a <b>","output":null}', '{"unknown":1}', "[1]", "not json", None, '{"prompt":"\\ud800x"}', '{"messages":[]}',
    ]
    frame = spark.createDataFrame([(k, "x", r) for k, r in enumerate(records)], "conv long, key string, record string")
    turns = chat.canonical_turns(frame).orderBy("conv", "part").collect()
    of = {k: [(r.role, r.text) for r in turns if r.conv == k] for k in range(len(records))}
    assert all(of[k] == [("user", "a <b>"), ("assistant", "c")] for k in range(6))
    assert of[6] == [("system", "s"), ("user", "a <b>"), ("assistant", "")]
    assert all(of[k] == [(None, None)] for k in (7, 8, 9, 10, 12)) and of[11] == [("user", "?x")]
    assert {r.key for r in turns} == {"x"} and chat.canonical_turns(frame.limit(0)).count() == 0


def test_formatted_turns_read_back(spark):
    said = ["", "\\### Assistant: </turn> ok", "</turn>\n### user: x", "a\\", "###\\\\#<", "\n\n", None, "é🙂"]
    rows = [(k % 3 if k % 4 else None, k, role, text) for k, text in enumerate(said) for role in ("assistant", "us:er#", None)]
    frame = spark.createDataFrame(rows, "conv long, turn int, role string, text string")
    made = chat.format_turns(frame)
    for row in made.collect():
        assert chat.read_turns(row.formatted) == [(row.role or "", row.text or "")]
        if row.role == "assistant":
            assert chat.unescape(row.formatted[row.loss_start : row.loss_end]) == (row.text or "")
    whole = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        whole.setdefault(conv, []).append((role or "", text or ""))
    got = {r.conv: r for r in chat.digest_conversations(made, "conv", ["turn", "role", "text"]).collect()}
    assert set(got) == set(whole)
    for conv, turns in whole.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.digest_conversations(made.limit(0), "conv", ["turn"]).count() == 0


def test_archives_read_back(spark):
    big = "<p>é</p>" * 100_000
    rows = [(1, "http://a/é x\r\ny", "same"), (2, None, "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", big), (None, "u", "same"), (6, "u", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "owner": F.lit(2), "id": F.lit(3)})
    got = sorted(tuple(r) for r in warc.archive_pages(pages).filter("id IS NOT NULL").collect())

    def expected(key, text, of):
        data = (text or "").encode()
        return key, "revisit" if of else "response", of, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode()

    assert got == sorted([expected(1, "same", 2), *[expected(2, "same", None)] * 2, expected(3, None, 4), expected(4, "", None), expected(5, big, None), expected(6, rows[-1][2], None)], key=str)
    alone = warc.archive_pages(pages.filter("page_id IS NULL")).collect()
    assert [(r.id, r.type, r.refers_to) for r in alone] == [(None, "response", None)]
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_inflating_many_members_and_garbage():
    import io

    whole = b"".join(warc.record_bytes(k, "u", b"x" * k * 1000, None) for k in range(50))
    members = gzip.compress(whole[:5000]) + gzip.compress(b"") + gzip.compress(whole[5000:])
    assert b"".join(warc.inflate(io.BytesIO(members))) == whole
    with pytest.raises(ValueError):
        list(warc.Reader(warc.inflate(io.BytesIO(gzip.compress(b"WARC/1.1\r\nhalf")))).header() for _ in range(2))


def test_mixing_meets_its_limit_and_budget(spark):
    rows = [(k, "big", prose(20, k)) for k in range(300)] + [(1000 + k, "small", prose(10, k)) for k in range(20)]
    rows += [(2000, None, prose(30, 1)), (2000, None, prose(30, 1)), (3000, "empty", None), (3001, "empty", ""), (None, "small", prose(5, 2))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"pass": F.lit(1), "tokens": F.lit(1), "block": F.lit(0)})
    mixed = mixing.mix_sources(docs, repeat_limit=3.0).collect()
    uses = {}
    for r in mixed:
        uses.setdefault(r.doc_id, []).append(r["pass"])
    assert set(uses) == {r[0] for r in rows}
    assert all(len(uses[k]) == 1 for k in range(300))
    assert len(uses[2000]) == 6 and sorted(uses[2000]) == [1, 1, 2, 2, 3, 3]
    assert max(len(v) for k, v in uses.items() if k != 2000) <= 3 and len({r.place for r in mixed if r.doc_id != 2000}) == len([r for r in mixed if r.doc_id != 2000])
    half = mixing.mix_sources(docs.filter("source = 'big'"), budget=3000).collect()
    assert 2980 < sum(r.n_tokens for r in half) <= 3000
    assert sorted(r.place for r in mixing.mix_sources(docs.filter("source = 'big'"), budget=3000).collect()) == sorted(r.place for r in half)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_exponent_meets_entropy(spark):
    tokens_of = [900_000, 50_000, 30_000, 20_000]
    sums = spark.createDataFrame([(f"s{k}", t, 1) for k, t in enumerate(tokens_of)], "source string, tokens long, docs long")
    a = mixing.bisect_exponent(sums, repeat_limit=1e9, target_entropy=1.0) / mixing.GRID

    def entropy(x):
        p = np.array(tokens_of, dtype=float) ** x
        p /= p.sum()
        return -(p * np.log(p)).sum()

    assert entropy(a) >= 1.0 > entropy(a + 2e-6)
    b = mixing.bisect_exponent(sums, repeat_limit=4.0) / mixing.GRID
    assert 45 ** (1 - b) <= 4.0 < 45 ** (1 - b + 2e-6)


def test_quality_scores_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2) for k in range(4, 12)] + [(None, 1), (5, None), (6, 7), (99, 1)], "doc_id long, quality int")
    got = classifier.score_quality(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    bare = classifier.score_quality(odd, labels.limit(0)).collect()
    assert {r.score for r in bare} == {0.5}
    assert classifier.score_quality(none, labels).count() == 0


def test_contexts_equal_a_loop_over_words():
    column = pa.array([None, "", "one", "one two", *[prose(40, n) for n in range(50)]])
    vectors, wanted = classifier.index_vectors(), np.zeros((classifier.PLACES, classifier.WIDTH), dtype=np.int64)
    found = np.zeros_like(wanted)
    for place, offsets in classifier._places(column):
        for low, high in zip(offsets[:-1], offsets[1:], strict=True):
            for i in range(low, high):
                for j in {i - 2, i - 1, i + 1, i + 2} & set(range(low, high)):
                    wanted[place[i]] += vectors[place[j]]
        classifier._add_contexts(found, place, offsets, vectors)
    assert found.any() and (found == wanted).all()


def test_contexts_of_many_texts_take_a_few_megabytes():
    column = pa.array([prose(40, n) for n in range(6_000)])
    vectors, held = classifier.index_vectors(), np.zeros((classifier.PLACES, classifier.WIDTH), dtype=np.int64)
    tracemalloc.start()
    for place, offsets in classifier._places(column):
        classifier._add_contexts(held, place, offsets, vectors)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 << 20


def test_network_learns_and_is_calibrated():
    random = np.random.default_rng(2)
    x = random.normal(size=(4000, 6))
    chance = 1 / (1 + np.exp(-3 * x[:, 0] * x[:, 1]))
    y = (random.random(4000) < chance).astype(int)
    found = classifier.train(x[:3000], y[:3000])
    p = found.probability(x[3000:])
    assert np.mean((p > 0.5) == (chance[3000:] > 0.5)) > 0.85
    for low in (0.0, 0.25, 0.5, 0.75):
        some = (p >= low) & (p < low + 0.25)
        assert abs(p[some].mean() - y[3000:][some].mean()) < 0.12


def test_licenses_of_odd_rows(odd, none):
    got = licenses.scan_licenses(odd).collect()
    assert len(got) == odd.count() and all(r.label_list == [] and r.score == 0 for r in got)
    assert licenses.scan_licenses(none).count() == 0


def test_contained_licenses_are_suppressed(spark):
    texts = {
        "Licensed under the Apache License, Version 2.0.": ["apache", "apache-2.0"],
        "the GNU Lesser General Public License v2.1": ["lgpl-2.1"],
        "SPDX-License-Identifier: GPL-2.0-or-later": ["gpl-2.0-or-later"],
        "CC BY-NC-SA 4.0 and CC BY 4.0; mit\nLICENSE": ["cc-by", "cc-by-4.0", "cc-by-nc-sa-4.0", "mit"],
        "accby licenses of emit license": [],
        "Released under the MIT License. Released under the MIT License.": ["mit"],
    }
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(frame).collect()}
    assert [got[k].label_list for k in range(len(texts))] == list(texts.values())
    assert [x["first"] for x in got[5].base] == [3, 8] and len(licenses.signatures()) > 200


def test_token_counts_of_odd_rows(odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = tokens.count_tokens(odd, path).collect()
    text = dict(odd.filter("doc_id IS NOT NULL").select("doc_id", "text").collect())
    assert len(got) == odd.count() and tokens.count_tokens(none, path).count() == 0
    for r in got:
        if r.doc_id is not None:
            assert r.n_tokens == len(library.encode(text[r.doc_id] or "", add_special_tokens=False).ids)


def test_merging_equals_the_library_on_strange_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(path), tokens.Counter(tokens.read_vocabulary(path))
    pick = random.Random(9)
    pool = "ab  \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　é中文1٣'stll<|endoftext|>🙂́!?"
    texts = ["".join(pick.choice(pool) for _ in range(pick.randrange(80))) for _ in range(2000)]
    texts += ["<|endoftext|>x<|endoftext|>", "a" * 5000, "ab" * 3000, "".join(pick.choice("abcdefgh") for _ in range(3000)), " " * 500, "word " * 300_000]
    assert counter.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
