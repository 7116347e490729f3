"""Operators against brute force on small fixtures, and their defined results for odd rows."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from conftest import SMALL, same_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerspark.llm import byte_bpe, compact_windows, exact_dedup, external_shuffle, kmeans_tree, licenses, packing, prefix_join, queries, quote_linking, shingles, toxicity
from ledgerspark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(rows, schema=DOCS):
        full = [(i, t, "en", "s", len(t or "")) for i, t in rows] if schema == DOCS else rows
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def odd(docs, spark):
    """Nulls in every column, an empty and a long text, repeated rows, and columns with names that operators use."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (2, None, 2), (3, "", 3), (None, "null id text", 4), (4, long, 5), (5, " \t\n", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard long").withColumns({"row": spark_lit("r"), "kept": spark_lit("k"), "ids": spark_lit(None)})


def spark_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x).cast("string")


BPE = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
WORDS = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SMALL), queries.ORACLE[name])


# 1: nearest neighbours


def test_neighbours_recall_and_order(spark):
    r = np.random.default_rng(3)
    centre = r.normal(size=(12, 16))
    v = (centre[r.integers(0, 12, 1500)] + 0.4 * r.normal(size=(1500, 16))).astype(np.float32)
    v[100:140] = v[100]  # a common vector
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = kmeans_tree.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=20, chunk=200).toPandas()
    exact, hit = v.astype(float), 0
    for q, rows in got.groupby("query_id"):
        rows = rows.sort_values("rank")
        s = exact @ exact[q]
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(len(v)), -s))[:20]) & set(rows["vec_id"]))
        assert list(rows["rank"]) == list(range(1, 21)) and q not in set(rows["vec_id"])
        assert np.allclose(rows["score"], s[rows["vec_id"]])
        assert list(zip(-rows["score"], rows["vec_id"])) == sorted(zip(-rows["score"], rows["vec_id"]))
    assert hit / len(got) >= 0.9


def test_neighbours_with_few_rows_and_other_columns(spark):
    """A query in a small leaf still gets k rows, or all there are; columns with names that the operator uses don't matter."""
    r = np.random.default_rng(5)
    v = r.normal(size=(300, 8))
    v[:4] += 40  # far from all others
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    df = df.withColumns({"leaf": F.lit("l"), "block": F.lit("b"), "id": F.lit(-1), "asked": F.lit(None).cast("boolean"), "v": F.lit("v")})
    got = kmeans_tree.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=20).toPandas()
    assert (got.groupby("query_id").size() == 20).all() and got["query_id"].nunique() == 15
    few = kmeans_tree.nearest_neighbours(df.where("vec_id < 10"), F.col("vec_id") == 0, k=20).toPandas()
    exact = v[:10] @ v[0]
    assert few["vec_id"].tolist() == [i for i in np.argsort(-exact) if i] and np.allclose(few["score"], exact[few["vec_id"]])


def test_neighbours_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (6, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = kmeans_tree.nearest_neighbours(df, F.lit(True)).collect()
    assert {(x["query_id"], x["vec_id"]) for x in got} == {(0, 5), (5, 0)}
    assert kmeans_tree.nearest_neighbours(df.limit(0), F.lit(True)).count() == 0


# 2: shards


def test_shuffle_is_whole_even_and_repeats(spark, odd):
    a = external_shuffle.external_shuffle(odd, shards=4)
    rows = a.collect()
    assert len(rows) == odd.count()
    assert sorted(map(str, (x["row"].asDict() for x in rows))) == sorted(map(str, (x.asDict() for x in odd.collect())))
    for s in range(4):
        assert sorted(x["slot"] for x in rows if x["shard"] == s) == list(range(sum(x["shard"] == s for x in rows)))
    again = external_shuffle.external_shuffle(odd, shards=4).collect()
    place = lambda rs: sorted((str(x["row"]), x["shard"], x["slot"]) for x in rs)
    assert place(rows) == place(again)
    assert external_shuffle.external_shuffle(odd.limit(0)).count() == 0


def test_shuffle_contract(spark):
    """Sizes, checksums, law, shares and slots of the query, by Python over all rows."""
    got = queries.op2_external_shuffle(spark, SMALL).collect()
    text = {x["doc_id"]: (x["text"] or "").encode() for x in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert sorted(x["doc_id"] for x in got) == sorted(text)
    assert all((x["size"], x["text_crc32"], x["law"], x["grown_shard"]) == (len(text[x["doc_id"]]) + 1, zlib.crc32(text[x["doc_id"]]), "rows", None) for x in got)
    shards = {i: sorted(x["slot"] for x in got if x["shard"] == i) for i in range(16)}
    assert all(v == list(range(len(v))) for v in shards.values()) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_shards_are_written(spark, docs, tmp_path):
    df = docs([(i, "x" * (i % 7)) for i in range(200)])
    external_shuffle.write_shards(external_shuffle.external_shuffle(df, shards=8, bucket_bytes=64), f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    counts = [r["count"] for r in back.groupBy("shard").count().collect()]
    assert sum(counts) == 200 and max(counts) - min(counts) <= 1


# 3: licences


def test_licenses(docs):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, "Prose.\nReleased under the MIT License.\nMore."), (2, "Intro\n\n" + mit.replace(", ", ",\n") + "\n\nend"), (3, None), (4, ""), (5, "nothing here"), (6, mit.upper())]
    got = {(x["doc_id"], x["unit"], x["license_id"]) for x in licenses.license_matches(docs(rows)).collect()}
    assert got >= {(1, "line", "MIT line"), (2, "block", "MIT"), (6, "line", "MIT")} and {i for i, _, _ in got} == {1, 2, 6}


def test_license_files_and_odd_rows(docs, odd):
    """A whole licence file of several paragraphs is found by its text; odd rows match nothing, repeated rows repeat."""
    body = licenses.TEMPLATES["BSD-3-Clause text"]
    file = "Copyright (c) 2020, Somebody. All rights reserved.\n\n" + body.replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ").replace(" 3. ", "\n\n3. ").replace(" THIS SOFTWARE", "\n\nTHIS SOFTWARE", 1)
    rows = [(1, file), (1, file), (2, "prose " * 50_000 + "\n\n" + licenses.TEMPLATES["Zlib text"]), (3, None), (4, "")]
    found = licenses.license_matches(docs(rows)).collect()
    names = lambda i: [x for x in found if x["doc_id"] == i]
    texts = {v for x in found for v in x.asDict().values() if isinstance(v, str)}
    assert {"BSD-3-Clause text", "Zlib text"} <= texts and len(names(1)) % 2 == 0 and names(2) and not names(3) and not names(4)
    assert licenses.license_matches(odd.select("doc_id", "text", "row", "kept")).isEmpty() and licenses.license_matches(odd.limit(0)).isEmpty()


def test_telling_words_lose_nothing(docs):
    """Any unit with a Dice coefficient at the threshold holds a telling word."""
    r = random.Random(2)
    known = {k: licenses.template_bigrams(t) for k, t in licenses.TEMPLATES.items()}
    telling = licenses.telling_words(known, 0.8)
    for pairs in known.values():
        for _ in range(50):
            left = set(r.sample(pairs, r.randint(1, len(pairs))))
            dice = 2 * len(left) / (len(left) + len(pairs))
            words = {w for p in left for w in p.split(" ")}
            assert dice < 0.8 or any(t in w if len(t) > 3 else t == w for t in telling for w in words)


# 4: exact copies


def test_exact_copies_and_collisions(docs):
    rows = [(5, "a b"), (3, "ab"), (9, "a  b"), (1, "xy"), (2, None), (7, ""), (8, " \n")]
    for content_hash in (exact_dedup.md5_128, lambda t: F.lit(b"same")):  # all texts collide in the second
        got = {x["row"]["doc_id"]: (x["keep_id"], x["group_size"], x["kept"]) for x in exact_dedup.exact_duplicates(docs(rows), content_hash=content_hash).collect()}
        assert got == {5: (9, 3, False), 3: (9, 3, False), 9: (9, 3, True), 1: (1, 1, True), 2: (8, 3, False), 7: (8, 3, False), 8: (8, 3, True)}


def test_exact_copies_odd_rows(odd):
    got = exact_dedup.exact_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert [x["keep_id"] for x in got if x["row"]["doc_id"] is None] == [None] and all(x["kept"] for x in got if x["row"]["doc_id"] is None)
    kept = exact_dedup.deduplicated(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 1 and kept.where("doc_id in (2, 3)").count() == 0
    assert exact_dedup.exact_duplicates(odd.limit(0)).count() == 0


# 5: passages


def brute_windows(v, least):
    out, todo = set(), [(0, len(v) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a + 1 >= least:
            c = a + int(v[a : b + 1].argmin())
            out.add((a, c, b))
            todo += [(a, c - 1), (c + 1, b)]
    return out


def test_compact_windows_are_tree_nodes():
    r = np.random.default_rng(1)
    for trial in range(60):
        v = r.integers(1, [9, 10**9][trial % 2], r.integers(1, 150)).astype(np.uint64)
        got = zip(*(x.tolist() for x in compact_windows.compact_windows(np.concatenate([[0], v, [0]]).astype(np.uint64), 6)), strict=True)
        assert {(a - 1, c - 1, b - 1) for a, c, b in got} == brute_windows(v, 6)


def prose(r, n):
    return [f"{r.choice('bcdfg')}{r.randint(0, 4000)}" for _ in range(n)]


def test_windows_reach_as_far_as_their_minimum(docs):
    """Against a loop, on a text of 3,000 words; reaches of texts beyond 32,768 words are packed wider, never narrower."""
    words = prose(random.Random(5), 3000)
    found = {(r["key"], r["place"] >> 32): (r["place"] >> 16 & 0xFFFF, r["place"] & 0xFFFF) for r in compact_windows.windows(docs([(1, " ".join(words))])).collect()}
    whole = sequence(words)
    for i, (width, least) in enumerate(compact_windows.SIGNATURES):
        v = [max(int(x), 1) for x in shingles.run_hashes(whole, width)]
        want = {}
        for c, x in enumerate(v):
            left = next((c - j - 1 for j in range(c - 1, -1, -1) if v[j] <= x), c)
            right = next((j - c - 1 for j in range(c + 1, len(v)) if v[j] < x), len(v) - 1 - c)
            if left + right + 1 >= least:
                want[int(np.uint64(x & ~1 | i).view(np.int64)), c] = left, right
        assert {k: x for k, x in found.items() if k[0] & 1 == i} == want and max(map(max, want.values())) > 500
    reach = np.array([0, 127, 32_767, 32_768, 32_769, 98_304, 98_305, 1 << 30])
    packed = compact_windows._packed(reach)
    assert (compact_windows._unpacked(packed)[:4] == reach[:4]).all() and (compact_windows._unpacked(packed) >= reach).all() and packed.max() < 1 << 16


def test_passages_are_found_and_cut(docs, odd):
    r = random.Random(4)
    shared = prose(r, 60)
    edited = [*shared]
    edited[30] = "edit"
    rows = [(i, " ".join(prose(r, 80) + (shared if i in (3, 5, 7) else edited if i == 8 else shared[:30] if i == 9 else []) + prose(r, 40))) for i in range(1, 13)]
    found = {x["doc_id"]: x for x in compact_windows.repeated_passages(docs(rows)).collect()}
    assert set(found) == {5, 7, 8}
    for i in (5, 7):
        assert (found[i]["start_word"], found[i]["end_word"]) == (80, 140) and found[i]["passage"] == " ".join(shared)
    assert found[8]["start_word"] == 80 and found[8]["similarity"] >= 0.8
    cut = {x["row"]["doc_id"]: (x["text"], x["cut"]) for x in compact_windows.without_repeats(docs(rows)).collect()}
    assert {i for i, (_, c) in cut.items() if c} == {5, 7, 8} and len(cut[5][0].split()) == 120
    assert all(cut[i][0] == t for i, t in rows if i not in (5, 7, 8))
    kept = compact_windows.without_repeats(odd).collect()
    assert len(kept) == odd.count() and not any(x["cut"] for x in kept)
    assert compact_windows.repeated_passages(odd.limit(0)).count() == 0


def test_every_word_for_word_passage_is_linked(docs):
    """All passages share a phrase that the first documents hold without the passage; every 50-word run is checked by brute force."""
    r = random.Random(6)
    phrase, passages = prose(r, 30), [(prose(r, 12), prose(r, 12)) for _ in range(6)]
    rows = [(i, " ".join(prose(r, 60) + phrase + prose(r, 60))) for i in range(1, 9)]
    for i in range(9, 40):
        before, after = passages[r.randrange(6)]
        rows.append((i, " ".join(prose(r, 60) + before + phrase + after + prose(r, 40))))
    want, held = set(), {}
    for i, t in rows:
        words = t.split()
        for at in range(len(words) - 49):
            if held.setdefault(tuple(words[at : at + 50]), i) < i:
                want |= {(i, x) for x in range(at, at + 50)}
    got = {(x["doc_id"], w) for x in compact_windows.repeated_passages(docs(rows)).collect() for w in range(x["start_word"], x["end_word"])}
    assert len({i for i, _ in want}) == 25 and want <= got


def test_holders_of_the_same_minima_dont_hide_a_passage(docs):
    """Smaller documents hold every minimum of a passage, with the words around it, in other prose."""
    r = random.Random(21)
    passage = prose(r, 60)
    decoys = [" ".join(w for at in range(start, 46, 12) for w in [*passage[at : at + 14], *prose(r, 30)]) for start in range(12)]
    rows = [*enumerate(decoys, 1), (20, " ".join(prose(r, 50) + passage + prose(r, 50))), (21, " ".join(prose(r, 70) + passage))]
    found = [x for x in compact_windows.repeated_passages(docs(rows)).collect() if x["doc_id"] == 21]
    assert [(x["other_id"], x["start_word"], x["end_word"]) for x in found] == [(20, 70, 130)]


def test_holders_of_parts_dont_hide_a_passage(docs):
    """In each of 300 groups two small documents hold 45 words each of a passage of 50 to 70 words, or most of it; two later ones hold all of
    it. Every 50-word run that a smaller document holds is found."""
    r = random.Random(23)
    rows, want, held = [], set(), {}
    for trial in range(300):
        passage = prose(r, r.choice([60, r.randint(50, 70)]))
        cut = 45 if trial % 3 else r.randint(45, 56)
        parts = [passage[:cut], passage[15:] if trial % 2 else passage[-45:], passage, passage]
        rows += [(10 * trial + i, " ".join(prose(r, r.randint(0, 40)) + part + prose(r, r.randint(0, 40)))) for i, part in enumerate(parts)]
    for i, t in rows:
        words = t.split()
        for at in range(len(words) - 49):
            if held.setdefault(tuple(words[at : at + 50]), i) < i:
                want |= {(i, x) for x in range(at, at + 50)}
    got = {(x["doc_id"], w) for x in compact_windows.repeated_passages(docs(rows)).collect() for w in range(x["start_word"], x["end_word"])}
    assert len({i for i, _ in want if i % 10 == 3}) == 300 and want <= got


def test_hashes_of_spans():
    r = np.random.default_rng(2)
    x = r.integers(1, 1 << 62, 400).astype(np.uint64)
    x[300:340] = x[100:140]
    a, b, c = (compact_windows.span_hashes(x, np.array([s]), np.array([s + n]))[0] for s, n in ((100, 40), (300, 40), (300, 41)))
    assert a == b != c


def test_edited_passages_are_found(docs):
    """Passages of 50 to 150 words with one edited word in every 50 at any place: all are found in full."""
    r = random.Random(22)
    rows, where = [], {}
    for i in range(1, 61):
        passage = prose(r, r.randint(50, 150))
        edited = [*passage]
        for at in range(0, len(passage) - 49, 50):
            edited[at + r.randint(5, 44)] = f"edit{r.randint(0, 10**6)}"
        before, after = prose(r, r.randint(0, 80)), prose(r, r.randint(0, 80))
        rows += [(i, " ".join(prose(r, 40) + passage + prose(r, 30))), (i + 100, " ".join(before + edited + after))]
        where[i + 100] = (i, len(before), len(before) + len(edited))
    found = {x["doc_id"]: x for x in compact_windows.repeated_passages(docs(rows)).collect()}
    assert set(found) == set(where)
    for i, (other, start, stop) in where.items():
        assert found[i]["other_id"] == other and abs(found[i]["start_word"] - start) <= 6 and abs(found[i]["end_word"] - stop) <= 6 and found[i]["similarity"] >= 0.8


def sequence(words):
    return shingles.shingle_sequence(shingles.word_hashes([w.encode() for w in words]))


def test_passages_with_repeated_lines_are_verified():
    r = random.Random(11)
    passage, line, noise = prose(r, 60), prose(r, 6), prose(r, 20)
    passage[27:33] = line
    found = compact_windows.matched_stretches(sequence(noise + passage + prose(r, 20)), sequence(line + prose(r, 14) + passage))
    assert [(a, b + 4, c, d + 4) for a, b, c, d, _ in found] == [(20, 80, 20, 80)]
    # A stray common line close to an edited passage is trimmed away.
    edited = passage[:15] + ["edit"] + passage[16:]
    stray = prose(r, 5)
    found = compact_windows.matched_stretches(sequence(stray + prose(r, 2) + edited + prose(r, 20)), sequence(stray + prose(r, 60) + passage))
    assert [(a, b + 4, c, d + 4) for a, b, c, d, _ in found] == [(7, 67, 65, 125)]


def test_passages_inside_long_chains_are_found():
    """A passage with an edit in each 40 words, and on both sides of it 20 scraps of 7 equal words: it is neither a whole chain nor at an end of one."""
    count = iter(range(10**6))
    fresh = lambda n: [f"f{next(count)}" for _ in range(n)]
    equal = lambda n: (x := fresh(n), x)
    other = lambda n: (fresh(n), fresh(n))
    scraps = lambda: [y for _ in range(20) for y in (equal(7), other(5))]
    passage = [y for _ in range(6) for y in (equal(39), other(1))] + [equal(39)]
    parts = [*scraps(), *passage, other(5), *scraps()]
    own, there = (sequence([w for part in parts for w in part[side]]) for side in (0, 1))
    start, stop = (sum(len(p[0]) for p in parts[:n]) for n in (40, 40 + len(passage)))
    found = compact_windows.matched_stretches(own, there)
    assert any(a <= start and stop - 4 <= b for a, b, *_ in found) and all(similarity >= 0.8 for *_, similarity in found)


def test_parts_of_chains_against_brute_force():
    r = random.Random(8)
    for words in (4, 9, 300):
        a = [r.randrange(words) for _ in range(400)]
        own, other = (np.array([x if r.random() > 0.05 else r.randrange(words) for x in a], np.uint64) for _ in range(2))
        start = np.arange(0, 390, 10) + np.array([r.randrange(3) for _ in range(39)])
        stop, diagonal = start + 5, np.array([r.randrange(4) for _ in range(39)])

        def similar(x, y):
            mine, its = set(own[start[x] : stop[y]].tolist()), set(other[start[x] + diagonal[x] : stop[y] + diagonal[y]].tolist())
            return stop[y] - start[x] >= compact_windows.MIN_SHINGLES and len(mine & its) >= 0.8 * len(mine | its)

        want, todo = [], [(0, 39)]
        while todo:
            low, high = todo.pop()
            best = max(((y - x, -x, y) for x in range(low, high) for y in range(x, high) if similar(x, y)), default=None)
            if best:
                want.append((-best[1], best[2]))
                todo += [(low, -best[1]), (best[2] + 1, high)]
        assert compact_windows._similar_parts(own, other, start, stop, diagonal) == want


def test_runs_of_equal_shingles_are_passages():
    r = random.Random(12)
    for _ in range(60):
        few = prose(r, 30)
        a, b = [r.choice(few) for _ in range(150)], [r.choice(few[:3]) for _ in range(150)]
        if r.random() < 0.5:
            a, b = [few[i % 7] for i in range(120)], [few[i % 7] for i in range(90)]
        b[20:80] = a[30:90]
        b[:20] = b[40:60]
        covered = {x for i, j, *_ in compact_windows.matched_stretches(sequence(a), sequence(b)) for x in range(i, j)}
        assert covered >= set(range(30, 86))


# 6: near copies


def brute_components(rows):
    sets = {i: set(shingles.shingle_set(t).tolist()) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_near_copies_against_brute_force(docs):
    r = random.Random(9)
    rows = []
    for base in range(6):
        words = prose(r, r.choice([3, 12, 60, 200]))
        for _ in range(6):
            copy = [*words]
            for _ in range(r.randint(0, max(1, len(words) // 40))):
                copy[r.randrange(len(copy))] = f"e{r.randint(0, 9)}"
            rows.append((len(rows) + 1, " ".join(copy)))
    rows += [(len(rows) + 1, rows[0][1]), (len(rows) + 2, None), (len(rows) + 3, ""), (len(rows) + 4, "one"), (len(rows) + 5, "ONE")]
    got = {x["doc_id"]: x["component_id"] for x in prefix_join.similar_documents(docs(rows)).collect()}
    assert got == brute_components(rows)


def test_near_copies_odd_rows(odd, docs):
    """Every row gives a row; one without an id has a size but no component and links nothing."""
    rows = prefix_join.similar_documents(odd).collect()
    assert len(rows) == odd.count() and [tuple(x) for x in rows if x["doc_id"] is None] == [(None, 1, None)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows if x["doc_id"] is not None}
    assert got == {1: (2, 1), 2: (0, 2), 3: (0, 3), 4: (977, 4), 5: (0, 5)}
    assert prefix_join.similar_documents(odd.limit(0)).count() == 0
    bridge = [(None, "a b c d e f g h"), (8, "a b c d e f g h"), (9, "a b c d e f g h")]
    assert {(x["doc_id"], x["component_id"]) for x in prefix_join.similar_documents(docs(bridge)).collect()} == {(None, None), (8, 8), (9, 8)}


def test_near_copies_of_repeated_ids(docs):
    """Texts of one id link what they are similar to."""
    r = random.Random(3)
    a, b = " ".join(prose(r, 40)), " ".join(prose(r, 40))
    got = sorted((x["doc_id"], x["component_id"]) for x in prefix_join.similar_documents(docs([(7, a), (7, b), (3, a), (1, b)])).collect())
    assert got == [(1, 1), (3, 1), (7, 1), (7, 1)]


def test_near_copies_in_one_large_group(docs):
    """Near copies of one text, of which many are not similar to each other, and many that only share a line."""
    r = random.Random(8)
    base, line, rows = prose(r, 120), prose(r, 14), []
    for i in range(150):
        copy = [*base]
        for _ in range(r.randint(0, 8)):
            copy[r.randrange(len(copy))] = f"e{r.randint(0, 10**6)}"
        rows.append((i + 1, " ".join(copy)))
    rows += [(i + 200, " ".join(prose(r, r.randint(5, 40)) + line)) for i in range(80)]
    got = {x["doc_id"]: x["component_id"] for x in prefix_join.similar_documents(docs(rows)).collect()}
    assert got == brute_components(rows)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {x["node"]: x["component"] for x in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# 7: toxicity


def test_toxicity_held_out(docs, odd, spark):
    r = random.Random(6)
    bad = ["vile", "scumbag", "moronic", "trashy"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = [f"w{min(int(r.expovariate(0.02)), 400)}" for _ in range(60)]
        for _ in range(4 if toxic else 0):
            words[r.randrange(60)] = r.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(rows), truth)
    got = {x["row"]["doc_id"]: x["score"] for x in toxicity.scored(docs(rows), model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    wrong = [i for i in held if (got[i] >= 0.7) != (i % 6 == 0)]
    assert len(wrong) <= 0.03 * len(held) and all(0 <= s <= 1 for s in got.values())
    assert toxicity.scored(odd, model).count() == odd.count()
    # Without labels there is no model: every score is 0.
    empty = toxicity.fit(docs(rows[:20]), truth.limit(0))
    assert {x["score"] for x in toxicity.scored(docs(rows[:20]), empty).collect()} == {0.0}


def test_language_models_against_brute_force(spark):
    """Ratios of words, contexts and bigrams, recomputed by dictionaries from the texts."""
    r = random.Random(13)
    rows = [(" ".join(f"w{min(int(r.expovariate(0.2)), 30 + 5 * t)}" for _ in range(60)), t) for t in [0, 1] * 20]
    other = [" ".join(f"w{r.randint(0, 40)}" for _ in range(50)) for _ in range(10)]
    df = spark.createDataFrame(rows, "text string, toxic long")
    corpus = toxicity.word_counts(spark.createDataFrame([(t,) for t, _ in rows] + [(t,) for t in other], "text string"))
    model = toxicity.language_models(df, corpus)
    whole = Counter(w for t in [*[t for t, _ in rows], *other] for w in t.split())
    pairs = [Counter((a, b) for t, label in rows if label == c for a, b in zip(t.split(), t.split()[1:])) for c in (1, 0)]
    listed = {k for k in {*pairs[0], *pairs[1]} if max(p[k] for p in pairs) >= toxicity.LEAST}
    p, chain, back, spare = [], [], [], []
    for c in (0, 1):
        before = Counter(b for _, b in pairs[c])
        d = toxicity._discount(sum(n == 1 for n in before.values()), sum(n == 2 for n in before.values()))
        left = 1 - sum(n - d for n in before.values()) / sum(before.values())
        p.append({w: max(before[w] - d, 0) / sum(before.values()) + left * (whole[w] + 1) / (sum(whole.values()) + len(whole)) for w in whole})
        e = toxicity._discount(sum(n == 1 for n in pairs[c].values()), sum(n == 2 for n in pairs[c].values()))
        first = Counter()
        for (a, _), n in pairs[c].items():
            first[a] += n
        back.append({a: max(1 - sum(max(pairs[c][k] - e, 0) for k in listed if k[0] == a) / first[a], 1e-3) if first[a] else 1.0 for a in whole})
        chain.append({(a, b): max(pairs[c][a, b] - e, 0) / max(first[a], 1) + back[c][a] * p[c][b] for a, b in listed})
        spare.append(left)
    key = lambda w: int(toxicity.word_hashes(w)[0])
    seen = {b for q in pairs for _, b in q}
    found = dict(zip(model.words[0].tolist(), model.words[1].tolist()))
    assert set(found) == {key(w) for w in seen} and all(abs(found[key(w)] - np.log(p[0][w] / p[1][w])) < 1e-5 for w in seen)
    found = dict(zip(model.bigrams[0].tolist(), model.bigrams[1].tolist()))
    want = {int(toxicity.bigram_keys(toxicity.word_hashes(f"{a} {b}"))[0]): np.log(chain[0][a, b] / chain[1][a, b]) for a, b in listed}
    assert set(found) == set(want) and all(abs(found[k] - v) < 1e-5 for k, v in want.items())
    found = dict(zip(model.contexts[0].tolist(), model.contexts[1].tolist()))
    assert all(abs(found.get(key(a), 0.0) - np.log(back[0][a] / back[1][a])) < 1e-5 for a in {a for q in pairs for a, _ in q})
    assert abs(model.default - np.log(spare[0] / spare[1])) < 1e-6


# 8: packing


def test_packing_round_trip(docs, odd):
    r = random.Random(8)
    rows = [(i, " ".join(prose(r, r.choice([1, 5, 80, 700, 3000])))) for i in range(60)] + [(60, None), (61, ""), (62, "Ünïcode ΣΑΣ 日本語 ŉ İ")]
    rows += [(63, "hello <|endoftext|> world"), (64, "it's <|x|> 2² x_y don't\x0bstop " + "é" * 90 + " <|startoftext|>"), (65, "a-b, (c) ½d\u00a0e 12345 I'LL we've")]
    pieces = packing.packed(docs(rows), WORDS).toPandas()
    own = Tokenizer.from_file(WORDS)
    assert own.encode(rows[63][1], add_special_tokens=False).ids == [3306, 49407, 1002]
    assert [zlib.crc32(np.array(x, "<u4").tobytes()) for x in pieces["ids"]] == pieces["ids_crc32"].tolist()
    for i, text in rows:
        part = pieces[pieces["doc_id"] == i].sort_values("start")
        assert np.concatenate(part["ids"].to_numpy()).tolist() == [*own.encode(text or "", add_special_tokens=False).ids, 1]
        assert part["start"].tolist() == np.cumsum([0, *part["length"]])[:-1].tolist()
    for _, part in pieces.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == np.cumsum([0, *part["length"]])[:-1].tolist() and part["length"].sum() <= 2048
    assert packing.packed(odd, WORDS).groupBy("doc_id").count().count() == 6
    assert packing.packed(odd.limit(0), WORDS).count() == 0


def test_sum_of_squares_choice():
    """The level chosen gives the smallest sum of squares, by trying all."""
    r = np.random.default_rng(2)
    p = packing.SumOfSquares(capacity=20, most_open=10**6)
    for i in range(400):
        size = int(r.integers(1, 20))
        options = {}
        for level in range(0, 20 - size + 1):
            if level and not p.count[level]:
                continue
            after = p.count.copy()
            if level:
                after[level] -= 1
            if level + size < 20:
                after[level + size] += 1
            options[level] = int((after[1:20] ** 2).sum())
        assert options[p.level_for(size)] == min(options.values())
        list(p.add(i, np.zeros(size, np.int32)))
        if not p.total:
            continue
        options = {}  # cut: a window that is too small for all of it is filled
        for level in range(1, 20):
            if p.count[level]:
                after = p.count.copy()
                after[level] -= 1
                if level + size < 20:
                    after[level + size] += 1
                options[level] = int((after[1:20] ** 2).sum())
        assert options[p.level_for(size, cut=True)] == min(options.values())


def test_open_windows_are_closed_by_the_same_rule():
    """Whatever was open is placed again in full; one window at most is not full, and few pieces are cut."""
    r = np.random.default_rng(3)
    p = packing.SumOfSquares(capacity=2048, most_open=300)
    sizes = r.integers(1, 6000, 2000)
    windows = [w for i, n in enumerate(sizes) for w in p.add(i, np.arange(n, dtype=np.int32))] + list(p.close())
    assert sum(w.level < 2048 for w in windows) <= 1 and not p.total and not p.count.any()
    held = {}
    for w in windows:
        for doc, start, ids, _ in w.pieces:
            assert (ids == np.arange(start, start + len(ids))).all()
            held.setdefault(doc, []).append((start, len(ids)))
    for i, n in enumerate(sizes):
        edges = sorted(held[i])
        assert [a for a, _ in edges] == np.cumsum([0, *(b for _, b in edges)])[:-1].tolist() and sum(b for _, b in edges) == n


# 9: quotations


def test_quotes_are_linked(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\nIt is long."),
        (1, 1, "assistant", "Use sorted."),
        (1, 2, "user", "On Monday someone wrote:\n> How do I  SORT a list?\n> It is long.\nThanks, solved."),
        (1, 3, "assistant", "> > How do I sort a list?\n> Thanks, solved.\nGood."),
        (1, 4, "user", "> never said\nok"),
        (2, 0, "user", None), (None, 0, "user", "x"), (2, 1, "user", "> "),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(x["conv_id"], x["turn"]): x for x in quote_linking.linked_conversations(df).collect()}
    assert (got[1, 2]["reply_to"], got[1, 3]["reply_to"], got[1, 4]["reply_to"]) == (0, 2, None)
    assert [k[1] for k in sorted((k for k in got if k[0] == 1), key=lambda k: got[k]["position"])] == [0, 2, 3, 1, 4]
    assert got[1, 2]["text"] == "Thanks, solved." and got[1, 4]["text"] == "ok" and got[1, 3]["thread"] == 0
    assert len(got) == 8 and quote_linking.linked_conversations(df.limit(0)).count() == 0
    lone = spark.createDataFrame([(None, 0, "user", "x"), (None, 0, "user", "x"), (None, None, None, None), (7, None, "user", "y")], df.schema)
    wide = lone.withColumns({"position": F.lit("p"), "thread": F.lit("t"), "reply_to": F.lit(None).cast("string")})
    assert sorted((x["conv_id"] or 0, x["position"]) for x in quote_linking.linked_conversations(wide).collect()) == [(0, 1)] * 3 + [(7, 1)]
    long = spark.createDataFrame([(1, 0, "user", "a line\n" * 20_000), (1, 1, "user", "> a line\nyes")], df.schema)
    assert {x["turn"]: x["reply_to"] for x in quote_linking.linked_conversations(long).collect()} == {0: None, 1: 0}


# 10: byte-level BPE


def test_bpe_like_the_library(docs, odd):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE[0], "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    texts = ["".join(r.choice("aAbé 日x\n\t1🙂\x00'") for _ in range(r.randint(0, 200))) for _ in range(150)]
    texts += ["ab" * 20_000, "".join(r.choice("abcdefgh") for _ in range(30_000)), "<|endoftext|>", None, ""]
    rows = list(enumerate(texts))
    ids = byte_bpe.encoded(docs(rows), *BPE)
    got = {x["row"]["doc_id"]: x for x in byte_bpe.decoded(ids, *BPE).collect()}
    for i, t in rows:
        assert got[i]["ids"] == own.encode_ordinary(t or "") and bytes(got[i]["bytes"]) == (t or "").encode()
    assert byte_bpe.encoded(odd, *BPE).count() == odd.count() and byte_bpe.encoded(odd.limit(0), *BPE).count() == 0


def test_queries_carry_digests(spark):
    row = queries.QUERIES["op10_bitmap_bpe"](spark, SMALL).first()
    text = spark.read.parquet(f"{SMALL}/documents.parquet").where(F.col("doc_id") == row["doc_id"]).first()["text"]
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_stages(spark):
    """Stages keep the columns, and what stays is what each operator decides on its own input."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.count()
    for name, stage in c.STAGES[:-1]:
        out = c.staged(stage(spark, docs, SMALL), name.replace(" ", "-"))
        assert out.columns == docs.columns and out.count() <= docs.count()
        if name == "exact dedup":
            assert exact_dedup.exact_duplicates(out).where("group_size > 1").isEmpty()
        if name == "n-gram jaccard join":
            rows = [(x["doc_id"], x["text"]) for x in out.collect()]
            assert all(k == v for k, v in brute_components(rows[:120]).items())
        docs = out
    assert docs.count() < before
    assert c.STAGES[-1][1](spark, docs, SMALL).groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def test_pipeline_stages_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns, an empty table: columns stay, clean rows stay."""
    import corpus_pipeline as c

    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "text without an id", "en", "s", 18), (4, long, "en", "s", len(long)), (5, " \t\n", "en", None, 3)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({x: F.lit("x") for x in ("row", "id", "score", "kept", "spans", "text_key", "cut", "component_id", "n", "ids")})
    for frame in (docs, docs.limit(0)):
        for name, stage in c.STAGES[:-1]:
            out = stage(spark, frame, SMALL)
            assert out.columns == docs.columns
            found = out.collect()
            assert {x["doc_id"] for x in found} >= ({None, 1, 4} if frame is docs else set()), name
            assert all(x["row"] == "x" and x["ids"] == "x" and x["cut"] == "x" for x in found)
            assert [x["n_chars"] for x in found if x["doc_id"] == 4] == [len(long)] * (frame is docs)
        pieces = c.STAGES[-1][1](spark, frame, SMALL)
        assert {x["doc_id"] for x in pieces.collect()} == ({None, 1, 2, 3, 4, 5} if frame is docs else set())


def test_pre_tokens_are_those_of_the_pattern():
    """Words, and words with a mark, skip the pattern and give what it gives; so do the ids of the library, whatever the order of learning."""
    r = random.Random(31)
    runs = ["".join(r.choice("abzéßªº²1'.,;:!?-*&¡") for _ in range(r.randint(1, 7))) for _ in range(20_000)] + ["don't", "'s", "a'", "word.", "ein,", "x²", ".", "!?"]
    assert all(packing._pre_tokens(run) == packing._WORDS.findall(run) for run in runs)
    tokenizer = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    text = " ".join(runs[:3000])
    assert tokenizer.encode_all([text, ""])[0].tolist() == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids


def test_half_a_million_runs_are_learned_once(monkeypatch):
    tokenizer = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join(a + b + c + d for c in letters for d in letters) for a in letters for b in letters[:20]] + ["x. " * 50] * 2
    texts += [" ".join(a + b + c + d + "." for c in letters for d in letters) for a in letters[:10] for b in letters[:20]]
    first, learned, learn = tokenizer.encode_all(texts), [], tokenizer._learn_runs
    monkeypatch.setattr(tokenizer, "_learn_runs", lambda runs: (learned.extend(runs), learn(runs)))
    again = [x for text in texts for x in tokenizer.encode_all([text])]
    assert not learned and all(np.array_equal(a, b) for a, b in zip(first, again, strict=True))
    assert first[0].tolist() == tokenizer.tokenizer.encode(texts[0], add_special_tokens=False).ids


def test_a_chain_of_runs_has_one_link(docs, monkeypatch):
    """120 documents hold the same 70 words in prose of their own: a link for each window's chain, not one for each run of 50 words."""
    r = random.Random(29)
    passage = prose(r, 70)
    rows = [(i, " ".join(prose(r, r.randint(1, 40)) + passage + prose(r, r.randint(1, 40)))) for i in range(120)]
    links, chains = [], compact_windows._chains

    def counted(runs):
        made = chains(runs)
        links.append((runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.sum(F.col("n") - 1)).first()[0], made.count()))
        return made

    monkeypatch.setattr(compact_windows, "_chains", counted)
    found = compact_windows.repeated_passages(docs(rows)).collect()
    covered = Counter(d for d, _ in {(x["doc_id"], w) for x in found for w in range(x["start_word"], x["end_word"])})
    assert all(covered[i] >= 70 for i in range(1, 120))
    assert 4 * links[0][1] <= links[0][0]
    # Two words over and over: two runs of 50 words, at hundreds of places of each document.
    rows = [(i, " ".join(prose(r, 20) + ["the", "of"] * (150 + i) + prose(r, 20))) for i in range(40)]
    found = compact_windows.repeated_passages(docs(rows)).collect()
    covered = Counter(d for d, _ in {(x["doc_id"], w) for x in found for w in range(x["start_word"], x["end_word"])})
    assert all(covered[i] >= 2 * (150 + i) for i in range(1, 40)) and links[1][1] <= 10 * 40
