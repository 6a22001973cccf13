"""Corpus operators against plain Python on small tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from brute import SF, components_of
from tokenizers import Tokenizer

import __spark_entry__ as entry
from gridlore.llm import exact_dedup, line_dedup, mixing, packing, quality, simhash, suffix_dedup, token_counts, topk, url_filter
from gridlore.llm.components import components
from gridlore.llm.word_bpe import Merges

QUERIES = entry.queries()
TOKENIZER = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))


def fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def near_groups(rows, bits=4):
    prints = [fingerprint(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= bits]
    return prints, components_of(len(rows), links)


def test_simhash(spark, rows):
    prints, groups = near_groups(rows)
    least = {g: min(rows[i][0] for i in members) for g, members in groups.items()}
    of = {i: g for g, members in groups.items() for i in members}
    want = {(rows[i][0], f"{prints[i]:016x}", least[of[i]]) for i in range(len(rows))}
    got = {tuple(r) for r in QUERIES["op4_simhash"](spark, SF).select("doc_id", "fingerprint", "component_id").collect()}
    assert got == want
    assert len(groups) < len(rows)


def test_simhash_odd_rows(spark, odd, empty):
    got = sorted(map(tuple, simhash.near_groups(odd).collect()), key=str)
    of = defaultdict(list)
    for doc_id, fp, root in got:
        of[doc_id].append((fp, root))
    assert len(got) == odd.count()
    assert of[3] == of[4] == of[5] == [(0, 3)]
    assert len(of[1]) == 2 and {root for _, root in of[1] + of[2] + of[None]} == {1}
    assert of[6][0][1] == of[7][0][1] == 6
    assert simhash.near_groups(empty).collect() == []
    stay = simhash.without_near_copies(odd)
    assert stay.columns == odd.columns
    assert sorted(r.doc_id for r in stay.collect()) == [1, 1, 3, 6, 8, 9, 10]


def test_near_copies_with_missing_and_repeated_ids(spark):
    a, b, c, d, e, f = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcdef")
    data = [
        (1, a), (None, a + " "), (None, b), (None, b + " "), (None, b + "  "), (None, b), (None, c),  # one without id of b, and of c
        (2, d), (9, d + " "), (9, e), (5, f), (5, f + " "),  # 9 stays by its other text, 5 once
    ]
    stay = simhash.without_near_copies(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text.strip()) for r in stay), key=str) == sorted([(1, a), (None, b), (None, c), (2, d), (9, e), (5, f)], key=str)


@pytest.mark.parametrize("tile", [4, 64])
def test_links_connect_dense_and_sparse_fingerprints(spark, tile):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 64, 40, np.uint64)
    values = {int(c) for c in centres}
    for c in centres[:6]:  # groups around one value, where most are linked and share blocks
        for _ in range(60):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            values.add(int(c) ^ sum(1 << int(f) for f in flips))
    values = sorted(values)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 4]
    want = {frozenset(values[i] for i in m) for m in components_of(len(values), pairs).values() if len(m) > 1}
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    found = simhash.links(frame, tile=tile)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in found.collect())
    got = defaultdict(set)
    for node, root in components(found).collect():
        got[root].add(node % (1 << 64))
    assert {frozenset(x) for x in got.values()} == want


def test_components_of_paths_stars_and_cycles(spark):
    path = [(i, i + 1) for i in range(1, 60)]
    star = [(100, 100 + i) for i in range(1, 50)]
    ring = [(200 + i, 200 + (i + 1) % 20) for i in range(20)]
    got = defaultdict(set)
    for node, root in components(spark.createDataFrame(path + star + ring + [(7, 7)], "a long, b long")).collect():
        got[root].add(node)
    assert sorted(map(sorted, got.values())) == [list(range(1, 61)), list(range(100, 150)), list(range(200, 220))]
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_token_counts(spark, rows):
    want = {(i, len(t.encode()), len(TOKENIZER.encode(t, add_special_tokens=False).ids)) for i, t in rows}
    got = QUERIES["op5_token_counts"](spark, SF).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in got} == want and len(got) == len(rows)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


HARD = [
    "", " ", "aaaaaaaa aaaaaaaaa", "it's don'T we'LL 'S ''s", "1234 \u00b2\u00b3 \u2167\u2168 \u0663 \U0001d7ce", "\u03a3\u03a3\u03a3 \u03b1\u03a3",
    "\u0130stanbul \u01c5 \ufb01 \u212b", "e\u0301 \u0301x a\u0308", "\u4e2d\u6587 \u3007 \u0e01\u0e33 \u0939\u093f", "a\u200bb\xa0c\u2028d \x1c e\x85f\u180eg\ufeffh",
    "x<|endoftext|>y <|startoftext|><|endoftext|> <|EndOfText|> <|", "!!!***&&&%%%###$$$ ...---", "\U0001f600\U0001f468\u200d\U0001f469",
    "\x00\x01\x7f", "snake_case camelCase _x_ __", "\n".join("word%d" % i for i in range(300)), "\u00c0\u00c9\u00df\u1e9e \u00d1o\u00d1o",
]


def test_token_counts_and_ids_of_hard_texts(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)) + [(99, None)], "doc_id int, text string")
    want = {i: TOKENIZER.encode(t, add_special_tokens=False).ids for i, t in enumerate(HARD)} | {99: []}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()} == {i: len(x) for i, x in want.items()}
    crc = {i: zlib.crc32(np.array([*x, 0], "<u4").tobytes()) for i, x in want.items()}
    assert {r.doc_id: r.ids_crc32 for r in packing.pieces(docs).collect()} == crc


def test_merges_of_random_words():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aabbcenthsiog"), rng.integers(1, 30))) for _ in range(3000)] + ["a" * n for n in range(1, 40)]
    flat, counts = Merges(str(public_tokenizers.path("word_bpe_49k.json"))).ids([w.encode() for w in words])
    want = [e.ids for e in TOKENIZER.encode_batch(words, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == want


def test_long_text_is_cut_in_blocks(spark, monkeypatch):
    text = " ".join(f"word{i}\n <|endoftext|>" for i in range(3000))
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    n = len(TOKENIZER.encode(text, add_special_tokens=False).ids)
    assert token_counts.count_tokens(docs).first().n_tokens == n
    import gridlore.llm.word_bpe as word_bpe

    monkeypatch.setattr(word_bpe, "BLOCK_CHARS", 50)
    known = word_bpe.Known(token_counts.tokenizer_path(), limit=100)
    assert "".join(known.words.blocks(text)) == text
    assert [len(x) // 4 for x in known.ids(["a b", text, "", "c"])] == [2, n, 0, 1]


def check_packing(docs, packed, sequence=2048):
    """All ids are there, in gapless sequences of at most so many tokens; gives the number of sequences."""
    ids = [[*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 0] for t in docs]
    want = Counter()
    for x in ids:
        for k, at in enumerate(range(0, len(x), sequence)):
            own = x[at : at + sequence]
            want[k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= sequence
    return len(bins), sum(map(len, ids))


def test_packing(spark, rows):
    packed = QUERIES["op9_best_fit_packing"](spark, SF).collect()
    n, tokens = check_packing([t for _, t in rows], packed)
    assert n <= 1.01 * -(-tokens // 2048) + 1


def test_packing_in_rounds(spark, rows, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, tokens = check_packing([t for _, t in rows], packing.pack(docs, sequence=512, task_items=25).collect(), 512)
    assert n <= 1.03 * -(-tokens // 512)
    check_packing([r.text for r in odd.collect()], packing.pack(odd).collect())
    assert packing.pack(empty).collect() == []


def test_items_that_fit_nothing_end_the_rounds(spark):
    docs = spark.createDataFrame([(i, "x " * 9) for i in range(300)], "doc_id int, text string")
    packed = packing.pack(docs, sequence=15, task_items=20).collect()
    assert check_packing(["x " * 9] * 300, packed, 15)[0] == 300


def test_best_fit():
    assert packing.best_fit([5, 7, 3, 5], 10) == [[1, 2], [0, 3]]
    assert packing.best_fit([], 10) == []


def test_quality(spark):
    scores = {r.doc_id: r for r in QUERIES["op8_quality_rules"](spark, "/root/testdata/sf0.01").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scores.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in scores.items())
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(r.quality, scores[r.doc_id].predicted) for r in labels if r.doc_id in scores and scores[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_quality_odd_rows(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    assert quality.scored(odd, model).count() == odd.count()
    assert quality.scored(empty, model).collect() == []
    assert quality.accepted(odd, model, 0.0).columns == odd.columns
    assert quality.accepted(odd, model, 0.0).count() == odd.count()
    for some in (labels.limit(0), labels.filter("quality = 1")):  # nothing to tell apart
        assert quality.fit(docs, some).rules == ()


def plain_statistics(text):
    """The statistics of a text by their definition."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars, n = max(1, len(text)), max(1, len(words))

    def share(letters):
        return sum(c in letters for c in text) / chars

    return {
        "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "symbols": share("!#$%&*+/<=>@^_|~{}[]\\"), "digits": share("0123456789"),
        "stops": share(".,;:?"), "lines": share("\n"), "word_length": chars / n, "words": math.log1p(n), "distinct_words": len(set(words)) / n,
    }


def test_quality_as_by_plain_python(spark, rows, odd):
    """Statistics, rules and the logistic sum, recomputed for every text from the fitted rules and weights."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert model.rules and all(r.bounds for r in model.rules)
    for frame, texts in ((docs, rows), (odd, [(r.doc_id, r.text or "") for r in odd.collect()])):
        found = quality._measured(frame.select("doc_id", "text"), quality.F.col("text")).drop("text").collect()
        want = sorted(((i, tuple(plain_statistics(t).values())) for i, t in texts), key=str)
        assert [i for i, _ in want] == [r[0] for r in sorted(found, key=str)]
        assert Counter((r[0], *(round(x, 9) for x in r[1:])) for r in found) == Counter((i, *(round(x, 9) for x in v)) for i, v in want)
        scores = Counter()
        for i, t in texts:
            s = plain_statistics(t)
            z = model.intercept + sum(
                w for r, w in zip(model.rules, model.weights, strict=True) if all(low < s[n] <= high for n, low, high in r.bounds)
            )
            scores[i, round(1 / (1 + math.exp(-z)), 9)] += 1
        assert Counter((r.doc_id, round(r.score, 9)) for r in quality.scored(frame, model).collect()) == scores


def test_rules_are_the_paths_of_the_trees(spark):
    """A tree of two splits gives a rule for each of its nodes but the root."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    data = [(float(x > 3 and y > 5), Vectors.dense(float(x), float(y))) for x in range(10) for y in range(10)]
    forest = RandomForestClassifier(
        labelCol="l", featuresCol="x", numTrees=1, maxDepth=2, featureSubsetStrategy="all", subsamplingRate=1.0, bootstrap=False, seed=1
    ).fit(spark.createDataFrame(data, ["l", "x"]))
    rules = {r.bounds for r in quality.rules_of(forest, ["a", "b"])}
    assert len(rules) == 4 and all(1 <= len(b) <= 2 for b in rules)
    both = [b for b in rules if len(b) == 2]
    assert {n for n, _, _ in both[0]} == {"a", "b"}
    assert any(all(low > 0 and high == math.inf for _, low, high in b) for b in both)


def test_search_prunes_and_agrees_with_brute_force():
    rng = np.random.default_rng(3)
    for spread in (1, 100_000, 10**7):  # sums in single, double and whole numbers
        x = rng.integers(-spread, spread, (900, 12)) * rng.integers(0, 2, (900, 12))
        x[100:150] = x[7]
        for q, (at, score) in enumerate(topk.max_score(x[:30], x.T, [6] * 30)):
            want = x @ x[q]
            assert set(at) == set(np.flatnonzero(want >= np.sort(want)[-6])) and (score == want[at]).all()


def test_search_odd_vectors(spark):
    data = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [0.1, 0.1]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (50, [1.0, 0.5]),
            (5, [0.1, 0.1]), (6, [1.0]), (7, []), (100, []), (8, [float("inf"), 1.0]), (None, [2.0, 2.0]), (9, [-1.0, -1.0])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<float>, v int")
    got = defaultdict(list)
    for r in topk.search(vectors, k=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == {0: [(None, 512 * 384), (50, 256 * 256 + 128 * 128), (1, 25 * 384)],
                   50: [(None, 512 * 384), (0, 256 * 256 + 128 * 128), (0, 256 * 256 + 128 * 128)], 100: [(7, 0)]}
    assert topk.search(vectors.limit(0)).collect() == []


def test_exact_groups_odd_rows(spark, odd, empty):
    got = exact_dedup.exact_groups(odd).collect()
    assert len(got) == odd.count()
    of = defaultdict(list)
    for r in got:
        of[r.keep_id].append(r)
    assert sorted((r.doc_id or 0, r.kept) for r in of[1]) == [(0, False), (1, False), (1, True), (2, False)]
    assert {r.group_size for r in of[1]} == {4}
    assert sorted(r.doc_id for r in of[3]) == [3, 4] and of[5][0].n_bytes == 1
    assert of[3][0].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert exact_dedup.exact_groups(empty).collect() == []
    stay = exact_dedup.without_copies(odd)
    assert stay.columns == odd.columns and sorted(r.doc_id for r in stay.collect()) == [1, 3, 5, 6, 7, 8, 9, 10]


def test_copies_without_id_do_not_meet_in_pairs(spark, monkeypatch):
    data = [(None, f"text {i}") for i in range(300)] + [(i, f"text {i}") for i in range(300)] + [(0, "text 0")] * 20
    seen, write = {}, exact_dedup.materialise
    monkeypatch.setattr(exact_dedup, "materialise", lambda df, name: write(seen.setdefault(name, df), name))
    got = exact_dedup.exact_groups(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(got) == 620 and sorted(r.doc_id for r in got if r.kept) == list(range(300))
    plan = seen["candidates"]._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"Join \[(.*?)\], \[(.*?)\], ", plan)
    assert any("_own" in own and "_s" in other for own, other in joins)


def test_equal_fingerprints_of_different_texts_are_told_apart(spark):
    data = [(i, f"{i % 40:02d}" * 30) for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = exact_dedup.exact_groups(docs, moduli=(7,), chunk_bytes=16).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(i, i % 40, 5, i < 40) for i in range(200)}


def test_chunk_hashes_compose():
    text, moduli = bytes(range(256)) * 9, exact_dedup.MODULI
    whole = exact_dedup.shifted_hashes([text], [0], moduli, 4096)
    chunks = [text[i : i + 100] for i in range(0, len(text), 100)]
    parts = exact_dedup.shifted_hashes(chunks, [len(text) - min(len(text), i + 100) for i in range(0, len(text), 100)], moduli, 100)
    assert [sum(p) % m for p, m in zip(parts, moduli, strict=True)] == [w[0] for w in whole]
    assert [sum((b + 1) * pow(exact_dedup.BASE, len(text) - 1 - i, m) for i, b in enumerate(text)) % m for m in moduli] == [w[0] for w in whole]


def test_huge_texts_are_hashed_in_several_tasks(spark, odd):
    a = exact_dedup.fingerprints(odd).drop("_rows").collect()
    b = exact_dedup.fingerprints(odd, chunk_bytes=1000, spread_bytes=5000).drop("_rows").collect()
    assert set(a) == set(b)


def test_mix_odd_rows(spark, odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.taken <= 3 * r.size for r in got)
    by = {r.source: r for r in got}
    total = sum(r.size for r in got)
    assert set(by) == {"a", "b", "c", None} and by[None].target == 0
    assert abs(sum(r.target for r in by.values()) - total) < 1e-6
    assert all(r.target <= 3 * r.source_size for r in got)
    assert mixing.mix(empty).collect() == []
    taken = mixing.mixed(odd)
    assert taken.columns == odd.columns
    want = Counter()
    for r in got:
        want[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in taken.collect()) == +want


def test_mix_comes_near_its_targets(spark):
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    taken, target, most = Counter(), {}, Counter()
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        most[r.source] = max(most[r.source], r.size)
    assert all(abs(taken[s] - t) <= 2 * most[s] for s, t in target.items())
    assert abs(sum(taken.values()) - sum(target.values())) < 0.05 * sum(target.values())


def test_shares_of_full_sources_go_to_the_others(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 500), ("d", 0), ("e", 20), (None, 70)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame([(s, z, 1) for s, z in sizes], "source string, source_size long, docs long")).collect()}
    weight = dict(zip(["a", "b", "c", "d", "e", None], [5, 2, 1, 5, 2, 1], strict=True))
    most, total = {s: 3.0 * z for s, z in sizes}, sum(z for _, z in sizes)
    full = {}
    while True:  # reshare the excess until none is above
        open_ = {s: w for s, w in weight.items() if s not in full}
        want = {s: (total - sum(full.values())) * w / sum(open_.values()) for s, w in open_.items()}
        above = {s: most[s] for s, t in want.items() if t > most[s]}
        if not above:
            break
        full |= above
    assert got == pytest.approx(full | want)


def lines_left(docs):
    seen, gone = {}, defaultdict(set)
    for i, t in sorted(docs):
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            if seen.setdefault(tuple(lines[p : p + 3]), (i, p)) != (i, p):
                gone[i] |= {p, p + 1, p + 2}
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in docs}


def test_line_dedup_odd_rows(spark, odd, empty):
    got = {r.doc_id: r for r in line_dedup.without_repeated_lines(odd).collect()}
    assert got[9].text == "x\ny\nz\nq" and got[3].text == "" and got[8].keep_id == "k"
    assert line_dedup.without_repeated_lines(odd).columns == odd.columns
    assert line_dedup.dedup_lines(empty).collect() == []
    data = [(1, "a\na\na\na\na\nb\nc"), (2, "q\na\nb\nc\nd\ne"), (3, "b\nc\nd\ne\nf"), (4, "c\nd"), (5, "\n\n\n\n")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert {r._row.doc_id: r._text for r in line_dedup.dedup_lines(docs).collect()} == lines_left(data)


def test_line_dedup_of_missing_and_repeated_ids(spark):
    data = [
        (1, "a\nb\nc\nd"), (None, "p\nq\nr\na\nb\nc"), (None, "1\n2\n3\n4\n5\n6\n7"), (2, "a\nb\nc\nz"), (2, "e\nf\ng\nh"),
        (None, "k\nl\nm\nx"), (None, "k\nl\nm\ny"),
    ]
    done = line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()
    got = {(r._row.doc_id, r._row.text): (r._text, r._n_removed) for r in done}
    assert len(done) == len(data) == len(got)
    assert got[data[0]] == (data[0][1], 0) and got[data[1]] == ("p\nq\nr", 3) and got[data[2]] == (data[2][1], 0)
    assert got[data[3]] == ("z", 3) and got[data[4]] == (data[4][1], 0)
    assert {got[data[5]], got[data[6]]} in ({("k\nl\nm\nx", 0), ("y", 3)}, {("x", 3), ("k\nl\nm\ny", 0)})


def test_url_filter_odd_rows(spark):
    urls = {
        1: None, 2: "", 3: "no scheme.com/x", 4: "HTTP://A.Example.COM/en/x?y", 5: "http://www.example.com/en/", 6: "http://example.com/en",
        7: "http://net/es/", 8: "http://x.net/de/free-bets", 9: "http://x.net/free", 10: "http://casino.org", 11: "http://casinoland.org/asexual",
        12: "a://b.net:80/es/", 13: "http://x.org/cheap/../pills#free", 14: "http://notexample.com/en/x", 15: "://?x", 16: "http://x.org/1\n2?q\nfree free",
    }
    pages = spark.createDataFrame([(i, u, "r", 1) for i, u in urls.items()], "page_id long, url string, rule string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("a.example.com", "/en/x", "example.com/en/", "block"),
        5: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 6: ("example.com", "/en", "com/", "allow"),
        7: ("net", "/es/", "net/es/", "block"), 8: ("x.net", "/de/free-bets", None, "block"), 9: ("x.net", "/free", None, "allow"),
        10: ("casino.org", "", None, "block"), 11: ("casinoland.org", "/asexual", None, "allow"), 12: ("b.net:80", "/es/", None, "allow"),
        13: ("x.org", "/cheap/../pills", None, "block"), 14: ("notexample.com", "/en/x", "com/", "allow"), 15: ("", "", None, "allow"),
        16: ("x.org", "/1\n2", None, "allow"),
    }
    assert url_filter.judge(pages.limit(0)).collect() == []
    assert re.search("://", urls[15])


def strings_left(docs, length=100):
    """doc_id -> (bytes, removed, spans, digest of what is left), each string of so many bytes looked up."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        data = t.encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        edges = int((gone & ~np.r_[False, gone[:-1]]).sum())
        left = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out[i] = (len(data), int(gone.sum()), edges, hashlib.sha256(left).hexdigest())
    return out


def removed(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_repeated_strings(spark, rows):
    got = removed(QUERIES["op3_repeated_strings"](spark, SF))
    want = strings_left(rows)
    assert got == want and sum(n for _, n, _, _ in want.values()) > 10_000


def test_repeated_strings_of_hard_texts(spark, odd, empty, monkeypatch):
    rng = np.random.default_rng(11)
    piece = lambda n: "".join(rng.choice(list("ab c\né"), n))
    passages = [piece(n) for n in (99, 100, 101, 150, 400)]
    texts = ["a" * 700, "ab" * 300, "a" * 350 + "b" * 350, "abc" * 200 + "ab", "", "a" * 99, "a" * 100]
    for _ in range(40):
        texts.append(piece(rng.integers(0, 150)) + passages[rng.integers(5)] + piece(rng.integers(0, 90)) + passages[rng.integers(5)][:130])
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert removed(suffix_dedup.without_repeats(frame)) == strings_left(docs)
    odd_rows = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    assert removed(suffix_dedup.without_repeats(odd_rows)) == strings_left([(r.doc_id, r.text or "") for r in odd_rows.collect()])
    assert suffix_dedup.without_repeats(odd).count() == odd.count()
    assert suffix_dedup.without_repeats(empty).collect() == []


def test_samples_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 101, n, np.uint8)) for n in (5000, 99, 100, 3000, 0, 250)]
    whole = {(int(r), int(p) - d) for rows, places, _, lo, hi in suffix_dedup.samples(texts) for r, p, a, b in zip(rows, places, lo, hi, strict=True) for d in range(a, b + 1)}
    assert whole == {(i, p) for i, t in enumerate(texts) for p in range(len(t) - 99)}  # every string has one
    places = {(int(r), int(p)) for rows, at, *_ in suffix_dedup.samples(texts) for r, p in zip(rows, at, strict=True)}
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    assert {(int(r), int(p)) for rows, at, *_ in suffix_dedup.samples(texts) for r, p in zip(rows, at, strict=True)} == places
