"""Bounds on what a task holds, and parts of operators against plain Python."""

import tracemalloc
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridlore.llm import packing, topk, url_filter, word_bpe

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def plain_best_fit(sizes, room):
    left = []
    for size in sorted(sizes, reverse=True):
        fitting = [i for i, x in enumerate(left) if x >= size]
        if fitting:
            best = min(fitting, key=lambda i: left[i])
            left[best] -= size
        else:
            left.append(room - size)
    return Counter(left)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_as_by_plain_search(seed):
    rng = np.random.default_rng(seed)
    room = int(rng.integers(5, 200))
    sizes = rng.integers(1, room + 1, 300).tolist()
    bins = packing.best_fit(sizes, room)
    assert sorted(i for b in bins for i in b) == list(range(300))
    assert Counter(room - sum(sizes[i] for i in b) for b in bins) == plain_best_fit(sizes, room)


def test_a_round_holds_numbers_only(spark):
    """40,000 bins, whatever lies in them, are packed in one task; members are in the tables of links."""
    items = spark.range(40_000).selectExpr("id AS bin", "1 + id % 40 AS fill").coalesce(1)
    links = packing._packed(items, 2048, 3).collect()
    assert len(links) == 40_000 and len({r.child for r in links}) == 40_000
    ends = Counter()
    for r in links:
        ends[r.parent] += 1 + r.child % 40
    assert all(ends[r.parent] == r.fill <= 2048 for r in links)


def test_many_tiny_texts_in_rounds(spark):
    docs = spark.range(5_000).selectExpr("id AS doc_id", "repeat('a ', cast(id % 9 AS int)) AS text")
    placed = packing.pack(docs, sequence=400, task_items=300).collect()
    at = {}
    for r in placed:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(placed) == 5_000
    for own in at.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 400
    assert len(at) <= 1.02 * -(-sum(r.length for r in placed) // 400) + 1


def test_remembered_chunks_are_bounded():
    known = word_bpe.Known(PATH, limit=4 << 20)
    rng = np.random.default_rng(0)
    list(known.ids(["a \u0394"]))  # what is built once
    tracemalloc.start()
    for _ in range(12):  # 4 MB without blanks
        blob = "".join(map(chr, rng.integers(0x4E00, 0x9FA0, 110_000)))
        list(known.ids([blob]))
    assert known.held < 1000
    for _ in range(10):
        list(known.ids([" ".join(f"w{x}" for x in rng.integers(0, 1 << 60, 10_000))]))
        assert known.held < (4 << 20) + 10_000 * 300
    assert tracemalloc.get_traced_memory()[0] < 60 << 20
    tracemalloc.stop()


def test_every_code_point_as_the_library():
    library, known = Tokenizer.from_file(PATH), word_bpe.Known(PATH)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b" for c in points if unicodedata.category(c) != "Cn"]
    texts += [f"aͅ{c}" for c in points if unicodedata.combining(c)] + [f"ä{c}̧" for c in points if unicodedata.combining(c)]
    texts += [f"a{c}b" for c in points if unicodedata.category(c) == "Cn"][::9]
    for lo in range(0, len(texts), 20_000):
        some = texts[lo : lo + 20_000]
        want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in known.ids(some)] == want


def test_rows_without_id_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 64)
    rng = np.random.default_rng(2)
    data = [(None if i % 3 else i, rng.normal(size=4).tolist()) for i in range(1500)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = topk.search(frame).collect()
    whole = [[int(np.floor(256 * x)) for x in v] for _, v in data]
    for q in {r.query_id for r in got}:
        scores = sorted((sum(a * b for a, b in zip(whole[q], w, strict=True)) for i, w in enumerate(whole) if data[i][0] != q), reverse=True)
        assert [r.score for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == scores[:5]
    sizes = frame.selectExpr("pmod(xxhash64(monotonically_increasing_id(), 'shard'), 24) AS s").groupBy("s").count()
    assert sizes.agg({"count": "max"}).first()[0] < 3 * 64


def test_forms_and_vocabulary_of_a_table(spark):
    assert url_filter.forms("bet") == ("bet", "bets", "betted", "betting")
    assert url_filter.forms("gamble") == ("gamble", "gambles", "gambled", "gambling")
    assert {"pharmacies", "crashes", "pills"} <= {f for t in ("pharmacy", "crash", "pill") for f in url_filter.forms(t)}
    terms = spark.createDataFrame(
        [("Bad", True), ("meh", False), ("bad", False), (None, True), ("", True), ("odd", None), ("so", False), ("meh", False)], "term string, strict boolean"
    )
    strict, soft = url_filter.vocabulary(terms)
    assert (strict, soft) == (("bad",), ("meh", "so"))
    urls = ["http://x.org/badding", "http://x.org/badly", "http://meh.org/mehs", "http://meh.org/so", "HTTP://BADS.org", None, "", "http://x.org/" + "a/" * 200_000 + "bad"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate([*urls, *urls])], "page_id int, url string, strict_hits int")
    got = sorted((r.page_id, r.strict_hits, r.soft_hits, r.verdict) for r in url_filter.judge(pages, (), strict, soft).collect())
    want = [(1, 0, "block"), (0, 0, "allow"), (0, 1, "allow"), (0, 2, "block"), (1, 0, "block"), (0, 0, "allow"), (0, 0, "allow"), (1, 0, "block")]
    assert got == [(i, *w) for i, w in enumerate([*want, *want])]
    assert url_filter.judge(pages.limit(0), (), strict, soft).collect() == []
    monster = spark.range(5).selectExpr("concat('t', id) AS term", "true AS strict")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(url_filter, "MAX_TERMS", 4)
        with pytest.raises(ValueError, match="at most 4"):
            url_filter.vocabulary(monster)
