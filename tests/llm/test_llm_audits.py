"""Whitening, filter audit and license scan against plain Python on small tables."""

import itertools
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from brute import SF

import __spark_entry__ as entry
from gridlore.llm import filter_audit, licenses, whitening

QUERIES = entry.queries()


# whitening


def whitened(rows, k=4):
    """{(vec_id, component): …} of integer vectors by numpy, signs as they come, and the fit's numbers."""
    fit = np.array(sorted({tuple(x) for _, x in rows}), float)
    n, mean = len(fit), fit.mean(axis=0)
    cov = (fit - mean).T @ (fit - mean) / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    sums = [sum(int(x[i]) for x in fit) for i in range(fit.shape[1])]
    out = {}
    for at, (i, x) in enumerate(rows):
        exact = sum((n * int(a) - s) ** 2 for a, s in zip(x, sums, strict=True))
        for c in range(min(k, len(e))):
            out[at, c + 1] = (i, n, exact, (np.array(x) - mean) @ v[:, c] / np.sqrt(e[c]), e[c] / np.trace(cov))
    return out


def test_whitening(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, [int(np.floor(256 * float(x))) for x in r.embedding]) for r in vectors.collect()]
    got = QUERIES["op11_whitening"](spark, SF).collect()
    want = whitened(rows)
    assert len(got) == len(want) == 4 * len(rows)
    mine = {(r.vec_id, r.component): r for r in got}
    sign = {c: np.sign(mine[rows[0][0], c].whitened * want[0, c][3]) for c in range(1, 5)}
    for (_, c), (i, n, exact, w, explained) in want.items():
        r = mine[i, c]
        assert (r.n, r.deviation) == (n, exact)
        assert r.whitened * sign[c] == pytest.approx(w, rel=1e-9, abs=1e-9)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert 0 <= r.identity_error < 1e-9


def test_whitening_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 6)  # blocks of two rows
    monkeypatch.setattr(whitening, "TASK_BLOCKS", 2)
    good = [(i, [float(i % 5), float(i * i % 7), float(i % 3)]) for i in range(40)]
    odd = [
        (1, [1.0, 1.0, 3.0]), (None, [1.0, 1.0, 3.0]), (None, [9.0, 0.5, -0.25]), (90, None), (91, []), (92, [1.0]), (93, [1.0, None, 2.0]),
        (94, [float("nan"), 0.0, 0.0]), (95, [float("inf"), 0.0, 0.0]), (96, [1.0, 2.0, 3.0, 4.0]),
    ]
    frame = spark.createDataFrame([(i, x, "a", 0, 1) for i, x in good + odd], "vec_id long, embedding array<double>, x string, n int, component int")
    used = [(i, [int(np.floor(256 * v)) for v in x]) for i, x in good + odd[:3]]
    want = whitened(used)
    got = whitening.whiten(frame).collect()
    assert Counter((r.vec_id, r.component, r.n, r.deviation) for r in got) == Counter((i, c, n, d) for (_, c), (i, n, d, *_) in want.items())
    by_id = defaultdict(list)
    for (_, c), (i, _, _, w, _) in want.items():
        by_id[i, c].append(abs(w))
    mine = defaultdict(list)
    for r in got:
        mine[r.vec_id, r.component].append(abs(r.whitened))
    assert all(np.allclose(sorted(mine[k]), sorted(v)) for k, v in by_id.items())
    assert {r.component for r in got} == {1, 2, 3} and got[0].identity_error < 1e-9


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in one} == {
        (i, c, 1, 0, None, None) for i in (1, 2) for c in (1, 2)
    }
    line = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], schema)).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)}
    assert {round(abs(r.whitened), 9) for r in line if r.component == 1} == {1.0} and line[0].identity_error < 1e-9


def test_deviation_beyond_a_long_is_null(spark):
    rows = spark.createDataFrame([(1, [1e15]), (2, [-1e15])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(rows).collect()} == {None}


# filter audit


def statistics(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


def failures(text, precedes):
    words, distinct, capitals, points, symbols = statistics(text)
    return "".join(
        f for f, c in zip("ABCDE", (words < 200, 100 * distinct < 50 * words, 100 * capitals > 2 * points, symbols > 0, precedes), strict=True) if c
    )


def audit(docs, labels):
    """The audit of (doc_id, text, source) rows and {doc_id: (quality, toxic)}."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, s in docs:
        t = t or ""
        rows.append((s or "", failures(t, t in first and (i is None or i > first[t])), labels.get(i, (None, None))))
    out = {}
    shapley = Counter()
    for part in {s for s, _, _ in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [(f, q) for s, f, q in rows if s == part]
            gone = []
            for step, x in enumerate(order, 1):
                here = [r for r in left if x in r[0]]
                redundant = sum(x in f for f in gone)
                gone += [f for f, _ in here]
                left = [r for r in left if x not in r[0]]
                unique = sum(f == x for s, f, _ in rows if s == part)
                shapley[part, x] += len(here)
                out[part, "".join(order), step] = (
                    len(left), len(here), redundant, unique, sum(q[0] == 1 for _, q in here), sum(q[1] == 1 for _, q in here)
                )
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_filter_audit(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op12_filter_audit"](spark, SF).collect()
    assert set(map(tuple, got)) == audit(docs, labels) and len(got) == 600 * len({s or "" for _, _, s in docs})


def test_filter_audit_odd_rows(spark, odd, empty):
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (None, 1, 1), (6, None, 1), (99, 1, 1), (10, 1, 0)]
    frame = spark.createDataFrame([(i, q, t, 0) for i, q, t in labels], "doc_id long, quality int, toxic int, part int")
    docs = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    kind = {1: (1, 1), 2: (1, None), 6: (None, 1), 10: (1, 0)}
    assert set(map(tuple, filter_audit.audit(odd, frame).collect())) == audit(docs, kind)
    assert filter_audit.audit(empty, frame).collect() == []


PIECES = ["a", "bb", "Zürich", "x" * 63, "x" * 64, "x" * 65, "y" * 700, "\U0001f600", "#", " ", "\t\n", "\x0b\x0c\r", "\x1c", "\x85", "　", "ABC", "|"]


def test_bytes_are_counted_as_by_plain_python():
    rng = np.random.default_rng(3)
    for limit in (32, 1 << 20):
        texts = ["", " ", *("".join(rng.choice(PIECES, rng.integers(0, 60))) for _ in range(120))]
        data = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, data)])
        assert filter_audit.measure(b"".join(data), offsets).T.tolist() == [statistics(t) for t in texts]
        for t, d in zip(texts, data, strict=True):
            if d:
                assert filter_audit.measure_long(d, limit)[:, 0].tolist() == statistics(t)


def test_spans_with_one_slot_are_told_apart(monkeypatch):
    monkeypatch.setattr(filter_audit, "MULTIPLIER", np.uint64(0))  # every word has the same slot
    texts = [b"a b a c b", b"a a", b"longer_than_a_lane longer_than_a_lanf longer_than_a_lane"]
    assert filter_audit.measure(b"".join(texts), np.cumsum([0, *map(len, texts)]))[1].tolist() == [3, 1, 2]


# license scan


def places(words, templates, df):
    """(label, base, start, share) of every template, as the definition has it."""
    out = []
    at = defaultdict(list)
    for i, w in enumerate(words):
        at[w].append(i)
    for t in templates:
        own = t.words()
        rare = sorted({w for w in own if w in at}, key=lambda w: (df[w], w))[: licenses.RARE]
        agree = Counter(s for w in rare for s in {i - p for i in at[w] for p, o in enumerate(own) if o == w})
        for s, votes in agree.items():
            if votes >= 2 and all(s + k >= 0 and words[s + k : s + k + len(key)] == key for k, key in t.phrases()):
                found = sum(0 <= s + p < len(words) and words[s + p] == w for p, w in enumerate(own))
                out.append((t.label, t.base, s, found / len(own)))
    return out


def scanned(rows, templates=(*licenses.BASE, *licenses.PASSAGES)):
    cut = [(i, licenses.split_words(t or "")) for i, t in rows]
    df = Counter(w for _, words in cut for w in set(words))
    out = []
    for i, words in cut:
        found = places(words, templates, df)
        base = [s for _, b, s, _ in found if b]
        out.append((
            i, len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted({x for x, b, *_ in found if b})),
            ",".join(sorted({x for x, *_ in found})), max((x[3] for x in found), default=0.0),
        ))
    return Counter(out)


def base_by_plain_search(text):
    words = licenses.split_words(text or "")
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    return [(n, i) for n, p in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]


def test_license_scan(spark, rows):
    got = QUERIES["op13_license_scan"](spark, SF).collect()
    assert Counter(map(tuple, got)) == scanned(rows)
    texts = dict(rows)
    for r in got:
        found = base_by_plain_search(texts[r.doc_id])
        assert r.n_base == len(found) and set(filter(None, r.base_labels.split(","))) == {n for n, _ in found}
    assert any(r.n_base for r in got)


MIT = next(t.passage for t in licenses.PASSAGES if t.label == "mit")


def test_license_scan_odd_texts(spark, odd, empty):
    texts = [
        (1, "UNDER THE MIT LICENSE under the mit license; under-the_mit.license"), (1, "UNDER THE MIT LICENSE"), (2, None), (3, ""), (None, "cc by-nc"),
        (None, "CC BY NC 4.0, cc by nc"), (4, "İ under the mİt license and the K"), (5, MIT), (6, MIT.replace("copy modify", "copy and modify")),
        (7, MIT.split("any person")[1]), (8, "under the old mit license"), (9, "spam " * 40_000 + "apache license, version 2.0 " * 300),
        (10, "deal in the software without restriction sublicense and or sell copies"), (11, "apache license version 2 apache license version 2"),
        (12, "cc by by nc cc by cc by nc nc"),
    ]
    frame = spark.createDataFrame([(i, t, 1, "x", 0) for i, t in texts], "doc_id long, text string, n_words int, labels string, _places int")
    got = licenses.labelled(frame).collect()
    assert Counter(map(tuple, got)) == scanned(texts)
    of = {r.doc_id: r for r in got}
    assert of[5].labels == "mit" and of[5].score == 1.0 and of[5].n_base == 0
    assert (of[9].n_base, of[9].first_word, of[9].base_labels) == (300, 40_000, "apache-2")
    assert (of[4].labels, of[8].labels, of[10].labels) == ("", "", "")
    assert [r.n_base for r in got if r.doc_id == 1] in ([3, 1], [1, 3])
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter(map(tuple, licenses.labelled(odd).collect())) == scanned(docs)
    assert licenses.labelled(empty).collect() == []


def test_license_scan_of_own_templates(spark):
    own = (licenses.Template("x", "alpha beta gamma delta epsilon", ("beta gamma", "epsilon")), licenses.Template("y", "one two one two three", base=True))
    texts = [(1, "alpha beta gamma zeta epsilon"), (2, "beta gamma delta epsilon"), (3, "alpha gamma beta delta epsilon"), (4, "one two one two one two three")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert Counter(map(tuple, licenses.labelled(frame, own).collect())) == scanned(texts, own)
    with pytest.raises(ValueError, match="no run of words"):
        licenses.Template("x", "a b c", ("a c",)).phrases()
    with pytest.raises(ValueError, match="ASCII"):
        licenses.Template("x", "Lizenz für").phrases()


def test_plain_python_counts_are_fractions_of_templates():
    """Shares are quotients of whole numbers, so that both engines give the same double."""
    assert all(Fraction(k, len(t.words())) for t in licenses.BASE for k in range(1, len(t.words())))
