"""Vector codes, whitening and license scans against brute force."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import licenses, vector_codes, whitening

KINDS = "vec_id long, embedding array<float>, label int, code string, x int, n long"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [c if c is None else float(c) for c in v], g, "mine", 5, 6) for i, v, g in rows], KINDS)


def cloud(rng, n, dim, places=6):
    """Vectors around a few places, with exact copies and ties among them."""
    centres = [[rng.choice((-1, -0.5, 0, 0.25, 1)) for _ in range(dim)] for _ in range(places)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)], rng.choice((1, 2, None))) for i in range(n)]
    return rows + [(1000 + i, rows[i % 3][1], 1) for i in range(n // 3)] + [(2000 + i, rng.choice(centres), 2) for i in range(n // 4)]


BAD = [(9001, None, 1), (9002, [None] * 32, 1), (9003, [NAN] + [0.0] * 31, 1), (9004, [INF] * 32, None), (9005, [0.5] * 17, 1), (9006, [-3e30] * 32, 2)]


def plain_codes(rows, entries=64, rounds=2):
    """Lloyd rounds with every distance, in whole numbers of Python."""
    kept = [(i, [math.floor(256 * np.float32(c).item()) for c in v], g) for i, v, g in rows]
    if not kept:
        return {}, ""
    width = len(kept[0][1]) // 16
    cut = lambda x, p: x[p * width : (p + 1) * width]
    first = [x for _, x, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    books = [[cut(x, p) for x in first] for p in range(16)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    for k in range(rounds + 1):
        best = [[min((far(cut(x, p), e), j) for j, e in enumerate(books[p])) for p in range(16)] for _, x, _ in kept]
        for p in range(16) if k < rounds else ():
            for j in range(len(books[p])):
                mine = [cut(x, p) for (_, x, _), b in zip(kept, best, strict=True) if b[p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = [sum(d for d, _ in b) for b in best]
    by_label = defaultdict(int)
    for (_, _, g), e in zip(kept, error, strict=True):
        by_label[g] += e
    return sorted((str(i), "".join(f"{j:02x}" for _, j in b), e, by_label[g], sha) for (i, _, g), b, e in zip(kept, best, error, strict=True))


@pytest.mark.parametrize("dim,n", [(32, 150), (16, 20)])
def test_codes_equal_plain_lloyd(spark, dim, n):
    rows = [*cloud(random.Random(dim), n, dim), (None, [0.1] * dim, None), (7, [0.2] * dim, None), (7, [0.1] * dim, 1)]
    coded, _ = vector_codes.compress(vectors(spark, rows + BAD).repartition(3))
    got = vector_codes.label_errors(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain_codes(rows)


def test_codes_of_few_other_and_no_vectors(spark):
    """Fewer vectors than entries, two dimensions beside each other, empty vectors, an empty table."""
    a, b = [(i, [i / 7] * 16, 1) for i in range(3)], [(10 + i, [i / 3 - c for c in range(32)], 1) for i in range(70)]
    coded, books = vector_codes.compress(vectors(spark, a + b + [(99, [], 1)]))
    got = {r["vec_id"]: r for r in vector_codes.label_errors(coded).collect()}
    assert books[16].shape == (16, 3, 1) and books[32].shape == (16, 64, 2) and len(got) == 74
    for part in (a, b):
        assert sorted((str(i), got[i]["code"], got[i]["error"], got[i]["codebooks_sha256"]) for i, _, _ in part) == [(*r[:3], r[4]) for r in plain_codes(part)]
    assert got[99]["code"] == "00" * 16 and got[99]["error"] == 0
    assert len({r["label_error"] for r in got.values()}) == 1
    assert vector_codes.label_errors(vector_codes.compress(vectors(spark, []))[0]).count() == 0


def test_bounds_skip_distances_and_never_decide_ties():
    rng = np.random.default_rng(3)
    centres = rng.integers(-300, 300, (40, 4))
    x = centres[rng.integers(0, 40, 3000)] + rng.integers(-6, 7, (3000, 4))
    book = np.vstack([x[:31], x[:31] + [1, 0, 0, 0], x[:2]])  # equal entries and near ones
    code, upper, lower = vector_codes.first_assignment(x, book)
    for _ in range(4):
        new = np.array([x[code == j].sum(axis=0) // max((code == j).sum(), 1) if (code == j).any() else book[j] for j in range(len(book))])
        moved = vector_codes._up(vector_codes._squared(new, book))
        code, upper, lower, taken = vector_codes.next_assignment(x, new, code, upper + moved[code], np.maximum(lower - moved, 0))
        book = new
        squared = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (code == squared.argmin(axis=1)).all()
        assert (upper**2 * (1 + 1e-9) >= squared.min(axis=1)).all() and (lower**2 <= squared * (1 + 1e-9)).all()
        assert taken < len(x) * len(book) / 3


def plain_whitening(rows):
    kept = [(i, [math.floor(256 * np.float32(c).item()) for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    n, s = len(fit), [int(c) for c in fit.sum(axis=0)]
    y = fit - fit.mean(axis=0)
    v = y.T @ y / n
    values, vecs = np.linalg.eigh(v)
    values, vecs = values[::-1][:4], vecs[:, ::-1][:, :4]
    out = {}
    for i, x in kept:
        for k in range(len(values)):
            out[i, k + 1] = (n, sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True)), abs((np.array(x) - fit.mean(axis=0)) @ vecs[:, k]) / np.sqrt(values[k]), values[k] / np.trace(v))
    return out


@pytest.mark.parametrize("dim", [3, 16, 37])
def test_whitening_equals_plain_numpy(spark, dim):
    """One tile in part, one whole, and several of different widths; copies count once in the fit."""
    rng = np.random.default_rng(dim)
    scale = np.linspace(3, 0.3, dim)
    rows = [(i, (rng.normal(size=dim) * scale + 5).tolist()) for i in range(90)]
    rows += [(500 + i, rows[i % 2][1]) for i in range(200)]
    bad = [(9001, None), (9002, [None] * dim), (9003, [NAN] * dim), (9004, [INF] * dim), (9005, []), (9006, [3e30] * dim)]
    got = whitening.whiten(vectors(spark, [(i, v, 1) for i, v in rows + bad]).repartition(5)).collect()
    want = plain_whitening(rows)
    assert len(got) == len(want) == 290 * min(dim, 4)
    for r in got:
        n, deviation, whitened, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(whitened, rel=1e-7, abs=1e-7) and r["explained"] == pytest.approx(explained, rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-9


def test_whitening_of_row_blocks(spark, monkeypatch):
    """Many row blocks a task give what one gives."""
    monkeypatch.setattr(whitening, "ROWS", 7)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=20) * np.arange(1, 21)).tolist()) for i in range(60)]
    want = plain_whitening(rows)
    for r in whitening.whiten(vectors(spark, [(i, v, 1) for i, v in rows])).collect():
        assert abs(r["whitened"]) == pytest.approx(want[r["vec_id"], r["component"]][2], rel=1e-7, abs=1e-7)


def test_whitening_without_variance_beyond_longs_and_empty(spark):
    one = whitening.whiten(vectors(spark, [(1, [0.5] * 5, 1), (2, [0.5] * 5, 1), (None, [0.5] * 5, 1)])).collect()
    assert len(one) == 12 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, 0.0, None) for r in one)
    flat = whitening.whiten(vectors(spark, [(i, [i, 2 * i, 0, 0, 0], 1) for i in range(9)])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) and r["identity_error"] < 1e-9 for r in flat)
    large = whitening.whiten(vectors(spark, [(1, [2.0**40, 1], 1), (2, [-(2.0**40), 2], 1), (3, [2.0, 7], 1), (4, [1.0, 2, 3], 1)])).collect()
    assert {r["vec_id"]: r["deviation"] for r in large if r["vec_id"] < 4}[1] is None and {r["n"] for r in large} == {1, 3}
    assert whitening.whiten(vectors(spark, [])).count() == 0


def plain_scan(rows):
    """Phrases by comparing words; spans of texts by votes, merged and single diagonals, in plain Python."""
    cut = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or ""))
    out = []
    for doc_id, text in rows:
        w, labels, score, places = cut(text), set(), 0.0, []
        for label, phrase in licenses.PHRASES:
            p = cut(phrase)
            places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        for label, template in licenses.TEXTS:
            t, votes = cut(template), defaultdict(set)
            for j in range(len(t) - 2):
                for i in range(len(w) - 2):
                    if w[i : i + 3] == t[j : j + 3]:
                        votes[i - j].add(j)
            groups, last = [], None
            for d in sorted(votes):
                if last is None or d - last > min(8, len(t) // 4):
                    groups.append([])
                groups[-1].append(d)
                last = d
            for g in groups + [[d] for d in votes]:
                at = [d + j for d in g for j in votes[d]]
                share = len(set().union(*(votes[d] for d in g))) / (len(t) - 2)
                if share >= 0.8 and max(at) + 3 - min(at) <= 1.5 * len(t):
                    labels.add(label)
                    score = max(score, share)
        base = {label for _, label in places}
        at = [i for i, _ in places]
        out.append((str(doc_id), len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels | base)), 1.0 if places else score))
    return sorted(out, key=str)


def test_license_scans_equal_brute_force(spark):
    rng = random.Random(4)
    noise = lambda n: " ".join("".join(rng.choice("abcdeäß日") for _ in range(rng.randint(1, 6))) for _ in range(n))
    rows = [(1, None), (2, ""), (3, "mit"), (4, "x" * 100_000), (None, "Under the MIT-License!"), (5, "CC BY-NC cc_by_nc cc by\x00nc"), (5, "CC BY-NC cc_by_nc cc by\x00nc"), (6, "under the mit licenses"), (7, "UNDER THE MIT LİCENSE é"), (8, "apache license version 2" * 3)]
    for i, (_, text) in enumerate(licenses.TEXTS):
        w = text.split()
        edited = [x for x in w if rng.random() > 0.03]
        for _ in range(len(w) // 25):
            edited.insert(rng.randrange(len(edited)), "really")
        rows += [(100 + i, f"{noise(30)}\n{text.upper()} {noise(9)}"), (200 + i, f"{noise(7)} {' '.join(edited)} {noise(7)}"), (300 + i, " ".join(w[: len(w) // 2])), (400 + i, f"{text} {text} {noise(3)} {text}")]
    rows += [(900, "mit license " * 3000), (901, " ".join(["under the mit license", noise(3)] * 2000)), (902, noise(20_000))]
    docs = spark.createDataFrame([(d, t, 1, "mine", 2.0) for d, t in rows], "doc_id long, text string, rid int, label string, w double")
    got = licenses.scan(docs.repartition(4)).collect()
    assert sorted(((str(r[0]), *r[1:]) for r in got), key=str) == plain_scan(rows)
    found = {r["doc_id"]: r for r in got}
    assert all(label in found[100 + i]["labels"].split(",") for i, (label, _) in enumerate(licenses.TEXTS))
    assert sum(label in found[200 + i]["labels"].split(",") for i, (label, _) in enumerate(licenses.TEXTS)) >= 8
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_templates_are_bounded(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    assert licenses.scan(docs, [("x", "b c d"), ("y", "c d e"), ("x", "a b c")], []).collect()[0][1:] == (5, 3, 0, 2, "x,y", "x,y", 1.0)
    with pytest.raises(ValueError):
        licenses.scan(docs, [("x", "two words")], [])
    with pytest.raises(ValueError):
        licenses.scan(docs, [("x", "w " * (licenses.MAX_TEMPLATE_WORDS + 1))], [])
