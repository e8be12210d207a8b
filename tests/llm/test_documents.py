"""Quality rules, line runs, near-dedup, sharding and the pipeline against brute force."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import graph, line_runs, quality, sharding, weighted_minhash

ODD = [(1, None, None), (2, "", "en"), (3, "a\x00b \x85 c d", "en"), (4, "one two\none two\n\n \none two ", "xx"), (5, "w " * 20_000, "en"), (None, "null id here", "en"), (7, "same text " * 12, "en"), (7, "same text " * 12, "en"), (8, "日本 語\n日本 語\r\n" * 3, None)]


def prose(rng, n, words=400):
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def frame(spark, data):
    return spark.createDataFrame([(d, t, g, 9, "c") for d, t, g in data], "doc_id long, text string, lang string, _kept int, rank string")


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(wins), set()
    for i, w in enumerate(wins):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_counts_and_clean_documents_stay(spark):
    rng = random.Random(1)
    letters = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))
    clean = [(100 + i, letters(rng.randint(60, 200)), "en") for i in range(60)]
    junk = [(300 + i, " ".join("".join(rng.choice("XQZ#*$%0187") for _ in range(6)) for _ in range(80)), "en") for i in range(2)]
    data = ODD + clean + junk
    docs = frame(spark, data).withColumn("bits", F.lit("mine")).withColumn("_lang", F.lit(3)).withColumn("_batch", F.lit(4))
    scored = quality.score(docs, quality.train(docs)).cache()
    got = quality.judge(scored).collect()
    assert len(got) == len(data) and all(r["row"]["bits"] == "mine" and r["row"]["_batch"] == 4 for r in got)
    want = sorted((str(d), *base(t)) for d, t, _ in data)
    assert sorted((str(r["row"]["doc_id"]), *(r[c] for c in quality.BASE)) for r in got) == want
    kept = {r["row"]["doc_id"] for r in got if r["kept"]}
    assert {d for d, _, _ in clean} <= kept
    assert not kept & {d for d, _, _ in junk}
    assert quality.judge(quality.score(docs.limit(0), quality.train(docs.limit(0)))).count() == 0


def kneser_ney(data):
    """bits(lang, before, character) of interpolated modified Kneser-Ney over code points, in plain Python."""
    texts, count = {}, {}
    for _, t, lang in data:
        padded = "\n" * 3 + (t or "")
        for i in range(3, len(padded)):
            g = (lang or "", padded[i - 3 : i + 1])
            count[g] = count.get(g, 0) + 1
            texts.setdefault(g, set()).add(t)
    levels = {4: {g: n for g, n in count.items() if len(texts[g]) > 1}}
    for k in (3, 2, 1):
        levels[k] = Counter((lang, g[1:]) for lang, g in levels[k + 1])
    cuts, total, left = {}, Counter(), Counter()
    for k, level in levels.items():
        for lang in {x for x, _ in level}:
            t = [max(1, sum(n == j for (x, _), n in level.items() if x == lang)) for j in (1, 2, 3, 4)]
            y = t[0] / (t[0] + 2 * t[1])
            cuts[k, lang] = [min(max(1 - 2 * y * t[1] / t[0], 0.1), 0.9), min(max(2 - 3 * y * t[2] / t[1], 0.1), 1.9), min(max(3 - 4 * y * t[3] / t[2], 0.1), 2.9)]
        for (lang, g), n in level.items():
            total[lang, k, g[:-1]] += n
            left[lang, k, g[:-1]] += cuts[k, lang][min(n, 3) - 1]

    def p(lang, g):
        if not g:
            letters = sum(x == lang for x, _ in levels[1])
            return 1 / (letters + 1) if letters else 2**-quality.UNKNOWN_BITS
        k, low = len(g), p(lang, g[1:])
        if not total[lang, k, g[:-1]]:
            return low
        n = levels[k].get((lang, g), 0)
        return (max(n - cuts[k, lang][min(n, 3) - 1], 0) if n else 0) / total[lang, k, g[:-1]] + left[lang, k, g[:-1]] / total[lang, k, g[:-1]] * low

    return lambda lang, before, c: -math.log2(p(lang or "", before + c))


def test_scores_equal_those_of_a_plain_model(spark):
    """Probabilities, means and spreads, also of n-grams that back off, of a copied text, other scripts, astral characters, and of documents that the model doesn't know."""
    rng = random.Random(22)
    data = [(i, "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 300))), "x") for i in range(12)]
    data += [(100 + i, "".join(rng.choice("абв на\n") for _ in range(80)), "ru") for i in range(4)] + [(200, "的一是不了 😀😀 的一是", None), (201, "的一是不了 😀 的", None), *ODD]
    data += [(300, data[0][1], "x")]
    new = [(900, "abc zzz Éé", "x"), (901, "abc", "unknown"), (902, "", "x"), (903, None, None)]
    bits = kneser_ney(data)
    docs = frame(spark, data)
    model = quality.train(docs)
    for asked, same in ((data, True), (new, False)):
        want = []
        for d, t, lang in asked:
            padded = "\n" * 3 + (t or "")
            b = [bits(lang, padded[i - 3 : i], padded[i]) for i in range(3, len(padded))]
            want.append((str(d), len(b), sum(b) / len(b) if b else -1, np.std(b) if b else -1))
        got = quality.score(frame(spark, asked), model, ["doc_id"], trained_on_docs=same).collect()
        got = sorted((str(r["row"]["doc_id"]), r["n_scored"], -1 if r["bits"] is None else r["bits"], -1 if r["spread"] is None else r["spread"]) for r in got)
        for g, w in zip(got, sorted(want), strict=True):
            assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], abs=2e-3)


def test_verdicts_follow_the_bands(spark):
    """Quartiles and verdicts by hand, for a written table of scores."""
    rng = random.Random(7)
    rows = [(i, "abc"[i % 3], 100, 0, rng.gauss(3, 0.1), rng.gauss(1, 0.05), 500) for i in range(400)] + [(900, "a", 100, 0, 5.0, 1.0, 500), (901, "b", 100, 0, 3.0, 2.0, 500), (902, "c", 10, 0, 3.0, 1.0, 500), (903, "a", 100, 31, 3.0, 1.0, 500), (904, None, 100, 0, 3.0, 1.0, 9), (905, "b", 100, 0, 1.0, 1.0, 500)]
    scored = spark.createDataFrame([((d, g), *rest) for d, g, *rest in rows], "row struct<doc_id: long, lang: string>, n_words long, n_repeat_words long, bits double, spread double, n_scored long")
    got = {r["row"]["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judge(scored).collect()}
    fair = [r for r in rows if r[2] >= 20 and r[3] <= 30]

    def fits(r, i, char):
        own = sorted(x[i] for x in fair if (x[1] or "") == (r[1] or ""))
        q = [own[math.ceil(p * len(own)) - 1] for p in (0.25, 0.5, 0.75)]
        return abs(r[i] - q[1]) - 4 * math.hypot(max((q[2] - q[0]) / 1.349, quality.LEAST_BITS), char / math.sqrt(r[6]))

    for r in rows:
        edge = max(fits(r, 4, quality.CHAR_BITS), fits(r, 5, quality.SPREAD_BITS)) if r in fair else 1
        assert got[r[0]][0] == (r not in fair)
        assert abs(edge) < 0.02 or got[r[0]][1] == (edge < 0)
    assert not any(got[d][1] for d in (900, 901, 902, 903, 905)) and got[904][1]


def test_characters_are_not_folded(spark):
    """Case, accents and other scripts count: scrambled or shouted text is less likely than the same text as it was."""
    rng = random.Random(21)
    data, odd = [], {}
    for lang, letters in (("ru", "абвгдежзиклмнопр"), ("zh", "的一是不了人我在有他这中大来上国"), ("fr", "abcdeéèêàçfghijkl")):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(80)]
        data += [(len(data) + i, " ".join(rng.choice(words) for _ in range(120)), lang) for i in range(30)]
        text = data[-1][1]
        mixed = list(text)
        rng.shuffle(mixed)
        odd[lang] = text, "".join(mixed), text.upper(), text.translate(str.maketrans("éèêà", "èéàê"))
    train = quality.train(frame(spark, data))
    asked = [(1000 * k + i, t, lang) for k, (lang, texts) in enumerate(odd.items()) for i, t in enumerate(texts)]
    bits = {r["row"]["doc_id"]: r["bits"] for r in quality.score(frame(spark, asked), train).collect()}
    assert bits[1] > bits[0] + 1 and bits[1001] > bits[1000] + 1 and bits[2001] > bits[2000] + 1
    assert bits[2] > bits[0] + 1 and bits[2002] > bits[2000] + 1 and bits[2003] > bits[2000] + 0.3
    more = [(5000 + i, " ".join("".join(rng.choice("абвгдежзиклмнопрст") for _ in range(4)) for _ in range(300)), "ru") for i in range(20)]
    assert quality.train(frame(spark, data + more)).orders[4].count() > 2 * train.orders[4].count()


def test_bands_reject_spam_shouting_and_tables(spark):
    rng = random.Random(23)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    text = lambda: [rng.choice(words) for _ in range(200)]
    clean = [(i, ". ".join(" ".join(x) for x in zip(*[iter(text())] * 8)), "en") for i in range(120)]
    junk = [(500 + i, " ".join(w + rng.choice(["###", "$$$", "&&&", "%%%"]) for w in text()), "en") for i in range(4)]
    junk += [(600 + i, " ".join(w.upper() + "!!" for w in text()), "en") for i in range(4)]
    junk += [(700 + i, " | ".join(text()), "en") for i in range(4)]
    docs = frame(spark, clean + junk)
    scored = quality.score(docs, quality.train(docs), trained_on_docs=True).cache()
    kept = {r["row"]["doc_id"] for r in quality.judge(scored).collect() if r["kept"]}
    assert kept == {d for d, _, _ in clean}


def cut_lines(data, least=line_runs.MIN_WORDS):
    """Line runs by brute force: every run of lines of enough words that occurs earlier."""
    order = sorted({(d, t) for d, t, _ in data if t is not None}, key=lambda x: (x[0] is None, x[0] or 0))
    lines = {x: [(i, s, len(s.split())) for i, raw in enumerate(x[1].split("\n")) if (s := raw.strip(" \t\r\x0b\x0c"))] for x in order}
    seen, gone = {}, {x: set() for x in order}
    for k, x in enumerate(order):
        for a in range(len(lines[x])):
            words, run = 0, []
            for b in range(a, min(len(lines[x]), a + 60)):
                words += lines[x][b][2]
                run.append(lines[x][b][1])
                if words >= least:
                    first = seen.setdefault(tuple(run), (k, a))
                    if first < (k, a):
                        gone[x].update(i for i, _, _ in lines[x][a : b + 1])
    return gone


def test_line_runs(spark):
    rng = random.Random(3)
    line = lambda n: prose(rng, n)
    passage, short = line(60), line(5)
    run = [line(20) for _ in range(4)]
    data = [
        (1, "\n".join([line(10), passage, short]), "a"), (2, "\n".join([short, passage, line(30)]), "a"), (3, "\n".join([line(8), *run, line(9)]), "a"), (4, "\n".join([*run, "", "  ", short]), "a"),
        (5, "\n".join([*run[1:], line(5)]), "a"), (6, "\n".join([run[0], line(3), *run[1:3]]), "a"), (9, "\n".join([passage, passage]), "a"), (10, "\n".join(run + run), "a"), (11, "\n".join(["x y"] * 90), "a"), *ODD,
    ]
    docs = frame(spark, data).withColumns({"_text": F.lit("mine"), "_gone": F.lit(2), "d": F.lit(3), "flags": F.lit(4), "n_lines": F.lit(5)})
    got = line_runs.dedup_lines(docs).collect()
    assert all((r["row"]["_text"], r["row"]["_gone"], r["row"]["d"], r["row"]["flags"], r["row"]["n_lines"], r["row"]["_kept"]) == ("mine", 2, 3, 4, 5, 9) for r in got)
    gone = cut_lines(data)
    assert len(got) == len(data)
    want = [(str(d), "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[(d, t)]) if t is not None else None, len(gone.get((d, t), ()))) for d, t, _ in data]
    assert sorted(((str(r["row"]["doc_id"]), r["text"], r["n_deleted"]) for r in got), key=str) == sorted(want, key=str)
    assert line_runs.dedup_lines(frame(spark, data).limit(0)).count() == 0


@pytest.mark.parametrize("least", [1, 4, 50])
def test_line_runs_of_any_length(spark, least):
    """Against brute force, for lines of a small alphabet, where runs of many lengths overlap; and the maximal runs cover what is deleted."""
    rng = random.Random(least)
    line = lambda: rng.choice(["a b", "c", "d e f", "g " * 20, "h i"])
    data = [(i, "\n".join(line() if rng.random() < 0.9 else f"only {i} {rng.random()}" for _ in range(rng.randint(1, 30))), "en") for i in range(25)]
    gone = cut_lines(data, least)
    got = {r["row"]["doc_id"]: r["n_deleted"] for r in line_runs.dedup_lines(frame(spark, data), least).collect()}
    assert got == {d: len(gone[(d, t)]) for d, t, _ in data}
    texts = {d: t.split("\n") for d, t, _ in data}
    covered = {d: set() for d in texts}
    for r in line_runs.repeated_runs(frame(spark, data), least).collect():
        here, there = texts[r["doc_id"]], texts[r["first_doc_id"]]
        run = here[r["from_line"] : r["to_line"] + 1]
        assert run == there[r["first_line"] : r["first_line"] + len(run)] and len(run) == r["n_lines"]
        assert sum(len(s.split()) for s in run) == r["n_words"] >= least
        covered[r["doc_id"]].update(range(r["from_line"], r["to_line"] + 1))
    assert covered == {d: gone[(d, t)] for d, t, _ in data}


def held_runs(data, rows, least):
    """Each run is a repetition within one document on both sides, as long as can be, in no other run of its document; all of them cover what goes."""
    texts = {d: t.split("\n") for d, t, _ in data}
    worded = {d: [(i, x.strip()) for i, x in enumerate(t) if x.strip()] for d, t in texts.items()}
    spans, covered = {}, {d: set() for d in texts}
    for r in rows:
        here, there = worded[r["doc_id"]], worded[r["first_doc_id"]]
        a = next(k for k, (i, _) in enumerate(here) if i == r["from_line"])
        b = next(k for k, (i, _) in enumerate(there) if i == r["first_line"])
        n = r["n_lines"]
        assert here[a + n - 1][0] == r["to_line"] and (r["first_doc_id"], b) < (r["doc_id"], a)
        assert [x for _, x in here[a : a + n]] == [x for _, x in there[b : b + n]]
        assert a == 0 or b == 0 or here[a - 1][1] != there[b - 1][1]
        assert a + n == len(here) or b + n == len(there) or here[a + n][1] != there[b + n][1]
        assert sum(len(x.split()) for _, x in here[a : a + n]) == r["n_words"] >= least
        spans.setdefault(r["doc_id"], []).append((r["from_line"], r["to_line"]))
        covered[r["doc_id"]].update(i for i, _ in here[a : a + n])
    assert all(not (c <= a and b <= d) for own in spans.values() for k, (a, b) in enumerate(own) for m, (c, d) in enumerate(own) if k != m)
    gone = cut_lines(data, least)
    assert covered == {d: gone[(d, t)] for d, t, _ in data}


def test_runs_stay_within_documents_and_are_maximal(spark):
    data = [(1, "a b\nc d", "en"), (2, "e f\ng h", "en"), (3, "a b\nc d\ne f\ng h", "en"), (4, "a b\nc d\n\ne f\ng h", "en")]
    rows = line_runs.repeated_runs(frame(spark, data), 4).collect()
    held_runs(data, rows, 4)
    got = sorted((r["doc_id"], r["from_line"], r["to_line"], r["first_doc_id"], r["first_line"]) for r in rows)
    assert got == [(3, 0, 1, 1, 0), (3, 2, 3, 2, 0), (4, 0, 4, 3, 0)]
    odd = [(None, "a b\nc d", "en"), (None, "a b\nc d", "en"), (5, "a b\nc d\nx", "en"), (6, None, "en"), (7, "", "en")]
    assert [tuple(r) for r in line_runs.repeated_runs(frame(spark, odd), 4).collect()] == [(None, 0, 1, 2, 4, 5, 0)]
    assert line_runs.repeated_runs(frame(spark, odd).limit(0), 4).count() == 0 and line_runs.repeated_runs(frame(spark, odd), 400).count() == 0


@pytest.mark.parametrize("seed", [5, 6])
def test_runs_of_texts_cut_at_random(spark, seed):
    """Copies of parts of one another, also of a text within itself and of periods, cut into documents at random."""
    rng = random.Random(seed)
    long = [f"line {rng.randint(0, 25)}" for _ in range(120)]
    data = []
    for i in range(14):
        parts = [long[(a := rng.randrange(110)) : a + rng.randint(1, 40)] for _ in range(rng.randint(1, 4))] + [["same same"] * rng.randint(0, 9)]
        rng.shuffle(parts)
        data.append((i, "\n".join(x for p in parts for x in p) or "x", "en"))
    for least in (2, 8, 30):
        held_runs(data, line_runs.repeated_runs(frame(spark, data), least).collect(), least)


def test_line_runs_of_very_long_texts(spark):
    """Two megabytes in 40,000 lines, twice, and half of them once more in another text."""
    rng = random.Random(33)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(400)]
    lines = [" ".join(rng.choices(words, k=8)) for _ in range(40_000)]
    data = [(1, "\n".join(lines), "en"), (2, "\n".join(["first", *lines[10_000:30_000], "last"]), "en"), (3, "\n".join(lines), "en")]
    began = time.monotonic()
    got = {r["row"]["doc_id"]: (r["text"], r["n_deleted"]) for r in line_runs.dedup_lines(frame(spark, data)).collect()}
    assert got == {1: (data[0][1], 0), 2: ("first\nlast", 20_000), 3: ("", 40_000)}
    assert time.monotonic() - began < 60


def classes(data, similarity=weighted_minhash.SIMILARITY):
    """Near classes by comparing all pairs."""
    live = [(d, t) for d, t, _ in data if t is not None]
    bags = []
    for _, t in live:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    df = Counter(k for b in bags for k in b)
    n = len(live)
    idf = {k: float(weighted_minhash.idf(weighted_minhash.code_of(np.array([v])), n)[0]) for k, v in df.items()}
    total = [sum(c * idf[k] for k, c in b.items()) for b in bags]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            both = sum(min(c, bags[j][k]) * idf[k] for k, c in bags[i].items() if k in bags[j])
            if live[i][1] == live[j][1] or (both and both >= (similarity - 1e-9) * (total[i] + total[j] - both)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(live):
        least.setdefault(find(i), []).append(d)
    return sorted((str(d), str(min((x for x in least[find(i)] if x is not None), default=None))) for i, (d, _) in enumerate(live)) + sorted((str(d), str(d)) for d, t, _ in data if t is None)


def near_data():
    rng = random.Random(4)
    data = list(ODD)
    for g in range(12):
        text = prose(rng, rng.randint(40, 120)).split()
        for k in range(rng.randint(1, 9)):
            copy = list(text)
            for _ in range(rng.randint(0, 2 + g // 3)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(1000)}"
            data.append((1000 + 20 * g + k, " ".join(copy), "en"))
    return data


def test_near_classes(spark):
    data = near_data()
    got = weighted_minhash.mark_near(frame(spark, data).withColumn("d", F.lit("mine")).withColumn("kept", F.lit(2)).withColumn("row", F.lit(3))).collect()
    assert sorted((str(r["row"]["doc_id"]), str(r["class_id"])) for r in got) == sorted(classes(data))
    assert all(r["kept"] == (r["class_id"] == r["row"]["doc_id"]) and (r["row"]["d"], r["row"]["kept"], r["row"]["_kept"]) == ("mine", 2, 9) for r in got)


def test_one_row_of_a_class_stays_whatever_its_ids(spark):
    rng = random.Random(24)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    data = [(None, a, "en"), (None, a, "en"), (None, a + " end", "en"), (3, b, "en"), (3, b, "en"), (3, b + " end", "en"), (None, c, "en"), (8, c, "en"), (None, d, "en"), (None, None, "en"), (None, None, "en")]
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    got = corpus_pipeline.near_dedup(spark, frame(spark, data), "").collect()
    assert Counter((r["doc_id"], (r["text"] or "none")[:20]) for r in got) == Counter({(None, a[:20]): 1, (3, b[:20]): 1, (8, c[:20]): 1, (None, d[:20]): 1, (None, "none"): 2})
    marked = weighted_minhash.mark_near(frame(spark, data)).where("row.doc_id IS NULL AND row.text IS NOT NULL AND kept").collect()
    assert Counter(r["row"]["text"][:20] for r in marked) == Counter({a[:20]: 1, d[:20]: 1})


def test_near_classes_in_parts(spark, monkeypatch):
    """Buckets, blocks, pivots and hash ranges of a few give what large ones do."""
    for name, v in (("SUB_BUCKET", 2), ("BLOCK_SHINGLES", 300), ("PIVOT_SHINGLES", 250), ("BLOCK_ROWS", 3), ("PIVOT_ROWS", 2), ("RANGE_SHINGLES", 1 << 10), ("BATCH_BYTES", 2000)):
        monkeypatch.setattr(weighted_minhash, name, v)
    data = near_data()
    got = weighted_minhash.mark_near(frame(spark, data)).collect()
    assert sorted((str(r["row"]["doc_id"]), str(r["class_id"])) for r in got) == sorted(classes(data))


def test_near_classes_of_nothing(spark):
    assert weighted_minhash.mark_near(frame(spark, ODD).limit(0)).count() == 0


def test_samples_agree_as_similarity_says():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 60, 500).astype(np.uint64)
    b = np.concatenate([a[:400], rng.integers(0, 1 << 60, 100).astype(np.uint64)])
    w = np.ones(500)
    sampler = weighted_minhash.Sampler()
    agree = []
    for salt in range(40):
        s = sampler.draw(np.concatenate([a, b]) ^ np.uint64(salt * 7919), np.concatenate([w, w]), np.array([0, 500, 1000]))
        agree.append((s[0] == s[1]).mean())
    assert np.mean(agree) == pytest.approx(400 / 600, abs=0.03)


def test_packed_keys():
    keys = np.unique(np.random.default_rng(6).integers(0, 1 << 46, 1000).astype(np.uint64))
    assert (weighted_minhash.unpack_keys(weighted_minhash.pack_keys(keys), len(keys)) == keys).all()


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (7, 8)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(random.Random(i).randrange(60), random.Random(-i - 1).randrange(60)) for i in range(50)]])
def test_components(spark, edges):
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["v"]: r["root"] for r in got.collect()} == {v: find(v) for v in root if find(v) != v}


@pytest.mark.parametrize("n", [0, 1, 37, 500])
def test_sharding(spark, n):
    rng = random.Random(n)
    data = [(i, f"text {rng.randrange(80)}" if rng.random() < 0.5 else f"alone {i}", "x") for i in range(n)]
    data = data + ODD if n == 500 else data
    got = sharding.shard_documents(frame(spark, data), 8).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _, _ in data)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values(), default=0) - min((sizes.get(s, 0) for s in range(8)), default=0) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    if n == 500:
        shard = {r["doc_id"]: r["shard"] for r in got}
        groups = {}
        for d, t, _ in data:
            if d is not None and t is not None:
                groups.setdefault(t, []).append(shard[d])
        assert sum(len(g) - max(Counter(g).values()) for g in groups.values()) <= 3  # of 250 linked documents hardly any is apart from its group
        again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(frame(spark, data[::-1]).repartition(3), 8).collect()}
        alone = [d for d, t, _ in data if d is not None and sum(t == u for _, u, _ in data) == 1 and sum(d == e for e, _, _ in data) == 1]
        assert all(again[d] == next((r["shard"], r["slot"]) for r in got if r["doc_id"] == d) for d in alone)  # however the table is cut


def test_quotas_respect_capacity():
    wanted = np.array([[0, 5, 1], [2, 0, 0], [9, 0, 0]])
    go = sharding.quotas(wanted, np.array([10.0, 10, 10]), 12)
    assert (go <= wanted).all()
    assert (np.array([10, 10, 10]) + go.sum(axis=0) - go.sum(axis=1) <= 12 + 1e-9).all()


def test_pipeline_on_odd_rows(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tidemark.llm.common import materialize

    rng = random.Random(9)
    clean = [(100 + i, "\n".join(prose(rng, 60) for _ in range(2)), "en") for i in range(30)]
    docs = frame(spark, ODD + clean + [(200, clean[0][1], "en")]).withColumns({"n_chars": F.char_length("text").cast("long"), "_text": F.lit(1), "_row": F.lit(2), "bits": F.lit(None).cast("string")})
    names = docs.columns
    for where, n in (("true", 30), ("false", 0)):
        now = docs.where(where)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = materialize(stage(spark, now, ""), name.replace(" ", "-"))
            assert now.columns == names
        assert {d for d, _, _ in clean if n} <= {r["doc_id"] for r in now.collect()}
        assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() >= n


def test_pipeline_may_run_twice(spark, tmp_path):
    """The first run's result can still be read after a second run, and both are equal."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(10)
    data = ODD + [(100 + i, "\n".join(prose(rng, 60) for _ in range(2)), "en") for i in range(20)]
    frame(spark, data).withColumn("n_chars", F.char_length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    first = corpus_pipeline.run(spark, str(tmp_path))
    second = corpus_pipeline.run(spark, str(tmp_path))
    rows = lambda df: sorted((str(r["doc_id"]), r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert rows(first) == rows(second) and len(rows(first)) >= 20
