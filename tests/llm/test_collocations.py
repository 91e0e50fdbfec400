import random
import re
from collections import Counter

from mintweave.llm import collocations as X

SCHEMA = "doc_id long, text string, lang string, n long, phrase string"


def plain(rows, least, longest, percent, first):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i:i + k])] += 1
    good = {p: n for p, n in counts.items() if len(p[1]) > 1 and n >= least}
    hidden = set()
    for (lang, p), n in good.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p) and 100 * n >= percent * counts[lang, p[i:j]]:
                    hidden.add((lang, p[i:j]))
    out = []
    for (lang, p), a in good.items():
        if (lang, p) in hidden:
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), left, right, total[lang]))
    out.sort()
    ranks, rows = Counter(), []
    for lang, score, a, p, left, right, n in out:
        ranks[lang] += 1
        if ranks[lang] <= first:
            rows.append((lang, ranks[lang], p.decode(), -a, left, right, n, -score))
    return rows


def got(frame):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


def made(seed=3, docs=80):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "Île", "ａ", "x\x00y", "in", "a-b", "#1"]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append("the city of new york" if rng.random() < 0.15 else words[min(int(rng.expovariate(0.5)), 10)])
            parts.append(rng.choice([" ", " ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", "; "]))
        rows.append((i % 70, "".join(parts), rng.choice(["en", "de", None, "und", "en"])))
    return rows + [(None, None, None), (1, "", "en"), (2, "same same " * 900, "de"), (2, "same same " * 900, "de"), (3, "z" * 20000, "fr")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "clash") for r in rows], SCHEMA)


def test_equals_brute_force_whatever_the_sample(spark):
    rows = made()
    texts = [(t, g) for _, t, g in rows]
    docs = frame(spark, rows)
    for sample, percent, first in ((0.3, 100, 10**6), (0.0, 100, 10**6), (1.0, 60, 4)):
        want = plain(texts, 6, 5, percent, first)
        assert got(X.collocations(docs, 6, 5, percent, first, sample)) == sorted(want) and want


def test_a_full_filter_changes_nothing(spark):
    rows = made(9, 40)
    docs = frame(spark, rows)
    assert got(X.collocations(docs, 4, 3, 100, None, 0.3, filter_blocks=1)) == sorted(plain([(t, g) for _, t, g in rows], 4, 3, 100, 10**9))


def test_products_over_64_bits_are_exact(spark):
    big = 3 * 10**12 + 1
    phrases = spark.createDataFrame([(1, "en", 2, "a b", big, big * 7, [2], [3])], "key long, lang string, size int, phrase string, a long, n long, heads array<long>, tails array<long>")
    found = spark.createDataFrame([(2, big + 5), (3, big + 9)], "key long, n long")
    assert X.scored(phrases, found).first().score == 1000 * big * big * 7 // ((big + 5) * (big + 9))


def test_empty_tables_and_rare_phrases(spark):
    assert got(X.collocations(frame(spark, []))) == []
    assert got(X.collocations(frame(spark, [(1, None, "en"), (2, "", None), (3, "a b c", "en")]))) == []
