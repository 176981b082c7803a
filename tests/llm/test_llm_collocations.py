import random
import re
from collections import Counter

import pytest
from compare import connect, differences
from edge import edge_documents, no_documents

from tracerisk.llm import catalog, collocations
from tracerisk.llm.oracle import ORACLE_SQL

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, longest=5, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    often = {p: f for p, f in counts.items() if f >= least}
    rows = []
    for (lang, words), a in often.items():
        k = len(words)
        inside = any(
            o == lang and len(w) > k and f >= a and any(w[i : i + k] == words for i in range(len(w) - k + 1))
            for (o, w), f in often.items()
        )
        if k == 1 or inside:
            continue
        cuts = []
        for j in range(1, k):
            left, right = often[lang, words[:j]], often[lang, words[j:]]
            cuts.append((1000 * a * totals[lang] // (left * right), j, left, right))
        score, _, left, right = min(cuts)
        rows.append((lang, -score, -a, " ".join(words).encode(), left, right, totals[lang]))
    out, place = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(rows):
        place[lang] += 1
        if place[lang] <= top:
            out.append((lang, place[lang], phrase.decode(), -a, left, right, n, -score))
    return out


def invented(draw, rows):
    vocabulary = ["the", "of", "New", "York", "city", "é", "state x", "a_b", "\U0001f642", "and", "IN"]
    ends = [" ", " ", "  ", "\t", " ", ". ", ", ", "\n", "\x0b", "? ", "\r\n", " "]
    for _ in range(rows):
        words = draw.choices(vocabulary, k=draw.randrange(0, 60))
        text = "".join(w + draw.choice(ends) for w in words)
        if draw.random() < 0.5:
            text += "new york city in the state x"
        yield text, draw.choice(["en", "en", "de", None])


@pytest.mark.parametrize("sent", [1000, 0])
def test_same_as_brute_force(spark, sent):
    docs = list(invented(random.Random(sent), 200))
    frame = spark.createDataFrame(docs, "text string, lang string").repartition(5)
    got = collocations.collocations(frame, least=6, top=40, sent_words=sent, sent_pairs=sent).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(docs, 6, top=40))
    assert len(got) > 60


def test_small_counters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "COUNTED", 10)
    docs = list(invented(random.Random(9), 60))
    got = collocations.collocations(spark.createDataFrame(docs, "text string, lang string"), least=4)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(docs, 4))


def test_query_same_as_sql(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    found = differences(catalog.op12_collocations(spark, folder), connect(folder), ORACLE_SQL["op12_collocations"])
    assert found == []


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**9
    row = spark.createDataFrame([(big, big * 7, [big, big], [big, big])], "f long, n long, heads array<long>, tails array<long>")
    cut = row.select(collocations._cut(2).alias("c")).first()["c"]
    assert cut["score"] == 1000 * big * big * 7 // (big * big)


def test_edges(spark):
    docs = edge_documents(spark)
    got = collocations.collocations(docs, least=2).collect()
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert sorted(tuple(r) for r in got) == sorted(brute(rows, 2))
    assert collocations.collocations(no_documents(spark)).collect() == []
    assert collocations.collocations(docs, least=10**9).collect() == []
