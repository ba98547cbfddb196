"""Results of learned operators worked out a second way, plainly; and texts of ten million characters."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from tests.conftest import SMALL
from tidemark.llm import decontam, langid, license_scan, packing, periodic, quality, simhash, toxicity


@pytest.fixture(scope="module")
def small(spark):
    return {n: spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "benchmark", "labels")}


@pytest.fixture(scope="module")
def texts(small):
    return {r["doc_id"]: r["text"] for r in small["documents"].select("doc_id", "text").collect()}


def test_severity_is_the_expected_grade(spark, small, texts):
    """From the fitted weights: a feature counts once however many words have it, and severity sums the chances of each grade."""
    model = toxicity.fit_severity(small["documents"], small["labels"])
    levels = len(model.thresholds)
    assert all(np.diff(model.thresholds) > 0)
    toxic = 0
    for r in toxicity.grade_toxicity(small["documents"], small["labels"]).collect():
        words = {w.decode() for w in decontam.plain_words(texts[r["doc_id"]])}
        own = {f for w in words for n in [len(w)] for f in [w, *("^" + w[:k] for k in range(3, 7) if k < n), *(w[-k:] + "$" for k in (3, 4) if k < n)]}
        x = math.fsum(model.weights[model.words[f]] for f in own if f in model.words)
        above = [1.0, *(1 / (1 + math.exp(min(60, max(-60, t - x)))) for t in model.thresholds), 0.0]
        chances = [above[k] - above[k + 1] for k in range(levels + 1)]
        assert abs(r["severity"] - sum(k * p for k, p in enumerate(chances))) < 1e-9
        assert abs(chances[r["grade"]] - max(chances)) < 1e-9 and abs(r["p_toxic"] - above[1]) < 1e-9 and r["toxic"] == (r["p_toxic"] >= 0.35)
        toxic += r["toxic"]
    assert 0 < toxic < len(texts) / 2


def test_language_by_plain_forward_backward(spark, small, texts):
    model = langid.fit_crf(langid.training_stretches(small["documents"]))
    got = {r["doc_id"]: r for r in langid.identify_languages(small["documents"], model).collect()}
    for doc, text in texts.items():
        words = langid.words_of(text)[:400]
        if len(langid.words_of(text)) > 400:
            continue  # long chains are held against exact ones elsewhere
        if not words:
            assert got[doc]["lang_pred"] == langid.UNKNOWN
            continue
        n = len(model.langs)
        scores = [[math.fsum(model.weights[model.index[f], k] for f in langid.features(w) if f in model.index) for k in range(n)] for w in words]

        def logs(values):
            top = max(values)
            return top + math.log(sum(math.exp(v - top) for v in values))

        a, b = [scores[0]], [[0.0] * n]
        for s in scores[1:]:
            a.append([s[k] + logs([a[-1][j] + model.transitions[j, k] for j in range(n)]) for k in range(n)])
        for s in scores[:0:-1]:
            b.append([logs([model.transitions[k, j] + s[j] + b[-1][j] for j in range(n)]) for k in range(n)])
        whole = logs(a[-1])
        mean = [sum(math.exp(x[k] + y[k] - whole) for x, y in zip(a, b[::-1], strict=True)) / len(words) for k in range(n)]
        assert got[doc]["lang_pred"] == model.langs[int(np.argmax(mean))] and abs(got[doc]["score"] - max(mean)) < 1e-4


def test_kept_by_walking_every_tree(spark, small, texts):
    model = quality.fit_quality(small["documents"], small["labels"])
    kept = 0
    for r in quality.quality_rules(small["documents"], small["labels"]).collect():
        counts, x = quality.statistics(texts[r["doc_id"]])
        total = model.bias
        for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        good = 1 / (1 + math.exp(-total))
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert abs(r["score"] - good) < 1e-9 and r["base_failed"] == failed and r["kept"] == (not failed and good >= 0.5)
        kept += r["kept"]
    assert 0 < kept < len(texts)


def test_packing_by_adding_up_all_squares(spark, small):
    """Each group again, with the sum of squares of every choice added up in full."""
    capacity = 64
    rows = packing.pack_documents(small["documents"].limit(60), capacity, group_pieces=150).collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["sequence_id"] >> 32].append(r)
    assert len(groups) > 2
    for group in groups.values():
        group.sort(key=lambda r: (-r["length"], r["doc_id"], r["piece"], r["start"], r["ids_crc32"]))
        gaps, inside, place = [], [], {}  # of each open sequence its gap; by gap the order in which sequences came to it
        for r in group:
            s, choices = r["length"], {}
            for gap in {g for g in gaps if g >= s}:
                after = collections.Counter(g for g in gaps if 0 < g)
                after[gap] -= 1
                if gap > s:
                    after[gap - s] += 1
                choices[gap] = sum(n * n for g, n in after.items() if g < capacity)
            if choices:
                gap = min(choices, key=lambda g: (choices[g], g))
                k = max((i for i, g in enumerate(gaps) if g == gap), key=lambda i: inside[i])
            else:
                gap, k = capacity, len(gaps)
                gaps.append(capacity)
                inside.append(0)
            place[id(r)] = k, capacity - gap
            gaps[k] = gap - s
            inside[k] = len(place)
        assert [(r["sequence_id"] & 0xFFFFFFFF, r["offset"]) for r in group] == [place[id(r)] for r in group]


def test_a_document_without_id_is_not_held_out(spark):
    docs = spark.createDataFrame([(None, "some words", "en"), (3, "some words", "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["held_out"] for r in langid.identify_languages(docs).collect()} == {None: False, 3: zlib.crc32(b"3") % 4 == 2}


def test_short_templates_are_an_error(spark):
    docs = spark.createDataFrame([(0, "some words")], "doc_id long, text string")
    with pytest.raises(ValueError, match="fewer than 5 words: tiny"):
        license_scan.scan_licenses(docs, license_scan.TEMPLATES | {"tiny": "all rights reserved"})


@pytest.fixture(scope="module")
def huge(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    text = " ".join(rng.choices(words, k=1_600_000)) + " and the stolen words of one known passage stand here at the very end of it"
    assert len(text) > 10_000_000
    return spark.createDataFrame([(0, text), (1, "a short text of a few words"), (2, text)], "doc_id long, text string").repartition(2)


LONG = {
    "decontamination": lambda s, d: decontam.find_leaks(d, s.createDataFrame([(5, "the stolen words of one known passage stand here at the very end")], "item_id long, text string")),
    "toxicity": lambda s, d: toxicity.grade_toxicity(d, s.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "quality": lambda s, d: quality.quality_rules(d, s.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")),
    "runs": lambda s, d: periodic.run_digest(periodic.periodic_runs(d)),
}


@pytest.mark.parametrize("name", LONG)
def test_ten_million_characters(spark, huge, name):
    got = {r["doc_id"]: r for r in LONG[name](spark, huge).collect()}
    if name == "decontamination":
        assert set(got) == {0, 2} and got[0]["passage_share"] == 1.0 and got[0]["from_word"] > 1_500_000
        return
    assert set(got) == {0, 1, 2} and got[0].asDict() | {"doc_id": 2} == got[2].asDict()
    if name == "simhash":
        assert [got[k]["component_id"] for k in range(3)] == [0, 1, 0]
    if name == "quality":
        assert got[0]["n_words"] == 1_600_016
