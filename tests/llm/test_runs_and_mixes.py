"""Periodic runs, alignment of tokenizers and source mixes against brute force, by hand and on the given table."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tidemark.llm import alignment, class_lm, decontam, mixing, periodic, registry


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Periodic runs


def stretches(w, periods, least):
    """All maximal stretches with a smallest period, by comparing every word with that ``q`` before it."""
    found = []
    for q in range(1, len(w) // periods + 1):
        same = [w[i] == w[i + q] for i in range(len(w) - q)]
        at = 0
        for equal, group in itertools.groupby(same):
            n = len(list(group))
            s, length = at, n + q
            if equal and length >= max(least, periods * q) and all(any(w[k] != w[k + r] for k in range(s, s + length - r)) for r in range(1, q)):
                found.append((s, length, q))
            at += n
    return sorted(found, key=lambda run: (run[0], run[2]))


def made(rng, letters):
    w = []
    for _ in range(rng.randint(0, 8)):
        w += [rng.choice(letters) for _ in range(rng.randint(1, 10))] * rng.choice([1, 1, 2, 4, 7])
        if rng.random() < 0.3:
            w += w[-rng.randint(1, 9) :][:3]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        texts = [made(rng, "abcdef"[: rng.randint(1, 6)]) for _ in range(rng.randint(1, 5))]
        assert periodic.runs_of(texts) == [stretches(w, 4, 6) for w in texts]
    for _ in range(300):
        w = [rng.randint(0, rng.randint(0, 3)) for _ in range(rng.randint(0, 60))]
        found = sorted(((s, e - s + 1, q) for (s, q), e in periodic.squares(w).items()), key=lambda run: (run[0], run[2]))
        assert found == stretches(w, 2, 2)
        assert periodic.runs_of([list(map(str, w))], 3, 2) == [stretches(w, 3, 2)]


def test_accesses_report_last_ends():
    """Each access names the segments of equal last ends on the path, against a table of all nodes' ends."""
    rng = random.Random(2)
    w = [rng.randint(0, 2) for _ in range(200)]
    automaton = periodic.Automaton(w)
    ends, last = periodic.LastEnds(automaton.link), {}
    for at, state in enumerate(automaton.prefix):
        path = [state]
        while automaton.link[path[-1]] >= 0:
            path.append(automaton.link[path[-1]])
        expected = [(next(group), end) for end, group in itertools.groupby(path, key=lambda s: last.get(s, -1)) if end >= 0]
        assert ends.access(state, at) == expected
        last.update(dict.fromkeys(path, at))


def test_long_texts_of_one_period():
    assert periodic.runs_of([["a"] * 100_000, ["a", "b"] * 40_000]) == [[(0, 100_000, 1)], [(0, 80_000, 2)]]
    phrase = [str(k) for k in range(3000)]
    assert periodic.runs_of([["x", *phrase * 5, "y"]]) == [[(1, 15_000, 3000)]]
    assert periodic.collapsed(["x", *["a", "b"] * 4, "y"], [(1, 8, 2)]) == "x a b y"


def test_query_of_runs(spark):
    got = {r[0]: tuple(r) for r in registry.queries()["op11_periodic_runs"](spark, SMALL).collect()}
    for doc, text in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        w, h = words(text), zlib.crc32(str(doc).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = stretches(w, 4, 6) if len(w) < 1500 else periodic.runs_of([w])[0]
        best = min(runs, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2])) if runs else None
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        digests = ["".join(f"{s},{length},{q}\n" for s, length, q in runs), " ".join(x for k, x in enumerate(w) if k not in gone)]
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert got.pop(doc) == (doc, len(runs), *shown, *(hashlib.sha256(d.encode()).hexdigest() for d in digests))
    assert not got


# Alignment


def aligned(texts):
    """The rows of ``alignment`` by the libraries' own encoders and comparisons of all tokens of a group."""
    use = alignment.tokenizers()
    first, second = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    first.encode_special_tokens = True

    def spans(ids, table):
        ends = list(itertools.accumulate(len(table[i]) for i in ids))
        return list(zip([0, *ends], ends, ids))  # noqa: B905

    pairs, docs = collections.Counter(), []
    for text in texts:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        if any(b"".join(table[i] for i in ids) != (" " + (text or "")).encode() for ids, table in ((a, use.a_bytes), (b, use.b_bytes))):
            a = b = []
        a, b = spans(a, use.a_bytes), spans(b, use.b_bytes)
        common = sorted({x[1] for x in a} & {x[1] for x in b})
        groups = [[[x for x in side if low < x[1] <= high] for side in (a, b)] for low, high in zip([0, *common], common)]  # noqa: B905
        links = [(x[2], y[2]) for p, q in groups for x in p for y in q if x[0] < y[1] and y[0] < x[1]]
        pairs.update(links)
        docs.append((a, b, groups, links))
    best = collections.Counter()
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    for k, (a, b, groups, links) in enumerate(docs):
        text = ";".join("|".join(",".join(str(x[2]) for x in side) for side in group) for group in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        yield k, len(a), len(b), len(groups), len(links), sum(pairs[x] == best[x[1]] for x in links), sum(pairs[x] for x in links), digest


PLAIN = [None, "", " ", "\n\n", "x", "a b", "  a  b ", "<|endoftext|> a<|endoftext|>", "<s> é ½ Ⅷ 日本語のテキスト   \x85\x1c\x00", "a▁b c", "A" * 500, "ab " * 300, "'s don't we'll 123 4567", "\U0001f600 x\U0001f600", " " * 12_000 + "x", "日本語" * 200]


@pytest.fixture(scope="module")
def mixed_texts():
    rng = random.Random(3)
    short = ["".join(rng.choice("ab ▁é'\n日1") for _ in range(rng.randint(1, 60))) for _ in range(30)]
    long = ["".join(rng.choice("abé'日1 \U0001f600") for _ in range(rng.randint(100, 500))) for _ in range(20)]
    texts = PLAIN + short + long
    return texts, list(aligned(texts))


@pytest.mark.parametrize(("chunk", "part", "table"), [(1 << 15, 1 << 18, 1 << 22), (7, 50, 1 << 22), (40, 200, 64)])
def test_alignment_equals_brute_force(spark, mixed_texts, chunk, part, table):
    texts, expected = mixed_texts
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, alignment.alignment(docs, chunk, part, table).collect())) == expected


def test_query_of_alignment(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in registry.queries()["op12_token_alignment"](spark, SMALL).collect()}
    assert got == {doc: row[1:] for (doc, _), row in zip(docs, aligned([text for _, text in docs]), strict=True)}


def test_fragments_compose_in_any_order():
    """However neighbours are composed, the open ends and the closed groups are the same."""
    use, rng = alignment.tokenizers(), random.Random(4)
    text = "".join(rng.choice("abé'日1 ") for _ in range(400))
    a, b, _ = next(alignment.encoded([text], use))
    leaves = [alignment.fragment_of(int(at), x, y, int(i), int(j), use) for at, x, y, i, j in alignment.chunked(a, b, 0, use, 5)]
    middles = [(2 * f.p_at + 1, *m) for f, m in leaves if m[0]]
    results = set()
    for seed in range(20):
        order, row, closed = random.Random(seed), [f for f, _ in leaves], list(middles)
        while len(row) > 1:
            k = order.randrange(len(row) - 1)
            whole, seam = row[k].then(row[k + 1])
            row[k : k + 2] = [whole]
            closed += [(2 * seam[0], *seam[1:])] if seam else []
        results.add((row[0], tuple(sorted(closed))))
    assert len(results) == 1
    whole, closed = results.pop()
    assert whole.pa + b"".join(x for _, x, _ in closed) == a.tobytes() and not whole.sa and not whole.sb


def test_alignment_of_very_long_texts(spark):
    """A text of many parts and fragments, and one without a place to part it, equal their alignment in one piece."""
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 9))) for _ in range(60_000)), "ab1日" * 50_000, "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = sorted(alignment.alignment(docs, 1 << 30, 1 << 30).collect())
    assert sorted(alignment.alignment(docs).collect()) == one == sorted(alignment.alignment(docs, table=100).collect())


# Source mixes


def test_query_of_the_mix(spark, duck):
    got = registry.queries()["op13_source_mix"](spark, SMALL)
    expected = duck.sql(mixing.oracle_sql())
    assert got.columns == expected.columns and sorted(map(tuple, got.collect())) == sorted(expected.fetchall())


def filled(sizes, weights, share, cap):
    """Targets by sharing what is over again and again, in fractions."""
    targets = {}
    left, open_ = Fraction(*share) * sum(sizes), dict(zip(range(len(sizes)), weights))  # noqa: B905
    while True:
        part = {k: left * w / sum(open_.values()) for k, w in open_.items()}
        over = [k for k, t in part.items() if t >= cap * sizes[k]]
        if not over:
            return targets | part
        for k in over:
            targets[k] = Fraction(cap * sizes[k])
            left -= targets[k]
            del open_[k]


@pytest.mark.parametrize("sizes", [[5, 100, 7, 0, 900], [10, 10], [1], [0, 0], [400, 1, 1, 1, 1, 1, 1, 300, 2], list(range(1, 60))])
def test_budgets_fill_up(spark, sizes):
    rows = [(f"s{k:03}", n) for k, n in enumerate(sizes)]
    got = sorted(mixing.source_budgets(spark.createDataFrame(rows, "source string, source_size long")).collect())
    weights = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
    expected = filled(sizes, weights, (3, 2), 2) if sum(sizes) else dict.fromkeys(range(len(sizes)), 0)
    assert [r["weight"] for r in got] == weights
    assert [r["target"] for r in got] == [float(expected[k]) for k in range(len(sizes))]
    assert [r["budget"] for r in got] == [int(expected[k]) for k in range(len(sizes))]
    assert [r["words_before"] for r in got] == list(itertools.accumulate([0, *sizes]))[:-1]


def test_mix_is_exact_and_rerun(spark):
    rows = [(k % 50 if k % 3 else None, None if k % 11 == 0 else "w " * (k % 13), None if k % 5 == 0 else "abé"[k % 3] * (1 + k % 2)) for k in range(300)]
    rows += [(5, " a\tb c ", "hot")] * 400 + [(9, "", "none")] * 3 + [(1, None, "nil")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_documents(docs, keep=("text", "source")).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, mixing.mix_documents(docs.repartition(7).select("source", "text", "doc_id"), keep=("text", "source")).collect()))
    taken, targets = collections.Counter(), {}
    for r in mixed:
        assert r["size"] == len(words(r["text"])) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
    assert all(taken[s] == int(t) for s, t in targets.items()) and len(mixed) == len(rows)
    frame = spark.createDataFrame(mixed, "doc_id long, size long, source_size long, target double, taken long, text string, source string")
    texts = mixing.copies(frame)
    assert texts.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(r["taken"] for r in mixed)


def test_words_are_counted_as_the_contract_splits(spark):
    texts = [None, "", " \t\n\x0b\x0c\r", "a", " a b", "a\x0bb\x85c\xa0d  ", "\n\n x \n", "é " * 40_000]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.n_words(F.col("text"))).collect()
    assert [r[0] for r in got] == [len(words(t)) for t in texts]


def test_native_plan_has_no_python(spark):
    plan = registry.queries()["op13_source_mix"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_names_of_ids():
    assert [bytes(row[row != 0]) for row in alignment.names()[[0, 7, 50_256]]] == [b"0", b"7", b"50256"] and np.count_nonzero(alignment.names()[7]) == 1


# Candidates of decontamination


def built(spark, texts, items):
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    index = decontam.build_index(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    return index, decontam.Windows.of(*decontam.term_places(texts, index.items.terms))


@pytest.mark.parametrize("kind", ["short", "stem"])
def test_alike_and_short_items_give_no_product(spark, kind):
    """Prose against thousands of short items of its commonest words, or of items that share three quarters of their words."""
    rng = random.Random(21)
    prose_words = [f"w{k}" for k in range(3000)]
    weights = [1 / (k + 2) for k in range(3000)]
    texts = [" ".join(rng.choices(prose_words, weights, k=400)) for _ in range(40)]
    if kind == "short":
        items = [" ".join(rng.choices(prose_words[:200], k=6)) for _ in range(2000)]
    else:
        stem = " ".join(rng.choices(prose_words, weights, k=30))
        items = [stem + " " + " ".join(f"i{k}x{j}" for j in range(10)) for k in range(2000)]
    texts += [f"{texts[0]} {items[5]} {texts[1]}", f"{texts[2]} {items[7]}"]
    index, own = built(spark, texts, items)
    windows = len(own.text)
    pairs = [len(decontam.verbatim_pairs(own, index)[0]), len(list(decontam.short_pairs(own, index)))]
    accepted = {(t, index.items.ids[item]) for t, found in decontam.leaks_of(texts, index) for item in found}
    assert {(40, 5), (41, 7)} <= accepted
    # The windows around the one text with the stem meet all 2,000 items that share it, and each is checked; no other window does.
    assert sum(pairs) <= (200 if kind == "short" else 0.02 * windows * len(items))


def test_paraphrases_come_through_the_latent_space(spark):
    """With the SVD taken out they are lost, and verbatim text is still found."""
    rng = random.Random(22)
    vocabulary = [f"w{k}" for k in range(2000)]
    items = [" ".join(rng.choices(vocabulary, k=32)) + ". " + " ".join(rng.choices(vocabulary, k=8)) + "." for _ in range(60)]
    texts = []
    for item in items:
        own = item.split()
        for k in rng.sample(range(40), 12):
            own[k] = rng.choice(vocabulary)
        texts.append(" ".join(rng.choices(vocabulary, k=50) + own + rng.choices(vocabulary, k=50)))
    verbatim = [" ".join(rng.choices(vocabulary, k=50)) + " " + item for item in items]
    index, _ = built(spark, texts + verbatim, items)
    found = [{t for t, own in decontam.leaks_of(some, index) if t in {index.items.ids[k] for k in own}} for some in (texts, verbatim)]
    assert len(found[0]) >= 54 and len(found[1]) == 60
    index = index._replace(folding=0 * index.folding)
    found = [{t for t, own in decontam.leaks_of(some, index) if t in {index.items.ids[k] for k in own}} for some in (texts, verbatim)]
    assert len(found[0]) <= 3 and len(found[1]) == 60


def test_cells_keep_what_is_near(spark):
    """Of all pairs with the least cosine, and of those the checks accept, the cells give nearly all."""
    docs = [r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    rng = random.Random(23)
    items = [" ".join(rng.choice(docs).split()[:40]) for _ in range(300)]
    index, own = built(spark, docs, items)
    vectors = decontam.latent_vectors(own, index)
    every = set(zip(*(x.tolist() for x in np.nonzero(vectors @ index.vectors.T >= decontam.COSINE)), strict=True))
    got = set(zip(*(x.tolist() for x in decontam.latent_pairs(vectors, index)), strict=True))
    assert got <= every
    near = {(w, p) for w, p in every if vectors[w] @ index.vectors[p] >= 0.6}
    print("recall of cells", len(got) / len(every), len(got & near) / len(near))
    assert len(got & near) >= 0.9 * len(near)


def test_texts_of_one_item_are_one_row(spark):
    docs = spark.createDataFrame([(0, "alpha beta gamma delta epsilon zeta eta theta iota kappa and one two three four five six seven eight nine")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (1, "one two three four five six seven eight nine"), (2, "seven eight nine")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()) == [(0, 1), (0, 2)]


# The class model's words that only held-out texts have


def test_words_of_held_out_texts_only(spark, monkeypatch):
    """One word 300,000 times in a text, and one in a third of all texts, both never in training; by broadcast and by join the same."""
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 7 == 2]
    texts = [("one two three four five " * 3 + ("wandering " if k in ids else "") + ("again " * 300_000 if k == ids[0] else "")) for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(class_lm.score_documents(docs).collect())
    train = sum(len(words(texts[k])) + 1 for k in range(400) if k not in ids)
    v = 6  # five words and the end
    for k in ids[:2]:
        r = rows[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words(texts[k])) + 1, 16, train)
        n = (400 - len(ids)) * 3
        base = 15 * math.log10((n + 1) / (train + v + 1)) + math.log10((400 - len(ids) + 1) / (train + v + 1)) - (r["n_tokens"] - 16) * math.log10(train + v + 1)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base)
    tail = spark.createDataFrame([(k, b"hot", 2) for k in range(50)] + [(k, b"w%d" % k, 1) for k in range(20)], "row long, word binary, k long")
    counts = spark.createDataFrame([(b"w3", 5), (b"hot", 7), (b"w4", 1)], "word binary, n long")
    expected = sorted(map(str, tail.join(counts, "word", "left").select("row", "k", "n").collect()))
    for heavy in (1, 3, 1000):
        assert sorted(map(str, class_lm.counted_misses(tail, counts, heavy).collect())) == expected
