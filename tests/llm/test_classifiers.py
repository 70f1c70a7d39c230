import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from seqloom.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out_accuracy(scored, labels, label, folds, fold, cut=0.5):
    rows = scored.join(labels, "doc_id").where(toxicity.fold_of(F.col("doc_id"), folds) == fold).select(label, "score").collect()
    assert rows
    return np.mean([(r.score >= cut) == (r[label] == 1) for r in rows]), rows


def test_quality_held_out(tables):
    docs, labels = tables
    model = quality.fit(docs.select("doc_id", "text"), labels)
    accuracy, rows = held_out_accuracy(quality.score(docs, model), labels, "quality", 3, 1)
    assert accuracy >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_held_out(tables):
    docs, labels = tables
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    accuracy, rows = held_out_accuracy(toxicity.score(docs, model), labels, "toxic", 5, 0)
    assert accuracy >= 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_expressions_in_a_long_text_are_found(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ten", "sur", "a"]) for _ in range(3))
    rude = lambda: "zoqq" + rng.choice(["a", "el", "ing", "ur", "ox"])
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [word() for _ in range(rng.choice([40, 2000]))]
        for _ in range(4 * toxic):
            words[rng.randrange(len(words))] = rude()
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    df, lab = spark.createDataFrame(docs, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(df, lab)
    got = {r.doc_id: r.p for r in toxicity.score(df, model, "p").collect()}
    wrong = [i for i, t in labels if (got[i] >= 0.5) != bool(t)]
    assert len(wrong) <= 4


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edges(spark, module):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, " \n", 3), (4, "a" * 100_000, 3), (4, "a" * 100_000, 3)], "doc_id bigint, text string, label int")
    labels = spark.createDataFrame([(1, 1, 1), (1, None, None), (99, 0, 0), (4, 1, 1)], "doc_id bigint, quality int, toxic int")
    for d in (docs, docs.where("false")):
        for lab in (labels, labels.where("false")):
            scored = module.score(d, module.fit(d, lab), "p")
            assert scored.columns == [*d.columns, "p"]
            assert all(0 <= r.p <= 1 for r in scored.collect())


def kneser_ney(texts, d=0.95, order=6):
    """Ratios by gram and by context, from dictionaries over all grams of (text, label)."""
    counts = defaultdict(lambda: [0, 0])
    for text, label in texts:
        for w in set(text.lower().split()):
            padded = "\x02" * (order - 1) + w + "\x03"
            for i in range(len(w) + 1):
                counts[padded[i : i + order]][1 - label] += 1
    levels, types = {}, set(counts)
    for k in range(order - 1, 0, -1):
        n = Counter(g[1:] for g in types)
        by_context = defaultdict(list)
        for g, c in n.items():
            by_context[g[:-1]].append(c)
        levels[k], types = (n, {h: (sum(cs), len(cs)) for h, cs in by_context.items()}), set(n)
    known = {}

    def shared(g):
        if g not in known:
            n, contexts = levels[len(g)]
            total, kinds = contexts[g[:-1]]
            lower = shared(g[1:]) if len(g) > 1 else 1 / (len(n) + 1)
            known[g] = (max(n[g] - d, 0) + d * kinds * lower) / total
        return known[g]

    seen = defaultdict(list)
    for g, c in counts.items():
        seen[g[:-1]].append(c)
    total = {h: [sum(c[i] for c in cs) for i in (0, 1)] for h, cs in seen.items()}
    mass = {h: [min(1.0, d * sum(c[i] > 0 for c in cs) / total[h][i]) if total[h][i] else 1.0 for i in (0, 1)] for h, cs in seen.items()}
    grams = {}
    for g, c in counts.items():
        h = g[:-1]
        toxic, plain = ((max(c[i] - d, 0) / total[h][i] if total[h][i] else 0) + mass[h][i] * max(shared(g[1:]), 1e-12) for i in (0, 1))
        grams[g] = math.log(toxic / plain)
    return grams, {h: math.log(a / b) for h, (a, b) in mass.items()}


@pytest.mark.parametrize("words", [3, 1000])
def test_counts_are_of_all_grams(spark, words):
    """The larger input has more than 300,000 different 6-grams, nearly all of them rare."""
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß", k=12)) for _ in range(words)) + " common" * 20, i % 2) for i in range(60)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([r[::2] for r in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    fold = {r.doc_id: r.f for r in docs.select("doc_id", toxicity.fold_of(F.col("doc_id"), 5).alias("f")).collect()}
    grams, contexts = kneser_ney([(text, label) for i, text, label in rows if fold[i] > 1])
    assert words < 1000 or len(grams) > 300_000
    for (keys, ratios), want in ((model.grams, grams), (model.contexts, contexts)):
        assert keys.tolist() == sorted(want)
        assert np.allclose(ratios, [want[k] for k in sorted(want)], rtol=1e-5, atol=1e-5)
    word = "".join(rng.choices("abc", k=9))
    padded = "\x02" * 5 + word + "\x03"
    each = [padded[i : i + 6] for i in range(10)]
    assert model.words(["common", word])[1] == pytest.approx(sum(grams.get(g, contexts.get(g[:5], 0.0)) for g in each), abs=1e-4)


def test_gradients_and_forward_pass():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, quality.FEATURES)) for n in (3, 1, 5, 2)]
    labels, weight = np.array([1.0, 0.0, 1.0, 0.0]), np.array([0.4, 0.1, 0.2, 0.3])
    model = quality.AttentionBag(hidden=3, gate=2)
    x, starts, bag = np.concatenate(bags), np.array([0, 3, 4, 9]), np.repeat(np.arange(4), [3, 1, 5, 2])
    p = model.p

    def plain(b):
        h = [[math.tanh(sum(w * v for w, v in zip(row, passage, strict=True)) + c) for row, c in zip(p["W"], p["b"], strict=True)] for passage in b]
        e = [sum(w * math.tanh(np.dot(v, hi)) / (1 + math.exp(-np.dot(u, hi))) for w, v, u in zip(p["w"], p["V"], p["U"], strict=True)) for hi in h]
        a = [math.exp(v) / sum(map(math.exp, e)) for v in e]
        return 1 / (1 + math.exp(-(sum(ai * np.dot(p["c"], hi) for ai, hi in zip(a, h, strict=True)) + p["d"][0])))

    assert np.allclose(model._forward(x, starts, bag)["y"], [plain(b) for b in bags])
    loss = lambda: -sum(w * math.log(plain(b) if y else 1 - plain(b)) for b, y, w in zip(bags, labels, weight, strict=True))
    got = model.gradients(x, starts, bag, labels, weight)
    for name, g in got.items():
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 4)]:
            kept, step = p[name][at], 1e-5
            p[name][at] = kept + step
            up = loss()
            p[name][at] = kept - step
            down = loss()
            p[name][at] = kept
            assert g[at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-7), (name, at)


def test_passages_by_the_plain_rule():
    words = ["Ab", "ab", "ab", "ß", "x!"] * 37
    text = "  " + " \n".join(words) + "\t"
    rows = quality.passages(text)
    n = round(len(words) / quality.PASSAGE)
    assert rows.shape == (n, quality.FEATURES)
    for i, row in enumerate(rows):
        own = [w.lower() for w in words[len(words) * i // n : len(words) * (i + 1) // n]]
        assert row[quality.BUCKETS] == pytest.approx(len(set(own)) / len(own))
        assert row[quality.BUCKETS + 1] == pytest.approx(sum(a == b for a, b in zip(own, own[1:], strict=False)) / len(own))
        assert row[quality.BUCKETS + 2] == pytest.approx(sum(len(w.encode()) for w in own) / len(own) / 10)
        assert (row[: quality.BUCKETS] ** 2).sum() == pytest.approx(1)
    one = quality.passages("abcabc")[0]
    grams = Counter((int.from_bytes(g.encode()) * 0x9E3779B1 & 0xFFFFFFFF) >> 24 for g in ("abc", "bca", "cab", "abc"))
    assert {b: pytest.approx(float(one[b] ** 2)) for b in np.flatnonzero(one[: quality.BUCKETS])} == {b: c / 4 for b, c in grams.items()}
    assert not quality.passages(" \n").any() and not quality.passages(None).any()


def test_passages_bound_the_sample(spark):
    """Long documents lower the number of documents, not what is read of each."""
    docs = spark.createDataFrame([(i, "word " * 6000) for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    seen = []
    keep = quality.AttentionBag.fit
    quality.AttentionBag.fit = lambda self, bags, labels, **k: seen.append([len(b) for b in bags])
    try:
        quality.fit(docs, labels, max_passages=3000)
    finally:
        quality.AttentionBag.fit = keep
    assert set(seen[0]) == {100} and 5 <= len(seen[0]) <= 60


def test_toxic_ratio_by_the_plain_rule():
    model = toxicity.KneserNey()
    model.words = lambda words: [{"bad": 9.0, "so": -1.0}.get(w, 0.5) for w in words]
    each = lambda r: math.log(1 - toxicity.MIXED + toxicity.MIXED * math.exp(min(r, toxicity.CAP)))
    assert model.ratio("Bad so, so x2", {}) == pytest.approx((each(9) + 2 * each(-1) + each(0.5)) / (4 + toxicity.FLOOR))
    assert model.ratio(None, {}) == model.ratio("12 !", {}) == 0
    toxicity.fit_scale(model, np.array([0.0, 0.1, 0.2, 1.0, 1.1, 1.2]), np.array([0, 0, 0, 1, 1, 1.0]))
    assert ((model.score(np.array([0.1, 0.5, 0.7, 1.0])) >= 0.5) == [False, False, True, True]).all()


def test_scale_over_rows(spark):
    """the scale and the counts came from a sample of the labelled rows."""
    assert "max_documents" not in toxicity.fit.__code__.co_varnames
    r, y = [0.0, 0.1, 0.9, 0.2, 1.0, 1.1, 0.15, 1.2], [0, 0, 0, 0, 1, 1, 1, 1]
    one, two = toxicity.KneserNey(), toxicity.KneserNey()
    toxicity.fit_scale(one, np.array(r), np.array(y, dtype=float))
    toxicity.fit_scale_rows(two, spark.createDataFrame(list(zip(r, y, strict=True)), "r double, label int"))
    assert two.scale == pytest.approx(one.scale)


def test_labels_do_not_move_texts(spark):
    """op9_toxicity: the join of labels shuffled whole texts, also those without a label, once labels were too many to broadcast."""
    docs = spark.createDataFrame([(i, "common words here " * 200 + f"own{chr(97 + i % 26)}" if i % 3 else None) for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(0, 400, 4)] + [(0, 1), (10_000, 1), (4, None)], "doc_id bigint, toxic int")
    marked = labels.selectExpr("doc_id _id", "toxic label").where("label is not null and _id > -1")
    before = toxicity.fit(docs, labels)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with toxicity._filtered(spark):
            rows = toxicity.labelled(docs, marked, toxicity.different_words(F.col("text")).alias("words"))
            found = Counter(tuple(r) for r in rows.collect())
        assert spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold") != "0"
        after = toxicity.fit(docs, labels)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert found == Counter((" ".join(dict.fromkeys(toxicity.words_of(texts[r._id]))), r.label) for r in marked.collect() if r._id in texts)
    assert before.scale == pytest.approx(after.scale) and before.grams[0].tolist() == after.grams[0].tolist() and np.allclose(before.grams[1], after.grams[1])


def test_documents_without_a_label_stay(spark, tables):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with toxicity._filtered(spark):
            marked = tables[1].select(F.col("doc_id").alias("_id"), F.col("toxic").alias("label")).where("label is not null and _id % 5 != 0")
            plan = toxicity.labelled(tables[0], marked, toxicity.different_words(F.col("text")).alias("words"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.index("Exchange hashpartitioning(_id") < plan.index("ArrowEvalPython") < plan.index("might_contain(")


def test_words_are_made_once(spark):
    """pipeline, op9: the condition on words was moved before the join, and a task had two Python workers for the same words."""
    docs = spark.createDataFrame([(1, "Aa bb aa"), (2, ""), (3, "cc"), (4, None)], "doc_id bigint, text string")
    marked = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "_id bigint, label int")
    grams = toxicity.gram_counts(toxicity.labelled(docs, marked, toxicity.different_words(F.col("text")).alias("words")))
    assert grams._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    whole = {r.gram.strip("\x02\x03"): (r.n_toxic, r.n_ordinary) for r in grams.collect() if r.gram.endswith("\x03")}
    assert whole == {"aa": (1, 0), "bb": (1, 0), "cc": (0, 1)}
