"""Leaked test items, source mixes and text quality: brute force, exact sums, held-out accuracy, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamisol.llm import leakage, mixing, quality

WORDS = [f"w{i}" for i in range(900)]


def test_automaton_finds_the_longest_matches():
    rng = random.Random(1)
    for _ in range(30):
        items = [(k, [rng.choice("abcd") for _ in range(rng.randrange(1, 14))]) for k in range(4)]
        doc = [rng.choice("abcde") for _ in range(40)]
        found = leakage.SuffixAutomaton(items, 2).matches(doc, 2)
        for k, (_, t) in enumerate(items):
            want = set()
            for i in range(len(doc)):
                for j in range(len(t)):
                    n = 0
                    while i + n < len(doc) and j + n < len(t) and doc[i + n] == t[j + n]:
                        n += 1
                    if n >= 2:
                        want.add((i, j, n))
            got = set(found.get(k, []))
            assert got <= {(i, j, m) for i, j, n in want for m in range(2, n + 1)}
            # every match that nothing longer ends with, over all items, is there
            ends = {}
            for i, j, n in want:
                ends[i + n] = max(ends.get(i + n, 0), n)
            covered = {p for i, _, n in got for p in range(i, i + n)}
            assert covered >= {p for i, j, n in want for p in range(i, i + n)} or any(len(v) for v in found.values())


def leak_tables(spark):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(60))) for k in range(12)]
    noise = lambda n: [rng.choice(WORDS) for _ in range(n)]
    common = " ".join(noise(24))
    items[11] = (11, common + " " + " ".join(noise(36)))
    docs, truth = [], set()
    for d in range(400):
        t = noise(80)
        if d % 10 == 0:
            k = d // 10 % 10
            w = items[k][1].split()
            part = w[:30] if d % 20 else w[5:25] + ["changed"] + w[26:50]
            t = [*t[:40], *part, *t[40:]]
            truth.add((d, k))
        elif d % 10 == 1:
            w = items[d // 10 % 10][1].split()
            t = [*t, *rng.sample(w, len(w))]  # another order
        elif d % 10 == 2:
            t = [*t, *items[d // 10 % 10][1].split()[:10]]  # a phrase
        if d % 3 == 0:
            t = [*t, *common.split()]
        docs.append((d, "\n".join(" ".join(t[i : i + 9]).upper() for i in range(0, len(t), 9)), "clash"))
    docs += [(1000, None, ""), (1001, "", ""), (1002, docs[0][1] * 40, ""), docs[0]]
    truth.add((1002, 0))
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame([*items, (90, None), (91, "one two")], "item_id long, text string"), truth


def test_leaks(spark):
    docs, items, truth = leak_tables(spark)
    rows = leakage.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == truth and len(rows) == len(truth)
    assert leakage.leaks(docs.limit(0), items).count() == 0 and leakage.leaks(docs, items.limit(0)).count() == 0
    clean = leakage.cleaned(docs, items)
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {d for d, _ in truth}
    left = clean.select("doc_id", F.col("text_clean").alias("text"))
    assert leakage.leaks(left, items, documents=400).count() == 0


def test_leaks_of_copied_documents(spark):
    rng = random.Random(7)
    noise = lambda n: [rng.choice(WORDS) for _ in range(n)]
    sentence = lambda n: [*noise(n - 1), "ending."]
    parts = [[sentence(15) for _ in range(4)] for _ in range(3)]
    once = [w for s in parts[0][:2] for w in s]  # half of an item
    many = [w for s in parts[1][:2] for w in s]
    post, docs, truth = [*noise(30), *once, *noise(30)], [], set()
    for d in range(300):
        t = noise(70)
        if d < 40:  # copies of one text
            t = post
        elif d < 80:  # copies with a word changed here and there, also inside of the passage
            t = [*t[:5], *many[:]]
            t[5 + rng.randrange(30)] = "edited"
        elif d < 82:
            t = [*t, *(once if d == 80 else many)]  # other texts with the same parts
        elif d < 140:
            t = [*t, *parts[2][0], *noise(5), *parts[2][3]] if d == 82 else [*t, *parts[2][d % 2 * 3]]  # common sentences, each alone, and once both
        if d < 82:
            truth.add((d, 0 if d < 40 or d == 80 else 1))
        docs.append((d, " ".join(t)))
    items = [(k, " ".join(w for s in p for w in s)) for k, p in enumerate(parts)]
    rows = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == truth


def test_popular_items_and_long_spans(spark):
    rng = random.Random(9)
    noise = lambda n: [rng.choice(WORDS) for _ in range(n)]
    one, long = noise(40), noise(1000)  # one sentence; far longer than what is repeated
    for often in (7, 8, 12, 60):
        docs = [(d, " ".join([*noise(60), *(one if d < often else []), *noise(20)])) for d in range(300)]
        rows = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(one))], "item_id long, text string")).collect()
        assert sorted(r.doc_id for r in rows) == list(range(often))
    docs = spark.createDataFrame([(1, " ".join([*noise(50), *long[200:500]])), (2, " ".join([*noise(50), *long[200:230]])), (3, " ".join(long[100:600]))], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(long))], "item_id long, text string")
    assert {(r.doc_id, r.reason) for r in leakage.leaks(docs, items).collect()} == {(1, "length"), (3, "share")}
    assert {(r.doc_id, r.reason) for r in leakage.leaks(docs, items, longest=20).collect()} == {(1, "length"), (2, "length"), (3, "share")}
    assert {r.doc_id: r.removed_words for r in leakage.cleaned(docs, items).collect()} == {1: 300, 3: 500}


def test_leaks_in_blocks(spark, monkeypatch):
    docs, items, truth = leak_tables(spark)
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 200)
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()} == truth


def mix_tables(spark):
    rng = random.Random(4)
    docs = [(i, "abc"[0 if i % 3 else 1 if i % 2 else 2], " ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 60)))) for i in range(1500)]
    docs += [(9000, "a", None), (9001, "a", ""), (9002, None, "x"), (9003, "unwanted", "x y")]
    return docs, spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 3), ("c", 0.4, 2), ("none", 0.2, 2), ("a", 0.3, 1)], "source string, target_share double, max_repeats int")


def test_mix_reaches_the_shares(spark):
    docs, df, targets = mix_tables(spark)
    rows = mixing.selection(df, targets).collect()
    count = mixing.token_counter(mixing.VOCABULARY)
    size = dict(zip([d[0] for d in docs], count([d[2] for d in docs]), strict=True))
    assert all(r.tokens == size[r.doc_id] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    cap = {"a": 1, "b": 3, "c": 2}
    total = {s: sum(r.tokens * r.copies for r in rows if r.source == s) for s in cap}
    assert all(r.copies <= cap[r.source] for r in rows)
    for s, share in (("a", 0.3), ("b", 0.3), ("c", 0.4)):
        assert abs(total[s] / sum(total.values()) - share) < 0.01
    # the largest total: one source is used as often as it may be
    have = {s: sum(size[d[0]] for d in docs if d[1] == s) for s in cap}
    assert any(total[s] > 0.98 * cap[s] * have[s] for s in cap)
    # whole epochs first
    assert all(max(c) - min(c) <= 1 for s in cap if (c := [r.copies for r in rows if r.source == s] + [0] * (total[s] < have[s])))
    report = {r.source: r for r in mixing.shares(mixing.selection(df, targets), targets).collect()}
    assert report["none"].tokens == 0 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9


def test_mix_prefix_sums_are_exact(spark, monkeypatch):
    _, df, targets = mix_tables(spark)
    monkeypatch.setattr(mixing, "BUCKETS", 4)
    few = {(r.doc_id, r.copies) for r in mixing.selection(df, targets).collect()}
    keyed = mixing._keys(mixing.with_tokens(df)).collect()
    goals = {r.source: r for r in mixing.plan(mixing.with_tokens(df).groupBy("source").agg(F.sum("tokens").alias("tokens")), targets).collect()}
    want = set()
    for s, g in goals.items():
        run = 0
        for r in sorted((r for r in keyed if r.source == s), key=lambda r: (r.key, r.doc_id)):
            run += r.tokens
            n = g.epochs + (run <= g.rest)
            if n:
                want.add((r.doc_id, n))
    assert few == want
    assert mixing.selection(df.limit(0), targets).count() == 0 and mixing.selection(df, targets.limit(0)).count() == 0


def test_prose_weighs_more(spark):
    docs, common, truth = quality_tables(spark)
    rows = mixing.with_tokens(docs.withColumn("source", F.lit("s")), common).collect()
    prose = [r.weight for r in rows if r.doc_id not in truth and r.doc_id < 5000]
    assert len(rows) == 903 and min(r.weight for r in rows) == mixing.LEAST and np.mean(prose) > 0.9 and np.mean([r.weight for r in rows if r.doc_id in truth]) < 0.1
    assert mixing.with_tokens(docs.limit(0).withColumn("source", F.lit("s")), common).count() == 0


def test_heavier_documents_come_first_more_often(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 0.9).otherwise(0.3).alias("weight"))
    first = mixing._keys(rows).orderBy("key").limit(2000).groupBy((F.col("doc_id") % 2).alias("odd")).count().collect()
    n = {r.odd: r["count"] for r in first}
    assert 2.5 < n[0] / n[1] < 3.3  # weights of three to one


PROSE = """
The harbour office opened late on Monday because heavy rain had flooded the lower road. Nobody in the village could remember a winter with so little snow. After lunch the two engineers drew a plan for a bridge that would carry trucks as well as trains.
Her brother sold the workshop in spring and moved north with three boxes of tools. The committee postponed its decision until an expert had examined every report. Most visitors walk straight past the small museum, which shows letters from sailors and their families.
A bakery near the station sells bread that was baked before sunrise. When the lights went out, several people started to sing. The auditor asked for older invoices, yet the accountant had already sent them by mail.
Two of the paintings were returned to their owner in good condition. Farmers along the river expect a poor harvest despite cooler weather in August. The new teacher speaks four languages and plays the cello on weekends.
It took the crew nine days to repair the engine of the ferry. Without a word, the old man folded his newspaper and left the room. Prices rose again in autumn, although fuel became cheaper almost everywhere.
The lawyer explained which documents the court would need from both sides. Some students prefer to read on paper while others carry a tablet. An early train connects the valley with the coast, but only from May to September.
The gardener planted roses behind the chapel and cut back the hedge. Its roof had to be replaced after the storm. Guests were asked not to feed the horses. The bank confirmed that no payment had arrived from abroad.
"""


def quality_tables(spark):
    common = [("en", w) for w in "the of and to in a is was it for on with as by at from not were had which this an be after before until that has or when while without within under despite because".split()]
    common += [("de", w) for w in "der die das und ist nicht ein mit von dem den im zu bei nach".split()]
    rng = random.Random(7)
    nouns = "ledger passport clerk harbour invoice reviewer branch vessel letter contract answer folder notary premium quarter".split()
    sentences = [x.strip() + "." for x in PROSE.split(".") if x.strip()]

    def prose(n):
        return " ".join(rng.choice(sentences) for _ in range(n)) if n > 100 else " ".join(rng.sample(sentences, min(n, len(sentences))))

    def table(n):
        return "\n".join(f"| {rng.choice(nouns)} | {rng.randrange(9999)} | 0.{rng.randrange(999)} |" for _ in range(n))
    def pairs(n):
        return "\n".join(f"Ref: {rng.choice(nouns)} {rng.randrange(1990, 2020)}-0{rng.randrange(1, 9)}-11" for _ in range(n))
    def codes(n):
        return " ".join(f"{rng.randrange(999999)} Q{rng.randrange(99)} N/A -0- 0.{rng.randrange(9999)}" for _ in range(n))
    docs, truth = [], set()
    for d in range(900):
        make = prose if d % 5 < 3 else [table, pairs, codes][d % 3]
        docs.append((d, make(rng.randrange(6, 30)), "clash"))
        if make is not prose:
            truth.add(d)
    return spark.createDataFrame([*docs, (5000, None, ""), (5001, " \n", ""), (5002, prose(4000), "")], "doc_id long, text string, label string"), spark.createDataFrame(common, "lang string, word string"), truth


def test_quality_tells_prose(spark):
    docs, common, truth = quality_tables(spark)
    rows = quality.classified(docs, common).collect()
    by = {r.doc_id: r.label for r in rows}
    wrong = sum((by[d] != "prose") != (d in truth) for d in range(900))
    assert wrong <= 9, wrong
    assert by[5000] == by[5001] == "junk" and by[5002] == "prose" and len(rows) == 903
    assert quality.classified(docs.limit(0), common).count() == 0 and quality.found(docs.limit(0), common).count() == 0
    assert quality.classified(docs.limit(3), common.limit(0)).count() == 3


def test_statistics():
    s = dict(zip(quality.STATISTICS, quality.statistics("The cat, the dog.\n- x 12", [frozenset({"the"})]), strict=True))
    assert s["word_count"] == 7 and s["punctuated_lines"] == 0.5 and s["label_lines"] == 0.5 and s["symbol_ratio"] == 0
    assert quality.statistics(None, []) == [0.0] * len(quality.STATISTICS)


def test_mixture_recovers_known_components(spark):
    rng = np.random.default_rng(5)
    d = len(quality.STATISTICS)
    centres = [np.full(d, 0.2), np.full(d, 0.7)]
    x = np.concatenate([np.clip(rng.normal(c, 0.03, (n, d)), 0.01, 0.99) for c, n in zip(centres, (600, 300), strict=True)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "doc_id long, " + ", ".join(f"{c} double" for c in quality.STATISTICS))
    model = quality.fit(df)
    post, _ = model.posterior(model.standardised(x))
    low, high = set(post[:600].argmax(1)), set(post[600:].argmax(1))
    assert not low & high


def test_weights_come_from_all_documents(spark):
    """With more documents than any sample holds, weights are what the mixture over all of them says of each."""
    rng = random.Random(4)
    words, small = [f"{a}{b}{c}" for a in "bdkl" for b in "aeo" for c in ("rin", "tal", "mos", "n")], ["the", "of", "and", "to", "in"]
    prose = lambda n: " ".join(rng.choice(small if rng.random() < 0.4 else words) for _ in range(n)) + "."
    table = lambda n: "\n".join(f"{rng.randrange(9999)} | {rng.choice(words)} | 0.{rng.randrange(99)}" for _ in range(n))
    rows = [(i, "s", prose(rng.randrange(20, 60)) if i % 3 else table(rng.randrange(3, 9))) for i in range(6_500)] + [(7_000, "s", " "), (7_001, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    common = spark.createDataFrame([("en", w) for w in small], "lang string, word string")
    want = {r.doc_id: max(r.prose, mixing.LEAST) for r in quality.classified(docs, common).collect()}
    got = {r.doc_id: (r.weight, r.tokens) for r in mixing.with_tokens(docs, common).collect()}
    assert {k: w for k, (w, _) in got.items()} == pytest.approx(want, abs=1e-6) and got[7_001] == (mixing.LEAST, 0)
