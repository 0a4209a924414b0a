"""Language, toxicity and licence models: held-out accuracy on made texts, odd rows, empty tables."""

import math
import random

from shelfmark.llm.language import fit as fit_language, identify
from shelfmark.llm import licenses
from shelfmark.llm.licenses import license_scan, train
from shelfmark.llm.toxicity import fit as fit_toxicity, toxicity

SYLLABLES = {"aa": "the and ing her tion th", "bb": "der und ich sch ung ein", "cc": "que los ción para ente ñas"}


def made(lang, rng, n=30):
    return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randrange(1, 4))) for _ in range(n))


def test_language_of_held_out_texts(spark):
    rng = random.Random(1)
    rows = [(i, made(lang, rng), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=240))]
    train_rows = rows[:120] + [(998, None, "aa"), (999, "x", None)]
    model = fit_language(spark.createDataFrame(train_rows, "doc_id long, text string, lang string"))
    test = spark.createDataFrame([(*r, 1.0) for r in rows[120:]] + [(1000, None, None, 1.0), (1001, "12 34\n", None, 1.0), (1002, "", "aa", 1.0), (None, "ü", None, 1.0)], "doc_id long, text string, lang_pred string, score double")
    found = {r.doc_id: r for r in identify(test, model).collect()}
    assert all(found[i].lang_pred == lang and 0 <= found[i].score <= 1 for i, _, lang in rows[120:])
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1000, 1001, 1002))
    assert found[None].lang_pred in SYLLABLES
    assert {r.lang_pred for r in identify(test, None).collect()} == {"und"}
    assert identify(test.limit(0), model).count() == 0 and fit_language(test.limit(0), lang_column="lang_pred") is None


def test_code_lengths_are_sums_of_single_bytes(spark):
    """The vectorised pass against a walk that finds each byte's longest context by itself."""
    import numpy as np
    rng = random.Random(2)
    rows = [(i, made(lang, rng), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=40))]
    model = fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), contexts=200)
    texts = [made("aa", rng).encode(), b"", "zñ".encode(), made("cc", rng).encode()]
    at = np.cumsum([0] + [len(t) for t in texts])
    found = model.lengths(np.frombuffer(b"".join(texts), np.uint8), at)
    for t, row in zip(texts, found):
        total = np.zeros(3)
        for i, b in enumerate(t):
            state = 0
            for c in t[max(0, i - model.order) : i]:
                state = model.step[state, model.symbol[c]]
            total += model.bits[state * model.step.shape[1] + model.symbol[b]]
        assert np.allclose(row, total, rtol=1e-5)
    chance = 2.0 ** -model.bits.reshape(*model.step.shape, 3)
    assert (chance[:, 1:].sum(1) <= 1 + 1e-5).all()


def test_trees_are_fitted_by_language(spark):
    """Code lengths against trees counted, cut and walked plainly; one language has a hundredth of the bytes."""
    import collections
    import math

    import numpy as np
    rng, order, contexts = random.Random(5), 3, 91
    rows = [(i, made(lang, rng, n), lang) for i, (lang, n) in enumerate([("aa", 40)] * 30 + [("bb", 40)] * 20 + [("cc", 12)])]
    model = fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), contexts=contexts, order=order)
    trees = {}
    for lang in SYLLABLES:
        grams = collections.Counter()
        for _, text, own in rows:
            t = text.encode()
            if own == lang:
                grams.update(t[i : i + n] for n in range(1, order + 2) for i in range(len(t) - n + 1))
        ranked = sorted((g for g in grams if len(g) <= order), key=lambda g: (-grams[g], len(g), g))
        trees[lang] = {c: {g[-1]: k for g, k in grams.items() if g[:-1] == c} for c in [b"", *ranked[: (contexts - 1) // 3]]}
    assert any(c not in trees["aa"] for c in trees["cc"])

    def chance(tree, context, byte):
        after = tree.get(context, {})
        if byte in after:
            return after[byte] / (sum(after.values()) + len(after))
        escape = len(after) / (sum(after.values()) + len(after)) if after else 1.0
        return escape * (chance(tree, context[1:], byte) if context else 1 / 256)

    texts = [made(lang, rng).encode() for lang in SYLLABLES] + [b"", "zñ?".encode()]
    at = np.cumsum([0] + [len(t) for t in texts])
    plain = [[-sum(math.log2(chance(trees[lang], t[max(0, i - order) : i], t[i])) for i in range(len(t))) for lang in sorted(SYLLABLES)] for t in texts]
    assert np.allclose(model.lengths(np.frombuffer(b"".join(texts), np.uint8), at), plain, rtol=1e-5)


def test_toxicity_of_held_out_texts(spark):
    rng = random.Random(3)
    rude = ["grubb", "snarl", "vexor"]
    docs, labels = [], []
    for i in range(400):
        words = made("aa", rng, 60).split()
        if i % 3 == 0:
            words[rng.randrange(60)] = rng.choice(rude).title() + ","
        docs.append((i, " ".join(words), 0.5, 1))
        labels.append((i, int(i % 3 == 0)))
    docs += [(900, None, 0.5, 1), (901, "", 0.5, 1), (902, "?!", 0.5, 1), (None, "grubb", 0.5, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score double, predicted int")
    marks = spark.createDataFrame([(i, y) for i, y in labels if i % 5] + [(5000, None), (None, 1), (1, labels[1][1])], "doc_id long, toxic int")
    model = fit_toxicity(frame, marks)
    found = {r.doc_id: r for r in toxicity(frame, model).collect()}
    held = [(found[i].predicted, y) for i, y in labels if i % 5 == 0]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    assert found[900].score == found[901].score == found[902].score < 0.5
    assert fit_toxicity(frame, marks.where("toxic = 1")) is None
    assert {r.score for r in toxicity(frame, None).collect()} == {0.0}
    assert toxicity(frame.limit(0), model).count() == 0


def test_licenses(spark):
    trained = train(spark)
    wrapped = "Permission is hereby granted, free of charge, to any person\r\nobtaining a copy of this software and associated documentation\r\nfiles, and so on"
    rows = [
        (1, "Some prose\nReleased under the MIT License.\nmore", "x"), (2, "licensed under the apache license version 2.0", "x"),
        (3, "This work is licensed under the GNU General Public License, version 3.", "x"), (4, "Licensed under CC BY-NC 4.0.", "x"),
        (5, "He lost his driving license on Monday", "x"), (6, None, "x"), (7, "", "x"), (8, "no such words", "x"), (None, "Released under the MIT License.", "x"),
        (9, "word " * 20000 + "\nLicensed under CC BY-NC 4.0.", "x"), (10, "CC BY-SA 4.0", "x"), (11, "MPL 2.0", "x"), (12, "Distributed under Apache-2.0", "x"),
        (13, wrapped, "x"), (14, "word " * 9000 + "Distributed under Apache-2.0 " + "word " * 9000, "x"), (15, "Her license under the general public was new", "x"),
    ]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, family string")
    rows_found = license_scan(docs, trained).collect()
    found = sorted((str(r.doc_id), r.paragraph, r.family) for r in rows_found if r.confirmed and r.doc_id != 14)
    assert found == sorted([
        ("1", 1, "MIT"), ("1", 1, "MIT"), ("2", 0, "Apache-2.0"), ("3", 0, "GPL"), ("4", 0, "CC-BY-NC"), ("None", 0, "MIT"), ("9", 1, "CC-BY-NC"),
        ("10", 0, "CC-BY-SA"), ("11", 0, "MPL"), ("12", 0, "Apache-2.0"), ("13", 0, "MIT")])
    assert {(r.paragraph, r.start % 320, r.family) for r in rows_found if r.doc_id == 14 and r.confirmed} == {(0, 0, "Apache-2.0")}
    assert [r.family for r in rows_found if r.doc_id == 15] == ["unknown"]
    assert license_scan(docs.limit(0), trained).count() == 0
    assert "Python" not in license_scan(docs, trained)._jdf.queryExecution().toString()


def test_licenses_without_signs_could_not_be_confirmed(spark):
    """The cut before the classifier loses nothing: every paragraph's largest share, told plainly."""
    words, pairs = licenses.signs()
    listed = [licenses._pairs_of(licenses.plain_words(t)) for ts in licenses.templates().values() for t in ts]
    listed = [p for p in listed if p]
    for template in listed:
        assert len([p for p in template if p not in pairs]) <= licenses.LEAST_SIMILARITY * len(template)
    texts = [t for ts in licenses.templates().values() for t in ts] + licenses.OTHERS
    texts += [t[: len(t) // 2] for t in texts] + [a + " " + b for a, b in zip(texts, texts[7:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id: set(r._words) for r in licenses.paragraphs(docs, holding=words).collect()}
    plain = {r.doc_id: r._words for r in licenses.paragraphs(docs).collect()}
    for i, text in enumerate(texts):
        assert plain[i] == licenses.plain_words(text)
        mine = licenses._pairs_of(plain[i])
        if max(len(mine & t) / len(t) for t in listed) > licenses.LEAST_SIMILARITY:
            assert kept[i] & set(words) and mine & set(pairs)


def test_toxicity_counts_pairs(spark):
    """Both orders of the model against plain dictionaries; a pair tells what its words alone do not."""
    import numpy as np
    from shelfmark.llm import toxicity as module
    rng, d = random.Random(4), module.DISCOUNT
    docs = [(i, " ".join(rng.choices("abcdefgh", k=12) + (["x", "y"] if i % 2 else ["y", "x"])), i % 2) for i in range(60)]
    model = fit_toxicity(spark.createDataFrame(docs, "doc_id long, text string, toxic int").select("doc_id", "text").repartition(3),
                         spark.createDataFrame([(i, y) for i, _, y in docs], "doc_id long, toxic int"), count_texts=1000)
    part = {r.doc_id: r.p for r in spark.range(60).selectExpr("id AS doc_id", f"pmod(xxhash64(id), {1 << 30}) / {float(1 << 30)} AS p").collect()}
    seen = [{}, {}]
    for i, text, y in docs:
        if part[i] < 0.7:
            for pair in zip(["<"] + text.split(), text.split()):
                seen[y][pair] = seen[y].get(pair, 0) + 1
    both = {p: sum(s.get(p, 0) for s in seen) for p in {*seen[0], *seen[1]}}
    known = sorted({b for _, b in both})

    def lower(pairs, backoff):
        follows = {b: sum(q[1] == b for q in pairs) for b in known}
        left = d * max(sum(n > 0 for n in follows.values()), 1)
        return {b: (max(follows.get(b, 0) - d, 0) + left * backoff[b]) / max(len(pairs), 1) for b in [*known, "?"]}

    every = lower(both, dict.fromkeys([*known, "?"], 1 / (len(known) + 1)))
    alone = [lower(s, every) for s in seen]

    def after(a, pairs, base):
        own = {b: n for (c, b), n in pairs.items() if c == a}
        total = sum(own.values())
        return {b: (max(own.get(b, 0) - d, 0) + d * len(own) * base[b]) / total for b in base} if total else base

    def plain(k, a):
        scaled = {b: p * alone[k][b] / every[b] for b, p in after(a, both, every).items()}
        return after(a, seen[k], {b: p / sum(scaled.values()) for b, p in scaled.items()})

    first = ["<", *known, "?"]
    hashed = dict(zip("".join(known) + "?", module._bigrams(*module.utf8(module.pa.array([" ".join(known) + " q"])))[2])) | {"<": module._START}
    a, b = zip(*[(p, q) for p in first for q in [*known, "?"]])
    pairs, back = np.unique(model.pairs(np.array([hashed[p] for p in a], np.uint64), np.array([hashed[q] for q in b], np.uint64)), return_inverse=True)
    found = model.chances(pairs)[back]
    want = np.array([[plain(k, p)[q] for k in (0, 1)] for p, q in zip(a, b)])
    assert np.allclose(found, want) and np.allclose(found.reshape(len(first), -1, 2).sum(1), 1)
    texts = [(i, "a b c " + ("x y" if i % 2 else "y x") + " d e") for i in range(20)]
    scored = toxicity(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    assert all(r.predicted == r.doc_id % 2 for r in scored)
