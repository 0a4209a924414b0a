import math
import random
from collections import Counter, defaultdict

from shelfmark.llm.ngrams import fit, score_texts


def plain_model(texts):
    """Interpolated modified Kneser-Ney of order two over dictionaries."""
    seqs = [[*(w.lower() for w in (t or "").split()), "</s>"] for t in texts]
    count = Counter(w for s in seqs for w in s)
    pair = Counter(p for s in seqs for p in zip(["<s>", *s], s))
    after, before = defaultdict(list), defaultdict(int)
    for (a, b), c in pair.items():
        after[a].append(c)
        before[b] += 1

    def discounts(values):
        n = [sum(v == i for v in values) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
        d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else y for k in (1, 2, 3)]
        return [min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)]

    high, low = discounts(pair.values()), discounts(before.values())

    def lower(w):
        left = sum(low[min(c, 3) - 1] for c in before.values()) / len(pair)
        c = before.get(w, 0)
        return (c - (low[min(c, 3) - 1] if c else 0)) / len(pair) + left / (len(count) + 1)

    def chance(a, b):
        if a not in after:
            return lower(b)
        total, c = sum(after[a]), pair.get((a, b), 0)
        share = sum(high[min(x, 3) - 1] for x in after[a]) / total
        return (c - (high[min(c, 3) - 1] if c else 0)) / total + share * lower(b)

    return count, chance


def test_scores_agree_with_dictionaries(spark):
    rng = random.Random(2)
    vocabulary = [f"Wo{i}rd" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, weights=range(1, 61), k=rng.randrange(0, 60))) for _ in range(60)] + [None, "", " \t"]
    extra = ["wo1rd unseen wo2rd", "é É\x0bx", None, "", "wo59rd " * 3000]
    model = fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), buckets=5)
    count, chance = plain_model(texts)
    n, v = sum(count.values()), len(count)
    assert (model.tokens, model.distinct) == (n, v)
    rows = list(enumerate(texts + extra))
    docs = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows] + [(None, "wo1rd", "clash", 1.0)], "doc_id int, text string, n_tokens string, score double")
    found = {r.doc_id: r for r in score_texts(docs, model).collect()}
    assert len(found) == len(rows) + 1
    for i, t in rows:
        s = [*(w.lower() if w.isascii() else w for w in (t or "").split()), "</s>"]
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(s), sum(w in count for w in s), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in s), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(chance(a, b)) for a, b in zip(["<s>", *s], s)), rel_tol=1e-9)
    some = ["<s>", *list(count)[:5]]
    for a in some:  # a distribution over the known words and one unknown
        assert math.isclose(sum(chance(a, b) for b in [*count, "?"]), 1, rel_tol=1e-9)


def test_nothing_learned_and_empty_table(spark):
    model = fit(spark.createDataFrame([], "text string"), buckets=2)
    rows = score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).collect()
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in rows] == [(3, 0, 0.0, 0.0)]
    assert score_texts(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_words_of_one_polynomial_hash(spark):
    bits = [0]
    for _ in range(10):
        bits += [1 - b for b in bits]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    model = fit(spark.createDataFrame([(f"{one} x",)], "text string"), buckets=2)
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id int, text string")
    assert {r.doc_id: r.n_known for r in score_texts(docs, model).collect()} == {1: 2, 2: 1}


def test_word_hashes_differ_by_length_and_byte():
    import numpy as np

    from shelfmark.llm.common import word_hash

    rng = random.Random(3)
    strings = {bytes(rng.choices(b"\x01ab\xff", k=n)) for n in [0, 1, 2, 7, 8, 9, 15, 16, 17, 255, 256, 257, 3000] for _ in range(60)}
    data = np.frombuffer(b"".join(strings), np.uint8)
    at = np.cumsum([0] + [len(s) for s in strings])
    h = word_hash(data, at[:-1], at[1:])
    assert len(set(h.tolist())) == len(strings)
    again = [int(word_hash(np.frombuffer(s, np.uint8), np.array([0]), np.array([len(s)]))[0]) for s in strings]
    assert again == h.tolist()
