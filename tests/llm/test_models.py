"""Learned and encoded operators: against brute force, the library, or held-out rows."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import langid, lm, neighbours, pieces, simhash, toxicity
from tidewell.llm.components import components
from tidewell.llm.hilbert import hilbert_key
from tidewell.llm.lookup import Table

DOCS = "doc_id long, text string, lang string, score double, _text string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0.0, "x") for i, t, lang in rows], DOCS)


def test_lookup_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    found = Table(keys).find(np.concatenate((keys, keys + np.uint64(1))))
    assert (found[: len(keys)] == np.arange(len(keys))).all()
    assert (Table(np.empty(0, np.uint64)).find(keys) == -1).all()


def test_hilbert_neighbours_differ_by_one_step():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    walk = grid[np.argsort(hilbert_key(grid, 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def brute_components(fps):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(fps))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fps))])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("direct", [0, 1024])
def test_bucket_links_are_exact(direct):
    rng = random.Random(direct)
    for trial in range(30):
        block = trial % 3
        at, width = simhash.BLOCKS[block]
        variant = rng.getrandbits(64) & ~(((1 << width) - 1) << at)
        flips = [0] + [1 << i for i in range(64) if not at <= i < at + width]
        fps = {variant ^ rng.choice(flips[: 3 + trial]) | rng.getrandbits(7) << at for _ in range(50)}
        fps = np.array(sorted(fps), np.uint64)
        a, b = simhash.bucket_links(fps, block, variant, direct)
        spot, label = {int(x): i for i, x in enumerate(fps)}, np.arange(len(fps))
        for x, y in zip(a, b, strict=True):
            label[spot[int(x)]] = spot[int(y)]
        assert (label == brute_components(fps)).all()


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    base = " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) + str(rng.randint(0, 99)) for _ in range(400)).split()
    rows = []
    for i in range(60):
        words = list(base) if i % 2 else [f"{i}x{k}" for k in range(40)]
        for _ in range(i % 7):
            words[rng.randrange(len(words))] = "edit"
        rows.append((100 - i, " ".join(words), "en"))
    rows += [(200, None, None), (201, "", None), (202, "\n", None), (7, rows[0][1], "en"), (7, rows[0][1], "en"), (None, rows[1][1], "en"), (203, "One Two", None), (204, "one  two", None)]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = np.array([simhash.fingerprint(t) for _, t, _ in rows], np.uint64)
    label = brute_components(fps)
    least = {c: min((rows[k][0] for k in np.nonzero(label == c)[0] if rows[k][0] is not None), default=None) for c in set(label)}
    want = sorted((r[0] or -1, least[label[k]]) for k, r in enumerate(rows))
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == want
    stay = simhash.one_per_component(table(spark, rows)).collect()
    assert sorted(r.doc_id for r in stay if r.doc_id is not None) == sorted(set(least.values()))
    assert simhash.near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_one_row_stays_of_each_component_when_ids_repeat(spark):
    texts = ["alpha beta gamma delta", "one two three four five", "red green blue black"]
    rows = [(1, texts[0], "a"), (1, texts[1], "b"), (2, texts[1], "c"), (1, texts[2], "d"), (0, texts[2], "e"), (0, texts[2], "e")]
    for turn in (rows, rows[::-1]):
        stay = simhash.one_per_component(table(spark, turn)).collect()
        assert sorted((r.doc_id, r.text, r.lang) for r in stay) == [(0, texts[2], "e"), (1, texts[0], "a"), (1, texts[1], "b")]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(900, 901), (5, 5)], "a long, b long")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {i: 0 for i in range(1, 151)} | {901: 900}


def test_vector_search(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 12)).astype(np.float32)
    vectors[50:90] = vectors[0]  # copies, ties to the smaller id
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] * 12), (1003, [1.0, None] * 6), (1004, [1.0]), (None, vectors[1].tolist()), (3, vectors[3].tolist())]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("entry", F.lit(1))
    got = neighbours.search(t, F.col("vec_id") % 20 == 0, k=5).toPandas()
    x = vectors.astype(float)
    hit = total = 0
    for q in range(0, 300, 20):
        s = (x * x[q]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[q] ** 2).sum()))
        s[q] = -9
        want = np.lexsort((np.arange(300), -s))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 5 and (np.diff(mine.score) <= 0).all()
        assert np.allclose(mine.score, s[mine.vec_id], atol=1e-12)
        hit, total = hit + len(set(want) & set(mine.vec_id)), total + 5
    assert hit / total >= 0.9
    assert got[got.query_id == 60].sort_values("rank").vec_id.tolist() == [0, 50, 51, 52, 53]
    assert neighbours.search(t.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = neighbours.search(t.filter("vec_id IN (20, 21, 22)"), F.col("vec_id") == 20, k=5).collect()
    assert sorted(r.vec_id for r in few) == [21, 22]


def brute_ppm(texts):
    seen = collections.defaultdict(collections.Counter)
    k_max = lm.ORDER
    for t in texts:
        b = b"\n" * k_max + b" ".join(lm.tokens(t)) + b"\n"
        for i in range(k_max, len(b)):
            for k in range(k_max + 1):
                seen[b[i - k : i]][b[i]] += 1

    def log10(text):
        b, out = b"\n" * k_max + b" ".join(lm.tokens(text)) + b"\n", 0.0
        for i in range(k_max, len(b)):
            excluded, p = set(), 1.0
            for k in range(k_max, -1, -1):
                left = {s: n for s, n in seen.get(b[i - k : i], {}).items() if s not in excluded}
                total = sum(left.values())
                if b[i] in left:
                    p *= (left[b[i]] - 0.5) / total
                    break
                if left:
                    p *= len(left) / 2 / total
                    excluded |= set(left)
            else:
                p /= 256 - len(excluded)
            out += math.log10(p)
        return out

    return log10


@pytest.mark.parametrize("hot", [3, 400_000])
def test_lm_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT_WORDS", hot)
    train = ["The cat sat on the mat", "the dog ate the cat", None, "", "héllo  wörld\tagain", "the the the"]
    rows = [(i, t, "en") for i, t in enumerate([*train, "the cow sat on zebra", "THE DOG", None, "q" * 300])]
    docs = table(spark, rows)
    got = lm.score(docs, lm.count(docs.filter(F.col("doc_id") < len(train)))).toPandas().set_index("doc_id")
    log10 = brute_ppm(train)
    words = collections.Counter(w for t in train for w in [*lm.tokens(t), b"\n"])
    n, v = sum(words.values()), len(words)
    for i, t, _ in rows:
        own = [*lm.tokens(t), b"\n"]
        r = got.loc[i]
        assert abs(r.score - log10(t)) < 1e-5 * abs(log10(t)) + 1e-6
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in words for w in own), n)
        assert abs(r.base_score - sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own)) < 1e-9
    assert lm.score(docs.limit(0), lm.count(docs)).count() == 0
    blank = lm.score(docs, lm.count(docs.limit(0))).collect()
    assert len(blank) == len(rows) and all(r.train_tokens == 0 for r in blank)


@pytest.mark.parametrize("most, group", [(40, 60_000), (40, 20), (0, 1)])
def test_lm_scores_with_all_grams_past_the_bound(spark, monkeypatch, most, group):
    monkeypatch.setattr(lm, "MAX_GRAMS", most)
    monkeypatch.setattr(lm, "GROUP_GRAMS", group)
    train = ["The cat sat on the mat", "the dog ate the cat", None, "", "héllo  wörld\tagain", "the the the"] * 2
    texts = [*train, "the cow sat on zebra", "THE DOG", None, "q" * 300, "日本 the", "z\0\0z"]
    docs = table(spark, [(i, t, "en") for i, t in enumerate(texts)])
    log10 = brute_ppm(train)
    for r in lm.score(docs, lm.count(docs.filter(F.col("doc_id") < len(train)))).collect():
        want = log10(texts[r.doc_id])
        assert abs(r.score - want) < 1e-5 * abs(want) + 1e-6, texts[r.doc_id]


def test_lm_stays_a_distribution_when_pruned(spark, monkeypatch):
    monkeypatch.setattr(lm, "MAX_GRAMS", 40)
    docs = table(spark, [(i, f"abra cadabra {'xy' * i}", "en") for i in range(9)])
    model = lm.fit(lm.count(docs))
    trie = lm.Trie(model["grams"], model["all_grams"])
    for context in (b"\n\n\n\n\n", b"cadab", b"zzzzz"):
        keys = np.array([int.from_bytes(context + bytes([s])) for s in range(256)], np.uint64)
        assert abs((10 ** trie.log10(keys)).sum() - 1) < 1e-3


def test_pieces_match_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = pieces.model_bytes()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(5)
    chars = "abcde  \n\t\r;{}()▁éß日本ａ\x00😀🧿﻿​<>s/0x41"
    texts = [None, "", " ", "▁", " " * 700, "ab" * 900, "fn prepare" * 30]
    texts += ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    got = pieces.encode_documents(table(spark, list(zip(range(len(texts)), texts, [None] * len(texts), strict=True))), model).collect()
    for r in got:
        ids = sp.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == sp.decode(ids), texts[r.doc_id]
    coder = pieces.Coder(model)
    words = [w for t in texts for w in coder.words(t or "")]
    assert coder.encode_words(words) == [coder._by_heap(w) for w in words]


LANGS = {"aa": "the thing with that other thin brother ", "bb": "oui nous vous avons toujours mieux pour ", "cc": "sch und ich nicht auch zwischen "}


def sample(rng, lang, n):
    words = LANGS[lang].split()
    return " ".join(rng.choice(words) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(2)
    rows = [(i, sample(rng, lang, 30), lang) for i, lang in enumerate(list(LANGS) * 20)]
    docs = table(spark, rows)
    prototypes = langid.fit(docs)
    odd = [(900, None, None), (901, "", "aa"), (902, "123 !!", None), (903, "é", None)]
    new = [(i, sample(rng, lang, 12), lang) for i, lang in enumerate(list(LANGS) * 5)]
    got = {r.doc_id: r for r in langid.predict(table(spark, new + odd).drop("score"), prototypes).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in new)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and 0 <= got[903].score <= 1
    assert langid.fit(docs.limit(0)) == {}
    assert langid.predict(docs.drop("score"), {}).filter("lang_pred <> 'und'").count() == 0
    keep = langid.predict(table(spark, new + odd).drop("score"), prototypes, keep=("doc_id", "text"))
    kept = keep.filter(langid.accepted(F.col("lang_pred"), F.col("score"), F.col("text")))
    assert kept.count() == len(new) + 1


def test_toxicity_learns_pairs(spark):
    rng = random.Random(4)
    filler = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(900):
        insult, group = i % 2, i // 2 % 2
        text = " ".join(rng.sample(filler, 12) + ["scum"] * insult + ["folk"] * group)
        rows.append((i, text, "en"))
        labels.append((i, insult & group))
    table_l = spark.createDataFrame([*labels, (3, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    docs = table(spark, rows)
    machine = toxicity.fit(docs, table_l.filter("doc_id < 600 OR doc_id IS NULL"))
    got = toxicity.score(docs.drop("score").filter("doc_id >= 600"), machine).toPandas().set_index("doc_id").score
    assert np.mean([(got[i] >= 0.3) == bool(y) for i, y in labels[600:]]) > 0.97
    odd = toxicity.score(table(spark, [(1, None, None), (2, "", None), (2, "", None)]).drop("score"), machine).collect()
    assert len(odd) == 3 and all(0 <= r.score <= 1 for r in odd)
    empty = toxicity.fit(docs, table_l.limit(0))
    assert toxicity.score(docs.drop("score"), empty).filter("score >= 0.3").count() == 0


def test_toxicity_learns_what_no_sum_of_weights_can(spark):
    """Toxic is an insult or a group mention, but not both: neither word tells anything alone."""
    rng = random.Random(8)
    filler = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(1500):
        insult, group = i % 2, i // 2 % 2
        rows.append((i, " ".join(rng.sample(filler, 12) + ["scum"] * insult + ["folk"] * group), "en"))
        labels.append((i, insult ^ group))
    docs, known = table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.fit(docs, known.filter("doc_id < 1000"))
    got = toxicity.score(docs.filter("doc_id >= 1000"), machine).toPandas().set_index("doc_id").score
    assert np.mean([(got[i] >= 0.3) == bool(y) for i, y in labels[1000:]]) > 0.97
    # The best additive model over the same two words says the same for all four kinds: half are right.
    assert abs(np.mean([y for i, y in labels[1000:] if i % 2]) - np.mean([y for i, y in labels[1000:] if not i % 2])) < 0.05
    # Every score is the machine's formula, written out pair by pair.
    for i, text, _ in rows[:30]:
        on = machine.active(toxicity.terms(text))
        margin = machine.bias + sum(float(machine.w[a]) for a in on)
        margin += sum(float(np.dot(machine.v[a].astype(float), machine.v[b].astype(float))) for k, a in enumerate(on) for b in on[k + 1 :])
        mine = toxicity.score(docs.filter(F.col("doc_id") == i), machine).first().score if i < 3 else float(toxicity._sigmoid(np.array(machine.margin(on))))
        assert abs(mine - 1 / (1 + math.exp(-margin))) < 1e-6


def rare_corpus(n, words, seed):
    """Two words in about one document of a hundred each, toxic exactly if one of them stands alone; elsewhere toxicity is a coin's."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        kind = i % 100
        own = {0: words[:1], 1: words[1:], 2: words, 3: words}.get(kind if i % 200 < 100 else kind + 2 if kind < 2 else 99, [])
        rows.append((i, " ".join(rng.sample([f"w{k}" for k in range(400)], 12) + list(own)), "en"))
        labels.append((i, 1 if len(own) == 1 else 0 if own else rng.randint(0, 1)))
    return rows, labels


def test_toxicity_learns_rare_pairs(spark):
    rows, labels = rare_corpus(9000, ["scum", "folk"], 5)
    docs, known = table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.fit(docs, known.filter("doc_id < 7000"))
    got = toxicity.score(docs.filter("doc_id >= 7000"), machine).toPandas().set_index("doc_id").score
    told = [(i, y) for (i, y), (_, t, _) in zip(labels, rows, strict=True) if i >= 7000 and ("scum" in t or "folk" in t)]
    assert len(told) > 30 and np.mean([(got[i] >= 0.5) == bool(y) for i, y in told]) > 0.97
    assert len(machine.chosen) <= 6


def test_all_telling_pairs_are_found(spark):
    """Against counts of every pair, in plain Python."""
    rng = np.random.default_rng(3)
    has, toxic = rng.random((3000, 12)) < np.tile([0.05, 0.1, 0.4], 4), rng.random(3000) < 0.3
    toxic = toxic | has[:, 0] & has[:, 1] | (has[:, 2] ^ has[:, 5]) & ~has[:, 4]
    rows = [(str(i), int(y), [7 * k for k in np.nonzero(h)[0].tolist()]) for i, (h, y) in enumerate(zip(has, toxic, strict=True))]
    t = spark.createDataFrame(rows, "id string, y int, terms array<int>")
    machine = toxicity.Machine(np.empty(0, np.int32), float(np.log(toxic.mean() / (1 - toxic.mean()))))
    found = toxicity.telling_pairs(t, toxicity.term_counts(t), machine, len(rows), int(toxic.sum())).collect()
    want, base = {}, toxic.mean()
    for i in range(12):
        for j in range(i + 1, 12):
            total, error = 0.0, 0.0
            for x, y, sign in ((1, 1, 1), (1, 0, -1), (0, 1, -1), (0, 0, 1)):
                cell = (has[:, i] == x) & (has[:, j] == y)
                rate = (toxic[cell].sum() + 0.5) / (cell.sum() + 1)
                total += sign * rate
                error += max(rate * (1 - rate), base * (1 - base)) / max(cell.sum(), 1)
            if abs(total) / error**0.5 >= toxicity.MIN_PAIR_Z:
                want[7 * i, 7 * j] = abs(total) / error**0.5
    assert want and {(r.one, r.two): pytest.approx(r.z) for r in found} == want


def test_toxicity_learns_rare_pairs_of_long_documents(spark):
    """Every document with one of the two words has 2,000 others, as have some with neither: 4e8 pairs of terms in all. Neither word tells alone."""
    rows, labels = ([x for x in side if x[0] % 200 not in (2, 3)] for side in rare_corpus(9000, ["scum", "folk"], 5))
    more = " ".join(f"v{k}" for k in range(2000))
    rows = [(i, f"{t} {more}" if "scum" in t or "folk" in t or i % 100 == 50 else t, lang) for i, t, lang in rows]
    docs, known = table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.fit(docs, known.filter("doc_id < 7000"))
    assert set(toxicity.terms("scum folk").tolist()) <= set(machine.chosen.tolist())
    got = toxicity.score(docs.filter("doc_id >= 7000"), machine).toPandas().set_index("doc_id").score
    told = [(i, y) for (i, y), (_, t, _) in zip(labels, rows, strict=True) if i >= 7000 and ("scum" in t or "folk" in t)]
    assert len(told) > 30 and np.mean([(got[i] >= 0.5) == bool(y) for i, y in told]) > 0.97


def test_blocks_of_terms_lose_no_pair(spark):
    """Groups of a few terms find what one group finds, and a machine that foretells the labels leaves nothing to find."""
    rng = np.random.default_rng(4)
    has, coin = rng.random((2000, 30)) < 0.2, rng.random(2000) < 0.3
    toxic = coin | (has[:, 3] ^ has[:, 17]) | has[:, 20] & has[:, 21]
    rows = [(str(i), int(y), (5 * np.nonzero(h)[0]).tolist()) for i, (h, y) in enumerate(zip(has, toxic, strict=True))]
    t = spark.createDataFrame(rows, "id string, y int, terms array<int>")
    machine = toxicity.Machine(np.empty(0, np.int32), float(np.log(toxic.mean() / (1 - toxic.mean()))))
    find = lambda m, **more: sorted(tuple(r) for r in toxicity.telling_pairs(t, toxicity.term_counts(t), m, len(rows), int(toxic.sum()), **more).collect())
    whole = find(machine)
    assert {(15, 85), (100, 105)} <= {r[:2] for r in whole} and find(machine, group=1000) == find(machine, group=1) == whole
    apart = toxicity.Machine(np.array([15, 85], np.int32), 0.0)  # 3 and 17 cancel out where both stand
    apart.w[:], apart.v[:] = 6, 0
    apart.v[0, 0], apart.v[1, 0], apart.bias = 3.5, -3.5, -0.85
    assert (15, 85) not in {r[:2] for r in find(apart)}


def test_the_machine_fits_as_a_plain_one(spark):
    """Adagrad on the logistic loss, batch by batch in the same order, with each pair's product written out."""
    rng = np.random.default_rng(2)
    docs = [np.sort(rng.choice(6, rng.integers(0, 5), replace=False)) for _ in range(150)]
    toxic = np.array([float(0 in d and 1 in d) for d in docs])
    machine, plain = (toxicity.Machine(np.arange(6, dtype=np.int32), -1.0) for _ in range(2))
    machine.fit(docs, toxic, passes=2, steps=1)
    w, v, bias = plain.w.astype(float), plain.v.astype(float), plain.bias
    sums = [np.zeros_like(w), np.zeros_like(v), 0.0]
    order = np.random.default_rng(11)
    for _ in range(2):
        places = order.permutation(len(docs))
        for at in range(0, len(docs), toxicity.BATCH):
            gw, gv, gb, seen = np.zeros_like(w), np.zeros_like(v), 0.0, set()
            for d in places[at : at + toxicity.BATCH]:
                on = docs[d].tolist()
                margin = bias + sum(w[i] for i in on) + sum(float(v[i] @ v[j]) for k, i in enumerate(on) for j in on[k + 1 :])
                g = 1 / (1 + math.exp(-margin)) - toxic[d]
                gb, seen = gb + g, seen | set(on)
                for i in on:
                    gw[i] += g
                    gv[i] += g * sum((v[j] for j in on if j != i), np.zeros(toxicity.FACTORS))
            for i in seen:
                gw[i] += 1e-3 * w[i]
                gv[i] += 1e-3 * v[i]
                sums[0][i] += gw[i] ** 2
                sums[1][i] += gv[i] ** 2
                w[i] -= 0.05 * gw[i] / (sums[0][i] ** 0.5 + 1e-6)
                v[i] -= 0.05 * gv[i] / (np.sqrt(sums[1][i]) + 1e-6)
            sums[2] += gb**2
            bias -= 0.05 * gb / (sums[2] ** 0.5 + 1e-6)
    assert np.allclose(machine.w, w, atol=2e-3) and np.allclose(machine.v, v, atol=2e-3) and abs(machine.bias - bias) < 2e-3


def test_toxicity_of_odd_rows(spark):
    long = "word " * 200_000
    docs = table(spark, [(1, "you scum", "en"), (1, "all fine here", "en"), (2, "scum " * 3, "en"), (3, long, "en"), (4, "fine day", "en"), (5, None, None)])
    known = spark.createDataFrame([(i, int(i in (1, 2))) for i in range(1, 6)], "doc_id long, toxic int")
    machines = [toxicity.fit(d, known) for d in (docs, docs.orderBy(F.desc("text")))]
    scores = [[r.score for r in toxicity.score(docs.orderBy("doc_id", "text"), m).collect()] for m in machines]
    assert scores[0] == scores[1] and len(scores[0]) == 6 and all(0 <= x <= 1 for x in scores[0])
    clash = toxicity.score(docs, machines[0], keep=("doc_id", "score", "_text"))
    assert clash.columns == ["doc_id", "_text", "score"] and clash.count() == 6
    assert toxicity.score(docs.limit(0), machines[0]).count() == 0


def test_language_id_matches_plain_numpy(spark):
    rng = random.Random(6)
    rows = [(i, sample(rng, lang, 20 + i), lang) for i, lang in enumerate(list(LANGS) * 4)]
    docs = table(spark, rows)

    def bundle(text):
        out = np.zeros(langid.DIMENSIONS)
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        padded = " " + " ".join(letters.split()) + " "
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            if b != " ":
                code = [ord(x) if x != " " else 0 for x in (a, b, c)]
                out += np.roll(langid._letter(code[0]), 2).astype(float) * np.roll(langid._letter(code[1]), 1) * langid._letter(code[2])
        return out

    want = {lang: sum(bundle(t) for _, t, name in rows if name == lang) for lang in LANGS}
    prototypes = langid.fit(docs)
    assert all(np.allclose(prototypes[k], want[k]) for k in LANGS)
    for r in langid.predict(docs, prototypes, keep=("doc_id", "text", "score", "lang_pred") if "lang_pred" in docs.columns else ("doc_id", "text", "score")).collect():
        own = bundle(r.text)
        cosines = {k: own @ v / np.linalg.norm(own) / np.linalg.norm(v) for k, v in want.items()}
        assert r.lang_pred == max(cosines, key=cosines.get) and abs(r.score - max(cosines.values())) < 1e-5


def test_language_id_ties_lengths_and_empty_tables(spark):
    docs = table(spark, [(1, "abc abd", "zz"), (2, "abc abd", "yy"), (3, "other words", "xx")])
    prototypes = langid.fit(docs)
    got = langid.predict(table(spark, [(1, "abc", None), (2, "abc " * 300_000, None), (3, "Абв где", None)]), prototypes).collect()
    assert [r.lang_pred for r in got][:2] == ["yy", "yy"] and 0 <= got[2].score <= 1
    assert langid.predict(docs.limit(0), prototypes).count() == 0
    rows = [(i, score, "x" * n) for i, (score, n) in enumerate([(0.16, 5000), (0.13, 5000), (0.02, 3), (0.0, 3), (0.11, 200), (0.1, 200)])]
    judged = spark.createDataFrame(rows, "i int, score double, text string")
    kept = judged.filter(langid.accepted(F.lit("en"), F.col("score"), F.col("text"))).collect()
    assert [r.i for r in kept] == [0, 2, 4]
    assert judged.filter(langid.accepted(F.lit("und"), F.col("score"), F.col("text"))).count() == 0


def test_kept_columns_may_be_named_like_results(spark):
    docs = table(spark, [(1, "a b c", "en"), (2, None, None)]).withColumns({"ids": F.lit(5), "n_tokens": F.lit(1), "failed_bits": F.lit(9)})
    coded = pieces.encode_documents(docs, pieces.model_bytes(), keep=("doc_id", "ids", "_text"))
    assert coded.columns == ["doc_id", "_text", "ids", "decoded"] and coded.filter("_text = 'x'").count() == 2
    assert pieces.encode_documents(docs.limit(0), pieces.model_bytes()).count() == 0
    scored = lm.score(docs, lm.count(docs), keep=("doc_id", "score", "n_tokens", "_text"))
    assert scored.columns == ["doc_id", "_text", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert scored.filter("n_tokens > 0 AND score < 0 AND _text = 'x'").count() == 2


@pytest.mark.parametrize("n", [400, 1600])
def test_vector_search_recall_outside_the_fit(spark, monkeypatch, n):
    """The window is fitted on few vectors; recall is counted on all queries but those."""
    monkeypatch.setattr(neighbours, "SAMPLE", 12)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "SPAN", 256)
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(n // 20, 24))
    x = (centres[rng.integers(0, len(centres), n)] + 0.4 * rng.normal(size=(n, 24))).astype(np.float32)
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = neighbours.entries(t, F.col("vec_id") % 5 == 0, 5).cache()
    fitted = {r.ids[0] for r in found.orderBy(F.xxhash64("v")).limit(12).collect()}
    got = neighbours.search(t, F.col("vec_id") % 5 == 0, k=5, curves=8).toPandas()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, n, 5):
        if q not in fitted:
            s = u @ u[q]
            s[q] = -9
            hit += len(set(np.argsort(-s)[:5]) & set(got[got.query_id == q].vec_id))
            total += 5
    assert hit / total >= 0.9


def test_neighbours_of_vectors_of_any_size(spark):
    """Squares of these components leave the range of doubles; cosines do not."""
    rng = np.random.default_rng(8)
    plain = rng.normal(size=(40, 6))
    sizes = np.array([1e200, 1.0, 1e-200, 1e307])[np.arange(40) % 4]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(plain * sizes[:, None])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.search(t, F.col("vec_id") % 10 == 0, k=5).collect()}
    unit = plain / np.linalg.norm(plain, axis=1, keepdims=True)
    for q in range(0, 40, 10):
        cosines = unit @ unit[q]
        best = [i for i in np.argsort(-cosines, kind="stable") if i != q][:5]
        assert [got[q, k + 1][0] for k in range(5)] == best
        assert [got[q, k + 1][1] for k in range(5)] == pytest.approx(cosines[best])


def plain_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    found = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def test_fingerprints_against_a_plain_version():
    rng = random.Random(4)
    parts = ["a", "B", "Éa", "the", "x\x00y", "\x85", " ", "\x1c", "\U0001f600", " ", "\t", "\n", "\x0b", "  ", "THE end"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.choice([0, 1, 2, 5, 60]))) for _ in range(500)]
    assert [simhash.fingerprint(t) for t in [None, *texts]] == [plain_fingerprint(t) for t in [None, *texts]]
