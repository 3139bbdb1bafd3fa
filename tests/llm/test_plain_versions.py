"""Operators and the pipeline's stages, whole, against plain versions."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from arborel.llm import hmm, langid, minhash, mixing, pii, shingles, topics, toxicity
from arborel.llm.minhash import keep_one
from arborel.llm.packing import pack

WORDS = [a + b for a in ("the", "ou", "er", "sh", "que") for b in ("ti", "on", "re", "xa", "mo", "li", "pa", "nu")]
TOKEN = re.compile(rb"[^\x20\x09-\x0d]+")


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ---------------------------------------------------------------- language model


def check_language_model(got, texts, held_out, models):
    """Rows of hmm.score against one step for each token, with the model that was trained."""
    m = models[-1]
    words = lambda t: [*TOKEN.findall((t or "").encode().lower()), hmm.END]
    counts = Counter(w for i, t in texts.items() if not held_out(i) for w in words(t))
    mass = np.ones(hmm.CLASSES + 1)
    for w, c in counts.items():
        mass[hmm.word_class(w)] += c + 1
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(texts)
    for r in got:
        own = words(texts[r.doc_id])
        total, state = 0.0, m["start"]
        for t, w in enumerate(own):
            k = hmm.word_class(w)
            state = (state if t == 0 else state @ m["trans"]) * m["emit"][:, k]
            total += math.log10(state.sum()) + math.log10((counts[w] + 1) / mass[k])
            state = state / state.sum()
        assert math.isclose(r.score, total, rel_tol=1e-9) and (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in counts for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9) and r.held_out == held_out(r.doc_id)


def test_language_model_score_is_the_plain_forward_sum(spark, monkeypatch):
    """Also of texts that are cut into lanes."""
    rng = random.Random(2)
    rows = [(i, text(rng, rng.randint(0, 40)) or None) for i in range(120)] + [(500, "unseen words ONLY"), (501, "the " * 9000), (502, text(rng, 5000))]
    models = []
    trained = hmm.trained
    monkeypatch.setattr(hmm, "trained", lambda *a: models.append(trained(*a)) or models[-1])
    got = hmm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 7 == 2, states=3, known_words=10).collect()
    check_language_model(got, dict(rows), lambda i: i % 7 == 2, models)


def test_lanes_give_the_sums_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(3)
    model = hmm.initial(rng.uniform(1, 5, hmm.CLASSES + 1), 4)
    codes = [rng.integers(0, hmm.CLASSES + 1, n).astype(np.uint16) for n in (1, 60, 500, 7, 14, 0, 21, 333)]
    whole = hmm.Chains(codes)
    want, logp = whole.expected(model), whole.log_likelihood(model)
    for cut, lane, block in ((20, 7, 50), (6, 7, 10_000), (20, 1, 13)):
        monkeypatch.setattr(hmm, "CUT", cut)
        monkeypatch.setattr(hmm, "LANE", lane)
        monkeypatch.setattr(hmm, "BLOCK", block)
        got = hmm.Chains(codes)
        assert max(map(len, got.rows)) <= max(cut, lane) and np.allclose(got.log_likelihood(model), logp, rtol=1e-10)
        assert all(np.allclose(x, want[k], rtol=1e-9, atol=1e-12) for k, x in got.expected(model).items())


def test_one_long_text_takes_about_as_long_as_many_short_ones():
    rng = np.random.default_rng(4)
    model = hmm.initial(rng.uniform(1, 5, hmm.CLASSES + 1), hmm.STATES)
    tokens = rng.integers(0, hmm.CLASSES, 400_000).astype(np.uint16)

    def seconds(codes):
        began = time.perf_counter()
        hmm.Chains(codes).expected(model)
        return time.perf_counter() - began

    assert min(seconds([tokens]) for _ in range(3)) < 5 * min(seconds(list(tokens.reshape(1000, 400))) for _ in range(3))


# ---------------------------------------------------------------- toxicity


def plain_toxicity(m, t):
    """Score and marginals of one text by the recursions, one token at a time."""
    f = toxicity.tokens([(t or "").encode()])["features"]
    e = np.clip(m["w"][f].sum(1, dtype=float), -30, 30)
    A, p = np.exp(m["trans"]), np.zeros(len(e))
    if len(e):
        ahead = [np.exp(m["start"]) * np.exp([0, e[0]])]
        for x in e[1:]:
            ahead.append(ahead[-1] / ahead[-1].sum() @ A * np.exp([0, x]))
        back = [np.ones(2)]
        for x in e[:0:-1]:
            b = A @ (np.exp([0, x]) * back[-1])
            back.append(b / b.sum())
        p = np.array([(a * b)[1] / (a * b).sum() for a, b in zip(ahead, reversed(back), strict=True)])
    most = min(max(p.max(initial=0), 1e-5), 1 - 1e-5)
    z = math.log(most / (1 - most)) * m["top"][0] + math.log1p(p[p >= 0.1].sum()) * m["top"][1] + m["bias"]
    return 1 / (1 + math.exp(-z)), p


@pytest.fixture(scope="module")
def toxic_rows():
    rng = random.Random(3)
    rows = []
    for i in range(400):
        w = text(rng, 40).split(" ")
        if i % 5 == 0:
            for _ in range(4):
                w[rng.randrange(40)] = "grob" + rng.choice(WORDS)
        rows.append((i, "é, " + " ".join(w), int(i % 5 == 0)))
    return rows


def test_toxicity_scores_and_offsets_are_the_plain_ones(spark, toxic_rows):
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic_rows if i % 2 == 0], "doc_id long, toxic int")
    odd = [(900, None), (901, ""), (902, "!"), (903, "grobti ß grobre grobon"), (904, "ß" * 9 + " grobti")]
    df = spark.createDataFrame([*((i, t) for i, t, _ in toxic_rows), *odd], "doc_id long, text string")
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    for i, t in [*((i, t) for i, t, _ in toxic_rows), *odd]:
        score, p = plain_toxicity(model, t)
        assert math.isclose(got[i].score, score, abs_tol=1e-6) and got[i].predicted == (score >= 0.3)
        want, last = [], None
        for m, x in zip(re.finditer(r"[A-Za-z0-9\u0080-\U0010ffff]+", t or ""), p, strict=True):
            if x >= 0.5:
                want = [*want[:-1], (want[-1][0], m.end())] if last else [*want, m.span()]
            last = x >= 0.5
        assert list(zip(got[i].span_starts, got[i].span_ends, strict=True)) == want


def test_long_labelled_texts_are_learned_from(spark, monkeypatch, toxic_rows):
    """The only toxic words are in texts longer than a chain."""
    monkeypatch.setattr(toxicity, "CHAIN_TOKENS", 30)
    df = spark.createDataFrame([(i, t) for i, t, _ in toxic_rows], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([(i, y) for i, _, y in toxic_rows], "doc_id long, toxic int"))
    got = {r.doc_id: r.predicted for r in toxicity.score(df, model).collect()}
    assert sum(got[i] == y for i, _, y in toxic_rows) >= 398
    monkeypatch.setattr(toxicity, "SAMPLE_TOKENS", 10)
    assert toxicity.fit(df, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")) is not None


def test_long_texts_by_stretches():
    parts = ["Wort%d" % i for i in range(60_000)]
    whole = (" ".join(parts) + " " + "x" * 2_500_000 + " y z").encode() * 2
    blank = np.frombuffer(b" " + whole + b" ", np.uint8) == 32
    found = shingles.stretches(blank, 1 << 16)
    assert found[0][0] == 0 and found[-1][1] == len(blank) - 1 and all(a[1] == b[0] for a, b in zip(found[:-1], found[1:], strict=True))
    assert all(blank[a] and blank[b] for a, b in found) and len(found) > 10
    of, h = shingles.word_hashes([b"a", whole, b"b"])
    alone = {w: int(shingles.word_hashes([w])[1][0]) for w in set(whole.split())}
    assert h[1:-1].tolist() == [alone[w] for w in whole.split()] and of[0] == 0 and of[-1] == 2
    t = toxicity.tokens([b"a", whole])
    assert [whole[a:b] for a, b in zip(t["start"][1:], t["end"][1:], strict=True)] == whole.split()
    assert (t["features"][1:1000] == np.concatenate([toxicity.tokens([w])["features"] for w in whole.split()[:999]])).all()


# ---------------------------------------------------------------- languages


def plain_language(model, t):
    raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in ("  " + t + "    ").encode())
    z, n = np.zeros(len(model["langs"])), 0
    for a in range(len(raw) - 3):
        for order in (2, 3, 4):
            g = raw[a : a + order]
            if g.count(32) > 1 or a >= len(raw) - 4 - 1 + 2:
                continue
            h = 0x9E3779B1 * order & 0xFFFFFFFF
            for b in g:
                h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
            h ^= h >> 15
            z, n = z + model["P"][(h * 0x85EBCA6B & 0xFFFFFFFF) >> 17], n + 1
    z = (z / max(n, 1) + model["b"]) * model["t"]
    p = np.exp(z - z.max())
    return model["langs"][int(p.argmax())], float(p.max() / p.sum())


def test_languages_are_those_of_a_plain_version(spark):
    rng = random.Random(5)
    made = [(i, text(rng, 30) if i % 2 else " ".join(rng.choice(["eau", "oû", "aire"]) + rng.choice(["é", "ment", "ch"]) for _ in range(30)), "en" if i % 2 else "fr") for i in range(200)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = langid.fit(df)

    for r in langid.predict(df.select("doc_id", "text"), model).where("doc_id < 40").collect():
        lang, score = plain_language(model, made[r.doc_id][1])
        assert r.lang_pred == lang and abs(r.score - score) < 0.02


def test_scores_keep_columns_of_any_name(spark, toxic_rows):
    df = spark.createDataFrame([(i, t, i) for i, t, _ in toxic_rows], "doc_id long, text string, `a.b` int").withColumns({"c`d": F.lit("x"), "score": F.lit("old"), "_text": F.lit(2)})
    model = toxicity.fit(df, spark.createDataFrame([(i, y) for i, _, y in toxic_rows], "doc_id long, toxic int"))
    got = toxicity.score(df, model)
    assert got.columns == ["doc_id", "a.b", "c`d", "_text", "score", "predicted", "span_starts", "span_ends"]
    assert all(r[0] == r[1] and r[2] == "x" and r[3] == 2 and 0 <= r[4] <= 1 for r in got.collect())
    assert toxicity.score(df, model, spans=False).columns == got.columns[:6]
    assert toxicity.clean(df, model).columns == df.columns and toxicity.clean(df, None).count() == df.count()
    of = df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "p").otherwise("q"))
    found = langid.predict(of, langid.fit(of))
    assert found.columns == ["doc_id", "a.b", "c`d", "_text", "lang", "lang_pred", "score", "accepted"]
    assert all(r[0] == r[1] and r.lang_pred in ("p", "q") for r in found.collect())


def test_many_languages_are_joined(spark, monkeypatch):
    rows = [(i, text(random.Random(i), 9), f"l{i % 40}") for i in range(200)] + [(None, "x y z", "l1"), (300, None, "l2"), (301, "", "l3"), (302, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = langid.fit(df)
    monkeypatch.setattr(langid, "HELD_LANGUAGES", 3)
    got = langid.fit(df)
    assert want["langs"] == got["langs"] == sorted({f"l{i}" for i in range(40)}) and (want["P"] == got["P"]).all()


# ---------------------------------------------------------------- mixing


def plain_raking(tokens, keys, exponents, kept):
    """Bounded raking with dictionaries: tokens of cells by their keys."""
    total, now = sum(tokens.values()), {c: t * kept for c, t in tokens.items()}
    goals = []
    for k, x in enumerate(exponents):
        t = Counter()
        for c, n in tokens.items():
            t[c[k]] += n
        low, high = 0.0, 1e9
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(n, mid * n**x) for n in t.values()) < kept * total else (low, mid)
        goals.append({v: min(n, high * n**x) for v, n in t.items()})
    for _ in range(300):
        for k, goal in enumerate(goals):
            sums = Counter()
            for c, n in now.items():
                sums[c[k]] += n
            now = {c: min(tokens[c], n * goal[c[k]] / sums[c[k]]) if sums[c[k]] else 0.0 for c, n in now.items()}
    return now, goals


def plain_topic(model, t):
    """The largest sum of a text's words over the topics' weights."""
    z = np.zeros(0 if model is None else model["centres"].shape[1])
    for w in TOKEN.findall((t or "").encode()):
        z = z + (model["centres"][int(shingles.word_hashes([w])[1][0]) % topics.DIMS] if len(z) else 0)
    return f"t{int(z.argmax())}" if len(z) and z.max() > 0 else topics.NO_TOPIC


def plain_mixing(rows, model):
    """Of rows (id, text, source, lang): (cell, tokens, probability, draw) of each, by plain raking."""
    cells = [(s or mixing.NONE, g or mixing.NONE, plain_topic(model, t)) for _, t, s, g in rows]
    size = [len(TOKEN.findall((t or "").encode())) for _, t, _, _ in rows]
    tokens = Counter()
    for c, n in zip(cells, size, strict=True):
        tokens[c] += n
    now, _ = plain_raking({c: n for c, n in tokens.items() if n}, None, (0.7, 0.8, 0.9), 0.7)
    draw = lambda i: xxhash.xxh64(b"mix", seed=xxhash.xxh64(b"" if i is None else str(i).encode(), seed=42).intdigest()).intdigest() % (1 << 30) / (1 << 30)
    return [(c, n, now[c] / tokens[c] if tokens[c] else 0.0, draw(i)) for (i, *_), c, n in zip(rows, cells, size, strict=True)]


def test_topics_are_clusters_of_words(spark):
    rng = random.Random(12)
    lists = [[f"{k}{i}" for i in range(60)] for k in "abc"]
    rows = [(i, " ".join([*rng.choices(lists[i % 3], k=30), *["common"] * 5])) for i in range(300)] + [(900, None), (901, ""), (902, " \n"), (903, "common"), (904, "absent")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, topic int, `a.b` string").repartition(3)
    model = topics.fit(df, topics=3)
    got = topics.with_topics(df, model)
    assert got.columns == ["doc_id", "text", "a.b", "n_tokens", "topic"] and topics.with_topics(df, model, keep_text=False).columns == ["doc_id", "a.b", "n_tokens", "topic"]
    found = {r.doc_id: r for r in got.collect()}
    assert {i: r.topic for i, r in found.items()} == {i: plain_topic(model, t) for i, t in rows}
    assert all(len({found[i].topic for i in range(k, 300, 3)}) == 1 for k in range(3)) and len({found[i].topic for i in range(3)}) == 3
    assert [found[i].topic for i in (900, 901, 902)] == [topics.NO_TOPIC] * 3 and [found[i].n_tokens for i in (900, 903, 0)] == [0, 1, 35]
    assert topics.fit(df.where("doc_id in (900, 901)")) is None and topics.fit(df.where("false")) is None
    assert {r.topic for r in topics.with_topics(df, None).collect()} == {topics.NO_TOPIC}
    assert topics.train([(np.array([1]), np.array([2]))] * 3) is None


@pytest.mark.parametrize("held", [mixing.HELD_CELLS, 0])
def test_bounded_mixing_is_plain_raking_and_its_sample_meets_the_targets(spark, monkeypatch, held):
    monkeypatch.setattr(mixing, "HELD_CELLS", held)
    monkeypatch.setattr(mixing, "CLOSE", 1e-2 if held == 0 else 1e-6)
    rng = random.Random(7)
    sources, langs = ["hot"] * 12 + ["b"] * 5 + ["c"] * 3 + [None], ["en"] * 6 + ["fr"] * 2 + ["de"]
    rows = [(i, text(rng, rng.randint(1, 60)) if i % 97 else None, rng.choice(sources), rng.choice(langs)) for i in range(4000)]
    targets = {"source": 0.6, "lang": 0.8}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("weight", F.lit("x")), targets=targets, kept_tokens=0.6, bounded=True).collect()
    cell = lambda s, g: (s or mixing.NONE, g)
    tokens = Counter()
    for _, t, s, g in rows:
        tokens[cell(s, g)] += len((t or "").split())
    now, goals = plain_raking(tokens, None, (0.6, 0.8), 0.6)
    near = 0.02 if held == 0 else 1e-4
    assert len(got) == len(rows) and all(r.weight == 1 for r in got)
    assert all(abs(r.probability - now[cell(r.source, r.lang)] / tokens[cell(r.source, r.lang)]) < near for r in got)
    kept = Counter()
    for r in got:
        if r.sampled:
            kept[r.source or mixing.NONE] += r.n_tokens
    assert all(abs(kept[v] / goal - 1) < 0.1 for v, goal in goals[0].items())
    assert abs(sum(kept.values()) / sum(tokens.values()) - 0.6) < 0.02


def test_targets_that_exclude_each_other_give_a_warning(spark):
    df = spark.createDataFrame([(1, "a b", "s", "x"), (2, "a b", "t", "y")], "doc_id long, text string, source string, lang string")
    with pytest.warns(UserWarning, match="raking"):
        assert mixing.mix(df, targets={"source": {"s": 1.0, "t": 3.0}, "lang": {"x": 3.0, "y": 1.0}}, rounds=3).count() == 2


# ---------------------------------------------------------------- packing


def test_step_groups_are_full(spark):
    import public_tokenizers

    rng = random.Random(8)
    rows = [(i, text(rng, rng.choice([3, 20, 90, 400, 3000]))) for i in range(500)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), public_tokenizers.path("word_bpe_49k.json"), group_windows=4).collect()
    ids, tiers = Counter(), {}
    for r in got:
        ids[r.step_group] += r.length
        tiers.setdefault(r.sequence_id, set()).add((r.step_group, r.tier))
    assert all(len(x) == 1 for x in tiers.values())
    tasks = {g >> 33 for g in ids}
    assert sum(n != 4 * 4096 for n in ids.values()) <= len(tasks) and all(n <= 4 * 4096 for n in ids.values()) and len(ids) > 2 * len(tasks)


# ---------------------------------------------------------------- personal data


def test_columns_of_any_name_and_many_spans(spark):
    rows = [(1, "mail a.b@c.de now", 5, "y"), (2, None, 6, None), (3, "bob.42@mail8.example.com, " * 4_000, 7, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found int, base string").withColumns({c: F.lit("k") for c in ("_t", "c0", "_base", "kind")})
    model = pii.fit(df)
    out = pii.find(df, model)
    assert sorted(out.columns) == sorted(df.columns)
    found = {r.doc_id: r for r in out.collect()}
    assert [tuple(x) for x in found[1].base] == [("email", 5, 13)] and found[2].found == [] and len(found[3].base) == 4_000 and found[3].c0 == "k"
    clean = {r.doc_id: r for r in pii.redact(df, model, size_col="found").collect()}
    assert pii.redact(df, model).dtypes == df.dtypes
    assert (clean[1].text, clean[1].base, clean[1].found) == ("mail [email] now", "y", 16) and clean[2].text is None and clean[2].found == 6
    assert clean[3].text == "[email], " * 4_000


# ---------------------------------------------------------------- pipeline


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found int, base string, topic string, score double, probability string, `a.b` int, `c``d` string, _nth int"


def test_stages_are_the_plain_ones_on_hard_rows(spark, tmp_path, toxic_rows):
    rng = random.Random(11)
    base = [text(rng, rng.randint(20, 80)) for _ in range(40)]
    texts = [*(t for _, t, _ in toxic_rows[:120]), *base, *base[:10], *(b + " mo" for b in base[10:20]), "x a.b@c.de y", None, "", " ", text(rng, 9000)]
    rows = [(1000 + i, t, rng.choice(["en", None]), rng.choice(["s", "t", None]), len(t or ""), i, "b", rng.choice(["p", None]), 0.5, "q", i, "d", 7) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (rows[4][0], "another text for one id", *rows[4][2:]), (None, "no id", "en", "s", 5, 1, "b", "p", 0.5, "q", None, None, 7)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(1000 + i, y) for i, (_, _, y) in enumerate(toxic_rows[:120])] + [(None, 1)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    sf, columns = str(tmp_path), docs.dtypes
    taken = lambda df: spark.createDataFrame(df.collect(), docs.schema)

    model = toxicity.fit(docs, labels)
    one = taken(corpus_pipeline.without_toxic(spark, docs, sf))
    assert one.dtypes == columns and Counter(map(tuple, one.collect())) == Counter(r for r in rows if plain_toxicity(model, r[1])[0] < 0.3)

    two = taken(corpus_pipeline.without_copies(spark, one, sf))
    sets = {}
    for r in one.collect():
        w = TOKEN.findall((r.text or "").encode().lower())
        if r.doc_id is not None:
            sets.setdefault(r.doc_id, []).append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    low = {i: i for i in sets}
    for _ in range(6):
        for a in sets:
            for b in sets:
                if any(x & y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    kept = two.collect()
    assert two.dtypes == columns and Counter(r.doc_id for r in kept) == Counter([i for i in low if low[i] == i] + [None])
    first = {}
    for r in one.collect():
        if r.doc_id is not None:
            first[r.doc_id] = min(first.get(r.doc_id, r), r, key=lambda x: (x.text is not None, x.text or ""))
    assert all(r.text == first[r.doc_id].text for r in kept if r.doc_id is not None)

    three = taken(corpus_pipeline.without_personal_data(spark, two, sf))
    before, after = ({r.doc_id: r for r in df.collect()} for df in (two, three))
    assert three.dtypes == columns and before.keys() == after.keys()
    for i, r in after.items():
        want = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[email]", before[i].text) if before[i].text else before[i].text
        assert r.text == want and r.n_chars == (len(want) if want != before[i].text else before[i].n_chars) and r.found == before[i].found

    four = taken(corpus_pipeline.mixed(spark, three, sf))
    kept = three.collect()
    plain = plain_mixing([(r.doc_id, r.text, r.source, r.lang) for r in kept], topics.fit(three))
    sure = [(r, draw < p) for r, (_, _, p, draw) in zip(kept, plain, strict=True) if abs(draw - p) > 1e-3]
    sampled = Counter(map(tuple, four.collect()))
    assert four.dtypes == columns and len(sure) > 0.9 * len(kept) and all((tuple(r) in sampled) == taken for r, taken in sure)
    assert sum(sampled.values()) <= sum(taken for _, taken in sure) + len(kept) - len(sure) and {taken for _, taken in sure} == {True, False}

    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in corpus_pipeline.packed(spark, four, sf).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for r in four.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        mine = sorted(pieces[r.doc_id], key=lambda x: x.start)
        assert sum(x.length for x in mine) == len(ids)
        assert all(x.ids_crc32 == zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes()) for x in mine)


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0 and docs.dtypes == spark.createDataFrame([], SCHEMA).dtypes
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_one_of_the_rows_of_an_id_stays_whatever_their_order(spark):
    rows = [(1, "b c", "x"), (1, "a c", "z"), (1, "a c", "y"), (2, None, "q")]
    for order in (rows, rows[::-1]):
        got = keep_one(spark.createDataFrame(order, "doc_id long, text string, extra string").repartition(2)).collect()
        assert sorted(map(tuple, got)) == [(1, "a c", "y"), (2, None, "q")]


# ---------------------------------------------------------------- near duplicates


def test_a_chain_of_documents_takes_work_in_proportion(spark, monkeypatch):
    """2,000 documents, each near the next only: one component, by a few pairs of each document and no blocks of all."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2000 * 8 + 200)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 100])) for i in range(2000) if i not in (700, 701)] + [(5000, " ".join(reversed(words)))]
    seen = {}
    for name in ("_asked_pairs", "_rest_links"):
        made = getattr(minhash, name)
        monkeypatch.setattr(minhash, name, lambda df, s, name=name, made=made: seen.update({name: (df.count(), made(df, s).count())}) or made(df, s))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=4).collect()}
    assert got == {i: 0 if i < 700 else 5000 if i == 5000 else 702 for i, _ in rows}
    assert 1_900 < seen["_asked_pairs"][1] < 2_000 * 10 and seen["_rest_links"][0] == 0


@pytest.mark.parametrize("block", [minhash.KEY_BLOCK, 5])
def test_dense_families_go_by_blocks_and_lose_no_link(spark, monkeypatch, block):
    """Texts of one template: most are close to all others, few are linked."""
    monkeypatch.setattr(minhash, "KEY_BLOCK", block)
    rng = random.Random(10)
    form = [text(rng, 60) for _ in range(4)]
    rows = []
    for i in range(160):
        w = form[i % 4].split(" ")
        for _ in range(rng.choice([1, 2, 4, 5])):
            w[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split(" ")[j : j + 4]) for j in range(57)} for _, t in rows]
    low = list(range(160))
    for _ in range(8):
        for a in range(160):
            for b in range(160):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == dict(enumerate(low)) and 4 < len(set(low)) < 150
