"""Held-out accuracy of the learned operators, and what their methods promise."""

import numpy as np

from bedtide.llm import crf, queries, raking, toxicity
from pyspark.sql import functions as F


def test_language_held_out(spark, small_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    rows = [r for r in queries.op8_language(spark, small_dir).collect() if r.held_out]
    assert len(rows) > 20 and sum(truth[r.doc_id] == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_forward_backward_sums_over_all_paths():
    dice = np.random.default_rng(1)
    scores, moves, begin = dice.normal(size=(7, 3)), dice.normal(size=(3, 3)), dice.normal(size=3)
    firsts = np.array([0, 4, 4, 7])
    got, flow = crf.posteriors(scores, firsts, moves, begin)
    want, steps = np.zeros((7, 3)), np.zeros((3, 3))
    for a, b in zip(firsts[:-1], firsts[1:]):
        paths = np.array(np.meshgrid(*[range(3)] * (b - a))).reshape(b - a, -1).T if b > a else np.zeros((0, 0), int)
        mass = np.array([np.exp(begin[p[0]] + sum(scores[a + i, y] for i, y in enumerate(p)) + sum(moves[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        for p, m in zip(paths, mass / mass.sum() if len(mass) else mass):
            for i, y in enumerate(p):
                want[a + i, y] += m
            for x, y in zip(p, p[1:]):
                steps[x, y] += m
    assert np.allclose(got, want) and np.allclose(flow, steps)


def test_code_switches_are_found():
    french, english = "le chat mange une souris dans la maison verte", "the cat eats one mouse inside that green house"
    field = crf.fit([french] * 20 + [english] * 20, ["fr"] * 20 + ["en"] * 20)
    words = crf.Words([f"{english} {french}"])
    post, _ = crf.posteriors(words.scores(field["weights"])[words.types], words.firsts, field["moves"], field["begin"])
    best = [field["names"][i] for i in post.argmax(axis=1)]
    assert best == ["en"] * 9 + ["fr"] * 9


def syllables(n):
    return "".join(chr(97 + n // 26 ** k % 26) for k in range(2)) * 2


def test_every_label_is_learned(spark):
    rows = [(230 * j + i, f"{syllables(i)} {syllables(i)}ki {syllables(i)}{'xyz'[j]}", f"l{i:03}") for i in range(230) for j in range(3)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert len(crf.train(frame.select("text", F.col("lang").alias("label")), total=100)["names"]) == 230
    truth = {r[0]: r[2] for r in rows}
    got = crf.language(frame, spark.sparkContext.broadcast(crf.train(frame.select("text", F.col("lang").alias("label"))))).collect()
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.97 * len(rows)


def test_weights_of_own_features_and_slices(monkeypatch):
    texts, labels = ([x for i in range(30) for x in (f"{syllables(i)} {syllables(i)}ki", f"{syllables(i)}ra")], [f"l{i:02}" for i in range(30) for _ in range(2)])
    whole = crf.fit(texts, labels)
    monkeypatch.setattr(crf, "ENTRIES", 1)
    for name, value in crf.fit(texts, labels).items():
        assert name == "names" or np.allclose(*(x["weight"] if name == "weights" else x for x in (value, whole[name])), atol=1e-4)
    monkeypatch.setattr(crf, "WEIGHTS", 0)
    field = crf.fit(texts, labels)
    words = crf.Words(texts)
    post, _ = crf.posteriors(words.scores(field["weights"])[words.types], words.firsts, field["moves"], field["begin"])
    best = [field["names"][post[a:b].mean(axis=0).argmax()] for a, b in zip(words.firsts[:-1], words.firsts[1:])]
    assert len(field["weights"]) < len(whole["weights"]) / 3 and best == labels


def test_evenly_mixed_texts_stay(spark):
    import corpus_pipeline

    stretch = {f"l{i}": " ".join(syllables(40 * i + j) for j in range(20)) for i in range(6)}
    rows = [(100 * i + j, text, lang) for i, (lang, text) in enumerate(stretch.items()) for j in range(12)]
    rows += [(9000 + j, " ".join(stretch.values()), None) for j in range(3)] + [(9100, "123 !!", "l1")]
    frame = spark.createDataFrame([(*r, "a", len(r[1])) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, frame, "").collect()}
    assert kept == {r[0] for r in rows} - {9100}


def test_toxicity_learns(spark, small_dir):
    sf = small_dir.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op10_toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    right = [r.predicted == truth[r.doc_id] for r in rows]
    assert len(rows) > 30 and sum(right) >= 0.93 * len(right)


def test_neutral_mentions_are_not_flagged():
    dice = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    line = lambda *extra: " ".join([*dice.choice(words, 8), *extra])
    # In the labelled sentences one group is mentioned almost only by insults: the plain classifier learns its name.
    toxic = [line("muslim", "vermin") if i % 2 else line("muslim", "filth") for i in range(80)] + [line("vermin") for _ in range(40)] + [line("filth") for _ in range(40)]
    clean = [line() for _ in range(150)] + [line("christian") for _ in range(10)]
    texts, labels = toxic + clean, np.array([1] * len(toxic) + [0] * len(clean))

    def change(swap_weight):
        model = toxicity.fit(texts, labels, np.ones(len(texts)), swap_weight)
        weights = np.zeros(toxicity.BUCKETS)
        weights[model["at"]] = model["weights"]
        score = lambda t: weights[toxicity.features([t])[1]].sum() + model["bias"]
        return abs(score("a muslim neighbour") - score("a christian neighbour")), score("you vermin filth"), score("a muslim neighbour")

    plain, regular = change(0.0), change(5.0)
    assert regular[0] < 0.2 * plain[0] and regular[1] > 0 > regular[2]


def test_rare_and_many_toxic_words_get_weights():
    # 4 of 600 toxic texts have the rare word, and 1500 further words tell the classes apart.
    word = lambda n: "".join(chr(97 + n // 26 ** k % 26) for k in range(3))
    toxic = [" ".join(word((15 * i + j) % 1500) for j in range(15)) + (" qzjk" if i < 4 else "") for i in range(600)]
    texts, labels = toxic + [f"{word(2000 + i % 300)} talk" for i in range(6000)], np.array([1] * 600 + [0] * 6000)
    model = toxicity.fit(texts, labels, np.ones(len(texts)))
    learned = dict(zip(model["at"].tolist(), model["weights"].tolist()))
    assert learned.get(int(toxicity.features(["qzjk"])[1][0]), 0) > 0 and sum(w != 0 for w in learned.values()) > 1000


def test_features_are_ranked_by_all_labelled_texts(spark):
    # A sample of about 20 texts of each class; every copy of a text or row counts once for its class.
    rows = [(i, f"word{i} talk" + (" qzj" if i % 4 == 0 else ""), int(i % 2 == 0)) for i in range(400)] + [(1000 + i, "same talk qzj", 0) for i in range(300)] + [(0, "word0 talk qzj", 1)] * 3
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    seen, true_screen = [], toxicity.screened
    toxicity.screened = lambda found, sizes: seen.append((found, sizes)) or true_screen(found, sizes)
    try:
        toxicity.train(frame.select("doc_id", "text"), frame.select("doc_id", "label").distinct(), 20)
    finally:
        toxicity.screened = true_screen
    (found, sizes), at = seen[0], int(toxicity.features(["qzj"])[1][0])
    assert sizes == (201, 200) and found[:, at].tolist() == [1, 100]


def test_swaps():
    assert "Three men and a christian man" in [s for s in toxicity.swaps("Three women and a christian man")]
    assert toxicity.swaps("nothing here") == []


def test_marginals_are_met(spark, small_dir):
    mixed = raking.mix(spark.read.parquet(f"{small_dir}/documents.parquet"))
    total = mixed.agg(F.sum("tokens")).first()[0]
    for margin in raking.MARGINS:
        rows = mixed.groupBy(margin).agg(F.sum("tokens").alias("own"), F.sum(F.col("tokens") * F.col("weight")).alias("mass")).collect()
        aims = {r[margin]: r.own ** raking.TEMPER[margin] for r in rows if r.own}
        for r in rows:
            assert abs(r.mass / total - aims.get(r[margin], 0) / sum(aims.values())) < 1e-7


def test_margins_are_summed_before_they_are_shuffled(spark, monkeypatch):
    plans, written = [], raking.materialise
    monkeypatch.setattr(raking, "materialise", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df))
    cells = spark.createDataFrame([(f"s{i // 4}", "en" if i % 2 else "fr", "prose" if i // 2 % 2 else "marks", i) for i in range(90)], "source string, lang string, topic string, tokens bigint")
    aims = {m: written(raking.tempered_targets(cells, m, 0.5)) for m in raking.MARGINS}
    raked = raking.rake(cells, aims)
    for margin in raking.MARGINS:
        want = {r.value: r.share * sum(range(90)) for r in aims[margin].collect()}
        got = {r[margin]: r.mass for r in raked.groupBy(margin).agg(F.sum(F.col("tokens") * F.col("weight")).alias("mass")).collect()}
        assert all(abs(got[v] - x) < 1e-5 for v, x in want.items())
    assert plans and not any("Window" in p for p in plans) and any("partial_sum" in p for p in plans) and max(map(len, plans)) < 20000


def test_rows_without_id_have_draws_of_their_own(spark):
    rows = [(None, f"text {i} of many", "en", "a" if i % 2 else "b", 9) for i in range(400) for _ in range(2)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    share = lambda **x: spark.createDataFrame(list(x.items()), "value string, share double")
    got = raking.mix(frame, {"source": share(a=1.0, b=3.0), "lang": share(en=1.0), "topic": share(prose=1.0)}, carry=("text",)).where("source = 'a'").collect()
    by_text = {}
    for r in got:
        by_text.setdefault(r.text, set()).add(r.sampled)
    assert all(len(s) == 1 for s in by_text.values()) and 60 < sum(True in s for s in by_text.values()) < 140


def test_given_targets(spark):
    rows = [(i, "one two three", "en" if i % 3 else "fr", "a" if i % 2 else "b", 13) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, n_chars int")
    share = lambda **x: spark.createDataFrame(list(x.items()), "value string, share double")
    mixed = raking.mix(frame, {"source": share(a=1.0, b=3.0), "lang": share(en=0.5, fr=0.5, xx=0.7), "topic": share(prose=2.0)})
    got = {(r.source, r.lang): r.m for r in mixed.groupBy("source", "lang").agg(F.sum(F.col("weight") * F.col("tokens")).alias("m")).collect()}
    assert abs(sum(v for (s, _), v in got.items() if s == "b") - 270) < 1e-4
    assert abs(sum(v for (_, c), v in got.items() if c == "fr") - 180) < 1e-4
    assert all(r.sampled for r in mixed.where("weight >= 1").collect()) and 0 < mixed.where("sampled").count() < 120
