"""The registered queries of the corpus operators against their contracts, and the pipeline against brute force."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.test_operators import BYTES, SCHEMA, WORDS, components_of, contaminated, corpus, removed, tokens

SMALL = "/root/testdata/sf0.01"
ITEMS = [(1, None), (2, "one"), (3, "ONE. two"), (7, "again other"), (10, "  ")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables: the odd corpus without its repeated row and null id, items, labels."""
    folder = tmp_path_factory.mktemp("tables")
    rows = [r for r in corpus(5, 70) if r[0] is not None][:-1]
    rows += [(1000, " ".join(f"w{i % 700}" for i in range(30_000)), *rows[0][2:]), (2000, "éß " * 4000, *rows[0][2:])]
    items = [*ITEMS, (5, " ".join(rows[7][1].split()[5:30])), (6, rows[14][1])]
    labels = [(r[0], i % 2, i % 3 // 2) for i, r in enumerate(rows[:60])]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, items


@pytest.fixture(scope="module")
def ask(spark, tables):
    from plumbline.llm.queries import QUERIES

    return lambda name: [r.asDict() for r in next(f for n, f in QUERIES.items() if n.split("_")[0] == name)(spark, tables[0]).collect()]


def ids_of(path, text, end):
    return np.array([*tokens(path, text), end], "<u4")


def test_op1_query(ask, tables):
    got = ask("op1")
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {r[0]: (len((r[1] or "").encode()), n := len(tokens(BYTES, r[1])), n > 1024) for r in tables[1]}
    assert any(r["n_chunks"] > 1 for r in got) and len(got) == len(tables[1])


def test_op2_query(ask, tables):
    wanted = {(doc, n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0) for doc, n, hit, items in contaminated(tables[1], tables[2])}
    assert {tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in ask("op2")} == wanted


def test_op3_query(ask, tables):
    got = ask("op3")
    texts = {r[0]: (r[1] or "").encode() for r in tables[1]}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in texts.items()} and len(got) == len(texts)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(i, [])) for i in range(24)]
    assert max(sizes) - min(sizes) <= 1 and {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_op4_query(ask, tables):
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in ask("op4")} == {i: (n, c, i == c) for i, (n, c) in components_of(tables[1], 4).items()}


def packed_well(got, rows, end=1):
    """Pieces cover each document's ids once, in order; sequences are gapless and hold 2048 ids at most."""
    whole = defaultdict(list)
    for doc, text in rows:
        whole[doc].append(ids_of(BYTES, text, end))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(whole)
    for doc, own in pieces.items():
        assert len(whole[doc]) > 1 or sorted(r["start"] for r in own) == np.cumsum([0] + [r["length"] for r in sorted(own, key=lambda r: r["start"])])[:-1].tolist()
        assert sum(r["length"] for r in own) == sum(map(len, whole[doc]))
        spans = {(len(w), s, n): zlib.crc32(w[s : s + n].tobytes()) for w in whole[doc] for s, n in {(r["start"], r["length"]) for r in own}} if len(whole[doc]) == 1 else {}
        assert all(spans[r["doc_tokens"], r["start"], r["length"]] == r["ids_crc32"] for r in own if spans)
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert 0 < at <= 2048
    assert sum(r["length"] for r in got) > 0.85 * 2048 * (len(windows) - 1)


def test_op5_query(ask, tables):
    packed_well(ask("op5"), [r[:2] for r in tables[1]])


@pytest.mark.parametrize(("name", "modulus", "remainder", "cut"), [("op6", 4, 2, 0.7), ("op8", 5, 0, 0.5)])
def test_classifier_queries(ask, tables, name, modulus, remainder, cut):
    got = ask(name)
    assert len(got) == len(tables[1]) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= cut) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder) for r in got)
    by_text = defaultdict(set)
    for r in got:
        by_text[dict((x[0], x[1]) for x in tables[1])[r["doc_id"]]].add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())  # ties: equal texts score alike


def test_op7_query(ask, tables):
    order = sorted(((r[0], r[1] or "") for r in tables[1]), reverse=True)
    got = {r["doc_id"]: r for r in ask("op7")}
    assert len(got) == len(order)
    for (doc, text), (following, other) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and (text != other or (r["near_next"] == 1 and r["fingerprint"] == got[following]["fingerprint"]))


def test_op9_query(ask, tables):
    start, wanted = 0, []
    for doc, text in sorted(r[:2] for r in tables[1]):
        ids = ids_of(WORDS, text, 2)
        wanted.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in ask("op9")) == wanted


def test_op10_query(ask, tables):
    wanted = {(doc, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for doc, n, gone, kept in removed(tables[1], 35)}
    assert {tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in ask("op10")} == wanted


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize(("name", "label", "least"), [("op6_quality", "quality", 0.9), ("op8_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    """Balanced accuracy on the labelled documents of the fold that wasn't learned from."""
    from plumbline.llm.queries import QUERIES

    scored = QUERIES[name](spark, SMALL).where("held_out").join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").select("predicted", label).collect()
    right = [np.mean([r["predicted"] == y for r in scored if r[label] == y]) for y in (0, 1)]
    assert len(scored) > 50 and np.mean(right) >= least


def test_bradley_terry_is_at_its_optimum():
    """The loss of the fit has no slope left, and another solver comes to the same scores."""
    from plumbline.llm import quality

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, len(quality.FEATURES)))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=300) > 0).astype(int)
    model = quality.fit(x, y, pairs=2000, seed=5)
    z = np.clip((x - model.middle) / model.spread, -6, 6)
    z = np.concatenate([z, z * z], axis=1)
    same = np.random.default_rng(5)
    d = z[same.choice(np.flatnonzero(y == 1), 2000)] - z[same.choice(np.flatnonzero(y == 0), 2000)]
    slope = lambda w: d.T @ (1 / (1 + np.exp(-d @ w)) - 1) / 2000 + 1e-3 * w
    assert np.abs(slope(model.weights)).max() < 1e-6
    w = np.zeros(d.shape[1])
    for _ in range(30_000):
        w -= 0.02 * slope(w)
    assert np.corrcoef(z @ w, model.latent(x))[0, 1] > 0.9999
    assert model.score(x)[np.argsort(model.latent(x))].tolist() == sorted(model.score(x))


def folder_of(spark, path, docs, items, labels, schema="doc_id long, text string, lang string, source string, n_chars long"):
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages_match_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(r[0], r[1], "en", "s", len(r[1] or "")) for r in corpus(9, 60)]
    items = [(1, "one"), (2, " ".join(rows[8][1].split()[3:40])), (None, rows[20][1])]
    folder_of(spark, str(tmp_path), rows, items, [(0, 1, 0)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(map(tuple, p.quality(spark, docs, str(tmp_path)).collect())) == Counter(rows)  # labels of one kind tell nothing
    # near duplicates, by a brute force over rows in the order in which they are kept
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    found = components_of([(i, r[1]) for i, r in enumerate(order)], 5)
    kept = Counter((order[i][0], order[i][1]) for i, (_, c) in found.items() if i == c)
    got = p.near_dedup(spark, docs, str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == kept
    # repeated passages
    left = p.substring_dedup(spark, docs, str(tmp_path))
    wanted = Counter()
    for r, (doc, n, gone, text) in zip(rows, [next(iter(x)) for x in [removed([r], 10**9) for r in rows]], strict=True):
        wanted[doc, n, r[1]] += 1
    gone = defaultdict(list)
    for doc, n, lost, text in removed(rows, 50).elements():
        gone[doc].append((n, lost, text))
    for r in left.collect():
        assert any((lost == 0 and n == len(re.findall(r"[^\x20\x09-\x0d]+", r.text or ""))) or (r.text == text and r.n_chars == len(text)) for n, lost, text in gone[r.doc_id])
    assert left.count() == sum(not lost or lost < n for x in gone.values() for n, lost, _ in x)
    # benchmark passages
    clean = Counter((doc, n) for doc, n, hit, _ in contaminated(rows, items).elements() if not hit)
    words = lambda t: len(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t or ""))
    assert Counter((r.doc_id, words(r.text)) for r in p.decontamination(spark, docs, str(tmp_path)).collect()) == clean
    packed_well([r.asDict() for r in p.packing(spark, docs, str(tmp_path)).collect()], [r[:2] for r in rows])


def test_pipeline_of_clashing_columns_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(2)
    text = lambda: " ".join(str(rng.randint(0, 10**6)) for _ in range(90))
    names = ["_score", "_removed", "_words", "_id", "_tag", "_key", "_windows", "_row", "key", "text_", "windows", "id", "tag", "score", "words", "_doc"]
    one = text()
    docs = [(1, one, 7, *names), (1, one, 7, *names), (2, text(), None, *names), (None, None, None, *names)]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    folder_of(spark, f"{tmp_path}/a", docs, [(1, "nothing here")], [(1, 1, 0)], schema)
    before = os.listdir("/tmp")
    got = p.run(spark, f"{tmp_path}/a").collect()
    assert Counter(r.doc_id for r in got) == Counter([1, 2, None]) and len(os.listdir("/tmp")) >= len(before) - 5
    frame = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, frame, f"{tmp_path}/a")
        assert out.columns == frame.columns and {r["_words"] for r in out.collect()} == {"_words"}
    folder_of(spark, f"{tmp_path}/b", [], [], [], schema)
    assert p.run(spark, f"{tmp_path}/b").count() == 0
    frame = spark.read.parquet(f"{tmp_path}/b/documents.parquet")
    assert all(stage(spark, frame, f"{tmp_path}/b").count() == 0 for _, stage in p.STAGES)


def test_scratch_of_finished_stages_is_removed(spark):
    from plumbline.llm.common import kept_alone, materialise, shared_root

    root = shared_root(spark).removeprefix("file://") + "/plumbline"
    made = []

    def stage():
        made.append(materialise(spark.range(5), "inner").where("id > 2"))
        return made[0]

    out = kept_alone(spark, stage, "outer")
    assert out.count() == 2 and not [n for n in os.listdir(root) if n.startswith("inner-")]


@pytest.mark.parametrize("seed", [4])
def test_near_duplicates_behind_boilerplate(spark, seed):
    """Pages that share a template, a third of each, with planted near copies: recall against all pairs."""
    from plumbline.llm.near_dedup import near_duplicates

    rng = random.Random(seed)
    word = lambda: str(rng.randint(0, 10**6))
    templates = [[word() for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(400):
        words = [*templates[i % 4], *[word() for _ in range(rng.randint(60, 120))]]
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            at = rng.randrange(len(words))
            rows.append((1000 + i, " ".join([*words[:at], *[word() for _ in range(rng.randint(1, 4))], *words[at:]])))
    # small blocks, so that clusters are cut in many
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=16, block_shingles=2_000, wide=50).collect()}
    wanted = {i: c for i, (_, c) in components_of(rows, 5).items()}
    linked = [i for i, c in wanted.items() if i != c]
    assert len(linked) > 100 and np.mean([got[i] == wanted[i] for i in linked]) >= 0.99
    assert all(got[i] == i or i in linked for i in got)


def broadcasts(spark, work):
    """Plans with a broadcast among those that ``work`` ran; and how many it ran."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    ran = store.executionsCount()
    work()
    bus.waitUntilEmpty()
    plans = store.executionsList(ran, 10_000)
    texts = [plans.apply(i).physicalPlanDescription() for i in range(plans.size())]
    return sum("BroadcastExchange" in t for t in texts), len(texts)


def copies(seed=6):
    """Copies near and exact of some texts, behind two templates, an id with two texts."""
    rng = random.Random(seed)
    word = lambda: str(rng.randint(0, 10**6))
    templates = [[word() for _ in range(60)] for _ in range(2)]
    rows = [(i, " ".join([*templates[i % 2], *[word() for _ in range(60)]])) for i in range(40)]
    return [*rows, *[(100 + i, f"{t} end") for i, t in rows[::3]], *[(200 + i, t) for i, t in rows[::4]], (1, rows[5][1])]


def test_near_duplicates_send_no_table_by_the_driver(spark):
    from plumbline.llm.near_dedup import near_duplicates

    docs, found = spark.createDataFrame(copies(), "doc_id long, text string").repartition(3), []
    count, ran = broadcasts(spark, lambda: found.extend(near_duplicates(docs, width=4).collect()))
    assert count == 0 and ran > 20 and any(not r.kept for r in found)


def test_stage_near_dedup_sends_no_table_by_the_driver(spark):
    import corpus_pipeline as p

    docs, found = spark.createDataFrame(copies(8), "doc_id long, text string").repartition(3), []
    count, ran = broadcasts(spark, lambda: found.extend(p.near_dedup(spark, docs, "").collect()))
    assert count == 0 and ran > 20 and 0 < len(found) < len(copies(8))


def test_quality_learns_from_all_labelled_rows(spark):
    """More rows than the former bound of 8,000: the loss of all pairs has no slope left at the weights, the cut is the
    quantile of all scores."""
    from plumbline.llm import quality

    rng = random.Random(12)
    text = lambda good: " ".join(rng.choice(["alpha", "Beta", "gamma,", "of", "12"] if rng.random() < (0.6 if good else 0.4) else ["x", "to.", "UP", "of"]) for _ in range(12))
    rows = [(i, text(i % 5), int(i % 5 > 0)) for i in range(12_000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    model = quality.train(docs, spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int"))
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    x, y = quality.features([t for _, t, _ in learned]), np.array([y for *_, y in learned])
    assert len(learned) > 8_500 and np.allclose(model.middle, x.mean(axis=0)) and np.allclose(model.spread, x.std(axis=0) + 1e-6)
    z = np.clip((x - model.middle) / model.spread, -6, 6)
    z = np.concatenate([z, z * z], axis=1)
    s = z @ model.weights
    ones, zeros, slope = z[y == 1], z[y == 0], 1e-3 * model.weights
    for part in np.array_split(np.arange(len(ones)), 50):
        wrong = 1 / (1 + np.exp(s[y == 1][part][:, None] - s[y == 0][None, :]))
        slope = slope + (wrong.sum(axis=0) @ zeros - wrong.sum(axis=1) @ ones[part]) / len(ones) / len(zeros)
    assert np.abs(slope).max() < 1e-4 < np.abs(model.weights).max()
    assert (s < model.cut).sum() == (y == 0).sum() or np.isclose(np.sort(s)[(y == 0).sum() - 1], model.cut)
