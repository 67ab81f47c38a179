"""Corpus operators against brute force, round trips and odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=3, n=60):
    """Invented texts with copies, near copies, shared passages, odd white space, nulls, empties and a repeated row."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 160))]
        if i % 7 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage[rng.randint(0, 10) :]
        if i % 5 == 0 and texts:
            words = texts[rng.randrange(len(texts))].split()
            words[rng.randrange(len(words))] = "Changed!"
        texts.append("".join(w + rng.choice([" ", " ", " ", " ", "  ", "\n", ", "]) for w in words))
    texts += [texts[0], texts[0], None, "", " \n\t", "one", "ONE two", "a <|endoftext|> b", "x" * 5000, " ".join(passage * 3)]
    rows = [(i, t, "en", "s", 1, "clash", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, "no id here at all", None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs, rows, empty):
    from plumbline.llm.token_counts import count_tokens

    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, BYTES, limit=100, chunk_chars=200, overlap_chars=8).collect())
    assert got == Counter((r[0], len((r[1] or "").encode()), len(t := tokens(BYTES, r[1])), len(t) > 100) for r in rows)
    assert count_tokens(empty, BYTES).count() == 0


def test_resynchronisation_widens_and_stays_exact():
    from tokenizers import Tokenizer

    from plumbline.llm.token_counts import resync_ids

    held = Tokenizer.from_file(BYTES)
    rng = random.Random(2)
    widened = 0
    for _ in range(60):
        text = "".join(rng.choice(["ab", " ", "  ", "\n", "'s", "<|endoftext|>", "9", "é", "🎉", "longer" * 8]) for _ in range(rng.randint(1, 400)))
        ids, chunks, more = resync_ids(lambda s: held.encode(s, add_special_tokens=False), text, 64, 4)
        widened += more
        assert ids.tolist() == held.encode(text, add_special_tokens=False).ids
    assert widened


def test_resynchronisation_of_texts_without_boundaries_is_linear():
    from tokenizers import Tokenizer

    from plumbline.llm.token_counts import resync_ids

    held, seen = Tokenizer.from_file(BYTES), []

    def encode(s):
        seen.append(len(s))
        return held.encode(s, add_special_tokens=False)

    rng = random.Random(4)
    blob = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(400_000))
    for text in (blob, "some words " * 9000 + blob + " and more words" * 9000):
        seen.clear()
        ids, chunks, _ = resync_ids(encode, text)
        assert ids.tolist() == held.encode(text, add_special_tokens=False).ids
        assert sum(seen) < 5 * len(text) and len(seen) == chunks < 25


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_word_memo_is_exact(path):
    from plumbline.llm.memo import WordMemo

    rng = random.Random(1)
    pieces = ["a", "é", " ", " ", "\n", "\n\n", ".\n", ", ", "x.|>", "<|endoftext", "Δς", "ªb", "×", "  ", "\n", "\t", "'s", "<|endoftext|>", "<|", "1", "Word", ".", "日本", "🎉", "́", "\xa0", "İ", "ß", "'LL", "_", "\x1c", "\x85", "<|startoftext|>"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    memo = WordMemo(path, most=500)
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        assert memo.encode(some) == [np.array(e.ids, "<u4").tobytes() for e in memo.tokenizer.encode_batch(some, add_special_tokens=False)]


def test_packing_places_each_id_once(docs, rows, empty):
    from plumbline.llm.packing import pack

    got = pack(docs, BYTES, size=64, windows=4, fan_in=2).collect()
    full = sorted((np.array([*tokens(BYTES, r[1]), 1], "<u4").tobytes() for r in rows), key=lambda x: (len(x), x))
    assert sum(r.length for r in got) == sum(len(x) // 4 for x in full)
    by_doc = {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    unique = {r[0]: np.array([*tokens(BYTES, r[1]), 1], "<u4").tobytes() for r in rows}
    for (doc, total), pieces in by_doc.items():
        if doc == rows[4][0]:
            assert sum(p.length for p in pieces) == 2 * total
            continue
        assert b"".join(bytes(p.ids) for p in sorted(pieces, key=lambda p: p.start)) == unique[doc] and len(unique[doc]) == 4 * total
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append(r)
    for held in windows.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    assert sum(r.length for r in got) > 0.9 * 64 * len(windows)
    assert pack(empty, BYTES).count() == 0


def test_sstables_round_trip(spark, docs, rows, empty):
    from plumbline.llm import sstable

    sstable.BLOCK, block = 256, sstable.BLOCK
    try:
        shards = sstable.write_tables(docs.drop("score"), WORDS, 2)
        got = sstable.read_tables(spark, shards).orderBy("start").collect()
    finally:
        sstable.BLOCK = block
    wanted = sorted(((r[0] is not None, r[0] or 0), np.array([*tokens(WORDS, r[1]), 2], "<u4").tobytes()) for r in rows)
    assert [(r.doc_id, bytes(r.ids)) for r in got] == [(k[1] if k[0] else None, v) for k, v in wanted]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()
    for (known, doc), value in wanted:
        assert value in sstable.lookup(shards, doc if known else None)
    assert len(sstable.lookup(shards, rows[4][0])) == 2 and sstable.lookup(shards, 10**9) == []
    assert sstable.write_tables(empty, WORDS, 2) == [] and sstable.read_tables(spark, []).count() == 0


def test_sharding_is_exact_and_uniform(spark, docs, rows, empty):
    from plumbline.llm.sharding import block_sizes, draw_hypergeometric, matrix_row, shard_uniformly

    got = shard_uniformly(docs, 5, block_rows=4).collect()
    assert len(got) == len(rows) and got[0].shard is not None
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert sorted(str(r.text) for r in got) == sorted(str(r[1]) for r in rows)
    assert shard_uniformly(empty, 5).count() == 0
    before = np.array([0, 30, 31, 90, 130])
    capacity = block_sizes(130, 4, 2)
    matrix = np.array([matrix_row(before, capacity, i, 3) for i in range(4)])
    assert matrix.sum(axis=0).tolist() == capacity.tolist() and matrix.sum(axis=1).tolist() == np.diff(before).tolist()
    seen = np.zeros((3, 2))
    for seed in range(400):
        for i in range(3):
            seen[i] += matrix_row(np.array([0, 2, 4, 6]), np.array([3, 3]), i, seed)
    assert np.abs(seen / 400 - 1).max() < 0.12
    rng = np.random.default_rng(1)
    large = [draw_hypergeometric(rng, 3 * 10**9, 10**9, 1000) for _ in range(300)]
    assert abs(np.mean(large) - 750) < 4 and 10 < np.std(large) < 18


def test_fingerprints(spark, docs, rows, empty):
    from plumbline.llm.fingerprints import fingerprint, likeness, packed

    plain = [r for r in rows if r[0] is not None and r is not rows[4]]
    made = fingerprint(spark.createDataFrame(plain, SCHEMA).repartition(3))
    got = {r.doc_id: r for r in made.select("*", packed("bins").alias("p"), likeness("bins", "edited_bins").alias("near"), likeness("bins", "next_bins").alias("near_next")).collect()}
    order = sorted(((r[0], r[1] or "") for r in plain), reverse=True)
    sets = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := re.findall(r"[^ \t-\r]+", t)) else set()
    errors = []
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[doc].edited == edited
        for other, near in ((edited, got[doc].near), (following, got[doc].near_next)):
            a, b = sets(text), sets(other)
            errors.append(abs(near - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert max(errors) < 0.15 and np.mean(errors) < 0.03
    by_text = {}
    for doc, text in order:
        by_text.setdefault(text, set()).add(got[doc].p)
    assert all(len(x) == 1 for x in by_text.values())
    assert fingerprint(empty).count() == 0 and fingerprint(docs).count() == len(rows)


def components_of(rows, width, percent=80):
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (r[1] or "").translate(LOWER))
        sets[r[0]] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(spark, empty, seed):
    from plumbline.llm.near_dedup import near_duplicates

    rng = random.Random(seed)
    rows = [r for r in corpus(seed, 40) if r[0] is not None][:-1]
    base = [str(rng.randint(0, 10**6)) for _ in range(100)]
    for i in range(40):  # a chain and a cloud around the threshold
        words = list(base)
        for at in rng.sample(range(100), rng.randint(1, 6)):
            words[at] = f"new{i}"
        if i % 3 == 0:
            base = words
        rows.append((1000 + i, " ".join(words), *rows[0][2:]))
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), width=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_of(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_of_odd_rows(docs, rows):
    from plumbline.llm.near_dedup import near_duplicates

    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert [r for r in got if r.doc_id is None][0].component_id is None


def test_near_duplicates_unite_the_texts_of_an_id(spark):
    from plumbline.llm.near_dedup import near_duplicates

    rng = random.Random(7)
    text = lambda n=80: " ".join(str(rng.randint(0, 10**6)) for _ in range(n))
    one, two, three, four, five = (text() for _ in range(5))
    # 20 has the shingles of two texts, of which 21 and 22 hold only one, 23 both; 30 has an empty row
    rows = [(20, one), (20, two), (21, one), (22, two), (23, f"{one} {two}"), (30, three), (30, None), (31, three), (None, four), (None, five), (None, five + " x"), (40, five), (None, None), (None, text())]
    got = Counter(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width=4).collect())
    wanted = [(20, 154, 20, True)] * 2 + [(21, 77, 21, True), (22, 77, 22, True), (23, 157, 20, False)] + [(30, 77, 30, True)] * 2 + [(31, 77, 30, False)]
    wanted += [(None, 77, None, True), (None, 77, 40, False), (None, 78, 40, False), (40, 77, 40, True), (None, 0, None, True), (None, 77, None, True)]
    assert got == Counter(wanted)


def test_near_duplicates_between_texts_unlike_the_head(spark):
    from plumbline.llm.near_dedup import half_bands, near_duplicates, shingles

    rng = random.Random(3)
    words = lambda n: [str(rng.randint(0, 10**7)) for _ in range(n)]
    rows, pairs = [], []
    for group in range(12):  # two short near copies, which many long texts contain
        short = words(30)
        rows += [(1000 * group + i, " ".join([*words(85), *short, *words(85)])) for i in range(150)]
        rows += [(1000 * group + 900, " ".join(short)), (1000 * group + 901, " ".join(short + words(3)))]
        keys, _ = half_bands(shingles([rows[-2][1], rows[-1][1]], 5), 1, 1)
        if (keys[0] == keys[1]).all():
            pairs.append((1000 * group + 900, 1000 * group + 901))
    # one table of two minhashes: a pair that shares it must be found
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), halves=1, rows=1).collect()}
    assert len(pairs) > 5 and all(got[a] == got[b] == a for a, b in pairs)
    assert all(got[i] == i for i, _ in rows if i % 1000 < 900)


def removed(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0d]+", r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        out.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return Counter(out)


def test_substring_removal_matches_brute_force(docs, rows, empty):
    from plumbline.llm.substring_dedup import remove_repeats

    got = Counter((r.doc_id, r.n_words, r.n_removed, " ".join((r.text or "").split(" ")) if r.n_removed else " ".join(re.findall(r"[^\x20\x09-\x0d]+", r.text or ""))) for r in remove_repeats(docs).collect())
    assert got == removed(rows, 35)
    assert remove_repeats(empty).count() == 0


def test_substring_removal_counts_the_windows_of_common_anchors(spark):
    from plumbline.llm.common import Scratch
    from plumbline.llm.substring_dedup import repeated_windows

    rng = random.Random(11)
    word = lambda: str(rng.randint(0, 10**6))
    passage = [word() for _ in range(50)]
    rows = [(i, " ".join([word() for _ in range(rng.randint(0, 30))] + passage[rng.randint(0, 9) :] + [word() for _ in range(rng.randint(0, 30))])) for i in range(150)]
    texts = spark.createDataFrame([(str(i).encode(), t) for i, t in rows], "key binary, text string").repartition(3)
    wanted = Counter((doc, n) for doc, _, n, _ in removed(rows, 35).elements())
    for most, size, sent, often in ((2_000, 100_000, 1 << 16, 16), (2_000, 300, 0, 2), (5, 100_000, 3, 2), (0, 1, 1 << 16, 2)):
        got = {int(bytes(r.key)): r.windows for r in repeated_windows(texts, Scratch(spark), shard_words=size, most_pieces=most, most_sent=sent, often=often).collect()}
        gone = {i: len({p for x in found for b in range(62) if x.bits >> b & 1 for p in range(x.first + b, x.first + b + 35)}) for i, found in got.items()}
        assert Counter((i, gone.get(i, 0)) for i, _ in rows) == wanted


@pytest.mark.parametrize("window", [3, 16, 50, 90])
def test_substring_removal_for_other_windows(spark, docs, rows, window):
    from plumbline.llm.substring_dedup import remove_repeats

    got = Counter((r.doc_id, r.words, r.gone) for r in remove_repeats(docs, window=window, words_col="words", removed_col="gone").collect())
    assert got == Counter((doc, n, gone) for doc, n, gone, _ in removed(rows, window).elements())


def test_suffix_automaton_matching_statistics():
    from plumbline.llm.automaton import SuffixAutomaton

    rng = random.Random(4)
    for _ in range(60):
        passages = [([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(3, 20))], rng.choice([1, 1, 2])) for _ in range(4)]
        held = SuffixAutomaton()
        coded = [held.add(*p) for p in passages]
        held.count()
        seen = Counter()
        for p, times in passages:
            for i in range(len(p) - 3):
                seen[tuple(p[i : i + 4])] += times
        for (p, _), c in zip(passages, coded, strict=True):
            assert held.repeats(c, 4) == [i for i in range(len(p) - 3) if seen[tuple(p[i : i + 4])] > 1]


def contaminated(rows, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for r in rows:
        w, hit, found = split(r[1]), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((r[0], len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


@pytest.mark.parametrize("block_words", [1 << 20, 15])
def test_decontamination_matches_brute_force(spark, docs, rows, empty, block_words):
    from plumbline.llm.decontamination import build_index, contaminated_spans, n_hit, proximity

    items = [(1, " ".join(rows[7][1].split()[5:30])), (2, rows[14][1]), (3, "one"), (10, "ONE. two"), (5, None), (6, "  "), (7, " ".join(rows[-3][1].split()[20:33])), (7, "again other")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = contaminated_spans(docs, bench, block_words=block_words).select("doc_id", "n_words", n_hit().alias("h"), "items").collect()
    assert Counter((r.doc_id, r.n_words, r.h, tuple(r["items"])) for r in found) == contaminated(rows, items)
    assert contaminated_spans(empty, bench).count() == 0
    assert {r.h for r in contaminated_spans(docs, bench.limit(0)).select(n_hit().alias("h")).collect()} == {0}
    near = proximity(build_index(docs), "two one", 1).collect()
    assert [(r.doc, r.position) for r in near] and all("one two" in dict((x[0], (x[1] or "").lower()) for x in rows)[r.doc] for r in near)


def test_decontamination_with_items_without_id(spark):
    from plumbline.llm.decontamination import contaminated_spans, n_hit

    docs = spark.createDataFrame([(1, "one two three"), (2, "two"), (3, "three"), (4, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "two"), (7, "One"), (5, "three"), (None, "one two")], "item_id long, text string")
    wanted = {1: (3, ["5", "7", None]), 2: (1, [None]), 3: (1, ["5"]), 4: (0, [])}
    for block_words in (1 << 20, 1):
        got = contaminated_spans(docs, bench, block_words=block_words).select("doc_id", n_hit().alias("h"), "items").collect()
        assert {r.doc_id: (r.h, r["items"]) for r in got} == wanted


def test_quality_ranks_held_out_rows(spark, empty):
    from plumbline.llm.quality import score_quality, train

    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "to"]) for _ in range(50)) + "."
    rows = [(i, good() if i % 4 else good().upper() + "!!" * 20, "en", "s", 1, "x", "x") for i in range(200)] + [(None, None, *[None] * 5), (500, "", *[None] * 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in score_quality(docs, train(docs, labels)).collect()}
    assert all((got[i] >= 0.7) == (i % 4 > 0) for i in range(200)) and 0 <= got[None] <= 1 and 0 <= got[500] <= 1
    model = train(empty, labels)
    assert score_quality(empty, model).count() == 0 and score_quality(docs, model).count() == len(rows)


def test_toxicity_and_counterfactuals(spark, empty):
    from plumbline.llm.toxicity import fit, score_toxicity, train

    rng = random.Random(9)
    filler = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    rows, labels = [], []
    for i in range(300):
        words = [rng.choice(filler) for _ in range(30)]
        toxic = i % 3 == 0
        if toxic:
            words[3] = rng.choice(["scumbag", "moron"])
        if i % 10 < (8 if toxic else 1):
            words[7] = "muslims"
        rows.append((i, " ".join(words), "en", "s", 1, "x", "x"))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.score for r in score_toxicity(docs, train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()}
    assert sum((got[i] >= 0.5) == (i % 3 == 0) for i in range(300)) >= 297
    sentences = [(sorted(set(r[1].split())), int(i % 3 == 0)) for i, r in enumerate(rows)]
    free, tied = fit(sentences, strength=0.0), fit(sentences, strength=40.0)
    gap = lambda m: abs(m.word("muslims") - m.word("christians"))
    assert gap(free) > 0.2 and gap(tied) < 0.3 * gap(free)
    odd = spark.createDataFrame([(1, None, *[None] * 5), (2, "", *[None] * 5)], SCHEMA)
    assert all(0 <= r.score <= 1 for r in score_toxicity(odd, tied).collect()) and score_toxicity(empty, tied).count() == 0


def test_toxicity_scores_with_the_counts_of_fitting():
    from plumbline.llm.toxicity import fit

    stems = [f"abcd{chr(97 + i)}{chr(97 + j)}x" for i in range(6) for j in range(6)]
    model = fit([((["abcdzz", "filler"] if i % 2 else ["other", "filler"]), i % 2) for i in range(40)])
    shared = model.latent("abcdq")
    assert shared > 0 and model.latent(" ".join(stems[:2])) == pytest.approx(2 * shared)
    assert model.latent(" ".join(stems)) == pytest.approx(3 * shared)


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(2000)]
    text = lambda n: ". ".join(" ".join(rng.choice(vocabulary) for _ in range(10)).capitalize() for _ in range(n))
    rows = [(i, text(12)) for i in range(120)]
    labels = [(i, 1, 0) for i in range(120)]
    rows += [(200 + i, text(6).upper().replace(" ", "!! ")) for i in range(40)]
    labels += [(200 + i, 0, 0) for i in range(40)]
    rows += [(300, rows[5][1]), (301, rows[6][1].replace(rows[6][1].split()[3], "other", 1))]
    item = " ".join(vocabulary[:14])
    rows += [(302, text(6) + ". " + item + ". " + text(5))]
    shared = text(7)
    rows += [(303, text(8) + ". " + shared + ". " + text(4)), (304, text(4) + ". " + shared + ". " + text(8)), (305, None), (306, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in got}
    assert set(range(120)) <= kept and {303, 304} <= kept
    assert not kept & {*range(200, 240), 300, 301, 302}
    whole = {r.doc_id: r.doc_tokens for r in got}
    texts = dict(rows)
    assert whole[7] == len(tokens(BYTES, texts[7])) + 1
    assert whole[303] < len(tokens(BYTES, texts[303])) - 60
    assert zlib.crc32(np.array([*tokens(BYTES, texts[7]), 1], "<u4").tobytes()) in {r.ids_crc32 for r in got if r.doc_id == 7}


def test_pipeline_keeps_one_whole_row_of_copies(spark):
    import corpus_pipeline

    rng = random.Random(12)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(120))
    one, two, three, four = text(), text(), text(), text()
    rows = [(1, one), (1, one), (2, two), (None, two), (None, two + " tail"), (None, three), (None, three), (4, four), (4, text()), (5, None), (None, "")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    deduped = corpus_pipeline.near_dedup(spark, docs, "")
    wanted = Counter([(1, one), (2, two), (None, three), (4, four), (4, rows[8][1]), (5, None), (None, "")])
    assert deduped.columns == docs.columns and Counter((r.doc_id, r.text) for r in deduped.collect()) == wanted
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.substring_dedup(spark, deduped, "").collect()) == wanted
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_components(spark):
    from plumbline.llm.components import components

    rng = random.Random(5)
    for edges in ([(i, i + 1) for i in range(40)] + [(100, 99), (50, 60), (50, 50)], [(rng.randrange(80), rng.randrange(80)) for _ in range(50)], []):
        parent = {}

        def top(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for x, y in edges:
            if x != y:
                p, q = sorted((top(x), top(y)))
                parent[q] = p
        got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: top(x) for x in list(parent)}
