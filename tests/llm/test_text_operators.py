"""The text operators against brute force, and the defined results of odd inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from statweave.llm import (
    components,
    decontaminate,
    fingerprints,
    language_model,
    lines,
    ngram_join,
    packing,
    queries,
    sharding,
    token_counts,
    tokens,
    toxicity,
    training_order,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["_row", "_k1", "cls", "n_shingles", "component_id", "shard", "slot", "n_lines", "key", "sequence_id", "_text", "score"]
SYLLABLES = "ta re mi sol fa du lo ka ne vi po ra".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Plain documents, exact copies, near copies that chain, shared passages, and every odd text."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(20, 90))) for i in range(60)]
    base = rows[3][1].split()
    for i in range(60, 90):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "edit" + str(i)
        rows.append((i, " ".join(words)))
    rows += [(90 + i, rows[7][1]) for i in range(10)]
    passage = prose(rng, 60)
    rows += [(100 + i, f"{prose(rng, 30)}\n{passage}\n{prose(rng, 25)}") for i in range(12)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "One"), (205, "two words"), (None, "no id at all here"), (None, None)]
    rows += [(206, "repeat me five words now"), (206, "repeat me five words now"), (207, "x" * 50_000), (208, prose(rng, 20_000))]
    rows += [(209, "Ünï çödé 文字 \U0001f600 test"), (210, "don't  stop\n\n\nhere \x1c\x85 now")]
    return [(i, t, "en", f"s{(i or 0) % 3}" if (i or 0) % 7 else None, len(t) if t is not None else None) for i, t in rows]


@pytest.fixture(scope="module")
def documents(spark, corpus):
    df = spark.createDataFrame(corpus, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


# -- packing ------------------------------------------------------------------------


def test_pieces_and_packing_cover_every_id(spark, documents, corpus):
    cut = packing.cut(documents, 128, with_ids=True)
    packed = packing.pack(cut.drop("ids"), 128)
    rows = packed.collect()
    encode = tokens.encoder()
    wanted = Counter()
    for i, text, *_ in corpus:
        ids = [*encode.exact.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 128 + 1
        edges = [0, *range(first, len(ids) + 1, 128)]
        for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            wanted[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    lengths = np.array([r.length for r in rows])
    assert packing.bound(lengths, 128) <= len(by) <= packing.bound(lengths, 128) + 3


def test_sequences_hold_the_ids(spark, corpus):
    df = spark.createDataFrame([r for r in corpus if r[0] is not None and r[0] < 40], SCHEMA)
    cut = packing.cut(df, 64, with_ids=True)
    packed = packing.pack(cut.drop("ids"), 64)
    got = {r.sequence_id: bytes(r.ids) for r in packing.sequences(cut, packed).collect()}
    ids = {(r.doc_id, r.piece): bytes(r.ids) for r in cut.collect()}
    for r in packed.collect():
        assert got[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == ids[r.doc_id, r.piece]


def exact_bins(lengths, capacity):
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity:
                bins[b] += lengths[i]
                place(i + 1, bins)
                bins[b] -= lengths[i]
        place(i + 1, bins + [lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_bound_never_exceeds_the_optimum():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([10, 12, 30])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        low = packing.bound(np.array(lengths), capacity)
        optimum = exact_bins(lengths, capacity)
        for method in (packing.best_fit, packing.exact_fit):
            bins, offsets, used = method(np.array(lengths), capacity)
            assert low <= optimum <= used
            for b in range(used):
                parts = sorted((offsets[i], lengths[i]) for i in range(len(lengths)) if bins[i] == b)
                assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
                assert 0 < sum(n for _, n in parts) <= capacity
    assert packing.bound(np.array([6, 6, 6]), 10) == 3  # no sum shows this
    assert packing.bound(np.array([], dtype=int), 10) == 0


def test_exchange_rounds_keep_all_pieces(spark, documents, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_PIECES", 9)
    cut = packing.cut(documents, 100)
    rows = packing.pack(cut, 100).collect()
    assert len(rows) == cut.count()
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 100
    assert len(fill) <= packing.bound(np.array([r.length for r in rows]), 100) + 5


# -- decontamination ----------------------------------------------------------------


def test_decontamination_agrees_with_brute_force(spark, documents, corpus):
    rng = random.Random(9)
    source = corpus[8][1].split()
    items = [(1, " ".join(source[3:17])), (2, "One"), (3, None), (4, ""), (5, "TWO  words!"), (6, prose(rng, 30)), (1, " ".join(source[3:17])), (None, corpus[9][1])]
    half = source[:9] + prose(rng, 12).split()
    items.append((7, " ".join(half)))  # too little of it is there
    most = corpus[10][1].split()[:20] + ["other"]
    items.append((8, " ".join(most)))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("_k1", F.lit(1))

    def grams(text):
        w = [x for x in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split(" ") if x]
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    wanted = Counter()
    for d, text, *_ in corpus:
        for i, item in {(i, t) for i, t in items}:
            g = grams(item)
            n = len(g & grams(text))
            if g and 4 * n >= 3 * len(g):
                wanted[d, i, len(g), n] += 1
    got = Counter((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in decontaminate.contaminated(documents, bench).collect())
    assert got == wanted and wanted[8, 1, 10, 10] == 1
    kept = decontaminate.clean(documents, bench)
    assert kept.columns == documents.columns
    bad = {d for d, *_ in wanted}
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == Counter(d for d, *_ in corpus if d is not None and d not in bad)


# -- line dedup ---------------------------------------------------------------------


def test_recurring_lines_go_and_the_rest_stays(spark, documents, corpus):
    got = {r.doc_id: r for r in lines.dedup(documents).where("doc_id >= 0").collect()}
    passage = next(t for i, t, *_ in corpus if i == 100).split("\n")[1]
    for i, text, *_ in corpus:
        if i is None:
            continue
        if 100 <= i < 112:
            assert got[i].text == "\n".join(x for x in text.split("\n") if x != passage) and got[i].n_dropped == 1
        else:
            assert got[i].text == text and got[i].n_dropped == 0
    assert got[200].text is None and got[200].n_lines == 0


def test_variable_fields_and_tails_share_a_template(spark):
    rng = random.Random(2)
    rows = [(i, f"{prose(rng, 12)}\nPage {i} of {i + 90} printed for user{i}@mail.example\n{prose(rng, 14)}\nclick here to read more about {prose(rng, 1)}{i}") for i in range(8)]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    for r in lines.dedup(df).collect():
        assert r.text.split("\n") == [rows[r.doc_id][1].split("\n")[k] for k in (0, 2)]


def test_copies_of_a_document_are_not_recurring_lines(spark):
    rng = random.Random(3)
    text = "\n".join(prose(rng, 15) for _ in range(6))
    df = spark.createDataFrame([(i, text, None, None, 0) for i in range(40)], SCHEMA)
    assert all(r.text == text for r in lines.dedup(df).collect())


@pytest.mark.parametrize(("shared", "n", "own"), [(5, 5, 2), (10, 10, 10), (10, 20, 10), (10, 40, 2), (20, 40, 3), (20, 5, 1)])
def test_long_passages_recur_in_few_short_documents(spark, shared, n, own):
    rng = random.Random(shared * n)
    passage = [prose(rng, 9) for _ in range(shared)]
    copied = [prose(rng, 12) for _ in range(6)]
    texts = [[prose(rng, 12) for _ in range(own)] for _ in range(n)]
    rows = [(i, "\n".join([*passage, *t]), None, None, 0) for i, t in enumerate(texts)] + [(n + i, "\n".join(copied), None, None, 0) for i in range(30)]
    for k in range(30):  # copies with an edit that leaves the other end of a line
        words = [x.split() for x in copied]
        words[k % 6][k % 3] = f"edit{prose(rng, 1)}"
        rows.append((n + 30 + k, "\n".join(map(" ".join, words)), None, None, 0))
    got = {r.doc_id: r for r in lines.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, *_ in rows:
        assert got[i].text == ("\n".join(texts[i]) if i < n else text)


# -- n-gram join --------------------------------------------------------------------


def brute_components(corpus):
    sets = [shingles(t) for _, t, *_ in corpus]
    root = list(range(len(corpus)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(corpus)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    out = []
    for i, (d, *_) in enumerate(corpus):
        ids = [e for j, (e, *_) in enumerate(corpus) if find(j) == find(i) and e is not None]
        out.append((d, len(sets[i]), min(ids) if ids and sets[i] else d))
    return out


@pytest.mark.parametrize("common", [64, 2])
def test_join_agrees_with_all_pairs(spark, documents, corpus, common, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", common)
    got = ngram_join.join(documents).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(corpus))


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    ruled_out = 0
    for _ in range(600):
        n = int(rng.integers(1, 300))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        kept = x[rng.random(len(x)) < rng.choice([0.2, 0.8, 0.9, 1.0])]
        y = np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, int(rng.integers(0, n // 3 + 1))).astype(np.uint64)]))
        if not len(y):
            continue
        linked = ngram_join._are_linked(x.tobytes(), y.tobytes(), len(x), len(y))
        assert linked == (100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y)))
        could = ngram_join._could_link(ngram_join._bitmap(x).tobytes(), ngram_join._bitmap(y).tobytes(), len(x), len(y))
        assert could or not linked
        ruled_out += not could
    assert ruled_out > 100


def test_one_row_of_each_group_stays(spark, documents, corpus):
    kept = ngram_join.keep_one(documents)
    assert kept.columns == documents.columns
    rows = kept.collect()
    wanted = set()
    for (i, _, c), (_, text, *_) in zip(brute_components(corpus), corpus, strict=True):
        if i == c or not words_of(text) or i is None:
            wanted.add((i, text))
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(wanted)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


# -- toxicity -----------------------------------------------------------------------


def test_automaton_agrees_with_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            out = [i]
            for j, y in enumerate(b, 1):
                out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
            row = out
        return row[-1]

    rng = random.Random(4)
    entries = ["abcde", "abcab", "bbbbb", "ab", "cabbage"]
    machine = toxicity.Automaton(entries, ["dad"])
    for _ in range(4000):
        word = "".join(rng.choice("abcdeg") for _ in range(rng.randint(1, 8)))
        if rng.random() < 0.5:
            word = list(rng.choice(entries))
            word[rng.randrange(len(word))] = rng.choice(["", "a", "ab", "c"])
            word = "".join(word)
        near = min(distance(word, e) for e in entries if len(e) >= toxicity.EDIT_LENGTH)
        want = 1 if word in entries else 2 if word.startswith("dad") and len(word) > 3 or word == "dad" else 3 if near <= 1 else 0
        assert machine.kind(word) == want, word


def test_toxic_words_and_stems_are_learned_and_quotes_are_apart(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        text, toxic = prose(rng, 40), int(i % 8 == 0)
        if toxic:
            text += " zzblocka you" if i % 16 else f" qqstem{prose(rng, 1)}"
        elif i % 9 == 0:
            text += ' he called it "zzblocka" once'
        rows.append((i, text, "en", "s", 0))
        labels.append((i, 1, toxic))
    rows += [(1000, "zzblockaa you", "en", "s", 0), (1001, "plain words", "en", "s", 0), (1002, None, None, None, None), (1003, "", "en", "s", 0), (None, "zzblocka", "en", "s", 0)]
    df, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, marks, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.toxicity for r in toxicity.score(df, model).collect()}
    assert "zzblocka" in model.words and any("qqstem".startswith(s) or s.startswith("qqst") for s in model.stems)
    assert all((got[i] >= 0.3) == bool(t) for i, _, t in labels if i % 5 == 0)
    assert got[1001] == got[1002] == got[1003] < 0.3 and got[None] >= 0.3
    assert all(0 <= s <= 1 for s in got.values())


def test_misspelled_inflected_terms_are_found(spark):
    machine = toxicity.Automaton([], ["qqstem", "zzbl"], ["zzblocken"])
    for word, kind in [("qqstemish", 2), ("qqsteem", 3), ("qqstam", 3), ("qqxstemish", 3), ("qstemish", 3), ("qqtsemish", 0), ("qqstedish", 0), ("zzblocken", 2), ("zbblocken", 3), ("zzlocken", 3), ("zzlocked", 0)]:
        assert machine.kind(word) == kind, word
    rng = random.Random(12)
    ends = ["ing", "ed", "er", "ers"]
    rows, labels = [], []
    for i in range(400):
        toxic = int(i % 4 == 0)
        term = ("wwxyz" if i % 8 else "wzxwyz") + ends[i // 8 % 4]
        rows.append((i, prose(rng, 40) + (f" {term}" if toxic else ""), "en", "s", 0))
        labels.append((i, 1, toxic))
    near = ["wxyzing", "wwxxyzed", "wzwyzer", "wzxyzers", "wzzwyzing"]
    rows += [(1000 + k, f"{prose(rng, 40)} {w}", "en", "s", 0) for k, w in enumerate(near)]
    df, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, marks)
    assert any("wwxyz".startswith(s) for s in model.stems) and {f"wwxyz{e}" for e in ends} <= set(model.forms) | set(model.words)
    kinds = toxicity._Kinds(toxicity.Automaton(model.words, model.stems, model.forms))
    assert [kinds[w] for w in near] == [3] * len(near)


def test_toxicity_without_labels(spark, documents, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents, none)
    assert {round(r.score, 6) for r in toxicity.score(documents, model, "score").collect()} == {0.05}
    assert toxicity.score(nothing, model).count() == 0


# -- fingerprints -------------------------------------------------------------------


def test_anchors_are_closed_syncmers(spark, documents, corpus):
    values = documents.select("doc_id", fingerprints.text_of().alias("text")).where("doc_id < 60 or doc_id = 208")
    hashed = fingerprints._with_runs(values, "text").select("doc_id", "_words", "_runs")
    runs = {r.doc_id: (r._words, r._runs) for r in hashed.collect()}
    for r in fingerprints.anchors(values).collect():
        words, h = runs[r.doc_id]
        last = fingerprints.RUNS
        wanted = [i + 1 for i in range(len(words) - fingerprints.WINDOW + 1) if min(h[i : i + last]) in (h[i], h[i + last - 1])]
        assert [a.place for a in r.anchors] == wanted


def test_fingerprints_follow_the_text_alone(spark, documents, corpus):
    rows = fingerprints.compare(documents).collect()
    assert len(rows) == len(corpus)
    order = sorted((r for r in corpus), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    wanted = Counter()
    for k, (i, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        wanted[i, len(text), hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == wanted
    prints = {}
    for r in rows:
        prints.setdefault(r.fingerprint, set()).add(r.doc_id)
    texts = {i: t for i, t, *_ in corpus}
    assert {200, 201, 202} <= prints[""]
    assert all(len({" ".join((texts[i] or "").split()) for i in ids if i}) == 1 for ids in prints.values() if len(ids) > 1 and None not in ids)
    long = next(r for r in rows if r.doc_id == 208)
    assert 0.3 < long.near_edited < 0.7 and long.near_next < 0.1


def test_short_texts_without_a_qualifying_window_differ(spark):
    rng = random.Random(9)
    texts = sorted({prose(rng, 6 + i % 3) for i in range(90)})
    got = fingerprints.compare(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert len({r.fingerprint for r in got}) == len(texts) and "" not in {r.fingerprint for r in got}
    assert max(r.near_next for r in got) < 1


# -- sharding -----------------------------------------------------------------------


@pytest.mark.parametrize("bucket_rows", [5, 100_000])
def test_shards_are_even_and_match_the_mixture(spark, documents, corpus, bucket_rows):
    rows = documents.select("doc_id", "text", "source", "key")
    got = sharding.interleave(rows, shards=5, bucket_rows=bucket_rows).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(5)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    counts = Counter((r.source, r.shard) for r in got)
    for s in {r.source for r in got}:
        assert max(counts[s, k] for k in range(5)) - min(counts[s, k] for k in range(5)) <= 2
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, *_ in corpus)


def test_shard_places_do_not_depend_on_buckets_or_layout(spark, documents):
    rows = documents.select("doc_id", "source").where("doc_id < 150")
    a, b = (sharding.interleave(x, bucket_rows=n).collect() for x, n in ((rows, 7), (rows.repartition(5), 1000)))
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))


# -- language model -----------------------------------------------------------------


def test_base_score_is_the_exact_word_model(spark, documents, corpus, monkeypatch):
    monkeypatch.setattr(language_model, "FREQUENT", 20)
    got = language_model.score(documents, F.col("doc_id") % 7 != 2).collect()
    counts = Counter()
    for i, text, *_ in corpus:
        if i is not None and i % 7 != 2:
            counts.update(words_of(text) + [None])
    n, v = sum(counts.values()), len(counts)
    wanted = Counter()
    for i, text, *_ in corpus:
        own = words_of(text) + [None]
        wanted[i, len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 4)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == wanted
    # Copies of a trained text are likelier than the word model says; unseen prose is not much less likely.
    copies = [r for r in got if r.doc_id and 90 <= r.doc_id < 100]
    assert all(r.score > 0.6 * r.base_score for r in copies)
    assert all(r.score > 1.2 * r.base_score for r in got)


def test_pairs_in_passes_score_the_same_and_counts_of_one_stay(spark, documents, monkeypatch):
    train = F.col("doc_id") % 7 != 2
    monkeypatch.setattr(language_model, "SEGMENT_BLOCKS", 64)

    def scores():
        return {(r.doc_id, r.n_tokens, round(r.base_score, 6)): r.score for r in language_model.score(documents, train).collect()}

    one = scores()
    monkeypatch.setattr(language_model, "FILTER_BYTES", 2 * 64 * language_model.BLOCK_BITS // 8)
    made, build = [], language_model.build
    monkeypatch.setattr(language_model, "build", lambda *a: made.append(a[2:]) or build(*a))
    several = scores()
    assert len([m for m in made if m]) > 2 and one.keys() == several.keys()
    assert all(math.isclose(one[k], several[k], rel_tol=1e-9) for k in one)

    texts = [f"a w{i} b" for i in range(20)] + [f"w{i} c b" for i in range(20) for _ in range(3)]
    empty = spark.sparkContext.broadcast(language_model.Filter(np.zeros(0, dtype=np.uint8), 0))
    counts = language_model.pair_counts(spark.createDataFrame([(t,) for t in texts], "text string"), empty, 100)
    assert Counter(r.c for r in counts.collect()) == {1: 40, 3: 40, 20: 1, 60: 1, 80: 1}


def test_filter_levels():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 62, 5000).astype(np.uint64))
    q = np.arange(len(keys)) % 7 + 1
    blocks = math.ceil(q.sum() * language_model.BITS_PER_KEY / language_model.BLOCK_BITS)
    bits = np.zeros(blocks * language_model.BLOCK_BITS, dtype=bool)
    start = language_model.Filter.block(keys, blocks) * np.uint64(language_model.BLOCK_BITS)
    for at in range(1, 8):
        for place in language_model.Filter.places(keys[q >= at], at):
            bits[(start[q >= at] + place).astype(np.int64)] = True
    f = language_model.Filter(np.packbits(bits, bitorder="little"), blocks)
    found = f.levels(keys)
    assert (found >= q).all() and (found == q).mean() > 0.97
    other = rng.integers(1 << 62, 1 << 63, 5000).astype(np.uint64)
    assert (f.levels(other) == 0).mean() > 0.97
    assert language_model.estimates()[1] == 1 and language_model.estimates(2)[1] == 2


# -- token counts -------------------------------------------------------------------


def test_token_counts_agree_with_word_by_word_search(spark, documents, corpus):
    scores = token_counts.zipf_scores()
    memo = {}

    def best(word):
        if word not in memo:
            top = [(0.0, 0)]
            for end in range(1, len(word) + 1):
                top.append(max((top[s][0] + scores[word[s:end]], top[s][1] - 1) for s in range(max(0, end - 130), end) if word[s:end] in scores))
            memo[word] = -top[-1][1]
        return memo[word]

    got = Counter(map(tuple, token_counts.token_counts(documents.where("doc_id <> 207 or doc_id is null")).collect()))
    wanted = Counter()
    for i, text, *_ in corpus:
        if i != 207:
            own = (text or "").encode().split()
            wanted[i, len(own), sum(best(b" " + w) for w in own)] += 1
    assert got == wanted


# -- training order -----------------------------------------------------------------


@pytest.mark.parametrize("count", [1, 2, 3, 17, 1000, 4097])
def test_permutation_is_one_to_one(count):
    slots = training_order.permuted(np.arange(count), count)
    assert sorted(slots.tolist()) == list(range(count))
    if count > 100:
        assert (slots != np.arange(count)).mean() > 0.9
        assert (slots != training_order.permuted(np.arange(count), count, seed=1)).any()


def test_shards_read_back_as_the_ids(spark, documents, corpus, folder, monkeypatch):
    monkeypatch.setattr(training_order, "SHARD_SEQUENCES", 50)
    ordered = training_order.training_order(documents, 32).cache()
    rows = ordered.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    training_order.write_shards(ordered, f"{folder}/shards")
    found = {}
    for r in rows:
        parts = spark.read.format("binaryFile").load(f"{folder}/shards/shard={r.shard}").collect() if r.shard not in found else found[r.shard]
        found[r.shard] = parts
        assert len(parts) == 1
        raw = bytes(parts[0].content)[r.byte_offset : r.byte_offset + 64]
        assert raw == bytes(r.ids)
    encode = tokens.encoder()
    whole = {}
    for r in sorted(rows, key=lambda r: r.piece):
        if r.doc_id is not None and r.doc_id != 206:
            whole[r.doc_id] = whole.get(r.doc_id, b"") + bytes(r.ids)[: 2 * r.n_ids]
    for i, text, *_ in corpus:
        if i is not None and i != 206:
            assert np.frombuffer(whole[i], dtype="<u2").tolist() == [*encode.exact.encode(text or "", add_special_tokens=False).ids, 2]


def test_shard_files_are_in_slot_order_without_a_cache(spark, corpus, folder, monkeypatch):
    monkeypatch.setattr(training_order, "SHARD_SEQUENCES", 50)
    documents = spark.createDataFrame([r for r in corpus if r[0] is not None and r[0] < 120], SCHEMA).repartition(8)
    training_order.write_shards(training_order.training_order(documents, 32), f"{folder}/plain")
    for path, index in [(f"{folder}/plain", training_order.training_order(documents, 32)), (f"{folder}/index", training_order.shards(documents, f"{folder}/index", 32))]:
        encode, whole, files, rows = tokens.encoder(), {}, {}, index.collect()
        assert sorted(r.slot for r in rows) == list(range(len(rows))) and len(rows) > 100
        for r in sorted(rows, key=lambda r: r.piece):
            if r.shard not in files:
                (part,) = spark.read.format("binaryFile").load(f"{path}/shard={r.shard}").collect()
                files[r.shard] = bytes(part.content)
            whole[r.doc_id] = whole.get(r.doc_id, b"") + files[r.shard][r.byte_offset : r.byte_offset + 2 * r.n_ids]
        for i, text, *_ in corpus:
            if i in whole:
                assert np.frombuffer(whole[i], dtype="<u2").tolist() == [*encode.exact.encode(text or "", add_special_tokens=False).ids, 2]


# -- empty tables, all operators ----------------------------------------------------


def test_empty_tables_give_empty_results(spark, nothing):
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in [
        packing.pack(packing.cut(nothing)),
        decontaminate.contaminated(nothing, bench),
        decontaminate.clean(nothing, bench),
        lines.dedup(nothing),
        ngram_join.join(nothing),
        ngram_join.keep_one(nothing),
        fingerprints.compare(nothing),
        sharding.interleave(nothing.select("doc_id", "source")),
        language_model.score(nothing, F.col("doc_id") > 0),
        token_counts.token_counts(nothing),
        training_order.training_order(nothing),
    ]:
        assert df.count() == 0


def test_pipeline_stages_keep_columns_and_clean_documents(spark, documents, folder):
    sf = f"{folder}/tables"
    documents.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(8, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    item = " ".join(documents.where("doc_id = 20").first().text.split()[2:18])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{sf}/{name}.parquet")
        docs = spark.read.parquet(f"{sf}/{name}.parquet")
        counts.append(docs.count())
    assert counts[0] == counts[1] == documents.count()
    ids = {r.doc_id for r in docs.collect()}
    assert set(range(60)) - {20} <= ids and not ids & {20, *range(90, 100)}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == ids
    assert isinstance(docs.schema["n_chars"].dataType, T.LongType)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
