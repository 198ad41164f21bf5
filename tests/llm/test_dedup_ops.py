import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from cases import empty, odd_rows, prose, words
from foldyard.llm.components import components
from foldyard.llm.hashing import rolling, word_hashes
from foldyard.llm.length_buckets import PackParams, best_boundaries, pack
from foldyard.llm.order_minhash import SketchParams, aligned, drop_near_duplicates, near_duplicate_classes
from foldyard.llm.substring_dedup import remove_repeats
from foldyard.llm.weighted_fingerprints import compare_with_next, edited_text, fingerprints


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


# -- substring dedup ----------------------------------------------------------------


def test_rolling_hashes_are_equal_only_for_equal_windows():
    ws = [w.encode() for w in prose(1, 300) * 2]
    for k in (1, 2, 5, 18, 35):
        got = rolling(word_hashes(ws), k)
        assert len(got) == len(ws) - k + 1
        by_hash = {h: tuple(ws[i : i + k]) for i, h in enumerate(got)}
        assert all(by_hash[h] == tuple(ws[i : i + k]) for i, h in enumerate(got))
        assert len(by_hash) == len({tuple(ws[i : i + k]) for i in range(len(got))})


def without_repeats(texts, window):
    split = [words(t) for t in texts]
    seen = Counter(tuple(ws[i : i + window]) for ws in split for i in range(len(ws) - window + 1))
    out = []
    for ws in split:
        gone = set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append([w for i, w in enumerate(ws) if i not in gone])
    return out


def passages():
    rng = random.Random(3)
    shared = [prose(50 + i, n) for i, n in enumerate((34, 35, 36, 60, 200))]
    texts = []
    for i in range(40):
        ws = prose(300 + i, rng.randint(0, 120))
        for p in rng.sample(shared, rng.randint(0, 3)):
            at = rng.randint(0, len(ws))
            ws[at:at] = p
        texts.append(" ".join(ws))
    inside = prose(70, 50)
    return texts + [" ".join(inside + prose(71, 17) + inside), " ".join(["tick"] * 90), texts[0]]


@pytest.mark.parametrize("window", [35, 8, 2])
def test_repeats_equal_brute_force(spark, window):
    texts = passages()
    got = {r["doc_id"]: r for r in remove_repeats(frame(spark, texts), window=window).collect()}
    for i, kept in enumerate(without_repeats(texts, window)):
        assert got[i]["kept_text"] == " ".join(kept)
        assert got[i]["n_removed"] == len(words(texts[i])) - len(kept)
        assert sum(s["end"] - s["first"] for s in got[i]["spans"]) == got[i]["n_removed"]


def test_layout_stays_around_cut_spans(spark):
    passage = " ".join(prose(80, 40))
    texts = [f"Start of\n it.\n{passage}\n The  end.", f"{passage} other", "a\n b"]
    got = {r["doc_id"]: r["kept_text"] for r in remove_repeats(frame(spark, texts), keep_layout=True).collect()}
    assert got == {0: "Start of\n it.\nThe  end.", 1: "other", 2: "a\n b"}


def test_substring_dedup_on_odd_rows(spark):
    odd = odd_rows(spark)
    got = remove_repeats(odd).collect()
    assert len(got) == odd.count()
    twice = [r for r in got if r["n_words"] == 60]
    assert len(twice) == 2 and all(r["n_removed"] == 60 and r["kept_text"] == "" for r in twice)
    assert {r["extra"]["n_words"] for r in got} == {"x", None}
    assert remove_repeats(empty(spark)).count() == 0


# -- near duplicates ----------------------------------------------------------------


def labelled(text, k=5):
    ws = words(text)
    grams = [tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))] if ws else []
    seen = Counter()
    out = []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def brute_classes(texts):
    """Classes of equal texts and of pairs with 0.8 of their labelled k-mers in common."""
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [set(labelled(t)) for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        both = len(a & b)
        if (texts[i] or "") == (texts[j] or "") or both and both >= 0.8 * (len(a) + len(b) - both):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def near_copies():
    rng = random.Random(8)
    texts = []
    for i in range(25):
        base = prose(500 + i, rng.randint(40, 300))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            ws = list(base)
            for _ in range(rng.choice([1, 1, 2, 4, 30])):
                ws[rng.randrange(len(ws))] = "other" + str(rng.random())
            texts.append(" ".join(ws))
    return texts + texts[:5] + ["too short", "too  short", "", None, "two words", "one two three four five"]


def test_classes_equal_all_pairs(spark):
    texts = near_copies()
    got = {r["doc_id"]: r for r in near_duplicate_classes(frame(spark, texts)).collect()}
    wanted = brute_classes(texts)
    assert [got[i]["class_id"] for i in range(len(texts))] == wanted
    sizes = Counter(wanted)
    assert all(r["copies"] == sizes[r["class_id"]] for r in got.values())
    assert {i for i, r in got.items() if r["keeps"]} == set(wanted)
    kept = drop_near_duplicates(frame(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(wanted))


def test_large_group_of_near_copies_is_one_class(spark):
    base = prose(600, 200)
    rng = random.Random(1)
    texts = [" ".join(base)]  # each copy is similar to it, though not to all other copies
    for _ in range(399):
        ws = list(base)
        for _ in range(3):
            ws[rng.randrange(len(ws))] = str(rng.random())
        texts.append(" ".join(ws))
    got = near_duplicate_classes(frame(spark, texts + [" ".join(prose(601, 200))])).collect()
    assert Counter(r["class_id"] for r in got) == {0: 400, 400: 1}


def test_alignment_is_the_longest_ordered_match_in_the_band():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a = rng.permutation(60).astype(np.uint64)
        b = a.copy()
        cut = rng.integers(0, 60, 2)
        b[cut.min() : cut.max()] = np.roll(b[cut.min() : cut.max()], 3)
        b[rng.integers(0, 60, 4)] = rng.integers(1000, 9000, 4)
        _, at = np.unique(b, return_index=True)
        b = b[np.sort(at)]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        best, total = table[-1, -1], len(a) + len(b)
        got = aligned(a, b, 0.8)
        assert got <= best and (best < 0.8 * (total - best) or got == best)


def test_near_dedup_on_odd_rows(spark):
    odd = odd_rows(spark)
    got = near_duplicate_classes(odd).collect()
    assert len(got) == odd.count()
    assert Counter((r["doc_id"], r["class_id"], r["copies"]) for r in got)[(1, 1, 2)] == 2
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sum(r["doc_id"] == 1 for r in kept.collect()) == 2  # two texts of one id
    assert kept.count() == len({r["class_id"] for r in got if r["class_id"] is not None}) + 2
    assert near_duplicate_classes(empty(spark)).count() == drop_near_duplicates(empty(spark)).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 301), (301, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_depend_on_order():
    from foldyard.llm.order_minhash import bands_of

    grams = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    params = SketchParams()
    assert (bands_of(grams, params) == bands_of(grams.copy(), params)).all()
    assert (bands_of(grams, params) == bands_of(grams[::-1].copy(), params)).sum() <= 1


# -- packing ------------------------------------------------------------------------


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


def test_boundaries_are_optimal():
    rng = np.random.default_rng(4)
    for buckets in (1, 2, 3, 4):
        lengths = rng.choice(np.arange(1, 60), 9, replace=False)
        counts = rng.integers(1, 50, 9)
        got = best_boundaries(lengths, counts, buckets)
        options = (c for k in range(1, buckets + 1) for c in itertools.combinations(sorted(lengths), k) if c[-1] == max(lengths))
        assert len(got) <= buckets
        assert padding(lengths, counts, got) == min(padding(lengths, counts, c) for c in options)
    assert best_boundaries(np.array([], int), np.array([], int), 3) == []


def test_batches_are_full_and_hold_every_token(spark):
    rng = random.Random(5)
    texts = [" ".join(["w"] * rng.choice([0, 1, 3, 7, 30, 31, 64, 65, 200])) for _ in range(500)]
    params = PackParams(max_tokens=64, buckets=3, token_budget=256, shard_rows=40)
    rows = pack(frame(spark, texts), params=params).collect()
    covered = {(r["doc_id"], t) for r in rows for t in range(r["first_token"], r["first_token"] + r["n_tokens"])}
    assert len(covered) == sum(r["n_tokens"] for r in rows) == sum(len(words(t)) for t in texts)
    assert len({r["bucket"] for r in rows}) <= 3
    for bucket in {r["bucket"] for r in rows}:
        own = [r for r in rows if r["bucket"] == bucket]
        size = Counter(r["batch"] for r in own)
        assert all(r["n_tokens"] <= bucket for r in own) and max(size) + 1 == len(size)
        assert all(size[b] == 256 // bucket for b in range(max(size)))
        assert len({(r["batch"], r["slot"]) for r in own}) == len(own)


def test_packing_odd_rows_and_settings(spark):
    odd = odd_rows(spark)
    rows = pack(odd).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(len(words(r["text"])) for r in odd.collect())
    assert pack(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        PackParams(max_tokens=10, token_budget=5)


# -- fingerprints -------------------------------------------------------------------


def jaccard(a, b):
    x, y = Counter(words(a)), Counter(words(b))
    keys = x.keys() | y.keys()
    return sum(min(x[k], y[k]) for k in keys) / sum(max(x[k], y[k]) for k in keys) if keys else 1.0


def test_collision_rate_is_generalised_jaccard(spark):
    common = prose(700, 80)
    texts = [" ".join(common * m + prose(701 + i, n)) for i, (m, n) in enumerate([(1, 10), (1, 40), (2, 40), (3, 5)])]
    got = [r["fingerprint"] for r in fingerprints(frame(spark, texts), samples=4096).orderBy("doc_id").collect()]
    cut = [[f[i : i + 4] for i in range(0, len(f), 4)] for f in got]
    for i, j in itertools.combinations(range(4), 2):
        near = np.mean([x == y for x, y in zip(cut[i], cut[j])])
        assert abs(near - jaccard(texts[i], texts[j])) < 0.04


def test_compared_with_the_next_document(spark):
    texts = [" ".join(prose(800 + i, 5 * i)) for i in range(30)] + ["", None, "é\U0001f600 x"]
    got = {r["doc_id"]: r for r in compare_with_next(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        text, following = text or "", texts[i - 1] or ""
        edited = edited_text(text, following)
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i]["near_edited"] - jaccard(text, edited)) < 0.3
        assert abs(got[i]["near_next"] - jaccard(text, following)) < 0.3
    whole = {r["doc_id"]: r["fingerprint"] for r in fingerprints(frame(spark, texts)).collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == whole


def test_fingerprints_of_odd_rows(spark):
    odd = odd_rows(spark)
    got = compare_with_next(odd).collect()
    assert len(got) == odd.count()
    by_text = {r["fingerprint"] for r in got if r["doc_id"] in (2, 3, 4)}
    assert by_text == {"0000" * 64}
    assert len({r["fingerprint"] for r in got if r["n_chars"] == len(" ".join(prose(1, 60))) + 1}) == 1
    assert compare_with_next(empty(spark)).count() == fingerprints(empty(spark)).count() == 0
    one = compare_with_next(frame(spark, ["a b c d"])).collect()
    assert one[0]["near_next"] == 1.0


def test_repeats_beside_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a b", 2, 3, 4)], "doc_id long, text string, `x.y` int, extra int, `a``b` int")
    got = remove_repeats(rows).first()
    assert got["extra"].asDict() == {"x.y": 2, "extra": 3, "a`b": 4}
