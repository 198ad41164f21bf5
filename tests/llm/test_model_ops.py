import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from cases import empty, odd_rows, prose
from conftest import TESTDATA
from foldyard.llm import factor_machine as fm
from foldyard.llm import maxent_lm as lm
from foldyard.llm.piece_viterbi import Encoder, Pieces, decode, encode
from foldyard.llm.queries_models import PIECES


def lower(text):
    return (text or "").encode().lower().split()


# -- language model -----------------------------------------------------------------


def base_scores(rows):
    counts = Counter()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(lower(text) + [None])
    n, v = sum(counts.values()), len(counts)
    known = {i: sum(counts[w] > 0 for w in lower(t) + [None]) for i, t in rows}
    scores = {i: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in lower(t) + [None]) for i, t in rows}
    return n, known, scores


def test_base_scores_equal_plain_python_and_the_model_beats_them(spark):
    docs = spark.read.parquet(str(TESTDATA / "documents.parquet")).select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    n, known, wanted = base_scores(rows)
    got = {r["doc_id"]: r for r in lm.train_and_score(docs.repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        assert got[i]["n_tokens"] == len(lower(text)) + 1
        assert got[i]["n_known"] == known[i] and got[i]["train_tokens"] == n
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert abs(got[i]["base_score"] - wanted[i]) < 1e-6 * abs(wanted[i])
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    words = lm.Vocabulary(100, 10, np.zeros(1, np.uint64), np.zeros(1, np.int64), rng.integers(1, 90, lm.CELLS).astype(float))
    model = lm.Model.start(words, lm.LmParams())
    model.class_weights[:] = rng.standard_normal(model.class_weights.shape)
    model.member_weights[:] = rng.standard_normal(model.member_weights.shape)
    history = np.array([5, 900, 37, 0], np.uint16)
    total = np.zeros(1)
    for cell in range(lm.CELLS):
        x = history.copy()
        x[3] = cell
        places = model.class_places(*lm.histories(x, np.zeros(1, np.int64), np.array([4])))
        outer, inner, _ = model.scores(places, x // lm.MEMBERS)
        total += np.exp(lm.log_chosen(outer, x // lm.MEMBERS) + lm.log_chosen(inner, x % lm.MEMBERS))[3:]
    assert abs(total[0] - 1) < 1e-3


def test_words_of_a_cell_share_it(spark):
    """Inside a cell the training words and one unseen word have probability 1 together."""
    docs = spark.createDataFrame([(i, " ".join(prose(i, 300))) for i in range(60)], "doc_id long, text string")
    schema = lm._block_schema(docs.schema["doc_id"].dataType)
    blocks = docs.mapInArrow(lm._make_blocks(lm.LmParams(), schema, 3), schema).cache()
    counted = blocks.where("part >= 0").select("block", "part", "words", "keys", "counts", "endings")
    words = lm._vocabulary(counted.groupBy("part").applyInArrow(lm._count_range, lm.COUNTED).cache())
    train = Counter(w for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2 for w in [x.encode() for x in prose(i, 300)])
    head = {lm.xxhash.xxh64_intdigest(w) for w in train} & set(words.head_keys.tolist())
    sums = np.zeros(lm.CELLS)
    for w, c in train.items():
        if lm.xxhash.xxh64_intdigest(w) not in head:
            sums[lm.HEAD + lm.ending(w)] += c + 1
    assert words.kinds == len(train) + 1 and words.tokens == sum(train.values()) + words.cell_tokens[0]
    assert np.allclose(sums[lm.HEAD :], words.cell_tokens[lm.HEAD :])


def test_history_starts_anew_in_each_document():
    a, b = np.array([3, 4, 5], np.uint16), np.array([9], np.uint16)
    one, two = lm.histories(np.concatenate([a, b, a]), np.array([0, 3, 4]), np.array([3, 1, 3]))
    s = lm.START
    assert one.tolist() == [s, 3, 4, s, s, 3, 4] and two.tolist() == [s, s, 3, s, s, s, 3]


def test_counted_cases_equal_token_by_token_sums():
    rng = np.random.default_rng(5)
    params = lm.LmParams(class_rows=1 << 8, member_rows=1 << 9)
    model = lm.Model.start(lm.Vocabulary(1, 1, np.zeros(1, np.uint64), np.zeros(1, np.int64), rng.integers(1, 9, lm.CELLS) * 1.0), params)
    model.class_weights[:] = rng.standard_normal(model.class_weights.shape)
    model.member_weights[:] = rng.standard_normal(model.member_weights.shape)
    one, two, cells = (rng.choice([0, 1, 40, 700, lm.CELLS - 1], 300) for _ in range(3))
    observed = {"class": np.zeros(model.class_weights.shape, np.int64), "member": np.zeros(model.member_weights.shape, np.int64)}
    expected = {k: np.zeros(v.shape, np.float32) for k, v in observed.items()}
    lm._count(model, (one * (lm.CELLS + 1) + two) * lm.CELLS + cells, observed, expected)
    wanted = {k: np.zeros(v.shape) for k, v in (*(("o" + k, v) for k, v in observed.items()), *(("e" + k, v) for k, v in expected.items()))}
    for a, b, cell in zip(one, two, cells):
        c, m = cell // lm.MEMBERS, cell % lm.MEMBERS
        places = model.class_places(np.array([a]), np.array([b]))
        z, y, inner = model.scores(places, np.array([c]))
        z, y = lm.softmax(z)[0], lm.softmax(y)[0]
        for p, q in zip(places, inner):
            wanted["oclass"][p[0], c] += 1
            wanted["omember"][q[0], m] += 1
            wanted["eclass"][p[0]] += z
            wanted["emember"][q[0]] += y
    for kind in observed:
        assert (observed[kind] == wanted["o" + kind]).all()
        np.testing.assert_allclose(expected[kind], wanted["e" + kind], rtol=1e-3, atol=1e-3)


def test_the_word_three_back_is_a_feature():
    rng = np.random.default_rng(6)
    params = lm.LmParams(class_rows=1 << 8, member_rows=1 << 9)
    model = lm.Model.start(lm.Vocabulary(1, 1, np.zeros(1, np.uint64), np.zeros(1, np.int64), rng.integers(1, 9, lm.CELLS) * 1.0), params)
    model.class_weights[:] = rng.standard_normal(model.class_weights.shape)
    model.member_weights[:] = rng.standard_normal(model.member_weights.shape)
    assert len(lm.histories(np.arange(5), np.zeros(1, np.int64), np.array([5]), lm.BACK)) == 3
    cells = rng.choice([0, 1, 40, 700, lm.CELLS - 1], 40_000)
    lengths = np.array([1, 2, 3, 4, 30_000, 9_990])
    history = lm.histories(cells, np.cumsum(lengths) - lengths, lengths, lm.BACK)
    observed = {"class": np.zeros(model.class_weights.shape, np.int64), "member": np.zeros(model.member_weights.shape, np.int64)}
    expected = {k: np.zeros(v.shape, np.float32) for k, v in observed.items()}
    lm._count(model, lm.case_keys(cells, *history), observed, expected)
    classes, members = cells // lm.MEMBERS, cells % lm.MEMBERS
    places = model.class_places(*history)
    z, y, inner = model.scores(places, classes)
    z, y = lm.softmax(z), lm.softmax(y)
    assert len(places) == lm.FEATURES == 4
    for kind, where, chosen, share in (("class", places, classes, z), ("member", inner, members, y)):
        seen, sums = np.zeros(observed[kind].shape, np.int64), np.zeros(observed[kind].shape)
        for p in where:
            np.add.at(seen, (p, chosen), 1)
            np.add.at(sums, p, share)
        assert (observed[kind] == seen).all()
        np.testing.assert_allclose(expected[kind], sums, rtol=1e-3, atol=1e-2)
    x = np.array([5, 6, 7, 8])
    scored = [
        lm.log_chosen(model.scores(model.class_places(*lm.histories(np.array([first, 6, 7, 8]), np.zeros(1, np.int64), np.array([4]), lm.BACK)), x // lm.MEMBERS)[1], x % lm.MEMBERS)
        for first in (5, 900)
    ]
    assert scored[0][3] != scored[1][3]  # three back


def quickest(f, times=7):
    def once():
        start = time.process_time()
        f()
        return time.process_time() - start

    return min(once() for _ in range(times))


def test_rows_are_added_without_sorting():
    """As sorting by place and adding up runs gives, in less time."""
    rng = np.random.default_rng(9)
    places = np.minimum(rng.pareto(0.8, 16_384) * 50, 4095).astype(np.uint16)
    rows = rng.random((len(places), lm.MEMBERS), np.float32)
    got, wanted = (np.zeros((4096, lm.MEMBERS), np.float32) for _ in range(2))

    def by_runs():
        order = np.argsort(places, kind="stable")
        ranked = places[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        wanted[ranked[first]] += np.add.reduceat(rows[order], first, axis=0)

    lm._add_rows(got, places, rows)
    by_runs()
    np.testing.assert_allclose(got, wanted, rtol=1e-4)
    assert quickest(lambda: lm._add_rows(got, places, rows)) < quickest(by_runs)


def test_shares_too_small_for_products_are_exact():
    rng = np.random.default_rng(10)
    params = lm.LmParams(class_rows=1 << 8, member_rows=1 << 9)
    model = lm.Model.start(lm.Vocabulary(1, 1, np.zeros(1, np.uint64), np.zeros(1, np.int64), rng.integers(1, 9, lm.CELLS) * 1.0), params)
    model.class_weights[:] = 60 * rng.standard_normal(model.class_weights.shape)
    model.member_weights[:] = 60 * rng.standard_normal(model.member_weights.shape)
    cells, lengths = rng.choice(lm.CELLS, 6_000), np.array([6_000])
    history = lm.histories(cells, np.zeros(1, np.int64), lengths, lm.BACK)
    classes, members = cells // lm.MEMBERS, cells % lm.MEMBERS
    places = model.class_places(*history)
    z, y, inner = model.scores(places, classes)
    observed = {"class": np.zeros(model.class_weights.shape, np.int64), "member": np.zeros(model.member_weights.shape, np.int64)}
    expected = {k: np.zeros(v.shape, np.float32) for k, v in observed.items()}
    lm._count(model, lm.case_keys(cells, *history), observed, expected)
    outer = lm.Powers.of(model.class_bias[None, :], model.class_weights)
    nested = lm.Powers.of(model.member_bias, model.member_weights)
    assert (lm.row_sums(nested.product(classes, inner)) < lm.TINY).any()
    for kind, powers, where, chosen, logs in (("class", outer, places, classes, z), ("member", nested, inner, members, y)):
        share = lm.softmax(logs.astype(np.float64))
        np.testing.assert_allclose(powers.chosen(classes, where, chosen), share[np.arange(len(cells)), chosen], rtol=1e-3, atol=1e-300)
        sums = np.zeros(expected[kind].shape)
        for p in where:
            np.add.at(sums, p, share)
        np.testing.assert_allclose(expected[kind], sums, rtol=1e-3, atol=1e-2)


def test_words_are_split_as_bytes_are():
    """At blanks of ASCII alone, A-Z lowered, each text by itself; in less time than word by word."""
    rng = random.Random(11)
    letters = [*" \t\n\x0b\x0c\r\x1c\x85\xa0AbZ\u00e9\u00c9\u4e2d\x00x", "\U0001f600"]
    for kind in (lm.pa.string(), lm.pa.large_string()):
        for _ in range(100):
            texts = [None if rng.random() < 0.1 else "".join(rng.choices(letters, k=rng.randint(0, 9))) for _ in range(6)]
            column, skipped = lm.pa.array(texts, kind), rng.randint(0, 6)
            wanted = [lower(t) for t in texts[skipped:]]
            words, counts = lm.split_words(column[skipped:])
            assert words.to_pylist() == sum(wanted, []) and counts.tolist() == [*map(len, wanted)]
            block = lm._Block()
            for a, b in lm._pieces_of(column):
                block.add([*range(a, b)], *lm.split_words(column[a:b]))
            names, tokens, lengths = block.numbered()
            wanted = [lower(t) for t in texts]
            names = [*lm._bytes_of(names), None]
            assert [names[k] for k in tokens] == [w for ws in wanted for w in [*ws, None]]
            assert lengths.tolist() == [len(ws) + 1 for ws in wanted] and block.ids == [*range(6)]
    texts = lm.pa.array([" ".join(prose(i, 1000)) for i in range(100)])

    def word_by_word():
        numbers = {}
        for text in texts:
            words = text.as_py().encode().lower().split()
            np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words))

    def numbered():
        block = lm._Block()
        block.add([*range(100)], *lm.split_words(texts))
        block.numbered()

    assert quickest(numbered) < quickest(word_by_word)


def test_long_batches_are_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(lm, "PIECE_BYTES", 10)
    for sizes in ([], [0], [3, 3, 3, 3], [25, 0, 1, 40, 2], [10, 10]):
        column = lm.pa.array(["x" * n for n in sizes], lm.pa.string())
        pieces = list(lm._pieces_of(column))
        assert [i for a, b in pieces for i in range(a, b)] == [*range(len(sizes))]
        assert all(sum(sizes[a + 1 : b]) < 10 for a, b in pieces)


def replayed_scores(rows, p):
    """The whole training and scoring, token by token; hashes and rows are the model's."""
    texts = {i: lower(t) + [None] for i, t in rows}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % p.folds != p.held_fold}
    key = {w: lm.END if w is None else lm.xxhash.xxh64_intdigest(w) for ws in texts.values() for w in ws}
    counts = Counter(w for i in train for w in texts[i])
    pairs = Counter(pair for i in train for pair in zip(["first", *texts[i]], texts[i]))
    signed = {w: k - (1 << 64) if k >= 1 << 63 else k for w, k in key.items()}
    top = sorted((w for w in counts if w is not None), key=lambda w: (-counts[w], signed[w]))[: lm.HEAD - 1]
    cell = {w: lm.HEAD + lm.ending(w) for w in key if w is not None} | {w: 1 + k for k, w in enumerate(top)} | {None: 0}
    held_in = np.zeros(lm.CELLS)
    for w, n in counts.items():
        held_in[cell[w]] += n + (cell[w] >= lm.HEAD)
    members = (held_in + 1).reshape(lm.CLASSES, lm.MEMBERS)
    class_bias = np.log(members.sum(axis=1) / members.sum())
    member_bias = np.log(members / members.sum(axis=1, keepdims=True))
    weights = {"class": np.zeros((p.class_rows, lm.CLASSES)), "member": np.zeros((p.member_rows, lm.MEMBERS))}
    hashing = lm.Model(p, None, None, None, None)

    def token(ws, at):
        back = [np.array([cell[ws[at - k]] if at >= k else lm.START]) for k in (1, 2, 3)]
        c, m = divmod(cell[ws[at]], lm.MEMBERS)
        outer = [int(x[0]) for x in hashing.class_places(*back)]
        inner = [int(hashing.member_place(np.array([x], np.uint16), np.array([c]))[0]) for x in outer]
        shares = [class_bias + sum(weights["class"][x] for x in outer), member_bias[c] + sum(weights["member"][x] for x in inner)]
        return [("class", outer, c, np.exp(shares[0]) / np.exp(shares[0]).sum()), ("member", inner, m, np.exp(shares[1]) / np.exp(shares[1]).sum())]

    for round_ in range(p.rounds):
        seen, due = ({k: np.zeros(w.shape) for k, w in weights.items()} for _ in range(2))
        for i in train:
            if zlib.crc32(str(i).encode()) // p.folds % p.rounds == round_:
                for at in range(len(texts[i])):
                    for kind, places, chosen, share in token(texts[i], at):
                        for x in places:
                            seen[kind][x, chosen] += 1
                            due[kind][x] += share
        for kind, prior in (("class", p.smoothing * np.exp(class_bias)), ("member", p.smoothing / lm.MEMBERS)):
            weights[kind] += p.rate / lm.FEATURES * np.log((seen[kind] + prior) / (due[kind] + prior))
    scores = {}
    for i, ws in texts.items():
        scores[i] = 0.0
        for at, w in enumerate(ws):
            share = math.prod(s[chosen] for _, _, chosen, s in token(ws, at))
            if cell[w] >= lm.HEAD:
                share *= (counts[w] + 1) / (held_in[cell[w]] + 1)
            before = ws[at - 1] if at else "first"
            n = counts[before] if at else len(train)
            g = p.pair_scale * (n + 1) ** p.pair_power
            scores[i] += math.log10((pairs[before, w] + g * share) / (n + g))
    return scores


def test_scores_equal_a_replay_token_by_token(spark):
    rows = [(i, " ".join(prose(i % 25, 30))) for i in range(30)] + [(90, None), (91, ""), (92, "Unseen WORDS here " * 3)]
    params = lm.LmParams(class_rows=1 << 10, member_rows=1 << 11)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm.train_and_score(docs, params=params).collect()}
    wanted = replayed_scores(rows, params)
    assert got.keys() == wanted.keys()
    assert all(abs(got[i] - wanted[i]) < 1e-3 * abs(wanted[i]) for i in wanted)


def test_pair_counts_come_back_to_every_block():
    rng = np.random.default_rng(8)
    keys = np.sort(rng.integers(1, 1 << 63, 50).astype(np.uint64))
    params, wanted, sent, blocks = lm.LmParams(), Counter(), [], []
    for number in range(3):
        tokens, lengths = rng.integers(0, 50, 400), np.array([1, 150, 249])
        ids = [number * 3 + k for k in range(3)]
        before = lm.neighbours(tokens, lengths, -1).tolist()
        train = np.repeat([lm.id_hash(i) % params.folds != params.held_fold for i in ids], lengths)
        wanted.update(pair for pair, t in zip(zip(before, tokens.tolist()), train) if t)
        row = {"doc_ids": ids, "block": number, "keys": keys.tobytes(), "tokens": lm._packed(tokens), "lengths": lengths.tobytes()}
        sent.append(lm.pa.RecordBatch.from_pylist([row]))
        blocks.append((row, list(zip(before, tokens.tolist()))))
    table = lm.pa.Table.from_batches(lm._send_pairs(params, 2)(iter(sent)))
    parts = sorted(set(table["part"].to_pylist()))
    assert parts == [0, 1, 2, 3]
    answers = lm.pa.concat_tables(
        lm._count_pairs([lm.pa.scalar(p)], table.filter(lm.pc.equal(table["part"], p))) for p in parts
    )
    for row, pairs in blocks:
        own = answers.filter(lm.pc.equal(answers["block"], row["block"]))
        assert lm._found_pairs(row, own).tolist() == [wanted[pair] for pair in pairs]


def test_packed_numbers_come_back():
    for values in ([], [0], [255, 256], [1 << 23, 1 << 24, 3], [(1 << 32) - 1, 0], [1 << 40]):
        assert lm._unpacked(lm._packed(np.array(values, np.int64))).tolist() == values


def held_loss(spark, rows):
    """Held-out log10 loss a token of the model, and of a discounted bigram."""
    got = lm.train_and_score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("held_out")
    total, tokens = got.groupBy().sum("score", "n_tokens").first()
    counts, pairs, kinds, after = Counter(), Counter(), Counter(), Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            words = lower(t) + [None]
            counts.update(words)
            pairs.update(zip(["first", *words], words))
    for (before, _), n in pairs.items():
        kinds[before] += 1
        after[before] += n
    whole = sum(counts.values()) + len(counts) + 1
    loss = 0.0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 == 2:
            words = lower(t) + [None]
            for before, w in zip(["first", *words], words):
                share, n = (counts[w] + 1) / whole, after[before]
                loss -= math.log10((max(pairs[before, w] - 0.75, 0) + 0.75 * kinds[before] * share) / n if n else share)
    return -total / tokens, loss / tokens


def test_held_out_loss_is_under_a_discounted_bigram(spark):
    docs = spark.read.parquet(str(TESTDATA.parent / "sf0.01" / "documents.parquet")).select("doc_id", "text")
    ours, bigram = held_loss(spark, [tuple(r) for r in docs.collect()])
    assert ours < bigram < 3.52


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, " ".join(prose(i % 40, 80))) for i in range(200)], "doc_id long, text string")
    one = {r["doc_id"]: r["score"] for r in lm.train_and_score(docs.repartition(1)).collect()}
    many = {r["doc_id"]: r["score"] for r in lm.train_and_score(docs.repartition(6)).collect()}
    assert all(abs(one[i] - many[i]) < 1e-2 for i in one)


def test_language_model_on_odd_rows(spark):
    odd = odd_rows(spark)
    got = lm.train_and_score(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {1}
    assert lm.train_and_score(empty(spark)).count() == 0
    unseen = lm.train_and_score(spark.createDataFrame([(7, "a b")], "doc_id long, text string"), params=lm.LmParams(folds=1, held_fold=0))
    assert unseen.first()["n_known"] == 0


# -- pieces -------------------------------------------------------------------------


TEXTS = [
    "Hello world, this is a test.",
    "  leading and   inner spaces  ",
    "naïve façade – Übermut 日本語 \U0001f600 \x00 end",
    "supercalifragilistic" * 40,
    "line one\nline two\t\ttabs",
    " ",
    "",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
]


def brute_path_score(pieces, unit, scores=None):
    scores = scores or {t: s for t, s, n in zip(pieces.texts, pieces.scores, pieces.normal) if n}
    unknown = min(scores.values()) - 10
    best = [0.0]
    for end in range(1, len(unit) + 1):
        options = [best[s] + scores[unit[s:end]] for s in range(end) if unit[s:end] in scores]
        if unit[end - 1] not in scores:
            options.append(best[end - 1] + unknown)
        best.append(max(options))
    return best[-1]


def test_paths_score_best_on_real_texts(spark):
    """Each unit of real texts against all segmentations, in double precision."""
    pieces = Pieces.read(PIECES)
    encoder = Encoder(pieces)
    docs = [r["text"] for r in spark.read.parquet(str(TESTDATA / "documents.parquet")).limit(60).collect()]
    scores = [encoder.unknown_score if i in pieces.bytes_.values() or i == pieces.unknown else s for i, s in enumerate(pieces.scores)]
    units = {u for text in TEXTS + docs for u in pieces.unit.findall("\u2581" + text.replace(" ", "\u2581"))}
    known = {t: s for t, s, n in zip(pieces.texts, pieces.scores, pieces.normal) if n}
    for unit in units:
        path = encoder.best_path(unit)
        # an unknown character is one cost, however many bytes it has
        text = "".join(pieces.texts[i] for i in path if pieces.normal[i])
        unknown = sum(c not in known for c in unit)
        got = sum(scores[i] for i in path if pieces.normal[i]) + unknown * encoder.unknown_score
        assert text == "".join(c for c in unit if c in known)
        assert math.isclose(got, brute_path_score(pieces, unit, known), rel_tol=1e-12)


def test_paths_are_best_on_a_small_alphabet():
    texts = ["a", "b", "ab", "ba", "aba", "bab", "abab", "aab"]
    pieces = Pieces(["<unk>", *texts], [0, -3, -3, -4, -4.5, -5, -6, -5.5, -7], [False] + [True] * 8, {}, 0)
    encoder = Encoder(pieces)
    scores = dict(zip(pieces.texts, pieces.scores))
    for k in range(1, 300):
        unit = "".join("abc"[(k * k + i * i * (k % 7 + 1)) % 3] for i in range(k % 17 + 1))
        path = encoder.best_path(unit)
        got = sum(scores[pieces.texts[i]] if i else encoder.unknown_score for i in path)
        assert math.isclose(got, brute_path_score(pieces, unit))


def test_round_trip_on_spark(spark):
    rows = spark.createDataFrame(list(enumerate([*TEXTS, None])), "doc_id long, text string")
    ids = encode(rows, PIECES)
    assert all(r["round_trip"] for r in ids.collect())
    back = {r["doc_id"]: r["text"] for r in decode(ids, PIECES).collect()}
    assert back == dict(enumerate([*TEXTS, ""]))
    docs = encode(spark.read.parquet(str(TESTDATA / "documents.parquet")), PIECES)
    assert docs.where("not round_trip").count() == 0


def test_pieces_of_odd_rows(spark):
    odd = odd_rows(spark)
    got = encode(odd, PIECES).collect()
    assert len(got) == odd.count() and all(r["round_trip"] for r in got)
    assert encode(empty(spark), PIECES).count() == 0


# -- quality ------------------------------------------------------------------------


def test_interactions_equal_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    machine = fm.Machine(0.3, rng.standard_normal(fm.INPUTS).astype(np.float32), rng.standard_normal((fm.INPUTS, 4)).astype(np.float32))
    inputs, values = rng.choice(fm.INPUTS, 12, replace=False), rng.random(12).astype(np.float32)
    got = machine.parts(inputs, values, np.array([0, 5]))[0]
    for part, value in ((slice(0, 5), got[0]), (slice(5, 12), got[1])):
        i, x = inputs[part], values[part]
        pairs = sum(machine.factors[i[a]] @ machine.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert math.isclose(value, 0.3 + machine.weights[i] @ x + pairs, rel_tol=1e-3)


def test_held_out_accuracy(spark):
    sf = TESTDATA.parent / "sf0.01"
    docs = spark.read.parquet(str(sf / "documents.parquet"))
    labels = spark.read.parquet(str(sf / "labels.parquet"))
    machine = fm.train(docs, labels)
    rows = fm.score(docs, machine).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    good = np.array([r["quality"] for r in rows])
    assert np.mean([r["predicted"] for r in rows] == good) > max(good.mean(), 0.9)


def test_only_text_and_length_matter(spark):
    rows = [(1, "some text here.", 15, "en"), (2, "some text here.", 15, "xx"), (None, None, None, None), (3, "", 0, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality long, toxic long")
    got = fm.score(docs, fm.train(docs, labels)).collect()
    assert len(got) == 4
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1


def test_quality_without_labels_and_on_odd_rows(spark):
    odd = odd_rows(spark)
    none = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    got = fm.score(odd, fm.train(odd, none)).collect()
    assert len(got) == odd.count() and {r["score"] for r in got} == {0.5}
    assert fm.score(empty(spark), fm.train(empty(spark), none)).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i}", 6) for i in range(300)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality long, toxic long")
    few = fm.train(docs, labels, fm.FmParams(max_rows=10))
    assert (few.weights != 0).sum() < 10 * 20


@pytest.mark.parametrize("value, level", [(0, 0), (1, 1), (2, 2), (3, 2), (4, 3), (10**9, 15)])
def test_levels(value, level):
    assert fm._log_level(np.array([value]))[0] == level


@pytest.mark.parametrize("width", [1, 2, 3, 12, 32])
def test_largest_of_each_row(width):
    x = np.random.default_rng(width).normal(size=(50, width)).astype(np.float32)
    assert np.array_equal(lm.row_max(x), x.max(axis=1, keepdims=True))
