"""The pipeline's stages, one after another, against plain Python."""

import random
from collections import Counter

import corpus_pipeline
from cases import odd_rows, prose, words
from test_dedup_ops import brute_classes, without_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(9)
    footer = "this fixed footer line stands in many documents."
    passage = " ".join(prose(901, 60)) + "."
    texts = []
    for i in range(30):
        body = " ".join(prose(1000 + i, rng.randint(60, 150))) + "."
        lines = [body] + [footer] * (i % 2) + [passage] * (i % 7 == 0) + ["Home | News | Log in"] * (i % 5 == 0)
        texts.append("\n".join(lines))
    texts += [texts[3], texts[3].replace("ba", "ba", 1), texts[4] + " tail.", "short", None, " ".join(["x***"] * 50)]
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in enumerate(texts)], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_against_plain_python(spark):
    docs, stages = frame(spark, corpus()), dict(corpus_pipeline.STAGES)
    texts = {i: t for i, t in enumerate(corpus())}

    kept = by_id(stages["quality_rules"](spark, docs, ""))
    menu = {i: "\n".join(x for x in (t or "").split("\n") if "|" not in x) for i, t in texts.items()}
    assert {i: r["text"] for i, r in kept.items()} == {i: t for i, t in menu.items() if len(words(texts[i])) >= 20 and "***" not in t}

    docs = frame(spark, []).union(stages["quality_rules"](spark, docs, ""))
    lines = by_id(stages["line_dedup"](spark, docs, ""))
    count = Counter(x for r in kept.values() for x in set(r["text"].split("\n")))
    first = {x: min(i for i, r in kept.items() if x in r["text"].split("\n")) for x in count}
    wanted = {
        i: "\n".join(x for x in r["text"].split("\n") if count[x] < 8 or first[x] == i) for i, r in kept.items()
    }
    assert {i: r["text"] for i, r in lines.items()} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values())

    docs = stages["line_dedup"](spark, docs, "")
    near = by_id(stages["near_dedup"](spark, docs, ""))
    ids = sorted(wanted)
    classes = brute_classes([wanted[i] for i in ids])
    assert set(near) == {ids[c] for c in set(classes)}

    docs = stages["near_dedup"](spark, docs, "")
    cut = by_id(stages["substring_dedup"](spark, docs, ""))
    left = sorted(near)
    assert [words(cut[i]["text"]) for i in left] == without_repeats([near[i]["text"] for i in left], 35)

    packed = stages["packing"](spark, stages["substring_dedup"](spark, docs, ""), "").collect()
    assert sum(r["n_tokens"] for r in packed) == sum(len(words(r["text"])) for r in cut.values())


def test_run_equals_the_stages_in_turn(spark, tmp_path):
    frame(spark, corpus()).write.parquet(str(tmp_path / "documents.parquet"))
    docs = frame(spark, corpus())
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert name == "packing" or docs.columns == columns
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, docs.collect()))


def test_stages_on_odd_rows(spark):
    odd = odd_rows(spark).drop("extra", "dedup")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, "")
        assert got.collect() is not None
        if name != "packing":
            assert got.columns == odd.columns


def test_columns_of_any_name_come_through_every_stage(spark):
    names = "doc_id long, text string, dedup int, line_cleaning int, cleaning int, row int, extra int, `x.y` int"
    docs = spark.createDataFrame([(i, t, *range(1, 7)) for i, t in enumerate(corpus())], names)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, "")
        if name != "packing":
            assert got.columns == docs.columns
            assert {tuple(r)[2:] for r in got.collect()} == {tuple(range(1, 7))}
            docs = got
        assert got.count() > 0
