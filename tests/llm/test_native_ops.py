import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cases import empty, odd_rows, prose, words
from foldyard.llm import line_templates
from foldyard.llm.license_scan import NOTICES, find_spans, scan_licenses
from foldyard.llm.line_rules import clean_lines
from foldyard.llm.line_templates import VARIABLE, TreeLimits, drop_recurring_lines, masked_line


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def cleaned(spark, texts):
    rows = clean_lines(frame(spark, texts)).orderBy("doc_id").collect()
    return [r["cleaning"] for r in rows]


def repeat_words(text, size=8):
    ws = words(text)
    seen = Counter(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))
    covered = set()
    for i in range(len(ws) - size + 1):
        if seen[tuple(ws[i : i + size])] > 1:
            covered |= set(range(i, i + size))
    return len(covered)


def test_base_counts_equal_plain_python(spark):
    block = " ".join(prose(7, 9))
    texts = [
        " ".join(prose(5, 30)),
        f"{block}\n{block}\n\n{block} and {block}",
        "tick tick tick tick tick tick tick tick tick tick",
        "a#b *c $ %d & | < >\n a#b\n a#b\n",
        "x\x0by\x0cz\r\n ümlaut joined",
    ]
    for text, got in zip(texts, cleaned(spark, texts)):
        ws = words(text)
        lines = [x for x in text.split("\n") if words(x)]
        assert got["n_words"] == len(ws)
        assert got["word_chars"] == sum(map(len, ws))
        assert got["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        assert got["n_dup_lines"] == len(lines) - len(set(lines))
        assert got["n_repeat_words"] == repeat_words(text)
        assert got["base_failed"] == (len(ws) < 20 or 100 * repeat_words(text) > 30 * len(ws))


def test_lines_fail_alone_and_texts_that_lose_too_much_go(spark):
    body = " ".join(prose(8, 40)) + "."
    good, menu, mostly = cleaned(
        spark,
        [
            body,
            f"Home | News | Contact | Log in\n{body}\nWe use cookies on this site\nRead more",
            " ".join(w + "***" for w in prose(9, 60)) + f"\n{body}",
        ],
    )
    assert good["kept"] and good["n_failed"] == 0 and good["text"] == body
    assert menu["kept"] and menu["n_failed"] == 3 and menu["text"] == body
    assert not mostly["kept"] and not mostly["base_failed"] and mostly["text"] == body


def test_clean_prose_stays(spark):
    """Marks of other scripts, an open last sentence, a phrase named in an article."""
    long = " ".join(prose(41, 300))
    sentences = ". ".join(" ".join(prose(i, 15)) for i in range(20))
    texts = [
        long + "\u0964", long + " \u06d4", long + "\u061f", long + " \u0589",
        sentences + " and so it goes on", "\u3002".join(prose(43, 30)) + " " + long,
        sentences.replace("o", "o cookie ", 1) + ".", long + " javascript.",
    ]
    rows = clean_lines(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r["cleaning"]["n_failed"], r["cleaning"]["kept"]) for r in rows] == [(0, True)] * len(texts)
    bad = [long, "this site uses a cookie so please click here to go on and read.", "1.5 " + long]
    assert [r["cleaning"]["n_failed"] for r in clean_lines(frame(spark, bad)).orderBy("doc_id").collect()] == [1, 1, 1]


def test_unfinished_shouted_and_spaced_lines(spark):
    long = " ".join(prose(10, 20))
    rows = cleaned(spark, [long, long + " \t", long + '."', " ".join(w.upper() + "!!" for w in prose(11, 30))])
    assert [r["n_failed"] for r in rows] == [1, 1, 0, 1]


def test_rules_on_odd_rows_keep_other_columns(spark):
    odd = odd_rows(spark)
    got = clean_lines(odd, prefix="my_").collect()
    assert len(got) == odd.count()
    for r in got:
        assert r["my_cleaning"]["n_words"] == len(words(r["text"]))
        if not words(r["text"]):
            assert not r["my_cleaning"]["kept"] and r["my_cleaning"]["word_chars"] == 0
    assert {r["n_words"] for r in got} == {"x", None}
    assert clean_lines(empty(spark)).count() == 0


def test_license_places_and_labels(spark):
    texts = [
        "Under CC BY-NC 4.0; cc by cc by. All  rights, reserved",
        "This is licensed under the GNU General Public License, version 3.",
        "Licensed under the famous Apache License, Version 2.0.",
        "all rights not reserved; general public good license",
        "",
        None,
        "Released under the MİT license; released under the mit license.",
    ]
    got = {r["doc_id"]: r for r in scan_licenses(frame(spark, texts)).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"]) == (4, 1, 10)
    assert got[0]["base_labels"] == "cc-by,reserved"
    assert got[1]["base_labels"] == "gpl" and "gpl-3.0" in got[1]["labels"].split(",")
    assert got[2]["labels"] == "apache-2.0" and got[2]["n_base"] == 0
    assert got[3]["labels"] == "" and got[3]["score"] == 0
    assert got[4]["n_words"] == got[5]["n_words"] == 0 and got[5]["first_word"] is None
    assert got[6]["labels"] == "mit"


def test_inserted_word_is_one_span_and_two_notices_are_two(spark):
    line = "licensed under the apache license version 2 0"
    rows = find_spans(frame(spark, [line.replace("apache", "apache software"), f"{line} {line}"])).collect()
    found = {(r["doc_id"], r["first_word"], r["end_word"]) for r in rows if r["label"] == "apache-2.0"}
    assert found == {(0, 0, 9), (1, 0, 8), (1, 8, 16)}


def test_one_edit_is_allowed_and_neighbours_are_told_apart(spark):
    texts = {
        "Licensed under the Apache License 2.0": "apache-2.0",
        "licensed under the gnu lesser public license": "lgpl",
        "CC BY NC 3.0": "cc-by,cc-by-nc",
        "licensed under cc by sa 4 0": "cc-by,cc-by-sa,cc-by-sa-4.0",
        "licensed under the GNU General Public License, version 2": "gpl,gpl-2.0",
        "licensed under the GNU General Public License, version 3 only": "gpl,gpl-3.0",
        "released under the bsd license": "",
        "licensed under the terms of the school": "",
    }
    got = scan_licenses(frame(spark, list(texts))).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == list(texts.values())
    for text, label, key in NOTICES:
        ws = text.split()
        if len(ws) < 6:
            continue
        rows = [" ".join(ws[:i] + ["zzz"] + ws[i + 1 :]) for i in range(1, len(ws) - 1) if ws[i] != key]
        rows = rows[:-1] if ws[-1] == key else rows  # a key at the end needs the word before it
        found = scan_licenses(frame(spark, rows)).collect()
        assert all(label in r["labels"].split(",") for r in found), text


def test_license_scan_on_odd_rows(spark):
    odd = odd_rows(spark)
    assert scan_licenses(odd).count() == odd.count()
    assert scan_licenses(empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "cc by")] * 2 + [(None, "cc by")], "doc_id long, text string")
    assert [r["n_base"] for r in scan_licenses(twice).collect()] == [1, 1, 1]


def test_masked_line(spark):
    got = spark.createDataFrame([("  On\t12 May  v2.0 x ",)], "line string").select(masked_line(F.col("line"))).first()[0]
    assert got == f"On {VARIABLE} May {VARIABLE} x"


def template_texts():
    """Ten documents with a templated footer, one of them twice the same line."""
    names = prose(20, 10)
    out = []
    for i, name in enumerate(names):
        body = " ".join(prose(100 + i, 30))
        out.append(f"{body}\nPosted on {i + 10} May by {name}{i} in the main forum today\n{body[::-1]}")
    return out


def test_recurring_templates_stay_in_the_first_document(spark):
    texts = template_texts() + ["Posted on 3 May by nobody7 in the main forum today\n" * 3 + "end of it all"]
    got = {r["doc_id"]: r["dedup"] for r in drop_recurring_lines(frame(spark, texts)).collect()}
    assert got[0]["n_dropped"] == 0 and got[0]["text"] == texts[0]
    for i in range(1, 10):
        lines = texts[i].split("\n")
        assert got[i]["n_dropped"] == 1 and got[i]["text"] == f"{lines[0]}\n{lines[2]}"
    assert got[10]["n_dropped"] == 3 and got[10]["text"] == "end of it all"


def test_variable_words_generalise_but_unlike_lines_do_not(spark):
    names = prose(30, 12)
    same = [f"report written by {n} for the yearly meeting of members" for n in names]
    unlike = ["report written by " + " ".join(prose(200 + i, 7)) for i in range(12)]
    got = drop_recurring_lines(frame(spark, same + unlike)).orderBy("doc_id").collect()
    assert [r["dedup"]["n_dropped"] for r in got] == [0] + [1] * 11 + [0] * 12


def test_seven_documents_are_too_few_and_repeats_in_one_count_once(spark):
    line = "this very line recurs in the corpus"
    limits = TreeLimits(least_repeats=8)
    few = frame(spark, [line] * 7 + [f"{line}\n" * 20])
    got = drop_recurring_lines(few, limits=limits).where("doc_id < 7").collect()
    assert {r["dedup"]["n_dropped"] for r in got} == {0, 1}
    fewer = frame(spark, [f"{line}\n" * 20 + str(i) for i in range(7)])
    assert {r["dedup"]["n_dropped"] for r in drop_recurring_lines(fewer, limits=limits).collect()} == {0}
    named = [f"report number x{i}x was seen by the board of members" for i in range(7)]
    assert {r["dedup"]["n_dropped"] for r in drop_recurring_lines(frame(spark, named)).collect()} == {0}


def test_literal_repeats_need_two_documents(spark):
    line = "  this very\tline recurs in 2 documents "
    got = drop_recurring_lines(frame(spark, [f"{line}\n{line}", "a b", f"own words here\n{line.strip()}"])).orderBy("doc_id").collect()
    assert [r["dedup"]["n_dropped"] for r in got] == [0, 0, 1]
    assert got[2]["dedup"]["text"] == "own words here"


def sql_tables():
    """Tables on which the rules of the line tree tell apart what they should."""
    rng = random.Random(6)
    forums = [f"posted by {rng.choice('abcdefgh')}user{i} in {'abcdefghijklmnop'[i % 16]}forum since the first of may" for i in range(160)]
    club = [f"report written by {a}a for the yearly meeting of {b}b" for a in "cdefghijklmn" for b in "cdefghijklmn"]
    return {
        "numbers": [f"1990 {i} 45" for i in range(10)],
        "forums": forums,
        "forum_names": [f"it was posted by {prose(i, 1)[0]} in {'abcdefghijklmnop'[i % 16]}forum since the first of may" for i in range(160)],
        "club": club,
        "small_leaf": [f"it was posted by {n}{c} in the main forum" for n, c in zip(prose(3, 9), "abcdefghi")] + ["it was posted by nobody at all who signs"],
        "two_templates": [f"it was seen by {n} {'in the hall of the club' if i % 2 else 'at the gate of the yard'}" for i, n in enumerate(prose(5, 30))],
        "repeats": ["one and two", "one  and two\nthree and 4", "three and 4", None, "", "three and 5\nthree and 5"],
    }


@pytest.mark.parametrize("name", sorted(sql_tables()))
def test_line_rules_equal_the_sql(spark, tmp_path, name):
    texts = sql_tables()[name]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = duck.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({entry.oracle_sql()['op4_line_dedup']})").fetchall()
    got = entry.queries()["op4_line_dedup"](spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(wanted)
    dropped = sum(r[2] for r in wanted)
    assert dropped == {
        "numbers": 0, "forums": 159, "forum_names": 159, "club": 143, "small_leaf": 8, "two_templates": 28, "repeats": 2,
    }[name]


def test_large_tables_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(line_templates, "BROADCAST_ROWS", 0)
    texts = template_texts()
    got = drop_recurring_lines(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r["dedup"]["n_dropped"] for r in got] == [0] + [1] * (len(texts) - 1)


def test_rows_of_numbers_recur_only_as_literal_repeats(spark):
    rows = [f"{1990 + i} {i * 7} {i * 13}\nPrice: {i}.50 {i}\n12/{i} 3:{i} 4 won" for i in range(12)]
    got = drop_recurring_lines(frame(spark, rows)).collect()
    assert {r["dedup"]["n_dropped"] for r in got} == {0}
    assert all(r["dedup"]["text"] == r["text"] for r in got)
    same = [f"{i} {i + 1} {i + 2}\n1990 23{' ' * (1 + i % 2)}45" for i in range(12)]
    got = drop_recurring_lines(frame(spark, same)).orderBy("doc_id").collect()
    assert [r["dedup"]["n_dropped"] for r in got] == [0] + [1] * 11
    assert all(r["dedup"]["text"] == f"{r['doc_id']} {r['doc_id'] + 1} {r['doc_id'] + 2}" for r in got[1:])


def test_field_values_stay_variable_in_a_large_leaf(spark):
    """Each writer and each club stands in 12 documents, each pair of them in one."""
    texts = [f"report written by {a}a for the yearly meeting of {b}b" for a in "cdefghijklmn" for b in "cdefghijklmn"]
    got = drop_recurring_lines(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r["dedup"]["n_dropped"] for r in got] == [0] + [1] * 143


def test_line_dedup_on_odd_rows(spark):
    odd = odd_rows(spark)
    got = drop_recurring_lines(odd).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(map(str, (r["doc_id"] for r in odd.collect())))
    assert all(r["dedup"]["text"] == (r["text"] or "") for r in got)
    assert drop_recurring_lines(empty(spark)).count() == 0


@pytest.mark.parametrize("query", ["op4_line_dedup", "op7_quality_rules", "op9_license_scans"])
def test_no_python_in_native_plans(spark, query):
    from conftest import TESTDATA

    from foldyard.llm.queries import QUERIES

    plan = QUERIES[query](spark, str(TESTDATA))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))
