import random

import pytest
from conftest import rows

from palimpsest.llm.leakage import Matcher, body, distance, instructions, leaks, words


def levenshtein(p, t):
    best = len(p)
    row = list(range(len(p) + 1))
    for w in t:
        new = [0]
        for i, x in enumerate(p):
            new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_distance_is_levenshtein_to_the_nearest_part():
    rnd = random.Random(3)
    for _ in range(500):
        p = [rnd.randrange(4) for _ in range(rnd.randrange(1, 20))]
        t = [rnd.randrange(4) for _ in range(rnd.randrange(0, 30))]
        assert distance(p, t, 2) == levenshtein(p, t)


def test_words_do_not_depend_on_setting():
    plain = words("The keeper doesn't open the old gate")
    for text in ("THE KEEPER DOESN’T\\nOPEN   the #cold# gate.", "the <b>keep</b>er doesn't<br>open, the o­ld ga​te!", "> The keeper doesn't\n> open the “öld” gate"):
        assert words(text) == plain
    assert words(None) == words("") == words(" \n") == []


ITEM = "Read the text and answer. Near the umber tower nine patient herons carry silver letters toward a sleeping ferry while nobody counts the burning lanterns of Karond"


def test_instructions_are_no_part_of_an_item():
    known = frozenset({"read the text and answer"})
    assert body(ITEM, known)[0] == "near" and body(ITEM, frozenset())[0] == "read" and body(None, known) == []


def docs_of(item):
    w = item.split()
    yield 1, " ".join(w[5:17]), True  # twelve words
    yield 2, " ".join(w[5:14]), False  # nine
    yield 3, "x " + " ".join([*w[5:9], "zz", *w[10:13], *w[14:18]]) + " y", True  # one changed, one missing
    yield 4, " ".join([*w[5:8], "zz", *w[9:12], "zz", *w[13:16], "zz", *w[17:20], "zz", *w[21:24], "zz"]), False  # every fourth
    yield 5, ("filler words here " * 60_000) + " ".join(w[6:20]).upper(), True  # at the end of a very long text
    yield 6, "Read the text and answer. " + " ".join(w[5:12]), False  # the instruction counts for nothing
    yield 7, None, False
    yield 8, "  ", False
    yield 9, " ".join(w[5:17]), True  # a copy


@pytest.mark.parametrize("block", [100_000, 20])
def test_leaks(spark, block):
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t, _ in docs_of(ITEM)], "doc_id bigint, text string, task string, item_id int")
    items = [(1, ITEM, "x"), (2, ITEM, "x"), (3, None, "x"), (4, "too short", "x")] + [(10 + i, "Read the text and answer. " + " ".join(f"w{i}x{k}" for k in range(20)), "x") for i in range(6)]
    got = rows(leaks(docs, spark.createDataFrame(items, "item_id bigint, text string, task string"), block_words=block))
    assert got == sorted(((i, j) for i, _, hit in docs_of(ITEM) if hit for j in (1, 2)), key=repr)


def test_empty(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert rows(leaks(docs.where("false"), items)) == [] and rows(leaks(docs, items.where("false"))) == []


def test_against_brute_force_on_the_tables(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "eval_items"))
    known = frozenset({"choose the one answer that fits best", "read the passage and answer the question below", "which of the following statements is true"})
    bodies = {r.item_id: body(r.text, known) for r in items.collect()}
    some = {r.doc_id: words(r.text) for r in docs.orderBy("doc_id").collect()}
    got = {tuple(r) for r in leaks(docs, items).collect()}
    near = set()
    for d, ws in some.items():
        have = set(ws)
        for i, item in bodies.items():
            for s in range(len(item) - 11):
                run = item[s : s + 12]
                if sum(w in have for w in run) >= 10 and levenshtein(run, ws) <= 2:
                    near.add((d, i))
                    break
    assert got == near


def test_matcher_tells_each_item_once():
    w = [f"w{i}" for i in range(30)]
    assert Matcher([(7, w), (8, w[:11])], 12, 2).find(w * 3) == [7]


def test_copies_and_questions_on_one_passage_keep_their_sentences(spark):
    parts = ITEM.split(". ")[1].split()
    story = f"{' '.join(parts[:9])}. {' '.join(parts[9:])}."
    asked = [f"{story} Question {i} asks who row{i} is?" for i in range(5)]
    items = [(i, story) for i in range(5)] + [(10 + i, t) for i, t in enumerate(asked)]
    items = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "so " + " ".join(parts[2:20]))], "doc_id bigint, text string")
    assert instructions(items) == frozenset()
    assert rows(leaks(docs, items)) == sorted([(1, i) for i in (*range(5), *range(10, 15))], key=repr)


def test_any_number_of_instructions_behind_one_another(spark):
    heads = ["Read it", "Think well", "Take your time", "Be brief", "Answer now"]
    items = [(i, ". ".join([*heads, " ".join(f"w{i}x{k}" for k in range(30))])) for i in range(5)]
    assert instructions(spark.createDataFrame(items, "item_id bigint, text string")) == {h.lower() for h in heads}


@pytest.mark.parametrize("n", [5, 50])
def test_many_questions_on_one_passage(spark, n):
    passage = "Near the umber tower nine patient herons carry silver letters toward a sleeping ferry while nobody counts the lanterns."
    items = [(i, f"{passage} What colour is lantern number {i}?") for i in range(n)]
    docs = spark.createDataFrame([(1, passage), (2, "nothing at all")], "doc_id bigint, text string")
    assert rows(leaks(docs, spark.createDataFrame(items, "item_id bigint, text string"))) == sorted([(1, i) for i in range(n)], key=repr)


def test_four_instructions_match_nothing_and_are_told_apart(spark):
    heads = "Read it well. Think before you write. Be brief and clear. Mark the one answer that you find to be best of all five."
    items = [(i, f"{heads} " + " ".join(f"w{i}x{k}" for k in range(60))) for i in range(9)]
    docs = spark.createDataFrame([(1, heads), (2, heads + " " + " ".join(f"w3x{k}" for k in range(4))), (3, " ".join(f"w4x{k}" for k in range(12)))], "doc_id bigint, text string")
    items = spark.createDataFrame(items, "item_id bigint, text string")
    assert rows(leaks(docs, items)) == [(3, 4)]
    flagged = rows(leaks(docs, items, heads=True))
    assert [r for r in flagged if not r[2]] == [(3, 4, False)] and {r[:2] for r in flagged if r[2]} == {(d, i) for d in (1, 2) for i in range(9)}


def test_a_million_words_of_items_are_one_pass(spark):
    items = spark.range(20_000).selectExpr("id item_id", "concat_ws(' ', transform(sequence(0, 49), k -> concat('w', id * 50 + k))) text")
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(777_750 + 5, 777_750 + 20)))], "doc_id bigint, text string")
    found = leaks(docs, items)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert rows(found) == [(1, 15_555)]
