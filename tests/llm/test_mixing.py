from fractions import Fraction

from conftest import rows
from pyspark.sql import functions as F

import numpy as np

from palimpsest.llm.mixing import frames, mix, plan, schedule, shares, source_name
from palimpsest.llm.queries import TOKENIZER


def test_schedule_stays_within_a_block():
    blocks = {"a": 1, "b": 37, "c": 300, "d": 12, "e": 0}
    every = sum(blocks.values())
    out = schedule(blocks)
    assert [slot for _, _, slot in out] == list(range(every))
    done = dict.fromkeys(blocks, 0)
    for s, k, slot in out:
        assert k == done[s]
        done[s] += 1
        for name, n in blocks.items():
            assert abs(done[name] - Fraction((slot + 1) * n, every)) < 1
    assert done == blocks and schedule({}) == []


def test_plan():
    need = plan({"a": 1000, "b": 10, "d": 5}, {"a": (0.5, 1), "b": (0.25, 4), "c": (0.15, 3), "d": (0.0, 3), "e": (0.1, None)})
    assert need == {"a": 80, "b": 40}
    assert plan({}, {"a": (1.0, 1)}) == {}


DOCS = [(i, f"word{i} and some more words of text " * (1 + i % 5), s) for i, s in enumerate(["Forum_Posts"] * 200 + [" forum-posts"] * 100 + ["TOOL tips"] * 20 + ["lore"] * 30 + [None, "other"] * 5)]
TARGETS = [("forum_posts", 0.5, 2), ("tool_tips", 0.2, 3), ("lore", 0.2, 5), ("absent", 0.1, 4)]


def run(spark, docs=DOCS, targets=TARGETS, **options):
    d = spark.createDataFrame([(*r, 5) for r in docs], "doc_id bigint, text string, source string, tokens int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return mix(d, t, TOKENIZER, **options), t


def test_shares_repeats_and_order(spark):
    docs = [(i, t, "lore" if s == "TOOL tips" else s) for i, t, s in DOCS] + [(900, None, "lore"), (901, " ", "lore"), (902, "", "lore")]
    docs += [(i, "tool tip text " * 4, "TOOL_TIPS ") for i in range(1000, 1020)]
    targets = [("forum_posts", 0.5, 2), ("tooltips", 0.2, 3), ("lore", 0.2, 5), ("absent", 0.1, 4)]
    out, t = run(spark, [(i, x, "tooltips" if s == "TOOL_TIPS " else s) for i, x, s in docs], targets)
    got = {r.source: r for r in shares(out, t).collect()}
    assert got["absent"].tokens == 0 and got["absent"].reached_share == 0
    for r in got.values():
        if r.source != "absent":
            assert abs(r.reached_share - r.target_share / 0.9) < 0.01
    assert got["tooltips"].most_copies == 3 and got["forum_posts"].most_copies <= 2 and got["lore"].most_copies <= 5
    assert out.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    assert out.where("doc_id in (900, 901, 902)").count() == 0
    one = out.where("source = 'forum_posts'").orderBy("slot", "start").select("start", "tokens").collect()
    assert [r.start for r in one] == [sum(x.tokens for x in one[:i]) for i in range(len(one))]


def test_names_and_empty(spark):
    df = spark.createDataFrame([(" A-b_C ",), (None,)], "s string")
    assert rows(df.select(source_name(F.col("s")))) == [("abc",), (None,)]
    out, t = run(spark, docs=[])
    assert out.count() == 0 and {r.tokens for r in shares(out, t).collect()} == {0}
    assert run(spark, targets=[])[0].count() == 0


def test_ten_million_blocks_stay_within_one():
    """At every slot of every frame no source is a block of its own ahead of or behind its tokens."""
    need = {"a": 9_000_000_123, "b": 7_777_777_777, "c": 3_456_789_012, "d": 245_000_001, "e": 1_000_003}
    repeats, share = frames(need, 2048, 10_000)
    m = sum(share.values())
    assert repeats * m >= 9_990_000 and abs(m - 10_000) <= 5
    owner = np.array([s for s, _, _ in schedule(share)])
    slots = np.arange(1, repeats * m + 1)
    for s, n in need.items():
        length = n / (repeats * share[s])
        assert share[s] == 1 or abs(length / 2048 - 1) < 0.5 / share[s] * 1.1
        given = np.cumsum(np.tile(owner == s, repeats)) * length
        assert np.abs(given - slots * (n / (repeats * m))).max() < length


def test_frames_repeat_in_order(spark):
    whole, t = run(spark)
    many, _ = run(spark, block=64, frame=10)
    pick = lambda df: sorted((r.doc_id, r.copy, r.start) for r in df.collect())
    assert pick(whole) == pick(many)
    rows_ = many.orderBy("slot", "start").collect()
    every = sum(r.tokens for r in rows_)
    assert max(r.slot for r in rows_) > 30
    share = {r.source: r.reached_share for r in shares(many, t).collect()}
    done = dict.fromkeys(share, 0)
    seen = 0
    longest = max(r.tokens for r in rows_)
    for r in rows_:
        done[r.source] += r.tokens
        seen += r.tokens
        for s, x in share.items():
            assert abs(done[s] - x * seen) < 2 * (80 + longest)
    assert seen == every and not any(rows_[i].slot > rows_[i + 1].slot for i in range(len(rows_) - 1))
