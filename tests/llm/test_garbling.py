import codecs
from collections import Counter

import numpy as np
import pytest
from conftest import rows

from palimpsest.llm import garbling as g

CLEAN = [
    "L’épreuve dure 35 minutes ; à l’âge de 323 ans, Varlen l’a réussie… « Lucid »",
    "Der Händler in Bryri verkauft für 216 Münzen – zurückkaufen möchte er nichts.",
    "Повышает скорость атаки, пока надет Гауло. Торговец продаёт за 310 монет.",
    "Gdy księżyc zajdzie, Ruorez wychodzi z jaskini i szuka łupów, ale już nie.",
    "ATENÇÃO: NÃO é possível entrar sem a bênção. Então o coração já não bate, SÃO 5.",
    "오류 수정: 밤에 폴텔의 문이 열리지 않던 문제를 고쳤습니다.",
    "最大の敵にダメージを与え、動きを遅くする。攻撃速度が上がります。",
    "You won’t get it – it’s 80 ° here, § 4, ½ price, ± 3 and © all",
]
WRONG = [("utf_8", "cp1252"), ("utf_8", "mac_roman"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp850"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("euc_jp", "cp1252"), ("cp949", "cp1252"), ("cp932", "cp1252"), ("koi8_r", "cp1251")]


def spoil(text, written, read):
    return codecs.charmap_decode(text.encode(written, "ignore"), "strict", g._DECODE[read])[0]


@pytest.fixture(scope="module")
def model():
    return g.Model(g.count(CLEAN * 50))


def test_each_wrong_reading_is_told_and_undone(model):
    seen = set()
    for written, read in WRONG:
        for text in CLEAN:
            if len(text.encode(written, "ignore").decode(written)) < len(text):
                continue  # not of that encoding
            bad = spoil(text, written, read)
            if bad == text:
                continue
            garbled, new, _ = g.restore(bad, model, 12.0)
            assert garbled, (written, read, bad)
            seen.add((written, read))
            if (written, read) in (("utf_8", "cp1252"), ("utf_8", "mac_roman")):
                assert new == text, (written, read, bad, new)
    assert len(seen) >= 9


def test_twice_in_part_entities_and_lost(model):
    text = CLEAN[1]
    assert g.restore(spoil(spoil(text, "utf_8", "cp1252"), "utf_8", "cp1252"), model, 12.0)[:2] == (True, text)
    half = CLEAN[0] + " " + spoil(text, "utf_8", "cp1252")
    assert g.restore(half, model, 12.0)[:2] == (True, CLEAN[0] + " " + text)
    assert g.restore("zur&Atilde;&frac14;ck", model, 12.0)[:2] == (True, "zurück")
    lost = g.restore("zur�ck", model, 12.0)
    assert lost[0] and not lost[2]


def test_clean_text_stays(model):
    for text in [*CLEAN, "plain", "a & b &amp; c", ""]:
        assert g.restore(text, model, 8.0) == (False, text, True)


def test_operator(spark):
    bad = [spoil(CLEAN[1], "utf_8", "cp1252"), spoil(CLEAN[1], "utf_8", "cp1252"), "zur�ck"]
    texts = [*CLEAN * 30, *bad, None, "", "  ", "ascii only", CLEAN[1] * 3000]
    df = spark.createDataFrame([(i, t, "x", True) for i, t in enumerate(texts)], "doc_id bigint, text string, restored string, complete boolean")
    got = rows(g.garbled(df))
    n = len(CLEAN) * 30
    assert [r[0] for r in got] == [n, n + 1, n + 2]
    assert got[0][1:] == (CLEAN[1], True) and got[2][1:] == ("zur�ck", False)
    assert rows(g.garbled(df.where("false"))) == []


def test_counts_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(t,) for t in CLEAN * 20], "text string")
    assert (g.train(df.repartition(1)) == g.train(df.repartition(7))).all()


def test_scores_add_up():
    m = g.Model(g.count(CLEAN))
    texts = ["für", "Münzen", "é", "zurückkaufen"]
    assert abs(m.logs(texts) - [m.logs([t])[0] for t in texts]).max() < 1e-5


def test_nothing_that_reaches_the_margin_is_left_untried(model):
    texts = [w for t in CLEAN for w in g.tokens(t)]
    texts += [w for t in CLEAN for a, b in WRONG for w in g.tokens(spoil(t, a, b))]
    for least in (2.0, 8.0):
        quick = g.Model(g.count(CLEAN * 50), least)
        for t in texts:
            full = model.best(t)
            got = quick.best(t)
            assert (got[1] == full[1] and abs(got[0] - full[0]) < 1e-6) or full[0] < least


def test_margin_is_validated_on_all_words_of_all_texts(spark):
    texts = [f"{CLEAN[i % 8]} {i}é" for i in range(1200)] + [" ".join([CLEAN[1], "größte"] * 3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = g.train(df)
    table = g.measured(df, counts)
    words = Counter(w for t in texts for w in {*g.tokens(t)} if not g.suspicious(w))
    assert words["größte"] == 1 and table[g._CLEAN].sum() == words.total() and table[g._SPOILT].sum() == sum(n for w, n in words.items() if g.spoilt(w) != w) > 2000
    assert (table == g.measured(df.repartition(7), counts)).all() and (table == g.gains(words.items(), g.Model(counts))).all()
    assert (g.gains(words.items(), g.Model(counts)) == g.gains(words.items(), g.Model(counts, enough=g.TOP))).all()


def test_a_text_garbled_as_a_whole_gains_no_less_than_a_word_of_it(model):
    for text in CLEAN:
        for chain in WRONG:
            each = [g.gain(spoil(w, *chain), model) for w in g.tokens(text)]
            assert not each or g.gain(spoil(text, *chain), model) >= max(each) - 1e-6 or "\u3000" in text or any(c.isspace() for w in g.tokens(text) for c in spoil(w, *chain))


def test_margin_is_not_moved_by_what_is_garbled_unnoticed(spark):
    """However many of the texts that pass for clean are garbled, the margin lies between what clean texts gain and what
    garbled ones do."""
    def table(unnoticed):
        out = np.zeros((2, g._STEPS), np.int64)
        at = lambda x: int(x / g.STEP)
        out[g._CLEAN, at(0.5)] += 9000
        out[g._CLEAN, at(5)] += 900
        out[g._CLEAN, at(20)] += unnoticed
        out[g._SPOILT, at(15)] += 100
        out[g._SPOILT, at(20)] += 9900
        return out

    found = [g.threshold(table(n)) for n in (0, 10, 100, 1000)]
    assert all(5 < m <= 20 for m in found) and max(found[1:]) - min(found[1:]) < 3
    assert g.threshold(np.zeros((2, g._STEPS), np.int64)) == g.UNVALIDATED


def test_the_validated_margin_is_the_one_used(spark):
    bad = spoil(CLEAN[1], "utf_8", "mac_roman")
    texts = [f"{CLEAN[i % 8]} {i}" for i in range(97)] + [f"{CLEAN[1] * 200} {i} {bad}" for i in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    counts = g.train(df)
    bound = g.margin(df, counts)
    assert bound == g.threshold(g.measured(df.repartition(3), counts))
    assert rows(g.garbled(df, restored=False)) == rows(g.garbled(df, counts=counts, bound=bound, restored=False)) == [(97,), (98,), (99,)]


def test_lost_characters_are_scored(model):
    """U+FFFD is garbling because the model finds it unlikely, not by itself: where it is usual it is left alone."""
    assert model.best("zur�ck")[0] > 12 and model.best("最大の敵�ダメージ")[0] > 12
    usual = g.count(CLEAN * 50 + ["a"])
    at = g._slots(np.frombuffer("  �� ".encode("utf-32-le"), np.uint32).astype(np.uint64), 1, g.TABLE)
    usual[at] += usual[-1]
    assert g.Model(usual).best("��")[0] < model.best("��")[0] - 10


def test_a_full_table_grows(spark):
    df = spark.createDataFrame([(t,) for t in CLEAN * 5], "text string")
    counts = g.train(df, slots=64)
    assert len(counts) - 1 > 512 and np.count_nonzero(counts[:-1]) <= g.FULL * (len(counts) - 1)


def test_a_larger_corpus_of_the_same_texts_changes_nothing():
    texts = [w for t in CLEAN for w in g.tokens(t)] + [w for t in CLEAN for a, b in WRONG for w in g.tokens(spoil(t, a, b))]
    counts = g.count(CLEAN * 500)
    one, many = g.Model(counts), g.Model(counts * 10**6)
    assert [one.best(t)[0] >= 10 for t in texts] == [many.best(t)[0] >= 10 for t in texts]


def test_counts_beyond_32_bits(spark):
    counts = g.count(CLEAN * 50)
    counts *= (1 << 33) // counts[-1]
    bad = spoil(CLEAN[1], "utf_8", "cp1252")
    df = spark.createDataFrame([(1, bad), (2, CLEAN[1])], "doc_id bigint, text string")
    assert rows(g.garbled(df, counts=counts, bound=12.0)) == [(1, CLEAN[1], True)]
    words = Counter(w for t in CLEAN for w in {*g.tokens(t)}).items()
    assert (g.measured(spark.createDataFrame([(t,) for t in CLEAN], "text string"), counts) == g.gains(words, g.Model(counts))).all()


def test_garbling_anywhere_in_a_long_word_is_found(model):
    clean = CLEAN[6] * 40
    bad = spoil(CLEAN[6], "utf_8", "cp1252")
    for at in (0, 17, 400, len(clean)):
        text = clean[:at] + bad + clean[at:]
        assert len(g.tokens(text)) == 1 and g.gain(text, model) > 30
        assert g.most(g.tokens(text), g.Model(model.counts, 10.0, 10.0)) >= 10
        assert g.restore(text, model, 12.0)[0]
    assert g.gain(clean, model) < 2
