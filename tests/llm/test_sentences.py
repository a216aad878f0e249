import pytest

from tributary.llm import sentences as S

BODY = [
    "Dr. {n} reviewed the parser on Jan. 7 and approved it.", "No developer has touched core since 2010.", "The vote ended at 11:59 p.m.", "It took approx. 28.14 s to open the store.", "See e.g. the queue in main.cfg for an example.",
    "{n} asked, \"Is it ready? I can test it,\" and waited.", "Version 7.8 of tool is 18.35 times faster than 1.12.4.", "We like tool-cli!", "Is it tool-core?", "The parser needs formatters, etc.", "J. K. {n} maintains the feed.",
]
NAMES = ["Marlow", "Kestrin", "Ordway", "Pellin", "Sandovar"]


@pytest.fixture(scope="module")
def corpus(spark):
    docs, truth = [], {}
    for i in range(1500):
        parts = [BODY[(i * 7 + k * 5) % len(BODY)].format(n=NAMES[(i + k) % 5]) for k in range(2 + i % 4)]
        docs.append((i, " ".join(parts)))
        truth[i] = parts
    return docs, truth


def units(spark, docs):
    got: dict = {}
    text = dict(docs)
    for r in S.sentence_units(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["start_pos"], r["end_pos"]))
    return {k: [text[k][a:b] for a, b in sorted(v)] for k, v in got.items()}


def test_learned_boundaries_on_held_out_layout(spark, corpus):
    docs, truth = corpus
    got = units(spark, docs)
    right = sum(got[i] == truth[i] for i in truth)
    assert right >= 0.98 * len(truth), [(got[i], truth[i]) for i in truth if got[i] != truth[i]][:3]


CASES = [
    ("# Title Dr. X on tool\n\nHi all,\n\nOne line\nwrapped here. Next!\n\n- item one\n- item two\n\nBest regards, Kim", ["# Title Dr. X on tool", "Hi all,", "One line\nwrapped here.", "Next!", "- item one", "- item two", "Best regards, Kim"]),
    ("[10:00] ann: ok. Done!\n[10:01] bo: why? Because.", ["[10:00] ann: ok.", "Done!", "[10:01] bo: why?", "Because."]),
    ("他说：“失败了。请重试。”然后离开了。（已修复。）真的吗？！", ["他说：“失败了。请重试。”然后离开了。", "（已修复。）", "真的吗？！"]),
    ("彼は「もう一度？無理です。」と答えた。満杯です…。", ["彼は「もう一度？無理です。」と答えた。", "満杯です…。"]),
    ("แคชเต็มแล้ว รุ่น 2.0 เร็วกว่าเดิมมาก", ["แคชเต็มแล้ว", "รุ่น 2.0 เร็วกว่าเดิมมาก"]),
    ("यह क्या है? यह ठीक है। हाँ।", ["यह क्या है?", "यह ठीक है।", "हाँ।"]),
    ("لماذا؟ نعم!", ["لماذا؟", "نعم!"]),
    ("1. one\n2. two\n3. three", ["1. one", "2. two", "3. three"]),
    ("", []), ("  \n\n ", []), (None, []),
]


def test_layout_quotes_and_scripts(spark, corpus):
    docs = corpus[0] + [(10_000 + i, t) for i, (t, _) in enumerate(CASES)]
    got = units(spark, docs)
    for i, (t, want) in enumerate(CASES):
        assert got.get(10_000 + i, []) == want, t


def test_units_hold_all_non_blank_text_and_long_texts(spark, corpus):
    text = "A word follows here. " * 5000 + "\"unclosed and (so on"
    got = units(spark, corpus[0][:200] + [(99_999, text)])
    assert "".join("".join(u).replace(" ", "") for u in ["".join(got[99_999])]) == text.replace(" ", "")
    assert S.sentence_units(spark.createDataFrame([], "doc_id long, text string")).count() == 0
