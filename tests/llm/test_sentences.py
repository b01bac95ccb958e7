"""Sentence ends: texts divided by hand in several scripts, round trip, edge cases."""

import pytest

from tallyweir.llm.sentences import Splitter, boundary_model, sentence_ends, sentences

ITEMS = "item_id bigint, text string, sent_end string"

TEXTS = [
    ["The plant opened in May.", "Dr. Meyer spoke to 3.5 million viewers about No. 4 and the U.S. market.", "Was it true?", "Nobody knew!"],
    ['The chair said "Orders rose. Margins held." and sat down.', "It was late."],
    ["Das 4. Werk wurde im Jahr 2019 eröffnet.", "Die Aufträge stiegen danach."],
    ["会社は増産を続けます。", "社長は「受注は増えている。増産を続ける。」と述べました。", "需要は堅調です。"],
    ["公司销售增长。", "董事会表示：“订单在增加。我们会继续扩产。”并维持目标。", "市场恢复了吗？"],
    ["매출이 늘었습니다.", "수요는 회복될까요?", "네."],
    ["कंपनी की आय बढ़ी।", "क्या माँग लौटेगी?"],
]


@pytest.fixture(scope="module")
def model(spark):
    plain = [("The plant opened in May. Was it true? Nobody knew! It was late. Dr. Meyer spoke. Die Aufträge stiegen danach. Das Werk wuchs."), "Nobody knew. The plant opened again. It was true. Was it late?"] * 5
    rows = [(i, t, None) for i, t in enumerate(plain + ["".join(x) if ord(x[0][0]) > 0x3000 and not "가" <= x[0][0] <= "힣" else " ".join(x) for x in TEXTS])]
    return boundary_model(spark.createDataFrame(rows, ITEMS))


@pytest.mark.parametrize("parts", TEXTS, ids=lambda p: p[0][:8])
def test_hand_made(model, parts):
    glue = "" if ord(parts[0][0]) > 0x3000 and not "가" <= parts[0][0] <= "힣" else " "
    text = glue.join(parts)
    ends = Splitter(model).ends(text)
    assert [text[a:b].strip() for a, b in zip([0, *ends], ends)] == parts


def test_layout(model):
    text = "[tag]\nProducts and markets\n\n1. Pumps\n- valves, small\nThe plant opened in May. Nobody knew"
    ends = Splitter(model).ends(text)
    assert [text[a:b].strip() for a, b in zip([0, *ends], ends)] == ["[tag]", "Products and markets", "1. Pumps", "- valves, small", "The plant opened in May.", "Nobody knew"]


def test_edges(spark):
    rows = [(1, None, None), (2, "", None), (3, " \n\t ", None), (4, "No mark", "clash"), (4, "No mark", None), (5, "Word. " * 4000, None), (6, "!!!", None), (7, "….", None)]
    frame = spark.createDataFrame(rows, ITEMS)
    found = sentence_ends(frame).collect()
    assert {r["item_id"] for r in found} == {4, 5, 6, 7}
    assert [tuple(r) for r in found if r["item_id"] == 4] == [(4, 7)]
    assert max(r["sent_end"] for r in found if r["item_id"] == 5) == len(("Word. " * 4000).rstrip())
    whole = "".join(r["sentence"] for r in sentences(frame).where("item_id = 5").orderBy("sent_no").collect())
    assert whole.replace(" ", "") == "Word." * 4000
    assert sentence_ends(spark.createDataFrame([], ITEMS)).count() == 0


def test_no_limit_on_what_a_span_leaves_out(model):
    text = "They met " + "Dr. Meyer and " * 90 + "others. It was late."
    ends = Splitter(model).ends(text)
    assert [text[a:b].strip()[:9] for a, b in zip([0, *ends], ends)] == ["They met ", "It was la"]


def test_counts_read_long_blocks(spark):
    tail = "終端" * 3
    counted = boundary_model(spark.createDataFrame([(1, "字" * 5_000 + tail, None), (2, tail + "字" * 5_000 + tail, None)], ITEMS))
    assert counted["oi"]["終端"] >= 6


@pytest.mark.parametrize("piece,expected", [("1.", True), ("(12)", True), ("1.2)", True), ("iv.", True), ("가.", True), ("（三）", True), ("•", True), ("Item 1A.", True), ("Art. 5.", True), ("1234.", False), ("word.", False), ("..", False), ("--", False), ("", False), ("5", False)])
def test_enumerators(piece, expected):
    from tallyweir.llm.sentences import is_enumerator

    assert is_enumerator(piece) == expected


def test_model_keeps_every_word(spark):
    letters = "bcdfghjklmnpqrstvwxz"
    words = [a + "a" + b + "e" + c + "i" + d for a in letters for b in letters for c in letters for d in letters] + [a + "o" + b + "u" + c + "a" + d for a in letters for b in letters for c in letters for d in letters[:8]]
    rows = [(i, " ".join(words[i * 500 : i * 500 + 500]), None) for i in range(len(words) // 500)] * 2
    counted = boundary_model(spark.createDataFrame(rows, ITEMS))
    assert len(words) > 220_000 and sum(map(len, counted.values())) > 220_000
