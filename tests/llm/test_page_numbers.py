"""Page numbers are found by their sequence; numbers and words that only look like them stay."""

from strataloom.llm import scanned as S


def page(*inserts, lines=60):
    text = [f"the valve of line {i} runs on into the next one and" for i in range(lines)]
    for at, s in sorted(inserts, reverse=True):
        text.insert(at, s)
    return text


def gone(lines, title="Some other title"):
    return [lines[i] for i in sorted(S.furniture(lines, title))]


def test_lone_numbers_stay():
    assert gone(page((3, "5"), (8, "3"), (20, "12"), (22, "Total"), (40, "7"))) == []
    assert gone(page((3, "2019"), (20, "civil"), (40, "ill"), (50, "[9]"))) == []
    assert gone(["5", "3", "12", "Total", "7"]) == [] and gone([]) == [] and gone([""]) == []


def test_sequences_go():
    assert gone(page((3, "47"), (20, "48"), (38, "4 9"))) == ["47", "48", "4 9"]
    assert gone(page((3, "xiv"), (20, "xv"), (38, "xvi"))) == ["xiv", "xv", "xvi"]
    # a misread digit, a page whose number is missing, and a number from a table between them
    assert gone(page((1, "9"), (16, "lO"), (24, "77"), (48, "12"))) == ["9", "lO", "12"]
    # numbers of a list follow each other without pages between them
    assert gone(["1", "2", "3", "4"]) == []


def test_numbers_that_say_so_go():
    assert gone(page((10, "- 39 -"))) == ["- 39 -"] and gone(page((10, "Page 7"))) == ["Page 7"]


def test_number_beside_a_head():
    lines = page((10, "THE SEALED VALVE"), (10, "48"))
    assert gone(lines, "The sealed valve") == ["48", "THE SEALED VALVE"]


def test_values():
    assert [S.page_value(x) for x in ("4 7", "lO5", "xlv", "XIX", "civil", "ill", "iiii", "Xi", "")] == [47, 105, 45, 19, 0, 0, 0, 0, 0]


def test_long_words_and_many_readings():
    assert len(S.candidates("ilililililililil")) > 400
    assert S.candidates("") == []
