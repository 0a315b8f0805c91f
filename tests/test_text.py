import random

import pytest

from gleanery.functions import text as X
from gleanery.functions.html import is_valid_content, parse_frontmatter
from pyspark.sql import functions as F

SAMPLES = ["", "a", "é", "中文", "👍🏽 ok", "áb", "x" * 50, "日本語テキスト" * 9, " lead", "� end �"]


def _cut(text: str, limit: int) -> str:
    return text.encode()[:limit].decode("utf-8", "ignore")


@pytest.mark.parametrize("limit", [1, 2, 3, 4, 5, 7, 11, 30])
def test_byte_cut_keeps_whole_characters(values, limit):
    rng = random.Random(limit)
    samples = SAMPLES + ["".join(rng.choice("aé中👍") for _ in range(rng.randrange(20))) for _ in range(60)]
    assert values(X.truncate_bytes("x", limit), samples) == [_cut(s, limit) for s in samples]


def test_byte_cut_off(values):
    assert values(X.truncate_bytes("x", 0), SAMPLES) == SAMPLES


def test_character_cut(values):
    assert values(X.truncate_chars("x", 3), ["", "abc", "abcd", "中文字符"]) == ["", "abc", "abc...", "中文字..."]


def test_spaces(values):
    odd = "　  \x85\x0b a   b\x0b "
    assert values(X.trim_space("x"), [odd, "", "​z"]) == ["a   b", "", "​z"]
    once = values(X.sanitize_text("x"), ["  a \t\n b\x0bc\r\n", odd, ""])
    assert once == ["a b\x0bc", "a   b", ""]
    assert values(X.sanitize_text("x"), once) == once


def test_newlines_and_tags(values):
    assert values(X.collapse_newlines("x"), ["a\n\n\n\n\nb\n\nc\n"]) == ["a\n\nb\n\nc\n"]
    assert values(X.strip_tags("x"), ["<p class='a'>b</p> 1<2 <"]) == ["b 1<2 <"]


def test_two_decimals_are_cut_toward_zero(values):
    assert values(X.trunc2(F.col("x").cast("double")), ["1.239", "-1.239", "0.009", "2"]) == [1.23, -1.23, 0.0, 2.0]


@pytest.mark.parametrize("kind, content, valid", [
    ("", "x" * 100, True), ("", " " + "x" * 99, False), (None, "中" * 34, True),
    ("application/json", " {} ", True), ("Text/XML; charset=x", " \n", False), ("application/xml", "a", True),
    ("text/plain", "abc", True), ("text/csv", " ab ", False), ("IMAGE/png", " ", True), ("video/mp4", "", False),
    ("audio/x", "1", True), ("application/pdf", "1", True), ("application/octet-stream", "", False),
    ("text/html", " " * 100, True), ("text/html", "中" * 33, False), ("weird", "x" * 99, False),
])
def test_validity(values, kind, content, valid):
    assert values(is_valid_content("x", F.lit(kind)), [content]) == [valid]


@pytest.mark.parametrize("text, body, meta", [
    ("plain", "plain", None),
    ("---\ntitle: a", "---\ntitle: a", None),
    ("---\n---\nbody", "---\n---\nbody", None),
    (" ---\na: b\n---\n", " ---\na: b\n---\n", None),
    ("---\n\n---\n body \n", "body", {}),
    ("---\ntitle: \"It's: \"\nno colon\n a : 'b' \na: c\n: v\n---more", "more",
     {"title": "It's: ", "a": "c", "": "v"}),
    ("---\nk: \"'q'\"\r\nx:\n----\nrest", "-\nrest", {"k": "q", "x": ""}),
])
def test_front_matter(values, text, body, meta):
    assert values(parse_frontmatter("x")["body"], [text]) == [body]
    assert values(parse_frontmatter("x")["meta"], [text]) == [meta]
