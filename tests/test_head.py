import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators.extract import extract_content, extract_metadata

PAGES = [
    "<title>A &amp; b</title>", "<TITLE\n x='>'>one</title ><title>two", "<title></title>", "", None, "<title>a<b>c</title>",
    "<!-- <title>no</title> --><title>yes</title>", "<!-- <title>no", "<script>'<title>no</title>'</script><title>s</title>",
    "<div title='<meta property=og:title content=no>'><meta property=og:title content=yes>",
    "<textarea><title>no</title></textarea><title>t</title>", "<STYLE><meta name=description content=no></Style><meta name=description content=d>",
    "<meta name=description><meta name=description content=''><meta name=description content='x'><meta name=description content=y>",
    "<meta property='og:title' property='no' content=\"it's\" content=no>", "<meta/property=og:image/content=/a.png/>",
    "<link rel=canonical><link rel=canonical href=''><link href=/c rel='canonical'><link rel=canonical href=/d>",
    "<link rel='shortcut canonical' href=/no>", "<meta name='' content='unnamed'>", "<metadata content=x name=description>",
    "<meta name=description content='&notit; &copy &copyx &copy= &copy;= &lt;b&gt; &#65; &#x41 &#128; &#0; &#xD800; &#x110000; &#99999999999;'>",
    "<title>&notit; &copy &copyx &ampfoo; &nosuch; &#65 &#x1F600; &#128; &#11; &#xFFFE; &CounterClockwiseContourIntegral; & &;</title>",
    "<title>a</title><p class='x", "<p class='x<title>a</title>", "1 < 2 <title>t</title>", "<title>\r\n a\r b\0c 　</title>",
    "<?xml x><!doctype html></x y='>'><title>t</title>", "<a =x><title>t</title>", "<meta property=og:site_name content='S'><meta =name=description content=z>",
    "<!-- a --!><title>b</title>", "<noscript><meta name=description content=no></noscript><title>n</title>",
    "<title>a</titlex></title>b", "<meta name=description content=a&amp;b&#10;c>", "</title><title>x</title>", "< title>no</title>",
]
PIECES = [
    "<title>", "</title>", "<meta name=description content=\"", "\">", "'", "\"", ">", "<", "<!--", "-->", "<script>", "</script>", "a b ",
    "&amp;", "&lt", "&eacute;x", "&#233;", "<meta property='og:title' content='t'>", "<link rel=canonical href='/c?a=1&b=2'>", "<p class=x>", "=", "/",
    "<xmp>", "</xmp>", "<meta property=\"og:site_name\" content=\" S  T \"/>", "\n",
]


def _both(spark, pages):
    rows = spark.createDataFrame([(i, "https://a.org/p", p) for i, p in enumerate(pages)], "id int, url string, html string")
    read = {r["id"]: r["metadata"].asDict() for r in extract_content(rows).collect()}
    return read, {r["id"]: r["metadata"].asDict() for r in extract_metadata(rows).collect()}


def test_metadata_by_expressions_is_that_of_the_reader(spark):
    read, got = _both(spark, PAGES)
    assert {i: (PAGES[i], m) for i, m in got.items()} == {i: (PAGES[i], m) for i, m in read.items()}
    assert read[0]["title"] == "A & b"


@pytest.mark.parametrize("seed", range(3))
def test_random_pages(spark, seed):
    draw = random.Random(seed)
    pages = ["".join(draw.choices(PIECES, k=draw.randrange(1, 25))) for _ in range(400)]
    read, got = _both(spark, pages)
    differ = [(pages[i], read[i], got[i]) for i in read if read[i] != got[i]]
    assert not differ, differ[:3]


def test_no_python_in_the_plan_and_long_pages(spark):
    long = "<p>x &amp; y</p><!-- c -->" * 200_000 + "<title>end</title>"
    rows = spark.createDataFrame([("https://a.org/", long, 7)], "url string, html string, _extra int")
    out = extract_metadata(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InArrow" not in plan and "InPandas" not in plan and plan.count("regexp_extract_all(replace(") == 1
    assert out.select("metadata.title", "_extra").collect() == [("end", 7)]
    assert extract_metadata(rows.where(F.lit(False))).count() == 0
